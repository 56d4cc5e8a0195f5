import json

from conftest import SF001
from tagweave.sources import tables as TB


def test_read_documents_formats(spark, tmp_path):
    p = tmp_path / "docs.jsonl"
    p.write_text("\n".join(json.dumps({"doc_id": i, "text": f"text {i}"}) for i in range(3)))
    d = TB.read_documents(spark, str(p), "json").select("doc_id", "text").orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in d] == [(0, "text 0"), (1, "text 1"), (2, "text 2")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("hello\nworld")
    t = TB.read_documents(spark, str(tmp_path / "t"), "text").collect()
    assert len(t) == 1 and t[0].text == "hello\nworld"


def test_evaluation_corpus_and_cap(spark):
    assert TB.evaluation_corpus(spark, SF001).count() == TB.read_table(spark, SF001, "documents").count()
    capped = [r.doc_id for r in TB.evaluation_corpus(spark, SF001, first_n=5).collect()]
    assert capped == sorted(capped) and len(capped) == 5 and capped[0] == 0


def test_conversation_documents_keep_turn_order(spark):
    conv = TB.conversation_documents(spark, SF001).orderBy("doc_id").first()
    turns = (TB.read_table(spark, SF001, "conversations").where(f"conv_id = {conv.doc_id}")
             .orderBy("turn").collect())
    assert conv.text == "\n".join(r.text for r in turns)
