"""The corpus pipeline, its registration, and queries on empty tables."""

import os

import pytest

import corpus_pipeline
from tagweave.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules, queries, toxicity, quality_rank
from tagweave.llm import chat_format, license_scan, substring_dedup
from tests.llm import helpers as H
from tests.llm.test_dedup import brute_groups, brute_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert any(x.startswith(f"op{n}_") for x in names)
    assert "pipeline" in names and "keyword_tags" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "mix"]


def make_docs():
    r = H.rng(20)
    item = H.sentence(r, 30, 5000)
    rows = []
    for i in range(60):
        w = H.sentence(r, 60, 20_000)
        if i % 12 == 0:
            w[20:20] = item
        text = " ".join(w) + ("\nShared Footer line" if i % 2 else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    base = rows[7][1].split()
    for i in range(60, 66):  # near copies of document 7
        w = list(base)
        w[i - 40] = "changed"
        rows.append((i, " ".join(w), "en", "s1", 1))
    rows += [(70, None, None, None, None), (71, "too short", "en", "s0", 9), (72, "again and " * 60, "en", "s0", 600)]
    return rows, " ".join(item)


def test_pipeline_stages(spark, tmp_path):
    rows, item = make_docs()
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: sorted(x.doc_id for x in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality_rules"](spark, docs, d)
    assert one.columns == docs.columns and ids(one) == list(range(66))
    two = stages["line_dedup"](spark, one, d)
    kept = [r for r in rows if r[0] < 66]
    assert two.columns == docs.columns
    assert sorted((x.doc_id, x.text) for x in two.collect()) == sorted((a, b) for a, _, _, b in brute_lines(kept, 10))
    assert all(x.n_chars == len(x.text) for x in two.collect())
    three = stages["near_dedup"](spark, two, d)
    groups = brute_groups([(x.doc_id, x.text) for x in two.collect()], 5)
    left = sorted({c for _, _, c in groups})
    assert ids(three) == left and len(left) < 66
    four = stages["decontaminate"](spark, three, d)
    assert four.columns == docs.columns and ids(four) == [i for i in left if i % 12 or i >= 60]
    five = stages["mix"](spark, four, d)
    assert ids(five) == ids(four)
    run = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, five.collect()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (line_dedup.drop_frequent_lines(docs), substring_dedup.remove_repeats(docs), quality_rules.apply_rules(docs),
               near_dedup.keep_one(docs), decontaminate.contaminated(docs, items), decontaminate.drop_contaminated(docs, items),
               mixing.mix(docs), license_scan.scan(docs), quality_rank.rank_quality(docs, labels),
               toxicity.score_documents(docs, labels), chat_format.digest(chat_format.format_conversations(conv))):
        assert df.collect() == []


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_line_dedup", "op6_quality_rules", "op7_chat_format", "op10_near_dedup"])
def test_oracles(spark, name):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(tuple(x[c] for c in order) for x in got.collect()) == sorted(
        tuple(dict(zip(want.columns, x))[c] for c in order) for x in want.fetchall())
