from collections import Counter
from itertools import combinations

from conftest import SF001
from tagweave.operators import entities as EN
from tagweave.operators import features as FE
from tagweave.operators import graph as GR
from tagweave.operators.lemma import Lemmatizer
from tagweave.sources.tables import read_table


def test_pair_counts_equal_brute_force(spark):
    docs = FE.prepare_documents(read_table(spark, SF001, "documents")).where("size(tokens) <= 400")
    toks = {r.doc_id: list(r.tokens) for r in docs.collect()}
    got = {}
    for r in GR.pair_counts(docs, k=5).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append((r.term, r["count"]))
    for d, t in toks.items():
        grams = list(combinations(t, 1)) + list(combinations(t, 2))
        want = [(" ".join(g), c) for g, c in Counter(grams).most_common(5)]
        assert got.get(d, []) == want, d


def test_textrank_path_golden():
    nodes, x = GR.pagerank_local(["a", "b"], ["b", "c"], 0.85, 3, None)
    assert [round(v, 6) for v in x] == [0.209729, 0.580542, 0.209729]


def test_textrank_edges_and_ranks(spark):
    docs = spark.createDataFrame([(1, "Spark joins data. Spark groups data, and Spark sorts!")], "doc_id long, text string")
    rows = GR.textrank(docs, top_n=3).orderBy("rank").collect()
    assert rows[0].term == "Spark" and len(rows) == 3


def test_entity_tags_rules(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License in 2020. MIT License again, 3rd of 5 May.")],
                                 "doc_id long, text string")
    gaz = spark.createDataFrame([("MIT License", "LAW"), ("MIT", "ORG"), ("May", "DATE")], "surface string, label string")
    tags = EN.entity_tags(EN.entity_spans(EN.entity_words(docs), gaz)).orderBy("label_rank", "entity_rank").collect()
    got = [(r.title, r.entity) for r in tags]
    assert got == [("Law", "MIT License"), ("Date", "2020"), ("Date", "May")]   # ORG "MIT" nested: dropped
    assert EN.capitalize is not None


def test_lemmas(spark):
    toks = spark.createDataFrame([(1, ["dogs", "boxes", "men", "glass", "cats"])], "doc_id long, tokens array<string>")
    lex = spark.createDataFrame([("dog",), ("box",), ("man",), ("glass",)], "lemma string")
    exc = spark.createDataFrame([("men", "man")], "form string, lemma string")
    out = Lemmatizer(lex, exc).apply(toks).first().tokens
    assert out == ["dog", "box", "man", "glass", "cats"]


def test_amounts_and_nesting(spark):
    docs = spark.createDataFrame([(1, "It costs $5.50 or 20 % of $3 million, not 7 apples; abc5% x. MIT License MIT")],
                                 "doc_id long, text string")
    gaz = spark.createDataFrame([("MIT License", "LAW"), ("MIT", "ORG")], "surface string, label string")
    spans = EN.entity_spans(EN.entity_words(docs), gaz, docs)
    got = [(r.label, r.entity) for r in spans.orderBy("start", "label").collect()]
    assert got == [("MONEY", "$5.50"), ("CARDINAL", "20"), ("PERCENT", "20 %"), ("MONEY", "$3 million"), ("CARDINAL", "7"),
                   ("LAW", "MIT License"), ("ORG", "MIT")]


def test_many_spans_in_one_document(spark):
    import time
    docs = spark.createDataFrame([(1, " ".join(str(i) for i in range(40_000)))], "doc_id long, text string")
    gaz = spark.createDataFrame([("1 2", "ORG")], "surface string, label string")
    t = time.time()
    assert EN.entity_spans(EN.entity_words(docs), gaz).count() == 39_999
    assert time.time() - t < 20


def test_textrank_raises_when_not_converged():
    import pytest
    with pytest.raises(ArithmeticError):
        GR.pagerank_local(["a", "b"], ["b", "c"], 0.85, 3, 1e-12)


def test_batched_pagerank_equals_single():
    import random
    import numpy as np
    r = random.Random(3)
    graph, ea, eb, single = [], [], [], []
    for g in range(30):
        edges = {tuple(sorted((f"t{r.randrange(9)}", f"t{r.randrange(9)}"))) for _ in range(r.randrange(12))}
        a, b = [x for x, _ in edges], [y for _, y in edges]
        graph += [g] * len(a)
        ea += a
        eb += b
        nodes, x = GR.pagerank_local(a, b, tol=1e-6)
        single += [(g, n, round(float(v), 12)) for n, v in zip(nodes, x)]
    owner, nodes, x = GR.pagerank_batch(np.array(graph), ea, eb, tol=1e-6)
    assert [(int(o), n, round(float(v), 12)) for o, n, v in zip(owner, nodes, x)] == single


def test_long_and_many_surfaces(spark):
    """A surface of 300 words and a gazetteer cut into several stripes give what a search by hand gives."""
    long = " ".join(f"w{i % 7}" for i in range(300))
    texts = {1: f"x {long} z É w0 w1", 2: " ".join(["w0", "w1"] * 200), 3: "", 4: "É"}
    docs = spark.createDataFrame([*texts.items(), (5, None)], "doc_id long, text string")
    gaz = [(long, "LAW"), ("w0 w1", "ORG"), ("w0 w1", "GPE"), ("É", "LOC"), ("w1 w0 w1", "ORG"), ("", "ORG"), ("w", "ORG")]
    df = spark.createDataFrame(gaz, "surface string, label string")
    want = set()
    for d, t in texts.items():
        ws = t.split()
        found = {(i, len(s.split()), s, lab) for s, lab in gaz if s for i in range(len(ws)) if ws[i:i + len(s.split())] == s.split()}
        want |= {(d, *a) for a in found if not any(b[1] > a[1] and b[0] <= a[0] and a[0] + a[1] <= b[0] + b[1] for b in found)}
    for stripe in (10, 1_000_000):
        got = EN.entity_spans(EN.entity_words(docs), df, stripe=stripe).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_replace_terms():
    import pyarrow as pa
    from tagweave.operators.lemma import replace_terms
    t = pa.array([["b", "a"], ["a", "b", "a"], [], ["c", "a"]])
    old, new = pa.array([["b"], ["a", "b"], [], []], pa.list_(pa.string())), pa.array([["x"], ["1", "2"], [], []], pa.list_(pa.string()))
    want = [["x", "a"], ["1", "2", "1"], [], ["c", "a"]]
    assert replace_terms(t, old, new).to_pylist() == want
    assert replace_terms(t.slice(1, 2), old.slice(1, 2), new.slice(1, 2)).to_pylist() == want[1:3]


def test_pair_counts_of_flat_documents_take_few_passes(monkeypatch):
    """Many words that repeat alike: first terms are counted many at a time, with the same ties as one by one."""
    import random
    from collections import Counter
    from tagweave.operators import graph as GR
    r = random.Random(5)
    for n, voc, k in ((1, 1, 5), (40, 30, 5), (60, 60, 3), (90, 20, 7), (30, 1, 2)):
        toks = [f"t{r.randrange(voc)}" for _ in range(n)]
        count, seen = Counter(), {}
        for i, x in enumerate(toks):
            count[x] += 1
            seen.setdefault(x, (0, i, 0))
            for j in range(i + 1, n):
                key = x + " " + toks[j]
                count[key] += 1
                seen.setdefault(key, (1, i, j))
        want = [(c, t) for t, c in sorted(count.items(), key=lambda tc: (-tc[1], seen[tc[0]]))[:k]]
        assert [(-e[0], e[4]) for e in GR._top_combinations(toks, k)] == want
    passes = []
    cumsum = GR.np.cumsum
    monkeypatch.setattr(GR.np, "cumsum", lambda *a, **kw: passes.append(1) or cumsum(*a, **kw))
    GR._top_combinations([f"t{i % 200}" for i in range(400)], 5)
    assert len(passes) < 20   # one for each of 200 first terms before


def test_spans_are_found_once_and_put_out_together(spark, monkeypatch):
    """The ranks of labels and entities come from one search, whose places leave a task in few batches."""
    monkeypatch.setattr(EN, "ROWS", 50)
    rows = [(i, " ".join(f"Name{(i + j) % 7} x" for j in range(i % 5))) for i in range(60)] + [(99, None), (98, "é\U0001F600 Name1 Name2")]
    gaz = spark.createDataFrame([(f"Name{i}", "ORG" if i % 2 else "GPE") for i in range(7)] + [("Name1 Name2", "PERSON")],
                                "surface string, label string")
    words = EN.entity_words(spark.createDataFrame(rows, "doc_id long, text string"))
    tags = EN.entity_tags(EN.entity_spans(words, gaz))
    assert tags._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = []
    for i, text in rows[:60]:
        names = list(dict.fromkeys(w for w in text.split() if w != "x"))
        label = lambda w: "Gpe" if int(w[-1]) % 2 == 0 else "Org"
        order = list(dict.fromkeys(map(label, names)))
        for lab in order:
            want += [(i, order.index(lab) + 1, lab, k + 1, w) for k, w in enumerate(x for x in names if label(x) == lab)]
    assert sorted(map(tuple, tags.collect())) == sorted(want + [(98, 1, "Person", 1, "Name1 Name2")])
