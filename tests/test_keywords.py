import math
import random
from collections import Counter

import pytest

from tagweave.operators import features as FE
from tagweave.operators.features import single_doc_tfidf, tfidf, one_topic_lda
from tagweave.operators.keywords import keyword_tags

SCHEMA = "doc_id long, tokens array<string>, headers string, styled string"


def _tags(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = keyword_tags(df, 0.2, headers="headers", styled="styled").orderBy("doc_id", "rank").collect()
    res = {}
    for r in out:
        res.setdefault(r.doc_id, []).append((r.tag, round(r.score, 6)))
    return res


def test_keyword_goldens(spark):
    words = [f"w{i:02d}" for i in range(30)]
    res = _tags(spark, [
        (1, "spark spark spark table".split(), "spark rocks", None),
        (2, "spark spark spark table".split(), "Spark rocks", "the table"),
        (3, words, None, None),
        (4, words, "w05 and w11", "w07"),
    ])
    assert res[1] == [("table", 0.333333), ("spark", 1.423025)]
    assert res[2] == [("table", 0.4), ("spark", 0.948683)]
    assert 3 not in res
    assert res[4] == [("w07", 0.219089), ("w05", 0.273861)]


def test_tfidf_defaults(spark):
    df = spark.createDataFrame([(1, "red red blue".split()), (2, "blue green".split()),
                                (3, "green green green".split())], "doc_id long, tokens array<string>")
    got = {(r.doc_id, r.term): round(r.weight, 6) for r in tfidf(df).collect()}
    assert got == {(1, "blue"): 0.355432, (1, "red"): 0.934702, (2, "blue"): 0.707107,
                   (2, "green"): 0.707107, (3, "green"): 1.0}


def test_single_doc_and_lda(spark):
    df = spark.createDataFrame([(1, "spark spark spark table".split())], "doc_id long, tokens array<string>")
    a = {r.term: round(r.score, 6) for r in single_doc_tfidf(df).collect()}
    assert a == {"spark": 0.948683, "table": 0.316228}
    b = [(r.rank, r.term, round(r.prob, 6)) for r in one_topic_lda(df).orderBy("rank").collect()]
    assert b == [(1, "spark", 0.666667), (2, "table", 0.333333)]


def test_top_ngrams_are_ranked_in_their_row(spark):
    """What is ranked by document has at most n rows a text, also where an id has several."""
    rows = [(1, "b a b a c".split()), (2, ["x"]), (3, []), (4, list("zyxw")), (5, "a a".split()), (5, "b b a".split())]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    counts = FE.ngram_counts(df, 1, 2)
    want = sorted(map(tuple, FE.top_terms(counts, 3, value="tf").select("doc_id", "rank", "term", "tf").collect()))
    got = FE.top_ngrams(df, 3)
    assert sorted(map(tuple, got.select("doc_id", "rank", "term", "tf").collect())) == want


def test_only_few_terms_of_a_document_are_scored(spark):
    """Ties at the tenth place, single letters, boosts: as if every term were scored, but no term of the bag is."""
    r = random.Random(7)
    rows = [(i, [r.choice("ab") if r.random() < 0.1 else f"w{int(r.paretovariate(0.4)) % 40}" for _ in range(r.randrange(60))],
             r.choice([None, "w1 w2 a", "w3"]), r.choice([None, "w1 w4 b"])) for i in range(150)]
    want = {}
    for i, toks, h, s in rows:
        tf = Counter(toks)
        norm = math.sqrt(sum(c * c for t, c in tf.items() if len(t) >= 2))
        top = sorted(tf, key=lambda t: (-tf[t], t))[:10]
        out = []
        for t, c in tf.items():
            boost = 1.5 if t in (h or "") else 1.2 if t in (s or "") else 1.0
            a = c / norm if len(t) >= 2 else 0.0
            b = (c + 1) / (len(toks) + len(tf)) if t in top else 0.0
            a = a * boost if (a > 0.2 or t in top) and a * boost > 0.2 else None
            b = b * boost if b * boost > 0.2 else None
            if a is not None or b is not None:
                first = b is None or (a is not None and a <= b)
                out.append((min(x for x in (a, b) if x is not None), 0 if first else 1, 0 if first else top.index(t) + 1, t,
                            max(x for x in (a, b) if x is not None)))
        if out:
            want[i] = [(t, round(score, 6)) for *_, t, score in sorted(out)]
    assert _tags(spark, rows) == want and len(want) > 100
    plan = keyword_tags(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan
