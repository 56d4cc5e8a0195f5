"""Decontamination recall, learned scores on held-out rows, mixing invariants."""

import numpy as np
import pyarrow as pa
import pytest

from tagweave.llm import decontaminate, mixing, quality_rank, queries, toxicity
from tests.llm import helpers as H

SF = "/root/testdata/sf0.01"


def edited(r, w, k):
    w = list(w)
    for _ in range(k):
        p = r.randrange(len(w))
        kind = r.randrange(3)
        if kind == 0:
            w[p] = f"e{r.randrange(9999)}"
        elif kind == 1:
            w.insert(p, f"e{r.randrange(9999)}")
        else:
            w.pop(p)
    return w


def test_decontamination(spark):
    r = H.rng(11)
    items = [H.sentence(r, r.choice([8, 9, 10, 12, 15, 20, 40, 59, 96, 97, 150]), 4000) for _ in range(60)]
    rows, want = [], {}
    for d in range(100, 400):
        i = r.randrange(len(items))
        n, kind = len(items[i]), r.choice(["none", "exact", "edit", "third"])
        body = {"none": [], "exact": items[i], "edit": edited(r, items[i], r.randrange(n // 5 + 1)), "third": items[i][:n // 3]}[kind]
        text = " ".join(H.sentence(r, r.randrange(60), 4000) + body + H.sentence(r, r.randrange(60), 4000))
        rows.append((d, text.upper() if d % 5 == 0 else text.replace(" ", ", ") if d % 5 == 1 else text, "s"))
        want[d] = (kind, i, n)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(500, None), (501, "a b"), (None, "")],
                                  "item_id long, text string")
    docs = H.frame(spark, rows + H.awkward_rows(), "doc_id long, text string, item string")
    got = {(x.d, x.item) for x in decontaminate.contaminated(docs, bench).collect()}
    leaks = {(d, i) for d, (kind, i, n) in want.items() if kind in ("exact", "edit")}
    assert len(leaks - got) <= 0.01 * len(leaks)
    assert all((d, want[d][1]) == (d, i) and (want[d][0] != "third" or want[d][2] > decontaminate.PIECE)
               for d, i in got - leaks)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {x[0] for x in rows + H.awkward_rows()} - {d for d, _ in got}
    nothing = decontaminate.drop_contaminated(docs, bench.where("item_id = 501"))
    assert nothing.count() == docs.count()


def test_decontamination_with_bunched_edits(spark):
    """All edits allowed at the worst places: the words after the first one replaced or left out, or spread gaps."""
    r = H.rng(12)
    items = [H.sentence(r, n, 4000) for n in (10, 15, 20, 30, 45, 59, 96) for _ in range(4)]
    rows, want = [], set()
    for d in range(336):
        i = d % len(items)
        w, k, kind = items[i], len(items[i]) // 5, d // len(items) % 4
        gaps = {1 + j * (len(w) - 1) // k for j in range(k)}
        body = [w[:1] + H.sentence(r, k, 4000) + w[k + 1:], w[:1] + w[k + 1:], [x for j, x in enumerate(w) if j not in gaps],
                w[:-k - 1] + w[-1:]][kind]
        rows.append((d, " ".join(H.sentence(r, 40, 4000) + body + H.sentence(r, 40, 4000))))
        want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert len(want - {(x.d, x.item) for x in got}) <= 0.01 * len(want)
    assert all(x.edits <= x.n // 5 and 40 - x.n // 5 <= x.first_word <= 40 + x.n // 5 for x in got)


def plain_distance(item, words):
    """Edits of the window of ``words`` closest to ``item``."""
    prev = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        cur = [i]
        for j, b in enumerate(words, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return min(prev)


def test_decontamination_against_all_windows(spark):
    """Every window of every document against every item, short ones word for word."""
    r = H.rng(13)
    items = [H.sentence(r, n, 300) for n in (1, 2, 4, 5, 6, 7, 7, 8, 9, 12, 16, 25, 40) for _ in range(2)]
    texts = []
    for d in range(90):
        w = H.sentence(r, r.randrange(30), 300)
        for _ in range(r.randrange(3)):
            x = r.choice(items)
            w += edited(r, x, r.choice([0, 0, len(x) // 5, len(x) // 5 + 1])) + H.sentence(r, r.randrange(10), 300)
        texts.append(w)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    want = {(d, i): plain_distance(x, w) for d, w in enumerate(texts) for i, x in enumerate(items)}
    want = {k: e for k, e in want.items() if e <= (len(items[k[1]]) // 5 if len(items[k[1]]) >= decontaminate.LEAST else 0)}
    got = {(x.d, x.item): x for x in decontaminate.contaminated(docs, bench, least_words=1).collect()}
    assert set(got) <= set(want) and len(set(want) - set(got)) <= 0.01 * len(want)
    assert {k for k in want if k not in got} <= {k for k, e in want.items() if e}
    for (d, i), x in got.items():
        assert x.edits == want[d, i] and x.n == x.total == len(items[i]) and x.pieces_found == 1
        assert plain_distance(items[i], texts[d][x.first_word:x.first_word + x.n_words]) == x.edits
    phrases = {(d, i): min(p for p in range(len(w)) if w[p:p + len(items[i])] == items[i])
               for (d, i) in want for w in [texts[d]] if len(items[i]) < decontaminate.LEAST}
    assert {k: got[k].first_word for k in phrases} == phrases
    bad = {d for d, i in got if len(items[i]) >= decontaminate.EVIDENCE}
    assert {x.doc_id for x in decontaminate.drop_contaminated(docs, bench).collect()} == set(range(90)) - bad
    assert {d for d, _ in got} - bad


def test_decontamination_edges(spark):
    """Seven words quoted verbatim, parts of a long item, one id with several texts, null ids."""
    r = H.rng(14)
    seven, whole = H.sentence(r, 7, 5000), H.sentence(r, 300, 5000)
    fill = lambda: H.sentence(r, 20, 5000)
    rows = [(1, fill() + seven + fill()), (1, fill() + whole + fill()), (1, fill()), (None, whole[:80] + fill()),
            (None, fill()), (2, seven[:6] + fill()), (3, fill() + seven)]
    docs = spark.createDataFrame([(d, " ".join(w), "x") for d, w in rows], "doc_id long, text string, th string")
    bench = spark.createDataFrame([(7, " ".join(seven)), (7, " ".join(seven)), (8, " ".join(whole))], "item_id long, text string")
    got = sorted((-1 if x.d == 2**63 - 1 else x.d, x.item, x.n < x.total, x.total, x.pieces_found)
                 for x in decontaminate.contaminated(docs.drop("th"), bench).collect())
    assert got == [(-1, 8, True, 300, 1), (1, 7, False, 7, 1), (1, 8, True, 300, 4), (3, 7, False, 7, 1)]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id or -1, x.text) for x in kept.collect()) == sorted(
        (rows[i][0] or -1, " ".join(rows[i][1])) for i in (2, 4, 5))
    for one in (bench.where("item_id = 7"), bench.where("item_id = 8")):
        assert decontaminate.drop_contaminated(docs, one).count() == 5


def test_prefix_distance():
    r = np.random.default_rng(1)

    def plain(item, window):
        prev = list(range(len(window) + 1))
        for i, a in enumerate(item, 1):
            cur = [i]
            for j, b in enumerate(window, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
            prev = cur
        return min(prev)
    items = [r.integers(1, 5, r.integers(1, 12)).astype(np.uint64) for _ in range(60)]
    wins = [r.integers(1, 5, r.integers(1, 15)).astype(np.uint64) for _ in range(60)]
    off = lambda x: np.concatenate(([0], np.cumsum([len(v) for v in x])))
    pad = lambda x: decontaminate._pad(np.concatenate(x), off(x))
    got, _ = decontaminate.prefix_distance(pad(items), np.diff(off(items)), pad(wins), np.diff(off(wins)))
    assert got.tolist() == [plain(a, b) for a, b in zip(items, wins)]


def auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()


@pytest.mark.parametrize("name,label,least", [("op9_quality_rank", "quality", 0.98), ("op1_toxicity", "toxic", 0.88)])
def test_held_out_ranking(spark, name, label, least):
    out = queries.QUERIES[name](spark, SF).toPandas()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out["score"].between(0, 1).all()
    rows = out.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = rows[rows["held_out"]]
    assert auc(held["score"].to_numpy(), held[label].to_numpy()) >= least
    assert (held["predicted"] == held[label]).mean() >= 0.9


def test_repeated_lines_are_whole_lines():
    """Lines that only begin alike do not count as repeated; equal ones do, whatever their blanks."""
    at = quality_rank.FEATURES.index("repeated_lines")
    texts = ["the same start a\nthe same start b\nthe same start c", "one two\n\n one  two\nthree\none two",
             "one\ntwo", "two\none", "", "a b\nb a"]
    x = quality_rank.features(pa.array(texts))
    assert np.allclose(x[:, at], [0, 2 / 4, 0, 0, 0, 0])


def test_scores_of_awkward_tables(spark):
    docs = H.frame(spark, H.awkward_rows(), "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (6, None, None), (8, 0, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.where("quality = 1"), labels.where("doc_id < 0")):
        for rows in (quality_rank.rank_quality(docs, table), toxicity.score_documents(docs, table)):
            got = rows.collect()
            assert len(got) == 13 and all(0 <= x.score <= 1 for x in got)
            same = [x.score for x in got if x.doc_id == 5]
            assert len(same) == 2 and same[0] == same[1]


def test_windows_cover_every_word():
    doc, first = toxicity.windows(np.array([0, 1, 64, 65, 500]))
    for d, n in enumerate([0, 1, 64, 65, 500]):
        starts = first[doc == d]
        assert set(range(n)) <= {p for s in starts for p in range(s, s + toxicity.WINDOW)}
        assert len(starts) == 1 or (np.diff(starts) == toxicity.STRIDE).all()


def test_gru_gradients():
    """Backward pass against finite differences."""
    r = np.random.default_rng(2)
    x, u = r.normal(size=(5, 3, 24)), r.normal(size=(8, 24))
    weight = r.normal(size=(5, 3, 8))
    loss = lambda a, b: float((toxicity._gru(a, b, False)[0].astype(float) * weight).sum())
    _, saved = toxicity._gru(x, u, True)
    dx, du = toxicity._gru_back(weight, saved, u.astype(np.float32))
    for arr, grad in ((x, dx), (u, du)):
        for _ in range(10):
            i = tuple(r.integers(0, s) for s in arr.shape)
            old = arr[i]
            arr[i] = old + 1e-2
            up = loss(x, u)
            arr[i] = old - 1e-2
            down = loss(x, u)
            arr[i] = old
            assert abs((up - down) / 2e-2 - grad[i]) < 0.02 * max(1, abs(grad[i]))


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, list(order)
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        full = [s for s in open_ if w[s] * level >= cap * sizes[s]]
        if not full:
            target.update({s: w[s] * level for s in open_})
            break
        target.update({s: cap * sizes[s] for s in full})
        open_ = [s for s in open_ if s not in full]
    return target


def test_mixing(spark):
    r = H.rng(12)
    rows = [(i, " ".join(H.sentence(r, r.choice([0, 1, 5, 40, 900]))), s) for i, s in
            enumerate(["big"] * 120 + ["tiny"] * 3 + ["b"] * 20 + ["é"] * 20 + [None] * 10 + ["a"] * 2)]
    rows += [(1000, None, "void"), *H.awkward_rows()]
    docs = H.frame(spark, rows, "doc_id long, text string, source string")
    params = dict(block_words=64, blocks_per_shard=16, bucket_docs=7)
    out = mixing.mix(docs, **params).toPandas()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(H.words(t))
    want = brute_targets(sizes)
    assert len(out) == len(rows)
    assert (out["taken"] <= 3 * out["size"]).all()
    docs_rows, pieces = mixing.plan(docs, **params)
    d, p = docs_rows.toPandas(), pieces.toPandas()
    joined = d.merge(p.groupby("row")["n_words"].sum().rename("taken").reset_index(), on="row", how="left").fillna({"taken": 0})
    for s, group in joined.groupby("source", dropna=False):
        s = None if s is np.nan or s != s else s
        assert abs(group["target"].iloc[0] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(group["taken"].sum() - want[s]) <= 1
    # pieces are disjoint within an epoch, inside their documents, and shards are equally filled
    size = d.set_index("row")["size"]
    assert ((p["first_word"] >= 0) & (p["first_word"] + p["n_words"] <= p["row"].map(size))).all()
    assert (p.groupby(["row", "epoch"])["n_words"].sum() <= p.groupby(["row", "epoch"])["row"].first().map(size)).all()
    blocks = p.groupby("shard")["slot"].nunique()
    assert blocks.max() <= 16 and blocks.max() - blocks.min() <= 2  # halves are rounded at each level
    again = mixing.mix(docs, **params).toPandas()
    key = lambda f: sorted(zip(f["size"], f["taken"], f["doc_id"].fillna(-1), f["dealt"], f["n_shards"]))
    assert key(out) == key(again)
    # the tree's deal shows: one shard instead of many takes the same words to other places
    one = mixing.mix(docs, **{**params, "blocks_per_shard": 10**6}).toPandas()
    plain = lambda f: sorted(zip(f["doc_id"].fillna(-1), f["size"], f["target"], f["taken"]))
    assert plain(one) == plain(out) and (out["n_shards"] > 1).any() and one["n_shards"].max() == 1
    assert set(one["dealt"]) != set(out["dealt"]) and ((out["dealt"] == "") == (out["taken"] == 0)).all()


def test_split_node_is_exact():
    import pandas as pd
    pdf = pd.DataFrame({"lo": 0, "hi": 37, "rank": [0, 1, 2], "n": [1000, 1, 363]})
    out = mixing._split_node(7)(pdf)
    assert out.groupby("rank")["n"].sum().tolist() == [1000, 1, 363]
    assert (out["hi"] - out["lo"] == 1).all() and out["lo"].nunique() == 37
    per = out.groupby("lo")["n"].sum()
    assert per.max() - per.min() <= 2  # halves are rounded at each level
