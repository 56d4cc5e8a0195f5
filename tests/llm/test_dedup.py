"""Line, substring and near-duplicate dedup against brute force."""

from collections import Counter, defaultdict

import pytest

from tagweave.llm import components, line_dedup, near_dedup, substring_dedup
from tests.llm import helpers as H


def brute_lines(rows, min_docs):
    key = lambda x: H.lower(x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < min_docs]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(spark, batches, fanout):
    r = H.rng(2)
    common = [f"  Common Line {i}\t" for i in range(12)]
    rows = [(i, "\n".join([" ".join(H.sentence(r, 4)) for _ in range(r.randrange(4))]
                          + [r.choice(common + [x.upper() for x in common]) for _ in range(r.randrange(6))]), "s")
            for i in range(60)] + H.awkward_rows()
    got = line_dedup.drop_frequent_lines(H.frame(spark, rows), min_docs=10, batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    assert sorted([(x.doc_id, x.n_lines, x.n_dropped, x.text) for x in got.collect()], key=str) == brute_lines(rows, 10)


def test_line_runs_settle_and_compact(spark):
    runs = line_dedup.LineRuns(spark, limit=3, fanout=2)
    for batch in ([(1, 1, 1), (2, 2, 3)], [(1, 1, 1), (3, 3, 1)], [(1, 1, 1), (2, 2, 5), (3, 3, 1)], [(4, 4, 2)]):
        runs.add(spark.createDataFrame(batch, line_dedup.RUN))
    assert len(runs.settled) == 3 and [len(x) for x in runs.levels] == [0, 0, 1]
    assert sorted(x.ka for x in runs.frequent().collect()) == [1, 2]


def brute_substrings(rows):
    ids = [2**63 - 1 if d is None else d for d, *_ in rows]
    texts = [H.words(t) for _, t, *_ in rows]
    first = {}
    for i, w in zip(ids, texts):
        for p in range(len(w) - 12):
            g = tuple(w[p:p + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for (d, *_), i, w in zip(rows, ids, texts):
        cut = {q for p in range(len(w) - 12) if first[tuple(w[p:p + 13])] < i for q in range(p, p + 13)}
        out.append((d, len(w), len(cut), " ".join(x for p, x in enumerate(w) if p not in cut)))
    return sorted(out, key=str)


def test_substring_dedup(spark):
    r = H.rng(5)
    base = H.sentence(r, 400)
    rows = []
    for d in range(90):
        w = H.sentence(r, r.choice([0, 3, 12, 13, 14, 60]), 30)
        for _ in range(r.randrange(4)):
            a, n, i = r.randrange(380), r.choice([12, 13, 14, 20, 60]), r.randrange(len(w) + 1)
            w[i:i] = base[a:a + n]
        rows.append((d * 7 % 90, " ".join(w * 2 if d % 10 == 0 else w), "s"))
    rows += H.awkward_rows() + [(500, " ".join(["a"] * 60), "s"), (501, " ".join(["a"] * 30), "s")]
    got = substring_dedup.remove_repeats(H.frame(spark, rows))
    assert sorted([(x.doc_id, x.n_words, x.n_removed, x.text) for x in got.collect()], key=str) == brute_substrings(rows)


def test_paths_cover_every_window_once():
    from tagweave.llm.words import split_words, string_bytes
    import pyarrow as pa
    r = H.rng(3)
    texts = [" ".join(H.sentence(r, n, 20)) for n in (0, 5, 13, 14, 40, 200)] + [" ".join(["z"] * 50)]
    w = split_words(*string_bytes(pa.array(texts)))
    _, _, doc, start, count = substring_dedup.minimizer_paths(w)
    seen = Counter((d, s + i) for d, s, c in zip(doc, start, count) for i in range(c))
    assert set(seen.values()) <= {1}
    assert len(seen) == sum(max(0, len(H.words(t)) - 12) for t in texts)


def shingles(text, k, low=True):
    w = H.words(H.lower(text) if low else text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_groups(rows, k, percent=80):
    sets = [shingles(t, k) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    name = defaultdict(lambda: 10**9)
    for i, (d, *_) in enumerate(rows):
        name[find(i)] = min(name[find(i)], d)
    return sorted((d, len(sets[i]), name[find(i)]) for i, (d, *_) in enumerate(rows))


@pytest.mark.parametrize("cap", [256, 6])
def test_near_dedup_dense_families(spark, monkeypatch, cap):
    """With a small cap dense regions and large families go through the block comparisons."""
    monkeypatch.setattr(near_dedup, "CAP", cap)
    r = H.rng(4)
    rows = []
    for _ in range(2):
        base = H.sentence(r, 150, 3000)
        for _ in range(70):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8])):
                w[r.randrange(len(w))] = f"y{r.randrange(3000)}"
            rows.append(" ".join(w))
    rows += [" ".join(r.choice("a B c D".split()) for _ in range(r.randrange(7))) for _ in range(50)] + [None, "", "x" * 10]
    r.shuffle(rows)
    rows = [(i * 7 % len(rows), t, "s") for i, t in enumerate(rows)]
    got = near_dedup.near_duplicates(near_dedup.with_ids(H.frame(spark, rows)))
    assert sorted((x.d, x.n_shingles, x.component) for x in got.collect()) == brute_groups(rows, 4)


def test_keep_one(spark):
    rows = H.awkward_rows()
    got = near_dedup.keep_one(H.frame(spark, rows, "doc_id long, text string, d string"))
    assert got.columns == ["doc_id", "text", "d"]
    kept = sorted([(x.doc_id, x.text) for x in got.collect()], key=str)
    # copies of the long text (3, 4), of 'one' (6, 7) and the repeated row 5 stay once
    want = {(d, t) for d, t, _ in rows} - {(4, rows[6][1]), (7, "one")}
    assert kept == sorted(want, key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(700)] + [(1000, 1001), (1001, 1000), (7, 7), (2000, 3)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(701)}, 1000: 1000, 1001: 1000, 2000: 0}


def test_lines_with_clashing_columns(spark):
    names = ["_lines", "_drop", "_ta", "_tb", "copies", "n_lines", "_text", "doc_id"]
    docs = spark.createDataFrame([(*range(7), i, f"common\nown {i}") for i in range(12)], ", ".join(f"{n} int" for n in names) + ", text string")
    got = line_dedup.drop_frequent_lines(docs)
    assert got.columns == ["_lines", "_drop", "_ta", "_tb", "copies", "_text", "doc_id", "text", "n_lines", "n_dropped"]
    assert sorted((x.doc_id, x.text, x.n_lines, x.n_dropped, x._lines, x._text) for x in got.collect()) == [
        (i, f"own {i}", 2, 1, 0, 6) for i in range(12)]
