"""Suffix dedup, embedding whitening and tokenizer alignment against brute force."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tagweave.llm import suffix_dedup, token_align, whitening
from tests.llm import helpers as H

# ---------------------------------------------------------------------------
# suffix dedup


def brute_bytes(rows, k):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i:i + k] for t in texts for i in range(len(t) - k + 1))
    out = []
    for (d, *_), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - k + 1):
            if seen[t[i:i + k]] > 1:
                gone[i:i + k] = b"\x01" * k
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, bytes(c for c, x in zip(t, gone) if not x)))
    return sorted(out, key=str)


def passages(r, n, k):
    """Documents with passages just under, at and over ``k`` bytes, near copies, periodic text and wide letters."""
    base = "".join(r.choice("abcdé fgh\n") for _ in range(6 * k))
    rows = []
    for d in range(n):
        w = "".join(r.choice("klmnöp qrs") for _ in range(r.choice([0, 3, k // 2, k, 2 * k])))
        for _ in range(r.randrange(3)):
            a, size, at = r.randrange(4 * k), r.choice([k // 2, k - 1, k, k + 1, 2 * k]), r.randrange(len(w) + 1)
            w = w[:at] + base[a:a + size] + w[at:]
        rows.append((d, w, "s"))
    rows += [(n, "ab" * k, "s"), (n + 1, "z" * (k + 1), "s"), (n + 2, "y" * k, "s"), (n + 3, base, "s")]
    rows += [(n + 4 + i, base[:3 * k] + f"<{i}>" + base[3 * k:], "s") for i in range(5)]
    return rows


@pytest.mark.parametrize("k,cap", [(80, 512), (80, 3), (400, 512)])
def test_suffix_dedup(spark, monkeypatch, k, cap):
    """With a small cap the windows of busy anchors are compared one by one."""
    monkeypatch.setattr(suffix_dedup, "CAP", cap)
    rows = passages(H.rng(k + cap), 60, k) + H.awkward_rows()
    got = suffix_dedup.remove_repeats(H.frame(spark, rows, "doc_id long, text string, d string"), k)
    assert got.columns == ["doc_id", "d", "text", "n_bytes", "n_removed", "n_spans"]
    assert sorted([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.text)) for x in got.collect()],
                  key=str) == brute_bytes(rows, k)


def test_suffix_dedup_edges(spark):
    same_id = [(1, "x" * 50 + "".join(chr(97 + i * i % 23) for i in range(500)), "s"), (1, "short", "s"),
               (None, "".join(chr(97 + i * i % 23) for i in range(500)), "s"), (None, None, "s")]
    got = suffix_dedup.remove_repeats(H.frame(spark, same_id, "doc_id long, text string, n_bytes string"))
    assert got.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans"]
    assert sorted([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.text)) for x in got.collect()],
                  key=str) == brute_bytes(same_id, 400)
    assert suffix_dedup.remove_repeats(H.frame(spark, [], H.DOCS)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(H.frame(spark, [], H.DOCS), 100)


def test_merged_transforms_are_the_sorted_suffixes():
    """The interleave of the shards is the order of all suffixes, and lcp the symbols neighbours share."""
    r = H.rng(8)
    k, m = 80, 5
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(80, 130))) for _ in range(12)]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ptr = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for shard in (80, 400, 10_000):
        got = suffix_dedup.repeated_starts(data, ptr, np.ones(len(texts)), k, shard)
        seen = Counter(t[i:i + k] for t in texts for i in range(len(t) - k + 1))
        want = [len(t) - i >= k and seen[t[i:i + k]] > 1 for t in texts for i in range(len(t))]
        assert got.tolist() == want
    # two shards of one-byte symbols: merged order equals a sort of all rotations' prefixes
    a, b = np.array([2, 0, 1]), np.array([1, 2])
    z, lcp = suffix_dedup.merge_transforms([a, b], 1)
    assert z.tolist() == [0, 0, 1, 0, 1] and lcp.tolist() == [0, 0, 1, 0, 1]
    assert m * suffix_dedup.ROUNDS == k


# ---------------------------------------------------------------------------
# whitening


def test_principal_against_eigh():
    g = np.random.default_rng(0)
    q = np.linalg.qr(g.standard_normal((400, 40)))[0]
    cases = {"plain": g.standard_normal((300, 40)), "graded": g.standard_normal((300, 40)) * np.logspace(0, -6, 40),
             "equal columns": np.repeat(g.standard_normal((300, 8)), 5, axis=1), "one value": q * 9,
             "two values": np.hstack((q[:, :15] * 5, q[:, 15:] * 2)), "few rows": g.integers(-30, 30, (5, 40)) * 1.0,
             "one column": g.standard_normal((50, 1)), "zeros": np.hstack((g.standard_normal((60, 3)), np.zeros((60, 4))))}
    for name, x in cases.items():
        x = x - x.mean(axis=0)
        r = np.linalg.qr(x, mode="r")
        r = np.vstack((r, np.zeros((x.shape[1] - len(r), x.shape[1]))))
        v, e, trace = whitening.principal(r, len(x), 40)
        cov = x.T @ x / len(x)
        want = np.linalg.eigvalsh(cov)[::-1]
        assert np.allclose(e, want[:len(e)], rtol=1e-9, atol=1e-14 * want[0]), name
        assert len(e) == (want > want[0] * 1e-14).sum(), name
        assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-9, name
        assert np.abs(cov @ v - v * e).max() < 1e-12 * want[0], name
        assert trace == pytest.approx(np.trace(cov)), name


def test_dqds_keeps_small_values():
    """A graded bidiagonal whose smallest value is known in closed form from the determinant."""
    d = np.array([1.0, 1e-3, 1e-6, 1e-9])
    s = np.sqrt(whitening.singular_squares(d, np.full(3, 1e-12)))
    assert np.allclose(s, d, rtol=1e-6)
    g = np.random.default_rng(4)
    b = np.diag(g.uniform(1, 2, 30)) + np.diag(g.uniform(0, 1, 29), 1)
    assert np.allclose(np.sqrt(whitening.singular_squares(np.diag(b), np.diag(b, 1))), np.linalg.svd(b)[1], rtol=1e-12)


def brute_whitening(rows, components):
    good = [(i, [int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = []
    for i, x in good:
        y = [n * a - b for a, b in zip(x, s)]
        w = (np.array(y) / n) @ v / np.sqrt(e)
        out += [(i, c + 1, n, sum(a * a for a in y), abs(w[c]), e[c] / e.sum()) for c in range(components)]
    return sorted(out)


def test_whitening(spark):
    g = np.random.default_rng(2)
    vectors = [(g.standard_normal(6) * [3, 2, 1, .5, .4, .3]).astype("float32").tolist() for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(5, vectors[7]), (7, vectors[7]), (900, vectors[9])]
    odd = [(1000, None), (1001, [None] * 6), (1002, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (1003, [float("inf")] * 6),
           (None, vectors[3]), (1004, []), (1005, [1.0]), (1006, [3e9] * 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, n string, _x int")
    got = whitening.whiten(df.repartition(5), components=4)
    assert got.columns == ["vec_id", "embedding", "_x", "n", "deviation", "whitened", "explained", "identity_error"]
    found = sorted((r.vec_id if r.vec_id is not None else -1, c + 1, r.n, r.deviation, abs(r.whitened[c]), r.explained[c])
                   for r in got.collect() for c in range(4))
    want = brute_whitening(rows + [(-1, vectors[3])], 4)
    assert [x[:4] for x in found] == [x[:4] for x in want]
    assert np.allclose([x[4:] for x in found], [x[4:] for x in want], rtol=1e-8, atol=1e-10)
    assert got.select("identity_error").first()[0] < 1e-9
    signs = {np.sign(r.whitened[0]) for r in got.collect()}
    assert signs == {-1.0, 1.0}


def test_whitening_degenerate(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened) for r in one] == [(1, 0, [])] * 2
    wide = whitening.whiten(spark.createDataFrame([(1, [2e9, 0.0]), (2, [-2e9, 0.0]), (3, [0.0, 1.0])], schema)).collect()
    assert {r.deviation is None for r in wide} == {False, True} and len(wide[0].whitened) == 2


# ---------------------------------------------------------------------------
# tokenizer alignment


def brute_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    a_tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    chars = token_align._byte_chars()

    def spell_b(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for d, t, *_ in rows:
        t = t or ""
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        sa = [bytes(chars[c] for c in a_tok.id_to_token(i)) for i in a]
        sb = [spell_b(i) for i in b]
        if not t or b"".join(sa) != (" " + t).encode() or b"".join(sb) != (" " + t).encode():
            docs.append((d, [], [], []))
            continue
        ends = lambda s: np.cumsum([len(x) for x in s]).tolist()
        ea, eb = ends(sa), ends(sb)
        groups, i, j = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            ni, nj = ea.index(cut) + 1, eb.index(cut) + 1
            groups.append((a[i:ni], b[j:nj]))
            i, j = ni, nj
        docs.append((d, a, b, groups))
    counts = Counter(p for *_, groups in docs for p in {(x, y) for ga, gb in groups for x in ga for y in gb})
    best = defaultdict(int)
    for (x, _), c in counts.items():
        best[x] = max(best[x], c)
    out = []
    for d, a, b, groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
                    sum(counts[p] for p in links), text))
    return sorted(out, key=str)


def alignment_rows():
    r = H.rng(6)
    rows = [(i, " ".join(r.choice(["the", "of", "tokenizer", "naïve", "1234", "x_y", "Größe", "日本語", "</s>", "🙂", "don't"])
                         for _ in range(r.randrange(60))), "s") for i in range(40)]
    rows += [(100, "a▁b", "s"), (101, "<|endoftext|> <s> [INST]", "s"), (102, " " * 300 + "x" + "\n" * 40, "s"),
             (103, "🙂🙃" * 200, "s"), (104, "\x00 a\x01", "s"), (105, " leading", "s"), (106, "q" * 2000, "s")]
    return rows + H.awkward_rows()


@pytest.mark.parametrize("bucket,stripe,small,block", [(2048, 1 << 22, 4096, 1 << 16), (16, 64, 6, 100)])
def test_alignment(spark, monkeypatch, bucket, stripe, small, block):
    """Also with several stripes and blocks, and with groups of over six links crossed instead of listed."""
    for name, value in (("BUCKET", bucket), ("SMALL", small), ("BLOCK", block), ("FAN", 2)):
        monkeypatch.setattr(token_align, name, value)
    rows = alignment_rows()
    got = token_align.align(H.frame(spark, rows, "doc_id long, text string, n_a string"), stripe=stripe)
    assert got.columns == ["doc_id", *token_align.MEASURES, "groups"]
    assert sorted([tuple(x) for x in got.collect()], key=str) == brute_alignment(rows)
    assert token_align.align(H.frame(spark, [], H.DOCS)).count() == 0


def test_rank_encoder_gives_the_same_ids():
    """Long runs go to the list of merges; every character of the basic plane is cut alike."""
    spec, model = (open(p, "rb").read() for p in token_align.vocabulary_paths())
    enc = token_align.Encoders(spec, model)
    assert enc.ranked is not None
    texts = [f" a{chr(c)}b1{chr(c)}2 {chr(c)}{chr(c)} !{chr(c)}?" for c in range(1, 0xD800)]
    texts += [" " * 12_000 + "x", "\n" * 200_000, "a" * 30_000, " <|endoftext|> it's"] + [t or "" for _, t, *_ in alignment_rows()]
    for i in range(0, len(texts), 5000):
        want = enc.a.encode_batch(texts[i:i + 5000], add_special_tokens=False)
        assert all(w.ids == enc.byte_ids(t).tolist() for w, t in zip(want, texts[i:i + 5000]))
    other = json.loads(spec)
    other["model"]["merges"].reverse()
    assert token_align.rank_encoder(json.dumps(other).encode()) is None


def test_pair_hash_is_minimal_and_verified():
    g = np.random.default_rng(3)
    pairs = np.unique(g.integers(0, 1 << 40, 20_000))
    buckets = 10
    rows = []
    for b in range(buckets):
        sizes, bits, order = token_align.hash_bucket(pairs[token_align.bucket_of(pairs, buckets) == b])
        rows.append((b, sizes, np.packbits(bits).tobytes(), order.astype(np.int64).tobytes()))
    whole = token_align.PairHash(rows, 0, buckets, buckets)
    assert sorted(whole.index(pairs)) == list(range(len(pairs)))
    half = token_align.PairHash(rows[5:], 5, buckets, buckets)
    at = half.index(pairs)
    assert sorted(at[at >= 0]) == list(range(len(half.pairs)))
    assert ((at >= 0) == (token_align.bucket_of(pairs, buckets) >= 5)).all()
    with pytest.raises(KeyError):
        whole.index(np.setdiff1d(np.arange(1000), pairs))
    empty = token_align.PairHash([], 0, 1, 1)
    assert len(empty.pairs) == 0


def test_groups_digest_is_plain():
    """The digest column of the query is that of the decimal groups; documents without tokens have ''."""
    assert hashlib.sha256(b"1|2").hexdigest() == H.sha("1|2")
    g = token_align.Groups(np.array([5, 6, 7], dtype=np.uint16), np.array([0, 2, 2, 3]), np.array([1, 2], dtype=np.uint16),
                           np.array([0, 1, 1, 2]), (token_align.Table([b"x"] * 5 + [b"a", b"b", b"c"]),
                                                    token_align.Table([b"", b"ab", b"c"])))
    assert g.spelled().to_pylist() == ["5,6|1", "", "7|2"]
    assert g.per_doc(g.na * g.nb).tolist() == [2, 0, 1]
    assert isinstance(g.spelled(), pa.Array)
