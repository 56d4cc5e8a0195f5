"""Quality rules, license scan and chat formatting against plain Python."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from tagweave.llm import chat_format, license_scan, quality_rules
from tests.llm import helpers as H


def brute_stats(text, k=8):
    w = H.words(text)
    seen = {}
    for i in range(len(w) - k + 1):
        seen.setdefault(tuple(w[i:i + k]), []).append(i)
    cover = {q for at in seen.values() if len(at) > 1 for p in at for q in range(p, p + k)}
    longest = 0
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            n = 0
            while j + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            longest = max(longest, n)
    lines = [x for x in (text or "").split("\n") if H.words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover),
            "longest_repeat": longest if longest >= k else 0}


def test_repetition_stats():
    r = H.rng(6)
    texts = [None, "", "\n\n", "a " * 200, "a b " * 70]
    for _ in range(150):
        w = [r.choice("a bb ccc é #x |y".split() + [f"w{i}" for i in range(r.choice([2, 5, 50]))])
             for _ in range(r.choice([0, 1, 8, 9, 20, 60]))]
        if len(w) > 12 and r.random() < 0.6:
            i = r.randrange(len(w))
            w = w + w[i:i + r.choice([7, 8, 9, 17, 30])] + ["zz"] + w[:r.choice([3, 12])]
        texts.append("".join(x + r.choice([" ", "  ", "\n", "\t", "\n\n"]) for x in w))
    got = quality_rules.measure(pa.array(texts))
    for i, t in enumerate(texts):
        assert {k: int(got[k][i]) for k in brute_stats(t)} == brute_stats(t), t


def test_maximal_repeats():
    block = " ".join(f"a{i}" for i in range(10))
    text = f"p {block} q {block} r {block} s {' '.join(f'a{i}' for i in range(8))} t"
    got = quality_rules.measure(pa.array([text]))
    # the ten-word block (three times) and its first eight words (a fourth time)
    assert int(got["n_maximal"][0]) == 2 and int(got["longest_repeat"][0]) == 10


def test_rules_keep_clean_rows_and_columns(spark):
    r = H.rng(1)
    clean = " ".join(H.sentence(r, 200, 10_000))
    half = " ".join(H.sentence(r, 70, 10_000))
    rows = H.awkward_rows() + [(100, clean, "s"), (101, clean, "s"), (102, f"{clean} {half} {half}", "s"),
                               (103, " ".join(H.sentence(r, 80, 10**6)) + f" {half} z {half}", "s")]
    out = quality_rules.apply_rules(H.frame(spark, rows, "doc_id long, text string, n_words string"))
    assert out.columns == ["doc_id", "text", "n_words"]
    ids = sorted(x.doc_id for x in out.collect() if x.doc_id is not None)
    assert ids == [100, 101]  # 102 and 103 are more than 30 % repeats
    # at the limits of production: a passage of 140 words pasted twice fails by its length alone, short or rare repeats do not
    fresh = lambda n: " ".join(H.sentence(r, n, 10**7))
    paste, short = fresh(140), fresh(60)
    rows2 = [(1, f"{fresh(500)} {paste} {fresh(360)} {paste}", "s"), (2, f"{fresh(500)} {short} {fresh(360)} {short}", "s"),
             (3, f"{fresh(900)} {paste} {fresh(900)} {paste}", "s"), (4, fresh(1140), "s")]
    stats = quality_rules.repetition_stats(H.frame(spark, rows2), keep=["doc_id"])
    failed, kept = quality_rules.verdict()
    got = {x.doc_id: (x.f, x.k) for x in stats.select("doc_id", failed.alias("f"), kept.alias("k")).collect()}
    assert got == {1: (False, False), 2: (False, True), 3: (False, True), 4: (False, True)}
    long_only = quality_rules.verdict(max_covered=100, max_longest_share=25)
    stats = quality_rules.repetition_stats(H.frame(spark, rows[-2:]), keep=["doc_id"]).select("doc_id", long_only[1].alias("k"))
    assert dict(stats.collect()) == {102: True, 103: False}


def brute_license(text):
    norm = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", H.lower(text))
    s = f" {' '.join(norm)} "
    found = []
    rules = [(p, 0, re.escape(p)) for p, _ in license_scan.BASE] + [(r[0], r[1], r[3]) for r in license_scan.RULES]
    for i, (_, tier, pat) in enumerate(rules):
        for m in re.finditer(rf" (?:{pat})(?= )", s):
            a = s[:m.start()].count(" ")
            found.append((a, a + m[0].count(" "), tier, i))
    base = sorted(f for f in found if f[2] == 0)
    names = [x for _, x in license_scan.BASE] + [r[0] for r in license_scan.RULES]
    live = []
    for f in found:
        if f[2] and any(g is not f and g[2] and g[2] <= f[2] and g[0] <= f[0] and g[1] >= f[1]
                        and ((g[0], -g[1], g[2], g[3]) < (f[0], -f[1], f[2], f[3])) for g in found):
            continue
        live.append(f)
    return (len(norm), len(base), base[0][0] if base else None, base[-1][0] if base else None,
            ",".join(sorted({names[f[3]] for f in base})), ",".join(sorted({names[f[3]] for f in live})))


TEXTS = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0!",
         "This work is licensed under the GNU General Public License, version 3.", "cc by nc cc by nc-sa 4.0 cc BY nc",
         "SPDX-License-Identifier: GPL-2.0-or-later\nnothing else", "mit apache license version", "no notice at all",
         "Copyright (c) 2019 2021 Somebody. All rights reserved. See the LICENSE file.",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT "
         "license under the MIT license", "le mit licencié É under the mit licenseé", "BSD 3-Clause License, the Unlicense; CC0 1.0"]


def test_license_scan(spark):
    r = H.rng(8)
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(H.sentence(r, r.randrange(30)) + [r.choice(TEXTS)] + H.sentence(r, 5) + [r.choice(TEXTS)]), "s")
             for i in range(40)] + H.awkward_rows() + [(900, " ".join(TEXTS * 60), "s")]
    got = license_scan.scan(H.frame(spark, rows, "doc_id long, text string, labels2 string")).collect()
    have = sorted([(x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels) for x in got], key=str)
    assert have == sorted([(d, *brute_license(t)) for d, t, _ in rows], key=str)
    assert all(0 <= x.score <= 1 and (x.score > 0) == bool(x.labels) for x in got)


def test_license_scan_with_clashing_columns(spark):
    names = ["rule", "tier", "start", "stop", "n_words", "labels", "_row", "_words", "doc_id"]
    docs = spark.createDataFrame([(*range(8), i, t) for i, t in enumerate(TEXTS)], ", ".join(f"{n} int" for n in names) + ", text string")
    got = license_scan.scan(docs)
    assert got.columns == ["rule", "tier", "start", "stop", "_row", "_words", "doc_id", "n_words", "n_base", "first_word",
                           "last_word", "base_labels", "labels", "score", "n_detections"]
    assert sorted((x.doc_id, x.n_words, x.labels, x.stop) for x in got.collect()) == [
        (i, brute_license(t)[0], brute_license(t)[5], 3) for i, t in enumerate(TEXTS)]


def test_license_rules_are_reachable():
    """Every rule's keyword must pass the gate, and rules are distinct."""
    assert len(license_scan.RULES) == len(set(license_scan.RULES)) >= 200
    for label, tier, key, pat in license_scan.RULES:
        re.compile(pat)
        assert tier in license_scan.WEIGHT


CONTROL = ["[INST] a [/INST]", "</s>[INST] ok [/INST]", "a\\b", "\\", "[\\INST]", "[INST!] x", "<s!> ", "[ROLE:x] y [/ROLE]", "",
           "plain", None, "line\nbreak </s>", "[/INST", "\\[INST]", "<\\s>", "é [/ROLE] \\\\"]


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "system", None, "a]b", "tool] [/ROLE]", ""]
    r = H.rng(9)
    rows = [(c, t, r.choice(roles), r.choice(CONTROL)) for c in range(30) for t in range(r.randrange(1, 9))]
    rows += [(None, 0, "user", "null id"), (77, None, "user", "first"), (77, 3, "assistant", "x"), (77, 3, "assistant", "x"),
             *[(88, t, "user" if t % 2 else "assistant", r.choice(CONTROL)) for t in range(700)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    out = {x.conv_id: x for x in chat_format.format_conversations(df).collect()}
    assert {c: [(t.role, t.text) for t in x.turns] for c, x in out.items()} == want
    # the whole formatted text parses to the same turns
    again = chat_format.format_conversations(df).select("conv_id", chat_format.parse(F.col("formatted")).alias("t")).collect()
    assert {x.conv_id: [(t.role, t.text) for t in x.t] for x in again} == want
    dig = {x.conv_id: x for x in chat_format.digest(chat_format.format_conversations(df)).collect()}
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert dig[c].turns_sha256 == H.sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (dig[c].n_turns, dig[c].loss_chars, dig[c].loss_sha256) == (len(turns), len(loss), H.sha(loss))


def test_chat_rejects_broken_text(spark):
    bad = spark.createDataFrame([("[INST] a [/INST] tail",), ("<s> a",), ("",)], "f string")
    assert [x.t for x in bad.select(chat_format.parse(F.col("f")).alias("t")).collect()] == [None, None, []]
