"""License scan with ordered signature rules.

A few hundred hand-written patterns (families of license notices, with their versions) are tried on a
normalised text: its words, lower-cased, joined by one space. A rule is tried only if its keyword is in the
text, and no rule at all if none of the ``STEMS`` is. Every place a pattern matches is a detection with a
word interval. Rules are ordered by tier (1 notice or identifier of an exact license and version, 2 named
license, 3 generic mention); a detection inside the interval of another one of the same or a better tier is
suppressed (the same interval: the rule listed first stays). Base phrases are counted apart and never
suppressed.

Only DataFrame functions are used; the one shuffle carries a row of numbers per document and detection.
Defined results: null text is empty; no words give zero counts, no labels and score 0; every row is a
document of its own, whatever its id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.shared import ascii_lower, text_of

#: Everything that is not a word character: ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# fixed values: base phrases and their labels
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

STEMS = ("licen", "gpl", "apache", "creative commons", "cc by", "cc0", "copyright", "spdx", "mozilla public",
         "public domain", "copyleft", "all rights reserved", "bsd", "redistribut", "permission is hereby",
         "as is", "eula", "unlicense", "wtfpl", "proprietary", "confidential", "mpl", "commons clause",
         "mit no attribution")

WEIGHT = {1: 1.0, 2: 0.8, 3: 0.4}


def _rules() -> list[tuple[str, int, str, str]]:
    """(label, tier, keyword, pattern) in order; patterns see single spaces between lower-case words."""
    out: list[tuple[str, int, str, str]] = []

    def add(label, tier, keyword, *patterns):
        out.extend((label, tier, keyword, p) for p in patterns)

    # GNU family: each version in its written forms
    for lic, name, short in (("gpl", "general public license", "gpl"),
                             ("lgpl", "(?:lesser|library) general public license", "lgpl"),
                             ("agpl", "affero general public license", "agpl")):
        for v, forms in (("1", "1(?: 0)?"), ("2", "2(?: 0)?"), ("2.1", "2 1"), ("3", "3(?: 0)?")):
            if (lic, v) in (("gpl", "2.1"), ("agpl", "2"), ("agpl", "2.1"), ("lgpl", "1")):
                continue
            key = name.split(")")[-1].strip()
            add(f"{lic}-{v}", 1, key,
                rf"gnu {name}(?: as published by the free software foundation)? (?:either )?version {forms}",
                rf"gnu {name} v ?{forms}",
                rf"{name} {forms} (?:only|or later|or any later version)")
            add(f"{lic}-{v}", 1, short,
                rf"(?:gnu )?{short} ?v? ?{forms} (?:only|or later|or any later version|license|licence)",
                rf"spdx license identifier {short} {forms}(?: only| or later| plus)?",
                rf"licensed under (?:the )?(?:gnu )?{short} ?v? ?(?:version )?{forms}",
                rf"{short} ?v{forms}")
        add(lic, 2, name.split(")")[-1].strip(), rf"gnu {name}", rf"under the {name}")
        add(lic, 2, short, rf"gnu {short}", rf"under the {short}", rf"{short} licen[sc]ed?")
    # Apache
    for v, forms in (("1", "1(?: 0)?"), ("1.1", "1 1"), ("2", "2(?: 0)?")):
        add(f"apache-{v}", 1, "apache", rf"apache (?:software )?licen[sc]e (?:version |v ?){forms}",
            rf"apache {forms} licen[sc]e", rf"spdx license identifier apache {forms}",
            rf"licensed under apache {forms}", rf"www apache org licenses license {forms}")
    add("apache", 2, "apache", r"apache (?:software )?licen[sc]e", r"licensed under apache", r"asl licen[sc]e")
    # Creative Commons: type by version
    for kind, words in (("by", "attribution"), ("by-sa", "attribution share ?alike"),
                        ("by-nd", "attribution no ?deriv(?:ative|ative work)?s?"),
                        ("by-nc", "attribution non ?commercial"),
                        ("by-nc-sa", "attribution non ?commercial share ?alike"),
                        ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative|ative work)?s?")):
        code = kind.replace("-", " ")
        for v in ("1", "2", "2.5", "3", "4"):
            num = v.replace(".", " ") if "." in v else f"{v}(?: 0)?"
            add(f"cc-{kind}-{v}", 1, f"cc {code}", rf"cc {code} {num}(?: international| unported| generic)?")
            add(f"cc-{kind}-{v}", 1, "creative commons",
                rf"creative commons {words} {num}(?: international| unported| generic)?")
            add(f"cc-{kind}-{v}", 1, "creativecommons org", rf"creativecommons org licenses {code} {num}")
        add(f"cc-{kind}", 2, f"cc {code}", rf"cc {code}(?: licen[sc]ed?)?")
        add(f"cc-{kind}", 2, "creative commons", rf"creative commons {words}(?: licen[sc]e)?")
    add("cc0", 1, "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 public domain dedication")
    add("cc0", 1, "creative commons", r"creative commons zero", r"creative commons public domain dedication")
    add("cc", 3, "creative commons", r"creative commons licen[sc]es?", r"creative commons")
    # BSD and other permissive licenses
    for n, words in (("2", "(?:2|two) clause|simplified|freebsd"), ("3", "(?:3|three) clause|new|modified|revised"),
                     ("4", "(?:4|four) clause|original|old"), ("0", "(?:0|zero) clause")):
        add(f"bsd-{n}", 1, "bsd", rf"(?:{words}) bsd licen[sc]e", rf"bsd (?:{words}) licen[sc]e",
            rf"bsd {n} clause", rf"spdx license identifier (?:bsd {n} clause|{n}bsd)")
    add("bsd", 2, "bsd", r"bsd (?:style )?licen[sc]ed?", r"under the bsd")
    add("bsd", 2, "redistribut", r"redistribution and use in source and binary forms with or without modification")
    add("mit", 1, "permission is hereby",
        r"permission is hereby granted free of charge to any person obtaining a copy of this software")
    add("mit", 1, "mit", r"(?:released|licensed|distributed|available) under the mit licen[sc]e",
        r"spdx license identifier mit", r"the mit licen[sc]e mit", r"mit expat licen[sc]e")
    add("mit", 2, "mit licen", r"mit licen[sc]ed?", r"(?:dual|also) mit licen[sc]ed")
    add("mit-0", 1, "mit", r"mit no attribution", r"spdx license identifier mit 0")
    add("isc", 1, "isc", r"isc licen[sc]ed?", r"spdx license identifier isc", r"under the isc licen[sc]e")
    add("zlib", 1, "zlib", r"zlib(?: libpng)? licen[sc]e", r"spdx license identifier zlib")
    add("boost", 1, "boost", r"boost software licen[sc]e(?: version)?(?: 1 0)?", r"spdx license identifier bsl 1 0")
    add("unlicense", 1, "unlicense", r"the unlicense", r"spdx license identifier unlicense", r"unlicense org")
    add("unlicense", 1, "public domain",
        r"this is free and unencumbered software released into the public domain")
    add("wtfpl", 1, "wtfpl", r"wtfpl", r"spdx license identifier wtfpl")
    add("wtfpl", 1, "licen", r"do what the fuck you want to public licen[sc]e")
    for label, name in (("artistic", "artistic"), ("postgresql", "postgresql"), ("python", "python software foundation"),
                        ("php", "php"), ("ruby", "ruby"), ("openssl", "openssl"), ("x11", "x11"), ("ncsa", "ncsa"),
                        ("afl", "academic free"), ("osl", "open software"), ("odbl", "open database"),
                        ("odc-by", "open data commons attribution"), ("pddl", "public domain dedication and"),
                        ("ofl", "sil open font"), ("gfdl", "gnu free documentation"), ("eupl", "european union public"),
                        ("cecill", "cecill"), ("ms-pl", "microsoft public"), ("ms-rl", "microsoft reciprocal"),
                        ("upl", "universal permissive"), ("blueoak", "blue oak model"), ("vim", "vim"),
                        ("tcl", "tcl"), ("curl", "curl"), ("json", "json"), ("beerware", "beerware")):
        add(label, 2, "licen", rf"{name} licen[sc]e(?: version)?(?: \d+(?: \d+)?)?", rf"under the {name} licen[sc]e")
    # weak copyleft
    for v, forms in (("1", "1(?: 0)?"), ("1.1", "1 1"), ("2", "2(?: 0)?")):
        add(f"mpl-{v}", 1, "mozilla public", rf"mozilla public licen[sc]e (?:version |v ?)?{forms}")
        add(f"mpl-{v}", 1, "mpl", rf"mpl ?v? ?{forms}", rf"spdx license identifier mpl {forms}")
        add(f"epl-{v}", 1, "eclipse public", rf"eclipse public licen[sc]e (?:version |v ?)?{forms}")
    add("mpl", 2, "mozilla public", r"mozilla public licen[sc]e")
    add("epl", 2, "eclipse public", r"eclipse public licen[sc]e")
    add("cddl", 2, "common development and distribution", r"common development and distribution licen[sc]e(?: version)?(?: 1 [01])?")
    add("cpl", 2, "common public", r"common public licen[sc]e(?: version)?(?: 1 0)?")
    # source-available and closed
    add("sspl", 1, "server side public", r"server side public licen[sc]e(?: version 1)?")
    add("busl", 1, "business source", r"business source licen[sc]e(?: 1 1)?")
    add("elastic", 1, "elastic", r"elastic licen[sc]e(?: 2 0)?")
    add("commons-clause", 1, "commons clause", r"commons clause(?: license condition)?")
    add("proprietary", 2, "proprietary", r"proprietary (?:and confidential|licen[sc]e|software)")
    add("proprietary", 2, "confidential", r"confidential and proprietary")
    add("proprietary", 2, "eula", r"end user licen[sc]e agreement eula", r"eula")
    add("all-rights-reserved", 3, "all rights reserved", r"copyright(?: c)? \d{4}(?: \d{4})? .{0,80}? all rights reserved",
        r"all rights reserved")
    add("public-domain", 2, "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain",
        r"public domain dedication", r"in the public domain")
    add("copyright", 3, "copyright", r"copyright(?: c)? \d{4}(?: \d{4})?", r"copyright(?:ed)? by")
    add("copyleft", 3, "copyleft", r"copyleft")
    add("other", 3, "licen", r"(?:released|licensed|distributed|available) under (?:the|a|an) .{0,60}?licen[sc]e",
        r"licen[sc]ed under", r"licen[sc]e agreement", r"terms of (?:the|this) licen[sc]e",
        r"see (?:the )?licen[sc]e file", r"spdx license identifier \S+")
    return out


RULES = _rules()


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a table (rule, label, tier, keyword, pattern); tier 0 holds the base phrases."""
    rows = [(i, label, 0, phrase, phrase) for i, (phrase, label) in enumerate(BASE)]
    rows += [(len(BASE) + i, label, tier, key, pat) for i, (label, tier, key, pat) in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule int, label string, tier int, keyword string, pattern string")


def _rule_array():
    rows = [(i, 0, phrase, phrase) for i, (phrase, _) in enumerate(BASE)]
    rows += [(len(BASE) + i, tier, key, pat) for i, (_, tier, key, pat) in enumerate(RULES)]
    return F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(t).alias("tier"), F.lit(k).alias("keyword"),
                              F.lit(rf" (?:{p})(?= )").alias("pattern")) for i, t, k, p in rows])


def _spaces(c):
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """All detections: the rows of ``docs`` (``_row``, its columns but the text, ``n_words``) with, per
    detection, ``rule``, ``tier``, ``start``, ``stop`` (words, stop exclusive) and ``suppressed``.
    A document without detections keeps one row with a null rule."""
    keep = [c for c in docs.columns if c != text]
    words = F.split(ascii_lower(text_of(text)), SEPARATORS)
    d = docs.select(*keep, F.monotonically_increasing_id().alias("_row"),
                    F.filter(words, lambda w: w != "").alias("_words"))
    stems = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    d = d.select(*keep, "_row", F.size("_words").cast("long").alias("n_words"), stems.alias("_norm"))
    gate = F.lit(False)
    for stem in STEMS:
        gate = gate | F.col("_norm").contains(stem)
    rules = F.when(gate, F.filter(_rule_array(), lambda r: F.contains(F.col("_norm"), r["keyword"])))
    d = d.select(*keep, "_row", "n_words", "_norm", F.explode_outer(rules).alias("_r"))
    found = F.when(F.col("_r").isNotNull(), F.regexp_extract_all("_norm", F.col("_r.pattern"), F.lit(0)))
    d = d.select(*keep, "_row", "n_words", F.col("_r.rule").alias("rule"), F.col("_r.tier").alias("tier"),
                 F.when(F.size(found) > 0, F.arrays_zip(
                     F.transform(F.slice(F.split("_norm", F.col("_r.pattern")), 1, F.size(found)), _spaces).alias("gap"),
                     F.transform(found, _spaces).alias("len"))).alias("_m"))
    # a rule without a match gives no row, but every document keeps one
    d = d.select(*keep, "_row", "n_words", "rule", "tier", F.posexplode_outer("_m").alias("_i", "_m"))
    d = (d.withColumn("gap", F.col("_m.gap")).withColumn("len", F.col("_m.len"))
          .withColumns({c: F.when(F.col("_m").isNotNull(), F.col(c)) for c in ("rule", "tier")}).drop("_m"))
    # words before a match: those in the gaps up to it and in the matches before it
    by_rule = Window.partitionBy("_row", "rule").orderBy("_i")
    d = (d.repartition("_row")
          .withColumn("start", F.sum(F.col("gap") + F.col("len")).over(by_rule) - F.col("len"))
          .withColumn("stop", F.col("start") + F.col("len")))
    before = (Window.partitionBy("_row")
                    .orderBy(F.col("start"), F.col("stop").desc(), F.col("tier"), F.col("rule"))
                    .rowsBetween(Window.unboundedPreceding, -1))
    reach = [F.coalesce(F.max(F.when(F.col("tier").between(1, t), F.col("stop"))).over(before), F.lit(-1)).alias(f"_e{t}")
             for t in (1, 2, 3)]
    d = d.select("*", *reach)
    inside = F.when(F.col("tier") == 1, F.col("_e1")).when(F.col("tier") == 2, F.col("_e2")).otherwise(F.col("_e3"))
    return (d.withColumn("suppressed", (F.col("tier") > 0) & (inside >= F.col("stop")))
             .drop("_e1", "_e2", "_e3", "gap", "len", "_i"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: the other columns, n_words, base statistics, labels, score, n_detections.

    A column of ``docs`` named like one of these gives way to it.
    """
    names = [c for c in docs.columns if c != text]
    keep = [f"_c{i}" for i in range(len(names))]  # no clash with the columns used here
    docs = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, keep)], F.col(text).alias("text"))
    labels = F.array(*[F.lit(x) for _, x in BASE], *[F.lit(r[0]) for r in RULES])
    weight = F.when(F.col("tier") == 1, WEIGHT[1]).when(F.col("tier") == 2, WEIGHT[2]).otherwise(WEIGHT[3])
    base = F.col("tier") == 0
    live = F.col("rule").isNotNull() & (base | ~F.col("suppressed"))
    d = detect(docs).withColumn("_label", F.when(live, F.element_at(labels, F.col("rule") + 1)))
    distinct = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = (d.groupBy("_row", "n_words", *keep)
             .agg(F.count(F.when(base, 1)).alias("n_base"),
                  F.min(F.when(base, F.col("start"))).alias("first_word"),
                  F.max(F.when(base, F.col("start"))).alias("last_word"),
                  distinct(F.when(base, F.col("_label"))).alias("base_labels"),
                  distinct(F.col("_label")).alias("labels"),
                  F.coalesce(F.max(F.when(live, F.when(base, WEIGHT[1]).otherwise(weight))), F.lit(0.0)).alias("score"),
                  F.count(F.when(live & ~base, 1)).alias("n_detections")))
    mine = [c for c in out.columns if c not in ("_row", *keep)]
    return out.select(*[F.col(k).alias(c) for c, k in zip(names, keep) if c not in mine], *mine)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", F.col("first_word").cast("long"),
                             F.col("last_word").cast("long"), "base_labels", "labels", "score")
