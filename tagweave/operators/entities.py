"""E1 entity text, E2 entity spans, F5 label filter, E3 entity tags.

The reference runs a trained statistical model; here entities come from
data: a gazetteer table ``(surface, label)`` searched in the document's
words (``phrases``), plus number patterns. Users extend recognition with rows, not
code. A span inside a longer span is dropped, repeats keep their first
place, and tags are grouped by label in order of first appearance.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.text import (DEFAULT_STOP_WORDS, DROPPED_ENTITY_LABELS, WORD_CLASS,
                                     capitalize, explode_structs)
from tagweave.operators.graph import RAW_TOKEN
from tagweave.operators.phrases import STRIPE, shared_automaton, stripes
from tagweave.session import reuse

# ---------------------------------------------------------------------------
# Default gazetteer rows and pattern labels.
LICENSE_ENTITIES = (
    ("Apache License", "LAW"),
    ("MIT License", "LAW"),
    ("GNU General Public License", "LAW"),
    ("CC BY NC", "LAW"),
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December")
YEAR_PATTERN = "^(1[5-9]|20)[0-9][0-9]$"
ORDINAL_PATTERN = "^[0-9]+(st|nd|rd|th)$"
CARDINAL_PATTERN = "^[0-9]+$"
# Amounts are read from the raw text, before punctuation is dropped.
_NUMBER = "[0-9]++(?:[.,][0-9]++)*+(?![" + WORD_CLASS + "])"
MONEY_PATTERN = (r"[$\x{20AC}\x{A3}\x{A5}] ?" + _NUMBER + "(?: (?:thousand|million|billion)(?![" + WORD_CLASS + "]))?")
PERCENT_PATTERN = "(?<![" + WORD_CLASS + "])" + _NUMBER + " ?%"
# End of fixed values.
# ---------------------------------------------------------------------------

ROWS = 10_000   # places found that are put out at once


def default_gazetteer(spark: SparkSession, base: str | None = None) -> DataFrame:
    """Licence names and month names, plus nation (GPE) and region (LOC) names when ``base`` is given."""
    rows = list(LICENSE_ENTITIES) + [(m, "DATE") for m in MONTHS]
    gaz = spark.createDataFrame(rows, "surface string, label string")
    if base is not None:
        from tagweave.sources.tables import read_table
        nations = read_table(spark, base, "nation").select(
            F.col("n_name").alias("surface"), F.lit("GPE").alias("label"))
        regions = read_table(spark, base, "region").select(
            F.col("r_name").alias("surface"), F.lit("LOC").alias("label"))
        gaz = gaz.unionByName(nations).unionByName(regions)
    return gaz


def entity_words(docs: DataFrame, text_col: str = "text",
                 stop_words: Iterable[str] = DEFAULT_STOP_WORDS) -> DataFrame:
    """``(doc_id, words)``: raw tokens without punctuation tokens, then without stop words."""
    stop = tuple(stop_words)
    rt = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit("(" + RAW_TOKEN + ")"), 1)
    return docs.select("doc_id", F.filter(rt, lambda t: t.rlike("^[" + WORD_CLASS + "]+$")
                                          & ~F.lower(t).isin(*stop)).alias("words"))


def amount_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(doc_id, start, n, entity, label)`` of MONEY and PERCENT amounts in the raw text.

    ``start`` is the word position (in the E1 word list) of the amount's first number, so amounts order
    with the other entities and hide the bare numbers inside them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = []
    for label, pattern in (("MONEY", MONEY_PATTERN), ("PERCENT", PERCENT_PATTERN)):
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.transform(F.slice(F.split(text, pattern), 1, F.size(found)), lambda x: _word_count(x))
        parts.append(docs.select("doc_id", F.lit(label).alias("label"), F.posexplode(
            F.arrays_zip(gaps.alias("gap"), found.alias("entity"), F.transform(found, lambda x: _word_count(x)).alias("n")))))
    rows = parts[0].unionByName(parts[1]).select("doc_id", "label", "pos", "col.*").where(F.col("n") > 0)
    before = Window.partitionBy("doc_id", "label").orderBy("pos")
    start = F.sum(F.col("gap") + F.col("n")).over(before) - F.col("n")
    return rows.select("doc_id", start.cast("int").alias("start"), F.col("n").cast("int").alias("n"), "entity", "label")


def _word_count(text, stop_words: Iterable[str] = DEFAULT_STOP_WORDS):
    """Number of E1 words in a piece of text (amounts start and end at word borders)."""
    stop = tuple(stop_words)
    return F.size(F.filter(F.regexp_extract_all(text, F.lit("([" + WORD_CLASS + "]+)"), F.lit(1)),
                           lambda t: ~F.lower(t).isin(*stop)))


def _surfaces_in(texts: DataFrame, entries) -> DataFrame:
    """``(doc_id, start, n, entity)`` of the surfaces of one stripe in ``texts(doc_id, _text)``.

    Words stand between single blanks, in texts and in surfaces, so every place found begins and ends at words.
    """
    told, key = texts.sparkSession.sparkContext.broadcast(entries), uuid.uuid4().hex
    schema = T.StructType([texts.schema["doc_id"], T.StructField("start", T.IntegerType()),
                           T.StructField("n", T.IntegerType()), T.StructField("entity", T.StringType())])

    def run(batches):
        found = shared_automaton(key, lambda: told.value)
        for b in batches:
            rows, starts, ns, names = [], [], [], []
            for i, text in enumerate(b["_text"].to_pylist()):
                places = [(end - length + 1, end) for end, (length, _) in found.iter(text)]
                if places:
                    blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype="<u4") == 32)
                    start, stop = np.searchsorted(blanks, np.array(places, dtype=np.int64)).T
                    rows.append(np.full(len(places), i))
                    starts.append(start)
                    ns.append(stop - start)
                    names += [text[x + 1:y] for x, y in places]
                if len(names) >= ROWS:
                    yield put(b, rows, starts, ns, names)
                    rows, starts, ns, names = [], [], [], []
            if names:
                yield put(b, rows, starts, ns, names)

    def put(b, rows, starts, ns, names):
        start, n = (pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, ns))
        return pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(np.concatenate(rows))), start, n, pa.array(names, pa.string())],
                                          names=schema.names)

    return texts.mapInArrow(run, schema)


def entity_spans(words: DataFrame, gazetteer: DataFrame, docs: DataFrame | None = None,
                 text_col: str = "text", stripe: int = STRIPE) -> DataFrame:
    """``(doc_id, start, n, entity, label)``, longest spans only.

    Gazetteer spans: one scan of the words finds all surfaces that stand in
    them, in time linear in the words whatever the length of the surfaces
    (a gazetteer of more than ``stripe`` characters is searched in several
    scans); their labels are joined. Pattern spans: years and month names are
    DATE, other numbers CARDINAL / ORDINAL. With ``docs`` also MONEY and
    PERCENT amounts of the raw text.
    """
    gaz = gazetteer.select(F.col("surface").alias("entity"), "label").where(F.col("entity") != "").distinct()
    words = reuse(words.select("doc_id", "words"))
    texts = words.select("doc_id", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("_text"))
    phrases = gaz.select(F.lit(0).alias("id"), F.concat(F.lit(" "), "entity", F.lit(" ")).alias("phrase"))
    passes = [_surfaces_in(texts, part) for part in stripes(phrases, stripe)]
    # pattern labels only apply to words starting with a digit: keep those positions in the row
    uni = explode_structs(words.select("doc_id", F.filter(F.transform("words", lambda w, i: F.struct(
        i.alias("start"), F.lit(1).alias("n"), w.alias("entity"))), lambda x: x["entity"].rlike("^[0-9]"))
        .alias("_u")), "_u", ["doc_id"])
    pattern = uni.select("doc_id", "start", "n", "entity", F.when(F.col("entity").rlike(YEAR_PATTERN), "DATE")
                         .when(F.col("entity").rlike(ORDINAL_PATTERN), "ORDINAL")
                         .when(F.col("entity").rlike(CARDINAL_PATTERN), "CARDINAL").alias("label")) \
                 .where(F.col("label").isNotNull())
    spans = pattern
    if passes:
        named = reduce(DataFrame.unionByName, passes).join(gaz, "entity")
        spans = spans.unionByName(named.select("doc_id", "start", "n", "entity", "label"))
    if docs is not None:
        spans = spans.unionByName(amount_spans(docs, text_col))
    return longest_spans(spans)


def longest_spans(spans: DataFrame) -> DataFrame:
    """Spans that lie in no longer span of their document.

    One sort per document: after ordering by start and falling end, a span is
    inside an earlier one exactly if the largest end so far (of longer spans)
    reaches its end, so there is no self-join.
    """
    stop = F.col("start") + F.col("n")
    before = Window.partitionBy("doc_id").orderBy("start", stop.desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    # among spans with the same start and end the largest end is their own; longer ones reach further or start earlier
    reach = F.max(F.struct(stop.alias("stop"), (-F.col("start")).alias("start"))).over(before)
    inside = (reach["stop"] > stop) | ((reach["stop"] == stop) & (-reach["start"] < F.col("start")))
    return spans.withColumn("_in", inside).where(~F.col("_in")).drop("_in")


def entity_tags(spans: DataFrame, dropped: Iterable[str] = DROPPED_ENTITY_LABELS) -> DataFrame:
    """F5 + E3: ``(doc_id, label_rank, title, entity_rank, entity)``.

    Labels in order of their first entity, entities distinct in first-seen
    order, title = label capitalised (``WORK_OF_ART`` -> ``Work_of_art``).
    DATE entities are always kept (the reference's date test never filters, Q6).
    """
    kept = spans.where(~F.col("label").isin(*dropped))
    first = kept.groupBy("doc_id", "label", "entity").agg(F.min("start").alias("pos")).repartition("doc_id")
    # ranks of labels and of entities from one table, so that the spans are found once
    ranked = first.withColumn("lpos", F.min("pos").over(Window.partitionBy("doc_id", "label")))
    ranked = ranked.withColumn("entity_rank", F.row_number().over(
        Window.partitionBy("doc_id", "label").orderBy("pos", "entity")))
    ranked = ranked.withColumn("label_rank", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("lpos", "label")))
    return ranked.select("doc_id", "label_rank", capitalize(F.col("label")).alias("title"), "entity_rank", "entity")
