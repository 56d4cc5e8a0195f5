"""Line deduplication with levelled sorted runs of line hashes.

Every batch of documents contributes one run: the batch's line keys (128-bit hashes, sorted) with the
number of documents that hold them. A new batch is merge-anti-joined with the settled keys, those already
known to be frequent, and adds the rest as a run at level 0. When a level holds ``fanout`` runs they are
compacted into one run at the next level, and keys that reached the limit move to the settled runs. The
index is a list of sorted Parquet tables in the shared folder, so a lost executor rereads runs.

Only DataFrame functions are used. Defined results: a null or empty text is one empty line; an empty
table gives an empty result; equal texts get equal results, whatever their ids; extra columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.shared import SPACE, ascii_lower, drop_stage, hash128, text_of, write_stage

KEY = ["ka", "kb"]
TEXT_KEY = ["_ta", "_tb"]
RUN = "ka long, kb long, n long"


class LineRuns:
    """Levelled sorted runs ``(ka, kb, n)``; ``n`` counts documents."""

    def __init__(self, spark: SparkSession, limit: int, fanout: int = 2):
        self.spark, self.limit, self.fanout = spark, limit, fanout
        self.levels: list[list[str]] = []
        self.settled: list[str] = []

    def _read(self, paths: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.schema(RUN).parquet(p) for p in paths])

    def _write(self, df: DataFrame, tag: str) -> str:
        return write_stage(df.sortWithinPartitions(*KEY), tag)

    def add(self, keys: DataFrame) -> None:
        """Add one batch: ``(ka, kb, n)`` rows, repeats allowed."""
        batch = keys.groupBy(*KEY).agg(F.sum("n").alias("n"))
        if self.settled:
            batch = batch.join(self._read(self.settled).select(*KEY).hint("merge"), KEY, "left_anti")
        self._push(0, self._write(batch, "line-run"))

    def _push(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        merged = self._write(self._read(old).groupBy(*KEY).agg(F.sum("n").alias("n")), "line-merged")
        rows = self.spark.read.schema(RUN).parquet(merged)
        self.settled.append(self._write(rows.where(F.col("n") >= self.limit), "line-settled"))
        rest = self._write(rows.where(F.col("n") < self.limit), "line-run")
        for p in [*old, merged]:
            drop_stage(self.spark, p)
        self._push(level + 1, rest)

    def frequent(self) -> DataFrame:
        """Keys found in at least ``limit`` documents (each key once)."""
        runs = [p for level in self.levels for p in level]
        found = self._read(runs).groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= self.limit)
        if self.settled:
            found = found.select(*KEY).unionByName(self._read(self.settled).select(*KEY))
        return found.select(*KEY)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4,
                        fanout: int = 2, text: str = "text") -> DataFrame:
    """Drop every line whose key (stripped, A-Z lower-cased) is in at least ``min_docs`` documents.

    Keys shorter than ``min_chars`` code points stay. Returns the input with ``text`` replaced by the kept
    lines, plus ``n_lines`` and ``n_dropped`` (which replace columns of these names). ``batches`` splits the documents into the batches of the
    index; it changes the number of runs, never the result.

    The decision depends on the text alone, so rows are joined by a hash of the text: copies are counted
    by multiplicity and their lines travel once, and a group of copies is no hot key in the line count.
    """
    spark = docs.sparkSession
    names, column = docs.columns, text
    text = "_text"
    docs = docs.toDF(*[text if c == column else f"_c{i}" for i, c in enumerate(names)])  # no clash with those used here
    inner = dict(zip(names, docs.columns))
    ta, tb = hash128(text_of(text))
    keys = F.transform(lines_of(text_of(text)), lambda x: F.struct(line_key(x).alias("k")))
    hashed = F.transform(keys, lambda s: F.when(
        F.char_length(s["k"]) >= min_chars,
        F.struct(*[h.alias(n) for h, n in zip(hash128(s["k"]), KEY)])))
    texts = (docs.select(ta.alias("_ta"), tb.alias("_tb"), hashed.alias("lines"))
                 .groupBy(*TEXT_KEY).agg(F.count(F.lit(1)).alias("copies"), F.first("lines").alias("lines"))
                 .withColumn("batch", F.pmod(F.col("_ta"), F.lit(batches)).cast("int")))
    path = write_stage(texts.repartition("batch", F.pmod(F.col("_tb"), F.lit(64))), "line-texts")
    table = spark.read.schema(texts.schema).parquet(path)

    index = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        one = (table.where(F.col("batch") == b)
                    .select("copies", F.explode(F.array_distinct("lines")).alias("k"))
                    .where(F.col("k").isNotNull()).select("k.*", F.col("copies").alias("n")))
        index.add(one)

    places = (table.select(*TEXT_KEY, F.posexplode("lines").alias("pos", "k"))
                   .where(F.col("k").isNotNull()).select(*TEXT_KEY, "pos", "k.*"))
    hits = (places.join(index.frequent(), KEY)
                  .groupBy(*TEXT_KEY).agg(F.collect_list("pos").alias("_drop")))
    out = docs.withColumns({"_ta": ta, "_tb": tb}).join(hits, TEXT_KEY, "left")
    lines = lines_of(text_of(text))
    # positions that stay: array_except keeps the order and works through a hash set
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), text_of(text)).otherwise(
        F.array_join(F.transform(stay, lambda i: F.element_at("_lines", i + 1)), "\n"))
    found = {"n_lines": F.size("_lines").cast("long"), "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long")}
    stay_names = [c for c in names if c not in found]
    # in two steps: an alias that repeats a name used here would be taken for it
    return out.withColumn("_lines", lines).select(
        *[(kept if c == column else F.col(inner[c])).alias(f"_o{i}") for i, c in enumerate(stay_names)],
        *found.values()).toDF(*stay_names, *found)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id"""
