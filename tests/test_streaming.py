import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from tagweave.plans.tag_pages import tag_pages
from tagweave.sources.tables import read_table
from tagweave.streaming import seen
from tagweave.streaming import tag_edits as TE
from tagweave.streaming.arrivals import tag_arrivals, tag_batch


def _fresh_dir():
    return tempfile.mkdtemp(prefix="tw-stream-")


def test_tag_fold_small_cases(spark):
    ev = spark.createDataFrame([
        (1, 1, "add", "a", None), (1, 2, "add", "b", None), (1, 3, "add", "a", None), (1, 4, "remove", "a", None),
        (2, 1, "add", "a", None), (2, 2, "set", None, ["x", "y"]), (2, 3, "remove", "z", None),
        (3, 1, "add", "x", None), (3, 2, "remove", "x", None),
    ], "doc_id long, seq long, op string, tag string, tags array<string>")
    got = {r.doc_id: r.tags for r in TE.tag_lists(TE.fold_tag_events(ev)).collect()}
    assert got == {1: ["b", "a"], 2: ["x", "y"]}  # doc 3 emptied: no rows


def _python_fold(rows):
    out = {}
    for doc, seq, op, tag, tags in sorted(rows, key=lambda r: (r[0], r[1])):
        cur = out.setdefault(doc, [])
        if op == "add":
            cur.append(tag)
        elif op == "remove":
            if tag in cur:
                cur.remove(tag)
        elif op == "set":
            out[doc] = list(tags)
    return {k: v for k, v in out.items() if v}


def test_tag_fold_matches_sequential_fold(spark):
    ev = TE.events_to_tag_events(read_table(spark, SF001.replace("0.001", "0.01"), "events"))
    rows = [tuple(r) for r in ev.collect()]
    got = {r.doc_id: r.tags for r in TE.tag_lists(TE.fold_tag_events(ev)).collect()}
    assert got == _python_fold(rows)


def test_tag_fold_stream_equals_batch(spark):
    ev = TE.events_to_tag_events(read_table(spark, SF001, "events")).cache()
    src = _fresh_dir()
    # three files in seq order; rows shuffled inside each file
    bounds = ev.approxQuantile("seq", [0.33, 0.66], 0.0)
    parts = [ev.where(F.col("seq") <= bounds[0]),
             ev.where((F.col("seq") > bounds[0]) & (F.col("seq") <= bounds[1])),
             ev.where(F.col("seq") > bounds[1])]
    for i, p in enumerate(parts):
        p.orderBy(F.rand(7)).coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    q = (TE.fold_tag_stream(stream).writeStream.outputMode("update").format("memory").queryName("tagfold")
         .option("checkpointLocation", _fresh_dir()).trigger(availableNow=True).start())
    q.awaitTermination(300)
    final = (spark.table("tagfold").groupBy("doc_id").agg(F.max_by("tags", "last_seq").alias("tags"),
                                                          F.max("late").alias("late")).collect())
    got = {r.doc_id: list(r.tags) for r in final if r.tags}
    want = {r.doc_id: r.tags for r in TE.tag_lists(TE.fold_tag_events(ev)).collect()}
    assert got == want
    assert all(r.late == 0 for r in final)


def test_tag_arrivals_stream_equals_batch(spark):
    pages = read_table(spark, SF001, "pages").cache()
    src, out = _fresh_dir(), _fresh_dir()
    for i, p in enumerate(pages.randomSplit([1.0, 1.0, 1.0], seed=3)):
        p.coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
    # one page arrives twice: it must be tagged once
    pages.limit(1).coalesce(1).write.parquet(os.path.join(src, "part9"))
    q = tag_arrivals(spark, src + "/*", out, _fresh_dir())
    q.awaitTermination(300)
    got = sorted((r.page_id, r.rank, r.tag) for r in spark.read.parquet(out + "/tags").collect())
    want, _ = tag_pages(pages)
    assert got == sorted((r.page_id, r.rank, r.tag) for r in want.collect())


def test_arrivals_replay_gives_the_same_rows(spark):
    pages = read_table(spark, SF001, "pages")
    out = _fresh_dir()
    parts = pages.randomSplit([1.0, 1.0], seed=5)
    tables = lambda: {t: sorted(map(tuple, spark.read.parquet(f"{out}/{t}").collect()), key=str)
                      for t in ("tags", "entities", "pages")}
    gaz = spark.createDataFrame([("The", "ORG"), ("La", "ORG")], "surface string, label string")
    for n, p in enumerate(parts):
        tag_batch(p, n, out, gaz)
    first = tables()
    assert len(first["tags"]) and len(first["entities"]) and len(first["pages"]) == pages.count()
    tag_batch(parts[0], 0, out, gaz)    # batch 0 is run again after batch 1 was written
    tag_batch(parts[1], 1, out, gaz)
    assert tables() == first
    tag_batch(parts[0], 2, out, gaz)    # the same pages in a later batch are not tagged again
    assert len(tables()["pages"]) == len(first["pages"])


def test_tag_fold_stream_counts_late_events(spark):
    src = _fresh_dir()
    schema = "doc_id long, seq long, op string, tag string, tags array<string>"
    spark.createDataFrame([(1, 5, "add", "a", None), (1, 3, "add", "b", None)], schema) \
         .coalesce(1).write.parquet(os.path.join(src, "p0"))
    # arrives later but is older than the last applied seq (5): skipped and counted
    spark.createDataFrame([(1, 4, "add", "c", None), (1, 6, "remove", "a", None)], schema) \
         .coalesce(1).write.parquet(os.path.join(src, "p1"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    q = (TE.fold_tag_stream(stream).writeStream.outputMode("update").format("memory").queryName("latefold")
         .option("checkpointLocation", _fresh_dir()).trigger(availableNow=True).start())
    q.awaitTermination(300)
    last = spark.table("latefold").orderBy(F.col("last_seq").desc()).first()
    assert list(last.tags) == ["b"] and last.late == 1


def test_tag_fold_buckets_do_not_change_result(spark):
    ev = TE.events_to_tag_events(read_table(spark, SF001.replace("0.001", "0.01"), "events")).cache()
    want = _python_fold([tuple(r) for r in ev.collect()])
    for bw in (7, 100, 1 << 20):
        got = {r.doc_id: r.tags for r in TE.tag_lists(TE.fold_tag_events(ev, bucket_width=bw)).collect()}
        assert got == want, bw


def test_seen_runs_cover_the_batches_before():
    for n in (0, 1, 7, 8, 9, 63, 64, 65, 511, 512, 1000):
        at = 0
        for level, first in seen.runs_before(n):
            assert first == at and first % seen.FAN ** level == 0
            at += seen.FAN ** level
        assert at == n
    assert max(len(seen.runs_before(n)) for n in range(4096)) <= (seen.FAN - 1) * 4


def test_seen_ids_over_many_batches(spark, monkeypatch):
    """Runs stay few and hold the ids of all batches before; batches run again leave the same ids."""
    monkeypatch.setattr(seen, "FAN", 3)
    folder, have = _fresh_dir(), set()
    ids = lambda n: [n * 10 + i for i in range(12)] + [-n, -n, None]

    def run(n):
        batch = spark.createDataFrame([(x,) for x in ids(n)], "page_id long")
        seen.drop_merged(spark, folder, n)
        old = seen.ids_before(spark, folder, n, batch)
        known = {r.page_id for r in old.collect()} if old is not None else set()
        fresh = batch.where(~F.col("page_id").isin(*known)) if known else batch
        seen.add_ids(fresh, folder, n)
        return known, old

    for n in range(11):
        known, old = run(n)
        assert known == {x for x in have if -n <= x <= n * 10 + 11}
        if n in (2, 8, 9):  # the last batch fails after it merged, before the stream noted it
            assert run(n)[0] == known
        have |= {x for x in ids(n) if x is not None}
        if old is not None:
            assert len(old.inputFiles()) <= 8 * len(seen.runs_before(n)) and len(seen.runs_before(n)) <= 6
            assert "GreaterThanOrEqual(page_id" in old._jdf.queryExecution().executedPlan().toString()
    levels = sum(len(fs) for fs in ([x for x in os.listdir(os.path.join(folder, d))] for d in os.listdir(folder)))
    assert levels <= len(seen.runs_before(11)) + 4


def _ordered(spark, folder, schema, name, delay):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/*")
    q = (TE.fold_tag_stream_ordered(stream, delay=delay).writeStream.outputMode("update").format("memory").queryName(name)
         .option("checkpointLocation", _fresh_dir()).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name)


def _put(df, folder, i):
    path = os.path.join(folder, f"part{i}")
    df.coalesce(1).write.parquet(path)
    for f in os.listdir(path):  # files are read in order of their time
        os.utime(os.path.join(path, f), (1_700_000_000 + i, 1_700_000_000 + i))


EDITS = "doc_id long, seq long, op string, tag string, tags array<string>, ts timestamp"


def test_tag_fold_ordered_stream_of_shuffled_files(spark):
    """Edits spread over files without order give the batch result once the watermark has passed them."""
    ev = (TE.events_to_tag_events(read_table(spark, SF001, "events"))
          .withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("seq")))).cache()
    src = _fresh_dir()
    for i in range(4):
        _put(ev.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == i), src, i)
    _put(ev.limit(20), src, 4)  # some arrive again
    end = "timestamp'2100-01-01'"
    _put(spark.sql(f"SELECT -1L doc_id, 1L seq, 'add' op, 'end' tag, cast(null AS array<string>) tags, {end} ts"), src, 5)
    out = _ordered(spark, src, ev.schema, "orderedfold", "30 days").where("doc_id >= 0")
    final = out.groupBy("doc_id").agg(F.max_by("tags", "last_seq").alias("tags"), F.max("late").alias("late")).collect()
    want = {r.doc_id: r.tags for r in TE.tag_lists(TE.fold_tag_events(ev)).collect()}
    assert {r.doc_id: list(r.tags) for r in final if r.tags} == want
    assert all(r.late == 0 for r in final)


def test_tag_fold_ordered_stream_counts_late_edits(spark):
    src = _fresh_dir()
    at = lambda rows: spark.createDataFrame(
        [(d, s, op, tag, tags, sec) for d, s, op, tag, tags, sec in rows], EDITS.replace("ts timestamp", "sec long")
    ).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    _put(at([(1, 3, "remove", "a", None, 103), (1, 1, "add", "a", None, 101), (2, 1, "add", "x", None, 101)]), src, 0)
    _put(at([(1, 2, "add", "b", None, 102), (1, 4, "add", "a", None, 104), (3, 1, "add", "z", None, 500)]), src, 1)
    _put(at([(3, 2, "set", None, ["p", "q", "p"], 501), (3, 3, "remove", "p", None, 502)]), src, 2)
    # the watermark is past 400 now: these come too late; a null time or document is left out
    _put(at([(1, 5, "add", "late", None, 105), (4, 1, "add", "late", None, 90), (None, 1, "add", "n", None, 600),
             (3, 4, "add", "r", None, 503), (3, 9, "add", "n", None, None)]), src, 3)
    _put(at([(-1, 1, "add", "end", None, 90_000)]), src, 4)
    rows = _ordered(spark, src, at([(1, 1, "add", "a", None, 1)]).schema, "orderedlate", "100 seconds").where("doc_id > 0").collect()
    last = {}
    for r in rows:
        if r.doc_id not in last or (r.last_seq, r.late) >= last[r.doc_id][:2]:
            last[r.doc_id] = (r.last_seq, r.late, list(r.tags))
    assert last == {1: (4, 1, ["b", "a"]), 2: (1, 0, ["x"]), 3: (4, 0, ["q", "p", "r"]), 4: (-1, 1, [])}
