"""T1 tag-edit fold, as a batch job and as a stateful stream.

Semantics per document: ``add`` appends a tag, ``remove`` drops the first
equal tag (no-op when absent), ``set`` replaces the whole list.

Batch form without collecting a document's events: only events after the
last ``set`` matter, and a ``remove`` of tag t only interacts with earlier
``add``s of t, which leave in first-in-first-out order. So per (document, tag)
the surviving adds are the latest k, where k is the running +1/-1 sum clamped
at zero, i.e. total - min(0, lowest prefix sum). Windows run per (doc_id,
tag, seq bucket) with carries between buckets from small tables, so no task
holds a document's whole history.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tagweave.session import cut_lineage

from tagweave import schemas

# Fixed mapping from the test table's event types to tag edits (``view`` is not an edit).
EVENT_OPS = {"click": "add", "purchase": "add", "error": "remove", "signup": "set"}


def events_to_tag_events(events: DataFrame) -> DataFrame:
    """Test-table adapter: ``events`` → ``(doc_id, seq, op, tag, tags)``.

    doc_id = user_id, seq = event_id, tag = "t" + tens digit of ``props.k``.
    """
    op = F.lit(None).cast("string")
    for et, o in EVENT_OPS.items():
        op = F.when(F.col("event_type") == et, F.lit(o)).otherwise(op)
    k = F.get_json_object("props", "$.k").cast("int")
    tag = F.concat(F.lit("t"), F.floor(k / 10).cast("string"))
    return (events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"),
                          op.alias("op"), tag.alias("tag"))
                  .where(F.col("op").isNotNull())
                  .withColumn("tags", F.when(F.col("op") == "set", F.array("tag")))
                  .select("doc_id", "seq", "op", "tag", "tags"))


def fold_tag_events(ev: DataFrame, bucket_width: int = 1 << 20) -> DataFrame:
    """Final tag list of every document as rows ``(doc_id, pos, tag)`` (pos from 1).

    A document whose list ends empty has no rows (it counts as untagged).
    Windows run per (document, tag, bucket of ``bucket_width`` seq values);
    what crosses buckets (running-sum carry, lowest prefix, adds after, list
    offsets) comes from small per-bucket tables, so even one document or one
    (document, tag) with a third of all events is sorted by many tasks.
    """
    last_set = (ev.where(F.col("op") == "set").groupBy("doc_id")
                  .agg(F.max_by("tags", "seq").alias("set_tags"), F.max("seq").alias("set_seq")))
    base = (last_set.select("doc_id", "set_seq", F.posexplode_outer("set_tags").alias("sub", "tag"))
                    .where(F.col("sub").isNotNull())
                    .select("doc_id", F.col("set_seq").alias("seq"), (F.col("sub") + 1).alias("sub"),
                            "tag", F.lit(1).alias("delta")))
    later = (ev.where(F.col("op").isin("add", "remove"))
               .join(last_set.select("doc_id", "set_seq"), "doc_id", "left")
               .where(F.col("set_seq").isNull() | (F.col("seq") > F.col("set_seq")))
               .select("doc_id", "seq", F.lit(0).alias("sub"), "tag",
                       F.when(F.col("op") == "add", 1).otherwise(-1).alias("delta")))
    steps = base.unionByName(later).withColumn("_b", F.floor(F.col("seq") / F.lit(bucket_width)))
    upto = Window.unboundedPreceding
    w_in = Window.partitionBy("doc_id", "tag", "_b").orderBy("seq", "sub").rowsBetween(upto, 0)
    # the edits with their running sums are written once and read by everything below
    steps = cut_lineage(steps.withColumn("run_in", F.sum("delta").over(w_in)))
    bstat = steps.groupBy("doc_id", "tag", "_b").agg(
        F.sum("delta").alias("tot_b"), F.min("run_in").alias("low_b"),
        F.sum(F.when(F.col("delta") == 1, 1).otherwise(0)).alias("adds_b"))
    wb = Window.partitionBy("doc_id", "tag").orderBy("_b")
    bstat = (bstat.withColumn("carry", F.coalesce(F.sum("tot_b").over(wb.rowsBetween(upto, -1)), F.lit(0)))
                  .withColumn("adds_after", F.coalesce(
                      F.sum("adds_b").over(wb.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))))
    bstat = cut_lineage(bstat)
    # adds that survive: the latest keep_n, keep_n = total - min(0, lowest prefix sum)
    tagstat = (bstat.groupBy("doc_id", "tag")
                    .agg(F.sum("tot_b").alias("total"), F.min(F.col("carry") + F.col("low_b")).alias("low"))
                    .select("doc_id", "tag", (F.col("total") - F.least(F.lit(0), F.col("low"))).alias("keep_n")))
    w_back = Window.partitionBy("doc_id", "tag", "_b").orderBy(F.col("seq").desc(), F.col("sub").desc())
    adds = (steps.where(F.col("delta") == 1)
                 .withColumn("from_end", F.row_number().over(w_back))
                 .join(bstat.select("doc_id", "tag", "_b", "adds_after"), ["doc_id", "tag", "_b"])
                 .join(tagstat, ["doc_id", "tag"]))
    kept = adds.where(F.col("from_end") + F.col("adds_after") <= F.col("keep_n"))
    w_pos = Window.partitionBy("doc_id", "_b").orderBy("seq", "sub")
    kept = kept.withColumn("pos_in", F.row_number().over(w_pos))
    cnt = kept.groupBy("doc_id", "_b").agg(F.count(F.lit(1)).alias("n_b"))
    cnt = cnt.withColumn("off", F.coalesce(F.sum("n_b").over(
        Window.partitionBy("doc_id").orderBy("_b").rowsBetween(upto, -1)), F.lit(0)))
    return kept.join(cnt, ["doc_id", "_b"]).select("doc_id", (F.col("off") + F.col("pos_in")).alias("pos"), "tag")


def tag_lists(rows: DataFrame) -> DataFrame:
    """``(doc_id, tags array<string>)`` in list order, from :func:`fold_tag_events` rows."""
    return (rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tag"))).alias("t"))
                .select("doc_id", F.transform("t", lambda x: x["tag"]).alias("tags")))


# --- streaming ---------------------------------------------------------------

STATE_SCHEMA = "tags array<string>, last_seq long, late long"
OUT_SCHEMA = "doc_id long, tags array<string>, last_seq long, late long"


def _apply_events(tags: list, ops: pd.DataFrame, last_seq: int) -> tuple[list, int, int]:
    late = 0
    for seq, op, tag, new in ops[["seq", "op", "tag", "tags"]].itertuples(index=False):
        if seq <= last_seq:
            late += 1
            continue
        last_seq = seq
        if op == "add":
            tags.append(tag)
        elif op == "remove":
            if tag in tags:
                tags.remove(tag)
        elif op == "set":
            tags = list(new) if new is not None else []
    return tags, last_seq, late


def _fold_group(key, pdfs: Iterator[pd.DataFrame], state):
    if state.exists:
        tags, last_seq, late = state.get
        tags = list(tags) if tags is not None else []
    else:
        tags, last_seq, late = [], -1, 0
    batch = pd.concat(list(pdfs), ignore_index=True).sort_values("seq", kind="stable")
    tags, last_seq, new_late = _apply_events(tags, batch, last_seq)
    late += new_late
    state.update((tags, int(last_seq), int(late)))
    yield pd.DataFrame({"doc_id": [key[0]], "tags": [tags], "last_seq": [last_seq], "late": [late]})


def fold_tag_stream(events: DataFrame) -> DataFrame:
    """Streaming T1: keyed state per document, events sorted by ``seq`` inside a micro-batch.

    Events whose ``seq`` is not above the last applied one arrive too late:
    they are skipped and counted in ``late``. Output mode: update.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout
    return events.groupBy("doc_id").applyInPandasWithState(
        _fold_group, OUT_SCHEMA, STATE_SCHEMA, "Update", GroupStateTimeout.NoTimeout)


class OrderedFold(StatefulProcessor):
    """Fold of one document's edits in order of (time, seq), each when the watermark has passed it.

    State is kept in entries, not as one list: ``pending`` per waiting edit, ``places`` per tag (the places of its
    surviving adds, ascending; a remove takes the first), so an edit touches the entries of its own tag only.
    ``head`` holds the next place, the last edit applied and the number of late ones. One timer waits for the
    earliest pending edit.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "ms long, seq long", "op string, tag string, tags array<string>")
        self.places = handle.getMapState("places", "tag string", "at array<long>")
        self.head = handle.getValueState("head", "place long, last_ms long, last_seq long, late long, timer long")

    def _load(self):
        return list(self.head.get()) if self.head.exists() else [0, -1, -1, 0, -1]

    def _wait(self, head, earliest: int) -> None:
        if head[4] < 0 or earliest < head[4]:
            if head[4] >= 0:
                self.handle.deleteTimer(head[4])
            head[4] = earliest
            self.handle.registerTimer(earliest)

    def _row(self, key, head):
        kept = sorted((at, tag) for (tag,), (places,) in self.places.iterator() for at in places)
        return pd.DataFrame({"doc_id": [key[0]], "tags": [[tag for _, tag in kept]],
                             "last_seq": [head[2]], "late": [head[3]]})

    def handleInputRows(self, key, rows, timerValues):
        head = self._load()
        late, earliest = head[3], None
        for pdf in rows:
            for ms, seq, op, tag, tags in pdf[["ms", "seq", "op", "tag", "tags"]].itertuples(index=False):
                if (ms, seq) <= (head[1], head[2]) or ms < timerValues.getCurrentWatermarkInMs():
                    head[3] += 1
                    continue
                self.pending.updateValue((int(ms), int(seq)), (op, tag, list(tags) if tags is not None else None))
                earliest = int(ms) if earliest is None else min(earliest, int(ms))
        if earliest is not None:
            self._wait(head, earliest)
        self.head.update(tuple(head))
        if head[3] > late:
            yield self._row(key, head)

    def _add(self, head, tag) -> None:
        old = self.places.getValue((tag,))[0] if self.places.containsKey((tag,)) else []
        self.places.updateValue((tag,), ([*old, head[0]],))
        head[0] += 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        head, mark = self._load(), timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(k) for k in self.pending.keys())
        due = [k for k in waiting if k[0] < mark]
        for k in due:
            op, tag, tags = self.pending.getValue(k)
            self.pending.removeKey(k)
            if op == "add":
                self._add(head, tag)
            elif op == "remove" and self.places.containsKey((tag,)):
                rest = list(self.places.getValue((tag,))[0])[1:]
                if rest:
                    self.places.updateValue((tag,), (rest,))
                else:
                    self.places.removeKey((tag,))
            elif op == "set":
                self.places.clear()
                for t in tags or []:
                    self._add(head, t)
            head[1], head[2] = k
        head[4] = -1
        if len(due) < len(waiting):  # an edit at the watermark itself waits for the next one
            self._wait(head, max(waiting[len(due)][0], mark + 1))
        self.head.update(tuple(head))
        if due:
            yield self._row(key, head)


def fold_tag_stream_ordered(events: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Streaming T1 with the order restored: ``(doc_id, tags, last_seq, late)`` of each document that changed.

    Edits wait until the watermark (the largest ``time`` seen, less ``delay``) has passed theirs and are then folded
    in order of (time, seq), so files may arrive in any order within ``delay``. Edits that the watermark has passed
    already are counted in ``late``, not applied. An edit that arrives twice counts once. Rows without a time, a
    document or a seq are left out. Output mode: update. State needs the RocksDB store, which is set here.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # time goes on as a plain number: rows with the watermarked column would be dropped uncounted when late
    marked = (events.where(F.col(time).isNotNull() & F.col("doc_id").isNotNull() & F.col("seq").isNotNull())
                    .withWatermark(time, delay)
                    .select("doc_id", "seq", "op", "tag", "tags", F.unix_millis(F.col(time)).alias("ms")))
    return marked.groupBy("doc_id").transformWithStateInPandas(OrderedFold(), OUT_SCHEMA, "Update", "EventTime")


def read_tag_event_stream(spark, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Tag events arriving as parquet files in ``path``."""
    return (spark.readStream.schema(schemas.TAG_EVENTS)
                 .option("maxFilesPerTrigger", max_files_per_trigger).parquet(path))
