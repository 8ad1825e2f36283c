"""Listening activity as streams; every operator agrees with its batch form on the same rows in any order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from listenlake.operators.windows import joined_ranges
from listenlake.sources.library import current_version, last_batch, merge_table, read_latest, upsert_latest


def latest_position(events: DataFrame) -> DataFrame:
    """``document_id, segment_id, updated_at``: the newest pointer of each document, as a stream in update mode or as a batch."""
    newest = F.max(F.struct("event_ts", "segment_id")).alias("n")
    return events.groupBy("document_id").agg(newest).select("document_id", F.col("n.segment_id").alias("segment_id"), F.col("n.event_ts").alias("updated_at"))


def stream_latest_position(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest pointer of each document in a table; what is older than the table's row is ignored."""
    writer = latest_position(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda batch, n: upsert_latest(batch, path, batch_id=n, source=checkpoint) and None).trigger(availableNow=True).start()


class _Ranges(StatefulProcessor):
    """Keeps the merged ranges of a document's passages, disjoint within each; a passage is forgotten after ``ttl_ms`` without a change.

    State is read and written once a document and batch, however many of its passages got events.
    """

    def __init__(self, gap: float, ttl_ms: int | None):
        self.gap, self.ttl_ms = gap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ranges = handle.getListState("ranges", "segment_id string, start_s double, end_s double, seen_ms long", self.ttl_ms)

    def _merge(self, more: dict[str | None, list[tuple[float, float]]], timerValues) -> dict[str | None, list[list[float]]]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms is not None else 0
        held: dict[str | None, list[tuple]] = {}
        for r in self.ranges.get() if self.ranges.exists() else ():
            if self.ttl_ms is None or r[3] + self.ttl_ms > now:
                held.setdefault(r[0], []).append((r[1], r[2], r[3]))
        found: dict[str | None, list[list[float]]] = {}
        for segment, fresh in more.items():
            merged: list[list[float]] = []
            for start, end in sorted([r[:2] for r in held.get(segment, ())] + fresh):
                if merged and start <= merged[-1][1] + self.gap:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            found[segment] = merged
            held[segment] = [(start, end, now) for start, end in merged]
        if found:
            self.ranges.put([(segment, *r) for segment, ranges in held.items() for r in ranges])
        return found

    @staticmethod
    def _by_segment(segments, starts, ends) -> dict[str | None, list[tuple[float, float]]]:
        more: dict[str | None, list[tuple[float, float]]] = {}
        for segment, x, y in zip(segments, starts, ends):
            if x != y:
                more.setdefault(segment, []).append((min(x, y), max(x, y)))
        return more

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._merge(self._by_segment(initialState["segment_id"], initialState["start_s"].astype(float), initialState["end_s"].astype(float)), timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        more: dict[str | None, list[tuple[float, float]]] = {}
        for pdf in rows:
            a, b = (pdf[c].where(pdf[c].abs() < float("inf"), 0.0).clip(lower=0.0) for c in ("start_s", "end_s"))
            for segment, ranges in self._by_segment(pdf["segment_id"], a, b).items():
                more.setdefault(segment, []).extend(ranges)
        if found := self._merge(more, timerValues) if more else {}:
            yield pd.DataFrame({"document_id": [key[0]] * len(found), "segment_id": list(found), "ranges": [[{"start_s": s, "end_s": e} for s, e in ranges] for ranges in found.values()]})

    def close(self) -> None:
        pass


def stream_listened(events: DataFrame, stored: DataFrame | None = None, gap: float = 0.2, ttl_ms: int | None = None) -> DataFrame:
    """``document_id, segment_id, ranges``: the merged ranges of each passage that got events, in update mode.

    Needs the RocksDB state store.  A passage's list holds only what does not touch, so it stays short.  ``stored``
    (``document_id, segment_id, ranges``) is what the first batch of a new stream begins with.  With ``ttl_ms`` a passage that got no
    events for so long leaves the state, and what comes out later are ranges heard since, for ``keep_listened`` to join.
    """
    first = stored.select("document_id", "segment_id", F.explode("ranges").alias("r")).select("document_id", "segment_id", "r.start_s", "r.end_s").groupBy("document_id") if stored is not None else None
    kind = "document_id long, segment_id string, ranges array<struct<start_s:double,end_s:double>>"
    return events.groupBy("document_id").transformWithStateInPandas(_Ranges(gap, ttl_ms), kind, "Update", "None" if ttl_ms is None else "ProcessingTime", first)


def keep_listened(events: DataFrame, path: str, checkpoint: str, gap: float = 0.2, ttl_ms: int | None = None) -> StreamingQuery:
    """Keeps the ranges of every passage in a table, ``document_id, segment_id, ranges``: those that come out of the stream are joined
    with the stored ones, so that a passage that the state has forgotten loses nothing.  A new stream begins with the table's rows."""
    spark, keys = events.sparkSession, ("document_id", "segment_id")
    fresh = last_batch(spark, path, checkpoint) < 0 <= current_version(spark, path)

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, "__bucket").agg(joined_ranges(F.flatten(F.collect_list("ranges")), gap).alias("ranges"))

    found = stream_listened(events, read_latest(spark, path) if fresh else None, gap, ttl_ms)
    writer = found.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda batch, n: merge_table(batch, path, keys, combine, n, checkpoint) and None).trigger(availableNow=True).start()


def sessions(touches: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """``document_id, session_start, session_end, blocks, last_block``: conversations told apart by pauses.  Of blocks touched last at one
    time the largest is named."""
    found = touches.groupBy("document_id", F.session_window("event_ts", gap)).agg(F.sort_array(F.collect_set("block_id")).alias("blocks"), F.max(F.struct("event_ts", "block_id")).alias("last"))
    return found.select("document_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "blocks", F.col("last.block_id").alias("last_block"))


#: The time of a row that ends a stream: it moves the watermark behind every session.
END = "2200-01-01 00:00:00"


def stream_sessions(touches: DataFrame, gap_minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """The rows of ``sessions`` as a stream in append mode: a session comes out, and leaves the state, once the watermark has passed its
    end.  ``touches``: ``document_id, block_id, event_ts``; what comes later than ``late`` is dropped.

    A row without a block only moves the watermark; one at the time ``END`` closes all sessions.  Spark's own session windows: no document
    is a call to Python.
    """
    rows = touches.withWatermark("event_ts", late)
    # the condition names the time, so that it is not moved to before the watermark, which rows without a block are to move
    return sessions(rows.where(F.when(F.col("block_id").isNotNull(), F.col("event_ts")).isNotNull()), f"{gap_minutes} minutes")


def stream_import_dedup(docs: DataFrame, late: str = "7 days") -> DataFrame:
    """Imports whose content was not imported shortly before, in the stream's own state.  ``docs``: ``fingerprint, event_ts, ...``.

    A copy, and anything else, that comes later than the watermark is dropped; ``dropped_late`` counts it.
    """
    return docs.withWatermark("event_ts", late).dropDuplicatesWithinWatermark(["fingerprint"])


def keep_imports(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends imports of new content to ``path/new``, whatever their time and order: of each content the first of the first batch that
    has it, by ``event_ts`` and ``document_id``.  ``docs``: ``fingerprint, event_ts, document_id, ...``.

    The fingerprints of all batches are a table in buckets below ``path/known``, which every batch is held against.  A batch's rows are
    written before its fingerprints, to a folder of its own, so that one that is handed over again is either written anew or left as it is.
    """
    spark, known = docs.sparkSession, f"{path}/known"

    def write(batch: DataFrame, n: int) -> None:
        if n <= last_batch(spark, known, checkpoint):
            return batch.write.format("noop").mode("overwrite").save()
        columns = batch.columns
        first = batch.groupBy("fingerprint").agg(F.min_by(F.struct(*columns), F.struct("event_ts", "document_id")).alias("row")).select("row.*")
        version = current_version(spark, known)
        new = first.join(read_latest(spark, known).select("fingerprint"), "fingerprint", "left_anti") if version >= 0 else first
        new.select(*columns).write.mode("overwrite").parquet(f"{path}/new/version={version + 1}")
        upsert_latest(spark.read.parquet(f"{path}/new/version={version + 1}").select("fingerprint", "event_ts"), known, "fingerprint", "event_ts", n, checkpoint)

    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def dropped_late(query: StreamingQuery) -> int:
    """How many rows a stream has dropped so far as they came later than its watermark."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in json.loads(p.json if hasattr(p, "json") else json.dumps(p))["stateOperators"])


def stream_activity(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """``document_id, window_start, window_end, heard_s, n_events``: seconds heard in tumbling or sliding windows.

    Made for update mode, in which windows behind the watermark leave the state.  What comes later than the watermark is dropped,
    and shows in the query's progress as rows dropped by watermark.
    """
    window = F.window("event_ts", width, slide) if slide else F.window("event_ts", width)
    summed = events.withWatermark("event_ts", late).groupBy("document_id", window).agg(F.sum(F.abs(F.col("end_s") - F.col("start_s"))).alias("heard_s"), F.count("*").alias("n_events"))
    return summed.select("document_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "heard_s", "n_events")
