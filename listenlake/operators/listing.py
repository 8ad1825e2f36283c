"""Library listings, work queues, and what past sessions left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.operators.predicates import title_search


def natural_key(title: Column, width: int = 12) -> Column:
    """A sort key that orders numbers in titles by value: runs of digits, padded, in lower case."""
    padded = F.regexp_replace(F.lower(title), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0+(\d{{{width}}})(?!\d)", "$1")


def library_page(docs: DataFrame, query: str = "", order: str = "recent", limit: int = 20) -> DataFrame:
    """A page of the library: titles that hold the query, by ``recent``, ``title``, ``added`` or ``progress``."""
    keys = {"recent": F.desc("updated_at"), "title": natural_key(F.col("title")), "added": F.desc("created_at"), "progress": F.desc("progress")}
    return title_search(docs, query).orderBy(keys[order], "document_id").limit(limit)


def position_progress(playback: DataFrame, segs: DataFrame) -> DataFrame:
    """``document_id, progress``: percent of the passages up to the one being played; 0 where it is unknown."""
    met = segs.join(playback.select("document_id", F.col("segment_id").alias("current")), "document_id", "left")
    at = F.min(F.when(F.col("segment_id") == F.col("current"), F.col("seg_idx")))
    return met.groupBy("document_id").agg(F.coalesce((at + 1) * 100.0 / F.count("*"), F.lit(0.0)).alias("progress"))


def newest_memories(memories: DataFrame, k: int = 20) -> DataFrame:
    """The last ``k`` notes of each document, oldest first within it."""
    order = Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("memory_id"))
    return memories.withColumn("age", F.row_number().over(order)).where(F.col("age") <= k)


def narration_queue(constructs: DataFrame, pointers: DataFrame) -> DataFrame:
    """``document_id, construct_id, rank``: work at or after the playhead first, then the rest, each in order.

    ``constructs``: ``document_id, ord, construct_id, pos``; ``pointers``: ``document_id, playhead`` (a position).
    """
    rows = constructs.join(pointers.select("document_id", "playhead"), "document_id", "left")
    behind = F.coalesce(F.coalesce("pos", F.lit(2**31 - 1)) < F.col("playhead"), F.lit(False))
    order = Window.partitionBy("document_id").orderBy(behind, "ord")
    return rows.select("document_id", "construct_id", F.row_number().over(order).alias("rank"))


def generation_plan(segs: DataFrame, pointers: DataFrame, cached: DataFrame, buffer: int = 3, everything: bool = False) -> DataFrame:
    """``document_id, seg_idx, rank``: passages to synthesize: the current one and those after it, or all, round to the beginning.

    A pointer outside a document is brought into it; without one the document begins at 0.  ``pointers``: ``document_id, current``.
    """
    count = segs.groupBy("document_id").agg(F.max("seg_idx").alias("last"))
    at = count.join(pointers.select("document_id", "current"), "document_id", "left")
    at = at.select("document_id", F.greatest(F.lit(0), F.least(F.coalesce("current", F.lit(0)), "last")).alias("at"))
    rows = segs.select("document_id", "seg_idx", "segment_id").join(at, "document_id")
    if not everything:
        rows = rows.where(F.col("seg_idx").between(F.col("at"), F.col("at") + max(0, buffer)))
    rows = rows.join(cached.select("document_id", "segment_id").distinct(), ["document_id", "segment_id"], "left_anti")
    order = Window.partitionBy("document_id").orderBy(F.col("seg_idx") < F.col("at"), "seg_idx")
    return rows.select("document_id", "seg_idx", F.row_number().over(order).alias("rank"))


def footprint(touches: DataFrame, most: int = 500) -> DataFrame:
    """``document_id, blocks, last_block, last_session``: blocks talked about in the order of first mention, the last ``most``.

    Read from the whole log; a block that was mentioned long ago and again keeps its first place.
    ``touches``: ``document_id, session_id, seq, block_id``.
    """
    firsts = touches.groupBy("document_id", "block_id").agg(F.min("seq").alias("first"))
    order = Window.partitionBy("document_id").orderBy(F.desc("first"), F.desc("block_id"))
    kept = firsts.withColumn("age", F.row_number().over(order)).where(F.col("age") <= most)
    blocks = kept.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "block_id"))), lambda x: x["block_id"]).alias("blocks"))
    last = touches.groupBy("document_id").agg(F.max_by("block_id", F.struct("seq", "block_id")).alias("last_block"), F.max_by("session_id", F.struct("seq", "session_id")).alias("last_session"))
    return blocks.join(last, "document_id")


def clean_url(url: Column) -> Column:
    """A URL without ``utm_`` parameters and a bare question mark."""
    plain = F.regexp_replace(url, r"(?<=[?&])utm_[^=&#]*(?:=[^&#]*)?(?:&|(?=#|$))", "")
    return F.regexp_replace(F.regexp_replace(plain, r"&(?=#|$)", ""), r"\?(?=#|$)", "")


def citation_sources(citations: DataFrame) -> DataFrame:
    """``finding_id, ord, url, title``: the distinct sources of each finding, the first mention's title, the URL where it has none.

    ``citations``: ``finding_id, ord, url, title``.
    """
    rows = citations.where("coalesce(url, '') <> ''").withColumn("url", clean_url(F.col("url")))
    firsts = rows.groupBy("finding_id", "url").agg(F.min_by("title", "ord").alias("title"), F.min("ord").alias("ord"))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), "url")
    return firsts.select("finding_id", "ord", "url", title.alias("title"))


def left_off(touches: DataFrame, blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``document_id, title, days``: the section of the last block talked about, and whole days since.

    ``touches``: ``document_id, seq, block_id, age_s`` (seconds ago); ``nodes``: ``document_id, pos, title``.
    """
    last = touches.groupBy("document_id").agg(F.max_by(F.struct("block_id", "age_s"), F.struct("seq", "block_id")).alias("l")).select("document_id", "l.block_id", "l.age_s")
    at = last.join(blocks.select("document_id", "block_id", "pos"), ["document_id", "block_id"], "left")
    met = at.join(nodes.select("document_id", F.col("pos").alias("node_pos"), "title"), "document_id", "left")
    title = F.max_by("title", F.when(F.col("node_pos") <= F.col("pos"), F.col("node_pos")))
    return met.groupBy("document_id").agg(title.alias("title"), F.floor(F.first("age_s") / 86400).alias("days"))


def variant_key(segs: DataFrame, *parts: str | Column) -> DataFrame:
    """Adds ``variant_key``: a hash of the parts that name one audio file."""
    return segs.withColumn("variant_key", F.sha2(F.concat_ws("\x1f", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)), 256))


def find_by_fingerprint(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose ``fingerprint`` is among the keys."""
    return docs.join(keys.select("fingerprint").distinct(), "fingerprint", "left_semi")


def cascade_delete(ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the rows of the documents to delete."""
    gone = ids.select("document_id").distinct()
    return [table.join(gone, "document_id", "left_anti") for table in tables]


def drop_segment_audio(variants: DataFrame, segments: DataFrame) -> DataFrame:
    """Audio without any variant of the named passages.  ``segments``: ``document_id, segment_id``."""
    return variants.join(segments.select("document_id", "segment_id").distinct(), ["document_id", "segment_id"], "left_anti")
