"""Lookups, overlaps and as-of matches between document tables, as equi-joins on the document with a residual, or as windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlake.functions import needles as needle_lookups
from listenlake.functions.text import WORD, finite, squeeze, words_in
from listenlake.operators.windows import held

_UPTO = (Window.unboundedPreceding, 0)


def _digest(text: Column) -> Column:
    """What stands for a text where only its identity counts."""
    return F.unhex(F.sha2(text, 256))


def match_existing(incoming: DataFrame, known: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(new, duplicates)``: incoming documents whose content the library lacks, and those it has.  ``known`` has ``fingerprint``."""
    hashed = incoming.withColumn("fingerprint", F.sha2(F.col(text), 256))
    have = known.select("fingerprint").distinct()
    return hashed.join(have, "fingerprint", "left_anti"), hashed.join(have, "fingerprint", "left_semi")


def playback_overlay(docs: DataFrame, playback: DataFrame) -> DataFrame:
    """Documents with their playback fields where these are at least as fresh as the document."""
    fresh = playback.withColumnsRenamed({"document_id": "__id", "updated_at": "__at"})
    on = (F.col("document_id") == F.col("__id")) & (F.col("__at") >= F.col("updated_at"))
    return docs.join(fresh, on, "left").withColumn("played_at", F.col("__at")).drop("__id", "__at")


#: Blocks, or characters of a passage, in a bin of an interval join.
BLOCK_BIN, CHAR_BIN = 64, 64


def bins_of(first: Column, last: Column, width: int) -> Column:
    """The bins that a range of whole numbers meets, its ends included; none for an inverted range."""
    low, high = F.floor(first / F.lit(width)).cast("int"), F.floor(last / F.lit(width)).cast("int")
    return F.when(first <= last, F.sequence(low, high))


def in_bin(at: Column, width: int) -> Column:
    return F.floor(at / F.lit(width)).cast("int")


def annotation_passages(annotations: DataFrame, segs: DataFrame) -> DataFrame:
    """``document_id, annotation_id, seg_idx``: the passages that an annotation covers.

    Offsets matter in the first and last block only; inverted anchors cover nothing, nor do orphaned annotations.  Blocks are joined in
    bins, so that a document with very many passages and annotations is many small groups.
    """
    live = annotations.where("not orphaned") if "orphaned" in annotations.columns else annotations
    live = live.where("start_pos <= end_pos").select("document_id", "annotation_id", "start_pos", "start_offset", "end_pos", "end_offset", F.explode(bins_of(F.col("start_pos"), F.col("end_pos"), BLOCK_BIN)).alias("__bin"))
    within = segs.select("document_id", "seg_idx", "block_pos", "start", F.coalesce(F.col("end") if "end" in segs.columns else F.lit(None), F.col("start") + F.length("text")).alias("stop"), in_bin(F.col("block_pos"), BLOCK_BIN).alias("__bin"))
    met = live.join(within, ["document_id", "__bin"]).where("block_pos between start_pos and end_pos")
    starts = (F.col("block_pos") != F.col("start_pos")) | (F.col("stop") > F.col("start_offset"))
    ends = (F.col("block_pos") != F.col("end_pos")) | (F.col("start") < F.col("end_offset"))
    return met.where(starts & ends).select("document_id", "annotation_id", "seg_idx")


def anchored_text(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """``document_id, annotation_id, anchored``: the text between the anchors, blocks joined by spaces; null where they do not fit."""
    rows = annotations.select("document_id", "annotation_id", "start_pos", "start_offset", "end_pos", "end_offset")
    binned = rows.withColumn("__bin", F.explode(bins_of(F.col("start_pos"), F.col("end_pos"), BLOCK_BIN)))
    met = binned.join(blocks.select("document_id", "pos", "text", in_bin(F.col("pos"), BLOCK_BIN).alias("__bin")), ["document_id", "__bin"]).where("pos between start_pos and end_pos")
    begin = F.when(F.col("pos") == F.col("start_pos"), F.col("start_offset")).otherwise(0)
    end = F.when(F.col("pos") == F.col("end_pos"), F.col("end_offset")).otherwise(F.length("text"))
    met = met.withColumns({"fits": (begin <= F.length("text")) & (end <= F.length("text")), "part": F.substring("text", begin + 1, F.greatest(F.lit(0), end - begin))})
    keys = ["document_id", "annotation_id"]
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), " ")
    texts = met.groupBy(*keys).agg(parts.alias("anchored"), F.bool_and("fits").alias("fits"), F.count("*").alias("n"), F.first("start_pos").alias("s"), F.first("end_pos").alias("e"), F.first("start_offset").alias("so"), F.first("end_offset").alias("eo"))
    whole = F.col("fits") & (F.col("n") == F.col("e") - F.col("s") + 1) & ((F.col("s") < F.col("e")) | (F.col("so") < F.col("eo")))
    return rows.select(*keys).join(texts.select(*keys, F.when(whole, F.col("anchored")).alias("anchored")), keys, "left")


def excerpt(text: Column, head: int = 300, tail: int = 99) -> Column:
    """A text on one line, its middle left out if it is long."""
    return _shortened(squeeze(text), head, tail)


def _shortened(plain: Column, head: int = 300, tail: int = 99) -> Column:
    return F.when(F.length(plain) <= head + tail + 1, plain).otherwise(F.concat(F.left(plain, F.lit(head)), F.lit("…"), F.right(plain, F.lit(tail))))


def annotation_excerpt(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """``document_id, annotation_id, excerpt`` of annotations whose anchors fit."""
    return anchored_text(annotations, blocks).where("anchored is not null and anchored <> ''").select("document_id", "annotation_id", excerpt(F.col("anchored")).alias("excerpt"))


def _rows(*columns: pa.Array):
    """The values of each row, a null array as an empty one; one row after the other, so that a batch is never held as Python objects."""
    return (tuple([] if (value := x.as_py()) is None else value for x in row) for row in zip(*columns))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _holding(texts: pa.Array, needles: pa.Array) -> pa.Array:
    return pa.array((needle_lookups.holding(*row) for row in _rows(texts, needles)), pa.list_(pa.list_(pa.int32())))


def _by_document(rows: DataFrame, name: str, *columns: str | Column) -> DataFrame:
    """One row a document, with its rows as structs of ``columns`` in an array ``name``, sorted."""
    return rows.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def holders(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """``document_id, needle_id, text_id``: the texts of a document that hold a needle, which is not empty.

    ``needles``: ``document_id, needle_id, needle``; ``texts``: ``document_id, text_id, text``.  Each table travels once, to its document;
    what is looked up there, by hashes of windows if it is much, stays inside the task.
    """
    asked = _by_document(needles.where("needle <> ''"), "asked", "needle", "needle_id")
    met = _by_document(texts.where("text is not null"), "held", "text_id", "text").join(asked, "document_id")
    found = met.select("document_id", "held.text_id", F.explode(F.arrays_zip("asked", _holding(F.col("held.text"), F.col("asked.needle")).alias("at"))).alias("x"))
    return found.select("document_id", F.col("x.asked.needle_id").alias("needle_id"), F.explode(F.transform("x.at", lambda i: F.get("text_id", i))).alias("text_id")).distinct()


_ANCHORS = ("start_pos", "start_offset", "end_pos", "end_offset")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _anchored(positions: pa.Array, texts: pa.Array, start_pos: pa.Array, start_offset: pa.Array, end_pos: pa.Array, end_offset: pa.Array) -> pa.Array:
    def of(positions, texts, *notes):
        blocks = dict(zip(positions, texts))
        return [needle_lookups.anchored(blocks, *note) for note in zip(*notes)]

    return pa.array((of(*row) for row in _rows(positions, texts, start_pos, start_offset, end_pos, end_offset)), pa.list_(pa.string()))


_PLACES = T.ArrayType(T.StructType([T.StructField("status", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in _ANCHORS)]))


@F.arrow_udf(_PLACES)
def _rescued(positions: pa.Array, texts: pa.Array, start_pos: pa.Array, start_offset: pa.Array, end_pos: pa.Array, end_offset: pa.Array, excerpts: pa.Array, probe: pa.Array) -> pa.Array:
    found = (needle_lookups.rescued(p, t, list(zip(*notes)), n) for p, t, *notes, n in _rows(positions, texts, start_pos, start_offset, end_pos, end_offset, excerpts, probe))
    kind = pa.struct([("status", pa.string()), *((c, pa.int32()) for c in _ANCHORS)])
    return pa.array(([dict(zip(("status", *_ANCHORS), place)) for place in rows] for rows in found), pa.list_(kind))


def excerpts_in_documents(rows: DataFrame) -> DataFrame:
    """``rows`` with the notes that fit only, and their ``excerpt``.  ``rows``, one a document, holds ``notes``, an array of structs with
    ``annotation_id`` and anchors, and ``blocks``, one of ``pos, text``."""
    rows = held(rows, noted=F.col("notes"), texts=F.col("blocks"))
    anchored = _anchored("texts.pos", "texts.text", *(F.col(f"noted.{c}") for c in _ANCHORS))
    fitting = F.filter(F.arrays_zip(F.col("noted").alias("note"), anchored.alias("plain")), lambda x: x["plain"] != "")
    rows = held(rows, fitting=F.transform(fitting, lambda x: F.struct(*(x["note"][c].alias(c) for c in ("annotation_id", *_ANCHORS)), squeeze(x["plain"]).alias("plain"))))
    note = lambda x: F.struct(*(x[c].alias(c) for c in ("annotation_id", *_ANCHORS)), _shortened(x["plain"]).alias("excerpt"))
    return rows.withColumn("notes", F.transform("fitting", note)).drop("noted", "texts", "fitting")


def rescue_in_documents(rows: DataFrame, probe: int = 60) -> DataFrame:
    """What ``rescue_annotations`` finds where a row holds a document: ``document_id``, ``notes``, an array of structs with
    ``annotation_id``, anchors and ``excerpt``, and ``blocks``, one of ``pos, text``.  Nothing is shuffled."""
    rows = held(rows.select("document_id", "notes", "blocks"), noted=F.col("notes"), texts=F.col("blocks"))
    found = _rescued("texts.pos", "texts.text", *(F.col(f"noted.{c}") for c in (*_ANCHORS, "excerpt")), F.lit(probe))
    each = rows.select("document_id", F.explode(F.arrays_zip(F.col("noted").alias("note"), found.alias("place"))).alias("x"))
    moved = F.col("x.place.status") == "moved"
    return each.select("document_id", "x.note.annotation_id", "x.place.status", *(F.when(moved, F.col(f"x.place.{c}")).otherwise(F.col(f"x.note.{c}")).alias(c) for c in _ANCHORS))


def rescue_annotations(annotations: DataFrame, blocks: DataFrame, probe: int = 60) -> DataFrame:
    """``document_id, annotation_id, status`` and anchors after the text changed.

    ``kept``: both ends of the stored excerpt still read the same.  ``moved``: the excerpt's head is found in the first block that
    holds it, and its tail from there on, blanks aside.  ``orphaned``: neither.  Annotations and blocks travel once, to their document.
    """
    notes = _by_document(annotations, "notes", "annotation_id", *_ANCHORS, "excerpt")
    texts = _by_document(blocks, "blocks", "pos", "text")
    without = notes.join(texts, "document_id", "left_anti").withColumn("blocks", F.array().cast(texts.schema["blocks"].dataType))
    return rescue_in_documents(notes.join(texts, "document_id").unionByName(without), probe)


def section_of_block(blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """``document_id, pos, section``: the latest bound at or before each block, by one window over both tables.

    ``bounds`` has ``document_id, pos, section``; of bounds at one place the last by name counts.
    """
    marks = bounds.select("document_id", "pos", F.lit(0).alias("is_block"), "section")
    rows = blocks.select("document_id", "pos", F.lit(1).alias("is_block"), F.lit(None).cast("string").alias("section"))
    order = Window.partitionBy("document_id").orderBy("pos", "is_block", "section").rowsBetween(*_UPTO)
    return marks.unionByName(rows).withColumn("section", F.last("section", ignorenulls=True).over(order)).where("is_block = 1").select("document_id", "pos", "section")


def page_for_offset(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """``document_id, pos, page``: the page whose span begins last at or before a block's ``src_start``.

    Before the first span it is the first page; a page that the block has stays.  ``spans``: ``document_id, page, start``.
    """
    marks = spans.select("document_id", F.col("start").alias("at"), F.lit(0).alias("is_block"), F.lit(None).cast("int").alias("pos"), F.col("page").alias("span_page"), F.lit(None).cast("int").alias("own"))
    rows = blocks.select("document_id", F.col("src_start").alias("at"), F.lit(1).alias("is_block"), "pos", F.lit(None).cast("int").alias("span_page"), F.col("page").alias("own"))
    keys = Window.partitionBy("document_id")
    order = keys.orderBy("at", "is_block", "span_page", "pos").rowsBetween(*_UPTO)
    first = F.min_by("span_page", F.when(F.col("is_block") == 0, F.struct("at", "span_page"))).over(keys)
    found = marks.unionByName(rows).withColumn("found", F.when(F.col("at").isNotNull(), F.coalesce(F.last("span_page", ignorenulls=True).over(order), first)))
    return found.where("is_block = 1").select("document_id", "pos", F.coalesce("own", "found").alias("page"))


def bookmark_targets(bookmarks: DataFrame, blocks: DataFrame) -> DataFrame:
    """``document_id, bm_idx, pos``: the block that each bookmark leads to.

    A heading of the same title on its page, else on the page before or after, else the first block at or after the page.  A
    document keeps its own outline (no rows) with fewer than two bookmarks or targets, or fewer than a third of its headings.
    """
    key = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[\d.]+", " "), r"\s+", " "))
    rows = bookmarks.select("document_id", "bm_idx", F.col("page").alias("to"), key(F.col("title")).alias("key"))
    heads = blocks.where("kind = 'heading' and page is not null").select("document_id", "pos", "page", key(F.col("text")).alias("key"))
    near = rows.where("key <> ''").join(heads, ["document_id", "key"]).withColumn("off", F.abs(F.col("page") - F.col("to"))).where("off <= 1")
    near = near.groupBy("document_id", "bm_idx").agg(F.min(F.struct("off", "pos")).alias("m")).select("document_id", "bm_idx", F.col("m.pos").alias("near"))
    # the first block in document order at or after a page: the smallest position over later pages
    firsts = blocks.where("page is not null").groupBy("document_id", "page").agg(F.min("pos").alias("first"))
    later = F.min("first").over(Window.partitionBy("document_id").orderBy("page").rowsBetween(0, Window.unboundedFollowing))
    firsts = firsts.withColumn("first", later)
    marks = rows.select("document_id", "bm_idx", "to", F.lit(None).cast("int").alias("first")).unionByName(firsts.select("document_id", F.lit(None).cast(rows.schema["bm_idx"].dataType).alias("bm_idx"), F.col("page").alias("to"), "first"))
    # pages sort after bookmarks of the same page, so the next page from each bookmark on is its own or a later one
    order = Window.partitionBy("document_id").orderBy("to", F.col("first").isNotNull(), "bm_idx")
    after = marks.withColumn("fallback", F.first("first", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))).where("bm_idx is not null").select("document_id", "bm_idx", "fallback")
    found = after.join(near, ["document_id", "bm_idx"], "left").select("document_id", "bm_idx", F.coalesce("near", "fallback").alias("pos"))
    heading_count = blocks.groupBy("document_id").agg(F.count(F.when(F.col("kind") == "heading", 1)).alias("headings"))
    counts = found.groupBy("document_id").agg(F.count("pos").alias("targets"))
    fine = counts.join(heading_count, "document_id").where("targets >= 2 and targets * 3 >= headings").select("document_id")
    return found.where("pos is not null").join(fine, "document_id", "left_semi")


def locate_time(queries: DataFrame, timeline: DataFrame) -> DataFrame:
    """``document_id, query_id, seg_idx, offset_s``: where in a document a second falls.

    It is the first passage that ends at or after it, so a boundary belongs to the earlier passage; times beyond either end are
    those ends.  ``timeline``: ``document_id, seg_idx, est_duration``.  One window over passages and queries, no range join.
    """
    order = Window.partitionBy("document_id").orderBy("seg_idx").rowsBetween(*_UPTO)
    ends = timeline.select("document_id", "seg_idx", finite(F.col("est_duration")).alias("d")).withColumn("stop", F.sum("d").over(order))
    total = ends.groupBy("document_id").agg(F.max("stop").alias("total"))
    asked = queries.join(total, "document_id").select("document_id", "query_id", F.least(finite(F.col("second")), F.col("total")).alias("at"))
    marks = ends.select("document_id", F.col("stop").alias("at"), F.lit(1).alias("is_end"), F.struct("seg_idx", "d", "stop").alias("seg"), F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"))
    both = marks.unionByName(asked.select("document_id", "at", F.lit(0).alias("is_end"), F.lit(None).cast("struct<seg_idx:int,d:double,stop:double>").alias("seg"), "query_id"))
    ahead = Window.partitionBy("document_id").orderBy("at", "is_end", F.col("seg.seg_idx")).rowsBetween(0, Window.unboundedFollowing)
    hit = both.withColumn("seg", F.first("seg", ignorenulls=True).over(ahead)).where("is_end = 0")
    return hit.select("document_id", "query_id", F.col("seg.seg_idx").alias("seg_idx"), F.least("seg.d", F.greatest(F.lit(0.0), F.col("at") - (F.col("seg.stop") - F.col("seg.d")))).alias("offset_s"))


def word_place(pointers: DataFrame, segs: DataFrame) -> DataFrame:
    """``document_id, position_id, block_pos, offset``: where in its block a word of a passage begins, to be found again after
    the text was cut anew.  ``pointers``: ``document_id, position_id, segment_id, word_idx``; ``segs``: ``..., segment_id, block_pos, start, text``.
    A word that the passage lacks is its beginning; pointers to no passage give no row."""
    words, gaps = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.split("text", WORD, -1)
    past = F.length(F.array_join(F.slice(words, F.lit(1), F.col("word_idx")), "")) + F.length(F.array_join(F.slice(gaps, F.lit(1), F.col("word_idx") + 1), ""))
    met = pointers.join(segs.select("document_id", "segment_id", "block_pos", "start", "text"), ["document_id", "segment_id"])
    begins = F.when((F.col("word_idx") >= 0) & (F.col("word_idx") < F.size(words)), past).otherwise(0)
    return met.select("document_id", "position_id", "block_pos", (F.col("start") + begins).alias("offset"))


def remap_position(positions: DataFrame, segs: DataFrame) -> DataFrame:
    """``document_id, position_id, segment_id, word_idx, offset_s``: the passage and word that a place in a block falls into after
    it was cut anew.

    The first passage whose range holds the place, both ends included, else the block's last one; in it the last word that
    begins at or before the place, else the first, and that word's share of the passage's seconds.
    ``positions``: ``document_id, position_id, block_pos, offset``; ``segs``: ``..., seg_idx, segment_id, block_pos, start, end, text,
    est_duration``.
    """
    held = segs.select("document_id", "seg_idx", "block_pos", "segment_id", "start", "end", "text", "est_duration", words_in(F.col("text")).alias("words"))
    met = positions.join(held, ["document_id", "block_pos"])
    # words that begin at or before the place are those of the text up to and with the character there: a word cut short is still one word
    begun = words_in(F.left("text", F.greatest(F.lit(0), F.col("offset") - F.col("start") + 1).cast("int")))
    found = F.struct("segment_id", F.greatest(F.lit(0), begun - 1).alias("word_idx"), "words", "est_duration")
    met = met.select("document_id", "position_id", "seg_idx", F.col("offset").between(F.col("start"), F.col("end")).alias("holds"), found.alias("seg"))  # texts go no further
    best = met.groupBy("document_id", "position_id").agg(F.coalesce(F.min_by("seg", F.when(F.col("holds"), F.col("seg_idx"))), F.max_by("seg", "seg_idx")).alias("seg"))
    return best.select("document_id", "position_id", "seg.segment_id", "seg.word_idx", (finite(F.col("seg.est_duration")) * F.col("seg.word_idx") / F.greatest(F.lit(1), F.col("seg.words"))).alias("offset_s"))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _moved(pointers: pa.Array, needles: pa.Array, old_ids: pa.Array, old_texts: pa.Array, new_ids: pa.Array, new_texts: pa.Array, lowered: pa.Array) -> pa.Array:
    return pa.array((needle_lookups.moved_passages(*row) for row in _rows(pointers, needles, old_ids, old_texts, new_ids, new_texts, lowered)), pa.list_(pa.string()))


def migrate_in_documents(rows: DataFrame) -> DataFrame:
    """What ``migrate_segment`` finds where a row holds a document: ``document_id`` and arrays of structs, ``pointers`` of ``pointer_id,
    segment_id, excerpt``, ``old`` of ``segment_id, text`` and ``new`` of ``segment_id, text`` in order.  Nothing is shuffled."""
    rows = held(rows.select("document_id", "pointers", "old", "new"), asked=F.col("pointers"), was=F.col("old"), now=F.col("new"))
    needles = F.transform("asked", lambda p: F.lower(F.coalesce(p["excerpt"], F.lit(""))))
    found = _moved(F.col("asked.segment_id"), needles, *(F.col(c) for c in ("was.segment_id", "was.text", "now.segment_id", "now.text")), F.transform("now", lambda n: F.lower(n["text"])))
    met = rows.select("document_id", F.explode(F.arrays_zip(F.col("asked.pointer_id").alias("pointer_id"), found.alias("segment_id"))).alias("x"))
    return met.select("document_id", "x.pointer_id", "x.segment_id")


def migrate_segment(pointers: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``document_id, pointer_id, segment_id``: the new passage for an old one: of the same id and text, of the same text, or
    the first that holds the pointer's excerpt.  ``pointers``: ``document_id, pointer_id, segment_id, excerpt``.  Each table travels once,
    to its document."""
    asked = _by_document(pointers, "pointers", "pointer_id", "segment_id", "excerpt")
    met = asked.join(_by_document(old, "old", "segment_id", "text"), "document_id", "left").join(_by_document(new, "new", "seg_idx", "segment_id", "text"), "document_id", "left")
    none = F.array().cast("array<struct<segment_id:string,text:string>>")
    return migrate_in_documents(met.withColumns({c: F.coalesce(F.transform(c, lambda x: F.struct(x["segment_id"].alias("segment_id"), x["text"].alias("text"))), none) for c in ("old", "new")}))


def cached_passages(segs: DataFrame, variants: DataFrame, **setting: object) -> DataFrame:
    """Passages that have audio for a voice and engine setting, given as columns of ``variants`` and their values."""
    chosen = variants
    for column, value in setting.items():
        chosen = chosen.where(F.col(column) == F.lit(value))
    return segs.join(chosen.select("document_id", "segment_id").distinct(), ["document_id", "segment_id"], "left_semi")


def stale_audio(old: DataFrame, new: DataFrame, variants: DataFrame) -> DataFrame:
    """Audio of passages whose text changed or that are gone."""
    now = new.select("document_id", "segment_id", F.col("text").alias("new_text"))
    gone = old.join(now, ["document_id", "segment_id"], "left").where(~F.col("text").eqNullSafe(F.col("new_text"))).select("document_id", "segment_id").distinct()
    return variants.join(gone, ["document_id", "segment_id"], "left_semi")


def missing_files(variants: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Audio rows whose file is not in the listing."""
    return variants.join(listing.select(path).distinct(), path, "left_anti")


def renumber_blocks(blocks: DataFrame) -> DataFrame:
    """Dense block ids after insertions: ``document_id, pos, block_id, parent_id, children``, references rewritten.

    References to blocks that are not there stay as they are.
    """
    order = Window.partitionBy("document_id").orderBy("pos")
    rows = blocks.withColumn("new_pos", (F.row_number().over(order) - 1).cast("int"))
    names = rows.select("document_id", F.col("block_id").alias("old"), F.concat(F.lit("b"), F.col("new_pos").cast("string")).alias("new"))
    parents = rows.join(names.withColumnsRenamed({"old": "parent_id", "new": "new_parent"}), ["document_id", "parent_id"], "left")
    kids = rows.where(F.size("children") > 0).select("document_id", "new_pos", F.posexplode("children").alias("i", "child"))
    kids = kids.join(names.withColumnRenamed("old", "child"), ["document_id", "child"], "left")
    kids = kids.groupBy("document_id", "new_pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("new", "child").alias("c")))), lambda x: x["c"]).alias("kids"))
    out = parents.join(kids, ["document_id", "new_pos"], "left")
    return out.select("document_id", F.col("new_pos").alias("pos"), F.concat(F.lit("b"), F.col("new_pos").cast("string")).alias("block_id"), F.coalesce("new_parent", "parent_id").alias("parent_id"), F.coalesce("kids", "children").alias("children"))


def segment_diff(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = ("segment_id", "text")) -> DataFrame:
    """``document_id, seg_idx, change``: passages added, removed or changed; equal ones are left out."""
    keys = ["document_id", "seg_idx"]
    a, b = old.select(*keys, F.struct(*fields).alias("o")), new.select(*keys, F.struct(*fields).alias("n"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("o").eqNullSafe(F.col("n"))).select(*keys, change.alias("change"))


def reconcile_study(sections: DataFrame, nodes: DataFrame, least_prose: int = 40) -> DataFrame:
    """``document_id, node_id, action, summary``: what becomes of each section's note.

    ``kept``: its own note is ready and of the same text.  ``rescued``: another ready note was of the same text; of such the last
    one, taken once, by the first section that needs it, unless an earlier section keeps it.  ``settled``: hardly any text
    beyond the title.  ``queued``: the rest.  ``sections``: ``document_id, ord, node_id, title, text, source_hash``; ``nodes``, of
    the current prompt version: ``document_id, ord, node_id, source_hash, status, summary``.
    """
    own = nodes.groupBy("document_id", "node_id").agg(F.max_by(F.struct(F.col("source_hash").alias("h"), F.col("status").alias("st"), F.col("summary").alias("own_summary")), "ord").alias("own"))  # the last of an id counts
    own = own.select("document_id", "node_id", "own.*")
    rows = sections.join(own, ["document_id", "node_id"], "left").withColumn("exact", F.coalesce((F.col("st") == "ready") & (F.col("h") == F.col("source_hash")), F.lit(False)))
    last = nodes.where("status = 'ready' and coalesce(summary, '') <> ''").groupBy("document_id", "source_hash").agg(F.max_by(F.struct(F.col("node_id").alias("from"), "summary"), "ord").alias("spare"))
    rows = rows.join(last, ["document_id", "source_hash"], "left")
    first = (F.row_number().over(Window.partitionBy("document_id", "source_hash", "exact").orderBy("ord")) == 1) & ~F.col("exact")
    kept_at = rows.where("exact").select("document_id", F.col("node_id").alias("from"), F.col("ord").alias("kept_ord"))
    rows = rows.withColumns({"first": first, "from": F.col("spare.from")}).join(kept_at, ["document_id", "from"], "left")
    free = F.col("kept_ord").isNull() | (F.col("kept_ord") > F.col("ord"))
    rescued = F.col("first") & F.col("spare").isNotNull() & free
    prose = F.length(F.trim(F.regexp_replace("text", F.concat(F.lit(r"^\Q"), "title", F.lit(r"\E")), "")))
    action = F.when(F.col("exact"), "kept").when(rescued, "rescued").when(prose < least_prose, "settled").otherwise("queued")
    summary = F.when(F.col("exact"), F.col("own_summary")).when(rescued, F.col("spare.summary"))
    return rows.select("document_id", "node_id", action.alias("action"), summary.alias("summary"))


def reconcile_narrations(constructs: DataFrame, entries: DataFrame, prompts: DataFrame, prompt_version: int) -> DataFrame:
    """``document_id, construct_id, status, queued``: what becomes of each construct's description.

    A ready entry of the same source stays if it was written by hand, or under the current prompt; a changed source or prompt makes
    it pending, and another ready entry of the same source rescues it once.  A failed entry stays failed and is queued again.
    ``constructs``: ``document_id, ord, construct_id, kind, source_hash``; ``entries``: ``document_id, construct_id, kind, status,
    source_hash, prompt_version, prompt_hash, origin``; ``prompts``: ``kind, prompt_hash``.
    """
    current = entries.join(F.broadcast(prompts.withColumnRenamed("prompt_hash", "now")), "kind", "left")
    good = (F.col("origin") == "manual") | ((F.col("prompt_version") == prompt_version) & F.col("prompt_hash").eqNullSafe(F.col("now")))
    current = current.withColumn("good", F.coalesce(good, F.lit(False)) & (F.col("status") == "ready"))
    own = current.select("document_id", "construct_id", F.col("source_hash").alias("h"), F.col("status").alias("st"), F.col("good").alias("own_good"))
    rows = constructs.join(own, ["document_id", "construct_id"], "left").withColumn("exact", F.coalesce(F.col("own_good") & (F.col("h") == F.col("source_hash")), F.lit(False)))
    spare = current.where("good").groupBy("document_id", "source_hash", "kind").agg(F.max("construct_id").alias("from"))
    taken = rows.where("exact").select("document_id", F.col("construct_id").alias("from"), F.lit(True).alias("taken"))
    rows = rows.join(spare, ["document_id", "source_hash", "kind"], "left").join(taken, ["document_id", "from"], "left")
    first = F.row_number().over(Window.partitionBy("document_id", "source_hash", "kind", "exact").orderBy("ord")) == 1
    failed = F.coalesce((F.col("st") == "failed") & (F.col("h") == F.col("source_hash")), F.lit(False))
    rescued = ~F.col("exact") & ~failed & first & F.col("from").isNotNull() & F.col("taken").isNull()
    ready = F.col("exact") | rescued
    return rows.select("document_id", "construct_id", F.when(ready, "ready").when(failed, "failed").otherwise("pending").alias("status"), (~ready).alias("queued"))


def passage_marker(blocks: DataFrame, segs: DataFrame) -> DataFrame:
    """``document_id, pos, marker``: the first passage of each block, null where it has none."""
    firsts = segs.groupBy("document_id", F.col("block_pos").alias("pos")).agg(F.min("seg_idx").alias("marker"))
    return blocks.select("document_id", "pos").join(firsts, ["document_id", "pos"], "left")


def word_timing_from_chars(words: DataFrame, chars: DataFrame) -> DataFrame:
    """``document_id, seg_idx, word_idx, start_s, end_s``: from the times of a word's first and last characters.

    ``words``: ``..., start, end`` (places); ``chars``: ``document_id, seg_idx, char_pos, start_s, end_s``.
    """
    keys = ["document_id", "seg_idx"]
    binned = words.select(*keys, "word_idx", "start", "end", F.explode(bins_of(F.col("start"), F.col("end") - 1, CHAR_BIN)).alias("__bin"))
    met = binned.join(chars.withColumn("__bin", in_bin(F.col("char_pos"), CHAR_BIN)), [*keys, "__bin"]).where("char_pos >= start and char_pos < end")
    return met.groupBy(*keys, "word_idx").agg(F.min_by("start_s", "char_pos").alias("start_s"), F.max_by("end_s", "char_pos").alias("end_s"))
