"""Summaries a document: durations, progress, page chrome, sections and their coverage, work counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.functions.text import STRUCTURAL, finite, fold_digits, half_up, strip
from listenlake.operators.joins import section_of_block

_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)
_AFTER = (1, Window.unboundedFollowing)


def _joined(order: list[str], text: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("__t")))), lambda x: x["__t"]), separator)


def reading_minutes(segs: DataFrame) -> DataFrame:
    """``document_id, minutes``: whole minutes of listening, at least 1."""
    return segs.groupBy("document_id").agg(F.greatest(F.lit(1), half_up(F.sum("est_duration") / 60)).cast("long").alias("minutes"))


def listened_progress(merged: DataFrame, segs: DataFrame) -> DataFrame:
    """``document_id, heard_s, total_s, share``: seconds heard, ranges cut to their passages after merging."""
    length = segs.select("document_id", "segment_id", finite(F.col("est_duration")).alias("d"))
    heard = merged.join(length, ["document_id", "segment_id"]).select("document_id", (F.least("d", "end_s") - F.least("d", "start_s")).alias("s"))
    heard = heard.groupBy("document_id").agg(F.sum("s").alias("heard_s"))
    total = length.groupBy("document_id").agg(F.sum("d").alias("total_s"))
    out = total.join(heard, "document_id", "left").withColumn("heard_s", F.coalesce("heard_s", F.lit(0.0)))
    return out.select("document_id", "heard_s", "total_s", F.coalesce(F.col("heard_s") / F.nullif("total_s", F.lit(0.0)), F.lit(0.0)).alias("share"))


def _with_cached(segs: DataFrame, cached: DataFrame) -> DataFrame:
    have = cached.select("document_id", "segment_id").distinct().withColumn("cached", F.lit(True))
    return segs.join(have, ["document_id", "segment_id"], "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def cached_progress(segs: DataFrame, cached: DataFrame) -> DataFrame:
    """``document_id, share``: the share of a document's seconds that has audio."""
    rows = _with_cached(segs, cached)
    have = F.coalesce(F.sum(F.when(F.col("cached"), F.col("est_duration"))), F.lit(0.0))
    return rows.groupBy("document_id").agg(F.coalesce(have / F.nullif(F.sum("est_duration"), F.lit(0.0)), F.lit(0.0)).alias("share"))


def prepared_gate(segs: DataFrame, cached: DataFrame, least: float = 0.9999) -> DataFrame:
    """``document_id``s that can be heard offline: all audio is there and no passage is ``pending``."""
    share = cached_progress(segs, cached).where(F.col("share") >= least)
    waiting = segs.where("pending").select("document_id").distinct() if "pending" in segs.columns else None
    return share.select("document_id") if waiting is None else share.select("document_id").join(waiting, "document_id", "left_anti")


def page_lines(pages: DataFrame) -> DataFrame:
    """``document_id, page, line_no, line`` of page texts."""
    return pages.select("document_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def page_chrome(pages: DataFrame) -> DataFrame:
    """``document_id, chrome_key, pages_with``: first and last lines, digits aside, on 60% of a document's pages and on three or more.

    Lines of a structure never count; a line counts once a page.
    """
    lines = page_lines(pages).where(F.trim(F.regexp_replace("line", r"\s", " ")) != "")
    edges = lines.groupBy("document_id", "page").agg(F.min_by("line", "line_no").alias("first"), F.max_by("line", "line_no").alias("last"))
    keys = edges.select("document_id", "page", F.explode(F.array_distinct(F.array(fold_digits(F.col("first")), fold_digits(F.col("last"))))).alias("chrome_key"))
    counts = keys.where((F.col("chrome_key") != "") & ~F.col("chrome_key").rlike(STRUCTURAL)).groupBy("document_id", "chrome_key").agg(F.count("*").alias("pages_with"))
    total = pages.groupBy("document_id").agg(F.count("*").alias("n"))
    return counts.join(total, "document_id").where("n >= 3 and pages_with >= greatest(3, ceil(n * 0.6))").select("document_id", "chrome_key", "pages_with")


def strip_page_chrome(pages: DataFrame, chrome: DataFrame) -> DataFrame:
    """``document_id, page, text`` without chrome at the edges: before a page's first or after its last line that is neither
    blank nor chrome."""
    known = chrome.select("document_id", "chrome_key").withColumn("known", F.lit(True))
    lines = page_lines(pages).withColumn("chrome_key", fold_digits(F.col("line"))).join(known, ["document_id", "chrome_key"], "left")
    body = strip(F.col("line"))
    lines = lines.withColumn("is_chrome", F.coalesce("known", F.lit(False)) & (body != "") & ~body.rlike(STRUCTURAL))
    solid = ((body != "") & ~F.col("is_chrome")).cast("int")
    order = Window.partitionBy("document_id", "page").orderBy("line_no")
    edge = (F.coalesce(F.max(solid).over(order.rowsBetween(*_BEFORE)), F.lit(0)) == 0) | (F.coalesce(F.max(solid).over(order.rowsBetween(*_AFTER)), F.lit(0)) == 0)
    lines = lines.withColumn("line", F.when(F.col("is_chrome") & edge, "").otherwise(F.col("line")))
    joined = lines.groupBy("document_id", "page").agg(_joined(["line_no"], F.col("line"), "\n").alias("text"))
    return joined.withColumn("text", F.regexp_replace("text", r"^\n+|\n+$", ""))


def _fully_bold(line: Column) -> Column:
    return line.rlike(r"^\*\*[^*]") & line.rlike(r"[^*]\*\*$") & ~F.contains(F.substring(line, F.lit(3), F.length(line) - 4), F.lit("**"))


def blanket_bold(pages: DataFrame, least: float = 0.6) -> DataFrame:
    """``document_id, page, text``: where most body lines of a document are bold, the bold means nothing and goes."""
    lines = page_lines(pages).withColumn("body", strip(F.col("line")))
    prose = (F.col("body") != "") & ~F.col("body").rlike(STRUCTURAL)
    lines = lines.withColumn("bold", _fully_bold(F.col("body")) & prose)
    share = lines.where(prose).groupBy("document_id").agg(F.avg(F.col("bold").cast("double")).alias("share"))
    lines = lines.join(share, "document_id", "left")
    bare = F.concat(F.regexp_extract("line", r"^(\s*)", 1), F.substring("body", F.lit(3), F.length("body") - 4), F.regexp_extract("line", r"(\s*)$", 1))
    lines = lines.withColumn("line", F.when((F.col("share") >= least) & F.col("bold"), bare).otherwise(F.col("line")))
    return lines.groupBy("document_id", "page").agg(_joined(["line_no"], F.col("line"), "\n").alias("text"))


def repeated_images(images: DataFrame, least: int = 4096, times: int = 3) -> DataFrame:
    """Adds ``repeats`` and ``decoration`` to ``document_id, image_no, content``: small images and those that a document repeats."""
    rows = images.withColumns({"bytes": F.octet_length("content").cast("long"), "hash": F.sha2("content", 256)})
    rows = rows.withColumn("repeats", F.count("*").over(Window.partitionBy("document_id", "hash")))
    return rows.withColumn("decoration", (F.col("repeats") >= times) | (F.col("bytes") < least)).drop("hash", "content")


def outline_level_cap(outline: DataFrame, segs: DataFrame, cap: int = 40) -> DataFrame:
    """``document_id, entry_idx, pos, title, level`` of the outline that a study tree keeps.

    The deepest levels go until the entries, and an opening section if text precedes the first of them, fit; a single level
    that is still too long is cut.
    """
    starts = segs.groupBy("document_id").agg(F.min("block_pos").alias("first_pos"))
    levels = outline.groupBy("document_id", "level").agg(F.count("*").alias("n"), F.min_by("pos", "entry_idx").alias("head"), F.min("entry_idx").alias("head_idx"))
    order = Window.partitionBy("document_id").orderBy("level").rowsBetween(*_UPTO)
    depth = levels.select("document_id", "level", F.row_number().over(Window.partitionBy("document_id").orderBy("level")).alias("depth"), F.sum("n").over(order).alias("entries"), F.min(F.struct("head_idx", "head")).over(order).alias("h"))
    depth = depth.join(starts, "document_id", "left").withColumn("lead", F.coalesce(F.col("first_pos") < F.col("h.head"), F.lit(False)).cast("int"))
    pick = depth.groupBy("document_id").agg(F.max(F.when((F.col("entries") + F.col("lead") <= cap) | (F.col("depth") == 1), F.struct("depth", "level", "lead"))).alias("p"))
    kept = outline.join(pick, "document_id").where("level <= p.level")
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("entry_idx"))
    return kept.withColumn("rn", rank).where(F.col("rn") <= F.greatest(F.lit(1), F.lit(cap) - F.col("p.lead"))).select("document_id", "entry_idx", "pos", "title", "level")


def section_text(segs: DataFrame, bounds: DataFrame, most: int = 7000) -> DataFrame:
    """``document_id, section, title, text, source_hash``: the passages of each section, clamped, and a hash of title and text.

    Passages of a block follow each other after a space, blocks after a newline.  ``bounds``: ``document_id, pos, section, title``;
    text before the first bound has no section.
    """
    places = segs.select("document_id", F.col("block_pos").alias("pos")).distinct()
    owner = section_of_block(places, bounds).withColumnRenamed("pos", "block_pos")
    order = Window.partitionBy("document_id").orderBy("seg_idx")
    rows = segs.withColumn("glue", F.when(F.lag("block_pos").over(order) == F.col("block_pos"), " ").otherwise("\n")).join(owner, ["document_id", "block_pos"]).where("section is not null")
    texts = rows.groupBy("document_id", "section").agg(F.trim(F.regexp_replace(_joined(["seg_idx"], F.concat("glue", "text"), ""), r"^\n", "")).alias("whole"))
    text = F.when(F.length("whole") > most, F.concat(F.left("whole", F.lit(most)), F.lit(" … (section continues)"))).otherwise(F.col("whole"))
    texts = texts.where("whole <> ''").withColumn("text", text).join(bounds.select("document_id", "section", "title").distinct(), ["document_id", "section"])
    return texts.select("document_id", "section", "title", "text", F.sha2(F.concat("title", F.lit("\n"), "text"), 256).alias("source_hash"))


def section_coverage(bounds: DataFrame, segs: DataFrame, heard: DataFrame, touched: DataFrame, least: float = 0.6) -> DataFrame:
    """``document_id, section, heard, discussed``: 60% of a section's passages have been heard; one of its blocks was talked about.

    A passage counts as heard with any range.  ``heard``: ``document_id, segment_id``; ``touched``: ``document_id, block_id``.
    """
    rows = segs.join(heard.select("document_id", "segment_id").distinct().withColumn("h", F.lit(1.0)), ["document_id", "segment_id"], "left")
    rows = rows.join(touched.select("document_id", "block_id").distinct().withColumn("t", F.lit(True)), ["document_id", "block_id"], "left")
    owner = section_of_block(segs.select("document_id", F.col("block_pos").alias("pos")).distinct(), bounds).withColumnRenamed("pos", "block_pos")
    found = rows.join(owner, ["document_id", "block_pos"]).groupBy("document_id", "section").agg((F.avg(F.coalesce("h", F.lit(0.0))) >= least).alias("heard"), F.bool_or(F.coalesce("t", F.lit(False))).alias("discussed"))
    every = bounds.select("document_id", "section").distinct().join(found, ["document_id", "section"], "left")
    return every.select("document_id", "section", F.coalesce("heard", F.lit(False)).alias("heard"), F.coalesce("discussed", F.lit(False)).alias("discussed"))


def coverage_classes(coverage: DataFrame) -> DataFrame:
    """``document_id, class, titles``: a document's section titles by what has been heard and discussed, in order.

    ``coverage``: ``document_id, ord, title, heard, discussed``.
    """
    kind = F.when(F.col("heard") & F.col("discussed"), "heard and discussed").when(F.col("heard"), "heard").when(F.col("discussed"), "discussed").otherwise("untouched")
    return coverage.groupBy("document_id", kind.alias("class")).agg(_joined(["ord"], F.col("title"), "; ").alias("titles"))


def abstract_status(nodes: DataFrame, studies: DataFrame) -> DataFrame:
    """``document_id, notes_hash, needed``: an abstract is due when nothing is pending, there is a note, and the notes have changed.

    ``nodes``: ``document_id, ord, title, summary, status``; ``studies``: ``document_id, abstract_status, abstract_hash``.
    """
    ready = (F.col("status") == "ready") & (F.coalesce("summary", F.lit("")) != "")
    note = F.when(ready, F.concat("title", F.lit("\n"), "summary"))
    found = nodes.groupBy("document_id").agg(F.sha2(_joined(["ord"], note, "\n\n"), 256).alias("notes_hash"), F.bool_or(F.col("status") == "pending").alias("waiting"), F.bool_or(ready).alias("any"))
    same = (F.col("abstract_status") == "ready") & (F.col("abstract_hash") == F.col("notes_hash"))
    return found.join(studies, "document_id", "left").select("document_id", "notes_hash", (~F.col("waiting") & F.col("any") & ~F.coalesce(same, F.lit(False))).alias("needed"))


def queue_totals(entries: DataFrame) -> DataFrame:
    """``document_id, pending, ready, failed, done``: counts by status; what is ready or failed is done."""
    count = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return entries.groupBy("document_id").agg(count("pending").alias("pending"), count("ready").alias("ready"), count("failed").alias("failed"), count("ready", "failed").alias("done"))


def settle_pending(entries: DataFrame, engines: DataFrame) -> DataFrame:
    """Pending entries of documents without an engine become failed.  ``engines``: ``document_id``."""
    able = engines.select("document_id").distinct().withColumn("__able", F.lit(True))
    status = F.when((F.col("status") == "pending") & F.col("__able").isNull(), "failed").otherwise(F.col("status"))
    return entries.join(able, "document_id", "left").withColumn("status", status).drop("__able")


def reset_entries(entries: DataFrame) -> DataFrame:
    """A bulk reset: entries written by hand stay, all others are pending again."""
    return entries.withColumn("status", F.when(F.col("origin") == "manual", F.col("status")).otherwise("pending"))


def page_count(blocks: DataFrame) -> DataFrame:
    """``document_id, pages``: the highest page, null without any."""
    return blocks.groupBy("document_id").agg(F.max("page").alias("pages"))


def block_for_page(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """``document_id, query_id, pos``: the first top-level block at or after a page, which is first brought into range, else the
    last one with a page.  ``queries``: ``document_id, query_id, page``.

    Pages and queries share one window, from the last page to the first, that carries the smallest position met so far.
    """
    paged = blocks.where("page is not null")
    total = paged.groupBy("document_id").agg(F.max("page").alias("pages"))
    top = paged.where("parent_id is null") if "parent_id" in blocks.columns else paged
    firsts = top.groupBy("document_id", "page").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    asked = queries.join(total, "document_id").select("document_id", "query_id", F.greatest(F.lit(1), F.least("pages", half_up(F.col("page")))).cast("long").alias("page"), F.lit(1).alias("is_query"))
    kinds = firsts.schema["first"].dataType
    marks = firsts.select("document_id", F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), F.col("page").cast("long").alias("page"), F.lit(0).alias("is_query"), "first", "last")
    both = marks.unionByName(asked.withColumns({"first": F.lit(None).cast(kinds), "last": F.lit(None).cast(kinds)}))
    later = Window.partitionBy("document_id").orderBy(F.desc("page"), "is_query").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"at": F.min("first").over(later), "end": F.max("last").over(Window.partitionBy("document_id"))})
    return found.where("is_query = 1 and end is not null").select("document_id", "query_id", F.coalesce("at", "end").alias("pos"))


#: Reasons for which a page's own text is of no use (fixed values).
UNREADABLE = ("scanned", "no-text", "garbled")


def ocr_outcome(stats: DataFrame, recognized: DataFrame, native_most: int = 40) -> DataFrame:
    """``document_id, unreadable, recognized, replaced, left_out``: pages that need recognition, and what came of it.

    ``stats``: ``document_id, page, needs_ocr, reasons array<string>, native_chars``; ``recognized``: ``document_id, page, text``.
    Recognized text stands in only for pages with next to no text of their own.
    """
    reasons = F.array(*map(F.lit, UNREADABLE))
    bad = stats.where(F.col("needs_ocr") & F.arrays_overlap("reasons", reasons))
    have = recognized.where(F.trim("text") != "").select("document_id", "page", F.lit(True).alias("got"))
    rows = bad.join(have, ["document_id", "page"], "left")
    got = F.count("got")
    return rows.groupBy("document_id").agg(F.count("*").alias("unreadable"), got.alias("recognized"), F.count(F.when(F.col("got") & (F.col("native_chars") < native_most), 1)).alias("replaced"), (F.count("*") - got).alias("left_out"))


def variant_inventory(variants: DataFrame, *setting: str) -> DataFrame:
    """Audio rows and seconds by document and setting columns."""
    return variants.groupBy("document_id", *setting).agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"))
