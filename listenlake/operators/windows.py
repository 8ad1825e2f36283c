"""Operators over document order: every window is partitioned by document, so all of them can share one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.functions.text import STRUCTURAL, WORD, finite, fold_digits, heading_key, squeeze, strip
from listenlake.operators.predicates import back_matter_heading

_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)


def _in_order(*order: str, keys: tuple[str, ...] = ("document_id",)):
    return Window.partitionBy(*keys).orderBy(*order)


def _joined(order: list[str], text: Column, separator: str) -> Column:
    """An aggregate: ``text`` of a group's rows in order, put together."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("__t")))), lambda x: x["__t"]), separator)


def joined_ranges(ranges: Column, gap: float = 0.2) -> Column:
    """An array of ranges, ``start_s`` before ``end_s``, sorted and joined where at most ``gap`` seconds lie between them."""

    def add(held: Column, x: Column) -> Column:
        last = F.element_at(held, -1)
        longer = F.struct(last["start_s"].alias("start_s"), F.greatest(last["end_s"], x["end_s"]).alias("end_s"))
        touches = (F.size(held) > 0) & (x["start_s"] <= F.try_element_at(held, F.lit(-1))["end_s"] + F.lit(max(0.0, gap)))
        return F.when(touches, F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(longer))).otherwise(F.concat(held, F.array(x)))

    return F.aggregate(F.sort_array(ranges), F.array().cast("array<struct<start_s:double,end_s:double>>"), add)


def merge_ranges(events: DataFrame, gap: float = 0.2) -> DataFrame:
    """Listened ranges of each passage, joined where at most ``gap`` seconds lie between them.

    Inverted ends are swapped, missing or infinite ones are 0, empty ranges go before anything is joined.
    """
    a, b = finite(F.col("start_s")), finite(F.col("end_s"))
    ranges = events.select("document_id", "segment_id", F.least(a, b).alias("start_s"), F.greatest(a, b).alias("end_s")).where("end_s > start_s")
    order = _in_order("start_s", "end_s", keys=("document_id", "segment_id"))
    new = F.col("start_s") > F.max("end_s").over(order.rowsBetween(*_BEFORE)) + max(0.0, gap)
    ranges = ranges.withColumn("new", F.coalesce(new, F.lit(True)).cast("int"))
    ranges = ranges.withColumn("island", F.sum("new").over(order.rowsBetween(*_UPTO)))
    return ranges.groupBy("document_id", "segment_id", "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).select("document_id", "segment_id", "start_s", "end_s")


def timeline(segs: DataFrame) -> DataFrame:
    """Adds ``start_s``, ``left`` and ``width``: where a passage begins, and its place and share of the whole."""
    length = finite(F.col("est_duration"))
    start = F.coalesce(F.sum(length).over(_in_order("seg_idx").rowsBetween(*_BEFORE)), F.lit(0.0))
    total = F.nullif(F.sum(length).over(Window.partitionBy("document_id")), F.lit(0.0))
    return segs.withColumns({"start_s": start, "left": F.coalesce(start / total, F.lit(0.0)), "width": F.coalesce(length / total, F.lit(0.0))})


def structural_pauses(segs: DataFrame) -> DataFrame:
    """Adds ``pause_before`` to ``document_id, seg_idx, block_pos, kind`` (and optional ``figure``): the silence before a block,
    by its kind and that of the block spoken before it; null within a block and at the beginning."""
    order = _in_order("seg_idx")
    previous, block = F.lag("kind").over(order), F.lag("block_pos").over(order)
    figure = F.col("figure") if "figure" in segs.columns else F.lit(False)
    pause = (
        F.when(F.col("kind") == "heading", 0.55)
        .when(previous == "heading", 0.3)
        .when(figure | F.col("kind").isin("table", "math"), 0.3)
        .when(F.col("kind") == "list-item", F.when(previous == "list-item", 0.12).otherwise(0.2))
        .otherwise(0.22)
    )
    return segs.withColumn("pause_before", F.when(previous.isNotNull() & (block != F.col("block_pos")), pause))


def back_matter_role(blocks: DataFrame, extra_titles: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``role``: ``back-matter`` where the latest heading at or before the block opens such a section."""
    marked = back_matter_heading(blocks, extra_titles)
    latest = F.last(F.when(F.col("kind") == "heading", F.col("back_matter")), ignorenulls=True).over(_in_order("pos").rowsBetween(*_UPTO))
    return marked.withColumn("role", F.when(latest, "back-matter")).drop("back_matter")


def back_matter_entry(segs: DataFrame) -> DataFrame:
    """The first passage of each run of back matter and the notice to speak: ``document_id, seg_idx, notice``.

    ``segs`` has ``role`` and ``heading`` (the text of heading passages, else null).
    """
    order = _in_order("seg_idx")
    heading = heading_key(F.coalesce(F.last("heading", ignorenulls=True).over(order.rowsBetween(*_UPTO)), F.lit("")))
    notice = F.concat(F.lit("Skipping the "), F.when(heading == "", "end matter").otherwise(heading), F.lit("."))
    enters = (F.col("role") == "back-matter") & F.coalesce(F.lag("role").over(order) != "back-matter", F.lit(True))
    return segs.withColumns({"notice": notice, "enters": enters}).where("enters").select("document_id", "seg_idx", "notice")


def next_playable(segs: DataFrame, mode: str = "natural") -> DataFrame:
    """Adds ``next_idx``: the first passage from here on that is no back matter; in verbatim mode the passage itself."""
    if mode == "verbatim":
        return segs.withColumn("next_idx", F.col("seg_idx"))
    plain = F.when(F.coalesce(F.col("role"), F.lit("")) != "back-matter", F.col("seg_idx"))
    return segs.withColumn("next_idx", F.first(plain, ignorenulls=True).over(_in_order("seg_idx").rowsBetween(0, Window.unboundedFollowing)))


def clamp_headings(blocks: DataFrame) -> DataFrame:
    """Headings at most one level below the one before: ``document_id, pos, level``.

    The clamped level of the k-th heading is the smallest of ``level - j`` over the headings up to it, plus k.
    """
    heads = blocks.where("kind = 'heading'").withColumn("k", F.row_number().over(_in_order("pos")))
    lowest = F.min(F.greatest(F.lit(1), F.coalesce("level", F.lit(2))) - F.col("k")).over(_in_order("pos").rowsBetween(*_UPTO))
    return heads.select("document_id", "pos", (lowest + F.col("k")).cast("int").alias("level"))


def outline(blocks: DataFrame) -> DataFrame:
    """Headings in order: ``document_id, entry_idx, block_id, title, level``; a missing level is 2."""
    heads = blocks.where("kind = 'heading'")
    return heads.select("document_id", (F.row_number().over(_in_order("pos")) - 1).alias("entry_idx"), "block_id", F.col("text").alias("title"), F.coalesce("level", F.lit(2)).alias("level"))


def page_starts(blocks: DataFrame) -> DataFrame:
    """Top-level blocks that first reach a new page: ``document_id, block_id, page``; pages that go back are ignored."""
    top = blocks.where("parent_id is null") if "parent_id" in blocks.columns else blocks
    seen = F.coalesce(F.max("page").over(_in_order("pos").rowsBetween(*_BEFORE)), F.lit(0))
    return top.withColumn("new", F.col("page") > F.greatest(seen, F.lit(0))).where("new").select("document_id", "block_id", "page")


def page_backfill(segs: DataFrame) -> DataFrame:
    """Adds ``page_at``: the page of the passage or of the nearest earlier one that has a page."""
    return segs.withColumn("page_at", F.last("page", ignorenulls=True).over(_in_order("seg_idx").rowsBetween(*_UPTO)))


def _seam(tail: Column, head: Column) -> Column:
    plain = (tail != "") & (head != "") & ~tail.rlike(STRUCTURAL) & ~head.rlike(STRUCTURAL) & head.rlike(r"^\p{Ll}")
    return F.when(plain & tail.rlike(r"\p{L}-$"), "hyphen").when(plain & ~tail.rlike(r"[.!?:][)”\"']?$"), "space").otherwise("break")


def _edges(text: Column) -> tuple[Column, Column]:
    body = strip(text)
    return F.substring_index(body, "\n", 1), F.substring_index(body, "\n", -1)


def page_seams(pages: DataFrame) -> DataFrame:
    """How each page joins the one before: ``document_id, page, seam``, one of hyphen, space and break; null for the first."""
    head, tail = _edges(F.col("text"))
    before = F.lag(tail).over(_in_order("page"))
    return pages.select("document_id", "page", F.when(before.isNotNull(), _seam(before, head)).alias("seam"))


def assemble_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages put together, and the place of each: ``(document_id, text)`` and ``(document_id, page, start, end)``.

    Words and sentences broken at a page end are mended; blank pages vanish.
    """
    body = strip(F.col("text"))
    rows = pages.select("document_id", "page", body.alias("text")).where("text <> ''")
    head, tail = _edges(F.col("text"))
    order = _in_order("page")
    rows = rows.withColumns({"seam": F.coalesce(_seam(F.lag(tail).over(order), head), F.lit("")), "first": F.row_number().over(order) == 1})
    rows = rows.withColumn("after", F.lead("seam").over(order))
    cut = F.when(F.col("after") == "hyphen", F.regexp_replace("text", r"-\s*$", "")).otherwise(F.col("text"))
    glue = F.when(F.col("first") | (F.col("seam") == "hyphen"), "").when(F.col("seam") == "space", " ").otherwise("\n\n")
    rows = rows.withColumns({"piece": cut, "glue": glue})
    past = F.coalesce(F.sum(F.length("piece") + F.length("glue")).over(order.rowsBetween(*_BEFORE)), F.lit(0)) + F.length("glue")
    rows = rows.withColumn("start", past)
    spans = rows.select("document_id", "page", F.col("start").cast("int").alias("start"), (F.col("start") + F.length("text")).cast("int").alias("end"))
    return rows.groupBy("document_id").agg(_joined(["page"], F.concat("glue", "piece"), "").alias("text")), spans


def rebuild_paragraphs(lines: DataFrame) -> DataFrame:
    """Page lines to paragraphs: ``document_id, page, para, text``.

    A line opens a paragraph if it starts like a sentence and the line before ends one; broken words are mended; no paragraph
    goes across pages.
    """
    keys = ("document_id", "page")
    order = _in_order("line_no", keys=keys)
    rows = lines.withColumn("line", strip(F.col("line"))).where("line <> ''")
    opens = F.col("line").rlike("^[A-Z“\"']") & F.lag("line").over(order).rlike("[.!?][”\"']?$")
    rows = rows.withColumn("para", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(order.rowsBetween(*_UPTO)))
    texts = rows.groupBy(*keys, "para").agg(_joined(["line_no"], F.col("line"), " ").alias("text"))
    return texts.select(*keys, F.col("para").cast("int").alias("para"), F.regexp_replace("text", "- ([a-z])", "$1").alias("text"))


def breadcrumb(blocks: DataFrame, outline: DataFrame, titles: DataFrame, separator: str = " › ", deepest: int = 6) -> DataFrame:
    """``document_id, pos, crumb``: the title and the headings above each block.

    A heading counts until one of its level or above follows.  ``outline`` has ``pos, title, level``; ``titles`` has
    ``document_id, title``.  The path is carried in one pass over each document; headings below ``deepest`` are left out.
    """
    marks = outline.select("document_id", "pos", F.lit(0).alias("is_block"), "level", F.col("title").alias("head"))
    rows = blocks.select("document_id", "pos", F.lit(1).alias("is_block"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("head"))
    union = marks.unionByName(rows)
    order = _in_order("pos", "is_block").rowsBetween(*_UPTO)
    # the latest heading of each level from 1 to the deepest, alive unless a shallower one came after it
    depth = F.coalesce(F.col("level"), F.lit(0))
    latest = {k: F.max(F.when(depth == k, F.struct("pos", "head"))).over(order) for k in range(1, deepest + 1)}
    higher = {k: F.max(F.when((depth > 0) & (depth < k), F.col("pos"))).over(order) for k in range(1, deepest + 1)}
    kept = union.select("document_id", "pos", "is_block", *(latest[k].alias(f"l{k}") for k in latest), *(higher[k].alias(f"h{k}") for k in higher)).where("is_block = 1")
    path = F.array(*(F.when(F.col(f"h{k}").isNull() | (F.col(f"l{k}.pos") > F.col(f"h{k}")), F.col(f"l{k}.head")) for k in range(1, deepest + 1)))
    kept = kept.select("document_id", "pos", F.filter(path, lambda p: p.isNotNull()).alias("path"))
    return kept.join(titles, "document_id").select("document_id", "pos", F.array_join(F.concat(F.array("title"), "path"), separator).alias("crumb"))


def outline_text(outline: DataFrame, most: int = 40) -> DataFrame:
    """``document_id, outline``: indented headings, the rest counted."""
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level") - 1)), F.lit("- "), "title")
    rows = outline.withColumn("rn", F.row_number().over(_in_order("entry_idx")))
    texts = rows.groupBy("document_id").agg(F.count("*").alias("n"), _joined(["entry_idx"], F.when(F.col("rn") <= most, line), "\n").alias("lines"))
    more = F.concat(F.lit("\n(+"), (F.col("n") - most).cast("string"), F.lit(" more sections)"))
    return texts.select("document_id", F.concat("lines", F.when(F.col("n") > most, more).otherwise("")).alias("outline"))


#: Kinds whose text explains what stands beside it (fixed values), and the mark between before and after.
CONTEXT_KINDS = ("paragraph", "heading", "list-item", "quote", "footnote", "definition-term", "definition-description")
SLOT = "⟪the narration speaks here⟫"


def context_window(blocks: DataFrame, constructs: DataFrame, before: int = 260, after: int = 220) -> DataFrame:
    """``document_id, pos, context``: prose before a construct, a slot, and the next prose, cut at a sentence end.

    Prose is told apart first and measured by its running length, so that the window before a block holds as much of it as is
    needed, however many tables or images stand between.  ``constructs`` has ``document_id, pos``.
    """
    prose = F.when(F.col("kind").isin(*CONTEXT_KINDS) & (F.trim("text") != ""), F.col("text"))
    order = _in_order("pos")
    rows = blocks.select("document_id", "pos", prose.alias("prose"))
    rows = rows.withColumn("length", F.sum(F.coalesce(F.length("prose") + 1, F.lit(0))).over(order.rowsBetween(*_UPTO)))
    enough = Window.partitionBy("document_id", F.col("prose").isNull()).orderBy("length").rangeBetween(-before, 0)
    rows = rows.withColumn("tail", F.when(F.col("prose").isNotNull(), F.right(F.array_join(F.collect_list("prose").over(enough), " "), F.lit(before))))
    rows = rows.withColumns({"past": F.last("tail", ignorenulls=True).over(order.rowsBetween(*_BEFORE)), "next": F.first("prose", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))})
    text = F.coalesce("past", F.lit(""))
    follow = squeeze(F.coalesce("next", F.lit("")))
    clipped = F.left(follow, F.lit(after))
    ends = F.array(*(F.length(clipped) - F.locate(e, F.reverse(clipped)) for e in (" .", " !", " ?")))
    at = F.array_max(F.filter(ends, lambda e: e < F.length(clipped)))
    cut = F.when(F.length(follow) <= after, follow).when(at - 1 > after * 0.3, F.left(clipped, at)).otherwise(clipped)
    found = constructs.select("document_id", "pos").join(rows, ["document_id", "pos"]).withColumns({"b": text, "a": cut})
    joined = F.array_join(F.filter(F.array("b", F.lit(SLOT), "a"), lambda x: x != ""), " ")
    return found.select("document_id", "pos", F.when((F.col("b") == "") & (F.col("a") == ""), "").otherwise(joined).alias("context"))


#: Characters of a block in one part of ``explain_context``.
TEXT_BIN = 2048


def explain_context(blocks: DataFrame, selections: DataFrame, before: int = 1200, after: int = 400) -> DataFrame:
    """``document_id, selection_id, before, after``: text up to the first selected block and text behind the last one, cut at
    blanks.  ``selections`` has ``document_id, selection_id, start_pos, end_pos``; those of documents without text give no row.

    Blocks, in parts of bounded length, and both ends of selections travel once, to their document.  Running lengths say where each
    stands in its text, and windows over these lengths hold the parts that an end needs, however long the document or a block is.
    """
    body = F.concat(F.trim("text"), F.lit("\n"))
    rows = blocks.select("document_id", "pos", body.alias("body")).where("body <> '\n'")
    rows = rows.select("document_id", "pos", "body", F.explode(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / TEXT_BIN).cast("int"))).alias("k"))
    none = F.lit(None).cast(selections.schema["selection_id"].dataType).alias("selection_id")
    parts = rows.select("document_id", "pos", F.lit(0).alias("side"), "k", none, F.substring("body", F.col("k") * TEXT_BIN + 1, F.lit(TEXT_BIN)).alias("part"))
    ends = F.array(F.struct(F.col("start_pos").alias("pos"), F.lit(1).alias("side")), F.struct(F.col("end_pos").alias("pos"), F.lit(2).alias("side")))
    marks = selections.select("document_id", F.explode(ends).alias("m"), "selection_id").select("document_id", "m.pos", "m.side", F.lit(0).alias("k"), "selection_id", F.lit(None).cast("string").alias("part"))
    both = parts.unionByName(marks).withColumn("at", F.coalesce(F.sum(F.length("part")).over(_in_order("pos", "side", "k").rowsBetween(*_UPTO)), F.lit(0)))
    both = both.withColumn("n", F.count("part").over(Window.partitionBy("document_id")))
    # a part ends, one past its last character, where ``at`` says; behind an end come parts that begin there or later
    held_by = lambda low, high: F.array_join(F.collect_list("part").over(_in_order("at").rangeBetween(low, high)), "")
    met = both.withColumns({"b": held_by(-before, 0), "a": held_by(1, after + TEXT_BIN + 2)}).where("side > 0 and n > 0")
    # no line feed at either end
    b, a = F.left("b", F.length("b") - 1), F.left("a", F.length("a") - 1)
    b = F.when(F.col("at") - 1 > before, F.regexp_replace(F.right(b, F.lit(before)), r"^\S+\s", "")).otherwise(b)
    a = F.when(F.length("a") - 1 > after, F.regexp_replace(F.left("a", F.lit(after)), r"(?s)(?<=.)\s\S*\z", "")).otherwise(a)
    met = met.select("document_id", "selection_id", F.when(F.col("side") == 1, b).alias("b"), F.when(F.col("side") == 2, a).alias("a"))
    return met.groupBy("document_id", "selection_id").agg(F.max("b").alias("before"), F.max("a").alias("after"))


def pack_to_budget(segs: DataFrame, chars: int) -> DataFrame:
    """``document_id, packed, cut_at``: how many passages fit, in order, and the index of the first that does not (-1: all fit)."""
    total = F.sum(F.length("text")).over(_in_order("seg_idx").rowsBetween(*_UPTO))
    rows = segs.withColumn("over", total > chars)
    return rows.groupBy("document_id").agg(F.sum((~F.col("over")).cast("int")).alias("packed"), F.coalesce(F.min(F.when(F.col("over"), F.col("seg_idx"))), F.lit(-1)).alias("cut_at"))


def passage_range(segs: DataFrame, ranges: DataFrame, most: int = 8000) -> DataFrame:
    """``document_id, range_id, text, truncated``: passages ``first`` to ``last`` with markers, as many as fit."""
    hit = ranges.join(segs.select("document_id", "seg_idx", "block_pos", "text"), "document_id").where("seg_idx between first and last")
    order = Window.partitionBy("document_id", "range_id").orderBy("seg_idx")
    same = F.lag("block_pos").over(order)
    lead = F.when(same.isNull(), "").when(same == F.col("block_pos"), " ").otherwise("\n\n")
    hit = hit.withColumn("piece", F.concat(lead, F.lit("⟦"), F.col("seg_idx").cast("string"), F.lit("⟧ "), squeeze(F.col("text"))))
    hit = hit.withColumn("fits", F.sum(F.length("piece")).over(order.rowsBetween(*_UPTO)) <= most)
    return hit.groupBy("document_id", "range_id").agg(_joined(["seg_idx"], F.when(F.col("fits"), F.col("piece")), "").alias("text"), F.bool_or(~F.col("fits")).alias("truncated"))


#: Numbers of an array that are added up together by ``running_sums``.
RUN = 64


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once, however often and wherever they are used afterwards."""
    made = F.explode(F.array(F.struct(*(value.alias(name) for name, value in columns.items())))).alias("__held")
    return rows.select("*", made).select(*rows.columns, *(F.col("__held").getField(name).alias(name) for name in columns))


def _running(values: Column, base: Column) -> Column:
    add = lambda held, x: F.struct((held["sum"] + x).alias("sum"), F.concat(held["past"], F.array(held["sum"])).alias("past"))
    return F.aggregate(values, F.struct(base.alias("sum"), F.array().cast("array<double>").alias("past")), add, lambda held: held["past"])


def running_sums(values: Column) -> Column:
    """For each place of an array of doubles that is not empty, a column of its own, the sum of what is before it; in runs, so that
    a long array takes little more than its length."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda k: F.slice(values, k * RUN + 1, F.lit(RUN)))
    sums = F.transform(runs, lambda run: F.aggregate(run, F.lit(0.0), lambda a, x: a + x))
    return F.flatten(F.zip_with(runs, _running(sums, F.lit(0.0)), _running))


def estimate_word_timing(passages: DataFrame) -> DataFrame:
    """``document_id, seg_idx, word_idx, word, start_s, end_s``: a passage's duration dealt out to its words by length and by the
    pause that the punctuation behind each stands for.  Times are added up within a passage's row, so nothing is shuffled."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = held(passages.select("document_id", "seg_idx", "est_duration", "text"), word=words, gap=F.split("text", WORD, -1)).where(F.size("word") > 0)
    pause = lambda gap: F.when(gap.rlike("[.!?…]"), 4.0).when(gap.rlike("[;:]"), 2.5).when(gap.rlike(","), 1.5).when(gap.rlike("\n"), 1.0).otherwise(0.0)
    speech = F.transform("word", lambda w: F.greatest(F.lit(1.5), F.length(w) * 0.62))
    rows = held(rows.drop("text"), speech=speech, pause=F.transform(F.slice("gap", F.lit(2), F.size("word")), pause)).drop("gap")
    rows = held(rows, took=F.zip_with("speech", "pause", lambda s, p: s + p)).drop("pause")
    rows = held(rows, past=running_sums(F.col("took")))
    scale = F.col("est_duration") / (F.element_at("past", -1) + F.element_at("took", -1))
    rows = held(rows.select("document_id", "seg_idx", scale.alias("scale"), "word", "speech", "past"), w=F.arrays_zip("word", "speech", "past"))
    each = rows.select("document_id", "seg_idx", "scale", F.posexplode("w").alias("word_idx", "w"))
    return each.select("document_id", "seg_idx", "word_idx", F.col("w.word").alias("word"), (F.col("w.past") * F.col("scale")).alias("start_s"), ((F.col("w.past") + F.col("w.speech")) * F.col("scale")).alias("end_s"))


def word_timing_in_passages(passages: DataFrame) -> DataFrame:
    """What ``joins.word_timing_from_chars`` gives, where the times of a passage's characters come with its words: nothing is shuffled.

    ``passages``: ``document_id, seg_idx, words array<struct<word_idx, start, end>>, starts, ends``; the last two are arrays of
    seconds by the place of a character, null where it has none.
    """
    known = lambda times, w: F.filter(F.slice(times, w["start"] + 1, F.greatest(F.lit(0), w["end"] - w["start"])), lambda t: t.isNotNull())
    first = lambda w: F.coalesce(F.get("starts", w["start"]), F.get(known("starts", w), F.lit(0)))
    last = lambda w: F.coalesce(F.get("ends", w["end"] - 1), F.try_element_at(known("ends", w), F.lit(-1)))
    timed = F.transform(F.filter("words", lambda w: w["start"] < w["end"]), lambda w: F.struct(w["word_idx"].alias("word_idx"), first(w).alias("start_s"), last(w).alias("end_s")))
    rows = held(passages.select("document_id", "seg_idx", "words", "starts", "ends"), timed=timed)
    return rows.select("document_id", "seg_idx", F.explode("timed").alias("w")).select("document_id", "seg_idx", "w.*").where("start_s is not null or end_s is not null")


def image_budget(images: DataFrame, least: int = 4096, each: int = 2_000_000, total: int = 25_000_000) -> DataFrame:
    """Adds ``kept`` and ``skipped`` to ``document_id, image_no, bytes, repeats``: in order, while the total allows.

    Small and repeated images vanish; one that is too large is skipped and uses up nothing, so what follows depends on every
    choice before it: a fold over a document's images in order, which carries what is left.
    """
    rows = images.select("document_id", "image_no", "bytes", "repeats")
    plain = lambda x: (x["bytes"] >= least) & (x["repeats"] < 3)
    order = F.sort_array(F.collect_list(F.struct("image_no", "bytes", "repeats")))

    def step(held: Column, x: Column) -> Column:
        fits = F.coalesce(plain(x) & (x["bytes"] <= each) & (x["bytes"] <= held["left"]), F.lit(False))
        left = F.when(fits, held["left"] - x["bytes"]).otherwise(held["left"])
        return F.struct(left.alias("left"), F.concat(held["kept"], F.array(fits)).alias("kept"))

    folded = F.aggregate(F.col("images"), F.struct(F.lit(total).cast("long").alias("left"), F.array().cast("array<boolean>").alias("kept")), step)["kept"]
    found = rows.groupBy("document_id").agg(order.alias("images")).select("document_id", F.explode(F.arrays_zip("images", folded.alias("kept"))).alias("x"))
    image = F.col("x.images")
    return found.select("document_id", image["image_no"].cast("int").alias("image_no"), image["bytes"].cast("long").alias("bytes"), image["repeats"].cast("long").alias("repeats"), F.col("x.kept").alias("kept"), (F.coalesce(plain(image), F.lit(False)) & ~F.col("x.kept")).alias("skipped"))


def dedup_exact(docs: DataFrame, id_column: str = "document_id", text: str = "text") -> DataFrame:
    """``document_id, fingerprint, first_id, copy``: the first document of each content stays, later ones are its copies."""
    rows = docs.select(F.col(id_column).alias("document_id"), F.sha2(F.col(text), 256).alias("fingerprint"))
    firsts = rows.groupBy("fingerprint").agg(F.min("document_id").alias("first_id"))  # a partial minimum: hot contents are no hot tasks
    return rows.join(firsts, "fingerprint").select("document_id", "fingerprint", "first_id", (F.col("document_id") != F.col("first_id")).alias("copy"))


def web_key(url: Column) -> Column:
    """The identity of a page: host in lower case, path without closing slashes, query; the fragment does not count."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.concat(F.lit("web:"), host, path, F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1))


def dedup_web(pages: DataFrame, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, web_key, first_id, copy``: pages with one address but for the fragment are one."""
    rows = pages.select(id_column, web_key(F.col(url)).alias("web_key"))
    firsts = rows.groupBy("web_key").agg(F.min(id_column).alias("first_id"))
    return rows.join(firsts, "web_key").select(id_column, "web_key", "first_id", (F.col(id_column) != F.col("first_id")).alias("copy"))
