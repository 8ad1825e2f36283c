"""Generators: documents to blocks, blocks to passages, passages to words, pages to articles and links."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlake.functions.text import LINK, SENTENCE, WORD, squeeze, strip, words_in

#: Characters that a passage should not exceed (a fixed value).
PASSAGE_CHARS = 280


def explode_blocks(docs: DataFrame, id_column: str = "document_id", text: str = "text") -> DataFrame:
    """Plain text to paragraphs: cut at blank lines, inner newlines to spaces, numbered ``b0, b1, ...``."""
    body = F.regexp_replace(F.col(text), r"^\x{FEFF}", "")
    parts = F.transform(F.split(body, r"\n\s*\n"), lambda p: strip(F.regexp_replace(p, r"\s*\n\s*", " ")))
    rows = docs.select(F.col(id_column).alias("document_id"), F.posexplode(F.filter(parts, lambda p: p != "")).alias("pos", "text"))
    return rows.select("document_id", "pos", F.concat(F.lit("b"), F.col("pos").cast("string")).alias("block_id"), F.lit("paragraph").alias("kind"), "text")


def line_inventory(docs: DataFrame, id_column: str = "document_id", text: str = "text") -> DataFrame:
    """The class of every line: what a Markdown document is made of.  Lines within a code fence are ``code``."""
    lines = docs.select(F.col(id_column).alias("document_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    fence = F.col("line").rlike(r"^\s{0,3}(?:```|~~~)")
    before = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1
    line = F.col("line")
    kind = (
        F.when(fence, "fence")
        .when(inside, "code")
        .when(line.rlike(r"^\s*$"), "blank")
        .when(line.rlike(r"^\s{0,3}#{1,6}\s+\S"), "heading")
        .when(line.rlike(r"^\s{0,3}(?:-{3,}|\*{3,}|_{3,})\s*$"), "rule")
        .when(line.rlike(r"^\s*(?:[-+*]|\d+[.)])\s+\S"), "list")
        .when(line.rlike(r"^\s{0,3}>"), "quote")
        .when(line.rlike(r"^\s*\|.*\|\s*$"), "table")
        .otherwise("prose")
    )
    return lines.select("document_id", "line_no", kind.alias("class"), F.length("line").alias("n_chars"))


def sentences(blocks: DataFrame) -> DataFrame:
    """Passages: paragraphs cut after final punctuation, headings and list items whole.

    The rule knows no abbreviations, so ``Fig. 2`` is cut.  Returns ``document_id, seg_idx, segment_id, block_id, block_pos, text,
    start``; ``start`` is the passage's place in the block, in code points.
    """
    pieces = F.when(F.col("kind") == "paragraph", F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).otherwise(F.array("text"))
    # each piece with the length of those before it; what lies between pieces is punctuation at the very beginning
    lead = F.length("text") - F.aggregate(pieces, F.lit(0), lambda a, x: a + F.length(x))
    rows = blocks.select("document_id", "block_id", "pos", lead.alias("lead"), pieces.alias("pieces")).select("*", F.posexplode("pieces").alias("p", "piece"))
    before = F.aggregate(F.slice("pieces", F.lit(1), F.col("p")), F.lit(0), lambda a, x: a + F.length(x))
    indent = F.length("piece") - F.length(F.ltrim("piece"))
    rows = rows.where(F.trim("piece") != "").withColumn("start", F.col("lead") + before + indent)
    order = Window.partitionBy("document_id").orderBy("pos", "p")
    return rows.select(
        "document_id",
        (F.row_number().over(order) - 1).alias("seg_idx"),
        F.concat("block_id", F.lit(":s"), F.col("p").cast("string")).alias("segment_id"),
        "block_id",
        F.col("pos").alias("block_pos"),
        F.trim("piece").alias("text"),
        "start",
    )


#: Where a long passage may be cut, and the share of the budget that a piece must fill to end there (fixed values).
_PAUSE, FILLED = regex.compile(r"[;,] | — "), 0.55


def piece_starts(text: str, most: int, spans: list[tuple[int, int]]) -> list[int]:
    """Where the pieces of a long passage begin.

    All pauses outside protected spans are listed once, by the place where they end; a piece is cut behind the first character of the
    last one that ends within its budget, if that fills enough of it.  Else it is cut at its budget, or at the edge of the span there.
    """
    pauses = [(m.end(), m.start() + 1) for m in _PAUSE.finditer(text, overlapped=True) if not any(a <= m.start() < b - 1 for a, b in spans)]
    starts = [0]
    while starts[-1] + most < len(text):
        begin = starts[-1]
        budget = begin + most
        last = bisect_right(pauses, (budget, len(text))) - 1
        cut = pauses[last][1] if last >= 0 else 0
        if cut - begin - 1 <= FILLED * most:
            around = [span for span in spans if span[0] < budget < span[1]][:1]
            cut = next((a if a > begin else b for a, b in around), budget)
        starts.append(min(cut, len(text)))
    return [at for at in starts if at < len(text)]


@F.udtf(returnType="part int, text string, start int")
class SplitLong:
    """Pieces of one long passage, none of which begins inside a protected span."""

    def eval(self, text: str, most: int, spans: list):
        starts = piece_starts(text, most, [(s["start"], s["end"]) for s in spans or ()])
        for part, (begin, end) in enumerate(zip(starts, [*starts[1:], len(text)])):
            yield part, text[begin:end], begin


def split_long(passages: DataFrame, most: int = PASSAGE_CHARS) -> DataFrame:
    """``passages`` (``document_id, seg_idx, text`` and optional ``spans array<struct<start,end>>``) with long ones cut.

    Only passages over ``most`` characters go through Python.  Adds ``part`` and ``start``.
    """
    if "spans" not in passages.columns:
        passages = passages.withColumn("spans", F.array().cast("array<struct<start:int,end:int>>"))
    short = passages.where(F.length("text") <= most).withColumns({"part": F.lit(0), "piece": F.col("text"), "start": F.lit(0)})
    long = passages.where(F.length("text") > most)
    cut = long.lateralJoin(SplitLong(F.col("text").outer(), F.lit(most), F.col("spans").outer()).select("part", F.col("text").alias("piece"), "start"))
    columns = [c for c in passages.columns if c not in ("text", "spans")]
    return short.unionByName(cut).select(*columns, "part", F.col("piece").alias("text"), "start")


def merge_around_spans(parts: DataFrame, spans: DataFrame) -> DataFrame:
    """Passages whose cut falls inside a construct are put together again, or the cut moves behind a reference.

    ``parts``: ``document_id, block_pos, part, text, start`` of contiguous pieces; ``spans``: ``document_id, block_pos, start, end,
    mode`` (``merge`` or ``shift``).  Within a ``shift`` span, and the ones directly after it, text goes to the piece before.
    """
    key = ["document_id", "block_pos"]
    order = Window.partitionBy(*key).orderBy("start")
    flow = Window.partitionBy(*key, "run").orderBy("start")
    shifts = spans.where("mode = 'shift'")
    # clusters of shift spans that touch act as one
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = shifts.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int")).withColumn("run", F.sum("new").over(Window.partitionBy(*key).orderBy("start", "end")))
    runs = runs.groupBy(*key, "run").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.sort_array(F.collect_list("end")).alias("ends"), F.sort_array(F.collect_list("start")).alias("starts"))
    cuts = parts.withColumn("stop", F.col("start") + F.length("text"))
    moved = cuts.join(runs, key, "left").withColumn("inside", F.exists(F.arrays_zip("starts", "ends"), lambda x: (x["starts"] < F.col("start")) & (F.col("start") < x["ends"])))
    moved = moved.groupBy(*key, "part", "text", "start", "stop").agg(F.max(F.when(F.col("inside"), F.col("e"))).alias("to"))
    merges = spans.where("mode = 'merge'").select(*key, F.col("start").alias("ms"), F.col("end").alias("me"))
    hit = moved.join(merges, key, "left").groupBy(*key, "part", "text", "start", "stop", "to").agg(F.max(F.coalesce((F.col("ms") < F.col("start")) & (F.col("start") < F.col("me")), F.lit(False))).alias("glue"))
    first = F.row_number().over(order) == 1
    # where each piece begins now; null: it belongs to the piece before
    begin = F.when(first, F.col("start")).when(F.col("to").isNotNull(), F.when(F.col("to") < F.col("stop"), F.col("to"))).when(~F.col("glue"), F.col("start"))
    begun = hit.withColumn("begin", begin)
    whole = begun.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("whole"), F.min("start").alias("origin"), F.max("stop").alias("last"))
    kept = begun.where("begin is not null").join(whole, key)
    end = F.coalesce(F.lead("begin").over(order), F.col("last"))
    return kept.withColumn("end", end).select(*key, (F.row_number().over(order) - 1).alias("part"), F.substring("whole", F.col("begin") - F.col("origin") + 1, F.col("end") - F.col("begin")).alias("text"), F.col("begin").alias("start"))


_WORD = regex.compile(WORD)


def _words(text: str | None) -> list[dict]:
    return [{"text": m[0], "start": m.start(), "end": m.end()} for m in _WORD.finditer(text or "")]


_WORDS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_WORDS)
def word_spans(text: pd.Series) -> pd.Series:
    """Words with their places, in code points."""
    return text.map(_words)


def explode_words(passages: DataFrame, offsets: bool = False) -> DataFrame:
    """One row a word, ``document_id, seg_idx, word_idx, word``; with ``offsets`` also ``start`` and ``end``, which need Python."""
    keys = [c for c in ("document_id", "seg_idx") if c in passages.columns]
    if not offsets:
        return passages.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word_idx", "word"))
    found = passages.select(*keys, F.posexplode(word_spans(F.col("text"))).alias("word_idx", "w"))
    return found.select(*keys, "word_idx", F.col("w.text").alias("word"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))


@dataclass(frozen=True)
class Rule:
    """A rewrite for speech: every match of ``pattern`` is read as ``spoken(match)``; None declines a match.

    Every text with a match holds one of ``needs``, in lower case; other texts are not searched.  Without it all are.
    """

    name: str
    pattern: str
    spoken: Callable[[regex.Match], str | None]
    needs: tuple[str, ...] = ("",)


def _said(text: str) -> Callable[[regex.Match], str]:
    return lambda match: text


def _link(match: regex.Match) -> str:
    tail = regex.search(r"[.,;:!?'\"\]]+$", match[0])
    return "a link in the document" + (tail[0] if tail else "")


_AUTHOR_YEAR = regex.compile(r"^\((?:see\s+)?\p{Lu}[^()]*(?:,\s*|\bet al\.?\s+)(?:19|20)\d{2}[a-z]?")
_SEE = regex.compile(r"(?i)^\((?:see|cf\.?)\s+[^()]*\d")
_POINTER = regex.compile(r"(?i)^\((?:fig(?:ure|s)?|tables?|tab|eqs?|equations?|sec(?:tion|s)?|appendix|appendices|chapters?|ch)\.?\s*[\dA-Za-z]+(?:\s*[–-]\s*[\dA-Za-z]+)?\)$")

#: Abbreviations, how they are read, and what texts with one hold, in order of priority (fixed values).  ``needs`` are letters that have
#: no other forms in upper case than their own, unlike i, k and s.
ABBREVIATIONS = (
    (r"(?i)\bet al\.?(?![\p{L}\p{N}])", "and colleagues", ("et al",)),
    (r"(?i)\be\.g\.,?", "for example,", ("e.g.",)),
    (r"(?i)\bi\.e\.,?", "that is,", (".e.",)),
    (r"(?i)\betc(?=\.)", "and so on", ("etc",)),
    (r"(?i)\bcf\.", "compare", ("cf.",)),
    (r"(?i)\bvs\.?(?![\p{L}\p{N}])", "versus", ("vs", "vſ")),
    (r"(?i)\bapprox\.", "approximately", ("approx.",)),
    (r"\bFig\.", "Figure", ("fig.",)),
    (r"\bFigs\.", "Figures", ("figs.",)),
    (r"\bEq\.", "Equation", ("eq.",)),
    (r"\bEqs\.", "Equations", ("eqs.",)),
    (r"\bRef\.", "Reference", ("ref.",)),
    (r"\bRefs\.", "References", ("refs.",)),
    (r"\bSec\.", "Section", ("sec.",)),
    (r"\bCh\.", "Chapter", ("ch.",)),
    (r"§\s*", "Section ", ("§",)),
    (r"(?i)\bpp?\.\s*(?=\d)", "page ", ("p.",)),
    (r"(?<![.:!?]\s)\bNo\.\s*(?=\d)", "number ", ("no.",)),
    (r"\bChap\.", "Chapter", ("chap.",)),
)

_CITATION = Rule("citation", r"\[\s*\d+(?:\s*[–—,;-]\s*\d+)*\s*\]", _said(""), ("[",))
_RANGE = r"(?<![\d.])(\d{1,3})(?:-|\s*[–—]\s*)(?=\d{1,3}(?![\d])(?!\.\d))"

VERBATIM = (Rule("link", LINK, _link, ("/", "www.")),)
NATURAL = (
    *VERBATIM,
    _CITATION,
    Rule("author-year", r"\([^()]*\)", lambda m: "" if _AUTHOR_YEAR.search(m[0]) else None, ("(",)),
    *(Rule(f"abbreviation-{i}", pattern, _said(spoken), needs) for i, (pattern, spoken, needs) in enumerate(ABBREVIATIONS)),
    Rule("range", _RANGE, lambda m: f"{m[1]} to ", ("-", "–", "—")),
    Rule("percent", r"(\d{1,15}(?:\.\d{1,15})?)\s*%", lambda m: f"{m[1]} percent", ("%",)),
    Rule("plus-minus", r"±\s*", _said("plus or minus "), ("±",)),
    Rule("about", r"~\s*(?=\d)", _said("approximately "), ("~",)),
)
FOCUSED = (Rule("pointer", r"\([^()]*\)", lambda m: "" if _SEE.search(m[0]) or _POINTER.search(m[0]) else None, ("(",)), *NATURAL)
MODES = {"verbatim": VERBATIM, "natural": NATURAL, "focused": FOCUSED}


#: Blanks in front of punctuation that ends a word.
_LOOSE = regex.compile(r"\s+(?=[.,;:!?](?:\s|$))")


@lru_cache(maxsize=256)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def speak(text: str, rules: list[tuple[regex.Pattern, Rule]]) -> dict:
    """The spoken form of one passage and, for each spoken word, the place on the page that it stands for."""
    first: dict[int, tuple[int, str]] = {}  # the first rule that matches at a place decides there
    lower = text.lower()
    for pattern, rule in rules:
        if not any(need in lower for need in rule.needs):
            continue
        for match in pattern.finditer(text):
            if match.start() not in first and (said := rule.spoken(match)) is not None:
                first[match.start()] = (match.end(), said)
    if not first:
        return {"spoken": " ".join(text.split()), "spans": _words(text)}
    ends = accumulate(sorted(first), lambda end, start: end if start < end else first[start][0], initial=0)
    taken = [start for start, end in zip(sorted(first), ends) if start >= end]
    # the page as stretches in order, each with what is said for it; None: the page itself
    edges = [0, *(edge for start in taken for edge in (start, first[start][0])), len(text)]
    said_for = [None if i % 2 == 0 else first[a][1] for i, a in enumerate(edges[:-1])]
    spans = []
    for a, b, said in zip(edges, edges[1:], said_for):
        spans += [{"text": w["text"], "start": a + w["start"], "end": a + w["end"]} if said is None else {"text": w["text"], "start": a, "end": b} for w in _words(text[a:b] if said is None else said)]
    spoken = " ".join("".join(text[a:b] if said is None else f" {said} " for a, b, said in zip(edges, edges[1:], said_for)).split())
    return {"spoken": _LOOSE.sub("", spoken) if taken else spoken, "spans": spans}


def spoken_text(passages: DataFrame, mode: str = "natural", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Adds ``spoken_text`` and ``spans``: rules match the original text, the earliest match wins, then the earlier rule.

    Rules overlap and are resolved by place, which no chain of replacements expresses, so this runs in Arrow batches.
    """
    chosen = rules if rules is not None else MODES[mode]
    result = T.StructType([T.StructField("spoken", T.StringType()), T.StructField("spans", _WORDS)])

    @F.arrow_udf(result)
    def rewrite(text: pa.Array) -> pa.Array:
        compiled = [(_compiled(rule.pattern), rule) for rule in chosen]
        said = [speak(t or "", compiled) for t in text.to_pylist()]
        words = [w for s in said for w in s["spans"]]
        columns = [pa.array([w[name] for w in words], kind) for name, kind in (("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()))]
        ends = pa.array(accumulate((len(s["spans"]) for s in said), initial=0), pa.int32())
        spans = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, ["text", "start", "end"]))
        return pa.StructArray.from_arrays([pa.array([s["spoken"] for s in said], pa.string()), spans], ["spoken", "spans"])

    rewritten = passages.withColumn("__said", rewrite(F.col("text")))
    return rewritten.withColumns({"spoken_text": F.col("__said.spoken"), "spans": F.col("__said.spans")}).drop("__said")


#: Patterns whose hits are tallied over a corpus (fixed values).
TALLIED = {
    "link": r"https?://[^\s<>()]+",
    "citation": r"\[\s*\d+(?:\s*[,;-]\s*\d+)*\s*\]",
    "abbreviation": r"\b(?:et al|Fig|Figs|Eq|Eqs|Ref|Refs|Sec|Ch|Chap)\.",
    "range": r"\b\d{1,3}-\d{1,3}\b",
    "percent": r"\d%",
}


def spoken_rule_tally(docs: DataFrame, id_column: str = "document_id", text: str = "text") -> DataFrame:
    """How often each sort of rewrite applies in each document: ``document_id, rule, hits``, only where it does."""
    counted = docs.select(F.col(id_column).alias("document_id"), *(F.regexp_count(text, F.lit(p)).alias(n) for n, p in TALLIED.items()))
    stacked = counted.select("document_id", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("hits")) for n in TALLIED))).alias("r"))
    return stacked.select("document_id", "r.rule", "r.hits").where("hits > 0")


def duration(spoken: Column, shown: Column) -> Column:
    """Seconds that a passage takes: its spoken words, and pauses at the punctuation that is shown."""
    short, long = (F.regexp_count(shown, F.lit(marks)) * hundredths / 100 for marks, hundredths in (("[,;:]", 12), ("[.!?]", 24)))
    return F.greatest(F.lit(0.7), F.greatest(words_in(spoken), F.lit(1)) / 2.65 + short + long)  # in this order: SQL ends a passage at the same bit


def estimate_duration(passages: DataFrame) -> DataFrame:
    """Adds ``est_duration``, by the ``spoken_text`` if there is one, else by the text."""
    spoken = F.col("spoken_text" if "spoken_text" in passages.columns else "text")
    return passages.withColumn("est_duration", duration(spoken, F.col("text")))


def link_inventory(docs: DataFrame, id_column: str = "document_id", text: str = "text") -> DataFrame:
    """Every link: ``document_id, link_no, url, host, safe``; trailing punctuation is cut, ``www.`` is no part of the host."""
    pattern = r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^\s<>()\"']+|mailto:[^\s<>()\"']+|www\.[^\s<>()\"']+"
    links = docs.select(F.col(id_column).alias("document_id"), F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("link_no", "raw"))
    url = F.regexp_replace("raw", r"[.,;:!?'\"\]]+$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^www\.", "")
    host = F.when(F.col("raw").startswith("www."), F.regexp_replace(F.lower(F.regexp_extract(url, r"^([^/?#]*)", 1)), r"^www\.", "")).otherwise(host)
    return links.select("document_id", "link_no", url.alias("url"), host.alias("host"), F.lower(url).rlike(r"^(https?:|mailto:|www\.|//)").alias("safe"))


def article_text(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """Title and visible text of web pages: ``page_id, title, text``.

    Scripts, styles and navigation go with their content, empty superscripts go, block ends become newlines, other tags go,
    the common entities are read, and runs of blanks and of empty lines collapse.
    """
    body = F.col(html)
    title = F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for tag in ("head", "script", "style", "nav", "header", "footer", "aside", "noscript"):
        body = F.regexp_replace(body, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", " ")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?i)<sup>\s*</sup>", "")
    body = F.regexp_replace(body, r"(?i)<br[^>]*>|</(?:p|div|li|h[1-6]|tr|section|article|blockquote)>", "\n")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body, title = F.replace(body, F.lit(entity), F.lit(char)), F.replace(title, F.lit(entity), F.lit(char))
    body = F.regexp_replace(F.regexp_replace(body, r"[ \t\r]+", " "), r" ?\n ?", "\n")
    body = F.regexp_replace(F.regexp_replace(body, r"\n{4,}", "\n\n\n"), r"^\s+|\s+$", "")
    return pages.select(id_column, F.regexp_replace(F.regexp_replace(title, r"\s+", " "), r"^ | $", "").alias("title"), body.alias("text"))


def compose_article(articles: DataFrame) -> DataFrame:
    """``title, author, site, published, url, text`` to ``markdown``: a heading unless the text has it, a byline, the text."""
    title, author = squeeze(F.coalesce("title", F.lit(""))), squeeze(F.coalesce("author", F.lit("")))
    first = F.regexp_extract(F.col("text"), r"^\s*([^\n]*)", 1)
    heading = F.lower(squeeze(F.regexp_replace(F.regexp_extract(strip(first), r"^#{1,6}\s+(.*)$", 1), r"[*_`]", "")))
    titled = (heading != "") & (F.lower(title).startswith(heading) | heading.startswith(F.lower(title)))
    site = squeeze(F.coalesce("site", F.lit("")))
    host = F.regexp_replace(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")), r"^www\.", "")
    site = F.when((site == "") | (F.lower(site) == F.lower(author)), host).otherwise(site)
    day = F.date_format(F.try_to_timestamp("published"), "MMMM d, yyyy")
    parts = F.array(F.when(author != "", F.concat(F.lit("By "), author)), F.when((site != "") & (F.lower(site) != F.lower(author)), site), day)
    byline = F.array_join(F.filter(parts, lambda p: p.isNotNull()), " · ")
    lines = F.array(F.when((title != "") & ~titled, F.concat(F.lit("# "), title)), F.when(byline != "", F.concat(F.lit("*"), byline, F.lit("*"))), strip(F.col("text")))
    return articles.withColumn("markdown", F.array_join(F.filter(lines, lambda p: p.isNotNull()), "\n\n"))


def clean_page_text(pages: DataFrame) -> DataFrame:
    """``document_id, page, text``: lone text fences unwrapped, letter-spaced headings outside fences joined."""
    unwrapped = F.regexp_replace(F.regexp_replace("text", r"(?m)^```text\n([\s\S]*?)\n?```$", "$1"), r"^\n+|\n+$", "")
    rows = pages.select("document_id", "page", F.posexplode(F.split(unwrapped, "\n", -1)).alias("line_no", "line"))
    fence = F.col("line").rlike(r"^\s*```")
    upto = Window.partitionBy("document_id", "page").orderBy("line_no")
    fenced = fence | (F.sum(fence.cast("int")).over(upto) % 2 == 1)
    body = F.regexp_extract("line", r"^\s*(?:#{1,6}\s+)?(.+?)\s*$", 1)
    lead = F.regexp_extract("line", r"^(\s*(?:#{1,6}\s+)?).+?\s*$", 1)
    spaced = body.rlike(r"^[\p{Lu}\p{N}](?: [\p{Lu}\p{N}])+(?:\s{2,}[\p{Lu}\p{N}](?: [\p{Lu}\p{N}])+)*$") & body.rlike(r"\p{Lu}") & (F.length(F.regexp_replace(body, r"\s", "")) >= 4)
    joined = F.array_join(F.transform(F.split(body, r"\s{2,}"), lambda w: F.replace(w, F.lit(" "), F.lit(""))), " ")
    line = F.when(~fenced & spaced, F.concat(lead, joined)).otherwise(F.col("line"))
    rows = rows.withColumn("line", line)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return rows.groupBy("document_id", "page").agg(F.array_join(lines, "\n").alias("text"))


def construct_inventory(blocks: DataFrame) -> DataFrame:
    """One row for each equation, diagram, code block, table row and captioned image: ``document_id, pos, construct_id, kind, source``.

    ``blocks`` has ``table_rows array<array<string>>`` and ``inlines array<struct<text, math boolean, image struct<alt,src>>>``.
    Rows of a table are ``b2:r0, ...``, the images of a paragraph ``b3:img0, ...``, its equations ``b3:m0, ...``.
    """
    kinds = F.when(F.col("kind") == "math", "math-block").when((F.col("kind") == "mermaid") | ((F.col("kind") == "code") & (F.col("code_language") == "mermaid")), "mermaid").when(F.col("kind") == "code", "code-block")
    whole = blocks.withColumn("what", kinds).where("what is not null").select("document_id", "pos", F.lit(-1).alias("at"), F.col("block_id").alias("construct_id"), F.col("what").alias("kind"), F.col("text").alias("source"))
    rows = blocks.where("kind = 'table'").select("document_id", "pos", "block_id", F.posexplode("table_rows").alias("at", "cells"))
    rows = rows.select("document_id", "pos", "at", F.concat("block_id", F.lit(":r"), F.col("at").cast("string")).alias("construct_id"), F.lit("table-row").alias("kind"), F.array_join("cells", ", ").alias("source"))
    runs = blocks.where("kind in ('paragraph', 'list-item')").select("document_id", "pos", "block_id", F.posexplode("inlines").alias("at", "run"))
    order = Window.partitionBy("document_id", "block_id", "what").orderBy("at")
    runs = runs.withColumn("what", F.when(F.col("run.math"), "m").when(F.coalesce(F.trim(F.col("run.image.alt")), F.lit("")) != "", "img")).where("what is not null")
    runs = runs.withColumn("k", F.row_number().over(order) - 1)
    runs = runs.select("document_id", "pos", "at", F.concat("block_id", F.lit(":"), "what", F.col("k").cast("string")).alias("construct_id"), F.when(F.col("what") == "m", "math-inline").otherwise("image").alias("kind"), F.when(F.col("what") == "m", F.col("run.text")).otherwise(F.col("run.image.alt")).alias("source"))
    return whole.unionByName(rows).unionByName(runs)
