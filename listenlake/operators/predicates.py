"""Row-local tests and projections over documents, blocks and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.functions.text import BACK_MATTER_TITLES, SILENT_KINDS, heading_key, strip

#: Any of these makes a plain text worth reading as Markdown (fixed values).
MARKDOWN_SIGNS = (
    r"^\s*---\s*\n[\s\S]+?\n---\s*(?:\n|$)",
    r"(?m)^\s{0,3}#{1,6}\s+\S",
    r"(?m)^\s{0,3}(?:`{3,}|~{3,})(?:\w+)?\s*$",
    r"(?im)^\s{0,3}>\s*\[!(?:NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]",
    r"(?m)^\s{0,3}>\s+\S",
    r"(?m)^\s{0,3}(?:[-+*]|\d+[.)])\s+\S",
    r"(?m)^\s*\|?.+\|.+\n\s*\|?\s*:?-{3,}",
    r"(?m)^\s*(?:\$\$|```math|\\\[)\s*$",
    r"!\[[^\]]*\]\([^\s)]+(?:\s+['\"][^'\"]*['\"])?\)",
    r"\[[^\]]+\]\([^\s)]+(?:\s+['\"][^'\"]*['\"])?\)",
    r"(?m)^\s{0,3}(?:-{3,}|\*{3,}|_{3,})\s*$",
)

#: Citation tokens that chat exports leave behind, in the order in which they are removed (fixed values).
CITATION_ARTIFACTS = (
    r" ?\x{E200}[^\x{E200}\x{E201}\x{E203}\x{E204}]{0,120}\x{E201}",
    r" ?\x{E203}[^\x{E200}\x{E201}\x{E203}\x{E204}]{0,120}\x{E204}",
    r" ?\b(?:file|news|image|video|forecast)?cite\w{0,20}?turn\d+\w+",
    r" ?\bturn\d+(?:file|search|news|image|video|fetch|forecast|sports|finance)\d+\b",
    r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]",
)

#: Languages not written in Latin script, and connectives of which an English text has two (fixed values).
NON_LATIN_LANGUAGES = ("ru", "bg", "uk", "sr", "el", "he", "ar", "fa", "hi", "zh", "ja", "ko", "th")
NON_LATIN_SCRIPTS = ("Cyrillic", "Greek", "Hebrew", "Arabic", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul")
ENGLISH_CONNECTIVES = ("the", "and", "of", "to", "in", "is", "that", "with", "for", "as", "are", "by", "this", "it", "from", "its")


def source_kind(docs: DataFrame, name: str = "source_name", mime: str = "mime_type", web_mime: str = "text/x-web-article") -> DataFrame:
    """Adds ``source_kind``: from the MIME type, then the file extension; null for what cannot be imported."""
    extension, kind = F.element_at(F.split(F.lower(F.coalesce(F.col(name), F.lit(""))), r"\."), -1), F.coalesce(F.col(mime), F.lit(""))
    return docs.withColumn(
        "source_kind",
        F.when(kind == web_mime, "web")
        .when((kind == "application/pdf") | (extension == "pdf"), "pdf")
        .when((kind == "application/vnd.openxmlformats-officedocument.wordprocessingml.document") | (extension == "docx"), "docx")
        .when(extension.isin("md", "markdown", "mdown", "mkd") | (kind == "text/markdown"), "markdown")
        .when(kind.startswith("text/") | extension.isin("txt", "text"), "text"),
    )


def looks_like_markdown(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``markdown``: whether the text shows any structural sign of Markdown."""
    body = F.regexp_replace(F.col(text), r"^\x{FEFF}", "")
    found = F.lit(False)
    for sign in MARKDOWN_SIGNS:
        found = found | body.rlike(sign)
    return docs.withColumn("markdown", found)


def strip_citation_artifacts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Removes citation tokens and private-use characters, and adds ``removed_chars``."""
    clean = F.col(text)
    for pattern in CITATION_ARTIFACTS:
        clean = F.regexp_replace(clean, pattern, "")
    return docs.withColumns({"clean_text": clean, "removed_chars": F.length(text) - F.length(clean)})


def normalize_block_text(blocks: DataFrame) -> DataFrame:
    """Blanks before newlines and runs of empty lines go; ``speak`` says whether the kind is read aloud."""
    text = F.regexp_replace(F.regexp_replace("text", r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return blocks.withColumns({"text": strip(text), "speak": ~F.col("kind").isin(*SILENT_KINDS)})


def letters_and_digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def readable_gate(pages: DataFrame, text: str = "text", least: int = 240) -> DataFrame:
    """Articles with enough letters and digits to be worth hearing."""
    return pages.where(letters_and_digits(F.col(text)) >= least)


def scanned_gate(docs: DataFrame, text: str = "text", pages: str = "pages") -> DataFrame:
    """Adds ``scanned``: too few letters for the number of pages, so the pages are pictures."""
    return docs.withColumn("scanned", letters_and_digits(F.col(text)) < F.greatest(F.lit(24), F.col(pages) * 8))


def title_search(docs: DataFrame, query: str, title: str = "title") -> DataFrame:
    """Documents whose title holds the query, case ignored; a blank query keeps all."""
    wanted = query.strip().lower()
    return docs.where(F.contains(F.lower(title), F.lit(wanted))) if wanted else docs


def language_gate(texts: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """Adds ``plausible``: whether a text can be in its declared language.

    Short texts pass.  The share of letters in other scripts must fit the language, and an English text needs two different
    connectives; anything unclear passes.
    """
    texts = texts.withColumn("__body", strip(F.col(text)))
    body, tag = F.col("__body"), F.lower(F.coalesce(F.col(language), F.lit("en")))
    # of ASCII only letters are of a script, and Latin; scripts are looked up for the rest alone
    texts = texts.withColumn("__beyond", F.regexp_replace(body, r"[\x00-\x7F]++", ""))
    beyond = F.col("__beyond")
    other = F.regexp_count(beyond, F.lit("|".join(rf"\p{{Is{s}}}" for s in NON_LATIN_SCRIPTS)))
    latins = F.regexp_count(beyond, F.lit(r"\p{IsLatin}")) + F.length(F.regexp_replace(body, "[^A-Za-z]++", ""))
    texts = texts.withColumn("__other", other).withColumn("__total", F.col("__other") + latins)
    other, total = F.col("__other"), F.col("__total")
    latin = ~tag.rlike(rf"^({'|'.join(NON_LATIN_LANGUAGES)})\b")
    share = other / F.nullif(total, F.lit(0))
    wrong = (total >= 20) & ((latin & (share > 0.2)) | (~latin & (share < 0.5)))
    found = F.regexp_extract_all(F.lower(body), F.lit(rf"\b({'|'.join(ENGLISH_CONNECTIVES)})\b"), F.lit(1))
    verdict = F.when(F.length(body) < 24, True).when(wrong, False).when(~tag.startswith("en"), True).otherwise(F.size(F.array_distinct(found)) >= 2)
    return texts.withColumn("plausible", verdict).drop("__body", "__beyond", "__other", "__total")


def back_matter_heading(blocks: DataFrame, extra_titles: tuple[str, ...] | DataFrame = ()) -> DataFrame:
    """Adds ``back_matter``: whether a heading is, whole, the title of a section that narrators skip.

    ``extra_titles`` are more such titles: a few names, or a table of any size with a column ``title``, whose titles are compared like
    headings, without numbering and closing punctuation.  Only headings are held against the table.
    """
    heading = F.col("kind") == "heading"
    if not isinstance(extra_titles, DataFrame):
        return blocks.withColumn("back_matter", heading & heading_key(F.col("text")).isin(*BACK_MATTER_TITLES, *extra_titles))
    titles = extra_titles.select(heading_key(F.col("title")).alias("__key")).where("__key <> ''").distinct()
    named = blocks.where(heading).select("document_id", "pos", heading_key(F.col("text")).alias("__key")).join(titles, "__key", "left_semi").select("document_id", "pos", F.lit(True).alias("__named")).distinct()
    marked = blocks.join(named, ["document_id", "pos"], "left")
    return marked.withColumn("back_matter", heading & (heading_key(F.col("text")).isin(*BACK_MATTER_TITLES) | F.coalesce("__named", F.lit(False)))).drop("__named")
