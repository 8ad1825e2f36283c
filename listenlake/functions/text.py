"""Column helpers shared by the operators: Unicode blanks, rounding, and the fixed word lists and patterns of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles that open back matter (fixed values).
BACK_MATTER_TITLES = (
    "references",
    "reference",
    "references and notes",
    "bibliography",
    "works cited",
    "literature cited",
    "notes",
    "endnotes",
    "end notes",
    "footnotes",
    "foot notes",
    "acknowledgment",
    "acknowledgments",
    "acknowledgement",
    "acknowledgements",
)

#: Block kinds that are containers or markup and are not read aloud themselves (fixed values).
SILENT_KINDS = ("list", "quote", "alert", "details", "definition-list", "code", "math", "mermaid", "frontmatter", "divider", "page-break")

#: A word: letters and digits, joined by apostrophes and hyphens.
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
#: A sentence: up to and with its final punctuation.
SENTENCE = r"[^.!?]+(?:[.!?]+|$)"
#: Lines that belong to a structure rather than to prose (a fixed value).
STRUCTURAL = r"^(#{1,6}\s|\||```|[-*+]\s|\d+[.)]\s|>|!\[)"
#: A spoken link: an absolute or www address, or a domain with a path (a fixed value).
LINK = r"(?i)(?:https?://|www\.)[^\s<>()]+|\b[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)+/[^\s<>()]*"


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space become one space, and none is left at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    bare = F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++$", "")  # a run of blanks is read once, wherever it stands
    return F.when(F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1))).rlike(r"(?U)\s"), bare).otherwise(text)


def half_up(value: Column) -> Column:
    """The nearest whole number, halves upwards."""
    return F.floor(value + 0.5)


def heading_key(title: Column) -> Column:
    """A heading in lower case without leading numbering and trailing punctuation, for comparison."""
    plain = strip(F.lower(title))
    plain = F.regexp_replace(plain, r"(?i)^(?:\d+(?:\.\d+)+\.?|\d+[.)]|(?:[ivxlcdm]+|[a-z])[.)])\s+", "")
    return squeeze(F.regexp_replace(plain, r"[:.]+$", ""))


def words_in(text: Column) -> Column:
    """How many words a text has."""
    return F.regexp_count(text, F.lit(WORD))


def finite(value: Column) -> Column:
    """A duration or position as a finite number of at least 0."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), value))


def fold_digits(line: Column) -> Column:
    """A line in lower case with each run of digits as ``#``: what repeats from page to page."""
    return F.regexp_replace(F.lower(strip(line)), r"\d+", "#")
