"""URL filter: allow and block rules, and a character language-model ratio for what no rule decides.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, each predict a character from up to
``ORDER`` characters before it; longer contexts fall back on shorter ones in proportion to how little they were seen.  The score
of a URL is the mean over its characters of log P(accepted) - log P(rejected).  The URLs that rules decide are the examples:
three quarters are counted, and the last quarter, unseen by the counts, calibrates the score at which a URL is accepted.

Counts cover every such URL of the table and stay a DataFrame, keyed by the exact bytes of context and next character, so the model
grows with the input and never passes through the driver.  Shorter contexts are sums of longer ones.  A text is scored by joining
its contexts to the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled
from .textops import slices, text_bytes

#: Characters of context at most.
ORDER = 5
#: Bits of a character in a gram: 0 stands for the beginning of the text, a byte for itself and one; six of them fit in 64 bits.
BITS = 9
#: Weight of the shorter context's estimate, as if it had been seen so often.
WEIGHT = 2.0
#: Parts of a log ratio that are added up, as whole numbers, so that the order of a sum does not matter.
PARTS = float(1 << 32)
#: Scores are calibrated on a grid of this many steps over [-LIMIT, LIMIT].
STEPS, LIMIT = 400, 4.0


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


#: A small rule set; the longest rule that fits wins.
RULES = (Rule("net", "/", False), Rule("example.net", "/en/", True), Rule("example.com", "/de/", False), Rule("org", "/fr/", True))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, "allow" if rule.allow else "block").otherwise(verdict)
    return text, verdict


def _grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """At every byte of the texts, that byte (the lowest bits) and the ``ORDER`` before it, nearest first."""
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    gram = np.zeros(len(data), dtype=np.int64)
    for back in range(ORDER + 1):
        some = np.flatnonzero(place >= back)
        gram[some] |= (data[some - back].astype(np.int64) + 1) << (BITS * back)
    return gram


def _counted(column: str):
    """``column``, gram and how often it occurs, added up within a slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = text_bytes(batch.column("text"))
            if len(data):
                rows = pd.DataFrame({column: np.repeat(batch.column(column).to_numpy(zero_copy_only=False), np.diff(at)), "gram": _grams(data, at)})
                yield pa.RecordBatch.from_pandas(rows.value_counts(sort=False).rename("n").reset_index(), preserve_index=False)

    return work


def _lower(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << (BITS * (order + 1))) - 1))


def _ratios(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """``gram, ratio``: log P(accepted) - log P(rejected) of each of ``grams``, in whole ``PARTS``.

    A context has at most 257 characters after it, so no join or window here has a larger group."""
    asked = counts.select("gram", "n0", "n1").unionByName(grams.select("gram", F.lit(0).cast("long").alias("n0"), F.lit(0).cast("long").alias("n1")))
    full = settled(asked.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    tables = [full]
    for order in range(ORDER - 1, -1, -1):
        tables.append(tables[-1].groupBy(_lower(order).alias("gram")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    chance = None
    for order, table in enumerate(reversed(tables)):
        context = Window.partitionBy(F.shiftright("gram", BITS))
        table = table.select("gram", "n0", "n1", F.sum("n0").over(context).alias("c0"), F.sum("n1").over(context).alias("c1"))
        if chance is None:
            table = table.withColumns({"p0": F.lit(1 / 256), "p1": F.lit(1 / 256)})
        else:
            table = table.withColumn("low", _lower(order - 1)).join(chance, "low")
        estimates = [((F.col(f"n{s}") + WEIGHT * F.col(f"p{s}")) / (F.col(f"c{s}") + WEIGHT)).alias(f"p{s}") for s in (0, 1)]
        chance = table.select(F.col("gram").alias("low"), *estimates)
    return chance.select(F.col("low").alias("gram"), F.round(F.log(F.col("p0") / F.col("p1")) * PARTS).cast("long").alias("ratio"))


class UrlModel:
    """Counts ``gram, n0, n1`` in accepted and rejected texts, null where one side has none, and the calibrated threshold."""

    def __init__(self, counts: DataFrame | None, threshold: float = 0.0):
        self.counts, self.threshold = counts, threshold

    def scores(self, texts: DataFrame) -> DataFrame:
        """``row, score`` for texts ``row, text`` with a unique number ``row``: the mean log-likelihood difference of the accepted
        and the rejected model.  An empty or null text, for which the score is 0, has no row."""
        kind = "row long, gram long, n long"
        if self.counts is None:
            return texts.select("row", F.lit(0.0).alias("score")).where(F.lit(False))
        seen = settled(texts.select("row", "text").mapInArrow(_counted("row"), kind))
        ratios = _ratios(self.counts, seen.select("gram").distinct())
        sums = seen.join(ratios, "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("ratio")).alias("sum"), F.sum("n").alias("n"))
        return sums.select("row", (F.col("sum") / F.col("n") / PARTS).alias("score"))

    def score(self, text: Column) -> Column:
        """The same as a column, for models and tables small enough for one process: the model is read by the driver."""
        if self.counts is None:
            return F.lit(0.0)
        counts = self.counts.toPandas()
        known, seen = counts["gram"].to_numpy(np.int64), counts[["n0", "n1"]].to_numpy(np.float64)

        def total(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            values, where = np.unique(keys, return_inverse=True)
            sums = np.stack([np.bincount(where, weights=seen[:, s]) for s in (0, 1)], axis=1)
            place = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            return np.where((values[place] == wanted)[:, None], sums[place], 0.0)

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            data, at = text_bytes(pa.array(texts, pa.string()))
            grams, chance = _grams(data, at), np.full((len(data), 2), 1 / 256)
            for order in range(ORDER + 1):
                mask = (1 << (BITS * (order + 1))) - 1
                chance = (total(known & mask, grams & mask) + WEIGHT * chance) / (total((known & mask) >> BITS, (grams & mask) >> BITS) + WEIGHT)
            ratio = np.r_[0, np.cumsum(np.round(np.log(chance[:, 0] / chance[:, 1]) * PARTS).astype(np.int64))]
            return pd.Series((ratio[at[1:]] - ratio[at[:-1]]) / np.maximum(1, np.diff(at)) / PARTS)

        return score(text)


def fit(examples: DataFrame) -> UrlModel:
    """A model of examples ``text, side`` (0 accepted, 1 rejected); a null side is no example.  Without examples of both
    sides every score is 0 and every URL is accepted."""
    examples = examples.where("side is not null and text is not null").select("text", F.col("side").cast("long").alias("side"))
    examples = examples.withColumn("fold", F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(4)))
    grams = examples.where("fold <> 0").select("text", "side").mapInArrow(_counted("side"), "side long, gram long, n long")
    sides = [F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in (0, 1)]
    counts = settled(grams.groupBy("gram").agg(*sides))
    both = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not both.n0 or not both.n1:
        return UrlModel(None)
    model = UrlModel(counts)
    kept_out = settled(examples.where("fold = 0").select(F.monotonically_increasing_id().alias("row"), "text", "side"))
    scored = kept_out.join(model.scores(kept_out), "row", "left").select("side", F.coalesce("score", F.lit(0.0)).alias("score"))
    step = F.floor((F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) + LIMIT) * (STEPS / (2 * LIMIT)))
    steps = scored.groupBy(step.cast("int").alias("step"), "side").count().toPandas()  # at most 2 * (STEPS + 1) rows
    count = np.zeros((2, STEPS + 1))
    count[steps["side"], steps["step"]] = steps["count"]
    kept = count[0][::-1].cumsum()[::-1] / max(1.0, count[0].sum())  # accepted URLs at or above each step
    dropped = np.concatenate([[0.0], count[1].cumsum()[:-1]]) / max(1.0, count[1].sum())
    best = np.flatnonzero(np.isclose(kept + dropped, (kept + dropped).max()))
    model.threshold = float(best.mean() * (2 * LIMIT / STEPS) - LIMIT)
    return model


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, model: UrlModel | None = None, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """A verdict on every URL: that of the longest rule that fits, else that of the model, which reads the whole URL.

    Returns ``page_id, host, path, rule, verdict, score``.  Without a ``model`` one is fitted to the URLs of the table that rules
    decide.  A null URL, or one without ``://``, has an empty host and path; a null or empty one has a score of 0.  A URL
    is allowed if its score reaches the model's threshold.  Null and repeated ids and repeated URLs pass through row by row; other
    columns are not read.
    """
    host, path = host_and_path(F.col(url_column))
    pages = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(url_column), F.lit("")).alias("text"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    pages = settled(pages.withColumns({"rule": rule, "ruled": verdict}))  # numbered once
    if model is None:
        model = fit(pages.select("text", F.when(F.col("ruled") == "allow", 0).when(F.col("ruled") == "block", 1).alias("side")))
    pages = pages.join(model.scores(pages), "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    judged = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    return pages.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")
