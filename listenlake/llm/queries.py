"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, decontaminate, edit_counts, html_text, line_dedup, minhash_join, oracles, quality_neighbours, secret_scan, token_alignment, toxicity, url_filter, vp_search, whitening


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Judges every URL of ``pages`` by the rules, else by the models fitted to the URLs that rules decide."""
    return url_filter.judge(_table(spark, folder, "pages"))


def op2_edit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document, and again after e-mail and IP addresses in it are replaced."""
    docs = _table(spark, folder, "documents")
    return edit_counts.count_with_edits(docs, edit_counts.redactions(F.col("text")))


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Three-word shingles, similarity 0.85: each document with its group and whether it is the one that stays."""
    return minhash_join.near_duplicates(_table(spark, folder, "documents"), width=3, percent=85)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score for every text; rows whose crc32 leaves 0 modulo 5 teach nothing and are marked as held out."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score_documents(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document after all but the first of each group of similar lines are taken out: counts, and a digest of the rest."""
    docs = line_dedup.without_repeats(_table(spark, folder, "documents").select("doc_id", "text"), percent=80)
    return docs.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_vp_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth row of ``embeddings``, searched exactly."""
    rows = _table(spark, folder, "embeddings")
    return vp_search.search(rows, rows.where("vec_id % 100 = 0"), k=10, factor=1.0)


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every text: counts of the fixed patterns, a digest of their spans, and all spans."""
    found = secret_scan.scan(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Ten-word windows of ``benchmark`` in every document."""
    found = decontaminate.overlaps(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op9_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    """Encodes and decodes every text with the 50k byte-level vocabulary; digests of both results."""
    return bpe_automaton.encode_decode(_table(spark, folder, "documents"), keep_text=False)


def op10_quality_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """A quality score for every text; rows whose crc32 leaves 1 modulo 3 teach nothing and are marked as held out."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = quality_neighbours.fit(docs, labels.where(~held_out))
    return quality_neighbours.score_documents(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the eight leading components of all vectors, scaled to unit variance."""
    found = whitening.whiten(_table(spark, folder, "embeddings"), components=8)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))  # null where it is no long


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of the tokens that the byte-level and the piece vocabulary make of every text."""
    return token_alignment.alignments(_table(spark, folder, "documents"), keep_groups=False)


def op13_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, folder, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_edit_counts": op2_edit_counts,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_vp_search": op6_vp_search,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontaminate": op8_decontaminate,
    "op9_bpe_automaton": op9_bpe_automaton,
    "op10_quality_neighbours": op10_quality_neighbours,
    "op11_whitening": op11_whitening,
    "op12_token_alignment": op12_token_alignment,
    "op13_html_text": op13_html_text,
}

#: DuckDB SQL of those that SQL can express on whole tables in reasonable time; the others have brute-force tests.
ORACLES: dict[str, str] = {"op3_minhash_near_dedup": oracles.OP3, "op6_vp_search": oracles.OP6, "op8_decontaminate": oracles.OP8}
