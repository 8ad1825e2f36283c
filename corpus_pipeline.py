"""A corpus cleaned and encoded in five stages, each of which works on what the one before it kept.

Between stages documents are written as Parquet, to the shared checkpoint folder, and read again.  Every stage takes empty tables and
any columns beside ``doc_id`` and ``text``, whatever their names, and returns the columns it got, but for the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.llm import bpe_automaton, decontaminate, line_dedup, minhash_join, toxicity
from listenlake.llm.graph import checked, settled, shared_folder

#: Word shingles of five words and a similarity of 0.8 for near duplicates; the same share of characters for lines.
WIDTH, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained with all labels, scores below one half.  A null or empty text scores like one without cues,
    and rows are judged one by one, whatever their ids; other columns are not read."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(model.score(F.col("text")) < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated and similar lines, ``n_chars``, if there is one, counted anew; a document that loses every line is a
    copy and goes.  Documents without lines (null, empty or blank texts) and those with a null id stay as they are."""
    kept = line_dedup.thinned(docs, percent=PERCENT).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    new = {"text": F.col("rest"), "n_chars": F.when(F.col("n_removed") > 0, F.length("rest").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return kept.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.  Texts without words and rows with a null id stay;
    rows that repeat the id of a document that stays all stay."""
    gone = settled(minhash_join.near_duplicates(docs, width=WIDTH, percent=PERCENT).where("not kept").select("doc_id"))
    return docs.join(checked(gone), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word passage of the benchmark.  Null and empty texts have none and stay, as rows with a null id do;
    of rows that repeat an id all go if one has such a passage."""
    found = decontaminate.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = settled(found.where("contaminated and doc_id is not null").select("doc_id").distinct())
    return docs.join(checked(gone), "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text they decode to, row by row; a null text counts as empty."""
    return bpe_automaton.encode_decode(docs, keep_text=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: No SQL expresses the classifier or the encoding; the tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
