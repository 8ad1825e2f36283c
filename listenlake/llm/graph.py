"""Distributed union-find over tables of links, and written tables that cut lineage; DataFrame operations only."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Where none is set a session in one process (tests) gets a new one; on a cluster that is an
    error, as executors could not read a folder of the driver's machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that fill a task.  A partition is a few files in every exchange and checkpoint, however few rows it has.
ROWS_A_TASK = 20_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows, in no more partitions than these rows fill; without an exchange, and more rows are more tasks."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def recounted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` settled and gathered, and the number of its rows."""
    df = settled(df)
    rows = df.count()
    return gathered(df, rows), rows


#: Bytes of a table that may be broadcast; a join with a larger one shuffles.
BROADCAST_BYTES = 1 << 24


def checked(small: DataFrame, row_bytes: int = 16) -> DataFrame:
    """A settled table of short rows, to be broadcast if all its rows fit in ``BROADCAST_BYTES``."""
    return F.broadcast(small) if row_bytes * small.count() <= BROADCAST_BYTES else small


def starred(crowd: DataFrame, rows: int | None = None) -> DataFrame:
    """``head, id`` for the members ``key, id`` of large buckets: of each bucket, the member that is in most of them is the head.

    ``rows`` is how many members there are at most, if that is known.

    Copies with a few changes each share buckets with their origin more than with one another, so that one head serves most of them.
    """

    def fewer(df: DataFrame) -> DataFrame:
        return df if rows is None else gathered(df, rows)

    central = settled(fewer(crowd.groupBy("id").agg(F.count("*").alias("n"))))
    heads = settled(fewer(fewer(crowd.join(central, "id")).groupBy("key").agg(F.max(F.struct("n", "id")).alias("top")).select("key", F.col("top.id").alias("head"))))
    return settled(fewer(fewer(crowd.join(heads, "key").select("head", "id")).distinct()))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that occurs in ``links``; the component is the smallest node reachable.

    Alternates large-star and small-star steps: each node hands its larger neighbours to its smallest one, then its smaller
    ones.  Every step is a partial ``min`` and a join, so a node with very many links is never gathered in one place.  Each
    round is written to the checkpoint folder; two sums tell whether a round changed anything.  Self links and repeated
    links are fine, links with a null end are none, and an empty table gives an empty one.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    nodes = links.select(F.explode(F.array(u, v)).alias("node"), F.least(u, v).alias("low")).where("node is not null and low is not null").select("node").distinct()
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v)).distinct()
    before, (edges, rows) = None, recounted(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v")
        large = gathered(gathered(large, rows).distinct(), rows)
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        edges = settled(gathered(gathered(small.select("e.u", "e.v").where("u != v"), 2 * rows).distinct(), rows))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
        if now == before:
            break
        before, rows = now, now[0]
        edges = gathered(edges, rows)
    return nodes.join(edges.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
