"""Reading and writing the library's tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlake.operators.joins import playback_overlay

#: What players write while they play.
LISTEN_EVENTS = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("segment_id", T.StringType()),
        T.StructField("start_s", T.DoubleType()),
        T.StructField("end_s", T.DoubleType()),
        T.StructField("event_ts", T.TimestampType()),
    ]
)


def read_library(docs: DataFrame, playback: DataFrame) -> DataFrame:
    """All documents, newest first, with their playback position where it is as fresh as the document."""
    return playback_overlay(docs, playback).orderBy(F.desc("updated_at"), "document_id")


#: Kinds of files by the ending of their name (fixed values).
MIME = {"txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}


def _named(path: Column) -> list[Column]:
    """A file's name, decoded, and its kind."""
    name = F.element_at(F.split(path, "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return [F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("source_name"), F.coalesce(F.element_at(known, ending), F.lit("application/octet-stream")).alias("mime")]


#: Ends a text in a bundle, and what stands for it, and for itself, within texts.
_END, _ESCAPE = "\x1e", "\x1b"


def write_bundles(docs: DataFrame, path: str, id_column: str = "document_id", text_column: str = "text") -> None:
    """Texts as text files that hold many of them, for ``read_text_corpus``: a small file each costs more than what is in it.

    Each text stands behind its id, whatever characters it has; a null one is told apart from an empty one.
    """
    escaped = F.replace(F.replace(text_column, F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(_END), F.lit(_ESCAPE + "1"))
    docs.select(F.concat(F.col(id_column).cast("string"), F.coalesce(F.concat(F.lit("\t"), escaped), F.lit(""))).alias("value")).write.text(path, lineSep=_END)


def read_text_corpus(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Text files, whole: ``source_name, mime, path, text``; a byte order mark goes.

    With ``bundled`` the files are those of ``write_bundles``: a row for each of their texts, with its ``id`` as a string.
    """
    kind = {"lineSep": _END} if bundled else {"wholetext": True}
    rows = spark.read.text(path, recursiveFileLookup=True, **kind).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    text, more = F.col("value"), []
    if bundled:
        at = F.locate("\t", "value")
        tail = F.when(at > 0, F.substring("value", at + 1, F.length("value")))
        text = F.replace(F.replace(tail, F.lit(_ESCAPE + "1"), F.lit(_END)), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))
        more = [F.substring_index("value", "\t", 1).alias("id")]
    return rows.select(*_named(F.col("path")), "path", *more, F.regexp_replace(text, r"^\x{FEFF}", "").alias("text"))


def read_binary_corpus(spark: SparkSession, path: str, least_text: float = 0.95) -> DataFrame:
    """Files of any kind: ``source_name, mime, path, n_bytes, content, text``.

    ``text`` is there for files of a text kind, and for those of no known kind whose bytes are valid UTF-8 with hardly a control
    character: at least ``least_text`` of their characters are none.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.select(*_named(F.col("path")), "path", F.col("length").alias("n_bytes"), "content")
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), r"^\x{FEFF}", "")
    plain = F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0E-\x1F]", "")) >= least_text * F.length(text)
    readable = F.startswith("mime", F.lit("text/")) | ((F.col("mime") == "application/octet-stream") & plain)
    return rows.withColumn("text", F.when(readable, text))


def read_web_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages: ``page_id, url, html``."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_listen_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Position and range events as a stream over a folder of Parquet files."""
    return spark.readStream.schema(LISTEN_EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def write_corpus(df: DataFrame, path: str, *partitions: str) -> None:
    """Replaces only the partitions that ``df`` has rows of."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def newest(rows: DataFrame, key: str = "document_id", at: str = "updated_at", tie: str = "__arriving") -> DataFrame:
    """The newest row of each key; of rows of one time the one with the larger ``tie``, then a fixed one.

    An aggregate with a partial step, so that a key with very many rows is no large task.
    """
    columns = [c for c in rows.columns if c != tie]
    fixed = [F.xxhash64(*(F.col(c) for c in columns if not _holds_map(rows.schema[c].dataType)))]
    best = rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns), F.struct(F.col(at), F.col(tie), *fixed)).alias("__row"))
    return best.select(*(F.col("__row").getField(c).alias(c) for c in columns))


def _holds_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString()


class _Folder:
    """Small files and whole folders below a path, through the file system that Spark itself uses."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.top = self.jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *names: str):
        found = self.top
        for name in names:
            found = self.jvm.org.apache.hadoop.fs.Path(found, name)
        return found

    def names(self, *below: str) -> list[str]:
        folder = self.at(*below)
        return [s.getPath().getName() for s in self.files.listStatus(folder)] if self.files.exists(folder) else []

    def read(self, *names: str) -> str:
        stream = self.files.open(self.at(*names))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str, *names: str) -> None:
        """Written beside its place and moved there, so that no reader meets half of it."""
        beside = self.at(*names[:-1], "." + names[-1])
        stream = self.files.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.files.rename(beside, self.at(*names)):
            raise OSError(f"{self.at(*names).toString()} is there already or cannot be written")

    def delete(self, *names: str) -> None:
        self.files.delete(self.at(*names), True)


#: Buckets of a table that ``upsert_latest`` begins; it keeps the number that it began with.
BUCKETS = 64


def _manifests(folder: _Folder) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in folder.names("manifests") if n.removesuffix(".json").isdigit())


def upsert_latest(batch: DataFrame, path: str, key: str = "document_id", at: str = "updated_at", batch_id: int | None = None, source: str = "", buckets: int = BUCKETS, keep: int = 2) -> bool:
    """Merges a batch into the table at ``path``: the newest row of each key stays, at equal times the arriving one.

    See ``merge_table``.
    """
    return merge_table(batch, path, (key,), lambda rows: newest(rows, key, at, "__arriving"), batch_id, source, buckets, keep)


def merge_table(batch: DataFrame, path: str, keys: tuple[str, ...], combine: Callable[[DataFrame], DataFrame], batch_id: int | None = None, source: str = "", buckets: int = BUCKETS, keep: int = 2) -> bool:
    """Merges a batch into the table at ``path``; ``combine`` makes one table of the arriving and the stored rows of some keys, which
    ``__arriving`` (1 and 0) tells apart, and keeps their ``__bucket``.

    Keys are dealt to buckets by hash.  Only the buckets that the batch has keys of are read, merged and written, to a folder
    that carries the version's number; a manifest of that number then says for every bucket which folder holds it, and is what makes
    the version count.  It also says which batch of each ``source``, a stream's checkpoint say, was merged last: one that is handed over
    again changes nothing, and one that failed before its manifest is written anew.  Without ``batch_id`` every call is a new batch.
    ``keep`` manifests and what they name stay, for readers that have begun; the rest goes.  Returns whether the batch was merged now.
    Batches of one table are merged one at a time.  Rows whose key is null are one key.
    """
    spark = batch.sparkSession
    folder = _Folder(spark, path)
    done = _manifests(folder)
    known = json.loads(folder.read("manifests", f"{done[-1]}.json")) if done else {"buckets": buckets, "held": {}, "seen": {}}
    if batch_id is not None and batch_id <= known["seen"].get(source, -1):
        batch.write.format("noop").mode("overwrite").save()  # a stream's state still has to see its batch
        return False
    number = done[-1] + 1 if done else 0
    count, held = known["buckets"], {int(b): n for b, n in known["held"].items()}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")
    rows = batch.withColumns({"__arriving": F.lit(1), "__bucket": bucket}).persist()  # computed once, for its buckets and its rows
    try:
        touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())  # at most as many as buckets
        both = rows
        if old := [(b, held[b]) for b in touched if b in held]:
            both = rows.unionByName(_buckets(spark, path, old).withColumns({"__arriving": F.lit(0), "__bucket": bucket}), allowMissingColumns=True)
        if touched:
            combine(both).repartition(len(touched), "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/data/{number}")
    finally:
        rows.unpersist()
    held |= dict.fromkeys(touched, number)
    seen = known["seen"] | ({source: batch_id} if batch_id is not None else {})
    folder.write(json.dumps({"buckets": count, "held": held, "seen": seen}), "manifests", f"{number}.json")
    _expire(folder, keep)
    return True


def _buckets(spark: SparkSession, path: str, held: list[tuple[int, int]]) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(*(f"{path}/data/{n}/__bucket={b}" for b, n in held))


def _expire(folder: _Folder, keep: int) -> None:
    """Removes all but the newest manifests, and the buckets that none of these names."""
    done = _manifests(folder)
    for number in done[:-keep]:
        folder.delete("manifests", f"{number}.json")
    named: dict[str, set[str]] = {}
    for number in done[-keep:]:
        for b, n in json.loads(folder.read("manifests", f"{number}.json"))["held"].items():
            named.setdefault(str(n), set()).add(f"__bucket={b}")
    for number in folder.names("data"):
        if number not in named:
            folder.delete("data", number)
            continue
        for bucket in folder.names("data", number):
            if bucket.startswith("__bucket=") and bucket not in named[number]:
                folder.delete("data", number, bucket)


def current_version(spark: SparkSession, path: str) -> int:
    """The number of the last version of the table at ``path``, -1 for none."""
    return max(_manifests(_Folder(spark, path)), default=-1)


def last_batch(spark: SparkSession, path: str, source: str = "") -> int:
    """The last batch of a source that was merged into the table at ``path``, -1 for none."""
    folder = _Folder(spark, path)
    done = _manifests(folder)
    return json.loads(folder.read("manifests", f"{done[-1]}.json"))["seen"].get(source, -1) if done else -1


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert_latest`` keeps, as of its last batch."""
    folder = _Folder(spark, path)
    held = json.loads(folder.read("manifests", f"{max(_manifests(folder))}.json"))["held"]
    return _buckets(spark, path, [(int(b), n) for b, n in held.items()])
