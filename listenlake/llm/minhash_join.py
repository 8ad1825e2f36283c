"""MinHash near-duplicates by an inverted join over signature coordinates.

Every document gets a signature of 64 coordinates, each the smallest of its shingles under one hash function.  Two sets with
Jaccard similarity s agree in a coordinate with probability s, so a pair at the threshold agrees in far more than ``T`` of
them.  Documents are posted under each (coordinate, value) pair.  As a pair that agrees in ``T`` of ``K`` coordinates must
share one of any ``K - T + 1`` taken in a common order, only that many of a document's postings, the rarest first, are read
(the prefix); postings that hold one document are never read (the skip).  For the pairs that meet, the coordinates that collide are
counted; those with ``T`` or more are retained, and confirmed on full sets.

Documents with one and the same set are one class from the start, so exact copies cost one row each.  No long posting list is expanded
into pairs: its members are first compared with one head, and only lists that are then still in several components are compared block
against block inside tasks, which return a spanning forest of the links found.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checked, components, settled, starred
from .textops import NOT_SPACE, mix, shingles, slices, text_bytes, word_hashes, word_spans

COORDINATES = 64
#: A pair at exactly the wanted similarity is missed with this probability at most.
MISS = 5e-5
#: A posting list of more documents is compared in blocks; shorter ones are expanded into at most 120 pairs.
LONG_LIST = 16
BLOCK = 2048

_KEYS = mix(np.arange(1000, 1000 + COORDINATES, dtype=np.uint64)) | np.uint64(1)


def matches(percent: int) -> int:
    """Coordinates in which a pair must agree: as many as ``MISS`` allows at ``percent``, but one at least (for 85: 42, missed with
    probability 3e-5; for 80: 38, with 4.3e-5)."""
    p, miss = percent / 100, 0.0
    for k in range(COORDINATES):
        miss += comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if miss > MISS:
            return max(1, k)
    return COORDINATES


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes side by side, and where those of each text begin and how many they are."""
    data, at = text_bytes(batch.column("text"))
    starts, ends, owner = word_spans(data, at, NOT_SPACE)
    value, of = shingles(word_hashes(data, starts, ends), owner, batch.num_rows, width)
    count = np.bincount(of, minlength=batch.num_rows)
    return value, np.cumsum(count) - count, count


def _signatures(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value, begin, count = _sets(batch, width)
            some = np.flatnonzero(count)
            sig = np.zeros((batch.num_rows, COORDINATES), dtype=np.uint32)
            size, one, two = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            if len(some):
                for k in range(COORDINATES):
                    sig[some, k] = np.minimum.reduceat((value * _KEYS[k]) >> np.uint64(32), begin[some])
            for i in some.tolist():
                own = np.unique(value[begin[i] : begin[i] + count[i]])
                size[i], one[i], two[i] = len(own), own.sum(), mix(own).sum()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, COORDINATES, dtype=np.int32)), pa.array(sig.view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], names=["doc_id", "n_shingles", "d1", "d2", "sig"])

    return work


def _full_sets(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value, begin, count = _sets(batch, width)
            own = [np.unique(value.view(np.int64)[b : b + c]) for b, c in zip(begin.tolist(), count.tolist())]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            flat = np.concatenate(own) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "set"])

    return work


def _list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])


def _confirm(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xat), (y, yat) = _list_parts(batch.column("xset")), _list_parts(batch.column("yset"))
            keep = []
            for i in range(batch.num_rows):
                p, q = x[xat[i] : xat[i + 1]], y[yat[i] : yat[i + 1]]
                low, high = (p, q) if len(p) <= len(q) else (q, p)
                place = np.minimum(np.searchsorted(high, low), len(high) - 1)
                shared = int((high[place] == low).sum())
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return work


def _forest(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the symmetric matrix ``linked`` connects, one fewer than the members of each part."""
    found, left = [], np.ones(len(ids), dtype=bool)
    for i in range(len(ids)):
        if not left[i]:
            continue
        left[i], edge = False, [i]
        while edge:
            j = edge.pop()
            new = np.flatnonzero(linked[j] & left)
            left[new] = False
            found += [(int(ids[j]), int(ids[k])) for k in new]
            edge += new.tolist()
    return found


def _block_links(percent: int):
    """For the members of one pair of blocks: links between them by exact set sizes, as a spanning forest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ids = table.column("rep").to_numpy()
        flat, at = _list_parts(table.column("set").combine_chunks())
        size = np.diff(at).astype(np.int64)
        row = np.repeat(np.arange(len(ids)), size)
        _, column, df = np.unique(flat, return_inverse=True, return_counts=True)
        shared = df[column] > 1  # a shingle of one member adds to no intersection
        row, column = row[shared], column[shared]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        column = np.cumsum(np.r_[0, column[1:] != column[:-1]]) if len(column) else column
        both, width = np.zeros((len(ids), len(ids)), dtype=np.float32), 2048
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [start, start + width])
            part = np.zeros((len(ids), width), dtype=np.float32)
            part[row[lo:hi], column[lo:hi] - start] = 1
            both += part @ part.T
        both = both.astype(np.int64)
        found = _forest(ids, 100 * both >= percent * (size[:, None] + size[None, :] - both))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return work


def _links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links between the representatives of classes of equal sets."""
    posted = classes.select("rep", "n_shingles", F.posexplode("sig").alias("k", "v")).select("rep", "n_shingles", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long") + F.lit(1 << 31)).alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    # of a document's postings in order of rarity, those of one document come first; the rest of its prefix is read
    mine = posted.join(shared, "key").groupBy("rep", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    most = COORDINATES - matches(percent) + 1
    read = mine.where(F.size("keys") > COORDINATES - most).select("rep", "n_shingles", F.explode(F.slice("keys", 1, F.size("keys") - (COORDINATES - most))).alias("p")).select("rep", "n_shingles", "p.key")
    read = settled(read)
    sizes = read.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    lists = settled(read.join(sizes, "key"))
    short, long = lists.where(F.col("m") <= LONG_LIST), lists.where(F.col("m") > LONG_LIST)
    x, y = short.select("key", F.col("rep").alias("a"), F.col("n_shingles").alias("na")), short.select("key", F.col("rep").alias("b"), F.col("n_shingles").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    large = starred(long.select("key", F.col("rep").alias("id")))
    stars = large.where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    met = settled(x.join(y, "key").where(fits).select("a", "b").unionByName(stars).distinct())
    sig = classes.select("rep", "sig")
    counted = met.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    collisions = F.size(F.filter(F.zip_with("sa", "sb", lambda p, q: p == q), lambda same: same))
    pairs = settled(counted.where(collisions >= matches(percent)).select("a", "b"))

    sets = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), width)
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("xset")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("yset")), "b")
    links = settled(both.select("a", "b", "xset", "yset").mapInArrow(_confirm(percent), "a long, b long"))

    # long lists of one head overlap widely and are taken together
    found = components(links).withColumnRenamed("node", "id")
    apart = settled(large.join(found, "id", "left").select("head", "id", F.coalesce("component", "id").alias("component")))
    open_ = settled(apart.groupBy("head").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).where("low < high"))
    if open_.isEmpty():
        return links
    left = settled(apart.join(open_.select("head", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "head").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    parts = left.select("head", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    parts = parts.select(F.col("id").alias("rep"), "head", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    joined = parts.join(_sets_of(docs, left.select(F.col("id").alias("doc_id")), width).withColumnRenamed("doc_id", "rep"), "rep")
    blocked = joined.groupBy("head", "i", "j").applyInArrow(lambda t: pa.Table.from_batches(_block_links(percent)(iter(t.select(["rep", "set"]).to_batches()))), "a long, b long")
    return links.unionByName(blocked)


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``doc_id, set``: the whole shingle sets of some documents."""
    wanted = checked(settled(wanted.distinct()))
    return settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets(width), "doc_id long, set array<long>"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose word-shingle sets overlap by ``percent`` or more: one row per document.

    Words are runs of non-space characters with A-Z lower-cased; a text of fewer than ``width`` words is one shingle.  Links
    are pairs with ``100 * intersection >= percent * union`` on whole sets; groups are their connected components.

    Returns ``doc_id, n_shingles, component_id, kept``.  A null or empty text has no shingles and is linked with nothing, even
    with another empty one.  Ids are whole numbers.  Rows that repeat a whole text are linked; rows that repeat an id are that id's rows, each
    returned.  A null id stays null: such a row takes no part and is its own kept group.  Other columns are not read.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    signed = settled(docs.mapInArrow(_signatures(width), "doc_id long, n_shingles long, d1 long, d2 long, sig array<int>"))
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = settled(some.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    firsts = classes.join(some.select(F.col("doc_id").alias("rep"), "n_shingles", "d1", "d2", "sig"), ["rep", "n_shingles", "d1", "d2"]).dropDuplicates(["rep", "d1", "d2", "n_shingles"])
    found = components(_links(docs, firsts.select("rep", "n_shingles", "sig"), width, percent)).withColumnRenamed("node", "rep")
    of_class = classes.join(found, "rep", "left").select("n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    empty = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = some.drop("sig").join(of_class, ["n_shingles", "d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
