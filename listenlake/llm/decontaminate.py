"""Benchmark decontamination with suffix arrays of the training text.

Documents are dealt to shards of a few MB by hash.  A task builds the suffix arrays of its shard once, one for each MB of text: all
word positions, in the lexicographic order of the words that follow, to the depth of a window.  Every suffix of every benchmark item
is then looked up by binary search; equal ranges give the places of verbatim matches, and matches that follow one another in both
texts join into longer ones.  Words are numbered within a suffix array, and a suffix with a word that it lacks needs no search.

The benchmark is a table that meets each shard in one exchange, sorted behind the shard's documents, and passes it in blocks of
bounded size.  Nothing of it goes through the driver, and neither the plan nor what a task holds grows with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .textops import LETTERS, sides, slices, text_bytes, word_hashes, word_spans

#: Consecutive words that make a match; an item of fewer words is matched as a whole.
WINDOW = 10
#: Bytes of benchmark text that are searched for at once; an item is never cut.
BLOCK_BYTES = 1 << 22
#: Bytes of text in a shard, on average, and under one suffix array, at most; a longer text has one of its own.
SHARD_BYTES, ARRAY_BYTES = 1 << 22, 1 << 20


def _keys(words: np.ndarray, at: np.ndarray, depth: np.ndarray, window: int) -> np.ndarray:
    """The ``depth`` words from each position as byte strings that sort like the words."""
    place = at[:, None] + np.arange(window)
    inside = np.arange(window) < depth[:, None]
    value = np.where(inside, words[np.minimum(place, len(words) - 1)], 0).astype(">u4")
    return np.ascontiguousarray(value).view(f"S{4 * window}").ravel()


class Probes:
    """The suffixes of a block of items, ready to be looked up."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        """``items``: id and text."""
        self.window = window
        #: The ids; in what follows an item is its place among them.
        self.ids = sorted({i for i, _ in items})
        place = {i: n for n, i in enumerate(self.ids)}
        data, at = text_bytes(pa.array([text for _, text in items], pa.string()))
        starts, ends, owner = word_spans(data, at, LETTERS)
        self.hashes = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        count = np.bincount(owner, minlength=len(items))
        length = np.minimum(window, count)[owner]
        left = np.cumsum(count)[owner] - np.arange(len(owner))
        self.at = np.flatnonzero(left >= length)  # a window begins here
        self.length = length[self.at]
        self.item = np.array([place[i] for i, _ in items], dtype=np.int64)[owner[self.at]]

    def longest(self, at: np.ndarray, probe: np.ndarray) -> np.ndarray:
        """For each match the words of the run of matches that it begins, and itself; later ones of a run get 0."""
        diagonal = self.at[probe] - at
        order = np.lexsort((at, self.item[probe], diagonal))
        a, d, i = at[order], diagonal[order], self.item[probe][order]
        new = np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (a[1:] != a[:-1] + 1)]
        first = np.flatnonzero(new)
        words = np.zeros(len(at), dtype=np.int64)
        words[order[first]] = np.diff(np.r_[first, len(a)]) - 1 + self.length[probe][order][first]
        return words


class SuffixArray:
    """All word positions of some texts, in the order of the words that follow to the depth of a window, and what was found in them."""

    def __init__(self, ids: pa.Array, texts: pa.Array, window: int = WINDOW):
        self.ids, self.window = ids, window
        data, offsets = text_bytes(texts)
        starts, ends, self.owner = word_spans(data, offsets, LETTERS)
        self.count = np.bincount(self.owner, minlength=len(ids))
        self.begin = np.cumsum(self.count) - self.count
        self.vocabulary, words = np.unique(word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64), return_inverse=True)
        words = (words + 1).astype(np.uint32)
        stop = (self.begin + self.count)[self.owner]  # a suffix ends with its own text
        place = np.arange(len(words))
        keys = _keys(words, place, np.minimum(window, stop - place), window) if len(words) else np.zeros(0, f"S{4 * window}")
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.hit = np.zeros(len(words), dtype=bool)
        self.items: dict[int, set] = {}
        #: For each text its longest match: words (negative), first word, and item.
        self.best: dict[int, tuple] = {}

    def find(self, probes: Probes) -> tuple[np.ndarray, np.ndarray]:
        """Word position and window of every verbatim match."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.keys) or not len(probes.at):
            return none, none
        place = np.minimum(np.searchsorted(self.vocabulary, probes.hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == probes.hashes
        lacking = np.r_[0, np.cumsum(~known)]
        sought = np.flatnonzero(lacking[probes.at + probes.length] == lacking[probes.at])
        if not len(sought):
            return none, none
        size = probes.length[sought]
        wanted = _keys(np.where(known, place + 1, 0).astype(np.uint32), probes.at[sought], size, self.window)
        beyond = wanted.view(np.uint8).reshape(len(sought), -1).copy()
        beyond[np.arange(4 * self.window) >= 4 * size[:, None]] = 255
        low, high = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, beyond.view(self.keys.dtype).ravel(), "right")
        n = np.maximum(0, high - low)
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return self.order[rank], np.repeat(sought, n)

    def search(self, probes: Probes) -> None:
        """Adds what a block of items has in these texts."""
        at, probe = self.find(probes)
        if not len(at):
            return
        edge = np.zeros(len(self.hit) + 1, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + probes.length[probe], -1)
        self.hit |= np.cumsum(edge[:-1]) > 0
        text, item, words = self.owner[at], probes.item[probe], probes.longest(at, probe)
        for i, k in np.unique(np.column_stack([text, item]), axis=0).tolist():
            self.items.setdefault(i, set()).add(probes.ids[k])
        order = np.lexsort((item, at, -words, text))  # of equally long matches the first, then the one with the smallest item
        for j in order[np.r_[True, np.diff(text[order]) > 0]].tolist():
            i = int(text[j])
            match = (-int(words[j]), int(at[j] - self.begin[i]), probes.ids[int(item[j])])
            self.best[i] = min(self.best.get(i, match), match)

    def found(self, item_type: pa.DataType) -> pa.RecordBatch:
        """One row for each text."""
        rows = range(len(self.ids))
        hit = np.flatnonzero(self.hit)
        ends = np.searchsorted(self.owner[hit], np.arange(len(rows) + 1)).astype(np.int32)
        hits = pa.ListArray.from_arrays(pa.array(ends), pa.array((hit - self.begin[self.owner[hit]]).astype(np.int32)))
        items = pa.array([sorted(self.items.get(i, ())) for i in rows], pa.list_(item_type))
        best = [self.best.get(i, (0, None, None)) for i in rows]
        longest = (pa.array([-b[0] for b in best], pa.int32()), pa.array([b[2] for b in best], item_type), pa.array([b[1] for b in best], pa.int32()))
        return pa.RecordBatch.from_arrays([self.ids, pa.array(self.count, pa.int64()), hits, items, *longest], names=["doc_id", "n_words", "hits", "items", "longest", "longest_item", "longest_at"])


def _search(item_type: pa.DataType, window: int):
    array_bytes, block_bytes = ARRAY_BYTES, BLOCK_BYTES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, arrays = None, []
        for at, side, batch in sides(batches):
            if at != shard:
                yield from (array.found(item_type) for array in arrays)
                shard, arrays = at, []
            if side == 0:
                arrays.extend(SuffixArray(part.column("doc_id"), part.column("text"), window) for part in slices([batch], most=array_bytes))
            elif arrays:
                for part in slices([batch], most=block_bytes):
                    probes = Probes(list(zip(part.column("item_id").to_pylist(), part.column("text").to_pylist())), window)
                    for array in arrays:
                        array.search(probes)
        yield from (array.found(item_type) for array in arrays)

    return work


def overlaps(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """Verbatim benchmark passages in every document: one row per document.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.  Returns ``doc_id, n_words,
    hits`` (positions of words inside a match, ascending), ``items`` (ids of items with a match, ascending), ``longest,
    longest_item, longest_at`` (words, item and first word of the longest match; 0 and null without one) and ``contaminated``.

    A null or empty text has no words.  Items with a null id or without words match nothing; items that share an id or a text
    each count under their id.  Ids may be of any type that can be ordered.  A text is never cut, however long.  Null
    and repeated document ids pass through row by row, an empty benchmark leaves all clean, and other columns are not read.
    """
    items = benchmark.select(F.col(item_column).alias("item_id"), F.col(item_text_column).alias("text")).where("item_id is not null and text is not null")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind, item = rows.schema["doc_id"].dataType, items.schema["item_id"].dataType
    shards = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"), F.lit(0).alias("side"), "doc_id", F.lit(None).cast(item).alias("item_id"), "text")
    # an item goes to all shards in two steps, so that no task writes more than a root of their number of copies
    step = math.isqrt(shards - 1) + 1
    some = items.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(shards - 1), F.lit(step)).cast("array<long>"))).repartition("first")
    shard = F.explode(F.sequence(F.col("first"), F.least(F.col("first") + step - 1, F.lit(shards - 1).cast("long"))))
    asked = some.select(shard.alias("shard"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("doc_id"), "item_id", "text")
    met = dealt.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "side")
    shown = kind.simpleString(), item.simpleString()
    found = met.mapInArrow(_search(to_arrow_type(item), window), f"doc_id {shown[0]}, n_words long, hits array<int>, items array<{shown[1]}>, longest int, longest_item {shown[1]}, longest_at int")
    return found.withColumn("contaminated", F.size("hits") > 0)
