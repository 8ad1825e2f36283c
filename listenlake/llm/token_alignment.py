"""Alignment of two tokenizers' tokens by the byte offsets at which both end.

The tokens of a text are two rising arrays of end offsets.  At the current shift between their indexes, exponential probing compares
stretches of 1, 2, 4, ... ends and jumps over all that agree, which are one-to-one groups; at the first that does not, the array that
is behind advances until both end together, which is one irregular group, and the shift is what it then is.

What stands between a character that is no white space and the next blank never shares a token with what follows, in either
vocabulary: pieces between such places end with a token of both.  New pieces are encoded and aligned side by side, and a worker
remembers the groups and links of each; a document's are those of its pieces.  Documents are worked on in blocks; a block lists its distinct pairs of linked ids once, and its documents name them by their place in that list.  Counts over all
documents are sums over blocks, and travel back to a block by its list, so that no shuffle holds a row for every document and pair.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_automaton import _byte_letters, vocabulary
from .graph import settled, shared_folder
from .textops import slices

#: Bytes of text in a block of documents, and of those that are worked on at once; a longer text is worked on by itself.
BLOCK_BYTES, PART_BYTES = 4 << 20, 1 << 20
#: Pieces, characters of them, and pairs that a worker remembers until its block ends; beyond that it starts afresh, which costs time and changes nothing.
REMEMBERED, REMEMBERED_CHARACTERS, REMEMBERED_PAIRS = 500_000, 1 << 24, 1 << 22
#: Characters of pieces that are encoded together.
TOGETHER = 4096
#: Blanks, what stands up to the next one, and, if that ends in white space, what follows too.
_PIECE = re.compile(r" +[^ ]*(?:(?<=[\s᠎]) +[^ ]*)*")


def _run(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many ends from ``i`` and ``j`` on, which agree, agree one by one: stretches that double, then halve inside the first that
    differs; the last few are compared singly."""
    done, width = 1, 4
    while True:
        left, right = a[i + done : i + done + width], b[j + done : j + done + width]
        if left != right or len(left) < width:
            break
        done, width = done + width, width * 2
    while width > 16:
        width //= 2
        left, right = a[i + done : i + done + width], b[j + done : j + done + width]
        if left == right and len(left) == width:
            done += width
            left, right = a[i + done : i + done + width], b[j + done : j + done + width]
    for x, y in zip(left, right):
        if x != y:
            break
        done += 1
    return done


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The groups of two rising arrays with one last end: of each, one past its last index in ``a`` and in ``b``; and which are irregular."""
    in_a, in_b, irregular, i, j, n = [], [], [], 0, 0, len(a)
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            k = _run(a, b, i, j)
            in_a += range(i + 1, i + k + 1)
            in_b += range(j + 1, j + k + 1)
            i, j = i + k, j + k
            continue
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        irregular.append(len(in_a))
        in_a.append(i)
        in_b.append(j)
    return in_a, in_b, irregular


class Growing:
    """Lists of numbers side by side in one array that grows, each known by its number."""

    def __init__(self):
        self.flat, self.starts, self.used, self.lists = np.zeros(1 << 12, dtype=np.int32), np.zeros(1 << 12, dtype=np.int64), 0, 0

    def add(self, numbers: np.ndarray, sizes: np.ndarray) -> None:
        """Some lists, one list after the other."""
        end, lists = self.used + len(numbers), self.lists + len(sizes)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(end, len(self.flat)), dtype=np.int32)])
        if lists >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(lists, len(self.starts)), dtype=np.int64)])
        self.flat[self.used : end] = numbers
        self.starts[self.lists + 1 : lists + 1] = self.used + np.cumsum(sizes)
        self.used, self.lists = end, lists

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of some lists, one list after the other, and the size of each."""
        start = self.starts[which]
        size = self.starts[which + 1] - start
        return self.flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


class Encoders:
    """Both vocabularies, and the pieces met so far: how many tokens and groups each has, how its groups are written, and its links.

    A piece that a vocabulary cannot spell has a null in place of its groups.
    """

    def __init__(self, spec: str, model: bytes):
        import sentencepiece
        import tokenizers

        self.first = tokenizers.Tokenizer.from_str(spec)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = _byte_letters()
        by_id = {i: token for token, i in self.first.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(letters.get(c, 63) for c in by_id.get(i, "")) for i in range(max(by_id, default=-1) + 1)]
        ids = range(self.second.vocab_size())
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.second.id_to_piece(i)) for i in ids)]
        self.length_a, self.length_b = (np.array([len(x) for x in of], dtype=np.int64) for of in (self.bytes_a, self.bytes_b))
        self.name = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.blank = self.second.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        #: Linked pairs of ids, ``A id * size of B + B id``, and their numbers.
        self.pairs: dict[int, int] = {}
        self.characters = 0
        self.groups: list[str | None] = []
        #: Tokens of each vocabulary and groups, three numbers for each piece; and the numbers of its linked pairs.
        self.sizes, self.links = Growing(), Growing()

    def full(self) -> bool:
        """Whether more is remembered than may be; what numbers stand for stays the same until ``forget``."""
        return len(self.known) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS or len(self.pairs) > REMEMBERED_PAIRS

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of a text that begins with a blank; the second vocabulary puts that blank there by itself."""
        return self.first.encode(text, add_special_tokens=False).ids, [self.blank] if text == " " else self.second.encode(text[1:])

    def _learn(self, new: list[str]) -> None:
        """Encodes and aligns some pieces, side by side as in a text, and each alone if they cannot be told apart then."""
        whole, ends = "".join(new).encode(), np.cumsum([len(piece.encode()) for piece in new])
        a, b = map(np.array, self.ids("".join(new)))
        spelt = all(b"".join([names[i] for i in ids.tolist()]) == whole for ids, names in ((a, self.bytes_a), (b, self.bytes_b)))
        end_a, end_b = (np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])) if spelt else (ends, ends)
        if not spelt or len(new) > 1 and not all(np.isin(ends, x, assume_unique=True).all() for x in (end_a, end_b)):
            if len(new) > 1:
                for piece in new:
                    self._learn([piece])
            else:
                self.groups.append(None)
                self.sizes.add(np.zeros(3), np.array([3]))
                self.links.add(np.zeros(0), np.array([0]))
            return
        in_a, in_b, irregular = align(end_a.tolist(), end_b.tolist())
        names_a, names_b = [self.name[i] for i in a.tolist()], [self.name[i] for i in b.tolist()]
        written, done = [], (0, 0)
        for g in [*irregular, len(in_a)]:
            i, j = (in_a[g - 1], in_b[g - 1]) if g else (0, 0)
            written += [x + "|" + y for x, y in zip(names_a[done[0] : i], names_b[done[1] : j])]
            if g < len(in_a):
                done = in_a[g], in_b[g]
                written.append(",".join(names_a[i : done[0]]) + "|" + ",".join(names_b[j : done[1]]))
        # every end of either array closes one link: an A token with the B token that covers its last byte, or the other way round
        over, under = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
        inner = end_a[under] != end_b
        wide, numbers = len(self.bytes_b), self.pairs
        linked = np.concatenate([a * np.int64(wide) + b[over], a[under[inner]] * np.int64(wide) + b[inner]])
        closes = np.concatenate([end_a, end_b[inner]])
        order = np.argsort(closes, kind="stable")
        self.links.add(np.array([numbers.setdefault(x, len(numbers)) for x in linked[order].tolist()], dtype=np.int32), np.diff(np.searchsorted(closes[order], ends, side="right"), prepend=0))
        to_a, to_b = np.searchsorted(end_a, ends) + 1, np.searchsorted(end_b, ends) + 1
        groups = np.searchsorted(end_a[np.array(in_a) - 1], ends) + 1
        self.sizes.add(np.column_stack([np.diff(x, prepend=0) for x in (to_a, to_b, groups)]).ravel(), np.full(len(new), 3))
        for start, end in zip([0, *groups.tolist()], groups.tolist()):
            self.groups.append(";".join(written[start:end]))

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces of some texts, in order, and how many each text has."""
        split = [_PIECE.findall(" " + text) if text else [] for text in texts]
        flat = [piece for own in split for piece in own]
        known = self.known
        numbers = np.array([known.get(piece, -1) for piece in flat], dtype=np.int64)
        missing = np.flatnonzero(numbers < 0).tolist()
        new = list(dict.fromkeys([flat[i] for i in missing]))
        known.update(zip(new, range(len(known), len(known) + len(new))))
        self.characters += sum(map(len, new))
        start, size = 0, 0
        for k, piece in enumerate(new):  # a piece that ends in white space would run into the next one
            size += len(piece)
            if size > TOGETHER or k + 1 == len(new) or piece[-1].isspace() or piece[-1] == "\u180e":
                self._learn(new[start : k + 1])
                start, size = k + 1, 0
        numbers[missing] = [known[flat[i]] for i in missing]
        return numbers, np.array([len(own) for own in split], dtype=np.int64)


class Listed:
    """The distinct pairs of a block, by their numbers, and in how many of its documents each is."""

    def __init__(self):
        self.place, self.numbers, self.documents = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def places(self, numbers: np.ndarray, pairs: int) -> np.ndarray:
        """The place of each pair in the list, new ones at its end; ``pairs`` is how many numbers there are."""
        self.place = np.concatenate([self.place, np.full(pairs - len(self.place), -1)])
        fresh = np.unique(numbers[self.place[numbers] < 0])
        self.place[fresh] = np.arange(len(self.numbers), len(self.numbers) + len(fresh))
        self.numbers, self.documents = np.concatenate([self.numbers, fresh]), np.concatenate([self.documents, np.zeros(len(fresh), dtype=np.int64)])
        return self.place[numbers]


def _sums(of: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``of`` over stretches of the given lengths."""
    until, total = np.cumsum(counts), np.concatenate([[0], np.cumsum(of)])
    return total[until] - total[until - counts]


def _aligned(encoders: Encoders, texts: list[str], listed: Listed, keep_groups: bool = False) -> dict[str, list | np.ndarray]:
    """Counts and groups of some texts, and their links as (text, place of the pair in the list, how often)."""
    pieces, counts = encoders.pieces(texts)
    numbers, groups, at, n_pieces = pieces.tolist(), [""] * len(texts), 0, counts.tolist()
    known, bad = encoders.groups, np.zeros(len(texts), dtype=bool)
    for k, n in enumerate(n_pieces):
        own = [known[x] for x in numbers[at : at + n]]
        at += n
        if None in own:
            bad[k] = True
        elif own:
            written = ";".join(own)
            groups[k] = written if keep_groups else hashlib.sha256(written.encode()).hexdigest()
    pieces, counts = pieces[~np.repeat(bad, counts)], np.where(bad, 0, counts)
    sizes = encoders.sizes.take(pieces)[0].reshape(-1, 3)
    links, n_links = encoders.links.take(pieces)
    place = listed.places(links, len(encoders.pairs))
    many = max(1, len(listed.numbers))
    both = np.sort(np.repeat(np.arange(len(texts)), _sums(n_links, counts)) * many + place)
    first = np.flatnonzero(np.diff(both, prepend=-1))
    times, both = np.diff(first, append=len(both)), both[first]
    listed.documents += np.bincount(both % many, minlength=many)[: len(listed.documents)]
    return {"n_a": _sums(sizes[:, 0], counts), "n_b": _sums(sizes[:, 1], counts), "n_groups": _sums(sizes[:, 2], counts), "groups": groups, "text": both // many, "place": both % many, "times": times}


#: A worker keeps the vocabularies, and what they made of pieces, from task to task.
_encoders: dict[str, Encoders] = {}


def piece_model(path: str | None = None) -> bytes:
    """The bytes of a piece model file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()


def _lists(numbers: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(numbers, kind))


def tokens_aligned(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, id_column: str = "doc_id", text_column: str = "text", keep_groups: bool = False) -> DataFrame:
    """Each document's groups and links in blocks: rows with groups are documents, rows without hold the pairs of their block.

    ``block, doc_id, n_a, n_b, n_groups, groups, place array<int>, times array<int>, pairs array<long>, documents array<int>``:
    ``place`` and ``times`` say which pairs of the block's list a document holds, and how often.
    """
    from pyspark import TaskContext

    sent = docs.sparkSession.sparkContext.broadcast((vocabulary(byte_path), piece_model(piece_path)))
    name = hashlib.sha256(sent.value[0].encode() + sent.value[1]).hexdigest()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "groups", "place", "times", "pairs", "documents"]
    none = np.zeros(0, dtype=np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _encoders:
            _encoders[name] = Encoders(*sent.value)
        encoders = _encoders[name]
        block, size, listed, id_type = TaskContext.get().partitionId() << 32, 0, Listed(), None

        def ended() -> pa.RecordBatch:
            pairs = np.fromiter(encoders.pairs, dtype=np.int64, count=len(encoders.pairs))[listed.numbers]  # a dict keeps its order
            nothing, empty = pa.array([None], pa.int64()), _lists(none, np.zeros(1, dtype=np.int64), pa.int32())
            found = pa.RecordBatch.from_arrays([pa.array([block]), pa.array([None], id_type), nothing, nothing, nothing, pa.array([None], pa.string()), empty, empty, _lists(pairs, np.array([len(pairs)]), pa.int64()), _lists(listed.documents, np.array([len(pairs)]), pa.int32())], names=names)
            if encoders.full():
                encoders.forget()
            return found

        for part in slices(batches, most=PART_BYTES):
            texts = part.column("text").to_pylist()
            found, id_type = _aligned(encoders, [t or "" for t in texts], listed, keep_groups), part.column("doc_id").type
            each, zeros = np.bincount(found["text"], minlength=len(texts)), np.zeros(len(texts), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(texts), block)), part.column("doc_id"), *(pa.array(found[c]) for c in ("n_a", "n_b", "n_groups")), pa.array(found["groups"], pa.string()), _lists(found["place"], each, pa.int32()), _lists(found["times"], each, pa.int32()), _lists(none, zeros, pa.int64()), _lists(none, zeros, pa.int32())], names=names
            )
            size += sum(map(len, filter(None, texts)))
            if size >= BLOCK_BYTES or encoders.full():
                yield ended()
                block, size, listed = block + 1, 0, Listed()
        if size:
            yield ended()

    return rows.mapInArrow(work, f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, groups string, place array<int>, times array<int>, pairs array<long>, documents array<int>")


def alignments(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, id_column: str = "doc_id", text_column: str = "text", keep_groups: bool = True) -> DataFrame:
    """Groups and links of the tokens that two vocabularies make of each text, a blank put before it.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` or, without ``keep_groups``, ``groups_sha256`` in the last
    one's place: ``a1,a2|b1;a3|b2,b3``, decimal ids in order, or the digest of that.  Tokens whose byte ranges overlap are linked; a
    pair of ids counts the documents in which it is linked, over the whole table, rows that repeat an id each for themselves; a link
    is best if no other pair of its A id counts more, ties included.  Texts that are null or empty, or that a vocabulary cannot spell, have no tokens:
    zeros and no groups, with an empty string for a digest.  Null and repeated ids pass through, row by row; an empty table gives an empty one; other
    columns are not read.
    """
    spark = docs.sparkSession
    size_b = _size(piece_path)
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    tokens_aligned(docs, byte_path, piece_path, id_column, text_column, keep_groups).write.option("compression", "zstd").parquet(folder)
    rows = spark.read.parquet(folder)
    listed = rows.where("groups is null").select("block", F.posexplode(F.arrays_zip("pairs", "documents")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.documents").alias("documents"))
    counts = settled(listed.groupBy("pair").agg(F.sum("documents").alias("count")))
    first = F.floor(F.col("pair") / F.lit(size_b))
    highest = counts.groupBy(first.alias("first")).agg(F.max("count").alias("highest"))  # an A id has as many pairs as B has ids, at most
    counts = counts.withColumn("first", first).join(highest, "first").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    back = listed.select("block", "place", "pair").join(counts, "pair").select(F.col("block").alias("list"), "place", "count", "best")

    last = "groups" if keep_groups else "groups_sha256"

    def counted(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        documents, place = documents.combine_chunks(), pairs["place"].to_numpy()
        count, best = np.zeros(len(place) + 1, dtype=np.int64), np.zeros(len(place) + 1, dtype=np.int64)
        count[place], best[place] = pairs["count"].to_numpy(), pairs["best"].to_numpy(zero_copy_only=False)
        own, times = (documents[c].combine_chunks() for c in ("place", "times"))
        sizes = np.asarray(own.value_lengths())
        own, times = own.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        links = [pa.array(_sums(x, sizes)) for x in (times, times * best[own], times * count[own])]
        return pa.table([*(documents[c] for c in ("doc_id", "n_a", "n_b", "n_groups")), *links, documents["groups"]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", last])

    told = rows.where("groups is not null").select("block", "doc_id", "n_a", "n_b", "n_groups", "place", "times", "groups")
    kind = told.schema["doc_id"].dataType.simpleString()
    return told.groupBy("block").cogroup(back.groupBy("list")).applyInArrow(counted, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {last} string")


def _size(path: str | None) -> int:
    """How many pieces a model has."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=piece_model(path)).vocab_size()
