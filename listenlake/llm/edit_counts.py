"""Token counts that follow edits.

Each edited document gets a segment tree over its pre-tokens: a leaf holds a pre-token's length and its token count, an inner
node their sums.  An edit finds the pre-tokens that it touches by descending on lengths, re-splits only these and as much
text around them as the split depends on, and replaces their leaves; only the sums above those change.

Splitting looks at little context: a pre-token can depend on the one before it (a space joins the next word, white space is cut
according to what follows) and never reaches further back.  So re-splitting starts two pre-tokens before the edit, and ends
as soon as a boundary beyond it is an old boundary after which the text splits as before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secret_scan import encoding
from .textops import slices

#: Pre-tokens before an edit that are split anew.
BACK = 2
#: Pre-tokens that a task remembers the counts of.
REMEMBERED = 400_000
#: Characters that are split at first beyond an edit; doubled until the split falls into step.
AHEAD = 64


class Counter:
    """Token counts of single pre-tokens."""

    def __init__(self, coder: tiktoken.Encoding, pattern: str):
        self.coder, self.split, self.known = coder, regex.compile(pattern).findall, {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.coder.encode_ordinary(piece))
        return n


class SegmentTree:
    """Sums of lengths and token counts over a sequence of leaves; replacing leaves rebuilds what lies above them only.

    The leaves are kept in runs of about ``RUN``; each run is a leaf of a balanced tree of sums over runs.
    """

    RUN = 64

    def __init__(self, pieces: list[str], counts: list[int]):
        self.runs = [(pieces[i : i + self.RUN], counts[i : i + self.RUN]) for i in range(0, len(pieces), self.RUN)] or [([], [])]
        self._grow()

    def _grow(self) -> None:
        self.size = 1 << (len(self.runs) - 1).bit_length()
        self.length, self.tokens = np.zeros(2 * self.size, dtype=np.int64), np.zeros(2 * self.size, dtype=np.int64)
        for i, (pieces, counts) in enumerate(self.runs):
            self.length[self.size + i], self.tokens[self.size + i] = sum(map(len, pieces)), sum(counts)
        for i in range(self.size - 1, 0, -1):
            self.length[i], self.tokens[i] = self.length[2 * i : 2 * i + 2].sum(), self.tokens[2 * i : 2 * i + 2].sum()

    def total(self) -> tuple[int, int]:
        return int(self.length[1]), int(self.tokens[1])

    def find(self, at: int) -> tuple[int, int, int]:
        """Run, leaf within it, and start of the leaf that holds character ``at``; beyond the end the last leaf."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.length[node] and self.length[node + 1] > 0:
                start += int(self.length[node])
                node += 1
        run = min(node - self.size, len(self.runs) - 1)
        pieces = self.runs[run][0]
        for leaf, piece in enumerate(pieces):
            if at < start + len(piece) or leaf == len(pieces) - 1:
                return run, leaf, start
            start += len(piece)
        return run, 0, start

    def back(self, run: int, leaf: int, start: int, steps: int) -> tuple[int, int, int]:
        """The leaf ``steps`` before, or the first."""
        while steps and (run or leaf):
            if leaf:
                leaf -= 1
            else:
                run -= 1
                while run and not self.runs[run][0]:
                    run -= 1
                leaf = len(self.runs[run][0]) - 1
            if leaf < 0:
                return run, 0, start
            start -= len(self.runs[run][0][leaf])
            steps -= 1
        return run, leaf, start

    def text(self, start: int, end: int) -> str:
        """Characters ``start`` to ``end``."""
        run, leaf, at = self.find(start)
        out, skip = [], start - at
        while run < len(self.runs) and at < end:
            for piece in self.runs[run][0][leaf:]:
                out.append(piece)
                at += len(piece)
                if at >= end:
                    break
            run, leaf = run + 1, 0
        return "".join(out)[skip : skip + end - start]

    def replace(self, first: tuple[int, int], last: tuple[int, int], pieces: list[str], counts: list[int]) -> None:
        """Puts new leaves in the place of those from ``first`` to before ``last`` (run and leaf)."""
        (r, i), (s, j) = first, last
        head, tail = self.runs[r], self.runs[s]
        merged = (head[0][:i] + pieces + tail[0][j:], head[1][:i] + counts + tail[1][j:])
        if len(merged[0]) > 4 * self.RUN:
            parts = [(merged[0][k : k + self.RUN], merged[1][k : k + self.RUN]) for k in range(0, len(merged[0]), self.RUN)]
            self.runs[r : s + 1] = parts
            self._grow()
            return
        self.runs[r] = merged
        for k in range(r + 1, s + 1):
            self.runs[k] = ([], [])
        for k in range(r, s + 1):
            node = self.size + k
            self.length[node], self.tokens[node] = sum(map(len, self.runs[k][0])), sum(self.runs[k][1])
            while node > 1:
                node //= 2
                self.length[node], self.tokens[node] = self.length[2 * node] + self.length[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]


def apply_edit(tree: SegmentTree, counter: Counter, start: int, end: int, new: str) -> int:
    """Replaces characters ``start`` to ``end`` by ``new``; returns how many characters were encoded anew."""
    size = tree.total()[0]
    start = min(max(0, start), size)
    end = min(max(start, end), size)
    run, leaf, begin = tree.back(*tree.find(start), BACK)
    ahead = AHEAD
    while True:
        stop = min(size, end + ahead)
        region = tree.text(begin, start) + new + tree.text(end, stop)
        pieces = counter.split(region)
        shift = len(new) - (end - start)
        if stop == size:
            last = (len(tree.runs) - 1, len(tree.runs[-1][0]))
            kept = len(pieces)
            break
        # boundaries of the new split beyond the edit, in old places; the last two pieces may yet change
        edge, place, found = begin, 0, None
        for place, piece in enumerate(pieces[: max(0, len(pieces) - BACK)], 1):
            edge += len(piece)
            old = edge - shift
            if edge >= start + len(new) and old >= end:
                at = tree.find(old)
                if at[2] == old and old < size and not (region[edge - begin - 1].isspace()):
                    found = at
                    break
        if found is not None:
            last, kept = (found[0], found[1]), place
            break
        ahead *= 2
    tree.replace((run, leaf), last, pieces[:kept], [counter.count(p) for p in pieces[:kept]])
    return sum(map(len, pieces[:kept]))


def redactions(text: Column) -> Column:
    """Edits ``array<struct<start,end,new>>`` that replace e-mail and IPv4 addresses, null for most texts without any; places
    count in code points."""
    pattern = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\b\d{1,3}(?:\.\d{1,3}){3}\b"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the text before each match ends where the pieces between matches, and the matches before it, end
    between = F.split(text, pattern, -1)
    starts = F.transform(found, lambda _, i: F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda a, x: a + F.length(x)))
    edits = F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), F.when(m.contains("@"), "[email]").otherwise("[address]").alias("new")))
    return F.when(text.rlike(r"@|\d\.\d"), edits)  # most texts need no closer look


def count_with_edits(docs: DataFrame, edits: Column, id_column: str = "doc_id", text_column: str = "text", ranks_path: str | None = None) -> DataFrame:
    """Token counts of every text before and after its edits.

    ``edits`` is an ``array<struct<start int, end int, new string>>``; places are code points of the original text, and edits
    must not overlap (one that begins inside an earlier one is moved behind it).  Returns ``doc_id, n_tokens, n_edits, n_tokens_after,
    n_chars_after, n_reencoded``: ``n_reencoded`` counts the characters that edits caused to be split and encoded again.

    A null or empty text has no tokens, and edits to it insert; null edits are none, places beyond the end are the end, a null
    ``new`` deletes.  Null and repeated ids pass through row by row; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = Counter(encoding(ranks_path), public_tokenizers.PATTERN)
        count = counter.count
        for batch in slices(batches):
            out: list[list[int]] = [[] for _ in range(5)]
            for text, todo in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist()):
                pieces = counter.split(text or "")
                counts = [count(p) for p in pieces]
                before, again, after = sum(counts), 0, (len(text or ""), sum(counts))
                todo = sorted((e["start"] or 0, e["end"] or 0, e["new"] or "") for e in todo or () if e is not None)
                if todo:
                    tree, shift, done = SegmentTree(pieces, counts), 0, 0
                    for start, end, new in todo:
                        start = min(max(start, done), len(text or ""))
                        end = min(max(end, start), len(text or ""))
                        again += apply_edit(tree, counter, start + shift, end + shift, new)
                        shift, done = shift + len(new) - (end - start), end
                    after = tree.total()
                for column, value in zip(out, (before, len(todo), after[1], after[0], again)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_reencoded"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), edits.cast("array<struct<start:int,end:int,new:string>>").alias("edits"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_reencoded long")
