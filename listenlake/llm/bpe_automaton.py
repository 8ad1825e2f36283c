"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton starts as one state that loops on each of the 256 byte tokens.  Merges are compiled in order of rank, each by one
merge gadget: for the merge ``u v -> w`` the state behind ``u`` loses its ``v`` arc, every state that still has a ``u`` arc gains
a ``w`` arc, and ``w`` leads to a copy of the state behind ``v``.  States are therefore named by the token that leads to them,
and what a gadget changes is stated by three numbers: ``u``, ``v`` and the rank at which ``w`` came into being.  Writing
every arc out would take 50,000 by 50,000 cells; the compiled tables hold the gadgets, and whether an arc survived is decided by
walking the gadgets that copied it (``_open``), once, the answer being kept in the transition table.

A sequence of tokens is a path through the automaton exactly if it is the encoding of the bytes it spells, and each prefix of
a word has one such path.  Encoding reads a word once, byte by byte, through a deterministic automaton of all arc labels, whose states
say which tokens end at a byte; of these the one with an arc from the state behind the prefix before it is taken.  Decoding
emits the bytes on the arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import slices

#: The published pre-token pattern of byte-level BPE (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and arcs that a task remembers; beyond that it starts afresh, which costs time and changes nothing.
REMEMBERED = 400_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled tables of one vocabulary file."""

    def __init__(self, spec: str):
        spec, letters = json.loads(spec), _byte_letters()
        model = spec["model"]
        ids = model["vocab"]
        #: Strings that are one token wherever they stand in a text.
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.label = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.gadget: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for k, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            u, v, w = ids[left], ids[right], ids[left + right]
            self.rank.setdefault((u, v), k)
            self.gadget.setdefault(w, (u, v, k))
        self.transitions: dict[tuple[int, int], bool] = {}
        #: Every label that can be built, a character for a byte, and the tokens that end at each byte of a word, longest first.
        self.ending = ahocorasick.Automaton()
        for i, label in self.label.items():
            if len(label) == 1 or i in self.gadget:
                self.ending.add_word(label.decode("latin-1"), (i, len(label)))
        self.ending.make_automaton()
        self.label |= {i: content.encode() for content, i in self.added.items()}

    def _open(self, state: int, token: int) -> bool:
        """Whether the state behind ``state`` still has an arc for ``token`` once all gadgets are in place."""
        p, t, before = state, token, len(self.rank) + 1
        while True:
            if self.rank.get((p, t), before) < before:
                return False
            born_p, born_t = self.gadget.get(p), self.gadget.get(t)
            if p == t and born_p is not None:
                t, p, k = born_p  # one gadget made both: its state follows the right half, its arc needs the left
                before = min(before, k)
            elif born_t is not None and (born_p is None or born_t[2] > born_p[2]):
                u, v, k = born_t  # the gadget of t gave an arc to all states that had one for u
                if u == v and p == u:
                    return False
                t, before = u, min(before, k)
            elif born_p is not None:
                _, p, k = born_p  # the gadget of p copied the state behind its right half
                before = min(before, k)
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-token."""
        behind = [0] * len(word)  # the last token of the encoding of each prefix
        size = [0] * len(word)
        known, step = self.transitions.get, self._step
        for end, (token, length) in self.ending.iter(word.decode("latin-1")):
            if size[end]:
                continue
            before = end - length
            if before >= 0:
                pair = (behind[before], token)
                arc = known(pair)
                if not (step(pair) if arc is None else arc):
                    continue
            behind[end], size[end] = token, length
        out, end = [], len(word) - 1
        while end >= 0:
            out.append(behind[end])
            end -= size[end]
        return out[::-1]

    def _step(self, pair: tuple[int, int]) -> bool:
        if len(self.transitions) >= 4 * REMEMBERED:
            self.transitions.clear()
        arc = self.transitions[pair] = self._open(*pair)
        return arc

    def decode(self, ids: list[int]) -> str:
        """The text that the arcs spell; bytes that are no UTF-8 become U+FFFD."""
        return b"".join([self.label[i] for i in ids]).decode("utf-8", "replace")


class Coder:
    """Pre-splitting, and a memory of the words met so far, around one automaton."""

    def __init__(self, spec: str):
        self.automaton, self.split = Automaton(spec), regex.compile(PATTERN).findall
        self.around = regex.compile("(" + "|".join(map(regex.escape, self.automaton.added)) + ")").split if self.automaton.added else None
        self.ids: dict[str, str] = {}
        self.emitted: dict[str, bytes] = {}

    def _word(self, word: str) -> str:
        if len(self.ids) >= REMEMBERED:
            self.ids.clear()
        ids = ",".join(map(str, self.automaton.encode_word(word.encode())))
        self.ids[word] = ids
        return ids

    def encode(self, text: str) -> list[str]:
        """For each pre-token its ids, joined by commas."""
        known, added = self.ids.get, self.automaton.added
        if self.around is not None and any(x in text for x in added):
            return [part for piece in self.around(text) for part in ([str(added[piece])] if piece in added else [known(w) or self._word(w) for w in self.split(piece)])]
        return [known(word) or self._word(word) for word in self.split(text)]

    def decode(self, parts: list[str]) -> str:
        """The text of the ids of some pre-tokens."""
        known, out = self.emitted.get, []
        for part in parts:
            label = known(part)
            if label is None:
                if len(self.emitted) >= REMEMBERED:
                    self.emitted.clear()
                label = self.emitted[part] = b"".join([self.automaton.label[int(i)] for i in part.split(",")])
            out.append(label)
        return b"".join(out).decode("utf-8", "replace")


#: A worker keeps the compiled tables from task to task.
_coders: dict[str, Coder] = {}


def vocabulary(path: str | None = None) -> str:
    """The text of a byte-level vocabulary file in the tokenizers library's format."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_decode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = True) -> DataFrame:
    """Each document's token ids and the text they decode to.

    Returns ``doc_id, n_tokens, ids array<int>, decoded`` or, without ``keep_text``, ``doc_id, n_tokens, ids_sha256,
    decoded_sha256``: digests of the comma-joined ids and of the decoded text.  A null text counts as empty: no tokens, an empty
    text back.  Null and repeated ids pass through, row by row; other columns are not read.  ``path`` names the vocabulary
    file, whose few MB travel to the executors once, as a broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    name = hashlib.sha256(sent.value.encode()).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _coders:
            _coders[name] = Coder(sent.value)
        coder = _coders[name]
        for batch in slices(batches):
            counts, first, second = [], [], []
            for text in batch.column("text").to_pylist():
                parts = coder.encode(text or "")
                ids, back = ",".join(parts), coder.decode(parts)
                counts.append(ids.count(",") + 1 if parts else 0)
                if keep_text:
                    first.append([int(i) for i in ids.split(",")] if parts else [])
                    second.append(back)
                else:
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.list_(pa.int32()) if keep_text else pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", *names])

    names = ["ids", "decoded"] if keep_text else ["ids_sha256", "decoded_sha256"]
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_tokens long, " + ("ids array<int>, decoded string" if keep_text else "ids_sha256 string, decoded_sha256 string"))
