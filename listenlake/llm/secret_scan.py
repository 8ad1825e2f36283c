"""Secret scanning: three fixed patterns, and a token-efficiency test for random strings.

A vocabulary trained on ordinary text spends few tokens on words and many on random characters.  Every run of 16 or more key-like
characters is encoded with the tiktoken vocabulary; at fewer than ``most`` characters a token, or nine tenths of that if it has no
digit, it is reported, unless it is a UUID, a digest of a known length, or one of the identifiers of ``known``.

Whole slices of text are screened as bytes first (runs by numpy, key words by substring search); only texts that pass are
looked at one by one, with the exact patterns, so the cost of a text without secrets is a few passes over its bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import slices, text_bytes, word_spans

#: Kinds of span in the order in which spans with one start are listed (fixed values).
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_KEYLIKE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Words one of which an assignment holds, and the mark of an access key.
_MARKS = (b"passw", b"secret", b"token", b"api")

_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Hex digits of common digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
_DIGESTS = (32, 40, 56, 64, 96, 128)

#: Share of ``most`` that holds for runs without a digit, which long ordinary words are too.  At sf0.1 (four languages) 2 of 1,111
#: such runs fall below 1.8; of random runs of 16 letters 88 % do in lower case, 98 % in capitals and 99.8 % in both.
WITHOUT_DIGITS = 0.9

_IS_HEX, _IS_KEY = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_IS_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


def encoding(path: str | None = None) -> tiktoken.Encoding:
    """A tiktoken vocabulary from a local rank file; the 50k byte-level one by default."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, kind, end) of the three fixed patterns: leftmost, not overlapping within a kind, too short ones dropped."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]


def random_spans(text: str, coder: tiktoken.Encoding, most: float, known: frozenset[str], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Key-like runs that the vocabulary encodes badly, outside the spans already found."""
    found = []
    for m in _KEYLIKE.finditer(text):
        run = m[0]
        if run in known or _UUID.fullmatch(run):
            continue
        if len(run) in _DIGESTS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", run) or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        limit = most if re.search("[0-9]", run) else WITHOUT_DIGITS * most
        if len(run) < limit * len(coder.encode_ordinary(run)):
            found.append((m.start(), 3, m.end()))
    return found


def _suspects(batch: pa.RecordBatch) -> np.ndarray:
    """Rows that may hold a span of any kind; never misses one."""
    data, at = text_bytes(batch.column("text"))
    raw = data.tobytes()
    low = raw.lower()
    hits = []
    for text, marks in ((low, _MARKS), (raw, (b"AKIA",))):
        for mark in marks:
            i = text.find(mark)
            while i >= 0:
                hits.append(i)
                i = text.find(mark, i + 1)
    rows = [np.searchsorted(at, np.array(hits, dtype=np.int64), side="right") - 1]
    starts, ends, owner = word_spans(data, at, _IS_HEX)
    rows.append(owner[ends - starts >= 24])
    starts, ends, owner = word_spans(data, at, _IS_KEY)
    rows.append(owner[ends - starts >= 16])
    return np.unique(np.concatenate(rows))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: float = 2.0, known: frozenset[str] = frozenset(), ranks_path: str | None = None) -> DataFrame:
    """Secrets in every text: one row per document.

    Returns ``doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans``; a span reads ``kind:start:end`` in code points,
    its end exclusive, and spans are listed by start, then kind.  ``base_spans`` are those of the three fixed patterns; ``spans``
    are these and the random strings of fewer than ``most`` characters a token (``WITHOUT_DIGITS`` of that for runs without a digit).
    A null or empty text has none.  Null and repeated ids pass through row by row; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks_path)
        for batch in slices(batches):
            counts, first, all_ = np.zeros((4, batch.num_rows), dtype=np.int64), [""] * batch.num_rows, [""] * batch.num_rows
            texts = batch.column("text")
            for i in _suspects(batch).tolist():
                text = texts[i].as_py() or ""
                base = base_spans(text)
                more = random_spans(text, coder, most, known, base)
                for _, kind, _ in base + more:
                    counts[kind, i] += 1
                first[i], all_[i] = _listed(base), _listed(base + more)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts), pa.array(first, pa.string()), pa.array(all_, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string")
