"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed character-class trigrams, words and repeated words, weighted by how few documents have each
(document frequencies come from all documents), and is projected onto the leading directions of labelled texts.  The labelled
vectors, a bounded number, travel to every task, which takes the exact cosine products of its documents with all of them, block by
block; the nearest vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import LETTERS, NOT_SPACE, mix, slices, text_bytes, word_hashes, word_spans

#: Features of each sort: character-class trigrams, words, and repetition.
TRIGRAMS, WORDS, REPEATS = 768, 252, 4
FEATURES = TRIGRAMS + WORDS + REPEATS
#: Bounds: labelled texts that are kept as neighbours, dimensions, and neighbours that vote.
NEIGHBOURS, DIMENSIONS, VOTES = 4000, 64, 15
#: Power of the similarity that weighs a vote.
SHARPNESS = 4

_CLASS = np.full(256, 9, dtype=np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0, 1, 2, 3
for _i, _c in enumerate(b" \n.,;:!?|#$%&*@/\"'()-_=+<>{}[]~^\\`"):
    _CLASS[_c] = 10 + _i
_CLASSES = int(_CLASS.max()) + 1
_SLOT = (mix(np.arange(_CLASSES**3, dtype=np.uint64)) % np.uint64(TRIGRAMS)).astype(np.int64)


def features(column: pa.Array) -> np.ndarray:
    """Counts of every feature for every text, as a dense block."""
    data, at = text_bytes(column)
    n = len(column)
    found = np.zeros(n * FEATURES)
    if len(data) > 2:
        owner = np.repeat(np.arange(n), np.diff(at))
        kind = _CLASS[data]
        whole = owner[:-2] == owner[2:]
        found += np.bincount(owner[:-2][whole] * FEATURES + _SLOT[(kind[:-2] * _CLASSES**2 + kind[1:-1] * _CLASSES + kind[2:])[whole]], minlength=n * FEATURES)
    starts, ends, of = word_spans(data, at, LETTERS)
    if len(starts):
        slot = (word_hashes(data, starts, ends) % np.uint64(WORDS)).astype(np.int64)
        found += np.bincount(of * FEATURES + TRIGRAMS + slot, minlength=n * FEATURES)
    starts, ends, of = word_spans(data, at, NOT_SPACE)
    if len(starts):
        words = word_hashes(data, starts, ends)
        for back in range(1, REPEATS + 1):
            same = (words[back:] == words[:-back]) & (of[back:] == of[:-back])
            found += np.bincount(of[back:][same] * FEATURES + TRIGRAMS + WORDS + back - 1, minlength=n * FEATURES)
    return found.reshape(n, FEATURES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in slices(batches):
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            yield part, features(part.column("text"))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's texts have each feature; the last row counts the texts."""
    seen = np.zeros(FEATURES + 1, dtype=np.int64)
    for part, count in _blocks(batches):
        seen[:-1] += (count > 0).sum(axis=0)
        seen[-1] += part.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(seen)], names=["feature", "df"])


def _weigh(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


class QualityModel:
    """Weights, directions, and the labelled vectors."""

    def __init__(self, idf: np.ndarray, directions: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.idf, self.directions, self.vectors, self.labels = idf, directions, vectors, labels

    def embed(self, count: np.ndarray) -> np.ndarray:
        x = _weigh(count, self.idf) @ self.directions
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)

    def vote(self, count: np.ndarray) -> np.ndarray:
        """Share of the nearest labelled texts' weight that has label 1."""
        if not len(self.labels):
            return np.full(len(count), 0.5)
        near = self.embed(count) @ self.vectors.T
        k = min(VOTES, len(self.labels))
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        share = (weight * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, share, self.labels.mean()), 0, 1)

    def score(self, text: Column) -> Column:
        """Probability of good quality, from 0 to 1; a null or empty text gets the share among labelled texts."""
        model = self

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            found = [model.vote(count) for _, count in _blocks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]))]
            return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

        return score(text)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> QualityModel:
    """A model from texts and from ``labels (doc_id, quality)``, of which ``NEIGHBOURS`` at most, in hash order, are kept.

    Null labels and ids teach nothing; a null text counts as empty, repeated rows each count.  Without labels every score is 0.5.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    seen = rows.select("text").mapInArrow(_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()  # FEATURES + 1 rows
    df = np.zeros(FEATURES + 1)
    df[seen["feature"]] = seen["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1
    some = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("double").alias("label")).where("doc_id is not null and label is not null")
    some = F.broadcast(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(NEIGHBOURS))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, count in _blocks(batches):
            at = pa.array(np.arange(0, count.size + 1, FEATURES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(at, pa.array(count.astype(np.float32).ravel()))], names=["doc_id", "label", "count"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    known = rows.join(some, "doc_id").select("doc_id", "text", "label").mapInArrow(counted, f"doc_id {kind}, label double, count array<float>").toArrow()  # at most NEIGHBOURS ids
    order = np.argsort(known.column("doc_id").to_numpy(), kind="stable")[:NEIGHBOURS]
    label = known.column("label").to_numpy()[order]
    count = known.column("count").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)[order].astype(np.float64) if len(order) else np.zeros((0, FEATURES))
    x = _weigh(count, idf)
    _, vectors = np.linalg.eigh(x.T @ x)
    model = QualityModel(idf, np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS]), np.zeros((0, DIMENSIONS)), label)
    model.vectors = model.embed(count)
    return model


def score_documents(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score, predicted``: row by row, null and repeated ids included."""
    scored = docs.select(F.col(id_column).alias("doc_id"), model.score(F.col(text_column)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
