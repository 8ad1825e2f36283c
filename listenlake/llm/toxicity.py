"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier trained on its labels.

Cues are words and word beginnings (4 to 7 bytes, for inflected forms).  Some are fixed; others are mined from labelled rows: those
far more frequent in toxic texts than in others.  Lexicons of cues and counting patterns make up the voters, which vote toxic or
abstain.  How often each combination of votes occurs among all documents is what the generative model sees: EM estimates each
voter's rates in both classes, and from what is left the correlations within a class, by which voters that repeat each other are
discounted.  A logistic classifier over the cues is then trained on the posterior of each text's votes, and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settled
from .textops import LETTERS, mix, shingles, slices, text_bytes, word_hashes, word_spans

#: Fixed lexicons, one voter each.
LEXICONS = (
    ("idiot", "moron", "imbecile", "dumb", "stupid", "fool"),
    ("loser", "clown", "pathetic", "worthless", "useless"),
    ("scum", "trash", "garbage", "vermin", "filth", "disgusting"),
    ("bastard", "bitch", "asshole", "fuck", "fucking", "shit"),
)
#: Bytes of the word beginnings that can be cues; 0 stands for whole words.  One voter each.
KINDS = (0, 4, 5, 6, 7)
#: Voters after these: two different cues, and a cue in every 60 words.
VOTERS = len(LEXICONS) + len(KINDS) + 2

#: Bounds: labelled rows that cues are mined from and the classifier is trained on, and mined cues.
LABELLED_ROWS, MINED_CUES = 20_000, 4096
#: A mined cue occurs in so many toxic texts at least, and its log odds ratio is as high as this.
LEAST_TEXTS, LEAST_ODDS = 4, 3.0

_TAGS = mix(np.arange(50, 50 + len(KINDS), dtype=np.uint64))


def _features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind its number, the feature hashes, the text of each, and the text of each word."""
    starts, ends, owner = word_spans(data, at, LETTERS)
    if not len(starts):
        return
    for number, (kind, tag) in enumerate(zip(KINDS, _TAGS)):
        some = np.ones(len(starts), dtype=bool) if kind == 0 else ends - starts > kind
        if some.any():
            yield number, word_hashes(data, starts[some], ends[some] if kind == 0 else starts[some] + kind) ^ tag, owner[some], owner


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature, its kind, toxic texts and other texts with it, for each slice."""
    for batch in slices(batches):
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
        for kind, value, owner, _ in _features(*text_bytes(batch.column("text"))):
            order = np.lexsort((value, owner))
            value, owner = value[order], owner[order]
            once = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
            feature, where = np.unique(value[once], return_inverse=True)
            pos = np.bincount(where, weights=toxic[owner[once]], minlength=len(feature)).astype(np.int64)
            neg = np.bincount(where, minlength=len(feature)) - pos
            yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(np.full(len(feature), kind, np.int32)), pa.array(pos), pa.array(neg)], names=["feature", "kind", "pos", "neg"])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number and two sums of the distinct shingle hashes of each text, which only copies share."""
    for batch in slices(batches):
        data, at = text_bytes(batch.column("text"))
        starts, ends, owner = word_spans(data, at, LETTERS)
        size, one, two = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
        if len(starts):
            value, of = shingles(word_hashes(data, starts, ends), owner, batch.num_rows, 3)
            edges = np.searchsorted(of, np.arange(batch.num_rows + 1)).tolist()
            for i, (begin, end) in enumerate(zip(edges, edges[1:])):
                own = np.unique(value[begin:end])
                size[i], one[i], two[i] = len(own), own.sum(), mix(own).sum()
        digest = [pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("toxic"), *digest], names=["doc_id", "text", "toxic", "n", "d1", "d2"])


class Cues:
    """All cues in hash order, with the voter of each."""

    def __init__(self, mined: np.ndarray, mined_kind: np.ndarray):
        fixed = [(word, voter) for voter, lexicon in enumerate(LEXICONS) for word in lexicon]
        data, at = text_bytes(pa.array([word for word, _ in fixed]))
        hashes = word_hashes(data, at[:-1], at[1:]) ^ _TAGS[0]
        value, voter = np.concatenate([hashes, mined]), np.concatenate([np.array([v for _, v in fixed]), len(LEXICONS) + mined_kind])
        self.hash, first = np.unique(value, return_index=True)
        self.voter = voter[first].astype(np.int64)
        self.known = np.zeros(1 << 16, dtype=bool)
        self.known[(self.hash >> np.uint64(48)).astype(np.int64)] = True

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, cue and number for each cue of each text, in text order, and the words of each text."""
        rows, cues = [], []
        words = np.zeros(len(column), dtype=np.int64)
        for _, value, owner, all_words in _features(*text_bytes(column)):
            words = np.bincount(all_words, minlength=len(column))
            maybe = np.flatnonzero(self.known[(value >> np.uint64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hash, value[maybe]), len(self.hash) - 1)
            same = self.hash[place] == value[maybe]
            rows.append(owner[maybe[same]])
            cues.append(place[same])
        if not rows:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, words
        both, number = np.unique(np.concatenate(rows) * len(self.hash) + np.concatenate(cues), return_counts=True)
        return both // len(self.hash), both % len(self.hash), number, words

    def votes(self, row: np.ndarray, cue: np.ndarray, number: np.ndarray, words: np.ndarray) -> np.ndarray:
        """A bit for each voter that votes toxic, for each text."""
        mask = np.zeros(len(words), dtype=np.int64)
        np.bitwise_or.at(mask, row, np.int64(1) << self.voter[cue])
        n, whole = len(LEXICONS) + len(KINDS), self.voter[cue] <= len(LEXICONS)
        mask[np.bincount(row[whole], minlength=len(words)) >= 2] |= 1 << n
        cues = np.bincount(row, weights=number, minlength=len(words))
        mask[(cues > 0) & (60 * cues >= words)] |= 1 << (n + 1)
        return mask


def label_model(masks: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, dict]:
    """Posterior probability of toxicity for each combination of votes, and the estimated rates, correlations and weights."""
    votes = (masks[:, None] >> np.arange(VOTERS)) & 1
    share = count / count.sum()
    posterior = np.array([0.001, 0.3, 0.9])[np.minimum(2, votes.sum(1))]
    weight = np.ones(VOTERS)

    def classes() -> list[np.ndarray]:
        return [share * (1 - posterior), share * posterior]

    def step() -> tuple[np.ndarray, float, np.ndarray]:
        # as if each class had also been seen in a few texts at the rates expected of a careful voter
        rate = np.array([(p @ votes + 1e-3 * guess) / (p.sum() + 1e-3) for p, guess in zip(classes(), (0.002, 0.3))])
        rate = np.clip(rate, 1e-5, 1 - 1e-5)
        prior = float(np.clip((share * posterior).sum(), 1e-4, 0.5))
        on, off = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
        odds = np.log(prior / (1 - prior)) + (votes * on + (1 - votes) * off) @ weight
        return rate, prior, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    for _ in range(rounds):
        rate, prior, posterior = step()
    within = np.zeros((VOTERS, VOTERS))
    for p, r in zip(classes(), rate):
        within += ((votes - r) * p[:, None]).T @ (votes - r)
    spread = np.sqrt(np.maximum(np.diag(within), 1e-12))
    correlation = np.clip(within / np.outer(spread, spread), -1, 1)
    weight = 1 / (1 + np.maximum(correlation - np.eye(VOTERS), 0).mean(1))
    rate, prior, posterior = step()
    return posterior, {"rates": rate, "prior": prior, "correlations": correlation, "weights": weight}


def _train(row: np.ndarray, cue: np.ndarray, value: np.ndarray, target: np.ndarray, cues: int, rounds: int = 400) -> np.ndarray:
    """Weights of a logistic classifier, the bias last, by gradient steps scaled per weight."""
    weight, step = np.zeros(cues + 1), np.full(cues + 1, 1e-8)
    for _ in range(rounds):
        odds = np.bincount(row, weights=value * weight[cue], minlength=len(target)) + weight[-1]
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target
        slope = np.r_[np.bincount(cue, weights=value * error[row], minlength=cues), error.sum()] / len(target) + 1e-6 * weight
        step += slope**2
        weight -= 0.5 * slope / np.sqrt(step)
    return weight


class ToxicityModel:
    """Cues and the classifier's weights."""

    def __init__(self, cues: Cues, weight: np.ndarray, label: dict):
        self.cues, self.weight, self.label = cues, weight, label

    def score(self, text: Column) -> Column:
        """Probability of toxicity, from 0 to 1; a null or empty text gets that of a text without cues."""
        cues, weight = self.cues, self.weight

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            out = []
            for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
                row, cue, number, _ = cues.counts(part.column("text"))
                odds = np.bincount(row, weights=np.log1p(number) * weight[cue], minlength=part.num_rows) + weight[-1]
                out.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

        return score(text)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> ToxicityModel:
    """A model from texts and from ``labels (doc_id, toxic)``, of which ``LABELLED_ROWS`` at most, in hash order, are read.

    Only the cues are learnt from labels.  Null labels, ids and texts teach nothing; labelled texts with one and the same
    set of word shingles count once.  Without any toxic label the fixed lexicons remain; without documents every text scores like one without cues.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    labels = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    some = F.broadcast(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS))
    kind = rows.schema["doc_id"].dataType.simpleString()
    examples = rows.where("text is not null").join(some, "doc_id").select("doc_id", "text", "toxic").mapInArrow(_fingerprints, f"doc_id {kind}, text string, toxic int, n long, d1 long, d2 long")
    examples = examples.groupBy("n", "d1", "d2", "toxic").agg(F.min_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text")).select("text", "toxic")
    examples = settled(examples)
    counts = examples.mapInArrow(_mined, "feature long, kind int, pos long, neg long").groupBy("feature", "kind").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    size = examples.agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0)).alias("pos"), F.count("*").alias("n")).first()
    odds = F.log((F.col("pos") + 0.5) / (size.pos + 1)) - F.log((F.col("neg") + 0.5) / (size.n - size.pos + 1))
    best = counts.withColumn("odds", odds).where((F.col("pos") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("odds"), "feature").limit(MINED_CUES)
    mined = best.select("feature", "kind").collect()  # at most MINED_CUES rows
    cues = Cues(np.array([r.feature for r in mined], dtype=np.int64).view(np.uint64), np.array([r.kind for r in mined], dtype=np.int64))

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            mask, n = np.unique(cues.votes(*cues.counts(batch.column("text"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(mask), pa.array(n.astype(np.int64))], names=["mask", "n"])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, cue, number, words = cues.counts(batch.column("text"))
            at = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(cues.votes(row, cue, number, words)), pa.ListArray.from_arrays(at, pa.array(cue.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(number.astype(np.int32)))], names=["mask", "cues", "numbers"])

    seen = rows.select("text").mapInArrow(masks, "mask long, n long").groupBy("mask").agg(F.sum("n").alias("n")).orderBy("mask").collect()  # at most 2**VOTERS rows
    if not seen:
        return ToxicityModel(cues, np.r_[np.zeros(len(cues.hash)), -4.0], {})
    mask = np.array([r.mask for r in seen])
    posterior, label = label_model(mask, np.array([float(r.n) for r in seen]))
    train = examples.select("text").mapInArrow(matched, "mask long, cues array<int>, numbers array<int>").toPandas()  # at most LABELLED_ROWS rows
    train = train.iloc[sorted(range(len(train)), key=lambda i: (train["mask"].iat[i], tuple(train["cues"].iat[i]), tuple(train["numbers"].iat[i])))]  # in one order whatever the partitions
    target = posterior[np.minimum(np.searchsorted(mask, train["mask"].to_numpy(np.int64)), len(mask) - 1)]
    row = np.repeat(np.arange(len(train)), train["cues"].map(len).to_numpy(np.int64) if len(train) else 0)
    flat = [np.concatenate([*train[c], np.zeros(0, np.int64)]).astype(np.int64) for c in ("cues", "numbers")]
    weight = _train(row, flat[0], np.log1p(flat[1]), target, len(cues.hash)) if len(train) else np.r_[np.ones(len(cues.hash)), -4.0]
    return ToxicityModel(cues, weight, label)


def score_documents(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score, predicted``: row by row, null and repeated ids included."""
    scored = docs.select(F.col(id_column).alias("doc_id"), model.score(F.col(text_column)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
