"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A document is a bag of sentences. Sentence s has the probability p_s = sigmoid(b + the sum
of its words' weights), and the document 1 - prod(1 - p_s) (noisy-or): it is toxic if any
sentence is. Weights are fitted on labels of documents alone, by the likelihood of the
noisy-or; the sentences that offend are then those whose own p_s is high.

A word's weight is the sum of the weights of its features: the word itself and its
first 3, 4 and 5 characters, hashed. Features are chosen by how much more often they occur
in documents labelled 1: those in ``LEAST_TOXIC`` such documents or more whose z score for that
is above ``LEAST_Z``, at most ``max_features`` of them, of the highest z. Nothing but the text
enters a score.

Fitted on at most ``max_labelled`` labelled rows (a bounded sample, those of the least
hash of ``doc_id``), whose ids are what is broadcast; every document is scored, in one pass
without a shuffle. The sample's features come to the driver a part at a time and lie in
temporary files there, so that its memory doesn't grow with the length of texts.

Defined cases: a null or empty text has no sentences and score 0; rows with a null
``doc_id`` are scored, and are not held out; several labels of one id count as the
largest, null labels as none; without labels of both kinds every score is 0; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import small_batches

MAX_LABELLED, MAX_FEATURES, BUCKETS, FOLDS = 20_000, 3_000, 1 << 22, 5
#: Occurrences of features that a step of the fit has in memory at once; parts of the sample, which reach the driver one by one.
BLOCK, SAMPLE_PARTS = 1 << 16, 32
#: What a feature must have to be one: documents labelled 1 that it is in, and their surplus in standard deviations.
LEAST_TOXIC, LEAST_Z = 3, 3
SCORED = "doc_id long, held_out boolean, score double, predicted int, sentences int, offending array<struct<sentence:int,score:double>>"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features_of(word: bytes) -> list[int]:
    found = [crc32(b"w" + word) % BUCKETS]
    letters = word.decode("utf-8", "replace")
    found += [crc32(b"p%d" % n + letters[:n].encode()) % BUCKETS for n in (3, 4, 5) if len(letters) > n]
    return found


class _Weights(dict):
    """Weight of each word, worked out when it first occurs; bounded."""

    def __init__(self, weights: dict[int, float], most: int = 1_000_000):
        self.weights, self.most = weights, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        get = self.weights.get
        self[word] = value = sum(get(f, 0.0) for f in features_of(word))
        return value


@dataclass
class Model:
    bias: float = -60.0  # without a fit every score is 0
    weights: dict[int, float] = field(default_factory=dict)
    fitted: bool = False


def _in_order(doc: np.ndarray, sentence: np.ndarray) -> bool:
    for i in range(0, len(doc), BLOCK):
        d, s = np.diff(doc[i : i + BLOCK + 1]), np.diff(sentence[i : i + BLOCK + 1])
        if ((d < 0) | (d == 0) & (s < 0)).any():
            return False
    return True


def _blocks(doc: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
    """First document and the one after the last, first occurrence and the one after the last: ``BLOCK`` occurrences or one document."""
    ends = np.searchsorted(doc, np.arange(n + 1, dtype=doc.dtype))
    found, d = [], 0
    while d < n:
        last = max(d + 1, int(np.searchsorted(ends, ends[d] + BLOCK, "right")) - 1)
        found.append((d, last, int(ends[d]), int(ends[last])))
        d = last
    return found


def fit_noisy_or(labels: np.ndarray, sentences: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n_features: int, steps: int = 400, rate: float = 0.1, ridge: float = 1e-3) -> tuple[float, np.ndarray]:
    """Bias and weights that maximise the noisy-or likelihood of ``labels``.

    ``sentences``: how many each document has. The three arrays tell each occurrence of a
    feature: its document, its sentence (numbers of the whole sample), the feature.
    With z_s a sentence's logit, -log(1 - P) of a document is the sum of softplus(z_s).
    Works on ``BLOCK`` occurrences at a time, whole documents, from a temporary file, so the three
    arrays may be those of files too; they are sorted first unless they are by document and sentence.
    """
    if not _in_order(doc, sentence):
        order = np.lexsort((sentence, doc))
        doc, sentence, feature = doc[order], sentence[order], feature[order]
    theta = np.concatenate(([-6.0], np.full(n_features, 0.5)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    y = labels.astype(float)
    with tempfile.TemporaryFile() as kept:
        bare, blocks = sentences.astype(np.int64), []  # bare: sentences without any feature
        for d0, d1, i, j in _blocks(doc, len(labels)):
            opens = np.ones(j - i, bool)
            opens[1:] = (np.diff(sentence[i:j]) != 0) | (np.diff(doc[i:j]) != 0)
            owner = doc[i:j][opens] - d0
            bare[d0:d1] -= np.bincount(owner, minlength=d1 - d0)
            for numbers in (feature[i:j], np.cumsum(opens) - 1, owner):
                kept.write(numbers.astype(np.int64).tobytes())
            blocks.append((slice(d0, d1), np.cumsum([j - i, j - i, len(owner)])))
        numbers, begun = _mapped(kept, np.int64), 0
        for k, (here, ends) in enumerate(blocks):  # of a block: each occurrence's feature and sentence, each sentence's document
            blocks[k] = here, *np.split(numbers[begun : begun + ends[-1]], ends[:-1])
            begun += ends[-1]
        for t in range(1, steps + 1):
            b, w = theta[0], theta[1:]
            soft0, sig0 = np.logaddexp(0, b), 1 / (1 + np.exp(-b))
            g = np.zeros_like(theta)
            for here, which, own, owner in blocks:
                z = b + np.bincount(own, w[which], minlength=len(owner))
                soft, sig = np.logaddexp(0, z), 1 / (1 + np.exp(-z))
                a = np.bincount(owner, soft, minlength=len(y[here])) + bare[here] * soft0
                slope = y[here] / np.expm1(np.clip(a, 1e-9, 50)) - (1 - y[here])  # of the log likelihood by a
                by_z = slope[owner] * sig
                g[0] += by_z.sum() + (slope * bare[here]).sum() * sig0
                g[1:] += np.bincount(which, by_z[own], minlength=n_features)
            g /= len(y)
            g[1:] -= ridge * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(theta[0]), theta[1:]


def _training(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("label")).filter("label_id is not null and label is not null")
    known = known.groupBy("label_id").agg(F.max("label").alias("label")).filter(~held_out(F.col("label_id")))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    return docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("body")).join(F.broadcast(known), "label_id").select("label_id", "body", "label")


def _mapped(file, dtype: str) -> np.ndarray:
    """A file's numbers, read as they are asked for."""
    file.flush()
    return np.asarray(np.memmap(file, dtype, "r")) if file.tell() else np.zeros(0, dtype)


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Model:
    small_batches(docs.sparkSession)
    rows = _training(docs, labels, max_labelled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[dict, dict] = ({}, {})
        for batch in batches:
            for body, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own, into = {f for w in set(words.words(body)) for f in features_of(w)}, counts[label > 0]
                for f in own:
                    into[f] = into.get(f, 0) + 1
                into[-1] = into.get(-1, 0) + 1
        both = sorted({*counts[0], *counts[1]})
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.int64()), pa.array([counts[1].get(f, 0) for f in both], pa.int64()), pa.array([counts[0].get(f, 0) for f in both], pa.int64())], ["feature", "toxic", "clean"])

    counts = rows.mapInArrow(count, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = counts.persist()
    try:
        totals = counts.filter("feature = -1").first()
        if totals is None or not totals.toxic or not totals.clean:
            return Model()
        n1, n0 = float(totals.toxic), float(totals.clean)
        rate = (F.col("toxic") + F.col("clean")) / (n1 + n0)
        z = F.try_divide(F.col("toxic") / n1 - F.col("clean") / n0, F.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0)))  # null: in every document
        best = counts.filter(f"feature >= 0 and toxic >= {LEAST_TOXIC}").withColumn("z", F.round(z, 9)).filter(f"z > {LEAST_Z}").orderBy(F.desc("z"), "feature").limit(max_features).collect()
    finally:
        counts.unpersist()
    if not best:
        return Model()
    place = {r.feature: i for i, r in enumerate(best)}

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for body in batch.column(1).to_pylist():
                at, which, found = [], [], words.sentences(body)
                for i, sentence in enumerate(found):
                    for w in sentence:
                        if (own := near.get(w)) is None:
                            if len(near) > 500_000:
                                near.clear()
                            near[w] = own = [place[f] for f in features_of(w) if f in place]
                        at += [i] * len(own)
                        which += own
                out.append((len(found), np.array(at, "<i4").tobytes(), np.array(which, "<i4").tobytes()))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["label_id", "label", "n", "at", "which"])

    sample = rows.mapInArrow(occurrences, "label_id long, label int, n int, at binary, which binary")
    sample = sample.repartition(SAMPLE_PARTS, "label_id").sortWithinPartitions("label_id", "n", "label", "at", "which")
    labels_, n, so_far = [], [], 0
    with tempfile.TemporaryFile() as doc, tempfile.TemporaryFile() as sentence, tempfile.TemporaryFile() as feature:
        for r in sample.toLocalIterator():  # a part at a time
            at = np.frombuffer(r.at, "<i4")
            doc.write(np.full(len(at), len(n), np.int32).tobytes())
            sentence.write((at.astype(np.int64) + so_far).tobytes())
            feature.write(r.which)
            labels_.append(r.label > 0)
            n.append(r.n)
            so_far += r.n
        bias, w = fit_noisy_or(np.array(labels_, float), np.array(n, np.int64), _mapped(doc, "<i4"), _mapped(sentence, "<i8"), _mapped(feature, "<i4"), len(best))
    return Model(bias, {r.feature: float(x) for r, x in zip(best, w)}, True)


def score(docs: DataFrame, model: Model, *, offends: float = 0.5) -> DataFrame:
    """``SCORED`` for each row; ``offending`` has the sentences (numbered from 0) with p_s >= ``offends``."""
    small_batches(docs.sparkSession)
    bias, weights, fitted = model.bias, model.weights, model.fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _Weights(weights).__getitem__
        for batch in batches:
            scores, counts, spans = [], [], []
            for body in batch.column(2).to_pylist():
                found = words.sentences(body)
                counts.append(len(found))
                if not found or not fitted:
                    scores.append(0.0)
                    spans.append([])
                    continue
                z = bias + np.array([sum(map(get, s)) for s in found])
                scores.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
                p = 1 / (1 + np.exp(-z))
                spans.append([{"sentence": int(i), "score": float(p[i])} for i in np.flatnonzero(p >= offends)])
            predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            kind = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), predicted, pa.array(counts, pa.int32()), pa.array(spans, kind)], ["doc_id", "held_out", "score", "predicted", "sentences", "offending"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("body"))
    return rows.mapInArrow(run, SCORED)
