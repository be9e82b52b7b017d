"""Quality: random-indexing word vectors pooled per document, a two-layer numpy network, temperature-calibrated output.

Words are runs of letters, digits and non-ASCII bytes, or runs of other visible ASCII, hashed to ``2 ** BITS`` rows. Every
row has a sparse random index vector; a word's vector is the sum of the index vectors of the words up to ``WINDOW``
positions to either side, over all documents (mergeable integer sums, one pass), scaled to length one. A document pools
the mean and the deviation of its words' vectors, the mean product of neighbouring vectors (a text that repeats itself has
like neighbours) and the logarithm of its length; a network with one hidden layer turns that into a logit, and a
temperature fitted on held-back rows makes the logit a probability.

Defined results: null and empty texts pool to zero and score what the network gives for zero; an empty table gives an
empty result; without labelled rows of both classes every score is the share of rows labelled 1 (0.5 if none is); repeated
rows are scored each; texts are read whole. Columns other than doc_id and text are never read for a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import (
    class_counts, crc_remainder, fit_temperature, joined_bytes, sampled_texts, span_hashes, summed_arrays, text_blocks,
    wanted_labels,
)

BITS, DIM, WINDOW, NONZERO = 15, 32, 2, 4
THRESHOLD = 0.3

_CLASS = np.full(256, 2, dtype=np.uint8)  # 0 white space, 1 word bytes, 2 other visible ASCII
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


@dataclass
class QualityModel:
    vectors: np.ndarray | None
    layers: list[np.ndarray]  # feature mean, feature scale, hidden weights and bias, output weights and bias
    temperature: float
    constant: float


def index_vectors(seed: int = 11) -> np.ndarray:
    """The sparse ternary index vector of every hashed word."""
    random = np.random.default_rng(seed)
    place = random.random((1 << BITS, DIM)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    vectors = np.zeros((1 << BITS, DIM), dtype=np.int8)
    np.put_along_axis(vectors, place, random.choice(np.array([-1, 1], dtype=np.int8), place.shape), axis=1)
    return vectors


def word_rows(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words of all texts in order, number of the text each belongs to)."""
    buffer, starts, ends = joined_bytes(texts)
    kind = _CLASS[buffer]
    edge = np.flatnonzero(np.diff(kind)) + 1
    begin = np.concatenate([[0], edge])
    end = np.concatenate([edge, [len(kind)]])
    words = kind[begin] > 0
    begin, end = begin[words], end[words]
    hashed = span_hashes(buffer, begin, end) >> np.uint64(64 - BITS)
    return hashed.astype(np.int64), np.searchsorted(starts, begin, side="right") - 1


def _contexts(batches) -> np.ndarray:
    """Summed context vectors of this task's texts."""
    index = index_vectors()
    total = np.zeros((1 << BITS, DIM), dtype=np.int64)
    for _, texts in text_blocks(batches):
        words, owner = word_rows(texts)
        if len(words) < 2:
            continue
        own = index[words].astype(np.int16)
        around = np.zeros_like(own)
        for step in range(1, WINDOW + 1):
            if len(words) > step:
                same = (owner[step:] == owner[:-step]).astype(np.int16)[:, None]
                around[step:] += own[:-step] * same
                around[:-step] += own[step:] * same
        order = np.argsort(words, kind="stable")
        ranked = words[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        total[ranked[first]] += np.add.reduceat(around[order].astype(np.int32), first, axis=0)
    return total.ravel()


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors from the contexts of all documents; the common direction is taken out first."""
    sums = summed_arrays(docs.select("text"), _contexts, DIM << BITS).reshape(1 << BITS, DIM).astype(float)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
    used = length[:, 0] > 0
    if used.any():
        unit[used] -= unit[used].mean(axis=0)
        unit[used] /= np.maximum(np.linalg.norm(unit[used], axis=1, keepdims=True), 1e-9)
    return unit.astype("f4")


def pooled(vectors: np.ndarray, texts: list[bytes | None]) -> np.ndarray:
    """Mean and deviation of the word vectors of each text, mean product of words next to and next but one to each other,
    logarithm of the number of words; zero where a text has no word."""
    words, owner = word_rows(texts)
    out = np.zeros((len(texts), 2 * DIM + 3), dtype=np.float32)
    if len(words):
        own = vectors[words]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        count = np.diff(np.concatenate([first, [len(words)]]))[:, None]
        mean = np.add.reduceat(own, first, axis=0, dtype=np.float32) / count
        square = np.add.reduceat(own * own, first, axis=0, dtype=np.float32) / count
        out[owner[first], :DIM] = mean
        out[owner[first], DIM:2 * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
        for step in (1, 2):
            like = np.einsum("ij,ij->i", own[step:], own[:-step]) * (owner[step:] == owner[:-step])
            out[:, 2 * DIM + step - 1] = np.bincount(owner[step:], weights=like, minlength=len(texts))
        out[owner[first], 2 * DIM:2 * DIM + 2] /= count
        out[owner[first], 2 * DIM + 2] = np.log(count[:, 0])
    return out


def _network(layers: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, w1, b1, w2, b2 = layers
    return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int, epochs: int, rate: float, seed: int):
    """Two layers, log loss, Adam on minibatches."""
    random = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    p = [random.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden),
         random.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    speed, square, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = random.permutation(len(x))
        for low in range(0, len(x), 128):
            i, t = order[low:low + 128], t + 1
            h = np.tanh(x[i] @ p[0] + p[1])
            z = h @ p[2] + p[3]
            error = weight[i] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[i]) / len(i)
            back = np.outer(error, p[2]) * (1 - h * h)
            gradients = [x[i].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ error + 1e-4 * p[2], np.array([error.sum()])]
            size = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, g in enumerate(gradients):
                speed[k] = 0.9 * speed[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                p[k] = p[k] - size * speed[k] / (np.sqrt(square[k]) + 1e-8)
    return [mean, scale, *p]


def fit(docs: DataFrame, labels: DataFrame, learn_from=None, per_class: int = 6000, hidden: int = 24, epochs: int = 30,
        rate: float = 0.005, seed: int = 3) -> QualityModel:
    """Word vectors from all of ``docs``; the network from at most about ``per_class`` rows of each class of ``labels``
    (doc_id, quality) that meet ``learn_from``, the documented bound, weighted back to the class shares. One row in five is
    held back for the temperature."""
    wanted = wanted_labels(labels, "quality", learn_from)
    counts = class_counts(wanted, "quality")
    if len(counts) < 2:
        return QualityModel(None, [], 1.0, float(counts.get(1, 0) / sum(counts.values())) if counts else 0.5)
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        for batch, texts in text_blocks(batches):
            rows = pooled(shared.value, texts)
            yield pa.record_batch([batch.column("quality"), pa.array([r.tobytes() for r in rows], pa.binary())],
                                  names=["quality", "x"])

    sample, shares = sampled_texts(docs, wanted, "quality", counts, per_class)
    constant = float(counts[1] / (counts[0] + counts[1]))
    rows = sample.select("text", "quality").mapInArrow(features, "quality int, x binary").collect()
    if len({r.quality for r in rows}) < 2:
        return QualityModel(None, [], 1.0, constant)
    rows.sort(key=lambda r: (r.quality, bytes(r.x)))
    order = np.random.default_rng(seed).permutation(len(rows))
    x = np.stack([np.frombuffer(bytes(rows[i].x), dtype="<f4") for i in order]).astype(float)
    y = np.array([rows[i].quality for i in order], dtype=float)
    weight = np.where(y == 1, 1 / shares[1], 1 / shares[0])
    weight /= weight.mean()
    held = len(rows) // 5
    layers = _train(x[held:], y[held:], weight[held:], hidden, epochs, rate, seed)
    z = _network(layers, x[:held])
    temperature = fit_temperature(np.stack([np.zeros(held), z], axis=1), y[:held].astype(int))
    return QualityModel(vectors, layers, temperature, 0.5)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and the probability of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.vectors, model.layers))
    temperature, constant = model.temperature, model.constant

    def scored(batches):
        vectors, layers = shared.value
        for batch, texts in text_blocks(batches):
            if vectors is None:
                scores = np.full(len(texts), constant)
            else:
                scores = 1 / (1 + np.exp(-np.clip(_network(layers, pooled(vectors, texts)) / temperature, -40, 40)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores.astype(float), pa.float64())],
                                  names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def classify(
    docs: DataFrame, labels: DataFrame, held_out_modulus: int = 5, held_out_remainder: int = 0, threshold: float = THRESHOLD
) -> DataFrame:
    """Learn outside the held-out rows, score every row: doc_id, held_out, score, predicted."""
    held_out = crc_remainder("doc_id", held_out_modulus) == held_out_remainder
    model = fit(docs, labels, ~held_out)
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
