"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The features of a text are the distinct hashed runs of 4 to 6 bytes of its normalised form (ASCII letters lower-cased,
white space a blank). Document frequencies of every feature by class come from all labelled rows. A feature's value is its
naive Bayes log-count ratio, and only features whose ratio is large and stands out from chance are kept, all of them, so a
long text does not gather noise; a logistic regression over them, fitted on a bounded sample, gives the probability. The
driver holds a sampled row as feature numbers or as a bitmap of the kept features, whichever is smaller (32 KB a row at most),
and reads ``BLOCK_CODES`` of them at a time.

Defined results: null and empty texts have no feature and score the bias; an empty table gives an empty result; without
labelled rows of both classes every score is the share of toxic rows (0 if there are none); repeated rows are scored each
and, as learning rows, counted each; texts are read whole. Columns other than doc_id and text are never read for a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import (
    class_counts, crc_remainder, joined_bytes, marked_rows, sampled_texts, summed_arrays, text_blocks, wanted_labels,
)

BITS, ORDERS = 18, (4, 5, 6)
THRESHOLD = 0.3
MIN_Z, MIN_RATIO = 3.5, 1.0
BLOCK_CODES = 1 << 20

_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[9:14] = 32


@dataclass
class ToxicityModel:
    weights: np.ndarray  # log-count ratio times coefficient, zero for features left out
    bias: float


def gram_codes(texts: list[bytes | None]):
    """Yields, for each text, its n-gram features with repeats. A blank stands at both ends of a text."""
    buffer, starts, ends = joined_bytes([b" " + t + b" " if t else None for t in texts])
    codes = _NORMAL[buffer].astype(np.uint64)
    packed, grams = codes, []
    for order in range(2, max(ORDERS) + 1):
        packed = packed[:-1] | codes[order - 1:] << np.uint64(8 * (order - 1))
        if order in ORDERS:
            grams.append((((packed ^ np.uint64(order << 56)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    for start, end in zip(starts, ends):
        own = [g[start:end - order + 1] for g, order in zip(grams, ORDERS) if end - start >= order]
        yield np.concatenate(own) if own else np.zeros(0, dtype=np.int32)


def _tallied(batches) -> np.ndarray:
    """Document frequencies, one array per class, one behind the other."""
    total = np.zeros(2 << BITS, dtype=np.int64)
    seen = np.zeros(1 << BITS, dtype=bool)
    for batch, texts in text_blocks(batches):
        for label, codes in zip(batch.column("toxic").to_pylist(), gram_codes(texts)):
            seen[codes] = True
            at = np.flatnonzero(seen)
            seen[at] = False
            total[at + (label << BITS)] += 1
    return total


def packed_row(at: np.ndarray, size: int) -> bytes:
    """Sorted distinct numbers under ``size``: four bytes each, or a bitmap where that is smaller."""
    if 4 * len(at) <= -(-size // 8):
        return at.astype("<i4").tobytes()
    bits = np.zeros(size, dtype=bool)
    bits[at] = True
    return np.packbits(bits).tobytes()


def unpacked(held: list[np.ndarray], number: np.ndarray, size: int) -> np.ndarray:
    """The numbers of some packed rows one behind the other; ``number``: how many each has."""
    rows = [h.view("<i4") if 4 * n <= -(-size // 8) else np.flatnonzero(np.unpackbits(h, count=size))
            for h, n in zip(held, number.tolist())]
    return np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)


def row_blocks(packed: list[bytes], number: np.ndarray, size: int) -> list[tuple[int, int, list[np.ndarray]]]:
    """(first row, row behind the last, packed rows) of runs of rows with about ``BLOCK_CODES`` numbers."""
    blocks, low, total = [], 0, 0
    for i, n in enumerate([*number.tolist(), None]):
        if n is None or i > low and total + n > BLOCK_CODES:
            blocks.append((low, i, [np.frombuffer(bytes(p), dtype=np.uint8) for p in packed[low:i]]))
            low, total = i, 0
        total += n or 0
    return blocks


def fit(docs: DataFrame, labels: DataFrame, learn_from=None, per_class: int = 4000, rounds: int = 400,
        l2: float = 1e-3) -> ToxicityModel:
    """``labels``: doc_id, toxic (0/1); ``learn_from``: a condition on doc_id. Ratios come from all labelled rows; the
    regression from at most about ``per_class`` rows of each class (the documented bound), weighted back to the class
    shares."""
    wanted = wanted_labels(labels, "toxic", learn_from)
    counts = class_counts(wanted, "toxic")
    negatives, positives = counts.get(0, 0), counts.get(1, 0)
    if not negatives or not positives:
        share = positives / max(1, positives + negatives)
        return ToxicityModel(np.zeros(1 << BITS, "f4"), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    labelled = marked_rows(docs, wanted).join(wanted.hint("merge"), "doc_id").select("text", "toxic")
    both = summed_arrays(labelled, _tallied, 2 << BITS, "int32")
    without, having = both[:1 << BITS].astype(float), both[1 << BITS:].astype(float)
    ratio = np.log((having + 0.5) / (positives + 1.0)) - np.log((without + 0.5) / (negatives + 1.0))
    spread = np.sqrt(1 / (having + 0.5) + 1 / (without + 0.5))
    clear = np.where(np.abs(ratio) >= MIN_RATIO, np.abs(ratio) / spread, 0)
    kept = np.flatnonzero(clear >= MIN_Z)
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def features(batches):
        where = shared.value
        for batch, texts in text_blocks(batches):
            rows = [np.unique(p[p >= 0]) for p in (where[c] for c in gram_codes(texts))]
            yield pa.record_batch(
                [batch.column("toxic"), pa.array([len(r) for r in rows], pa.int32()),
                 pa.array([packed_row(r, len(kept)) for r in rows], pa.binary())], names=["toxic", "n", "at"])

    sample, shares = sampled_texts(docs, wanted, "toxic", counts, per_class)
    rows = sample.select("text", "toxic").mapInArrow(features, "toxic int, n int, at binary").collect()
    y = np.array([r.toxic for r in rows], dtype=float)
    number = np.array([r.n for r in rows], dtype=np.int64)
    blocks = row_blocks([r["at"] for r in rows], number, len(kept))
    del rows
    whole = unpacked(blocks[0][2], number, len(kept)) if len(blocks) == 1 else None
    scale = ratio[kept]
    weight = np.where(y == 1, 1 / shares[1], 1 / shares[0])
    weight /= weight.sum()
    coefficient, bias = np.full(len(kept), 0.05), float(np.log(positives / negatives))
    speed, speed_bias, mean2, mean2_bias = np.zeros(len(kept)), 0.0, np.zeros(len(kept)), 0.0
    for t in range(1, rounds + 1):  # Adam on the whole sample
        used, error, gradient = coefficient * scale, np.zeros(len(y)), np.zeros(len(kept))
        for low, high, held in blocks:
            column = unpacked(held, number[low:high], len(kept)) if whole is None else whole
            row = np.repeat(np.arange(high - low), number[low:high])
            z = bias + np.bincount(row, weights=used[column], minlength=high - low)
            error[low:high] = weight[low:high] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[low:high])
            gradient += np.bincount(column, weights=error[low:high][row], minlength=len(kept))
        gradient = gradient * scale + l2 * coefficient / max(1, len(kept))
        gradient_bias = float(error.sum())
        speed, speed_bias = 0.9 * speed + 0.1 * gradient, 0.9 * speed_bias + 0.1 * gradient_bias
        mean2, mean2_bias = 0.999 * mean2 + 0.001 * gradient**2, 0.999 * mean2_bias + 0.001 * gradient_bias**2
        size = 0.02 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        coefficient = coefficient - size * speed / (np.sqrt(mean2) + 1e-10)
        bias = bias - size * speed_bias / (np.sqrt(mean2_bias) + 1e-10)
    weights = np.zeros(1 << BITS, "f4")
    weights[kept] = coefficient * scale
    return ToxicityModel(weights, bias)


def score(docs: DataFrame, model: ToxicityModel, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and the probability of every whole text."""
    columns = docs.select(*carried).schema
    shared, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias

    def scored(batches):
        weights = shared.value
        used = weights != 0
        for batch, texts in text_blocks(batches):
            scores = []
            for codes in gram_codes(texts):
                z = bias + float(weights[np.unique(codes[used[codes]])].sum(dtype=float))
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
            yield pa.record_batch([*(batch.column(c) for c in carried), pa.array(scores, pa.float64())], names=[*carried, "score"])

    return docs.select(*dict.fromkeys([*carried, "text"])).mapInArrow(scored, columns.add("score", "double"))


def classify(
    docs: DataFrame, labels: DataFrame, held_out_modulus: int = 4, held_out_remainder: int = 2, threshold: float = THRESHOLD
) -> DataFrame:
    """Learn outside the held-out rows, score every row: doc_id, held_out, score, predicted."""
    held_out = crc_remainder("doc_id", held_out_modulus) == held_out_remainder
    model = fit(docs, labels, ~held_out)
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
