"""Language identification: averaged hashed subword embeddings, a linear softmax, numpy SGD, calibrated rejection.

Every run of 1 to 4 bytes of the normalised text (letters lower-cased, everything else in ASCII a blank) is a subword; it
is hashed to one of ``2 ** BITS`` embeddings. A text is the mean of its subword embeddings; a linear softmax over the
learned languages gives the prediction. Since mean and softmax layer are linear, scoring adds up one class row per subword.

Defined results: a null text, or one without any letter, is ``und`` with score 0 and rejected; an empty table gives an
empty result; with no labelled rows every text is ``und``; repeated rows are scored each; ties go to the language that
sorts first; rows of any length are read whole. Input columns other than doc_id, text (and lang for learning) are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import bounded_sample, class_counts, crc_remainder, fit_temperature, joined_bytes, text_blocks

BITS, DIM, ORDERS = 14, 16, (1, 2, 3, 4)
UNDETERMINED = "und"

_NORMAL = np.full(256, 32, dtype=np.uint8)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # one row of class scores per subword
    bias: np.ndarray
    temperature: float
    threshold: float


def subword_counts(texts: list[bytes | None]):
    """Yields the subword counts of each text (all orders together)."""
    buffer, starts, ends = joined_bytes(texts)
    codes = _NORMAL[buffer].astype(np.uint32)
    grams, packed = [], codes
    for order in ORDERS:
        if order > 1:
            packed = packed[:-1] | codes[order - 1:] << np.uint32(8 * (order - 1))
        grams.append(((packed + np.uint32(order * 0x51ED27)) * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    for start, end in zip(starts, ends):
        own = [g[start:end - order + 1] for g, order in zip(grams, ORDERS) if end - start >= order]
        yield np.bincount(np.concatenate(own), minlength=1 << BITS) if own else None


def _features(batches):
    for batch, texts in text_blocks(batches):
        rows = []
        for counts in subword_counts(texts):
            at = np.flatnonzero(counts) if counts is not None else np.zeros(0, dtype=np.int64)
            shares = counts[at] / counts[at].sum() if len(at) else np.zeros(0)
            rows.append((at.astype("<u2").tobytes(), shares.astype("<f4").tobytes()))
        yield pa.record_batch([batch.column("lang"), pa.array([r[0] for r in rows], pa.binary()),
                               pa.array([r[1] for r in rows], pa.binary())], names=["lang", "at", "share"])


def fit(
    docs: DataFrame, lang: str = "lang", learn_from=None, per_language: int = 700, epochs: int = 12, rate: float = 40.0,
    reject_share: float = 0.001, seed: int = 7,
) -> LanguageModel:
    """Learn from at most about ``per_language`` labelled rows of each language (a documented bound on what the driver
    holds). ``learn_from`` is a condition that rows to learn from meet. One row in five of the sample is held back: it
    sets the temperature, and the rejection threshold as the ``reject_share`` quantile of its confidence (0.5 at most)."""
    known = docs.select("doc_id", "text", F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn_from is not None:
        known = known.where(learn_from)
    counts = class_counts(known, "lang")
    languages = sorted(counts)
    sample, _ = bounded_sample(known, "lang", counts, per_language, "doc_id", "text")
    rows = sample.mapInArrow(_features, "lang string, at binary, share binary").collect() if languages else []
    classes = len(languages)
    if not rows:
        return LanguageModel([], np.zeros((1 << BITS, 0), "f4"), np.zeros(0, "f4"), 1.0, 0.0)
    rows.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.share)))
    target = np.array([languages.index(r.lang) for r in rows])
    at = [np.frombuffer(bytes(r["at"]), dtype="<u2") for r in rows]
    share = [np.frombuffer(bytes(r["share"]), dtype="<f4") for r in rows]
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    held, learn = order[:len(rows) // 5], order[len(rows) // 5:]
    embedding = random.normal(0, 0.1, (1 << BITS, DIM)).astype("f4")
    softmax, bias = np.zeros((DIM, classes), "f4"), np.zeros(classes, "f4")
    weight = (1.0 / np.maximum(np.bincount(target, minlength=classes), 1))
    weight = (weight * len(rows) / classes).astype("f4")

    def dense(index):
        x = np.zeros((len(index), 1 << BITS), "f4")
        for row, i in enumerate(index):
            x[row, at[i]] = share[i]
        return x

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        learn = random.permutation(learn)
        for low in range(0, len(learn), 64):
            index = learn[low:low + 64]
            x = dense(index)
            mean = x @ embedding
            p = np.exp((z := mean @ softmax + bias) - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(index)), target[index]] -= 1
            p *= weight[target[index], None] / len(index)
            back = x.T @ (p @ softmax.T)
            softmax -= 0.1 * step * (mean.T @ p)
            bias -= 0.02 * step * p.sum(axis=0)
            embedding -= step * back
    weights = embedding @ softmax
    checked = np.concatenate([dense(held[i:i + 256]) @ weights for i in range(0, len(held), 256)] or [np.zeros((0, classes), "f4")])
    checked = checked + bias
    temperature = fit_temperature(checked, target[held])
    threshold = 0.0
    if len(held):
        z = checked / temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        threshold = float(min(0.5, np.quantile((p / p.sum(axis=1, keepdims=True)).max(axis=1), reject_share)))
    return LanguageModel(languages, weights.astype("f4"), bias, temperature, threshold)


def has_letter(text: bytes | None) -> bool:
    return text is not None and any(map(str.isalpha, text.decode("utf-8", "ignore")))


def predict(docs: DataFrame, model: LanguageModel, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred, score and accepted (false below the calibrated threshold and for ``und``)."""
    columns = docs.select(*carried).schema
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    known, temperature, threshold = model.languages, model.temperature, model.threshold

    def scored(batches):
        weights, bias = shared.value
        for batch, texts in text_blocks(batches):
            languages, scores = [], []
            for text, counts in zip(texts, subword_counts(texts)):
                if not known or counts is None or not has_letter(text):
                    languages.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                z = ((counts / counts.sum()).astype("f4") @ weights + bias).astype(float) / temperature
                p = np.exp(z - z.max())
                best = int(p.argmax())
                languages.append(known[best])
                scores.append(float(p[best] / p.sum()))
            accepted = [a != UNDETERMINED and s >= threshold for a, s in zip(languages, scores)]
            yield pa.record_batch(
                [*(batch.column(c) for c in carried), pa.array(languages, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(accepted, pa.bool_())], names=[*carried, "lang_pred", "score", "accepted"])

    return docs.select(*dict.fromkeys([*carried, "text"])).mapInArrow(
        scored, columns.add("lang_pred", "string").add("score", "double").add("accepted", "boolean"))


def identify(docs: DataFrame, held_out_modulus: int = 4, held_out_remainder: int = 2) -> DataFrame:
    """Learn outside the held-out rows, predict every row; adds held_out."""
    held_out = crc_remainder("doc_id", held_out_modulus) == held_out_remainder
    return predict(docs, fit(docs, learn_from=~held_out)).withColumn("held_out", held_out)
