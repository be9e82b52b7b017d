"""Helpers shared by the operators: text blocks inside tasks, splits by crc32, summed arrays, bounded samples."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 18
SUM_BLOCK = 1 << 12
MARKS = 1 << 20
ODD_BLANK = re.compile(r" (?=\s|\Z)")


def crc_remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def release_memory() -> None:
    """Give freed memory of a worker back to the system: workers live on after a task and share the executor's memory."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_blocks(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of text (one row at least), so that numpy
    intermediates stay small whatever the batch size. Texts come as UTF-8 bytes, null as None."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        start = size = 0
        for i, length in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
            if i > start and size + length > limit:
                yield batch.slice(start, i - start), texts.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += length
        if batch.num_rows:
            yield batch.slice(start), texts.slice(start).to_pylist()
        del texts
    release_memory()


def joined_bytes(texts: list[bytes | None], separator: bytes = b" ") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends): the texts one after another with a separator byte behind each."""
    lengths = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths + len(separator)) - len(separator)
    buffer = np.frombuffer(separator.join(t or b"" for t in texts) + separator, dtype=np.uint8)
    return buffer, ends - lengths, ends


def fingerprint64(values: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function, vectorised."""
    x = np.asarray(values, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_CODES = fingerprint64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(base: int, length: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < length:
        steps = np.full(max(length, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        held = _POWERS[base] = np.multiply.accumulate(steps)
    return held[:length]


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hash of buffer[start:end] for each span, equal for equal bytes wherever they stand."""
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[buffer] * _powers(_BASE, len(buffer)), out=sums[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    back = _powers(inverse, len(buffer) + 1)
    lengths = (ends - starts).astype(np.uint64)
    return fingerprint64((sums[ends] - sums[starts]) * back[starts] + lengths * np.uint64(0x2545F4914F6CDD1D))


def summed_arrays(
    frame: DataFrame, tallies: Callable[[Iterable[pa.RecordBatch]], np.ndarray], size: int, dtype: str = "int64"
) -> np.ndarray:
    """Sum over all tasks of the array that ``tallies`` makes of a task's batches.

    Each task sends its array as zero-free compressed blocks; the blocks are summed by block number in Spark, each in a
    stream, and the total (``size`` numbers, a fixed bound) is what reaches the driver.
    """
    kind = np.dtype(dtype)

    def parts(batches):
        total = np.asarray(tallies(batches), dtype=kind)
        rows = [(i, total[i * SUM_BLOCK:(i + 1) * SUM_BLOCK]) for i in range(-(-size // SUM_BLOCK))]
        rows = [(i, pa.compress(x.tobytes(), codec="zstd", asbytes=True)) for i, x in rows if x.any()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                              names=["block", "packed"])

    def unpack(i: int, packed: bytes) -> np.ndarray:
        width = min(SUM_BLOCK, size - i * SUM_BLOCK)
        return np.frombuffer(pa.decompress(packed, width * kind.itemsize, codec="zstd", asbytes=True), dtype=kind)

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = unpack(i, packed)
                sums[i] = sums[i] + x if i in sums else x
        yield pa.record_batch(
            [pa.array(list(sums), pa.int32()),
             pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in sums.values()], pa.binary())],
            names=["block", "packed"])

    schema = "block int, packed binary"
    total = np.zeros(size, dtype=kind)
    for row in frame.mapInArrow(parts, schema).repartition("block").mapInArrow(added, schema).collect():
        x = unpack(row.block, bytes(row.packed))
        total[row.block * SUM_BLOCK:row.block * SUM_BLOCK + len(x)] = x
    return total


def class_counts(frame: DataFrame, label: str) -> dict:
    """Rows by label value; the labels of a classifier are few."""
    return {r[0]: r[1] for r in frame.groupBy(label).count().orderBy(label).collect()}


def bounded_sample(frame: DataFrame, label: str, counts: dict, per_class: int, *drawn_by: str) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each label value, chosen by a hash of the columns ``drawn_by``, and the share taken of each
    value."""
    shares = {value: min(1.0, per_class / n) for value, n in counts.items()}
    drawn = F.pmod(F.xxhash64(*drawn_by), F.lit(1 << 30))
    chosen = [(F.col(label) == F.lit(v)) & (drawn < F.lit(int(share * (1 << 30)))) for v, share in shares.items()]
    condition = reduce(lambda a, b: a | b, chosen) if chosen else F.lit(False)
    return frame.where(condition).limit(4 * per_class * max(1, len(shares))), shares


def wanted_labels(labels: DataFrame, label: str, learn_from: Column | None) -> DataFrame:
    """doc_id and label (0 or 1) of the labels to learn from."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias(label)).where(
        F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    return rows if learn_from is None else rows.where(learn_from)


def sampled_texts(docs: DataFrame, wanted: DataFrame, label: str, counts: dict, per_class: int) -> tuple[DataFrame, dict]:
    """Texts of a bounded sample of the wanted labels; the sample's ids (4 * per_class * classes at most) are broadcast, so no
    text is shuffled."""
    sample, shares = bounded_sample(wanted, label, counts, per_class, "doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), shares


def marked_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of docs without most rows whose id is not in ``ids``: a fixed-size bitmap of hashed ids, so that the
    exact join that follows moves few texts. It may let others pass, never stops a wanted one."""
    def tally(batches):
        total = np.zeros(MARKS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).to_numpy(), minlength=MARKS)
        return total

    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(MARKS)).cast("int")
    marks = np.packbits(summed_arrays(ids.select(place.alias("m")), tally, MARKS, "int32") > 0)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def passed(batches):
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[batch.column("m").to_numpy()]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", place.alias("m")).mapInArrow(
        passed, f"doc_id {kind}, text string, m int").select("doc_id", "text")


def fit_temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """Temperature with the least log loss of softmax(logits / T) on held-back rows."""
    if not len(logits):
        return 1.0
    best, least = 1.0, np.inf
    for t in np.exp(np.linspace(np.log(0.05), np.log(20), 121)):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), target]))
        if loss < least - 1e-12:
            best, least = float(t), loss
    return best


def worker_state(key: str, make: Callable):
    """A value made once per Python worker process and kept for its later tasks (encoders, bounded caches)."""
    import sys
    import types

    holder = sys.modules.setdefault("_headwise_worker_state", types.ModuleType("_headwise_worker_state")).__dict__
    if key not in holder:
        holder[key] = make()
    return holder[key]


def spaced_words(text: str) -> list[str]:
    """Cut a text before every blank that a non-blank character follows; the blanks themselves are left out of the parts
    but the first. The byte-level BPE pre-tokenisers here always start a new piece at such a blank, so the parts (the blank
    put back in front of all but the first) can be encoded one by one."""
    parts = text.split(" ")
    if ODD_BLANK.search(text) is None:
        return parts
    whole = [parts[0]]
    for part in parts[1:]:
        if not part or part[0].isspace():
            whole[-1] += " " + part
        else:
            whole.append(part)
    return whole
