"""Byte-level BPE encoding and decoding through a global distinct-word shuffle.

Encoding. Every task replaces the words of its documents by their places in a dictionary of the chunk of documents it is
reading (a chunk ends at ``CHUNK_WORDS`` distinct words or ``CHUNK_BYTES`` of text). Documents, now short code arrays, and
the dictionaries, exploded by word bucket, are written once, the documents bucketed by chunk. The dictionaries are shuffled by
word bucket, where each distinct word of the corpus is encoded once; the ids travel back by chunk, meet the documents of the
chunk, which are not shuffled, and are put in the order of the codes. A frequent word therefore counts once per chunk, not once per occurrence, and no task holds more
than one chunk's dictionary or one bucket's distinct words (buckets grow in number with spark.sql.shuffle.partitions).

A word is a part of the text from a blank before a non-blank character to the next such blank. The pre-tokeniser always
starts a match there, so matches never cross words; within a word every match of the pattern is encoded separately.

Decoding joins the token-byte table (one row per id of the vocabulary, a fixed size) to the ids and concatenates by place.

Defined results: null and empty texts have no ids and decode to no bytes; texts are read whole; repeated rows are encoded
each; an empty table gives an empty result; extra columns are ignored; an id that is not in the vocabulary raises an error.
"""

from __future__ import annotations

import base64
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import release_memory, spaced_words, worker_state
from headwise.sources.staging import fresh_path

CHUNK_WORDS, CHUNK_BYTES = 1 << 20, 24 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks (ids), one base64 token and number a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _pack(array: np.ndarray) -> bytes:
    data = array.tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b"", dtype=dtype)


def _pack_codes(codes: np.ndarray) -> bytes:
    """Codes below 2 ** 35 in groups of seven bits, the first group first, compressed."""
    size = sum((codes >= 1 << 7 * k for k in range(1, 5)), np.ones(len(codes), dtype=np.int64))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(5):
        own = size > k
        out[at[own] + k] = (codes[own] >> 7 * k & 127) | (size[own] > k + 1) << 7
    return _pack(out)


def _unpack_codes(data: bytes) -> np.ndarray:
    raw = _unpack(data, "u1").astype(np.int64)
    last = np.flatnonzero(raw < 128)
    at = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    codes = np.zeros(len(last), dtype=np.int64)
    for k in range(5):
        own = last - at >= k
        codes[own] |= (raw[at[own] + k] & 127) << 7 * k
    return codes


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), dtype="<u4", count=len(words))
    return _pack(np.frombuffer(np.array([len(words)], "<u4").tobytes() + lengths.tobytes() + b"".join(words), dtype=np.uint8))


def _unpack_words(data: bytes) -> list[bytes]:
    raw = _unpack(data, "u1").tobytes()
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw[4:4 + 4 * n], dtype="<u4"), dtype=np.int64) + 4 + 4 * n
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())] if n else []


def _coded(buckets: int):
    """Task function: documents as code arrays (bucket -1) and the chunk's words by bucket."""
    def code(batches):
        task = TaskContext.get().partitionId()
        number, size, places = 0, 0, {}

        def dictionary(chunk, kind):
            parts: dict[int, tuple[list, list]] = {}
            for word, place in places.items():
                data = word.encode("utf-8", "surrogatepass")
                words, slots = parts.setdefault(zlib.crc32(data) % buckets, ([], []))
                words.append(data)
                slots.append(place)
            rows = []
            for bucket, (words, slots) in parts.items():  # in order of place: steps between places are small numbers
                rows.append((bucket, _pack_words(words), _pack_codes(np.diff(np.array([-1, *slots])) - 1)))
            return pa.record_batch(
                [pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                 pa.nulls(len(rows), kind), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "bucket", "doc_id", "data", "slots"])

        kind = None
        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            kind, start, codes = keys.type, 0, []
            for i, text in enumerate(texts):
                if text:
                    words = spaced_words(text)
                    words[1:] = [" " + w for w in words[1:]]
                    codes.append(_pack_codes(np.array([places.setdefault(w, len(places)) for w in words], dtype=np.int64)))
                    size += len(text)
                else:
                    codes.append(_pack_codes(np.zeros(0, np.int64)))
                full = len(places) >= CHUNK_WORDS or size >= CHUNK_BYTES
                if full or i == len(texts) - 1:
                    n, chunk = len(codes), (task << 24) + number
                    yield pa.record_batch(
                        [pa.array([chunk] * n, pa.int64()), pa.array([-1] * n, pa.int32()), keys.slice(start, n),
                         pa.array(codes, pa.binary()), pa.nulls(n, pa.binary())],
                        names=["chunk", "bucket", "doc_id", "data", "slots"])
                    start, codes = i + 1, []
                if full:
                    yield dictionary((task << 24) + number, kind)
                    number, size, places = number + 1, 0, {}
        if places:
            yield dictionary((task << 24) + number, kind)
        places = {}
        release_memory()

    return code


def _encoder(path: str, pattern: str):
    def make():
        import tiktoken

        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})

    return make


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every document."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = f"chunk bigint, bucket int, doc_id {kind}, data binary, slots binary"
    path = fresh_path(spark, "bpe-chunks")
    docs.select("doc_id", "text").mapInArrow(_coded(buckets), chunks).withColumn(
        "part", F.when(F.col("bucket") < 0, "docs").otherwise("words")).write.partitionBy("part").bucketBy(
        buckets, "chunk").option("path", path).saveAsTable(name := f"headwise_{uuid.uuid4().hex}")
    held = spark.table(name)

    def words_to_ids(batches):
        encoder, current, known = worker_state(f"bpe {ranks_path} {pattern}", _encoder(ranks_path, pattern)), None, {}
        for batch in batches:
            rows = []
            for chunk, bucket, data, slots in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "data", "slots"))):
                if bucket != current:
                    current, known = bucket, {}
                ids = []
                for word in _unpack_words(data):
                    found = known.get(word)
                    if found is None:
                        found = known[word] = np.array(
                            encoder.encode_ordinary(word.decode("utf-8", "surrogatepass")), dtype="<u4").tobytes()
                    ids.append(found)
                lengths = np.fromiter(map(len, ids), dtype="<u4", count=len(ids)) // 4
                rows.append((chunk, _pack(np.frombuffer(b"".join(ids), "<u4")), slots, _pack(lengths)))
            yield pa.record_batch(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
                names=["chunk", "data", "slots", "lengths"])

    coded = held.where("part = 'words'").select("chunk", "bucket", "data", "slots").repartition(
        buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        words_to_ids, "chunk bigint, data binary, slots binary, lengths binary")
    def reassembled(key, documents, words):
        parts = list(zip(*(words[c].to_pylist() for c in ("data", "slots", "lengths"))))
        parts = [(_unpack(ids, "<u4"), np.cumsum(_unpack_codes(slots) + 1) - 1, _unpack(sizes, "<u4")) for ids, slots, sizes in parts]
        total, base = sum(len(p[1]) for p in parts), 0
        lengths, offsets = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for ids, at, count in parts:
            lengths[at] = count
            offsets[at] = base + np.cumsum(count, dtype=np.int64) - count
            base += len(ids)
        flat = np.concatenate([p[0] for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32)
        out = []
        for data in documents["data"]:
            codes = _unpack_codes(data.as_py())
            count = lengths[codes]
            ends = np.cumsum(count)
            out.append(flat[np.repeat(offsets[codes] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)])
        marks = np.concatenate([[0], np.cumsum([len(a) for a in out])]).astype(np.int32)
        values = pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32())
        return pa.table([documents["doc_id"], pa.ListArray.from_arrays(pa.array(marks), values)], names=["doc_id", "ids"])

    return held.where("part = 'docs'").groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(
        reassembled, f"doc_id {kind}, ids array<int>")


def decode(coded: DataFrame, ranks_path: str) -> DataFrame:
    """``coded`` (doc_id, ids) with the column decoded: the bytes of the ids in order. The token-byte table is broadcast, it
    has one row per id of the vocabulary whatever the corpus."""
    ranks = read_ranks(ranks_path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    ends = np.cumsum([len(t) for t in tokens])
    shared = coded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(tokens), np.uint8), ends))

    def joined(batches):
        flat, ends = shared.value
        starts = np.concatenate([[0], ends[:-1]])
        for batch in batches:
            ids, low = batch.column("ids"), 0
            marks = ids.offsets.to_numpy()
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(marks, marks[low] + (1 << 20), side="right")) - 1)
                high = min(high, batch.num_rows)
                own = ids.values.to_numpy()[marks[low]:marks[high]]
                size = ends[own] - starts[own]
                until = np.cumsum(size)
                data = flat[np.repeat(starts[own] - until + size, size) + np.arange(until[-1] if len(until) else 0)]
                cut = np.concatenate([[0], until])[marks[low:high + 1] - marks[low]].astype(np.int32)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(low, high - low), ids.slice(low, high - low),
                     pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(cut), pa.py_buffer(data)])],
                    names=["doc_id", "ids", "decoded"])
                low = high
        release_memory()

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(joined, f"doc_id {kind}, ids array<int>, decoded binary")
