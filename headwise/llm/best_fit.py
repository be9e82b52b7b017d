"""Best-fit decreasing packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing treats documents of equal length alike, so it needs only the number of documents of each length (at most
``capacity`` numbers). The driver runs it on those counts: lengths descending, and for each the tightest open bin is found
in a segment tree over remaining capacities in logarithmic time. Bins with the same history are kept as ranges of sequence
numbers, so placing a million documents of one length costs as much as placing one. The outcome is a short list of
placement rules (documents number lo to hi of a length go to sequences from a number on, at an offset). Spark numbers the
documents of each length by counting in buckets and applies the rules; no document passes through the driver.

Defined results: null and empty texts are the end token alone; a document longer than the capacity is cut into pieces of
exactly the capacity, the first of which may be shorter; texts are read whole, however long; repeated rows are packed each; an
empty table gives an empty result; of ``docs`` only doc_id and text are read, whatever other columns there are; ties
between bins of equal room go to the one opened or filled earliest in the run of the algorithm.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwise.llm.common import release_memory, spaced_words, worker_state
from headwise.sources.staging import stage

CAPACITY = 2048
END_ID = 0
CACHED_WORDS = 75_000  # in each of two generations


class RoomTree:
    """Segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, room: int, value: bool) -> None:
        i = room + self.size
        self.open[i] = value
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest capacity >= need with an open bin."""
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_rules(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first sequence, offset, documents per sequence) for every run of equal placements. Document number
    ``o`` of a length, lo <= o < hi, goes to sequence first + (o - lo) div per, at offset + ((o - lo) mod per) * length."""
    tree, ranges = RoomTree(capacity), [deque() for _ in range(capacity + 1)]
    rules, opened = [], 0

    def give(room: int, first: int, bins: int) -> None:
        if room and bins:
            ranges[room].append((first, bins))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                first, bins = opened, -(-(total - done) // (capacity // length))
                opened += bins
            else:
                first, bins = ranges[room].popleft()
                if not ranges[room]:
                    tree.set(room, False)
            per = room // length  # a bin filled once more is the tightest again, until the length no longer fits
            taken = min(total - done, bins * per)
            rules.append((length, done, done + taken, first, capacity - room, per))
            full, rest = divmod(taken, per)
            give(room - per * length, first, full)
            if rest:
                give(room - rest * length, first + full, 1)
            give(room, first + full + bool(rest), bins - full - bool(rest))
            done += taken
    return rules


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies show bytes: printable Latin-1 ones themselves, the others in order from
    U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merge_ranks(tokenizer_path: str) -> dict[bytes, int] | None:
    """Token bytes and ids of a plain byte-level BPE file whose ids follow the order of its merges, so that the id of a token is
    also its rank; None for any other file."""
    with open(tokenizer_path, encoding="utf-8") as held:
        file = json.load(held)
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(
        model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or file.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    vocabulary, bytes_of = model["vocab"], byte_characters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocabulary[x + y] for x, y in pairs]
    special = {t["content"] for t in file.get("added_tokens", [])}
    if order != sorted(order) or len(set(order)) != len(order) or len(vocabulary.keys() - special) != len(order) + 256:
        return None
    return {bytes(bytes_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}


class WordIds:
    """Ids of words with a blank in front, as bytes, with a cache of two generations: when the younger one is full it becomes the
    older one, and words found there move up, so frequent words stay and memory is bounded.

    A plain byte-level BPE file is read as ranks, which gives the ids of the ``tokenizers`` library at a third of its time; any
    other file goes through that library."""

    def __init__(self, tokenizer_path: str, ranks: dict[bytes, int] | None):
        import os

        if ranks is not None:
            import public_tokenizers
            import tiktoken

            self.encode = tiktoken.Encoding(
                "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            opening = [i for token, i in ranks.items() if token.startswith(b" ")]
        else:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            library = Tokenizer.from_file(tokenizer_path)
            library.encode_special_tokens = True
            self.encode = lambda text: library.encode_batch_fast([text], add_special_tokens=False)[0].ids
            opening = [i for token, i in library.get_vocab().items() if token.startswith("\u0120")]
        self.opens = np.zeros(max(opening, default=0) + 1, dtype=bool)  # tokens that begin with a blank
        self.opens[opening] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """A blank before a word always starts a token, and in a word without blanks no other token begins with one: so the ids
        of many words come from one call and are cut at those tokens."""
        out = {w: self.whole(" " + w) for w in words if not w or " " in w}
        plain = [w for w in words if w not in out] if out else words
        if plain:
            ids = np.array(self.encode(" " + " ".join(plain)), dtype="<u4")
            cuts = np.flatnonzero((ids < len(self.opens)) & self.opens[np.minimum(ids, len(self.opens) - 1)]).tolist()
            if len(cuts) != len(plain):  # a tokenizer that does not start a token at every blank before a word
                return out | {w: self.whole(" " + w) for w in plain}
            data = ids.tobytes()
            out.update(zip(plain, [data[4 * a:4 * b] for a, b in zip(cuts, [*cuts[1:], len(ids)])]))
        return out

    def of(self, words: list[str]) -> list[bytes]:
        found = list(map(self.young.get, words))
        if None not in found:
            return found
        missing = {w for w, ids in zip(words, found) if ids is None}
        new = {w: self.old[w] for w in missing if w in self.old}
        new.update(self._fresh([w for w in missing if w not in new]))
        if len(self.young) + len(new) > CACHED_WORDS:
            self.young, self.old = {}, self.young
        if len(new) <= CACHED_WORDS:
            self.young.update(new)
        return [new[w] if ids is None else ids for w, ids in zip(words, found)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit numbers) of every piece. Words are encoded with
    the tokenizer (special-token strings in a text are ordinary text) and kept in a bounded cache in each worker."""
    end = np.array([end_id], dtype="<u4").tobytes()
    # read once here, as parsing the file takes each worker more memory than the ranks (one per token of the vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(merge_ranks(tokenizer_path))

    def cut(batches):
        known = worker_state("tokenizer " + tokenizer_path, lambda: WordIds(tokenizer_path, shared.value))

        def ids_of(text: str | None) -> bytes:
            if not text:
                return end
            first, *rest = spaced_words(text)
            return b"".join([known.whole(first), *known.of(rest), end])

        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            at, piece, start, length, ids, held = [], [], [], [], [], 0
            for i, text in enumerate(texts):
                coded = ids_of(text)
                n = len(coded) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(coded[4 * a:4 * b])
                held += len(coded)
                if held > 4 << 20 or i == len(texts) - 1:
                    yield pa.record_batch(
                        [keys.take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                         pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                        names=["doc_id", "piece", "start", "length", "ids"])
                    at, piece, start, length, ids, held = [], [], [], [], [], 0
        release_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length and any further columns) with sequence_id and offset. The pieces are written once and read twice:
    to count them by length and bucket, and to place them."""
    spark = pieces.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = pieces.columns
    held = stage(pieces.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")), "pieces")
    by_bucket = held.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r.length: r.n for r in by_bucket.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_bucket.select(
        F.col("length").alias("_length"), F.col("_bucket").alias("_base_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rules = spark.createDataFrame(
        best_fit_rules(counts, capacity), "_l bigint, _lo bigint, _hi bigint, _first bigint, _at bigint, _per bigint")
    within = Window.partitionBy("length", "_bucket").orderBy(*[c for c in columns if c != "length"])
    numbered = held.withColumn("_row", F.row_number().over(within)).join(
        bases, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_base_bucket"))).withColumn(
        "_o", F.col("_base") + F.col("_row") - 1)
    placed = numbered.join(  # the rules depend on the lengths in use, at most ``capacity``, not on the documents
        F.broadcast(rules), (F.col("length") == F.col("_l")) & (F.col("_o") >= F.col("_lo")) & (F.col("_o") < F.col("_hi")))
    step = F.col("_o") - F.col("_lo")
    return placed.select(
        *columns, (F.col("_first") + F.floor(step / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_at") + step % F.col("_per") * F.col("length")).cast("long").alias("offset"))
