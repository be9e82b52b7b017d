"""Spelling variants: words one edit apart, grouped under their most frequent form, by k-d trees over letter counts.

One inserted, deleted or replaced letter moves a word's vector of letter counts by at most two in L1 distance (by one if the
lengths differ). Vectors are held as 128 bits, up to four ones per letter, so that the L1 distance is the number of unlike bits
(letters beyond a-z share six places and counts stop at four: distances only shrink, so nothing is missed). A box of a tree
is then the AND and the OR of its vectors, and the distance to it again a count of bits.

* **Counting.** Tasks count the words of their documents and send distinct words with counts; frequent words are no hot keys.
* **Cells.** A k-d tree over length and letter counts, fitted on a bounded sample of the distinct words (``SAMPLE_WORDS``;
  it decides the cut of the work, never a result), divides all words into cells, and cells that turn out large into units by a
  hash of the word. Each word is stored in its unit and sent to the later units within distance two of it.
* **Search.** A unit builds a k-d tree per word length. Each length is searched with the words of equal length (radius two) and
  of the neighbouring lengths (radius one), pruned by boxes; words that come close are compared letter by letter.
* **Result.** Units send a count of near words and the best one for each word, not pairs. Forms are followed to their roots by
  doubling; a form is at least ``RATIO`` times as frequent, so the number of steps is bounded by the logarithm of the count.

Defined results: null and empty texts have no words; texts are read whole; repeated rows count each; an empty table gives an
empty result; columns other than doc_id and text are ignored, whatever their names; a null doc_id counts as the empty text where
letters are left out; of equally frequent near words the smallest in code-point order is the form.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import release_memory, span_hashes, text_blocks
from headwise.sources.staging import stage

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
HELD_WORDS = 300_000
CELL_WORDS, MOST_CELLS, SAMPLE_WORDS = 1 << 15, 1 << 14, 1 << 16
QUERY_ROWS, LEAF_WORDS, TILE = 1 << 17, 64, 1 << 20
PLACES, ONES = 32, 4

_LETTERS = np.full(256, 32, dtype=np.uint8)  # Latin-1: letters as they are, a-z for A-Z, a blank for the rest
_LETTERS[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[0xC0:] = np.arange(0xC0, 0x100)
_PLACE = np.zeros(256, dtype=np.int64)
_PLACE[ord("a"):ord("z") + 1] = np.arange(26)
_PLACE[0xC0:] = 26 + np.arange(0xC0, 0x100) % 6


# --- counting

def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                drop_every: int | None = None) -> DataFrame:
    """word (its letters as Latin-1 bytes, which order as code points do) and n: the lower-cased runs of letters of at least
    ``least_length`` that occur ``least_count`` times. With ``drop_every``, a run whose crc32 (behind the id and a colon) is
    divisible by it loses one letter, before the length is looked at."""
    letters = _LETTERS.tobytes()

    def rows(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def counted(batches):
        total: Counter[bytes] = Counter()
        for batch, texts in text_blocks(batches):
            for key, text in zip(batch.column("doc_id").to_pylist(), texts):
                if not text:
                    continue
                found = text.decode().encode("latin-1", "replace").translate(letters).split()
                own = Counter([w for w in found if len(w) >= least_length])
                if drop_every is not None:
                    start = zlib.crc32(b":" if key is None else f"{key}:".encode())
                    for word in list(own):
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % drop_every == 0:
                            n, at = own.pop(word), h % len(word)
                            if len(word) > least_length:
                                total[word[:at] + word[at + 1:]] += n
                for word, n in own.items():
                    total[word] += n
            if len(total) >= HELD_WORDS:
                yield rows(total)
                total.clear()
        yield rows(total)
        total.clear()
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(counted, "word binary, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- letter counts

def matrices(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, numbers of the words of that length, their letters as a matrix) of an array of binary words."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for a, b in zip(cuts, cuts[1:]):
        own, length = order[a:b], int(sizes[order[a]])
        yield length, own, data[offsets[own][:, None] + np.arange(length)]


def letter_counts(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by place, ``ONES`` at most, and the same as 128 bits in two columns."""
    n, length = letters.shape
    counts = np.zeros((n, PLACES), dtype=np.uint8)
    step = max(1, TILE // max(1, length))
    for a in range(0, n, step):
        part = _PLACE[letters[a:a + step]] + (np.arange(len(letters[a:a + step])) * PLACES)[:, None]
        whole = np.bincount(part.ravel(), minlength=len(part) * PLACES).reshape(-1, PLACES)
        counts[a:a + step] = np.minimum(whole, ONES)
    return counts, bits_of(counts)


def bits_of(counts: np.ndarray) -> np.ndarray:
    ones = (np.uint64(1) << counts.astype(np.uint64)) - np.uint64(1)
    half = PLACES // 2
    shift = (np.arange(half) * ONES).astype(np.uint64)
    return np.stack([np.bitwise_or.reduce(ones[:, k * half:(k + 1) * half] << shift, axis=1) for k in (0, 1)], axis=1)


def _box_distance(bits: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    outside = np.bitwise_count(low & ~bits) + np.bitwise_count(bits & ~high)
    return outside[:, 0] + outside[:, 1]


class LetterTree:
    """K-d tree over the letter counts of words of one length."""

    def __init__(self, counts: np.ndarray, bits: np.ndarray):
        self.order, self.bits = np.arange(len(bits)), bits
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self._add(counts, 0, len(bits))
        open_nodes = [0]
        while open_nodes:
            node = open_nodes.pop()
            a, b = self.span[node]
            if b - a <= LEAF_WORDS:
                continue
            own = self.order[a:b]
            held = counts[own]
            place = int(np.argmax(held.var(axis=0)))
            value = held[:, place]
            cut = np.sort(value)[(b - a) // 2]
            left = value < cut if value.min() < cut else value <= cut
            if left.all():
                continue  # equal vectors
            self.order[a:b] = np.concatenate([own[left], own[~left]])
            middle = a + int(left.sum())
            self.children[node] = (self._add(counts, a, middle), self._add(counts, middle, b))
            open_nodes += self.children[node]

    def _add(self, counts: np.ndarray, a: int, b: int) -> int:
        own = self.bits[self.order[a:b]]
        self.low.append(np.bitwise_and.reduce(own, axis=0))
        self.high.append(np.bitwise_or.reduce(own, axis=0))
        self.span.append((a, b))
        self.children.append(None)
        return len(self.span) - 1

    def within(self, bits: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of queries, numbers of words) of all pairs at a distance of ``radius`` or less."""
        pending = [(0, np.arange(len(bits)))] if len(bits) and len(self.bits) else []
        while pending:
            node, asked = pending.pop()
            asked = asked[_box_distance(bits[asked], self.low[node], self.high[node]) <= radius]
            if not len(asked):
                continue
            if self.children[node] is not None:
                pending += [(child, asked) for child in self.children[node]]
                continue
            a, b = self.span[node]
            for c in range(a, b, TILE >> 8):
                own = self.order[c:min(b, c + (TILE >> 8))]
                step = max(1, TILE // len(own))
                for q in range(0, len(asked), step):
                    part = asked[q:q + step]
                    unlike = np.bitwise_count(bits[part, 0][:, None] ^ self.bits[own, 0])
                    unlike += np.bitwise_count(bits[part, 1][:, None] ^ self.bits[own, 1])
                    one, other = np.nonzero(unlike <= radius)
                    if len(one):
                        yield part[one], own[other]


def one_edit(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter (equal lengths) or by one letter that the longer has more."""
    length = shorter.shape[1]
    if longer.shape[1] == length:
        return (shorter != longer).sum(axis=1) == 1
    front, back = shorter != longer[:, :length], shorter != longer[:, 1:]
    first = np.where(front.any(axis=1), front.argmax(axis=1), length)
    last = np.where(back.any(axis=1), length - 1 - back[:, ::-1].argmax(axis=1), -1)
    return last < first


class Words:
    """The words of one length of a unit or of a batch of queries."""

    def __init__(self, letters: np.ndarray, n: np.ndarray):
        self.letters, self.n, self.length = letters, n, letters.shape[1]
        self.counts, self.bits = letter_counts(letters)
        self._rank = self._tree = None

    @property
    def tree(self) -> LetterTree:
        if self._tree is None:
            self._tree = LetterTree(self.counts, self.bits)
        return self._tree

    @property
    def rank(self) -> np.ndarray:
        """Places in code-point order."""
        if self._rank is None:
            order = np.argsort(np.ascontiguousarray(self.letters).view(f"S{self.length}").ravel(), kind="stable")
            self._rank = np.empty(len(order), dtype=np.int64)
            self._rank[order] = np.arange(len(order))
        return self._rank

    def taken(self, at: np.ndarray) -> pa.Array:
        offsets = (np.arange(len(at) + 1) * self.length).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(self.letters[at].tobytes())])


def near_pairs(asked: Words, held: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers in asked, numbers in held) of the pairs one edit apart; of a set with itself, every pair once."""
    if abs(asked.length - held.length) > 1:
        return
    radius = 2 if asked.length == held.length else 1
    step = max(1, 4 * TILE // held.length)
    for one, other in held.tree.within(asked.bits, radius):
        if asked is held:
            once = one < other
            one, other = one[once], other[once]
        for a in range(0, len(one), step):
            i, j = one[a:a + step], other[a:a + step]
            if asked.length <= held.length:
                near = one_edit(asked.letters[i], held.letters[j])
            else:
                near = one_edit(held.letters[j], asked.letters[i])
            if near.any():
                yield i[near], j[near]


def _best(of: Words, at: np.ndarray, near: Words, other: np.ndarray) -> list[pa.Array]:
    """For each word of ``of`` in ``at``: how many near words it has here, and the best of them with its count."""
    order = np.lexsort((near.rank[other], -near.n[other], at))
    at, other = at[order], other[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return [of.taken(at[first]), pa.array(np.diff(np.append(first, len(at)))), pa.array(near.n[other[first]]), near.taken(other[first])]


PARTS = ["word", "near", "best_n", "best"]
PARTS_DDL = "word binary, near bigint, best_n bigint, best binary"


def _found(asked: Words, held: Words) -> Iterator[pa.RecordBatch]:
    pairs = list(near_pairs(asked, held))
    if pairs:
        one, other = (np.concatenate(side) for side in zip(*pairs))
        yield pa.record_batch(_best(asked, one, held, other), names=PARTS)
        yield pa.record_batch(_best(held, other, asked, one), names=PARTS)


def _by_length(batches: list[pa.RecordBatch]) -> dict[int, Words]:
    whole = pa.Table.from_batches(batches).combine_chunks()
    words, n = whole["word"].chunk(0), whole["n"].to_numpy()
    return {length: Words(letters, n[own]) for length, own, letters in matrices(words)}


def searched_units(batches) -> Iterator[pa.RecordBatch]:
    """Rows (unit, asks, word, n), by unit, stored words before asking ones: the near words found in each unit. Held at a time are
    the stored words of one unit and ``QUERY_ROWS`` asking ones."""
    unit, stored, asking, waiting, held = None, [], [], 0, None

    def own_words():
        return _by_length(stored) if stored else {}

    def inside(held):
        for length, words in held.items():
            yield from _found(words, words)
            if length + 1 in held:
                yield from _found(words, held[length + 1])

    def answered(held, asking):
        if asking and held:
            for length, words in _by_length(asking).items():
                for near in (length - 1, length, length + 1):
                    if near in held:
                        yield from _found(words, held[near])

    for batch in batches:
        units, asks = batch.column("unit").to_numpy(), batch.column("asks").to_numpy()
        key = units.astype(np.int64) * 2 + asks
        cuts = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            if units[a] != unit:
                if unit is not None:
                    if held is None:
                        held = own_words()
                        yield from inside(held)
                    yield from answered(held, asking)
                unit, stored, asking, waiting, held = units[a], [], [], 0, None
            part = batch.slice(a, b - a).select(["word", "n"])
            if asks[a]:
                if held is None:
                    held = own_words()
                    stored = []
                    yield from inside(held)
                asking.append(part)
                waiting += part.num_rows
                if waiting >= QUERY_ROWS:
                    yield from answered(held, asking)
                    asking, waiting = [], 0
            else:
                stored.append(part)
    if unit is not None:
        if held is None:
            held = own_words()
            yield from inside(held)
        yield from answered(held, asking)
    release_memory()


# --- cells

class Cells:
    """K-d tree over length and letter counts that divides the space of all words."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, wanted: int):
        values = np.concatenate([np.minimum(lengths, 255)[:, None].astype(np.int64), counts], axis=1)
        low = np.zeros(PLACES + 1, dtype=np.int64)
        high = np.full(PLACES + 1, ONES)
        high[0] = 1 << 30
        self.low, self.high, self.children, self.cell = [low], [high], [None], [0]
        waiting, cells = [(-len(values), 0, values)], 1
        while waiting and cells < wanted:
            _, node, own = heapq.heappop(waiting)
            cut = self._cut(own) if len(own) > 1 else None
            if cut is None:
                continue
            place, value = cut
            for side in (0, 1):
                low, high = self.low[node].copy(), self.high[node].copy()
                if side:
                    low[place] = value + 1
                else:
                    high[place] = value
                self.low.append(low)
                self.high.append(high)
                self.children.append(None)
                self.cell.append(self.cell[node] if side == 0 else cells)
            cells += 1
            left = own[:, place] <= value
            self.children[node] = (len(self.low) - 2, len(self.low) - 1)
            for child, rows in zip(self.children[node], (own[left], own[~left])):
                heapq.heappush(waiting, (-len(rows), child, rows))
        self.number = cells
        self.box = [(int(a[0]), int(b[0]), *bits_of(np.stack([a[1:], b[1:]]))) for a, b in zip(self.low, self.high)]

    @staticmethod
    def _cut(own: np.ndarray) -> tuple[int, int] | None:
        """The cut of a balanced kind that the fewest words are close to."""
        best = None
        for place in range(own.shape[1]):
            values = np.bincount(own[:, place], minlength=2).astype(float)
            below = np.cumsum(values)[:-1] / len(own)
            near = np.convolve(values, [0.5, 1, 1, 0.5])[2:len(values) + 1] / len(own)
            uneven = np.abs(below - 0.5)
            cost = np.where((below > 0) & (below < 1), near + np.where(uneven > 0.25, 10 * uneven, uneven), np.inf)
            at = int(np.argmin(cost))
            if np.isfinite(cost[at]) and (best is None or cost[at] < best[0]):
                best = (cost[at], place, at)
        return best and best[1:]

    def reached(self, lengths: np.ndarray, bits: np.ndarray, radius: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of words, cells, distances) for every cell within the radius; a word's own cell has distance zero."""
        numbers, cells, distances = [], [], []
        pending = [(0, np.arange(len(bits)))]
        while pending:
            node, asked = pending.pop()
            shortest, longest, low, high = self.box[node]
            size = lengths[asked]
            far = _box_distance(bits[asked], low, high) + np.maximum(shortest - size, 0) + np.maximum(size - longest, 0)
            asked, far = asked[far <= radius], far[far <= radius]
            if not len(asked):
                continue
            if self.children[node] is not None:
                pending += [(child, asked) for child in self.children[node]]
                continue
            numbers.append(asked)
            cells.append(np.full(len(asked), self.cell[node]))
            distances.append(far)
        return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (numbers, cells, distances))


def _measured(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, capped counts and bits of an array of binary words."""
    lengths = np.zeros(len(words), dtype=np.int64)
    counts, bits = np.zeros((len(words), PLACES), dtype=np.uint8), np.zeros((len(words), 2), dtype=np.uint64)
    for length, own, letters in matrices(words):
        lengths[own] = length
        counts[own], bits[own] = letter_counts(letters)
    return lengths, counts, bits


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """``words``: word (distinct, binary Latin-1), n; cheap to read more than once. word, near (number of words one edit
    away), best_n and best (the most frequent of them) for every word that has any."""
    spark = words.sparkSession
    total = words.count()
    share = min(1.0, SAMPLE_WORDS / max(1, total))
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))).select("word").limit(2 * SAMPLE_WORDS)
    sample = pa.array([bytes(r.word) for r in drawn.collect()], pa.binary())
    lengths, counts, _ = _measured(sample)
    cells = Cells(lengths, counts, min(MOST_CELLS, -(-total // cell_words)))

    def homes(batches):
        found = np.zeros(cells.number, dtype=np.int64)
        for batch in batches:
            size, _, bits = _measured(batch.column("word"))
            found += np.bincount(cells.reached(size, bits, 0)[1], minlength=cells.number)
        used = np.flatnonzero(found)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(found[used], pa.int64())], names=["cell", "n"])

    size_of = np.zeros(cells.number, dtype=np.int64)
    for r in words.select("word").mapInArrow(homes, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        size_of[r.cell] = r.n
    units = np.maximum(1, -(-size_of // (2 * cell_words)))  # a cell of many equal vectors is divided by hash
    base = np.cumsum(units) - units

    def sent(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(a, 1 << 14)
                words = part.column("word")
                size, _, bits = _measured(words)
                number, cell, far = cells.reached(size, bits)
                offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
                buffer = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
                offsets = offsets - offsets[0]
                hashes = span_hashes(buffer, offsets[:-1], offsets[1:])
                own = np.zeros(len(words), dtype=np.int64)
                own[number[far == 0]] = cell[far == 0]
                own = base[own] + (hashes % units[own].astype(np.uint64)).astype(np.int64)
                many = units[cell]
                asker = np.repeat(number, many)
                unit = np.repeat(base[cell] - np.cumsum(many) + many, many) + np.arange(many.sum())
                later = unit > own[asker]
                asker, unit = asker[later], unit[later]
                at = np.concatenate([np.arange(len(words)), asker])
                asks = np.zeros(len(at), dtype=np.int32)
                asks[len(words):] = 1
                yield pa.record_batch(
                    [pa.array(np.concatenate([own, unit]).astype(np.int32)), pa.array(asks), words.take(pa.array(at)),
                     part.column("n").take(pa.array(at))], names=["unit", "asks", "word", "n"])

    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(units.sum()) // 16)
    dealt = words.select("word", "n").mapInArrow(sent, "unit int, asks int, word binary, n bigint")
    parts = dealt.repartition(width, "unit").sortWithinPartitions("unit", "asks").mapInArrow(searched_units, PARTS_DDL)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return parts.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select(
        "word", "near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


# --- forms and roots

def roots(forms: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """``forms``: word, form. word, root: the end of the chain of forms. Each step multiplies a count of two at least by
    ``ratio`` and none exceeds ``most``, which bounds the length of the chains; every round doubles what is followed."""
    steps = max(1, int(math.log(max(most, 2) / LEAST_COUNT, max(ratio, 2))) + 1)
    held = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        held = stage(held, "roots")
        onward = held.select(F.col("word").alias("middle"), F.col("root").alias("onward"))
        held = held.join(onward, F.col("root") == F.col("middle"), "left").select("word", F.coalesce("onward", "root").alias("root"))
    return held


def spelling_variants(docs: DataFrame, drop_every: int | None = None, ratio: int = RATIO, cell_words: int = CELL_WORDS) -> DataFrame:
    """word, form, root (strings), n, n_near, form_n of every word."""
    words = stage(count_words(docs, drop_every=drop_every), "words")
    near = near_words(words, cell_words)
    good = F.col("best_n") >= ratio * F.col("n")
    judged = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"),
        F.when(good, F.col("best_n")).alias("form_n")), "near-words")
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(judged.where("form is not null"), most, ratio).withColumnRenamed("word", "of")
    text = {c: F.decode(F.col(c), "ISO-8859-1") for c in ("word", "form", "root")}
    return judged.join(ends, F.col("word") == F.col("of"), "left").select(
        text["word"].alias("word"), text["form"].alias("form"),
        F.coalesce(text["root"], text["word"]).alias("root"), "n", "n_near", "form_n")
