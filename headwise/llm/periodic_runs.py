"""Periodic runs of words (maximal repetitions) by a dictionary of basic factors, and texts collapsed to one period per run.

Factors of one, two, four, ... words get a name each, the same name for equal factors of one document: a factor of 2L words is
named by the pair of its halves, and a factor that occurs once is dropped, so the dictionary soon ends in ordinary text. At
length L every run of period p, L <= p < 2L, shows at its first word as two occurrences of one factor p words apart, unlike
words before them. Such successors are looked up within twice the length:

* A factor without a period of L/4 or less occurs at most every L/4 words, so at most seven successors are within reach.
* Of a factor with such a period the occurrences form arithmetic progressions. They lie in a run found at a smaller length, and
  one of the two occurrences is that run's first word; so only first words of such runs look for partners, in both
  directions, a number of pairs that is linear in the text.

Each proposal is extended with the dictionary (longest lengths first) and kept if it is two periods long; of equal stretches the
smallest period stays. The work is n log n for n words, whatever the repetitions. Documents are dealt out by Spark as they are
read; nothing is shuffled, and a task holds a block of short documents or one long one.

Defined results: null and empty texts and texts of blanks have no words and no runs and collapse to the empty text; texts are
read whole, a very long one alone; repeated rows are treated each; an empty table gives an empty result; columns other than
doc_id and text are ignored, whatever their names; a null doc_id is carried through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import text_blocks

SHORTEST = 12
LEAST_PERIODS = 2
WORD = r"[^\x20\x09-\x0D]+"

RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class BasicFactors:
    """Names of the repeated factors of 2 ** k words of a sequence of numbers. A name is the first place of its factor; -1 stands
    at the places of factors that occur once."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.names: list[np.ndarray] = []
        self.sorted: list[tuple[np.ndarray, np.ndarray]] = []  # places grouped by factor, ascending within; number of the group
        at, key = np.arange(self.n), ids
        while len(at):
            at, group = self._repeated(at, key)
            if not len(at):
                break
            name = np.full(self.n, -1, dtype=np.int32)
            first = np.flatnonzero(np.diff(group, prepend=-1))
            name[at] = at[first][group]
            self.names.append(name)
            self.sorted.append((at, group))
            step = 1 << (len(self.names) - 1)
            at = np.flatnonzero(name[:self.n - step] >= 0) if step < self.n else at[:0]
            at = at[name[at + step] >= 0]
            key = name[at].astype(np.int64) * self.n + name[at + step]

    @staticmethod
    def _repeated(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        held = key[order]
        new = np.ones(len(held), dtype=bool)
        new[1:] = held[1:] != held[:-1]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        group = group[several]
        return at[order][several], np.cumsum(np.diff(group, prepend=-1) > 0) - 1

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from the places i and j > i on."""
        length = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            a, b = name[np.minimum(i + length, self.n - 1)], name[np.minimum(j + length, self.n - 1)]
            length += np.where((j + length < self.n) & (a == b) & (a >= 0), 1 << k, 0)
        return length


def _successors(at: np.ndarray, group: np.ndarray, chosen: np.ndarray, reach: int) -> tuple[list, list]:
    """Pairs of occurrences of one factor less than ``reach`` apart, from the chosen ones on, successor by successor."""
    left, right, hop = [], [], 0
    index = np.flatnonzero(chosen)
    while len(index):
        hop += 1
        index = index[index + hop < len(at)]
        index = index[(group[index + hop] == group[index]) & (at[index + hop] - at[index] < reach)]
        left.append(at[index])
        right.append(at[index + hop])
    return left, right


def _around(at: np.ndarray, group: np.ndarray, index: np.ndarray, reach: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the occurrences at ``index`` with all others of their factor less than ``reach`` away, on both sides."""
    order = group.astype(np.int64) * (n + 1) + at
    own = order[index]
    low = np.searchsorted(order, own - np.minimum(at[index], reach - 1), side="left")
    high = np.searchsorted(order, own + np.minimum(n - at[index], reach - 1), side="right")
    size = high - low
    one = np.repeat(at[index], size)
    other = at[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
    return np.minimum(one, other), np.maximum(one, other)


def runs_of(ids: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of all runs of at least ``shortest`` words and two periods, by start, then period."""
    ids = np.asarray(ids, dtype=np.int64)
    nothing = np.zeros(0, dtype=np.int64)
    factors = BasicFactors(ids)
    # two periods and ``shortest`` words: at least half of them recur a period later
    if 1 << len(factors.names) <= -(-shortest // 2) // 2 or not factors.names:
        return nothing, nothing, nothing
    n = factors.n
    start = end = period = nothing
    for k, (at, group) in enumerate(factors.sorted):
        length = 1 << k
        dense = (4 * period <= length) & (end - start >= length)
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, start[dense], 1)
        np.add.at(edge, end[dense] - length + 1, -1)
        periodic = np.cumsum(edge)[:n] > 0
        first = np.zeros(n, dtype=bool)
        first[start[dense]] = True
        left, right = _successors(at, group, ~periodic[at], 2 * length)
        more = _around(at, group, np.flatnonzero(first[at]), 2 * length, n)
        i, j = np.concatenate([*left, more[0]]), np.concatenate([*right, more[1]])
        wanted = (j - i >= length) & ((i == 0) | (ids[i - 1] != ids[j - 1]))
        pairs = np.unique(i[wanted] * n + j[wanted])
        i, j = pairs // n, pairs % n
        same = factors.common(i, j)
        whole = same >= j - i
        start = np.concatenate([start, i[whole]])
        end = np.concatenate([end, (j + same)[whole]])
        period = np.concatenate([period, (j - i)[whole]])
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.ones(len(start), dtype=bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    kept = least & (end - start >= shortest)
    start, end, period = start[kept], end[kept], period[kept]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id; runs: array of (start, length, period) in words, by start, then period; collapsed: the words that no run contains
    after its first period, joined by one space, as UTF-8 bytes."""
    def found(batches):
        for batch, texts in text_blocks(batches):
            words = [t.split() if t else [] for t in texts]
            ends = np.cumsum([len(w) for w in words])
            starts = np.concatenate([[0], ends[:-1]])
            ids = np.empty(int(ends[-1]), dtype=np.int64)  # a word's number is its first place, so no number is in two texts
            for own, a, b in zip(words, starts.tolist(), ends.tolist()):
                ids[a:b] = list(map({}.setdefault, own, range(a, b)))
            first, last, period = runs_of(ids, shortest)
            cut = np.searchsorted(first, np.concatenate([starts, ends[-1:]]))
            edge = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(edge, first + period, 1)
            np.add.at(edge, last, -1)
            kept = np.cumsum(edge)[:-1] == 0
            collapsed = []
            for k, own in enumerate(words):
                if cut[k + 1] > cut[k]:
                    own = [own[i] for i in np.flatnonzero(kept[starts[k]:ends[k]]).tolist()]
                collapsed.append(b" ".join(own))
            rows = pa.StructArray.from_arrays(
                [pa.array(first - np.repeat(starts, np.diff(cut))), pa.array(last - first), pa.array(period)],
                fields=list(RUN_TYPE))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), rows),
                 pa.array(collapsed, pa.binary())], names=["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        found, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs. In every tenth document by crc32 of its id, the words from a place on repeat those before them
    with a period, both drawn from the same number; the words are then joined by one space. Null ids count as the empty text."""
    words, key = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    number = F.crc32(key.cast("binary"))
    drawn = docs.select("doc_id", "text", number.alias("h"), F.floor(number / 10).alias("g"), F.size(words).cast("long").alias("n"))
    at = F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")
    rest = (F.col("n") - at).cast("int")
    period = (F.lit(1) + F.floor(rest / (F.lit(3) + F.col("g") % 8))).cast("int")
    unit = F.slice(words, at + 1, period)
    copies = F.flatten(F.array_repeat(unit, F.ceil(rest / period).cast("int")))
    planted: Column = F.array_join(F.concat(F.slice(words, F.lit(1), at), F.slice(copies, F.lit(1), rest)), " ")
    return drawn.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))
