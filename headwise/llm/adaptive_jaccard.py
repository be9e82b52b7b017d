"""Exact Jaccard join of word-shingle sets with adaptive multi-match prefixes.

All sets are ordered by one global order, estimated frequency first (a fixed-size table of counts over all documents), then
hash. Two sets of sizes n and m that must share t shingles share at least L of them within the first n - t + L and
m - t + L positions, for any L up to t. Every document picks its own L by estimated cost: a longer prefix adds postings to
read but asks for more shared ones before a pair is verified. A pair counts under the smaller L of the two.

Equal sets are one node from the start. A posting list is never turned into all its pairs: its members are first compared
with the member that has the most frequent prefix (in a group of near copies, the text they derive from). Links found that
way join most groups; only pairs whose components still differ are then looked for, completely, in the lists that still
hold more than one component. Verification is exact on the whole sets, recomputed from the text of one document per set.

The result is connectivity only: links between unlike sets inside a component that is already joined are neither looked for
nor counted, and no pairs are returned. The multi-match count decides the pairs looked for after that; pairs with the most
frequent member are verified from one shared shingle on.

Defined results: words are runs of bytes other than blank and 0x09-0x0D, A-Z lower-cased; fewer words than a shingle are
one shingle; null, empty and wordless texts have no shingle and link with nothing; rows without doc_id get their
n_shingles and no component; repeated rows are linked copies; texts are read whole, however long; an empty table gives an
empty result; extra columns are ignored, whatever their names. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import fingerprint64, joined_bytes, marked_rows, span_hashes, summed_arrays, text_blocks
from headwise.llm.components import components
from headwise.sources.staging import stage

COUNTERS = 1 << 21
LARGEST_MATCH = 4
SEEN_SETS = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLACE = fingerprint64(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def _mixed(value: int) -> np.ndarray:
    return fingerprint64(np.array([value & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))


def shingle_sets(texts: list[bytes | None], words: int):
    """Yields the sorted distinct shingle hashes of each text."""
    buffer, starts, ends = joined_bytes(texts)
    lower, blank = _LOWER[buffer], _BLANK[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    hashed = span_hashes(lower, begin, end)
    low, high = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
    rolled = np.zeros(0, dtype=np.uint64)
    if len(hashed) >= words:
        rolled = sum((hashed[i:len(hashed) - words + 1 + i] * _PLACE[i] for i in range(words)), np.zeros(1, dtype=np.uint64))
        rolled = fingerprint64(rolled)
    for a, b in zip(low.tolist(), high.tolist()):
        if b - a >= words:
            yield np.unique(rolled[a:b - words + 1])
        elif b > a:
            yield _mixed(int((hashed[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64)) + (b - a) * int(_PLACE[63]))
        else:
            yield np.zeros(0, dtype=np.uint64)


def set_key(shingles: np.ndarray) -> int:
    """64-bit key of a set, signed."""
    return int(_mixed(int(shingles.sum(dtype=np.uint64)) + len(shingles) * int(_PLACE[62])).view(np.int64)[0])


def shared_needed(n, m, percent: int):
    """Least intersection of sets of sizes n and m with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def adaptive_prefix(n: int, counts: np.ndarray, percent: int) -> tuple[int, int]:
    """(prefix length, L) of least estimated cost. ``counts`` are the estimated frequencies in prefix order."""
    least = int(shared_needed(n, -(-percent * n // 100), percent))
    base, most = n - least, min(LARGEST_MATCH, max(1, least))
    read = np.cumsum(counts[:base + most])
    costs = [read[min(base + k, n) - 1] * (1 + n / 8 / k) for k in range(1, most + 1)]
    match = int(np.argmin(costs)) + 1
    return min(n, base + match), match


def _unseen(batches, words: int):
    """Blocks of (record batch, sets); a set met before in this task comes as None (a bounded memory, so only a saving)."""
    seen: set[int] = set()
    for batch, texts in text_blocks(batches):
        sets = []
        for shingles in shingle_sets(texts, words):
            key = set_key(shingles) if len(shingles) else None
            sets.append(None if key is None or key in seen else (key, shingles))
            if key is not None:
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(key)
        yield batch, sets


def _frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """Estimated document frequency by hashed shingle: log2 classes of a fixed-size table of counts."""
    def tally(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for _, sets in _unseen(batches, words):
            own = [s[1] for s in sets if s is not None]
            if own:
                total += np.bincount((np.concatenate(own) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        return total

    return summed_arrays(docs.select("text"), tally, COUNTERS, "int32")


def _keys(docs: DataFrame, words: int) -> DataFrame:
    def keyed(batches):
        for batch, texts in text_blocks(batches):
            sets = list(shingle_sets(texts, words))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n", "sid"])

    return docs.mapInArrow(keyed, "doc_id bigint, n bigint, sid bigint")


def _prefixes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """h, sid, n, pos, need (the document's L) and cost (mean frequency class of its prefix) for every prefix position."""
    counts = _frequencies(docs, words)
    floor = int(np.median(counts))
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def prefixed(batches):
        table = shared.value
        for _, sets in _unseen(batches, words):
            out = [[] for _ in range(6)]
            for key, shingles in (s for s in sets if s is not None):
                n = len(shingles)
                own = table[(shingles % np.uint64(COUNTERS)).astype(np.int64)]
                rank = np.log2(1 + own).astype(np.uint64)
                order = np.argsort(rank << np.uint64(58) | shingles >> np.uint64(6), kind="stable")
                length, need = adaptive_prefix(n, np.maximum(own[order] - floor, 1).astype(float), percent)
                head = order[:length]
                cost = int(1000 * rank[head].mean())
                for column, values in zip(out, (shingles[head].view(np.int64), np.full(length, key), np.full(length, n),
                                                np.arange(length), np.full(length, need), np.full(length, cost))):
                    column.append(values)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, kinds)],
                                  names=["h", "sid", "n", "pos", "need", "cost"])

    return docs.select("text").mapInArrow(prefixed, "h bigint, sid bigint, n int, pos int, need int, cost int")


def _with_hubs(batches):
    """Rows in order of (h, cost desc, sid): those of lists with two members or more, each with its list's first member. The
    lists stream by; only the last row and the current first member are kept."""
    names = ["h", "sid", "n", "pos", "need"]
    carry = None  # (h, last sid, first member's values, whether it was sent)
    for batch in batches:
        if not batch.num_rows:
            continue
        h, sid, *_ = columns = [batch.column(c).to_numpy() for c in names]
        same = np.concatenate([[carry is not None and h[0] == carry[0]], h[1:] == h[:-1]])
        again = same & np.concatenate([[carry is not None and sid[0] == carry[1]], sid[1:] == sid[:-1]])
        columns, same = [c[~again] for c in columns], same[~again]
        if not len(same):
            continue
        start = np.flatnonzero(~same)
        run = np.cumsum(~same) - 1
        first = [np.where(run >= 0, c[start[run]] if len(start) else 0, carry[2][i] if carry else 0) for i, c in enumerate(columns)]
        follows = np.concatenate([same[1:], [False]])
        sent = same | follows
        extra = carry is not None and same[0] and not carry[3]
        out = []
        for c in columns + first[1:]:
            out.append(c[sent])
        if extra:
            out = [np.concatenate([[v], c]) for v, c in zip(list(carry[2]) + list(carry[2])[1:], out)]
        if len(start):
            carry = (columns[0][-1], columns[1][-1], [c[start[-1]] for c in columns], bool(start[-1] < len(same) - 1))
        else:
            carry = (carry[0], columns[1][-1], carry[2], True)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names + ["hub", "hub_n", "hub_pos", "hub_need"])


def _needed(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent) - F.lit(1e-9))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set keys whose sets are similar enough, as links (u, v). The sets of b travel to the texts of a."""
    pairs = stage(pairs.select("a", "b"), "jaccard-candidates")
    wanted_b = reps.join(pairs.select(F.col("b").alias("sid")).distinct(), "sid")
    wanted_a = pairs.join(reps.select(F.col("sid").alias("a"), F.col("doc_id").alias("a_doc")), "a")

    def sets(batches):
        for batch, texts in text_blocks(batches):
            rows = [(sid, s) for sid, s in zip(batch.column("sid").to_pylist(), shingle_sets(texts, words)) if set_key(s) == sid]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary())],
                                  names=["b", "b_set"])

    texts_b = marked_rows(docs, wanted_b).join(wanted_b.hint("merge"), "doc_id").select("sid", "text")
    sets_b = stage(texts_b.mapInArrow(sets, "b bigint, b_set binary").dropDuplicates(["b"]), "jaccard-sets")

    def compared(batches):
        for batch, texts in text_blocks(batches):
            us, vs = [], []
            for a, b, data, own in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(),
                                       batch.column("b_set").to_pylist(), shingle_sets(texts, words)):
                if set_key(own) != a:
                    continue
                other = np.frombuffer(data, dtype=np.uint64)
                both = np.searchsorted(other, own)
                shared = int((other[np.minimum(both, len(other) - 1)] == own).sum())
                if shared >= shared_needed(len(own), len(other), percent):
                    us.append(a)
                    vs.append(b)
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    asked = wanted_a.join(sets_b, "b").select(F.col("a_doc").alias("doc_id"), "a", "b", "b_set")
    return marked_rows(docs, wanted_a.select(F.col("a_doc").alias("doc_id"))).join(asked.hint("merge"), "doc_id").select(
        "a", "b", "b_set", "text").mapInArrow(compared, "u bigint, v bigint")


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; links where 100 * intersection >= percent * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = stage(_keys(docs, words), "jaccard-keys")
    reps = stage(keys.where("sid is not null and doc_id is not null").groupBy("sid").agg(
        F.min("doc_id").alias("doc_id")), "jaccard-sets-of")
    lists = stage(_prefixes(docs, words, percent).repartition(width, "h").sortWithinPartitions(
        "h", F.desc("cost"), "sid").mapInArrow(
        _with_hubs, "h bigint, sid bigint, n int, pos int, need int, hub bigint, hub_n int, hub_pos int, hub_need int"), "postings")

    def fits(n, pos, need, m, other_pos, other_need) -> Column:
        """Sizes allow the pair, and both positions lie within the prefixes of the pair's own t and L."""
        t, match = _needed(n, m, percent), F.least(need, other_need)
        return (F.least(n, m) >= t) & (pos < n - t + match) & (other_pos < m - t + match)

    c = F.col
    first = lists.where((c("sid") != c("hub")) & fits(c("n"), c("pos"), c("need"), c("hub_n"), c("hub_pos"), c("hub_need"))).select(
        c("sid").alias("a"), c("hub").alias("b")).distinct()
    links = stage(_verified(first, docs, reps, words, percent), "jaccard-links")
    joined = stage(components(links), "jaccard-components")
    members = lists.select("h", "sid", "n", "pos", "need").join(joined, c("sid") == c("node"), "left").select(
        "h", "sid", "n", "pos", "need", F.coalesce("component", "sid").alias("comp"))
    open_lists = members.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
    left = stage(members.join(open_lists.select("h"), "h"), "postings-open")
    right = left.select(*[c(n).alias(f"r_{n}") for n in left.columns])
    t = _needed(c("n"), c("r_n"), percent)
    # the first shingle that a pair shares stands within the shortest prefixes of both; the join asks for that one alone
    met = left.join(right, (c("h") == c("r_h")) & (c("sid") < c("r_sid")) & (c("comp") != c("r_comp"))
                    & (F.least("n", "r_n") >= t) & (c("pos") <= c("n") - t) & (c("r_pos") <= c("r_n") - t))
    pairs = met.groupBy("sid", "r_sid").agg(*[F.first(x).alias(x) for x in ("n", "r_n", "need", "r_need")])
    # all that a pair of different components can share lies in open lists: count it within the prefixes of the pair's own L
    heads = left.groupBy("sid").agg(F.collect_list(F.struct("pos", "h")).alias("head"))
    match = F.least("need", "r_need")

    def within(head: str, n: str) -> Column:
        return F.transform(F.filter(head, lambda x: x["pos"] < c(n) - t + match), lambda x: x["h"])

    second = pairs.join(heads, "sid").join(
        heads.select(c("sid").alias("r_sid"), c("head").alias("r_head")), "r_sid").where(
        F.size(F.array_intersect(within("head", "n"), within("r_head", "r_n"))) >= match).select(
        c("sid").alias("a"), c("r_sid").alias("b"))
    more = _verified(second, docs, reps, words, percent)
    whole = stage(components(links.unionByName(more)), "jaccard-components")
    placed = keys.join(whole, c("sid") == c("node"), "left").select(
        "doc_id", "n", F.coalesce("component", "sid").alias("comp"))
    placed = stage(placed, "jaccard-placed")
    least = placed.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "comp", "left").select(
        "doc_id", c("n").alias("n_shingles"),
        F.when(c("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
