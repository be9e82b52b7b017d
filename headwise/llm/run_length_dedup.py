"""Exact removal of repeated passages with run-length indexes.

A passage of ``length`` bytes that starts at two places, of any documents, is repeated; every byte that a repeated passage
covers is removed. Passages are bytes of the UTF-8 text and never cross documents.

1. Anchors. Every start of a passage is given to the least hashed gram inside the passage (the leftmost of equals), which
   depends on the passage's bytes alone. So equal passages meet at equal anchors, and a context (an anchor with all the
   starts it owns, about half as many as grams fit a passage) carries each start once.
2. One shuffle by anchor. Anchors seen once leave. Contexts equal as a whole are repeated from end to end and stay as one
   text to match others with.
3. Run-length index. Where an anchor has unlike contexts, their texts are gathered, about ``INDEX_BYTES`` at a time, into a
   Burrows-Wheeler transform kept as runs with suffix samples at run ends. The length matched elsewhere, streamed over a
   text, falls by one from a position to the next except at sampled run ends, so only there is it computed (against the
   neighbour in suffix order, on both sides); every sample with ``length`` or more marks the starts it proves repeated.
4. Anchors with very many contexts (found with a fixed-size table of counts) are dealt out by context instead of by anchor, so
   no group has to fit into a task. Every passage of theirs also holds half of its other bytes on one side of the anchor: halves
   of contexts whose longer gram occurs once leave, and the passages of the others are counted one by one by hash.

Contexts that are equal within a run of texts of one task travel as one row with the places of all, so copies and texts that
repeat a short pattern cost one row per run.

Defined results: null and empty texts have no bytes; texts shorter than ``length`` keep all; repeated rows are repeated
passages like any; an empty table gives an empty result; extra columns are ignored. Anchors with contexts, rows and passages
are identified by 64-bit hashes (two of them together for contexts and passages).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import fingerprint64, joined_bytes, release_memory, span_hashes, summed_arrays, text_blocks
from headwise.sources.staging import stage

LENGTH, GRAM = 200, 64
RUN_BYTES = 4 << 20
PIECE = 1 << 18
PLACE_BITS, BUFFER_BYTES = 24, 1 << 22
COUNTERS, CROWDED = 1 << 22, 2048
INDEX_BYTES = 1 << 19
MARKS = 1 << 20


# --- anchors ----------------------------------------------------------------------------------------------------------
def _gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, from packed words."""
    word = buffer.astype(np.uint64)
    for step, bits in ((1, 8), (2, 16), (4, 32)):
        word = word[:-step] | word[step:] << np.uint64(bits)
    size = len(word) - GRAM + 8
    mixed = np.zeros(max(0, size), dtype=np.uint64)
    if size > 0:
        for i in range(0, GRAM, 8):
            mixed = (mixed ^ word[i:i + size]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
            mixed ^= mixed >> np.uint64(29)
    return mixed


def contexts(texts: list[bytes | None], length: int = LENGTH):
    """Arrays (text number, first start, number of starts, anchor hash, context hash, anchor's place in the context) of all
    contexts of the texts. Long texts are cut into pieces that own disjoint ranges of starts, and about ``BUFFER_BYTES`` of
    pieces are hashed at a time, so places in a buffer fit ``PLACE_BITS`` and the numpy intermediates do not grow with a text."""
    parts, pieces, owner, base, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, (len(text) if text else 0) - length + 1), PIECE):
            if pieces and size >= BUFFER_BYTES:
                parts.append(_piece_contexts(pieces, owner, base, length))
                pieces, owner, base, size = [], [], [], 0
            pieces.append(text[at:at + PIECE + length - 1])
            owner.append(i)
            base.append(at)
            size += len(pieces[-1])
    if pieces:
        parts.append(_piece_contexts(pieces, owner, base, length))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (none,) * 6


def _piece_contexts(pieces: list[bytes], owner: list[int], base: list[int], length: int):
    """``contexts`` of the pieces of one buffer; ``owner`` and ``base`` are the text number and place of each piece."""
    buffer, starts, ends = joined_bytes(pieces)
    if len(buffer) > 1 << PLACE_BITS:
        raise ValueError(f"passages of {length} bytes are too long: a buffer holds {1 << PLACE_BITS} bytes")
    grams = _gram_hashes(buffer)
    # 40 bits of hash over the position: the least key is the leftmost of the least grams
    low = np.uint64(PLACE_BITS)
    least = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
    window, width = length - GRAM + 1, 1
    while 2 * width <= window:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < window:
        least = np.minimum(least[:width - window], least[window - width:])
    at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    count = ends - starts - length + 1
    first = np.cumsum(count) - count
    start = np.repeat(starts - first, count) + np.arange(count.sum())
    anchor = at[start]
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    head = np.flatnonzero(fresh)
    number = np.diff(np.concatenate([head, [len(start)]]))
    begin = start[head]
    piece = np.searchsorted(starts, begin, side="right") - 1
    key = fingerprint64(grams[anchor[head]]).view(np.int64)
    body = span_hashes(buffer, begin, begin + number + length - 1) ^ fingerprint64((anchor[head] - begin).astype(np.uint64))
    return (np.array(owner)[piece], begin - starts[piece] + np.array(base)[piece], number, key, body.view(np.int64),
            anchor[head] - begin)


def _runs(batches, length: int, rids: bool):
    """Contexts of about ``RUN_BYTES`` of text at a time, equal ones together: arrays rid, start, number, anchor, context in an
    order that puts equal contexts side by side, and the bounds of each distinct one."""
    held, size = [], 0

    def grouped():
        rid, start, number, key, body = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((body, key))
        rid, start, number, key, body = (c[order] for c in (rid, start, number, key, body))
        fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (body[1:] != body[:-1])]))
        return rid, start, number, key, body, np.concatenate([fresh, [len(key)]])

    for batch, texts in text_blocks(batches):
        row, start, number, key, body, _ = contexts(texts, length)
        if len(row):
            rid = batch.column("rid").to_numpy()[row] if rids else np.zeros(len(row), dtype=np.int64)
            held.append((rid, start, number, key, body))
        size += sum(len(t) for t in texts if t)
        if held and size >= RUN_BYTES:
            yield grouped()
            held, size = [], 0
    if held:
        yield grouped()


def _counter(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) % np.uint64(COUNTERS)).astype(np.int64)


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    """rid, start, number, anchor, context, crowded for every distinct context of a run of texts; ``others`` has the rid,
    start and number of its further occurrences there."""
    def tally(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for _, _, _, key, _, bounds in _runs(batches, length, False):
            total += np.bincount(_counter(key[bounds[:-1]]), minlength=COUNTERS)
        return total

    crowded = np.packbits(summed_arrays(docs.select("text"), tally, COUNTERS, "int32") > CROWDED)
    shared = docs.sparkSession.sparkContext.broadcast(crowded)

    def listed(batches):
        many = np.unpackbits(shared.value).astype(bool)
        for rid, start, number, key, body, bounds in _runs(batches, length, True):
            first = bounds[:-1]
            rest = np.ones(len(key), dtype=bool)
            rest[first] = False
            counts = np.diff(bounds) - 1
            triples = np.stack([rid[rest], start[rest], number[rest]], axis=1).ravel()
            others = pa.ListArray.from_arrays(
                pa.array(3 * np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(triples, pa.int64()))
            whole = pa.record_batch(
                [pa.array(rid[first], pa.int64()), pa.array(start[first], pa.int64()), pa.array(number[first], pa.int32()),
                 pa.array(key[first], pa.int64()), pa.array(body[first], pa.int64()),
                 pa.array(many[_counter(key[first])], pa.bool_()), others],
                names=["rid", "start", "number", "anchor", "context", "crowded", "others"])
            for low in range(0, whole.num_rows, 8192):
                yield whole.slice(low, 8192)

    return docs.select("rid", "text").mapInArrow(
        listed, "rid bigint, start bigint, number int, anchor bigint, context bigint, crowded boolean, others array<bigint>")


def _compared(batches):
    """Rows in order of (anchor, context): those whose anchor has another row next to them, and all of crowded anchors, with
    ``copy`` (another row has the same context) and ``head`` (first of its context). One row is held back."""
    names = ["rid", "start", "number", "anchor", "context", "crowded", "others"]
    held, before = None, (None, None)
    for batch in _with_end(batches):
        table = held if batch is None else pa.Table.from_batches(([*held.to_batches()] if held is not None else []) + [batch])
        if table is None or not table.num_rows:
            continue
        last = table.num_rows if batch is None else table.num_rows - 1
        anchor, context = table["anchor"].to_numpy(), table["context"].to_numpy()
        like = np.concatenate([[anchor[0] == before[0]], anchor[1:] == anchor[:-1], [False]])
        same = like & np.concatenate([[context[0] == before[1]], context[1:] == context[:-1], [False]])
        twice = pc.list_value_length(table["others"]).to_numpy() > 0
        copy, head = same[:-1] | same[1:] | twice, ~same[:-1]
        wanted = np.flatnonzero((like[:-1] | like[1:] | twice | table["crowded"].to_numpy())[:last])
        out = table.select(names).take(pa.array(wanted)).append_column("copy", pa.array(copy[wanted], pa.bool_())).append_column(
            "head", pa.array(head[wanted], pa.bool_()))
        yield from out.to_batches()
        if batch is not None:
            held = table.slice(last).combine_chunks()
            if last:
                before = (anchor[last - 1], context[last - 1])


def _with_end(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


# --- index ------------------------------------------------------------------------------------------------------------
def suffix_order(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffix order of a text of at most 65,536 different symbols whose suffixes differ within ``longest`` symbols."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(4, dtype=text.dtype)]).astype(np.uint64)
    key = padded[:n] << np.uint64(48) | padded[1:n + 1] << np.uint64(32) | padded[2:n + 2] << np.uint64(16) | padded[3:n + 3]
    width = 4
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]), dtype=np.int64).astype(np.uint64)
        if width >= longest or int(rank[order[-1]]) == n - 1:
            return order
        after = np.zeros(n, dtype=np.uint64)
        after[:n - width] = rank[width:] + np.uint64(1)
        key, width = rank << np.uint64(32) | after, 2 * width


def matched_lengths(words: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the match of a[i] and b[i], within their texts (``left``: bytes left in the text of a position)."""
    most = np.minimum(left[a], left[b])
    length, open_ = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    while len(open_):
        at = length[open_]
        unlike = words[a[open_] + at] ^ words[b[open_] + at]
        low = unlike & (~unlike + np.uint64(1))
        step = np.where(unlike == 0, 8, np.log2(np.maximum(low, 1).astype(float)).astype(np.int64) // 8)
        length[open_] = at + step
        open_ = open_[(unlike == 0) & (length[open_] < most[open_])]
    return np.minimum(length, most)


class RunLengthIndex:
    """Burrows-Wheeler transform of some texts as runs, with suffix samples at both ends of each run."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes + 1) - 1
        data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        symbols = data.astype(np.uint16) + np.uint16(len(texts))
        symbols[ends] = np.arange(len(texts))  # every text ends in a symbol of its own
        order = suffix_order(symbols, int(sizes.max()) + 1)
        before = symbols[order - 1]
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.run_symbol = before[np.concatenate([[0], change])]
        self.run_start = np.concatenate([[0], change])
        self.head, self.above = order[change], order[change - 1]  # the row that opens a run and the one above it
        self.starts = ends - sizes
        self.left = np.repeat(ends, sizes + 1) - np.arange(len(data))
        word = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
        for step, bits in ((1, 8), (2, 16), (4, 32)):
            word = word[:-step] | word[step:] << np.uint64(bits)
        self.words = word

    def repeated(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) positions of starts proven repeated: at each sampled run end the matched length is computed, and it
        falls by one from there on until the next sample."""
        matched = matched_lengths(self.words, self.left, self.head, self.above)
        long = matched >= length
        first = np.concatenate([self.head[long], self.above[long]])
        return first, first + np.tile(matched[long] - length, 2)


def _indexed(length: int):
    """Task function: contexts in order of anchor; repeated starts of those that are not copies."""
    def index(batches):
        texts, rows, size, current = [], [], 0, None

        def flush():
            marks = [[], [], []]
            if len(texts) > 1:
                made = RunLengthIndex(texts)
                first, last = made.repeated(length)
                text = np.searchsorted(made.starts, first, side="right") - 1
                for t, a, b in zip(text.tolist(), (first - made.starts[text]).tolist(), (last - made.starts[text]).tolist()):
                    rid, start, copy = rows[t]
                    if not copy:
                        marks[0].append(rid)
                        marks[1].append(start + a)
                        marks[2].append(start + b + length)
            return pa.record_batch([pa.array(m, pa.int64()) for m in marks], names=["rid", "begin", "until"])

        for batch in batches:
            for anchor, rid, start, copy, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "rid", "start", "copy", "body"))):
                if anchor != current and size >= INDEX_BYTES or len(texts) == 60_000:
                    yield flush()
                    texts, rows, size = [], [], 0
                current = anchor
                texts.append(body)
                rows.append((rid, start, copy))
                size += len(body)
        yield flush()
        release_memory()

    return index


def _bodies(length: int):
    """Task function: texts with the contexts wanted of them; one row per context with its bytes."""
    def cut(batches):
        for batch in (part.slice(low, 256) for part in batches for low in range(0, part.num_rows, 256)):
            texts, wanted = batch.column("text").cast(pa.binary()), batch.column("wanted").to_pylist()
            rids, rows, held = batch.column("rid").to_pylist(), [], 0
            for i, (rid, list_) in enumerate(zip(rids, wanted)):
                text = texts[i].as_py()
                for w in list_:
                    rows.append((w["anchor"], rid, w["start"], w["number"], w["copy"], w["crowded"],
                                 text[w["start"]:w["start"] + w["number"] + length - 1]))
                    held += w["number"] + length
                if rows and (held > 4 << 20 or i == len(rids) - 1):
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (
                        pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()))],
                        names=["anchor", "rid", "start", "number", "copy", "crowded", "body"])
                    rows, held = [], 0
        release_memory()

    return cut


def _halves(length: int):
    """Task function: contexts cut in two by the side of the anchor on which their passages surely hold half of their other
    bytes, each part under the hash of the anchor with those bytes."""
    side = (length - GRAM) // 2

    def cut(batches):
        for batch in (part.slice(low, 1024) for part in batches for low in range(0, part.num_rows, 1024)):
            bodies, out = batch.column("body").to_pylist(), [[] for _ in range(6)]
            at = contexts(bodies, length)[5]
            for i, body in enumerate(bodies):
                rid, start, number, copy = (batch.column(c)[i].as_py() for c in ("rid", "start", "number", "copy"))
                left = min(number, max(0, int(at[i]) - side + 1))  # passages that start so far before the anchor
                for low, high, grams in ((0, left, (at[i] - side, at[i] + GRAM)), (left, number, (at[i], at[i] + GRAM + side))):
                    if high > low:
                        gram = np.frombuffer(body, dtype=np.uint8)
                        key = span_hashes(gram, np.array([grams[0]]), np.array([grams[1]])).view(np.int64)[0] ^ int(low > 0 or left == 0)
                        for column, value in zip(out, (key, rid, start + low, high - low, copy, body[low:high + length - 1])):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)],
                                  names=["anchor", "rid", "start", "number", "copy", "body"])

    return cut


def _passages(length: int):
    """Task function: every passage of the contexts by hash."""
    def hashed(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                bodies, number = part.column("body").to_pylist(), part.column("number").to_numpy()
                buffer, starts, _ = joined_bytes(bodies)
                row = np.repeat(np.arange(len(number)), number)
                step = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                at = starts[row] + step
                yield pa.record_batch(
                    [part.column("anchor").take(pa.array(row)), pa.array(span_hashes(buffer, at, at + length).view(np.int64)),
                     part.column("rid").take(pa.array(row)), pa.array(part.column("start").to_numpy()[row] + step, pa.int64()),
                     part.column("copy").take(pa.array(row))], names=["anchor", "passage", "rid", "start", "copy"])

    return hashed


def with_rid(docs: DataFrame) -> DataFrame:
    """A row key from id and text: equal rows share their spans."""
    return docs.withColumn("rid", F.xxhash64("doc_id", "text"))


def _in(frame: DataFrame, ids: DataFrame):
    """(rows that may be in ids, rows that are not): a fixed-size bitmap of rids, so that few texts are shuffled."""
    def tally(batches):
        total = np.zeros(MARKS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).to_numpy(), minlength=MARKS)
        return total

    place = F.pmod("rid", F.lit(MARKS)).cast("int")
    bits = np.packbits(summed_arrays(ids.select(place.alias("m")), tally, MARKS, "int32") > 0)
    shared = frame.sparkSession.sparkContext.broadcast(bits)
    schema = frame.schema

    def passing(wanted: bool):
        def passed(batches):
            marks = np.unpackbits(shared.value).astype(bool)
            for batch in batches:
                at = (batch.column("rid").to_numpy() % MARKS).astype(np.int64)
                yield batch.filter(pa.array(marks[at] == wanted))

        return passed

    return frame.mapInArrow(passing(True), schema), frame.mapInArrow(passing(False), schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """rid, begin, until (bytes, maybe overlapping) of everything covered by repeated passages. ``docs`` has rid and text."""
    docs = docs.select("rid", "text")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.xxhash64("anchor", F.when(F.col("crowded"), F.col("context")))
    kinds = ("rid bigint, start bigint, number int, anchor bigint, context bigint, crowded boolean, others array<bigint>, "
             "copy boolean, head boolean")
    rows = stage(_occurrences(docs, length).withColumn("dealt", dealt).repartition(width, "dealt").drop("dealt").sortWithinPartitions(
        "anchor", "context").mapInArrow(_compared, kinds), "contexts")
    places = F.concat(F.array("rid", "start", F.col("number").cast("long")), F.coalesce("others", F.array().cast("array<bigint>")))
    copies = rows.where("copy").select(places.alias("p")).select(F.explode(F.transform(
        F.expr("sequence(0, cast(size(p) div 3 as int) - 1)"), lambda i: F.struct(
            F.get("p", (3 * i).cast("int")).alias("rid"), F.get("p", (3 * i + 1).cast("int")).alias("begin"),
            (F.get("p", (3 * i + 1).cast("int")) + F.get("p", (3 * i + 2).cast("int")) + (length - 1)).alias("until")))).alias("m")).select("m.*")
    heads = rows.where("head").drop("others")
    unlike = heads.where("not crowded").groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor")
    asked = heads.where("not crowded").join(unlike, "anchor").unionByName(heads.where("crowded").select("anchor", *[
        c for c in heads.columns if c != "anchor"]))
    asked = stage(asked.groupBy("rid").agg(F.collect_list(F.struct(
        "anchor", "start", "number", "copy", "crowded")).alias("wanted")), "contexts-asked")
    may, _ = _in(docs, asked)
    bodies = stage(may.join(asked.hint("merge"), "rid").mapInArrow(
        _bodies(length),
        "anchor bigint, rid bigint, start bigint, number int, copy boolean, crowded boolean, body binary"), "context-bodies")
    found = bodies.where("not crowded").select("anchor", "rid", "start", "copy", "body").repartition(width, "anchor").sortWithinPartitions(
        "anchor").mapInArrow(_indexed(length), "rid bigint, begin bigint, until bigint")
    halves = stage(bodies.where("crowded").select("rid", "start", "number", "copy", "body").mapInArrow(
        _halves(length), "anchor bigint, rid bigint, start bigint, number int, copy boolean, body binary"), "context-halves")
    longer = halves.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor")
    passages = halves.join(longer, "anchor").select("anchor", "rid", "start", "number", "copy", "body").mapInArrow(
        _passages(length), "anchor bigint, passage bigint, rid bigint, start bigint, copy boolean")
    often = passages.groupBy("anchor", "passage").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor", "passage")
    counted = passages.where("not copy").join(often, ["anchor", "passage"]).select(
        "rid", F.col("start").alias("begin"), (F.col("start") + length).alias("until"))
    return copies.unionByName(found).unionByName(counted)


def remove_repeats(docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """The columns of ``docs`` with n_bytes, spans (sorted, disjoint byte ranges removed) and kept (the remaining bytes; with
    ``as_text`` a string, from which what is left of characters cut in two is dropped). Columns of ``docs`` that bear one of
    these names, or the name rid, are left out."""
    kept = [c for c in docs.columns if c not in ("n_bytes", "spans", "kept", "rid")]
    keyed = with_rid(docs.select(*kept))
    spans = stage(repeated_spans(keyed, length).groupBy("rid").agg(
        F.collect_set(F.struct("begin", "until")).alias("spans")), "repeated-spans")  # equal rows find the same spans
    may, never = _in(keyed, spans)
    frame = may.join(spans.hint("merge"), "rid", "left").unionByName(
        never.withColumn("spans", F.lit(None).cast("array<struct<begin:bigint,until:bigint>>")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + (
        f", n_bytes bigint, spans array<struct<begin:bigint,until:bigint>>, kept {'string' if as_text else 'binary'}")
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("until", pa.int64())]))

    def applied(batches):
        for batch, texts in text_blocks(batches):
            sizes, out, left = [], [], []
            for text, spans in zip(texts, batch.column("spans").to_pylist()):
                text, merged = text or b"", []
                for s in sorted(spans or [], key=lambda s: s["begin"]):
                    if merged and s["begin"] <= merged[-1]["until"]:
                        merged[-1]["until"] = max(merged[-1]["until"], s["until"])
                    else:
                        merged.append({"begin": s["begin"], "until": s["until"]})
                at, parts = 0, []
                for s in merged:
                    parts.append(text[at:s["begin"]])
                    at = s["until"]
                parts.append(text[at:])
                sizes.append(len(text))
                out.append(merged)
                remaining = b"".join(parts)
                left.append(remaining.decode("utf-8", "ignore") if as_text else remaining)
            yield pa.record_batch(
                [*(batch.column(c) for c in kept), pa.array(sizes, pa.int64()), pa.array(out, span_type),
                 pa.array(left, pa.string() if as_text else pa.binary())],
                names=[*kept, "n_bytes", "spans", "kept"])

    return frame.select(*kept, "spans").mapInArrow(applied, schema)
