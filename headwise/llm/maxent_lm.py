"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class given the history times that of the word in its class. Features of the history are
the word before (bigram), the two words before (trigram, not used inside classes) and the word two places back (skip); words
beyond the ``LISTED`` most frequent ones stand for their last two bytes, trigrams and the pairs of feature and class of the second
softmax are hashed.

* **Classes.** The ``HEAD_CLASSES * CLASS_WORDS`` most frequent words, ordered by their endings, make the classes with a softmax
  of their own. All other words fall into ``TAIL_CLASSES`` classes by their last two bytes; there the probability is the smoothed
  count, with one unknown word (half a count) per class. So the probabilities of all known words and the unknown ones add up to
  one.
* **Counts.** Every training token is counted; distinct words with counts are shuffled, not tokens. The most frequent
  ``HEAD_WORDS`` at most are broadcast, the ``LISTED`` most frequent ones always; counts of other words are joined to the distinct
  ones of each document, so nothing that grows with the vocabulary is held by a task or the driver. Which words are broadcast does
  not change a score: beyond ``LISTED`` a word counts by its ending either way.
* **Token numbers** of all documents are written once and read by training and scoring.
* **Training.** The model starts as the unigram model and is fitted in ``ROUNDS`` rounds over disjoint parts of all training
  documents. In a round every task walks over its documents in mini-batches with scaled gradient steps (AdaGrad); the changes of
  all tasks are averaged by row, weighted by how often a task has seen the row (rows seen ``DOUBT`` times or so stay near
  where they were). The tables have a fixed size (4 MB).
* **Scores** are summed from sparse look-ups in numpy batches.

Defined results: null and empty texts are the end token alone; texts are read whole, in pieces cut at blanks; repeated rows
are learned from and scored each; an empty table gives an empty result; without training documents every word is unknown;
columns other than doc_id and text are never read, whatever their names; a null doc_id counts as the empty text for the split.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import crc_remainder, release_memory, summed_arrays, text_blocks
from headwise.sources.staging import stage

END = b"\n"  # no word holds a blank
HEAD_WORDS, HELD_WORDS = 1 << 18, 200_000
HEAD_CLASSES, CLASS_WORDS, TAIL_CLASSES = 24, 64, 8
CLASSES = HEAD_CLASSES + TAIL_CLASSES
LISTED, ENDINGS = 4096, 1024
FEATURES = LISTED + ENDINGS + 1  # the last one stands before the text
PAIRS, WORD_ROWS = 1 << 13, 1 << 12
CLASS_TABLE, WORD_TABLE = 2 * FEATURES + PAIRS, 2 * WORD_ROWS
ROUNDS, BATCH, RATE, SLOW, DOUBT = 2, 4096, 0.3, 1.0, 1.0
PIECE, RUN = 1 << 20, 1 << 16
UNKNOWN = 0.5

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:])


def word_pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The lower-cased words of a text and the end token, in lists of about ``PIECE`` bytes."""
    at, text = 0, text or b""
    while len(text) - at > PIECE:
        blank = _BLANK.search(text, at + PIECE)
        if blank is None:
            break
        yield text[at:blank.start()].translate(_LOWER).split()
        at = blank.start()
    last = text[at:].translate(_LOWER).split()
    last.append(END)
    yield last


def count_tokens(docs: DataFrame) -> DataFrame:
    """word (bytes) and n over all tokens of docs."""
    def rows(counts):
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def counted(batches):
        total: Counter[bytes] = Counter()
        for _, texts in text_blocks(batches):
            for text in texts:
                for words in word_pieces(text):
                    total.update(words)
                    if len(total) >= HELD_WORDS:
                        yield rows(total)
                        total.clear()
        yield rows(total)
        total.clear()
        release_memory()

    return docs.select("text").mapInArrow(counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Vocabulary statistics and weights. ``words``: the broadcast ones, most frequent first. The arrays ``group`` (class),
    ``place`` (in a head class, else -1), ``feature``, ``base`` and ``own`` (what a token adds to the scores whatever its history)
    are by token number + ``ENDINGS``; a token that is not broadcast has the number -1 - (hash of its ending)."""

    words: list[bytes]
    n: np.ndarray
    tokens: int
    distinct: int
    bias: np.ndarray  # log shares of the classes
    inner_bias: np.ndarray  # log shares of words in their classes
    tail_mass: np.ndarray
    by_class: np.ndarray = field(default_factory=lambda: np.zeros((CLASS_TABLE, CLASSES), dtype="f4"))
    by_word: np.ndarray = field(default_factory=lambda: np.zeros((WORD_TABLE, CLASS_WORDS), dtype="f4"))

    def __post_init__(self):
        ends = np.fromiter((ending(w) % ENDINGS for w in self.words), dtype=np.int64, count=len(self.words))
        ends = np.concatenate([np.arange(ENDINGS)[::-1], ends])
        group, place = class_places(self.words)
        head, listed = slice(ENDINGS, ENDINGS + len(group)), min(LISTED, len(self.words))
        self.group = (HEAD_CLASSES + ends % TAIL_CLASSES).astype(np.int32)
        self.group[head] = group
        self.place = np.full(len(ends), -1, dtype=np.int32)
        self.place[head] = place
        self.feature = (LISTED + ends).astype(np.int32)
        self.feature[ENDINGS:ENDINGS + listed] = np.arange(listed)
        self.base = np.concatenate([np.zeros(ENDINGS), np.log10(self.n + 0.5)])
        outside = self.place < 0
        self.own = np.zeros(len(ends))
        self.own[outside] = self.base[outside] - np.log10(self.tail_mass)[self.group[outside] - HEAD_CLASSES]

    def numbers_only(self) -> Model:
        """The same without words and what only their numbering needs, for tasks that train or score."""
        lean = copy(self)
        lean.words, lean.n, lean.base, lean.own = [], self.n[:0], self.base[:0], self.own[:0]
        return lean


def class_places(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Class and place in it of the words of the head classes (most frequent first): by their endings, class by class."""
    listed = min(len(words), HEAD_CLASSES * CLASS_WORDS)
    order = sorted(range(listed), key=lambda i: words[i][::-1])
    place = np.empty(listed, dtype=np.int64)
    place[order] = np.arange(listed)
    return place // CLASS_WORDS, place % CLASS_WORDS


def histories(model: Model, tokens: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(first token, (class, place, feature of the word before, feature of the word two places back)) of runs of ``RUN`` tokens.
    ``tokens``: the numbers of the tokens of several texts, one behind the other; ``ends``: where they end."""
    starts = np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]
    for a in range(0, len(tokens), RUN):
        b = min(a + RUN, len(tokens))
        line = np.full(b - a + 2, FEATURES - 1, dtype=np.int32)
        low = max(a - 2, 0)
        own = tokens[low:b] + ENDINGS
        line[low - a + 2:] = model.feature[own]
        own = own[a - low:]
        one, two = line[1:-1].copy(), line[:-2].copy()
        first = starts[np.searchsorted(starts, a):np.searchsorted(starts, b)] - a
        one[first] = two[first] = FEATURES - 1
        second = starts[np.searchsorted(starts, a - 1):np.searchsorted(starts, b - 1)] + 1 - a
        two[second] = FEATURES - 1
        yield a, (model.group[own], model.place[own], one, two)


def feature_rows(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """Rows of the class table for the word before, the word two places back and both."""
    pair = one.astype(np.int64) * 40503 + two.astype(np.int64) * 2654435761
    return [one, FEATURES + two, 2 * FEATURES + ((pair >> 7) % PAIRS).astype(np.int32)]


def inner_rows(rows: list[np.ndarray], group: np.ndarray) -> list[np.ndarray]:
    """Rows of the word table for the two single words of the history together with a class."""
    return [(((row.astype(np.int64) * HEAD_CLASSES + group) * 2654435761 >> 9) % WORD_ROWS + k * WORD_ROWS).astype(np.int32)
            for k, row in enumerate(rows[:2])]


def _shares(bias: np.ndarray, table: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the logits and their sums."""
    logits = table.take(rows[0], axis=0)
    for row in rows[1:]:
        logits += table.take(row, axis=0)
    logits += bias
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], dtype=logits.dtype)


def log_shares(model: Model, group, place, one, two) -> np.ndarray:
    """Natural logarithm of the probability of each token's class, times that of the word in a head class."""
    out = np.empty(len(group))
    for a in range(0, len(group), BATCH):
        part = slice(a, a + BATCH)
        rows, own = feature_rows(one[part], two[part]), group[part]
        share, total = _shares(model.bias, model.by_class, rows)
        found = np.log(share[np.arange(len(own)), own]) - np.log(total)
        head = np.flatnonzero(place[part] >= 0)
        if len(head):
            own, inner = own[head], place[part][head]
            share, total = _shares(model.inner_bias.take(own, axis=0), model.by_word, inner_rows([r[head] for r in rows], own))
            found[head] += np.log(share[np.arange(len(head)), inner]) - np.log(total)
        out[part] = found
    return out


class Trainer:
    """Scaled gradient steps of one task. Every batch changes the weights of all features, however many batches there are."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate = model, rate
        self.tables = [model.by_class.copy(), model.by_word.copy()]
        self.squares = [np.full_like(t, SLOW) for t in self.tables]
        self.seen = [np.zeros(len(t), dtype=np.int64) for t in self.tables]

    def _step(self, which: int, bias: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> None:
        table, squares, seen = self.tables[which], self.squares[which], self.seen[which]
        error, total = _shares(bias, table, rows)
        error *= (1 / total)[:, None]
        error[np.arange(len(target)), target] -= 1
        for row in rows:
            order = np.argsort(row.astype(np.uint16), kind="stable")
            held = row.take(order)
            first = np.flatnonzero(np.diff(held, prepend=-1))
            used = held[first]
            gradient = np.add.reduceat(error.take(order, axis=0), first, axis=0)
            square = squares.take(used, axis=0)
            square += gradient * gradient
            squares[used] = square
            np.sqrt(square, out=square)
            gradient /= square
            gradient *= self.rate
            changed = table.take(used, axis=0) - gradient
            table[used] = np.clip(changed, -6, 6, out=changed)
            seen[used] += np.diff(np.append(first, len(held)))

    def learn(self, group, place, one, two) -> None:
        for a in range(0, len(group), BATCH):
            part = slice(a, a + BATCH)
            rows, own, inner = feature_rows(one[part], two[part]), group[part], place[part]
            self._step(0, self.model.bias, rows, own)
            head = np.flatnonzero(inner >= 0)
            if len(head):
                own = own[head]
                self._step(1, self.model.inner_bias.take(own, axis=0), inner_rows([r[head] for r in rows], own), inner[head])

    def changes(self) -> np.ndarray:
        """Changes of all weights times how often their rows were seen, and the latter."""
        parts = []
        for table, before, seen in zip(self.tables, (self.model.by_class, self.model.by_word), self.seen):
            weighted = ((table - before) * seen[:, None]).astype("f4").ravel()
            parts.append((weighted.view("u4") & np.uint32(0xFFFFF000)).view("f4"))  # half the digits: packs better
        return np.concatenate([*parts, *(s.astype("f4") for s in self.seen)])


def vocabulary(counts: DataFrame) -> Model:
    """The untrained model: unigram shares. ``counts`` is cheap to read more than once."""
    tail = (F.crc32(F.substring("word", -2, 2)) % TAIL_CLASSES).cast("int")
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # some hundred at most
    least, kept, held = None, 0, 0
    for row in sorted(levels, key=lambda r: -r.level):
        held += row.n
        if held > HEAD_WORDS:
            break
        least, kept = row.level, held
    words, n = [], np.zeros(0)
    if levels:
        # classes and features hang on the LISTED most frequent words, so these are held however many words share a level
        enough = kept >= min(LISTED, sum(r.n for r in levels))
        chosen = counts.where(level >= least) if enough else counts.orderBy(F.desc("n"), "word").limit(LISTED)
        frame = chosen.select("word", "n").toArrow()
        n = frame["n"].to_numpy()
        words = frame["word"].to_pylist()
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        words, n = [words[i] for i in order], n[order]
    mass = np.full(TAIL_CLASSES, UNKNOWN)
    tokens = distinct = 0
    for r in counts.groupBy(tail.alias("tail")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        mass[r.tail] += r.n + 0.5 * r.words
        tokens, distinct = tokens + r.n, distinct + r.words
    group, place = class_places(words)
    for i in range(len(group)):
        mass[ending(words[i]) % TAIL_CLASSES] -= n[i] + 0.5
    shares = np.zeros((HEAD_CLASSES, CLASS_WORDS))
    shares[group, place] = n[:len(group)] + 0.5
    whole = np.concatenate([shares.sum(axis=1), mass])
    with np.errstate(divide="ignore", invalid="ignore"):
        bias = np.maximum(np.log(whole / whole.sum()), -1e4)
        inner = np.maximum(np.nan_to_num(np.log(shares / shares.sum(axis=1, keepdims=True)), nan=-1e4), -1e4)
    return Model(words, n, tokens, distinct, bias.astype("f4"), inner.astype("f4"), mass)


def number_tokens(docs: DataFrame, model: Model, *carried: str) -> DataFrame:
    """The carried columns and row (a number of its own), tokens (their numbers), n_tokens, known, base, own (parts of the scores
    that need no history) and rare (words that are not broadcast, with counts), written once: text is read once for training and
    scoring."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)

    def numbered(batches):
        model = shared.value
        known_words = {w: i for i, w in enumerate(model.words)}  # for this task alone, not for the life of the worker
        number = TaskContext.get().partitionId() << 40
        for batch, texts in text_blocks(batches):
            size = len(texts)
            n, base, own, rare = np.zeros(size, np.int64), np.zeros(size), np.zeros(size), [Counter() for _ in texts]
            known, parts, words, owners = np.zeros(size, np.int64), [], [], []

            def looked_up():
                at = np.fromiter(map(known_words.get, words, repeat(-1)), dtype=np.int32, count=len(words))
                text = np.repeat([i for i, _ in owners], [k for _, k in owners])
                far = np.flatnonzero(at < 0)
                for i, k in zip(text[far].tolist(), far.tolist()):
                    rare[i][words[k]] += 1
                at[far] = [-1 - ending(words[k]) % ENDINGS for k in far.tolist()]
                nonlocal n, known, base, own
                n += np.bincount(text, minlength=size)
                known += np.bincount(text[at >= 0], minlength=size)
                base += np.bincount(text, weights=model.base[at + ENDINGS], minlength=size)
                own += np.bincount(text, weights=model.own[at + ENDINGS], minlength=size)
                parts.append(at)
                words.clear()
                owners.clear()

            for i, text in enumerate(texts):
                for piece in word_pieces(text):
                    words += piece
                    owners.append((i, len(piece)))
                    if len(words) >= RUN:
                        looked_up()
            if words:
                looked_up()
            cuts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            tails = np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32)
            yield pa.record_batch(
                [*(batch.column(c) for c in carried), pa.array(number + np.arange(size)),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(parts))), pa.array(n), pa.array(known),
                 pa.array(base), pa.array(own), pa.ListArray.from_arrays(pa.array(tails), pa.StructArray.from_arrays(
                     [pa.array([w for r in rare for w in r], pa.binary()), pa.array([k for r in rare for k in r.values()], pa.int64())],
                     names=["word", "k"]))],
                names=[*carried, "row", "tokens", "n_tokens", "known", "base", "own", "rare"])
            number += size
        release_memory()

    return stage(docs.select(*dict.fromkeys([*carried, "text"])).mapInArrow(
        numbered, f"{kinds}, row bigint, tokens array<int>, n_tokens bigint, known bigint, base double, own double, "
                  "rare array<struct<word:binary,k:bigint>>"), "tokens")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts of a batch one behind the other, and where the texts end."""
    lists = batch.column("tokens")
    marks = lists.offsets.to_numpy()
    return lists.values.to_numpy()[marks[0]:marks[-1]], (marks[1:] - marks[0]).astype(np.int64)


def fit(numbered: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """The model trained on documents given by their token numbers (columns row, tokens)."""
    spark, part = numbered.sparkSession, F.pmod(F.xxhash64("row"), F.lit(rounds))
    size = CLASS_TABLE * (CLASSES + 1) + WORD_TABLE * (CLASS_WORDS + 1)
    for k in range(rounds if model.tokens else 0):
        shared, rate = spark.sparkContext.broadcast(model.numbers_only()), RATE / (1 + k)

        def changes(batches):
            trainer = Trainer(shared.value, rate)
            for batch in batches:
                for _, run in histories(trainer.model, *_flat(batch)):
                    trainer.learn(*run)
            release_memory()
            return trainer.changes()

        total = summed_arrays(numbered.where(part == k).select("tokens"), changes, size, "float32")
        cuts = np.cumsum([CLASS_TABLE * CLASSES, WORD_TABLE * CLASS_WORDS, CLASS_TABLE])
        by_class, by_word, seen, seen_inner = np.split(total, cuts)
        model.by_class = model.by_class + by_class.reshape(-1, CLASSES) / (seen + DOUBT)[:, None]
        model.by_word = model.by_word + by_word.reshape(-1, CLASS_WORDS) / (seen_inner + DOUBT)[:, None]
    return model


def score(numbered: DataFrame, model: Model, counts: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, n_tokens, n_known, base_score and score (logarithms to base 10) of documents given by token numbers."""
    shared = numbered.sparkSession.sparkContext.broadcast(model.numbers_only())
    told = [*carried, "row", "n_tokens", "known", "base"]

    def scored(batches):
        model = shared.value
        for batch in batches:
            tokens, ends = _flat(batch)
            logs, text = np.zeros(batch.num_rows), 0
            for a, run in histories(model, tokens, ends):
                part = log_shares(model, *run)
                text = np.searchsorted(ends, np.arange(a, a + len(part)), side="right")
                logs += np.bincount(text, weights=part, minlength=batch.num_rows)
            own = batch.column("own").to_numpy() + logs / np.log(10)
            yield pa.record_batch([*(batch.column(c) for c in told), pa.array(own)], names=[*told, "own"])
        release_memory()

    kinds = ", ".join(f"{c} {numbered.schema[c].dataType.simpleString()}" for c in [*told, "own"])
    held = numbered.select(*told, "own", "tokens").mapInArrow(scored, kinds)
    rare = numbered.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    met = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k"))).alias("met"), F.sum(F.when(F.col("n").isNull(), F.col("k"))).alias("new"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("k") * F.log10(F.col("n") + 0.5))).alias("logs"))
    whole = float(np.log10(model.tokens + 0.5 * (model.distinct + 1)))
    none = F.lit(0)
    new, logs = F.coalesce("new", none), F.coalesce("logs", none)
    return held.join(met, "row", "left").select(
        *carried, "n_tokens", (F.col("known") + F.coalesce("met", none)).cast("long").alias("n_known"),
        (F.col("base") + logs + new * float(np.log10(0.5)) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("own") + logs + new * float(np.log10(UNKNOWN))).alias("score"))


def score_corpus(docs: DataFrame, held_out_modulus: int = 5, held_out_remainder: int = 1) -> DataFrame:
    """Learn outside the held-out documents, score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held_out = crc_remainder("doc_id", held_out_modulus) == held_out_remainder
    counts = stage(count_tokens(docs.where(~held_out)), "token-counts")
    model = vocabulary(counts)
    numbered = number_tokens(docs.select("doc_id", "text"), model, "doc_id")
    model = fit(numbered.where(~held_out), model)
    return score(numbered, model, counts, "doc_id").select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score")
