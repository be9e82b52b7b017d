"""The language model: exact counts and base scores, probabilities that add up, gains over the unigram model."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwise.llm import maxent_lm as lm
from headwise.llm.queries import QUERIES

from .test_llm_edges import CLASHING, SCHEMA, TEXTS

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LARGER = "/root/testdata/sf0.01"


def tokens(text):
    return [*WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())), None]


def plain_scores(rows):
    """[(held_out, n_tokens, n_known, train_tokens, base_score)] of (doc_id, text) rows."""
    held_out = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(t for (_, text), out in zip(rows, held_out) if not out for t in tokens(text))
    whole, distinct = sum(counts.values()), len(counts)
    return [(out, len(own := tokens(text)), sum(counts[t] > 0 for t in own), whole,
             sum(math.log10((counts[t] + 0.5) / (whole + 0.5 * (distinct + 1))) for t in own)) for (_, text), out in zip(rows, held_out)]


def check(got, rows):
    want = plain_scores(rows)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, want[i][4]))
    got = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.base_score))
    assert [r.doc_id for r in got] == [rows[i][0] for i in order]
    for r, i in zip(got, order):
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[i][:4], r
        assert r.base_score == pytest.approx(want[i][4], rel=1e-9, abs=1e-9)
        assert math.isfinite(r.score) and r.score <= 1e-6


def test_query_counts(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(QUERIES["op12_maxent_lm"](spark, sf_dir).collect(), rows)


@pytest.mark.parametrize("head", [lm.HEAD_WORDS, 12, 0])
def test_edges(spark, tmp_path, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)  # counts that are not broadcast are joined, with the same results
    monkeypatch.setattr(lm, "PIECE", 1000)
    monkeypatch.setattr(lm, "HELD_WORDS", 50)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7]), (7, "another text under one id"), (None, "no id here")]
    frame = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], SCHEMA)
    frame = frame.withColumns({c: F.lit("clash") for c in [*CLASHING, "word", "row", "rare", "known", "base", "own", "k"]})
    frame.write.parquet(f"{tmp_path}/a/documents.parquet")
    check(QUERIES["op12_maxent_lm"](spark, f"{tmp_path}/a").collect(), rows)
    frame.where("doc_id < 0").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert QUERIES["op12_maxent_lm"](spark, f"{tmp_path}/b").count() == 0


def test_without_training_documents(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(3)], "doc_id long, text string")
    rows = lm.score_corpus(docs.where(lm.crc_remainder("doc_id", 5) == 1).union(
        docs.select(F.lit(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)).cast("long"), "text"))).collect()
    assert rows and all((r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and math.isfinite(r.score) for r in rows)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 10)
    text = b"  Aa bb\tccccccccccccccccccccc  dd " + b"e" * 50 + b" "
    assert [w for words in lm.word_pieces(text) for w in words] == [*text.lower().split(), lm.END]
    assert list(lm.word_pieces(None)) == [[lm.END]]


@pytest.mark.parametrize("run", [1 << 16, 7, 2, 1])
def test_histories(monkeypatch, run):
    monkeypatch.setattr(lm, "RUN", run)
    words = [b"a", b"b", lm.END]
    model = lm.Model(words, np.array([9, 5, 4]), 18, 3, np.zeros(lm.CLASSES), np.zeros((lm.HEAD_CLASSES, lm.CLASS_WORDS)), np.ones(8))
    texts = [[0, 1, 0, 2], [2], [-5, 1, 2], [0, 2]]
    ends = np.cumsum([len(t) for t in texts])
    parts = [p for _, p in lm.histories(model, np.concatenate(texts).astype(np.int32), ends)]
    group, place, one, two = (np.concatenate(x).tolist() for x in zip(*parts))
    none, seen = lm.FEATURES - 1, lambda t: t if t >= 0 else lm.LISTED - 1 - t
    assert one == [seen(t[i - 1]) if i else none for t in texts for i in range(len(t))]
    assert two == [seen(t[i - 2]) if i > 1 else none for t in texts for i in range(len(t))]
    assert [p >= 0 for p in place] == [t >= 0 for text in texts for t in text]
    assert group[5] == lm.HEAD_CLASSES + 4 % lm.TAIL_CLASSES


def test_every_batch_trains_all_features(monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 8)
    drawn = np.random.default_rng(3)
    words = [b"w%d" % i for i in range(30)]
    shares = np.full((lm.HEAD_CLASSES, lm.CLASS_WORDS), -4, dtype="f4")
    model = lm.Model(words, np.ones(30), 30, 30, np.full(lm.CLASSES, -3, dtype="f4"), shares, np.ones(lm.TAIL_CLASSES))
    tokens = drawn.integers(0, 30, 3000).astype(np.int32)
    trainer = lm.Trainer(model, 0.1)
    for _, run in lm.histories(model, tokens, np.array([1000, 3000])):
        trainer.learn(*run)
    of_class, of_word = trainer.seen
    kinds = np.split(of_class, [lm.FEATURES, 2 * lm.FEATURES]) + np.split(of_word, [lm.WORD_ROWS])
    assert [int(k.sum()) for k in kinds] == [3000] * 5  # 375 batches: as many as there are


def test_scores_do_not_hang_on_the_broadcast_words(spark, monkeypatch):
    drawn = np.random.default_rng(4)
    rare = [[f"r{i}x{k}" for k in range(60)] for i in range(100)]  # 6,000 words with one count
    texts = [" ".join(["often", "seen", "words", *r, *(f"v{k}" for k in drawn.integers(0, 40, 60))]) for r in rare]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def scores():
        return [(r.doc_id, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score_corpus(docs).orderBy("doc_id").collect()]

    whole = scores()
    for head in (4500, 100, 0):  # a level of words that no longer fits
        monkeypatch.setattr(lm, "HEAD_WORDS", head)
        for a, b in zip(scores(), whole, strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)


def test_probabilities_add_up(spark):
    drawn = np.random.default_rng(1)
    text = [" ".join(f"w{k}{'xyz'[k % 3]}" for k in drawn.zipf(1.2, 200) % 3000) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    counts = lm.count_tokens(docs)
    model = lm.vocabulary(counts)
    model = lm.fit(lm.number_tokens(docs, model, "doc_id"), model)
    assert np.abs(model.by_class).max() > 0.05 and np.abs(model.by_word).max() > 0.05
    words, n = zip(*[(bytes(r.word), r.n) for r in counts.collect()])
    assert set(words) == set(model.words) and sum(n) == model.tokens
    number = {w: i + lm.ENDINGS for i, w in enumerate(model.words)}
    at = [number[w] for w in words]
    group, place = model.group[at], model.place[at]
    for one, two in drawn.integers(0, lm.FEATURES, size=(20, 2)):
        history = np.full(len(words), one), np.full(len(words), two)
        p = np.exp(lm.log_shares(model, group, place, *history))
        outside = place < 0
        p[outside] *= (np.array(n)[outside] + 0.5) / model.tail_mass[group[outside] - lm.HEAD_CLASSES]
        tail = np.arange(lm.TAIL_CLASSES)
        none = np.full(lm.TAIL_CLASSES, -1)
        q = np.exp(lm.log_shares(model, tail + lm.HEAD_CLASSES, none, history[0][:lm.TAIL_CLASSES], history[1][:lm.TAIL_CLASSES]))
        assert p.sum() + (q * lm.UNKNOWN / model.tail_mass).sum() == pytest.approx(1, abs=1e-4)


def test_the_history_is_learned(spark):
    drawn = np.random.default_rng(2)
    follow = {i: (7 * i + 3) % 40 for i in range(40)}
    def line():
        at, out = int(drawn.integers(40)), []
        for _ in range(300):
            out.append(f"w{at}")
            at = follow[at] if drawn.random() < 0.9 else int(drawn.integers(40))
        return " ".join(out)
    docs = spark.createDataFrame([(i, line()) for i in range(600)], "doc_id long, text string")
    held = lm.score_corpus(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.5 * held[1]  # logarithms: half the bits


def test_held_out_documents_score_above_the_unigram_model(spark):
    got = QUERIES["op12_maxent_lm"](spark, LARGER)
    better, score, base, n = got.where("held_out").agg(
        F.avg((F.col("score") > F.col("base_score")).cast("int")), F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert better >= 0.95 and (score - base) / n >= 0.15
