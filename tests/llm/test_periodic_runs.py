"""Periodic runs against all periods tried one by one."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from headwise.llm import periodic_runs
from headwise.llm.queries import QUERIES

from . import plain
from .test_llm_edges import CLASHING, SCHEMA, TEXTS


def numbered(words):
    first = {}
    return np.array([first.setdefault(w, i) for i, w in enumerate(words)], dtype=np.int64)


def found(words, shortest):
    starts, ends, periods = periodic_runs.runs_of(numbered(words), shortest)
    return [(int(s), int(e - s), int(p)) for s, e, p in zip(starts, ends, periods)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=8), st.lists(st.integers(0, 3), max_size=12), st.integers(1, 9), st.integers(1, 4),
       st.sampled_from([2, 5, 12]))
def test_runs_of_runs(unit, rest, inner, outer, shortest):
    words = rest[:3] + (unit * inner + rest) * outer + rest[::-1]
    assert found(words, shortest) == plain.word_runs(words, shortest)[0]


def test_many_runs():
    words, before = [0, 1], [0]
    for _ in range(9):  # a Fibonacci word: nearly as many runs as words can hold
        words, before = words + before, words
    assert found(words, 2) == plain.word_runs(words, 2)[0]
    assert found([7] * 3000, 12) == [(0, 3000, 1)]
    assert found([1, 2, 3] * 1000 + [1], 12) == [(0, 3001, 3)]
    assert found(list(range(500)) * 2, 12) == [(0, 1000, 500)]
    assert found([], 12) == found([1], 12) == []


def check(rows, texts):
    for r in rows:
        runs, kept = plain.word_runs(plain.planted_words(r.doc_id, texts[r.doc_id]))
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs), r
        assert (r.start, r.length, r.period) == (best or (None,) * 3), r
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()


def test_query_equals_plain_runs(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op11_periodic_runs"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert sum(r.n_runs > 0 for r in rows) > len(rows) // 20
    check(rows, texts)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts = [*TEXTS, "a b " * 9 + "c " + "b a " * 9, "same words " * 40, "\u00e9\u00e8 \u00e9\u00e8 " * 30, "x\ty\n" * 8, "w " * 11, "w " * 12]
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows + rows[20:22] + [(None, "no id " * 10, None, None, None)], SCHEMA)
    path = str(tmp_path_factory.mktemp("runs"))
    frame.withColumns({c: F.lit("clash") for c in [*CLASHING, "runs", "collapsed", "start", "period", "g", "best"]}).write.parquet(
        f"{path}/documents.parquet")
    return path, dict(enumerate(texts)) | {None: "no id " * 10}


def test_edges(spark, folder, tmp_path):
    path, texts = folder
    rows = QUERIES["op11_periodic_runs"](spark, path).collect()
    assert len(rows) == len(texts) + 2  # repeated rows give repeated results
    check(rows, texts)
    spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op11_periodic_runs"](spark, str(tmp_path)).count() == 0


def test_a_long_text(spark):
    words = [f"w{i}" for i in range(300_000)]
    text = " ".join(words + words[-1000:] * 3 + words[:200_000])
    (row,) = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(299_000, 4000, 1000)]
    assert row.collapsed.decode() == " ".join(words + words[:200_000])
