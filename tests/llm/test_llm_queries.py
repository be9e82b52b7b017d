"""The registered queries on whole small tables: against SQL, libraries, plain versions, or held-out labels."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from headwise.llm import byte_bpe
from headwise.llm.oracle import SQL
from headwise.llm.queries import QUERIES

from . import plain

LARGER = "/root/testdata/sf0.01"


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, QUERIES[name], SQL[name], sf_dir) is None


def test_bpe_equals_the_library(spark, sf_dir):
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in QUERIES["op6_byte_bpe"](spark, sf_dir).collect()}
    rows = documents(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = encoder.encode_ordinary(row.text or "")
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_repeats_equal_all_windows(spark, sf_dir):
    rows = documents(spark, sf_dir).orderBy("doc_id").collect()
    got = [tuple(r)[1:] for r in QUERIES["op8_run_length_dedup"](spark, sf_dir).orderBy("doc_id").collect()]
    assert got == plain.repeats([r.text for r in rows], 200)


def test_packing_equals_the_sequential_one(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = QUERIES["op9_best_fit"](spark, sf_dir).collect()
    pieces = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got}
    assert len(pieces) == len(got)
    lengths = []
    for row in documents(spark, sf_dir).collect():
        ids = np.array([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            assert pieces[row.doc_id, k] == (a, b - a, zlib.crc32(ids[a:b].tobytes()))
            lengths.append(b - a)
    assert len(lengths) == len(got)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048
    assert len(filled) == plain.best_fit_bins(lengths, 2048)


@pytest.mark.parametrize("name, label, least", [("op4_quality_classifier", "quality", 0.97), ("op5_toxicity", "toxic", 0.97)])
def test_held_out_labels(spark, name, label, least):
    got = QUERIES[name](spark, LARGER)
    assert got.count() == documents(spark, LARGER).count()
    assert got.where("score is null or score < 0 or score > 1 or predicted != cast(score >= 0.3 as int)").count() == 0
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", F.col(label).alias("truth"))
    right = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("truth")).cast("int"))).first()[0]
    assert right >= least


def test_held_out_languages(spark):
    got = QUERIES["op10_language_id"](spark, LARGER)
    truth = documents(spark, LARGER).select("doc_id", "lang")
    joined = got.where("held_out").join(truth, "doc_id")
    assert joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97
    assert got.where("not accepted").count() <= 0.02 * got.count()


def test_no_python_in_the_native_operator(spark, sf_dir):
    plan = QUERIES["op2_url_trust"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
