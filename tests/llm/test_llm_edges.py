"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from headwise.llm import (
    adaptive_jaccard, best_fit, byte_bpe, collision_dedup, components, host_trust, impact_topk, language_id, quality,
    run_length_dedup, toxicity,
)

from . import plain

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
STORY = " ".join(f"word{i % 97}x{i}" for i in range(120))
TEXTS = [
    None, "", "  \n\t ", "x", "one two", "one two", "ONE two", STORY, STORY, STORY.replace("x5 ", "y5 "), PASSAGE,
    "before it " + PASSAGE + " after it", "\u00e9\u00e8 " * 150, "a" * 3000, "ab" * 700, "long " * 40000,
    "tail  of   blanks \n  here ", "don't we'll 12345 \u4f60\u597d \U0001f600 <|endoftext|>",
]
#: names that the operators use inside
CLASHING = ["score", "held_out", "sid", "rid", "hub", "n", "h", "comp", "component_id", "spans", "kept", "chunk", "bucket", "ids",
            "length", "piece", "begin", "wanted", "m", "a", "b", "_row", "label", "quality", "toxic", "id", "v", "copy", "host"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de"][i % 2], "s", 0) for i, t in enumerate(TEXTS)] + [(None, "no id here", "en", None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(len(TEXTS))] + [(3, None, None), (None, 1, 1)],
                                 "doc_id bigint, quality int, toxic int")


def test_jaccard(docs, nothing):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in adaptive_jaccard.near_copies(docs, 4, 85).collect()}
    assert got.pop(None) == (1, None)
    assert got == plain.near_copies(dict(enumerate(TEXTS)), 4, 85)
    assert adaptive_jaccard.near_copies(nothing).count() == 0


def test_jaccard_groups_without_a_common_original(spark):
    words = [f"w{i}" for i in range(200)]
    texts = {}
    for k in range(60):  # a chain of edits, twice over, and a few strays
        copy = list(words)
        for j in range(k // 2):
            copy[(7 * j) % 200] = f"edit{j}"
        texts[k] = " ".join(copy[:190 + k % 5])
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in adaptive_jaccard.near_copies(frame, 4, 85).collect()}
    assert got == plain.near_copies(texts, 4, 85)


@pytest.mark.parametrize("crowded", [2048, 1])
def test_repeats(docs, nothing, monkeypatch, crowded):
    monkeypatch.setattr(run_length_dedup, "CROWDED", crowded)
    texts = TEXTS[:15] + TEXTS[16:]
    rows = run_length_dedup.remove_repeats(docs.where("doc_id is not null and doc_id != 15"), 200).orderBy("doc_id").collect()
    got = [(r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows]
    assert got == plain.repeats(texts, 200)
    assert run_length_dedup.remove_repeats(nothing).count() == 0


def test_repeated_long_row(docs):
    twice = docs.where("doc_id = 15").select("doc_id", "text")
    for r in run_length_dedup.remove_repeats(twice.union(twice)).collect():
        assert (r.n_bytes, len(r.kept), len(r.spans)) == (200000, 0, 1)


def test_equal_rows_find_their_spans_once(spark):
    rows = [(1, PASSAGE + " and " + STORY)] * 300 + [(2, "before " + PASSAGE)]
    keyed = run_length_dedup.with_rid(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = run_length_dedup.remove_repeats(keyed.select("doc_id", "text"), 200).groupBy("doc_id", "spans").count().collect()
    assert sorted((r.doc_id, len(r.spans), r["count"]) for r in got) == [(1, 1, 300), (2, 1, 1)]


def test_repeats_far_into_a_long_text(spark):
    drawn = np.random.default_rng(8)
    shared = drawn.integers(97, 123, 700, dtype=np.uint8).tobytes()
    long = drawn.integers(97, 123, (1 << 24) + 400_000, dtype=np.uint8).tobytes()
    at = (1 << 24) + 150_000
    long = long[:at] + shared + long[at:]
    texts = [long, b"A" + shared + b"B"]
    text, start, number, _, _, place = run_length_dedup.contexts(texts, 200)
    sizes = np.array([len(t) for t in texts]) - 199
    assert np.bincount(text, weights=number).tolist() == sizes.tolist()  # every start once
    assert (place >= 0).all() and (place + run_length_dedup.GRAM <= number + 199).all()
    rows = run_length_dedup.remove_repeats(spark.createDataFrame(
        [(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string"), 200).orderBy("doc_id").collect()
    assert [[tuple(s) for s in r.spans] for r in rows] == [[(at, at + 700)], [(1, 701)]]
    assert [bytes(r.kept) for r in rows] == [long[:at] + long[at + 700:], b"AB"]


def test_run_length_index_marks_both_sides():
    index = run_length_dedup.RunLengthIndex([b"xx" + b"abcdefgh" * 3, b"yy" + b"abcdefgh" * 3 + b"z"])
    first, last = index.repeated(20)
    starts = {(int(a), int(b)) for a, b in zip(first, last)}
    covered = {p for a, b in starts for p in range(a, b + 1)}
    assert covered == {2, 3, 4, 5, 6, 29, 30, 31, 32, 33}


def test_bpe(docs, nothing, spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    got = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in coded.collect()}
    import tiktoken

    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for i, text in [*enumerate(TEXTS), (None, "no id here")]:
        assert got[i] == (encoder.encode_ordinary(text or ""), (text or "").encode())
    assert byte_bpe.encode(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_codes_round_trip():
    import numpy as np

    codes = np.array([0, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**30])
    assert byte_bpe._unpack_codes(byte_bpe._pack_codes(codes)).tolist() == codes.tolist()


def test_packing(docs, nothing, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = best_fit.pack(best_fit.pieces(docs, path)).collect()
    assert sum(r.doc_id == 0 and r.length == 1 for r in got) == 1
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 15)
    assert all(n == 2048 for _, _, n in long[1:]) and long[0][2] <= 2048
    bins = {r.sequence_id for r in got}
    assert len(bins) == plain.best_fit_bins([r.length for r in got], 2048)
    assert best_fit.pack(best_fit.pieces(nothing, path)).count() == 0


def test_ranks_are_those_of_the_file():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as held:
        vocabulary = json.load(held)["model"]["vocab"]
    ranks = best_fit.merge_ranks(public_tokenizers.path("byte_bpe_50k.json"))
    assert ranks == byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert len(best_fit.byte_characters()) == 256 and vocabulary["\u0120the"] == ranks[b" the"]
    assert best_fit.merge_ranks(public_tokenizers.path("word_bpe_49k.json")) is None


@pytest.mark.parametrize("by_ranks", [True, False])
def test_word_ids_equal_the_library(monkeypatch, by_ranks):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(best_fit, "CACHED_WORDS", 6)  # the generations of the cache change all the time
    known, library = best_fit.WordIds(path, best_fit.merge_ranks(path) if by_ranks else None), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    odd = ["a  b", " a", "a ", "  ", "x \n y", "x\u00a0y \u00a0z", "a \u3000b", "don't I'll", "\u0120x \u0120", "1 2 12345", "<|endoftext|> b", "_ __ a_b"]
    for text in [*odd, *TEXTS[1:], " ".join(odd), " ".join(f"w{i % 9} v{i}" for i in range(60))]:
        first, *rest = best_fit.spaced_words(text)
        ids = b"".join([known.whole(first), *known.of(rest)])
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert len(known.young) <= 6 and len(known.old) <= 6


@pytest.mark.parametrize("lengths", [[1] * 5000, [2048] * 3, [1500, 548, 548, 1500, 1, 1], list(range(1, 700)) * 3, [700] * 7 + [600] * 9])
def test_rules_equal_the_sequential_algorithm(lengths):
    from collections import Counter

    rules = best_fit.best_fit_rules(dict(Counter(lengths)))
    filled = {}
    for length, low, high, first, at, per in rules:
        for o in range(high - low):
            filled.setdefault(first + o // per, []).append((at + o % per * length, length))
    assert sum(map(len, filled.values())) == len(lengths)
    for parts in filled.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 2048
    assert len(filled) == plain.best_fit_bins(lengths, 2048)


def vectors(spark):
    import random

    r = random.Random(1)
    rows = [(i, [r.choice([-0.5, 0.25, 0.25, 1.0]) for _ in range(6)], i % 3) for i in range(260)]
    rows += [(500, None, 1), (501, [0.5, None, 1.0, 0.0, 0.0, 0.0], 1), (502, [float("nan")] * 6, 1), (503, [0.0] * 6, 1),
             (504, [float("inf")] + [0.0] * 5, 1), (505, [1.0, 0.0], 1), (506, [], 1), (600, [0.5] * 6, None), (7, rows[7][1], 1),
             (7, rows[7][1], 1), (None, [1.0] * 6, 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return rows, frame.withColumns({c: F.lit("clash") for c in ("id", "v", "n", "copy", "sub", "cell", "component_id", "score", "rank")})


def test_top_k(spark, monkeypatch):
    rows, frame = vectors(spark)
    monkeypatch.setattr(impact_topk, "LEAST_BLOCK", 64)
    got = {}
    for r in impact_topk.search(frame, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == plain.top_scores([(i, v) for i, v, _ in rows], 10)
    assert impact_topk.search(frame.where("vec_id < 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize("block", [512, 16])
def test_embedding_links(spark, block):
    import numpy as np

    rows, frame = vectors(spark)
    got = sorted(tuple(r) for r in collision_dedup.near_duplicates(frame, block=block).collect())
    sound = [(k, i, np.array(v, float) / np.linalg.norm(v), label) for k, (i, v, label) in enumerate(rows)
             if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a in sound for b in sound if a[0] != b[0] and a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] >= 0.98]
    least = plain.closure({i for i, _, _ in rows if i is not None}, [(a[1], b[1]) for a, b in links])
    count = {k: sum(a[0] == k for a, _ in links) for k in range(len(rows))}
    assert got == sorted((i, count[k], least[i], i == least[i]) for k, (i, _, _) in enumerate(rows) if i is not None)
    assert collision_dedup.near_duplicates(frame.where("vec_id < 0")).count() == 0


def test_near_links_are_found(spark):
    import numpy as np

    r = np.random.default_rng(3)
    base = r.normal(size=(40, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = r.normal(size=(40, 10, 64))
    noise /= np.linalg.norm(noise, axis=2, keepdims=True)
    rows = [(10 * i + j, (base[i] + 0.13 * noise[i, j]).astype("f4").tolist(), 0) for i in range(40) for j in range(10)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.98).sum() - len(rows)
    assert true > 200
    assert collision_dedup.near_duplicates(frame).agg(F.sum("n_links")).first()[0] >= 0.97 * true


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(300) if i != 150] + [(5, 5), (7, 6), (7, 6)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == plain.closure(range(301), links)
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_urls(spark):
    urls = [None, "no scheme", "http://EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "http://a.net/es/1", "http://a.net/other",
            "x://net/fr/", "http://com", "http://b.org#top", "http://b.org#top", "http://c.b.org/p"]
    html = '<a href="http://a.net/es/1">1</a> <a HREF=\'//no\'> <a href=http://evil.org/>'
    pages = spark.createDataFrame([(i, u, None if i == 3 else html) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "trust", "n", "src", "dst", "fit")})
    rows = host_trust.judge(pages).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[0] == ("", "", None, "allow") and got[1] == ("", "", None, "allow")
    assert got[2] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[3] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[4] == ("a.net", "/es/1", "net/es/", "block")
    assert all(r.verdict == ("block" if (r.distrust or 0) > (r.trust or 0) else "allow") for r in rows if r.rule is None)
    assert got[6] == ("net", "/fr/", "net/fr/", "block")
    assert got[7] == ("com", "", None, "allow")
    assert got[8] == got[9] and got[8][:3] == ("b.org", "", None) and got[8][3] == "block"  # links to a blocked host
    assert host_trust.judge(pages.where("page_id < 0")).count() == 0


def test_walks_on_a_link_graph(spark):
    drawn = np.random.default_rng(7)
    hosts = [f"h{i}.org" for i in range(40)] + ["good.com", "b.net", "c.net"]
    rows = []
    for i, host in enumerate(hosts):
        for page in range(int(drawn.integers(1, 4))):
            out = drawn.choice(hosts, size=4) if i % 7 else []
            kind = ["http://", "//", "https://"]
            html = " ".join(f'<a href="{kind[k % 3]}{h}/x">' for k, h in enumerate(out))
            rows.append((len(rows), f"http://{host}/{'es' if page == 0 else 'fr'}/{page}", html))
    chain = [f"far{i}.info" for i in range(15)]  # a host fifteen links from a blocked one is reached
    rows += [(len(rows) + i, f"http://{h}/", f'<a href="//{n}/">') for i, (h, n) in enumerate(zip(chain, [*chain[1:], "b.net"]))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: (r.trust, r.distrust, r.verdict) for r in host_trust.judge(pages).where("rule is null").collect()}
    trust, distrust = plain.walks(rows, host_trust.RULES, 0.85, 400)
    for host, (t, d, verdict) in got.items():
        assert abs(t / host_trust.SCALE - trust.get(host, 0)) <= host_trust.REMAINDER
        assert abs(d / host_trust.SCALE - distrust.get(host, 0)) <= host_trust.REMAINDER
        assert verdict == ("block" if d > t else "allow")
    assert len(got) == 55 and got["far0.info"][2] == "block" and {v for _, _, v in got.values()} == {"allow", "block"}


def test_classifiers(docs, nothing, labels):
    for operator in (quality, toxicity):
        rows = operator.classify(docs, labels).collect()
        assert len(rows) == len(TEXTS) + 1 and all(0 <= r.score <= 1 for r in rows)
        assert operator.classify(nothing, labels).count() == 0
        without = {round(r.score, 6) for r in operator.classify(docs, labels.where("doc_id < 0")).collect()}
        assert without == {0.5 if operator is quality else 0.0} or (operator is toxicity and len(without) == 1)


def test_toxicity_keeps_rare_features_beside_many_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_CODES", 1 << 18, raising=False)
    drawn = np.random.default_rng(5)
    mild = drawn.integers(97, 123, 7000, dtype=np.uint8).tobytes().decode()  # about 21,000 features
    rare = "zq0 jx1 vk2 wq3 xj4"
    rows = [(i, f"plain words {i} " + (rare if i % 4 == 0 else mild), 1) for i in range(100)]
    rows += [(i, f"plain words {i} " + (mild if i % 5 == 0 else ""), 0) for i in range(100, 1100)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert np.count_nonzero(model.weights) > 16384
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(scores[i] for i in range(0, 100, 4)) >= toxicity.THRESHOLD
    assert max(scores[i] for i in range(100, 1100) if i % 5) < toxicity.THRESHOLD


def test_toxicity_rows_are_packed_without_loss():
    drawn = np.random.default_rng(6)
    for size in (0, 1, 33, 5000):
        rows = [np.flatnonzero(drawn.random(size) < share) for share in (0, 0.01, 0.04, 0.5, 1)]
        number = np.array([len(r) for r in rows])
        packed = [toxicity.packed_row(r, size) for r in rows]
        assert all(len(p) <= -(-size // 8) for p in packed)
        blocks = toxicity.row_blocks(packed, number, size)
        assert [(a, b) for a, b, _ in blocks][-1][1] == len(rows)
        got = np.concatenate([toxicity.unpacked(held, number[a:b], size) for a, b, held in blocks])
        assert got.tolist() == np.concatenate(rows).tolist()


def test_language(docs, nothing):
    rows = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(rows) == len(TEXTS) + 1
    for i in (0, 1, 2):
        assert (rows[i].lang_pred, rows[i].score, rows[i].accepted) == ("und", 0.0, False)
    assert rows[3].lang_pred in ("en", "de")
    assert language_id.identify(nothing).count() == 0


@pytest.fixture(scope="module")
def folder(docs, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels.where("doc_id < 0").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_on_edges(spark, folder, tmp_path):
    got = corpus_pipeline.run(spark, folder)
    kept = {r.doc_id for r in got.collect()}
    assert not kept & {0, 1, 2}  # no letters
    assert 5 not in kept and 8 not in kept  # copies of 4 and 7
    assert {3, 4, 7} <= kept
    spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_tell_rows_apart_by_id_and_text(spark, tmp_path):
    other = " ".join(f"other{i}" for i in range(90))
    rows = [(3, STORY), (5, STORY), (5, other), (5, other), (6, STORY.replace("x5 ", "y5 ")), (7, None), (7, None), (8, ""), (None, STORY),
            (9, other + " and more"), (2, "short one"), (2, "short two"), (2, "short one")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("_key", F.lit("clash"))
    kept = sorted((tuple(r)[:2] for r in corpus_pipeline.near_copy_stage(spark, docs, str(tmp_path)).collect()), key=str)
    assert kept == sorted([(3, STORY), (5, other), (7, None), (8, ""), (None, STORY), (2, "short one"), (2, "short two")], key=str)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == corpus_pipeline.COLUMNS, name
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = {i for i, (_, c) in plain.near_copies(texts, 5, 80).items() if i == c}
    assert {r.doc_id for r in corpus_pipeline.near_copy_stage(spark, docs, sf_dir).collect()} == first
