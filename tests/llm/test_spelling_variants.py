"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwise.llm import spelling_variants as variants
from headwise.llm.queries import QUERIES

from .test_llm_edges import CLASHING, SCHEMA, TEXTS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows, drop_every=31):
    """{word: (form, root, n, n_near, form_n)} of (doc_id, text) rows."""
    counts = Counter()
    for key, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if drop_every and h % drop_every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += len(word) >= 7
    n = {w: c for w, c in counts.items() if c >= 2}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def got(frame):
    rows = frame.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    drawn = random.Random(4)
    base = ["international", "recommended", "élémentaire", "stressed", "desserts", "×÷×÷×÷×",
            "abcabcabc", "aaaaaaaa", "b" * 300]
    texts = list(TEXTS)
    for word in base:
        for k in range(6):
            other = word
            for _ in range(k):
                at = drawn.randrange(len(other))
                other = drawn.choice([other[:at] + other[at + 1:], other[:at] + drawn.choice("abeéÿ") + other[at:],
                                      other[:at] + drawn.choice("rstè") + other[at + 1:]])
            texts += [f"{other} {word.upper()}. " * drawn.choice([1, 2, 15])]
    chain = ["chainedx", "chainedy", "chainedyy", "chainedyyz"]
    texts += [f"{w} " * (2 * 10**k) for k, w in enumerate(chain)]
    texts += ["ties aaaaaab aaaaaab " + "aaaaaac aaaaaad " * 20, "sevenupĀsevenupªsevenup_sevenup0sevenup"]
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)]
    rows += rows[18:24] + [(None, "Noidhere noidhere NOIDHERE", None, None, None)]
    path = str(tmp_path_factory.mktemp("variants"))
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.withColumns({c: F.lit("clash") for c in [*CLASHING, "word", "form", "root", "near", "unit", "best"]}).write.parquet(
        f"{path}/documents.parquet")
    return path, [r[:2] for r in rows]


def test_edges(spark, folder, tmp_path):
    path, rows = folder
    want = plain_variants(rows)
    assert len(want) > 40 and sum(w[0] is not None for w in want.values()) > 5
    assert got(QUERIES["op13_spelling_variants"](spark, path)) == want
    spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    assert got(QUERIES["op13_spelling_variants"](spark, str(tmp_path))) == {}


def test_small_cells_and_batches(spark, folder, monkeypatch):
    path, rows = folder
    monkeypatch.setattr(variants, "HELD_WORDS", 7)
    monkeypatch.setattr(variants, "QUERY_ROWS", 5)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for cell_words in (1, 4, 20):
        assert got(variants.spelling_variants(docs, cell_words=cell_words)) == plain_variants(rows, None)


def test_anagrams_are_divided_by_hash(spark):
    drawn = random.Random(9)
    words = {"".join(drawn.sample("abcdefgh", 8)) for _ in range(400)}
    words |= {w[:3] + "z" + w[4:] for w in list(words)[:80]}
    rows = [(i, f"{w} " * drawn.choice([2, 3, 40])) for i, w in enumerate(sorted(words))]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert got(variants.spelling_variants(docs, cell_words=16)) == plain_variants(rows, None)


def test_tree_search_is_exact():
    drawn = np.random.default_rng(2)
    letters = drawn.choice(np.frombuffer(b"aeinst\xe9\xff", dtype=np.uint8), size=(900, 8))
    counts, bits = variants.letter_counts(letters)
    tree = variants.LetterTree(counts, bits)
    pairs = {(int(i), int(j)) for one, other in tree.within(bits[:200], 2) for i, j in zip(one, other)}
    unlike = np.bitwise_count(bits[:200, None] ^ bits[None]).sum(axis=2)
    assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(unlike <= 2))}
    whole = np.stack([(letters == c).sum(axis=1) for c in np.unique(letters)], axis=1)
    assert (unlike <= np.abs(whole[:200, None] - whole[None]).sum(axis=2)).all()


def test_one_edit():
    words = [bytes(x) for x in np.random.default_rng(3).choice(np.frombuffer(b"ab", dtype=np.uint8), size=(40, 5))]
    for a in words:
        for b in words + [w[:k] + b"b" + w[k:] for w in words for k in (0, 3, 5)]:
            pair = [np.frombuffer(x, dtype=np.uint8)[None] for x in (a, b)]
            assert bool(variants.one_edit(*pair)[0]) == one_edit(a, b)
