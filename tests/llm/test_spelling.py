"""Word counts, near words, forms and roots against plain loops."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from demur.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def plain_counts(rows, least=5, one_in=97):
    out = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(counts, ratio=2):
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    out = {}
    for w, n in counts.items():
        near = [x for m in (-1, 0, 1) for x in by_length.get(len(w) + m, []) if edit_one(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form, n, len(near), counts[form] if form else None]
    rows = {}
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, n, n_near, form_n)
    return rows


def grouped(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variant_groups(words).collect()}


def made_words(seed, size):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(size)}
    return {w: rng.choice([3, 3, 4, 6, 7, 12, 24, 50, 100]) for w in words}


def test_counts(spark):
    rng = random.Random(3)
    words = ["Écran", "house", "HOUSE", "hou", "a", "Straße", "x" * 200, "über", "naïve", "×÷×÷×", "日本", "l'été", "word1word", "Ābcdef"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(60))) + rng.choice(["", "\n", ",x"])) for i in range(400)]
    rows += [(5, None), (6, ""), (7, "seven" * 40_000), (8, "sixes " * 20_000), (8, "sixes " * 20_000)]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    for one_in in (97, 3, None):
        got = {r["word"]: r["n"] for r in spelling.count_words(docs, 5, one_in).collect()}
        assert got == dict(plain_counts(rows, 5, one_in))
    assert spelling.count_words(docs.where("doc_id < 0"), 5, 97).count() == 0


def test_crc_of_runs():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 2000, dtype=np.uint8)
    start = np.array([0, 5, 5, 100, 400, 900])
    end = np.array([1, 5, 9, 180, 464, 965])
    before = np.array([zlib.crc32(b"p%d" % i) for i in range(6)], np.uint32)
    want = [zlib.crc32(data[x:y].tobytes(), int(b)) for x, y, b in zip(start, end, before)]
    assert spelling.crc_of_runs(data, start, end, before).tolist() == want


@pytest.mark.parametrize("seed,size", [(1, 1500), (2, 40)])
def test_groups(spark, seed, size):
    counts = made_words(seed, size)
    assert grouped(spark, counts) == plain_groups(counts)


def test_large_blocks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", 7)
    monkeypatch.setattr(spelling, "PIECE", 11)
    counts = made_words(4, 900)
    assert grouped(spark, counts) == plain_groups(counts)


def test_ties_long_words_and_empty_table(spark):
    long = "ab" * 3000
    counts = {long: 5, long[:-1]: 10, long[:-1] + "c": 10, "hause": 3, "house": 6, "hausé": 6, "mause": 12, "mouse": 24, "apple": 1, "b": 4, "c": 9, "": 2}
    assert grouped(spark, counts) == plain_groups(counts)
    assert spelling.variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0


def test_query_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = plain_groups({w: n for w, n in plain_counts(rows).items() if n >= 3})
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.op11_spelling_variants(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
