"""Runs against all periods of all texts, and the parts of the search by themselves."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from demur.llm import periods

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(w, min_length=24, exponent=3):
    code = {x: i for i, x in enumerate(dict.fromkeys(w))}
    v, n, out = np.array([code[x] for x in w], int), len(w), []
    for q in range(1, n // exponent + 1):
        same = np.concatenate([[False], v[:-q] == v[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            size = e - s + q
            if size >= max(min_length, exponent * q):
                part = v[s : s + size]
                if not any((part[:-k] == part[k:]).all() for k in range(1, q)):
                    out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found(spark, texts, *args):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, start int, runs string")
    return {r["doc_id"]: r for r in periods.collapse_runs(docs.repartition(3), *args).collect()}


def made(seed, n_texts):
    rng = random.Random(seed)
    texts = []
    for _ in range(n_texts):
        parts = []
        for _ in range(rng.randrange(6)):
            root = [rng.choice(["a", "b", "cé", "日"]) for _ in range(rng.randrange(1, rng.choice([3, 12, 40])))]
            parts += (root * rng.randrange(1, 9))[: rng.randrange(1, 130)]
            if rng.random() < 0.2:
                parts *= rng.randrange(1, 5)
        texts.append(rng.choice([" ", "\n", "  \t"]).join(parts))
    return texts


@pytest.mark.parametrize("args", [(), (24, 3), (10, 4), (3, 3), (2, 3), (60, 5)])
def test_against_all_periods(spark, args):
    texts = [*made(len(args), 150), None, "", " \n", "x", "x " * 23, "x " * 24, "a b " * 2000, ("u v w " * 30 + "k ") * 40]
    got = found(spark, texts, *args)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        want = plain_runs(w, *args)
        assert [tuple(r) for r in got[i]["runs"]] == want, (i, t)
        assert got[i]["collapsed"] == collapsed(w, want) and got[i]["n_words"] == len(w)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "p q " * 20), (1, "p q " * 20), (None, "z " * 30), (None, None)], "doc_id long, text string")
    out = periods.collapse_runs(docs).collect()
    assert sorted(r["collapsed"] for r in out) == ["", "p q", "p q", "z"]
    assert periods.collapse_runs(docs.where("doc_id > 5")).count() == 0
    with pytest.raises(ValueError):
        periods.collapse_runs(docs, 24, 2)


def test_query_on_documents(spark):
    want = {}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    for r in rows:
        w = WORD.findall(r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = plain_runs(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want[r["doc_id"]] = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(collapsed(w, runs)))
    got = {r[0]: tuple(r)[1:] for r in periods.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and sum(v[0] for v in want.values()) > 5


def test_range_successor():
    rng = np.random.default_rng(2)
    values = rng.permutation(700)
    low = rng.integers(0, 700, 300)
    high = np.minimum(700, low + rng.integers(0, 200, 300))
    least = rng.integers(0, 1100, 300)
    got = periods.Wavelet(values).successor(low, high, least)
    want = [min((x for x in values[a:b].tolist() if x >= v), default=-1) for a, b, v in zip(low, high, least)]
    assert got.tolist() == want


def test_blocks_are_intervals_of_the_suffix_array():
    rng = np.random.default_rng(3)
    text = np.append(np.tile(rng.integers(0, 3, 40), 6)[rng.integers(0, 3) :], 99)
    array, blocks = periods.repeated_blocks(text, 2, 60)
    seen = set()
    for at, low, high, size in zip(*(c.tolist() for c in blocks[:4])):
        block = text[at : at + size].tolist()
        assert sorted(array[low:high].tolist()) == [i for i in range(len(text)) if text[i : i + size].tolist() == block]
        seen.add((at, size))
    for size in (2, 3, 4, 6, 8, 12, 16, 24, 32, 48):
        for at in range(0, len(text) - size, max(1, size // 4)):
            many = sum(text[i : i + size].tolist() == text[at : at + size].tolist() for i in range(len(text)))
            assert ((at, size) in seen) == (many > 1)
