"""Contamination against all windows of all items, and the guarantee of the fingerprints."""

import random
import re

import numpy as np

from demur.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(len(w), 10)
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(g) for g in windows}
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, named = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                g = windows.get(tuple(w[i : i + k]))
                if g is not None:
                    hit |= set(range(i, i + k))
                    named |= g
        spans = [p for p in sorted(hit) if p - 1 not in hit]
        ends = [p + 1 for p in sorted(hit) if p + 1 not in hit]
        out.append((doc_id, len(w), len(hit), list(zip(spans, ends)), sorted(str(x) for x in named if x is not None)))
    return sorted(out, key=repr)


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, n_hit int").repartition(5)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, gram int").repartition(3)
    got = [
        (r["doc_id"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"]) for r in winnow.contamination(d, b).collect()
    ]
    assert sorted(got, key=repr) == plain(docs, items)


def made(seed):
    rng = random.Random(seed)
    say = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choice(["ab", "Cd", "é日", "x1", "é日", "DE", "f"]) for _ in range(n))
    items = [(i if i % 9 else None, say(rng.choice([0, 1, 3, 7, 9, 10, 11, 14, 30, 60]))) for i in range(30)]
    items += [(3, items[4][1]), (50, items[5][1]), (51, items[5][1]), (52, None), (53, "..."), (54, "z " * 40), (55, "q w " * 30)]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(5)):
            w = (rng.choice(items)[1] or "").split()
            x = rng.randrange(len(w) + 1)
            parts += w[x : x + rng.randrange(25)] + say(rng.randrange(12)).split()
        docs.append((rng.randrange(60) if i % 11 else None, " ".join(parts)))
    docs += [(1, None), (2, ""), (4, "z " * 20_000), (5, "q w " * 9_000 + "z"), (6, docs[0][1]), (6, docs[0][1]), (7, "!?")]
    return docs, items


def test_against_all_windows(spark):
    for seed in (1, 2):
        check(spark, *made(seed))


def test_small_bitmap_and_no_short_items(spark, monkeypatch):
    monkeypatch.setattr(winnow, "FEW_BITS", 3)
    monkeypatch.setattr(winnow, "MANY_BITS", 15)
    docs, items = made(3)
    check(spark, docs, [(i, t) for i, t in items if len(words(t)) >= 10])


def test_empty_tables(spark):
    docs, items = made(4)
    check(spark, docs[:20], [])
    check(spark, [], items)


def test_documents_against_plain(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").collect()
    docs = [(r["doc_id"], r["text"]) for r in read("documents")]
    items = [(r["item_id"], r["text"]) for r in read("benchmark")]
    check(spark, docs, items)


def test_shared_windows_share_a_fingerprint():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 4, 3000).astype(np.uint64)
    limits = np.array([0, 7, 7, 17, 500, 3000])
    at, _ = winnow.winnowed(h, limits)
    chosen = set(at.tolist())
    by_window = {}
    for x, y in zip(limits[:-1], limits[1:]):
        for i in range(x, y - winnow.WINDOW + 1):
            inside = {p - i for p in range(i, i + winnow.WIDE) if p in chosen}
            assert inside
            by_window.setdefault(h[i : i + winnow.WINDOW].tobytes(), []).append(inside)
    assert all(set.intersection(*v) for v in by_window.values())
