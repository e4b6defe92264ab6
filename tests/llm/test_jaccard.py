"""Classes and links against the comparison of all pairs, and the edge cases."""

import random
import re

from demur.llm import jaccard as j


def plain(rows):
    """``[(doc_id, text)]`` to sorted ``(doc_id, class_id, n_links)``."""
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [[k for k, b in enumerate(sets) if k != i and a and b and 10 * len(a & b) >= 8 * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        out.append((doc_id, min((rows[k][0] for k in seen if rows[k][0] is not None), default=None), len(near[i])))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "m") for i, t in rows], "doc_id long, text string, c long, mins string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in j.near_duplicates(docs).collect()), key=repr)
    assert got == plain(rows)


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(j, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(j, "SET_BLOCK", 4)
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 160))]
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b"), (n + 4, "a  b"), (n + 5, "a b c"), (n + 6, "w " * 30000)]
    rows += [(n + 7, "w " * 20000), (3, rows[40][1]), (3, "other text here of six words"), (n + 8, None)]
    check(spark, rows)


def test_rows_without_id(spark):
    a = " ".join(f"w{i}" for i in range(150))
    near = a.replace("w149", "x")
    alone = " ".join(f"y{i}" for i in range(40))
    check(spark, [(None, a), (None, a), (1, near), (2, near), (None, alone), (None, alone + " z"), (None, None), (7, None)])
    check(spark, [(4, a), (4, near), (4, alone), (None, alone), (None, "b"), (None, "b")])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty_table(spark):
    assert j.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    fewest = j.fewest_matches(0.8)
    assert list(fewest) == list(j.STEPS) and all(0 < m < 0.8 * n for n, m in fewest.items())
    assert fewest[128] > 60
