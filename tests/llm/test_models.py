"""Recall of the neighbour search, the resampling's verdicts, and edge cases of both."""

import numpy as np

from demur.llm import importance, neighbours

SF = "/root/testdata/sf0.01"


def test_recall_and_odd_vectors(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = vectors.toPandas()
    x, ids = np.stack(rows["embedding"].to_numpy()).astype(float), rows["vec_id"].to_numpy()
    found = neighbours.search(vectors).toPandas()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        i = int(np.flatnonzero(ids == q)[0])
        d = np.sqrt(np.square(x - x[i]).sum(axis=1))
        d[i] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]])
        hits += len(want & set(found[found["query_id"] == q]["vec_id"]))
        total += 10
    assert hits >= 0.9 * total
    odd = spark.createDataFrame(
        [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, float("nan")]), (4, [1.0]), (5, [3.0, 2.0])],
        "vec_id long, embedding array<float>",
    )
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(odd).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 5, 2.0), (100, 1, 0, 0.0), (100, 2, 5, 2.0)]
    assert neighbours.search(odd.where("vec_id > 900")).count() == 0


def test_every_query_gets_k_rows(spark):
    # very many copies of few vectors, single vectors, repeated ids and columns with names of the search's own
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 6))
    x = np.concatenate([base[rng.integers(0, 3, 3000)], base[rng.integers(3, 12, 60)], rng.normal(size=(140, 6))])
    ids = [*range(3190), *[100] * 5, *range(3195, 3200)]
    rows = [(i, [float(v) for v in r], "p", 1) for i, r in zip(ids, x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part string, rank int").repartition(4)
    found = neighbours.search(vectors).toPandas()
    asked = [i for i in ids if i % 100 == 0]
    per_row = found.groupby("query_id").size()
    assert all(per_row[i] >= 10 for i in set(asked))
    assert not (found["query_id"] == found["vec_id"]).any()
    for i in set(asked) - {100}:
        mine = found[found["query_id"] == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine["score"].is_monotonic_increasing


def plain_hash(b):
    """64-bit hash of bytes as the library takes it."""
    m, base = 2**64 - 1, 0x9E3779B97F4A7C15
    return plain_mix((sum((v + 1) * pow(base, i, 2**64) for i, v in enumerate(b)) + len(b)) & m)


def plain_mix(h):
    m = 2**64 - 1
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = ((h ^ (h >> shift)) * factor) & m
    return h ^ (h >> 31)


def test_resampling_against_a_plain_version(spark):
    from collections import Counter
    from math import log

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(5000, None), (5001, ""), (5002, "one"), (5003, "one"), (5003, "one"), (5004, "word " * 30_000)]
    labels = [(i, int(i % 3 == 0)) for i, _ in rows[:150]] + [(9999, 1), (None, 1)]
    docs = spark.createDataFrame([(i, t, "k", 1.0) for i, t in rows], "doc_id long, text string, key string, log_weight double").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int")

    def buckets(text):
        words = [plain_hash(w.encode()) for w in (text or "").split()]
        pairs = [plain_mix((a * 0x9E3779B97F4A7C15 + b) & (2**64 - 1)) for a, b in zip(words, words[1:])]
        return [h % importance.BUCKETS for h in words + pairs]

    good = {i for i, q in labels if q == 1 and i is not None}
    found = [(i, buckets(t)) for i, t in rows]
    raw, target = Counter(), Counter()
    for i, b in found:
        raw.update(b)
        if i in good:
            target.update(b)
    n_raw, n_target, size = sum(raw.values()), sum(target.values()), importance.BUCKETS
    ratio = lambda b: log((target[b] + 1) / (n_target + size)) - log((raw[b] + 1) / (n_raw + size))
    u = {r[0]: r[1] for r in docs.selectExpr("doc_id", f"((xxhash64({importance.SEED}, doc_id) >> 11) + 4503599627370496 + 0.5D) / 9007199254740992D").collect()}
    want = []
    for i, b in found:
        weight = sum(map(ratio, b))
        want.append((i, len(b), weight, weight - log(-log(u[i]))))
    k = round(0.3 * len(rows))
    cut = sorted((-key, i) for i, _, _, key in want)[k - 1]
    got = importance.resample(docs, table, share=0.3).collect()
    assert len(got) == len(rows)
    by_id = {i: (n, w, key) for i, n, w, key in want}
    for r in got:
        n, w, key = by_id[r["doc_id"]]
        assert r["n_features"] == n and abs(r["log_weight"] - w) < 1e-6 * max(1, abs(w)) and abs(r["key"] - key) < 1e-6 * max(1, abs(key))
        assert r["kept"] == ((-key, r["doc_id"]) <= cut)


def test_resampling(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = importance.resample(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id", how="left")
    assert len(out) == docs.count()
    # k follows the labels' share of good rows, so some bad rows fill it up on this small table
    assert out[out["quality"] == 1]["kept"].mean() > 0.9 and out[out["quality"] == 0]["kept"].mean() < 0.5
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "a b c")], "doc_id long, text string")
    assert importance.resample(odd, labels, share=0.5).count() == 4
    assert importance.resample(odd.where("doc_id > 9"), labels).count() == 0
