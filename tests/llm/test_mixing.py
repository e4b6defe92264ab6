"""Budgets against a plain recursion, prefixes against a plain order, and the edge cases."""

import pytest

from demur.llm import mixing as m

SF = "/root/testdata/sf0.001"
WEIGHTS = {"lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def split(leaves, path, depth, give, names, epochs):
    """Fills children by weight, again and again as some are full."""
    if depth == len(names):
        return {path: give}
    kids = sorted({p[: depth + 1] for p in leaves if p[:depth] == path})
    cap = {k: epochs * sum(v for p, v in leaves.items() if p[: depth + 1] == k) for k in kids}
    weight = {k: WEIGHTS.get(names[depth], {}).get(k[-1], 1.0) for k in kids}
    share, open_, left = dict.fromkeys(kids, 0.0), set(kids), min(give, sum(cap.values()))
    while open_ and left > 1e-9:
        unit = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if cap[k] - share[k] <= unit * weight[k] + 1e-12}
        for k in full or open_:
            add = cap[k] - share[k] if full else unit * weight[k]
            share[k] += add
            left -= add
        open_ = open_ - full if full else set()
    out = {}
    for k in kids:
        out |= split(leaves, k, depth + 1, share[k], names, epochs)
    return out


@pytest.mark.parametrize("share,epochs", [(1.0, 4), (0.5, 1), (3.0, 2), (0.95, 1), (9.0, 2)])
def test_budgets_and_prefixes(spark, share, epochs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = m.mix(docs, budget_share=share, max_epochs=epochs, weights=WEIGHTS).collect()
    assert len(rows) == docs.count()
    names = list(m.LEVELS)
    leaves: dict = {}
    for r in rows:
        leaves.setdefault(tuple(r[n] for n in names), []).append(r)
    tokens = {k: sum(r["n_tokens"] for r in v) for k, v in leaves.items()}
    want = split(tokens, (), 0, share * sum(tokens.values()), names, epochs)
    for k, v in leaves.items():
        budget = v[0]["leaf_budget"]
        assert budget == pytest.approx(want[k], rel=1e-6, abs=1e-6)
        used = sum(r["epochs"] * r["n_tokens"] for r in v)
        counts = {r["epochs"] for r in v}
        assert used <= budget + 1e-6 and max(counts) - min(counts) <= 1 and max(counts) <= epochs
        # the next document in the order would not fit
        left = [r["n_tokens"] for r in v if r["epochs"] == min(counts)]
        if len(counts) == 2 or min(counts) < epochs:
            assert used + max(left) > budget - 1e-6


def test_rows_of_the_mixture(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", "en", "s1", 9), (1, "a b c", "en", "s1", 9), (2, None, None, None, None), (3, "d", "de", "x", 1)],
        "doc_id long, text string, lang string, source string, domain int",
    )
    out = m.mixed_documents(docs, budget_share=2.0, max_epochs=2)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] != 2) == [1, 1, 1, 1, 3, 3]
    assert m.mix(docs.where("doc_id > 9")).count() == 0


def test_same_seed_same_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r["doc_id"] for r in m.mixed_documents(docs, budget_share=0.5, max_epochs=1).select("doc_id").collect()}
    b = {r["doc_id"] for r in m.mixed_documents(docs.repartition(7), budget_share=0.5, max_epochs=1).select("doc_id").collect()}
    assert a == b and 0 < len(a) < docs.count()
