"""Queries over all columns, which have no SQL, against brute force."""

import itertools

import numpy as np

import __spark_entry__ as entry
from demur.plans import views
from demur.plans.queries.prepare import KENDALL

SF = "/root/testdata/sf0.001"


def test_mahalanobis_over_all_numbers(spark):
    rows = views.vectors_view(spark, SF).select("row_id", "vec").orderBy("row_id").collect()
    ids, x = np.array([r["row_id"] for r in rows]), np.array([r["vec"] for r in rows])
    vi = np.linalg.inv(np.cov(x, rowvar=False))
    found = {}
    for r in entry.queries()["knn_metric_mahalanobis_full"](spark, SF).collect():
        found.setdefault(r["row_id"], {})[r["rank"]] = (r["ref_id"], r["dist"])
    assert len(found) == len(ids) and x.shape[1] == 64
    for i, at in enumerate(ids):
        d = np.round(np.sqrt(np.einsum("ij,jk,ik->i", x - x[i], vi, x - x[i])), 9)
        best = [k for k in np.lexsort((ids, d)) if k != i][:7]
        got = [found[at][k] for k in range(1, 8)]
        assert [g[0] for g in got] == list(ids[best]), at
        assert np.allclose([g[1] for g in got], d[best], atol=1e-5)


def test_profile_of_all_columns(spark):
    rows = [r.asDict() for r in views.orders_view(spark, SF).collect()]
    out = {r["column_name"]: r for r in entry.queries()["table_profile_full"](spark, SF).collect()}
    assert set(out) == set(rows[0]) and {"avg_discount", "avg_tax"} <= set(out)
    for c, r in out.items():
        values = [x[c] for x in rows]
        assert r["n_rows"] == len(rows) and r["n_null"] == values.count(None), c
        assert r["n_distinct"] == len({v for v in values if v is not None}), c


def test_kendall_with_the_price(spark):
    columns = [*KENDALL, "l_extendedprice"]
    x = spark.read.parquet(f"{SF}/lineitem.parquet").select(*columns).toPandas().dropna().astype(float)
    out = {(r["col_a"], r["col_b"]): r for r in entry.queries()["kendall_matrix_full"](spark, SF).collect()}
    assert set(out) == set(itertools.combinations(columns, 2))
    v = {c: x[c].to_numpy() for c in columns}
    for (a, b), r in out.items():
        s = sx = sy = 0.0
        for p, q in zip(v[a], v[b]):
            dx, dy = np.sign(v[a] - p), np.sign(v[b] - q)
            s, sx, sy = s + float(dx @ dy), sx + float(np.abs(dx).sum()), sy + float(np.abs(dy).sum())
        assert r["n"] == len(x) and abs(r["tau_b"] - s / np.sqrt(sx * sy)) < 2e-6, (a, b)
