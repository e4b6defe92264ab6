"""Cleaning, encodings, splits, readers and named datasets on small files."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demur.functions import text as tx
from demur.operators import prep, profile
from demur.operators import split as sp
from demur.plans import datasets
from demur.session import shared_dir, small_table
from demur.sources import scan


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"t {kind}")


def test_bathrooms(spark):
    texts = ["2.5 baths", "1 bath", "Half-bath", "Shared half-bath", "3 shared baths", None, "1 private bath"]
    got = column(spark, texts).select(tx.bathroom_count(F.col("t")), tx.bathroom_type(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [
        (2.5, "regular bath"), (1.0, "regular bath"), (0.5, "regular bath"), (0.5, "shared bath"),
        (3.0, "shared bath"), (None, None), (1.0, "private bath"),
    ]


def test_money_percent_and_property(spark):
    assert [r[0] for r in column(spark, ["$1,234.50", "x", None]).select(tx.parse_money(F.col("t"))).collect()] == [1234.5, None, None]
    assert [r[0] for r in column(spark, ["95%", "N/A"]).select(tx.parse_percent(F.col("t"))).collect()] == [95.0, None]
    kinds = ["Entire condo", "Private room in rental unit", "Casa particular", "Room in hotel", "Shared room"]
    got = [r[0] for r in column(spark, kinds).select(tx.bucket_property(F.col("t"))).collect()]
    assert got == ["condo", "rental unit", "home", "other", "other"]


def test_flags(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1)], "a int, b int")
    assert [r[0] for r in df.select(prep.flags_to_label(["a", "b"])).collect()] == [0, 1, 2, None]


def test_ordinal_and_dict(spark):
    df = column(spark, ["lo", "hi", None, "?"])
    assert [r[0] for r in df.select(prep.encode_ordinal(F.col("t"), ["lo", "hi"])).collect()] == [0, 1, None, None]
    assert [r[0] for r in prep.encode_dict(df, {"t": {"lo": 5}}).collect()] == ["5", "hi", None, "?"]


def test_label_codes_keep_nulls(spark):
    got = {r["t"]: r["code"] for r in prep.encode_label(column(spark, ["b", "a", None, "b", "c"]), "t").collect()}
    assert got == {"a": 0, "b": 1, "c": 2, None: None}


def test_unseen_category_is_zero_everywhere(spark):
    onehot = prep.OneHot.fit(column(spark, ["a", "b", None]), ["t"])
    rows = onehot.apply(column(spark, ["a", "z", None])).collect()
    assert [tuple(r) for r in rows] == [(1, 0), (0, 0), (0, 0)]


def test_scaler_leaves_constants_finite(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in prep.Scaler.fit(df, ["a", "b"]).apply(df).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_mode_tie_takes_the_smallest(spark):
    assert prep.exact_modes(column(spark, ["b", "a", "b", "a", "c", None]), ["t"]) == {"t": "a"}


def test_cardinality_rule(spark):
    df = spark.createDataFrame([(i % 4, i % 5, None if i % 2 else 1) for i in range(40)], "a int, b int, c int")
    assert prep.type_by_cardinality(df, ["a", "b", "c"]) == {"a": "categorical", "b": "continuous", "c": "categorical"}


def test_not_in_counts_missing_as_not_in(spark):
    df, other = column(spark, ["a", None, "c"]), column(spark, ["a", None])
    assert [r[0] for r in prep.not_in_list(df, "t", other, "t").collect()] == [None, "c"]
    assert [r[0] for r in prep.in_list(df, "t", other, "t").collect()] == ["a"]


def test_kendall_against_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(6), rng.randrange(4), rng.random()) for _ in range(120)]
    df = spark.createDataFrame(rows, "a int, b int, c double")
    for r in profile.kendall_matrix(df, ["a", "b", "c"]).collect():
        i, j = "abc".index(r["col_a"]), "abc".index(r["col_b"])
        s = sx = sy = 0
        for p in rows:
            for q in rows:
                x, y = (p[i] > q[i]) - (p[i] < q[i]), (p[j] > q[j]) - (p[j] < q[j])
                s, sx, sy = s + x * y, sx + abs(x), sy + abs(y)
        assert r["tau_b"] == pytest.approx(s / math.sqrt(sx * sy))


def test_histogram_of_one_value(spark):
    rows = profile.histogram(column(spark, [2.0, 2.0, None], "double"), "t").collect()
    assert sum(r["n"] for r in rows) == 2 and len(rows) == 10


def test_splits_of_a_hot_class(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 < 9, 0).otherwise(1).alias("y"))
    four = {(r["y"], r["split"]): r["count"] for r in sp.split_stratified_four_way(df, 1).groupBy("y", "split").count().collect()}
    assert all(four[(0, p)] == 675 and four[(1, p)] == 75 for p in sp.PARTS)
    sampled = sp.sample_stratified(df, 0.1, 1).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in sampled} == {0: 270, 1: 30}
    assert sp.split_random(df, 0.251, 1).where("is_test").count() == math.ceil(3000 * 0.251)
    more = sp.oversample(df, 1)
    assert {r["y"]: r["count"] for r in more.groupBy("y").count().collect()} == {0: 2700, 1: 2700}
    assert more.where("copy = 1").count() == 3000
    folds = sp.fold_assign(df, 1).groupBy("y", "fold").count().collect()
    assert {(r["y"], r["count"]) for r in folds} == {(0, 270), (1, 30)} and len(folds) == 20
    assert sp.split_random(df, 0.5, 1).exceptAll(sp.split_random(df.repartition(7), 0.5, 1)).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x|y\n1|NA\n|b\n")
    df = scan.scan_sniffed(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.collect()] == [(1, None), (None, "b")]
    (tmp_path / "b.txt").write_text("1.5 2 3\n4 5 6\n")
    assert [tuple(r) for r in scan.scan_headerless(spark, str(tmp_path / "b.txt"), " ").collect()] == [(1.5, 2.0, 3.0), (4.0, 5.0, 6.0)]
    (tmp_path / "c.csv").write_text(",X1\nID,V\n1,2\n3,?\n")
    rows = scan.cast_all(scan.scan_header_offset(spark, str(tmp_path / "c.csv"), ["ID", "V"]), "double").collect()
    assert sorted(tuple(r) for r in rows if r[1]) == [(1.0, 2.0)] and len(rows) == 2
    with pytest.raises(ValueError):
        scan.sink_results(df, str(tmp_path / "r"), "xml")


def test_header_offset_goes_by_place(spark, tmp_path):
    folder = tmp_path / "tops"
    folder.mkdir()
    (folder / "a.csv").write_text("x,1\nID,V\nx,1\ny,2\n\n")
    (folder / "b.csv").write_text("junk b\nID,V\nz,3\nID,V\n")
    (folder / "c.csv").write_text("junk c\nID,V\n")
    rows = scan.scan_header_offset(spark, str(folder), ["ID", "V"]).collect()
    assert sorted(tuple(r) for r in rows) == [("ID", "V"), ("x", "1"), ("y", "2"), ("z", "3")]
    big = tmp_path / "big.csv"
    big.write_text("top\nID,V\n" + "top,0\n" * 20_000)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        assert scan.scan_header_offset(spark, str(big), ["ID", "V"]).count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    for name, text in (("ragged", "t\nID,V\n1,2\n1,2,3\n"), ("other", "t\nV,ID\n1,2\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):
            scan.scan_header_offset(spark, str(tmp_path / name), ["ID", "V"]).collect()


def test_small_table_is_bounded(spark):
    import pyarrow as pa

    with pytest.raises(ValueError):
        small_table(spark, {"a": list(range(100_001))}, pa.schema([("a", pa.int64())]))
    assert shared_dir(spark)


def write(path, header, rows, sep=",", top=None):
    lines = ([top] if top else []) + ([sep.join(header)] if header else []) + [sep.join(map(str, r)) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def check(data, features, labels):
    rows = data.rows
    assert set(features) == set(data.features)
    assert {r[0] for r in rows.select("y").distinct().collect()} == set(labels)
    assert {r[0] for r in rows.select("split").distinct().collect()} == set(sp.PARTS)
    assert data.scaled().select(*data.scaler.stats).na.drop().count() > 0


def test_churn_adult_marketing(spark, tmp_path):
    rng = random.Random(0)
    yn = ["No", "Yes"]
    path = write(
        tmp_path / "churn.csv",
        ["gender", "Partner", "Contract", "tenure", "TotalCharges", "Churn"],
        [[rng.choice(["Male", "Female"]), rng.choice(yn), rng.choice(["Month-to-month", "One year", "Two year"]), i, "" if i == 3 else i * 2.5, yn[i % 5 == 0]] for i in range(200)],
    )
    data = datasets.get_data(spark, "churn", path)
    check(data, ["gender", "Partner", "Contract", "tenure", "TotalCharges"], [0, 1])
    assert set(data.scaler.stats) == {"tenure", "TotalCharges"}
    counts = [r["count"] for r in data.train().groupBy("y").count().collect()]
    assert len(set(counts)) == 1
    header = ["age", *datasets.ADULT_CATEGORICAL, "target"]
    rows = [[20 + i % 40, *[f" {rng.choice('abc')}" if i % 9 else " ?" for _ in datasets.ADULT_CATEGORICAL], [" <=50K", " >50K"][i % 2]] for i in range(160)]
    data = datasets.get_data(spark, "adult", write(tmp_path / "adult.csv", header, rows))
    check(data, header[:-1], [0, 1])
    assert data.rows.count() == sum(i % 9 != 0 for i in range(160))
    rows = [[20 + i % 30, rng.choice(["admin", "blue"]), ["no", "yes"][i % 3 == 0]] for i in range(120)]
    data = datasets.get_data(spark, "marketing", write(tmp_path / "bank.csv", ["age", "job", "y"], rows, ";"))
    check(data, ["age", "job"], [0, 1])
    assert set(data.scaler.stats) == {"age"}


def test_listing_and_cover(spark, tmp_path):
    rng = random.Random(1)
    header = [c for c in datasets.LISTING_COLUMNS if c not in ("bathrooms", "bathroom_type")] + ["bathrooms_text"]
    rows = []
    for i in range(120):
        values = {c: rng.randrange(1, 9) for c in header}
        values |= {
            "host_response_time": rng.choice(list(tx.RESPONSE_TIMES)), "host_response_rate": "95%", "host_is_superhost": rng.choice("tf"),
            "host_identity_verified": "t", "property_type": rng.choice(["Entire loft", "Private room in home"]), "room_type": rng.choice(["A", "B"]),
            "price": '"$1,200.00"' if i % 2 else "$50.00", "bathrooms_text": rng.choice(["1 bath", "2 shared baths"]),
        }
        rows.append([values[c] for c in header])
    data = datasets.get_data(spark, "airbnb", write(tmp_path / "listings.csv", header, rows))
    assert {"property_type_loft", "property_type_home", "room_type_A", "bathroom_type_shared bath"} <= set(data.features)
    assert "host_is_superhost" not in data.scaler.stats and "bathrooms" in data.scaler.stats
    assert {r[0] for r in data.rows.select("y").distinct().collect()} == {0, 1}
    path = write(tmp_path / "cover.csv", ["Elevation", "Soil_Type1", "Cover_Type"], [[i, i % 2, 1 + i % 2] for i in range(800)])
    data = datasets.get_data(spark, "covertype", path)
    assert data.rows.count() == 80 and set(data.scaler.stats) == {"Elevation"}


def test_other_files(spark, tmp_path):
    path = write(tmp_path / "magic.data", None, [[*[i + j for j in range(10)], "gh"[i % 2]] for i in range(80)])
    check(datasets.get_data(spark, "magic_gamma", path), datasets.GAMMA_COLUMNS[:-1], [0, 1])
    header = ["ID", "LIMIT", datasets.CREDIT_TARGET]
    path = write(tmp_path / "credit.csv", header, [[i, i * 10, int(i % 4 == 0)] for i in range(80)], top=",X1,Y")
    check(datasets.get_data(spark, "credit", path), ["LIMIT"], [0, 1])
    path = write(tmp_path / "drive.txt", None, [[i, -i, 1 + i % 3] for i in range(90)], " ")
    check(datasets.get_data(spark, "drive", path), ["f0", "f1"], [0, 1, 2])
    path = write(tmp_path / "qsar.csv", ["a", "experimental class"], [[i, ["RB", "NRB"][i % 2]] for i in range(80)], ";")
    check(datasets.get_data(spark, "qsar", path), ["a"], [0, 1])
    path = write(tmp_path / "heloc.csv", ["a", "RiskPerformance"], [[i, ["Bad", "Good"][i % 2]] for i in range(80)])
    check(datasets.get_data(spark, "heloc", path), ["a"], [0, 1])
    path = write(tmp_path / "covid.csv", ["sex", "age", "severity"], [[i % 2, i, i % 2] for i in range(80)])
    data = datasets.get_data(spark, "covid", path)
    check(data, ["sex", "age"], [0, 1])
    assert set(data.scaler.stats) == {"age"}
    flags = datasets.FAILURE_FLAGS
    rows = [[i, f"L{i}", "LMH"[i % 3], *[int(i % 5 == f) for f in range(3)], int(i % 5 == 0 and i % 2 == 0)] for i in range(100)]
    data = datasets.get_data(spark, "ai4i", write(tmp_path / "ai4i.csv", ["UDI", "Product ID", "Type", *flags], rows))
    assert data.rows.count() == 90


def test_shapes_and_unknown_names(spark):
    data = datasets.prepare_shape(spark, "twomoons", 3, 400)
    check(data, ["x0", "x1"], [0, 1])
    for call in (lambda: datasets.get_data(spark, "nothing", "x"), lambda: datasets.prepare_shape(spark, "square", 1)):
        with pytest.raises(ValueError):
            call()


def test_many_copies_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(sp, "COPIES_PER_BLOCK", 50)
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 3, 1).otherwise(0).alias("y"))
    out = sp.oversample(df, 1)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 997, 1: 997}
    assert out.groupBy("row_id", "copy").count().where("count > 1").count() == 0


@pytest.mark.parametrize("kind", ["boolean", "double"])
def test_classes_of_any_type_and_missing_ones(spark, kind):
    df = spark.range(90).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3 - 1).cast(kind).alias("y")
    ).where("row_id % 3 <> 1 or row_id < 40")
    assert sp.split_stratified(df, 0.5, 1).count() == df.count()
    counts = {r["y"]: r["count"] for r in sp.oversample(df, 1).groupBy("y").count().collect()}
    assert len(counts) == 3 and set(counts.values()) == {30}


def test_split_of_nothing(spark):
    df = spark.createDataFrame([], "row_id bigint, y int")
    assert sp.split_stratified(df, 0.5, 1).count() == 0


def test_kendall_tree_stands_over_the_smaller_column(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(float(rng.normal()), float(rng.integers(0, 3)), float(rng.normal())) for _ in range(200)]
    seen, settle = [], profile.settle
    monkeypatch.setattr(profile, "settle", lambda d, name="table": seen.append(settle(d, name)) or seen[-1])
    out = {(r["col_a"], r["col_b"]): r["tau_b"] for r in profile.kendall_matrix(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert seen[0].where("col_a = 'a' and col_b = 'b'").agg(F.max("i")).first()[0] == 3
    d = np.array(rows)
    s = np.sign(d[:, None, :] - d[None, :, :])
    for i, j in ((0, 1), (0, 2), (1, 2)):
        want = (s[..., i] * s[..., j]).sum() / np.sqrt((s[..., i] ** 2).sum() * (s[..., j] ** 2).sum())
        assert abs(out["abc"[i], "abc"[j]] - want) < 1e-9


def test_kendall_by_ranges_of_hot_and_single_values(spark, monkeypatch):
    """Few cuts and few held keys, so that pairs fall into the counts by codes and into ranges of either column."""
    monkeypatch.setattr(profile, "FEW_VALUES", 5)
    monkeypatch.setattr(profile, "LEAST_CUTS", 4)
    monkeypatch.setattr(profile, "HELD_KEYS", 100)
    rng = np.random.default_rng(4)
    n = 400
    a, b = np.round(rng.normal(size=n), 1), np.where(rng.random(n) < 0.4, -0.0, np.round(rng.normal(size=n), 2))
    c, d = np.where(rng.random(n) < 0.3, a, rng.integers(0, 40, n)), rng.integers(0, 3, n).astype(float)
    b[::50] = 0.0
    v = np.stack([a, b, c, d], axis=1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in v], "a double, b double, c double, d double").repartition(3)
    plans, made = [], profile.settle
    monkeypatch.setattr(profile, "settle", lambda t, name="table": plans.append(made(t, name)) or plans[-1])
    out = {(r["col_a"], r["col_b"]): r for r in profile.kendall_matrix(df, list("abcd")).collect()}
    # the rows shrink to counts by two codes, however many values there are
    assert plans[0].groupBy("p").count().agg(F.max("count")).first()[0] <= 81
    s = np.sign(v[:, None, :] - v[None, :, :])
    for i, j in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)):
        want = (s[..., i] * s[..., j]).sum() / np.sqrt((s[..., i] ** 2).sum() * (s[..., j] ** 2).sum())
        assert out["abcd"[i], "abcd"[j]]["n"] == n and abs(out["abcd"[i], "abcd"[j]]["tau_b"] - want) < 1e-12


def test_kendall_of_one_value_and_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0)], "a double, b double")
    assert [tuple(r) for r in profile.kendall_matrix(df, ["a", "b"]).collect()] == [("a", "b", 2, None)]
    assert profile.kendall_matrix(df.where("b > 9"), ["a", "b"]).collect() == []
