"""Sources, cleaning, encodings, splits and descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from demur.functions import text as tx
from demur.operators import prep, profile, split
from demur.operators.metrics import label_set as label_values
from demur.plans import views
from demur.plans.oracle_parts import DOCS, EVENTS, ORDERS, SEED, VECTORS, hash_sql, prepared, with_split
from demur.plans.registry import query
from demur.plans.views import ORDER_FEATURES, table
from demur.session import scratch_path, settle
from demur.sources import config, runs, scan, synth

# --- scans: the table is written as text and read back -------------------------------------
ORDERS_COPY = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
ORDER_TEXT = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


def _as_text(spark, sf_dir, sep, header=True):
    path = scratch_path(spark, "orders-text")
    columns = [c.split()[0] for c in ORDER_TEXT.split(", ")]
    table(spark, sf_dir, "orders").select(*columns).write.option("header", header).option("sep", sep).csv(path)
    return path, spark.createDataFrame([], ORDER_TEXT).schema


@query(ORDERS_COPY)
def scan_csv(spark, sf_dir):
    path, schema = _as_text(spark, sf_dir, ",")
    return scan.scan_csv(spark, path, schema)


@query(ORDERS_COPY)
def scan_delimited(spark, sf_dir):
    path, schema = _as_text(spark, sf_dir, ";")
    return scan.scan_delimited(spark, path, ";", schema)


@query(ORDERS_COPY)
def scan_sniffed(spark, sf_dir):
    path, schema = _as_text(spark, sf_dir, "|")
    return scan.scan_sniffed(spark, path, schema)


@query("SELECT l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_linenumber::DOUBLE AS y FROM lineitem")
def scan_headerless(spark, sf_dir):
    path = scratch_path(spark, "lines-text")
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
    rows.write.option("sep", " ").csv(path)
    return scan.scan_headerless(spark, path, " ")


@query("SELECT c_custkey::VARCHAR AS ID, c_mktsegment AS SEGMENT, c_acctbal AS BALANCE FROM customer")
def scan_header_offset(spark, sf_dir):
    """Every file starts with a line of no use, which equals one of its rows, and the header."""
    names = ["ID", "SEGMENT", "BALANCE"]
    rows = table(spark, sf_dir, "customer").select(
        F.pmod(F.hash("c_custkey"), F.lit(4)).alias("p"),
        F.lit(2).alias("o"),
        F.concat_ws(",", F.col("c_custkey").cast("string"), "c_mktsegment", F.col("c_acctbal").cast("string")).alias("line"),
    )
    tops = rows.groupBy("p").agg(F.min("line").alias("line")).select(
        "p", F.posexplode(F.array("line", F.lit(",".join(names)))).alias("o", "line")
    )
    path = scratch_path(spark, "customer-text")
    # a folder, and so a file, by p: two of them may share a task
    lines = rows.unionByName(tops).repartition(4, "p").sortWithinPartitions("p", "o")
    lines.select("p", "line").write.partitionBy("p").text(path)
    back = scan.scan_header_offset(spark, path, names, skipped=1)
    return scan.cast_all(back, "double", ["BALANCE"])


@query("SELECT p_partkey, p_name FROM part")
def trim_column_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(" p_partkey"), F.col("p_name").alias("p_name  "))
    return prep.trim_column_names(rows)


@query("SELECT p_partkey, p_brand, p_size AS y FROM part")
def split_features_target(spark, sf_dir):
    return prep.split_features_target(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_size")


@query("SELECT vec_id AS row_id, round(e0 * -0.6 + e1 * 0.5, 6) + 0.0 AS x0, round(e0 * 0.5 + e1 * -0.2, 6) + 0.0 AS x1 FROM "
       "(SELECT vec_id, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1 FROM embeddings)")
def affine_project(spark, sf_dir):
    pts = views.vectors_view(spark, sf_dir).select("row_id", F.col("e0").alias("x0"), F.col("e1").alias("x1"))
    out = synth.affine_project(pts, [[-0.6, 0.5], [0.5, -0.2]])
    return out.select("row_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x0", "x1")])


def _uniform(tag):
    return f"((('0x' || substr(md5('{SEED}-{tag}-' || row_id), 1, 10))::BIGINT + 0.5) / 1099511627776.0)"


def _normal(tag):
    return f"(sqrt(-2 * ln({_uniform(tag + 'u')})) * cos(2 * pi() * {_uniform(tag + 'v')}))"


_MOON_T = f"(pi() * {_uniform('t')})"
_RING_T = f"(2 * pi() * {_uniform('t')})"
_IDS = "(SELECT event_id AS row_id FROM events)"


@query(f"""
SELECT 'twomoons' AS shape, row_id, (row_id % 2)::INTEGER AS label,
  round(CASE WHEN row_id % 2 = 0 THEN cos({_MOON_T}) ELSE 1 - cos({_MOON_T}) END + 0.22 * {_normal('a')}, 6) + 0.0 AS x0,
  round(CASE WHEN row_id % 2 = 0 THEN sin({_MOON_T}) ELSE 0.5 - sin({_MOON_T}) END + 0.22 * {_normal('b')}, 6) + 0.0 AS x1 FROM {_IDS}
UNION ALL SELECT 'circles', row_id, (row_id % 2)::INTEGER,
  round(CASE WHEN row_id % 2 = 0 THEN 1 ELSE 0.5 END * cos({_RING_T}) + 0.1 * {_normal('a')}, 6) + 0.0,
  round(CASE WHEN row_id % 2 = 0 THEN 1 ELSE 0.5 END * sin({_RING_T}) + 0.1 * {_normal('b')}, 6) + 0.0 FROM {_IDS}
UNION ALL SELECT 'blobs', row_id, (row_id % 3)::INTEGER,
  round([5, 7, 6][row_id % 3 + 1] + 0.4 * {_normal('a')}, 6) + 0.0, round([9, 4, 6][row_id % 3 + 1] + 0.4 * {_normal('b')}, 6) + 0.0 FROM {_IDS}
UNION ALL SELECT 'varied', row_id, (row_id % 3)::INTEGER,
  round([0, 2, 6][row_id % 3 + 1] + [1.5, 2.5, 0.7][row_id % 3 + 1] * {_normal('a')}, 6) + 0.0,
  round([10, 1, 8][row_id % 3 + 1] + [1.5, 2.5, 0.7][row_id % 3 + 1] * {_normal('b')}, 6) + 0.0 FROM {_IDS}
UNION ALL SELECT 'aniso', row_id, (row_id % 3)::INTEGER, round(a * -0.6 + b * 0.5, 6) + 0.0, round(a * 0.5 + b * -0.2, 6) + 0.0 FROM (
  SELECT row_id, [10, 2, 5][row_id % 3 + 1] + 0.9 * {_normal('a')} AS a, [9, 1, 10][row_id % 3 + 1] + 0.9 * {_normal('b')} AS b FROM {_IDS})""")
def synth_shapes(spark, sf_dir):
    """The five shapes over the ids of the events table."""
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"))
    # Parameters of the five shapes.
    shapes = {
        "twomoons": synth.two_moons(ids, 0.22, SEED),
        "circles": synth.circles(ids, 0.1, 0.5, SEED),
        "blobs": synth.blobs(ids, [[5, 9], [7, 4], [6, 6]], 0.4, SEED),
        "varied": synth.blobs(ids, [[0, 10], [2, 1], [6, 8]], [1.5, 2.5, 0.7], SEED),
        "aniso": synth.affine_project(
            synth.blobs(ids, [[10, 9], [2, 1], [5, 10]], 0.9, SEED), [[-0.6, 0.5], [0.5, -0.2]]
        ),
    }
    out = scan.append_rows([df.withColumn("shape", F.lit(name)) for name, df in shapes.items()])
    return out.select("shape", "row_id", "label", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x0", "x1")])


@query()
def synth_classification(spark, sf_dir):
    """20 features, 10 of them informative, over the ids of the orders table."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    points = synth.classification(ids, SEED)
    return points.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"x{i}") for i in range(20)])


@query("""
SELECT n_name AS dataset, 'data/' || n_nationkey || '.csv' AS path, 'target' AS target, s.size::INTEGER AS ensemble_size,
  r_regionkey::BIGINT AS seed, 0.3::DOUBLE AS test_size FROM nation JOIN region ON n_regionkey = r_regionkey,
  (SELECT unnest([5, 10]) AS size) s""")
def study_grid(spark, sf_dir):
    """One study document by region, its nations as datasets."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dataset = F.struct(
        F.col("n_name").alias("name"),
        F.concat(F.lit("data/"), F.col("n_nationkey").cast("string"), F.lit(".csv")).alias("path"),
        F.lit("target").alias("target"),
    )
    docs = (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_regionkey").cast("bigint").alias("seed"))
        .agg(F.collect_list(dataset).alias("datasets"))
        .withColumn("test_size", F.lit(0.3))
        .withColumn("ensemble_sizes", F.array(F.lit(5), F.lit(10)))
        .withColumn("reject_rates", F.array(F.lit(0.0), F.lit(0.1), F.lit(0.2)))
        .withColumn("results_path", F.lit("results/study.csv"))
    )
    path = scratch_path(spark, "studies")
    docs.repartition("seed").write.option("maxRecordsPerFile", 1).json(path)
    grid = config.study_grid(config.read_study(spark, path))
    return grid.select("dataset", "path", "target", "ensemble_size", "seed", "test_size")


@query("""SELECT o_orderstatus AS dataset, o_orderpriority AS method, count(*) AS n, round(avg(o_totalprice), 6) AS accuracy
FROM orders GROUP BY 1, 2""")
def sink_results(spark, sf_dir):
    result = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("method")
    ).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 6).alias("accuracy"))
    path = scan.sink_results(result, scratch_path(spark, "results"), "parquet", ["dataset"])
    return spark.read.parquet(path)


# --- registry ------------------------------------------------------------------------------
RUNS_SQL = """
runs AS (SELECT 'run-' || o_orderkey AS run_id, lower(replace(replace(o_orderpriority, '-', ''), ' ', '')) || '_v6_42' AS experiment,
  'model_' || o_orderstatus AS run_name, o_orderdate AS started_at, o_totalprice / 1000000 AS score FROM orders)"""


def _runs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        runs.experiment_key(F.col("o_orderpriority"), "v6", 42).alias("experiment"),
        F.concat(F.lit("model_"), "o_orderstatus").alias("run_name"),
        F.col("o_orderdate").alias("started_at"),
        F.create_map(F.lit("cust"), F.col("o_custkey").cast("string")).alias("params"),
        F.create_map(F.lit("test_accuracy"), F.col("o_totalprice") / 1000000).alias("metrics"),
        F.concat(F.lit("models/"), F.col("o_orderkey").cast("string")).alias("model_path"),
    )


NEWEST_SQL = "newest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY experiment, run_name ORDER BY started_at DESC, run_id DESC) = 1)"


@query(f"WITH {RUNS_SQL}, {NEWEST_SQL} SELECT experiment, run_name, run_id, round(score, 6) AS test_accuracy FROM newest")
def registry_lookup(spark, sf_dir):
    found = runs.newest_run(_runs(spark, sf_dir))
    return found.select(
        "experiment", "run_name", "run_id", F.round(F.col("metrics")["test_accuracy"], 6).alias("test_accuracy")
    )


@query(f"WITH {RUNS_SQL}, {NEWEST_SQL} SELECT experiment, run_name, run_id, strftime(started_at, '%Y-%m-%d') AS started_on FROM newest")
def newest_run(spark, sf_dir):
    found = runs.newest_run(_runs(spark, sf_dir))
    return found.select("experiment", "run_name", "run_id", F.date_format("started_at", "yyyy-MM-dd").alias("started_on"))


@query(f"""WITH {RUNS_SQL}, {NEWEST_SQL},
req AS (SELECT DISTINCT experiment, run_name FROM runs UNION ALL SELECT DISTINCT experiment, 'model_' || p_type FROM runs, part)
SELECT req.experiment, req.run_name, newest.run_id, newest.run_id IS NOT NULL AS found FROM req LEFT JOIN newest USING (experiment, run_name)""")
def registry_load_pool(spark, sf_dir):
    """Requests for every known run, and for names that no run has."""
    known = _runs(spark, sf_dir)
    experiments = known.select("experiment").distinct()
    types = label_values(table(spark, sf_dir, "part"), "p_type")
    strange = experiments.select(
        "experiment", F.explode(F.array(*[F.lit(f"model_{t}") for t in types])).alias("run_name")
    )
    requests = known.select("experiment", "run_name").distinct().unionByName(strange)
    found, missing = runs.load_pool(known, requests)
    return found.select("experiment", "run_name", "run_id", F.lit(True).alias("found")).unionByName(
        missing.select("experiment", "run_name", F.lit(None).cast("string").alias("run_id"), F.lit(False).alias("found"))
    )


@query("SELECT DISTINCT o_orderpriority AS name, lower(regexp_replace(o_orderpriority, '[-_ ]', '', 'g')) || '_v6_1246495320' AS key FROM orders")
def experiment_key(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")).distinct()
    return names.select("name", runs.experiment_key(F.col("name"), "v6", 1246495320).alias("key"))


# --- projections, filters, cleaning --------------------------------------------------------
@query("SELECT o_orderkey, o_totalprice FROM orders")
def project(spark, sf_dir):
    return prep.project(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"])


@query("SELECT * EXCLUDE (p_name, p_retailprice) FROM part")
def drop_columns(spark, sf_dir):
    return prep.drop_columns(table(spark, sf_dir, "part"), ["p_name", "p_retailprice"])


@query("""SELECT c AS column_name, CASE WHEN c IN ('p_name', 'p_brand', 'p_type') THEN 'categorical' ELSE 'numeric' END AS kind,
  (SELECT count(*) FROM part) AS n_rows FROM (SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS c)""")
def select_by_type(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cat, _ = prep.select_by_type(part)
    names = F.array(*[F.lit(c) for c in part.columns])
    return part.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(names).alias("column_name"), "n_rows").select(
        "column_name", F.when(F.col("column_name").isin(cat), "categorical").otherwise("numeric").alias("kind"), "n_rows"
    )


TYPED = ["p_brand", "p_type", "p_size", "p_retailprice"]
EVENT_TYPED = ["event_type", "user_id", "value"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) <= 4 THEN 'categorical' ELSE 'continuous' END AS kind FROM {t}"
        for t, cs in (("part", TYPED), ("orders", ["o_orderstatus", "o_orderpriority"]), ("labels", ["quality", "toxic"]))
        for c in cs
    )
)
def type_by_cardinality(spark, sf_dir):
    frames = []
    for name, cols in (("part", TYPED), ("orders", ["o_orderstatus", "o_orderpriority"]), ("labels", ["quality", "toxic"])):
        rows = table(spark, sf_dir, name)
        kinds = prep.type_by_cardinality(rows, cols)
        spread = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind")) for c, k in kinds.items()])
        frames.append(rows.agg(F.count(F.lit(1))).select(F.explode(spread).alias("e")).select("e.*"))
    return scan.append_rows(frames)


@query(f"WITH {ORDERS} SELECT row_id, y, n_lines FROM v WHERE n_lines IS NOT NULL")
def drop_null_rows(spark, sf_dir):
    return prep.drop_null_rows(views.orders_view(spark, sf_dir)).select("row_id", "y", "n_lines")


@query(f"WITH {ORDERS} SELECT row_id, coalesce(n_lines, 0) AS n_lines, coalesce(sum_qty, 0) AS sum_qty FROM v")
def fill_constant(spark, sf_dir):
    rows = views.orders_view(spark, sf_dir).select("row_id", "n_lines", "sum_qty")
    return prep.fill_constant(rows, ["n_lines", "sum_qty"], 0.0)


SENTINEL = f"WITH {DOCS}"


@query(f"{SENTINEL} SELECT row_id, y, n_chars, nullif(lang, 'de') AS lang, source FROM v")
def sentinel_to_null(spark, sf_dir):
    rows = prep.sentinel_to_null(views.sentinel_view(spark, sf_dir))
    return rows.select("row_id", "y", "n_chars", "lang", "source")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def filter_compare(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where((F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") == "F")).select("o_orderkey")


@query(f"WITH {ORDERS} SELECT row_id, regexp_matches(o_orderpriority, '(URGENT)|(HIGH)') AND n_lines IS NOT NULL AS hit FROM v JOIN orders ON row_id = o_orderkey")
def filter_regex(spark, sf_dir):
    """The text is missing for orders without lines; a missing text is no hit."""
    rows = views.orders_view(spark, sf_dir).join(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderpriority"), "row_id"
    )
    text = F.when(F.col("n_lines").isNotNull(), F.col("o_orderpriority"))
    return rows.select("row_id", prep.contains_pattern(text, "(URGENT)|(HIGH)").alias("hit"))


@query(f"WITH {ORDERS} SELECT row_id FROM v WHERE n_lines IS NULL AND o_totalprice IS NOT NULL")
def filter_null_pair(spark, sf_dir):
    rows = views.orders_view(spark, sf_dir)
    return rows.where(prep.only_first_missing(F.col("n_lines"), F.col("o_totalprice"))).select("row_id")


LEFT = "(SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey END AS k FROM orders)"


@query(f"SELECT row_id FROM {LEFT} WHERE k IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def in_list(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("k")
    )
    return prep.in_list(left, "k", table(spark, sf_dir, "lineitem").where("l_quantity > 45"), "l_orderkey").select("row_id")


@query(f"SELECT row_id FROM {LEFT} WHERE k IS NULL OR k NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def not_in_list(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("k")
    )
    return prep.not_in_list(left, "k", table(spark, sf_dir, "lineitem").where("l_quantity > 45"), "l_orderkey").select("row_id")


@query("SELECT coalesce(l_discount = l_tax, false) AS agree, count(*) AS n FROM lineitem GROUP BY 1")
def column_agreement(spark, sf_dir):
    return prep.column_agreement(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax")


@query("SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS is_f, (o_totalprice > 300000)::INTEGER AS is_dear FROM orders")
def binary_target(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        prep.binary_target(F.col("o_orderstatus") == "F").alias("is_f"),
        prep.binary_target(F.col("o_totalprice") > 300000).alias("is_dear"),
    )


@query("SELECT l_linenumber AS y1, l_linenumber - 1 AS y0, count(*) AS n FROM lineitem GROUP BY 1, 2")
def shift_label(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("y1"), prep.shift_label(F.col("l_linenumber")).alias("y0"))
    return rows.groupBy("y1", "y0").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE WHEN a + b + c + d > 1 THEN NULL WHEN a + b + c + d = 0 THEN 0
  ELSE a * 1 + b * 2 + c * 3 + d * 4 END AS label FROM (SELECT event_id, (value < 10)::INTEGER AS a, (user_id % 7 = 0)::INTEGER AS b,
  (event_type = 'error')::INTEGER AS c, (user_id % 11 = 0)::INTEGER AS d FROM events)""")
def flags_to_label(spark, sf_dir):
    flags = table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("value") < 10).cast("int").alias("TWF"),
        (F.col("user_id") % 7 == 0).cast("int").alias("HDF"),
        (F.col("event_type") == "error").cast("int").alias("PWF"),
        (F.col("user_id") % 11 == 0).cast("int").alias("OSF"),
    )
    return flags.select("event_id", prep.flags_to_label(["TWF", "HDF", "PWF", "OSF"]).alias("label"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3 END AS code FROM orders""")
def encode_ordinal(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", prep.encode_ordinal(F.col("o_orderpriority"), ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]).alias("code")
    )


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE o_orderstatus END AS o_orderstatus,
  CASE o_orderpriority WHEN '1-URGENT' THEN '1' WHEN '5-LOW' THEN '5' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def encode_dict(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return prep.encode_dict(orders, {"o_orderstatus": {"F": 0, "O": 1}, "o_orderpriority": {"1-URGENT": 1, "5-LOW": 5}})


@query("SELECT o_orderkey, o_orderstatus = 'O' AS flag FROM orders")
def encode_flag(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", prep.encode_flag(F.col("o_orderstatus"), "O").alias("flag"))


@query("""SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part""")
def encode_label(spark, sf_dir):
    return prep.encode_label(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand")


ONEHOT_SQL = f"""WITH {DOCS}, {with_split()},
cats AS (SELECT DISTINCT 'lang' AS c, lang AS v FROM s WHERE split = 'T' UNION SELECT DISTINCT 'source', source FROM s WHERE split = 'T')
SELECT s.row_id, c || '_' || v AS feature, (CASE c WHEN 'lang' THEN coalesce(lang = v, false) ELSE coalesce(source = v, false) END)::INTEGER AS value
FROM s, cats"""


def _melt(df, columns):
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("value")) for c in columns])
    return df.select("row_id", F.explode(cells).alias("e")).select("row_id", "e.feature", "e.value")


@query(ONEHOT_SQL)
def encode_onehot(spark, sf_dir):
    rows = split.split_four_way(views.docs_view(spark, sf_dir), SEED)
    onehot = prep.OneHot.fit(rows.where("split = 'T'"), ["lang", "source"])
    return _melt(onehot.apply(rows), onehot.names())


@query(f"WITH {ORDERS}, {with_split()}, m AS (SELECT median(n_lines) AS a, median(max_price) AS b FROM s WHERE split = 'T') "
       "SELECT row_id, coalesce(n_lines, a) AS n_lines, round(coalesce(max_price, b), 6) AS max_price FROM s, m")
def impute_median(spark, sf_dir):
    rows = settle(split.split_four_way(views.orders_view(spark, sf_dir), SEED), "orders-split")
    filled = prep.impute_median(rows.where("split = 'T'"), ["n_lines", "max_price"]).apply(rows)
    return filled.select("row_id", "n_lines", F.round("max_price", 6).alias("max_price"))


@query(f"WITH {ORDERS}, {with_split()}, m AS (SELECT " + ", ".join(f"median({f}) AS {f}_md" for f in ORDER_FEATURES) + " FROM s WHERE split = 'T') "
       "SELECT row_id, " + ", ".join(f"round(coalesce({f}, {f}_md), 6) AS {f}" for f in ORDER_FEATURES) + " FROM s, m")
def impute_median_full(spark, sf_dir):
    """The same for all features."""
    rows = settle(split.split_four_way(views.orders_view(spark, sf_dir), SEED), "orders-split")
    filled = prep.impute_median(rows.where("split = 'T'"), ORDER_FEATURES).apply(rows)
    return filled.select("row_id", *[F.round(f, 6).alias(f) for f in ORDER_FEATURES])


@query(f"{SENTINEL}, s AS (SELECT *, nullif(lang, 'de') AS l2 FROM v), m AS (SELECT l2 FROM s WHERE l2 IS NOT NULL GROUP BY l2 ORDER BY count(*) DESC, l2 LIMIT 1) "
       "SELECT row_id, coalesce(s.l2, m.l2) AS lang FROM s, m")
def impute_mode(spark, sf_dir):
    rows = prep.sentinel_to_null(views.sentinel_view(spark, sf_dir))
    return prep.impute_mode(rows, ["lang"]).apply(rows).select("row_id", "lang")


@query(f"WITH {ORDERS}, {with_split()}, {prepared(ORDER_FEATURES)} SELECT row_id, split, "
       + ", ".join(f"round({f}, 6) + 0.0 AS {f}" for f in ORDER_FEATURES) + " FROM z")
def scale_columns(spark, sf_dir):
    rows = views.split_prepared(settle(views.orders_view(spark, sf_dir)), ORDER_FEATURES)
    return rows.select("row_id", "split", *[(F.round(f, 6) + 0.0).alias(f) for f in ORDER_FEATURES])


@query(f"""{SENTINEL}, s0 AS (SELECT row_id, y, CASE WHEN n_chars % 5 = 0 THEN NULL ELSE n_chars END AS n_chars, nullif(lang, 'de') AS lang, source FROM v),
{with_split('s0', 's')},
md AS (SELECT median(n_chars) AS md FROM s WHERE split = 'T'),
mo AS (SELECT lang AS mo FROM s WHERE split = 'T' AND lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1),
ms AS (SELECT source AS ms FROM s WHERE split = 'T' GROUP BY source ORDER BY count(*) DESC, source LIMIT 1),
f AS (SELECT row_id, split, coalesce(n_chars, md) AS n_chars, coalesce(lang, mo) AS lang, coalesce(source, ms) AS source FROM s, md, mo, ms),
st AS (SELECT avg(n_chars) AS mu, stddev_pop(n_chars) AS sd FROM f WHERE split = 'T'),
cats AS (SELECT DISTINCT 'lang' AS c, lang AS v FROM f WHERE split = 'T' UNION SELECT DISTINCT 'source', source FROM f WHERE split = 'T')
SELECT row_id, 'n_chars' AS feature, round((n_chars - mu) / sd, 6) + 0.0 AS value FROM f, st
UNION ALL SELECT row_id, c || '_' || v, (CASE c WHEN 'lang' THEN lang = v ELSE source = v END)::DOUBLE FROM f, cats""")
def preprocess_table(spark, sf_dir):
    rows = prep.sentinel_to_null(views.sentinel_view(spark, sf_dir)).withColumn(
        "n_chars", F.when(F.col("n_chars") % 5 != 0, F.col("n_chars"))
    )
    rows = split.split_four_way(rows, SEED)
    fitted = prep.Preprocessor.fit(rows.where("split = 'T'"))
    out = fitted.apply(rows)
    doubles = out.select("row_id", *[F.col(f"`{c}`").cast("double").alias(c) for c in fitted.features])
    return _melt(doubles, fitted.features).withColumn("value", F.round("value", 6) + 0.0)


# --- sampling and splitting ----------------------------------------------------------------
HASHED = f"h AS (SELECT *, {hash_sql(SEED)} AS h FROM v)"


@query(f"WITH {ORDERS}, {HASHED} SELECT row_id, row_number() OVER (ORDER BY h, row_id) <= ceil(0.3 * count(*) OVER ()) AS is_test FROM h")
def split_random(spark, sf_dir):
    rows = views.orders_view(spark, sf_dir).select("row_id", "y")
    return split.split_random(rows, 0.3, SEED).select("row_id", "is_test")


@query(f"WITH {ORDERS}, {with_split()} SELECT row_id, split FROM s")
def split_four_way(spark, sf_dir):
    return split.split_four_way(views.orders_view(spark, sf_dir).select("row_id"), SEED)


STRATA = "row_number() OVER (PARTITION BY y ORDER BY h, row_id)"


@query(f"WITH {EVENTS}, {HASHED} SELECT row_id, y, {STRATA} <= floor(0.3 * count(*) OVER (PARTITION BY y)) AS is_test FROM h")
def split_stratified(spark, sf_dir):
    rows = views.events_view(spark, sf_dir).select("row_id", "y")
    return split.split_stratified(rows, 0.3, SEED)


@query(f"""WITH {DOCS}, {HASHED}, r AS (SELECT row_id, y, {STRATA} AS rn, count(*) OVER (PARTITION BY y) AS n FROM h)
SELECT row_id, y, CASE WHEN rn <= floor(n / 4) THEN 'T' WHEN rn <= floor(n * 2 / 4) THEN 'T_lambda' WHEN rn <= floor(n * 3 / 4) THEN 'DSEL' ELSE 'G' END AS split FROM r""")
def split_stratified_four_way(spark, sf_dir):
    rows = views.docs_view(spark, sf_dir).select("row_id", "y")
    return split.split_stratified_four_way(rows, SEED)


@query(f"WITH {EVENTS}, {HASHED} SELECT row_id, y FROM h QUALIFY {STRATA} <= floor(0.1 * count(*) OVER (PARTITION BY y))")
def sample_stratified(spark, sf_dir):
    rows = views.events_view(spark, sf_dir).select("row_id", "y")
    return split.sample_stratified(rows, 0.1, SEED)


@query(f"""WITH {DOCS}, {HASHED}, r AS (SELECT row_id, y, {STRATA} AS rn, count(*) OVER (PARTITION BY y) AS n FROM h),
t AS (SELECT *, max(n) OVER () AS top FROM r)
SELECT row_id, y, unnest(range(1, (top // n + (rn <= top % n)::INTEGER + 1)::BIGINT))::INTEGER AS copy FROM t""")
def oversample(spark, sf_dir):
    rows = views.docs_view(spark, sf_dir).select("row_id", "y")
    return split.oversample(rows, SEED)


@query(f"WITH {EVENTS}, {HASHED} SELECT row_id, y, (({STRATA} - 1) % 10)::INTEGER AS fold FROM h")
def fold_assign(spark, sf_dir):
    rows = views.events_view(spark, sf_dir).select("row_id", "y")
    return split.fold_assign(rows, SEED, folds=split.fold_count(rows.count()))


# --- descriptions --------------------------------------------------------------------------
@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1")
def value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "part"), "p_type")


@query(f"{SENTINEL} SELECT lang AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM v), 6) AS percent FROM v WHERE lang <> 'de' GROUP BY 1")
def value_share(spark, sf_dir):
    rows = prep.sentinel_to_null(views.sentinel_view(spark, sf_dir))
    return profile.value_share(rows, "lang").withColumn("percent", F.round("percent", 6))


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM part" for c in PART_COLUMNS))
def distinct_count(spark, sf_dir):
    return profile.distinct_count(table(spark, sf_dir, "part"), PART_COLUMNS)


@query(f"WITH {ORDERS} SELECT DISTINCT n_lines AS value FROM v")
def distinct_values(spark, sf_dir):
    return profile.distinct_values(views.orders_view(spark, sf_dir), "n_lines")


PROFILED = {"row_id": "bigint", "y": "int", **{f: "double" for f in ORDER_FEATURES if not f.startswith("avg")}}


@query(f"WITH {ORDERS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS data_type, count(DISTINCT {c}) AS n_distinct, count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n_rows FROM v"
    for c, k in PROFILED.items()))
def table_profile(spark, sf_dir):
    return profile.table_profile(views.orders_view(spark, sf_dir), list(PROFILED))


@query()
def table_profile_full(spark, sf_dir):
    """All columns; no SQL, as distinct averages depend on the order of the sums."""
    return profile.table_profile(views.orders_view(spark, sf_dir))


@query("""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT unnest(range(10)) AS bin),
c AS (SELECT least(9, floor((l_extendedprice - lo) / ((hi - lo) / 10))) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
SELECT b.bin::INTEGER AS bin, round(lo + b.bin * ((hi - lo) / 10), 6) AS low, coalesce(c.n, 0) AS n FROM b CROSS JOIN s LEFT JOIN c ON b.bin = c.bin""")
def histogram(spark, sf_dir):
    out = profile.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return out.withColumn("low", F.round("low", 6))


@query("SELECT bool_and(o_totalprice > 0) AS all_true FROM orders")
def all_true(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_totalprice") > 0).alias("flag"))
    return profile.all_true(rows, "flag")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark, sf_dir):
    return profile.preview(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


KENDALL = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _kendall_sql(source, columns):
    import itertools

    parts = []
    for a, b in itertools.combinations(columns, 2):
        parts.append(f"""
SELECT '{a}' AS col_a, '{b}' AS col_b, (SELECT count(*) FROM {source}) AS n, round(sum(s) / sqrt(sum(sx) * sum(sy)), 6) + 0.0 AS tau_b FROM (
  SELECT p.w * q.w * sign(p.x - q.x) * sign(p.y - q.y) AS s, p.w * q.w * abs(sign(p.x - q.x)) AS sx, p.w * q.w * abs(sign(p.y - q.y)) AS sy
  FROM (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS w FROM {source} GROUP BY 1, 2) p,
       (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS w FROM {source} GROUP BY 1, 2) q)""")
    return " UNION ALL ".join(parts)


@query(_kendall_sql("lineitem", KENDALL))
def kendall_matrix(spark, sf_dir):
    out = profile.kendall_matrix(table(spark, sf_dir, "lineitem"), KENDALL)
    return out.withColumn("tau_b", F.round("tau_b", 6) + 0.0)


@query()
def kendall_matrix_full(spark, sf_dir):
    """With the price, whose values are nearly all distinct; too slow as SQL."""
    out = profile.kendall_matrix(table(spark, sf_dir, "lineitem"), [*KENDALL, "l_extendedprice"])
    return out.withColumn("tau_b", F.round("tau_b", 6) + 0.0)


# --- text ----------------------------------------------------------------------------------
LISTING = """
v AS (SELECT p_partkey AS row_id, '$' || format('{:,.2f}', p_retailprice) AS price, p_size || '%' AS rate,
  [p_size || ' baths', p_size || '.5 shared baths', 'Half-bath', 'Shared half-bath', '1 bath', '1 private bath'][p_partkey % 6 + 1] AS bathrooms_text,
  ['Entire rental unit', 'Private room in home', 'Shared room in condo', 'Room in hotel', 'Casa particular', 'Private room',
   'Entire loft', 'Entire serviced apartment'][p_partkey % 8 + 1] AS property_type FROM part)"""


@query("SELECT p_partkey AS row_id, round(p_retailprice, 2) AS price FROM part")
def parse_money(spark, sf_dir):
    return views.listing_view(spark, sf_dir).select("row_id", tx.parse_money(F.col("price")).alias("price"))


@query("SELECT p_partkey AS row_id, p_size::DOUBLE AS rate FROM part")
def parse_percent(spark, sf_dir):
    return views.listing_view(spark, sf_dir).select("row_id", tx.parse_percent(F.col("rate")).alias("rate"))


@query("""SELECT p_partkey AS row_id,
  CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size + 0.5 WHEN 2 THEN 0.5 WHEN 3 THEN 0.5 ELSE 1 END::DOUBLE AS n_baths,
  CASE p_partkey % 6 WHEN 0 THEN 'regular bath' WHEN 1 THEN 'shared bath' WHEN 2 THEN 'regular bath' WHEN 3 THEN 'shared bath'
    WHEN 4 THEN 'regular bath' ELSE 'private bath' END AS bath_type FROM part""")
def parse_bathrooms(spark, sf_dir):
    text = F.col("bathrooms_text")
    return views.listing_view(spark, sf_dir).select(
        "row_id", tx.bathroom_count(text).alias("n_baths"), tx.bathroom_type(text).alias("bath_type")
    )


@query("""SELECT p_partkey AS row_id, ['rental unit', 'home', 'condo', 'other', 'home', 'other', 'loft', 'serviced apartment'][p_partkey % 8 + 1] AS kind FROM part""")
def bucket_property(spark, sf_dir):
    return views.listing_view(spark, sf_dir).select("row_id", tx.bucket_property(F.col("property_type")).alias("kind"))


# --- joins and sets ------------------------------------------------------------------------
@query("SELECT o_orderkey AS row_id, o_totalprice, o_custkey FROM orders")
def align_columns(spark, sf_dir):
    """Two column groups of the same rows, put together by key."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "row_id")
    return orders.select("row_id", "o_totalprice").join(orders.select("row_id", "o_custkey"), "row_id")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", "n_name")


@query("SELECT o_orderstatus AS dataset, 'orders' AS source, NULL::VARCHAR AS lang, count(*) AS n FROM orders GROUP BY 1 UNION ALL "
       "SELECT source, 'documents', lang, count(*) FROM documents GROUP BY source, lang")
def append_rows(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("dataset"), "lang").agg(F.count(F.lit(1)).alias("n"))
    return scan.append_rows([a.withColumn("source", F.lit("orders")), b.withColumn("source", F.lit("documents"))])


@query(f"WITH {VECTORS} SELECT DISTINCT y AS label FROM v")
def label_set(spark, sf_dir):
    return views.vectors_view(spark, sf_dir).select(F.col("y").alias("label")).distinct()


@query("""SELECT o_custkey, list_sort(list_distinct(list(round(r, 2)) || [0.0::DOUBLE]))::VARCHAR AS rates FROM (
  SELECT DISTINCT o_custkey, (o_orderkey % 20) * 0.05 AS r FROM orders) GROUP BY 1""")
def add_rate(spark, sf_dir):
    """Ascending rates of each customer with 0 among them."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.round((F.col("o_orderkey") % 20) * 0.05, 2).alias("r"))
    rates = F.sort_array(F.array_union(F.collect_set("r"), F.array(F.lit(0.0))))
    return orders.groupBy("o_custkey").agg(rates.alias("rs")).select(
        "o_custkey", F.concat(F.lit("["), F.array_join(F.col("rs").cast("array<string>"), ", "), F.lit("]")).alias("rates")
    )


@query("""SELECT l_suppkey, unnest(list_sort(list(DISTINCT l_discount))) AS rate FROM lineitem GROUP BY 1""")
def sort_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_discount")).alias("rs"))
    return rows.select("l_suppkey", F.explode("rs").alias("rate"))
