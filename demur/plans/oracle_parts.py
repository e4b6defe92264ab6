"""Common table expressions of the check SQL: views, splits and long-form scores.

The SQL works on one row by (row, model, class); the library works on arrays. The two share no code.
"""

from __future__ import annotations

from demur.plans.views import EVENT_FEATURES, ORDER_FEATURES, VECTOR_BLOCK_SIZE, VECTOR_FEATURES

SEED = 42
SPLIT = f"""CASE (('0x' || substr(md5('{SEED}-' || row_id), 1, 8))::BIGINT % 10000) // 2500
    WHEN 0 THEN 'T' WHEN 1 THEN 'T_lambda' WHEN 2 THEN 'DSEL' ELSE 'G' END"""


def hash_sql(seed: int, row_id: str = "row_id") -> str:
    return f"('0x' || substr(md5('{seed}-' || {row_id}), 1, 15))::BIGINT"


ORDERS = """
v AS (
  SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y,
         o_totalprice, n_lines, sum_qty, avg_discount, avg_tax, max_price
  FROM orders LEFT JOIN (
    SELECT l_orderkey, count(*)::DOUBLE AS n_lines, sum(l_quantity) AS sum_qty,
           avg(l_discount) AS avg_discount, avg(l_tax) AS avg_tax, max(l_extendedprice) AS max_price
    FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey)"""

EVENTS = """
v AS (
  SELECT event_id AS row_id,
         (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS y,
         value, hour(ts)::DOUBLE AS hour, json_extract_string(props, '$.k')::DOUBLE AS k,
         (user_id % 10)::DOUBLE AS user_mod
  FROM events)"""

VECTORS = (
    "v AS (SELECT vec_id AS row_id, label AS y, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {f}" for i, f in enumerate(VECTOR_FEATURES))
    + " FROM embeddings)"
)

DOCS = """
v AS (
  SELECT l.doc_id AS row_id, l.quality AS y, d.n_chars, d.lang, d.source
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def with_split(prev: str = "v", name: str = "s") -> str:
    return f"{name} AS (SELECT *, {SPLIT} AS split FROM {prev})"


def prepared(features: list[str], prev: str = "s", name: str = "z") -> str:
    """Median and population scale of part T applied to all rows."""
    med = ", ".join(f"median({f}) AS {f}_md" for f in features)
    imp = ", ".join(f"coalesce({f}, {f}_md) AS {f}" for f in features)
    mom = ", ".join(f"avg({f}) AS {f}_mu, stddev_pop({f}) AS {f}_sd" for f in features)
    out = ", ".join(f"({f} - {f}_mu) / {f}_sd AS {f}" for f in features)
    return f"""
{name}_md AS (SELECT {med} FROM {prev} WHERE split = 'T'),
{name}_im AS (SELECT row_id, y, split, {imp} FROM {prev}, {name}_md),
{name}_mo AS (SELECT {mom} FROM {name}_im WHERE split = 'T'),
{name} AS (SELECT row_id, y, split, {out} FROM {name}_im, {name}_mo)"""


def nb_scores(members: list[list[str]], prev: str = "z", name: str = "p") -> str:
    """Long-form naive Bayes probabilities ``(row_id, y, split, m, c, p)``, members fitted on T."""
    feats = [(m, f) for m, fs in enumerate(members) for f in fs]
    cells = " UNION ALL ".join(
        f"SELECT row_id, y, split, {m} AS m, '{f}' AS f, {f} AS x FROM {prev}" for m, f in feats
    )
    return f"""
{name}_x AS MATERIALIZED ({cells}),
{name}_pr AS (SELECT y AS c, count(*) / (SELECT count(*) FROM {prev} WHERE split = 'T') AS prior
              FROM {prev} WHERE split = 'T' GROUP BY y),
{name}_fl AS (SELECT m, 1e-9 * max(v) AS floor_ FROM (
   SELECT m, f, var_pop(x) AS v FROM {name}_x WHERE split = 'T' GROUP BY m, f) GROUP BY m),
{name}_st AS (SELECT t.m, t.f, t.c, t.mu, t.v + fl.floor_ AS v FROM (
   SELECT m, f, y AS c, avg(x) AS mu, var_pop(x) AS v FROM {name}_x WHERE split = 'T' GROUP BY m, f, y) t
   JOIN {name}_fl fl ON t.m = fl.m),
{name}_ll AS (SELECT x.row_id, x.y, x.split, x.m, st.c,
      max(ln(pr.prior)) + sum(-0.5 * ln(2 * pi() * st.v) - (x.x - st.mu) * (x.x - st.mu) / (2 * st.v)) AS ll
   FROM {name}_x x JOIN {name}_st st ON x.m = st.m AND x.f = st.f JOIN {name}_pr pr ON pr.c = st.c
   GROUP BY x.row_id, x.y, x.split, x.m, st.c),
{name}_ex AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY row_id, m)) AS e FROM {name}_ll),
{name} AS MATERIALIZED (SELECT row_id, y, split, m, c, e / sum(e) OVER (PARTITION BY row_id, m) AS p FROM {name}_ex)"""


ORDERS_P = (
    "WITH "
    + ",\n".join(
        [
            ORDERS,
            with_split(),
            prepared(ORDER_FEATURES),
            nb_scores([ORDER_FEATURES[2 * i : 2 * i + 2] for i in range(3)]),
        ]
    )
)
EVENTS_P = "WITH " + ",\n".join([EVENTS, with_split(), nb_scores([[f] for f in EVENT_FEATURES], prev="s")])
VECTORS_P = "WITH " + ",\n".join(
    [
        VECTORS,
        with_split(),
        nb_scores(
            [VECTOR_FEATURES[b : b + VECTOR_BLOCK_SIZE] for b in range(0, len(VECTOR_FEATURES), VECTOR_BLOCK_SIZE)],
            prev="s",
        ),
    ]
)

# decision by row: best class of the mean over models that are at most as uncertain as the mean
DECISION = """
u AS (SELECT row_id, y, m, 1 - max(p) AS u FROM p GROUP BY row_id, y, m),
us AS (SELECT row_id, y, avg(u) AS s_avg, median(u) AS s_median, min(u) AS s_min, max(u) AS s_max
       FROM u GROUP BY row_id, y),
sel AS (SELECT u.row_id, u.m FROM u JOIN us ON u.row_id = us.row_id WHERE u.u <= us.s_avg + 1e-12),
mm AS (SELECT p.row_id, p.c, round(avg(p.p), 9) AS f FROM p JOIN sel ON p.row_id = sel.row_id AND p.m = sel.m
       GROUP BY p.row_id, p.c),
d AS MATERIALIZED (SELECT us.*, k.pred FROM us JOIN (
       SELECT row_id, c AS pred FROM mm QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY f DESC, c) = 1) k
       ON us.row_id = k.row_id)"""


def metrics_sql(source: str, keys: list[str], binary: bool = False) -> str:
    """Metrics of ``source(keys, y, pred)`` by plain per-class counts."""
    by = ", ".join(keys)
    comma = f"{by}, " if by else ""
    using = f" USING ({by})" if by else " ON true"
    group = f" GROUP BY {by}" if by else ""
    agg = (
        "coalesce(max(pr) FILTER (c = 1), 0) AS pr, coalesce(max(rc) FILTER (c = 1), 0) AS rc, coalesce(max(f1) FILTER (c = 1), 0) AS f1"
        if binary
        else "avg(pr) AS pr, avg(rc) AS rc, avg(f1) AS f1"
    )
    return f"""
SELECT {comma}round(acc, 6) AS accuracy, round(pr, 6) AS "precision", round(rc, 6) AS recall, round(f1, 6) AS f1
FROM (SELECT {comma}avg((y = pred)::INTEGER) AS acc FROM {source}{group}) a
JOIN (SELECT {comma}{agg} FROM (
  SELECT {comma}c,
    CASE WHEN count(*) FILTER (k = 'p') = 0 THEN 0 ELSE count(*) FILTER (k = 'p' AND hit) / count(*) FILTER (k = 'p') END AS pr,
    CASE WHEN count(*) FILTER (k = 't') = 0 THEN 0 ELSE count(*) FILTER (k = 't' AND hit) / count(*) FILTER (k = 't') END AS rc,
    2 * count(*) FILTER (k = 'p' AND hit) / count(*) AS f1
  FROM (SELECT {comma}y AS c, 't' AS k, y = pred AS hit FROM {source}
        UNION ALL SELECT {comma}pred AS c, 'p' AS k, y = pred AS hit FROM {source})
  GROUP BY {comma}c){group}) b{using}"""
