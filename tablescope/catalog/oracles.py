"""SQL for the registered queries, over the same Parquet tables."""

from __future__ import annotations

from itertools import combinations

from tablescope.catalog.inputs import SALES_CATEGORIES, SALES_METRICS, SECRET
from tablescope.functions import fixed_values as fx
from tablescope.functions import rounded as rd
from tablescope.operators import normality as nm

ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def union(parts: list[str], by_name: bool = False) -> str:
    return (" UNION ALL BY NAME " if by_name else " UNION ALL ").join(f"({p})" for p in parts)


SALES = """SELECT l_orderkey AS order_key, l_linenumber AS line_number, l_partkey AS part_key, l_suppkey AS supp_key,
  o_orderdate AS order_date, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
  l_extendedprice * (1 - l_discount) AS revenue, l_returnflag AS return_flag, l_linestatus AS line_status,
  o_orderpriority AS priority, c_mktsegment AS segment, n_name AS nation,
  CASE WHEN n_nationkey < 22 THEN 'home' ELSE 'export' END AS market
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey"""

GAPPED = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS ship_date,
  nullif(l_quantity, 7.0) AS quantity, CASE WHEN l_quantity > 20 THEN l_linenumber END AS line_count,
  CASE WHEN l_tax > 0.01 THEN l_quantity * l_quantity * l_quantity * l_quantity END AS heavy,
  nullif(l_returnflag, 'A') AS flag FROM lineitem"""

TEXT_ORDERS = """SELECT CAST(o_orderkey AS VARCHAR) AS order_no,
  'Order#' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS order_label, o_orderstatus AS status,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed_at,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END
    AS mixed_day,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) ELSE 'n/a' END
    AS noisy_total,
  lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS customer_code FROM orders"""

CHART_SPECS = """SELECT l_orderkey AS run_id, l_linenumber AS key1, l_partkey AS key2, l_suppkey AS key3,
  CASE WHEN l_tax = 0.08 THEN NULL ELSE
    (['bar','stacked_bar','histogram','scatter','line','pivot_heatmap','pareto'])[l_linenumber] END AS chart_type,
  CASE l_returnflag WHEN 'A' THEN 'segment' WHEN 'N' THEN 'price' WHEN 'R' THEN '["nation","price"]' END AS x,
  CASE WHEN l_discount = 0.1 THEN 'margin' WHEN l_linestatus = 'O' THEN 'revenue' END AS y,
  CASE WHEN l_quantity > 10 THEN 'quantity' END AS z,
  CASE WHEN l_quantity > 40 THEN 'segment' END AS color FROM lineitem"""

DOMAIN_RECORDS = """SELECT o_orderkey AS run_id,
  (['retail_sales','hr_attrition','finance_transactions','logistics','other','space travel','weather'])
    [o_custkey % 7 + 1] AS domain,
  CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Medium' ELSE 'certain' END AS confidence,
  CASE WHEN o_totalprice < 100000 THEN [] WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN ['price','tax']
    ELSE ['price'] END AS metrics,
  CASE WHEN o_totalprice > 400000 THEN [] ELSE ['price'] END AS directed FROM orders"""

DOMAIN_CHECK = f"""SELECT run_id, list_contains({fx.DOMAINS}, domain) AS valid_domain,
  list_contains({fx.CONFIDENCES}, confidence) AS has_confidence, len(metrics) > 0 AS has_key_metrics,
  len(directed) > 0 AS has_directions, list_has_all(directed, metrics) AS keys_match FROM ({DOMAIN_RECORDS})"""

CAUSAL_ROWS = """SELECT o_orderkey AS run_id, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS price,
  CAST(floor(o_totalprice / 10000) AS BIGINT) + 65 AS first_sum FROM orders"""

CAUSAL_CHECK = f"""SELECT run_id, connection_count,
    CAST(CASE WHEN connection_count = 0 THEN 1 ELSE found END AS INTEGER) AS issue_count,
    connection_count > 0 AND found = 0 AS pass
  FROM (SELECT run_id, CAST(CASE WHEN st = 'O' AND pr = '5-LOW' THEN 0 WHEN st = 'F' THEN 2 ELSE 1 END AS INTEGER)
      AS connection_count,
    CAST(st = 'P' AS INTEGER) + CAST(price < 50000 AS INTEGER) + CAST(pr = '5-LOW' AS INTEGER)
      + CAST(first_sum NOT BETWEEN 85 AND 115 AS INTEGER) AS found FROM ({CAUSAL_ROWS}))"""

CHART_CHECK = f"""SELECT run_id, CAST(sum(bad) AS BIGINT) AS violation_count, sum(bad) = 0 AS pass FROM (
  SELECT run_id,
    CAST(coalesce(chart_type = 'stacked_bar', false) AND color IS NOT DISTINCT FROM x AS INTEGER)
    + CAST(coalesce(chart_type = 'pivot_heatmap', false) AND z IS NULL AS INTEGER)
    + CAST(coalesce(chart_type IN ('bar','line','scatter'), false) AND x IS NULL AS INTEGER)
    + CAST(row_number() OVER (PARTITION BY run_id, x, y ORDER BY key1, key2, key3) > 1 AS INTEGER) AS bad
  FROM ({CHART_SPECS})) GROUP BY run_id"""


# ---- category findings ----------------------------------------------------------------------------------


def stats_sql(source: str, metrics: list[str], categories: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS category, {c} AS key, '{m}' AS metric, coalesce(sum({m}), 0) AS total, avg({m}) AS mean, "
            f"stddev({m}) AS sd, count({m}) AS n, count(*) AS dated_rows FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"
            for c in categories
            for m in metrics
        ]
    )


STATS = f"WITH sales AS ({SALES}), stats AS ({stats_sql('sales', SALES_METRICS, SALES_CATEGORIES)})"
ENDS = """SELECT category, metric, max(mean) AS hi, min(mean) AS lo, arg_min(key, (-mean, key)) AS hi_key,
  arg_min(key, (mean, key)) AS lo_key FROM stats GROUP BY category, metric"""
CONCENTRATION = """SELECT category, metric, arg_min(key, (-total, key)) AS top_contributor,
  round(max(total) / sum(total) * 100, 2) AS contribution_pct, round(max(total) / sum(total) * 100, 2) > 50
  AS is_concentrated FROM stats GROUP BY category, metric HAVING sum(total) <> 0"""

ORACLES["concentration"] = f"{STATS} {CONCENTRATION}"
ORACLES["pareto_critical"] = f"{STATS} SELECT * FROM ({CONCENTRATION}) WHERE contribution_pct > 80"
ORACLES["group_stats"] = f"""{STATS} SELECT category, key, metric, round(total, 4) AS total, round(mean, 4) AS mean,
  round(sd, 4) AS sd, n, dated_rows FROM stats"""
SEGMENTS = f"SELECT category, metric, hi_key AS best, lo_key AS worst FROM ({ENDS})"
ORACLES["segments"] = f"{STATS} {SEGMENTS}"


def performers_sql(higher: list[str]) -> str:
    up = f"metric IN ({', '.join(quoted(m) for m in higher)})" if higher else "false"
    return f"""SELECT category, metric, CASE WHEN {up} THEN lo_key ELSE hi_key END AS worst,
  round(CASE WHEN {up} THEN lo ELSE hi END, 4) AS worst_value, CASE WHEN {up} THEN hi_key ELSE lo_key END AS best,
  round(CASE WHEN {up} THEN hi ELSE lo END, 4) AS best_value, round(hi - lo, 4) AS gap FROM ({ENDS})"""


ORACLES["performers"] = f"{STATS} {performers_sql(['revenue', 'price'])}"
KEY_GROWTH = """SELECT category, metric, round(CASE WHEN min_by(mean, key) = 0 THEN 0 ELSE
  (max_by(mean, key) - min_by(mean, key)) / min_by(mean, key) * 100 END, 2) AS percent_growth
  FROM stats GROUP BY category, metric"""
ORACLES["key_growth"] = f"{STATS} {KEY_GROWTH}"

# ---- profile --------------------------------------------------------------------------------------------

ORDER_COLUMNS = [
    ("o_orderkey", "bigint", "numeric"),
    ("o_custkey", "bigint", "numeric"),
    ("o_orderstatus", "string", "categorical"),
    ("o_totalprice", "double", "numeric"),
    ("o_orderdate", "timestamp_ntz", "date"),
    ("o_orderpriority", "string", "categorical"),
]


def profile_row(name: str, kind: str, role: str) -> str:
    v = f"CAST({name} AS DOUBLE)" if role == "numeric" else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{name}' AS column, '{kind}' AS dtype, count(*) - count({name}) AS null_count,
      round((count(*) - count({name})) / count(*) * 100, 2) AS null_percent, count(DISTINCT {name}) AS cardinality,
      round(avg({v}), 4) AS mean, round(stddev({v}), 4) AS std, round(min({v}), 4) AS min,
      round(quantile_cont({v}, 0.25), 4) AS q25, round(quantile_cont({v}, 0.5), 4) AS q50,
      round(quantile_cont({v}, 0.75), 4) AS q75, round(max({v}), 4) AS max,
      round(skewness({v}), 3) AS skewness, round(kurtosis({v}), 3) AS kurtosis, '{role}' AS role FROM orders"""


ORACLES["profile_columns"] = union([profile_row(*c) for c in ORDER_COLUMNS])
ORACLES["profile_table"] = """SELECT (SELECT count(*) FROM lineitem) AS rows, CAST(11 AS INTEGER) AS columns,
  (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates"""
ORACLES["duplicate_rows"] = """SELECT (SELECT count(*) FROM lineitem) AS rows, CAST(3 AS INTEGER) AS columns,
  (SELECT count(*) FROM lineitem)
  - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem)) AS duplicates"""
GAPPED_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ship_date", "quantity", "line_count", "heavy", "flag",
]
ORACLES["null_counts"] = f"WITH t AS ({GAPPED}) " + union(
    [
        f"SELECT '{c}' AS column, count(*) - count({c}) AS null_count, "
        f"round((count(*) - count({c})) / count(*) * 100, 2) AS null_percent FROM t"
        for c in GAPPED_COLUMNS
    ]
)
ORACLES["numeric_summary"] = union(
    [
        f"""SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS std,
        round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
        round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max, round(skewness({c}), 3) AS skewness,
        round(kurtosis({c}), 3) AS kurtosis FROM lineitem"""
        for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    ]
)
ORACLES["text_summary"] = union(
    [
        f"""SELECT '{c}' AS column, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique,
        arg_min(v, (-n, v)) AS top, max(n) AS freq
        FROM (SELECT {c} AS v, count(*) AS n FROM customer WHERE {c} IS NOT NULL GROUP BY {c})"""
        for c in ["c_name", "c_mktsegment"]
    ]
)
LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
ORACLES["distinct_counts"] = union(
    [f"SELECT '{c}' AS column, count(DISTINCT {c}) AS cardinality FROM lineitem" for c in LINE_COLUMNS]
)
ORACLES["low_cardinality_columns"] = union(
    [
        f"SELECT '{c}' AS column, count(DISTINCT {c}) AS cardinality FROM part HAVING count(DISTINCT {c}) < 50"
        for c in ["p_name", "p_brand", "p_type"]
    ]
)
TEXT_COLUMNS = [
    "order_no", "order_label", "status", "total", "placed_at", "mixed_day", "noisy_total", "customer_code",
]
STRPTIME = {
    "yyyy-MM-dd": "%Y-%m-%d",
    "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S",
    "yyyy-MM-dd'T'HH:mm:ss": "%Y-%m-%dT%H:%M:%S",
    "yyyy/MM/dd": "%Y/%m/%d",
    "MM/dd/yyyy": "%m/%d/%Y",
    "dd/MM/yyyy": "%d/%m/%Y",
    "dd-MM-yyyy": "%d-%m-%Y",
    "yyyyMMdd": "%Y%m%d",
    "HH:mm": "%H:%M",
}


def role_row(c: str) -> str:
    shares = ", ".join(
        f"avg(CASE WHEN regexp_matches({c}, {quoted(shape)}) AND try_strptime({c}, {quoted(STRPTIME[fmt])}) IS NOT NULL "
        "THEN 1.0::DOUBLE ELSE 0 END)"
        for fmt, shape in fx.DATE_SHAPES
    )
    number = f"avg(CASE WHEN regexp_matches({c}, {quoted(fx.NUMBER_SHAPE)}) THEN 1.0::DOUBLE ELSE 0 END)"
    return f"""SELECT '{c}' AS column, count(DISTINCT {c}) AS cardinality, greatest({shares}) AS ds, {number} AS ns,
      count(*) AS n FROM t"""


ORACLES["column_roles"] = f"""WITH t AS ({TEXT_ORDERS}), r AS ({union([role_row(c) for c in TEXT_COLUMNS])})
  SELECT "column", cardinality, round(ds, 6) AS date_share, round(ns, 6) AS number_share,
  CASE WHEN ds > 0.6 THEN 'date' WHEN ns > 0.8 THEN 'numeric' WHEN cardinality >= 0.9 * n THEN 'id'
  WHEN cardinality < 100 THEN 'categorical' END AS role FROM r"""
ORACLES["impute"] = f"""WITH t AS ({GAPPED}), s AS (SELECT
  CASE WHEN abs(skewness(quantity)) <= 1 THEN avg(quantity) ELSE median(quantity) END AS q,
  CASE WHEN abs(skewness(line_count)) <= 1 THEN avg(line_count) ELSE median(line_count) END AS c,
  CASE WHEN abs(skewness(heavy)) <= 1 THEN avg(heavy) ELSE median(heavy) END AS h FROM t)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ship_date, round(coalesce(quantity, q), 4) AS quantity,
  round(coalesce(CAST(line_count AS DOUBLE), c), 4) AS line_count, round(coalesce(heavy, h), 4) AS heavy,
  coalesce(flag, 'Unknown') AS flag FROM t, s"""
ORACLES["normalise_types"] = f"""SELECT CAST(order_no AS BIGINT) AS order_no, order_label, status,
  CAST(total AS DOUBLE) AS total, CAST(placed_at AS TIMESTAMP) AS placed_at, mixed_day, noisy_total,
  CAST(customer_code AS BIGINT) AS customer_code FROM ({TEXT_ORDERS})"""
ORACLES["csv_scan"] = """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey,
  o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"""

ORACLES["slim_profile"] = f"SELECT \"column\", null_percent, role FROM ({ORACLES['profile_columns']})"
ORACLES["landing_profile"] = """SELECT count(*) AS rows, CAST(6 AS INTEGER) AS columns,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicates FROM orders"""
ORACLES["search_results"] = """SELECT source || '/' || doc_id AS query,
  CAST(len(string_split(text, chr(10))) AS INTEGER) AS results, replace(text, chr(10), ' | ') AS content
  FROM documents"""
ORACLES["stored_findings"] = f"SELECT *, 'second' AS run_id FROM ({ORACLES['concentration']})"

# ---- findings over metrics ------------------------------------------------------------------------------


def outlier_row(source: str, c: str) -> str:
    return f"""SELECT '{c}' AS column, count(*) FILTER (z > 3) AS counts, round(max(z), 3) AS max_zscore
      FROM (SELECT abs(({c} - (SELECT avg({c}) FROM {source})) / (SELECT stddev_pop({c}) FROM {source})) AS z
      FROM {source}) HAVING count(*) FILTER (z > 3) > 0"""


ORACLES["outliers"] = union(
    [outlier_row("events", "value")]
    + [outlier_row("lineitem", c) for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]]
)
ORACLES["z_scores"] = """SELECT event_id, round((value - (SELECT avg(value) FROM events))
  / (SELECT stddev_pop(value) FROM events), 6) AS zscore FROM events"""


def trend_row(source: str, c: str, order: str) -> str:
    return f"""SELECT '{c}' AS column, CASE WHEN abs(s) <= 1e-5 THEN 'NIL' WHEN s < 0 THEN 'Negative'
      WHEN s > 0 THEN 'Positive' END AS trend, round(s, 3) AS value, round(r, 3) AS r2 FROM (
      SELECT regr_slope({c}, i) AS s, regr_r2({c}, i) AS r FROM (
      SELECT {c}, row_number() OVER (ORDER BY {order}) - 1 AS i FROM {source} WHERE {c} IS NOT NULL))"""


ORACLES["trend"] = trend_row("orders", "o_totalprice", "o_orderdate, o_orderkey")
LINE_ORDER = "ship_date, l_orderkey, l_linenumber, l_partkey, l_suppkey"
ORACLES["trend_with_gaps"] = f"WITH t AS ({GAPPED}) " + union(
    [trend_row("t", c, LINE_ORDER) for c in ["quantity", "heavy"]]
)
ORACLES["trend_over_time"] = """SELECT 'value' AS column, CASE WHEN abs(s) <= 1e-12 THEN 'NIL' WHEN s < 0 THEN 'Negative'
  ELSE 'Positive' END AS trend, round(s, 3) AS value, round(r, 3) AS r2 FROM (
  SELECT regr_slope(value, floor(epoch(ts))) AS s, regr_r2(value, floor(epoch(ts))) AS r FROM events)"""


def pairs_sql(source: str, columns: list[str]) -> str:
    return union(
        [
            f"SELECT '{a}' AS col1, '{b}' AS col2, corr({a}, {b}) AS r FROM {source}"
            for i, a in enumerate(columns)
            for b in columns[i + 1 :]
        ]
    )


def strong_pairs(pairs: str) -> str:
    return f"""SELECT col1, col2, round(r, 4) AS corr, CASE WHEN abs(r) >= 0.7 THEN 'strong' ELSE 'moderate' END AS degree,
      CASE WHEN abs(r) > 0.95 THEN 'both columns might mean the same' END AS warning FROM ({pairs}) WHERE abs(r) >= 0.5"""


def matrix_sql(source: str, columns: list[str]) -> str:
    return union(
        [
            f"SELECT '{a}' AS col1, '{b}' AS col2, "
            + ("CAST(1 AS DOUBLE)" if a == b else f"round(corr({a}, {b}), 4)")
            + f" AS corr FROM {source}" + (" LIMIT 1" if a == b else "")
            for a in columns
            for b in columns
        ]
    )


ORACLES["correlations"] = f"WITH sales AS ({SALES}) {strong_pairs(pairs_sql('sales', SALES_METRICS))}"
ORACLES["correlation_matrix"] = f"WITH t AS ({GAPPED}) {matrix_sql('t', ['quantity', 'line_count', 'heavy'])}"


def distribution_row(source: str, c: str, places: int = 4) -> str:
    return f"""SELECT '{c}' AS column, round(f.g, {places}) AS skew, CASE WHEN f.n < 3 THEN NULL WHEN p.p > 0.05 THEN 'normal'
      WHEN f.k > 3 THEN 'heavy_tailed' WHEN f.g > 1 THEN 'right_skewed' WHEN abs(f.g) < 0.5 THEN 'symmetric'
      WHEN f.g < -1 THEN 'left_skewed' WHEN f.g > 0 THEN 'slightly_right_skewed' ELSE 'slightly_left_skewed' END
      AS distribution, round(p.p, 2) AS p_value, f.n AS n
      FROM (SELECT skewness({c}) AS g, kurtosis({c}) AS k, count({c}) AS n FROM {source}) f, (
      SELECT exp(-(m / 6 * (g1 * g1 + g2 * g2 / 4)) / 2) AS p FROM (
      SELECT count(*) AS m, avg(pow(y - mu, 3)) / pow(avg(pow(y - mu, 2)), 1.5) AS g1,
      avg(pow(y - mu, 4)) / pow(avg(pow(y - mu, 2)), 2) - 3 AS g2 FROM (
      SELECT y, avg(y) OVER () AS mu FROM (SELECT {c} AS y FROM {source} WHERE {c} IS NOT NULL)))) p"""


LINE_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ORACLES["distribution"] = union(
    [distribution_row("lineitem", c) for c in ["l_quantity", "l_extendedprice"]]
    + [distribution_row("events", "value")]
)


def period_rows(source: str, metrics: list[str], date: str) -> str:
    sums = union(
        [
            f"SELECT '{m}' AS metric, CAST(date_trunc('month', {date}) AS TIMESTAMP) AS period, sum({m}) AS v "
            f"FROM {source} WHERE {date} IS NOT NULL GROUP BY ALL"
            for m in metrics
        ]
    )
    return f"""SELECT metric, period, round(v, 4) AS value, round(CASE WHEN b = 0 THEN 0 ELSE (v - b) / b * 100 END, 2)
      AS percent_growth FROM (SELECT *, lag(v) OVER (PARTITION BY metric ORDER BY period) AS b FROM ({sums}))"""


ORACLES["period_growth"] = period_rows("orders", ["o_totalprice"], "o_orderdate")


def cap_row(m: str) -> str:
    share = "(SELECT 0)"
    if m != "revenue":
        share = f"""(SELECT max(s) / sum(s) * 100 FROM (SELECT sum({m}) AS s FROM g GROUP BY market))"""
    return f"""SELECT '{m}' AS metric, {share} AS pct, (SELECT 100.0 * (count(*) - count({m})) / count(*) FROM g) AS nulls,
      (SELECT count(*) FROM g WHERE abs(({m} - (SELECT avg({m}) FROM g)) / (SELECT stddev_pop({m}) FROM g)) > 3)
      AS odd"""


ORACLES["confidence_caps"] = f"""WITH g AS (SELECT * REPLACE (CASE WHEN quantity > 20 THEN tax END AS tax) FROM ({SALES})),
  m AS ({union([cap_row(m) for m in ["price", "tax", "revenue"]])})
  SELECT metric, CASE WHEN reasons <> '' THEN 'MEDIUM' END AS cap, reasons FROM (SELECT metric, concat_ws(', ',
  CASE WHEN pct > 70 THEN 'geographic concentration' END, CASE WHEN nulls > 20 THEN 'missing data' END,
  CASE WHEN odd > 0 THEN 'outliers' END) AS reasons FROM m)"""

SALES_ORDER = "order_date, order_key, line_number, part_key, supp_key"
SALES_KEY = "order_key, line_number, part_key, supp_key"


def summary_part(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS analysis, * FROM ({sql})"


ORACLES["findings_summary"] = f"""{STATS} SELECT "analysis", "column", "counts", "max_zscore", "col1", "col2", "corr",
  "degree", "warning", round("skew", 4) AS "skew", "distribution", "p_value", "n", "trend", "value", "r2", "metric",
  "period", "percent_growth", "category", "best", "worst", "worst_value", "best_value", "gap", "top_contributor",
  "contribution_pct", "is_concentrated" FROM (""" + union(
    [
        summary_part("outliers", union([outlier_row("sales", m) for m in SALES_METRICS])),
        summary_part(
            "correlations",
            strong_pairs(pairs_sql("sales", [
                "order_key", "line_number", "part_key", "supp_key", "quantity", "price", "discount", "tax", "revenue",
            ])),
        ),
        summary_part("distribution", union([distribution_row("sales", m) for m in SALES_METRICS])),
        summary_part("trend", union([trend_row("sales", m, SALES_ORDER) for m in SALES_METRICS])),
        summary_part("period_growth", period_rows("sales", SALES_METRICS, "order_date")),
        summary_part("segments", SEGMENTS),
        summary_part("performers", performers_sql([])),
        summary_part("concentration", CONCENTRATION),
        summary_part("pareto_critical", f"SELECT * FROM ({CONCENTRATION}) WHERE contribution_pct > 80"),
        summary_part("key_growth", KEY_GROWTH),
    ],
    by_name=True,
) + ")"
ORACLES["findings_json"] = f"""{STATS} SELECT 'segments' AS analysis, '{{"category":"' || category || '","metric":"' || metric
  || '","best":"' || best || '","worst":"' || worst || '"}}' AS record FROM ({SEGMENTS})"""

# ---- order ----------------------------------------------------------------------------------------------

ORACLES["row_index"] = """SELECT o_orderkey, o_orderdate,
  row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders"""
ORACLES["hash_sample"] = "SELECT event_id, value FROM events ORDER BY md5(CAST(event_id AS VARCHAR)) LIMIT 2000"
ORACLES["first_row"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1"

# ---- charts ---------------------------------------------------------------------------------------------

ORACLES["chart_bar"] = f"SELECT nation AS x, round(sum(revenue), 4) AS y FROM ({SALES}) GROUP BY nation"
ORACLES["stored_charts"] = ORACLES["chart_bar"]
ORACLES["chart_stacked_bar"] = f"""SELECT segment AS x, priority AS color, round(sum(revenue), 4) AS y FROM ({SALES})
  GROUP BY ALL"""
ORACLES["chart_histogram"] = """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
  SELECT bin, round(lo + bin * ((hi - lo) / 20), 4) AS lo, round(CASE WHEN bin = 19 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 20) END, 4)
  AS hi, n FROM (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n,
  any_value(lo) AS lo, any_value(hi) AS hi FROM events, e GROUP BY 1)"""
ORACLES["chart_box"] = """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b,
  quantile_cont(value, 0.75) AS c FROM events)
  SELECT 'value' AS column, round(any_value(a), 4) AS q25, round(any_value(b), 4) AS q50, round(any_value(c), 4) AS q75,
  round(min(value) FILTER (value BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)), 4) AS whisker_low,
  round(max(value) FILTER (value BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)), 4) AS whisker_high,
  count(*) FILTER (value NOT BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)) AS beyond FROM events, q"""
ORACLES["chart_treemap"] = f"""WITH g AS (SELECT nation AS x, sum(revenue - 35000) AS y FROM ({SALES}) GROUP BY nation
  HAVING sum(revenue - 35000) > 0)
  SELECT x, round(y, 4) AS y, round(y / (SELECT sum(y) FROM g) * 100, 4) AS share_pct FROM g"""
ORACLES["chart_pareto"] = """WITH g AS (SELECT p_brand AS x, avg(p_retailprice) AS y FROM part GROUP BY p_brand)
  SELECT x, round(y, 4) AS y, round(sum(y) OVER (ORDER BY y DESC, x ROWS UNBOUNDED PRECEDING)
  / sum(y) OVER () * 100, 4) AS cumulative_pct FROM g"""
ORACLES["chart_correlation_heatmap"] = f"WITH sales AS ({SALES}) {matrix_sql('sales', SALES_METRICS)}"
ORACLES["chart_scatter_points"] = """SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, p_type AS color FROM part
  ORDER BY md5(CAST(p_partkey AS VARCHAR)) LIMIT 500"""
ORACLES["chart_scatter_line"] = f"""SELECT segment AS color, round(regr_slope(price, quantity), 4) AS slope,
  round(regr_intercept(price, quantity), 4) AS intercept, round(regr_r2(price, quantity), 4) AS r2,
  CAST(regr_count(price, quantity) AS BIGINT) AS n FROM ({SALES}) GROUP BY segment"""
ORACLES["chart_line"] = """SELECT o_orderdate AS x, round(avg(o_totalprice), 8) AS y FROM orders GROUP BY o_orderdate"""
ORACLES["chart_line_text"] = """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS x,
  round(avg(o_totalprice), 6) AS y FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1"""
ORACLES["chart_pivot_cells"] = f"""SELECT segment AS x, priority AS y, round(avg(revenue), 4) AS z FROM ({SALES})
  GROUP BY ALL"""
ORACLES["chart_pivot_heatmap"] = f"""SELECT segment AS x, round(avg(revenue) FILTER (return_flag = 'A'), 4) AS "A",
  round(avg(revenue) FILTER (return_flag = 'N'), 4) AS "N", round(avg(revenue) FILTER (return_flag = 'R'), 4) AS "R"
  FROM ({SALES}) GROUP BY segment"""
CHART_REASON = f"""SELECT *, reason IS NULL AS valid FROM (SELECT *, CASE WHEN chart_type IS NULL THEN 'missing chart_type'
  WHEN x LIKE '[%' THEN 'x is a list'
  WHEN y IS NULL AND chart_type <> 'histogram' THEN 'y is missing'
  WHEN y = 'margin' THEN 'y is not a column'
  WHEN chart_type IN ('scatter', 'histogram') AND x = 'segment' THEN 'x is not numeric' END AS reason
  FROM ({CHART_SPECS}))"""
ORACLES["chart_specs_valid"] = CHART_REASON
ORACLES["chart_specs_chosen"] = f"SELECT * FROM ({CHART_REASON}) WHERE valid ORDER BY run_id, key1, key2, key3 LIMIT 6"


def kpi_row(m: str, way: str) -> str:
    good = "delta >= 0" if way == "higher_is_better" else "delta < 0"
    return f"""SELECT '{m.title()}' AS label, round(v, 4) AS value,
      CASE WHEN v >= 1000 THEN printf('%.2fK', v / 1000) ELSE CAST(round(v, 2) AS VARCHAR) END AS value_str,
      '{way}' AS direction, delta, {good} AS is_good FROM (
      SELECT avg({m}) AS v, round((avg({m}) FILTER (NOT early) - avg({m}) FILTER (early)) / avg({m}) FILTER (early) * 100, 2)
      AS delta FROM h)"""


ORACLES["kpis"] = f"""WITH h AS (SELECT *, row_number() OVER (ORDER BY {SALES_ORDER}) <= count(*) OVER () // 2 AS early
  FROM ({SALES})) """ + union(
    [kpi_row(m, "lower_is_better" if m == "discount" else "higher_is_better") for m in SALES_METRICS]
)
ORACLES["dimension_values"] = """SELECT 'p_name' AS column, p_name AS value FROM part GROUP BY p_name
  ORDER BY min(p_partkey) LIMIT 5"""

# ---- personal data --------------------------------------------------------------------------------------


def pii_row(source: str, c: str) -> str:
    return f"""SELECT '{c}' AS column, regexp_matches('{c}', {quoted('(?i)' + fx.SENSITIVE_NAME)}) AS name_match,
      avg(CAST(regexp_matches({c}, {quoted(fx.EMAIL_SHAPE)}) AS DOUBLE)) AS e,
      avg(CAST(regexp_matches({c}, {quoted(fx.PHONE_SHAPE)}) AS DOUBLE)) AS p,
      avg(CAST(regexp_matches({c}, {quoted(fx.ID_SHAPE)}) AS DOUBLE)) AS i FROM {source}"""


PII = union(
    [pii_row("customer", c) for c in ["c_name", "c_mktsegment"]]
    + [pii_row("documents", c) for c in ["text", "lang", "source"]]
)
ORACLES["pii_columns"] = f"""SELECT "column", name_match, round(e, 6) AS email_share, round(p, 6) AS phone_share,
  round(i, 6) AS id_share, name_match OR greatest(e, p, i) >= 0.5 AS is_sensitive FROM ({PII})"""


def token_sql(c: str, namespace: str) -> str:
    return f"'ID-' || substr(sha256(concat_ws('~', {quoted(SECRET)}, '{namespace}', {c})), 1, 16)"


ORACLES["tokenise"] = f"""SELECT c_custkey, {token_sql('c_name', 'c_name')} AS c_name, c_nationkey, c_acctbal, c_mktsegment
  FROM customer"""
# 12 bytes of IV and a 16-byte tag around each value; the content is compared by token_map_opened
ORACLES["token_map"] = f"""SELECT DISTINCT 'c_name' AS column, {token_sql('c_name', 'c_name')} AS token,
  CAST(strlen(c_name) + 28 AS INTEGER) AS ciphertext_bytes FROM customer"""
ORACLES["token_map_opened"] = union(
    [
        f"SELECT DISTINCT '{c}' AS column, {token_sql(c, c)} AS token, {c} AS value FROM customer"
        for c in ["c_name", "c_mktsegment"]
    ]
)
ORACLES["detokenise"] = "SELECT * FROM customer"
ORACLES["detokenise_text"] = """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 'Nothing to report.'
  WHEN '1-URGENT' THEN 'Call ' || c_name || ' now; ' || c_name || ' waits for ID-unknown.'
  ELSE c_name || ' ordered again' END AS text FROM orders JOIN customer ON o_custkey = c_custkey"""
ORACLES["leak_check"] = f"""SELECT 'c_name' AS column, false AS missing, CAST(0 AS BIGINT) AS leaked_values,
  CAST(0 AS BIGINT) AS untokenised_values, count(DISTINCT c_name) - count(DISTINCT {token_sql('c_name', 'c_name')})
  AS collisions, true AS pass FROM customer
  UNION ALL SELECT 'c_mktsegment', false, count(DISTINCT c_mktsegment) FILTER (c_acctbal <= 0),
  count(DISTINCT c_mktsegment) FILTER (c_acctbal <= 0), count(DISTINCT c_mktsegment)
  - count(DISTINCT CASE WHEN c_acctbal > 0 THEN 'ID-' || c_mktsegment ELSE c_mktsegment END), false FROM customer
  UNION ALL SELECT 'c_nationkey', true, 0, 0, 0, false"""
ORACLES["token_collisions"] = f"""SELECT 'text' AS column, count(DISTINCT text)
  - count(DISTINCT {token_sql('text', 'text')}) AS collisions FROM documents"""

# ---- text -----------------------------------------------------------------------------------------------

ORACLES["clean_text"] = """SELECT doc_id, replace(replace(text, ', ', '--'), ' d', ' -d') AS text FROM documents"""
MENTIONS = f"""m AS (SELECT doc_id, text, regexp_extract_all(text, '{fx.NUMBER_PATTERN}') AS nums,
  string_split_regex(text, '{fx.NUMBER_PATTERN}') AS parts FROM documents),
  e AS (SELECT doc_id, text, unnest(nums) AS raw, unnest(range(1, len(nums) + 1)) AS i, nums, parts FROM m),
  p AS (SELECT doc_id, text, raw, CAST(length(array_to_string(parts[1:i], '')) + length(array_to_string(nums[1:i-1], ''))
  AS BIGINT) AS pos FROM e),
  x AS (SELECT doc_id, replace(raw, ',', '') AS number, pos,
  lower(substring(text, greatest(pos - 30, 0) + 1, least(pos, 30) + length(raw) + 30)) AS context,
  lower(substring(text, greatest(pos - 5, 0) + 1, least(pos, 5))) AS lead FROM p)"""
ORACLES["number_mentions"] = f"WITH {MENTIONS} SELECT doc_id, number, pos, context FROM x"


def plain_decimal(value: str, places: int) -> str:
    return (
        f"regexp_replace(CAST(TRY_CAST(round({value}, {places}) AS DECIMAL(38,{places})) AS VARCHAR), "
        "'(\\.[0-9]+?)0+$', '\\1')"
    )


def truth_sql(source: str, text: str) -> str:
    return f"""r AS (SELECT DISTINCT number, TRY_CAST(number AS DOUBLE) AS v FROM (
      SELECT unnest(regexp_extract_all({text}, '{fx.GROUND_TRUTH_PATTERN}')) AS number FROM {source})),
      truth AS (SELECT DISTINCT number FROM (SELECT number FROM r
      UNION ALL SELECT CAST(TRY_CAST(round(v * 100, 0) AS DECIMAL(38,0)) AS VARCHAR) FROM r WHERE v < 1
      UNION ALL SELECT {plain_decimal('v * 100', 2)} FROM r WHERE v < 1
      UNION ALL SELECT {plain_decimal('v / 100', 4)} FROM r WHERE v > 1) WHERE number IS NOT NULL)"""


ORACLES["ground_truth_numbers"] = f"""WITH l AS (SELECT printf('%.2f and %.2f', l_discount, l_quantity) AS t FROM lineitem),
  {truth_sql('l', 't')} SELECT number FROM truth"""
SKIPPED = " OR ".join(
    [f"contains(lead, {quoted(m)})" for m in fx.OPERATOR_MARKS]
    + [f"regexp_matches(context, {quoted(p)})" for p in fx.SKIP_PATTERNS + fx.STATISTIC_PATTERNS]
    + [f"(TRY_CAST(number AS DOUBLE) <= 20 AND contains(context, {quoted(w)}))" for w in fx.SMALL_NUMBER_WORDS]
)
ORACLES["invented_numbers"] = f"""WITH {MENTIONS}, {truth_sql('benchmark', 'text')},
  bad AS (SELECT doc_id, count(*) AS n FROM x WHERE NOT ({SKIPPED})
  AND number NOT IN (SELECT number FROM truth) GROUP BY doc_id)
  SELECT doc_id, coalesce(n, 0) AS invention_count, coalesce(n, 0) <= 5 AS pass
  FROM documents LEFT JOIN bad USING (doc_id)"""
FULL_HEAD = (
    "# Executive Summary\n# Critical Issues\n## Action one\n# Root Cause\n# Recommended Actions\n### more ACTIONS\n"
    "# Data Gaps\n"
)
PART_HEAD = "# Executive Summary\n" + "## Action\n" * 6
MISSING = ", ".join(f"CASE WHEN NOT contains(r, {quoted(s)}) THEN {quoted(s)} END" for s in fx.REPORT_SECTIONS)
ORACLES["section_check"] = f"""WITH t AS (SELECT doc_id, CASE lang WHEN 'en' THEN {quoted(FULL_HEAD)} WHEN 'de'
  THEN {quoted(PART_HEAD)} ELSE '' END || text AS r FROM documents),
  c AS (SELECT doc_id, concat_ws('; ', {MISSING}) AS missing_sections,
  CAST(len(regexp_extract_all(r, '(?im)^#{{1,3}} .*action')) AS INTEGER) AS action_count, length(r) >= 1500 AS length_ok
  FROM t)
  SELECT doc_id, missing_sections = '' AS has_all_sections, missing_sections, action_count,
  action_count <= 5 AS actions_under_5, length_ok FROM c"""
ORACLES["word_count"] = """SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS words,
  len(regexp_extract_all(text, '\\S+')) >= 1500 AS long_enough FROM documents"""
ORACLES["json_payload"] = """SELECT event_id, CASE WHEN event_type <> 'view' THEN props END AS payload,
  CASE WHEN event_type <> 'view' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events"""
ORACLES["nested_contents"] = """SELECT doc_id, source AS query, CAST(len(string_split(text, chr(10))) AS INTEGER) AS results,
  replace(text, chr(10), ' | ') AS content FROM documents"""
ORACLES["map_keys"] = "SELECT event_id, CAST(user_id AS VARCHAR) AS key, value FROM events"
ORACLES["percent_sums"] = f"""SELECT run_id, first_sum + CASE WHEN st = 'F' THEN 100 ELSE 0 END AS percent_sum
  FROM ({CAUSAL_ROWS}) WHERE NOT (st = 'O' AND pr = '5-LOW')"""

# ---- run-record checks ----------------------------------------------------------------------------------

FLAGS = ["valid_domain", "has_confidence", "has_key_metrics", "has_directions", "keys_match"]
PASSED = " + ".join(f"CAST({f} AS INTEGER)" for f in FLAGS)
ORACLES["domain_check"] = f"SELECT *, CAST({PASSED} AS DOUBLE) / 5 AS total FROM ({DOMAIN_CHECK})"
ORACLES["chart_check"] = CHART_CHECK
ORACLES["repeated_pairs"] = f"""SELECT run_id, place, x, y, row_number() OVER (PARTITION BY run_id, x, y ORDER BY place) > 1
  AS repeated FROM (SELECT run_id, concat_ws('-', key1, key2, key3) AS place, x, y FROM ({CHART_SPECS}))"""
ORACLES["causal_check"] = CAUSAL_CHECK
LEAK_ISSUES = """CAST(missing AS INTEGER) + CAST(leaked_values > 0 AS INTEGER) + CAST(untokenised_values > 0 AS INTEGER)
  + CAST(collisions > 0 AS INTEGER)"""
ORACLES["anonymisation_check"] = f"""SELECT run_id, CAST(sum({LEAK_ISSUES}) AS BIGINT) AS issue_count, sum({LEAK_ISSUES}) = 0 AS pass
  FROM (SELECT *, CAST(1 AS INTEGER) AS run_id FROM ({ORACLES["leak_check"]})
  UNION ALL SELECT *, CAST(2 AS INTEGER) FROM ({ORACLES["leak_check"]}) WHERE "column" = 'c_name') GROUP BY run_id"""
ORACLES["scorecard"] = f"""WITH h AS ({ORACLES["section_check"]}), f AS ({ORACLES["invented_numbers"]}), n AS (
  SELECT run_id, 'domain' AS node, {PASSED} AS passed, 5 AS total FROM ({DOMAIN_CHECK})
  UNION ALL SELECT doc_id, 'report', CAST(has_all_sections AS INTEGER) + CAST(actions_under_5 AS INTEGER)
  + CAST(length_ok AS INTEGER), 3 FROM h
  UNION ALL SELECT doc_id, 'faithfulness', CAST(pass AS INTEGER), 1 FROM f
  UNION ALL SELECT run_id, 'charts', CAST(pass AS INTEGER), 1 FROM ({CHART_CHECK})
  UNION ALL SELECT run_id, 'causal', CAST(pass AS INTEGER), 1 FROM ({CAUSAL_CHECK})
  UNION ALL SELECT run_id, 'anonymisation', CAST(pass AS INTEGER), 1 FROM ({ORACLES["anonymisation_check"]})),
  b AS (SELECT run_id, node, passed, total FROM n
  UNION ALL SELECT run_id, 'overall', sum(passed), sum(total) FROM n GROUP BY run_id)
  SELECT run_id, node, CAST(passed AS BIGINT) AS passed, CAST(total AS BIGINT) AS total,
  CAST(round(CAST(passed AS DOUBLE) / total * 100) AS INTEGER) AS node_score FROM b"""


# ---- inputs that real files bring ------------------------------------------------------------------------

ORACLES["trend_us_dates"] = ORACLES["trend"]
ORACLES["period_growth_us_dates"] = ORACLES["period_growth"]
ORACLES["csv_quoted"] = """SELECT CAST(doc_id AS INTEGER) AS doc_id, text, lang, source, CAST(n_chars AS INTEGER) AS n_chars
  FROM documents"""
ORACLES["csv_missing_words"] = """SELECT CAST(p_partkey AS INTEGER) AS p_partkey,
  CASE WHEN p_size <= 20 THEN CAST(p_size AS INTEGER) END AS p_size FROM part"""
ORACLES["wide_metrics"] = union(
    [distribution_row(f"(SELECT l_quantity * {i + 1} AS amount_{i} FROM lineitem)", f"amount_{i}") for i in range(36)]
)
ORACLES["decimal_findings"] = """WITH e AS (SELECT CAST(CAST(value AS DECIMAL(18,4)) AS DOUBLE) AS v FROM events),
  s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM e)
  SELECT 'value' AS column, count(*) FILTER (abs((v - m) / sd) > 3) AS counts, round(max(abs((v - m) / sd)), 3) AS max_zscore
  FROM e, s"""
WIDE = [f"mix_{i}" for i in range(12)]
WIDE_LINES = "SELECT " + ", ".join(
    f"(l_quantity * {i + 1} + l_extendedprice / {10 * (i + 1)}) / {i + 1} - l_tax * {i} * {i} AS {c}" for i, c in enumerate(WIDE)
) + " FROM lineitem"
ORACLES["correlation_wide"] = f"WITH t AS ({WIDE_LINES}) {strong_pairs(pairs_sql('t', WIDE))}"

# ---- merged states, keys, texts against values, runs ----------------------------------------------------

ORACLES["landing_merged"] = f"""SELECT "column", dtype, (SELECT count(*) FROM orders) AS rows, null_count, mean, std, min, max,
  skewness, kurtosis, role, true AS cardinality_close, true AS quartiles_close FROM ({ORACLES['profile_columns']})"""


def unique_keys_sql(source: str, columns: list[str], width: int) -> str:
    """Every group of up to `width` columns counted, and the minimal ones among those without repeated rows."""
    groups = [g for size in range(1, width + 1) for g in combinations(columns, size)]
    rows = [
        f"SELECT '{','.join(g)}' AS key_columns, {len(g)} AS size, [{', '.join(quoted(c) for c in g)}] AS names "
        f"WHERE (SELECT count(*) FROM (SELECT DISTINCT {', '.join(g)} FROM {source})) = (SELECT count(*) FROM {source})"
        for g in groups
    ]
    return f"""WITH k AS MATERIALIZED ({union(rows)})
      SELECT key_columns, CAST(size AS INTEGER) AS size FROM k AS x
      WHERE NOT EXISTS (SELECT 1 FROM k AS y WHERE y.size < x.size AND list_has_all(x.names, y.names))"""


ORACLES["unique_keys"] = unique_keys_sql("lineitem", LINE_COLUMNS, 3)
MEMOS = """SELECT doc_id, CASE WHEN doc_id % 3 = 0
    THEN text || coalesce(' Agreed with ' || c_name || ' (' || c_mktsegment || ').', '') ELSE text END AS text
  FROM documents LEFT JOIN customer ON c_custkey = doc_id + 1"""
ORACLES["text_leaks"] = f"""WITH m AS ({MEMOS}), v AS (
    SELECT c_name AS value FROM customer UNION SELECT c_mktsegment FROM customer UNION SELECT n_name FROM nation
    UNION SELECT source FROM documents)
  SELECT doc_id, value FROM m JOIN v ON length(value) >= 4 AND contains(m.text, v.value)"""


def polynomial(coefficients: list[float], x: str) -> str:
    return " + ".join(f"{c!r} * pow({x}, {k})" for k, c in enumerate(coefficients))


def normality_sql(source: str, metric: str, key: str) -> str:
    """The test on the 5,000 rows with the smallest md5 of their keys, as published (algorithms AS 241 and AS R94)."""
    centre = f"q * ({polynomial(nm.CENTRE_TOP, 'r')}) / ({polynomial(nm.CENTRE_BOTTOM, 'r')})"
    tail = f"sign(q) * ({polynomial(nm.TAIL_TOP, 't')}) / ({polynomial(nm.TAIL_BOTTOM, 't')})"
    return f"""SELECT "column", n, round(w, 6) AS w, round(p, 4) AS p_value, p > 0.05 AS normal FROM (
      WITH s AS (SELECT {metric} AS x FROM {source} WHERE {metric} IS NOT NULL ORDER BY md5({key}) LIMIT 5000),
      o AS (SELECT x - avg(x) OVER () AS x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM s),
      q AS (SELECT *, (i - 0.375) / (n + 0.25) - 0.5 AS q FROM o),
      r AS (SELECT *, 0.180625 - q * q AS r, sqrt(-ln(0.5 - abs(q))) - 1.6 AS t FROM q),
      m AS (SELECT x, i, n, CASE WHEN abs(q) <= 0.425 THEN {centre} ELSE {tail} END AS m FROM r),
      f AS (SELECT any_value(n) AS n, sum(x * x) AS ss, sum(m * m) AS mm, max(m) AS m1, max(m) FILTER (i = n - 1) AS m2,
        1 / sqrt(any_value(n)) AS u FROM m),
      a AS (SELECT *, {polynomial(nm.LAST, 'u')} + m1 / sqrt(mm) AS a1, {polynomial(nm.SECOND, 'u')} + m2 / sqrt(mm) AS a2 FROM f),
      b AS (SELECT *, sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS phi FROM a),
      l AS (SELECT sum(x * CASE i WHEN 1 THEN -a1 WHEN 2 THEN -a2 WHEN m.n THEN a1 WHEN m.n - 1 THEN a2 ELSE m / phi END) AS line
        FROM m, b),
      w AS (SELECT n, least(1.0, line * line / ss) AS w, ln(n) AS g FROM l, b),
      z AS (SELECT n, w, (ln(1 - w) - ({polynomial(nm.LARGE_MEAN, 'g')})) / exp({polynomial(nm.LARGE_LOG, 'g')}) AS z FROM w),
      h AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS h FROM z),
      e AS (SELECT n, w, z, exp(-z * z / 2) * 0.3989422804014327 * ({polynomial(nm.UPPER, 'h')}) AS e FROM h)
      SELECT '{metric}' AS "column", n, w, CASE WHEN z >= 0 THEN e ELSE 1 - e END AS p FROM e)"""


LINE_KEY = "concat_ws('~', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
ORACLES["normality_w"] = union(
    [
        normality_sql("events", "value", "CAST(event_id AS VARCHAR)"),
        normality_sql("lineitem", "l_quantity", LINE_KEY),
        normality_sql("lineitem", "l_extendedprice", LINE_KEY),
    ]
)
FIGURES = """SELECT o_orderkey, 'About ' || (cents // 100000) || '.' || (cents // 10000) % 10 || 'K or ' || (cents // 100000000) || '.'
    || lpad(CAST((cents // 1000000) % 100 AS VARCHAR), 2, '0') || ' million; ' || (cents // 100) || ' in all, ' || (o_custkey % 100)
    || ' % of it late.' AS text FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""
MENTION_PARTS = ", ".join(f"regexp_extract_all(text, {quoted(rd.ROUNDED_PATTERN)}, {k})[i] AS {n}" for k, n in enumerate(["mention", "number", "unit"]))
ORACLES["rounded_numbers"] = f"""WITH f AS ({FIGURES}),
  v AS (SELECT DISTINCT 2 * CAST(round(abs(v) * 100) AS HUGEINT) * 100000000 AS x FROM (
    SELECT o_totalprice AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_discount FROM lineitem
    UNION ALL SELECT l_quantity FROM lineitem)),
  m AS (SELECT o_orderkey, i - 1 AS place, {MENTION_PARTS} FROM
    (SELECT *, unnest(range(1, len(regexp_extract_all(text, {quoted(rd.ROUNDED_PATTERN)})) + 1)) AS i FROM f)),
  d AS (SELECT o_orderkey, CAST(place AS INTEGER) AS place, mention, CAST(replace(replace(number, ',', ''), '.', '') AS HUGEINT) AS digits,
    CASE WHEN contains(number, '.') THEN len(split_part(number, '.', 2)) ELSE 0 END AS shown,
    CASE lower(unit) WHEN 'k' THEN 3 WHEN 'million' THEN 6 ELSE 0 END AS power, unit = '%' AS percent FROM m),
  e AS (SELECT *, unnest(CASE WHEN percent THEN [power - shown, power - shown - 2] ELSE [power - shown] END) AS scale FROM d),
  u AS (SELECT DISTINCT digits, scale, (2 * digits - 1) * CAST(pow(10, scale + 10) AS HUGEINT) AS a,
    (2 * digits + 1) * CAST(pow(10, scale + 10) AS HUGEINT) AS b FROM e),
  c AS (SELECT digits, scale, count(*) AS n FROM u JOIN v ON v.x BETWEEN u.a AND u.b GROUP BY ALL)
  SELECT o_orderkey, place, mention, round(CASE WHEN any_value(digits) = 0 THEN 0.0
      ELSE (any_value(digits) - 0.5::DOUBLE) * pow(10, any_value(power - shown)) END, 6) AS low,
    round((any_value(digits) + 0.5::DOUBLE) * pow(10, any_value(power - shown)), 6) AS high,
    CAST(coalesce(sum(n), 0) AS BIGINT) AS matches, coalesce(sum(n), 0) > 0 AS supported
  FROM e LEFT JOIN c USING (digits, scale) GROUP BY o_orderkey, place, mention"""
ORACLES["findings_difference"] = f"""WITH sales AS ({SALES}), home AS (SELECT * FROM sales WHERE market = 'home'),
  b AS (SELECT category, key, metric, round(total, 2) AS total FROM ({stats_sql('sales', SALES_METRICS, SALES_CATEGORIES)})),
  a AS (SELECT category, key, metric, round(total, 2) AS total, n FROM ({stats_sql('home', SALES_METRICS, SALES_CATEGORIES)}))
  SELECT category, key, metric, CASE WHEN b.total IS NULL THEN 'added' WHEN a.n IS NULL THEN 'gone' ELSE 'changed' END AS change,
    CASE WHEN b.total IS NULL OR a.n IS NULL THEN '' ELSE
      concat_ws(',', CASE WHEN a.total <> b.total THEN 'total' END, 'n') END AS changed_columns
  FROM b FULL JOIN a USING (category, key, metric)"""

SPINE = """WITH t AS (SELECT date_trunc('{period}', o_orderdate) AS period, sum(o_totalprice) AS value, count(*) AS rows FROM orders
    WHERE extract('dayofyear' FROM o_orderdate) % 3 > 0 AND month(o_orderdate) <> 7 AND day(o_orderdate) < 20 GROUP BY 1),
  s AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 {period})) AS TIMESTAMP) AS period FROM t),
  p AS (SELECT s.period, t.value, coalesce(t.rows, 0) AS rows FROM s LEFT JOIN t USING (period))
  SELECT 'o_totalprice' AS metric, '{period}' AS unit, p.period, p.rows, round(p.value, 4) AS value,
    round(CASE WHEN e.value = 0 THEN 0 ELSE (p.value - e.value) / e.value * 100 END, 2) AS percent_growth,
    round(CASE WHEN y.value = 0 THEN 0 ELSE (p.value - y.value) / y.value * 100 END, 2) AS percent_growth_year
  FROM p LEFT JOIN p AS e ON e.period = p.period - INTERVAL 1 {period} LEFT JOIN p AS y ON y.period = p.period - INTERVAL {year}"""
ORACLES["period_growth_spine"] = union(
    [SPINE.format(period="month", year="12 month"), SPINE.format(period="week", year="52 week"), SPINE.format(period="day", year="12 month")]
)
ORACLES["csv_header_orders"] = """SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_mktsegment,
  CASE WHEN c_custkey % 3 = 2 THEN c_acctbal END AS c_acctbal FROM customer"""
ORACLES["csv_mixed_encoding"] = """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, 'é ' || o_orderpriority AS label,
  CAST(o_orderkey % 2 AS INTEGER) AS part FROM orders"""
ORACLES["csv_records"] = """SELECT count(*) AS records, count(*) FILTER (o_orderkey % 5 < 2) AS bad_records FROM orders"""
ORACLES["search_results_broken"] = """SELECT source AS query, CAST(1 AS INTEGER) AS results,
  (SELECT count(*) FROM documents WHERE doc_id % 4 = 1) AS broken FROM documents WHERE doc_id % 4 <> 1"""
ORACLES["date_evidence"] = """WITH o AS (SELECT o_orderkey % 6 AS k, day(o_orderdate) AS d, month(o_orderdate) AS m FROM orders),
  f AS (SELECT * FROM (VALUES (0, 'y-m-d', 'ymd', 'form'), (1, 'a/b/y', 'mdy', 'impossible days'), (2, 'a.b.y', 'dmy', 'impossible days'),
    (3, 'name d, y', 'ndy', 'form'), (4, 'd name y', 'dny', 'form'), (5, 'unread', NULL, NULL)) AS f(k, form, reading, reason))
  SELECT form, reading, count(*) AS values, count(*) FILTER (k < 5) AS read,
    count(*) FILTER (k IN (1, 2) AND d <= 12 AND d <> m) AS doubtful, reason FROM o JOIN f USING (k) GROUP BY form, reading, reason"""
ORACLES["dates_read"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS day FROM orders"""
ORACLES["payload_fields"] = """SELECT event_id, CAST(props->>'k' AS BIGINT) AS k,
  CASE WHEN event_type IN ('click', 'view') THEN event_type END AS kind, CASE WHEN event_type <> 'view' THEN value END AS amount,
  CASE WHEN event_type = 'click' THEN user_id || ',' || event_id END AS ids FROM events WHERE event_type <> 'error'"""

ORACLES["sql_surface"] = f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders),
  f AS ({FIGURES})
  SELECT 'trend' AS operator, o_orderpriority AS key, CAST(count(*) AS VARCHAR) AS a,
    CAST(CAST(regr_slope(o_totalprice, i) AS DECIMAL(18,4)) AS VARCHAR) AS b,
    CAST(CAST(regr_r2(o_totalprice, i) AS DECIMAL(12,8)) AS VARCHAR) AS c FROM o GROUP BY o_orderpriority
  UNION ALL SELECT 'mentions', CAST(o_orderkey AS VARCHAR), CAST(i - 1 AS VARCHAR), regexp_extract_all(text, {quoted(rd.ROUNDED_PATTERN)})[i], NULL
    FROM (SELECT *, unnest(range(1, len(regexp_extract_all(text, {quoted(rd.ROUNDED_PATTERN)})) + 1)) AS i FROM f)
  UNION ALL SELECT 'token', CAST(o_orderkey AS VARCHAR), 'ID-' || substr(sha256('key~p~' || o_orderpriority), 1, 16), NULL, NULL FROM orders
  UNION ALL SELECT 'number', CAST(o_orderkey AS VARCHAR), CASE WHEN o_totalprice >= 1000
      THEN printf('%.2fK', floor(o_totalprice / 10) * 10 / 1000) ELSE CAST(round(floor(o_totalprice / 10) * 10, 2) AS VARCHAR) END,
    CAST(CAST(CASE WHEN o_custkey = 0 THEN 0 ELSE (o_orderkey - o_custkey) / o_custkey * 100 END AS DECIMAL(18,2)) AS VARCHAR), NULL FROM orders
  UNION ALL SELECT 'words', CAST(doc_id AS VARCHAR), CAST(len(regexp_extract_all(text, '\\S+')) AS VARCHAR),
    sha256(text), NULL FROM documents"""
