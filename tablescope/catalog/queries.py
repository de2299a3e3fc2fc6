"""Registered queries: name -> callable(spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope import columns as cols
from tablescope.catalog import inputs as inp
from tablescope.catalog.inputs import rounded, table
from tablescope.functions import fixed_values as fx
from tablescope.functions import rounded as rd
from tablescope.functions import text as tx
from tablescope.functions.dates import read_dates
from tablescope.operators import charts, checks, findings, groups, keys, leaks, normality, order, privacy, profile
from tablescope.plans.analysis import analyse, summary, to_json_rows
from tablescope.plans.scratch import shared_folder, write_scratch
from tablescope.plans.sql_functions import register
from tablescope.sources import readers, stores
from tablescope.streaming.landing import landing_total, profile_landing

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _sales_stats(spark: SparkSession, d: str, *measures: str) -> DataFrame:
    return groups.group_stats(
        inp.sales(spark, d), inp.SALES_METRICS, inp.SALES_CATEGORIES, measures=list(measures) or None
    )


# ---- category findings ----------------------------------------------------------------------------------


@query
def concentration(spark, d):
    return groups.concentration(_sales_stats(spark, d, "total"))


@query
def pareto_critical(spark, d):
    return groups.pareto_critical(groups.concentration(_sales_stats(spark, d, "total")))


@query
def performers(spark, d):
    return groups.performers(_sales_stats(spark, d, "mean"), {"revenue": "higher_is_better", "price": "higher_is_better"})


@query
def segments(spark, d):
    return groups.segments(_sales_stats(spark, d, "mean"))


@query
def key_growth(spark, d):
    return groups.key_growth(_sales_stats(spark, d, "dated_mean"))


@query
def group_stats(spark, d):
    stats = _sales_stats(spark, d).drop("dated_mean")
    return rounded(stats, 4)


# ---- profile --------------------------------------------------------------------------------------------


@query
def profile_columns(spark, d):
    return rounded(profile.column_profile(table(spark, d, "orders")), 4)


@query
def profile_table(spark, d):
    return profile.table_profile(table(spark, d, "lineitem"))


@query
def duplicate_rows(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return profile.table_profile(lines)


@query
def null_counts(spark, d):
    return profile.null_counts(inp.gapped_lines(spark, d))


@query
def numeric_summary(spark, d):
    lines = table(spark, d, "lineitem")
    return rounded(profile.numeric_summary(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4)


@query
def text_summary(spark, d):
    return profile.text_summary(table(spark, d, "customer"))


@query
def distinct_counts(spark, d):
    return profile.distinct_counts(table(spark, d, "lineitem"))


@query
def low_cardinality_columns(spark, d):
    return cols.low_cardinality_columns(table(spark, d, "part"))


@query
def column_roles(spark, d):
    return profile.column_roles(inp.text_orders(spark, d))


@query
def impute(spark, d):
    return rounded(profile.impute(inp.gapped_lines(spark, d)), 4)


@query
def normalise_types(spark, d):
    return profile.normalise_types(inp.text_orders(spark, d))


@query
def csv_scan(spark, d):
    path = f"{shared_folder(spark)}/orders-csv-{uuid.uuid4().hex}"
    orders = table(spark, d, "orders")
    orders.write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return readers.read_csv(spark, path)


@query
def slim_profile(spark, d):
    return cols.slim_profile(profile.column_profile(table(spark, d, "orders"), exact=False))


@query
def landing_profile(spark, d):
    orders, place = table(spark, d, "orders"), f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    orders.write.option("header", True).csv(f"{place}/in")
    run = profile_landing(spark, f"{place}/in", orders.schema, f"{place}/out", uuid.uuid4().hex)
    run.awaitTermination()
    return spark.read.parquet(f"{place}/out/table_profile").select("rows", "columns", "duplicates")


@query
def search_results(spark, d):
    path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    lines = F.transform(F.split("text", "\n"), lambda s: F.struct(s.alias("content"), F.length(s).alias("score")))
    stored = table(spark, d, "documents").select(
        F.concat("source", F.lit("/"), "doc_id").alias("query"), F.struct(lines.alias("results")).alias("response")
    )
    stored.write.json(path)
    return readers.read_search_results(spark, path).select(
        "query", F.size("content").alias("results"), F.array_join("content", " | ").alias("content")
    )


@query
def stored_findings(spark, d):
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    found = groups.concentration(_sales_stats(spark, d, "total"))
    for run in ("first", "second"):
        stores.save_findings({"concentration": found}, folder, run)
    return stores.load_findings(spark, folder, "concentration", "second")


@query
def stored_charts(spark, d):
    folder = f"{shared_folder(spark)}/charts-{uuid.uuid4().hex}"
    stores.save_charts({"bar": chart_bar(spark, d), "box": chart_box(spark, d)}, folder)
    return spark.read.parquet(f"{folder}/bar")


# ---- findings over metrics ------------------------------------------------------------------------------


@query
def outliers(spark, d):
    events = findings.outliers(table(spark, d, "events"), ["value"])
    return events.unionByName(findings.outliers(table(spark, d, "lineitem")))


@query
def z_scores(spark, d):
    return findings.z_scores(table(spark, d, "events"), "value").select(
        "event_id", F.round("zscore", 6).alias("zscore")
    )


@query
def trend(spark, d):
    return findings.trend(table(spark, d, "orders"), ["o_totalprice"], "o_orderdate", ["o_orderkey"])


@query
def trend_with_gaps(spark, d):
    return findings.trend(inp.gapped_lines(spark, d), ["quantity", "heavy"], "ship_date", inp.LINE_KEYS)


@query
def trend_over_time(spark, d):
    return rounded(
        findings.trend(table(spark, d, "events"), ["value"], "ts", axis="time", epsilon=1e-12), 4
    )


@query
def correlations(spark, d):
    return findings.correlations(inp.sales(spark, d), inp.SALES_METRICS)


@query
def correlation_matrix(spark, d):
    return findings.correlation_matrix(inp.gapped_lines(spark, d), ["quantity", "line_count", "heavy"])


@query
def distribution(spark, d):
    lines = findings.distribution(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    events = findings.distribution(table(spark, d, "events"), ["value"])
    return rounded(lines.unionByName(events), 4)


@query
def period_growth(spark, d):
    return rounded(findings.period_growth(table(spark, d, "orders"), ["o_totalprice"], "o_orderdate", "month"), 4)


@query
def confidence_caps(spark, d):
    rows = inp.sales(spark, d)
    gapped = rows.withColumn("tax", F.when(F.col("quantity") > 20, F.col("tax")))
    caps = findings.confidence_caps(
        ["price", "tax", "revenue"],
        groups.concentration(groups.group_stats(gapped, ["price", "tax"], ["market", "segment"], measures=["total"])),
        profile.null_counts(gapped, ["price", "tax", "revenue"]),
        findings.outliers(gapped, ["price", "tax", "revenue"]),
        ["market"],
    )
    return caps.withColumn("reasons", F.array_join("reasons", ", "))


@query
def findings_summary(spark, d):
    found = analyse(inp.sales(spark, d), inp.SALES_KEYS, inp.SALES_METRICS, inp.SALES_CATEGORIES, store=True)
    return rounded(summary(found), 4)


@query
def findings_json(spark, d):
    return to_json_rows({"segments": groups.segments(_sales_stats(spark, d, "mean"))})


# ---- order ----------------------------------------------------------------------------------------------


@query
def row_index(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return order.row_index(orders, [F.col("o_orderdate"), F.col("o_orderkey")]).drop("row_count")


@query
def hash_sample(spark, d):
    return order.hash_sample(table(spark, d, "events"), ["event_id"], 2000).select("event_id", "value")


@query
def first_row(spark, d):
    return order.first_row(table(spark, d, "orders"), ["o_orderkey"])


# ---- charts ---------------------------------------------------------------------------------------------


@query
def chart_bar(spark, d):
    return rounded(charts.bar(inp.sales(spark, d), "nation", "revenue"), 4)


@query
def chart_stacked_bar(spark, d):
    return rounded(charts.stacked_bar(inp.sales(spark, d), "segment", "revenue", "priority"), 4)


@query
def chart_histogram(spark, d):
    return rounded(charts.histogram(table(spark, d, "events"), "value"), 4)


@query
def chart_box(spark, d):
    return rounded(charts.box(table(spark, d, "events"), "value"), 4)


@query
def chart_treemap(spark, d):
    rows = inp.sales(spark, d).withColumn("margin", F.col("revenue") - 35000)
    return rounded(charts.treemap(rows, "nation", "margin"), 4)


@query
def chart_pareto(spark, d):
    return rounded(charts.pareto(table(spark, d, "part"), "p_brand", "p_retailprice"), 4)


@query
def chart_correlation_heatmap(spark, d):
    return charts.correlation_heatmap(inp.sales(spark, d), inp.SALES_METRICS)


@query
def chart_scatter_points(spark, d):
    return charts.scatter_points(table(spark, d, "part"), "p_size", "p_retailprice", ["p_partkey"], "p_type", 500)


@query
def chart_scatter_line(spark, d):
    return rounded(charts.ols_line(inp.sales(spark, d), "quantity", "price", "segment"), 4)


@query
def chart_line(spark, d):
    return rounded(charts.line(table(spark, d, "orders"), "o_orderdate", "o_totalprice"), 8)


@query
def chart_line_text(spark, d):
    day = F.when(F.col("o_orderstatus") == "F", "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return rounded(charts.line(table(spark, d, "orders").withColumn("day", day), "day", "o_totalprice", "month"), 6)


@query
def chart_pivot_cells(spark, d):
    return rounded(charts.pivot_cells(inp.sales(spark, d), "segment", "priority", "revenue"), 4)


@query
def chart_pivot_heatmap(spark, d):
    return rounded(charts.pivot_heatmap(inp.sales(spark, d), "segment", "return_flag", "revenue"), 4)


@query
def chart_specs_valid(spark, d):
    return charts.valid_charts(inp.chart_specs(spark, d), inp.sales(spark, d))


@query
def chart_specs_chosen(spark, d):
    specs = inp.chart_specs(spark, d)
    return charts.chosen_charts(specs, inp.sales(spark, d), ["run_id", "key1", "key2", "key3"], 6)


@query
def kpis(spark, d):
    return rounded(
        charts.kpis(
            inp.sales(spark, d), inp.SALES_METRICS, inp.SALES_KEYS, direction={"discount": "lower_is_better"}
        ),
        4,
    )


@query
def dimension_values(spark, d):
    return charts.dimension_values(table(spark, d, "part"), ["p_partkey"], 5)


# ---- personal data --------------------------------------------------------------------------------------


@query
def pii_columns(spark, d):
    customers = privacy.sensitive_columns(table(spark, d, "customer"))
    return customers.unionByName(privacy.sensitive_columns(table(spark, d, "documents")))


@query
def tokenise(spark, d):
    return privacy.tokenise(table(spark, d, "customer"), ["c_name"], inp.SECRET)


@query
def token_map(spark, d):
    tokens = privacy.token_map(table(spark, d, "customer"), ["c_name"], inp.SECRET)
    return tokens.select("column", "token", F.octet_length("ciphertext").alias("ciphertext_bytes"))


@query
def token_map_opened(spark, d):
    tokens = privacy.token_map(table(spark, d, "customer"), ["c_name", "c_mktsegment"], inp.SECRET)
    return privacy.open_token_map(tokens, inp.SECRET)


@query
def detokenise(spark, d):
    customers = table(spark, d, "customer")
    tokens = privacy.token_map(customers, ["c_mktsegment"], inp.SECRET)
    hidden = privacy.tokenise(customers, ["c_mktsegment"], inp.SECRET)
    return privacy.detokenise(hidden, "c_mktsegment", tokens, inp.SECRET)


@query
def detokenise_text(spark, d):
    tokens = privacy.token_map(table(spark, d, "customer"), ["c_name"], inp.SECRET)
    return privacy.detokenise_text(inp.letters(spark, d), "o_orderkey", "text", tokens, inp.SECRET)


@query
def leak_check(spark, d):
    customers = table(spark, d, "customer")
    hidden = privacy.tokenise(customers, ["c_name"], inp.SECRET)
    half = hidden.withColumn(
        "c_mktsegment",
        F.when(F.col("c_acctbal") > 0, privacy.token(F.col("c_mktsegment"), inp.SECRET, "c_mktsegment")).otherwise(
            F.col("c_mktsegment")
        ),
    ).drop("c_nationkey")
    return privacy.leak_check(customers, half, ["c_name", "c_mktsegment", "c_nationkey"])


@query
def token_collisions(spark, d):
    documents = table(spark, d, "documents")
    return privacy.leak_check(
        documents, privacy.tokenise(documents, ["text"], inp.SECRET), ["text"]
    ).select("column", "collisions")


# ---- text -----------------------------------------------------------------------------------------------


@query
def clean_text(spark, d):
    documents = table(spark, d, "documents")
    dressed = F.regexp_replace(F.regexp_replace(F.col("text"), ", ", "—"), " d", " –d")
    return documents.select("doc_id", tx.clean_text(dressed).alias("text"))


@query
def number_mentions(spark, d):
    return tx.number_mentions(table(spark, d, "documents"), "doc_id", "text")


@query
def ground_truth_numbers(spark, d):
    lines = table(spark, d, "lineitem").select(F.format_string("%.2f and %.2f", "l_discount", "l_quantity").alias("t"))
    return tx.ground_truth_numbers(lines, "t")


@query
def invented_numbers(spark, d):
    truth = tx.ground_truth_numbers(table(spark, d, "benchmark"), "text")
    return tx.invented_numbers(table(spark, d, "documents"), "doc_id", "text", truth)


@query
def section_check(spark, d):
    found = checks.report_check(inp.reports(spark, d), "report", "doc_id")
    return found.withColumn("missing_sections", F.array_join("missing_sections", "; "))


@query
def word_count(spark, d):
    words = tx.word_count(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", words.alias("words"), (words >= fx.MIN_REPORT_WORDS).alias("long_enough")
    )


@query
def json_payload(spark, d):
    found = inp.model_answers(spark, d).withColumn("payload", tx.json_payload(F.col("answer")))
    return found.select("event_id", "payload", F.get_json_object("payload", "$.k").cast("bigint").alias("k"))


@query
def nested_contents(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda s: F.struct(s.alias("content")))
    rows = table(spark, d, "documents").select("doc_id", "source", F.struct(lines.alias("results")).alias("response"))
    found = rows.select("doc_id", tx.result_contents(F.col("source"), F.col("response")).alias("r"))
    return found.select(
        "doc_id",
        F.col("r.query").alias("query"),
        F.size("r.content").alias("results"),
        F.array_join("r.content", " | ").alias("content"),
    )


@query
def map_keys(spark, d):
    keyed = table(spark, d, "events").select("event_id", F.create_map("user_id", "value").alias("m"))
    texts = keyed.select("event_id", tx.text_keys(F.col("m"), keyed.schema["m"].dataType).alias("m"))
    return texts.select("event_id", F.explode("m").alias("key", "value"))


@query
def percent_sums(spark, d):
    one = F.explode("connections").alias("c")
    return inp.causal_records(spark, d).select("run_id", one).groupBy("run_id").agg(
        F.sum(tx.percent_sum(F.col("c.variance_decomposition"))).alias("percent_sum")
    )


# ---- run-record checks ----------------------------------------------------------------------------------


@query
def domain_check(spark, d):
    return checks.domain_check(inp.domain_records(spark, d))


@query
def chart_check(spark, d):
    return checks.chart_check(inp.chart_specs(spark, d))


@query
def repeated_pairs(spark, d):
    specs = inp.chart_specs(spark, d).select(
        "run_id", F.concat_ws("-", "key1", "key2", "key3").alias("place"), "x", "y"
    )
    return checks.repeated_pairs(specs, "place")


@query
def causal_check(spark, d):
    return checks.causal_check(inp.causal_records(spark, d))


@query
def scorecard(spark, d):
    domain = checks.node_scores(checks.domain_check(inp.domain_records(spark, d)), "domain")
    plots = checks.node_scores(checks.chart_check(inp.chart_specs(spark, d)), "charts")
    causal = checks.node_scores(checks.causal_check(inp.causal_records(spark, d)), "causal")
    report = inp.reports(spark, d).withColumnRenamed("doc_id", "run_id")
    heads = checks.node_scores(checks.report_check(report), "report")
    truth = tx.ground_truth_numbers(table(spark, d, "benchmark"), "text")
    documents = table(spark, d, "documents").withColumnRenamed("doc_id", "run_id")
    faith = checks.node_scores(tx.invented_numbers(documents, "run_id", "text", truth), "faithfulness")
    hidden = checks.node_scores(anonymisation_check(spark, d), "anonymisation")
    return checks.scorecard([domain, heads, plots, faith, causal, hidden])


@query
def anonymisation_check(spark, d):
    """Two runs: one with all leaks, and one that has hidden the customers' names only."""
    first = leak_check(spark, d).withColumn("run_id", F.lit(1))
    second = leak_check(spark, d).where("column = 'c_name'").withColumn("run_id", F.lit(2))
    return privacy.anonymisation_check(first.unionByName(second))


# ---- inputs that real files bring ------------------------------------------------------------------------


def _us_orders(spark, d):
    """Orders with the day as MM/dd/yyyy text."""
    return table(spark, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "MM/dd/yyyy"))


@query
def trend_us_dates(spark, d):
    return findings.trend(_us_orders(spark, d), ["o_totalprice"], "o_orderdate", ["o_orderkey"])


@query
def period_growth_us_dates(spark, d):
    return rounded(findings.period_growth(_us_orders(spark, d), ["o_totalprice"], "o_orderdate", "month"), 4)


@query
def csv_quoted(spark, d):
    """Documents with quotes and line breaks, through a delimited file and back."""
    path = f"{shared_folder(spark)}/documents-csv-{uuid.uuid4().hex}"
    writer = table(spark, d, "documents").write.option("header", True).option("escape", '"').option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv(spark, path)


@query
def csv_missing_words(spark, d):
    path = f"{shared_folder(spark)}/parts-csv-{uuid.uuid4().hex}"
    size = F.when(F.col("p_size") > 25, F.lit("NA")).when(F.col("p_size") > 20, F.lit("null")).otherwise(F.col("p_size").cast("string"))
    table(spark, d, "part").select("p_partkey", size.alias("p_size")).write.option("header", True).csv(path)
    return readers.read_csv(spark, path)


@query
def wide_metrics(spark, d):
    """More metrics than any default ever took, and no list of them given."""
    rows = table(spark, d, "lineitem").select(*[(F.col("l_quantity") * (i + 1)).alias(f"amount_{i}") for i in range(36)])
    return rounded(findings.distribution(rows), 4)


@query
def decimal_findings(spark, d):
    rows = table(spark, d, "events").select(F.col("value").cast("decimal(18,4)").alias("value"))
    return findings.outliers(rows)


WIDE = [f"mix_{i}" for i in range(12)]


@query
def correlation_wide(spark, d):
    mixed = [((F.col("l_quantity") * (i + 1) + F.col("l_extendedprice") / (10 * (i + 1))) / (i + 1) - F.col("l_tax") * i * i).alias(c) for i, c in enumerate(WIDE)]
    return findings.correlations(table(spark, d, "lineitem").select(*mixed), WIDE)


# ---- merged states, keys, texts against values, runs ----------------------------------------------------


@query
def landing_merged(spark, d):
    """Three intakes of one folder; the profile of all rows comes from their states, and is held against the table."""
    orders, place, name = table(spark, d, "orders"), f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}", uuid.uuid4().hex
    for part in range(3):
        rows = orders.where(F.col("o_orderkey") % 3 == part)
        rows.write.mode("append").option("header", True).csv(f"{place}/in")
        profile_landing(spark, f"{place}/in", orders.schema, f"{place}/out", name, each_batch=False).awaitTermination()
    total = write_scratch(landing_total(spark, f"{place}/out", name), "total")
    exact = profile.distinct_counts(orders).withColumnRenamed("cardinality", "exact")
    close = (F.abs(F.col("cardinality") - F.col("exact")) <= 0.03 * F.col("exact")).alias("cardinality_close")
    checks_of = []
    for r in total.where("q50 IS NOT NULL").select("column", "q25", "q50", "q75").collect():
        inside = F.lit(True)
        for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            v = F.col(r["column"])
            inside = inside & (F.avg((v < r[q]).cast("int")) <= p + 0.02) & (F.avg((v <= r[q]).cast("int")) >= p - 0.02)
        checks_of.append(orders.agg(F.lit(r["column"]).alias("column"), inside.alias("inside")))
    ranks = checks_of[0]
    for more in checks_of[1:]:
        ranks = ranks.unionAll(more)
    joined = total.join(exact, "column").join(ranks, "column", "left")
    exactly = ["column", "dtype", "rows", "null_count", "mean", "std", "min", "max", "skewness", "kurtosis", "role"]
    return rounded(joined.select(*exactly, close, F.coalesce("inside", F.lit(True)).alias("quartiles_close")), 4)


@query
def unique_keys(spark, d):
    found = keys.unique_keys(table(spark, d, "lineitem"), 3)
    return found.select(F.array_join("columns", ",").alias("key_columns"), "size")


@query
def text_leaks(spark, d):
    return leaks.text_leaks(inp.memos(spark, d), "doc_id", "text", inp.private_values(spark, d), "value")


@query
def normality_w(spark, d):
    lines = normality.normality(table(spark, d, "lineitem"), inp.LINE_KEYS, ["l_quantity", "l_extendedprice"])
    return normality.normality(table(spark, d, "events"), ["event_id"], ["value"]).unionAll(lines)


@query
def rounded_numbers(spark, d):
    found = rd.rounded_numbers(inp.figures(spark, d), "o_orderkey", "text", inp.known_amounts(spark, d), "v")
    return rounded(found, 6)


@query
def findings_difference(spark, d):
    """Two runs in the store, the second without the export market and with another measure; what changed between them."""
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    whole = rounded(_sales_stats(spark, d, "total"), 2)
    home = groups.group_stats(inp.sales(spark, d).where("market = 'home'"), inp.SALES_METRICS, inp.SALES_CATEGORIES, measures=["total", "n"])
    stores.save_findings({"totals": whole}, folder, "all/markets")
    stores.save_findings({"totals": rounded(home, 2)}, folder, "home market")
    before, after = (stores.load_findings(spark, folder, "totals", run).drop("run_id", "dated_rows") for run in ("all/markets", "home market"))
    found = stores.findings_difference(before, after, ["category", "key", "metric"])
    return found.withColumn("changed_columns", F.array_join("changed_columns", ","))


@query
def period_growth_spine(spark, d):
    """Months, weeks and days of a table in which whole months, weeks and days are missing."""
    gone = "dayofyear(o_orderdate) % 3 > 0 AND month(o_orderdate) <> 7 AND day(o_orderdate) < 20"
    orders = table(spark, d, "orders").where(gone)
    parts = [
        findings.period_growth_spine(orders, ["o_totalprice"], "o_orderdate", unit).withColumn("unit", F.lit(unit)) for unit in ("month", "week", "day")
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).withColumn("value", F.round("value", 4))


# ---- files and texts of mixed forms ---------------------------------------------------------------------


@query
def csv_header_orders(spark, d):
    """Three files of one folder, each with its columns in another order and one with a further column."""
    path, customers = f"{shared_folder(spark)}/customers-csv-{uuid.uuid4().hex}", table(spark, d, "customer")
    for part, names in enumerate((["c_custkey", "c_name", "c_mktsegment"], ["c_mktsegment", "c_custkey", "c_name"], ["c_name", "c_acctbal", "c_mktsegment", "c_custkey"])):
        customers.where(F.col("c_custkey") % 3 == part).select(*names).write.mode("append").option("header", True).csv(path)
    return readers.read_csv(spark, path).select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@query
def csv_mixed_encoding(spark, d):
    """Two folders of one table, one in each encoding; the folder's name is a column."""
    path = f"{shared_folder(spark)}/labels-csv-{uuid.uuid4().hex}"
    orders = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("é "), "o_orderpriority").alias("label"))
    for part, encoding in enumerate(("UTF-8", "ISO-8859-1")):
        rows = orders.where(F.col("o_orderkey") % 2 == part)
        rows.write.option("header", True).option("encoding", encoding).csv(f"{path}/part={part}")
    return readers.read_csv(spark, path)


@query
def csv_records(spark, d):
    """Records with a field too many or too few are counted."""
    path = f"{shared_folder(spark)}/ragged-csv-{uuid.uuid4().hex}"
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 5 == 1, "more"))
    lines = table(spark, d, "orders").select(line.alias("key,status,priority"))
    lines.write.option("header", True).option("quote", "\u0000").option("sep", "|").csv(path)
    return readers.file_records(spark, path).agg(F.sum("records").alias("records"), F.sum("bad_records").alias("bad_records"))


@query
def search_results_broken(spark, d):
    path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    results = F.array(F.struct(F.col("lang").alias("content")))
    good = F.to_json(F.struct(F.col("source").alias("query"), F.struct(results.alias("results")).alias("response")))
    table(spark, d, "documents").select(F.when(F.col("doc_id") % 4 == 1, F.lit("{broken")).otherwise(good).alias("value")).write.text(path)
    count = readers.broken_lines(spark, path).agg(F.sum("broken").alias("broken"))
    found = readers.read_search_results(spark, path).select("query", F.size("content").alias("results"))
    return found.select("query", "results", F.lit(count.first().broken).cast("bigint").alias("broken"))


def _mixed_dates(spark, d):
    """Orders with their day in five forms, and one that is no date."""
    form = F.col("o_orderkey") % 6
    day = F.when(form == 5, "soon")
    for k, pattern in enumerate(("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "MMM d, yyyy", "d-MMM-yy")):
        day = day.when(form == k, F.date_format("o_orderdate", pattern))
    return table(spark, d, "orders").select("o_orderkey", day.alias("day"))


@query
def date_evidence(spark, d):
    return read_dates(_mixed_dates(spark, d), "day").evidence


@query
def dates_read(spark, d):
    orders = _mixed_dates(spark, d)
    return orders.select("o_orderkey", read_dates(orders, "day").parsed(F.col("day")).alias("day"))


@query
def payload_fields(spark, d):
    """JSON objects whose fields differ by event type, as typed columns."""
    events = table(spark, d, "events").where("event_type <> 'error'")
    kind = F.when(F.col("event_type").isin("click", "view"), F.col("event_type"))
    amount = F.when(F.col("event_type") != "view", F.col("value"))
    ids = F.when(F.col("event_type") == "click", F.array("user_id", "event_id"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    payload = F.to_json(F.struct(k.alias("k"), kind.alias("kind"), amount.alias("amount"), ids.alias("ids")))
    return tx.payload_fields(events.select("event_id", payload.alias("payload")), "payload").select("event_id", "k", "kind", F.col("amount").cast("double").alias("amount"), F.array_join("ids", ",").alias("ids"))


@query
def sql_surface(spark, d):
    """Five operators called from SQL: two table functions and three scalar ones."""
    register(spark)
    orders, letters, documents = f"surface_{uuid.uuid4().hex}", f"surface_{uuid.uuid4().hex}", f"surface_{uuid.uuid4().hex}"
    table(spark, d, "orders").createOrReplaceTempView(orders)
    inp.figures(spark, d).createOrReplaceTempView(letters)
    table(spark, d, "documents").createOrReplaceTempView(documents)
    trend = f"trend_of(TABLE(SELECT o_orderpriority, o_orderkey, o_totalprice FROM {orders}) PARTITION BY o_orderpriority ORDER BY o_orderkey)"
    mentions = f"mentions_of(TABLE(SELECT o_orderkey, text FROM {letters}))"
    return spark.sql(f"""
        SELECT 'trend' AS operator, o_orderpriority AS key, string(n) AS a, string(cast(slope AS decimal(18,4))) AS b, string(cast(r2 AS decimal(12,8))) AS c FROM {trend}
        UNION ALL SELECT 'mentions', string(o_orderkey), string(place), mention, NULL FROM {mentions}
        UNION ALL SELECT 'token', string(o_orderkey), value_token(o_orderpriority, 'key', 'p'), NULL, NULL FROM {orders}
        UNION ALL SELECT 'number', string(o_orderkey), compact_number(floor(o_totalprice / 10) * 10), string(cast(percent_change(o_orderkey, o_custkey) AS decimal(18,2))), NULL FROM {orders}
        UNION ALL SELECT 'words', string(doc_id), string(word_count(text)), sha2(clean_text(text), 256), NULL FROM {documents}""")
