"""Tables that the registered queries start from: the given Parquet tables and rows derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECRET = "correct horse battery staple"
SALES_METRICS = ["quantity", "price", "discount", "tax", "revenue"]
SALES_CATEGORIES = ["return_flag", "line_status", "priority", "segment", "nation", "market"]
SALES_KEYS = ["order_key", "line_number", "part_key", "supp_key"]
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, places: int) -> DataFrame:
    """Doubles rounded, because their last digits depend on the order of summation."""
    return df.select(
        *[F.round(F.col(f"`{n}`"), places).alias(n) if k == "double" else F.col(f"`{n}`") for n, k in df.dtypes]
    )


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """One flat sales table, the kind of input the operators expect."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    nations = table(spark, folder, "nation")
    joined = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(nations, customers.c_nationkey == nations.n_nationkey)
    )
    return joined.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("o_orderdate").alias("order_date"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.when(F.col("n_nationkey") < 22, "home").otherwise("export").alias("market"),
    )


def gapped_lines(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with missing values in three columns, one of them strongly skewed."""
    lines = table(spark, folder, "lineitem")
    heavy = F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity")
    return lines.select(
        *LINE_KEYS,
        F.col("l_shipdate").alias("ship_date"),
        F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("quantity"),
        F.when(F.col("l_quantity") > 20, F.col("l_linenumber")).alias("line_count"),
        F.when(F.col("l_tax") > 0.01, heavy).alias("heavy"),
        F.nullif(F.col("l_returnflag"), F.lit("A")).alias("flag"),
    )


def text_orders(spark: SparkSession, folder: str) -> DataFrame:
    """orders as an untyped file would give it: text columns only, with one column of mixed date formats."""
    orders = table(spark, folder, "orders")
    stamp = F.col("o_orderdate")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("order_no"),
        F.concat(F.lit("Order#"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("order_label"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total"),
        F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("placed_at"),
        F.when(F.col("o_orderstatus") == "F", F.date_format(stamp, "MM/dd/yyyy"))
        .otherwise(F.date_format(stamp, "yyyy-MM-dd"))
        .alias("mixed_day"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        .otherwise("n/a")
        .alias("noisy_total"),
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("customer_code"),
    )


def chart_specs(spark: SparkSession, folder: str) -> DataFrame:
    """A large table of chart specs derived from lineitem, good and bad ones; one run per order."""
    lines = table(spark, folder, "lineitem")

    def pick(column: str, *choices: tuple[str, str | None]) -> Column:
        out = F.lit(None).cast("string")
        for value, choice in choices:
            out = F.when(F.col(column) == value, F.lit(choice).cast("string")).otherwise(out)
        return out

    kind = F.element_at(
        F.array(
            *[F.lit(k) for k in ["bar", "stacked_bar", "histogram", "scatter", "line", "pivot_heatmap", "pareto"]]
        ),
        F.col("l_linenumber"),
    )
    return lines.select(
        F.col("l_orderkey").alias("run_id"),
        *[F.col(k).alias(f"key{i}") for i, k in enumerate(LINE_KEYS[1:], 1)],
        F.when(F.col("l_tax") == 0.08, F.lit(None)).otherwise(kind).alias("chart_type"),
        pick("l_returnflag", ("A", "segment"), ("N", "price"), ("R", '["nation","price"]')).alias("x"),
        F.when(F.col("l_discount") == 0.1, F.lit("margin"))
        .otherwise(pick("l_linestatus", ("O", "revenue"), ("F", None)))
        .alias("y"),
        F.when(F.col("l_quantity") > 10, F.lit("quantity")).alias("z"),
        F.when(F.col("l_quantity") > 40, F.lit("segment")).alias("color"),
    )


def domain_records(spark: SparkSession, folder: str) -> DataFrame:
    """One domain record per order."""
    orders = table(spark, folder, "orders")
    names = ["retail_sales", "hr_attrition", "finance_transactions", "logistics", "other", "space travel", "weather"]
    place = (F.col("o_custkey") % len(names)).cast("int") + 1
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.element_at(F.array(*[F.lit(n) for n in names]), place).alias("domain"),
        F.when(F.col("o_orderstatus") == "F", "High")
        .when(F.col("o_orderstatus") == "O", "Medium")
        .otherwise("certain")
        .alias("confidence"),
        F.when(F.col("o_totalprice") < 100000, F.array().cast("array<string>"))
        .when(high, F.array(F.lit("price"), F.lit("tax")))
        .otherwise(F.array(F.lit("price")))
        .alias("metrics"),
        F.when(F.col("o_totalprice") > 400000, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        .otherwise(F.create_map(F.lit("price"), F.lit("higher_is_better")))
        .alias("directions"),
    )


def causal_records(spark: SparkSession, folder: str) -> DataFrame:
    """One causal record per order; the array of connections is empty for open orders of low priority."""
    orders = table(spark, folder, "orders")
    share = F.floor(F.col("o_totalprice") / 10000).cast("string")
    first = F.struct(
        F.col("o_orderpriority").alias("issue"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("internal_evidence"),
        F.when(F.col("o_totalprice") < 50000, F.lit("")).otherwise("supplier delay").alias("causal_mechanism"),
        F.when(F.col("o_orderpriority") == "5-LOW", "perhaps").otherwise("supported").alias("verdict"),
        F.concat(F.lit("{primary: cause "), share, F.lit("%, secondary: 40%, unexplained: 25%, spread 9%}")).alias(
            "variance_decomposition"
        ),
    )
    second = F.struct(
        F.lit("late delivery").alias("issue"),
        F.lit("mean delay 4.2 days").alias("internal_evidence"),
        F.lit("port to warehouse to order").alias("causal_mechanism"),
        F.lit("no_external_evidence").alias("verdict"),
        F.lit("{primary: 60%, secondary: 30%, unexplained: 10%}").alias("variance_decomposition"),
    )
    none = F.array().cast(
        "array<struct<issue:string,internal_evidence:string,causal_mechanism:string,verdict:string,"
        "variance_decomposition:string>>"
    )
    return orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW"), none)
        .when(F.col("o_orderstatus") == "F", F.array(first, second))
        .otherwise(F.array(first))
        .alias("connections"),
    )


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """One report text per document: the document below the headings its language group brings along."""
    documents = table(spark, folder, "documents")
    full = (
        "# Executive Summary\n# Critical Issues\n## Action one\n# Root Cause\n"
        "# Recommended Actions\n### more ACTIONS\n# Data Gaps\n"
    )
    some = "# Executive Summary\n" + "## Action\n" * 6
    head = F.when(F.col("lang") == "en", F.lit(full)).when(F.col("lang") == "de", F.lit(some)).otherwise("")
    return documents.select("doc_id", F.concat(head, F.col("text")).alias("report"))


def letters(spark: SparkSession, folder: str) -> DataFrame:
    """One text per order that names its customer by token, twice for urgent ones, not at all for low priority."""
    from tablescope.operators.privacy import token

    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    tokens = customers.select(F.col("c_custkey"), token(F.col("c_name"), SECRET, "c_name").alias("who"))
    joined = orders.join(tokens, F.col("o_custkey") == F.col("c_custkey"))
    text = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("Nothing to report."))
        .when(
            F.col("o_orderpriority") == "1-URGENT",
            F.concat(F.lit("Call "), F.col("who"), F.lit(" now; "), F.col("who"), F.lit(" waits for ID-unknown.")),
        )
        .otherwise(F.concat(F.col("who"), F.lit(" ordered again")))
    )
    return joined.select("o_orderkey", text.alias("text"))


def model_answers(spark: SparkSession, folder: str) -> DataFrame:
    """One text per event that wraps its JSON properties in fences or prose, or has none."""
    events = table(spark, folder, "events")
    props = F.col("props")
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(F.col("event_type") == "error", F.concat(F.lit("Here {you} go: "), props, F.lit(" and [more].")))
        .when(F.col("event_type") == "view", F.lit("no object here { at all"))
        .otherwise(props)
    )
    return events.select("event_id", text.alias("answer"))


def memos(spark: SparkSession, folder: str) -> DataFrame:
    """One text per document; every third one ends with the name and segment of a customer."""
    documents, customers = table(spark, folder, "documents"), table(spark, folder, "customer")
    named = documents.where("doc_id % 3 = 0").join(customers, F.col("c_custkey") == F.col("doc_id") + 1, "left")
    ending = F.concat(F.lit(" Agreed with "), "c_name", F.lit(" ("), "c_mktsegment", F.lit(")."))
    plain = documents.where("doc_id % 3 <> 0").select("doc_id", "text")
    return named.select("doc_id", F.concat("text", F.coalesce(ending, F.lit(""))).alias("text")).unionAll(plain)


def private_values(spark: SparkSession, folder: str) -> DataFrame:
    """Names and segments of the customers, nations, and the sources of documents."""
    columns = [("customer", "c_name"), ("customer", "c_mktsegment"), ("nation", "n_name"), ("documents", "source")]
    parts = [table(spark, folder, t).select(F.col(c).alias("value")) for t, c in columns]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def figures(spark: SparkSession, folder: str) -> DataFrame:
    """One text per order with its total cut to tenths of thousands, hundredths of millions and whole units, and a percentage."""
    orders = table(spark, folder, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    text = (
        "concat('About ', cents div 100000, '.', (cents div 10000) % 10, 'K or ', cents div 100000000, '.', "
        "lpad(string((cents div 1000000) % 100), 2, '0'), ' million; ', cents div 100, ' in all, ', o_custkey % 100, ' % of it late.')"
    )
    return orders.select("o_orderkey", F.expr(text).alias("text"))


def known_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of the finished orders, and the discounts and quantities of all lines."""
    orders, lines = table(spark, folder, "orders").where("o_orderstatus = 'F'"), table(spark, folder, "lineitem")
    parts = [orders.select(F.col("o_totalprice").alias("v")), lines.select("l_discount"), lines.select("l_quantity")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).select(F.round("v", 2).alias("v"))
