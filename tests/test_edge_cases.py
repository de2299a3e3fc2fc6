"""Nulls, NaN, constants, tiny tables, ties, dirty text."""

import math

import pytest
from pyspark.sql import functions as F

from tablescope import columns as cols
from tablescope.functions import text as tx

from tablescope.operators import charts, checks, findings, groups, order, privacy, profile, quantiles
from tablescope.plans import lookup


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def as_dict(df, key):
    return {r[key]: r for r in df.collect()}


def test_duplicates_count_rows_with_null(spark):
    df = frame(spark, [(1, None), (1, None), (2, "a"), (2, "a"), (3, "b")], "a int, b string")
    assert profile.duplicate_rows(df) == 2
    assert profile.duplicate_rows(df.union(df)) == 7
    assert profile.table_profile(df).first().asDict() == {"rows": 5, "columns": 2, "duplicates": 2}


def test_one_date_format_wins(spark):
    df = frame(
        spark,
        [("2024-01-02", "1.5", "x1"), ("01/05/2024", "7.25", "x2"), ("2024-03-04", "z", "x3")],
        "day string, amount string, label string",
    )
    roles = as_dict(profile.column_roles(df), "column")
    assert roles["day"]["role"] == "date" and roles["day"]["date_share"] == pytest.approx(2 / 3, abs=1e-6)
    assert roles["amount"]["role"] == "id"  # two thirds numeric is below the limit; all values differ
    assert roles["label"]["role"] == "id"
    assert as_dict(profile.column_roles(df, approx_distinct=True), "column")["day"]["role"] == "date"


def test_compact_dates_are_dates(spark):
    df = frame(spark, [("20240101",), ("20240102",)], "d string")
    assert profile.column_roles(df).first()["role"] == "date"


def test_leading_zeros(spark):
    df = frame(spark, [("01234", "a"), ("00001", "b")], "code string, t string")
    assert [r["code"] for r in profile.normalise_types(df).collect()] == [1234, 1]
    assert profile.normalise_types(df, keep_leading_zeros=True).schema["code"].dataType.typeName() == "string"


def test_date_named_column_becomes_timestamp(spark):
    df = frame(spark, [("2024-01-01 10:00:00", "2024-01-01"), (None, "2024-01-02")], "seen_at string, order_date string")
    out = profile.normalise_types(df)
    assert dict(out.dtypes) == {"seen_at": "timestamp", "order_date": "string"}
    assert [r["seen_at"] is None for r in out.collect()] == [False, True]


def test_constant_metric(spark):
    df = frame(spark, [(i, 1.0, float(i), f"2024-01-0{i}") for i in (1, 2, 3)], "k int, c double, v double, date string")
    assert findings.outliers(df, ["c"]).count() == 0
    t = findings.trend(df, ["c"], "date", ["k"]).first()
    assert (t["trend"], t["value"], t["r2"]) == ("NIL", 0.0, 0.0)
    assert findings.correlations(df, ["c", "v"]).count() == 0
    matrix = {(r["col1"], r["col2"]): r["corr"] for r in findings.correlation_matrix(df, ["c", "v"]).collect()}
    assert matrix[("c", "c")] is None and matrix[("v", "v")] == 1.0 and matrix[("v", "c")] is None
    d = findings.distribution(df, ["c"]).first()
    assert d["n"] == 3 and d["distribution"] == "normal"
    h = charts.histogram(df, "c").collect()
    assert len(h) == 1 and h[0]["n"] == 3
    assert findings.z_scores(df, "c").where("zscore is not null").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3])
def test_tiny_tables(spark, n):
    df = frame(spark, [(i, float(i * i), f"2024-01-0{i + 1}") for i in range(n)], "k int, v double, date string")
    row = profile.numeric_summary(df, ["v"]).first()
    assert (row["skewness"] is None) == (n < 3)
    assert row["kurtosis"] is None
    findings.outliers(df, ["v"]).collect()
    assert findings.trend(df, ["v"], "date", ["k"]).count() == 1
    d = findings.distribution(df, ["v"]).first()
    assert (d["distribution"] is None) == (n < 3)


def test_empty_table(spark):
    df = frame(spark, [], "k int, v double, s string, date string")
    assert profile.table_profile(df).first()["rows"] == 0
    p = as_dict(profile.column_profile(df), "column")
    assert p["v"]["cardinality"] == 0 and p["s"]["null_count"] == 0 and p["v"]["q50"] is None
    assert findings.trend(df, ["v"], "date", ["k"]).count() == 0
    assert groups.group_stats(df, ["v"], ["s"]).count() == 0
    assert charts.histogram(df, "v").count() == 0
    assert charts.kpis(df, ["v"], ["k"]).count() == 1


def test_nan_is_missing(spark):
    df = frame(spark, [(1.0,), (float("nan"),), (3.0,)], "v double")
    row = as_dict(profile.column_profile(df), "column")["v"]
    assert (row["null_count"], row["mean"], row["max"], row["cardinality"]) == (1, 2.0, 3.0, 2)
    assert profile.null_counts(df).first()["null_count"] == 1


def test_ties_take_the_smallest_key(spark):
    df = frame(spark, [("b", 5.0), ("a", 5.0)], "cat string, v double")
    stats = groups.group_stats(df, ["v"], ["cat"])
    assert groups.concentration(stats).first()["top_contributor"] == "a"
    seg = groups.segments(stats).first()
    assert (seg["best"], seg["worst"]) == ("a", "a")


def test_zero_total_and_zero_base(spark):
    df = frame(spark, [("a", 1.0), ("b", -1.0)], "cat string, v double")
    assert groups.concentration(groups.group_stats(df, ["v"], ["cat"])).count() == 0
    df = frame(spark, [("a", 0.0), ("b", 4.0)], "cat string, v double")
    assert groups.key_growth(groups.group_stats(df, ["v"], ["cat"])).first()["percent_growth"] == 0.0


def test_all_null_group_is_not_an_extreme(spark):
    df = frame(spark, [("a", None), ("b", 2.0), ("c", 3.0), (None, 99.0)], "cat string, v double")
    seg = groups.segments(groups.group_stats(df, ["v"], ["cat"])).first()
    assert (seg["best"], seg["worst"]) == ("c", "b")


def test_directions(spark):
    df = frame(spark, [("a", 1.0), ("b", 2.0)], "cat string, v double")
    stats = groups.group_stats(df, ["v"], ["cat"])
    assert groups.performers(stats).first()["best"] == "a"
    assert groups.performers(stats, {"v": "higher_is_better"}).first()["best"] == "b"


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_first_half_has_the_smaller_part(spark, n):
    df = frame(spark, [(i, "2024-01-01" if i % 2 else None) for i in range(n)], "k int, d string")
    df = df.withColumn("d", F.try_to_timestamp("d"))
    rows = df.select("k", "d", order.first_half(df, ["k"], "d").alias("early")).collect()
    expected = sorted(rows, key=lambda r: (r["d"] is None, r["k"]))[: n // 2]
    assert {r["k"] for r in rows if r["early"]} == {r["k"] for r in expected}


def test_first_half_of_one_hot_date(spark):
    df = spark.range(1001).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 7 == 0, F.timestamp_micros(F.lit(10) + F.col("id"))).otherwise(
            F.timestamp_micros(F.lit(500).cast("bigint"))
        ).alias("d"),
    )
    rows = df.select("k", "d", order.first_half(df, ["k"], "d").alias("early")).collect()
    expected = sorted(rows, key=lambda r: (r["d"], r["k"]))[:500]
    assert {r["k"] for r in rows if r["early"]} == {r["k"] for r in expected}


def test_missing_date_is_left_out(spark):
    rows = [(1, "2024-01-01", 1.0), (2, None, 50.0), (3, "2024-01-03", 3.0), (4, "Unknown", 70.0)]
    df = frame(spark, rows, "k int, date string, v double")
    assert findings.trend(df, ["v"], "date", ["k"]).first()["value"] == 2.0
    assert findings.period_growth(df, ["v"], "date", "day").count() == 2
    assert charts.line(df, "date", "v").count() == 2
    kpi = charts.kpis(df, ["v"], ["k"], "date").first()
    assert kpi["delta"] == round((60.0 - 2.0) / 2.0 * 100, 2)
    with pytest.raises(Exception, match="Unknown"):
        findings.trend(df, ["v"], "date", ["k"], strict=True).collect()


def test_impute(spark):
    rows = [(1, "a", 1.0, "2024-01-01"), (None, None, None, None), (3, "b", 3.0, "2024-01-02"), (4, "b", 100.0, None)]
    out = profile.impute(frame(spark, rows, "i int, s string, v double, date string"))
    filled = out.where("s = 'Unknown'").first()
    assert filled["i"] == pytest.approx(8 / 3) and filled["v"] == 3.0 and filled["date"] is None
    whole = profile.impute(frame(spark, [(1, "a")], "i int, s string"))
    assert dict(whole.dtypes) == {"i": "int", "s": "string"}


def test_column_choices(spark):
    df = frame(spark, [], "id int, order_date string, amount double, Year_no int, area string, flag boolean, d decimal(9,2)")
    assert cols.date_column(df) == "order_date"
    assert cols.candidate_metrics(df) == ["id", "amount", "d"]
    assert cols.category_columns(df) == ["area"]
    assert cols.numeric_columns(df) == ["id", "amount", "Year_no", "d"]
    with pytest.raises(ValueError, match="not in table"):
        cols.require_columns(df, ["nope"])
    with pytest.raises(ValueError, match="not numeric"):
        cols.require_columns(df, ["area"], numeric=True)


def test_text_only_table_is_described_as_text(spark):
    out = profile.describe(frame(spark, [("b",), ("a",), (None,), ("b",)], "s string")).first()
    assert out.asDict() == {"column": "s", "count": 3, "unique": 2, "top": "b", "freq": 2}
    assert profile.column_types(frame(spark, [], "a int, b string")).collect()[1]["dtype"] == "string"


def test_number_positions(spark):
    df = frame(spark, [(1, "Amount has 4,076 outliers; mean 12.5 and top 5.")], "k int, t string")
    rows = tx.number_mentions(df, "k", "t").orderBy("pos").collect()
    assert [(r["number"], r["pos"]) for r in rows] == [("4076", 11), ("12.5", 32), ("5.", 45)]
    assert rows[0]["context"] == "amount has 4,076 outliers; mean 12.5 and top 5"


def test_number_mentions_match_a_plain_scan(spark):
    import re

    texts = ["", "none", "1", "a1b22c3,3.5.7 " * 9, "é 5 ß 66,000.25\n7", "9" * 80 + " 1." + "x" * 40 + "2", None]
    df = frame(spark, list(enumerate(texts)), "k int, t string")
    expected = sorted(
        (k, m.group().replace(",", ""), m.start(), t[max(0, m.start() - 30) : m.end() + 30].lower())
        for k, t in enumerate(texts)
        if t
        for m in re.finditer(r"[0-9][0-9,]*\.?[0-9]*", t)
    )
    assert sorted(tuple(r) for r in tx.number_mentions(df, "k", "t").collect()) == expected


def test_invented_numbers_rules(spark):
    truth = tx.ground_truth_numbers(frame(spark, [("0.25 and 150 and 12",)], "t string"), "t")
    forms = {r["number"] for r in truth.collect()}
    assert {"0.25", "25", "25.0", "150", "1.5", "12", "0.12"} <= forms
    texts = [
        (1, "the share is 25 of all, and 777 goes wrong"),
        (2, "page 777 only"),
        (3, "it rose to 777 units"),
        (4, "the average of 777 is fine"),
        (5, "no numbers"),
        (6, "step 7 is small, but far away there is a value of size 778 apples"),
        (7, "x 31 y 32 z 33 u 34 v 35 w 36 q"),
    ]
    df = frame(spark, texts, "k int, t string")
    got = as_dict(tx.invented_numbers(df, "k", "t", truth), "k")
    assert {k: r["invention_count"] for k, r in got.items()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1, 7: 6}
    assert not got[7]["pass"] and got[1]["pass"]


def test_clean_text(spark):
    df = frame(spark, [("a b c‑d–e—f",)], "t string")
    assert df.select(tx.clean_text(F.col("t"))).first()[0] == "a b c-d-e--f"


def test_json_payload(spark):
    texts = [
        '```json\n{"a": 1}\n```', 'Here it is: {"a": [1, 2]} bye', "nothing", None, "{broken [1] x",
        '{"a": "x\\\\ny", "b": "p\\\\\\\\q"}', '[{"a": 1}]', 'so {not} this {"b": "\\\\t"}',
    ]
    df = frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["j"] for r in df.select("i", tx.json_payload(F.col("t")).alias("j")).collect()}
    assert got == {
        0: '{"a": 1}', 1: '{"a": [1, 2]}', 2: None, 3: None, 4: "[1]",
        5: '{"a": "x\\ny", "b": "p\\\\\\\\q"}', 6: '[{"a": 1}]', 7: '{"b": "\\t"}',
    }


def test_sections(spark):
    full = "# Executive Summary\n# Critical Issues\n# Root Cause\n# Recommended Actions\n# Data Gaps\n"
    df = frame(spark, [(1, full + "x" * 1500), (2, "## action\n" * 6), (3, "")], "run_id int, report string")
    got = as_dict(checks.report_check(df), "run_id")
    assert got[1]["has_all_sections"] and got[1]["length_ok"] and got[1]["action_count"] == 1
    assert got[2]["action_count"] == 6 and not got[2]["actions_under_5"] and len(got[2]["missing_sections"]) == 5
    assert not got[3]["length_ok"]


def test_percent_sum_and_words(spark):
    df = frame(spark, [("a 10% b 20 % c 30% d 50% e 99%",), ("",), ("  two\n words ",)], "t string")
    got = [tuple(r) for r in df.select(tx.percent_sum(F.col("t")), tx.word_count(F.col("t"))).collect()]
    assert got == [(90, 11), (0, 0), (0, 2)]


def test_chart_spec_reasons(spark):
    table = frame(spark, [], "region string, product string, amount double")
    specs = [
        ("bar", "region", "amount", None, None, None),
        (None, "region", "amount", None, None, "missing chart_type"),
        ("bar", '["region"]', "amount", None, None, "x is a list"),
        ("correlation_heatmap", '["amount"]', None, None, None, None),
        ("correlation_heatmap", '["amount","gone"]', None, None, None, "x is not a column"),
        ("bar", "region", '["amount"]', None, None, "y is a list"),
        ("bar", None, "amount", None, None, "x is missing"),
        ("bar", "region", None, None, None, "y is missing"),
        ("histogram", "amount", None, None, None, None),
        ("histogram", "region", None, None, None, "x is not numeric"),
        ("bar", "region", "product", None, None, "y is not numeric"),
        ("pivot_heatmap", "region", "product", "gone", None, "z is not a column"),
    ]
    df = frame(spark, specs, "chart_type string, x string, y string, z string, color string, expected string")
    for r in charts.valid_charts(df, table).collect():
        assert r["reason"] == r["expected"] and r["valid"] == (r["expected"] is None)


def test_chart_check(spark):
    specs = [
        (1, 0, "stacked_bar", "a", "m", None, "a"),
        (1, 1, "bar", "a", "m", None, None),
        (1, 2, "pivot_heatmap", "a", "b", None, None),
        (1, 3, "line", None, "b", None, None),
        (2, 0, "bar", "a", "m", None, None),
        (2, 1, "bar", "b", "m", None, None),
        (3, 0, "histogram", None, None, None, None),
        (3, 1, "correlation_heatmap", None, None, None, None),
    ]
    df = frame(spark, specs, "run_id int, pos int, chart_type string, x string, y string, z string, color string")
    got = as_dict(checks.chart_check(df), "run_id")
    assert [got[i]["violation_count"] for i in (1, 2, 3)] == [4, 0, 1]
    repeated = checks.repeated_pairs(df, "pos").where("repeated").collect()
    assert sorted((r["run_id"], r["pos"]) for r in repeated) == [(1, 1), (3, 1)]


def test_causal_check(spark):
    kind = (
        "run_id int, connections array<struct<issue:string,internal_evidence:string,causal_mechanism:string,"
        "verdict:string,variance_decomposition:string>>"
    )
    good = ("i", "e", "m", "supported", "{'primary': '60% x', 'secondary': '30%', 'rest': '10%', 'more': '77%'}")
    bad = ("i", None, "", "maybe", None)
    got = as_dict(checks.causal_check(frame(spark, [(1, [good]), (2, [good, bad]), (3, []), (4, None)], kind)), "run_id")
    assert got[1]["pass"] and got[1]["issue_count"] == 0
    assert got[2]["issue_count"] == 4 and got[2]["connection_count"] == 2
    assert not got[3]["pass"] and not got[4]["pass"] and got[4]["connection_count"] == 0


def test_scorecard_rounds_per_node(spark):
    flags = frame(spark, [(1, True, False, 0.5), (2, True, True, 0.1)], "run_id int, a boolean, b boolean, total double")
    none = frame(spark, [(1, 3.0)], "run_id int, total double")
    got = {
        (r["run_id"], r["node"]): r["node_score"]
        for r in checks.scorecard([checks.node_scores(flags, "x"), checks.node_scores(none, "y")]).collect()
    }
    assert got == {(1, "x"): 50, (1, "y"): 0, (1, "overall"): 50, (2, "x"): 100, (2, "overall"): 100}


def test_tokens(spark):
    people = frame(spark, [(1, "Ann"), (2, "Bob"), (3, None), (4, "Ann")], "k int, name string")
    hidden = privacy.tokenise(people, ["name"], "s")
    values = {r["k"]: r["name"] for r in hidden.collect()}
    assert values[1] == values[4] != values[2] and values[3] is None and values[1].startswith("ID-")
    tokens = privacy.token_map(people, ["name"], "s")
    assert tokens.count() == 2 and "Ann" not in str(tokens.collect())
    assert tokens.collect() == privacy.token_map(people, ["name"], "s").collect()
    back = privacy.detokenise(hidden, "name", tokens, "s")
    assert {r["k"]: r["name"] for r in back.collect()} == {1: "Ann", 2: "Bob", 3: None, 4: "Ann"}
    wrong = privacy.detokenise(hidden, "name", tokens, "other")
    assert {r["k"]: r["name"] for r in wrong.collect()} == values
    assert privacy.tokenise(people, [], "s").collect() == people.collect()
    assert privacy.token_map(people, [], "s").count() == 0


def test_tokens_in_text(spark):
    people = frame(spark, [("Ann",), ("Bob",)], "name string")
    tokens = privacy.token_map(people, ["name"], "s")
    a, b = (r["t"] for r in privacy.tokenise(people, ["name"], "s").withColumnRenamed("name", "t").collect())
    texts = [(1, f"{a}{b} and {a}"), (2, "none"), (3, f"x {a}"), (4, "ID-0000000000000000 stays"), (5, None), (6, "")]
    df = frame(spark, texts, "k int, t string")
    got = {r["k"]: r["t"] for r in privacy.detokenise_text(df, "k", "t", tokens, "s").collect()}
    assert got == {1: "AnnBob and Ann", 2: "none", 3: "x Ann", 4: "ID-0000000000000000 stays", 5: None, 6: ""}


def test_leaks(spark):
    people = frame(spark, [("Ann", "x"), ("Bob", "y")], "name string, other string")
    hidden = privacy.tokenise(people, ["name"], "s")
    row = privacy.leak_check(people, hidden, ["name"]).first()
    assert row["pass"] and row["collisions"] == 0
    row = privacy.leak_check(people, people, ["name"]).first()
    assert (row["leaked_values"], row["untokenised_values"], row["pass"]) == (2, 2, False)
    assert privacy.leak_check(people, hidden.drop("name"), ["name"]).first()["missing"]
    merged = people.withColumn("name", F.lit("ID-1"))
    assert privacy.leak_check(people, merged, ["name"]).first()["collisions"] == 1


def test_sensitive_columns(spark):
    rows = [("a@b.example", "+49 123-456-7890", "Employee#000001", "x"), ("c@d.example", "(020) 555 1234", "E-99999", "y")]
    df = frame(spark, rows, "contact string, reach string, ref string, customer_name string")
    got = as_dict(privacy.sensitive_columns(df), "column")
    assert got["contact"]["email_share"] == 1.0 and got["contact"]["is_sensitive"]
    assert got["reach"]["phone_share"] == 1.0 and got["ref"]["id_share"] == 1.0
    assert got["customer_name"]["name_match"]


def test_confidence_caps(spark):
    shares = frame(spark, [("area", "v", "x", 90.0, True)], "category string, metric string, top_contributor string, contribution_pct double, is_concentrated boolean")
    nulls = frame(spark, [("v", 0, 25.0), ("w", 0, 0.0)], "column string, null_count int, null_percent double")
    odd = frame(spark, [("v", 3, 9.0)], "column string, counts int, max_zscore double")
    got = as_dict(findings.confidence_caps(["v", "w"], shares, nulls, odd, ["area"]), "metric")
    assert got["v"]["cap"] == "MEDIUM" and len(got["v"]["reasons"]) == 3 and got["w"]["cap"] is None


def test_kpi_text_and_limits(spark):
    df = frame(spark, [(i, 1000.0 + i, 2.0) for i in range(4)], "k int, big_sum double, small double")
    rows = charts.kpis(df, ["big_sum", "missing", "small"], ["k"]).collect()
    assert [r["label"] for r in rows] == ["Big Sum", "Small"]
    assert rows[0]["value_str"] == "1.00K" and math.isclose(rows[0]["delta"], 0.2) and rows[1]["is_good"]


def test_pivot_looks_up_its_columns(spark):
    df = frame(spark, [("a", "x", 1.0), ("a", "y", None), ("b", "x", 3.0)], "r string, c string, v double")
    for columns in (["x"], None):
        assert {r["x"]: r[1] for r in charts.pivot_heatmap(df, "r", "c", "v", columns).toDF("x", "v").collect()} == {"a": 1.0, "b": 3.0}


def test_nothing_is_cut_without_a_limit(spark):
    names = [f"amount_{i}" for i in range(35)]
    df = spark.range(6).select(F.col("id").alias("k"), *[(F.col("id") * i).cast("double").alias(n) for i, n in enumerate(names)])
    assert cols.candidate_metrics(df) == ["k", *names]
    assert len(charts.kpis(df, names, ["k"]).collect()) == 35 and len(charts.kpis(df, names, ["k"], limit=2).collect()) == 2
    assert findings.distribution(df, names).count() == 35


def test_decimals_are_metrics_and_no_metric_is_no_row(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "s string, date string").withColumn("price", F.lit("1.50").cast("decimal(18,2)"))
    assert cols.candidate_metrics(df) == ["price"]
    none = df.drop("price")
    assert findings.metric_stats(none) == {} and findings.outliers(none).count() == 0
    assert findings.trend(none, None, "date", ["s"]).count() == 0 and findings.period_growth(none, None, "date").count() == 0
    with pytest.raises(ValueError, match="keys"):
        findings.trend(df, ["price"], "date")


def test_quantiles_survive_a_wrong_sketch(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    wrong = lambda c, probs: F.array(*[F.lit(e) for _ in probs for e in (800.0, 810.0)])
    monkeypatch.setattr(quantiles, "sketch", wrong)
    assert quantiles.exact_quantiles(df, ["v"], [0.25, 0.5], bracket_rows=10) == {"v": [249.75, 499.5]}


def test_lookup_of_a_hot_key(spark):
    big = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("key")
    )
    small = spark.createDataFrame([("hot", 1), ("1", 2)], "key string, v int")
    rows = {r["id"]: r["v"] for r in lookup.lookup_join(big, small, "key").collect()}
    assert len(rows) == 3000 and rows[0] == 1 and rows[1] == 2 and rows[2] is None and rows[4] is None


def test_json_in_hostile_texts(spark):
    texts = ["[" * 200_000, "[ " * 5000 + '{"a": 1}', "{" * 50 + '"a"', 'x [1, [2, {"b": [3]}]] y', "[[[1,2]", "no brackets"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["j"] for r in df.select("i", tx.json_payload(F.col("t")).alias("j")).collect()}
    assert got == {0: None, 1: '{"a": 1}', 2: None, 3: '[1, [2, {"b": [3]}]]', 4: "[1,2]", 5: None}


def test_keys_become_text_at_every_depth(spark):
    df = spark.range(1).selectExpr("map(1, array(map(2, struct(map(true, 3) as m, 4 as n)))) AS c")
    kind = df.select(tx.text_keys(F.col("c"), df.schema["c"].dataType).alias("c")).schema["c"].dataType
    assert kind.simpleString() == "map<string,array<map<string,struct<m:map<string,int>,n:int>>>>"


def test_products_are_no_personal_data(spark):
    df = spark.createDataFrame([("SKU-12345", "bolt", "Ann B", "Customer#00001", "widget")], "code string, p_name string, full_name string, buyer string, product_name string")
    got = {r["column"]: r["is_sensitive"] for r in privacy.sensitive_columns(df).collect()}
    assert got == {"code": False, "p_name": False, "full_name": True, "buyer": True, "product_name": False}


def test_long_texts_are_counted_by_digest(spark):
    long = "a" * 500
    df = frame(spark, [(long + "1",), (long + "2",), (long + "1",), ("9" * 200,), (None,)], "t string")
    got = profile.column_profile(df).first()
    assert (got["cardinality"], got["null_count"]) == (3, 1)
    assert profile.column_roles(frame(spark, [("9" * 200,), ("8" * 100,)], "t string")).first()["role"] == "numeric"


def test_many_metrics_are_grouped_in_several_jobs(spark):
    df = spark.range(50).select((F.col("id") % 2).cast("string").alias("cat"), *[(F.col("id") * i).cast("double").alias(f"m{i:02d}") for i in range(1, 20)])
    stats = groups.group_stats(df, [f"m{i:02d}" for i in range(1, 20)], ["cat"])
    got = {(r["metric"], r["key"]): r["total"] for r in stats.collect()}
    assert len(got) == 38 and got[("m19", "0")] == 19.0 * 600
    assert len(findings.metric_stats(df)) == 19 and profile.numeric_summary(df).count() == 19


def test_types_change_only_where_every_value_fits(spark):
    rows = [("12", "5 days", "01/31/2024", "8:30", "2024-01-01"), ("7", "2024-01-01", "02/01/2024", "9:10", None)]
    df = frame(spark, rows, "lead_time string, updated_at string, created_at string, open_time string, date string")
    out = profile.normalise_types(df)
    assert dict(out.dtypes) == {"lead_time": "bigint", "updated_at": "string", "created_at": "timestamp", "open_time": "string", "date": "timestamp"}
    got = out.orderBy("lead_time").collect()
    assert [r.updated_at for r in got] == ["2024-01-01", "5 days"] and got[1].created_at.month == 1 and got[0].date is None


def test_dates_are_read_in_their_own_format(spark):
    iso = frame(spark, [(i, f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", float(i * i)) for i in range(60)], "k int, date string, v double")
    other = iso.withColumn("date", F.date_format(F.to_date("date"), "MM/dd/yyyy"))
    for of in (lambda d: findings.trend(d, ["v"], "date", ["k"]), lambda d: findings.period_growth(d, ["v"], "date"), lambda d: charts.kpis(d, ["v"], ["k"], "date")):
        assert sorted(map(str, of(iso).collect())) == sorted(map(str, of(other).collect()))
    with pytest.raises(ValueError, match="date"):
        findings.period_growth(iso.withColumn("date", F.lit("soon")), ["v"], "date")


def test_causal_records_may_hold_a_struct(spark):
    kind = (
        "run_id int, connections array<struct<issue:string,internal_evidence:string,causal_mechanism:string,"
        "verdict:string,variance_decomposition:struct<primary:string,secondary:string>>>"
    )
    rows = [(1, [("i", "e", "m", "supported", ("60% x", "35%"))]), (2, [("i", "e", "m", "supported", ("10%", None))])]
    got = as_dict(checks.causal_check(frame(spark, rows, kind)), "run_id")
    assert got[1]["pass"] and not got[2]["pass"]
