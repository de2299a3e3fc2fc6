"""Files in, findings out, landing folder."""

import uuid

import pytest
from pyspark.sql import functions as F

from tablescope.operators import groups
from tablescope.plans import scratch
from tablescope.plans.analysis import analyse, summary, to_json_rows
from tablescope.sources import readers, stores
from tablescope.streaming.landing import profile_landing


def test_utf8_and_latin1_files(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("a,b\n1,é\n".encode())
    (tmp_path / "l.csv").write_bytes("a,b\n1,é\n".encode("latin-1"))
    for name, encoding in (("u.csv", "UTF-8"), ("l.csv", "ISO-8859-1")):
        path = str(tmp_path / name)
        assert readers.file_encoding(spark, path) == encoding
        row = readers.read_csv(spark, path).first()
        assert (row["a"], row["b"]) == (1, "é")
    typed = readers.read_csv(spark, str(tmp_path / "u.csv"), schema="a bigint, b string")
    assert dict(typed.dtypes) == {"a": "bigint", "b": "string"}


def test_quotes_line_ends_and_missing_words(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b,c\n1,"x ""quoted"", y",2.5\nNA,"two\nlines",null\n3,plain,7\n')
    df = readers.read_csv(spark, str(tmp_path / "q.csv"))
    assert dict(df.dtypes) == {"a": "int", "b": "string", "c": "double"}
    assert [tuple(r) for r in df.collect()] == [(1, 'x "quoted", y', 2.5), (None, "two\nlines", None), (3, "plain", 7.0)]
    (tmp_path / "bad.csv").write_text("a,b\n1,x\n2,y,z\nq,w\n")
    assert readers.malformed_records(spark, str(tmp_path / "bad.csv"), "a int, b string") == 2


def test_a_folder_of_both_encodings(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "u 1.csv").write_bytes("a,b\n1,é\n".encode())
    (tmp_path / "m" / "l.csv").write_bytes("a,b\n2,ü\n".encode("latin-1"))
    got = {r.a: r.b for r in readers.read_csv(spark, str(tmp_path / "m")).collect()}
    assert got == {1: "é", 2: "ü"}


def test_parquet_nan_is_null(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1.0,), (float("nan"),)], "v double").write.parquet(path)
    assert readers.read_parquet(spark, path).where("v is null").count() == 1


def test_search_results(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"query":"q1","response":{"results":[{"content":"a","url":"u"},{"content":"b"}]}}\n{"query":"q2","response":{"results":[]}}\n'
    )
    got = {r["query"]: r["content"] for r in readers.read_search_results(spark, str(tmp_path / "r.json")).collect()}
    assert got == {"q1": ["a", "b"], "q2": []}


def test_findings_are_kept_per_run(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01", "a", 1.0), (2, "2024-01-02", "b", 9.0)], "k int, date string, cat string, v double")
    found = analyse(df, ["k"], ["v"], direction={"v": "higher_is_better"}, store=True)
    assert set(found) == {
        "date_evidence", "outliers", "correlations", "distribution", "trend", "period_growth", "segments", "performers",
        "concentration", "pareto_critical", "key_growth",
    }
    assert [tuple(r)[:4] for r in found["date_evidence"].collect()] == [("y-m-d", "ymd", 2, 2)]
    folder = str(tmp_path / "runs")
    for run in ("r1", "r2", "r2"):
        stores.save_findings({"concentration": found["concentration"], "segments": found["segments"]}, folder, run)
    assert stores.load_findings(spark, folder, "concentration").count() == 2
    for run in ("7", "007"):
        stores.save_findings({"ids": spark.range(len(run))}, folder, run)
    assert {r["run_id"] for r in stores.load_findings(spark, folder, "ids").collect()} == {"7", "007"}
    assert stores.load_findings(spark, folder, "ids", "7").count() == 1
    one = stores.load_findings(spark, folder, "concentration", "r2").first()
    assert one["top_contributor"] == "b" and one["contribution_pct"] == 90.0
    whole = summary(found)
    assert whole.where("analysis = 'trend'").first()["value"] == 8.0
    assert to_json_rows({"concentration": found["concentration"]}).first()["record"].startswith('{"category":"cat"')


def test_charts_are_kept_one_table_each(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "x string, y double")
    stores.save_charts({"bar": df}, str(tmp_path), "json")
    assert spark.read.json(str(tmp_path / "bar")).count() == 2


class FakeSession:
    """Just the two places the folder is looked up in."""

    def __init__(self, configured, master, checkpoint=None):
        self.conf = self
        self.sparkContext = self
        self.configured, self.master, self.checkpoint = configured, master, checkpoint

    def get(self, name, default):
        return self.configured if name == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, folder):
        self.checkpoint = folder


def test_scratch_folder_is_the_configured_one():
    assert scratch.shared_folder(FakeSession("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    assert scratch.shared_folder(FakeSession(None, "yarn", "s3a://b/c")) == "s3a://b/c"
    assert scratch.shared_folder(FakeSession(None, "local[2]")).startswith("/tmp/run-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(FakeSession(None, "yarn"))


def test_scratch_table_is_written_below_it(spark):
    table = scratch.write_scratch(spark.range(5), "t")
    assert scratch.shared_folder(spark) in table.inputFiles()[0] and table.count() == 5


def test_landing_folder_takes_each_file_once(spark, tmp_path):
    landing, out, name = tmp_path / "in", str(tmp_path / "out"), uuid.uuid4().hex
    landing.mkdir()
    (landing / "1.csv").write_text("k,cat,v\n1,a,1.5\n2,b,2.5\n")

    def run():
        query = profile_landing(spark, str(landing), "k int, cat string, v double", out, name)
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    run()
    assert spark.read.parquet(f"{out}/rows").count() == 2
    (landing / "2.csv").write_text("k,cat,v\n3,a,7.5\n")
    run()
    assert spark.read.parquet(f"{out}/rows").count() == 3
    profiles = spark.read.parquet(f"{out}/column_profile").where("column = 'v'")
    assert {r["max"] for r in profiles.collect()} == {2.5, 7.5}
    assert spark.read.parquet(f"{out}/table_profile").agg(F.sum("rows")).first()[0] == 3


def test_group_statistics_keep_all_keys(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("name"), F.lit(1.0).alias("v"))
    assert groups.group_stats(df, ["v"], ["name"]).count() == 3000


def test_each_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "1.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "h" / "2.csv").write_text("b,a\nz,3\n")
    (tmp_path / "h" / "3.csv").write_bytes("b,a,c d\né,4,5.5\n".encode("latin-1"))
    path = str(tmp_path / "h")
    got = readers.read_csv(spark, path)
    assert dict(got.dtypes) == {"a": "int", "b": "string", "c d": "double"}
    assert sorted((r.a, r.b, r["c d"]) for r in got.collect()) == [(1, "x", None), (2, "y", None), (3, "z", None), (4, "é", 5.5)]
    (tmp_path / "h" / "3.csv").unlink()
    given = readers.read_csv(spark, path, schema="a bigint, b string")
    assert given.columns == ["a", "b"] and sorted(tuple(r) for r in given.collect()) == [(1, "x"), (2, "y"), (3, "z")]
    placed = readers.read_csv(spark, str(tmp_path / "h" / "1.csv"), schema="k bigint, v string")
    assert sorted(tuple(r) for r in placed.collect()) == [(1, "x"), (2, "y")]


def test_folder_columns_of_mixed_files(spark, tmp_path):
    for day, text in ((1, "a,b\n1,é\n".encode()), (2, "a,b\n2,ü\n".encode("latin-1"))):
        (tmp_path / "m" / f"day={day}").mkdir(parents=True)
        (tmp_path / "m" / f"day={day}" / "x.csv").write_bytes(text)
    for path in (str(tmp_path / "m"), str(tmp_path / "m") + "/*"):
        got = readers.read_csv(spark, path)
        assert sorted((r.a, r.b, r.day) for r in got.collect()) == [(1, "é", 1), (2, "ü", 2)]
    given = readers.read_csv(spark, str(tmp_path / "m"), schema="a bigint, b string")
    assert given.columns == ["a", "b", "day"]


def test_records_that_do_not_fit_are_counted(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.csv").write_text('a,b\n1,"two\nlines"\n2,y\n')
    (tmp_path / "r" / "2.csv").write_text("a,b\n1,x,9\n2\n3,z\n")
    got = {r.file[-5:]: (r.records, r.bad_records) for r in readers.file_records(spark, str(tmp_path / "r")).collect()}
    assert got == {"1.csv": (2, 0), "2.csv": (3, 2)}
    assert readers.malformed_records(spark, str(tmp_path / "r" / "1.csv"), "a int, b string") == 0
    assert readers.malformed_records(spark, str(tmp_path / "r"), "a int, b string") == 2
    assert readers.read_csv(spark, str(tmp_path / "r")).count() == 5


def test_broken_search_lines_are_counted(spark, tmp_path):
    good = '{"query": "q", "response": {"results": [{"content": "c", "score": 1}]}}'
    (tmp_path / "s.json").write_text(good + "\n{broken\n" + good.replace('"q"', '"r"') + "\n[1]\n")
    got = readers.read_search_results(spark, str(tmp_path / "s.json"))
    assert sorted((r.query, r.content) for r in got.collect()) == [("q", ["c"]), ("r", ["c"])]
    counted = readers.broken_lines(spark, str(tmp_path / "s.json")).first()
    assert (counted.lines, counted.broken) == (4, 2)
