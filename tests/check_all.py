"""Run every registered query beside its SQL. Usage: python tests/check_all.py <folder> [name ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

from compare import differences, duck  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

if __name__ == "__main__":
    folder, chosen = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(folder), 0
    con.execute("SET TimeZone = 'UTC'")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in chosen or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            found = differences(df, con, sqls[name]) if name in sqls else [f"rows only: {df.count()}"]
        except Exception as e:  # report and go on with the next query
            found = [f"{type(e).__name__}: {str(e)[:1500]}", traceback.format_exc()[-300:]]
        bad += bool(found) and name in sqls
        print(f"{'ok ' if not found else 'BAD' if name in sqls else '-  '} {name} {time.time() - start:.2f}s", flush=True)
        for line in found:
            print("     ", line, flush=True)
    print("unregistered SQL:", sorted(set(sqls) - set(queries)), "bad:", bad)
