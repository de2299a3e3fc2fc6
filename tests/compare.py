"""Compare a Spark result with its SQL result in DuckDB: names, types, rows in any order."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB",
}


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def _sorted_rows(names, rows):
    places = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in places) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    ran = con.execute(sql)
    sql_names = [d[0] for d in ran.description]
    sql_types = {d[0]: str(d[1]) for d in ran.description}
    sql_rows = ran.fetchall()
    rows = spark_df.collect()
    names = spark_df.columns
    out = []
    if sorted(names) != sorted(sql_names):
        return [f"columns {sorted(names)} != {sorted(sql_names)}"]
    for n, k in spark_df.dtypes:
        if TYPES.get(k, k) != sql_types[n]:
            out.append(f"type of {n}: {k} != {sql_types[n]}")
    a, b = _sorted_rows(names, rows), _sorted_rows(sql_names, sql_rows)
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    left, right = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    if left or right:
        out.append(f"{len(left)} rows only in spark, {len(right)} only in sql; {sorted(names)}")
        out += [f"  spark {r}"[:600] for r in left[:3]] + [f"  sql   {r}"[:600] for r in right[:3]]
    if not a:
        out.append("both empty" if not b else "spark empty")
    return out
