"""Compare a registered query with its SQL statement, the way a strict reader would: names, types, rows, values."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, dict):
        return tuple(sorted((k, _value(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _value(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    return v


def _kind(name: str) -> str:
    return {
        "bigint": "bigint", "int": "integer", "integer": "integer", "double": "double", "string": "varchar",
        "varchar": "varchar", "date": "date", "boolean": "boolean",
    }.get(name.lower(), name.lower())


def compare(df, sql: str, con) -> list[str]:
    problems = []
    columns = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return [f"columns {columns} != {sorted(names)}"]
    kinds = {n: _kind(t) for n, t in df.dtypes}
    duck_kinds = {r[0]: _kind(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    for n in columns:
        if "<" not in kinds[n] and kinds[n] != duck_kinds[n]:
            problems.append(f"type of {n}: {kinds[n]} != {duck_kinds[n]}")
    cur = con.execute(sql)
    want = [tuple(_value(r[names.index(n)]) for n in columns) for r in cur.fetchall()]
    got = [tuple(_value(r[n]) for n in columns) for r in df.collect()]
    if len(want) != len(got):
        problems.append(f"rows {len(got)} != {len(want)}")
    order = lambda r: tuple(repr(x) for x in r)
    want.sort(key=order), got.sort(key=order)
    if want != got:
        extra = sorted(set(map(repr, got)) - set(map(repr, want)))
        missing = sorted(set(map(repr, want)) - set(map(repr, got)))
        problems.append(f"{len(extra)} rows differ {columns}: spark {extra[:2]} sql {missing[:2]}")
    if not want:
        problems.append("empty result")
    return problems


if __name__ == "__main__":
    import sys

    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from pyspark.sql import SparkSession
    from tractloom.catalog import load

    directory = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(directory)
    registry = load()
    wanted = sys.argv[2:]
    bad = 0
    for name, q in registry.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = q.build(spark, directory)
            t1 = time.time()
            if q.sql:
                problems = compare(df, q.sql, con)
            else:
                n = len(df.collect())
                problems = [] if n else ["empty result"]
        except Exception as e:  # report and go on with the next query
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {name} {time.time() - t:.1f}s {'sql' if q.sql else 'rows'}", *problems, sep="\n     " if problems else " ", flush=True)
    print("bad:", bad)
