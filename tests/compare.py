"""Run registered queries against their SQL twins: ``python tests/compare.py [sf] [name ...]``."""
from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, name, fn, sql):
    import duckdb
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return len(got), None, []
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    exp = res.fetchall()
    problems = []
    if sorted(cols) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(cols)}")
        return len(got), len(exp), problems
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck = {c[0]: str(c[1]).lower() for c in res.description}
    alike = {"string": "varchar", "bigint": "bigint", "int": "integer", "double": "double", "boolean": "boolean"}
    for c, t in types.items():
        if alike.get(t, t) != duck[c]:
            problems.append(f"type {c}: {t} vs {duck[c]}")
    a, b = rows_of(df.columns, got), rows_of(cols, exp)
    if a != b:
        sa, sb = set(a), set(b)
        problems.append(f"only spark {len(sa - sb)}: {sorted(sa - sb, key=repr)[:2]}")
        problems.append(f"only sql {len(sb - sa)}: {sorted(sb - sa, key=repr)[:2]}")
    return len(got), len(exp), problems


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    oracles = oracle_sql()
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            n, m, problems = compare(spark, sf, name, fn, oracles.get(name))
            state = "rows-only" if m is None else ("ok" if not problems else "DIFF")
            print(f"{state:9} {name:24} {n:7} {'' if m is None else m:>7} {time.time() - start:6.1f}s", flush=True)
            for p in problems:
                print("    " + p[:600], flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"ERROR     {name:24} {time.time() - start:6.1f}s {type(e).__name__} {str(e)[:500]}", flush=True)


if __name__ == "__main__":
    main()
