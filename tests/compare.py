"""Runs queries beside their SQL, as the driver does: columns by name, rows in any order, values equal."""

import glob
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(path := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return repr(x)


def difference(spark_df, con, sql):
    """None if equal, else what differs."""
    names = sorted(spark_df.columns)
    ours = [tuple(map(cell, r)) for r in spark_df.select(*[f"`{n}`" for n in names]).collect()]
    got = con.execute(sql)
    theirs_names = [d[0] for d in got.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    order = [theirs_names.index(n) for n in names]
    theirs = [tuple(cell(r[i]) for i in order) for r in got.fetchall()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    a, b = sorted(ours), sorted(theirs)
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(off)} of {len(a)} rows, such as {off[:2]}" if off else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connection(sf_dir), entry.queries(), entry.oracle_sql()
    for name in names or sorted(oracles):
        began = time.time()
        try:
            found = difference(queries[name](spark, sf_dir), con, oracles[name])
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - began:.1f} s{'' if found is None else ' ' + found}", flush=True)
