"""Run registered queries against their SQL twins: python tests/compare.py SF_DIR [names...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty where both sides agree, else what differs."""
    got = canonical(query(spark, sf_dir).toPandas())
    want = canonical(con.execute(sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for c in got.columns:
        a, b = got[c], want[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = int((~same).idxmax())
            return f"column {c}: {int((~same).sum())} of {len(got)} differ, first {a[i]!r} != {b[i]!r}"
        if str(a.dtype) != str(b.dtype):
            print(f"   note {c}: {a.dtype} / {b.dtype}")
    return ""


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            verdict = difference(spark, con, query, sql, sf_dir) if sql else f"rows only {query(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:400]}"
        bad += bool(verdict) and bool(sql)
        print(f"{name:28s} {verdict or 'ok'} {time.time() - started:.1f}s", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
