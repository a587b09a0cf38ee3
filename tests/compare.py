"""Run registered queries against their SQL equivalents.

    python -m tests.compare sf0.01 [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def sql_engine(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v.date()) if hasattr(v, "date") else v)
        df[c] = df[c].map(lambda v: "<null>" if v is None else repr(float(v)) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"{len(spark_df)} and {len(sql_df)} rows"
    a, b = normal(spark_df), normal(sql_df)
    rows = (a != b).any(axis=1)
    if rows.any():
        return f"{rows.sum()} rows differ, first:\n{a[rows].head(3).to_dict('records')}\n{b[rows].head(3).to_dict('records')}"
    return ""


def main() -> None:
    from mentionmill.session import build_session
    from suite.oracles import ORACLES
    from suite.queries import QUERIES

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = sql_engine(sf_dir)
    bad = 0
    for name in sys.argv[2:] or [n for n in QUERIES if n in ORACLES]:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            middle = time.time()
            text = difference(got, con.execute(ORACLES[name]).df())
        except Exception as e:  # report and go on
            text, got, middle = f"failed: {str(e)[:900]}", [], time.time()
        bad += bool(text)
        print(f"{name:45s} {len(got):8d} spark {middle - start:6.2f} sql {time.time() - middle:6.2f} {text or 'ok'}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
