"""Compare a query with its SQL in DuckDB on the smallest tables."""

from pathlib import Path

DATA = Path("/root/testdata/sf0.001")


def rows(frame):
    import pandas as pd

    columns = sorted(frame.columns)
    clean = lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return columns, sorted((tuple(map(clean, r)) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


def check(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    assert rows(query(spark, str(DATA)).toPandas()) == rows(con.sql(sql).df())
