"""A query's rows against its oracle's, as multisets."""

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    cell = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) or hasattr(x, "item") else x
    return sorted(repr(tuple(cell(x) for x in r)) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark, sf_dir: str, query, sql: str) -> None:
    mine, theirs = query(spark, sf_dir).toPandas(), duck(sf_dir).sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
