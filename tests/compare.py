"""Rows of two tables as comparable text, whatever their order."""

import datetime as dt
from decimal import Decimal

import duckdb
import pandas as pd
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(x) -> str:
    if x is None:
        return ""
    if isinstance(x, Decimal):
        return str(int(x)) if x == int(x) else cell(float(x))
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if isinstance(x, dt.datetime):
        return str(x.replace(tzinfo=None))
    if isinstance(x, list):
        return str([cell(y) for y in x])
    return str(x)


def rows(table: pa.Table | pd.DataFrame) -> list[tuple]:
    """Cells by the types of Arrow, so that a null doesn't turn a column of whole numbers into another kind."""
    if isinstance(table, pd.DataFrame):
        table = pa.Table.from_pandas(table, preserve_index=False)
    columns = [[cell(x) for x in table.column(c).to_pylist()] for c in sorted(table.column_names)]
    return sorted(zip(*columns, strict=True)) if table.num_rows else []
