"""Queries against their SQL on tables with other keys than the small ones have."""

import importlib
import shutil
from pathlib import Path

from compare import connect, rows

SF = "/root/testdata/sf0.001"

for _name in ("batch", "cdc", "search", "sources", "streams"):
    importlib.import_module(f"millrace.plans.{_name}")
from millrace.plans.registry import ORACLE_SQL, QUERIES  # noqa: E402


def changed(folder, name: str, sql: str) -> str:
    """A folder with the small tables, of which one is what the SQL makes of it."""
    folder = str(folder / "tables")
    shutil.copytree(SF, folder, copy_function=shutil.copyfile)
    Path(folder).chmod(0o755)
    Path(f"{folder}/{name}.parquet").unlink()
    connect(SF).execute(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
    return folder


def same(spark, folder: str, name: str) -> None:
    ours, theirs = QUERIES[name](spark, folder).toArrow(), connect(folder).execute(ORACLE_SQL[name]).to_arrow_table()
    assert rows(ours) == rows(theirs) and ours.num_rows


def test_scalars_of_large_keys(spark, tmp_path):
    folder = changed(tmp_path, "orders", "SELECT * REPLACE (o_orderkey * 6001 AS o_orderkey) FROM orders")
    assert spark.read.parquet(f"{folder}/orders.parquet").selectExpr("max(o_orderkey)").first()[0] > 3_000_000  # a day of a year of five digits
    same(spark, folder, "scalar_suite")
