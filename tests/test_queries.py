"""Every registered query against its SQL on the smallest tables."""

import importlib

import pytest
from compare import connect, rows

SF = "/root/testdata/sf0.001"

for _name in ("batch", "cdc", "search", "sources", "streams"):
    importlib.import_module(f"millrace.plans.{_name}")
from millrace.plans.registry import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, SF).toArrow()
    if name not in ORACLE_SQL:
        assert ours.num_rows
        return
    theirs = duck.execute(ORACLE_SQL[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours) == rows(theirs)


def test_entry_lists_all_queries():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
