"""Joins and aggregates where the shared tables have no case of: parts of one key, and what a task of positions holds."""

import re

import duckdb
import pandas as pd

from tidemark.operators import relational
from tidemark.registry import ORACLE_SQL


def _written(path):
    t = pd.Timestamp("2024-02-03")
    lineitem = [(1, 10, 2.0, 10.5, t), (1, 10, 3.0, 1.25, t + pd.Timedelta(days=200)), (1, 11, 1.0, 2.0, t), (2, 10, 4.0, 3.0, t), (2, None, 5.0, 7.0, t), (None, 12, 1.0, None, t)]
    part = [(10, "a", 20), (10, "a", 21), (10, "b", 22), (10, "c", 1), (11, None, 30), (11, "cusip 11", 30), (None, "z", 40)]
    pd.DataFrame(lineitem, columns=["l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]).astype({"l_suppkey": "Int64", "l_partkey": "Int64", "l_shipdate": "datetime64[us]"}).to_parquet(path / "lineitem.parquet")
    pd.DataFrame(part, columns=["p_partkey", "p_name", "p_size"]).astype({"p_partkey": "Int64"}).to_parquet(path / "part.parquet")


def test_symbols_of_parts_of_one_key(spark, tmp_path):
    """A part that is there twice counts twice, one of two names gives two rows, a name may be that of a part without."""
    _written(tmp_path)
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.sql(f"SELECT fund, cusip, symbol, value FROM ({ORACLE_SQL['j15_symbol_resolution']})").fetchall()
    got = relational.j15_symbol_resolution(spark, str(tmp_path)).select("fund", "cusip", "symbol", "value").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_positions_are_summed_after_the_shuffle(spark, sf_dir):
    """No task sums what it reads of the table, and tasks of sums keep their number: each holds its share of the positions."""
    for df in (relational.j15_symbol_resolution(spark, sf_dir), relational.holdings(spark, sf_dir)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(fund" in x]
        assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]
        assert not re.search(r"HashAggregate\(keys=\[fund", plan[plan.index(dealt[0]) :])
