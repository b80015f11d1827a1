"""The driver contract."""

import os

import pytest

import __spark_entry__ as entry
from hypograph.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalogue.QUERIES) == sum(len(m.QUERIES) for m in catalogue._MODULES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not there")
@pytest.mark.parametrize("name", ["triple_frequency", "evaluation_set", "freq_second_derivative", "cosine_pairs"])
def test_queries_agree_with_their_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from check import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not there")
def test_no_nested_loops_or_products(spark):
    """No query of the library, as far as it is planned when it is built, compares all rows of two tables."""
    for name, query in catalogue.QUERIES.items():
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not there")
def test_plan_does_not_depend_on_the_number_of_files(spark, tmp_path):
    """The flagship plan has the same operators over one file and over many."""
    import re

    plans = []
    for files in (1, 12):
        for name in ("documents", "benchmark"):
            spark.read.parquet(f"{SF}/{name}.parquet").repartition(files).write.parquet(f"{tmp_path}/{files}/{name}.parquet")
        plan = catalogue.QUERIES["triple_frequency"](spark, f"{tmp_path}/{files}")._jdf.queryExecution().executedPlan().toString()
        plans.append(re.findall(r"[A-Z][A-Za-z]*(?:Exec|Join|Exchange|Aggregate|Scan|Generate|Python|Sort)\b", plan))
    assert plans[0] == plans[1] and plans[0]
