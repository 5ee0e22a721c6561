"""Every registered query of the engine proper: against its SQL where it has one, else it must give rows."""

import pytest
from pyspark.sql import functions as F

from quillmask import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(name, spark, data, agree):
    agree(registry.QUERIES[name](spark, data), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows(name, spark, data):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_profile_of_lineitem_with_many_prices(spark, agree, tmp_path):
    n, i, path = 1_500_000, F.col("id"), f"{tmp_path}/lineitem.parquet"  # more prices than are counted with other columns
    keys = [(i % k).alias(c) for c, k in (("l_orderkey", 997), ("l_partkey", 200), ("l_suppkey", 10))]
    numbers = [(i % 7 + 1).cast("int").alias("l_linenumber"), (i % 50 + 1).cast("double").alias("l_quantity"), ((i * 7919 % n + 90000) / 100).alias("l_extendedprice"), (i % 11 / 100).alias("l_discount"), (i % 9 / 100).alias("l_tax")]
    spark.range(n).select(*keys, *numbers, F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus")).write.parquet(path)
    sql = registry.ORACLE_SQL["profile_lineitem"].replace("WITH cells", f"WITH lineitem AS (SELECT * FROM '{path}/*.parquet'), cells", 1)
    agree(registry.QUERIES["profile_lineitem"](spark, str(tmp_path)), sql)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_nothing_else_imports_llm():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parent
    assert [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and re.search(r"quillmask\.llm", p.read_text())] == []
