"""Each query that SQL expresses against DuckDB on the same tables; the others give rows."""

import pytest

from quillon.plans import catalog, parts  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, data, duck, same_rows, name):
    same_rows(catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, data, name):
    catalog.QUERIES[name](spark, data).collect()


def test_plans(spark, data):
    """Top-k by group is limited before the window's sort; filters reach the scan."""
    from quillon.operators import lexical

    docs, asked = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    plan = lexical.search(lexical.build(docs, "doc_id"), asked, "doc_id", "item_id", 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    read = spark.read.parquet(f"{data}/documents.parquet").where("source = 'src1'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in read


def test_rows_do_not_depend_on_partitions(spark, data, same_rows):
    from quillon.operators import lexical

    docs, asked = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    one, many = (lexical.search(lexical.build(d, "doc_id"), asked, "doc_id", "item_id", 10).toPandas() for d in (docs.coalesce(1), docs.repartition(7)))
    same_rows(one.drop(columns="matched"), many.drop(columns="matched"))
