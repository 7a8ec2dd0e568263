"""Stores, versions, and work that is left."""

import pytest

from quillon.sources import store, tabular


def test_chunks_are_checked(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "s", "x"), ("b", "t", "y")], "chunk_id string, source string, text string")
    vectors = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    store.write_chunks(chunks, str(tmp_path / "ok"), vectors)
    plan = spark.read.parquet(str(tmp_path / "ok")).where("source = 's'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan
    for bad in (chunks.unionAll(chunks), chunks.selectExpr("chunk_id", "source", "' ' as text")):
        with pytest.raises(store.Mismatch):
            store.check_chunks(bad)
    for bad in (vectors.limit(1), vectors.unionAll(spark.createDataFrame([("c",)], "chunk_id string"))):
        with pytest.raises(store.Mismatch):
            store.check_chunks(chunks, bad)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    assert store.versions(spark, path) == [] and store.write_version(spark.range(3), path) == 0 and store.write_version(spark.range(5), path) == 1
    (tmp_path / "v" / "v=2").mkdir()  # a run that broke off
    assert store.read_version(spark, path).count() == 5 and store.read_version(spark, path, 0).count() == 3 and store.versions(spark, path) == [0, 1]
    assert store.write_version(spark.range(1), path) == 2
    with pytest.raises(FileNotFoundError):
        store.read_version(spark, path, 9)


def test_left_to_do_and_fingerprints(spark):
    assert [r.id for r in store.left_to_do(spark.range(3), spark.createDataFrame([(0,), (1,)], "id long"), "id").collect()] == [2]
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    store.check_fingerprint(texts.repartition(3), store.fingerprint(texts.distinct()))
    with pytest.raises(store.Mismatch):
        store.check_fingerprint(texts, store.fingerprint(texts.where("text = 'a'")))


def test_since(spark):
    names = spark.createDataFrame([("r_2019.pdf",), ("r_2023.pdf",), ("r.pdf",)], "name string")
    assert sorted((r.name, r.year) for r in tabular.since(names, "name", 2022).collect()) == [("r.pdf", 0), ("r_2023.pdf", 2023)]
