"""Lookups by id: right rows, and row groups without the ids are not read."""

import pytest
from pyspark.sql import functions as F

from reelspark.session import materialize
from reelspark.sources import id_lookup
from reelspark.sources.id_lookup import id_filters, rows_with_ids

N = 200_000


@pytest.fixture(scope="module")
def log(spark):
    # ids of a wide range in every file, as in a log stored by date; too many for a dictionary
    rows = spark.range(0, N, 1, 8)
    return rows.select(
        (F.abs(F.xxhash64("id")) % 1_000_000_000).alias("user_id"), F.col("id").alias("time_ms")
    )


@pytest.fixture(scope="module")
def stored(log):
    small_groups = {"parquet.block.size": str(64 * 1024), "parquet.enable.dictionary": "false"}
    return materialize(log, "log", options={**small_groups, **id_filters("user_id")})


def rows_read(df):
    """Rows the scan of `df` handed on."""
    rows = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    metric = leaves.apply(0).metrics().get("numOutputRows").get().value()
    return rows, metric


def test_row_groups_without_the_ids_are_skipped(spark, log, stored):
    wanted = log.filter("time_ms IN (17, 60000, 150001)").select("user_id")
    rows, read = rows_read(rows_with_ids(stored, "user_id", wanted))
    assert sorted(r["time_ms"] for r in rows) == [17, 60000, 150001]
    assert 0 < read < N / 4
    plain = materialize(log, "log", options={"parquet.block.size": str(64 * 1024), "parquet.enable.dictionary": "false"})
    again, read_without = rows_read(rows_with_ids(plain, "user_id", wanted))
    assert sorted(again) == sorted(rows) and read_without > 3 * read


def test_ids_no_row_has(spark, stored):
    unknown = spark.createDataFrame([(1_000_000_001 + i,) for i in range(3)], "user_id bigint")
    assert rows_with_ids(stored, "user_id", unknown).count() == 0
    assert rows_with_ids(stored, "user_id", unknown.limit(0)).count() == 0


def test_many_ids_are_joined(spark, log, stored):
    wanted = log.filter(F.col("time_ms") % 50 == 3).select("user_id")
    assert wanted.distinct().count() > id_lookup.PUSHED_IDS
    got = rows_with_ids(stored, "user_id", wanted)
    want = {r["user_id"] for r in wanted.collect()}
    assert got.columns == stored.columns
    assert sorted(got.collect()) == sorted(r for r in log.collect() if r["user_id"] in want)


@pytest.mark.parametrize("limit", [500, 2])
def test_nulls_repeats_and_ties(spark, monkeypatch, limit):
    monkeypatch.setattr(id_lookup, "PUSHED_IDS", limit)
    rows = [("a", 1), ("b", 2), (None, 3), ("a", 1), ("c", 4), ("d", 5)]
    table = spark.createDataFrame(rows, "extra string, id bigint").select(F.col("extra").alias("user_id"), "id")
    ids = spark.createDataFrame([("a",), ("a",), (None,), ("x",), ("d",)], "user_id string")
    assert sorted(tuple(r) for r in rows_with_ids(table, "user_id", ids).collect()) == [("a", 1), ("a", 1), ("d", 5)]
