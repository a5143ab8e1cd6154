from random import Random

from conftest import DAY0
from pyspark.sql import functions as F

from reelspark.functions import bitmaps
from reelspark.operators import explore, ingest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_of_any_ids_and_totals_in_one_pass(spark):
    rng = Random(3)
    ids = [0, 1, 63, 64, -1, -64, -65, 2**40, -(2**50), 2**63 - 1, -(2**63), None]
    rows = [(rng.choice("ab") if rng.random() < 0.6 else None, rng.choice(ids + list(range(200))), rng.choice(ids), rng.choice([1, 5, None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, x bigint, y bigint, v int")
    out = bitmaps.totals(df, ["g"], {"nx": F.col("x"), "ny": F.col("y")}, {"rows": F.lit(1), "total": F.col("v")})
    text = plan(out)  # before it runs: the plan of a finished query names everything twice
    want = df.groupBy("g").agg(F.count_distinct("x"), F.count_distinct("y"), F.count(F.lit(1)), F.sum("v"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    # One scan, no row made more often than there are id columns, hash aggregation throughout.
    assert "Expand" not in text and "SortAggregate" not in text and text.count("Scan") == 1


def test_no_rows(spark):
    df = spark.createDataFrame([], "x bigint, y bigint")
    out = bitmaps.totals(df, [], {"nx": F.col("x"), "ny": F.col("y")}, {"rows": F.lit(1)}).collect()
    assert [tuple(r) for r in out] == [(0, 0, None)]


def test_words_are_fewer_than_dense_ids(spark):
    df = spark.range(100_000).select(F.pmod("id", F.lit(50_000)).alias("x"))
    assert bitmaps.words(df, [], [F.col("x")]).count() == -(-50_000 // 64)


def test_distinct_counts_of_the_operators_make_no_expanded_rows(spark, events, items):
    for out in (explore.overview(events), explore.sparsity(events)):
        assert "Expand" not in plan(out)


def test_manifest_reads_the_log_once(spark, events, items, monkeypatch):
    read = []
    original = ingest.materialize
    monkeypatch.setattr(ingest, "materialize", lambda df, name: read.append(name) or original(df, name))
    unknown = events.limit(5).withColumn("item_id", F.col("item_id") + 10_000)
    log = events.union(unknown)
    out = ingest.manifest(log, items)
    got = {r["entry"]: r["value"] for r in out.collect()}
    assert read == ["manifest-words", "item-words"] and "Expand" not in plan(out)
    scans = [line for line in plan(out).splitlines() if "InMemoryTableScan" in line]
    assert not scans  # all of it comes from the stored words
    assert got["n_users"] == str(log.select("user_id").distinct().count())
    assert got["n_items_logged"] == str(log.select("item_id").distinct().count())
    assert got["n_items_catalog"] == str(items.count()) and got["first_day"] == str(DAY0)
    missing = log.select("item_id").distinct().join(items, "item_id", "left_anti").count()
    assert got["logged_items_missing_features"] == str(missing) and missing > 0
