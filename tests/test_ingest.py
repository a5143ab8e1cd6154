from datetime import date

import pytest
from pyspark.sql import functions as F

from reelspark.operators import contracts, ingest
from reelspark.params import BaselineParams, EvalParams, FeatureParams, SplitDates
from reelspark.sources import logs, tables

SPLITS = SplitDates(
    train=(date(2024, 3, 1), date(2024, 3, 5)), val=(date(2024, 3, 6), date(2024, 3, 7)), test=(date(2024, 3, 8), date(2024, 3, 9))
)


def log_frame(spark, **changed):
    rows = []
    for i in range(40):
        row = {c: 0 for c in logs.LOG_COLUMNS} | {
            "user_id": i % 7,
            "video_id": i % 11,
            "date": 20240301 + i % 9,
            "hourmin": 1200,
            "time_ms": 1000 + i,
            "is_click": i % 2,
            "is_rand": int(i % 4 == 0),
        }
        rows.append(row | {"source": "random" if i % 4 == 0 else "standard"})
    rows[5] |= changed
    schema = ", ".join(f"{c} {'bigint' if c in logs.LONG_LOG_COLUMNS else 'int'}" for c in logs.LOG_COLUMNS)
    return spark.createDataFrame([tuple(r[c] for c in [*logs.LOG_COLUMNS, "source"]) for r in rows], schema + ", source string")


def violations(frame):
    return {r["check"]: r["offending_rows"] for r in contracts.log_violations(frame).collect() if r["offending_rows"]}


@pytest.mark.parametrize(
    "changed, check",
    [
        ({"is_like": 2}, "binary_is_like"),
        ({"user_id": None}, "non_null_keys"),
        ({"is_rand": 1}, "is_rand_matches_source"),
    ],
)
def test_planted_defects_are_counted_and_raise(spark, changed, check):
    frame = log_frame(spark, **changed)
    assert violations(frame) == {check: 1}
    with pytest.raises(contracts.ContractError, match=check):
        contracts.enforce(contracts.log_violations(frame))


def test_clean_log_passes_and_null_flags_pass(spark):
    assert violations(log_frame(spark)) == {}
    assert violations(log_frame(spark, is_like=None, is_rand=None)) == {}


def test_split_follows_date_and_outside_rows_raise(spark):
    out = ingest.normalize_logs(log_frame(spark), SPLITS)
    assert {r["split"] for r in out.filter(F.col("date") == "2024-03-06").collect()} == {"val"}
    assert contracts.split_violations(out).first()["offending_rows"] == 0
    late = ingest.normalize_logs(log_frame(spark, date=20240401), SPLITS)
    assert contracts.split_violations(late).first()["offending_rows"] == 1
    with pytest.raises(Exception):
        ingest.normalize_logs(log_frame(spark, date=20241301), SPLITS).collect()


def test_unique_counts_nulls(spark):
    frame = spark.createDataFrame([(1,), (1,), (None,), (None,)], "item_id int")
    assert contracts.unique_violations(frame, "item_id", "u").first()["offending_rows"] == 3


def test_latest_event_takes_the_date_before_the_clock(spark):
    rows = [(1, 10, date(2024, 3, 1), 900), (1, 11, date(2024, 3, 2), 100)]
    frame = spark.createDataFrame(rows, "user_id bigint, item_id bigint, date date, time_ms bigint")
    assert ingest.latest_event(frame, ["user_id"]).first()["last_item_id"] == 11


def test_written_tables_prune_partitions(spark, events, items, users, tmp_path):
    logs.write_tables(events, users, items, str(tmp_path))
    read = logs.read_tables(spark, str(tmp_path))["interactions"]
    chosen = tables.eval_set(read, "val_random")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan or "PartitionFilters: [isnotnull(source" in plan
    assert chosen.count() == tables.eval_set(events, "val_random").count()
    fit = tables.fit_window(read, date(2024, 3, 9)).select("item_id")
    plan = fit._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(date,2024-03-09)" in plan and "play_time_ms" not in plan


def test_bad_names_and_parameters_raise():
    for name in ("test", "foo_random", "test_other"):
        with pytest.raises(ValueError):
            tables.parse_eval_set(name)
    with pytest.raises(ValueError):
        SplitDates(SPLITS.val, SPLITS.train, SPLITS.test)
    with pytest.raises(ValueError):
        FeatureParams(windows=(7, 3))
    with pytest.raises(ValueError):
        EvalParams(headline_k=7)
    with pytest.raises(ValueError):
        BaselineParams(recent_popular={})


def test_sub_releases(spark):
    rows = log_frame(spark)
    items = spark.createDataFrame([(i,) for i in range(20)], "video_id bigint")
    pool_rows, pool_items = ingest.derive_pool_release(rows, items)
    pool = {r["video_id"] for r in rows.filter("source = 'random'").collect()}
    assert {r["video_id"] for r in pool_rows.collect()} == pool == {r["video_id"] for r in pool_items.collect()}
    users = spark.createDataFrame([(i,) for i in range(7)], "user_id bigint")
    mine, kept, seen = ingest.derive_user_release(rows, users, items, 3, 1)
    assert kept.count() == 3
    assert {r["video_id"] for r in seen.collect()} == {r["video_id"] for r in mine.collect()}
    again = ingest.sample_users(users.repartition(5), 3, 1)
    assert {r[0] for r in again.collect()} == {r["user_id"] for r in kept.collect()}


def test_a_file_without_a_column_is_named(spark, tmp_path):
    paths = []
    for i in range(3):
        columns = [c for c in logs.LOG_COLUMNS if (i, c) != (1, "is_click")]
        frame = log_frame(spark).select(*(reversed(columns) if i == 2 else columns))
        frame.coalesce(1).write.option("header", True).csv(str(tmp_path / f"part{i}"))
        paths.append(str(tmp_path / f"part{i}"))
    with pytest.raises(contracts.ContractError, match="part1 lacks the columns is_click"):
        logs.read_logs(spark, paths[:2], paths[2:])
    with pytest.raises(contracts.ContractError, match="part1 lacks"):
        logs.stage_logs(spark, [(i, p, "standard") for i, p in enumerate(paths)])
    with pytest.raises(FileNotFoundError):
        logs.read_logs(spark, [str(tmp_path / "none")], [])


def test_one_scan_for_each_header(spark, tmp_path):
    files = []
    for i in range(5):
        columns = list(reversed(logs.LOG_COLUMNS)) if i == 4 else list(logs.LOG_COLUMNS)
        log_frame(spark).filter(F.col("user_id") == i).select(*columns).write.option("header", True).csv(str(tmp_path / f"f{i}"))
        files.append((i, str(tmp_path / f"f{i}"), "random" if i > 2 else "standard"))
    staged = logs.stage_logs(spark, files)
    assert staged._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    got = {(r["file_id"], r["source"], r["user_id"]) for r in staged.collect()}
    assert got == {(i, s, i) for i, _, s in files}


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from reelspark import session

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)


def test_order_of_written_rows_is_checked(spark, tmp_path):
    out = ingest.normalize_logs(log_frame(spark), SPLITS)
    out.coalesce(1).orderBy("date", "time_ms", "user_id", "item_id").write.parquet(str(tmp_path / "good"))
    out.coalesce(1).sortWithinPartitions(F.col("time_ms").desc()).write.parquet(str(tmp_path / "bad"))
    assert ingest.order_violations(spark.read.parquet(str(tmp_path / "good"))).first()[0] == 0
    assert ingest.order_violations(spark.read.parquet(str(tmp_path / "bad"))).first()[0] > 10
