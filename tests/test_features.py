from collections import defaultdict
from datetime import timedelta

import pytest
from conftest import DAY0, EVENT_SCHEMA, event_rows, item_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.operators import point_in_time as pit
from reelspark.operators.contracts import LeakageError, check_leakage
from reelspark.params import FeatureParams
from reelspark.session import materialize

CUT = DAY0 + timedelta(days=9)


def examples(events):
    keyed = events.filter(F.col("date") == F.lit(CUT)).select("user_id", "item_id", "date", "is_click")
    return keyed.withColumn("row_id", F.monotonically_increasing_id())


def feature_rows(spark, rows, asked, items, users):
    frame = pit.historical_features(asked, spark.createDataFrame(rows, EVENT_SCHEMA), items, users)
    return {r["row_id"]: r.asDict() for r in frame.collect()}


@pytest.fixture(scope="module")
def baseline(spark, events, items, users):
    asked = examples(events).persist()
    return asked, feature_rows(spark, event_rows(), asked, items, users)


def test_rows_and_columns_are_kept(baseline):
    asked, got = baseline
    assert len(got) == asked.count()
    assert {"user_id", "item_id", "date", "is_click", "item_ctr_7d", "ua_active_days_all"} <= set(next(iter(got.values())))


def test_features_match_brute_force(baseline):
    authors = {r[0]: r[1] for r in item_rows()}
    _, got = baseline
    events = [r for r in event_rows() if r[5] == "standard" and r[2] < CUT]
    g_ctr = sum(r[7] for r in events) / len(events)
    for row in list(got.values())[:25]:
        mine = [r for r in events if r[1] == row["item_id"]]
        week = [r for r in mine if r[2] >= CUT - timedelta(days=7)]
        assert row["item_impr_all"] == len(mine) and row["item_impr_7d"] == len(week)
        assert row["item_ctr_7d"] == pytest.approx((sum(r[7] for r in week) + 20 * g_ctr) / (len(week) + 20))
        author = authors[row["item_id"]]
        if author is None:
            assert row["author_impr_all"] is None and row["ua_impr_all"] is None
        else:
            theirs = [r for r in events if authors[r[1]] == author and r[0] == row["user_id"]]
            assert row["ua_impr_all"] == len(theirs)
            assert row["ua_active_days_all"] == len({r[2] for r in theirs})
            last = (CUT - max(r[2] for r in theirs)).days if theirs else None
            assert row["ua_days_since_last"] == last


def later_rewritten(rows):
    out = []
    for r in rows:
        if r[2] >= CUT:
            out += [(*r[:7], 1 - r[7], 1 - r[8], 1 - r[9], r[10] * 5, r[11])] * 3
        else:
            out.append(r)
    return out


def test_rewriting_the_day_and_later_changes_nothing(spark, baseline, items, users):
    asked, got = baseline
    assert feature_rows(spark, later_rewritten(event_rows()), asked, items, users) == got


def test_rewriting_the_day_before_changes_features(spark, baseline, items, users):
    asked, got = baseline
    before = CUT - timedelta(days=1)
    rows = [(*r[:7], 1 - r[7], *r[8:]) if r[2] == before else r for r in event_rows()]
    assert feature_rows(spark, rows, asked, items, users) != got


def test_an_inclusive_frame_would_be_caught(spark, baseline, items, users, monkeypatch):
    """Mutation: frames that end at the day itself must break the perturbation test."""
    asked, _ = baseline
    real = type(Window.partitionBy("x")).rangeBetween
    monkeypatch.setattr(
        type(Window.partitionBy("x")), "rangeBetween", lambda self, a, b: real(self, a, 0 if b == -1 else b)
    )
    clean = feature_rows(spark, event_rows(), asked, items, users)
    assert feature_rows(spark, later_rewritten(event_rows()), asked, items, users) != clean


def test_leaky_columns_raise_before_any_job(spark, events, items, users):
    with pytest.raises(LeakageError):
        check_leakage(events.withColumn("item_show_cnt", F.lit(1)), FeatureParams().leaky_columns)
    leaky = FeatureParams(leaky_columns=("ctr_7d",))
    with pytest.raises(LeakageError):
        pit.historical_features(examples(events), events, items, users, leaky)


def test_written_features_cover_every_set(spark, events, items, users, tmp_path):
    pit.write_features(events, items, users, str(tmp_path / "f"))
    written = spark.read.parquet(str(tmp_path / "f"))
    assert written.count() == events.count()
    assert written.select("split", "source").distinct().count() == 6


def test_windows_see_days_not_events(spark, events, items):
    """The window is fed by the daily aggregation, and no single task takes raw rows."""
    asked = events.join(items.select("item_id", "author_id"), "item_id", "left")
    view = pit.VIEWS[0]
    feed = pit.feature_events(events, items)
    frame = pit.view_features(feed, asked, view, pit.global_rates(feed, asked), FeatureParams())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.index("Window") < plan.index("HashAggregate")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_wide_rows_are_shuffled_three_times_at_most(spark, events, items, users):
    # stored inputs: plans of cached frames would show up in the text
    events, items, users = (materialize(x, "inputs") for x in (events, items, users))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = examples(events).withColumn("marker", F.concat(F.lit("wide"), F.col("row_id").cast("string")))
        plan = pit.historical_features(asked, events, items, users)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    tree = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    wide = [line for line in tree if "item_id" in line and "user_id" in line]
    assert plan.count("SortMergeJoin") <= 3 + 2 + 3 and len(wide) <= 3
    log = events._scratch_path.rsplit("/", 1)[-1]
    assert plan.count("InMemoryTableScan") == 0 and plan.count(log) <= 1  # as the examples; the log was summed before


def exchanged(frame):
    """Column names of each exchange of a plan."""
    adaptive = frame._jdf.queryExecution().executedPlan()
    found, open_nodes = [], [adaptive.initialPlan() if adaptive.nodeName().startswith("AdaptiveSparkPlan") else adaptive]
    while open_nodes:
        node = open_nodes.pop()
        if node.nodeName() == "Exchange":
            found.append([node.output().apply(i).name() for i in range(node.output().size())])
        open_nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_totals_travel_instead_of_features(spark, events, items, users):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exchanged(pit.historical_features(examples(events), events, items, users))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert found and not any("_ctr_" in c or c.startswith("author_impr") for names in found for c in names)
    # after the window the item's totals move once
    assert sum("_item_impr_all" in names and "is_click" not in names for names in found) == 1


def test_wide_rows_are_shuffled_by_item_and_by_user_only(spark, events, items, users):
    """Totals by user and author come with the user's day; no row is dealt out for them."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exchanged(pit.historical_features(examples(events), events, items, users))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    wide = [names for names in found if "is_click" in names]
    assert len(wide) == 2 and not any("_ua_impr_all" in names or "_user_impr_all" in names for names in wide)


def test_many_authors_join_before_the_rows_do(spark, baseline, events, items, users, monkeypatch):
    asked, got = baseline
    monkeypatch.setattr(pit, "AUTHOR_DAYS", 0)
    assert feature_rows(spark, event_rows(), asked, items, users) == got


def test_pairs_of_user_and_author_are_summed_once(spark, events, items):
    """Sums by user, item and day would shuffle the log once more and make it hardly shorter."""
    view = next(v for v in pit.VIEWS if v.name == "ua")
    joined = pit.view_events(events, items, view)
    assert "Aggregate" not in joined._jdf.queryExecution().optimizedPlan().toString()
    got = pit.daily_totals(joined, view.keys).collect()
    wanted = defaultdict(lambda: [0.0] * len(pit.MEASURES))
    authors = {r["item_id"]: r["author_id"] for r in items.collect()}
    for r in events.filter("source = 'standard'").collect():
        author = authors.get(r["item_id"])
        if author is not None and r["user_id"] is not None:
            total = wanted[r["user_id"], author, r["date"]]
            for i, column in enumerate(pit.MEASURES.values()):
                total[i] += 1 if column is None else r[column] or 0
    assert {(r["user_id"], r["author_id"], r["date"]): [r[m] for m in pit.MEASURES] for r in got} == dict(wanted)
