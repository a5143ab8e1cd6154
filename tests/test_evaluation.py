from datetime import timedelta
from math import log2

import numpy as np
import pytest
from conftest import DAY0
from pyspark.sql import functions as F

from reelspark.operators import eval_ranking as er
from reelspark.operators import eval_retrieval as ev
from reelspark.operators.popularity import MostPopular
from reelspark.operators.random_ranker import RandomRecommender
from reelspark.operators.recommend import top_k
from reelspark.params import EvalParams, SplitDates
from reelspark.plans import experiment
from reelspark.sources import logs


def user_rows(spark, hits, targets, cats=None, ks=(1, 2, 4), width=4, depth=3):
    rows = [
        (u, 100 * u + r, r + 1, h, (cats[u][r] if cats else r), 1.0)
        for u, row in enumerate(hits)
        for r, h in enumerate(row)
    ]
    frame = spark.createDataFrame(rows, "user_id bigint, item_id bigint, rank int, hit int, category bigint, information double")
    wanted = spark.createDataFrame([(u, -i) for u, n in enumerate(targets) for i in range(n)], "user_id bigint, item_id bigint")
    return [r.asDict() for r in ev.user_metrics(frame, wanted, ks, width, depth).orderBy("user_id").collect()]


def test_retrieval_metric_literals(spark):
    first, second = user_rows(spark, [[1, 0, 1, 0], [0, 1, 0, 0]], [2, 1])
    assert (first["recall@1"], second["recall@1"], first["recall@4"], second["recall@4"]) == (0.5, 0, 1, 1)
    assert first["ndcg@4"] == pytest.approx((1 + 1 / 2) / (1 + 1 / log2(3)))
    assert second["ndcg@4"] == pytest.approx(1 / log2(3))
    assert (first["hit@1"], second["hit@1"]) == (1, 0)


def test_ideal_is_capped_at_k(spark):
    (row,) = user_rows(spark, [[1, 1]], [5], ks=(2,), width=2, depth=2)
    assert row["ndcg@2"] == pytest.approx(1) and row["recall@2"] == pytest.approx(0.4)


def test_diversity_literals_and_empty_slots(spark):
    got = user_rows(spark, [[0] * 3] * 3, [1] * 3, cats=[[1, 1, 1], [1, 2, 3], [1, 1, 2]], ks=(3,), width=3)
    assert [r["ild@3"] for r in got] == pytest.approx([0, 1, 2 / 3])
    (short,) = user_rows(spark, [[0]], [1], ks=(3,), width=3)
    assert short["ild@3"] == pytest.approx(1)


def test_a_user_without_a_list_still_counts(spark):
    rows = user_rows(spark, [[1]], [1, 2], ks=(1,), width=1, depth=1)
    assert [r["recall@1"] for r in rows] == [1, 0] and rows[1]["ild@1"] == 0


def test_top_k_respects_tiny_differences(spark):
    frame = spark.createDataFrame([(0, i, 1e-12 if i == 37 else 0.0) for i in range(50)], "user_id bigint, item_id bigint, score double")
    best = top_k(frame, 1, F.col("score"), [F.col("item_id")]).first()
    assert best["item_id"] == 37


def test_spread_counts_unshown_items(spark):
    lists = spark.createDataFrame([(u, 7, 1) for u in range(5)], "user_id bigint, item_id bigint, rank int")
    available = spark.range(100).select(F.col("id").alias("item_id"))
    row = ev.list_concentration(lists, available, (1,)).first()
    assert row["coverage"] == pytest.approx(0.01) and row["gini"] == pytest.approx(0.99)


@pytest.fixture(scope="module")
def literal(spark):
    groups, y, s = [1, 1, 1, 2, 2, 3, 3], [1, 0, 0, 0, 1, 1, 1], [0.9, 0.1, 0.2, 0.8, 0.3, 0.5, 0.4]
    rows = [(str(g), i, a, b) for i, (g, a, b) in enumerate(zip(groups, y, s))]
    return spark.createDataFrame(rows, "group_id string, item_id bigint, is_click int, score double")


def as_dict(frame):
    return {(r["metric"], r["k"]): r for r in frame.collect()}


def test_gauc_and_ndcg_literals(literal):
    got = as_dict(er.ranking_metrics(literal, ["is_click"], [2]))
    assert got["gauc", None]["value"] == pytest.approx(3 / 5) and got["gauc_groups", None]["value"] == 2
    assert got["ndcg", 2]["value"] == pytest.approx((1 + 1 / log2(3) + 1) / 3)
    assert got["n_impressions", None]["value"] == 7


def test_all_ties_give_one_half(literal):
    got = as_dict(er.ranking_metrics(literal.withColumn("score", F.lit(1.0)), ["is_click"], [2]))
    assert got["auc", None]["value"] == 0.5 and got["gauc", None]["value"] == 0.5


def test_ties_are_broken_at_random_but_fairly(spark):
    rows = [(str(g), i, int(i == 0), 1.0) for g in range(2000) for i in range(4)]
    frame = spark.createDataFrame(rows, "group_id string, item_id bigint, is_click int, score double")
    value = er.group_ndcg(frame, ["is_click"], [1], 17).agg(F.avg("ndcg_1")).first()[0]
    assert value == pytest.approx(0.25, abs=0.04)


def test_gauc_matches_pairs_when_one_group_holds_most_rows(spark):
    rng = np.random.default_rng(8)
    g = np.where(rng.random(2000) < 0.5, 0, rng.integers(1, 15, 2000))
    s, y = np.round(rng.random(2000), 2), (rng.random(2000) < 0.4).astype(int)
    rows = [(str(a), i, int(b), float(c)) for i, (a, b, c) in enumerate(zip(g, y, s))]
    frame = spark.createDataFrame(rows, "group_id string, item_id bigint, is_click int, score double")
    total, weight = 0.0, 0
    for a in np.unique(g):
        pos, neg = s[(g == a) & (y == 1)], s[(g == a) & (y == 0)]
        if len(pos) and len(neg):
            auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
            total, weight = total + auc * (g == a).sum(), weight + (g == a).sum()
    got = as_dict(er.ranking_metrics(frame, ["is_click"], [5], n_boot=40, seed=2))
    assert got["gauc", None]["value"] == pytest.approx(total / weight)
    assert got["gauc", None]["ci_lo"] < total / weight < got["gauc", None]["ci_hi"]
    assert got["ndcg", 5]["ci_lo"] < got["ndcg", 5]["value"] < got["ndcg", 5]["ci_hi"]


def test_exposures_take_the_maximum(spark):
    rows = [(1, 2, DAY0, 0), (1, 2, DAY0, 1), (1, 2, DAY0 + timedelta(days=1), 0)]
    frame = spark.createDataFrame(rows, "user_id bigint, item_id bigint, date date, is_click int")
    assert [r["is_click"] for r in er.exposures(frame, ["is_click"]).collect()] == [1]
    by_day = er.with_group(er.exposures(frame, ["is_click"], "user_date"), "user_date")
    assert {r["group_id"]: r["is_click"] for r in by_day.collect()} == {"1|2024-03-01": 1, "1|2024-03-02": 0}


def test_whole_experiment(spark, events, items, tmp_path):
    splits = SplitDates(
        (DAY0, DAY0 + timedelta(days=7)),
        (DAY0 + timedelta(days=8), DAY0 + timedelta(days=10)),
        (DAY0 + timedelta(days=11), DAY0 + timedelta(days=13)),
    )
    params = EvalParams(
        eval_sets=("val_standard", "test_random"), labels=("is_click",), ks=(3, 5), headline_k=5, ranking_ks=(2,), bootstrap_samples=20
    )
    results = experiment.evaluate_models(events, items, splits, lambda: [MostPopular(), RandomRecommender(1)], params)
    logs.write_results(results, str(tmp_path / "r"))
    read = logs.read_results(spark, str(tmp_path / "r")).persist()
    assert read.columns == list(experiment.RESULT_COLUMNS)
    assert {(r["eval_set"], r["protocol"]) for r in read.collect()} == {
        ("val_standard", "retrieval"),
        ("val_standard", "ranking"),
        ("test_random", "ranking"),
    }
    bounded = read.filter("metric in ('recall','hit','ndcg','coverage','gauc','auc')")
    assert bounded.filter("value < 0 or value > 1 or value is null").count() == 0
    table = experiment.summary_table(read, params.eval_sets, 5).collect()
    assert {r["model"] for r in table} == {"most_popular", "random"} and all(r["val_standard"] is not None for r in table)
    assert {r["k"] for r in experiment.largest_k(read, "recall").collect()} == {5}
