import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import expressions as X
from reelspark.functions import stats


def column(spark, values, kind, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_duration_index_edges_go_up(spark):
    got = column(spark, [None, 1000.0, 7000.0, 7001.0, 18000.0, 1e7], "double", X.duration_index)
    assert got == [0, 1, 2, 2, 3, 8]


def test_duration_label_edges_go_down(spark):
    got = column(spark, [None, 7000, 7001, 18000, 60000, 60001, 180001], "bigint", X.duration_label)
    assert got == ["unknown", "0-7s", "7-18s", "7-18s", "18-60s", "1-3min", "3min+"]


def test_age_labels(spark):
    got = column(spark, [None, -2, 0, 1, 7, 8, 30, 31, 180, 365, 366], "int", X.age_label)
    assert got == ["unknown", "0d", "0d", "1-7d", "1-7d", "8-30d", "8-30d", "31-180d", "31-180d", "181-365d", "365d+"]


def test_tag_list_keeps_slots(spark):
    got = column(spark, ["3,1", None, "", "7, 8 ,9,10,11", "x,5"], "string", lambda c: X.tag_list(c, 4))
    assert got == [[3, 1], [], [-1], [7, 8, 9, 10], [-1, 5]]


def test_two_primary_tag_rules(spark):
    values = ["3,1", None, "", "x,2", "3.7", " 4"]
    assert column(spark, values, "string", X.primary_tag_feature) == [3, None, None, None, None, 4]
    assert column(spark, values, "string", X.primary_tag_category) == [3, -1, -1, -1, 3, 4]


def histogram(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "n bigint")
    return stats.concentration(stats.count_histogram(frame, []), []).first()


@pytest.mark.parametrize("values, gini, top", [([1] * 10, 0.0, 0.1), ([0] * 99 + [1], 0.99, 1.0), ([0] * 99 + [100], 0.99, 1.0), ([1] * 100, 0.0, 0.01)])
def test_concentration_literals(spark, values, gini, top):
    row = histogram(spark, values)
    assert row["gini"] == pytest.approx(gini) and row["top_1pct_share"] == pytest.approx(top)


def test_gini_against_its_definition(spark):
    values = [random.Random(5).randrange(50) for _ in range(300)]
    x = np.sort(np.array(values, float))
    differences = np.abs(x[:, None] - x[None, :]).sum() / (2 * len(x) * x.sum())
    assert histogram(spark, values)["gini"] == pytest.approx(differences)


def pairwise_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))


def test_grouped_auc_matches_pairs_for_a_hot_group_and_odd_scores(spark):
    rng = np.random.default_rng(1)
    group = np.where(rng.random(3000) < 0.6, 0, rng.integers(1, 20, 3000))
    score = np.round(rng.normal(size=3000) * 10.0 ** rng.integers(-3, 3, 3000), 4)
    score[rng.random(3000) < 0.2] = 0.0
    y = (rng.random(3000) < 0.3).astype(int)
    frame = spark.createDataFrame([(int(g), int(a), float(s)) for g, a, s in zip(group, y, score)], "g int, y int, s double")
    got = {r["g"]: r["auc"] for r in stats.grouped_auc(frame, ["g"], "y", "s").collect()}
    for g in np.unique(group):
        assert got[g] == pytest.approx(pairwise_auc(y[group == g], score[group == g]))
    assert stats.grouped_auc(frame, [], "y", "s").first()["auc"] == pytest.approx(pairwise_auc(y, score))


def test_auc_ties_and_single_class(spark):
    frame = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 1, 1.0), (1, 1, 0.2)], "g int, y int, s double")
    got = {r["g"]: r["auc"] for r in stats.grouped_auc(frame, ["g"], "y", "s").collect()}
    assert got == {0: 0.5, 1: None}


def test_parts_follow_the_values_and_stay_even(spark):
    """A million scores that differ in the sixth digit only."""
    scores = spark.range(1_000_000).select((0.9 + F.pmod(F.col("id") * 7919, F.lit(1_000_000)) * 1e-9).alias("s"))
    parts = stats.ordered_parts(scores, "s", "scores")
    found = parts.groupBy("_bucket").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.count("*").alias("n")).orderBy("_bucket").collect()
    assert all(a["high"] < b["low"] for a, b in zip(found, found[1:]))
    assert max(r["n"] for r in found) <= 2 * 1_000_000 / len(found) and len(found) == 4


def test_poisson_table_reaches_the_last_uniform_number():
    assert 1 - stats.POISSON_CDF[-1] < 2**-52 and list(stats.POISSON_CDF) == sorted(stats.POISSON_CDF)
    assert stats.POISSON_CDF[:3] == pytest.approx((0.36787944117144233, 0.7357588823428847, 0.9196986029286058))


def test_global_rank_is_a_full_ranking(spark):
    rows = [(i, (i * 7) % 5) for i in range(500)] + [(i, 99) for i in range(500, 503)]
    frame = spark.createDataFrame(rows, "id bigint, n bigint")
    got = stats.global_rank(frame, "n", "id", 1).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 504))
    assert [r["n"] for r in got] == sorted((n for _, n in rows), reverse=True)


def test_exact_quantiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.lognormal(size=700), np.zeros(200), [0.25] * 300])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]
    got = {r["prob"]: r["quantile"] for r in stats.exact_quantiles(frame, [], "v", probs).collect()}
    assert [got[p] for p in probs] == pytest.approx(list(np.quantile(values, probs)))


def test_bootstrap_brackets_the_mean_and_is_reproducible(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(0.6, 0.1, 400)
    frame = spark.createDataFrame([(i, float(v), 1.0) for i, v in enumerate(values)], "g int, v double, w double")
    first = stats.bootstrap_interval(frame, [], ["g"], "v", "w", 200, 17).first()
    again = stats.bootstrap_interval(frame.repartition(7), [], ["g"], "v", "w", 200, 17).first()
    assert first["ci_lo"] < values.mean() < first["ci_hi"]
    width = 2 * 1.96 * values.std() / 20
    assert first["ci_hi"] - first["ci_lo"] == pytest.approx(width, rel=0.3)
    assert again["ci_lo"] == pytest.approx(first["ci_lo"])
