"""Neighbour lists by bounds: equal to counting all pairs, with fewer pairs made."""

from random import Random

import pytest
from pyspark.sql import functions as F

from reelspark.operators import cooccurrence as cooc
from reelspark.operators.pruned_neighbors import pruned_neighbors, with_rounds

SCHEMA = "user_id bigint, item_id bigint"


def themed(users=1500, themes=40, per_theme=12, popular=6, wide=0.04, seed=5):
    """Users of one theme, a few of many, who nearly all meet the popular items; item 0 is in every history."""
    rng, rows = Random(seed), set()
    for user in range(users):
        met = rng.sample(range(themes), 8 if rng.random() < wide else 1)
        mine = [1000 * (t + 1) + i for t in met for i in range(per_theme) if rng.random() < 0.8]
        others = [i for i in range(1, popular) if rng.random() < 0.9]
        rows |= {(user, item) for item in [0, *mine, *others]}
    return sorted(rows)


def plain(history, n, shrinkage):
    return cooc.top_neighbors(cooc.item_similarities(cooc.co_users(history), shrinkage), n)


def listed(df):
    return sorted((r["src_item"], r["dst_item"], r["sim"]) for r in df.collect())


def all_pairs(rows):
    sizes = {}
    for user, _ in rows:
        sizes[user] = sizes.get(user, 0) + 1
    return sum(s * (s - 1) // 2 for s in sizes.values())


@pytest.mark.parametrize("n, shrinkage, rounds", [(8, 10.0, 6), (8, 0.0, 4), (1, 3.0, 6), (500, 10.0, 3), (5, 10.0, 1)])
def test_lists_are_those_of_all_pairs(spark, n, shrinkage, rounds):
    history = spark.createDataFrame(themed(users=400), SCHEMA)
    got, _ = pruned_neighbors(history, n, shrinkage, rounds)
    assert listed(got) == listed(plain(history, n, shrinkage))


def test_fewer_pairs_are_made(spark):
    rows = themed()
    got, work = pruned_neighbors(spark.createDataFrame(rows, SCHEMA), 4, 10.0)
    assert listed(got) == listed(plain(spark.createDataFrame(rows, SCHEMA), 4, 10.0))
    assert sum(work.made) + work.looked_up < 0.6 * all_pairs(rows)
    _, work = pruned_neighbors(spark.createDataFrame(rows, SCHEMA), 4, 10.0, rounds=1)
    assert (sum(work.made), work.looked_up) == (all_pairs(rows), 0)


def test_ties_at_the_last_place_keep_the_smallest_ids(spark):
    # all items are alike, so every list is decided by ids alone
    rows = [(user, item) for user in range(60) for item in range(12)]
    history = spark.createDataFrame(rows, SCHEMA)
    got, _ = pruned_neighbors(history, 3, 1.0)
    assert listed(got) == listed(plain(history, 3, 1.0))
    assert {r["dst_item"] for r in got.filter("src_item > 3").collect()} == {0, 1, 2}


def test_random_histories(spark):
    for seed in range(3):
        rng = Random(seed)
        rows = sorted({(rng.randrange(120), int(30 * rng.random() ** 2)) for _ in range(1500)})
        history = spark.createDataFrame(rows, SCHEMA)
        assert listed(pruned_neighbors(history, 4, 2.0)[0]) == listed(plain(history, 4, 2.0))


def test_rounds_share_the_work(spark):
    dealt = with_rounds(spark.createDataFrame(themed(), SCHEMA), 4)
    work = {
        r["round"]: r["pairs"]
        for r in dealt.groupBy("user_id", "round")
        .count()
        .groupBy("round")
        .agg(F.sum(F.expr("count * (count - 1) / 2")).alias("pairs"))
        .collect()
    }
    whole = sum(work.values())
    assert all(abs(work[r] / whole - 0.25) < 0.06 for r in range(4))


def test_empty_and_missing_ids(spark):
    assert pruned_neighbors(spark.createDataFrame([], SCHEMA), 3, 1.0)[0].count() == 0
    rows = [(1, 1), (1, 2), (None, 1), (None, 2), (2, None)]
    assert listed(pruned_neighbors(spark.createDataFrame(rows, SCHEMA), 3, 1.0)[0]) == [(1, 2, 0.5), (2, 1, 0.5)]
    with pytest.raises(ValueError, match="positive"):
        pruned_neighbors(spark.createDataFrame(rows, SCHEMA), 0, 1.0)
