from collections import Counter, defaultdict
from datetime import date, timedelta
from math import sqrt

import pytest
from conftest import DAY0, event_rows
from pyspark.sql import functions as F

from reelspark.operators import catalog as cat
from reelspark.operators import cooccurrence as cooc
from reelspark.operators.baselines import build_baselines
from reelspark.operators.cooccurrence import ItemCooccurrence
from reelspark.operators.popularity import MostPopular
from reelspark.operators.random_ranker import RandomRecommender, _next_prime
from reelspark.operators.recommend import Recommender, item_tie, numbered_slots, top_k, walk_shared_order
from reelspark.params import BaselineParams
from reelspark.sources import tables

AS_OF = DAY0 + timedelta(days=8)
K = 6


@pytest.fixture(scope="module")
def setting(spark, events, items):
    fit = tables.fit_window(events, AS_OF).persist()
    eval_df = tables.eval_set(events, "val_standard").persist()
    catalog = cat.build_catalog(items, fit).persist()
    available = cat.available_items(catalog, F.lit(DAY0 + timedelta(days=10))).persist()
    targets, exclusions = cat.retrieval_targets(eval_df, fit, "is_click", catalog, available)
    return fit, eval_df, catalog, available, targets, exclusions


def lists(model, setting, k=K):
    fit, _, catalog, available, targets, exclusions = setting
    fitted = model.fit(fit, catalog, AS_OF)
    people = targets.select("user_id").distinct()
    rows = fitted.recommend(people, k, exclusions, available, 5).collect()
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r["user_id"]].append(r["item_id"])
    return fitted, dict(out)


def fully_ranked(model, setting, k=K):
    fit, _, catalog, available, targets, exclusions = setting
    fitted = model.fit(fit, catalog, AS_OF)
    # The definition, on a frame small enough for it: every open pair is scored and ranked.
    pairs = targets.select("user_id").distinct().crossJoin(available.select("item_id"))
    scored = fitted.score_pairs(pairs.join(exclusions, ["user_id", "item_id"], "left_anti"))
    rows = top_k(scored, k, F.col("score"), item_tie(5)).collect()
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r["user_id"]].append(r["item_id"])
    return dict(out)


@pytest.mark.parametrize(
    "make",
    [lambda: MostPopular(), lambda: MostPopular("long_view", 3), lambda: ItemCooccurrence("is_click", 5, 2.0, 10), lambda: ItemCooccurrence("is_click", 200, 10.0, 200)],
)
def test_own_path_lists_what_full_ranking_lists(setting, make):
    assert lists(make(), setting)[1] == fully_ranked(make(), setting)


@pytest.mark.parametrize("make", [MostPopular, ItemCooccurrence, lambda: RandomRecommender(3)])
def test_lists_respect_exclusions_and_availability(setting, make):
    _, _, _, available, targets, exclusions = setting
    allowed = {r["item_id"] for r in available.collect()}
    barred = defaultdict(set)
    for r in exclusions.collect():
        barred[r["user_id"]].add(r["item_id"])
    everyone = {r["user_id"] for r in targets.collect()}
    # far more slots than items: a list may be short only because items ran out
    for k in (K, 100):
        _, got = lists(make(), setting, k)
        for user in everyone:
            mine = got.get(user, [])
            assert len(mine) == len(set(mine)) and set(mine) <= allowed - barred[user]
            assert len(mine) == min(k, len(allowed - barred[user]))


def test_cooccurrence_matches_a_plain_computation(spark, setting):
    fit, _, catalog, *_ = setting
    model = ItemCooccurrence("is_click", 4, 3.0, 5).fit(fit, catalog, AS_OF)
    latest = {}
    for r in event_rows():
        if r[5] == "standard" and r[2] < AS_OF and r[7] == 1:
            latest[r[0], r[1]] = max(latest.get((r[0], r[1]), (date.min, 0)), (r[2], r[3]))
    by_user = defaultdict(list)
    for (user, item), last in latest.items():
        by_user[user].append((last, item))
    history = {u: [i for _, i in sorted(rows, reverse=True)[:5]] for u, rows in by_user.items()}
    n = Counter(i for items in history.values() for i in items)
    both = Counter((a, b) for items in history.values() for a in items for b in items if a != b)
    sim = defaultdict(list)
    for (a, b), c in both.items():
        sim[a].append((-c / (sqrt(n[a] * n[b]) + 3.0), b))
    near = {a: {b: -s for s, b in sorted(rows)[:4]} for a, rows in sim.items()}
    pairs = spark.createDataFrame([(u, i) for u in range(30) for i in range(-1, 40)], "user_id bigint, item_id bigint")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in model.score_pairs(pairs).collect()}
    assert len(got) == 30 * 40  # the unknown item is not scored
    for (user, item), score in got.items():
        want = sum(near.get(h, {}).get(item, 0.0) for h in history.get(user, [])) + 1e-6 * n[item] / max(n.values())
        assert score == pytest.approx(want, abs=1e-12)


def test_a_user_history_is_bounded(setting):
    fit = setting[0]
    kept = cooc.user_histories(fit, "is_click", 7).groupBy("user_id").count().agg(F.max("count")).first()[0]
    assert kept == 7


def test_a_model_without_a_path_of_its_own_names_itself():
    with pytest.raises(NotImplementedError, match="recommender"):
        Recommender().recommend(None, K, None, None, 5)


def test_random_is_reproducible_and_spread_out(spark, setting):
    _, first = lists(RandomRecommender(3), setting)
    _, again = lists(RandomRecommender(3), setting)
    _, other = lists(RandomRecommender(4), setting)
    assert first == again and first != other
    n, k, users = 50, 5, 4000
    available = spark.range(n).select(F.col("id").alias("item_id"))
    people = spark.range(users).select(F.col("id").alias("user_id"))
    nothing = people.limit(0).select("user_id", F.col("user_id").alias("item_id"))
    model = RandomRecommender(9).fit(people, available, AS_OF)
    counts = [r["count"] for r in model.recommend(people, k, nothing, available, 1).groupBy("item_id").count().collect()]
    assert len(counts) == n and min(counts) > 0.7 * users * k / n and max(counts) < 1.3 * users * k / n


def test_next_prime():
    assert [_next_prime(n) for n in (0, 2, 4, 8, 14, 90)] == [2, 2, 5, 11, 17, 97]


def test_slots_come_in_bounded_chunks(spark):
    users = spark.createDataFrame([(1, 25_001), (2, 1), (3, 0)], "user_id bigint, n bigint")
    got = {r["user_id"]: (r["c"], r["m"]) for r in numbered_slots(users, F.col("n")).groupBy("user_id").agg(F.count("slot").alias("c"), F.max("slot").alias("m")).collect()}
    assert got == {1: (25_001, 25_000), 2: (1, 0)}


def test_walk_for_a_user_who_excluded_nearly_everything(spark):
    ranked = spark.range(1, 20_001).select(F.col("id").alias("item_id"), F.col("id").alias("position"))
    barred = spark.range(1, 19_998).select(F.lit(1).cast("bigint").alias("user_id"), F.col("id").alias("item_id"))
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    got = defaultdict(list)
    for r in walk_shared_order(users, 5, barred, ranked).orderBy("rank").collect():
        got[r["user_id"]].append(r["item_id"])
    assert dict(got) == {1: [19_998, 19_999, 20_000], 2: [1, 2, 3, 4, 5]}


def test_model_set():
    assert [m.name for m in build_baselines()] == ["most_popular", "recent_popular_3d", "item_cooc", "random"]
    assert [m.name for m in build_baselines(BaselineParams(random=None, item_cooc=None))] == ["most_popular", "recent_popular_3d"]


def test_plans_have_no_products(setting):
    fit, _, catalog, available, targets, exclusions = setting
    for model in (MostPopular(), ItemCooccurrence(), RandomRecommender(1)):
        fitted = model.fit(fit, catalog, AS_OF)
        plan = fitted.recommend(targets.select("user_id").distinct(), K, exclusions, available, 5)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
