from collections import defaultdict
from datetime import timedelta

import numpy as np
import pytest
from conftest import DAY0, event_rows
from pyspark.sql import functions as F

from reelspark.operators import catalog as cat
from reelspark.operators import tower_inputs as ti
from reelspark.operators import tower_math as tm
from reelspark.operators import ball_tree, two_tower, vector_index, vector_search
from reelspark.operators.eval_ranking import evaluate_ranking
from reelspark.params import TwoTowerParams
from reelspark.sources import tables

AS_OF = DAY0 + timedelta(days=8)
SMALL = TwoTowerParams(max_history=5, max_tags=2, field_dim=4, user_field_dim=2, hidden=16, dim=8, batch_size=64, epochs=3, lr=0.02, id_min_count=2, shard_rows=10_000)


def test_vocabulary_literal(spark):
    counts = spark.createDataFrame([("f", "a", 2), ("f", "b", 1)], "field string, value string, n bigint")
    vocab = ti.vocabulary(counts, 2)
    assert [(r["value"], r["idx"]) for r in vocab.collect()] == [("a", 1)]
    assert ti.vocabulary_sizes(vocab, ["f", "g"]) == {"f": 2, "g": 1}


def test_encoding_is_the_same_broadcast_or_shuffled(spark, items, users, monkeypatch):
    vocab = ti.user_vocabulary(users).persist()
    sizes = ti.vocabulary_sizes(vocab, ti.USER_FIELDS)
    near = sorted(map(str, ti.encode_users(users, vocab, sizes).collect()))
    monkeypatch.setattr(ti, "BROADCAST_ENTRIES", 3)
    assert sorted(map(str, ti.encode_users(users, vocab, sizes).collect())) == near


def snapshots(spark, positives, requests, length):
    events = spark.createDataFrame(positives, "user_id bigint, item_id bigint, date date, time_ms bigint")
    asked = spark.createDataFrame(requests, "user_id bigint, date date")
    return {(r["user_id"], r["date"]): r["history"] for r in ti.history_snapshots(events, asked, length).collect()}


def test_history_literals(spark):
    d1, d2, d3 = (DAY0 + timedelta(days=i) for i in range(3))
    rows = [(1, 10, d1, 5), (1, 11, d2, 1), (1, 12, d2, 2)]
    got = snapshots(spark, rows, [(1, d2), (1, d3), (2, d3), (1, d1)], 3)
    assert got == {(1, d2): [-1, -1, 10], (1, d3): [10, 11, 12], (2, d3): [-1] * 3, (1, d1): [-1] * 3}


def test_histories_match_brute_force(spark):
    rows = [(r[0], r[1], r[2], r[3]) for r in event_rows() if r[7] == 1]
    requests = [(u, DAY0 + timedelta(days=d)) for u in (0, 1, 2, 29, 77) for d in range(0, 16, 3)]
    got = snapshots(spark, rows, requests, 7)
    for user, day in requests:
        before = sorted((d, t, i) for u, i, d, t in rows if u == user and d < day)[-7:]
        assert got[user, day] == [-1] * (7 - len(before)) + [i for _, _, i in before]


def test_recent_examples_keep_exactly_the_latest(spark):
    rows = [(r[0], r[1], r[2], r[3]) for r in event_rows()]
    frame = spark.createDataFrame(rows, "user_id bigint, item_id bigint, date date, time_ms bigint")
    kept = ti.recent_examples(frame, 333).collect()
    latest = sorted(rows, key=lambda r: (r[2], r[3], r[0], r[1]))[-333:]
    assert sorted(map(tuple, kept)) == sorted(latest)
    assert ti.recent_examples(frame, None).count() == len(rows)


def test_field_rows_literal():
    offsets = tm.row_offsets({"a": 3, "b": 4})
    assert offsets == {"a": 1, "b": 3} and tm.table_rows({"a": 3, "b": 4}) == 6


def test_loss_masks_repeats_and_ignores_uniform_log_q():
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
    ids = np.array([7, 7, 8, 9])
    v[1] = v[0]
    plain, _, _ = tm.softmax_loss(u, v, ids, np.zeros(4), 0.5)
    logits = u @ v.T / 0.5
    logits[0, 1] = logits[1, 0] = -np.inf
    want = np.mean(np.log(np.exp(logits).sum(axis=1)) - np.diag(logits))
    assert plain == pytest.approx(want)
    assert tm.softmax_loss(u, v, ids, np.full(4, -3.0), 0.5)[0] == pytest.approx(plain)


@pytest.mark.parametrize("history_grad", [True, False])
def test_gradients_match_finite_differences(history_grad):
    rng = np.random.default_rng(1)
    p = TwoTowerParams(field_dim=3, user_field_dim=2, hidden=5, dim=4, temperature=0.7, history_grad=history_grad)
    w = tm.initial_weights(tm.tower_shapes(3, 2, p), 3)
    content, profile = rng.normal(size=(9, 3)), rng.normal(size=(5, 2))
    content[0] = profile[0] = 0
    batch = {
        "fields": rng.integers(0, 9, (6, 2)), "tags": rng.integers(0, 9, (6, 3)), "h_fields": rng.integers(0, 9, (6, 4, 2)),
        "h_tags": rng.integers(0, 9, (6, 4, 3)), "profile": rng.integers(0, 5, (6, 2)), "item_ids": np.array([1, 2, 3, 1, 5, 6]),
        "log_q": rng.normal(size=6),
    }
    _, grads, d_content, d_profile = tm.batch_gradients(w, content, profile, batch, p)

    def slope(array, at):
        kept = array[at]
        array[at] = kept + 1e-6
        up = tm.batch_gradients(w, content, profile, batch, p)[0]
        array[at] = kept - 1e-6
        down = tm.batch_gradients(w, content, profile, batch, p)[0]
        array[at] = kept
        return (up - down) / 2e-6

    for name, grad in grads.items():
        at = tuple(s // 2 for s in w[name].shape)
        assert grad[at] == pytest.approx(slope(w[name], at), abs=1e-6), name
    for row in range(1, 5):
        assert d_profile[row, 1] == pytest.approx(slope(profile, (row, 1)), abs=1e-6)
    if history_grad:
        for row in range(1, 9):
            assert d_content[row, 2] == pytest.approx(slope(content, (row, 2)), abs=1e-6)


def vectors(spark, matrix, id_column):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{id_column} bigint, vector array<double>")


def folded(users, items):
    """Scores as sums from the first coordinate to the last."""
    return np.array([np.cumsum(items * u, axis=1)[:, -1] for u in users])


def full_sort(users, items, barred, k, seed):
    import hashlib

    tie = [hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in range(len(items))]
    scores = folded(users, items)
    gone = defaultdict(set)
    for u, i in barred:
        gone[u].add(i)
    return {u: sorted((i for i in range(len(items)) if i not in gone[u]), key=lambda i: (-scores[u, i], tie[i], i))[:k] for u in range(len(users))}


def lists_of(found):
    got = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got[r["user_id"]].append(r["item_id"])
    return got


def clustered(rng, n_items, n_users, dim=6, centers=5):
    middles = rng.normal(size=(centers, dim)) * 3
    items = middles[rng.integers(0, centers, n_items)] + rng.normal(size=(n_items, dim)) * 0.2
    users = middles[rng.integers(0, centers, n_users)] + rng.normal(size=(n_users, dim)) * 0.2
    return users, items


def test_vector_search_equals_a_full_sort(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "ITEM_BLOCK", 16)
    monkeypatch.setattr(vector_search, "USER_BLOCK", 8)
    users, items = clustered(np.random.default_rng(2), 300, 40)
    items[100:200] = items[0]  # a hot group of equal vectors
    items[250] = 0
    barred = [(0, i) for i in range(150)] + [(u, u) for u in range(1, 40)]
    exclusions = spark.createDataFrame(barred, "user_id bigint, item_id bigint")
    found = vector_search.exact_top_k(vectors(spark, users, "user_id"), vectors(spark, items, "item_id"), 5, exclusions, 3)
    assert lists_of(found) == full_sort(users, items, barred, 5, 3)


def test_the_least_difference_of_scores_counts(spark):
    """Items whose scores differ by 1e-12, and by one unit in the last place, behind others that tie exactly."""
    items = np.array([[1.0, 0.0], [1.0 + 1e-12, 0.0], [1.0 + 1e-12 + 2.3e-16, 0.0], [0.5, 0.5], [0.5, 0.5], [1.0 - 1e-12, 0.0]])
    users = np.array([[1.0, 1.0], [1.0, 0.0]])
    nobody = spark.createDataFrame([], "user_id bigint, item_id bigint")
    got = lists_of(vector_search.exact_top_k(vectors(spark, users, "user_id"), vectors(spark, items, "item_id"), 6, nobody, 3))
    assert got[0][:2] == [2, 1] and got[0][5] == 5 and set(got[0][2:5]) == {0, 3, 4}
    assert got == full_sort(users, items, [], 6, 3)


def test_nothing_to_search(spark):
    nobody = spark.createDataFrame([], "user_id bigint, item_id bigint")
    none = spark.createDataFrame([], "item_id bigint, vector array<double>")
    one = vectors(spark, np.ones((1, 2)), "user_id")
    assert vector_search.exact_top_k(one, none, 3, nobody, 3).count() == 0


def test_trees_grow_with_the_items_and_bound_them(spark):
    nodes = []
    for n in (400, 1600):
        _, items = clustered(np.random.default_rng(3), n, 1, centers=40)
        items[: n // 3] = items[0]
        tree = ball_tree.build(vectors(spark, items, "item_id"), "item_id", 16, 4)
        rows = tree.placed.collect()
        assert len(rows) == n
        leaves = {r["node"]: r for r in tree.levels[-1].collect()}
        by_part = defaultdict(int)
        for r in rows:
            leaf = leaves[r["node"]]
            assert np.linalg.norm(np.array(r["vector"]) - leaf["center"]) <= leaf["radius"] + 1e-9
            by_part[r["node"], r["part"]] += 1
        assert max(by_part.values()) <= 48
        for above, below in zip([[0], *[[r["node"] for r in x.collect()] for x in tree.levels]], tree.levels):
            assert {r["parent"] for r in below.collect()} <= set(above)
        nodes.append(len(leaves))
    assert nodes[1] > 2 * nodes[0]


def test_bounds_rule_out_leaves_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "ITEM_BLOCK", 48)
    monkeypatch.setattr(vector_search, "USER_BLOCK", 8)
    kept, original = [], vector_search.surviving

    def counted(chunks, levels):
        out = original(chunks, levels)
        kept.append((out.count(), chunks.count() * levels[-1].count()))
        return out

    monkeypatch.setattr(vector_search, "surviving", counted)
    users, items = clustered(np.random.default_rng(4), 800, 60, dim=8, centers=12)
    nobody = spark.createDataFrame([], "user_id bigint, item_id bigint")
    found = vector_search.exact_top_k(vectors(spark, users, "user_id"), vectors(spark, items, "item_id"), 5, nobody, 3)
    assert lists_of(found) == full_sort(users, items, [], 5, 3)
    assert kept[0][0] < 0.5 * kept[0][1]


def test_unit_vectors_without_clusters_leave_few_leaves_open(spark, monkeypatch):
    """Near the top scores of vectors of equal length the gap between two balls rules out far more than their products."""
    monkeypatch.setattr(vector_search, "ITEM_BLOCK", 48)
    monkeypatch.setattr(vector_search, "USER_BLOCK", 8)
    kept, original = [], vector_search.surviving

    def counted(chunks, levels):
        out = original(chunks, levels)
        kept.append((out.count(), chunks.count() * levels[-1].count()))
        return out

    monkeypatch.setattr(vector_search, "surviving", counted)
    both = np.random.default_rng(6).normal(size=(3300, 3))
    both /= np.linalg.norm(both, axis=1, keepdims=True)
    items, users = both[:2500], both[2500:]
    nobody = spark.createDataFrame([], "user_id bigint, item_id bigint")
    found = vector_search.exact_top_k(vectors(spark, users, "user_id"), vectors(spark, items, "item_id"), 5, nobody, 3)
    assert lists_of(found) == full_sort(users, items, [], 5, 3)
    assert kept[0][0] < 0.2 * kept[0][1], kept


def test_scoring_is_dealt_out_by_number(spark, monkeypatch):
    """Short vectors take few bytes and much time: chunks of one leaf do not meet in one task."""
    monkeypatch.setattr(vector_search, "USER_BLOCK", 8)
    seen, original = [], vector_search._score_blocks
    monkeypatch.setattr(vector_search, "_score_blocks", lambda pairs: seen.append(pairs) or original(pairs))
    both = np.random.default_rng(7).normal(size=(400, 2))
    nobody = spark.createDataFrame([], "user_id bigint, item_id bigint")
    vector_search.exact_top_k(vectors(spark, both, "user_id"), vectors(spark, both, "item_id"), 5, nobody, 3)
    tasks = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) >= 6 and max(tasks) <= sum(tasks) / 3


def test_approximate_lists_reach_their_recall(spark):
    users, items = clustered(np.random.default_rng(5), 900, 70, dim=12, centers=9)
    items[:300] = items[0]
    barred = spark.createDataFrame([(u, i) for u in range(5) for i in range(200)], "user_id bigint, item_id bigint")
    u, v = vectors(spark, users, "user_id"), vectors(spark, items, "item_id")
    index = vector_index.InvertedIndex.build(v, 3, list_rows=40, slices=5)
    sizes = [len(r["item_ids"]) for r in index.lists.collect()]
    assert sum(sizes) == 900 and max(sizes) <= 120
    probes, depth, reached = index.calibrated(u, 5, barred, 3)
    found = index.search(u, 5, barred, 3, probes, depth)
    exact = vector_search.exact_top_k(u, v, 5, barred, 3)
    assert reached >= 0.9 and vector_index.recall(found, exact) >= 0.9
    assert found.join(exact.withColumnRenamed("score", "s"), ["user_id", "item_id"]).filter("score <> s").count() == 0
    # All lists and all candidates: nothing is lost.
    assert vector_index.recall(index.search(u, 5, barred, 3, 1000, 900), exact) == 1
    assert found.groupBy("user_id").count().filter("count <> 5").count() == 0


def moved_sides(monkeypatch, module):
    """Rows of each side that `dealt` sends to pairs of groups."""
    rows, original = [], vector_search.dealt

    def counted(df, pair, tasks):
        rows.append(df.count())
        return original(df, pair, tasks)

    monkeypatch.setattr(module, "dealt", counted, raising=False)
    return rows


def test_vectors_without_structure_move_once_a_pair_of_groups(spark, monkeypatch):
    """Bounds rule nothing out here: chunks x leaves must not be what is shuffled."""
    monkeypatch.setattr(vector_search, "ITEM_BLOCK", 16)
    monkeypatch.setattr(vector_search, "USER_BLOCK", 8)
    rows = moved_sides(monkeypatch, vector_search)
    both = np.random.default_rng(8).normal(size=(300, 24))
    nobody = spark.createDataFrame([], "user_id bigint, item_id bigint")
    found = vector_search.exact_top_k(vectors(spark, both[:80], "user_id"), vectors(spark, both, "item_id"), 5, nobody, 3)
    assert lists_of(found) == full_sort(both[:80], both, [], 5, 3)
    chunks, leaves = 80, 300 // 16
    assert len(rows) == 2 and rows[0] <= chunks * vector_search.LEAST_GROUPS and rows[1] <= 300 * vector_search.LEAST_GROUPS
    assert rows[0] < chunks * leaves / 2


def test_a_search_of_all_lists_moves_a_user_once_a_group(spark, monkeypatch):
    rows = moved_sides(monkeypatch, vector_index)
    both = np.random.default_rng(9).normal(size=(400, 8))
    nobody = spark.createDataFrame([], "user_id bigint, item_id bigint")
    v = vectors(spark, both, "item_id")
    index = vector_index.InvertedIndex.build(v, 3, list_rows=8, slices=4)
    lists = index.lists.count()
    found = index.search(vectors(spark, both[:20], "user_id"), 5, nobody, 3, lists, 400)
    assert lists_of(found) == full_sort(both[:20], both, [], 5, 3)
    assert rows and rows[0] <= 20 * vector_search.LEAST_GROUPS < 20 * lists


@pytest.fixture(scope="module")
def fitted(spark, events, items, users):
    """Clicks planted by user and author parity, so there is something to learn."""
    author = items.select("item_id", "author_id")
    planted = events.join(author, "item_id", "left").withColumn(
        "is_click", ((F.col("user_id") + F.coalesce("author_id", F.lit(0))) % 2 == 0).cast("int")
    )
    fit = tables.fit_window(planted, AS_OF).drop("author_id").persist()
    catalog = cat.build_catalog(items, fit).persist()
    model = two_tower.TwoTowerRetriever(items, users, SMALL, 5).fit(fit, catalog, AS_OF)
    return planted, model, catalog


def test_training_lowers_the_loss_and_gives_unit_vectors(fitted):
    _, model, catalog = fitted
    assert model.losses[-1] < model.losses[0]
    rows = model.item_vectors.collect()
    assert len(rows) == catalog.count()
    assert np.linalg.norm([r["vector"] for r in rows], axis=1) == pytest.approx(np.ones(len(rows)))


def test_planted_affinity_beats_random(fitted):
    planted, model, _ = fitted
    shown = tables.eval_set(planted, "val_random")
    got = {r["metric"]: r["value"] for r in evaluate_ranking(model, shown, ["is_click"], [3]).collect()}
    assert got["gauc"] > 0.55


def test_several_shards_train_and_unknown_users_get_vectors(spark, fitted, items, users):
    planted, _, catalog = fitted
    fit = tables.fit_window(planted, AS_OF).drop("author_id")
    params = TwoTowerParams(**{**SMALL.__dict__, "shard_rows": 100, "epochs": 2, "max_examples": 350})
    model = two_tower.TwoTowerRetriever(items, users, params, 5).fit(fit, catalog, AS_OF)
    assert model.losses[-1] < model.losses[0]
    people = spark.createDataFrame([(0,), (29,), (999,)], "user_id bigint")
    rows = model.embed_users(people).collect()
    assert {r["user_id"] for r in rows} == {0, 29, 999}
    assert np.linalg.norm([r["vector"] for r in rows], axis=1) == pytest.approx(np.ones(3))


def test_shards_in_turn_learn_like_one_and_side_by_side_nearly_so(spark, fitted, items, users):
    planted, _, catalog = fitted
    fit = tables.fit_window(planted, AS_OF).drop("author_id")
    n = fit.filter("is_click = 1").join(catalog, "item_id", "left_semi").count()

    def losses(shards, parallel):
        sizes = {"shard_rows": -(-n // shards), "parallel_shards": parallel, "batch_size": 16, "epochs": 3}
        model = two_tower.TwoTowerRetriever(items, users, TwoTowerParams(**{**SMALL.__dict__, **sizes}), 5)
        model.fit(fit, catalog, AS_OF)
        assert model.examples_seen == [n] * 3
        return model.losses

    one = losses(1, 1)
    assert losses(16, 1)[-1] == pytest.approx(one[-1], rel=0.1)
    assert losses(4, 4)[-1] == pytest.approx(one[-1], rel=0.3)
    # Sixteen side by side take a sixteenth of the steps: they fall as steadily, later.
    wide = losses(16, 16)
    assert wide[2] < wide[1] < wide[0] and wide[2] < 1.5 * one[-1]


def test_shards_have_rounds_and_lanes_of_growing_width():
    model = two_tower.TwoTowerRetriever(None, None, TwoTowerParams(parallel_shards=8))
    places = [model._place(s) for s in range(400)]
    assert len(set(places)) == 400 and places[:4] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    width = defaultdict(int)
    for number, lane in places:
        width[number] = max(width[number], lane + 1)
    assert [width[r] for r in (0, 15, 16, 31, 32, 40)] == [2, 2, 4, 4, 8, 8]


def test_default_rounds_spread_over_tasks_and_learn_like_one(spark, items, users):
    """Batches of a round side by side, never in one task, end near the loss of one step a batch."""
    n = 70_000
    row = F.col("id")
    user = F.pmod(F.xxhash64(row), F.lit(28))
    item = F.pmod(F.xxhash64(row, F.lit(1)), F.lit(20)) * 2 + user % 2
    fit = spark.range(n).select(
        user.alias("user_id"), item.alias("item_id"), F.date_add(F.lit(DAY0), (row % 8).cast("int")).alias("date"),
        row.alias("time_ms"), F.lit(1).alias("is_click"),
    )
    catalog = cat.build_catalog(items, fit).persist()
    narrow = {"max_history": 5, "max_tags": 2, "field_dim": 4, "user_field_dim": 2, "hidden": 16, "dim": 8}

    def fitted(**sizes):
        model = two_tower.TwoTowerRetriever(items, users, TwoTowerParams(**narrow, **sizes), 5)
        model.prepare(fit, catalog, AS_OF)
        model.train()
        assert model.examples_seen == [n] * 2
        return model

    default, one = fitted(), fitted(shard_rows=n, parallel_shards=1)
    assert one.steps == 2 * -(-n // 2048) and default.steps >= one.steps / 2
    assert set(default.widths) == {2} and set(one.widths) == {1}
    print("losses", default.losses, one.losses)
    assert default.losses[-1] == pytest.approx(one.losses[-1], rel=0.04)


def test_rounds_in_a_row_in_one_task_train_like_jobs(spark, items, users, monkeypatch):
    """Few shards a round: one job trains a stretch of rounds, with the results of a job a round."""
    n = 3_000
    row = F.col("id")
    user = F.pmod(F.xxhash64(row), F.lit(28))
    item = F.pmod(F.xxhash64(row, F.lit(1)), F.lit(20)) * 2 + user % 2
    fit = spark.range(n).select(
        user.alias("user_id"), item.alias("item_id"), F.date_add(F.lit(DAY0), (row % 8).cast("int")).alias("date"),
        row.alias("time_ms"), F.lit(1).alias("is_click"),
    )
    catalog = cat.build_catalog(items, fit).persist()
    # a shard is a batch: the order of equal items in a shard is not fixed and would deal them to other batches
    params = TwoTowerParams(max_history=5, max_tags=2, field_dim=4, user_field_dim=2, hidden=16, dim=8, batch_size=512, epochs=1, shard_rows=250)
    monkeypatch.setattr(two_tower, "RAMP", 4)
    written, original = [], two_tower.materialize
    monkeypatch.setattr(two_tower, "materialize", lambda df, name, *rest: written.append(name) or original(df, name, *rest))

    def fitted():
        written.clear()
        model = two_tower.TwoTowerRetriever(items, users, params, 5)
        model.prepare(fit, catalog, AS_OF)
        model.train()
        rows = {(r["tab"], r["id"]): r["vec"] for r in model.tables.collect()}
        return model, rows, written.count("changes")

    in_a_row, rows, few = fitted()
    monkeypatch.setattr(two_tower, "TURN_WORK", 0)
    job_by_job, rows_by_job, many = fitted()
    assert in_a_row.widths == job_by_job.widths == [2] * 4 + [4] and (few, many) == (2, 5)
    assert in_a_row.examples_seen == job_by_job.examples_seen == [n] and in_a_row.steps == job_by_job.steps
    assert in_a_row.losses == pytest.approx(job_by_job.losses, rel=1e-9)
    for name, weights in in_a_row.weights.items():
        assert weights == pytest.approx(job_by_job.weights[name], abs=1e-9), name
    assert rows.keys() == rows_by_job.keys()
    assert max(np.abs(np.subtract(rows[k], rows_by_job[k])).max() for k in rows) < 1e-9


def test_tasks_bring_the_parameters_along():
    """Executors have no install: nothing a task gets may be looked up by module."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import sys, pickle; print(pickle.load(sys.stdin.buffer)(2048))"
    sent = cloudpickle.dumps(lambda size: TwoTowerParams(batch_size=size).batch_size)
    found = subprocess.run([sys.executable, "-I", "-c", code], input=sent, capture_output=True, cwd="/")
    assert found.stdout.split() == [b"2048"], found.stderr
