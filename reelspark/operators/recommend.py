"""The model protocol and the top-k building blocks shared by all models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.expressions import tie_key
from reelspark.session import broadcast_if_small

_SLOT_CHUNK = 10_000


class Recommender:
    """A model over DataFrames.

    `fit` keeps model tables, `score_pairs` adds a `score` to the (user, item)
    pairs it can score and drops the others, and `recommend` returns
    `(user_id, item_id, rank)` with at most k rows per user.
    """

    name = "recommender"

    def fit(self, interactions: DataFrame, catalog: DataFrame, as_of) -> Recommender:
        raise NotImplementedError

    def score_pairs(self, pairs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def recommend(self, users: DataFrame, k: int, exclusions: DataFrame, available: DataFrame, seed) -> DataFrame:
        raise NotImplementedError(f"{self.name} lists items by no path of its own; users are never paired with a whole catalog")


def top_k(scores: DataFrame, k: int, order: Column, tie: list[Column], by: str = "user_id") -> DataFrame:
    """Best k rows per group by (order desc, tie asc), with their `rank`.

    `rank <= k` directly above the window lets Spark prune each group to k rows
    before the shuffle, so a huge group sends k rows per task.
    """
    best = Window.partitionBy(by).orderBy(order.desc(), *[t.asc() for t in tie])
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def item_tie(seed, item: str = "item_id") -> list[Column]:
    return [tie_key(seed, F.col(item)), F.col(item)]


def numbered_slots(users: DataFrame, n: Column, name: str = "slot") -> DataFrame:
    """Rows 0..n-1 per user; generated in chunks, so no long array is ever built."""
    last = F.floor((n - 1) / _SLOT_CHUNK).cast("bigint")
    chunked = users.withColumn("_n", n.cast("bigint")).filter("_n > 0").withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    )
    start = F.col("_chunk") * _SLOT_CHUNK
    end = F.least(start + (_SLOT_CHUNK - 1), F.col("_n") - 1)
    return chunked.withColumn(name, F.explode(F.sequence(start, end))).drop("_n", "_chunk")


def with_barred_count(users: DataFrame, barred: DataFrame) -> DataFrame:
    """Users with `_barred`, the number of listable items barred for them."""
    counts = barred.groupBy("user_id").agg(F.count(F.lit(1)).alias("_barred"))
    return users.join(counts, "user_id", "left").withColumn("_barred", F.coalesce("_barred", F.lit(0)))


def walk_shared_order(users: DataFrame, k: int, exclusions: DataFrame, ranked: DataFrame) -> DataFrame:
    """First k items per user of one shared order, skipping the user's exclusions.

    `ranked` holds `(item_id, position)` with positions 1.. . A user with e
    exclusions needs at most the first k + e positions, so the rows made are
    users x k plus the exclusions themselves; items never meet users in a product.
    """
    barred = exclusions.join(ranked, "item_id").select("user_id", "position")
    slots = numbered_slots(with_barred_count(users, barred), F.col("_barred") + k)
    open_slots = slots.select("user_id", (F.col("slot") + 1).alias("position")).join(
        barred, ["user_id", "position"], "left_anti"
    )
    listed = top_k(open_slots, k, -F.col("position"), [])
    # every user lists the same few positions, so the head they reach is
    # broadcast if it is short and looked up by a skew-split join if not
    longest = barred.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
    head = broadcast_if_small(ranked.filter(F.col("position") <= longest + k))
    return listed.join(head, "position").select("user_id", "item_id", "rank")
