"""Item-item collaborative filtering on items that share users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.stats import global_rank
from reelspark.operators.recommend import Recommender, item_tie, top_k, walk_shared_order
from reelspark.session import materialize

# Similarities are summed as whole numbers of 1e-15, so a sum does not depend
# on the order in which rows arrive and equal scores stay equal.
UNIT = 1_000_000_000_000_000
POPULARITY_UNITS = 1_000_000_000  # 1e-6 in those units


def user_histories(interactions: DataFrame, signal: str, max_history: int) -> DataFrame:
    """Each user's latest `max_history` distinct positives, by their latest event."""
    latest = (
        interactions.filter(F.col(signal) == 1)
        .groupBy("user_id", "item_id")
        .agg(F.max(F.struct("date", "time_ms")).alias("_last"))
    )
    recent = Window.partitionBy("user_id").orderBy(F.col("_last").desc(), F.col("item_id").desc())
    kept = latest.withColumn("_rank", F.row_number().over(recent)).filter(F.col("_rank") <= max_history)
    return kept.select("user_id", "item_id")


def history_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_users"))


def co_users(history: DataFrame) -> DataFrame:
    """Users shared by each item pair `(item_a < item_b, n_a, n_b, n_both)`.

    A history holds at most `max_history` items, so a user makes a bounded
    number of pairs; each unordered pair is made once and counted map-side.
    """
    counted = history.join(history_counts(history), "item_id")
    lists = counted.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "n_users"))).alias("_items"))
    heads = lists.select("_items", F.posexplode("_items").alias("_at", "_a"))
    rest = F.slice(F.col("_items"), F.col("_at") + 2, F.greatest(F.size("_items") - F.col("_at") - 1, F.lit(0)))
    pairs = heads.select("_a", F.explode(rest).alias("_b"))
    return pairs.groupBy(F.col("_a.item_id").alias("item_a"), F.col("_b.item_id").alias("item_b")).agg(
        F.max("_a.n_users").alias("n_a"), F.max("_b.n_users").alias("n_b"), F.count(F.lit(1)).alias("n_both")
    )


def item_similarities(pairs: DataFrame, shrinkage: float) -> DataFrame:
    """Damped cosine in both directions: `(src_item, dst_item, sim)`, no diagonal."""
    cosine = F.col("n_both") / (F.sqrt(F.col("n_a").cast("double") * F.col("n_b").cast("double")) + F.lit(shrinkage))
    both_ways = F.array(
        F.struct(F.col("item_a").alias("src_item"), F.col("item_b").alias("dst_item")),
        F.struct(F.col("item_b").alias("src_item"), F.col("item_a").alias("dst_item")),
    )
    return pairs.select(cosine.alias("sim"), F.inline(both_ways)).select("src_item", "dst_item", "sim")


def top_neighbors(similarities: DataFrame, n: int) -> DataFrame:
    """The n most similar items of each source item."""
    best = Window.partitionBy("src_item").orderBy(F.col("sim").desc(), F.col("dst_item"))
    return similarities.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= n).drop("_rank")


class ItemCooccurrence(Recommender):
    """Score = summed similarity of the user's history to the item, popularity as tie-break."""

    name = "item_cooc"

    def __init__(
        self, signal: str = "is_click", top_neighbors: int = 200, shrinkage: float = 10.0, max_history: int = 200
    ):
        self.signal, self.n_neighbors = signal, top_neighbors
        self.shrinkage, self.max_history = float(shrinkage), max_history

    def fit(self, interactions: DataFrame, catalog: DataFrame, as_of) -> ItemCooccurrence:
        self.history = materialize(user_histories(interactions, self.signal, self.max_history), "histories")
        counts = history_counts(self.history)
        nearest = top_neighbors(item_similarities(co_users(self.history), self.shrinkage), self.n_neighbors)
        units = F.floor(F.col("sim") * UNIT).cast("bigint")
        self.similarities = materialize(nearest.withColumn("units", units), "similarities")
        most = counts.agg(F.max("n_users")).scalar()
        n_users = F.coalesce(F.col("n_users"), F.lit(0)).cast("double")
        share = n_users / F.greatest(F.coalesce(most, F.lit(1)), F.lit(1)).cast("double")
        base = F.floor(share * POPULARITY_UNITS).cast("bigint").alias("base")
        self.popularity = materialize(
            catalog.select("item_id").join(counts, "item_id", "left").select("item_id", base), "popularity"
        )
        return self

    def score_pairs(self, pairs: DataFrame) -> DataFrame:
        """Each pair's history is looked up first, then its similarity to the pair's item."""
        wanted = pairs.select("user_id", "item_id").distinct()
        sims = self.similarities.select(F.col("src_item"), F.col("dst_item").alias("item_id"), "units")
        matched = (
            wanted.join(self.history.select("user_id", F.col("item_id").alias("src_item")), "user_id")
            .join(sims, ["src_item", "item_id"])
            .groupBy("user_id", "item_id")
            .agg(F.sum("units").alias("_units"))
        )
        total = F.coalesce("_units", F.lit(0)) + F.col("base")
        return (
            pairs.join(self.popularity.select("item_id", "base"), "item_id")
            .join(matched, ["user_id", "item_id"], "left")
            .withColumn("score", total.cast("double") / F.lit(float(UNIT)))
            .drop("_units", "base")
        )

    def candidates(self, users: DataFrame) -> DataFrame:
        """Summed similarity of every neighbour of a user's history."""
        mine = self.history.join(users.select("user_id"), "user_id", "left_semi")
        return (
            mine.withColumnRenamed("item_id", "src_item")
            .join(self.similarities.select("src_item", F.col("dst_item").alias("item_id"), "units"), "src_item")
            .groupBy("user_id", "item_id")
            .agg(F.sum("units").alias("units"))
        )

    def recommend(self, users, k, exclusions, available, seed) -> DataFrame:
        """Best k of the neighbours and the k most popular items not excluded.

        Similarities are not negative, so an item outside both sets has k items
        ahead of it and can never be listed.
        """
        listable = self.popularity.join(available.select("item_id"), "item_id", "left_semi")
        ranked = materialize(global_rank(listable, "base", "item_id", seed).select("item_id", "position"), "ranked")
        popular = walk_shared_order(users, k, exclusions, ranked)
        near = self.candidates(users).join(exclusions, ["user_id", "item_id"], "left_anti")
        pool = near.unionByName(popular.select("user_id", "item_id", F.lit(0).cast("bigint").alias("units")))
        scored = (
            pool.groupBy("user_id", "item_id")
            .agg(F.sum("units").alias("units"))
            .join(listable.select("item_id", "base"), "item_id")
            .withColumn("score", F.col("units") + F.col("base"))
        )
        return top_k(scored, k, F.col("score"), item_tie(seed)).select("user_id", "item_id", "rank")
