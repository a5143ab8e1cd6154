"""Uniformly random scores and lists, as functions of (seed, user, item)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.expressions import hash_number, hash_uniform
from reelspark.functions.stats import global_rank
from reelspark.operators.recommend import Recommender, numbered_slots, top_k, with_barred_count
from reelspark.session import materialize


def _next_prime(n: int) -> int:
    candidate = max(2, n)
    while any(candidate % d == 0 for d in range(2, int(candidate**0.5) + 1)):
        candidate += 1
    return candidate


class RandomRecommender(Recommender):
    """Random baseline; reproducible on any partitioning because nothing is drawn in sequence."""

    name = "random"

    def __init__(self, seed: int = 0):
        self.seed = seed

    def fit(self, interactions: DataFrame, catalog: DataFrame, as_of) -> RandomRecommender:
        self.catalog = catalog
        return self

    def score_pairs(self, pairs: DataFrame) -> DataFrame:
        known = pairs.join(self.catalog.select("item_id"), "item_id", "left_semi")
        return known.withColumn("score", hash_uniform(self.seed, F.col("user_id"), F.col("item_id")))

    def recommend(self, users, k, exclusions, available, seed) -> DataFrame:
        """Each user walks the catalog from a hashed start by a hashed stride.

        Modulo a prime at or above the catalog size any stride visits distinct
        positions, so k + exclusions + (prime - size) steps always suffice.
        """
        listable = available.select("item_id", F.lit(0).alias("_level"))
        ranked = global_rank(listable, "_level", "item_id", self.seed)
        ranked = materialize(ranked.select("item_id", (F.col("position") - 1).alias("position")), "positions")
        n_items = ranked.count()
        prime = _next_prime(n_items)
        barred = exclusions.join(ranked, "item_id").select("user_id", "position")
        steps = F.least(F.col("_barred") + k + (prime - n_items), F.lit(prime))
        start = hash_number(f"{self.seed}:start", F.col("user_id")) % prime
        stride = hash_number(f"{self.seed}:stride", F.col("user_id")) % (prime - 1) + 1
        walk = with_barred_count(users, barred).withColumns({"_start": start, "_stride": stride})
        visited = numbered_slots(walk, steps).withColumn(
            "position", (F.col("_start") + F.col("slot") * F.col("_stride")) % prime
        )
        allowed = visited.filter(F.col("position") < n_items).join(barred, ["user_id", "position"], "left_anti")
        listed = top_k(allowed.select("user_id", "position", "slot"), k, -F.col("slot"), [])
        return listed.join(ranked, "position").select("user_id", "item_id", "rank")
