"""A recommender that lists the same much-liked items to everyone."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.stats import global_rank
from reelspark.operators.recommend import Recommender, walk_shared_order
from reelspark.session import materialize


class MostPopular(Recommender):
    """Score of an item: its rows with `signal` set, all of them or those of the `window_days` days before `as_of`.

    Catalog items without such rows score zero, so every listable item has a place.
    """

    def __init__(self, signal: str = "is_click", window_days: int | None = None):
        self.signal = signal
        self.window_days = window_days

    @property
    def name(self) -> str:
        return f"recent_popular_{self.window_days}d" if self.window_days is not None else "most_popular"

    def fit(self, interactions: DataFrame, catalog: DataFrame, as_of) -> MostPopular:
        rows = interactions.filter(F.col(self.signal) == 1)
        if self.window_days is not None:
            rows = rows.filter(F.col("date") >= F.lit(as_of - timedelta(days=self.window_days)))
        counts = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("_count"))
        scores = catalog.select("item_id").join(counts, "item_id", "left")
        self.item_scores = materialize(
            scores.select("item_id", F.coalesce("_count", F.lit(0)).cast("double").alias("score")), self.name
        )
        return self

    def score_pairs(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.item_scores, "item_id")

    def ranked(self, available: DataFrame, seed) -> DataFrame:
        """Available items in popularity order: `(item_id, position)`."""
        listable = self.item_scores.join(available.select("item_id"), "item_id", "left_semi")
        return materialize(global_rank(listable, "score", "item_id", seed).select("item_id", "position"), "ranked")

    def recommend(self, users, k, exclusions, available, seed) -> DataFrame:
        return walk_shared_order(users, k, exclusions, self.ranked(available, seed))
