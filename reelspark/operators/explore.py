"""Exploratory queries over the processed interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import bitmaps, stats
from reelspark.params import SOURCES


def overlap_window(interactions: DataFrame) -> DataFrame:
    """Rows on days on or after the first random-log day, so both logs cover the same days."""
    first = interactions.filter(F.col("source") == "random").agg(F.min("date").alias("first_random_day"))
    return interactions.filter(F.col("date") >= first.scalar())


def overview(interactions: DataFrame) -> DataFrame:
    ids = {"users": F.col("user_id"), "items": F.col("item_id")}
    out = bitmaps.totals(interactions, ["source", "split"], ids, {"rows": F.lit(1).cast("bigint")}, F.col("date"))
    days = [F.col(n).cast("string").alias(f"{n}_day") for n in ("first", "last")]
    return out.select("source", "split", "rows", "users", "items", *days)


def feedback_rates(interactions: DataFrame) -> DataFrame:
    """Mean labels per source; the play ratio is capped at 3 and null on zero duration."""
    played = F.col("play_time_ms") / F.nullif(F.col("duration_ms"), F.lit(0))
    return (
        overlap_window(interactions)
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("impressions"),
            F.avg("is_click").alias("click_rate"),
            F.avg("long_view").alias("long_view_rate"),
            F.avg("is_like").alias("like_rate"),
            F.avg(F.when(played.isNotNull(), F.least(played, F.lit(3.0)))).alias("play_ratio"),
        )
    )


def item_exposure(interactions: DataFrame) -> DataFrame:
    """Impressions per item and source over every item either source logged, zeros included."""
    return overlap_window(interactions).groupBy("item_id").agg(
        *[F.count_if(F.col("source") == s).alias(f"{s}_impressions") for s in SOURCES]
    )


def _exposure_histogram(interactions: DataFrame) -> DataFrame:
    per_source = item_exposure(interactions).select(
        F.inline(
            F.array(
                *[F.struct(F.lit(s).alias("source"), F.col(f"{s}_impressions").alias("n")) for s in SOURCES]
            )
        )
    )
    return stats.count_histogram(per_source, ["source"])


def exposure_concentration(interactions: DataFrame) -> DataFrame:
    """Items shown, share of the most shown 1 % of all items, and Gini, per source."""
    shares = stats.concentration(_exposure_histogram(interactions), ["source"])
    return shares.select("source", "items_shown", "top_1pct_share", "gini")


def lorenz_curve(interactions: DataFrame) -> DataFrame:
    """Corners of the Lorenz curve per source, one per distinct count."""
    return stats.lorenz_points(_exposure_histogram(interactions), ["source"])


def exposure_vs_quality(interactions: DataFrame, min_random_impressions: int = 20, buckets: int = 5) -> DataFrame:
    """Random-log click rate of items bucketed by how often the policy showed them.

    `ntile` is computed from a distributed rank: items are ordered by standard
    exposure and a hash of the id, and the bucket follows from the rank and the total.
    """
    shown = (
        overlap_window(interactions)
        .filter(F.col("source") == "standard")
        .groupBy("item_id")
        .agg(F.count(F.lit(1)).alias("shown"))
    )
    measured = (
        interactions.filter(F.col("source") == "random")
        .groupBy("item_id")
        .agg(F.count(F.lit(1)).alias("random_rows"), F.avg("is_click").alias("click_rate"))
        .filter(F.col("random_rows") >= min_random_impressions)
    )
    # minus the exposure, so that the descending rank starts at the least shown item
    joined = measured.join(shown, "item_id", "left").withColumn("_order", -F.coalesce("shown", F.lit(0)))
    ranked = stats.global_rank(joined, "_order", "item_id", "ntile")
    total = joined.agg(F.count(F.lit(1)).alias("items")).scalar()
    size, larger = F.floor(total / buckets), total % buckets
    rank = F.col("position") - 1
    edge = larger * (size + 1)
    bucket = F.when(rank < edge, F.floor(rank / (size + 1))).otherwise(
        larger + F.floor((rank - edge) / F.greatest(size, F.lit(1)))
    )
    return (
        ranked.withColumn("standard_exposure_bucket", (bucket + 1).cast("bigint"))
        .groupBy("standard_exposure_bucket")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.percentile(-F.col("_order"), F.lit(0.5)).alias("median_standard_impr"),
            F.avg("click_rate").alias("random_click_rate"),
        )
    )


def sparsity(interactions: DataFrame) -> DataFrame:
    """Share of observed (user, item) pairs, and impressions per user."""
    per_user = (
        interactions.groupBy("source", "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("source", "n")
        .agg(F.count(F.lit(1)).alias("m"))
        .groupBy("source")
        .agg(
            F.percentile("n", F.lit(0.5), F.col("m")).alias("median_impr_per_user"),
            F.percentile("n", F.lit(0.9), F.col("m")).alias("p90_impr_per_user"),
        )
    )
    # A user's items of one source as words of bits: fewer rows than pairs, and the same row gives the source's items.
    seen = interactions.select("source", "user_id", bitmaps.word(F.col("item_id")).alias("word"), bitmaps.bit(F.col("item_id")).alias("bit"))
    seen = seen.groupBy("source", "user_id", "word").agg(F.bit_or("bit").alias("bits"))
    pairs = seen.groupBy("source").agg(F.sum(F.when(F.col("bits").isNull(), 1).otherwise(F.bit_count("bits"))).alias("pairs"))
    one = {"rows": F.lit(1).cast("bigint")}
    sides = bitmaps.totals(interactions, ["source"], {"users": F.col("user_id"), "items": F.col("item_id")}, one)
    cells = F.nullif(F.col("users").cast("double") * F.col("items").cast("double"), F.lit(0.0))
    density = pairs.join(sides, "source").select("source", (F.col("pairs") / cells).alias("density"))
    return density.join(per_user, "source")


def daily_volume(interactions: DataFrame) -> DataFrame:
    """Impressions per day, one column per source, 0 where absent."""
    return interactions.groupBy("date").agg(*[F.count_if(F.col("source") == s).alias(s) for s in SOURCES])


def tab_mix(interactions: DataFrame) -> DataFrame:
    """Per tab: its share of each source's impressions and its click rate there."""
    per_tab = overlap_window(interactions).groupBy("source", "tab").agg(
        F.count(F.lit(1)).alias("n"), F.avg("is_click").alias("click_rate")
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy("source"))
    shares = per_tab.withColumn("share", share)

    def of(source: str, column: str) -> F.Column:
        return F.max(F.when(F.col("source") == source, F.col(column))).alias(f"{source}_{column}")

    return shares.groupBy("tab").agg(*[of(s, c) for c in ("share", "click_rate") for s in SOURCES])


def within_user_rates(interactions: DataFrame, labels=("is_click", "long_view"), min_each: int = 5) -> DataFrame:
    """Standard vs random rates within users who have enough rows in both logs."""

    def rows(source: str) -> F.Column:
        return F.count_if(F.col("source") == source)

    def rate(source: str, label: str) -> F.Column:
        return F.avg(F.when(F.col("source") == source, F.col(label)))

    per_user = (
        overlap_window(interactions)
        .groupBy("user_id")
        .agg(
            *[rows(s).alias(f"_n_{s}") for s in SOURCES],
            *[rate(s, label).alias(f"{label}_{s}") for label in labels for s in SOURCES],
        )
        .filter((F.col("_n_standard") >= min_each) & (F.col("_n_random") >= min_each))
    )
    long = per_user.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(label).alias("label"),
                        F.col(f"{label}_standard").alias("standard"),
                        F.col(f"{label}_random").alias("random"),
                    )
                    for label in labels
                ]
            )
        )
    )
    return long.groupBy("label").agg(
        F.count(F.lit(1)).alias("users"),
        F.avg("standard").alias("standard_rate"),
        F.avg("random").alias("random_rate"),
        F.avg(F.col("standard") - F.col("random")).alias("mean_difference"),
        F.avg((F.col("standard") > F.col("random")).cast("double")).alias("share_users_higher_on_standard"),
    )
