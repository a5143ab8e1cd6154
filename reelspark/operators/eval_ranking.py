"""Impression-list ranking metrics: AUC, GAUC and NDCG with bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import stats
from reelspark.functions.expressions import hash_number
from reelspark.operators.eval_retrieval import ideal_dcg
from reelspark.operators.recommend import Recommender
from reelspark.session import materialize


def exposures(eval_df: DataFrame, labels, group_by: str = "user") -> DataFrame:
    """One row per (user, item) or (user, item, date); a label is 1 if it ever was."""
    keys = ["user_id", "item_id"] + (["date"] if group_by == "user_date" else [])
    return eval_df.groupBy(*keys).agg(*[F.max(label).alias(label) for label in labels])


def with_group(scored: DataFrame, group_by: str = "user") -> DataFrame:
    parts = ["user_id", "date"] if group_by == "user_date" else ["user_id"]
    return scored.withColumn("group_id", F.concat_ws("|", *[F.col(p).cast("string") for p in parts]))


def by_label(df: DataFrame, keep: list[str], labels) -> DataFrame:
    """Long form over labels: `label`, `y`."""
    pairs = F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).cast("bigint").alias("y")) for n in labels])
    return df.select(*keep, F.inline(pairs))


def group_auc(scored: DataFrame, labels) -> DataFrame:
    """AUC per label and group, groups with one class dropped; `n` is the group's size."""
    long = by_label(scored, ["group_id", "score"], labels)
    found = stats.grouped_auc(long, ["label", "group_id"], "y", "score").filter(F.col("auc").isNotNull())
    return found.select("label", "group_id", (F.col("pos") + F.col("neg")).alias("n"), "auc")


def group_ndcg(scored: DataFrame, labels, ks, seed) -> DataFrame:
    """NDCG@k per label and group that has a positive; score ties in hashed order."""
    longest = max(ks)
    shuffled = hash_number(seed, F.col("group_id"), F.col("item_id"))
    order = Window.partitionBy("group_id").orderBy(F.col("score").desc(), shuffled, F.col("item_id"))
    listed = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= longest)
    gains = (
        by_label(listed, ["group_id", "rank"], labels)
        .groupBy("label", "group_id")
        .agg(*[F.sum(F.when(F.col("rank") <= k, F.col("y") / F.log2(F.col("rank") + 1))).alias(f"_dcg_{k}") for k in ks])
    )
    totals = (
        by_label(scored, ["group_id"], labels)
        .groupBy("label", "group_id")
        .agg(F.sum("y").alias("_pos"))
        .filter("_pos > 0")
    )
    return totals.join(gains, ["label", "group_id"]).select(
        "label",
        "group_id",
        *[
            (F.col(f"_dcg_{k}") / ideal_dcg(F.least(F.col("_pos"), F.lit(k)), k)).alias(f"ndcg_{k}")
            for k in ks
        ],
    )


def evaluate_ranking(
    model: Recommender,
    eval_df: DataFrame,
    labels,
    ks,
    group_by: str = "user",
    gauc_weight: str = "impressions",
    seed: int = 0,
    n_boot: int = 0,
) -> DataFrame:
    """Ranking metrics of a fitted model: `(label, metric, k, value, ci_lo, ci_hi)`."""
    scored = with_group(model.score_pairs(exposures(eval_df, labels, group_by)), group_by)
    return ranking_metrics(materialize(scored, "scored"), labels, ks, gauc_weight, seed, n_boot)


def ranking_metrics(scored: DataFrame, labels, ks, gauc_weight="impressions", seed=0, n_boot: int = 0) -> DataFrame:
    """Metrics of scored impressions with `group_id`, `item_id`, `score` and label columns."""
    no_k, none = F.lit(None).cast("int"), F.lit(None).cast("double")

    def plain(df: DataFrame, metric: str, value, k=no_k) -> DataFrame:
        return df.select("label", F.lit(metric).alias("metric"), k.alias("k"), value.cast("double").alias("value"))

    overall = stats.grouped_auc(by_label(scored, ["score"], labels), ["label"], "y", "score")
    weight = F.col("n").cast("double") if gauc_weight == "impressions" else F.lit(1.0)
    groups = materialize(group_auc(scored, labels).withColumn("w", weight), "group-auc")
    gauc = groups.groupBy("label").agg(
        (F.sum(F.col("auc") * F.col("w")) / F.sum("w")).alias("value"), F.count(F.lit(1)).alias("groups")
    )
    lists = materialize(group_ndcg(scored, labels, ks, seed), "group-ndcg")
    long_lists = lists.select(
        "label",
        "group_id",
        F.lit(1.0).alias("w"),
        F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"ndcg_{k}").alias("ndcg")) for k in ks])),
    )
    ndcg = long_lists.groupBy("label", "k").agg(F.avg("ndcg").alias("value"), F.count(F.lit(1)).alias("groups"))
    out = plain(overall, "auc", F.col("auc"))
    out = out.unionByName(plain(overall, "n_impressions", F.col("pos") + F.col("neg")))
    out = out.unionByName(plain(gauc, "gauc_groups", F.col("groups")))
    out = out.unionByName(plain(gauc, "gauc", F.col("value")))
    out = out.unionByName(plain(ndcg, "ndcg", F.col("value"), F.col("k")))
    out = out.unionByName(plain(ndcg.filter(F.col("k") == max(ks)), "ndcg_groups", F.col("groups")))
    if not n_boot:
        return out.withColumns({"ci_lo": none, "ci_hi": none})
    gauc_ci = stats.bootstrap_interval(groups, ["label"], ["group_id"], "auc", "w", n_boot, seed)
    ndcg_ci = stats.bootstrap_interval(long_lists, ["label", "k"], ["group_id"], "ndcg", "w", n_boot, seed)
    bounds = gauc_ci.select("label", F.lit("gauc").alias("metric"), F.lit(-1).alias("_k"), "ci_lo", "ci_hi").unionByName(
        ndcg_ci.select("label", F.lit("ndcg").alias("metric"), F.col("k").alias("_k"), "ci_lo", "ci_hi")
    )
    keyed = out.withColumn("_k", F.coalesce("k", F.lit(-1)))
    return keyed.join(bounds, ["label", "metric", "_k"], "left").drop("_k")
