"""Full-catalog retrieval metrics from recommended lists and targets."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import stats
from reelspark.operators.catalog import available_items, retrieval_targets
from reelspark.operators.recommend import Recommender
from reelspark.session import materialize


def item_information(fit_df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Surprise of each catalog item, -log2 of its smoothed impression share."""
    counts = fit_df.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    known = catalog.select("item_id", "category").join(counts, "item_id", "left")
    known = known.withColumn("_n", F.coalesce("_n", F.lit(0)).cast("double"))
    norm = known.agg(F.sum("_n") + F.count(F.lit(1))).scalar()
    return known.select("item_id", "category", (-F.log2((F.col("_n") + 1) / norm)).alias("information"))


def ideal_dcg(n: Column, longest: int) -> Column:
    """DCG of n hits at the top; a constant lookup, n at most `longest`."""
    sums, total = [], 0.0
    for rank in range(1, longest + 1):
        total += 1.0 / log2(rank + 1)
        sums.append(total)
    table = F.array(*[F.lit(s) for s in sums])
    return F.element_at(table, F.greatest(F.least(n, F.lit(longest)), F.lit(1)).cast("int"))


def hit_lists(recommended: DataFrame, targets: DataFrame) -> DataFrame:
    """Recommended rows with a 0/1 `hit`."""
    marked = targets.select("user_id", "item_id", F.lit(1).alias("_target"))
    joined = recommended.join(marked, ["user_id", "item_id"], "left")
    return joined.withColumn("hit", F.coalesce("_target", F.lit(0))).drop("_target")


def user_metrics(hits: DataFrame, targets: DataFrame, ks, width: int, diversity_k: int) -> DataFrame:
    """One row per evaluated user with recall, hit, NDCG, novelty and diversity.

    `hits` needs `hit`, `rank`, `category` and `information`. All metrics come
    from one aggregation by user.
    """
    depth = min(diversity_k, width)
    rank, gain = F.col("rank"), F.col("hit") / F.log2(F.col("rank") + 1)
    columns = [F.collect_list(F.when(rank <= depth, F.col("category"))).alias("_cats")]
    for k in ks:
        inside = rank <= k
        columns += [
            F.sum(F.when(inside, F.col("hit"))).alias(f"_hits_{k}"),
            F.sum(F.when(inside, gain)).alias(f"_dcg_{k}"),
            F.sum(F.when(inside, F.col("information"))).alias(f"_info_{k}"),
            F.count_if(inside).alias(f"_listed_{k}"),
        ]
    per_user = hits.groupBy("user_id").agg(*columns)
    sizes = targets.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_targets"))
    joined = sizes.join(per_user, "user_id", "left")
    n_targets = F.col("n_targets")
    out = ["user_id", "n_targets"]
    for k in ks:
        n_hits = F.coalesce(F.col(f"_hits_{k}"), F.lit(0)).cast("double")
        cut = min(k, width)
        dcg = F.coalesce(F.col(f"_dcg_{k}"), F.lit(0.0))
        listed = F.greatest(F.coalesce(F.col(f"_listed_{k}"), F.lit(0)), F.lit(1))
        out += [
            (n_hits / n_targets).alias(f"recall@{k}"),
            (n_hits > 0).cast("double").alias(f"hit@{k}"),
            (dcg / ideal_dcg(F.least(n_targets, F.lit(cut)), cut)).alias(f"ndcg@{k}"),
            (F.coalesce(F.col(f"_info_{k}"), F.lit(0.0)) / listed).alias(f"novelty@{k}"),
        ]
    if depth < 2:
        diversity = F.lit(0.0)
    else:
        cats = F.coalesce(F.col("_cats"), F.array().cast("array<bigint>"))
        same = F.aggregate(cats, F.lit(0), lambda acc, c: acc + F.size(F.filter(cats, lambda o: o == c)))
        pads = F.lit(depth) - F.size(cats)  # an empty slot is a category of its own
        diversity = (F.lit(float(depth * depth)) - same - pads) / float(depth * (depth - 1))
    return joined.select(*out, diversity.alias(f"ild@{diversity_k}"))


def list_concentration(recommended: DataFrame, available: DataFrame, ks) -> DataFrame:
    """Coverage and Gini at each k over all available items, zeros included: `(k, coverage, gini)`."""
    per_item = recommended.groupBy("item_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"_{k}") for k in ks])
    long = per_item.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("n")) for k in ks]))
    ).filter("n > 0")
    n_available = available.agg(F.count(F.lit(1)).alias("n")).scalar()
    shown = stats.count_histogram(long, ["k"])
    unshown = (
        shown.groupBy("k")
        .agg(F.sum("m").alias("_shown"))
        .select("k", F.lit(0).cast("bigint").alias("n"), (n_available - F.col("_shown")).alias("m"))
        .filter("m > 0")
    )
    shares = stats.concentration(shown.unionByName(unshown), ["k"])
    return shares.select("k", (F.col("items_shown") / F.col("items")).alias("coverage"), "gini")


def _mean_metrics(per_user: DataFrame) -> DataFrame:
    names = [c for c in per_user.columns if "@" in c]
    means = per_user.agg(
        *[F.avg(F.col(f"`{c}`")).alias(c) for c in names], F.count(F.lit(1)).cast("double").alias("n_users")
    )
    long = means.unpivot([], [F.col(f"`{c}`") for c in [*names, "n_users"]], "_name", "value")
    name = F.split_part(F.col("_name"), F.lit("@"), F.lit(1))
    k = F.split_part(F.col("_name"), F.lit("@"), F.lit(2)).try_cast("int")
    return long.select(name.alias("metric"), k.alias("k"), "value")


def evaluate_retrieval(
    model: Recommender,
    fit_df: DataFrame,
    eval_df: DataFrame,
    catalog: DataFrame,
    label: str,
    ks,
    users: str = "warm",
    exclude_fit_positives: bool = True,
    diversity_k: int = 10,
    seed: int = 0,
    width: int | None = None,
) -> DataFrame:
    """Retrieval metrics of a fitted model for one label: `(metric, k, value)`.

    `width` is the list length, by default the largest k; pass the catalog size
    where that is smaller.
    """
    width = min(max(ks), width or max(ks))
    last_day = eval_df.agg(F.max("date")).scalar()
    available = available_items(catalog, last_day)
    targets, exclusions = retrieval_targets(eval_df, fit_df, label, catalog, available, users, exclude_fit_positives)
    people = targets.select("user_id").distinct()
    # the lists feed the per-user and the per-item metrics
    recommended = materialize(model.recommend(people, width, exclusions, available, seed), "recommended")
    described = hit_lists(recommended, targets).join(item_information(fit_df, catalog), "item_id")
    metrics = _mean_metrics(user_metrics(described, targets, ks, width, diversity_k))
    spread = list_concentration(recommended, available, ks).select(
        F.col("k").cast("int").alias("k"),
        F.inline(
            F.array(
                F.struct(F.lit("coverage").alias("metric"), F.col("coverage").alias("value")),
                F.struct(F.lit("gini").alias("metric"), F.col("gini").alias("value")),
            )
        ),
    )
    return metrics.unionByName(spread.select("metric", "k", "value"))
