"""Item catalog, positives and evaluation targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.expressions import primary_tag_category
from reelspark.session import materialize


def build_catalog(items: DataFrame, interactions: DataFrame) -> DataFrame:
    """Every item of the item table or the logs: `(item_id, category, upload_dt)`."""
    described = items.select("item_id", primary_tag_category(F.col("tag")).alias("category"), "upload_dt")
    extra = interactions.select("item_id").distinct().join(items.select("item_id"), "item_id", "left_anti")
    return described.unionByName(
        extra.select(
            "item_id", F.lit(-1).cast("bigint").alias("category"), F.lit(None).cast("date").alias("upload_dt")
        )
    )


def available_items(catalog: DataFrame, last_day) -> DataFrame:
    """Items uploaded by `last_day` (a date or a scalar column); an unknown upload counts as available."""
    return catalog.filter(F.col("upload_dt").isNull() | (F.col("upload_dt") <= last_day))


def positives(df: DataFrame, label: str, catalog: DataFrame) -> DataFrame:
    """Distinct (user, item) pairs with the label, for items of the catalog."""
    found = df.filter(F.col(label) == 1).select("user_id", "item_id").distinct()
    return found.join(catalog.select("item_id"), "item_id", "left_semi").select("user_id", "item_id")


def retrieval_targets(
    eval_df: DataFrame,
    fit_df: DataFrame,
    label: str,
    catalog: DataFrame,
    available: DataFrame,
    users: str = "warm",
    exclude_fit_positives: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Targets and exclusions `(user_id, item_id)` per evaluated user.

    Both are written out, as every later step reads them. Targets are eval positives that are available and, if asked, no fit
    positives. Warm users have any fit row at all. Users without a target drop out.
    """
    targets = positives(eval_df, label, catalog)
    if users == "warm":
        targets = targets.join(fit_df.select("user_id").distinct(), "user_id", "left_semi")
    if exclude_fit_positives:
        seen = positives(fit_df, label, catalog)
        targets = targets.join(seen, ["user_id", "item_id"], "left_anti")
    targets = targets.join(available.select("item_id"), "item_id", "left_semi").select("user_id", "item_id")
    targets = materialize(targets, "targets")
    if exclude_fit_positives:
        exclusions = materialize(seen.join(targets.select("user_id").distinct(), "user_id", "left_semi"), "exclusions")
    else:
        exclusions = targets.limit(0)
    return targets, exclusions
