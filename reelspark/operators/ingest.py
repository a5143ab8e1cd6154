"""From raw logs to the processed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import bitmaps
from reelspark.functions.expressions import parse_day, split_label
from reelspark.operators import contracts
from reelspark.session import materialize
from reelspark.sources.id_lookup import rows_with_ids
from reelspark.sources.logs import ITEM_COLUMNS, LOG_COLUMNS, USER_COLUMNS

LABEL_COLUMNS = (
    "is_click",
    "long_view",
    "is_like",
    "is_follow",
    "is_comment",
    "is_forward",
    "is_hate",
    "is_profile_enter",
)


def normalize_logs(logs: DataFrame, splits) -> DataFrame:
    """Typed interactions with their split; an invalid date raises."""
    day = parse_day(F.col("date"))
    return logs.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("video_id").cast("bigint").alias("item_id"),
        day.alias("date"),
        F.col("time_ms").cast("bigint").alias("time_ms"),
        F.col("tab").cast("int").alias("tab"),
        "source",
        split_label(day, splits).alias("split"),
        *[F.col(c).cast("tinyint").alias(c) for c in LABEL_COLUMNS],
        F.col("play_time_ms").cast("bigint").alias("play_time_ms"),
        F.col("duration_ms").cast("bigint").alias("duration_ms"),
    )


def project_items(raw_items: DataFrame, leaky_columns=()) -> DataFrame:
    """Item table without leaky columns; an unparseable upload date becomes null."""
    special = {
        "video_id": F.col("video_id").cast("bigint").alias("item_id"),
        "upload_dt": F.col("upload_dt").try_cast("date").alias("upload_dt"),
        "tag": F.col("tag").cast("string").alias("tag"),
    }
    kept = [c for c in ITEM_COLUMNS if c not in set(leaky_columns)]
    return raw_items.select(*[special.get(c, F.col(c)) for c in kept])


def order_violations(stored: DataFrame) -> DataFrame:
    """Rows of written interactions that stand before an earlier event in their file: one row, one count.

    A file is as large as one writing task made it, and so is a window here.
    """
    event = F.struct("date", "time_ms", "user_id", "item_id")
    placed = stored.select(event.alias("_event"), "_metadata.file_path", "_metadata.row_index")
    before = F.lag("_event").over(Window.partitionBy("file_path").orderBy("row_index"))
    return placed.select((before > F.col("_event")).alias("_late")).agg(F.count_if("_late").alias("rows_out_of_order"))


def latest_event(interactions: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's last event in canonical order, found without sorting the group."""
    event = F.max(F.struct("date", "time_ms", "user_id", "item_id")).alias("_last")
    last = interactions.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(event)
    return last.select(
        *[F.col(f"_{k}").alias(f"of_{k}") for k in keys],
        F.col("_last.date").alias("last_date"),
        F.col("_last.time_ms").alias("last_time_ms"),
        F.col("_last.user_id").alias("last_user_id"),
        F.col("_last.item_id").alias("last_item_id"),
    )


def manifest(interactions: DataFrame, items: DataFrame, leaky_columns=()) -> DataFrame:
    """Ingest manifest as long rows `(entry, value)`, all values as text.

    One pass over the log makes id words and partial totals; all entries come from these.
    """
    one = F.lit(1).cast("bigint")
    parts = bitmaps.words(interactions, ["source", "split"], [F.col("user_id"), F.col("item_id")], {"n": one}, F.col("date"))
    parts = materialize(parts, "manifest-words")
    counts = parts.filter("kind = 0").groupBy("source", "split").agg(F.sum("n").alias("n"))
    counts = counts.select(
        F.concat(F.lit("rows/"), "source", F.lit("/"), "split").alias("entry"), F.col("n").cast("string").alias("value")
    )
    merged = parts.groupBy("kind", "word").agg(F.bit_or("bits").alias("bits"), F.min("first").alias("first"), F.max("last").alias("last"))
    names = ["n_users", "n_items_logged", "first_day", "last_day"]
    values = [bitmaps.counted(0), bitmaps.counted(1), F.min("first"), F.max("last")]
    entries = [F.struct(F.lit(n).alias("entry"), F.col(n).alias("value")) for n in names]
    totals = merged.agg(*[v.cast("string").alias(n) for v, n in zip(values, names)]).select(F.inline(F.array(*entries)))
    known = bitmaps.words(items, [], [F.col("item_id")], {"n": one}).select("word", F.col("bits").alias("known"), F.col("n").alias("rows"))
    known = materialize(known, "item-words")
    catalog = known.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("string").alias("value")).select(
        F.lit("n_items_catalog").alias("entry"), "value"
    )
    logged = merged.filter("kind = 1").join(known, "word", "left")
    lacking = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("bigint")))))
    missing = logged.agg(F.coalesce(F.sum(lacking), F.lit(0)).cast("string").alias("value")).select(
        F.lit("logged_items_missing_features").alias("entry"), "value"
    )
    dropped = ",".join(sorted(set(leaky_columns) & set(ITEM_COLUMNS)))
    spark = interactions.sparkSession
    names = spark.range(1).select(F.lit("dropped_leaky_item_columns").alias("entry"), F.lit(dropped).alias("value"))
    return counts.union(totals).union(catalog).union(missing).union(names)


def ingest(logs: DataFrame, users: DataFrame, raw_items: DataFrame, splits, leaky_columns=()) -> dict[str, DataFrame]:
    """Check the raw inputs, then return the processed tables."""
    contracts.require_columns(logs.columns, LOG_COLUMNS, "logs")
    contracts.require_columns(users.columns, USER_COLUMNS, "users")
    contracts.require_columns(raw_items.columns, ITEM_COLUMNS, "items")
    contracts.enforce(contracts.log_violations(logs))
    interactions = normalize_logs(logs, splits)
    items = project_items(raw_items, leaky_columns)
    checks = contracts.split_violations(interactions)
    checks = checks.union(contracts.unique_violations(items, "item_id", "unique_item_id"))
    checks = checks.union(contracts.unique_violations(users, "user_id", "unique_user_id"))
    contracts.enforce(checks)
    return {"interactions": interactions, "users": users, "items": items}


def derive_pool_release(logs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sub-release of the items in the random log: its rows and its items."""
    pool = logs.filter(F.col("source") == "random").select("video_id").distinct()
    return logs.join(pool, "video_id", "left_semi"), items.join(pool, "video_id", "left_semi")


def sample_users(users: DataFrame, n_users: int, seed) -> DataFrame:
    """`n_users` users with the lowest hash of (seed, id): the same sample on any cluster."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("user_id").cast("string")))
    return users.select("user_id").distinct().orderBy(key, "user_id").limit(n_users)


def derive_user_release(logs: DataFrame, users: DataFrame, items: DataFrame, n_users: int, seed):
    """Sub-release of a user sample: its rows, its users and the items they saw."""
    sample = sample_users(users, n_users, seed)
    rows = rows_with_ids(logs, "user_id", sample)
    seen = rows.select("video_id").distinct()
    return rows, users.join(sample, "user_id", "left_semi"), items.join(seen, "video_id", "left_semi")
