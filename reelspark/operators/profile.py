"""Summary tables of one release, from staged text logs.

The pool is the set of items in the release's own random log. Every table is a
few aggregations over the staged rows; joins with the item table happen after
rows are aggregated per item and day, so a very popular item stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import bitmaps, stats
from reelspark.functions.expressions import (
    UNKNOWN,
    age_label,
    duration_label,
    hash_number,
    local_timestamp,
    parse_day,
)
from reelspark.session import broadcast_if_small, materialize
from reelspark.sources.fixtures import FLAGS

# The summary tables and the display order of bucket labels.
TABLES = ("files", "daily", "tabs", "user_activity", "attributes", "concentration", "pool", "clock", "users")
BUCKET_ORDER = {
    "duration": ("0-7s", "7-18s", "18-60s", "1-3min", "3min+", "unknown"),
    "age_at_impression": ("0d", "1-7d", "8-30d", "31-180d", "181-365d", "365d+", "unknown"),
}
ROW_FINGERPRINT = ("time_ms", "play_time_ms", "duration_ms", "is_click", "long_view", "is_like", "tab")
ID_FINGERPRINT = ("user_id", "video_id", "time_ms")


def stage_items(raw_items: DataFrame) -> DataFrame:
    return raw_items.select(
        F.col("video_id").try_cast("bigint").alias("video_id"),
        F.col("upload_dt").try_cast("date").alias("upload_dt"),
        "video_type",
        "upload_type",
    )


def stage_users(raw_users: DataFrame) -> DataFrame:
    """User columns for the profile; a bad value becomes null."""
    return raw_users.select(
        F.col("user_id").try_cast("bigint").alias("user_id"),
        "user_active_degree",
        *[
            F.col(c).try_cast("int").alias(c)
            for c in ("register_days", "follow_user_num", "fans_user_num", "is_video_author")
        ],
    )


def random_pool(staged: DataFrame) -> DataFrame:
    """Distinct items of the random log."""
    shown = staged.filter((F.col("source") == "random") & F.col("video_id").isNotNull())
    return shown.select("video_id").distinct()


def with_clocks(staged: DataFrame) -> DataFrame:
    """Add the log's day, the local clock of `time_ms`, and where the two disagree."""
    local = local_timestamp(F.col("time_ms"))
    return (
        staged.withColumn("day", parse_day(F.col("date")))
        .withColumn("offset_days", F.datediff(F.col("day"), F.to_date(local)).cast("bigint"))
        .withColumn("ts_hour", F.hour(local).cast("bigint"))
        .withColumn("hourmin_hour", F.floor(F.col("hourmin") / 100).cast("bigint"))
    )


def base_rows(staged: DataFrame) -> DataFrame:
    """Staged rows with clocks and the pool flag on every row.

    The pool is written out and counted, so that the whole log is shuffled for
    the flag only where the pool is too large to broadcast.
    """
    pool = materialize(random_pool(staged).withColumn("_pooled", F.lit(True)), "pool")
    flagged = with_clocks(staged).join(broadcast_if_small(pool), "video_id", "left")
    return flagged.withColumn("in_pool", F.col("_pooled").isNotNull()).drop("_pooled")


def _label_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"),
        F.sum("is_click").cast("bigint").alias("clicks"),
        F.sum("long_view").cast("bigint").alias("long_views"),
    ]


def _resum() -> list[Column]:
    return [F.sum(c).cast("bigint").alias(c) for c in ("rows", "clicks", "long_views")]


def files(staged: DataFrame, file_names: DataFrame) -> DataFrame:
    """Contract counters per file; a null or unparseable flag counts as non-binary."""
    local_day = F.date_format(local_timestamp(F.col("time_ms")), "yyyyMMdd").cast("int")
    null_key = (
        F.col("user_id").isNull() | F.col("video_id").isNull() | F.col("date").isNull() | F.col("time_ms").isNull()
    )
    counted = staged.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.count_distinct("user_id").alias("users"),
        F.min("user_id").alias("min_user_id"),
        F.max("user_id").alias("max_user_id"),
        F.count_if(null_key).alias("null_or_unparseable_keys"),
        F.count_if(F.col("is_rand") != (F.col("source") == "random").cast("tinyint")).alias("is_rand_mismatch"),
        F.count_if(F.col("date") != local_day).alias("date_time_mismatch"),
        *[F.count_if(F.coalesce(~F.col(c).isin(0, 1), F.lit(True))).alias(f"nonbinary_{c}") for c in FLAGS],
    )
    return file_names.join(counted, "file_id").select("file_id", "file", "source", *counted.columns[1:])


def _row_hash(columns, portable: bool) -> Column:
    if portable:
        return hash_number("fp", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.xxhash64(*columns)


def daily(base: DataFrame, portable: bool = False) -> DataFrame:
    """Volumes, label sums and two order-independent fingerprints per day, source and pool flag.

    A fingerprint is a sum of row hashes, so it does not depend on row order.
    `portable` takes an md5-based hash that other engines can recompute.
    """

    def fingerprint(columns) -> Column:
        return _row_hash(columns, portable).cast("decimal(20,0)")

    sums = {
        "rows": F.lit(1).cast("bigint"),
        "clicks": F.col("is_click").cast("bigint"),
        "long_views": F.col("long_view").cast("bigint"),
        "likes": F.col("is_like").cast("bigint"),
        "fp_rows": fingerprint(ROW_FINGERPRINT),
        "fp_ids": fingerprint(ID_FINGERPRINT),
    }
    ids = {"users": F.col("user_id"), "items": F.col("video_id")}
    out = bitmaps.totals(base, ["day", "source", "in_pool"], ids, sums)
    texts = [F.col(n).cast("string").alias(n) for n in ("fp_rows", "fp_ids")]
    return out.select("day", "source", "in_pool", "rows", "users", "items", "clicks", "long_views", "likes", *texts)


def tabs(base: DataFrame) -> DataFrame:
    return base.groupBy("source", "in_pool", "tab").agg(*_label_sums())


def user_activity(base: DataFrame) -> DataFrame:
    return base.groupBy("user_id", "file_id", "source", "in_pool").agg(
        *_label_sums(), F.count_if(F.col("offset_days") != 0).alias("date_mismatches")
    )


def clock(base: DataFrame, file_names: DataFrame) -> DataFrame:
    """Rows by file, day offset, hour of `time_ms` and hour of `hourmin`."""
    counted = base.groupBy("file_id", "offset_days", "ts_hour", "hourmin_hour").agg(F.count(F.lit(1)).alias("rows"))
    named = file_names.select("file_id", "file")
    return counted.join(named, "file_id").select("file", "offset_days", "ts_hour", "hourmin_hour", "rows")


def _per_item_day(base: DataFrame) -> DataFrame:
    bucket = duration_label(F.col("duration_ms")).alias("duration")
    return base.groupBy("source", "in_pool", "video_id", "day", bucket).agg(*_label_sums())


def attributes(base: DataFrame, items: DataFrame) -> DataFrame:
    """Exposure-weighted item attributes in long form, pool vs not."""
    joined = _per_item_day(base).join(items, "video_id", "left")
    age = F.datediff(F.col("day"), F.col("upload_dt"))
    combined = joined.groupBy(
        "source",
        "in_pool",
        "duration",
        age_label(age).alias("age_at_impression"),
        F.coalesce("video_type", F.lit(UNKNOWN)).alias("video_type"),
        F.coalesce("upload_type", F.lit(UNKNOWN)).alias("upload_type"),
    ).agg(*_resum())
    names = ("duration", "age_at_impression", "video_type", "upload_type")
    pairs = F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(n).alias("bucket")) for n in names])
    long = combined.select("source", "in_pool", "rows", "clicks", "long_views", F.inline(pairs))
    return long.groupBy("source", "in_pool", "attribute", "bucket").agg(*_resum())


def pool_table(base: DataFrame, items: DataFrame) -> DataFrame:
    """Per pool item: upload date, first day in each log, rows in each log."""
    standard, random = F.col("source") == "standard", F.col("source") == "random"
    counted = (
        base.filter("in_pool")
        .groupBy("video_id")
        .agg(
            F.min(F.when(standard, F.col("day"))).alias("first_standard_day"),
            F.min(F.when(random, F.col("day"))).alias("first_random_day"),
            F.count_if(standard).alias("standard_rows"),
            F.count_if(random).alias("random_rows"),
        )
    )
    dates = items.groupBy("video_id").agg(F.max("upload_dt").alias("upload_dt"))
    return counted.join(dates, "video_id", "left")


def concentration(base: DataFrame) -> DataFrame:
    """Gini and top-1 % share over the items shown, per source and pool flag."""
    by = ["source", "in_pool"]
    counts = base.groupBy(*by, "video_id").agg(F.count(F.lit(1)).alias("n"))
    shares = stats.concentration(stats.count_histogram(counts, by), by)
    return shares.select(*by, "items_shown", "impressions", "gini", "top_1pct_share")


def manifest(staged: DataFrame) -> DataFrame:
    pool = F.count_distinct(F.when(F.col("source") == "random", F.col("video_id")))
    return staged.agg(F.count(F.lit(1)).alias("rows"), pool.alias("pool_size"))


class Profile(Mapping):
    """The summary tables of a release by name; each is planned, and the base rows are prepared, when first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def build_profile(
    staged: DataFrame, items: DataFrame, users: DataFrame, file_names: DataFrame, portable: bool = False
) -> Profile:
    """All summary tables of a release, lazily. Stage `staged` as parquet when many are read."""
    base = cache(lambda: base_rows(staged))
    return Profile(
        {
            "files": lambda: files(staged, file_names),
            "daily": lambda: daily(base(), portable),
            "tabs": lambda: tabs(base()),
            "user_activity": lambda: user_activity(base()),
            "attributes": lambda: attributes(base(), items),
            "concentration": lambda: concentration(base()),
            "pool": lambda: pool_table(base(), items),
            "clock": lambda: clock(base(), file_names),
            "users": lambda: users,
        }
    )
