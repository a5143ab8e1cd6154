"""Impression logs derived from the driver's star-schema tables.

The given tables hold no impression logs; these views map them onto the
interactions / items / users model so that every operator can run on them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.expressions import split_label
from reelspark.params import SplitDates

EVENT_SPLITS = SplitDates(
    train=(date(2024, 1, 1), date(2024, 1, 22)),
    val=(date(2024, 1, 23), date(2024, 1, 26)),
    test=(date(2024, 1, 27), date(2024, 1, 30)),
)
ORDER_SPLITS = SplitDates(
    train=(date(1995, 1, 1), date(2000, 6, 30)),
    val=(date(2000, 7, 1), date(2000, 12, 31)),
    test=(date(2001, 1, 1), date(2001, 12, 31)),
)
FLAGS = (
    "is_click",
    "is_like",
    "is_follow",
    "is_comment",
    "is_forward",
    "is_hate",
    "long_view",
    "is_profile_enter",
    "is_rand",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    first = (key % 40).cast("string")
    second = ((key * 7) % 40).cast("string")
    return table(spark, sf_dir, "part").select(
        key.alias("item_id"),
        F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int").alias("author_id"),
        F.col("p_type").alias("video_type"),
        F.date_add(F.lit("2023-12-01").cast("date"), ((key * 13) % 55).cast("int")).alias("upload_dt"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("upload_type"),
        (F.col("p_size") * 1000).cast("double").alias("video_duration"),
        F.lit(720).alias("server_width"),
        F.lit(1280).alias("server_height"),
        ((key * 31) % 500).cast("bigint").alias("music_id"),
        (key % 10).cast("int").alias("music_type"),
        F.when(key % 11 == 0, F.lit(None).cast("string"))
        .when(key % 3 == 0, first)
        .otherwise(F.concat_ws(",", first, second))
        .alias("tag"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        F.col("c_mktsegment").alias("user_active_degree"),
        (key % 2).cast("int").alias("is_lowactive_period"),
        F.lit(0).alias("is_live_streamer"),
        F.when(key % 3 == 0, 1).otherwise(0).alias("is_video_author"),
        ((key * 13) % 600).cast("int").alias("follow_user_num"),
        ((key * 17) % 2000).cast("int").alias("fans_user_num"),
        F.lit(0).alias("friend_user_num"),
        ((key * 37) % 3000).cast("int").alias("register_days"),
        F.col("c_nationkey").cast("int").alias("onehot_feat0"),
        *[F.lit(0).alias(f"onehot_feat{i}") for i in range(1, 18)],
    )


def _flag(condition) -> F.Column:
    return F.when(condition, 1).otherwise(0)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their item; shared by the interactions and the raw text log."""
    kind = F.col("event_type")
    event = F.col("event_id")
    logged = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        _flag(kind.isin("click", "purchase")).alias("is_click"),
        _flag(kind.isin("view", "purchase")).alias("long_view"),
        _flag(kind == "purchase").alias("is_like"),
        _flag(kind == "signup").alias("is_follow"),
        _flag(event % 10 == 0).alias("is_comment"),
        _flag(event % 20 == 0).alias("is_forward"),
        _flag(kind == "error").alias("is_hate"),
        _flag(event % 15 == 0).alias("is_profile_enter"),
        F.round(F.col("value") * 1000).cast("bigint").alias("play_time_ms"),
        F.when(event % 4 == 0, "random").otherwise("standard").alias("source"),
        (event % 5).cast("int").alias("tab"),
    )
    durations = items(spark, sf_dir).select("item_id", F.col("video_duration").cast("bigint").alias("duration_ms"))
    return logged.join(durations, "item_id")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-based interactions, one row per event."""
    return (
        _events(spark, sf_dir)
        .withColumn("date", F.to_date("ts"))
        .withColumn("time_ms", F.unix_millis("ts"))
        .withColumn("split", split_label(F.col("date"), EVENT_SPLITS))
        .drop("ts", "event_id")
    )


def interactions_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions whose random log starts later than the standard one."""
    late = F.col("date") >= F.lit("2024-01-10").cast("date")
    return interactions(spark, sf_dir).filter((F.col("source") == "standard") | late)


def interactions_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-line interactions, one row per line: the larger log."""
    returned, status = F.col("l_returnflag"), F.col("l_linestatus")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    durations = items(spark, sf_dir).select("item_id", F.col("video_duration").cast("bigint").alias("duration_ms"))
    day = F.col("o_orderdate").cast("date")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(
        durations, F.col("l_partkey") == durations.item_id
    )
    return joined.select(
        F.col("o_custkey").alias("user_id"),
        "item_id",
        day.alias("date"),
        (
            F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000
            + F.col("l_linenumber").cast("bigint") * 1000
        ).alias("time_ms"),
        F.col("l_linenumber").cast("int").alias("tab"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 4 == 0, "random").otherwise("standard").alias("source"),
        split_label(day, ORDER_SPLITS).alias("split"),
        _flag(returned == "R").alias("is_click"),
        _flag(status == "O").alias("long_view"),
        _flag((returned == "A") & (status == "F")).alias("is_like"),
        F.lit(0).alias("is_follow"),
        F.lit(0).alias("is_comment"),
        F.lit(0).alias("is_forward"),
        F.lit(0).alias("is_hate"),
        F.lit(0).alias("is_profile_enter"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("play_time_ms"),
        "duration_ms",
    )


RAW_FILES = (
    (0, "log_standard_1.csv", "standard"),
    (1, "log_standard_2.csv", "standard"),
    (2, "log_random_1.csv", "random"),
)


def raw_logs(spark: SparkSession, sf_dir: str, defects: bool = True) -> DataFrame:
    """The same events as raw text columns with a `file_id`, defects planted by event id."""
    event = F.col("event_id")
    local_day = F.to_date("ts")
    moved = (event % 97 == 0) if defects else F.lit(False)
    day_text = F.date_format(F.when(moved, F.date_add(local_day, 1)).otherwise(local_day), "yyyyMMdd")
    hour = F.when((event % 89 == 0) if defects else F.lit(False), (F.hour("ts") + 1) % 24).otherwise(F.hour("ts"))

    def planted(modulus: int, bad: str, value):
        return F.when(event % modulus == 0, bad).otherwise(value.cast("string")) if defects else value.cast("string")

    is_rand = _flag(F.col("source") == "random")
    return _events(spark, sf_dir).select(
        F.when(F.col("source") == "random", 2)
        .when(local_day < F.lit("2024-01-15").cast("date"), 0)
        .otherwise(1)
        .alias("file_id"),
        "source",
        planted(1009, "", F.col("user_id")).alias("user_id"),
        F.col("item_id").cast("string").alias("video_id"),
        planted(983, "n/a", day_text).alias("date"),
        (hour * 100 + F.minute("ts")).cast("string").alias("hourmin"),
        (F.unix_millis("ts") - 28_800_000).cast("string").alias("time_ms"),
        planted(991, "x", F.col("is_click")).alias("is_click"),
        planted(499, "2", F.col("is_like")).alias("is_like"),
        *[F.col(c).cast("string").alias(c) for c in FLAGS if c not in ("is_click", "is_like", "is_rand")],
        F.col("play_time_ms").cast("string").alias("play_time_ms"),
        F.col("duration_ms").cast("string").alias("duration_ms"),
        F.lit("0").alias("profile_stay_time"),
        F.lit("0").alias("comment_stay_time"),
        (F.when(event % 997 == 0, 1 - is_rand).otherwise(is_rand) if defects else is_rand)
        .cast("string")
        .alias("is_rand"),
        F.col("tab").cast("string").alias("tab"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as raw text, with an unparseable upload date and a leaky column."""
    base = items(spark, sf_dir)
    key = F.col("item_id")
    return base.select(
        key.cast("string").alias("video_id"),
        F.col("author_id").cast("string").alias("author_id"),
        F.when(key % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("video_type")).alias("video_type"),
        F.when(key % 101 == 0, "unknown").otherwise(F.col("upload_dt").cast("string")).alias("upload_dt"),
        "upload_type",
        (key % 2).cast("string").alias("visible_status"),
        *[
            F.col(c).cast("string").alias(c)
            for c in ("video_duration", "server_width", "server_height", "music_id", "music_type")
        ],
        "tag",
    )


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as raw text, with unparseable register days planted."""
    key = F.col("user_id")
    base = users(spark, sf_dir)
    return base.select(
        key.cast("string").alias("user_id"),
        "user_active_degree",
        F.when(key % 103 == 0, "?").otherwise(F.col("register_days").cast("string")).alias("register_days"),
        F.col("follow_user_num").cast("string").alias("follow_user_num"),
        F.col("fans_user_num").cast("string").alias("fans_user_num"),
        F.col("is_video_author").cast("string").alias("is_video_author"),
    )
