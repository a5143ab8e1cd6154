"""Reading raw logs and tables, and writing and reading the processed ones."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.operators.contracts import require_columns
from reelspark.sources.fixtures import FLAGS
from reelspark.sources.id_lookup import id_filters

# Column contracts of the raw files.
LOG_COLUMNS = (
    "user_id",
    "video_id",
    "date",
    "hourmin",
    "time_ms",
    "is_click",
    "is_like",
    "is_follow",
    "is_comment",
    "is_forward",
    "is_hate",
    "long_view",
    "play_time_ms",
    "duration_ms",
    "profile_stay_time",
    "comment_stay_time",
    "is_profile_enter",
    "is_rand",
    "tab",
)
ITEM_COLUMNS = (
    "video_id",
    "author_id",
    "video_type",
    "upload_dt",
    "upload_type",
    "visible_status",
    "video_duration",
    "server_width",
    "server_height",
    "music_id",
    "music_type",
    "tag",
)
USER_COLUMNS = (
    "user_id",
    "user_active_degree",
    "is_lowactive_period",
    "is_live_streamer",
    "is_video_author",
    "follow_user_num",
    "follow_user_num_range",
    "fans_user_num",
    "fans_user_num_range",
    "friend_user_num",
    "friend_user_num_range",
    "register_days",
    "register_days_range",
    *(f"onehot_feat{i}" for i in range(18)),
)
LONG_LOG_COLUMNS = ("user_id", "video_id", "time_ms", "play_time_ms", "duration_ms")
# The columns a profile stages, with their types.
PROFILE_TYPES = {
    "user_id": "bigint",
    "video_id": "bigint",
    "date": "int",
    "hourmin": "int",
    "time_ms": "bigint",
    "tab": "int",
    "play_time_ms": "bigint",
    "duration_ms": "bigint",
}


def read_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files with a header, every column as text."""
    return spark.read.option("header", True).csv(paths)


def _files_of(spark: SparkSession, path: str) -> list:
    """Status of the files under a path: itself, or what a writer left in it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(conf)
    found = system.globStatus(where)
    if not found:
        raise FileNotFoundError(path)
    files = [inner for status in found for inner in (system.listStatus(status.getPath()) if status.isDirectory() else [status])]
    return [f for f in files if f.getLen() > 0 and f.getPath().getName()[0] not in "._"]


def _header(spark: SparkSession, status) -> tuple[str, ...]:
    """Column names of a file from its first line, read without a Spark job."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stream = status.getPath().getFileSystem(conf).open(status.getPath())
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(status.getPath())
        reader = jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
        line = jvm.java.io.BufferedReader(reader).readLine() or ""
    finally:
        stream.close()
    return tuple(next(csv.reader([line]), []))


def _tagged_text(spark: SparkSession, files: list[tuple[int, str, str]], required) -> DataFrame:
    """Text columns of all files with `file_id` and `source`: one scan for each distinct header.

    Every file must have the required columns, whatever the others have. The ids come by a
    join with the list of files on the path that Spark gives with each row.
    """
    by_header: dict[tuple[str, ...], list[tuple[str, int, str]]] = {}
    for file_id, path, source in files:
        for status in _files_of(spark, path):
            header = _header(spark, status)
            require_columns(header, required, path)
            by_header.setdefault(header, []).append((status.getPath().toUri().toString(), file_id, source))
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  file:/x and file:///x are one
    parts = []
    for header, members in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        text = spark.read.schema(schema).option("header", True).csv([uri for uri, _, _ in members])
        ids = spark.createDataFrame(members, "_uri string, file_id int, source string").withColumn("_uri", plain("_uri"))
        rows = text.select("*", plain(F.col("_metadata.file_path")).alias("_uri"))
        parts.append(rows.join(F.broadcast(ids), "_uri").drop("_uri"))  # one row a file, as the driver lists them
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _integral(column: str) -> F.Column:
    kind = "bigint" if column in LONG_LOG_COLUMNS else "int"
    return F.col(column).cast(kind).alias(column)


def read_logs(spark: SparkSession, standard_paths: list[str], random_paths: list[str]) -> DataFrame:
    """Log files unioned by column name, typed and tagged with their source.

    Files may order their columns differently, but each must have all of them: one that
    does not raises and is named. A value that is no number raises.
    """
    tagged = [(p, "standard") for p in standard_paths] + [(p, "random") for p in random_paths]
    text = _tagged_text(spark, [(i, p, s) for i, (p, s) in enumerate(tagged)], LOG_COLUMNS)
    typed = [_integral(c) if c in LOG_COLUMNS else F.col(c) for c in text.columns if c not in ("file_id", "source")]
    return text.select(*typed, "source")


def stage_text_logs(raw: DataFrame) -> DataFrame:
    """Text log rows narrowed and try-cast: a bad value becomes null and is counted later."""
    return raw.select(
        F.col("file_id").cast("int").alias("file_id"),
        "source",
        *[F.col(c).try_cast(kind).alias(c) for c, kind in PROFILE_TYPES.items()],
        *[F.col(c).try_cast("tinyint").alias(c) for c in FLAGS],
    )


def stage_logs(spark: SparkSession, files: list[tuple[int, str, str]]) -> DataFrame:
    """Stage log files given as `(file_id, path, source)`; each must have the staged columns."""
    return stage_text_logs(_tagged_text(spark, files, {*PROFILE_TYPES, *FLAGS}))


def write_tables(interactions: DataFrame, users: DataFrame, items: DataFrame, path: str) -> None:
    """Processed tables as parquet; interactions are partitioned for eval-set pruning.

    Rows are in event order inside each file, which lets readers skip row groups
    by date, and have filters by user and item. Readers that need an order state it themselves.
    """
    ordered = interactions.sortWithinPartitions("source", "split", "date", "time_ms", "user_id", "item_id")
    by_id = ordered.write.mode("overwrite").options(**id_filters("user_id", "item_id"))
    by_id.partitionBy("source", "split").parquet(f"{path}/interactions")
    users.write.mode("overwrite").parquet(f"{path}/users")
    items.write.mode("overwrite").parquet(f"{path}/items")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("interactions", "users", "items")}


def write_frames(frames: dict[str, DataFrame], path: str) -> None:
    """One parquet folder per named table."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def read_frames(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_results(results: DataFrame, path: str) -> None:
    """Tidy results as JSON lines."""
    results.write.mode("overwrite").json(path)


RESULT_SCHEMA = T.StructType(
    [
        T.StructField("eval_set", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("ci_lo", T.DoubleType()),
        T.StructField("ci_hi", T.DoubleType()),
    ]
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).json(path)
