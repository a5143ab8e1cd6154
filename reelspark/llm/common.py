"""Helpers shared by the text operators: stored intermediates, safe joins, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.session import discard, materialize

#: Documents per Arrow batch: a batch of ordinary documents is some megabytes.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the Python stages of these operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class Stored:
    """A DataFrame written to the shared folder: survives lost executors, can be deleted when a later step replaces it.

    What is not deleted by then goes with `session.release`.
    """

    def __init__(self, df: DataFrame, name: str) -> None:
        self.df = materialize(df, name)
        self.path = self.df._scratch_path

    def drop(self) -> None:
        discard(self.df)


def keep_only(df: DataFrame, key: str, keepers: DataFrame, keeper_key: str) -> DataFrame:
    """Rows of `df` whose `key` is among `keepers`; null keys match null keys, columns of `df` stay as they are."""
    name = f"keeper_{uuid.uuid4().hex[:8]}"
    right = keepers.select(F.col(keeper_key).alias(name))
    return df.join(right, df[key].eqNullSafe(F.col(name)), "left_semi")


def components(edges: DataFrame) -> tuple[DataFrame, Stored | None]:
    """Connected components of `edges` (u, v: long, not null): (node, component), component = smallest node.

    Large-star and small-star steps in turn. Both take minima with map-side combining,
    so a node with a third of all edges is no bottleneck, and edges never grow beyond
    one per node and neighbour. Rounds end when the edges no longer change (compared by
    count and an order-free hash, one row to the driver a round). Every round is stored.
    Nodes without edges are not returned. No edges: an empty frame.
    """
    clean = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = Stored(clean, "edges")
    seen = _digest(now.df)
    while seen[0]:
        both = now.df.union(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour goes to the smallest one.
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours and the node itself go to the smallest one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = Stored(small.where("u <> v").distinct(), "edges")
        now.drop()
        now, before = after, seen
        seen = _digest(now.df)
        if seen == before:
            break
    nodes = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots), now


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


