"""As-of join of rows: each left row with the latest earlier row of the same entity.

The right side shrinks to one row per key and time, the left side to the distinct keys and times it asks for;
both together are dealt out by ranges of (key, time) that Spark samples, so an entity with a large share of all
rows is cut in time. Inside a range the latest row is a running last value. What a range's first entity had before it
is one row to carry in: only entities that reach over a range's end have one, at most two a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.session import materialize


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str | None = None, *,
    inclusive: bool = False, tie: list[str] | None = None, prefix: str = "asof_",
) -> DataFrame:
    """`left` with the columns of the latest `right` row of the same `by` columns before `time`, named with `prefix`.

    `inclusive` lets a row of the same time match. Of several right rows of one time the one with the
    largest `tie` columns (all its other columns by default) is taken. Left rows all stay, those
    without a match, with a null key or a null time have nulls; right rows with these never match.
    """
    right_time = right_time or time
    # A null counts less than any value, as it does in a maximum of structs.
    others = [c for c in right.columns if c not in by and c != right_time]
    rank = F.struct(*[F.col(c) for c in (tie or others)]) if (tie or others) else F.lit(0)
    row = F.struct(F.col(right_time).alias("time"), F.struct(*[F.col(c) for c in others] or [F.lit(True).alias("_")]).alias("rest"))
    given = right.filter(_known(by, right_time)).groupBy(*by, F.col(right_time).alias("_time")).agg(F.max_by(row, rank).alias("_row"))
    asked = left.filter(_known(by, time)).select(*by, F.col(time).alias("_time")).distinct()

    # At the same time a right row comes after the question, or before it if it may match.
    order = (0, 1) if inclusive else (1, 0)
    events = given.select(*by, "_time", F.lit(order[0]).alias("_side"), "_row").unionByName(
        asked.select(*by, "_time", F.lit(order[1]).alias("_side"), F.lit(None).cast(given.schema["_row"].dataType).alias("_row"))
    )
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.repartitionByRange(parts, *by, "_time").withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "asof-ranges")
    inside = Window.partitionBy("_range", *by).orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumn("_found", F.last("_row", ignorenulls=True).over(inside)).filter(F.col("_side") == order[1])

    # One row per entity of a range, for entities that have several ranges.
    lasts = dealt.groupBy(*by, "_range").agg(F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("_time"))).alias("_last"))
    spread = lasts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.join(spread, by, "left_semi").withColumn("_carried", F.last("_last", ignorenulls=True).over(ahead)).drop("_last")
    # At most two entities of a range reach over its ends.
    answers = found.join(F.broadcast(carried), [*by, "_range"], "left").select(
        *by, F.col("_time").alias(time), F.coalesce("_found", "_carried").alias("_row")
    )
    names = [F.col("_row.time").alias(f"{prefix}{right_time}"), *[F.col(f"_row.rest.{c}").alias(f"{prefix}{c}") for c in others]]
    return left.join(answers, [*by, time], "left").select(*[left[c] for c in left.columns], *names)


def _known(by: list[str], time: str) -> Column:
    known = F.col(time).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    return known
