"""Exact distinct counts by bitmaps that merge: a row per 64 ids instead of a row per id.

An id is a bit of the word that id / 64 numbers. Words of a group are combined by `bit_or`, which Spark adds up
map-side in generated code, so what a task sends on is at most one row per word it has met: for dense ids a
64th of them, and for scattered ones no more than a distinct count has. Several id columns and ordinary totals come from one
pass over the input: a row is taken once for each id column, and for the totals with the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word(id_: Column) -> Column:
    return F.shiftright(id_.cast("bigint"), 6)


def bit(id_: Column) -> Column:
    place = id_.cast("bigint").bitwiseAND(F.lit(63).cast("bigint")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def words(df: DataFrame, by: list[str], ids: list[Column], sums: dict[str, Column] | None = None, days: Column | None = None) -> DataFrame:
    """(by…, kind, word, bits, sums…, first, last): the words of each id column, whose number is `kind`, and partial totals.

    Totals are in rows of kind 0; a null id has a word of its own, null, without bits.
    """
    sums = sums or {}
    kinds = [F.struct(F.lit(i).alias("kind"), word(c).alias("word"), bit(c).alias("bit")) for i, c in enumerate(ids)]
    day = F.lit(None).cast("date") if days is None else days
    taken = df.select(*by, *[v.alias(f"_{n}") for n, v in sums.items()], day.alias("_day"), F.explode(F.array(*kinds)).alias("_id"))
    first = F.col("_id.kind") == 0
    return taken.groupBy(*by, F.col("_id.kind").alias("kind"), F.col("_id.word").alias("word")).agg(
        F.bit_or("_id.bit").alias("bits"),
        *[F.sum(F.when(first, F.col(f"_{n}"))).alias(n) for n in sums],
        F.min(F.when(first, F.col("_day"))).alias("first"),
        F.max(F.when(first, F.col("_day"))).alias("last"),
    )


def counted(kind: int) -> Column:
    """Number of ids of a kind, as an aggregate over `words`."""
    size = F.when((F.col("kind") == kind) & F.col("bits").isNotNull(), F.bit_count("bits"))
    return F.coalesce(F.sum(size), F.lit(0)).cast("bigint")


def totals(df: DataFrame, by: list[str], ids: dict[str, Column], sums: dict[str, Column], days: Column | None = None) -> DataFrame:
    """Per group the number of distinct ids of each column of `ids`, the `sums`, and first and last of `days`, in one pass."""
    parts = words(df, by, list(ids.values()), sums, days)
    spans = [] if days is None else [F.min("first").alias("first"), F.max("last").alias("last")]
    numbers = [counted(i).alias(n) for i, n in enumerate(ids)]
    return parts.groupBy(*by).agg(*numbers, *[F.sum(n).alias(n) for n in sums], *spans)
