"""Order statistics that stay distributed: ranks, Gini, AUC, quantiles, bootstrap.

None of them sorts raw rows in one task. Each first shrinks its input to a
histogram, orders the histogram inside parts of about equal size, and then
combines one small row per part.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.expressions import hash_number
from reelspark.session import materialize

_PRIME = 2_147_483_647  # 2^31 - 1
_HALF, _LOW = 1 << 26, 1 << 21
# Numbers each bootstrap replicate draws for itself.
CONSTANTS = ("m1", "m2", "a1", "m3", "m4", "a2")


def _poisson_cdf() -> tuple[float, ...]:
    """Cumulative Poisson(1) probabilities of 0, 1, 2, … until a 52-bit uniform number cannot exceed them."""
    term, total, out = math.exp(-1), 0.0, []
    while not out or 1 - out[-1] >= 2**-52:
        total += term
        out.append(total)
        term /= len(out)
    return tuple(out)


POISSON_CDF = _poisson_cdf()


def ordered_parts(df: DataFrame, value: str, name: str) -> DataFrame:
    """`df`, stored, with `_bucket`: numbers of parts that follow the order of `value` and hold about equally many rows.

    Spark samples the values and deals out ranges of them, so near-equal values are spread
    as well as any others; one value stays together.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, value).withColumn("_bucket", F.spark_partition_id()), name)


def concentration(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Gini and top-1 % share per group from a histogram `(by…, n, m)`: m items with count n.

    A group with T impressions has at most sqrt(2T) distinct counts, so the
    window over a group's histogram stays small even where the group is huge.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    up_to = group.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    below = F.col("_through") - F.col("m")
    above = F.col("_items") - F.col("_through")
    top = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_items") / 100))
    in_top = F.least(F.col("m"), F.greatest(top - above, F.lit(0).cast("bigint")))
    ranked = (
        histogram.withColumn("_through", F.sum("m").over(up_to))
        .withColumn("_items", F.sum("m").over(group))
        .withColumn("_weighted", n * (2 * below.cast("double") * m + m * m + m))
        .withColumn("_top", n * in_top.cast("double"))
    )
    items, total = F.col("items").cast("double"), F.col("impressions").cast("double")
    return (
        ranked.groupBy(*by)
        .agg(
            F.max("_items").alias("items"),
            F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("m"))), F.lit(0)).cast("bigint").alias("items_shown"),
            F.sum(F.col("n") * F.col("m")).cast("bigint").alias("impressions"),
            F.sum("_weighted").alias("_weighted"),
            F.sum("_top").alias("_top"),
        )
        .select(
            *by,
            "items",
            "items_shown",
            "impressions",
            F.when(total == 0, F.lit(0.0))
            .otherwise((F.col("_weighted") - (items + 1) * total) / F.nullif(items * total, F.lit(0.0)))
            .alias("gini"),
            (F.col("_top") / F.nullif(total, F.lit(0.0))).alias("top_1pct_share"),
        )
    )


def count_histogram(counts: DataFrame, by: list[str], count_col: str = "n") -> DataFrame:
    """Histogram `(by…, n, m)` of per-item counts."""
    return counts.groupBy(*by, F.col(count_col).alias("n")).agg(F.count(F.lit(1)).alias("m"))


def lorenz_points(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Lorenz curve corners: cumulative share of items and impressions at each distinct count."""
    group = Window.partitionBy(*by)
    up_to = group.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = F.col("n") * F.col("m")
    return histogram.select(
        *by,
        F.col("n").cast("bigint").alias("count_per_item"),
        (F.sum("m").over(up_to) / F.sum("m").over(group)).alias("items_share"),
        (F.sum(shown).over(up_to) / F.nullif(F.sum(shown).over(group), F.lit(0))).alias("impressions_share"),
    )


def grouped_auc(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """ROC AUC per group, ties counted half; null where a group has one class only.

    A group of any size is cut into ordered score buckets: pairs inside a bucket
    are counted from a running sum there, pairs across buckets from bucket totals.
    """
    y = F.col(label).cast("bigint")
    scores = df.groupBy(*by, F.col(score).alias("_score")).agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    scores = ordered_parts(scores, "_score", "scores")
    inside = Window.partitionBy(*by, "_bucket").orderBy("_score")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pos, neg = F.col("_pos").cast("double"), F.col("_neg").cast("double")
    buckets = (
        scores.withColumn("_wins", pos * (F.sum("_neg").over(inside) - neg / 2))
        .groupBy(*by, "_bucket")
        .agg(F.sum("_wins").alias("_wins"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    )
    across = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    across = across.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = buckets.withColumn("_wins", F.col("_wins") + pos * (F.sum("_neg").over(across) - neg))
    return (
        total.groupBy(*by)
        .agg(
            F.sum("_wins").alias("_wins"),
            F.sum("_pos").cast("bigint").alias("pos"),
            F.sum("_neg").cast("bigint").alias("neg"),
        )
        .select(
            *by,
            "pos",
            "neg",
            (F.col("_wins") / F.nullif(F.col("pos").cast("double") * F.col("neg").cast("double"), F.lit(0.0))).alias(
                "auc"
            ),
        )
    )


def global_rank(df: DataFrame, count_col: str, id_col: str, seed, by: list[str] | None = None) -> DataFrame:
    """Add `position`, the rank 1.. by (count desc, md5 of id), without a global sort.

    Offsets come from a table of (count, first three hex digits of the hash)
    cells; each cell holds about 1/4096 of the rows sharing a count, and only
    that cell is sorted by one task. Counts of T events take at most sqrt(2T)
    distinct values, which bounds the table of levels.
    """
    by = by or []
    group = by or [F.lit(1)]
    keyed = df.withColumn(
        "_tie", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    ).withColumn("_cell", F.substring("_tie", 1, 3))
    cells = keyed.groupBy(*by, count_col, "_cell").agg(F.count(F.lit(1)).alias("_in_cell"))
    before = (Window.unboundedPreceding, -1)
    within = Window.partitionBy(*by, count_col).orderBy("_cell").rowsBetween(*before)
    level_sizes = cells.groupBy(*by, count_col).agg(F.sum("_in_cell").alias("_in_level"))
    over_levels = Window.partitionBy(*group).orderBy(F.col(count_col).desc()).rowsBetween(*before)
    levels = level_sizes.select(
        *by, count_col, F.coalesce(F.sum("_in_level").over(over_levels), F.lit(0)).alias("_level_offset")
    )
    offsets = cells.withColumn("_cell_offset", F.coalesce(F.sum("_in_cell").over(within), F.lit(0))).join(
        levels, [*by, count_col]
    )
    inside = Window.partitionBy(*by, count_col, "_cell").orderBy("_tie", id_col)
    ranked = keyed.withColumn("_in", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*by, count_col, "_cell"])
        .withColumn("position", (F.col("_level_offset") + F.col("_cell_offset") + F.col("_in")).cast("bigint"))
        .drop("_tie", "_cell", "_in", "_in_cell", "_cell_offset", "_level_offset")
    )


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles `(by…, prob, quantile)` of a column with many distinct values.

    Bucket counts locate the buckets holding the wanted positions; only their
    rows are ordered.
    """
    values = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    values = ordered_parts(values, "_v", "values")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = (Window.unboundedPreceding, -1)
    buckets = (
        values.groupBy(*by, "_bucket")
        .agg(F.sum("_c").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(group.orderBy("_bucket").rowsBetween(*before)), F.lit(0)))
        .withColumn("_n", F.sum("_size").over(group))
    )
    position = F.col("prob") * (F.col("_n") - 1)
    wanted = (
        buckets.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_at", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))))
        .filter((F.col("_at") >= F.col("_offset")) & (F.col("_at") < F.col("_offset") + F.col("_size")))
        .withColumn("_weight", F.when(F.floor(position) == F.ceil(position), F.lit(1.0)).otherwise(1 - F.abs(position - F.col("_at"))))
        .select(*by, "_bucket", "_offset", "prob", "_at", "_weight")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(*before)
    needed = values.join(wanted.select(*by, "_bucket").distinct(), [*by, "_bucket"], "left_semi")
    placed = needed.withColumn("_start", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    start = F.col("_offset") + F.col("_start")
    return (
        placed.join(wanted, [*by, "_bucket"])
        .filter((F.col("_at") >= start) & (F.col("_at") < start + F.col("_c")))
        .groupBy(*by, "prob")
        .agg(F.sum(F.col("_v") * F.col("_weight")).alias("quantile"))
    )


def _replicate_constants(seed, n_boot: int) -> list[tuple[int, ...]]:
    def number(text: str) -> int:
        return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) % _PRIME

    return [(b, *[number(f"{seed}:{name}:{b}") for name in CONSTANTS]) for b in range(1, n_boot + 1)]


def poisson_count(uniform: Column) -> Column:
    """Poisson(1) draw by inversion of its cumulative probabilities."""
    count = F.when(uniform < POISSON_CDF[0], 0)
    for i, edge in enumerate(POISSON_CDF[1:], start=1):
        count = count.when(uniform < edge, i)
    return count.otherwise(len(POISSON_CDF))


def bootstrap_means(
    groups: DataFrame, by: list[str], key: list[str], value: str, weight: str, n_boot: int, seed
) -> DataFrame:
    """Weighted mean per bootstrap replicate `(by…, replicate, mean)`.

    Each group gets an independent Poisson(1) multiplicity per replicate, a
    function of its key alone, so replicates are aggregated map-side and at most
    `n_boot` rows per task are shuffled.
    """
    names = ("b", *CONSTANTS)
    constants = F.array(
        *[
            F.struct(*[F.lit(v).cast("bigint").alias(name) for name, v in zip(names, values)])
            for values in _replicate_constants(seed, n_boot)
        ]
    )
    keyed = groups.select(
        *by,
        F.col(value).cast("double").alias("_v"),
        F.col(weight).cast("double").alias("_w"),
        hash_number(seed, *[F.col(k) for k in key]).alias("_h"),
    ).withColumn("_r", F.explode(constants))
    # Both halves of the 52-bit hash enter every replicate with factors of its own, so two
    # groups never share all their draws; two such numbers make 52 bits.
    high, low = F.floor(F.col("_h") / _HALF), F.col("_h") % _HALF
    first = (high * F.col("_r.m1") + low * F.col("_r.m2") + F.col("_r.a1")) % _PRIME
    second = (high * F.col("_r.m3") + low * F.col("_r.m4") + F.col("_r.a2")) % _PRIME
    uniform = (first * _LOW + second % _LOW) / F.lit(float(1 << 52))
    drawn = keyed.select(*by, F.col("_r.b").alias("replicate"), "_v", "_w", poisson_count(uniform).alias("_times"))
    return drawn.groupBy(*by, "replicate").agg(
        (F.sum(F.col("_w") * F.col("_v") * F.col("_times")) / F.nullif(F.sum(F.col("_w") * F.col("_times")), F.lit(0.0)))
        .alias("mean")
    )


def bootstrap_interval(
    groups: DataFrame,
    by: list[str],
    key: list[str],
    value: str,
    weight: str,
    n_boot: int,
    seed,
    level: float = 0.95,
) -> DataFrame:
    """Percentile interval `(by…, ci_lo, ci_hi)` of a weighted mean over groups."""
    means = bootstrap_means(groups, by, key, value, weight, n_boot, seed)
    low, high = (1 - level) / 2, (1 + level) / 2
    return means.groupBy(*by).agg(
        F.percentile("mean", F.lit(low)).alias("ci_lo"),
        F.percentile("mean", F.lit(high)).alias("ci_hi"),
    )
