"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Duration bucket edges in seconds for the content encoding.
DURATION_EDGES_S = (7, 18, 30, 60, 120, 300, 600)

# Labels and upper edges of the profile's duration buckets (ms).
DURATION_LABELS = (
    (7_000, "0-7s"),
    (18_000, "7-18s"),
    (60_000, "18-60s"),
    (180_000, "1-3min"),
)
DURATION_LAST = "3min+"

# Labels and upper edges of the profile's age buckets (days).
AGE_LABELS = (
    (0, "0d"),
    (7, "1-7d"),
    (30, "8-30d"),
    (180, "31-180d"),
    (365, "181-365d"),
)
AGE_LAST = "365d+"
UNKNOWN = "unknown"

# Fixed value: the log's local clock is eight hours ahead of UTC.
LOCAL_SHIFT_MS = 28_800_000


def day_number(day: Column) -> Column:
    """Days since 1970-01-01, the integer key that day-range frames need."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint")


def parse_day(yyyymmdd: Column) -> Column:
    """Date of a yyyymmdd number or text; an invalid date raises under ANSI."""
    return F.to_date(yyyymmdd.cast("string"), "yyyyMMdd")


def split_label(day: Column, splits) -> Column:
    """Name of the split whose inclusive range holds `day`, else `unused`."""
    label = F.when(day.between(F.lit(splits.train[0]), F.lit(splits.train[1])), "train")
    label = label.when(day.between(F.lit(splits.val[0]), F.lit(splits.val[1])), "val")
    label = label.when(day.between(F.lit(splits.test[0]), F.lit(splits.test[1])), "test")
    return label.otherwise("unused")


def primary_tag_feature(tag: Column) -> Column:
    """First comma piece as an integer, null when it is not one."""
    return F.split_part(tag, F.lit(","), F.lit(1)).try_cast("int")


def primary_tag_category(tag: Column) -> Column:
    """First comma piece as a number without its fraction, -1 when unusable."""
    number = F.split_part(tag, F.lit(","), F.lit(1)).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("bigint"), F.lit(-1).cast("bigint"))


def tag_list(tag: Column, max_tags: int) -> Column:
    """First `max_tags` comma pieces as ids; a piece that is not digits keeps its slot as -1."""
    pieces = F.slice(F.split(tag, ","), 1, max_tags)

    def piece_id(piece: Column) -> Column:
        text = F.trim(piece)
        return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")).otherwise(F.lit(-1).cast("bigint"))

    return F.coalesce(F.transform(pieces, piece_id), F.array().cast("array<bigint>"))


def duration_index(duration_ms: Column) -> Column:
    """1 + number of edges at or below the duration; 0 when unknown."""
    index = F.when(duration_ms.isNull(), F.lit(0))
    for i in range(len(DURATION_EDGES_S), 0, -1):
        index = index.when(duration_ms >= F.lit(DURATION_EDGES_S[i - 1] * 1000), F.lit(i + 1))
    return index.otherwise(F.lit(1))


def _upper_edge_label(value: Column, edges, last: str) -> Column:
    label = F.when(value.isNull(), UNKNOWN)
    for edge, name in edges:
        label = label.when(value <= F.lit(edge), name)
    return label.otherwise(last)


def duration_label(duration_ms: Column) -> Column:
    return _upper_edge_label(duration_ms, DURATION_LABELS, DURATION_LAST)


def age_label(age_days: Column) -> Column:
    return _upper_edge_label(age_days, AGE_LABELS, AGE_LAST)


def local_timestamp(time_ms: Column) -> Column:
    return F.timestamp_millis(time_ms + F.lit(LOCAL_SHIFT_MS))


def hash_number(seed, *parts: Column) -> Column:
    """52-bit number from md5 of `seed:part:part…`, the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def hash_uniform(seed, *parts: Column) -> Column:
    """Uniform number in [0, 1) for a key, independent of how rows are partitioned."""
    return hash_number(seed, *parts) / F.lit(float(2**52))


def tie_key(seed, item_id: Column) -> Column:
    """One shared pseudo-random order over items, used to break score ties."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), item_id.cast("string")))
