"""Named evaluation sets and fit windows over the interactions table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.params import SOURCES, SPLITS


def parse_eval_set(name: str) -> tuple[str, str]:
    """`(split, source)` of a name such as `test_random`."""
    split, _, source = name.partition("_")
    if split not in SPLITS or source not in SOURCES:
        raise ValueError(f"{name!r} is no evaluation set: it takes one of {SPLITS}, an underscore and one of {SOURCES}")
    return split, source


def eval_set(interactions: DataFrame, name: str) -> DataFrame:
    split, source = parse_eval_set(name)
    return interactions.filter((F.col("split") == split) & (F.col("source") == source))


def fit_window(interactions: DataFrame, before: date, sources=("standard",)) -> DataFrame:
    """Rows of `sources` dated strictly before `before`."""
    return interactions.filter((F.col("date") < F.lit(before)) & F.col("source").isin(*sources))
