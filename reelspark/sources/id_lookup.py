"""Rows of a stored table by id, without reading the row groups that cannot hold them.

Logs are stored by date, so the smallest and largest id of a row group say nothing
about a user or an item in it. Bloom filters do: `id_filters` asks the Parquet writer
for them, and `rows_with_ids` pushes a short list of ids down to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ids pushed into a scan as values; each is tried on the filter of every row group.
PUSHED_IDS = 500


def id_filters(*columns: str) -> dict[str, str]:
    """Parquet writer options for a bloom filter per row group on each of `columns`.

    The writer picks the size that the ids met in a row group need, one megabyte at
    most. A column it could write with a dictionary has that in place of a filter.
    """
    options = {}
    for column in columns:
        options[f"parquet.bloom.filter.enabled#{column}"] = "true"
        options[f"parquet.bloom.filter.adaptive.enabled#{column}"] = "true"
    return options


def rows_with_ids(table: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of `table` whose `column` is among the ids of `ids`, a frame with that column.

    Up to `PUSHED_IDS` distinct ids become values of the scan's filter. More of them
    are joined, beside which Spark puts a bloom filter of its own where sizes call for
    it. A null id finds nothing, no ids find no rows, repeated ids find a row once.
    """
    wanted = ids.select(column).dropna().distinct()
    few = wanted.limit(PUSHED_IDS + 1).collect()
    if len(few) > PUSHED_IDS:
        return table.join(wanted, column, "left_semi").select(*table.columns)
    if not few:
        return table.filter(F.lit(False))
    return table.filter(F.col(column).isin(*[row[0] for row in few]))
