"""Inputs of the two-tower model: vocabularies, encoded items and users, point-in-time histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.expressions import DURATION_EDGES_S, day_number, duration_index, tag_list
from reelspark.functions.stats import global_rank
from reelspark.session import materialize

# The fields of each tower.
ITEM_FIELDS = ("author_id", "music_id", "music_type", "video_type", "upload_type")
USER_FIELDS = ("user_active_degree", *(f"onehot_feat{i}" for i in range(18)))
DURATION_SIZE = len(DURATION_EDGES_S) + 2

# A field's vocabulary up to this many entries is broadcast, a larger one is
# joined by shuffle.
BROADCAST_ENTRIES = 100_000


def vocabulary(counts: DataFrame, min_counts: dict[str, int] | int = 1) -> DataFrame:
    """Indices 1.. per field by descending count: `(field, value, idx)`.

    `counts` holds `(field, value, n)`. Values seen less often than the field's
    minimum have no entry and so encode to 0.
    """
    if isinstance(min_counts, int):
        kept = counts.filter(F.col("n") >= min_counts)
    else:
        needed = F.lit(min_counts.get("", 1))
        for field, least in min_counts.items():
            if field:
                needed = F.when(F.col("field") == field, least).otherwise(needed)
        kept = counts.filter(F.col("n") >= needed)
    ranked = global_rank(kept, "n", "value", "vocab", by=["field"])
    return ranked.select("field", "value", F.col("position").alias("idx"))


def vocabulary_sizes(vocab: DataFrame, fields) -> dict[str, int]:
    """Entries per field plus one for unknown; one row per field."""
    found = {r["field"]: r["n"] for r in vocab.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {f: found.get(f, 0) + 1 for f in fields}


def long_fields(df: DataFrame, keys: list[str], fields) -> DataFrame:
    """One row per key and non-null field value, as text."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(*keys, F.inline(pairs)).filter(F.col("value").isNotNull())


def encode(long: DataFrame, vocab: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Rows of `long` whose value is known, with its `idx`.

    Small vocabularies are broadcast, which also keeps their very common values
    from piling up in one task; large ones are joined by shuffle.
    """
    small = [f for f, n in sizes.items() if n <= BROADCAST_ENTRIES]
    near = long.filter(F.col("field").isin(small)).join(
        F.broadcast(vocab.filter(F.col("field").isin(small))), ["field", "value"]
    )
    if len(small) == len(sizes):
        return near
    far = long.filter(~F.col("field").isin(small)).join(
        vocab.filter(~F.col("field").isin(small)).hint("shuffle_merge"), ["field", "value"]
    )
    return near.unionByName(far)


def positive_counts(train: DataFrame) -> DataFrame:
    """Training positives per item, repeats included."""
    return train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def content_vocabulary(
    items: DataFrame, counts: DataFrame, min_count: int = 1, max_tags: int = 4, id_min_count: int | None = None
) -> DataFrame:
    """Vocabularies of every content field, weighted by each item's training positives."""
    known = counts.join(items, "item_id", "left")
    fields = [*ITEM_FIELDS] + (["item"] if id_min_count is not None else [])
    singles = long_fields(known.withColumn("item", F.col("item_id")), ["n"], fields)
    tags = known.select("n", F.explode(tag_list(F.col("tag"), max_tags)).alias("_tag")).filter("_tag >= 0")
    tags = tags.select("n", F.lit("tag").alias("field"), F.col("_tag").cast("string").alias("value"))
    totals = singles.unionByName(tags).groupBy("field", "value").agg(F.sum("n").alias("n"))
    least = {"": min_count}
    if id_min_count is not None:
        least["item"] = id_min_count
    return vocabulary(totals, least)


def single_fields(sizes: dict[str, int]) -> list[str]:
    """Single-valued content fields in their fixed (sorted) order."""
    return [f for f in sorted(sizes) if f != "tag"]


def encode_items(
    items: DataFrame, catalog: DataFrame, vocab: DataFrame, sizes: dict[str, int], max_tags: int = 4
) -> DataFrame:
    """One row per catalog item: `fields`, one index per single field, and `tags`, 0-padded."""
    names = single_fields(sizes)
    described = catalog.select("item_id").join(items.drop("upload_dt"), "item_id", "left")
    coded = [f for f in names if f != "duration"]
    singles = long_fields(described.withColumn("item", F.col("item_id")), ["item_id"], coded)
    singles = singles.withColumn("slot", F.lit(0))
    tags = described.select("item_id", F.posexplode(tag_list(F.col("tag"), max_tags)).alias("slot", "_tag"))
    tags = tags.select("item_id", F.lit("tag").alias("field"), F.col("_tag").cast("string").alias("value"), "slot")
    known = encode(singles.unionByName(tags.filter("_tag >= 0")), vocab, sizes)

    def index(condition: Column) -> Column:
        return F.coalesce(F.max(F.when(condition, F.col("idx"))), F.lit(0)).cast("int")

    field = F.col("field")
    wide = known.groupBy("item_id").agg(
        *[index(field == f).alias(f"_f_{f}") for f in coded],
        *[index((field == "tag") & (F.col("slot") == i)).alias(f"_t_{i}") for i in range(max_tags)],
    )
    duration = duration_index(F.col("video_duration")).cast("int")
    joined = described.select("item_id", duration.alias("_f_duration")).join(wide, "item_id", "left")
    return joined.select(
        "item_id",
        F.array(*[F.coalesce(F.col(f"_f_{f}"), F.lit(0)) for f in names]).alias("fields"),
        F.array(*[F.coalesce(F.col(f"_t_{i}"), F.lit(0)) for i in range(max_tags)]).alias("tags"),
    )


def user_vocabulary(users: DataFrame) -> DataFrame:
    counts = long_fields(users, [], USER_FIELDS).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary(counts)


def encode_users(users: DataFrame, vocab: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """One row per user: `profile`, one index per profile field in sorted order."""
    names = sorted(sizes)
    known = encode(long_fields(users, ["user_id"], names), vocab, sizes)
    wide = known.groupBy("user_id").agg(
        *[F.coalesce(F.max(F.when(F.col("field") == f, F.col("idx"))), F.lit(0)).cast("int").alias(f"_f_{f}") for f in names]
    )
    joined = users.select("user_id").join(wide, "user_id", "left")
    return joined.select("user_id", F.array(*[F.coalesce(F.col(f"_f_{f}"), F.lit(0)) for f in names]).alias("profile"))


def history_snapshots(positives: DataFrame, requests: DataFrame, max_len: int) -> DataFrame:
    """Each request's last `max_len` positives strictly before its day, -1 padded on the left.

    `positives` has `(user_id, item_id, date, time_ms)`, `requests` distinct
    `(user_id, date)`. A user's day is cut to its last `max_len` positives
    before anything is collected, so a user never holds more than that many
    items per calendar day, however active.
    """
    latest = Window.partitionBy("user_id", "date").orderBy(F.col("time_ms").desc(), F.col("item_id").desc())
    cut = (
        positives.select("user_id", "item_id", "date", "time_ms")
        .withColumn("_r", F.row_number().over(latest))
        .filter(F.col("_r") <= max_len)
    )
    ordered = F.sort_array(F.collect_list(F.struct("time_ms", "item_id")))
    days = cut.groupBy("user_id", "date").agg(ordered.getField("item_id").alias("_items"))
    by_day = Window.partitionBy("user_id").orderBy("_day")
    recent = by_day.rowsBetween(-(max_len - 1), Window.currentRow)
    flat = F.flatten(F.collect_list("_items").over(recent))
    through = days.withColumn("_day", day_number(F.col("date"))).withColumn("_flat", flat)
    through = through.select(
        "user_id",
        "_day",
        F.slice("_flat", F.greatest(F.size("_flat") - max_len + 1, F.lit(1)), max_len).alias("_through"),
        F.lit(None).cast("date").alias("date"),
    )
    asked = requests.select(
        "user_id", day_number(F.col("date")).alias("_day"), F.lit(None).cast("array<bigint>").alias("_through"), "date"
    )
    before = by_day.rangeBetween(Window.unboundedPreceding, -1)
    both = through.unionByName(asked).withColumn("_last", F.last("_through", ignorenulls=True).over(before))
    found = F.coalesce(F.col("_last"), F.array().cast("array<bigint>"))
    padding = F.array_repeat(F.lit(-1).cast("bigint"), F.lit(max_len) - F.size(found))
    return both.filter(F.col("date").isNotNull()).select("user_id", "date", F.concat(padding, found).alias("history"))


def _newest_cells(rows: DataFrame, cell: str, max_examples: int) -> DataFrame:
    """Cells of `rows`, newest first, that begin within the limit: their size and what is newer (`_before`)."""
    newer = Window.partitionBy(F.lit(1)).orderBy(F.col("date").desc(), F.col(cell).desc())
    newer = newer.rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("date", cell).agg(F.count(F.lit(1)).alias("_n"), F.max("_base").alias("_base"))
    before = F.col("_base") + F.coalesce(F.sum("_n").over(newer), F.lit(0))
    return cells.select("date", cell, "_n", before.alias("_before")).filter(F.col("_before") < max_examples)


def recent_examples(positives: DataFrame, max_examples: int | None) -> DataFrame:
    """The latest `max_examples` positives; all of them when None.

    Whole hours are kept or dropped from their counts, then whole milliseconds of the
    hour that the limit falls into; only the rows of one millisecond are ordered.
    """
    if max_examples is None:
        return positives
    columns = positives.columns
    hour = F.floor(F.col("time_ms") / 3_600_000)
    rows = positives.withColumn("_hour", hour).withColumn("_base", F.lit(0).cast("bigint"))
    parts = []
    for cell in ("_hour", "time_ms"):
        marked = rows.drop("_base").join(_newest_cells(rows, cell, max_examples), ["date", cell])
        whole = F.col("_before") + F.col("_n") <= max_examples
        parts.append(marked.filter(whole).select(*columns))
        rows = marked.filter(~whole).withColumn("_base", F.col("_before")).drop("_n", "_before")
    order = Window.partitionBy("date", "time_ms").orderBy(F.col("user_id").desc(), F.col("item_id").desc())
    edge = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.lit(max_examples) - F.col("_base"))
    return parts[0].unionByName(parts[1]).unionByName(edge.select(*columns))


def log_sampling(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    """log-Q per catalog item: log of its share of the training positives, at least one."""
    total = F.greatest(F.coalesce(counts.agg(F.sum("n")).scalar(), F.lit(1)), F.lit(1)).cast("double")
    joined = catalog.select("item_id").join(counts, "item_id", "left")
    share = F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).cast("double") / total
    return joined.select("item_id", F.ln(share).alias("log_q"))


def fit_vocabularies(
    items: DataFrame, users: DataFrame, counts: DataFrame, min_count: int, max_tags: int, id_min_count: int | None
) -> tuple[DataFrame, dict[str, int], DataFrame, dict[str, int]]:
    """Content and profile vocabularies, written out, with their sizes."""
    content = materialize(content_vocabulary(items, counts, min_count, max_tags, id_min_count), "content-vocabulary")
    names = [*ITEM_FIELDS, "tag"] + (["item"] if id_min_count is not None else [])
    sizes = vocabulary_sizes(content, names) | {"duration": DURATION_SIZE}
    profile = materialize(user_vocabulary(users), "profile-vocabulary")
    return content, sizes, profile, vocabulary_sizes(profile, USER_FIELDS)
