"""Point-in-time features: every value uses only events dated before the example's day.

Per feature view there is one aggregation, over the events and the requested
(entity, day) snapshots together, to one row per entity and day; a range frame
that ends at the day before then yields every total. A window task therefore
sees at most one row per calendar day and entity, however many impressions an
entity has, and no as-of join is needed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.expressions import day_number, primary_tag_feature
from reelspark.operators.contracts import check_leakage
from reelspark.params import FeatureParams
from reelspark.session import materialize


@dataclass(frozen=True)
class FeatureView:
    """Features aggregated over one entity key; the name prefixes their columns."""

    name: str
    keys: tuple[str, ...]


# The four entity views and the static columns.
VIEWS = (
    FeatureView("item", ("item_id",)),
    FeatureView("user", ("user_id",)),
    FeatureView("author", ("author_id",)),
    FeatureView("ua", ("user_id", "author_id")),
)
ITEM_STATIC = ("video_type", "upload_type", "video_duration", "music_type", "server_width", "server_height")
USER_STATIC = (
    "user_active_degree",
    "is_lowactive_period",
    "is_live_streamer",
    "is_video_author",
    "follow_user_num",
    "fans_user_num",
    "friend_user_num",
    "register_days",
    *(f"onehot_feat{i}" for i in range(18)),
)
# Daily sums, by name, and the event column each adds up (None counts rows).
MEASURES = {
    "impr": None,
    "click": "is_click",
    "lv": "long_view",
    "likes": "is_like",
    "play_ms": "play_time_ms",
    "dur_ms": "duration_ms",
}
RATES = {"ctr": "click", "lvr": "lv", "likr": "likes"}
#: Rows of features by author and day (180 bytes each) that a broadcast may hold.
AUTHOR_DAYS = 100_000


def feature_events(interactions: DataFrame, items: DataFrame, sources=("standard",)) -> DataFrame:
    """Events that may feed features, with their author."""
    authors = items.select("item_id", "author_id")
    return interactions.filter(F.col("source").isin(*sources)).join(authors, "item_id", "left")


def _measures(events: DataFrame) -> list[F.Column]:
    if set(MEASURES) <= set(events.columns):  # already summed
        return [F.col(name) for name in MEASURES]
    return [
        (F.lit(1) if source is None else F.col(source)).cast("double").alias(name) for name, source in MEASURES.items()
    ]


def view_events(interactions: DataFrame, items: DataFrame, view: FeatureView | None, sources=("standard",)) -> DataFrame:
    """What one view aggregates: raw events, or daily sums per item joined with their author.

    Only author views need the item table. Events are summed per item and day before
    the join, so a very popular item joins as one row per day. With users among the keys such
    sums would have nearly as many rows as the log, at the price of a shuffle of it; there the
    rows join as they are, and a hot item is left to Spark's splitting of skewed joins.
    """
    events = interactions.filter(F.col("source").isin(*sources))
    if view is None or "author_id" not in view.keys:
        return events
    others = [k for k in view.keys if k != "author_id"]
    per_item = events.select(*others, "item_id", "date", *_measures(events))
    if not others:
        per_item = per_item.groupBy("item_id", "date").agg(*[F.sum(m).alias(m) for m in MEASURES])
    return per_item.join(items.select("item_id", "author_id"), "item_id")


def _known(keys: tuple[str, ...]) -> F.Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def daily_totals(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sums per entity and active day; rows with a null key are dropped."""
    known = events.filter(_known(keys)) if keys else events
    rows = known.select(*keys, "date", *_measures(events))
    return rows.groupBy(*keys, "date").agg(*[F.sum(m).alias(m) for m in MEASURES])


def running_totals(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Totals through each active day, the count of active days and the first one."""
    through = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily_totals(events, keys).select(
        *keys,
        "date",
        *[F.sum(m).over(through).alias(m) for m in MEASURES],
        F.count(F.lit(1)).over(through).alias("days"),
        F.min("date").over(through).alias("first_date"),
    )


def _requests(examples: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    wanted = examples.filter(_known(keys)) if keys else examples
    zeros = [F.lit(0.0).alias(m) for m in MEASURES]
    return wanted.select(*keys, "date", *zeros, F.lit(True).alias("_asked"))


def snapshots(examples: DataFrame, view: FeatureView) -> DataFrame:
    """Distinct (entity, day) pairs a view must answer."""
    return _requests(examples, view.keys).select(*view.keys, "date").distinct()


def snapshot_totals(
    events: DataFrame, examples: DataFrame, keys: tuple[str, ...], windows: tuple[int, ...]
) -> DataFrame:
    """Totals before each requested day: lifetime and per window, zeros without history."""
    known = events.filter(_known(keys)) if keys else events
    happened = known.select(*keys, "date", *_measures(events), F.lit(False).alias("_asked"))
    per_day = (
        happened.unionByName(_requests(examples, keys))
        .groupBy(*keys, "date")
        .agg(*[F.sum(m).alias(m) for m in MEASURES], F.max("_asked").alias("_asked"))
        .withColumn("_day", day_number(F.col("date")))
        .withColumn("_active", F.when(F.col("impr") > 0, F.col("_day")))
    )
    entity = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    lifetime = entity.orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    frames = {"all": lifetime} | {f"{w}d": entity.orderBy("_day").rangeBetween(-w, -1) for w in windows}
    totals = [
        F.coalesce(F.sum(m).over(frame), F.lit(0.0)).alias(f"_{m}_{suffix}")
        for suffix, frame in frames.items()
        for m in MEASURES
    ]
    return per_day.select(
        *keys,
        "date",
        "_asked",
        *totals,
        (F.col("_day") - F.max("_active").over(lifetime)).alias("_since_last"),
        (F.col("_day") - F.min("_active").over(lifetime)).alias("_since_first"),
        F.coalesce(F.count("_active").over(lifetime), F.lit(0)).cast("double").alias("_active_days"),
    ).filter("_asked").drop("_asked")


def global_rates(events: DataFrame, examples: DataFrame) -> DataFrame:
    """Global rates as of each requested day: one row per calendar day, 0 before any event."""
    totals = snapshot_totals(events, examples, (), ())
    return totals.select(
        "date",
        *[
            F.coalesce(F.col(f"_{hits}_all") / F.nullif(F.col("_impr_all"), F.lit(0.0)), F.lit(0.0)).alias(f"g_{rate}")
            for rate, hits in RATES.items()
        ],
    )


def view_features(
    events: DataFrame, examples: DataFrame, view: FeatureView, rates: DataFrame, params: FeatureParams
) -> DataFrame:
    """One view's features per requested (entity, day), named `<view>_<metric>_<all|Nd>`."""
    return view_columns(snapshot_totals(events, examples, view.keys, params.windows), view, rates, params)


def view_columns(totals: DataFrame, view: FeatureView, rates: DataFrame, params: FeatureParams) -> DataFrame:
    """A view's features from its totals, whichever way these were found."""
    # one row per calendar day, so the broadcast does not grow with the log
    joined = totals.join(F.broadcast(rates), "date")
    return joined.select(*view.keys, "date", *_shown_columns(view, params))


def _shown_columns(view: FeatureView, params: FeatureParams, mark: str = "") -> list[F.Column]:
    """A view's features, from global rates and its totals, whose names begin with `mark`."""
    prior, prefix = F.lit(float(params.prior_strength)), view.name
    columns = []
    for suffix in ["all", *(f"{w}d" for w in params.windows)]:
        shown = F.col(f"{mark}_impr_{suffix}")
        columns.append(shown.alias(f"{prefix}_impr_{suffix}"))
        columns.append(F.col(f"{mark}_click_{suffix}").alias(f"{prefix}_click_{suffix}"))
        for rate, hits in RATES.items():
            smoothed = (F.col(f"{mark}_{hits}_{suffix}") + prior * F.col(f"g_{rate}")) / (shown + prior)
            columns.append(smoothed.alias(f"{prefix}_{rate}_{suffix}"))
        duration = F.col(f"{mark}_dur_ms_{suffix}")
        played = F.when(duration > 0, F.col(f"{mark}_play_ms_{suffix}") / duration)
        columns.append(played.alias(f"{prefix}_play_ratio_{suffix}"))
    columns.append(F.col(f"{mark}_since_last").alias(f"{prefix}_days_since_last"))
    columns.append(F.col(f"{mark}_since_first").alias(f"{prefix}_days_since_first"))
    columns.append(F.col(f"{mark}_active_days").alias(f"{prefix}_active_days_all"))
    return columns


def static_item_columns(items: DataFrame, leaky=()) -> DataFrame:
    return items.select(
        "item_id",
        F.col("author_id").alias("item_author_id"),
        *[F.col(c).alias(f"item_{c}") for c in ITEM_STATIC if c not in leaky],
        F.col("upload_dt").alias("_upload_dt"),
        primary_tag_feature(F.col("tag")).alias("item_primary_tag"),
    )


def static_user_columns(users: DataFrame, leaky=()) -> DataFrame:
    return users.select("user_id", *[F.col(c).alias(f"user_{c}") for c in USER_STATIC if c not in leaky])


def static_features(examples: DataFrame, items: DataFrame, users: DataFrame, leaky=()) -> DataFrame:
    """Examples with their item's and user's static columns and the item's age in days."""
    joined = examples.join(static_item_columns(items, leaky), "item_id", "left").join(
        static_user_columns(users, leaky), "user_id", "left"
    )
    age = F.datediff(F.col("date"), F.col("_upload_dt")).cast("bigint")
    return joined.withColumn("item_age_days", age).drop("_upload_dt")


def _matched(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Left join on key pairs, nulls matching nulls; the right side's keys are dropped."""
    other = right.withColumnsRenamed({k: f"_of_{k}" for k in keys.values()})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{v}")) for k, v in keys.items()])
    return left.join(other, same, "left").drop(*[f"_of_{k}" for k in keys.values()])


def _marked(totals: DataFrame, view: FeatureView) -> DataFrame:
    """Totals whose names tell their view."""
    return totals.withColumnsRenamed({c: f"_{view.name}{c}" for c in totals.columns if c not in (*view.keys, "date")})


@dataclass(frozen=True)
class FeatureTables:
    """What examples are joined with. Views travel as totals, which are short; their features are put in where rows arrive."""

    per_day: DataFrame
    """By item and day: totals of the item, static columns, and `_author`, whose features `shown` adds."""
    of_user: DataFrame
    """By user and day."""
    pairs: DataFrame
    """By user, author and day."""
    rates: DataFrame
    authors: DataFrame | None
    """Features by author and day if these are few; else they are among the columns of `per_day`."""
    params: FeatureParams

    def shown(self, df: DataFrame, *names: str) -> DataFrame:
        """`df` with the features of the views of these names instead of their totals."""
        views = [v for v in VIEWS if v.name in names and v.name != "author"]
        out = df
        if "author" in names:
            if self.authors is not None:
                days = self.authors.withColumnsRenamed({"author_id": "_of_author", "date": "_of_date"})
                same = (F.col("_author") == F.col("_of_author")) & (F.col("date") == F.col("_of_date"))
                out = out.join(F.broadcast(days), same, "left").drop("_of_author", "_of_date")
            out = out.drop("_author")
        # one row per calendar day, so the broadcast does not grow with the log
        of_day = self.rates.withColumnRenamed("date", "_of_date")
        out = out.join(F.broadcast(of_day), F.col("date") == F.col("_of_date"), "left")
        totals = tuple(f"_{v.name}_" for v in views)
        kept = [c for c in out.columns if not c.startswith(totals) and c not in of_day.columns]
        return out.select(*kept, *[c for v in views for c in _shown_columns(v, self.params, f"_{v.name}")])

    def columns(self) -> list[str]:
        """Names of all features, in their order."""
        names = {v.name: self._names(v) for v in VIEWS}
        static = [c for c in self.per_day.columns if not c.startswith("_") and not c.startswith("author_") and c not in ("item_id", "date")]
        of_user = [c for c in self.of_user.columns if not c.startswith("_") and c not in ("user_id", "date")]
        return [*names["item"], *names["author"], *static, *names["user"], *of_user, *names["ua"]]

    def _names(self, view: FeatureView) -> list[str]:
        frames = ["all", *(f"{w}d" for w in self.params.windows)]
        of_frame = [f"{view.name}_{m}_{s}" for s in frames for m in ("impr", "click", *RATES, "play_ratio")]
        return [*of_frame, *(f"{view.name}_{m}" for m in ("days_since_last", "days_since_first", "active_days_all"))]


def _null_safe(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Columns by which rows with equal keys, nulls included, are equal without null: `_f_<key>` and `_n_<key>`."""
    zero = {"date": "1970-01-01", "string": ""}
    return df.withColumns(
        {f"_f_{k}": F.coalesce(k, F.lit(zero.get(t, "0")).cast(t)) for k, t in df.dtypes if k in keys}
        | {f"_n_{k}": F.col(k).isNull() for k in keys}
    )


def _safe_names(*keys: str) -> list[str]:
    return [f"_{x}_{k}" for x in "fn" for k in keys]


def _safe_totals(totals: DataFrame, key: str) -> DataFrame:
    """Totals by `key` and day under the names of `_null_safe`; those of no day answer nobody."""
    return _null_safe(totals.filter(F.col("date").isNotNull()), (key, "date")).drop(key, "date")


def feature_tables(
    examples: DataFrame, interactions: DataFrame, items: DataFrame, users: DataFrame, params: FeatureParams
) -> FeatureTables:
    keys = ("user_id", "item_id", "author_id", "date")
    authors = items.select("item_id", "author_id")
    logged = interactions.filter(F.col("source").isin(*params.sources))
    daily = logged.select("user_id", "item_id", "date", *_measures(logged)).groupBy("user_id", "item_id", "date")
    daily = materialize(daily.agg(*[F.sum(m).alias(m) for m in MEASURES]).join(authors, "item_id", "left"), "daily")
    per_item = daily.groupBy("item_id", "author_id", "date").agg(*[F.sum(m).alias(m) for m in MEASURES])
    per_item = materialize(per_item, "item-days")
    asked = examples.select("user_id", "item_id", "date").distinct().join(authors, "item_id", "left")
    asked = materialize(asked.select(*keys), "asked")
    rates = materialize(global_rates(per_item, asked), "rates")
    totals = {
        v.name: _marked(snapshot_totals(daily if "user_id" in v.keys else per_item, asked, v.keys, params.windows), v)
        for v in VIEWS
        if v.name != "author"
    }
    author_view = next(v for v in VIEWS if v.name == "author")
    of_author = materialize(view_features(per_item, asked, author_view, rates, params), "author-days")
    few = of_author.count() <= AUTHOR_DAYS

    # The last join of either table has the keys that rows ask by: totals are shuffled by them once.
    per_day = _null_safe(asked.select("item_id", "author_id", "date").distinct(), ("item_id", "date"))
    per_day = per_day.withColumnRenamed("author_id", "_author")
    static = _null_safe(static_item_columns(items, params.leaky_columns), ("item_id",)).drop("item_id")
    per_day = per_day.join(static, _safe_names("item_id"), "left")
    age = F.datediff(F.col("date"), F.col("_upload_dt")).cast("bigint")
    per_day = per_day.withColumn("item_age_days", age).drop("_upload_dt")
    if not few:
        per_day = per_day.join(of_author.withColumnRenamed("author_id", "_author"), ["_author", "date"], "left")
    per_day = per_day.join(_safe_totals(totals["item"], "item_id"), _safe_names("item_id", "date"), "left")
    of_user = _null_safe(asked.select("user_id", "date").distinct(), ("user_id", "date"))
    of_user = of_user.join(static_user_columns(users, params.leaky_columns), "user_id", "left")
    of_user = of_user.join(_safe_totals(totals["user"], "user_id"), _safe_names("user_id", "date"), "left")
    pairs = totals["ua"].filter(F.col("date").isNotNull()).withColumnRenamed("author_id", "item_author_id")
    return FeatureTables(per_day, of_user, pairs, rates, of_author if few else None, params)


def historical_features(
    examples: DataFrame,
    interactions: DataFrame,
    items: DataFrame,
    users: DataFrame,
    params: FeatureParams | None = None,
) -> DataFrame:
    """Examples (user_id, item_id, date, …) with all their features.

    Keeps every input column and row. A null author leaves the author views
    null; a known author without history gets zeros. Row order is not a
    DataFrame property: carry a row id where an order matters.

    The log is summed once, to a row per user, item and day; what is asked is
    reduced once, to distinct keys and days. The views, and the static columns,
    are put together on those small sides, so the wide rows join twice: by item and
    day, and by user and day, where the totals of the user's authors that day are one map. They carry totals,
    which are short; features are made of them, and the few rows of authors join, after the last shuffle.
    """
    params = params or FeatureParams()
    tables = feature_tables(examples, interactions, items, users, params)
    of_item, of_user = _safe_names("item_id", "date"), _safe_names("user_id", "date")
    out = _null_safe(examples, ("user_id", "item_id", "date")).join(tables.per_day.drop("item_id", "date"), of_item, "left")
    # A user's day brings the totals of all its authors, so the widest rows are not shuffled by author as well.
    totals = [c for c in tables.pairs.columns if c not in ("user_id", "item_author_id", "date")]
    entry = F.struct("item_author_id", F.struct(*totals).alias("totals"))
    authors = _null_safe(tables.pairs, ("user_id", "date")).groupBy(*of_user)
    authors = authors.agg(F.map_from_entries(F.collect_list(entry)).alias("_authors"))
    out = out.join(tables.of_user.drop("user_id", "date").join(authors, of_user, "left"), of_user, "left")
    out = out.withColumn("_met", F.try_element_at("_authors", F.col("item_author_id")))
    out = out.withColumns({c: F.col(f"_met.{c}") for c in totals}).drop("_met", "_authors", *of_item, *of_user)
    out = tables.shown(out, "item", "author", "user", "ua")
    check_leakage(out, params.leaky_columns)
    passed = examples.columns
    return out.select(*passed, *[c for c in tables.columns() if c not in passed])


def write_features(
    interactions: DataFrame, items: DataFrame, users: DataFrame, path: str, params: FeatureParams | None = None
) -> None:
    """Features of all evaluation rows at once, partitioned by split and source."""
    examples = interactions.filter(F.col("split") != "unused")
    features = historical_features(examples, interactions, items, users, params)
    features.write.mode("overwrite").partitionBy("split", "source").parquet(path)
