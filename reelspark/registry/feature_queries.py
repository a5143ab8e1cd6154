"""Point-in-time features (D).

The SQL recomputes every total by brute force: each requested (entity, day) is
joined with all earlier days of the entity.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions.expressions import day_number
from reelspark.operators import feature_cells
from reelspark.operators import point_in_time as pit
from reelspark.operators.asof import asof_join
from reelspark.operators.day_blocks import DayBlocks
from reelspark.params import FeatureParams
from reelspark.registry.common import query, view
from reelspark.session import materialize, scratch_path
from reelspark.sources import fixtures

PARAMS = FeatureParams()
KEYS = {"item": ["item_id"], "user": ["user_id"], "author": ["author_id"], "ua": ["user_id", "author_id"]}

# authors of every eleventh item are unknown, so null keys are exercised
view(
    "f_items",
    "SELECT * REPLACE (CASE WHEN item_id % 11 = 5 THEN NULL ELSE author_id END AS author_id) FROM fx_items",
    "fx_items",
)
view(
    "f_events",
    "SELECT x.*, i.author_id FROM fx_large x LEFT JOIN f_items i USING (item_id) WHERE x.source = 'standard'",
    "fx_large",
    "f_items",
)
view(
    "f_asked",
    "SELECT x.*, i.author_id FROM fx_large x LEFT JOIN f_items i USING (item_id)",
    "fx_large",
    "f_items",
)
_SUMS = {
    "impr": "count(*)",
    "click": "sum(is_click)",
    "lv": "sum(long_view)",
    "likes": "sum(is_like)",
    "play": "sum(play_time_ms)",
    "dur": "sum(duration_ms)",
}
view(
    "f_global",
    """
    SELECT q.date, coalesce(sum(e.c) / nullif(sum(e.n), 0), 0) AS g_ctr,
           coalesce(sum(e.v) / nullif(sum(e.n), 0), 0) AS g_lvr, coalesce(sum(e.l) / nullif(sum(e.n), 0), 0) AS g_likr
    FROM (SELECT DISTINCT date FROM f_asked) q
    LEFT JOIN (SELECT date, count(*) AS n, sum(is_click) AS c, sum(long_view) AS v, sum(is_like) AS l
               FROM f_events GROUP BY date) e ON e.date < q.date
    GROUP BY q.date
    """,
    "f_events",
    "f_asked",
)


def _view_sql(name: str) -> str:
    keys = KEYS[name]
    listed = ", ".join(keys)
    same = " AND ".join(f"d.{k} = q.{k}" for k in keys)
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    out = []
    for suffix, frame in (("all", "true"), ("3d", "d.date >= q.date - 3"), ("7d", "d.date >= q.date - 7")):
        got = {m: f"coalesce(sum(d.{m}) FILTER ({frame}), 0)" for m in _SUMS}
        out.append(f"cast({got['impr']} AS double) AS {name}_impr_{suffix}")
        out.append(f"cast({got['click']} AS double) AS {name}_click_{suffix}")
        for rate, m in (("ctr", "click"), ("lvr", "lv"), ("likr", "likes")):
            out.append(
                f"round(({got[m]} + 20.0::double * max(g.g_{rate})) / ({got['impr']} + 20.0::double) + 1e-11, 8) AS {name}_{rate}_{suffix}"
            )
        out.append(
            f"CASE WHEN {got['dur']} > 0 THEN round({got['play']} / {got['dur']} + 1e-11, 8) END AS {name}_play_ratio_{suffix}"
        )
    out.append(f"cast(q.date - max(d.date) AS bigint) AS {name}_days_since_last")
    out.append(f"cast(q.date - min(d.date) AS bigint) AS {name}_days_since_first")
    out.append(f"cast(count(d.date) AS double) AS {name}_active_days_all")
    sums = ", ".join(f"{sql} AS {m}" for m, sql in _SUMS.items())
    group = ", ".join(f"q.{k}" for k in keys)
    return f"""
    SELECT {group}, q.date, {", ".join(out)}
    FROM (SELECT DISTINCT {listed}, date FROM f_asked WHERE {known}) q
    LEFT JOIN (SELECT {listed}, date, {sums} FROM f_events GROUP BY {listed}, date) d
           ON {same} AND d.date < q.date
    JOIN f_global g ON g.date = q.date
    GROUP BY {group}, q.date
    """


for _name in KEYS:
    view(f"f_{_name}", _view_sql(_name), "f_global")


def _inputs(spark, d):
    large = fixtures.interactions_large(spark, d)
    items = fixtures.items(spark, d)
    unknown = F.col("item_id") % 11 == 5
    items = items.withColumn("author_id", F.when(~unknown, F.col("author_id")))
    asked = large.join(items.select("item_id", "author_id"), "item_id", "left")
    return large, items, pit.feature_events(large, items), asked


def _rounded(df):
    def is_ratio(c):
        return any(f"_{m}_" in c for m in ("ctr", "lvr", "likr", "play_ratio"))

    # shifted a little, so that no exact half is left for the engines to round differently
    return df.withColumns({c: F.round(F.col(c) + 1e-11, 8) for c in df.columns if is_ratio(c)})


def _view_frame(spark, d, name):
    large, items, _, asked = _inputs(spark, d)
    feature_view = next(v for v in pit.VIEWS if v.name == name)
    rates = pit.global_rates(pit.view_events(large, items, None), asked)
    events = pit.view_events(large, items, feature_view)
    return _rounded(pit.view_features(events, asked, feature_view, rates, PARAMS))


@query(
    "d1_feature_events",
    "SELECT author_id, count(*) AS rows, sum(is_click)::bigint AS clicks FROM f_events GROUP BY author_id",
    ("f_events",),
)
def feature_events(spark, d):
    events = _inputs(spark, d)[2]
    return events.groupBy("author_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("is_click").alias("clicks"))


def _daily_sql(name):
    keys = ", ".join(KEYS[name])
    known = " AND ".join(f"{k} IS NOT NULL" for k in KEYS[name])
    sums = ", ".join(f"cast({sql} AS double) AS {m}" for m, sql in _SUMS.items())
    return f"SELECT {keys}, date, {sums} FROM f_events WHERE {known} GROUP BY {keys}, date".replace(
        "AS play,", "AS play_ms,"
    ).replace("AS dur ", "AS dur_ms ")


def _register_daily(name):
    @query(f"d2_daily_totals_{name}", _daily_sql(name), ("f_events",))
    def daily(spark, d):
        return pit.daily_totals(_inputs(spark, d)[2], tuple(KEYS[name]))


for _name in KEYS:
    _register_daily(_name)


@query(
    "d2_daily_totals_global",
    "SELECT date, cast(count(*) AS double) AS impr, cast(sum(is_click) AS double) AS click FROM f_events GROUP BY date",
    ("f_events",),
)
def daily_totals_global(spark, d):
    return pit.daily_totals(_inputs(spark, d)[2], ()).select("date", "impr", "click")


@query(
    "d3_running_totals",
    """
    WITH a AS (SELECT author_id, date, count(*) AS n, sum(is_click) AS c FROM f_events WHERE author_id IS NOT NULL
               GROUP BY author_id, date)
    SELECT q.author_id, q.date, cast(sum(p.n) AS double) AS impr, cast(sum(p.c) AS double) AS click,
           count(*) AS days, min(p.date) AS first_date
    FROM a q JOIN a p ON p.author_id = q.author_id AND p.date <= q.date GROUP BY q.author_id, q.date
    """,
    ("f_events",),
)
def running_totals(spark, d):
    totals = pit.running_totals(_inputs(spark, d)[2], ("author_id",))
    return totals.select("author_id", "date", "impr", "click", "days", "first_date")


def _register_columns(key, name, pattern_columns):
    columns = [*KEYS[name], "date", *pattern_columns]

    @query(key, f"SELECT {', '.join(columns)} FROM f_{name}", (f"f_{name}",))
    def part(spark, d):
        return _view_frame(spark, d, name).select(*columns)


_register_columns("d4_lifetime_totals", "item", ["item_impr_all", "item_click_all"])
_register_columns("d5_window_totals", "author", [f"author_{m}_{w}" for w in ("3d", "7d") for m in ("impr", "click")])
_register_columns("d6_smoothed_rates", "user", [f"user_{m}_{w}" for w in ("all", "3d", "7d") for m in ("ctr", "lvr", "likr")])
_register_columns("d8_play_ratio", "user", [f"user_play_ratio_{w}" for w in ("all", "3d", "7d")])
_register_columns("d9_days_since", "item", ["item_days_since_last", "item_days_since_first"])
_register_columns("d10_active_days", "ua", ["ua_active_days_all"])


@query(
    "d7_global_rates",
    "SELECT date, round(g_ctr, 8) AS g_ctr, round(g_lvr, 8) AS g_lvr, round(g_likr, 8) AS g_likr FROM f_global",
    ("f_global",),
)
def global_rates(spark, d):
    _, _, events, asked = _inputs(spark, d)
    rates = pit.global_rates(events, asked)
    return rates.withColumns({c: F.round(c, 8) for c in ("g_ctr", "g_lvr", "g_likr")})


@query(
    "d11_snapshots",
    "SELECT DISTINCT user_id, author_id, date FROM f_asked WHERE author_id IS NOT NULL",
    ("f_asked",),
)
def snapshots(spark, d):
    return pit.snapshots(_inputs(spark, d)[3], pit.VIEWS[3])


def _register_view(name):
    @query(f"d14_view_{name}", f"SELECT * FROM f_{name}", (f"f_{name}",))
    def features(spark, d):
        return _view_frame(spark, d, name)


for _name in KEYS:
    _register_view(_name)


_STATIC_SQL = f"""
    i.author_id AS item_author_id, {", ".join(f"i.{c} AS item_{c}" for c in pit.ITEM_STATIC)},
    cast(q.date - i.upload_dt AS bigint) AS item_age_days,
    CASE WHEN regexp_full_match(split_part(i.tag, ',', 1), '[0-9]+')
         THEN cast(split_part(i.tag, ',', 1) AS integer) END AS item_primary_tag,
    {", ".join(f"u.{c} AS user_{c}" for c in pit.USER_STATIC)}
"""
_ROW = "q.user_id, q.item_id, q.date, q.time_ms, q.tab, q.is_click"


@query(
    "d13_static_features",
    f"SELECT {_ROW}, {_STATIC_SQL} FROM f_asked q LEFT JOIN f_items i ON i.item_id = q.item_id "
    "LEFT JOIN fx_users u ON u.user_id = q.user_id",
    ("f_asked", "fx_users"),
)
def static_features(spark, d):
    large, items, _, _ = _inputs(spark, d)
    examples = large.select("user_id", "item_id", "date", "time_ms", "tab", "is_click")
    return pit.static_features(examples, items, fixtures.users(spark, d))


def _all_columns():
    parts = []
    for name, keys in KEYS.items():
        parts.append(f"v_{name}.* EXCLUDE ({', '.join(keys)}, date)")
    return ", ".join(parts)


def _view_joins():
    joins = []
    for name, keys in KEYS.items():
        on = " AND ".join(f"v_{name}.{k} = q.{k}" for k in [*keys, "date"])
        joins.append(f"LEFT JOIN f_{name} v_{name} ON {on}")
    return " ".join(joins)


_EVERYTHING = tuple(f"f_{n}" for n in KEYS) + ("fx_users",)


@query(
    "d12_assembly_nulls",
    f"""
    SELECT count(*) AS rows, count(v_author.author_impr_all) AS with_author, count(v_ua.ua_impr_all) AS with_ua,
           count(*) FILTER (v_author.author_impr_all = 0) AS known_author_without_history,
           count(v_item.item_impr_all) AS with_item
    FROM f_asked q {_view_joins()}
    """,
    _EVERYTHING,
)
def assembly_nulls(spark, d):
    """A null author leaves nulls; a known author without history gets zeros."""
    out = _features(spark, d)
    return out.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("author_impr_all").alias("with_author"),
        F.count("ua_impr_all").alias("with_ua"),
        F.count_if(F.col("author_impr_all") == 0).alias("known_author_without_history"),
        F.count("item_impr_all").alias("with_item"),
    )


def _feature_inputs(spark, d):
    large, items, _, _ = _inputs(spark, d)
    large = materialize(large, "interactions")  # the processed table, as a user would have it
    examples = large.select("user_id", "item_id", "date", "time_ms", "tab", "is_click")
    return examples, large, items, fixtures.users(spark, d)


def _features(spark, d):
    return pit.historical_features(*_feature_inputs(spark, d), PARAMS)


@query(
    "d15_historical_features",
    f"SELECT {_ROW}, {_STATIC_SQL}, {_all_columns()} FROM f_asked q LEFT JOIN f_items i ON i.item_id = q.item_id "
    f"LEFT JOIN fx_users u ON u.user_id = q.user_id {_view_joins()}",
    _EVERYTHING,
)
def historical_features(spark, d):
    return _rounded(_features(spark, d))


@query(
    "d15_features_by_cell",
    f"SELECT {_ROW}, {_STATIC_SQL}, {_all_columns()} FROM f_asked q LEFT JOIN f_items i ON i.item_id = q.item_id "
    f"LEFT JOIN fx_users u ON u.user_id = q.user_id {_view_joins()}",
    _EVERYTHING,
)
def features_by_cell(spark, d):
    """The same features shipped to examples stored in buckets, written and read back."""
    path = scratch_path(spark, "features")
    feature_cells.write_features_by_cell(*_feature_inputs(spark, d), path, PARAMS)
    return _rounded(spark.read.parquet(path))


@query(
    "a6_write_features",
    """
    SELECT split, source, count(*) AS rows, sum(is_click)::bigint AS clicks FROM fx_x WHERE split <> 'unused'
    GROUP BY split, source
    """,
    ("fx_x",),
)
def write_features(spark, d):
    """Features of all eval sets in one job, written partitioned and read back."""
    path = scratch_path(spark, "features")
    pit.write_features(fixtures.interactions(spark, d), fixtures.items(spark, d), fixtures.users(spark, d), path)
    written = spark.read.parquet(path)
    return written.groupBy("split", "source").agg(
        F.count("item_ctr_7d").alias("rows"), F.sum("is_click").alias("clicks")
    )


@query(
    "j1_asof_item_totals",
    """
    WITH t AS (SELECT item_id, date, sum(count(*)) OVER (PARTITION BY item_id ORDER BY date) AS impr
               FROM f_events GROUP BY item_id, date),
    q AS (SELECT DISTINCT item_id, date FROM f_asked)
    SELECT q.item_id, q.date, cast(coalesce(a.impr, 0) AS double) AS impr,
           cast(coalesce(a.impr, 0) - coalesce(w.impr, 0) AS double) AS impr_7d
    FROM q ASOF LEFT JOIN t a ON a.item_id = q.item_id AND q.date > a.date
           ASOF LEFT JOIN t w ON w.item_id = q.item_id AND q.date - 7 > w.date
    """,
    ("f_events", "f_asked"),
)
def asof_item_totals(spark, d):
    """As-of join and windowed difference as range frames, against a native as-of join."""
    _, _, events, asked = _inputs(spark, d)
    totals = pit.snapshot_totals(events, asked, ("item_id",), (7,))
    return totals.select(
        "item_id", "date", F.col("_impr_all").alias("impr"), F.col("_impr_7d").alias("impr_7d")
    )


view(
    # Of rows of one time the largest other columns count, so that both engines take the same one.
    "f_liked_rows",
    "SELECT user_id, time_ms, max((item_id, long_view, play_time_ms)) AS row FROM f_events WHERE is_click = 1 GROUP BY user_id, time_ms",
    "f_events",
)


def _asof_sql(sign: str) -> str:
    return f"""
    SELECT q.user_id, q.item_id, q.time_ms, a.time_ms AS asof_time_ms, a.row[1] AS asof_item_id, a.row[2] AS asof_long_view, a.row[3] AS asof_play_time_ms
    FROM f_asked q ASOF LEFT JOIN f_liked_rows a ON a.user_id = q.user_id AND q.time_ms {sign} a.time_ms
    """


def _liked_before(spark, d, inclusive: bool):
    _, _, events, asked = _inputs(spark, d)
    liked = events.filter("is_click = 1").select("user_id", "time_ms", "item_id", "long_view", "play_time_ms")
    return asof_join(asked.select("user_id", "item_id", "time_ms"), liked, ["user_id"], "time_ms", inclusive=inclusive)


@query("j1_asof_rows", _asof_sql(">"), ("f_asked", "f_liked_rows"))
def asof_rows(spark, d):
    """Each impression with what its user clicked last before it, as a whole row."""
    return _liked_before(spark, d, False)


@query("j1_asof_rows_inclusive", _asof_sql(">="), ("f_asked", "f_liked_rows"))
def asof_rows_inclusive(spark, d):
    """The same, with clicks of the same instant."""
    return _liked_before(spark, d, True)


#: Days appended one by one; those before are built together.
NEW_DAYS = 3


def _incremental_view(spark, d, name):
    """A view from stored blocks of days: all but the last days at once, these appended one after the other."""
    large, items, _, asked = _inputs(spark, d)
    feature_view = next(v for v in pit.VIEWS if v.name == name)
    events = materialize(pit.view_events(large, items, feature_view), "view-events")
    low, high = events.agg(F.min(day_number(F.col("date"))), F.max(day_number(F.col("date")))).first()
    blocks = DayBlocks(spark, scratch_path(spark, "day-blocks"), feature_view.keys)
    blocks.append(events, low, high - NEW_DAYS)
    for day in range(high - NEW_DAYS + 1, high + 1):
        blocks.append(events.filter(day_number(F.col("date")) == day), day)
    rates = pit.global_rates(pit.view_events(large, items, None), asked)
    return _rounded(pit.view_columns(blocks.snapshot_totals(asked, PARAMS.windows), feature_view, rates, PARAMS))


@query("d14_incremental_view_item", "SELECT * FROM f_item", ("f_item",))
def incremental_view_item(spark, d):
    return _incremental_view(spark, d, "item")


@query("d14_incremental_view_ua", "SELECT * FROM f_ua", ("f_ua",))
def incremental_view_ua(spark, d):
    return _incremental_view(spark, d, "ua")
