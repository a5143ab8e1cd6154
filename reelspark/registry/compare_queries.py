"""Cross-release comparisons (K)."""

from __future__ import annotations

from reelspark.operators import compare
from reelspark.registry.common import FLAG_NAMES, query
from reelspark.registry.profile_queries import RELEASES, profiles, rounded
from reelspark.sources import fixtures

_CHECKS = ["null_or_unparseable_keys", "is_rand_mismatch", "date_time_mismatch", *[f"nonbinary_{c}" for c in FLAG_NAMES]]


def _all(table: str, columns: str = "*", releases=RELEASES) -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS version, {columns} FROM {table}_{r}" for r in releases)


def _names(table: str, releases=RELEASES) -> tuple[str, ...]:
    return tuple(f"{table}_{r}" for r in releases)


@query(
    "k1_contracts",
    f"""
    WITH f AS ({_all("files")}),
    l AS ({" UNION ALL ".join(f"SELECT version, file, source, rows, min_date, max_date, '{c}' AS \"check\", {c} AS offending_rows FROM f" for c in _CHECKS)})
    SELECT * FROM l WHERE "check" IN (SELECT "check" FROM l GROUP BY "check" HAVING sum(offending_rows) > 0)
    """,
    _names("files"),
)
def contracts(spark, d):
    return compare.contracts(profiles(spark, d))


@query(
    "k2_k3_random_log_identity",
    f"""
    WITH t AS (SELECT version, sum(rows)::bigint AS random_rows, sum(cast(fp_rows AS hugeint)) AS a,
                      sum(cast(fp_ids AS hugeint)) AS b
               FROM ({_all("daily")}) WHERE source = 'random' GROUP BY version)
    SELECT version, random_rows, a = (SELECT a FROM t WHERE version = 'full') AS same_rows_as_full,
           b = (SELECT b FROM t WHERE version = 'full') AS same_ids_as_full FROM t
    """,
    _names("daily"),
)
def random_log_identity(spark, d):
    """Fingerprint totals and whether they agree (K2, K3)."""
    return compare.random_log_identity(profiles(spark, d))


@query(
    "k4_pool_vs_full_pool",
    """
    WITH p AS (SELECT day, source, sum(rows)::bigint AS n, sum(cast(fp_rows AS hugeint)) AS fp FROM daily_pool GROUP BY ALL),
    f AS (SELECT day, source, sum(rows)::bigint AS n, sum(cast(fp_rows AS hugeint)) AS fp FROM daily_full
          WHERE in_pool GROUP BY ALL)
    SELECT day, source, coalesce(p.n, 0) AS pool_rows, coalesce(f.n, 0) AS full_pool_rows,
           coalesce(p.n, 0) - coalesce(f.n, 0) AS row_diff, coalesce(p.fp = f.fp, false) AS same_rows
    FROM (SELECT * FROM p WHERE day IS NOT NULL) p FULL JOIN (SELECT * FROM f WHERE day IS NOT NULL) f USING (day, source)
    UNION ALL SELECT NULL, source, n, 0, n, false FROM p WHERE day IS NULL
    UNION ALL SELECT NULL, source, 0, n, -n, false FROM f WHERE day IS NULL
    """,
    ("daily_pool", "daily_full"),
)
def pool_vs_full_pool(spark, d):
    return compare.pool_vs_full_pool(profiles(spark, d, ["full", "pool"]))


@query(
    "k5_sample_vs_full",
    """
    WITH s AS (SELECT user_id, source, sum(rows) AS n FROM activity_sample WHERE user_id IS NOT NULL GROUP BY ALL),
    f AS (SELECT user_id, source, sum(rows) AS n FROM activity_full
          WHERE user_id IN (SELECT user_id FROM s) GROUP BY ALL),
    j AS (SELECT user_id, bool_and(coalesce(s.n, 0) = coalesce(f.n, 0)) AS same, count(f.n) AS hits
          FROM s FULL JOIN f USING (user_id, source) GROUP BY user_id)
    SELECT count(*) AS users_in_sample, count(*) FILTER (hits > 0) AS found_in_full,
           count(*) FILTER (same) AS users_with_identical_counts FROM j
    """,
    ("activity_sample", "activity_full"),
)
def sample_vs_full(spark, d):
    return compare.sample_vs_full(profiles(spark, d, ["full", "sample"]))


@query(
    "k6_pool_coverage",
    " UNION ALL ".join(
        f"SELECT '{r}' AS version, (SELECT count(*) FROM pool_{r}) AS pool_items, "
        f"(SELECT count(*) FROM pool_{r} WHERE video_id IN (SELECT video_id FROM pool_full)) AS in_full_pool, "
        f"(SELECT count(*) FROM pool_{r} WHERE video_id NOT IN (SELECT video_id FROM pool_full)) AS not_in_full_pool, "
        f"(SELECT count(*) FROM pool_full WHERE video_id NOT IN (SELECT video_id FROM pool_{r})) AS full_pool_missing"
        for r in RELEASES
    ),
    _names("pool"),
)
def pool_coverage(spark, d):
    return compare.pool_coverage(profiles(spark, d))


@query(
    "k7_pool_upload_dates",
    """
    SELECT upload_dt AS upload_date, count(*) AS items,
           count(*) FILTER (first_standard_day IS NULL) AS never_shown_by_policy,
           cast(median(first_standard_day - upload_dt) AS double) AS median_days_to_first_standard,
           sum(standard_rows)::bigint AS standard_rows
    FROM pool_full GROUP BY upload_dt
    """,
    ("pool_full",),
)
def pool_upload_dates(spark, d):
    return compare.pool_upload_dates(profiles(spark, d, ["full"]))


_VOLUME = f"""
    WITH a AS ({_all("daily")}),
    v AS (SELECT version, day, source, 'all' AS scope, rows FROM a
          UNION ALL SELECT version, day, source, CASE WHEN in_pool THEN 'pool' ELSE 'non_pool' END, rows FROM a)
"""


@query(
    "k8_daily_volume_by_scope",
    _VOLUME + "SELECT version, day, source, scope, sum(rows)::bigint AS rows FROM v GROUP BY ALL",
    _names("daily"),
)
def daily_volume_by_scope(spark, d):
    return compare.daily_volume_by_scope(profiles(spark, d))


@query(
    "k8_daily_volume_table",
    _VOLUME
    + "SELECT day, "
    + ", ".join(
        f"(sum(rows) FILTER (version = '{r}' AND scope = '{s}'))::bigint AS {r}_{s}"
        for r in RELEASES
        for s in compare.SCOPES
    )
    + " FROM v WHERE source = 'standard' GROUP BY day",
    _names("daily"),
)
def daily_volume_table(spark, d):
    return compare.daily_volume_table(compare.daily_volume_by_scope(profiles(spark, d)), RELEASES)


@query(
    "k9_pool_share_per_user",
    """
    WITH u AS (SELECT user_id, coalesce(sum(rows) FILTER (in_pool), 0) AS p, sum(rows) AS n FROM activity_full
               WHERE source = 'standard' AND user_id IS NOT NULL GROUP BY user_id)
    SELECT 'full' AS version, count(*) AS users, round(sum(p) / sum(n), 6) AS overall_share,
           round(avg(p / n), 6) AS mean_share, round(quantile_cont(p / n, 0.1), 6) AS p10,
           round(quantile_cont(p / n, 0.25), 6) AS p25, round(quantile_cont(p / n, 0.5), 6) AS p50,
           round(quantile_cont(p / n, 0.75), 6) AS p75, round(quantile_cont(p / n, 0.9), 6) AS p90,
           count(*) FILTER (p = 0) AS users_with_no_pool_rows
    FROM u
    """,
    ("activity_full",),
)
def pool_share_per_user(spark, d):
    out = compare.pool_share_per_user(profiles(spark, d, ["full"]))
    return rounded(out, "overall_share", "mean_share", "p10", "p25", "p50", "p75", "p90")


@query(
    "k10_label_rates",
    f"""
    SELECT version, source, in_pool, sum(rows)::bigint AS rows, round(sum(clicks) / sum(rows), 6) AS click_rate,
           round(sum(long_views) / sum(rows), 6) AS long_view_rate
    FROM ({_all("daily")}) GROUP BY version, source, in_pool
    """,
    _names("daily"),
)
def label_rates(spark, d):
    return rounded(compare.label_rates(profiles(spark, d)), "click_rate", "long_view_rate")


def _group_columns(columns: dict[str, str], groups: dict[str, str]) -> str:
    return ", ".join(
        f"round(max({sql}) FILTER ({condition}), 6) AS {g}_{c}"
        for c, sql in columns.items()
        for g, condition in groups.items()
    )


_TAB_GROUPS = {
    f"{s}_{scope}": f"source = '{s}' AND {'in_pool' if scope == 'pool' else 'NOT in_pool'}"
    for s in ("standard", "random")
    for scope in ("pool", "non_pool")
}


@query(
    "k11_tab_mix",
    f"""
    WITH t AS (SELECT *, rows / sum(rows) OVER (PARTITION BY source, in_pool) AS share FROM tabs_full)
    SELECT tab, {_group_columns({"share": "share", "click_rate": "clicks / rows"}, _TAB_GROUPS)} FROM t GROUP BY tab
    """,
    ("tabs_full",),
)
def tab_mix(spark, d):
    out = compare.tab_mix(profiles(spark, d, ["full"]))
    return rounded(out, *[c for c in out.columns if c != "tab"])


def _register_typicality(attribute):
    order = compare.BUCKET_ORDER.get(attribute)
    rank = (
        "CASE bucket " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(order, 1)) + " END"
        if order
        else "NULL"
    )

    @query(
        f"k12_pool_typicality_{attribute}",
        f"""
        WITH a AS (SELECT *, rows / sum(rows) OVER (PARTITION BY in_pool) AS share FROM attributes_full
                   WHERE attribute = '{attribute}' AND source = 'standard')
        SELECT bucket, {_group_columns({"share": "share", "click_rate": "clicks / rows", "long_view_rate": "long_views / rows"},
                                       {"pool": "in_pool", "non_pool": "NOT in_pool"})},
               cast({rank} AS bigint) AS bucket_rank
        FROM a GROUP BY bucket
        """,
        ("attributes_full",),
    )
    def typicality(spark, d):
        out = compare.pool_typicality(profiles(spark, d, ["full"]), attribute)
        return rounded(out, *[c for c in out.columns if c.endswith(("share", "rate"))])


for _attribute in ("duration", "age_at_impression", "video_type", "upload_type"):
    _register_typicality(_attribute)


@query("k13_concentration", _all("concentration"), _names("concentration"))
def concentration(spark, d):
    return rounded(compare.concentration(profiles(spark, d)), "gini", "top_1pct_share")


def _sample_part(r: str) -> str:
    activity = (
        f"(SELECT sum(rows) AS n FROM activity_{r} WHERE source = 'standard' AND user_id IS NOT NULL GROUP BY user_id)"
    )
    return f"""
    SELECT '{r}' AS v, 'users' AS metric, count(*)::double AS value FROM u_{r}
    UNION ALL SELECT '{r}', 'median_standard_rows', median(n) FROM {activity}
    UNION ALL SELECT '{r}', 'p90_standard_rows', quantile_cont(n, 0.9) FROM {activity}
    UNION ALL SELECT '{r}', 'median_register_days', median(register_days) FROM u_{r}
    UNION ALL SELECT '{r}', 'share_video_authors', avg(is_video_author) FROM u_{r}
    UNION ALL SELECT '{r}', 'active_' || user_active_degree, count(*) / (SELECT count(user_active_degree) FROM u_{r})
              FROM u_{r} WHERE user_active_degree IS NOT NULL GROUP BY user_active_degree
    """


@query(
    "k14_user_sample",
    f"WITH l AS ({_sample_part('full')} UNION ALL {_sample_part('sample')}) "
    'SELECT metric, round(max(value) FILTER (v = \'full\'), 6) AS "full", '
    "round(max(value) FILTER (v = 'sample'), 6) AS sample FROM l GROUP BY metric",
    ("activity_full", "activity_sample", "u_full", "u_sample"),
)
def user_sample(spark, d):
    return rounded(compare.user_sample(profiles(spark, d, ["full", "sample"])), "full", "sample")


@query(
    "k15_clock_summary",
    f"""
    WITH c AS (SELECT *, coalesce(offset_days, 99) <> 0 AS off FROM ({_all("clock")})),
    g AS (SELECT version, file, sum(rows)::bigint AS n, coalesce(sum(rows) FILTER (off), 0)::bigint AS bad,
                 coalesce(sum(rows) FILTER (hourmin_hour = ts_hour), 0) AS agree,
                 sum(rows) FILTER (offset_days = -1) AS minus, sum(rows) FILTER (offset_days = 1) AS plus,
                 sum(rows) FILTER (off AND coalesce(offset_days, 99) NOT IN (-1, 1)) AS other,
                 coalesce(sum(rows) FILTER (off AND hourmin_hour = ts_hour), 0) AS same,
                 coalesce(sum(rows) FILTER (off AND hourmin_hour < ts_hour), 0) AS past
          FROM c GROUP BY version, file)
    SELECT version, file, n AS rows, bad AS mismatched, round(bad / n, 6) AS mismatch_share,
           round(agree / n, 6) AS hourmin_hour_matches_overall, round(minus / nullif(bad, 0), 6) AS offset_minus_1,
           round(plus / nullif(bad, 0), 6) AS offset_plus_1, round(other / nullif(bad, 0), 6) AS offset_other,
           round(same / nullif(bad, 0), 6) AS hourmin_hour_matches_time_ms,
           round(past / nullif(bad, 0), 6) AS hourmin_past_midnight
    FROM g
    """,
    _names("clock"),
)
def clock_summary(spark, d):
    out = compare.clock_summary(profiles(spark, d))
    return rounded(out, *[c for c in out.columns if c not in ("version", "file", "rows", "mismatched")])


_FILES = [name for _, name, _ in fixtures.RAW_FILES]


@query(
    "k16_clock_by_hour",
    "SELECT ts_hour, "
    + ", ".join(
        f"round(coalesce(sum(rows) FILTER (file = '{f}' AND coalesce(offset_days, 99) <> 0), 0) "
        f"/ sum(rows) FILTER (file = '{f}'), 6) AS {f.removesuffix('.csv')}"
        for f in _FILES
    )
    + " FROM clock_full WHERE ts_hour IS NOT NULL GROUP BY ts_hour",
    ("clock_full",),
)
def clock_by_hour(spark, d):
    out = compare.clock_by_hour(profiles(spark, d, ["full"]), _FILES)
    return rounded(out, *[c for c in out.columns if c != "ts_hour"])


@query(
    "k17_part_files",
    """
    WITH a AS (SELECT file_id, user_id, sum(rows) AS n, sum(date_mismatches) AS bad FROM activity_full
               WHERE user_id IS NOT NULL GROUP BY ALL),
    s AS (SELECT a.file_id, b.file_id AS other FROM files_full a JOIN files_full b
          ON a.source = b.source AND a.min_date = b.min_date AND a.file_id <> b.file_id)
    SELECT f.file, f.users, f.min_user_id, f.max_user_id,
           CASE WHEN f.file_id IN (SELECT file_id FROM s) THEN
               (SELECT count(*) FROM a WHERE a.file_id = f.file_id AND a.user_id IN
                   (SELECT o.user_id FROM a o JOIN s ON s.other = o.file_id WHERE s.file_id = f.file_id)) END
               AS users_also_in_sibling,
           (SELECT count(*) FROM a WHERE a.file_id = f.file_id AND bad > 0) AS users_with_mismatches,
           round((SELECT sum(bad) / sum(n) FROM a WHERE a.file_id = f.file_id AND bad > 0), 6)
               AS mismatch_rate_among_those_users
    FROM files_full f
    """,
    ("activity_full", "files_full"),
)
def part_files(spark, d):
    return rounded(compare.part_files(profiles(spark, d, ["full"])), "mismatch_rate_among_those_users")
