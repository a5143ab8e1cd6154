"""Exploratory queries (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import explore
from reelspark.registry.common import query
from reelspark.sources import fixtures

_OVERLAP = "date >= (SELECT min(date) FROM fx_overlap WHERE source = 'random')"
_EXPOSURE = f"""
WITH e AS (
    SELECT item_id, count(*) FILTER (source = 'standard') AS standard_impressions,
           count(*) FILTER (source = 'random') AS random_impressions
    FROM fx_overlap WHERE {_OVERLAP} GROUP BY item_id),
c AS (SELECT 'standard' AS source, standard_impressions AS n FROM e
      UNION ALL SELECT 'random', random_impressions FROM e),
o AS (SELECT source, n, row_number() OVER (PARTITION BY source ORDER BY n) AS i,
             row_number() OVER (PARTITION BY source ORDER BY n DESC) AS d,
             count(*) OVER (PARTITION BY source) AS items, sum(n) OVER (PARTITION BY source) AS total FROM c)
"""


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "i1_overview",
    """
    SELECT source, split, count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items,
           cast(min(date) AS varchar) AS first_day, cast(max(date) AS varchar) AS last_day
    FROM fx_large GROUP BY source, split
    """,
    ("fx_large",),
)
def overview(spark, d):
    return explore.overview(fixtures.interactions_large(spark, d))


@query(
    "i2_feedback_rates",
    f"""
    SELECT source, count(*) AS impressions, round(avg(is_click), 6) AS click_rate,
           round(avg(long_view), 6) AS long_view_rate, round(avg(is_like), 6) AS like_rate,
           round(avg(CASE WHEN play_time_ms / nullif(duration_ms, 0) > 3 THEN 3
                          ELSE play_time_ms / nullif(duration_ms, 0) END), 6) AS play_ratio
    FROM fx_overlap WHERE {_OVERLAP} GROUP BY source
    """,
    ("fx_overlap",),
)
def feedback_rates(spark, d):
    out = explore.feedback_rates(fixtures.interactions_overlap(spark, d))
    return _rounded(out, "click_rate", "long_view_rate", "like_rate", "play_ratio")


@query("i3_item_exposure", _EXPOSURE + "SELECT * FROM e", ("fx_overlap",))
def item_exposure(spark, d):
    return explore.item_exposure(fixtures.interactions_overlap(spark, d))


@query(
    "i4_exposure_concentration",
    _EXPOSURE
    + """
    SELECT source, count(*) FILTER (n > 0) AS items_shown,
           round(sum(n) FILTER (d <= greatest(1, items // 100)) / sum(n), 6) AS top_1pct_share,
           round(sum((2 * i - items - 1) * n) / (max(items) * max(total)), 6) AS gini
    FROM o GROUP BY source
    """,
    ("fx_overlap",),
)
def exposure_concentration(spark, d):
    return _rounded(
        explore.exposure_concentration(fixtures.interactions_overlap(spark, d)), "top_1pct_share", "gini"
    )


@query(
    "i5_lorenz_curve",
    _EXPOSURE
    + """
    SELECT source, n AS count_per_item, round(max(i) / max(items), 6) AS items_share,
           round((SELECT sum(c.n) FROM c WHERE c.source = o.source AND c.n <= o.n) / max(total), 6)
               AS impressions_share
    FROM o GROUP BY source, n
    """,
    ("fx_overlap",),
)
def lorenz_curve(spark, d):
    return _rounded(
        explore.lorenz_curve(fixtures.interactions_overlap(spark, d)), "items_share", "impressions_share"
    )


@query(
    "i6_exposure_vs_quality",
    f"""
    WITH shown AS (SELECT item_id, count(*) AS n FROM fx_overlap WHERE source = 'standard' AND {_OVERLAP}
                   GROUP BY item_id),
    measured AS (SELECT item_id, avg(is_click) AS ctr FROM fx_overlap WHERE source = 'random'
                 GROUP BY item_id HAVING count(*) >= 5),
    b AS (SELECT ctr, coalesce(n, 0) AS n,
                 ntile(5) OVER (ORDER BY coalesce(n, 0), md5('ntile:' || cast(item_id AS varchar))) AS bucket
          FROM measured LEFT JOIN shown USING (item_id))
    SELECT cast(bucket AS bigint) AS standard_exposure_bucket, count(*) AS items,
           cast(median(n) AS double) AS median_standard_impr, round(avg(ctr), 6) AS random_click_rate
    FROM b GROUP BY bucket
    """,
    ("fx_overlap",),
)
def exposure_vs_quality(spark, d):
    out = explore.exposure_vs_quality(fixtures.interactions_overlap(spark, d), 5)
    return _rounded(out, "random_click_rate")


@query(
    "i7_sparsity",
    """
    WITH u AS (SELECT source, user_id, count(*) AS n FROM fx_large GROUP BY source, user_id)
    SELECT x.source, round(count(DISTINCT (user_id, item_id)) /
                           (count(DISTINCT user_id) * count(DISTINCT item_id)), 9) AS density,
           (SELECT cast(median(n) AS double) FROM u WHERE u.source = x.source) AS median_impr_per_user,
           (SELECT round(quantile_cont(n, 0.9), 6) FROM u WHERE u.source = x.source) AS p90_impr_per_user
    FROM fx_large x GROUP BY x.source
    """,
    ("fx_large",),
)
def sparsity(spark, d):
    out = explore.sparsity(fixtures.interactions_large(spark, d))
    return _rounded(_rounded(out, "density", digits=9), "p90_impr_per_user")


@query(
    "i8_daily_volume",
    """
    SELECT date, count(*) FILTER (source = 'standard') AS standard, count(*) FILTER (source = 'random') AS random
    FROM fx_large GROUP BY date
    """,
    ("fx_large",),
)
def daily_volume(spark, d):
    return explore.daily_volume(fixtures.interactions_large(spark, d))


@query(
    "i9_tab_mix",
    f"""
    WITH w AS (SELECT * FROM fx_overlap WHERE {_OVERLAP})
    SELECT tab,
           round(count(*) FILTER (source = 'standard') / (SELECT count(*) FROM w WHERE source = 'standard'), 6)
               AS standard_share,
           round(count(*) FILTER (source = 'random') / (SELECT count(*) FROM w WHERE source = 'random'), 6)
               AS random_share,
           round(avg(is_click) FILTER (source = 'standard'), 6) AS standard_click_rate,
           round(avg(is_click) FILTER (source = 'random'), 6) AS random_click_rate
    FROM w GROUP BY tab
    """,
    ("fx_overlap",),
)
def tab_mix(spark, d):
    out = explore.tab_mix(fixtures.interactions_overlap(spark, d))
    return _rounded(out, "standard_share", "random_share", "standard_click_rate", "random_click_rate")


@query(
    "i10_within_user_rates",
    f"""
    WITH w AS (SELECT * FROM fx_overlap WHERE {_OVERLAP}),
    u AS (SELECT user_id, avg(is_click) FILTER (source = 'standard') AS cs, avg(is_click) FILTER (source = 'random') AS cr,
                 avg(long_view) FILTER (source = 'standard') AS ls, avg(long_view) FILTER (source = 'random') AS lr
          FROM w GROUP BY user_id
          HAVING count(*) FILTER (source = 'standard') >= 5 AND count(*) FILTER (source = 'random') >= 5),
    l AS (SELECT 'is_click' AS label, cs AS s, cr AS r FROM u UNION ALL SELECT 'long_view', ls, lr FROM u)
    SELECT label, count(*) AS users, round(avg(s), 6) AS standard_rate, round(avg(r), 6) AS random_rate,
           round(avg(s - r), 6) AS mean_difference,
           round(avg(CASE WHEN s > r THEN 1.0 ELSE 0.0 END), 6) AS share_users_higher_on_standard
    FROM l GROUP BY label
    """,
    ("fx_overlap",),
)
def within_user_rates(spark, d):
    out = explore.within_user_rates(fixtures.interactions_overlap(spark, d))
    return _rounded(out, "standard_rate", "random_rate", "mean_difference", "share_users_higher_on_standard")
