"""Comparisons across releases, over their profile tables.

`profiles` maps a release (`full`, `pool`, `sample`) to its profile tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import stats
from reelspark.operators.profile import BUCKET_ORDER
from reelspark.params import SOURCES

Profiles = dict[str, dict[str, DataFrame]]
SCOPES = ("all", "pool", "non_pool")


def need(profiles: Profiles, *releases: str) -> None:
    missing = [r for r in releases if r not in profiles]
    if missing:
        raise KeyError(f"needs profiles for {missing}")


def stacked(profiles: Profiles, table: str) -> DataFrame:
    """One table of every release, with the release as `version`."""
    parts = [tables[table].withColumn("version", F.lit(v)) for v, tables in profiles.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _total(fingerprint: str) -> Column:
    return F.sum(F.col(fingerprint).cast("decimal(38,0)")).cast("string")


def _ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def contracts(profiles: Profiles) -> DataFrame:
    """Failed checks per file in long form: only checks that found a problem somewhere."""
    files = stacked(profiles, "files")
    checks = [
        c for c in files.columns if c.endswith(("_keys", "_mismatch")) or c.startswith("nonbinary_")
    ]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(0)).alias("offending_rows")) for c in checks]
    )
    long = files.select("version", "file", "source", "rows", "min_date", "max_date", F.inline(pairs))
    # one row per (file, check): both sides are as small as the list of files
    failing = long.groupBy("check").agg(F.sum("offending_rows").alias("_bad")).filter("_bad > 0").select("check")
    return long.join(failing, "check", "left_semi")


def random_log_identity(profiles: Profiles) -> DataFrame:
    """Is each release's random log the same set of rows as the full release's?"""
    need(profiles, "full")
    totals = (
        stacked(profiles, "daily")
        .filter(F.col("source") == "random")
        .groupBy("version")
        .agg(F.sum("rows").cast("bigint").alias("random_rows"), _total("fp_rows").alias("_rows"), _total("fp_ids").alias("_ids"))
    )
    everyone = Window.partitionBy(F.lit(1))  # one row per release

    def full(column: str) -> Column:
        return F.max(F.when(F.col("version") == "full", F.col(column))).over(everyone)

    return totals.select(
        "version",
        "random_rows",
        (F.col("_rows") == full("_rows")).alias("same_rows_as_full"),
        (F.col("_ids") == full("_ids")).alias("same_ids_as_full"),
    )


def pool_vs_full_pool(profiles: Profiles) -> DataFrame:
    """Pool release vs the full release restricted to pool items, per day and source."""
    need(profiles, "pool", "full")
    keys = ["day", "source"]
    pool = profiles["pool"]["daily"].groupBy(*keys).agg(F.sum("rows").alias("_pool"), _total("fp_rows").alias("_pool_fp"))
    full = (
        profiles["full"]["daily"]
        .filter("in_pool")
        .groupBy(*keys)
        .agg(F.sum("rows").alias("_full"), _total("fp_rows").alias("_full_fp"))
    )
    pool_rows, full_rows = F.coalesce("_pool", F.lit(0)), F.coalesce("_full", F.lit(0))
    return pool.join(full, keys, "full_outer").select(
        *keys,
        pool_rows.cast("bigint").alias("pool_rows"),
        full_rows.cast("bigint").alias("full_pool_rows"),
        (pool_rows - full_rows).cast("bigint").alias("row_diff"),
        F.coalesce(F.col("_pool_fp") == F.col("_full_fp"), F.lit(False)).alias("same_rows"),
    )


def sample_vs_full(profiles: Profiles) -> DataFrame:
    """Do the sample's users have the same per-source row counts in the full release?"""
    need(profiles, "sample", "full")
    keys = ["user_id", "source"]

    def counts(release: str, name: str) -> DataFrame:
        activity = profiles[release]["user_activity"].filter(F.col("user_id").isNotNull())
        return activity.groupBy(*keys).agg(F.sum("rows").alias(name))

    sample = counts("sample", "_sample")
    full = counts("full", "_full").join(sample.select("user_id").distinct(), "user_id", "left_semi")
    per_user = (
        sample.join(full, keys, "full_outer")
        .groupBy("user_id")
        .agg(
            F.bool_and(F.coalesce("_sample", F.lit(0)) == F.coalesce("_full", F.lit(0))).alias("_same"),
            F.count("_full").alias("_found"),
        )
    )
    return per_user.agg(
        F.count(F.lit(1)).alias("users_in_sample"),
        F.count_if(F.col("_found") > 0).alias("found_in_full"),
        F.count_if("_same").alias("users_with_identical_counts"),
    )


def pool_coverage(profiles: Profiles) -> DataFrame:
    """Each release's pool against the full release's, from one grouping by item."""
    need(profiles, "full")
    versions = list(profiles)
    members = stacked(profiles, "pool").groupBy("video_id").agg(
        *[F.max((F.col("version") == v).cast("int")).alias(f"_in_{v}") for v in versions]
    )
    per_version = members.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(v).alias("version"), (F.col(f"_in_{v}") == 1).alias("mine"), (F.col("_in_full") == 1).alias("ref"))
                    for v in versions
                ]
            )
        )
    )
    mine, ref = F.col("mine"), F.col("ref")
    return per_version.groupBy("version").agg(
        F.count_if(mine).alias("pool_items"),
        F.count_if(mine & ref).alias("in_full_pool"),
        F.count_if(mine & ~ref).alias("not_in_full_pool"),
        F.count_if(~mine & ref).alias("full_pool_missing"),
    )


def pool_upload_dates(profiles: Profiles, release: str = "full") -> DataFrame:
    """Pool items by upload date, with how long the policy took to show them."""
    need(profiles, release)
    waited = F.datediff(F.col("first_standard_day"), F.col("upload_dt"))
    return (
        profiles[release]["pool"]
        .groupBy(F.col("upload_dt").alias("upload_date"))
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.count_if(F.col("first_standard_day").isNull()).alias("never_shown_by_policy"),
            F.percentile(waited, F.lit(0.5)).alias("median_days_to_first_standard"),
            F.sum("standard_rows").cast("bigint").alias("standard_rows"),
        )
    )


def daily_volume_by_scope(profiles: Profiles) -> DataFrame:
    """Rows per day, release, source and scope (all / pool / non-pool)."""
    scopes = F.array(F.lit("all"), F.when(F.col("in_pool"), "pool").otherwise("non_pool"))
    expanded = stacked(profiles, "daily").withColumn("scope", F.explode(scopes))
    return expanded.groupBy("version", "day", "source", "scope").agg(F.sum("rows").cast("bigint").alias("rows"))


def daily_volume_table(volume: DataFrame, versions, source: str = "standard") -> DataFrame:
    """One row per day, one column per release and scope."""
    names = [(v, s) for v in versions for s in SCOPES]
    return (
        volume.filter(F.col("source") == source)
        .groupBy("day")
        .agg(
            *[
                F.sum(F.when((F.col("version") == v) & (F.col("scope") == s), F.col("rows"))).alias(f"{v}_{s}")
                for v, s in names
            ]
        )
    )


def pool_share_per_user(profiles: Profiles, release: str = "full") -> DataFrame:
    """Share of each user's standard impressions that land on pool items."""
    need(profiles, release)
    per_user = (
        profiles[release]["user_activity"]
        .filter((F.col("source") == "standard") & F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.sum(F.when(F.col("in_pool"), F.col("rows")).otherwise(0)).alias("_pool"), F.sum("rows").alias("_all"))
        .withColumn("share", _ratio(F.col("_pool"), F.col("_all")))
    )
    probs = {0.1: "p10", 0.25: "p25", 0.5: "p50", 0.75: "p75", 0.9: "p90"}
    quantiles = stats.exact_quantiles(per_user, [], "share", list(probs)).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for p, name in probs.items()]
    )
    totals = per_user.agg(
        F.count(F.lit(1)).alias("users"),
        _ratio(F.sum("_pool"), F.sum("_all")).alias("overall_share"),
        F.avg("share").alias("mean_share"),
        F.count_if(F.col("_pool") == 0).alias("users_with_no_pool_rows"),
    )
    # two one-row frames, joined on a constant release name
    left = totals.withColumn("version", F.lit(release))
    return left.join(quantiles.withColumn("version", F.lit(release)), "version")


def label_rates(profiles: Profiles) -> DataFrame:
    sums = stacked(profiles, "daily").groupBy("version", "source", "in_pool").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("rows", "clicks", "long_views")]
    )
    return sums.select(
        "version",
        "source",
        "in_pool",
        "rows",
        _ratio(F.col("clicks"), F.col("rows")).alias("click_rate"),
        _ratio(F.col("long_views"), F.col("rows")).alias("long_view_rate"),
    )


def tab_mix(profiles: Profiles, release: str = "full") -> DataFrame:
    """Share of impressions and click rate per tab, per source and pool membership."""
    need(profiles, release)
    group = F.concat_ws("_", "source", F.when(F.col("in_pool"), "pool").otherwise("non_pool"))
    rows = profiles[release]["tabs"].withColumn("_group", group)
    rows = rows.withColumn("share", _ratio(F.col("rows"), F.sum("rows").over(Window.partitionBy("_group"))))
    rows = rows.withColumn("click_rate", _ratio(F.col("clicks"), F.col("rows")))
    groups = [f"{s}_{scope}" for s in SOURCES for scope in ("pool", "non_pool")]
    return rows.groupBy("tab").agg(
        *[
            F.max(F.when(F.col("_group") == g, F.col(c))).alias(f"{g}_{c}")
            for c in ("share", "click_rate")
            for g in groups
        ]
    )


def pool_typicality(profiles: Profiles, attribute: str, release: str = "full") -> DataFrame:
    """Standard impressions on pool vs other items, bucketed by an attribute.

    `bucket_rank` gives the display order where the attribute has a fixed one.
    """
    need(profiles, release)
    rows = (
        profiles[release]["attributes"]
        .filter((F.col("attribute") == attribute) & (F.col("source") == "standard"))
        .withColumn("_group", F.when(F.col("in_pool"), "pool").otherwise("non_pool"))
    )
    rows = rows.select(
        "bucket",
        "_group",
        _ratio(F.col("rows"), F.sum("rows").over(Window.partitionBy("_group"))).alias("share"),
        _ratio(F.col("clicks"), F.col("rows")).alias("click_rate"),
        _ratio(F.col("long_views"), F.col("rows")).alias("long_view_rate"),
    )
    order = BUCKET_ORDER.get(attribute)
    if order:
        # buckets outside the fixed order are not shown
        rank = F.array_position(F.array(*[F.lit(b) for b in order]), F.col("bucket"))
        rows = rows.filter(F.col("bucket").isin(*order))
    else:
        rank = F.lit(None).cast("bigint")
    return (
        rows.groupBy("bucket")
        .agg(
            *[
                F.max(F.when(F.col("_group") == g, F.col(c))).alias(f"{g}_{c}")
                for c in ("share", "click_rate", "long_view_rate")
                for g in ("pool", "non_pool")
            ]
        )
        .withColumn("bucket_rank", rank.cast("bigint"))
    )


def concentration(profiles: Profiles) -> DataFrame:
    return stacked(profiles, "concentration")


def user_sample(profiles: Profiles) -> DataFrame:
    """Is the sample fair? One row per metric, one column per release."""
    need(profiles, "sample", "full")
    chosen = {v: profiles[v] for v in ("full", "sample")}
    activity = (
        stacked(chosen, "user_activity")
        .filter((F.col("source") == "standard") & F.col("user_id").isNotNull())
        .groupBy("version", "user_id")
        .agg(F.sum("rows").alias("n"))
        .groupBy("version", "n")
        .agg(F.count(F.lit(1)).alias("m"))
        .groupBy("version")
        .agg(
            F.percentile("n", F.lit(0.5), F.col("m")).alias("median_standard_rows"),
            F.percentile("n", F.lit(0.9), F.col("m")).alias("p90_standard_rows"),
        )
    )
    users = stacked(chosen, "users")
    totals = users.groupBy("version").agg(
        F.count(F.lit(1)).cast("double").alias("users"),
        F.percentile("register_days", F.lit(0.5)).alias("median_register_days"),
        F.avg("is_video_author").alias("share_video_authors"),
    )
    degrees = users.filter(F.col("user_active_degree").isNotNull()).groupBy("version", "user_active_degree").count()
    share = _ratio(F.col("count"), F.sum("count").over(Window.partitionBy("version")))
    degree_rows = degrees.select(
        "version", F.concat(F.lit("active_"), "user_active_degree").alias("metric"), share.alias("value")
    )
    wide = totals.join(activity, "version")
    names = [c for c in wide.columns if c != "version"]
    long = wide.unpivot("version", names, "metric", "value").unionByName(degree_rows)
    return long.groupBy("metric").agg(
        *[F.max(F.when(F.col("version") == v, F.col("value"))).alias(v) for v in ("full", "sample")]
    )


def clock_summary(profiles: Profiles) -> DataFrame:
    """Per file: how often the date disagrees with the local clock, and which way.

    A row whose offset is unknown counts as a mismatch.
    """
    rows, offset = F.col("rows"), F.col("offset_days")
    off = ~offset.eqNullSafe(F.lit(0))
    same_hour = F.col("hourmin_hour") == F.col("ts_hour")
    past = F.col("hourmin_hour") < F.col("ts_hour")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, rows)), F.lit(0))

    def if_any(condition: Column) -> Column:
        return F.sum(F.when(off & condition, rows))

    sums = (
        stacked(profiles, "clock")
        .groupBy("version", "file")
        .agg(
            F.sum("rows").cast("bigint").alias("rows"),
            total(off).cast("bigint").alias("mismatched"),
            total(same_hour).alias("_agree"),
            if_any(offset == -1).alias("_minus"),
            if_any(offset == 1).alias("_plus"),
            if_any(F.coalesce(~offset.isin(-1, 1), F.lit(True))).alias("_other"),
            total(off & same_hour).alias("_same"),
            total(off & past).alias("_past"),
        )
    )
    bad = F.col("mismatched")
    return sums.select(
        "version",
        "file",
        "rows",
        "mismatched",
        _ratio(bad, rows).alias("mismatch_share"),
        _ratio(F.col("_agree"), rows).alias("hourmin_hour_matches_overall"),
        _ratio(F.col("_minus"), bad).alias("offset_minus_1"),
        _ratio(F.col("_plus"), bad).alias("offset_plus_1"),
        _ratio(F.col("_other"), bad).alias("offset_other"),
        _ratio(F.col("_same"), bad).alias("hourmin_hour_matches_time_ms"),
        _ratio(F.col("_past"), bad).alias("hourmin_past_midnight"),
    )


def clock_by_hour(profiles: Profiles, file_names: list[str], release: str = "full") -> DataFrame:
    """Mismatch share by local hour, one column per file."""
    need(profiles, release)
    off = ~F.col("offset_days").eqNullSafe(F.lit(0))

    def share(file: str) -> Column:
        mine = F.col("file") == file
        return _ratio(
            F.sum(F.when(mine & off, F.col("rows")).when(mine, 0)), F.sum(F.when(mine, F.col("rows")))
        ).alias(file.removesuffix(".csv"))

    clocks = profiles[release]["clock"].filter(F.col("ts_hour").isNotNull())
    return clocks.groupBy("ts_hour").agg(*[share(f) for f in file_names])


def part_files(profiles: Profiles, release: str = "full") -> DataFrame:
    """How a release's files split its users, and where clock mismatches sit.

    Siblings are files of the same source and first day; the share of users a
    file has in common with them is near 0 when parts were split by user.
    """
    need(profiles, release)
    tables = profiles[release]
    files = tables["files"].select("file_id", "file", "source", "min_date", "users", "min_user_id", "max_user_id")
    parts = Window.partitionBy("source", "min_date")
    files = files.withColumn("_siblings", F.count(F.lit(1)).over(parts) - 1)  # a row a file
    activity = (
        tables["user_activity"]
        .filter(F.col("user_id").isNotNull())
        .groupBy("file_id", "user_id")
        .agg(F.sum("rows").alias("_rows"), F.sum("date_mismatches").alias("_bad"))
        .join(files.select("file_id", "source", "min_date"), "file_id")
    )
    # a user has one row a file here, so the window holds as many rows as a user has files
    of_user = Window.partitionBy("source", "min_date", "user_id")
    activity = activity.withColumn("_shared", F.count(F.lit(1)).over(of_user) > 1)
    bad = F.col("_bad") > 0
    per_file = (
        activity.groupBy("file_id")
        .agg(
            F.count_if("_shared").alias("_shared"),
            F.count_if(bad).alias("users_with_mismatches"),
            _ratio(F.sum(F.when(bad, F.col("_bad"))), F.sum(F.when(bad, F.col("_rows")))).alias(
                "mismatch_rate_among_those_users"
            ),
        )
    )
    return (
        files.join(per_file, "file_id", "left")
        .select(
            "file",
            "users",
            "min_user_id",
            "max_user_id",
            F.when(F.col("_siblings") > 0, F.coalesce("_shared", F.lit(0))).alias("users_also_in_sibling"),
            F.coalesce("users_with_mismatches", F.lit(0)).alias("users_with_mismatches"),
            "mismatch_rate_among_those_users",
        )
    )
