"""Sources, contracts and projections (A, B, C)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from reelspark.functions import expressions as X
from reelspark.operators import catalog, contracts, ingest, point_in_time, profile
from reelspark.registry.common import AGE_LABELS, DURATION_LABELS, FLAG_NAMES, label_sql, query
from reelspark.registry.model_queries import with_unknown_items
from reelspark.session import materialize, scratch_path
from reelspark.sources import fixtures, logs, tables
from reelspark.sources.id_lookup import id_filters, rows_with_ids

ALL_LABELS = ingest.LABEL_COLUMNS


def _long_logs(spark, d):
    """Clean raw logs, typed."""
    raw = fixtures.raw_logs(spark, d, defects=False)
    return raw.select(
        "source",
        *[F.col(c).cast("bigint" if c in logs.LONG_LOG_COLUMNS else "int").alias(c) for c in logs.LOG_COLUMNS],
    )


def _broken_logs(spark, d):
    """Raw logs with defects, typed leniently so that every check has something to find."""
    raw = fixtures.raw_logs(spark, d)
    return raw.select(
        "source",
        *[F.col(c).try_cast("bigint" if c in logs.LONG_LOG_COLUMNS else "int").alias(c) for c in logs.LOG_COLUMNS],
    )


_COUNT_ROWS = """
SELECT source, count(*) AS rows, sum(cast(user_id AS bigint))::bigint AS user_sum,
       sum(cast(time_ms AS bigint))::bigint AS time_sum, sum(cast(play_time_ms AS bigint))::bigint AS play_sum,
       count(DISTINCT video_id) AS items
"""


@query(
    "a1_read_logs",
    _COUNT_ROWS + "FROM (SELECT source, user_id, epoch_us(ts) // 1000 - 28800000 AS time_ms, play_time_ms, "
    "item_id AS video_id FROM fx_logged) GROUP BY source",
    ("fx_logged",),
)
def read_logs(spark, d):
    """Write the raw log as CSV files, one with its columns reversed, and read them back."""
    path = scratch_path(spark, "raw-csv")
    raw = fixtures.raw_logs(spark, d, defects=False)
    for file_id, name, _ in fixtures.RAW_FILES:
        columns = list(logs.LOG_COLUMNS) if file_id != 1 else list(reversed(logs.LOG_COLUMNS))
        raw.filter(F.col("file_id") == file_id).select(*columns).write.option("header", True).csv(f"{path}/{name}")
    read = logs.read_logs(spark, [f"{path}/{n}" for _, n, s in fixtures.RAW_FILES if s == "standard"], [f"{path}/log_random_1.csv"])
    return read.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("user_id").alias("user_sum"),
        F.sum("time_ms").alias("time_sum"),
        F.sum("play_time_ms").alias("play_sum"),
        F.count_distinct("video_id").alias("items"),
    )


@query(
    "a2_stage_logs",
    """
    SELECT file_id, source, count(*) AS rows, count(user_id) AS user_ids, count(date) AS dates,
           count(is_click) AS clicks, sum(time_ms)::bigint AS time_sum, sum(is_like)::bigint AS likes
    FROM fx_staged GROUP BY file_id, source
    """,
    ("fx_staged",),
)
def stage_logs(spark, d):
    """Defective CSV files staged all as text."""
    path = scratch_path(spark, "stage-csv")
    raw = fixtures.raw_logs(spark, d)
    for file_id, name, _ in fixtures.RAW_FILES:
        part = raw.filter(F.col("file_id") == file_id).select(*logs.LOG_COLUMNS)
        part.write.option("header", True).csv(f"{path}/{name}")
    staged = logs.stage_logs(spark, [(i, f"{path}/{n}", s) for i, n, s in fixtures.RAW_FILES])
    return staged.groupBy("file_id", "source").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("user_id").alias("user_ids"),
        F.count("date").alias("dates"),
        F.count("is_click").alias("clicks"),
        F.sum("time_ms").alias("time_sum"),
        F.sum("is_like").alias("likes"),
    )


_X_COLUMNS = (
    "user_id, item_id, date, time_ms, tab, source, split, is_click, long_view, is_like, is_follow, "
    "is_comment, is_forward, is_hate, is_profile_enter, play_time_ms, duration_ms"
)


@query("a3_write_read_tables", f"SELECT {_X_COLUMNS} FROM fx_x", ("fx_x",))
def write_read_tables(spark, d):
    """Round trip of the processed tables (A3, A4)."""
    path = scratch_path(spark, "tables")
    logs.write_tables(fixtures.interactions(spark, d), fixtures.users(spark, d), fixtures.items(spark, d), path)
    return logs.read_tables(spark, path)["interactions"].select(*_X_COLUMNS.split(", "))


@query("c3_written_in_event_order", "SELECT cast(0 AS bigint) AS rows_out_of_order, count(*) AS rows FROM fx_x", ("fx_x",))
def written_in_event_order(spark, d):
    """Every file of the written interactions holds them in event order."""
    path = scratch_path(spark, "ordered")
    logs.write_tables(fixtures.interactions(spark, d), fixtures.users(spark, d), fixtures.items(spark, d), path)
    stored = spark.read.parquet(f"{path}/interactions")
    rows = stored.agg(F.count(F.lit(1)).alias("rows")).withColumn("_one", F.lit(1))
    return ingest.order_violations(stored).withColumn("_one", F.lit(1)).join(rows, "_one").drop("_one")


@query(
    "a5_ingest_manifest",
    """
    SELECT 'rows/' || source || '/' || split AS entry, cast(count(*) AS varchar) AS value
    FROM fx_large GROUP BY source, split
    UNION ALL SELECT 'n_users', cast(count(DISTINCT user_id) AS varchar) FROM fx_large
    UNION ALL SELECT 'n_items_logged', cast(count(DISTINCT item_id) AS varchar) FROM fx_large
    UNION ALL SELECT 'first_day', cast(min(date) AS varchar) FROM fx_large
    UNION ALL SELECT 'last_day', cast(max(date) AS varchar) FROM fx_large
    UNION ALL SELECT 'n_items_catalog', cast(count(*) AS varchar) FROM fx_items
    UNION ALL SELECT 'logged_items_missing_features', cast(count(*) AS varchar)
              FROM (SELECT item_id FROM fx_large EXCEPT SELECT item_id FROM fx_items)
    UNION ALL SELECT 'dropped_leaky_item_columns', 'visible_status'
    """,
    ("fx_large",),
)
def ingest_manifest(spark, d):
    return ingest.manifest(fixtures.interactions_large(spark, d), fixtures.items(spark, d), ["visible_status", "show_cnt"])


@query(
    "a7_write_load_profile",
    """
    SELECT source, tab, count(*) AS rows, sum(is_click)::bigint AS clicks FROM fx_staged GROUP BY source, tab
    """,
    ("fx_staged",),
)
def write_load_profile(spark, d):
    """Round trip of profile tables."""
    path = scratch_path(spark, "profile")
    staged = logs.stage_text_logs(fixtures.raw_logs(spark, d))
    base = profile.base_rows(staged)
    logs.write_frames({"tabs": profile.tabs(base), "manifest": profile.manifest(staged)}, path)
    loaded = logs.read_frames(spark, path, ["tabs", "manifest"])
    return loaded["tabs"].groupBy("source", "tab").agg(
        F.sum("rows").alias("rows"), F.sum("clicks").alias("clicks")
    )


# --- contracts -----------------------------------------------------------------

_TYPED = ", ".join(
    f"try_cast({c} AS {'bigint' if c in logs.LONG_LOG_COLUMNS else 'integer'}) AS {c}" for c in logs.LOG_COLUMNS
)


@query(
    "b1_missing_columns",
    "SELECT 'log_standard_2.csv' AS file, 'is_click' AS missing, count(*) AS rows FROM fx_logged",
    ("fx_logged",),
)
def missing_columns(spark, d):
    """Of three log files one lacks a column; reading them names the file and the column."""
    path = scratch_path(spark, "broken-csv")
    raw = fixtures.raw_logs(spark, d, defects=False)
    for file_id, name, _ in fixtures.RAW_FILES:
        columns = [c for c in logs.LOG_COLUMNS if (file_id, c) != (1, "is_click")]
        raw.filter(F.col("file_id") == file_id).select(*columns).write.option("header", True).csv(f"{path}/{name}")
    try:
        logs.read_logs(spark, [f"{path}/{n}" for _, n, _ in fixtures.RAW_FILES], [])
        where = columns = ""
    except contracts.ContractError as error:
        where, columns = str(error).split(" lacks the columns ")
    counted = raw.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.lit(where.rpartition("/")[2]).alias("file"), F.lit(columns).alias("missing"), "rows")


@query(
    "b2_b4_log_violations",
    f"WITH typed AS (SELECT source, {_TYPED} FROM fx_raw) "
    + " UNION ALL ".join(
        f"SELECT 'binary_{c}' AS \"check\", count(*) FILTER ({c} NOT IN (0, 1)) AS offending_rows FROM typed"
        for c in FLAG_NAMES
    )
    + """
    UNION ALL SELECT 'non_null_keys', count(*) FILTER (user_id IS NULL OR video_id IS NULL OR date IS NULL) FROM typed
    UNION ALL SELECT 'is_rand_matches_source',
                     count(*) FILTER ((source = 'random' AND is_rand <> 1) OR (source <> 'random' AND is_rand = 1))
              FROM typed
    """,
    ("fx_raw",),
)
def log_violations(spark, d):
    return contracts.log_violations(_broken_logs(spark, d))


@query(
    "b5_split_violations",
    "SELECT 'inside_split_ranges' AS \"check\", count(*) FILTER (date > DATE '2000-12-31' OR date < DATE '1996-01-01') "
    "AS offending_rows FROM fx_large",
    ("fx_large",),
)
def split_violations(spark, d):
    """A split that leaves the first and the last year out."""
    narrow = fixtures.SplitDates(
        train=(date(1996, 1, 1), date(1998, 12, 31)),
        val=(date(1999, 1, 1), date(1999, 12, 31)),
        test=(date(2000, 1, 1), date(2000, 12, 31)),
    )
    large = fixtures.interactions_large(spark, d)
    return contracts.split_violations(large.withColumn("split", X.split_label(F.col("date"), narrow)))


@query(
    "b6_unique_violations",
    "SELECT 'unique_user_id' AS \"check\", count(*) - count(DISTINCT o_custkey) AS offending_rows FROM orders "
    "UNION ALL SELECT 'unique_item_id', count(*) - count(DISTINCT item_id) FROM fx_items",
    ("fx_items",),
)
def unique_violations(spark, d):
    orders = fixtures.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    repeated = contracts.unique_violations(orders, "user_id", "unique_user_id")
    return repeated.union(contracts.unique_violations(fixtures.items(spark, d), "item_id", "unique_item_id"))


@query(
    "b7_items_without_features",
    "SELECT count(DISTINCT item_id) AS logged_items_missing_features FROM m_large WHERE item_id NOT IN (SELECT item_id FROM fx_items)",
    ("m_large", "fx_items"),
)
def items_without_features(spark, d):
    log = with_unknown_items(fixtures.interactions_large(spark, d))
    return contracts.items_without_features(log, fixtures.items(spark, d))


@query(
    "b9_leakage_guard",
    "SELECT 'item_show_cnt' AS leaked, count(*) AS rows FROM fx_x",
    ("fx_x",),
)
def leakage_guard(spark, d):
    """A frame with a blocked name: the guard names it before any job runs."""
    frame = fixtures.interactions(spark, d).withColumn("item_show_cnt", F.lit(1))
    try:
        contracts.check_leakage(frame, ["show_cnt"])
        leaked = ""
    except contracts.LeakageError as error:
        leaked = str(error).rpartition(": ")[2]
    return frame.agg(F.count(F.lit(1)).alias("rows")).withColumn("leaked", F.lit(leaked))


# --- projections and scalar functions --------------------------------------------

_INT_LABELS = ", ".join(f"cast({c} AS tinyint) AS {c}" for c in ALL_LABELS)


@query(
    "c1_normalize_logs",
    f"SELECT user_id, item_id, date, time_ms, tab, source, split, {_INT_LABELS}, play_time_ms, duration_ms "
    "FROM (SELECT * REPLACE (time_ms - 28800000 AS time_ms) FROM fx_x)",
    ("fx_x",),
)
def normalize_logs(spark, d):
    """Raw rows to interactions, splits included."""
    return ingest.normalize_logs(_long_logs(spark, d), fixtures.EVENT_SPLITS)


@query(
    "c2_split_label",
    """
    SELECT CASE WHEN date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' THEN 'train'
                WHEN date BETWEEN DATE '1999-06-01' AND DATE '1999-12-31' THEN 'val'
                WHEN date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' THEN 'test' ELSE 'unused' END AS split,
           count(*) AS rows, min(date) AS first_day, max(date) AS last_day
    FROM fx_large GROUP BY 1
    """,
    ("fx_large",),
)
def split_label(spark, d):
    splits = fixtures.SplitDates(
        train=(date(1996, 1, 1), date(1998, 12, 31)),
        val=(date(1999, 6, 1), date(1999, 12, 31)),
        test=(date(2000, 1, 1), date(2000, 12, 31)),
    )
    large = fixtures.interactions_large(spark, d)
    return large.groupBy(X.split_label(F.col("date"), splits).alias("split")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


@query(
    "c3_latest_event",
    """
    SELECT item_id AS of_item_id, date AS last_date, time_ms AS last_time_ms, user_id AS last_user_id,
           item_id AS last_item_id
    FROM fx_large
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY date DESC, time_ms DESC, user_id DESC) = 1
    """,
    ("fx_large",),
)
def latest_event(spark, d):
    """Each item's last event in canonical order."""
    return ingest.latest_event(fixtures.interactions_large(spark, d), ["item_id"])


@query(
    "c4_project_items",
    "SELECT cast(video_id AS bigint) AS item_id, cast(author_id AS integer) AS author_id, video_type, "
    "try_cast(upload_dt AS date) AS upload_dt, upload_type, tag FROM fx_raw_items",
    ("fx_raw_items",),
)
def project_items(spark, d):
    leaky = ["visible_status", "video_duration", "server_width", "server_height", "music_id", "music_type"]
    items = ingest.project_items(fixtures.raw_items(spark, d), leaky)
    return items.withColumn("author_id", F.col("author_id").cast("int"))


@query(
    "c5_eval_set_and_fit_window",
    """
    SELECT 'val_random' AS part, count(*) AS rows, count(DISTINCT user_id) AS users FROM fx_large
    WHERE split = 'val' AND source = 'random'
    UNION ALL
    SELECT 'fit', count(*), count(DISTINCT user_id) FROM fx_large
    WHERE date < DATE '2000-07-01' AND source = 'standard'
    """,
    ("fx_large",),
)
def eval_set_and_fit_window(spark, d):
    large = fixtures.interactions_large(spark, d)

    def size(df, name):
        return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users")).withColumn(
            "part", F.lit(name)
        )

    fit = tables.fit_window(large, fixtures.ORDER_SPLITS.start("val"))
    return size(tables.eval_set(large, "val_random"), "val_random").unionByName(size(fit, "fit"))


_FIRST = "split_part(tag, ',', 1)"


@query(
    "c6_c8_tags",
    f"""
    WITH pieces AS (SELECT item_id, tag, string_split(tag, ',')[1:4] AS p FROM fx_items)
    SELECT item_id, CASE WHEN regexp_full_match({_FIRST}, '[0-9]+') THEN cast({_FIRST} AS integer) END AS primary_tag,
           coalesce(CASE WHEN regexp_full_match({_FIRST}, '[0-9]+') THEN cast({_FIRST} AS bigint) END, -1) AS category,
           coalesce(array_to_string([CASE WHEN regexp_full_match(trim(x), '[0-9]+') THEN trim(x) ELSE '-1' END
                                     FOR x IN p], ','), '') AS tags
    FROM pieces
    """,
    ("fx_items",),
)
def tags(spark, d):
    """Both primary-tag rules and the tag list."""
    tag = F.col("tag")
    return fixtures.items(spark, d).select(
        "item_id",
        X.primary_tag_feature(tag).alias("primary_tag"),
        X.primary_tag_category(tag).alias("category"),
        F.array_join(X.tag_list(tag, 4).cast("array<string>"), ",").alias("tags"),
    )


@query(
    "c9_duration_index",
    """
    SELECT (CASE WHEN duration_ms IS NULL THEN 0 ELSE
             1 + cast(duration_ms >= 7000 AS integer) + cast(duration_ms >= 18000 AS integer)
               + cast(duration_ms >= 30000 AS integer) + cast(duration_ms >= 60000 AS integer)
               + cast(duration_ms >= 120000 AS integer) + cast(duration_ms >= 300000 AS integer)
               + cast(duration_ms >= 600000 AS integer) END)::integer AS bucket,
           count(*) AS rows
    FROM fx_large GROUP BY 1
    """,
    ("fx_large",),
)
def duration_index(spark, d):
    """Content duration bucket: an edge value belongs above it."""
    bucket = X.duration_index(F.col("duration_ms")).cast("int").alias("bucket")
    return fixtures.interactions_large(spark, d).groupBy(bucket).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "c10_duration_label",
    f"""
    SELECT {label_sql("duration_ms", DURATION_LABELS)} AS label, count(*) AS rows
    FROM fx_large GROUP BY 1
    """,
    ("fx_large",),
)
def duration_label(spark, d):
    """Profile duration bucket: an edge value belongs below it."""
    label = X.duration_label(F.col("duration_ms")).alias("label")
    return fixtures.interactions_large(spark, d).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "c11_age_label",
    f"""
    WITH a AS (SELECT x.date - i.upload_dt AS age FROM fx_x x JOIN fx_items i USING (item_id))
    SELECT {label_sql("age", AGE_LABELS)} AS label, count(*) AS rows
    FROM a GROUP BY 1
    """,
    ("fx_x",),
)
def age_label(spark, d):
    dates = fixtures.items(spark, d).select("item_id", "upload_dt")
    joined = fixtures.interactions(spark, d).join(dates, "item_id")
    label = X.age_label(F.datediff(F.col("date"), F.col("upload_dt"))).alias("label")
    return joined.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "c12_clocks",
    """
    WITH c AS (
        SELECT *, cast(strptime(cast(date AS varchar), '%Y%m%d') AS date) AS day,
               make_timestamp((time_ms + 28800000) * 1000) AS local_ts FROM fx_staged)
    SELECT day, cast(day - cast(local_ts AS date) AS bigint) AS offset_days, hour(local_ts) AS ts_hour,
           cast(hourmin // 100 AS bigint) AS hourmin_hour, count(*) AS rows
    FROM c GROUP BY ALL
    """,
    ("fx_staged",),
)
def clocks(spark, d):
    rows = profile.with_clocks(logs.stage_text_logs(fixtures.raw_logs(spark, d)))
    return rows.groupBy("day", "offset_days", "ts_hour", "hourmin_hour").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "c13_pool_flag",
    """
    SELECT source, video_id IN (SELECT DISTINCT video_id FROM fx_staged WHERE source = 'random') AS in_pool,
           count(*) AS rows, count(DISTINCT video_id) AS items
    FROM fx_staged GROUP BY 1, 2
    """,
    ("fx_staged",),
)
def pool_flag(spark, d):
    base = profile.base_rows(logs.stage_text_logs(fixtures.raw_logs(spark, d)))
    return base.groupBy("source", "in_pool").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("video_id").alias("items")
    )


@query(
    "c14_overlap_window",
    """
    SELECT source, count(*) AS rows, min(date) AS first_day FROM fx_overlap
    WHERE date >= (SELECT min(date) FROM fx_overlap WHERE source = 'random') GROUP BY source
    """,
    ("fx_overlap",),
)
def overlap_window(spark, d):
    from reelspark.operators.explore import overlap_window as overlap

    rows = overlap(fixtures.interactions_overlap(spark, d))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_day"))


@query(
    "c15_available_items",
    """
    SELECT item_id, upload_dt FROM fx_items
    WHERE upload_dt IS NULL OR upload_dt <= (SELECT max(date) FROM fx_x WHERE split = 'val')
    """,
    ("fx_x",),
)
def available_items(spark, d):
    x, items = fixtures.interactions(spark, d), fixtures.items(spark, d)
    last_day = x.filter(F.col("split") == "val").agg(F.max("date")).scalar()
    return catalog.available_items(catalog.build_catalog(items, x), last_day).select("item_id", "upload_dt")


@query(
    "c16_derive_releases",
    """
    WITH pool AS (SELECT DISTINCT video_id FROM fx_staged WHERE source = 'random'),
         sample AS (SELECT user_id FROM fx_users ORDER BY md5('7:' || cast(user_id AS varchar)), user_id LIMIT 40),
         mine AS (SELECT * FROM fx_staged WHERE user_id IN (SELECT user_id FROM sample))
    SELECT 'pool' AS release, count(*) AS rows,
           (SELECT count(*) FROM fx_staged_items WHERE video_id IN (SELECT video_id FROM pool)) AS items
    FROM fx_staged WHERE video_id IN (SELECT video_id FROM pool)
    UNION ALL
    SELECT 'sample', count(*),
           (SELECT count(*) FROM fx_staged_items WHERE video_id IN (SELECT video_id FROM mine)) FROM mine
    """,
    ("fx_staged", "fx_staged_items", "fx_users"),
)
def derive_releases(spark, d):
    staged = logs.stage_text_logs(fixtures.raw_logs(spark, d))
    items = profile.stage_items(fixtures.raw_items(spark, d))
    users = profile.stage_users(fixtures.raw_users(spark, d))
    pool_rows, pool_items = ingest.derive_pool_release(staged, items)
    user_rows, _, seen_items = ingest.derive_user_release(staged, users, items, 40, 7)

    def sizes(rows, kept, name):
        n_items = kept.agg(F.count(F.lit(1))).scalar()
        return rows.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("release"), "rows", n_items.alias("items")
        )

    return sizes(pool_rows, pool_items, "pool").union(sizes(user_rows, seen_items, "sample"))


@query(
    "j3_left_join_events_authors",
    """
    SELECT author_id, count(*) AS rows FROM fx_large x LEFT JOIN
           (SELECT * FROM fx_items WHERE author_id <> 3) i USING (item_id) GROUP BY author_id
    """,
    ("fx_large",),
)
def left_join_events_authors(spark, d):
    """Left equi-join of events and items, unknown authors kept."""
    known = fixtures.items(spark, d).filter(F.col("author_id") != 3)
    events = point_in_time.feature_events(fixtures.interactions_large(spark, d), known, ("standard", "random"))
    return events.groupBy("author_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "j6_rows_of_ids",
    """
    SELECT user_id, item_id, date, time_ms, is_click FROM fx_large WHERE user_id IN
        (SELECT user_id FROM fx_users ORDER BY md5('7:' || cast(user_id AS varchar)), user_id LIMIT 40)
    """,
    ("fx_large", "fx_users"),
)
def rows_of_ids(spark, d):
    """The log of a user sample from a stored table with filters by user."""
    log = fixtures.interactions_large(spark, d).select("user_id", "item_id", "date", "time_ms", "is_click")
    stored = materialize(log.sortWithinPartitions("date", "time_ms"), "log", options=id_filters("user_id"))
    return rows_with_ids(stored, "user_id", ingest.sample_users(fixtures.users(spark, d), 40, 7))
