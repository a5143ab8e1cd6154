"""Registration, and the fixture views as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}
_DEPENDS: dict[str, tuple[str, ...]] = {}


def view(name: str, sql: str, *depends: str) -> None:
    VIEWS[name], _DEPENDS[name] = sql.strip(), depends


def with_views(body: str, *names: str) -> str:
    """`body` with the named views, and what they depend on, as a WITH clause."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in _DEPENDS[name]:
                visit(other)
            ordered.append(name)

    for name in names:
        visit(name)
    clauses = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {clauses},\n{body[5:]}"
    return f"WITH {clauses}\n{body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query and, where SQL can express it, its oracle."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views) if views else sql.strip()
        return fn

    return add


def hash_sql(seed: str, *parts: str) -> str:
    """The portable 52-bit hash of `seed:part…` as SQL."""
    text = " || ':' || ".join([f"'{seed}'", *[f"cast({p} as varchar)" for p in parts]])
    return f"cast('0x' || substr(md5({text}), 1, 13) as bigint)"


# Profile labels with the values each takes, bounds included.
DURATION_LABELS = ((None, 7_000, "0-7s"), (7_001, 18_000, "7-18s"), (18_001, 60_000, "18-60s"), (60_001, 180_000, "1-3min"), (180_001, None, "3min+"))
AGE_LABELS = ((None, 0, "0d"), (1, 7, "1-7d"), (8, 30, "8-30d"), (31, 180, "31-180d"), (181, 365, "181-365d"), (366, None, "365d+"))


def label_sql(value: str, labels) -> str:
    """The label whose bounds hold a whole number, looked up in a table of them; `unknown` for null."""
    rows = ", ".join(f"({'NULL' if a is None else a}, {'NULL' if b is None else b}, '{name}')" for a, b, name in labels)
    return (
        f"coalesce((SELECT l.name FROM (VALUES {rows}) l(low, high, name) "
        f"WHERE {value} BETWEEN coalesce(l.low, {value}) AND coalesce(l.high, {value})), 'unknown')"
    )


def gini_sql(counts: str) -> str:
    """Gini of a list of counts: the mean absolute difference of two members over twice their mean."""
    grid = f"[list_sum([abs(a - b) FOR b IN {counts}]) FOR a IN {counts}]"
    return f"list_sum({grid}) / (2.0 * len({counts}) * list_sum({counts}))"


def tie_sql(seed, item: str) -> str:
    return f"md5('{seed}:' || cast({item} as varchar))"


view(
    "fx_items",
    """
    SELECT p_partkey AS item_id,
           cast(split_part(p_brand, '#', 2) AS integer) AS author_id,
           p_type AS video_type,
           DATE '2023-12-01' + cast((p_partkey * 13) % 55 AS integer) AS upload_dt,
           split_part(p_name, ' ', 1) AS upload_type,
           cast(p_size * 1000 AS double) AS video_duration,
           720 AS server_width, 1280 AS server_height,
           cast((p_partkey * 31) % 500 AS bigint) AS music_id,
           cast(p_partkey % 10 AS integer) AS music_type,
           CASE WHEN p_partkey % 11 = 0 THEN NULL
                WHEN p_partkey % 3 = 0 THEN cast(p_partkey % 40 AS varchar)
                ELSE cast(p_partkey % 40 AS varchar) || ',' || cast((p_partkey * 7) % 40 AS varchar) END AS tag
    FROM part
    """,
)
view(
    "fx_users",
    f"""
    SELECT c_custkey AS user_id, c_mktsegment AS user_active_degree,
           cast(c_custkey % 2 AS integer) AS is_lowactive_period, 0 AS is_live_streamer,
           CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS is_video_author,
           cast((c_custkey * 13) % 600 AS integer) AS follow_user_num,
           cast((c_custkey * 17) % 2000 AS integer) AS fans_user_num,
           0 AS friend_user_num,
           cast((c_custkey * 37) % 3000 AS integer) AS register_days,
           cast(c_nationkey AS integer) AS onehot_feat0,
           {", ".join(f"0 AS onehot_feat{i}" for i in range(1, 18))}
    FROM customer
    """,
)
view(
    "fx_logged",
    """
    SELECT e.event_id, e.ts, e.user_id, i.item_id,
           cast(e.event_type IN ('click', 'purchase') AS integer) AS is_click,
           cast(e.event_type IN ('view', 'purchase') AS integer) AS long_view,
           cast(e.event_type = 'purchase' AS integer) AS is_like,
           cast(e.event_type = 'signup' AS integer) AS is_follow,
           cast(e.event_id % 10 = 0 AS integer) AS is_comment,
           cast(e.event_id % 20 = 0 AS integer) AS is_forward,
           cast(e.event_type = 'error' AS integer) AS is_hate,
           cast(e.event_id % 15 = 0 AS integer) AS is_profile_enter,
           cast(round(e.value * 1000) AS bigint) AS play_time_ms,
           CASE WHEN e.event_id % 4 = 0 THEN 'random' ELSE 'standard' END AS source,
           cast(e.event_id % 5 AS integer) AS tab,
           cast(i.video_duration AS bigint) AS duration_ms
    FROM events e JOIN fx_items i ON i.item_id = cast(e.props->>'k' AS bigint)
    """,
    "fx_items",
)
view(
    "fx_x",
    """
    SELECT user_id, item_id, cast(ts AS date) AS date, epoch_us(ts) // 1000 AS time_ms, tab, source,
           CASE WHEN cast(ts AS date) <= DATE '2024-01-22' THEN 'train'
                WHEN cast(ts AS date) <= DATE '2024-01-26' THEN 'val'
                WHEN cast(ts AS date) <= DATE '2024-01-30' THEN 'test' ELSE 'unused' END AS split,
           is_click, long_view, is_like, is_follow, is_comment, is_forward, is_hate, is_profile_enter,
           play_time_ms, duration_ms
    FROM fx_logged
    """,
    "fx_logged",
)
view(
    "fx_overlap",
    "SELECT * FROM fx_x WHERE source = 'standard' OR date >= DATE '2024-01-10'",
    "fx_x",
)
view(
    "fx_large",
    """
    SELECT o_custkey AS user_id, l_partkey AS item_id, cast(o_orderdate AS date) AS date,
           epoch_us(cast(cast(o_orderdate AS date) AS timestamp)) // 1000 + l_linenumber * 1000 AS time_ms,
           cast(l_linenumber AS integer) AS tab,
           CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN 'random' ELSE 'standard' END AS source,
           CASE WHEN o_orderdate < DATE '2000-07-01' THEN 'train'
                WHEN o_orderdate < DATE '2001-01-01' THEN 'val' ELSE 'test' END AS split,
           cast(l_returnflag = 'R' AS integer) AS is_click, cast(l_linestatus = 'O' AS integer) AS long_view,
           cast(l_returnflag = 'A' AND l_linestatus = 'F' AS integer) AS is_like,
           cast(l_quantity * 1000 AS bigint) AS play_time_ms,
           cast(video_duration AS bigint) AS duration_ms
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN fx_items ON item_id = l_partkey
    """,
    "fx_items",
)
FLAG_NAMES = (
    "is_click",
    "is_like",
    "is_follow",
    "is_comment",
    "is_forward",
    "is_hate",
    "long_view",
    "is_profile_enter",
    "is_rand",
)
view(
    "fx_raw",
    """
    SELECT CASE WHEN source = 'random' THEN 2 WHEN cast(ts AS date) < DATE '2024-01-15' THEN 0 ELSE 1 END AS file_id,
           source,
           CASE WHEN event_id % 1009 = 0 THEN '' ELSE cast(user_id AS varchar) END AS user_id,
           cast(item_id AS varchar) AS video_id,
           CASE WHEN event_id % 983 = 0 THEN 'n/a'
                WHEN event_id % 97 = 0 THEN strftime(cast(ts AS date) + 1, '%Y%m%d')
                ELSE strftime(ts, '%Y%m%d') END AS date,
           cast((CASE WHEN event_id % 89 = 0 THEN (hour(ts) + 1) % 24 ELSE hour(ts) END) * 100 + minute(ts) AS varchar)
               AS hourmin,
           cast(epoch_us(ts) // 1000 - 28800000 AS varchar) AS time_ms,
           CASE WHEN event_id % 991 = 0 THEN 'x' ELSE cast(is_click AS varchar) END AS is_click,
           CASE WHEN event_id % 499 = 0 THEN '2' ELSE cast(is_like AS varchar) END AS is_like,
           cast(is_follow AS varchar) AS is_follow, cast(is_comment AS varchar) AS is_comment,
           cast(is_forward AS varchar) AS is_forward, cast(is_hate AS varchar) AS is_hate,
           cast(long_view AS varchar) AS long_view, cast(is_profile_enter AS varchar) AS is_profile_enter,
           cast(play_time_ms AS varchar) AS play_time_ms, cast(duration_ms AS varchar) AS duration_ms,
           '0' AS profile_stay_time, '0' AS comment_stay_time,
           cast(CASE WHEN event_id % 997 = 0 THEN 1 - cast(source = 'random' AS integer)
                     ELSE cast(source = 'random' AS integer) END AS varchar) AS is_rand,
           cast(tab AS varchar) AS tab
    FROM fx_logged
    """,
    "fx_logged",
)
_ints = {"date": "integer", "hourmin": "integer", "tab": "integer"}
_longs = ("user_id", "video_id", "time_ms", "play_time_ms", "duration_ms")
view(
    "fx_staged",
    "SELECT cast(file_id AS integer) AS file_id, source, "
    + ", ".join(f"try_cast({c} AS bigint) AS {c}" for c in _longs)
    + ", "
    + ", ".join(f"try_cast({c} AS {t}) AS {c}" for c, t in _ints.items())
    + ", "
    + ", ".join(f"try_cast({c} AS tinyint) AS {c}" for c in FLAG_NAMES)
    + " FROM fx_raw",
    "fx_raw",
)
view(
    "fx_raw_items",
    """
    SELECT cast(item_id AS varchar) AS video_id, cast(author_id AS varchar) AS author_id,
           CASE WHEN item_id % 17 = 0 THEN NULL ELSE video_type END AS video_type,
           CASE WHEN item_id % 101 = 0 THEN 'unknown' ELSE cast(upload_dt AS varchar) END AS upload_dt,
           upload_type, tag
    FROM fx_items
    """,
    "fx_items",
)
view(
    "fx_staged_items",
    """
    SELECT try_cast(video_id AS bigint) AS video_id, try_cast(upload_dt AS date) AS upload_dt, video_type, upload_type
    FROM fx_raw_items
    """,
    "fx_raw_items",
)
view(
    "fx_staged_users",
    """
    SELECT user_id, user_active_degree,
           CASE WHEN user_id % 103 = 0 THEN NULL ELSE register_days END AS register_days,
           follow_user_num, fans_user_num, is_video_author
    FROM fx_users
    """,
    "fx_users",
)
