from datetime import UTC, datetime, timedelta

import pytest
from conftest import DAY0, event_rows
from pyspark.sql import functions as F

from reelspark.operators import compare, profile
from reelspark.sources import logs
from reelspark.sources.fixtures import FLAGS

FILES = [(0, "standard_1.csv", "standard"), (1, "standard_2.csv", "standard"), (2, "random.csv", "random")]


def raw_rows(shift_items=0, moved=lambda i: False, skip_day=None, file_of=None):
    out = []
    for i, r in enumerate(event_rows(n=900)):
        if skip_day is not None and r[2] == skip_day:
            continue
        local = datetime(r[2].year, r[2].month, r[2].day, 12, tzinfo=UTC) + timedelta(seconds=i)
        day = r[2] + timedelta(days=1) if moved(i) else r[2]
        file_id = 2 if r[5] == "random" else (file_of(r, i) if file_of else int(r[2] >= DAY0 + timedelta(days=7)))
        row = {
            "file_id": file_id, "source": r[5], "user_id": r[0], "video_id": r[1] + shift_items, "date": day.strftime("%Y%m%d"),
            "hourmin": 1200, "time_ms": int(local.timestamp() * 1000) - 28_800_000, "is_click": r[7], "long_view": r[8],
            "is_like": r[9], "is_rand": int(r[5] == "random"), "play_time_ms": r[10], "duration_ms": r[11], "tab": r[4],
        }
        out.append({k: str(v) if k not in ("file_id", "source") else v for k, v in row.items()})
    return out


COLUMNS = ["file_id", "source", *logs.PROFILE_TYPES, *FLAGS]


def staged(spark, rows):
    data = [tuple(r.get(c, "0") for c in COLUMNS) for r in rows]
    schema = ", ".join(f"{c} {'int' if c == 'file_id' else 'string'}" for c in COLUMNS)
    return logs.stage_text_logs(spark.createDataFrame(data, schema))


def build(spark, rows, items, users):
    frame = staged(spark, rows)
    listed = items.select(F.col("item_id").alias("video_id"), "upload_dt", "video_type", "upload_type")
    people = users.select("user_id", "user_active_degree", "register_days", "follow_user_num", "fans_user_num", "is_video_author")
    names = spark.createDataFrame(FILES, "file_id int, file string, source string")
    return profile.build_profile(frame, listed, people, names)


def test_defects_are_counted_per_file(spark, items, users):
    rows = raw_rows()
    rows[0] |= {"is_click": "x"}
    rows[1] |= {"date": "n/a"}
    rows[2] |= {"is_rand": "1" if rows[2]["is_rand"] == "0" else "0"}
    rows[3] |= {"is_like": "2"}
    found = build(spark, rows, items, users)["files"]
    totals = found.agg(*[F.sum(c).alias(c) for c in found.columns if c.startswith("nonbinary_") or c.endswith(("keys", "mismatch"))]).first()
    assert (totals["nonbinary_is_click"], totals["nonbinary_is_like"]) == (1, 1)
    assert (totals["null_or_unparseable_keys"], totals["is_rand_mismatch"], totals["date_time_mismatch"]) == (1, 1, 0)
    assert totals["nonbinary_is_hate"] == 0


def test_profile_totals_agree(spark, items, users, tmp_path):
    rows = raw_rows()
    tables = build(spark, rows, items, users)
    logs.write_frames(tables, str(tmp_path))
    loaded = logs.read_frames(spark, str(tmp_path), list(profile.TABLES))
    for name in ("daily", "tabs", "user_activity", "clock", "files"):
        assert loaded[name].agg(F.sum("rows")).first()[0] == len(rows)
    per_attribute = loaded["attributes"].groupBy("attribute").agg(F.sum("rows").alias("n")).collect()
    assert {r["n"] for r in per_attribute} == {len(rows)} and len(per_attribute) == 4
    assert loaded["concentration"].agg(F.sum("impressions")).first()[0] == len(rows)


def test_fingerprints_ignore_order_and_see_renumbered_items(spark, items, users):
    full = build(spark, raw_rows(), items, users)
    shuffled = build(spark, list(reversed(raw_rows())), items, users)
    renumbered = build(spark, raw_rows(shift_items=10_000), items, users)
    got = {r["version"]: r for r in compare.random_log_identity({"full": full, "same": shuffled, "other": renumbered}).collect()}
    assert got["same"]["same_rows_as_full"] and got["same"]["same_ids_as_full"]
    assert got["other"]["same_rows_as_full"] and not got["other"]["same_ids_as_full"]
    cover = {r["version"]: r for r in compare.pool_coverage({"full": full, "other": renumbered}).collect()}
    assert cover["other"]["in_full_pool"] == 0 and cover["full"]["not_in_full_pool"] == 0
    assert cover["other"]["full_pool_missing"] == cover["full"]["pool_items"]


def test_a_missing_day_shows(spark, items, users):
    pool = build(spark, raw_rows(skip_day=DAY0 + timedelta(days=3)), items, users)
    full = build(spark, raw_rows(), items, users)
    rows = compare.pool_vs_full_pool({"full": full, "pool": pool}).collect()
    missing = [r for r in rows if r["day"] == DAY0 + timedelta(days=3)]
    assert missing and all(r["pool_rows"] == 0 and r["row_diff"] < 0 and not r["same_rows"] for r in missing)


def test_moved_dates_show_in_the_clock(spark, items, users):
    moved = {i for i in range(900) if i % 30 == 0}
    tables = build(spark, raw_rows(moved=moved.__contains__), items, users)
    summary = compare.clock_summary({"full": tables}).collect()
    assert sum(r["mismatched"] for r in summary) == len(moved)
    assert all(r["offset_plus_1"] == 1.0 and r["offset_minus_1"] is None for r in summary if r["mismatched"])


@pytest.mark.parametrize("by_user", [True, False])
def test_part_files_split_by_user_or_by_rows(spark, items, users, by_user):
    split = (lambda r, i: r[0] % 2) if by_user else (lambda r, i: i % 2)
    rows = raw_rows(file_of=split)
    for r in rows:  # both standard files start on the same day
        r["date"] = DAY0.strftime("%Y%m%d")
    got = {r["file"]: r for r in compare.part_files({"full": build(spark, rows, items, users)}).collect()}
    shared = [got[f"standard_{i}.csv"]["users_also_in_sibling"] for i in (1, 2)]
    assert shared[0] == shared[1] and (shared[0] == 0) == by_user
    assert got["random.csv"]["users_also_in_sibling"] is None


def test_missing_releases_raise(spark, items, users):
    with pytest.raises(KeyError):
        compare.random_log_identity({"pool": build(spark, raw_rows(), items, users)})
