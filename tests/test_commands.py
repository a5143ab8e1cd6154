from datetime import timedelta

from conftest import DAY0, event_rows, item_rows
from pyspark.sql import functions as F

from reelspark.operators import profile
from reelspark.params import BaselineParams, EvalParams, SplitDates, TwoTowerParams
from reelspark.plans import commands
from reelspark.sources import logs

SPLITS = SplitDates(
    (DAY0, DAY0 + timedelta(days=7)),
    (DAY0 + timedelta(days=8), DAY0 + timedelta(days=10)),
    (DAY0 + timedelta(days=11), DAY0 + timedelta(days=13)),
)
EVAL = EvalParams(
    eval_sets=("val_standard", "val_random"), labels=("is_click",), ks=(5,), headline_k=5, ranking_ks=(2,), bootstrap_samples=10
)


def write_csv(spark, rows, columns, path):
    frame = spark.createDataFrame(
        [tuple(None if r.get(c) is None else str(r[c]) for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns)
    )
    frame.coalesce(1).write.option("header", True).csv(str(path))
    return str(path)


def raw_release(spark, folder):
    rows = [
        {c: 0 for c in logs.LOG_COLUMNS}
        | {
            "user_id": r[0], "video_id": r[1], "date": r[2].strftime("%Y%m%d"), "hourmin": 1200, "time_ms": r[3], "tab": r[4],
            "is_click": r[7], "long_view": r[8], "is_like": r[9], "play_time_ms": r[10], "duration_ms": r[11],
            "is_rand": int(r[5] == "random"), "source": r[5],
        }
        for r in event_rows(n=1200)
    ]
    standard = [r for r in rows if r["source"] == "standard"]
    files = [
        write_csv(spark, standard[::2], logs.LOG_COLUMNS, folder / "s1.csv"),
        write_csv(spark, standard[1::2], list(reversed(logs.LOG_COLUMNS)), folder / "s2.csv"),
        write_csv(spark, [r for r in rows if r["source"] == "random"], logs.LOG_COLUMNS, folder / "r.csv"),
    ]
    items = [
        dict(zip(("video_id", "author_id", "video_type", "upload_dt", "upload_type", "video_duration", "server_width", "server_height", "music_id", "music_type", "tag"), i))
        | {"visible_status": 1}
        for i in item_rows()
    ]
    users = [{c: u % 3 for c in logs.USER_COLUMNS} | {"user_id": u, "user_active_degree": "high"} for u in range(30)]
    items_path = write_csv(spark, items, logs.ITEM_COLUMNS, folder / "items.csv")
    return files, write_csv(spark, users, logs.USER_COLUMNS, folder / "users.csv"), items_path, len(rows)


def test_commands_from_raw_files_to_results(spark, tmp_path):
    files, users, items, n_rows = raw_release(spark, tmp_path)
    out = str(tmp_path / "data")
    models = BaselineParams(item_cooc={"top_neighbors": 5}, recent_popular=None)
    results = commands.run_all(spark, files[:2], files[2:], users, items, out, SPLITS, EVAL, models)
    assert {r["model"] for r in results.select("model").distinct().collect()} == {"most_popular", "item_cooc", "random"}
    stored = logs.read_tables(spark, out)
    assert stored["interactions"].count() == n_rows and "visible_status" not in stored["items"].columns
    assert spark.read.parquet(f"{out}/features").filter(F.col("item_impr_all").isNotNull()).count() == n_rows

    tower = TwoTowerParams(max_history=4, max_tags=2, field_dim=4, user_field_dim=2, hidden=8, dim=4, batch_size=64, epochs=1)
    found = commands.run_retrieve(spark, out, SPLITS, EVAL, tower)
    assert found.filter("metric = 'recall' and value between 0 and 1").count() == 1

    sources = ("standard", "standard", "random")
    commands.run_profile(spark, list(zip(files, sources)), users, items, str(tmp_path / "profile"))
    loaded = logs.read_frames(spark, str(tmp_path / "profile"), [*profile.TABLES, "manifest"])
    assert loaded["manifest"].first()["rows"] == n_rows
    assert loaded["files"].agg(F.sum("rows")).first()[0] == n_rows
