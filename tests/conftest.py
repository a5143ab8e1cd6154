import sys
from datetime import date, timedelta
from pathlib import Path
from random import Random

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from reelspark.session import BUILDER_SETTINGS, configure, release  # noqa: E402

DAY0 = date(2024, 3, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config(map=BUILDER_SETTINGS)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield configure(session)
    release(session)
    session.stop()


def event_rows(n=2500, users=30, items=40, days=14, seed=3, hot=0.33):
    """Random events where one item and one user hold about a third of all rows each."""
    rng = Random(seed)
    rows = []
    for i in range(n):
        user = 0 if rng.random() < hot else rng.randrange(users)
        item = 0 if rng.random() < hot else rng.randrange(items)
        day = rng.randrange(days)
        click, view, like = (int(rng.random() < p) for p in (0.4, 0.5, 0.1))
        source = "random" if rng.random() < 0.25 else "standard"
        split = "train" if day < 8 else "val" if day < 11 else "test"
        rows.append(
            (user, item, DAY0 + timedelta(days=day), 1000 * day + i % 97, i % 3, source, split, click, view, like, 10 * (i % 7), 70)
        )
    return rows


EVENT_SCHEMA = (
    "user_id bigint, item_id bigint, date date, time_ms bigint, tab int, source string, split string, "
    "is_click int, long_view int, is_like int, play_time_ms bigint, duration_ms bigint"
)
ITEM_SCHEMA = (
    "item_id bigint, author_id bigint, video_type string, upload_dt date, upload_type string, video_duration double, "
    "server_width int, server_height int, music_id bigint, music_type int, tag string"
)


def item_rows(items=40):
    return [
        (
            i,
            None if i % 9 == 4 else i % 6,
            "NORMAL" if i % 5 else "AD",
            DAY0 + timedelta(days=i % 12) if i % 7 else None,
            "cam",
            float(1000 * (i % 20)),
            720,
            1280,
            i % 4,
            i % 3,
            None if i % 8 == 0 else f"{i % 5},{i % 3}",
        )
        for i in range(items)
    ]


@pytest.fixture(scope="session")
def events(spark):
    return spark.createDataFrame(event_rows(), EVENT_SCHEMA).persist()


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame(item_rows(), ITEM_SCHEMA).persist()


@pytest.fixture(scope="session")
def users(spark):
    columns = ["user_active_degree string"] + [
        f"{c} int"
        for c in (
            "is_lowactive_period is_live_streamer is_video_author follow_user_num fans_user_num friend_user_num register_days"
        ).split()
    ]
    columns += [f"onehot_feat{i} int" for i in range(18)]
    rows = [(u, "high" if u % 2 else "low", *[u % (i + 2) for i in range(7)], *[u % (i + 1) for i in range(18)]) for u in range(28)]
    return spark.createDataFrame(rows, "user_id bigint, " + ", ".join(columns)).persist()
