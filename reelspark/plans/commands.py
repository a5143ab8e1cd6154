"""The whole jobs: ingest, features, baselines, retrieval and release profile.

Each reads and writes folders every executor can reach, and ends in written
tables; `run_all` is ingest, features and baselines in a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators import ingest, point_in_time, profile
from reelspark.operators.baselines import build_baselines
from reelspark.operators.two_tower import TwoTowerRetriever
from reelspark.params import BaselineParams, EvalParams, FeatureParams, SplitDates, TwoTowerParams
from reelspark.plans.experiment import evaluate_models
from reelspark.session import configure, materialize, scratch
from reelspark.sources import logs

TEXT_COLUMNS = (
    "user_active_degree",
    "follow_user_num_range",
    "fans_user_num_range",
    "friend_user_num_range",
    "register_days_range",
)


def _typed(text: DataFrame, kinds: dict[str, str], default: str) -> DataFrame:
    return text.select(*[F.col(c).cast(kinds.get(c, default)).alias(c) for c in text.columns])


def read_users(spark: SparkSession, path: str) -> DataFrame:
    kinds = {c: "string" for c in TEXT_COLUMNS} | {"user_id": "bigint"}
    return _typed(logs.read_text(spark, [path]), kinds, "int")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    kinds = {c: "string" for c in ("video_type", "upload_dt", "upload_type", "tag")}
    kinds |= {c: "bigint" for c in ("video_id", "author_id", "music_id")} | {"video_duration": "double"}
    return _typed(logs.read_text(spark, [path]), kinds, "int")


def run_ingest(
    spark: SparkSession,
    standard_paths: Sequence[str],
    random_paths: Sequence[str],
    users_path: str,
    items_path: str,
    out: str,
    splits: SplitDates,
    features: FeatureParams | None = None,
) -> None:
    """Read, check and write the processed tables and their manifest."""
    configure(spark)
    leaky = (features or FeatureParams()).leaky_columns
    # the text is parsed once; the checks and the tables read the stored copy
    with scratch(spark):
        rows = materialize(logs.read_logs(spark, list(standard_paths), list(random_paths)), "logs")
        tables = ingest.ingest(rows, read_users(spark, users_path), read_items(spark, items_path), splits, leaky)
        logs.write_tables(tables["interactions"], tables["users"], tables["items"], out)
    stored = logs.read_tables(spark, out)
    entries = ingest.manifest(stored["interactions"], stored["items"], leaky)
    entries.write.mode("overwrite").json(f"{out}/manifest")


def run_features(spark: SparkSession, data: str, features: FeatureParams | None = None) -> None:
    configure(spark)
    tables = logs.read_tables(spark, data)
    with scratch(spark):
        point_in_time.write_features(
            tables["interactions"], tables["items"], tables["users"], f"{data}/features", features
        )


def run_baselines(
    spark: SparkSession,
    data: str,
    splits: SplitDates,
    params: EvalParams | None = None,
    models: BaselineParams | None = None,
) -> DataFrame:
    """Evaluate the enabled baselines; the tidy results are written and returned."""
    params = params or EvalParams()
    return _evaluate(spark, data, splits, params, "baselines", lambda _: build_baselines(models, params.seed))


def run_retrieve(
    spark: SparkSession,
    data: str,
    splits: SplitDates,
    params: EvalParams | None = None,
    two_tower: TwoTowerParams | None = None,
) -> DataFrame:
    """Train and evaluate the two-tower retriever; the tidy results are written and returned."""
    params = params or EvalParams()

    def make(tables: dict[str, DataFrame]):
        return [TwoTowerRetriever(tables["items"], tables["users"], two_tower, params.seed)]

    return _evaluate(spark, data, splits, params, "retrieve", make)


def _evaluate(spark: SparkSession, data: str, splits: SplitDates, params: EvalParams, tag: str, make) -> DataFrame:
    configure(spark)
    tables = logs.read_tables(spark, data)
    path = f"{data}/results/{tag}"
    with scratch(spark):
        results = evaluate_models(tables["interactions"], tables["items"], splits, lambda: make(tables), params)
        logs.write_results(results, path)
    return logs.read_results(spark, path)


def run_profile(
    spark: SparkSession, files: Sequence[tuple[str, str]], users_path: str, items_path: str, out: str
) -> None:
    """Profile a release given as `(path, source)` files; tables and manifest are written."""
    configure(spark)
    numbered = [(i, path, source) for i, (path, source) in enumerate(files)]
    names = spark.createDataFrame(
        [(i, path.rstrip("/").rsplit("/", 1)[-1], source) for i, path, source in numbered],
        "file_id int, file string, source string",
    )
    items = profile.stage_items(logs.read_text(spark, [items_path]))
    users = profile.stage_users(logs.read_text(spark, [users_path]))
    with scratch(spark):
        # one pass over the text; every table reads the narrow stored copy
        staged = materialize(logs.stage_logs(spark, numbered), "staged")
        tables = profile.build_profile(staged, items, users, names)
        logs.write_frames({**tables, "manifest": profile.manifest(staged), "release_files": names}, out)


def run_all(
    spark: SparkSession,
    standard_paths: Sequence[str],
    random_paths: Sequence[str],
    users_path: str,
    items_path: str,
    out: str,
    splits: SplitDates,
    params: EvalParams | None = None,
    models: BaselineParams | None = None,
    features: FeatureParams | None = None,
) -> DataFrame:
    run_ingest(spark, standard_paths, random_paths, users_path, items_path, out, splits, features)
    run_features(spark, out, features)
    return run_baselines(spark, out, splits, params, models)
