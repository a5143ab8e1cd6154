"""Fit models as of each split's start and evaluate them on every eval set."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.catalog import build_catalog
from reelspark.operators.eval_ranking import evaluate_ranking
from reelspark.operators.eval_retrieval import evaluate_retrieval
from reelspark.operators.recommend import Recommender
from reelspark.params import EvalParams, SplitDates
from reelspark.session import materialize
from reelspark.sources import tables

RESULT_COLUMNS = ("eval_set", "model", "protocol", "label", "metric", "k", "value", "ci_lo", "ci_hi")


def evaluate_models(
    interactions: DataFrame,
    items: DataFrame,
    splits: SplitDates,
    make_models: Callable[[], list[Recommender]],
    params: EvalParams | None = None,
) -> DataFrame:
    """Tidy results, one row per eval set, model, protocol, label and metric.

    Models are fitted once per split on the rows before it. Retrieval runs on
    standard sets only, ranking on all of them.
    """
    params = params or EvalParams()
    fitted: dict[str, tuple] = {}
    parts: list[DataFrame] = []
    for name in params.eval_sets:
        split, source = tables.parse_eval_set(name)
        if split not in fitted:
            as_of = splits.start(split)
            fit_df = materialize(tables.fit_window(interactions, as_of), f"fit-{split}")
            catalog = materialize(build_catalog(items, fit_df), f"catalog-{split}")
            models = [m.fit(fit_df, catalog, as_of) for m in make_models()]
            fitted[split] = (fit_df, catalog, models, min(max(params.ks), catalog.count()))
        fit_df, catalog, models, width = fitted[split]
        eval_df = materialize(tables.eval_set(interactions, name), name)
        for model in models:
            if source == "standard":
                for label in params.labels:
                    retrieval = evaluate_retrieval(
                        model,
                        fit_df,
                        eval_df,
                        catalog,
                        label,
                        params.ks,
                        params.users,
                        params.exclude_fit_positives,
                        params.diversity_k,
                        params.seed,
                        width,
                    )
                    parts.append(_tagged(retrieval.withColumn("label", F.lit(label)), name, model, "retrieval"))
            ranking = evaluate_ranking(
                model,
                eval_df,
                params.labels,
                params.ranking_ks,
                params.group_by,
                params.gauc_weight,
                params.seed,
                params.bootstrap_samples,
            )
            parts.append(_tagged(ranking, name, model, "ranking"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _tagged(df: DataFrame, eval_set: str, model: Recommender, protocol: str) -> DataFrame:
    none = F.lit(None).cast("double")
    for bound in ("ci_lo", "ci_hi"):
        if bound not in df.columns:
            df = df.withColumn(bound, none)
    tags = {"eval_set": eval_set, "model": model.name, "protocol": protocol}
    return df.withColumns({c: F.lit(v) for c, v in tags.items()}).select(*RESULT_COLUMNS)


def results_summary(results: DataFrame, k: int) -> DataFrame:
    """Headline numbers: recall@k on standard sets, GAUC with its interval on random ones."""
    random_set = F.col("eval_set").endswith("_random")
    recall = ~random_set & (F.col("metric") == "recall") & (F.col("k") == k)
    gauc = random_set & (F.col("metric") == "gauc")
    return results.filter(recall | gauc).select(
        "label", "model", "eval_set", "metric", "value", "ci_lo", "ci_hi"
    )


def largest_k(results: DataFrame, metric: str) -> DataFrame:
    """Rows of a metric at the largest cut-off each model has for it."""
    rows = results.filter((F.col("metric") == metric) & F.col("k").isNotNull())
    top = rows.groupBy("eval_set", "model", "protocol", "label").agg(F.max("k").alias("k"))
    return rows.join(top, ["eval_set", "model", "protocol", "label", "k"], "left_semi")


def summary_table(results: DataFrame, eval_sets, k: int) -> DataFrame:
    """The headline in wide form: one row per label and model, one column per eval set."""
    summary = results_summary(results, k)
    return summary.groupBy("label", "model").agg(
        *[F.max(F.when(F.col("eval_set") == s, F.col("value"))).alias(s) for s in eval_sets]
    )
