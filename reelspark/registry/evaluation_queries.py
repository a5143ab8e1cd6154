"""Retrieval and ranking evaluation (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import stats
from reelspark.operators import catalog as cat
from reelspark.operators import eval_ranking as er
from reelspark.operators import eval_retrieval as ev
from reelspark.operators.popularity import MostPopular
from reelspark.operators.random_ranker import RandomRecommender
from reelspark.params import EvalParams
from reelspark.plans import experiment
from reelspark.registry.common import gini_sql, hash_sql, query, tie_sql, view
from reelspark.registry.model_queries import AS_OF, K, SEED, Setting
from reelspark.session import materialize, scratch_path
from reelspark.sources import fixtures, logs

KS, DIVERSITY_K = (5, 10), 5
LABELS = ("is_click", "long_view")
N_BOOT = 50
PRIME = 2_147_483_647


view(
    "v_hits",
    "SELECT l.*, t.user_id IS NOT NULL AS hit FROM m_popular_lists l LEFT JOIN m_targets t "
    "ON t.user_id = l.user_id AND t.item_id = l.item_id",
    "m_popular_lists",
    "m_targets",
)
view(
    "v_sizes",
    "SELECT user_id, count(*) AS n_targets FROM m_targets GROUP BY user_id",
    "m_targets",
)
view(
    "v_info",
    """
    SELECT item_id, category, -log2((coalesce(n, 0) + 1) /
           ((SELECT count(*) FROM m_fit) + (SELECT count(*) FROM m_catalog))) AS information
    FROM m_catalog LEFT JOIN (SELECT item_id, count(*) AS n FROM m_fit GROUP BY item_id) USING (item_id)
    """,
    "m_catalog",
    "m_fit",
)
view("v_ideal", "SELECT n, sum(1 / log2(n + 1)) OVER (ORDER BY n) AS dcg FROM range(1, 1000) t(n)")


def _user_sql() -> str:
    out = []
    for k in KS:
        out.append(f"count(*) FILTER (hit AND rank <= {k}) / n_targets AS recall_{k}")
        out.append(f"cast(count(*) FILTER (hit AND rank <= {k}) > 0 AS double) AS hit_{k}")
        out.append(
            f"coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= {k}), 0) / "
            f"(SELECT dcg FROM v_ideal WHERE n = least(n_targets, {k})) AS ndcg_{k}"
        )
        out.append(f"avg(information) FILTER (rank <= {k}) AS novelty_{k}")
    return (
        f"SELECT user_id, n_targets, {', '.join(out)} FROM v_sizes JOIN v_hits USING (user_id) "
        "JOIN v_info USING (item_id) GROUP BY user_id, n_targets"
    )


view("v_user", _user_sql(), "v_sizes", "v_hits", "v_info", "v_ideal")
view(
    "v_diversity",
    f"""
    SELECT a.user_id, count(*) FILTER (a.rank <> b.rank AND x.category <> y.category) / {DIVERSITY_K * (DIVERSITY_K - 1)}
               AS ild
    FROM m_popular_lists a JOIN m_popular_lists b ON a.user_id = b.user_id
    JOIN m_catalog x ON x.item_id = a.item_id JOIN m_catalog y ON y.item_id = b.item_id
    WHERE a.rank <= {DIVERSITY_K} AND b.rank <= {DIVERSITY_K} GROUP BY a.user_id
    """,
    "m_popular_lists",
    "m_catalog",
)
view(
    "v_counts",
    " UNION ALL ".join(
        f"SELECT {k} AS k, a.item_id, count(l.user_id) AS n FROM m_available a LEFT JOIN "
        f"(SELECT * FROM m_popular_lists WHERE rank <= {k}) l USING (item_id) GROUP BY a.item_id"
        for k in KS
    ),
    "m_available",
    "m_popular_lists",
)
view(
    "v_spread",
    f"""
    SELECT k, len([n FOR n IN counts IF n > 0]) / len(counts) AS coverage, {gini_sql('counts')} AS gini
    FROM (SELECT k, list(n) AS counts FROM v_counts GROUP BY k)
    """,
    "v_counts",
)


def _popular_hits(s):
    targets, exclusions = s.targets()
    people = targets.select("user_id").distinct()
    model = MostPopular("is_click").fit(s.fit, s.catalog, AS_OF)
    lists = materialize(model.recommend(people, K, exclusions, s.available, SEED), "recommended")
    return lists, targets


def _user_frame(s):
    lists, targets = _popular_hits(s)
    described = ev.hit_lists(lists, targets).join(ev.item_information(s.fit, s.catalog), "item_id")
    return ev.user_metrics(described, targets, KS, K, DIVERSITY_K)


@query(
    "g2_tie_order",
    f"SELECT item_id, row_number() OVER (ORDER BY {tie_sql(SEED, 'item_id')}, item_id) AS position FROM m_catalog",
    ("m_catalog",),
)
def tie_order(spark, d):
    """One shared permutation of the catalog, ranked without a global sort."""
    level = Setting(spark, d).catalog.select("item_id", F.lit(0).alias("_level"))
    return stats.global_rank(level, "_level", "item_id", SEED).select("item_id", "position")


@query(
    "g3_positives",
    "SELECT DISTINCT user_id, item_id FROM m_eval WHERE is_click = 1 AND item_id IN (SELECT item_id FROM m_catalog)",
    ("m_eval", "m_catalog"),
)
def positives(spark, d):
    s = Setting(spark, d)
    return cat.positives(s.eval, "is_click", s.catalog)


@query("g4_targets", "SELECT * FROM m_targets", ("m_targets",))
def targets(spark, d):
    return Setting(spark, d).targets()[0]


@query("g4_exclusions", "SELECT * FROM m_excluded", ("m_excluded",))
def exclusions(spark, d):
    return Setting(spark, d).targets()[1]


@query("g5_hits", "SELECT user_id, item_id, rank, cast(hit AS integer) AS hit FROM v_hits", ("v_hits",))
def hits(spark, d):
    lists, wanted = _popular_hits(Setting(spark, d))
    return ev.hit_lists(lists, wanted)


@query(
    "g6_retrieval_metrics",
    "SELECT user_id, n_targets, "
    + ", ".join(f"round({m}_{k}, 8) AS {m}_{k}" for m in ("recall", "hit", "ndcg") for k in KS)
    + " FROM v_user",
    ("v_user",),
)
def retrieval_metrics(spark, d):
    frame = _user_frame(Setting(spark, d))
    return frame.select(
        "user_id",
        "n_targets",
        *[F.round(F.col(f"`{m}@{k}`"), 8).alias(f"{m}_{k}") for m in ("recall", "hit", "ndcg") for k in KS],
    )


@query(
    "g7_g8_coverage_gini", "SELECT k, round(coverage, 8) AS coverage, round(gini, 8) AS gini FROM v_spread", ("v_spread",)
)
def coverage_gini(spark, d):
    s = Setting(spark, d)
    spread = ev.list_concentration(_popular_hits(s)[0], s.available, KS)
    return spread.withColumns({c: F.round(c, 8) for c in ("coverage", "gini")})


@query(
    "g9_novelty",
    f"SELECT {', '.join(f'round(avg(novelty_{k}), 6) AS novelty_{k}' for k in KS)} FROM v_user",
    ("v_user",),
)
def novelty(spark, d):
    frame = _user_frame(Setting(spark, d))
    return frame.agg(*[F.round(F.avg(F.col(f"`novelty@{k}`")), 6).alias(f"novelty_{k}") for k in KS])


@query("g10_intra_list_diversity", "SELECT user_id, round(ild, 8) AS ild FROM v_diversity", ("v_diversity",))
def diversity(spark, d):
    frame = _user_frame(Setting(spark, d))
    return frame.select("user_id", F.round(F.col(f"`ild@{DIVERSITY_K}`"), 8).alias("ild"))


# --- ranking --------------------------------------------------------------------

view(
    "r_exposed",
    "SELECT user_id, item_id, max(is_click) AS is_click, max(long_view) AS long_view FROM m_large "
    "WHERE split = 'val' GROUP BY user_id, item_id",
    "m_large",
)
view(
    "r_scored",
    "SELECT e.*, p.score, cast(user_id AS varchar) AS group_id FROM r_exposed e JOIN m_popular p USING (item_id)",
    "r_exposed",
    "m_popular",
)
view(
    "r_long",
    "SELECT 'is_click' AS label, group_id, item_id, score, is_click::bigint AS y FROM r_scored "
    "UNION ALL SELECT 'long_view', group_id, item_id, score, long_view::bigint FROM r_scored",
    "r_scored",
)
view(
    "r_auc",
    """
    SELECT p.label, p.group_id,
           avg(CASE WHEN p.score > n.score THEN 1.0::double WHEN p.score = n.score THEN 0.5::double ELSE 0.0::double END) AS auc
    FROM (SELECT * FROM r_long WHERE y = 1) p JOIN (SELECT * FROM r_long WHERE y = 0) n
      ON p.label = n.label AND p.group_id = n.group_id
    GROUP BY p.label, p.group_id
    """,
    "r_long",
)
view(
    "r_groups",
    "SELECT a.label, a.group_id, g.n, a.auc FROM r_auc a JOIN "
    "(SELECT label, group_id, count(*) AS n FROM r_long GROUP BY ALL) g USING (label, group_id)",
    "r_auc",
)
_SHUFFLED = hash_sql(str(SEED), "group_id", "item_id")
view(
    "r_lists",
    "SELECT label, group_id, "
    + ", ".join(
        f"coalesce(sum(y / log2(rank + 1)) FILTER (rank <= {k}), 0) / "
        f"(SELECT dcg FROM v_ideal WHERE n = least(sum(y), {k})) AS ndcg_{k}"
        for k in KS
    )
    + f""" FROM (SELECT *, row_number() OVER (PARTITION BY label, group_id ORDER BY score DESC, {_SHUFFLED}, item_id) AS rank
                 FROM r_long) GROUP BY label, group_id HAVING sum(y) > 0""",
    "r_long",
    "v_ideal",
)


def _boot_sql(groups: str, value: str, weight: str) -> str:
    cdf = " ".join(f"WHEN u < {edge}::double THEN {i}" for i, edge in enumerate(stats.POISSON_CDF))
    b = "cast(b AS varchar)"
    drawn_from = {name: f"cast('0x' || substr(md5('{SEED}:{name}:' || {b}), 1, 13) AS bigint) % {PRIME}" for name in stats.CONSTANTS}
    consts = ", ".join(f"{sql} AS {name}" for name, sql in drawn_from.items())
    return f"""
    WITH consts AS (SELECT b, {consts} FROM range(1, {N_BOOT + 1}) t(b)),
    hashed AS (SELECT label, {value} AS v, {weight}::double AS w, {hash_sql(str(SEED), 'group_id')} AS h FROM {groups}),
    drawn AS (SELECT label, v, w, b,
                     ((((h // 67108864) * m1 + (h % 67108864) * m2 + a1) % {PRIME}) * 2097152
                      + (((h // 67108864) * m3 + (h % 67108864) * m4 + a2) % {PRIME}) % 2097152) / 4503599627370496.0::double AS u
              FROM hashed, consts),
    times AS (SELECT label, b, v, w, CASE {cdf} ELSE {len(stats.POISSON_CDF)} END AS x FROM drawn),
    means AS (SELECT label, b, sum(w * v * x) / nullif(sum(w * x), 0) AS mean FROM times GROUP BY label, b)
    SELECT label, round(quantile_cont(mean, 0.025), 7) AS ci_lo, round(quantile_cont(mean, 0.975), 7) AS ci_hi
    FROM means GROUP BY label
    """


def _scored(spark, d):
    s = Setting(spark, d)
    shown = s.large.filter(F.col("split") == "val")
    model = MostPopular("is_click").fit(s.fit, s.catalog, AS_OF)
    return er.with_group(model.score_pairs(er.exposures(shown, LABELS)))


@query("g11_exposures", "SELECT * FROM r_exposed", ("r_exposed",))
def exposures(spark, d):
    shown = Setting(spark, d).large.filter(F.col("split") == "val")
    return er.exposures(shown, LABELS)


@query(
    "g11_exposures_by_day",
    "SELECT user_id, item_id, date, max(is_click) AS is_click FROM fx_x GROUP BY user_id, item_id, date",
    ("fx_x",),
)
def exposures_by_day(spark, d):
    return er.exposures(fixtures.interactions(spark, d), ["is_click"], "user_date")


@query("g12_scorable", "SELECT * FROM r_scored", ("r_scored",))
def scorable(spark, d):
    return _scored(spark, d)


@query(
    "g13_auc",
    """
    WITH x AS (SELECT quality AS y, n_chars::double AS s FROM labels JOIN documents USING (doc_id)),
    r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM x)
    SELECT count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg,
           round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
                 / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) AS auc
    FROM r
    """,
)
def auc(spark, d):
    """Document length as a score for the quality label, over all labelled documents."""
    documents = fixtures.table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    labelled = fixtures.table(spark, d, "labels").select("doc_id", "quality").join(documents, "doc_id")
    return stats.grouped_auc(labelled, [], "quality", "score").withColumn("auc", F.round("auc", 8))


@query(
    "g13_auc_per_label",
    """
    SELECT p.label, round(avg(CASE WHEN p.score > n.score THEN 1.0::double WHEN p.score = n.score THEN 0.5::double
                                   ELSE 0.0::double END), 8) AS auc
    FROM (SELECT * FROM r_long WHERE y = 1) p JOIN (SELECT * FROM r_long WHERE y = 0) n USING (label) GROUP BY p.label
    """,
    ("r_long",),
)
def auc_per_label(spark, d):
    long = er.by_label(_scored(spark, d), ["score"], LABELS)
    return stats.grouped_auc(long, ["label"], "y", "score").select("label", F.round("auc", 8).alias("auc"))


@query("g14_group_auc", "SELECT label, group_id, n, round(auc, 8) AS auc FROM r_groups", ("r_groups",))
def group_auc(spark, d):
    return er.group_auc(_scored(spark, d), LABELS).withColumn("auc", F.round("auc", 8))


@query(
    "g14_gauc",
    "SELECT label, round(sum(auc * n) / sum(n), 8) AS gauc, round(avg(auc), 8) AS gauc_uniform, count(*) AS groups "
    "FROM r_groups GROUP BY label",
    ("r_groups",),
)
def gauc(spark, d):
    groups = er.group_auc(_scored(spark, d), LABELS)
    return groups.groupBy("label").agg(
        F.round(F.sum(F.col("auc") * F.col("n")) / F.sum("n"), 8).alias("gauc"),
        F.round(F.avg("auc"), 8).alias("gauc_uniform"),
        F.count(F.lit(1)).alias("groups"),
    )


@query(
    "g15_group_ndcg",
    "SELECT label, group_id, " + ", ".join(f"round(ndcg_{k}, 8) AS ndcg_{k}" for k in KS) + " FROM r_lists",
    ("r_lists",),
)
def group_ndcg(spark, d):
    lists = er.group_ndcg(_scored(spark, d), LABELS, KS, SEED)
    return lists.withColumns({f"ndcg_{k}": F.round(f"ndcg_{k}", 8) for k in KS})


@query("g16_bootstrap_gauc", _boot_sql("r_groups", "auc", "n"), ("r_groups",))
def bootstrap_gauc(spark, d):
    groups = er.group_auc(_scored(spark, d), LABELS)
    ci = stats.bootstrap_interval(groups, ["label"], ["group_id"], "auc", "n", N_BOOT, SEED)
    return ci.withColumns({c: F.round(c, 7) for c in ("ci_lo", "ci_hi")})


@query("g16_bootstrap_ndcg", _boot_sql("r_lists", "ndcg_5", "1"), ("r_lists",))
def bootstrap_ndcg(spark, d):
    lists = er.group_ndcg(_scored(spark, d), LABELS, KS, SEED).withColumn("w", F.lit(1.0))
    ci = stats.bootstrap_interval(lists, ["label"], ["group_id"], "ndcg_5", "w", N_BOOT, SEED)
    return ci.withColumns({c: F.round(c, 7) for c in ("ci_lo", "ci_hi")})


@query(
    "g17_gini",
    f"""
    SELECT split, round({gini_sql('counts')}, 8) AS gini
    FROM (SELECT split, list(n) AS counts FROM (SELECT split, item_id, count(*) AS n FROM fx_large GROUP BY split, item_id) GROUP BY split)
    """,
    ("fx_large",),
)
def gini(spark, d):
    counts = fixtures.interactions_large(spark, d).groupBy("split", "item_id").agg(F.count(F.lit(1)).alias("n"))
    shares = stats.concentration(stats.count_histogram(counts, ["split"]), ["split"])
    return shares.select("split", F.round("gini", 8).alias("gini"))


# --- whole evaluation -------------------------------------------------------------


def _metric(name: str, k, value: str, source: str) -> str:
    k = "NULL" if k is None else str(k)
    return f"SELECT '{name}' AS metric, cast({k} AS integer) AS k, round({value}, 7) AS value FROM {source}"


@query(
    "g4_g10_retrieval_evaluation",
    " UNION ALL ".join(
        [_metric(m, k, f"avg({m}_{k})", "v_user") for m in ("recall", "hit", "ndcg", "novelty") for k in KS]
        + [_metric(m, k, m, f"v_spread WHERE k = {k}") for m in ("coverage", "gini") for k in KS]
        + [_metric("ild", DIVERSITY_K, "avg(ild)", "v_diversity"), _metric("n_users", None, "count(*)", "v_user")]
    ),
    ("v_user", "v_spread", "v_diversity"),
)
def retrieval_evaluation(spark, d):
    """All retrieval metrics of one model and label in tidy form."""
    s = Setting(spark, d)
    model = MostPopular("is_click").fit(s.fit, s.catalog, AS_OF)
    out = ev.evaluate_retrieval(
        model, s.fit, s.eval, s.catalog, "is_click", KS, diversity_k=DIVERSITY_K, seed=SEED
    )
    return out.withColumn("value", F.round("value", 7))


PARAMS = EvalParams(
    eval_sets=("val_standard", "val_random"), ks=KS, headline_k=10, ranking_ks=KS, bootstrap_samples=N_BOOT, seed=SEED
)


def _models():
    return [MostPopular("is_click"), RandomRecommender(SEED)]


def _results(spark, d):
    s = Setting(spark, d)
    return experiment.evaluate_models(s.large, s.items, fixtures.ORDER_SPLITS, _models, PARAMS)


@query("g18_evaluate_models")
def evaluate_models(spark, d):
    """Two models on a standard and a random eval set: tidy results."""
    return _results(spark, d).withColumns({c: F.round(c, 7) for c in ("value", "ci_lo", "ci_hi")})


view(
    "w_scored",
    "SELECT e.user_id, e.is_click AS y, p.score FROM (SELECT user_id, item_id, max(is_click) AS is_click FROM m_large "
    "WHERE split = 'val' AND source = 'random' GROUP BY ALL) e JOIN m_popular p USING (item_id)",
    "m_popular",
)


@query(
    "g19_results_summary",
    """
    WITH a AS (SELECT p.user_id, avg(CASE WHEN p.score > n.score THEN 1.0::double WHEN p.score = n.score THEN 0.5::double
                                          ELSE 0.0::double END) AS auc
               FROM w_scored p JOIN w_scored n ON p.user_id = n.user_id AND p.y = 1 AND n.y = 0 GROUP BY p.user_id),
    g AS (SELECT user_id, count(*) AS n FROM w_scored GROUP BY user_id)
    SELECT 'is_click' AS label, 'most_popular' AS model, round((SELECT avg(recall_10) FROM v_user), 7) AS val_standard,
           round((SELECT sum(auc * n) / sum(n) FROM a JOIN g USING (user_id)), 7) AS val_random
    """,
    ("w_scored", "v_user"),
)
def results_summary(spark, d):
    """Recall on the standard set and GAUC on the random one, written and read as JSON first."""
    s = Setting(spark, d)
    params = EvalParams(
        eval_sets=PARAMS.eval_sets, labels=("is_click",), ks=KS, headline_k=10, ranking_ks=KS, bootstrap_samples=0, seed=SEED
    )
    results = experiment.evaluate_models(
        s.large, s.items, fixtures.ORDER_SPLITS, lambda: [MostPopular("is_click")], params
    )
    path = scratch_path(spark, "results")
    logs.write_results(results, path)
    table = experiment.summary_table(logs.read_results(spark, path), PARAMS.eval_sets, params.headline_k)
    return table.withColumns({c: F.round(c, 7) for c in PARAMS.eval_sets})
