"""Recommenders (E) and the joins they rest on."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from reelspark.operators import catalog as cat
from reelspark.operators import cooccurrence as cooc
from reelspark.operators.baselines import build_baselines
from reelspark.operators.cooccurrence import ItemCooccurrence
from reelspark.operators.popularity import MostPopular
from reelspark.operators.pruned_neighbors import pruned_neighbors
from reelspark.operators.random_ranker import RandomRecommender
from reelspark.operators.recommend import top_k
from reelspark.params import BaselineParams
from reelspark.registry.common import hash_sql, query, tie_sql, view
from reelspark.session import materialize
from reelspark.sources import fixtures, tables

SEED, K, HISTORY, NEIGHBORS, SHRINKAGE, WINDOW = 17, 10, 20, 15, 10.0, 60
AS_OF = date(2000, 7, 1)

# Uploads reach past the eval window. Some impressions are of items that the item
# table does not know, so that the catalog must take logged items in.
UNKNOWN_ITEM = 1_000_000_000
view("m_items", "SELECT * REPLACE (DATE '2000-11-20' + cast((item_id * 13) % 55 AS integer) AS upload_dt) FROM fx_items", "fx_items")
view(
    "m_large",
    f"SELECT * REPLACE (CASE WHEN (item_id * 31 + user_id) % 23 = 7 THEN item_id + {UNKNOWN_ITEM} ELSE item_id END AS item_id) FROM fx_large",
    "fx_large",
)
view("m_fit", "SELECT * FROM m_large WHERE date < DATE '2000-07-01' AND source = 'standard'", "m_large")
view("m_eval", "SELECT * FROM m_large WHERE split = 'val' AND source = 'standard'", "m_large")
view(
    "m_catalog",
    """
    SELECT item_id, coalesce(CASE WHEN regexp_full_match(split_part(tag, ',', 1), '[0-9]+')
                                  THEN cast(split_part(tag, ',', 1) AS bigint) END, -1) AS category, upload_dt
    FROM (SELECT item_id FROM m_items UNION SELECT item_id FROM m_fit) LEFT JOIN m_items USING (item_id)
    """,
    "m_items",
    "m_fit",
)
view(
    "m_available",
    "SELECT * FROM m_catalog WHERE upload_dt IS NULL OR upload_dt <= (SELECT max(date) FROM m_eval)",
    "m_catalog",
    "m_eval",
)
view("m_seen", "SELECT DISTINCT user_id, item_id FROM m_fit WHERE is_click = 1", "m_fit")
view(
    "m_targets",
    """
    SELECT DISTINCT user_id, item_id FROM m_eval
    WHERE is_click = 1 AND user_id IN (SELECT user_id FROM m_fit) AND item_id IN (SELECT item_id FROM m_available)
      AND NOT EXISTS (SELECT 1 FROM m_seen s WHERE s.user_id = m_eval.user_id AND s.item_id = m_eval.item_id)
    """,
    "m_available",
    "m_seen",
)
view(
    "m_excluded",
    "SELECT * FROM m_seen WHERE user_id IN (SELECT user_id FROM m_targets)",
    "m_targets",
)
view(
    "m_open",
    """
    SELECT u.user_id, a.item_id FROM (SELECT DISTINCT user_id FROM m_targets) u CROSS JOIN m_available a
    WHERE NOT EXISTS (SELECT 1 FROM m_excluded e WHERE e.user_id = u.user_id AND e.item_id = a.item_id)
    """,
    "m_excluded",
)
view(
    "m_popular",
    "SELECT item_id, cast(coalesce(n, 0) AS double) AS score FROM m_catalog LEFT JOIN "
    "(SELECT item_id, count(*) AS n FROM m_fit WHERE is_click = 1 GROUP BY item_id) USING (item_id)",
    "m_catalog",
)
view(
    "m_history",
    f"""
    SELECT user_id, item_id FROM (
        SELECT user_id, item_id, max((date, time_ms)) AS last FROM m_fit WHERE is_click = 1 GROUP BY user_id, item_id)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last DESC, item_id DESC) <= {HISTORY}
    """,
    "m_fit",
)
view("m_n", "SELECT item_id, count(*) AS n FROM m_history GROUP BY item_id", "m_history")
view(
    "m_pairs",
    "SELECT a.item_id AS src_item, b.item_id AS dst_item, count(*) AS n_both FROM m_history a JOIN m_history b "
    "ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2",
    "m_history",
)
view(
    "m_sim_all",
    f"SELECT src_item, dst_item, n_both / (sqrt((a.n * b.n)::double) + {SHRINKAGE}::double) AS sim FROM m_pairs "
    "JOIN m_n a ON a.item_id = src_item JOIN m_n b ON b.item_id = dst_item",
    "m_pairs",
    "m_n",
)
view(
    "m_sim",
    f"""
    SELECT src_item, dst_item, sim, floor(sim * 1e15::double)::bigint AS units FROM m_sim_all
    QUALIFY row_number() OVER (PARTITION BY src_item ORDER BY sim DESC, dst_item) <= {NEIGHBORS}
    """,
    "m_sim_all",
)
view(
    "m_base",
    "SELECT item_id, floor(coalesce(n, 0)::double / (SELECT max(n) FROM m_n)::double * 1e9::double)::bigint AS base "
    "FROM m_catalog LEFT JOIN m_n USING (item_id)",
    "m_catalog",
    "m_n",
)
view(
    "m_near",
    "SELECT h.user_id, s.dst_item AS item_id, sum(s.units) AS units FROM m_history h "
    "JOIN m_sim s ON s.src_item = h.item_id GROUP BY 1, 2",
    "m_history",
    "m_sim",
)


def listed_sql(order: str, source: str, k: int = K) -> str:
    return f"""
    SELECT user_id, item_id, rank FROM (
        SELECT o.user_id, o.item_id, row_number() OVER (PARTITION BY o.user_id
               ORDER BY {order} DESC, {tie_sql(SEED, 'o.item_id')}, o.item_id) AS rank
        FROM m_open o {source}) WHERE rank <= {k}
    """


view("m_popular_lists", listed_sql("p.score", "JOIN m_popular p USING (item_id)"), "m_open", "m_popular")
view(
    "m_cooc_lists",
    listed_sql(
        "coalesce(n.units, 0) + b.base",
        "JOIN m_base b USING (item_id) LEFT JOIN m_near n ON n.user_id = o.user_id AND n.item_id = o.item_id",
    ),
    "m_open",
    "m_base",
    "m_near",
)


def with_unknown_items(log):
    """`log` with some impressions of items that no item table has."""
    known = (F.col("item_id") * 31 + F.col("user_id")) % 23 != 7
    return log.withColumn("item_id", F.when(known, F.col("item_id")).otherwise(F.col("item_id") + UNKNOWN_ITEM))


class Setting:
    """The shared model fixture: fit window, eval set, catalog, targets."""

    def __init__(self, spark, d):
        large = with_unknown_items(fixtures.interactions_large(spark, d))
        items = fixtures.items(spark, d)
        shifted = F.date_add(F.lit("2000-11-20").cast("date"), ((F.col("item_id") * 13) % 55).cast("int"))
        self.items = items.withColumn("upload_dt", shifted)
        self.large = large
        self.fit = tables.fit_window(large, AS_OF)
        self.eval = tables.eval_set(large, "val_standard")
        self.catalog = cat.build_catalog(self.items, self.fit)
        self.available = cat.available_items(self.catalog, self.eval.agg(F.max("date")).scalar())

    def targets(self):
        """Targets and exclusions; what they and the later steps share is written once."""
        self.fit, self.eval = materialize(self.fit, "fit"), materialize(self.eval, "eval")
        self.catalog = materialize(cat.build_catalog(self.items, self.fit), "catalog")
        self.available = cat.available_items(self.catalog, self.eval.agg(F.max("date")).scalar())
        return cat.retrieval_targets(self.eval, self.fit, "is_click", self.catalog, self.available)

    def lists(self, model, k: int = K):
        targets, exclusions = self.targets()
        fitted = model.fit(self.fit, self.catalog, AS_OF)
        return fitted.recommend(targets.select("user_id").distinct(), k, exclusions, self.available, SEED)

    def pairs(self):
        """Eval pairs plus one pair per user with an item no catalog knows."""
        pairs = self.eval.select("user_id", "item_id").distinct()
        unknown = pairs.select("user_id").distinct().withColumn("item_id", F.lit(-5).cast("bigint"))
        return pairs.unionByName(unknown)


def cooc_model():
    return ItemCooccurrence("is_click", NEIGHBORS, SHRINKAGE, HISTORY)


@query("e1_catalog", "SELECT * FROM m_catalog", ("m_catalog",))
def catalog(spark, d):
    return Setting(spark, d).catalog


@query(
    "e2_known_items",
    "SELECT item_id, item_id IN (SELECT item_id FROM m_catalog) AS known FROM (SELECT DISTINCT item_id FROM m_large)",
    ("m_catalog",),
)
def known_items(spark, d):
    """Id lookup: an item outside the catalog stays unmatched."""
    s = Setting(spark, d)
    marked = s.catalog.select("item_id", F.lit(True).alias("known"))
    logged = s.large.select("item_id").distinct().join(marked, "item_id", "left")
    return logged.withColumn("known", F.coalesce("known", F.lit(False)))


@query("e3_popularity", "SELECT * FROM m_popular", ("m_popular",))
def popularity(spark, d):
    s = Setting(spark, d)
    return MostPopular("is_click").fit(s.fit, s.catalog, AS_OF).item_scores


@query(
    "e4_recent_popularity",
    f"""
    SELECT item_id, cast(coalesce(n, 0) AS double) AS score FROM m_catalog LEFT JOIN
        (SELECT item_id, count(*) AS n FROM m_fit WHERE is_click = 1 AND date >= DATE '2000-07-01' - {WINDOW}
         GROUP BY item_id) USING (item_id)
    """,
    ("m_catalog",),
)
def recent_popularity(spark, d):
    s = Setting(spark, d)
    return MostPopular("is_click", WINDOW).fit(s.fit, s.catalog, AS_OF).item_scores


@query(
    "e5_popularity_pairs",
    "SELECT DISTINCT user_id, item_id, score FROM m_eval JOIN m_popular USING (item_id)",
    ("m_eval", "m_popular"),
)
def popularity_pairs(spark, d):
    s = Setting(spark, d)
    return MostPopular("is_click").fit(s.fit, s.catalog, AS_OF).score_pairs(s.pairs())


@query("e6_popularity_lists", "SELECT * FROM m_popular_lists", ("m_popular_lists",))
def popularity_lists(spark, d):
    return Setting(spark, d).lists(MostPopular("is_click"))


@query("e7_histories", "SELECT * FROM m_history", ("m_history",))
def histories(spark, d):
    return cooc.user_histories(Setting(spark, d).fit, "is_click", HISTORY)


@query("j7_item_pairs", "SELECT src_item, dst_item, n_both FROM m_pairs WHERE src_item < dst_item", ("m_pairs",))
def item_pairs(spark, d):
    """Users shared by each pair of items."""
    pairs = cooc.co_users(cooc.user_histories(Setting(spark, d).fit, "is_click", HISTORY))
    return pairs.select(F.col("item_a").alias("src_item"), F.col("item_b").alias("dst_item"), "n_both")


@query("e8_similarity", "SELECT src_item, dst_item, round(sim, 9) AS sim FROM m_sim_all", ("m_sim_all",))
def similarity(spark, d):
    pairs = cooc.co_users(cooc.user_histories(Setting(spark, d).fit, "is_click", HISTORY))
    return cooc.item_similarities(pairs, SHRINKAGE).withColumn("sim", F.round("sim", 9))


@query("e9_top_neighbors", "SELECT src_item, dst_item, units FROM m_sim", ("m_sim",))
def neighbors(spark, d):
    s = Setting(spark, d)
    return cooc_model().fit(s.fit, s.catalog, AS_OF).similarities.select("src_item", "dst_item", "units")


@query("e9_pruned_neighbors", "SELECT src_item, dst_item, units FROM m_sim", ("m_sim",))
def neighbors_by_bounds(spark, d):
    """The same lists without making the pairs that bounds rule out."""
    history = materialize(cooc.user_histories(Setting(spark, d).fit, "is_click", HISTORY), "histories")
    nearest, _ = pruned_neighbors(history, NEIGHBORS, SHRINKAGE)
    return nearest.select("src_item", "dst_item", F.floor(F.col("sim") * cooc.UNIT).cast("bigint").alias("units"))


@query(
    "e10_cooccurrence_pairs",
    """
    SELECT p.user_id, p.item_id, round((coalesce(n.units, 0) + b.base)::double / 1e15::double, 10) AS score
    FROM (SELECT DISTINCT user_id, item_id FROM m_eval) p JOIN m_base b USING (item_id)
    LEFT JOIN m_near n ON n.user_id = p.user_id AND n.item_id = p.item_id
    """,
    ("m_eval", "m_base", "m_near"),
)
def cooccurrence_pairs(spark, d):
    s = Setting(spark, d)
    scored = cooc_model().fit(s.fit, s.catalog, AS_OF).score_pairs(s.pairs())
    return scored.withColumn("score", F.round("score", 10))


@query("j8_history_by_similarity", "SELECT user_id, item_id, units::bigint AS units FROM m_near", ("m_near",))
def history_by_similarity(spark, d):
    """History x similarity as a join and a sum."""
    s = Setting(spark, d)
    model = cooc_model().fit(s.fit, s.catalog, AS_OF)
    return model.candidates(model.history.select("user_id").distinct())


@query("e11_cooccurrence_lists", "SELECT * FROM m_cooc_lists", ("m_cooc_lists",))
def cooccurrence_lists(spark, d):
    return Setting(spark, d).lists(cooc_model())


@query(
    "e13_random_pairs",
    f"""
    SELECT DISTINCT user_id, item_id,
           round({hash_sql('17', 'user_id', 'item_id')} / 4503599627370496.0::double, 9) AS score
    FROM m_eval WHERE item_id IN (SELECT item_id FROM m_catalog)
    """,
    ("m_eval", "m_catalog"),
)
def random_pairs(spark, d):
    s = Setting(spark, d)
    scored = RandomRecommender(SEED).fit(s.fit, s.catalog, AS_OF).score_pairs(s.pairs())
    return scored.withColumn("score", F.round("score", 9))


@query(
    "e13_random_lists",
    f"""
    WITH placed AS (SELECT item_id, row_number() OVER (ORDER BY {tie_sql(17, 'item_id')}, item_id) - 1 AS position
                    FROM m_available),
    size AS (SELECT count(*) AS n FROM m_available),
    prime AS (SELECT min(c.p) AS p FROM (SELECT unnest(range(n, n + 1000)) AS p FROM size) c
              WHERE c.p >= 2 AND NOT EXISTS (SELECT 1 FROM range(2, 2000) t(f) WHERE t.f * t.f <= c.p AND c.p % t.f = 0)),
    users AS (SELECT DISTINCT user_id, {hash_sql('17:start', 'user_id')} AS a, {hash_sql('17:stride', 'user_id')} AS b
              FROM m_targets),
    walk AS (SELECT user_id, j, (a % p + j * (b % (p - 1) + 1)) % p AS position
             FROM users, prime, (SELECT unnest(range(0, p)) AS j FROM prime))
    SELECT w.user_id, i.item_id, row_number() OVER (PARTITION BY w.user_id ORDER BY w.j) AS rank
    FROM walk w JOIN placed i USING (position)
    WHERE NOT EXISTS (SELECT 1 FROM m_excluded e WHERE e.user_id = w.user_id AND e.item_id = i.item_id)
    QUALIFY rank <= {K}
    """,
    ("m_available", "m_excluded"),
)
def random_lists(spark, d):
    return Setting(spark, d).lists(RandomRecommender(SEED))


@query(
    "e14_model_set",
    """
    SELECT model, count(*) AS rows FROM (VALUES ('most_popular'), ('recent_popular_3d'), ('random')) m(model),
           (SELECT DISTINCT user_id, item_id FROM m_eval WHERE item_id IN (SELECT item_id FROM m_catalog))
    GROUP BY model
    """,
    ("m_eval", "m_catalog"),
)
def model_set(spark, d):
    """The enabled models, co-occurrence switched off, each scoring the eval pairs."""
    s = Setting(spark, d)
    out = None
    for model in build_baselines(BaselineParams(item_cooc=None), SEED):
        scored = model.fit(s.fit, s.catalog, AS_OF).score_pairs(s.pairs())
        part = scored.agg(F.count("score").alias("rows")).withColumn("model", F.lit(model.name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "g1_top_k",
    f"""
    SELECT user_id, item_id, rank FROM (
        SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id
               ORDER BY score DESC, {tie_sql(SEED, 'item_id')}, item_id) AS rank
        FROM (SELECT DISTINCT user_id, item_id, score FROM m_eval JOIN m_popular USING (item_id))) WHERE rank <= 3
    """,
    ("m_eval", "m_popular"),
)
def best_of_pairs(spark, d):
    """Top k per user of scored pairs, ties in the shared order."""
    from reelspark.operators.recommend import item_tie

    s = Setting(spark, d)
    scored = MostPopular("is_click").fit(s.fit, s.catalog, AS_OF).score_pairs(s.pairs())
    return top_k(scored, 3, F.col("score"), item_tie(SEED)).select("user_id", "item_id", "rank")
