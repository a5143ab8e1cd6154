"""Two-tower inputs, model and exact vector search (F)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from reelspark.functions.expressions import DURATION_EDGES_S
from reelspark.operators import tower_inputs as ti
from reelspark.operators import tower_math as tm
from reelspark.operators import two_tower, vector_index, vector_search
from reelspark.operators.two_tower import TwoTowerRetriever
from reelspark.params import TwoTowerParams
from reelspark.registry.common import query, view
from reelspark.registry.model_queries import AS_OF, K, SEED, Setting
from reelspark.session import materialize
from reelspark.sources import fixtures

MAX_TAGS, MIN_COUNT, ID_MIN_COUNT, HISTORY, MAX_EXAMPLES = 4, 2, 5, 8, 900

view("t_positive", "SELECT user_id, item_id, date, time_ms FROM m_fit WHERE is_click = 1", "m_fit")
view(
    "t_tags",
    """
    SELECT item_id, slot, trim(string_split(tag, ',')[slot]) AS value
    FROM m_items, (SELECT unnest(range(1, 5)) AS slot) WHERE slot <= len(string_split(tag, ','))
    """,
    "m_items",
)
view(
    "t_values",
    " UNION ALL ".join(
        f"SELECT item_id, '{f}' AS field, 0 AS slot, cast({f} AS varchar) AS value FROM m_items WHERE {f} IS NOT NULL"
        for f in ti.ITEM_FIELDS
    )
    + " UNION ALL SELECT item_id, 'item', 0, cast(item_id AS varchar) FROM m_catalog"
    + " UNION ALL SELECT item_id, 'tag', slot, value FROM t_tags WHERE regexp_full_match(value, '[0-9]+')",
    "t_tags",
    "m_catalog",
)
view(
    "t_vocab",
    f"""
    SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY n DESC, md5('vocab:' || value), value) AS idx
    FROM (SELECT field, value, count(*) AS n FROM t_positive JOIN t_values USING (item_id) GROUP BY field, value)
    WHERE n >= CASE WHEN field = 'item' THEN {ID_MIN_COUNT} ELSE {MIN_COUNT} END
    """,
    "t_positive",
    "t_values",
)
_SINGLE = sorted([*ti.ITEM_FIELDS, "item", "duration"])
_BUCKET = " + ".join(f"cast(video_duration >= {s * 1000} AS integer)" for s in DURATION_EDGES_S)


def _index_sql(field: str, slot: int = 0) -> str:
    return f"coalesce(max(c.idx) FILTER (c.field = '{field}' AND c.slot = {slot}), 0)"


def _fields_sql() -> str:
    parts = []
    for f in _SINGLE:
        if f == "duration":
            parts.append(f"max(CASE WHEN i.video_duration IS NULL THEN 0 ELSE 1 + {_BUCKET} END)")
        else:
            parts.append(_index_sql(f))
    return "concat_ws(',', " + ", ".join(parts) + ")"


view(
    "t_users_vocab",
    "SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY n DESC, md5('vocab:' || value), value) AS idx "
    "FROM (SELECT field, value, count(*) AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, cast({f} AS varchar) AS value FROM fx_users WHERE {f} IS NOT NULL" for f in ti.USER_FIELDS
    )
    + ") GROUP BY field, value)",
    "fx_users",
)


def _positives(s):
    return s.fit.filter(F.col("is_click") == 1).select("user_id", "item_id", "date", "time_ms")


def _vocab(s):
    counts = ti.positive_counts(_positives(s))
    return ti.content_vocabulary(s.items, counts, MIN_COUNT, MAX_TAGS, ID_MIN_COUNT)


@query("f1_vocabulary", "SELECT field, value, idx FROM t_vocab", ("t_vocab",))
def vocabulary(spark, d):
    return _vocab(Setting(spark, d))


@query(
    "f2_encode",
    "SELECT item_id, coalesce(idx, 0) AS idx FROM m_items LEFT JOIN (SELECT * FROM t_vocab WHERE field = 'music_id') v "
    "ON v.value = cast(music_id AS varchar)",
    ("t_vocab",),
)
def encode(spark, d):
    """One field encoded: index, or 0 when unknown or rare."""
    s = Setting(spark, d)
    vocab = materialize(_vocab(s).filter(F.col("field") == "music_id"), "vocabulary")
    long = ti.long_fields(s.items, ["item_id"], ["music_id"])
    known = ti.encode(long, vocab, ti.vocabulary_sizes(vocab, ["music_id"])).select("item_id", "idx")
    joined = s.items.select("item_id").join(known, "item_id", "left")
    return joined.withColumn("idx", F.coalesce("idx", F.lit(0)))


@query(
    "f3_encode_items",
    f"""
    WITH c AS (SELECT v.item_id, v.field, v.slot, t.idx FROM t_values v JOIN t_vocab t USING (field, value))
    SELECT k.item_id, {_fields_sql()} AS fields,
           concat_ws(',', {", ".join(_index_sql("tag", i) for i in range(1, MAX_TAGS + 1))}) AS tags
    FROM m_catalog k LEFT JOIN m_items i USING (item_id) LEFT JOIN c ON c.item_id = k.item_id GROUP BY k.item_id
    """,
    ("t_vocab",),
)
def encode_items(spark, d):
    s = Setting(spark, d)
    catalog = materialize(s.catalog, "catalog")
    vocab = materialize(_vocab(s), "vocabulary")
    sizes = ti.vocabulary_sizes(vocab, [*ti.ITEM_FIELDS, "item", "tag"]) | {"duration": ti.DURATION_SIZE}
    out = ti.encode_items(s.items, catalog, vocab, sizes, MAX_TAGS)
    return out.select(
        "item_id",
        *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("fields", "tags")],
    )


@query(
    "f4_encode_users",
    "SELECT user_id, concat_ws(',', "
    + ", ".join(
        f"(SELECT idx FROM t_users_vocab v WHERE v.field = '{f}' AND v.value = cast(u.{f} AS varchar))"
        for f in sorted(ti.USER_FIELDS)
    )
    + ") AS profile FROM fx_users u",
    ("t_users_vocab",),
)
def encode_users(spark, d):
    users = fixtures.users(spark, d)
    vocab = materialize(ti.user_vocabulary(users), "vocabulary")
    out = ti.encode_users(users, vocab, ti.vocabulary_sizes(vocab, ti.USER_FIELDS))
    return out.select("user_id", F.array_join(F.col("profile").cast("array<string>"), ",").alias("profile"))


@query(
    "f5_history_snapshots",
    f"""
    WITH q AS (SELECT DISTINCT user_id, date FROM m_eval),
    h AS (SELECT q.user_id, q.date, p.item_id, row_number() OVER (PARTITION BY q.user_id, q.date
                 ORDER BY p.date DESC, p.time_ms DESC, p.item_id DESC) AS r
          FROM q JOIN t_positive p ON p.user_id = q.user_id AND p.date < q.date)
    SELECT q.user_id, q.date,
           repeat('-1,', {HISTORY} - count(h.r)::integer) || coalesce(string_agg(cast(h.item_id AS varchar), ',' ORDER BY r DESC) || ',', '')
               AS history
    FROM q LEFT JOIN h ON h.user_id = q.user_id AND h.date = q.date AND h.r <= {HISTORY} GROUP BY q.user_id, q.date
    """,
    ("t_positive", "m_eval"),
)
def history_snapshots(spark, d):
    s = Setting(spark, d)
    requests = s.eval.select("user_id", "date").distinct()
    out = ti.history_snapshots(_positives(s), requests, HISTORY)
    text = F.concat(F.array_join(F.col("history").cast("array<string>"), ","), F.lit(","))
    return out.select("user_id", "date", text.alias("history"))


@query(
    "f6_recent_examples",
    f"SELECT * FROM t_positive ORDER BY date DESC, time_ms DESC, user_id DESC, item_id DESC LIMIT {MAX_EXAMPLES}",
    ("t_positive",),
)
def recent_examples(spark, d):
    return ti.recent_examples(_positives(Setting(spark, d)), MAX_EXAMPLES)


@query(
    "f7_log_sampling",
    "SELECT item_id, round(ln(greatest(coalesce(n, 1), 1) / (SELECT count(*) FROM t_positive)), 8) AS log_q "
    "FROM m_catalog LEFT JOIN (SELECT item_id, count(*) AS n FROM t_positive GROUP BY item_id) USING (item_id)",
    ("m_catalog", "t_positive"),
)
def log_sampling(spark, d):
    s = Setting(spark, d)
    out = ti.log_sampling(ti.positive_counts(_positives(s)), s.catalog)
    return out.withColumn("log_q", F.round("log_q", 8))


# --- model ------------------------------------------------------------------------

SMALL = TwoTowerParams(
    max_history=HISTORY, field_dim=8, user_field_dim=4, hidden=32, dim=16, batch_size=256, epochs=2, lr=0.01, shard_rows=1_024
)


def _fitted(spark, d):
    s = Setting(spark, d)
    s.fit, s.eval = materialize(s.fit, "fit"), materialize(s.eval, "eval")
    s.catalog = materialize(s.catalog, "catalog")
    model = TwoTowerRetriever(s.items, fixtures.users(spark, d), SMALL, SEED)
    return s, model.fit(s.fit, s.catalog, AS_OF)


@query(
    "f8_f12_training_loss",
    f"""
    SELECT cast(epoch AS integer) AS epoch, count(*) AS examples, true AS lower
    FROM (SELECT unnest(range({SMALL.epochs})) AS epoch), t_positive WHERE item_id IN (SELECT item_id FROM m_catalog) GROUP BY epoch
    """,
    ("t_positive", "m_catalog"),
)
def training_loss(spark, d):
    """Each epoch of the data-parallel fit sees every positive once and lowers the loss."""
    _, model = _fitted(spark, d)
    before = [float("inf"), *model.losses]
    rows = [(i, n, loss < before[i]) for i, (loss, n) in enumerate(zip(model.losses, model.examples_seen))]
    return spark.createDataFrame(rows, "epoch int, examples bigint, lower boolean")


@query("f9_f13_item_vectors", "SELECT item_id, 1.0::double AS norm FROM m_catalog", ("m_catalog",))
def item_vectors(spark, d):
    """Every catalog item gets a unit vector."""
    _, model = _fitted(spark, d)
    return model.item_vectors.select("item_id", _norm().alias("norm"))


def _norm():
    return F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 6)


@query("f10_f16_user_vectors", "SELECT user_id, 1.0::double AS norm FROM (SELECT DISTINCT user_id FROM m_eval)", ("m_eval",))
def user_vectors(spark, d):
    """Every asked user gets a unit vector as of the fit end, history or not."""
    s, model = _fitted(spark, d)
    return model.embed_users(s.eval).select("user_id", _norm().alias("norm"))


@query("f14_two_tower_lists")
def two_tower_lists(spark, d):
    """The fitted model's lists for the evaluated users."""
    s, model = _fitted(spark, d)
    targets, exclusions = s.targets()
    return model.recommend(targets.select("user_id").distinct(), K, exclusions, s.available, SEED)


view(
    "t_vector_scores",
    # A sum from the first coordinate to the last, as exact search defines a score.
    """
    SELECT a.vec_id AS user_id, b.vec_id AS item_id, list_reduce(list_concat([0.0::double],
               list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])), lambda x, y: x + y) AS score
    FROM (SELECT vec_id, cast(embedding AS double[]) AS v FROM embeddings) a
    CROSS JOIN (SELECT vec_id, cast(embedding AS double[]) AS v FROM embeddings) b WHERE a.vec_id <> b.vec_id
    """,
)


@query(
    "f14_vector_top_k",
    f"""
    SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC,
               md5('{SEED}:' || cast(item_id AS varchar)), item_id) AS rank, score
    FROM t_vector_scores QUALIFY rank <= {K}
    """,
    ("t_vector_scores",),
)
def vector_top_k(spark, d):
    """Exact nearest vectors of every embedding, itself excluded."""
    vectors = fixtures.table(spark, d, "embeddings")
    users = vectors.select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("vector"))
    items = vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    own = users.select("user_id", F.col("user_id").alias("item_id"))
    return vector_search.exact_top_k(users, items, K, own, SEED)


@query(
    "f15_pair_scores",
    """
    SELECT a.vec_id AS user_id, b.vec_id AS item_id,
           round(list_dot_product(cast(a.embedding AS double[]), cast(b.embedding AS double[])), 6) AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
    """,
)
def pair_scores(spark, d):
    """Dot products of given pairs; a pair without a vector drops out."""
    vectors = fixtures.table(spark, d, "embeddings")
    users = vectors.select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("vector"))
    items = vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    pairs = users.select("user_id", (F.col("user_id") + 1).alias("item_id"))
    return vector_search.pair_scores(pairs, users, items).withColumn("score", F.round("score", 6))


#: Every so manieth vector asks the approximate index.
QUERY_STRIDE, LIST_ROWS = 20, 128


def _vector_sides(spark, d):
    vectors = fixtures.table(spark, d, "embeddings")
    asking = vectors.filter(F.col("vec_id") % QUERY_STRIDE == 0)
    users = materialize(asking.select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("vector")), "asking")
    items = vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return users, items, users.select("user_id", F.col("user_id").alias("item_id"))


def _approximate(spark, d):
    users, items, own = _vector_sides(spark, d)
    index = vector_index.InvertedIndex.build(items, SEED, LIST_ROWS)
    probes, depth, _ = index.calibrated(users, K, own, SEED)
    return index.search(users, K, own, SEED, probes, depth)


@query("f14_approximate_top_k")
def approximate_top_k(spark, d):
    """Nearly nearest vectors of a twentieth of the embeddings, among all of them."""
    return _approximate(spark, d)


@query(
    "f14_approximate_recall",
    f"""
    SELECT count(*) AS asked_pairs, true AS nine_tenths_found, cast(0 AS bigint) AS wrong_scores FROM (
        SELECT user_id FROM t_vector_scores WHERE user_id % {QUERY_STRIDE} = 0
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC) <= {K})
    """,
    ("t_vector_scores",),
)
def approximate_recall(spark, d):
    """Recall of the approximate lists against exact search; where both have an item, their scores agree."""
    users, items, own = _vector_sides(spark, d)
    found = materialize(_approximate(spark, d), "approximate").select("user_id", "item_id", F.col("score").alias("near"))
    both = vector_search.exact_top_k(users, items, K, own, SEED).join(found, ["user_id", "item_id"], "left")
    counts = both.agg(F.count(F.lit(1)).alias("asked_pairs"), F.count("near").alias("n"), F.count_if(F.col("near") != F.col("score")).alias("wrong_scores"))
    return counts.select("asked_pairs", (F.col("n") >= 0.9 * F.col("asked_pairs")).alias("nine_tenths_found"), "wrong_scores")


# --- towers by value ----------------------------------------------------------------
# The whole way from tables to vectors, with embeddings and weights that both engines know by a formula.

PLANTED = TwoTowerParams(
    max_history=HISTORY, max_tags=MAX_TAGS, min_count=MIN_COUNT, id_min_count=ID_MIN_COUNT, field_dim=2, user_field_dim=2, hidden=4, dim=3
)
#: Phase of the weights of each layer.
PHASES = {"item_w1": 0.1, "item_w2": 0.2, "user_w1": 0.3, "user_w2": 0.4}


def _planted_weights(shapes):
    """cos(0.7 i + 1.3 j + phase) over the square root of the inputs, i and j from 1; biases sin(j) / 10."""
    out = {}
    for name, shape in shapes.items():
        j = np.arange(1, shape[-1] + 1)
        if name in PHASES:
            i = np.arange(1, shape[0] + 1)[:, None]
            out[name] = np.cos(0.7 * i + 1.3 * j + PHASES[name]) / np.sqrt(shape[0])
        else:
            out[name] = np.sin(j) / 10
    return out


def _planted_table(spark, tab: int, rows: int, dim: int):
    """Row r has sin(r d) at place d; moments, which no vector depends on, are zero."""
    values = [F.sin(F.col("id") * F.lit(d)) for d in range(1, dim + 1)] + [F.lit(0.0)] * (2 * dim)
    return spark.range(1, rows).select(F.lit(tab).alias("tab"), "id", F.array(*values).alias("vec"))


def _planted(spark, d):
    s = Setting(spark, d)
    s.fit, s.eval = materialize(s.fit, "fit"), materialize(s.eval, "eval")
    s.catalog = materialize(s.catalog, "catalog")
    model = TwoTowerRetriever(s.items, fixtures.users(spark, d), PLANTED, SEED)
    model.prepare(s.fit, s.catalog, AS_OF)
    model.weights = _planted_weights(tm.tower_shapes(len(model.single) + 1, len(model.user_sizes), PLANTED))
    content = _planted_table(spark, two_tower.CONTENT_ROW, tm.table_rows(model.item_sizes), PLANTED.field_dim)
    profile = _planted_table(spark, two_tower.PROFILE_ROW, tm.table_rows(model.user_sizes), PLANTED.user_field_dim)
    model.tables = materialize(content.unionByName(profile), "tables")
    return s, model


def _shown(vectors, key):
    return vectors.select(key, *[F.round(F.col("vector")[i], 6).alias(f"v{i + 1}") for i in range(PLANTED.dim)])


def _tower_sql(source: str, key: str, side: str) -> str:
    """Unit vectors from `source`, whose x is a tower's input."""

    def layer(x: str, name: str, n_out: int, inner: str) -> str:
        weight = f"cos(0.7::double * i + 1.3::double * j + {PHASES[name]}::double) / sqrt(len({x})::double)"
        return f"[{inner.format(f'list_sum([{x}[i] * {weight} FOR i IN range(1, len({x}) + 1)]) + sin(j::double) / 10')} FOR j IN range(1, {n_out + 1})]"

    return f"""
    SELECT {key}, {", ".join(f"round(y[{i}] / norm, 6) AS v{i}" for i in range(1, PLANTED.dim + 1))}
    FROM (SELECT {key}, y, greatest(sqrt(list_sum([v * v FOR v IN y])), 1e-12) AS norm
          FROM (SELECT {key}, {layer("h", f"{side}_w2", PLANTED.dim, "{}")} AS y
                FROM (SELECT {key}, {layer("x", f"{side}_w1", PLANTED.hidden, "greatest({}, 0.0)")} AS h FROM {source})))
    """


_DIMS = range(1, PLANTED.field_dim + 1)
view(
    "p_starts",
    f"""
    SELECT field, 1 + coalesce(sum(n) OVER (ORDER BY field ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start
    FROM (SELECT field, count(*) AS n FROM t_vocab GROUP BY field UNION ALL SELECT 'duration', {ti.DURATION_SIZE - 1})
    """,
    "t_vocab",
)


def _row_sql(field: str) -> str:
    if field == "duration":
        return f"max(CASE WHEN i.video_duration IS NULL THEN 0 ELSE (SELECT start FROM p_starts WHERE field = 'duration') + {_BUCKET} END)"
    return f"coalesce(max(c.row) FILTER (c.field = '{field}'), 0)"


view(
    "p_item_rows",
    f"""
    SELECT k.item_id, {", ".join(f"{_row_sql(f)} AS r_{f}" for f in _SINGLE)},
           coalesce(list(c.row ORDER BY c.slot) FILTER (c.field = 'tag'), []) AS tags
    FROM m_catalog k LEFT JOIN m_items i USING (item_id)
    LEFT JOIN (SELECT v.item_id, v.field, v.slot, s.start + t.idx - 1 AS row
               FROM t_values v JOIN t_vocab t USING (field, value) JOIN p_starts s USING (field)) c ON c.item_id = k.item_id
    GROUP BY k.item_id
    """,
    "m_catalog",
    "m_items",
    "t_values",
    "p_starts",
)
view(
    "p_item_inputs",
    "SELECT item_id, ["
    + ", ".join(f"CASE WHEN r_{f} = 0 THEN 0.0 ELSE sin((r_{f} * {d})::double) END" for f in _SINGLE for d in _DIMS)
    + ", "
    + ", ".join(f"coalesce(list_avg([sin((t * {d})::double) FOR t IN tags]), 0.0)" for d in _DIMS)
    + "] AS x FROM p_item_rows",
    "p_item_rows",
)
view(
    "p_profiles",
    f"""
    SELECT u.user_id, {", ".join(f"coalesce(max(v.row) FILTER (v.field = '{f}'), 0) AS q_{f}" for f in sorted(ti.USER_FIELDS))}
    FROM (SELECT user_id, {", ".join(f"cast({f} AS varchar) AS {f}" for f in ti.USER_FIELDS)} FROM fx_users) u
    LEFT JOIN (SELECT field, value, idx + coalesce((SELECT count(*) FROM t_users_vocab b WHERE b.field < a.field), 0) AS row
               FROM t_users_vocab a) v
      ON ({" OR ".join(f"(v.field = '{f}' AND v.value = u.{f})" for f in ti.USER_FIELDS)})
    GROUP BY u.user_id
    """,
    "fx_users",
    "t_users_vocab",
)
view(
    "p_user_inputs",
    f"""
    SELECT h.user_id, list_concat([{", ".join(f"h.m_{f}_{d}" for f in _SINGLE for d in _DIMS)}, {", ".join(f"h.t_{d}" for d in _DIMS)}], [
               {", ".join(f"CASE WHEN coalesce(p.q_{f}, 0) = 0 THEN 0.0 ELSE sin((p.q_{f} * {d})::double) END" for f in sorted(ti.USER_FIELDS) for d in _DIMS)}]) AS x
    FROM (SELECT u.user_id,
                 {", ".join(f"coalesce(avg(sin((r_{f} * {d})::double)) FILTER (r_{f} > 0), 0.0) AS m_{f}_{d}" for f in _SINGLE for d in _DIMS)},
                 {", ".join(f"coalesce(sum(list_sum([sin((t * {d})::double) FOR t IN tags])) / nullif(sum(len(tags)), 0), 0.0) AS t_{d}" for d in _DIMS)}
          FROM (SELECT DISTINCT user_id FROM m_eval) u
          LEFT JOIN (SELECT user_id, item_id FROM t_positive
                     QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC, time_ms DESC, item_id DESC) <= {HISTORY}) l
            ON l.user_id = u.user_id
          LEFT JOIN p_item_rows r ON r.item_id = l.item_id GROUP BY u.user_id) h
    LEFT JOIN p_profiles p ON p.user_id = h.user_id
    """,
    "p_item_rows",
    "p_profiles",
    "t_positive",
    "m_eval",
)


@query("f9_f13_item_vector_values", _tower_sql("p_item_inputs", "item_id", "item"), ("p_item_inputs",))
def item_vector_values(spark, d):
    """Item vectors by value: vocabulary, encoding, table rows, tag means and the item tower."""
    s, model = _planted(spark, d)
    return _shown(model.embed_items(s.catalog), "item_id")


@query("f10_f16_user_vector_values", _tower_sql("p_user_inputs", "user_id", "user"), ("p_user_inputs",))
def user_vector_values(spark, d):
    """User vectors by value: histories, their means, profiles and the user tower."""
    s, model = _planted(spark, d)
    return _shown(model.embed_users(s.eval), "user_id")


view("p_item_vectors", _tower_sql("p_item_inputs", "item_id", "item"), "p_item_inputs")
view("p_user_vectors", _tower_sql("p_user_inputs", "user_id", "user"), "p_user_inputs")


@query(
    "f14_planted_tower_lists",
    f"""
    SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id
               ORDER BY u.v1 * i.v1 + u.v2 * i.v2 + u.v3 * i.v3 DESC, md5('{SEED}:' || cast(item_id AS varchar)), item_id) AS rank
    FROM m_open JOIN p_user_vectors u USING (user_id) JOIN p_item_vectors i USING (item_id) QUALIFY rank <= {K}
    """,
    ("m_open", "p_user_vectors", "p_item_vectors"),
)
def planted_tower_lists(spark, d):
    """Lists of the towers with known weights, on vectors cut to six decimals, so that both engines rank the same numbers."""
    s, model = _planted(spark, d)
    targets, exclusions = s.targets()
    cut = F.transform("vector", lambda x: F.round(x, 6)).alias("vector")
    asked = targets.select("user_id").distinct()
    users = materialize(model.embed_users(s.eval).join(asked, "user_id", "left_semi").select("user_id", cut), "user-vectors")
    items = materialize(model.embed_items(s.catalog).join(s.available, "item_id", "left_semi").select("item_id", cut), "item-vectors")
    return vector_search.exact_top_k(users, items, K, exclusions, SEED).drop("score")
