"""Registered queries of the text operators: each applies its operator to the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import blob_ledger, exact_dedup, licences, packing, phrases, pieces, rp_forest, sharding, simhash, simple8b, token_counts, toxicity, turn_repair
from reelspark.llm.common import Stored, table
from reelspark.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "op1_rp_forest_near_dedup",
    """
    WITH RECURSIVE usable AS (
        SELECT vec_id, label, len(embedding) AS dim, cast(embedding AS double[]) AS v FROM embeddings
        WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.dim = b.dim AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.v, b.v) >= 0.98
    ), reached AS (
        SELECT vec_id AS a, vec_id AS b FROM embeddings
        UNION
        SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
    )
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings
    LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = vec_id
    JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) r ON r.a = vec_id
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_simple8b_output")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simple8b.read(simple8b.write(docs, public_tokenizers.path("word_bpe_49k.json")).df)


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_convolutional_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.default_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op5_sum_of_squares_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op6_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(content) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content
          FROM documents)
    WINDOW same AS (PARTITION BY content)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


SHARDS, SLOTS = {f"shard-{i:02d}": 1 for i in range(16)}, 4099


@query(
    "op7_lookup_sharding",
    # One turn a step: the claimer takes the first free slot of its order; orders are made once.
    f"""
    WITH RECURSIVE shards AS (
        SELECT i, 'shard-' || lpad(cast(i AS varchar), 2, '0') AS shard FROM range({len(SHARDS)}) r(i)
    ), orders AS (
        SELECT list(preference ORDER BY i) AS preferences, list(shard ORDER BY i) AS names
        FROM (SELECT i, shard, [(o + j * s) % {SLOTS} FOR j IN range({SLOTS})] AS preference
              FROM (SELECT i, shard, cast('0x' || substr(md5(shard || ':offset'), 1, 13) AS bigint) % {SLOTS} AS o,
                           cast('0x' || substr(md5(shard || ':step'), 1, 13) AS bigint) % {SLOTS - 1} + 1 AS s FROM shards))
    ), turns AS (
        SELECT cast(0 AS bigint) AS turn, cast(-1 AS bigint) AS slot, [false FOR j IN range({SLOTS})] AS taken
        UNION ALL
        SELECT turn + 1, claim, taken[:claim] || [true] || taken[claim + 2:]
        FROM (SELECT turn, taken, [p FOR p IN preferences[turn % {len(SHARDS)} + 1] IF NOT taken[p + 1]][1] AS claim
              FROM turns, orders WHERE turn < {SLOTS})
    )
    SELECT doc_id, cast(t.slot AS integer) AS slot, names[(turn - 1) % {len(SHARDS)} + 1] AS shard
    FROM (SELECT doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '')), 1, 13) AS bigint) % {SLOTS} AS slot FROM documents) d
    JOIN turns t ON t.slot = d.slot, orders
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


@query("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_licence_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _of_kinds(spans, kinds):
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def _span_list(spans):
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _span_sql(number: int, rule: blob_ledger.Rule) -> str:
    """Spans of one rule: places from the lengths of what lies between its matches."""
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    size = f"length(regexp_extract(m[i], {pattern}, {rule.group}))"
    return f"""(SELECT list({{'s': b, 'k': {number}, 'e': b + length(m[i])}}) FROM (
        SELECT m, i, list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS b
        FROM (SELECT regexp_extract_all(t, {pattern}) AS m, regexp_split_to_array(t, {pattern}) AS g), range(1, len(m) + 1) r(i)
        WHERE {size} >= {rule.least}))"""


_KINDS = [r.kind for r in blob_ledger.RULES]
_SHOW = f"array_to_string(list_transform(list_sort({{}}), lambda x: {_KINDS}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"


@query(
    "op13_blob_ledger",
    f"""
    WITH found AS (
        SELECT doc_id, {", ".join(f"coalesce({_span_sql(i, r)}, []) AS s{i}" for i, r in enumerate(blob_ledger.RULES))}
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    )
    SELECT doc_id, len(s0) AS n_assign, len(s1) AS n_access, len(s2) AS n_hex,
           sha256({_SHOW.format("s0 || s1 || s2")}) AS base_sha256,
           {_SHOW.format(" || ".join(f"s{i}" for i in range(len(_KINDS))))} AS spans
    FROM found
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blob_ledger.scan_documents(table(spark, sf_dir, "documents"), scratch_path(spark, "ledger"))
    spans, base = F.col("spans"), [r.kind for r in blob_ledger.BASE]
    counts = [F.size(_of_kinds(spans, [k])).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(_span_list(_of_kinds(spans, base)).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), _span_list(spans).alias("spans"))


def _repair_sql() -> str:
    """A turn a step from the last one on; per state the cost (nine digits) and the audit from there, in one text."""

    def plus(x: str, cost: int, letter: str) -> str:
        return f"(lpad(cast(cast({x}[:9] AS bigint) + {cost} AS varchar), 9, '0') || '{letter}' || {x}[10:])"

    insert = lambda x: plus(x, 3, "I")
    relaxed = {0: f"least(r0, {insert('r2')}, {insert(insert('r3'))})", 1: f"least(r1, {insert('r2')}, {insert(insert('r3'))})"}
    relaxed |= {2: f"least(r2, {insert('r3')})", 3: f"least(r3, {insert('r2')})"}
    extra = "CASE WHEN letter = upper(letter) THEN 3 ELSE 0 END"
    moves = []
    for state, keep in enumerate(({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})):
        options = [plus(f"c{state}", 4, "D")]
        options += [f"CASE WHEN lower(letter) = '{role}' THEN {plus(f'c{to}', 0, 'K').replace('+ 0', f'+ {extra}')} END" for role, to in keep.items()]
        options.append(f"CASE WHEN letter <> 'x' THEN {plus('c3' if state == 2 else 'c2', 0, 'R').replace('+ 0', f'+ 3 + {extra}')} END")
        moves.append(f"least({', '.join(options)}) AS r{state}")
    after_edits = ", ".join(f"{v} AS c{k}" for k, v in relaxed.items())
    return f"""
    WITH RECURSIVE polynomials AS (
        SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
        FROM range(256) r(i)
    ), hashed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce(list_concat([4294967295], list_transform(string_split(
                   coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' '), ''), lambda ch: cast(ascii(ch) AS bigint))),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
        FROM conversations, polynomials
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM hashed, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
    ), told AS (
        SELECT conv_id, turn, role, text, said, place, n, initial, lag(initial) OVER along AS before,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again
        FROM (SELECT *, row_number() OVER along AS place, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS initial,
                     rtrim(text, e' \\t\\n\\x0b\\x0c\\r') AS said
              FROM damaged WINDOW along AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        WINDOW along AS (PARTITION BY conv_id ORDER BY place)
    ), faults AS (
        SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(own) ELSE own END AS letter
        FROM (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
                     CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS own FROM told)
    ), totals AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
        FROM faults GROUP BY conv_id
    ), steps AS (
        SELECT conv_id, max(n) AS place, '000000000' AS c0, '000000006II' AS c1, '000000003I' AS c2, '000000000' AS c3 FROM faults GROUP BY conv_id
        UNION ALL
        SELECT conv_id, place - 1, {after_edits}
        FROM (SELECT steps.conv_id, steps.place, {", ".join(moves)}
              FROM steps JOIN faults ON faults.conv_id IS NOT DISTINCT FROM steps.conv_id AND faults.place = steps.place)
    ), best AS (
        SELECT conv_id, cast(c0[:9] AS bigint) AS cost, c0[10:] AS audit FROM steps WHERE place = 0
    ), edits AS (
        SELECT conv_id, i, audit[i] AS edit, len(replace(audit[:i], 'I', '')) AS place
        FROM best, range(1, len(audit) + 1) r(i) WHERE audit[i] <> 'D'
    ), placed AS (
        SELECT edits.conv_id, i, edit, role, text, row_number() OVER (PARTITION BY edits.conv_id ORDER BY i) AS nth,
               max(CASE WHEN edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY edits.conv_id) AS led
        FROM edits LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM edits.conv_id AND faults.place = edits.place AND edit <> 'I'
    ), hashes AS (
        SELECT conv_id, sha256(string_agg((CASE WHEN edit = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':'
                               || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS sha
        FROM placed GROUP BY conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN totals ON totals.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN hashes ON hashes.conv_id IS NOT DISTINCT FROM o.conv_id
    """


@query("op12_turn_repair", _repair_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    damaged = turn_repair.damage(given)
    told = Stored(turn_repair.report(damaged), "reports").df
    hashes = turn_repair.digests(turn_repair.repaired(damaged, told)).withColumnRenamed("conv_id", "of")
    asked = given.select(F.col("conv_id").alias("asked")).distinct()
    full = asked.join(told, F.col("asked").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("asked").eqNullSafe(F.col("of")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return full.select(
        F.col("asked").alias("conv_id"), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256"),
    )


@query(
    "op11_phrase_tiles",
    """
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
    ), lists AS (
        SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
    ), grams AS (
        SELECT lang, size, unnest([array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS phrase
        FROM lists, range(1, 4) r(size)
    ), counts AS (
        SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL
    ), totals AS (
        SELECT lang, sum(a)::bigint AS n FROM counts WHERE size = 1 GROUP BY lang
    ), chosen AS (
        SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND a >= 10
    ), parts AS (
        SELECT c.lang, c.phrase, c.size, c.a, k, h.a AS l, t.a AS r, (1000000 * c.a::hugeint * c.a::hugeint // (h.a::hugeint * t.a::hugeint))::bigint AS score
        FROM chosen c, range(1, 3) r(k)
        JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[:k], ' ')
        JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1:], ' ')
        WHERE k < c.size
    ), weakest AS (
        SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), longer AS (
        SELECT lang, phrase, max(a) AS a FROM (
            SELECT lang, a, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM chosen WHERE size = 3) GROUP BY lang, phrase
    ), ranked AS (
        SELECT x.*, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, x.a DESC, encode(x.phrase)) AS rank
        FROM weakest x LEFT JOIN longer y ON y.lang = x.lang AND y.phrase = x.phrase
        WHERE y.a IS NULL OR 100 * y.a < 50 * x.a
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
