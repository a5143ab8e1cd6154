"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Three aggregations, each keyed by the digest and the full text, so texts that merely
share a digest never meet: (1) within a map task (Spark's partial aggregation), (2) per
salted digest, (3) per digest over the salt winners. A text that a third of all rows hold
sends one row per map task to one of SALTS reducers, and SALTS rows to the last one.

Decisions go back to the documents by digest alone where a digest stands for one text,
which step 3 has proved by comparing texts; digests that stand for several are joined by
the text as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import Stored, keep_only

SALTS = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normal(text: Column) -> Column:
    """A-Z in lower case, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _keyed(docs: DataFrame, digest) -> DataFrame:
    text = normal(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("content")).withColumn("digest", digest(F.col("content")))


def groups(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """(digest, content, keep_id, group_size) of every distinct text."""
    salted = _keyed(docs, digest).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return merged.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def _winners(docs: DataFrame, digest, salts: int) -> tuple[DataFrame, DataFrame | None]:
    """(digest, keep_id, group_size) of digests that stand for one text; and with the text, those that stand for several."""
    per_digest = groups(docs, digest, salts).groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts")
    )
    stored = Stored(per_digest, "digests").df
    several = stored.where("texts > 1").select("digest")
    shared = None
    if not several.isEmpty():
        parts = keep_only(docs.select("doc_id", "text").withColumn("digest", digest(normal(F.col("text")))), "digest", several, "digest")
        shared = groups(parts, digest, salts)
    return stored.where("texts = 1").select("digest", "keep_id", "group_size"), shared


def exact_duplicates(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest
    doc_id of a group stays; null doc_ids stay only in groups without any other, with a null
    keep_id. Rows that repeat a doc_id within a group all count and, being the same document,
    share its `kept`. Needs doc_id and text, ignores other columns; an empty table gives no rows.
    """
    single, shared = _winners(docs, digest, salts)
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    keyed = _keyed(docs, digest).withColumn("text_sha256", F.lower(F.hex(sha256(F.col("content")))))
    result = keyed.join(single, "digest").select(out)
    return result if shared is None else result.union(keyed.join(shared, ["digest", "content"]).select(out))


def drop_duplicates(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """The rows of `docs` that `exact_duplicates` keeps, with all their columns as they are.

    The join has the kept doc_id beside the digest in its key, so copies do not meet in one task.
    """
    single, shared = _winners(docs, digest, salts)
    mark = f"digest_{uuid.uuid4().hex[:8]}"
    marked = docs.withColumn(mark, digest(normal(F.col("text"))))
    names = {"digest": f"{mark}_d", "keep_id": f"{mark}_k", "content": f"{mark}_c"}
    same = (F.col(mark) == F.col(names["digest"])) & F.col("doc_id").cast("long").eqNullSafe(F.col(names["keep_id"]))
    kept = marked.join(single.withColumnsRenamed(names), same, "left_semi")
    if shared is not None:
        equal = same & (normal(F.col("text")) == F.col(names["content"]))
        kept = kept.union(marked.join(shared.select(*names).withColumnsRenamed(names), equal, "left_semi"))
    return kept.drop(mark)
