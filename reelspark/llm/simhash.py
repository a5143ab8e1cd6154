"""SimHash near-duplicates over deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Of two fingerprints at four or fewer
differing bits at least one segment differs in one bit at most (three segments with two
or more each would make six). So the index holds every segment as it is, and once for
each of its bits with that bit left out: 3 + 64 keys. Pairs are found by equality joins on
these keys: equal segments meet in the first kind; segments that differ in exactly bit i
meet in the variant without bit i, where a side with the bit unset is joined with a side
that has it set, so that each pair meets there once. The join verifies the whole distance.

Fingerprints are made distinct first, whatever number of documents has one. Members of a
large group of near copies are linked before the join: within equal segments to the
smallest, the largest and the preceding fingerprint, where these are near enough. The
join then only looks for links between what these edges left apart, so a group gives
about as many rows as it has members, and no link between groups is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from reelspark.llm.common import Stored, components

WORDS, SEED, MAX_BITS = 4, 42, 4
#: (first bit, bits) of the segments.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
#: Shingles hashed at a time.
STEP = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Majority of the bits of all shingle hashes; 0 for a text without words (null: empty)."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z only, white space is 09-0D and 20
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    ends = ends[min(words, len(tokens)) - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, STEP):
        pairs = zip(starts[at : min(n, at + STEP)].tolist(), ends[at : at + STEP].tolist())
        hashes = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in pairs]), np.uint8)
        ones += np.unpackbits(hashes).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


@F.pandas_udf(LongType())
def _bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits): `bits` is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _bits("text").alias("bits"))


def _segment(bits: Column, first: int, n: int) -> Column:
    return F.shiftrightunsigned(bits, first).bitwiseAND(F.lit((1 << n) - 1))


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def near_components(points: DataFrame) -> DataFrame:
    """(bits, component) of distinct fingerprints; component is a fingerprint of the class."""
    bits = F.col("bits")
    equal = points.select("bits", F.explode(F.array(*[_segment(bits, f, n) + F.lit(s << 32) for s, (f, n) in enumerate(SEGMENTS)])).alias("key"))
    bucket = Window.partitionBy("key")
    others = equal.select("bits", F.min("bits").over(bucket).alias("low"), F.max("bits").over(bucket).alias("high"),
                          F.lag("bits").over(bucket.orderBy("bits")).alias("last"))
    stars = others.select("bits", F.explode(F.array("low", "high", "last")).alias("other")).where(_near(bits, F.col("other")))
    first, _ = components(stars.select(bits.alias("u"), F.col("other").alias("v")))
    labelled = points.join(first, bits == F.col("node"), "left").select("bits", F.coalesce("component", "bits").alias("label"))
    labelled = Stored(labelled, "labelled").df
    second, _ = components(links_between(labelled).select("u", "v"))
    return labelled.join(second, F.col("label") == F.col("node"), "left").select("bits", F.coalesce("component", "label").alias("component"))


def links_between(labelled: DataFrame) -> DataFrame:
    """(u, v) and the fingerprints: near pairs of `labelled` (bits, label) whose labels differ."""
    bits = F.col("bits")
    # Two numbers a row become 67 keys: dealt out evenly first, or the few files of the table were the only tasks.
    tasks = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, sides = [], []
    for s, (start, n) in enumerate(SEGMENTS):
        segment = _segment(bits, start, n)
        keys.append(segment + F.lit(s << 32))
        sides.append(F.lit(None).cast("boolean"))
        for i in range(n):
            keys.append(segment.bitwiseAND(F.lit(((1 << n) - 1) ^ (1 << i))) + F.lit((3 + start + i) << 32))
            sides.append(_segment(bits, start + i, 1) == 1)
    index = labelled.repartition(tasks).select("bits", "label", F.explode(F.arrays_zip(F.array(*keys).alias("key"), F.array(*sides).alias("side"))).alias("k"))
    index = index.select("bits", "label", F.col("k.key").alias("key"), F.col("k.side").alias("side"))
    a = index.where("side is null or not side").select("key", bits.alias("a"), F.col("label").alias("u"), F.col("side").isNull().alias("whole"))
    b = index.where("side is null or side").select("key", bits.alias("b"), F.col("label").alias("v"))
    # Spark sizes what it explodes like the rows before, 67 times too low, and would broadcast it: both sides are shuffled.
    met = a.join(b.hint("merge"), "key")
    return met.where((F.col("u") != F.col("v")) & _near(F.col("a"), F.col("b")) & (~F.col("whole") | (F.col("a") < F.col("b"))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have the fingerprint zero and link like any other. A null doc_id is
    never the smallest; a class of null doc_ids alone has a null component_id. Repeated rows
    share their fingerprint and so their class. Needs doc_id and text, ignores other columns;
    an empty table gives no rows.
    """
    made, smallest = _classes(docs)
    hex_digits = F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint")
    return made.join(smallest, "bits").select("doc_id", hex_digits, "component_id")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    made = Stored(fingerprints(docs), "fingerprints").df
    points = made.groupBy("bits").agg(F.min("doc_id").alias("doc_id"))
    classes = Stored(points.join(near_components(points.select("bits")), "bits"), "classes").df
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return made, classes.join(least, "component").select("bits", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its class, all columns as they are.

    Rows with the same doc_id stay or go together. Rows without one stay only where their
    whole class has none.
    """
    made, smallest = _classes(docs)
    name = f"kept_{uuid.uuid4().hex[:8]}"
    # The kept doc_id is part of the key, so copies do not meet in one task.
    least = smallest.withColumnRenamed("bits", "of")
    same = (F.col("bits") == F.col("of")) & (F.col("doc_id") == F.col("component_id"))
    kept = made.join(least, same, "left_semi").select(F.col("doc_id").alias(name))
    numbered = docs.join(kept, docs["doc_id"].cast("long") == F.col(name), "left_semi")
    nameless = smallest.where("component_id is null").select(F.col("bits").alias(name))
    marked = docs.where("doc_id is null").withColumn(f"{name}_bits", _bits("text"))
    return numbered.union(marked.join(nameless, F.col(f"{name}_bits") == F.col(name), "left_semi").drop(f"{name}_bits"))
