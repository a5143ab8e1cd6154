"""Near-duplicate embeddings by a forest of random-projection trees.

A node with more than LEAF vectors is split by a random direction at a sparse place near
the median; vectors within the spill width of the threshold go to both sides, so a near
pair is rarely parted in one tree, and hardly ever in all TREES of them. Trees grow in
passes over all vectors: each pass fits up to LEVELS levels of every large node on a
bounded sample of it (about SAMPLE rows, chosen by a hash) and splits all its rows, until
no node is large. A node that cannot be split without parting too many near vectors stays
whole and is compared block by block. Where one tree has all vectors of a label in one leaf, that tree
compares all pairs, and the other trees leave that label out.

Within a leaf all pairs are compared by one matrix product, and what leaves the task is no
pair but a number of links per vector and one edge per vector to the smallest one of its
connected group. A pair that shares several leaves is counted only in the one with the
smallest number. Identical vectors are one point with a number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import Stored, components

TREES, LEAF, LEVELS, SAMPLE, BLOCK = 5, 256, 5, 1024, 1024
MIN_COSINE = 0.98
#: Both sides get what lies within so many standard deviations of a near pair's projected distance.
SPILL = 0.6
#: A node where no threshold keeps the spilled share below this is not split.
MAX_SPILL = 0.35
SEED = 11


@lru_cache(maxsize=512)
def directions(tree: int, depth: int, dim: int) -> np.ndarray:
    drawn = np.random.default_rng([SEED, tree, depth, dim]).normal(size=((1 << LEVELS) - 1, dim))
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


def _of_key(key: str) -> tuple[int, int]:
    return int(key.split("/")[0].split(":")[2]), key.count("/")


def unit(vectors) -> np.ndarray:
    rows = np.stack([np.asarray(v, float) for v in vectors])
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # against overflow and underflow of squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def spill_width(dim: int, cosine: float) -> float:
    return SPILL * np.sqrt((2 - 2 * cosine) / dim)


def thresholds(x: np.ndarray, n: int, ways: np.ndarray, width: float, leaf: int) -> np.ndarray:
    """Of the splits of a node that holds n vectors, from a sample x: NaN where a node is small enough, -inf where it stays whole."""
    out = np.full(len(ways), np.nan, np.float32)
    rows = {0: np.arange(len(x))}
    for i in range(len(ways)):
        mine = rows.pop(i, None)
        if mine is None or n * len(mine) / len(x) <= leaf:
            continue
        p = x[mine] @ ways[i]
        options = np.quantile(p, np.linspace(0.3, 0.7, 17))
        spilled = (np.abs(p[:, None] - options) <= width).mean(axis=0)
        best = int(np.lexsort((np.abs(np.arange(17) - 8), spilled))[0])
        if spilled[best] > MAX_SPILL:
            out[i] = -np.inf
            continue
        out[i] = options[best]
        rows[2 * i + 1], rows[2 * i + 2] = mine[p <= out[i] + width], mine[p >= out[i] - width]
    return out


def leaves_of(p: np.ndarray, splits: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, node, whether the node stays whole) of all leaves of rows with projections `p` and the splits of their nodes."""
    row, node = np.arange(len(p)), np.zeros(len(p), np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(row):
        inside = node < splits.shape[1]
        at = splits[row, np.minimum(node, splits.shape[1] - 1)]
        on = inside & np.isfinite(at)
        out.append((row[~on], node[~on], (inside & np.isneginf(at))[~on]))
        row, node, at = row[on], node[on], at[on]
        value = p[row, node]
        left, right = value <= at + width, value >= at - width
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (row, node, row > 0)


def forest(points: DataFrame, cosine: float, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(leaf, point): the leaves of every point; `points` has point, label, dim, embedding."""
    key = F.concat_ws(":", F.hex("label"), "dim", F.col("tree").cast("string"))
    counts = points.groupBy("label", "dim").agg(F.count("*").alias("all"))
    planted = points.join(counts, ["label", "dim"])
    last = F.when(F.col("all") <= leaf, 0).otherwise(trees - 1)  # one leaf holds a small label
    state = planted.select("point", "embedding", F.explode(F.sequence(F.lit(0), last)).alias("tree"), "label", "dim")
    now = Stored(state.select(key.alias("key"), "point", "embedding", F.lit(False).alias("whole")), "forest")
    done: list[DataFrame] = []

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        name, x = rows["key"].iloc[0], unit(rows["embedding"])
        tree, depth = _of_key(name)
        dim = x.shape[1]
        made = thresholds(x, int(rows["n"].iloc[0]), directions(tree, depth, dim), spill_width(dim, cosine), leaf)
        return pd.DataFrame({"key": [name], "splits": [made]})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            missing = batch["splits"].isna()
            if missing.any():  # no row of the node was sampled
                yield batch[missing].assign(key="!" + batch["key"], whole=True)[["key", "point", "embedding", "whole"]]
                batch = batch[~missing]
            kinds = [(*_of_key(k), len(v)) for k, v in zip(batch["key"], batch["embedding"])]
            # Rows of all nodes with the same directions together: a batch holds many nodes.
            for kind, rows in batch.groupby(pd.Series(kinds, batch.index, dtype=object), sort=False):
                p = unit(rows["embedding"]) @ directions(*kind).T
                at, node, whole = leaves_of(p, np.stack(rows["splits"].to_list()), spill_width(kind[2], cosine))
                keys = rows["key"].to_numpy()[at]
                yield pd.DataFrame(
                    {
                        "key": [f"{k}/{i}" for k, i in zip(keys, node.tolist())],
                        "point": rows["point"].to_numpy()[at],
                        "embedding": rows["embedding"].to_numpy()[at],
                        "whole": whole,
                    }
                )

    while True:
        sizes = now.df.groupBy("key").agg(F.count("*").alias("n"), F.max("whole").alias("stays"))
        sizes = Stored(sizes, "nodes").df
        large = sizes.where((F.col("n") > leaf) & ~F.col("stays"))
        ready = sizes.where((F.col("n") <= leaf) | F.col("stays")).select("key")
        done.append(Stored(now.df.select("key", "point").join(ready, "key", "left_semi"), "leaves").df)
        if large.isEmpty():
            now.drop()
            break
        share = F.pmod(F.xxhash64("key", "point"), F.lit(1 << 30)) / F.lit(1 << 30)
        sample = now.df.join(large, "key").where(share < F.lit(float(SAMPLE)) / F.col("n")).select("key", "embedding", "n")
        fitted = sample.groupBy("key").applyInPandas(fit, "key string, splits array<float>")
        models = Stored(large.select("key").join(fitted, "key", "left"), "splits").df
        if len(done) == 1:
            models = _without_spare_trees(models)
        # A hot node is many rows of one key here: adaptive execution splits such a join.
        rows = now.df.select("key", "point", "embedding").join(models, "key")
        after = Stored(rows.mapInPandas(split, "key string, point long, embedding array<float>, whole boolean"), "forest")
        now.drop()
        now = after
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.union(more)
    return leaves.select(F.xxhash64("key").alias("leaf"), "point")


def _without_spare_trees(models: DataFrame) -> DataFrame:
    """Splits of roots; of a label that a tree keeps whole only those of the first such tree."""
    of_label = models.withColumn("label", F.substring_index("key", ":", 2)).withColumn("tree", F.substring_index("key", ":", -1).cast("int"))
    whole = of_label.where(F.element_at("splits", 1) == float("-inf")).groupBy("label").agg(F.min("tree").alias("alone"))
    kept = of_label.join(whole, "label", "left").where(F.col("alone").isNull() | (F.col("tree") == F.col("alone")))
    return kept.select("key", "splits")


def shares_lower(leaves: list, leaf: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b of each pair share a leaf with a number below `leaf`; `leaves` are those of each row."""
    lower = [np.asarray(v)[np.asarray(v) < leaf] for v in leaves]
    width = max(map(len, lower), default=0)
    out = np.zeros(len(a), bool)
    if not width:
        return out
    # Numbers as codes from 1; 0 and -1 fill up and never match each other.
    numbers, codes = np.unique(np.concatenate(lower), return_inverse=True)
    place = np.repeat(np.arange(len(lower)), list(map(len, lower)))
    column = np.concatenate([np.arange(len(v)) for v in lower])
    left, right = np.zeros((len(lower), width), np.int32), np.full((len(lower), width), -1, np.int32)
    left[place, column] = right[place, column] = codes + 1
    step = max(1, (1 << 22) // (width * width))
    for i in range(0, len(a), step):
        x, y = left[a[i : i + step]], right[b[i : i + step]]
        out[i : i + step] = (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    return out


def grouped(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation, the first row of its connected group."""
    label = np.arange(len(near))
    while True:
        seen = np.where(near, label[None], len(near)).min(axis=1, initial=len(near))
        lower = np.minimum(label, seen)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _compare(cosine: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point", kind="stable")
        x, points, copies = unit(rows["embedding"]), rows["point"].to_numpy(), rows["copies"].to_numpy()
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        block = rows["block"].to_numpy()
        if rows["one"].iloc[0] != rows["two"].iloc[0]:  # pairs within a block have a task of their own
            near &= block[:, None] != block[None]
        counted = near.copy()
        a, b = np.nonzero(np.triu(near))
        elsewhere = shares_lower(rows["leaves"].to_list(), rows["leaf"].iloc[0], a, b)
        counted[a[elsewhere], b[elsewhere]] = counted[b[elsewhere], a[elsewhere]] = False
        links = counted @ copies
        first = grouped(near)
        used = np.flatnonzero(near.any(axis=1))
        return pd.DataFrame({"point": points[used], "links": links[used], "smallest": points[first[used]]})

    return compare


def near_duplicates(vectors: DataFrame, cosine: float = MIN_COSINE, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared only within a label and number of components; those that are null,
    empty or zero or hold null or non-finite components, and those without a label, link
    with nothing. n_links counts the other rows linked directly; component_id is the smallest
    vec_id reachable, itself included. Repeated rows are copies of each other. Rows without a
    vec_id count as links where others carry the same vector, and else link with nothing.
    Needs vec_id, embedding, label, ignores other columns; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(fine, F.lit(False)))
    same = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("point"), F.count("*").alias("copies"))
    points = Stored(same.where("point is not null").withColumn("dim", F.size("embedding").cast("string")), "points").df

    leaves = Stored(forest(points, cosine, trees, leaf), "leaves").df
    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = leaves.join(sizes, "leaf").withColumn("parts", parts)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("leaf", "point", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    of_point = leaves.groupBy("point").agg(F.collect_list("leaf").alias("leaves"))  # as many as spilling makes, some a tree
    whole = points.select("point", "embedding", "copies").join(of_point, "point")
    tasks = placed.join(whole, "point").groupBy("leaf", "one", "two")
    found = Stored(tasks.applyInPandas(_compare(cosine), "point long, links long, smallest long"), "found").df
    groups, _ = components(found.select(F.col("point").alias("u"), F.col("smallest").alias("v")))
    links = found.groupBy("point").agg(F.sum("links").alias("links"))
    known = points.select("label", "embedding", "point", "copies").join(links, "point", "left").join(groups, F.col("point") == F.col("node"), "left")
    known = known.select("label", "embedding", "point", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")

    usable = rows.select("vec_id", F.when(F.col("usable"), F.col("label")).alias("label"), "embedding")
    joined = usable.join(known, ["label", "embedding"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "point", "vec_id"))
    out = joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
