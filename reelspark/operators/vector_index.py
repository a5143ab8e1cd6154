"""Approximate top-k by dot product: inverted lists over quantised residuals, re-ranked on full vectors.

The leaves of a ball tree are the lists, so a list has a bounded number of vectors and their number grows with the
items. Every vector is stored as its list's center plus a residual, and of the residual only the nearest codewords of
its slices (one byte each; product quantisation). A search goes down the tree with the best `probes` nodes of each
level, scores the codes of these lists, keeps the `depth` best a user, and ranks those again by their full vectors.

Codewords are fitted on a sample of at most SAMPLE residuals, chosen by a hash; every vector is coded. `calibrated` finds the
probes and the depth at which the recall against exact search, of at most SAMPLE_USERS users, reaches its target.

A search deals users and lists out in groups: a group of users meets a group of lists in one task, whatever the number of
lists a user looks at. Where vectors have no structure nearly all lists must be looked at. Looking for the best of them then costs
more than they do: above one in SCAN lists a search takes all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators import ball_tree
from reelspark.operators.ball_tree import BallTree, dot, doubles
from reelspark.operators.recommend import item_tie, top_k, with_barred_count
from reelspark.operators.vector_search import MAX_TASKS, dealt, exact_top_k, group_of, pair_scores
from reelspark.session import broadcast_if_small, materialize

LIST_ROWS, SLICES, CODEWORDS = 1_024, 16, 256
SAMPLE, SAMPLE_USERS, ROUNDS = 20_000, 64, 12
#: Users of a group, and users scored at a time.
GROUP, SLICE = 4_096, 256
#: Of so many lists one may be looked for; if more are wanted, all are taken.
SCAN = 32

cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["GROUP"]))


def codebooks(residuals: np.ndarray, slices: int, seed: int) -> list[np.ndarray]:
    """Codewords of each slice by Lloyd's rounds; as many as there are residuals if these are few."""
    random = np.random.default_rng(seed)
    books = []
    for part in np.array_split(residuals, slices, axis=1):
        book = part[random.permutation(len(part))[:CODEWORDS]].copy()
        for _ in range(ROUNDS):
            near = nearest(part, book)
            for j in range(book.shape[1]):
                total, n = np.bincount(near, part[:, j], len(book)), np.bincount(near, minlength=len(book))
                book[:, j] = np.where(n > 0, total / np.maximum(n, 1), book[:, j])
        books.append(book)
    return books


def nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(axis=1)[None, :] - 2 * part @ book.T).argmin(axis=1) if part.shape[1] else np.zeros(len(part), np.int64)


def _bounds(dim: int, slices: int) -> list[tuple[int, int]]:
    edges = np.cumsum([0] + [len(x) for x in np.array_split(np.arange(dim), slices)]).tolist()
    return list(zip(edges[:-1], edges[1:]))


@dataclass
class InvertedIndex:
    tree: BallTree
    lists: DataFrame
    """(node, part, center, item_ids, codes, group), one row a list part; `group` is that of near lists."""
    vectors: DataFrame
    books: list[np.ndarray]

    @classmethod
    def build(cls, items: DataFrame, seed: int, list_rows: int = LIST_ROWS, slices: int = SLICES) -> InvertedIndex:
        tree = ball_tree.build(items, "item_id", list_rows)
        rows = tree.placed
        if tree.levels:
            leaves = tree.levels[-1].select("node", "center")
            rows = rows.join(broadcast_if_small(leaves, ball_tree.BROADCAST_NODES), "node")
        else:
            rows = rows.withColumn("center", F.transform("vector", lambda x: F.lit(0.0)))
        rows = rows.withColumn("residual", F.zip_with("vector", "center", lambda a, b: a - b))
        # no more than SAMPLE rows, whatever the number of items
        sample = rows.select("item_id", "residual").orderBy(F.xxhash64("item_id", F.lit(seed)), "item_id").limit(SAMPLE).collect()
        if not sample:
            return cls(tree, rows.selectExpr("node", "part", "center", "array(item_id) as item_ids", "cast('' as binary) as codes", "0 as group"), items, [])
        books = codebooks(np.array([r["residual"] for r in sample]), slices, seed)
        bounds = _bounds(sum(b.shape[1] for b in books), len(books))

        def encode(batches):
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["residual"].to_numpy())
                    codes = np.stack([nearest(x[:, a:b], book) for (a, b), book in zip(bounds, books)], axis=1).astype(np.uint8)
                    yield pd.DataFrame({"item_id": pdf["item_id"], "node": pdf["node"], "part": pdf["part"], "code": [c.tobytes() for c in codes]})

        coded = rows.select("item_id", "node", "part", "residual").mapInPandas(encode, "item_id bigint, node bigint, part int, code binary")
        packed = coded.groupBy("node", "part").agg(F.collect_list(F.struct("item_id", "code")).alias("_m"))
        joined = F.unhex(F.array_join(F.transform("_m", lambda x: F.hex(x["code"])), ""))
        packed = packed.select("node", "part", F.col("_m.item_id").alias("item_ids"), joined.alias("codes"))
        centers = rows.groupBy("node").agg(F.first("center").alias("center"))
        lists = materialize(packed.join(centers, "node"), "list-parts")
        groups = group_of(lists, ["node", "part"], lists.agg(F.sum(F.size("item_ids"))).first()[0], "group")
        lists = materialize(lists.join(broadcast_if_small(groups), ["node", "part"]), "inverted-lists")
        return cls(tree, lists, items.select("item_id", doubles("vector").alias("vector")), books)

    def probed(self, users: DataFrame, probes: int) -> DataFrame:
        """(user_id, vector, node) of the lists to look at: the best `probes` nodes of each level under those of the one above."""
        out = users.withColumn("node", F.lit(0).cast("bigint"))
        for nodes in self.tree.levels:
            kids = nodes.select(F.col("parent").alias("node"), F.col("node").alias("_kid"), F.col("center").alias("_c"))
            scored = out.join(broadcast_if_small(kids, ball_tree.BROADCAST_NODES), "node").withColumn("_s", dot(F.col("vector"), F.col("_c")))
            best = Window.partitionBy("user_id").orderBy(F.col("_s").desc(), "_kid")
            ranked = scored.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= probes)
            out = ranked.withColumn("node", F.col("_kid")).drop("_kid", "_c", "_s", "_n")
        return out

    def search(self, users: DataFrame, k: int, exclusions: DataFrame, seed, probes: int, depth: int) -> DataFrame:
        """Nearly best k items per user: `(user_id, item_id, rank, score)`, scores as exact search has them.

        A user with e exclusions keeps depth + e candidates of the codes, so exclusions cost no place.
        """
        barred = exclusions.join(self.vectors.select("item_id"), "item_id", "left_semi").select("user_id", "item_id")
        wanting = with_barred_count(users.select("user_id", doubles("vector").alias("vector")), barred)
        wanting = wanting.withColumn("want", (F.col("_barred") + depth).cast("bigint")).drop("_barred")
        coded = self._coded(materialize(wanting, "asking-users"), probes)
        most = wanting.agg(F.max("want")).first()[0] or 1
        kept = top_k(coded.join(wanting.select("user_id", "want"), "user_id"), most, F.col("near"), [F.col("item_id")])
        kept = kept.filter(F.col("rank") <= F.col("want")).select("user_id", "item_id").join(barred, ["user_id", "item_id"], "left_anti")
        return top_k(pair_scores(kept, users, self.vectors), k, F.col("score"), item_tie(seed)).select("user_id", "item_id", "rank", "score")

    def _coded(self, users: DataFrame, probes: int) -> DataFrame:
        """Each user's best `want` items of each group of lists by center and codewords: `(user_id, item_id, near)`."""
        if not self.books:
            return users.sparkSession.createDataFrame([], "user_id bigint, item_id bigint, near double")
        groups = max(1, -(-users.count() // GROUP))
        ugroup = F.pmod(F.xxhash64("user_id"), F.lit(groups)).cast("int").alias("ugroup")
        others = self.lists.select("group").distinct()
        if probes * SCAN >= self.lists.select("node").distinct().count():
            # one row a group of lists
            asked = users.select("user_id", "want", "vector", ugroup).crossJoin(F.broadcast(others)).withColumn("nodes", F.lit(None).cast("array<bigint>"))
        else:
            of_list = broadcast_if_small(self.lists.select("node", "group").distinct())
            found = self.probed(users, probes).select("user_id", "want", "vector", "node").join(of_list, "node")
            asked = found.groupBy("user_id", "group").agg(F.first("want").alias("want"), F.first("vector").alias("vector"), F.collect_list("node").alias("nodes"))
            asked = asked.select("user_id", "want", "vector", ugroup, "group", "nodes")
        told = self.lists.crossJoin(F.broadcast(users.sparkSession.range(groups).select(F.col("id").cast("int").alias("ugroup"))))
        pair, tasks = ["ugroup", "group"], min(MAX_TASKS, 2 * groups * others.count())
        books = self.books
        return dealt(asked, pair, tasks).cogroup(dealt(told, pair, tasks)).applyInPandas(lambda people, lists: _score_codes(people, lists, books), "user_id bigint, item_id bigint, near double")

    def calibrated(self, users: DataFrame, k: int, exclusions: DataFrame, seed, target: float = 0.95) -> tuple[int, int, float]:
        """Probes and depth, doubled in turn until the sample's recall reaches the target, and that recall."""
        sample = users.orderBy(F.xxhash64("user_id", F.lit(seed)), "user_id").limit(SAMPLE_USERS)
        sample = materialize(sample, "sample-users")
        own = materialize(exclusions.join(sample.select("user_id"), "user_id", "left_semi"), "sample-exclusions")
        truth = materialize(exact_top_k(sample, self.vectors, k, own, seed), "sample-truth")
        lists = self.lists.select("node").distinct().count()
        probes, depth, before = (8 if 8 * SCAN < lists else lists), 4 * k, -1.0
        while True:
            found = recall(self.search(sample, k, own, seed, probes, depth), truth)
            wider, deeper = (2 * probes if 2 * probes * SCAN < lists else lists), 2 * depth
            if found >= target or (probes == lists and found == before):
                return probes, depth, found
            # more lists while these help, then more candidates of theirs
            if wider > probes:
                probes = wider
            else:
                depth, before = deeper, found


def _score_codes(people: pd.DataFrame, lists: pd.DataFrame, books: list[np.ndarray]) -> pd.DataFrame:
    """The best `want` items of these lists by center and codewords, for users who look at all of them or those of `nodes`."""
    out = [pd.DataFrame({"user_id": [], "item_id": [], "near": []})]
    if not len(people) or not len(lists):
        return out[0]
    sizes = [len(x) for x in lists["item_ids"]]
    items = np.concatenate([np.asarray(x) for x in lists["item_ids"]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    codes = np.frombuffer(b"".join(lists["codes"]), np.uint8).reshape(len(items), -1)
    near = np.stack(lists["center"].to_numpy())[owner] + np.concatenate([book[codes[:, i]] for i, book in enumerate(books)], axis=1)
    users, wants = people["user_id"].to_numpy(), np.minimum(people["want"].to_numpy(np.int64), len(items))
    order = np.argsort(wants, kind="stable")
    for at in range(0, len(order), SLICE):
        slice_ = order[at : at + SLICE]
        scores = np.stack(people["vector"].to_numpy()[slice_]) @ near.T
        chosen = people["nodes"].to_numpy()[slice_]
        if chosen[0] is not None:
            listed = np.stack([np.isin(lists["node"].to_numpy(), x) for x in chosen])
            scores[~listed[:, owner]] = -np.inf
        for want in np.unique(wants[slice_]).tolist():
            rows = np.flatnonzero(wants[slice_] == want)
            best = np.argpartition(-scores[rows], want - 1, axis=1)[:, :want]
            found = pd.DataFrame({"user_id": np.repeat(users[slice_[rows]], want), "item_id": items[best].ravel(), "near": np.take_along_axis(scores[rows], best, axis=1).ravel()})
            out.append(found[found["near"] > -np.inf])
    return pd.concat(out)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true (user, item) pairs found."""
    pairs = truth.select("user_id", "item_id")
    hits = pairs.join(found.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").count()
    return hits / max(pairs.count(), 1)
