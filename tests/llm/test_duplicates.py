"""Exact duplicates, SimHash, components and the vector forest against brute force."""

import hashlib
import re
from collections import defaultdict
from random import Random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cases import frame, rows
from reelspark.llm import common, exact_dedup, rp_forest, simhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def joined(n, linked):
    """Smallest member of each one's class."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def expected_groups(made):
    groups = defaultdict(list)
    for i, t in made:
        groups[lower(t)].append(i)
    out = []
    for i, t in made:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def colliding(text):
    return F.substring(F.md5(text.cast("binary")), 1, 1).cast("binary")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, colliding])
def test_exact_duplicates(spark, digest):
    docs = common.Stored(frame(spark), "docs").df
    got = exact_dedup.exact_duplicates(docs, digest).collect()
    assert sorted(map(tuple, got), key=repr) == expected_groups(rows())
    kept = exact_dedup.drop_duplicates(docs, digest)
    assert kept.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    wanted = [(i, t) for (i, t), row in zip(rows(), [None] * len(rows())) for g in [lower(t)]
              if i == max((x for x, y in rows() if lower(y) == g and x is not None), default=None)]
    assert left == sorted(wanted, key=repr)


def test_exact_duplicates_of_an_empty_table(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    assert exact_dedup.drop_duplicates(frame(spark, [])).count() == 0


def test_exact_duplicates_run_no_python(spark):
    plan = exact_dedup.exact_duplicates(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan and "Pandas" not in plan


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints(monkeypatch):
    short = [(i, t) for i, t in rows() if len(t or "") < 3000]
    assert [simhash.fingerprint(t) for _, t in short] == [slow_fingerprint(t) for _, t in short]
    monkeypatch.setattr(simhash, "STEP", 7)
    assert [simhash.fingerprint(t) for _, t in short[:40]] == [slow_fingerprint(t) for _, t in short[:40]]


def test_fingerprint_is_sparks_hash(spark):
    text = "four words of text"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (2**64 - 1) == simhash.fingerprint(text)


def clustered(seed, n_centres=25, size=30):
    random = Random(seed)
    points = set()
    for _ in range(n_centres):
        centre = random.getrandbits(64)
        for _ in range(size):
            flips = 0
            for bit in random.sample(range(64), random.randrange(7)):
                flips |= 1 << bit
            points.add(centre ^ flips)
    return sorted(points)


@pytest.mark.parametrize("seed", [1, 2])
def test_no_link_between_fingerprints_is_lost(spark, seed):
    points = clustered(seed)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    linked = [(a, b) for a in range(len(points)) for b in range(a) if (points[a] ^ points[b]).bit_count() <= simhash.MAX_BITS]
    expected = joined(len(points), linked)
    got = dict(map(tuple, simhash.near_components(spark.createDataFrame([(s,) for s in signed], "bits bigint")).collect()))
    number = {s: i for i, s in enumerate(signed)}
    classes = defaultdict(set)
    for s, c in got.items():
        classes[c].add(number[s])
    wanted = defaultdict(set)
    for i, c in enumerate(expected):
        wanted[c].add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, wanted.values()))


def test_every_pair_of_near_fingerprints_shares_a_key(spark):
    random = Random(5)
    pairs = []
    for distance in range(5):
        for _ in range(30):
            a = random.getrandbits(64)
            b = a
            for bit in random.sample(range(64), distance):
                b ^= 1 << bit
            pairs.append((a, b))
    for a, b in pairs:
        segments = [(((a >> f) ^ (b >> f)) & ((1 << n) - 1)).bit_count() for f, n in simhash.SEGMENTS]
        assert min(segments) <= 1


def test_keys_are_not_broadcast(spark):
    """A row is exploded to 67 keys, which Spark does not count: however few bytes the fingerprints seem to be, both sides are shuffled."""
    assert int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))) > 1 << 20
    few = spark.createDataFrame([(i, i) for i in (0, 1, 7, 1 << 60)], "bits long, label long")
    found = simhash.links_between(few)
    assert {tuple(sorted(r)) for r in found.select("a", "b").collect()} == {(0, 1), (0, 7), (0, 1 << 60), (1, 7), (1, 1 << 60), (7, 1 << 60)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_near_duplicates(spark):
    docs = common.Stored(frame(spark), "docs").df
    made = rows()
    prints = [slow_fingerprint(t) if len(t or "") < 3000 else simhash.fingerprint(t) for _, t in made]
    linked = [(a, b) for a in range(len(made)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    classes = joined(len(made), linked)
    least = {c: min((i for (i, _), d in zip(made, classes) if d == c and i is not None), default=None) for c in classes}
    expected = sorted(((i, f"{f:016x}", least[c]) for (i, _), f, c in zip(made, prints, classes)), key=repr)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == expected
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _, c in expected if i == c), key=repr)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    random = Random(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(160)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 90)] + edges[:5] + [(7, 7)]
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    number = {x: i for i, x in enumerate(nodes)}
    expected = {nodes[i]: nodes[c] for i, c in enumerate(joined(len(nodes), [(number[a], number[b]) for a, b in edges if a != b]))}
    got, _ = common.components(spark.createDataFrame(edges, "u bigint, v bigint"))
    assert sorted(map(tuple, got.collect())) == sorted(expected.items())
    assert common.components(spark.createDataFrame([], "u bigint, v bigint"))[0].count() == 0


def vectors(n=700, dim=24, seed=6):
    random = np.random.default_rng(seed)
    made = []
    centres = random.normal(size=(n // 7, dim))
    for i in range(n):
        kind = i % 7
        v = centres[i // 7 % len(centres)] + random.normal(size=dim) * (0.0 if kind == 0 else 0.09 * random.random() * kind)
        made.append((i, v.astype(np.float32).tolist(), i // 7 % 2))
    dense = random.normal(size=dim)
    made += [(n + i, (dense + random.normal(size=dim) * 0.05).astype(np.float32).tolist(), 0) for i in range(200)]
    at = n + 200
    bad = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    made += [(at + i, v, 0) for i, v in enumerate(bad * 2)]
    at += len(bad) * 2
    made += [(at, made[1][1], None), (at + 1, made[1][1][:-1], 0), (at + 2, made[1][1][:-1], 0), (at + 3, made[1][1], made[1][2])]
    made += [(at + 4, [x * 2 for x in made[2][1]], made[2][2]), (at + 5, [1e-30] * dim, 0), (at + 6, [2e-30] * dim, 0), (at + 7, [1e30] * dim, 0)]
    return made


@pytest.mark.parametrize("leaf", [16, 4096])
def test_forest_finds_all_links(spark, leaf, monkeypatch):
    monkeypatch.setattr(rp_forest, "BLOCK", 64)
    made = vectors()
    frame_ = spark.createDataFrame([(*r, "x", 1) for r in made], "vec_id bigint, embedding array<float>, label int, point string, copies int")
    usable = [i for i, (_, v, label) in enumerate(made) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = []
    for k, i in enumerate(usable):
        for j in usable[:k]:
            a, b = np.array(made[i][1], float), np.array(made[j][1], float)
            if made[i][2] == made[j][2] and len(a) == len(b):
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    linked.append((i, j))
    n_links = np.bincount(np.array(linked).ravel(), minlength=len(made))
    classes = joined(len(made), linked)
    expected = [(made[i][0], int(n_links[i]), made[c][0], i == c) for i, c in enumerate(classes)]
    got = sorted(map(tuple, rp_forest.near_duplicates(frame_, leaf=leaf).collect()))
    assert len(linked) > 5000
    assert got == expected
    assert rp_forest.near_duplicates(frame_.limit(0)).count() == 0


def test_vectors_without_a_number(spark):
    made = [(None, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (None, [0.0, 1.0], 0), (3, [1.0, 0.0], 0)]
    got = rp_forest.near_duplicates(spark.createDataFrame(made, "vec_id bigint, embedding array<float>, label int")).collect()
    assert sorted(map(tuple, got), key=repr) == [(3, 2, 3, True), (3, 2, 3, True), (None, 0, None, True), (None, 2, None, True)]


def test_lower_leaves_that_pairs_share():
    random = np.random.default_rng(5)
    leaves = [random.choice(40, int(random.integers(0, 9)), replace=False).astype(np.int64) - 20 for _ in range(60)]
    a, b = np.nonzero(np.triu(np.ones((60, 60), bool), 1))
    for leaf in (-30, 0, 7, 100):
        expected = [any(x < leaf for x in set(leaves[i].tolist()) & set(leaves[j].tolist())) for i, j in zip(a.tolist(), b.tolist())]
        assert rp_forest.shares_lower(leaves, leaf, a, b).tolist() == expected


def test_a_dense_label_is_compared_in_one_tree(spark, monkeypatch):
    """All vectors of one label are near each other: no tree can split them, and one compares them."""
    random = np.random.default_rng(6)
    near = random.normal(size=16) + random.normal(size=(900, 16)) * 0.02
    spread = random.normal(size=(700, 16))
    made = [(i, v.tolist(), "a:b/c") for i, v in enumerate(near)] + [(5000 + i, v.tolist(), "x") for i, v in enumerate(spread)]
    vectors = spark.createDataFrame(made, "vec_id bigint, embedding array<float>, label string")
    trees, original = [], rp_forest.forest

    def counted(points, *rest):
        leaves = original(points, *rest)
        per_point = leaves.groupBy("point").count()
        trees.append({r["many"]: r["count"] for r in per_point.groupBy((F.col("count") > 1).alias("many")).count().collect()})
        return leaves

    monkeypatch.setattr(rp_forest, "forest", counted)
    got = {r.vec_id: (r.n_links, r.component_id) for r in rp_forest.near_duplicates(vectors).collect()}
    assert trees[0] == {False: 900, True: 700}
    for group, first in ((near, 0), (spread, 5000)):
        unit = rp_forest.unit(group.astype(np.float32))
        linked = unit @ unit.T >= 0.98
        np.fill_diagonal(linked, False)
        assert [got[first + i][0] for i in range(len(group))] == linked.sum(axis=1).tolist()
