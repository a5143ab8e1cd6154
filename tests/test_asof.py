from random import Random

import pytest
from pyspark.sql import functions as F

from reelspark.operators import asof
from reelspark.operators.asof import asof_join

LEFT, RIGHT = "k bigint, t bigint, x string", "k bigint, t bigint, x string, y int"


def plain(left, right, inclusive):
    out = []
    for k, t, x in left:
        before = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (r[1] < t or (inclusive and r[1] == t))]
        best = max(before, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or 0), default=None)
        out.append((k, t, x, *(best[1:] if best else (None,) * 3)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("inclusive", [False, True])
def test_rows_with_half_of_all_on_one_key(spark, inclusive):
    rng = Random(7)
    key = lambda: 5 if rng.random() < 0.5 else rng.randrange(12)
    left = [(key(), rng.randrange(900), rng.choice("ab")) for _ in range(700)] + [(None, 3, "n"), (5, None, "n"), (99, 3, "n")]
    right = [(key(), rng.randrange(900), rng.choice(["u", "v", None]), rng.choice([1, 2, None])) for _ in range(500)]
    right += [(None, 1, "u", 1), (5, None, "u", 1)] + [(5, 450, "same", i) for i in range(60)]
    left += left[:20]
    out = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", inclusive=inclusive)
    assert out.columns == ["k", "t", "x", "asof_t", "asof_x", "asof_y"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain(left, right, inclusive)


def test_a_hot_key_is_cut_in_time(spark, monkeypatch):
    seen, original = {}, asof.materialize

    def spied(df, name, *rest):
        seen[name] = original(df, name, *rest)
        return seen[name]

    monkeypatch.setattr(asof, "materialize", spied)
    left, right = (spark.range(4000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias(n), F.lit("x").alias("x")) for n in ("t", "s"))
    out = asof_join(left, right, ["k"], "t", "s")
    assert out.filter("asof_s <> t - 1 or (asof_s is null) <> (t = 0)").count() == 0
    sizes = [r["count"] for r in seen["asof-ranges"].groupBy("_range").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 0.6 * sum(sizes)


def test_no_rows_and_several_keys(spark):
    left = spark.createDataFrame([(1, 2, 5), (1, 3, 5)], "a int, b int, t int")
    right = spark.createDataFrame([(1, 2, 4, 9), (1, 2, 5, 8), (1, 3, 9, 7)], "a int, b int, t int, v int")
    got = sorted(map(tuple, asof_join(left, right, ["a", "b"], "t", tie=["v"]).collect()))
    assert got == [(1, 2, 5, 4, 9), (1, 3, 5, None, None)]
    assert asof_join(left.limit(0), right, ["a", "b"], "t").count() == 0
    assert asof_join(left, right.limit(0), ["a", "b"], "t").filter("asof_v is null").count() == 2
