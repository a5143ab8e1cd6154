"""Most similar items by bounds: pairs that cannot enter either item's list are not made.

Users are dealt to rounds of equal work, short histories first: they are most of the
users and make few pairs, so when the long ones come little is left. After a round
every item knows a threshold, the n-th best similarity of its pairs on the users
counted so far: a lower bound of its n-th best in the end. In the next round a
pair is made only while the users both items have left could lift it, on their
own, to the lower of their two thresholds. Users left only shrink and thresholds
only grow, so a pair is made in the rounds before some round and in none from it
on, and its count covers exactly those. Pairs whose making has ended are dropped
when count and users left cannot reach a threshold; the others get the rest of
their count by looking up the shorter remaining user list in the longer one.

The lists are those of `top_neighbors(item_similarities(co_users(history)))`, ties
at the last place included: bounds are compared with a margin, final values as there.
What it saves depends on the log: popular items beside rare ones and long histories
over many subjects are ruled out early, while items without close neighbours have
low thresholds, and their pairs must all be made.
Rows without a user or an item belong to no history; an empty history gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators.cooccurrence import item_similarities, top_neighbors
from reelspark.session import discard, materialize

MARGIN = 1.0 - 1e-9  # rounding of a product and a root stays far below
PAIR = ("item_a", "item_b")


@dataclass
class Work:
    """Pairs made in each round, and users looked up for pairs that outlived their rounds."""

    made: list[int]
    looked_up: int


def with_rounds(history: DataFrame, rounds: int, seed: int = 0) -> DataFrame:
    """`history` with a column `round`: users in order of history length, as many pairs in each round.

    The work of a length is one row, so the running sum orders at most the longest
    history's length of rows.
    """
    history = history.dropna(subset=["user_id", "item_id"])
    sizes = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("_size"))
    work = F.col("_size") * (F.col("_size") - 1) / 2
    by_size = sizes.groupBy("_size").agg(F.sum(work).alias("_work"))
    before = Window.orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_size").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = by_size.select(
        "_size",
        (F.coalesce(F.sum("_work").over(before), F.lit(0.0)) / F.greatest(F.sum("_work").over(every), F.lit(1.0))).alias("_from"),
        (F.col("_work") / F.greatest(F.sum("_work").over(every), F.lit(1.0))).alias("_share"),
    )
    spread = F.pmod(F.xxhash64(F.lit(seed), F.col("user_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.col("_from") + F.col("_share") * spread
    number = F.least(F.floor(share * rounds), F.lit(rounds - 1))
    dealt = sizes.join(placed, "_size").select("user_id", number.cast("int").alias("round"))
    return history.select("user_id", "item_id").join(dealt, "user_id")


def item_facts(dealt: DataFrame, rounds: int) -> DataFrame:
    """A row per item: users in all, users left at the start of each round and at the end, threshold 0."""
    left = [F.sum(F.when(F.col("round") >= r, F.col("_n")).otherwise(F.lit(0))) for r in range(rounds + 1)]
    by_round = dealt.groupBy("item_id", "round").agg(F.count(F.lit(1)).alias("_n"))
    return by_round.groupBy("item_id").agg(F.sum("_n").alias("n"), F.array(*left).alias("left"), F.lit(0.0).alias("t"))


def _norm(n_a, n_b, shrinkage: float):
    return F.sqrt(n_a.cast("double") * n_b.cast("double")) + F.lit(float(shrinkage))


def _within_reach(most, t_a, t_b, norm):
    """Whether `most` shared users could put the pair into the list of one of its items."""
    return most.cast("double") >= F.least(t_a, t_b) * norm * F.lit(MARGIN)


def _made_in(dealt: DataFrame, facts: DataFrame, number: int, shrinkage: float) -> DataFrame:
    """Pairs of the users of one round that are within reach, counted map-side.

    An item whose own threshold no partner can help it to reach is only paired with
    items that can still gain; two of that kind are never put together.
    """
    left = F.element_at("left", number + 1)
    # sharing t * norm users takes a partner of at least t * t * n users, and of one
    needs = F.col("t") * (F.greatest(F.sqrt(F.col("n").cast("double")), F.col("t") * F.col("n")) + F.lit(float(shrinkage)))
    gains = left.cast("double") >= needs * F.lit(MARGIN * MARGIN)
    entry = F.struct("item_id", "n", left.alias("left"), "t", gains.alias("gains"))
    mine = dealt.filter(F.col("round") == number).select("user_id", "item_id").join(facts, "item_id")
    lists = mine.groupBy("user_id").agg(F.collect_list(entry).alias("_items"))
    heads = lists.select("_items", F.explode("_items").alias("_a")).filter("_a.gains")
    pairs = heads.select("_a", F.explode("_items").alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    once = (a.item_id != b.item_id) & (~b.gains | (a.item_id < b.item_id))
    reach = _within_reach(F.least(a.left, b.left), a.t, b.t, _norm(a.n, b.n, shrinkage))
    ordered = a.item_id < b.item_id
    return (
        pairs.filter(once & reach)
        .groupBy(F.least(a.item_id, b.item_id).alias("item_a"), F.greatest(a.item_id, b.item_id).alias("item_b"))
        .agg(
            F.max(F.when(ordered, a.n).otherwise(b.n)).alias("n_a"),
            F.max(F.when(ordered, b.n).otherwise(a.n)).alias("n_b"),
            F.count(F.lit(1)).alias("made"),
        )
    )


def _thresholds(counted: DataFrame, facts: DataFrame, n: int, shrinkage: float) -> DataFrame:
    """`facts` with the n-th best similarity so far, 0 where an item has fewer pairs."""
    so_far = item_similarities(counted.select(*PAIR, "n_a", "n_b", F.col("made").alias("n_both")), shrinkage)
    nth = top_neighbors(so_far, n).groupBy("src_item").agg(F.count(F.lit(1)).alias("_pairs"), F.min("sim").alias("_nth"))
    known = nth.filter(F.col("_pairs") == n).select(F.col("src_item").alias("item_id"), "_nth")
    found = facts.join(known, "item_id", "left")
    return found.select("item_id", "n", "left", F.greatest("t", F.coalesce("_nth", F.lit(0.0))).alias("t"))


def _alive(counted: DataFrame, facts: DataFrame, number: int, rounds: int, shrinkage: float) -> DataFrame:
    """Pairs that can still enter a list; `closed` is the round from which they are not made.

    At the end nobody is left, and a pair that was never closed is complete.
    """

    def side(name: str) -> DataFrame:
        return facts.select(
            F.col("item_id").alias(f"item_{name}"), F.col("left").alias(f"_left_{name}"), F.col("t").alias(f"_t_{name}")
        )

    both = counted.join(side("a"), "item_a").join(side("b"), "item_b")
    norm = _norm(F.col("n_a"), F.col("n_b"), shrinkage)

    def reach(most):
        return _within_reach(most, F.col("_t_a"), F.col("_t_b"), norm)

    def left_at(name: str, at):
        return F.element_at(f"_left_{name}", at + 1)

    def shared(at):
        return F.least(left_at("a", at), left_at("b", at))

    if number < rounds:
        ends = F.when(~reach(shared(F.lit(number))), F.lit(number))
        both = both.withColumn("closed", F.coalesce("closed", ends))
    since = F.coalesce("closed", F.lit(number))
    return both.filter(reach(F.col("made") + shared(since))).select(
        *PAIR,
        "n_a",
        "n_b",
        "made",
        "closed",
        shared(since).alias("rest"),
        (left_at("a", since) <= left_at("b", since)).alias("a_shorter"),
    )


def _looked_up(pairs: DataFrame, dealt: DataFrame) -> DataFrame:
    """Shared users from round `closed` on: each user of the shorter rest is looked up in the other item."""
    probe = pairs.select(
        *PAIR,
        "closed",
        F.when(F.col("a_shorter"), F.col("item_a")).otherwise(F.col("item_b")).alias("_of"),
        F.when(F.col("a_shorter"), F.col("item_b")).otherwise(F.col("item_a")).alias("_in"),
    )
    users = dealt.select(F.col("item_id").alias("_of"), "user_id", "round")
    has = dealt.select(F.col("item_id").alias("_in"), "user_id")
    asked = probe.join(users, "_of").filter(F.col("round") >= F.col("closed"))
    return asked.join(has, ["user_id", "_in"], "left_semi").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_more"))


def pruned_neighbors(history: DataFrame, n: int, shrinkage: float, rounds: int = 6) -> tuple[DataFrame, Work]:
    """The n most similar items of each item of `history`, `(src_item, dst_item, sim)`, and the work done."""
    if n < 1 or rounds < 1:
        raise ValueError("n and rounds must be positive")
    dealt = materialize(with_rounds(history, rounds), "rounds")
    facts = materialize(item_facts(dealt, rounds), "facts")
    kept, counted, made = None, None, []
    for number in range(rounds):
        fresh = _made_in(dealt, facts, number, shrinkage).withColumns({"closed": F.lit(None).cast("int"), "fresh": F.col("made")})
        rows = fresh if kept is None else kept.drop("rest", "a_shorter").withColumn("fresh", F.lit(0)).unionByName(fresh)
        sums = [F.max(c).alias(c) for c in ("n_a", "n_b", "closed")] + [F.sum(c).alias(c) for c in ("made", "fresh")]
        together = materialize(rows.groupBy(*PAIR).agg(*sums), "pairs")
        made.append(together.agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0])
        raised = materialize(_thresholds(together, facts, n, shrinkage), "facts")
        for old in (counted, facts):
            if old is not None:
                discard(old)
        counted, facts = together, raised
        kept = _alive(counted, facts, number + 1, rounds, shrinkage)
    kept = materialize(kept, "alive")
    discard(counted)
    ended = kept.filter(F.col("closed").isNotNull())
    asked = ended.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]
    whole = kept.join(_looked_up(ended, dealt), list(PAIR), "left")
    pairs = whole.select(*PAIR, "n_a", "n_b", (F.col("made") + F.coalesce("_more", F.lit(0))).alias("n_both"))
    return top_neighbors(item_similarities(pairs, shrinkage), n), Work(made, asked)
