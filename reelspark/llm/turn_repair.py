"""Conversation structure repair over a suffix-shared automaton of role and fault signatures.

A conversation's signature has one letter a turn: its role's initial (s, u, a, other) in
lower case, in upper case where the text is cut short, x where the turn must go (blank or
said before). What the cheapest repair of a suffix is depends on its letters and the
grammar state before it alone, so distinct signatures are sorted from their ends, which
brings shared suffixes together, and become paths of an automaton in which every suffix is
one node. Per node and grammar state the cost-to-go and the first edits of the best audit
are found once; nodes whose costs differ by a constant share their moves, and an audit is
read off along the path up to where an earlier one has been over it.

Per state each edit starts with a letter of its own (D, I, K, R), so of equally cheap
audits the least is told by its first letter; nothing longer is ever compared.

Turns are shuffled by conversation twice, once for the signatures and once with the
audits for the repaired turns. Both stream over sorted rows: a long conversation is never
held whole, but its turns follow each other in one task, as its hash demands. What becomes
one value is a letter a turn, put together in blocks of BLOCK turns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import Stored

BLOCK = 4096
WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: The state after a turn of this role; other roles are not allowed there.
NEXT = {(START, "s"): AFTER_SYSTEM, (AFTER_USER, "a"): AFTER_ASSISTANT}
NEXT |= {(s, "u"): AFTER_USER for s in (START, AFTER_SYSTEM, AFTER_ASSISTANT)}
#: The one role that a turn may be given, or inserted with, in each state.
GIVEN = {START: "u", AFTER_SYSTEM: "u", AFTER_USER: "a", AFTER_ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Suffixes up to so many turns are kept as texts where paths of the automaton meet; longer ones are walked.
KEPT = 512


def _clean(turns: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults planted by a hash of conv_id and turn; null reads as one space.

    crc32("conv_id:turn") % 20 is 0: the row goes; 1: no text; 2: no `.!?`; 3: twice; 4: role user.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def signatures(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal (longs) and signature of every conversation."""
    along = Window.partitionBy("conv_id").orderBy(*_order())
    said = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    marked = _clean(turns).select(
        "conv_id",
        "turn",
        F.row_number().over(along).alias("place"),
        initial.alias("initial"),
        F.lag(initial).over(along).alias("before"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(along))).cast("long").alias("new_turn"),
        (said == "").alias("blank"),
        (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut"),
        # The length tells where the role ends.
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)).alias("digest"),
    )
    same = Window.partitionBy("conv_id", "digest").orderBy("place")
    told = marked.withColumn("again", F.row_number().over(same) > 1)
    blank, again = F.col("blank"), ~F.col("blank") & F.col("again")
    cut = ~F.col("blank") & ~F.col("again") & F.col("cut")
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(blank | again, "x").when(cut, F.upper(role)).otherwise(role)
    wrong = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")

    def count(flag: Column) -> Column:
        return F.sum(flag.cast("long"))

    names = ["blank", "duplicate", "truncated", "illegal", "turns"]

    def joined(order: str, what: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, what))), lambda x: x[what]), "")

    blocks = told.select("*", letter.alias("letter"), F.floor((F.col("place") - 1) / BLOCK).alias("block")).groupBy("conv_id", "block")
    blocks = blocks.agg(
        count(blank).alias("blank"), count(again).alias("duplicate"), count(cut).alias("truncated"), count(wrong).alias("illegal"),
        F.sum("new_turn").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"), joined("place", "letter").alias("part"),
    )
    whole = blocks.groupBy("conv_id").agg(*[F.sum(n).alias(n) for n in names], F.min("low").alias("low"), F.max("high").alias("high"), joined("block", "part").alias("signature"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return whole.select("conv_id", gaps.alias("gaps"), *names[:-1], "signature")


def _best(costs: dict[int, tuple[float, str, str, int]]) -> tuple[list[float], list[tuple[str, int]]]:
    """Per state the cost-to-go, and the edits up to and with this turn's with the state after it; `costs` are those without insertions."""
    best = dict(costs)
    for _ in range(4):  # an insertion leads to another state, and never twice to the same one
        for state in range(4):
            to = NEXT[state, GIVEN[state]]
            cost, letter, edits, after = best[to]
            if (cost + INSERT, "I") < best[state][:2] or best[state][1] == "I":
                best[state] = cost + INSERT, "I", "I" + edits, after
    return [best[s][0] for s in range(4)], [best[s][2:] for s in range(4)]


class Automaton:
    """Nodes of the suffixes of signatures that are given in the order of their reverses."""

    def __init__(self) -> None:
        end = {s: ((0 if s in (START, AFTER_ASSISTANT) else math.inf), "", "", s) for s in range(4)}
        costs, moves = _best(end)
        #: Classes of nodes by their costs above the least one; per class and letter what a node before it is like.
        self.classes: dict[tuple, int] = {}
        self.costs: list[tuple] = []
        self.steps: dict[tuple[int, str], tuple[float, int, list]] = {}
        base, kind = self._class(costs)
        self.path = [(base, kind, moves)]
        self.known: list[dict[int, str]] = [{}]
        self.reverse = ""
        self.nodes = 1

    def _class(self, costs: list[float]) -> tuple[float, int]:
        base = min(costs)
        key = tuple(c - base for c in costs)
        if key not in self.classes:
            self.classes[key] = len(self.costs)
            self.costs.append(key)
        return base, self.classes[key]

    def _step(self, kind: int, letter: str) -> tuple[float, int, list]:
        """Of a node whose turn is `letter` and whose next one is of class `kind`: added cost, class and moves."""
        after, role = self.costs[kind], letter.lower()
        out = {}
        for state in range(4):
            options = [(after[state] + DELETE, "D", state)]
            if letter != "x":
                extra = CUT_SHORT if letter.isupper() else 0
                if (state, role) in NEXT:
                    options.append((after[NEXT[state, role]] + KEEP + extra, "K", NEXT[state, role]))
                given = NEXT[state, GIVEN[state]]
                options.append((after[given] + REROLE + extra, "R", given))
            cost, edit, to = min(options)
            out[state] = cost, edit, edit, to
        costs, moves = _best(out)
        return (*self._class(costs), moves)

    def repair(self, signature: str) -> tuple[int, str]:
        """Cost and audit of the cheapest repair, the least audit among equals."""
        backwards = signature[::-1]
        shared = 0
        for a, b in zip(backwards, self.reverse):
            if a != b:
                break
            shared += 1
        del self.path[shared + 1 :], self.known[shared + 1 :]
        base, kind, _ = self.path[-1]
        for letter in backwards[shared:]:
            step = self.steps.get((kind, letter))
            if step is None:
                step = self.steps[kind, letter] = self._step(kind, letter)
            base, kind = base + step[0], step[1]
            self.path.append((base, kind, step[2]))
            self.known.append({})
        self.nodes += len(backwards) - shared
        self.reverse = backwards
        state, edits, meeting = START, [], None
        for depth in range(len(backwards), -1, -1):
            if state in self.known[depth]:
                edits.append(self.known[depth][state])
                break
            if depth == shared and depth <= KEPT:
                meeting = len(edits), depth, state
            move, state = self.path[depth][2][state]
            edits.append(move)
        if meeting is not None:
            at, depth, state = meeting
            self.known[depth][state] = "".join(edits[at:])
        return int(base + self.costs[kind][START]), "".join(edits)


def audits(signed: DataFrame) -> DataFrame:
    """(signature, cost, audit) of every distinct signature; one automaton a range of reversed signatures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton()
        for batch in batches:
            rows = [(s, *automaton.repair(s)) for s in batch["signature"]]
            yield pd.DataFrame(rows, columns=["signature", "cost", "audit"])

    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = signed.select("signature").distinct().withColumn("backwards", F.reverse("signature"))
    ordered = distinct.repartitionByRange(parts, "backwards").sortWithinPartitions("backwards").select("signature")
    return ordered.mapInPandas(run, "signature string, cost long, audit string")


def report(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit.

    Turns are taken by number (nulls first), then role and text. Each has one fault at most:
    blank (white space alone), duplicate (role and text seen earlier in the conversation), truncated
    (last character not `.!?`). `gaps` are missing turn numbers, `illegal` adjacent roles other
    than su, ua, au by their initials. The audit has the initials of the cheapest edits (Keep 0,
    Rerole 3, Delete 4, Insert 3, an undeleted truncated turn 3 more) that leave roles of the form
    `(s?(ua)+)?`. Null role or text reads as one space; a null conv_id is a conversation of its own.
    Needs conv_id, turn, role and text, ignores other columns; an empty table gives no rows.
    """
    signed = Stored(signatures(turns), "signatures").df
    return signed.join(audits(signed), "signature").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """Repaired turns: conv_id, place (from 0), edit (K, R or I), role, text; inserted ones have an empty text.

    Within a partition the turns of a conversation follow each other in order. The audit goes
    before its turns as a row of its own, not beside each of them.
    """
    schema = _clean(turns).schema
    kind = schema["conv_id"].dataType.simpleString()
    heads = reports.select("conv_id", F.lit(0).alias("row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = heads.union(_clean(turns).select("conv_id", F.lit(1), "turn", "role", "text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "row", *_order())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, state = "", 0, 0, START
        for batch in batches:
            source, places, edits, roles, kept = [], [], [], [], []
            is_turn, role_of = batch.column("row").to_pylist(), batch.column("role").to_pylist()
            texts = batch.column("text")

            def add(i: int, edit: str, initial: str, role: str) -> None:
                nonlocal place, state
                source.append(i)
                places.append(place)
                edits.append(edit)
                roles.append(role)
                kept.append(None if edit == "I" else i)
                place, state = place + 1, NEXT[state, initial]

            for i, turn in enumerate(is_turn):
                if not turn:
                    audit, at, place, state = texts[i].as_py(), 0, 0, START
                    continue
                while audit[at] == "I":
                    add(i, "I", GIVEN[state], ROLES[GIVEN[state]])
                    at += 1
                if audit[at] == "K":
                    add(i, "K", role_of[i][:1], role_of[i])
                elif audit[at] == "R":
                    add(i, "R", GIVEN[state], ROLES[GIVEN[state]])
                at += 1
                if len(audit) - at <= 3 and set(audit[at:]) == {"I"}:  # what is inserted behind the last turn
                    for _ in audit[at:]:
                        add(i, "I", GIVEN[state], ROLES[GIVEN[state]])
                    at = len(audit)
            columns = [
                batch.column("conv_id").take(pa.array(source, pa.int64())), pa.array(places, pa.int64()), pa.array(edits, pa.string()),
                pa.array(roles, pa.string()), texts.take(pa.array(kept, pa.int64())).fill_null(""),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "edit", "role", "text"])

    return ordered.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(fixed: DataFrame) -> DataFrame:
    """(conv_id, sha256) of `role:text`, newline-joined, of conversations in the order that `repaired` gives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_, owner = None, None
        for batch in batches:
            done, names = [], batch.column("conv_id")
            rows = zip(batch.column("place").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist())
            for i, (place, role, text) in enumerate(rows):
                if place == 0:
                    if hash_ is not None:
                        done.append((owner, hash_.hexdigest()))
                    hash_, owner = hashlib.sha256(), names.slice(i, 1)
                hash_.update(f"{role}:{text}".encode() if place == 0 else f"\n{role}:{text}".encode())
            if done:
                yield _digest_rows(done)
        if hash_ is not None:
            yield _digest_rows([(owner, hash_.hexdigest())])

    return fixed.select("conv_id", "place", "role", "text").mapInArrow(run, f"conv_id {fixed.schema['conv_id'].dataType.simpleString()}, sha256 string")


def _digest_rows(done: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([o for o, _ in done]), pa.array([h for _, h in done], pa.string())], names=["conv_id", "sha256"])
