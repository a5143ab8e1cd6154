"""Conversation repair against a search over all edits, and odd conversations against a plain version."""

import hashlib
import heapq
import zlib
from collections import defaultdict
from random import Random

from pyspark.sql import functions as F

from reelspark.llm import turn_repair
from reelspark.llm.turn_repair import GIVEN, NEXT

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place int, audit string, signature string, block int, kind string"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(signature):
    """Least (cost, audit) by Dijkstra's search over turns and grammar states."""
    queue, done = [(0, "", 0, 0)], set()
    while queue:
        cost, audit, place, state = heapq.heappop(queue)
        if place == len(signature) and state in (0, 3):
            return cost, audit
        if (place, state) in done:
            continue
        done.add((place, state))
        given = NEXT[state, GIVEN[state]]
        heapq.heappush(queue, (cost + 3, audit + "I", place, given))
        if place < len(signature):
            letter = signature[place]
            heapq.heappush(queue, (cost + 4, audit + "D", place + 1, state))
            if letter != "x":
                extra = 3 if letter.isupper() else 0
                heapq.heappush(queue, (cost + extra + 3, audit + "R", place + 1, given))
                if (state, letter.lower()) in NEXT:
                    heapq.heappush(queue, (cost + extra, audit + "K", place + 1, NEXT[state, letter.lower()]))


def test_audits_of_all_kinds_of_signatures():
    random = Random(4)
    letters = lambda: "xsuaoSUAO" if random.random() < 0.5 else "uaua"
    signatures = {"".join(random.choice(letters()) for _ in range(random.randrange(12))) for _ in range(4000)}
    automaton = turn_repair.Automaton()
    for signature in sorted(signatures, key=lambda s: s[::-1]):
        assert automaton.repair(signature) == cheapest(signature), signature
    assert automaton.nodes < sum(map(len, signatures)) and len(automaton.costs) < 40


def test_long_signatures():
    long = "".join(Random(5).choice("uauaxUAs") for _ in range(20_000))
    automaton = turn_repair.Automaton()
    kept = {s: automaton.repair(s) for s in sorted([long, long[1:], "u" + long[7:], long[9000:]], key=lambda s: s[::-1])}
    assert all(kept[s] == turn_repair.Automaton().repair(s) for s in kept) and automaton.nodes < 20_010


def plain(rows):
    """The whole report and hash of each conversation by loops."""
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn is not None, turn or 0, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for conv, turns in of.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        seen, signature, numbers = set(), "", {t[1] for t in turns if t[0]}
        count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in turns:
            said = text.rstrip(WHITE)
            own = role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            signature += "x" if fault in ("blank", "duplicate") else own.upper() if fault else own
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = cheapest(signature) if len(signature) < 50 else turn_repair.Automaton().repair(signature)
        lines, state, at = [], 0, 0
        for edit in audit:
            given = {"u": "user", "a": "assistant"}[GIVEN[state]]
            role, text = (given, "") if edit == "I" else (turns[at][2] if edit == "K" else given, turns[at][3])
            at += edit != "I"
            if edit != "D":
                lines.append(f"{role}:{text}")
                state = NEXT[state, role[:1]]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha if lines else None
    return out


def odd_rows():
    random = Random(6)
    texts = ["Good.", "Good. \n", "cut", "", None, " \t\x0b", "Why?\x0c", "é!", "ß", "a\nb.", "Good.  "]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "ukulele", "écoute"]
    rows = []
    for conv in [None, *range(200)]:
        for turn in range(random.randrange(7)):
            role = ("user", "assistant")[turn % 2] if random.random() < 0.6 else random.choice(roles)
            rows.append((conv, None if random.random() < 0.1 else turn + random.choice((0, 0, 0, 1, -5)), role, random.choice(texts)))
    rows += rows[:40] + [(901, i, "user" if i % 2 else "assistant", f"turn {i % 4001}" + "." * (i % 3)) for i in range(9001)]
    rows += [(902, 1, "user", "x" * 300_000 + "."), (902, 2, "assistant", "yes.")] + [(903, None, "system", "Only this.")]
    return rows


def made(spark, rows):
    return spark.createDataFrame([(*r, 9, "KK", "ua", 3, "k") for r in rows], SCHEMA).repartition(5)


def test_reports_and_repaired_turns_of_odd_conversations(spark):
    rows = odd_rows()
    turns = made(spark, rows)
    reports = turn_repair.report(turns)
    fixed = turn_repair.repaired(turns, reports)
    hashes = {r.conv_id: r.sha256 for r in turn_repair.digests(fixed).collect()}
    got = {r.conv_id: (*tuple(r)[1:], hashes.get(r.conv_id)) for r in reports.collect()}
    assert got == plain(rows)
    roles = fixed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", F.substring("role", 1, 1).alias("role")))).alias("x"))
    grammar = roles.select(F.array_join(F.col("x.role"), "").rlike("^s?(ua)+$").alias("ok"), (F.size("x") == F.col("x.place")[F.size("x") - 1] + 1).alias("whole"))
    assert all(r.ok and r.whole for r in grammar.collect())


def test_planted_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (None, 5, 6) for t in [None, *range(60)]] + [(7, 1, None, None)]
    space = lambda x: " " if x is None else str(x)
    expected = []
    for conv, turn, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        expected += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in turn_repair.damage(made(spark, rows)).collect())


def test_empty_tables(spark):
    turns = made(spark, [])
    reports = turn_repair.report(turns)
    assert reports.count() == 0 and turn_repair.digests(turn_repair.repaired(turns, reports)).count() == 0
