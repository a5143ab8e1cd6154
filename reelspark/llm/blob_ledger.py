"""Secret scan over an incremental ledger of blobs, in DataFrame operations only.

A blob is the content of one or more document versions under its SHA-256. The ledger, a
Parquet table, says which versions of which rules have seen which blob and what they
found. An update scans a blob only with the rules it has not met in their present version:
new texts meet all rules, a changed rule meets all texts again, copies and unchanged texts
are never scanned twice. Findings then go back to every document, whatever version or
copy of a blob it holds.

Copies shrink to one text a map task before the shuffle (the sort aggregation by digest),
so a text that a third of all rows hold is no hot key. Where few blobs are unseen, their
digests are broadcast and nothing else is shuffled. A rule's matches are told apart by the
gaps between them: splitting by a pattern gives the gaps, extracting gives the matches,
and running sums of their lengths the places, in code points.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import Stored

#: Unseen blobs whose digests (40 bytes each) may be broadcast.
FEW_BLOBS = 100_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    """Java regular expression of bounded or single-class repeats, so that scans take linear time."""
    group: int = 0
    least: int = 0
    """Shortest length of `group`; shorter matches are dropped, and what they cover is not looked at again."""
    hint: str = ""
    """Text that every match holds, looked for first."""

    @property
    def version(self) -> str:
        """Changes with anything that changes the findings."""
        return f"{self.kind}@{hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:12]}"


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # 20 characters in all; a run that is too short after its first AKIA is so after a later one.
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What the base rules leave: keys in PEM form, web tokens, passwords in addresses.
FURTHER = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}", hint=".eyJ"),
    Rule("address", r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,128}:[^\x00-\x20/@]{1,128}@", hint="://"),
)
RULES = BASE + FURTHER

LEDGER = "blob binary, rules array<string>, spans array<struct<rule string, start int, end int>>"


def content(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def addresses(docs: DataFrame) -> DataFrame:
    """(doc_id, blob) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob(content(F.col("text"))).alias("blob"))


def read(spark, ledger: str) -> DataFrame:
    """The ledger; empty where nothing has been written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def unseen(blobs: DataFrame, known: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, todo): blobs with a rule version they have not met, and for every rule whether it is one."""
    seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    met = F.coalesce("seen", F.array().cast("array<string>"))
    todo = F.array(*[~F.array_contains(met, r.version) for r in rules])
    return blobs.join(seen, "blob", "left").select("blob", todo.alias("todo")).where(F.array_contains("todo", True))


def _matches(text: Column, rule: Rule, number: int, wanted: Column) -> Column:
    """Array of (rule, place among its matches, gap before it, length, whether it is long enough)."""
    pairs = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("match"))

    def one(pair: Column, i: Column) -> Column:
        part = F.regexp_extract(pair["match"], rule.pattern, rule.group) if rule.group else pair["match"]
        return F.struct(
            F.lit(number).alias("rule"), i.alias("i"), F.length(pair["gap"]).alias("gap"), F.length(pair["match"]).alias("size"),
            (F.length(part) >= rule.least).alias("counts"),
        )

    found = F.filter(F.transform(pairs, one), lambda x: x["size"].isNotNull())  # behind the last gap is no match
    here = wanted & (F.contains(text, F.lit(rule.hint)) if rule.hint else F.lit(True)) & F.rlike(text, F.lit(rule.pattern))
    return F.when(here, found).otherwise(F.array().cast("array<struct<rule int, i int, gap int, size int, counts boolean>>"))


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs of `texts` (blob, content, todo) in which a rule to do finds something."""
    arrays = [_matches(F.col("content"), rule, i, F.col("todo")[i]) for i, rule in enumerate(rules)]
    hits = texts.select("blob", F.explode(F.concat(*arrays)).alias("hit")).select("blob", "hit.*")
    along = Window.partitionBy("blob", "rule").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = hits.withColumn("end", end.cast("int")).where("counts")
    versions = F.array(*[F.lit(r.version) for r in rules])
    span = F.struct(F.get(versions, F.col("rule")).alias("rule"), (F.col("end") - F.col("size")).alias("start"), "end")
    return placed.groupBy("blob").agg(F.collect_list(span).alias("spans"))


def update(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, addressed: DataFrame | None = None) -> int:
    """Scans what the ledger has not seen and appends it; returns the number of blobs scanned.

    One writer at a time; a run that fails before its commit leaves the ledger as it was.
    """
    spark = docs.sparkSession
    blobs = (addresses(docs) if addressed is None else addressed).select("blob").distinct()
    new = Stored(unseen(blobs, read(spark, ledger), rules), "unseen")
    n = new.df.count()
    if n:
        texts = docs.select(content(F.col("text")).alias("content")).withColumn("blob", blob(F.col("content")))
        if n <= FEW_BLOBS:
            texts = texts.join(F.broadcast(new.df.select("blob")), "blob", "left_semi")
        one_each = texts.groupBy("blob").agg(F.first("content").alias("content"))
        found = scan(one_each.join(new.df, "blob"), rules)
        versions = F.array(*[F.lit(r.version) for r in rules])
        done = F.transform(F.filter(F.arrays_zip("todo", versions.alias("rule")), lambda x: x["todo"]), lambda x: x["rule"])
        none = F.array().cast("array<struct<rule string, start int, end int>>")
        entries = new.df.join(found, "blob", "left").select("blob", done.alias("rules"), F.coalesce("spans", none).alias("spans"))
        entries.write.mode("append").parquet(ledger)
    new.drop()
    return n


def findings(addressed: DataFrame, known: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`addressed` (blob and any columns) with spans: array of (start, kind, end) by start, then by the order of `rules`."""
    numbers = F.array(*[F.lit(r.version) for r in rules])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    ordered = F.transform(
        F.filter("all", lambda s: F.array_contains(numbers, s["rule"])),
        lambda s: F.struct(s["start"].alias("start"), F.array_position(numbers, s["rule"]).cast("int").alias("n"), s["end"].alias("end")),
    )
    spans = F.transform(
        F.array_sort(F.array_distinct(ordered)), lambda s: F.struct(s["start"].alias("start"), F.element_at(kinds, s["n"]).alias("kind"), s["end"].alias("end"))
    )
    found = known.where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("all")).select("blob", spans.alias("spans"))
    none = F.array().cast("array<struct<start int, kind string, end int>>")
    return addressed.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def scan_documents(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Brings the ledger up to date with `docs` and returns (blob, doc_id, spans), a row for every row of `docs`.

    Whole texts are read; null counts as empty, an empty text has no spans. Rows may repeat a
    doc_id (versions of a document) or a text (copies): each has its own row with the spans
    of its text. Null doc_ids stay. Needs doc_id and text, ignores other columns; an empty table
    gives no rows. Spans of one kind never overlap, those of different kinds may.
    """
    addressed = Stored(addresses(docs), "addresses").df
    update(docs, ledger, rules, addressed)
    return findings(addressed, read(docs.sparkSession, ledger), rules)
