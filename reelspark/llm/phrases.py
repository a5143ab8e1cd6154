"""Phrase collocations: adjacent pairs of ranked ids counted in tiles, level by level.

Texts become runs of word numbers in chunks of some CHUNK_WORDS words, each with a
dictionary of its own. Words are counted from the dictionaries; those that occur often
enough get their rank by frequency as id, and the ids go back to the chunks. Then pairs of adjacent
ids are counted: the plane of pairs is cut into square tiles of TILE x TILE ids, a tile
with many pairs in it is counted by direct address (numpy's bincount over its cells), all
others together as sorted coordinates. Spark adds up the counts of all chunks. Pairs that are frequent
get ranks in turn, their places in the chunks become the ids of the next level, and
two overlapping pairs of it are a phrase of three words, and so on.

Dictionaries, not words or pairs, go through the shuffles, and no list that grows with
the corpus goes to every task: ids reach a chunk by a join with its dictionary. A word of
every chunk is one row a chunk there, which adaptive execution splits. Counts are added
map-side first. Ranks are counted over ranges dealt out by Spark, never in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.llm.common import BATCH_ROWS, Stored

MIN_COUNT, MAX_WORDS, TOP, KEEP_SHARE = 10, 3, 2000, 50
CHUNK_WORDS = 1 << 18
#: A text above this many bytes is cut at its piece ends.
BLOCK_BYTES = 4 << 20
TILE = 256
#: A tile with at least one pair to so many cells is counted densely.
SPARSE = 8
#: Chunks in an Arrow batch.
BATCH_CHUNKS = 4
SALTS = 32
BREAK = -1

#: A-Z to lower case, ends of pieces to line feeds, tabs to spaces.
_BYTES = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNKS = "chunk long, lang string, run binary, units array<string>, counts array<int>"
LEVEL = "chunk long, lang string, run binary, units array<long>, counts array<int>"


def blocks(text: str) -> Iterator[bytes]:
    """The normalised bytes of a text, cut at piece ends where it is very long."""
    data = text.encode("utf-8", "surrogatepass").translate(_BYTES)
    start = 0
    while len(data) - start > BLOCK_BYTES:
        cut = data.rfind(b"\n", start, start + BLOCK_BYTES)
        cut = cut if cut > start else data.find(b"\n", start + BLOCK_BYTES)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut + 1
    yield data[start:]


def runs(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """Words in order, and the piece of each."""
    raw = np.frombuffer(data, np.uint8)
    ends = raw == 10
    word = ~ends & (raw != 32)
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    starts = np.flatnonzero(word & ~before)
    offsets = np.concatenate([np.cumsum(word)[starts] - 1, [word.sum()]]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])])
    return words, np.cumsum(ends, dtype=np.int64)[starts]


def _row(chunk: int, lang: str, run: np.ndarray, units: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [pa.array([chunk], pa.int64()), pa.array([lang], pa.string()), pa.array([run.tobytes()], pa.binary()), one(units), one(pa.array(counts, pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "lang", "run", "units", "counts"])


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts: dict[str, list[bytes]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)
    number = TaskContext.get().partitionId() << 32

    def flush(lang: str) -> pa.RecordBatch:
        nonlocal number
        words, piece = runs(b"\n".join(texts.pop(lang)))
        del sizes[lang]
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        counts = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32)
        # A break between words of different pieces.
        place = np.arange(len(codes)) + np.concatenate([[0], np.cumsum(np.diff(piece) > 0)]) if len(codes) else np.zeros(0, np.int64)
        run = np.full(int(place[-1]) + 1 if len(place) else 0, BREAK, np.int32)
        run[place] = codes
        number += 1
        return _row(number, lang, run, coded.dictionary.cast(pa.string()), counts)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for block in blocks(text):
                texts[lang].append(block)
                sizes[lang] += len(block)
                if sizes[lang] >= 6 * CHUNK_WORDS:
                    yield flush(lang)
    for lang in list(texts):
        yield flush(lang)


def pair_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs as left << 32 | right, ascending, and the count of each."""
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tile = (left // TILE) << 32 | right // TILE
    tiles, which, sizes = np.unique(tile, return_inverse=True, return_counts=True)
    dense = sizes >= TILE * TILE // SPARSE
    keys, counts = [], []
    rest = np.flatnonzero(~dense[which])
    sparse, n = np.unique(left[rest] << 32 | right[rest], return_counts=True)
    keys.append(sparse)
    counts.append(n)
    if dense.any():
        inside = np.flatnonzero(dense[which])
        inside = inside[np.argsort(which[inside], kind="stable")]
        cells = (left[inside] % TILE) * TILE + right[inside] % TILE
        for t, part in zip(np.flatnonzero(dense), np.split(cells, np.cumsum(sizes[dense])[:-1])):
            full = np.bincount(part, minlength=TILE * TILE)
            at = np.flatnonzero(full)
            i, j = int(tiles[t]) >> 32, int(tiles[t]) & 0xFFFFFFFF
            keys.append((i * TILE + at // TILE) << 32 | (j * TILE + at % TILE))
            counts.append(full[at])
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order]


def _adjacent(run: np.ndarray) -> np.ndarray:
    """Places whose unit and next unit both have an id."""
    return np.flatnonzero((run[:-1] >= 0) & (run[1:] >= 0)) if len(run) else np.zeros(0, np.int64)


def _counted(words: bool):
    """Ids of a chunk in place of its own numbers (`words`) or of the pairs of its last level, and the pairs of these."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n) for n in ("chunk", "lang", "run", "unit", "id")]
            for chunk, lang, data, unit, ids in zip(*columns):
                unit, ids = unit.values.to_numpy(), ids.values.to_numpy()
                if words:
                    own = np.frombuffer(data.as_buffer(), np.int32)
                    table = np.full(max(int(own.max(initial=0)), int(unit.max(initial=0))) + 2, BREAK, np.int64)
                    table[unit] = ids
                    run = table[own]  # BREAK reads the last entry, which stays BREAK
                else:
                    own = np.frombuffer(data.as_buffer(), np.int64)
                    at = _adjacent(own)
                    keys = own[at] << 32 | own[at + 1]
                    order = np.argsort(unit)
                    where = np.minimum(np.searchsorted(unit[order], keys), len(unit) - 1) if len(unit) else np.zeros(0, np.int64)
                    run = np.full(max(0, len(own) - 1), BREAK, np.int64)
                    if len(unit):
                        hit = unit[order][where] == keys
                        run[at[hit]] = ids[order][where[hit]]
                at = _adjacent(run)
                keys, counts = pair_counts(run[at], run[at + 1])
                yield _row(chunk.as_py(), lang.as_py(), run, pa.array(keys, pa.int64()), counts.astype(np.int32))

    return count


@contextmanager
def _settings(spark: SparkSession, batch_rows: int):
    """Arrow batches of so many rows, and tables of long arrays packed tightly, inside."""
    inside = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows), "spark.sql.parquet.compression.codec": "zstd"}
    before = {name: spark.conf.get(name) for name in inside}
    for name, value in inside.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _sums(level: DataFrame) -> DataFrame:
    """(lang, unit, f) over all chunks."""
    each = level.select("lang", F.explode(F.arrays_zip("units", "counts")).alias("x"))
    return each.groupBy("lang", F.col("x.units").alias("unit")).agg(F.sum("x.counts").alias("f"))


def _ranked(counts: DataFrame, name: str) -> DataFrame:
    """`counts` (lang, unit, f, …), stored, with an id: 0 for the most frequent unit of a language, and so on."""
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["lang", F.col("f").desc(), "unit"]
    ordered = counts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = Stored(ordered.select("*", F.monotonically_increasing_id().alias("row")), name).df
    part = F.shiftright("row", 33)
    ranges = rows.groupBy("lang", part.alias("part")).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    ahead = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("lang", "part", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("base"))
    # One row a range, and one more where two languages meet in it.
    return rows.withColumn("part", part).join(bases, ["lang", "part"]).withColumn("id", F.col("row") + F.col("base")).drop("row", "part", "base")


def _level(below: Stored, units: DataFrame, words: bool, name: str) -> Stored:
    """The chunks of the next level: runs of the ids of `units` (lang, unit, id) and their adjacent pairs."""
    spark = units.sparkSession
    number = F.col("pos") if words else F.col("unit")
    each = below.df.select("chunk", "lang", F.posexplode("units").alias("pos", "unit"))
    ids = each.join(units.select("lang", "unit", "id"), ["lang", "unit"]).groupBy("chunk").agg(
        F.collect_list(F.struct(number.cast("long").alias("unit"), "id")).alias("x")
    )
    chunks = below.df.select("chunk", "lang", "run").join(ids, "chunk").select("chunk", "lang", "run", F.col("x.unit").alias("unit"), F.col("x.id").alias("id"))
    with _settings(spark, BATCH_CHUNKS):
        made = Stored(chunks.mapInArrow(_counted(words), LEVEL), name)
    below.drop()
    return made


def _score(a: Column, left: Column, right: Column) -> Column:
    whole = [c.cast("decimal(19,0)") for c in (a, left, right)]
    top = F.lit(1_000_000).cast("decimal(7,0)") * (whole[0] * whole[0]).cast("decimal(38,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (whole[1] * whole[2]).cast("decimal(38,0)"))


def _phrases(counts: DataFrame, below: DataFrame, name: str) -> DataFrame:
    """Ranked phrases of a level: two phrases of the level below that overlap in all but a word.

    Columns: lang, unit, f, id, phrase, last (its last word), heads and tails (frequencies of
    its first and last k words, k = 1, 2, …).
    """
    side = {s: below.select(F.col("lang").alias(f"{s}_lang"), *[F.col(c).alias(f"{s}_{c}") for c in ("id", "f", "phrase", "last", "heads", "tails")]) for s in "ab"}
    first, second = F.shiftrightunsigned("unit", 32), F.col("unit").bitwiseAND(F.lit(0xFFFFFFFF))
    joined = counts.withColumn("first", first).withColumn("second", second)
    joined = joined.join(side["a"], (F.col("lang") == F.col("a_lang")) & (F.col("first") == F.col("a_id")))
    joined = joined.join(side["b"], (F.col("lang") == F.col("b_lang")) & (F.col("second") == F.col("b_id")))
    made = joined.select(
        "lang", "unit", "f", F.concat_ws(" ", "a_phrase", "b_last").alias("phrase"), F.col("b_last").alias("last"),
        F.concat("a_heads", F.array("a_f")).alias("heads"), F.concat("b_tails", F.array("b_f")).alias("tails"),
    )
    return _ranked(made, name)


def candidates(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, keep_share: int = KEEP_SHARE) -> DataFrame:
    """All phrases of 2 to `max_words` words that occur `min_count` times: lang, phrase, words, a, l, r, n, score, kept.

    `kept` is false where a phrase of more words holds it and has `keep_share` percent of its count.
    """
    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    with _settings(docs.sparkSession, BATCH_ROWS):
        level = Stored(given.mapInArrow(_chunks, CHUNKS), "chunks")
    words = Stored(_sums(level.df), "words").df
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    none = F.array().cast("array<long>")
    frequent = words.where(F.col("f") >= min_count).select("*", F.col("unit").alias("phrase"), F.col("unit").alias("last"), none.alias("heads"), none.alias("tails"))
    below = _ranked(frequent, "level-1")
    found = []
    for size in range(2, max_words + 1):
        level = _level(level, below, size == 2, f"runs-{size}")
        counts = _sums(level.df).where(F.col("f") >= min_count)
        here = _phrases(counts, below, f"level-{size}")
        found.append(here.withColumn("words", F.lit(size)))
        below = here
    level.drop()
    out = None
    for i, here in enumerate(found):
        if i + 1 < len(found):
            pair = F.explode(F.array(F.shiftrightunsigned("unit", 32), F.col("unit").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("id")
            longer = found[i + 1].select("lang", "f", pair).groupBy("lang", "id").agg(F.max("f").alias("longer"))
            here = here.join(longer, ["lang", "id"], "left")
        else:
            here = here.withColumn("longer", F.lit(None).cast("long"))
        kept = F.col("longer").isNull() | (100 * F.col("longer") < keep_share * F.col("f"))
        cuts = F.array(*[
            F.struct(_score(F.col("f"), F.col("heads")[k], F.col("tails")[i - k]).alias("score"), F.lit(k).alias("k"), F.col("heads")[k].alias("l"), F.col("tails")[i - k].alias("r"))
            for k in range(i + 1)
        ])
        cut = F.array_min(cuts)
        scored = here.select("lang", "phrase", "words", F.col("f").alias("a"), cut.alias("cut"), kept.alias("kept"))
        out = scored if out is None else out.union(scored)
    return out.join(totals, "lang").select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score", "kept")


def collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    Words are runs of characters other than space and tab within pieces that `.,;:!?` and line
    ends cut, with A-Z in lower case. Of a phrase, a is its count, l and r those of the two
    parts at its weakest cut, score floor(10^6 a a / (l r)), n the language's words. Ordered by score, a
    (both descending) and phrase in bytes, which tells all ties apart. A null lang is `und`, a
    null or empty text has no words, repeated rows count each. Needs lang and text, ignores other
    columns; a language without a frequent phrase, like an empty table, gives no rows.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = candidates(docs, **options).where("kept").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
