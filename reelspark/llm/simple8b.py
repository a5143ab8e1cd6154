"""Token ids as word-aligned Simple-8b blocks, written as files in document order and read back.

A 64-bit word holds a 4-bit selector and 60 bits of equal-width values: many small ids
or few large ones. Values of more than 60 bits go to a list of escapes, the word holds
their place in it. A coded block has up to BLOCK_IDS ids and starts at a word of its own,
so blocks decode independently, and within a block all words of one selector decode in
one numpy step.

File layout. The rows of a Parquet table are the frames of the files, one file (`part`) a
range of doc_id: frame number, ids before it in its file, its documents with their
lengths, and the payload: header (magic, ids, blocks, escapes), the first word of each
block, escapes, words; all little-endian. Parquet gives the container its commit protocol.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm import word_ids
from reelspark.llm.common import Stored

#: (values in a word, bits of each), by selector; the last selector is the escape.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = len(SELECTORS)
BLOCK_IDS = 1 << 15
FRAME_IDS = 1 << 18
MAGIC = 0x42385331
HEADER = struct.Struct("<IIQ")

FRAMES = "part int, frame int, before long, doc_ids array<bigint>, lengths array<bigint>, payload binary"


#: Upper limits of what fits a selector's bits, narrowest first, and the class of every small value among them.
_LIMITS = np.array([1 << b for _, b in SELECTORS], np.uint64)
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)
_COUNTS = np.array([c for c, _ in SELECTORS] + [1], np.int32)
#: The walk over words goes by jumps of two to so many words.
_DOUBLINGS = 5


def _choices(ids: np.ndarray) -> np.ndarray:
    """For every place the fullest selector whose whole word of values from there on fits its bits."""
    n = len(ids)
    wide = _SMALL[ids] if int(ids.max(initial=0)) < len(_SMALL) else np.searchsorted(_LIMITS, ids, "right").astype(np.uint8)
    choice = wide.clip(len(SELECTORS) - 1)  # one value of up to 60 bits, or an escape
    # Widest value of 1, 2, 4, … places from each on; any other number of places is two of these that overlap.
    reach, widest = 1, {1: wide}
    while 2 * reach <= min(n, SELECTORS[0][0]):
        last = widest[reach]
        widest[2 * reach] = np.maximum(last[:-reach], last[reach:])
        reach *= 2
    for selector in range(len(SELECTORS) - 2, -1, -1):
        count = SELECTORS[selector][0]
        if count > n:
            break
        half = 1 << (count.bit_length() - 1)
        whole = widest[half]
        if count > half:
            whole = np.maximum(whole[: n - count + 1], whole[count - half :])
        choice[: n - count + 1][whole <= selector] = selector
    return choice


def _starts(step: np.ndarray) -> np.ndarray:
    """0, step[0], and so on: every 2^_DOUBLINGS-th by itself, those between by jumps of all at once."""
    n = len(step)
    jumps = [np.append(np.minimum(np.arange(n, dtype=np.int32) + step, n), np.int32(n))]
    for _ in range(_DOUBLINGS):
        jumps.append(jumps[-1][jumps[-1]])
    far, at, some = jumps.pop(), 0, []
    while at < n:
        some.append(at)
        at = int(far[at])
    starts = np.array(some, np.int64)
    for jump in reversed(jumps):
        starts = np.stack([starts, jump[starts]], axis=1).reshape(-1)
    return starts[starts < n]


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes of one block of unsigned 64-bit values; the fullest selector that fits is taken each time."""
    ids = np.ascontiguousarray(ids, np.uint64)
    choice = _choices(ids)
    first = _starts(_COUNTS[choice])
    chosen = choice[first]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(chosen == selector)
        if len(mine):
            place, packed = first[mine], words[mine]
            for j in range(count):
                packed |= ids[place + j] << np.uint64(j * bits)
            words[mine] = packed
    mine = np.flatnonzero(chosen == ESCAPE)
    words[mine] |= np.arange(len(mine), dtype=np.uint64)
    return words, ids[first[mine]]


def decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS] + [1], np.int64)[selectors]
    first = np.cumsum(counts) - counts
    ids = np.empty(n, np.uint64)
    for selector, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(selectors == selector)
        if len(mine):
            values, place = words[mine], first[mine]
            mask = np.uint64((1 << bits) - 1)
            for j in range(count):
                ids[place + j] = (values >> np.uint64(j * bits)) & mask
    mine = np.flatnonzero(selectors == ESCAPE)
    if len(mine):
        ids[first[mine]] = escapes[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return ids


def encode(ids: np.ndarray) -> bytes:
    """A payload: blocks with their offsets."""
    coded = [encode_block(ids[i : i + BLOCK_IDS]) for i in range(0, len(ids), BLOCK_IDS)]
    bounds = np.zeros((len(coded) + 1, 2), "<u4")  # first word and first escape of each block
    if coded:
        bounds[1:] = np.cumsum([[len(w), len(e)] for w, e in coded], axis=0)
    parts = [HEADER.pack(MAGIC, len(coded), len(ids)), bounds.tobytes()]
    parts += [e.astype("<u8").tobytes() for _, e in coded] + [w.astype("<u8").tobytes() for w, _ in coded]
    return b"".join(parts)


def decode(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first..last-1 of a payload (all by default), reading only the blocks that hold them."""
    magic, n_blocks, n = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b payload")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.empty(0, np.uint64)
    bounds = np.frombuffer(payload, "<u4", 2 * n_blocks + 2, HEADER.size).reshape(-1, 2).astype(np.int64)
    body = HEADER.size + bounds.size * 4
    escapes = np.frombuffer(payload, "<u8", bounds[-1, 1], body)
    words = np.frombuffer(payload, "<u8", bounds[-1, 0], body + 8 * len(escapes))
    a, b = first // BLOCK_IDS, -(-last // BLOCK_IDS)
    out = [
        decode_block(words[bounds[k, 0] : bounds[k + 1, 0]], escapes[bounds[k, 1] : bounds[k + 1, 1]], min(BLOCK_IDS, n - k * BLOCK_IDS))
        for k in range(a, b)
    ]
    return np.concatenate(out)[first - a * BLOCK_IDS : last - a * BLOCK_IDS]


def _frames(tokenizer: str, end_id: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part = word_ids.load(tokenizer), TaskContext.get().partitionId()
        docs: list = []
        ids: list[np.ndarray] = []
        held = frame = before = 0

        def flush() -> pd.DataFrame:
            lengths = [len(x) for x in ids]
            return pd.DataFrame(
                {"part": [part], "frame": [frame], "before": [before], "doc_ids": [docs], "lengths": [lengths], "payload": [encode(np.concatenate(ids))]}
            )

        for batch in batches:
            keys = [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
            for key, row in zip(keys, words.documents(batch["text"], end_id, word_ids.WIDE_BLOCK_CHARS)):
                docs.append(key)
                ids.append(row)
                held += len(row)
                if held >= FRAME_IDS:
                    yield flush()
                    before, frame, held, docs, ids = before + held, frame + 1, 0, [], []
        if docs:
            yield flush()

    return write


def write(docs: DataFrame, tokenizer: str, end_id: int = 1) -> Stored:
    """Ids of every whole text (null: empty), `end_id` after each document, as files in ascending doc_id order.

    Needs the columns doc_id and text, ignores others. Null doc_ids come first, rows with
    the same doc_id follow each other in no fixed order. An empty table gives no frames.
    Texts are dealt out by ranges of doc_id once; ids are made where they are written.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    # As text, since pandas would turn a column of numbers and nulls into floats.
    ordered = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return Stored(ordered.mapInPandas(_frames(tokenizer, end_id), FRAMES), "simple8b")


def read(frames: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded frames.

    `start` counts ids over all files; the base of a file comes from one row per file.
    """

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, before, docs, lengths, payload in zip(batch["part"], batch["before"], batch["doc_ids"], batch["lengths"], batch["payload"]):
                raw = decode(payload).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(memoryview(raw)[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths)]
                yield pd.DataFrame(
                    {"part": part, "doc_id": pd.array(docs, "Int64"), "in_file": before + ends - lengths, "n_tokens": lengths, "ids_crc32": crc}
                )

    rows = frames.mapInPandas(decoded, "part int, doc_id long, in_file long, n_tokens long, ids_crc32 long")
    sizes = frames.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("ids"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("base"))
    # One row per file, and a file is one task of the writing stage: small by construction.
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")
