"""Sum-of-squares online packing of token documents into fixed windows.

A task packs the documents of its input partition as they come. A document longer than a
window gives full windows from its start; what is left goes whole to the fill level h that
makes the sum over h of N(h)^2 smallest, N(h) being the number of open windows filled to
level h (an array of one counter a level). A window that becomes full is written at once.

When a stream ends, or when OPEN_WINDOWS are open, the open windows are closed: those
within `tolerance` of full stay as they are, the pieces of the others are laid end to end
and cut anew at window borders. What remains at the end of a stream is cut at powers of
two, which need no padding, down to `least`; shorter rests stay one padded window.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm import word_ids

WINDOW = 2048
OPEN_WINDOWS = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Levels:
    """Open windows by fill level; pieces are (document, start, ids, length of the document)."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.n_open = 0

    def choose(self, size: int) -> int:
        """The level whose use makes the sum of squares smallest; the fullest of equals; 0 opens a window."""
        last = self.window - size
        from_, to = self.counts[: last + 1], self.counts[size:]
        # Moving a window from h to h + size changes the sum by 2 (N(h + size) - N(h) + 1).
        change = 2 * (to - from_) + 2
        change[0] = 2 * self.counts[size] + 1
        if last > 0:
            change[last] = 1 - 2 * self.counts[last]
        else:
            return 0
        change[1:][from_[1:] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> list | None:
        """Puts a piece of at most a window; returns the window's pieces when that fills it."""
        size = len(piece[2])
        level = self.choose(size)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.open[level + size].append(pieces)
        self.counts[level + size] += 1
        self.n_open += 1
        return None

    def close(self, tolerance: int, rest: list) -> Iterator[list]:
        """Closes all windows; pieces that fill no window end up in `rest`."""
        loose = list(rest)
        rest.clear()
        for level in sorted(self.open, reverse=True):
            for pieces in self.open[level]:
                if self.window - level <= tolerance:
                    yield pieces
                else:
                    loose += pieces
        self.open.clear()
        self.counts[:] = 0
        self.n_open = 0
        yield from cut(loose, self.window, rest)


def cut(pieces: list, window: int, rest: list) -> Iterator[list]:
    """`pieces` end to end, cut every `window` ids; what fills none goes to `rest`."""
    now, room = [], window
    for doc, start, ids, total in pieces:
        while len(ids) >= room:
            yield [*now, (doc, start, ids[:room], total)]
            start, ids, now, room = start + room, ids[room:], [], window
        if len(ids):
            now.append((doc, start, ids, total))
            room -= len(ids)
    rest += now


def _packer(tokenizer: str, end_id: int, window: int, tolerance: int, least: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, levels, rest = word_ids.load(tokenizer), Levels(window), []
        # Deterministic input partitions: a task run anew gives the same sequences.
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def emit(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def frame() -> pd.DataFrame:
            names = [c.split()[0] for c in PIECES.split(", ")]
            made = pd.DataFrame(out, columns=names)
            made["doc_id"] = pd.array([x[0] for x in out], "Int64")
            out.clear()
            return made

        for batch in batches:
            keys = [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
            for key, ids in zip(keys, words.documents(batch["text"], end_id)):
                full = len(ids) // window * window
                for at in range(0, full, window):
                    emit([(key, at, ids[at : at + window], len(ids))])
                if full < len(ids) and (done := levels.place((key, full, ids[full:], len(ids)))):
                    emit(done)
                if levels.n_open >= OPEN_WINDOWS:
                    for pieces in levels.close(tolerance, rest):
                        emit(pieces)
            if out:
                yield frame()
        for pieces in levels.close(tolerance, rest):
            emit(pieces)
        while (held := sum(len(p[2]) for p in rest)) >= least:
            tail, rest = rest, []
            # One window of the largest power of two that can be filled.
            size, left = 1 << (held.bit_length() - 1), []
            for pieces in cut(tail, size, left):
                emit(pieces)
            rest = left
        if rest:
            emit(rest)
        if out:
            yield frame()

    return pack


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, tolerance: int = 0, least: int = 1) -> DataFrame:
    """Pieces of every document (null text: empty, one end id) in windows of `window` ids.

    Columns: doc_id (null stays null), start and length of the piece in its document,
    ids_crc32 of its ids, doc_tokens, sequence_id, offset in the sequence. Needs doc_id and
    text, ignores other columns; repeated rows are packed each; an empty table gives no rows.
    No shuffle: every input partition is a stream of its own, with at most one sequence of
    each power of two at its end.
    """
    # As text, since pandas would turn a column of numbers and nulls into floats.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(_packer(tokenizer, end_id, window, tolerance, least), PIECES)
