"""Token counts of a byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Pre-tokens of a batch lie one after the other in one array of symbols. In each round every
pre-token merges all places of its own lowest-rank pair at once; those without a pair that
merges are done, and their count is the number of symbols they have left. A merge never
makes a pair of lower rank than its own, so rounds give what one merge at a time gives.

Texts are cut at single spaces between other characters, where no pre-token crosses, so
each worker pre-tokenises a chunk once; a text with other runs of white space at a cut is
pre-tokenised whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.word_ids import BLOCK_CHARS, Codes
from reelspark.llm.worker import held

NONE = np.int64(1 << 40)
#: Symbols merged at a time.
BATCH_SYMBOLS = 1 << 20

# Fixed value: the published pre-token pattern of this kind of byte-level BPE.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class PairRanks:
    """(left, right) -> (rank, merged symbol), looked up for whole arrays by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(len(left) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        self.made = np.zeros(1 << self.bits, np.int64)
        for rank, key in enumerate((left << 32 | right).tolist()):
            slot = int(self._slot(np.array([key]))[0])
            while self.keys[slot] >= 0 and self.keys[slot] != key:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            if self.keys[slot] < 0:
                self.keys[slot], self.ranks[slot], self.made[slot] = key, rank, merged[rank]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; an empty slot has the rank NONE."""
        keys = left << 32 | right
        slots = self._slot(keys)
        held = self.keys[slots]
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slots[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return slots


class Counter:
    """Token counts of texts as the tokenizers library gives them for a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocabulary = model["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        column = lambda f: np.array([vocabulary[f(m)] for m in merges], np.int64)
        self.pairs = PairRanks(column(lambda m: m[0]), column(lambda m: m[1]), column(lambda m: m[0] + m[1]))
        # The byte-level alphabet: printable Latin-1 stands for itself, the rest follows from U+0100.
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.first = np.array([vocabulary[chr(b) if b in own else chr(next(rest))] for b in range(256)], np.int64)
        added = [x["content"] for x in model["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._reset()

    def _reset(self) -> None:
        self.tokens: dict[str, int] = {}
        self.inner, self.leading = (Codes(lambda words, p=p: self._learn(words, p)) for p in (" ", ""))
        self.counts: dict[str, np.ndarray] = {p: np.zeros(1 << 14, np.int64) for p in (" ", "")}
        self.learnt = {" ": 0, "": 0}

    def merge(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token."""
        out = np.zeros(len(tokens), np.int64)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        bounds = np.cumsum(sizes)
        at = 0
        while at < len(tokens):
            to = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + BATCH_SYMBOLS, "right")))
            out[at:to] = self._merge(b"".join(tokens[at:to]), sizes[at:to])
            at = to
        return out

    def _merge(self, data: bytes, sizes: np.ndarray) -> np.ndarray:
        out = sizes.copy()
        symbols = self.first[np.frombuffer(data, np.uint8)]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        while len(symbols) > 1:
            same = owner[:-1] == owner[1:]
            slots = self.pairs.of(symbols[:-1], symbols[1:])
            ranks = np.where(same, self.pairs.ranks[slots], NONE)
            begins = np.flatnonzero(np.concatenate([[True], ~same]))
            sizes_now = np.diff(np.append(begins, len(symbols)))
            lowest = np.minimum.reduceat(np.append(ranks, NONE), begins)
            least = np.repeat(lowest, sizes_now)
            places = np.flatnonzero((ranks == least[:-1]) & (ranks < NONE))
            if not len(places):
                break
            # Equal symbols in a row overlap: every second place from the left.
            run = np.concatenate([[True], np.diff(places) != 1])
            start = places[run][np.cumsum(run) - 1]
            places = places[(places - start) % 2 == 0]
            symbols[places] = self.pairs.made[slots[places]]
            keep = np.repeat(lowest < NONE, sizes_now)  # the others are done
            keep[places + 1] = False
            out -= np.bincount(owner[places + 1], minlength=len(out))
            symbols, owner = symbols[keep], owner[keep]
        return out

    def _pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and the special strings in it, which are one token each."""
        if self.special is None:
            return PRE_TOKENS.findall(text), 0
        parts = self.special.split(text)
        return [t for part in parts for t in PRE_TOKENS.findall(part)], len(parts) - 1

    def whole(self, texts: list[str]) -> list[int]:
        found = [self._pieces(t) for t in texts]
        new = list({t for tokens, _ in found for t in tokens if t not in self.tokens})
        given = dict(zip(new, self.merge([t.encode() for t in new]).tolist()))
        if len(self.tokens) < 400_000:
            self.tokens.update((t, n) for t, n in given.items() if len(t) <= 128)
        count = lambda t: given[t] if t in given else self.tokens[t]
        return [special + sum(map(count, tokens)) for tokens, special in found]

    def _learn(self, words: list[str], prefix: str) -> None:
        have, n = self.learnt[prefix], len(words)
        if have + n > len(self.counts[prefix]):
            self.counts[prefix] = np.concatenate([self.counts[prefix], np.zeros(max(n, have), np.int64)])
        self.counts[prefix][have : have + n] = [
            # A cut beside more white space: told by a negative number, the text is counted whole.
            -1 if not w or w[-1].isspace() else c
            for w, c in zip(words, self.whole([prefix + w for w in words]))
        ]
        self.learnt[prefix] = have + n

    def count(self, texts: Iterable[str | None]) -> np.ndarray:
        """Tokens of each text (null: empty)."""
        out: list[np.ndarray] = []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size > BLOCK_CHARS:
                out.append(self._group(group))
                group, size = [], 0
        return np.concatenate([*out, self._group(group)]) if group else np.concatenate(out or [np.zeros(0, np.int64)])

    def _group(self, texts: list[str]) -> np.ndarray:
        if self.inner.full or self.leading.full:
            self._reset()
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets, flat = lists.offsets.to_numpy(), lists.flatten()
        is_first = np.zeros(len(flat), bool)
        is_first[offsets[:-1]] = True
        counts = np.empty(len(flat), np.int64)
        for mask, codes, prefix in ((is_first, self.leading, ""), (~is_first, self.inner, " ")):
            coded = flat.filter(pa.array(mask)).dictionary_encode()
            rows = codes.of(coded.dictionary.to_pylist())
            counts[mask] = self.counts[prefix][rows][coded.indices.to_numpy()]
        totals = np.add.reduceat(counts, offsets[:-1])
        odd = np.flatnonzero(np.add.reduceat(counts < 0, offsets[:-1]))
        totals[odd] = self.whole([texts[i] for i in odd.tolist()])
        return totals


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text (null: empty).

    Repeated rows are counted each; null doc_ids stay; an empty table gives no rows. Needs
    doc_id and text, ignores other columns. `tokenizer` is a byte-level BPE file on every executor.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = held(("counts", tokenizer), lambda: Counter(tokenizer))
        for texts in batches:
            yield pd.Series(counter.count(texts), dtype="int64")

    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), count("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
