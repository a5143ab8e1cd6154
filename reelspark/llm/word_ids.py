"""Token ids of whole documents by the tokenizers library, one library call per distinct word.

The word-level BPE of `word_bpe_49k.json` never joins characters across white space:
normalisation, splitting and merging all end at it. So the ids of a document are the
ids of its white-space-free chunks in order, and each worker asks the library once for
each chunk it meets. `tests/llm/test_token_files.py` holds this against whole-text calls.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from reelspark.llm.worker import held

#: Distinct chunks a worker remembers (some 100 MB at most); results do not depend on it.
MAX_CHUNKS = 250_000
#: Chunks above this many characters are not remembered.
MAX_CHUNK_CHARS = 128
#: Documents are handled together up to so many characters; longer ones in pieces of this size, cut at white space.
BLOCK_CHARS = 4 << 20
#: For operators that hold nothing else: more words to a dictionary save time, and take memory.
WIDE_BLOCK_CHARS = 8 << 20

_WHITE = re.compile("[ \\t\\n\\r\\x0b\\x0c]")
# Chunks of letters, digits and signs whose runs this module can tell by itself: no
# apostrophe (contractions), no "<" (special strings), nothing that normalisation composes.
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_RUNS = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\n]+|\n")
# The byte-level alphabet: printable Latin-1 stands for itself, the rest follows from U+0100.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_SELF))}


class Ragged:
    """Rows of unsigned 32-bit numbers, appended at the end as bytes, gathered by row number."""

    def __init__(self) -> None:
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.rows = self.used = 0

    def append(self, rows: list[bytes]) -> None:
        self.extend(np.frombuffer(b"".join(rows), np.uint32), np.fromiter(map(len, rows), np.int64, len(rows)) // 4)

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        """Rows of these lengths, their contents one after the other."""
        total, n = len(values), len(lengths)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.rows + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used : self.used + total] = values
        self.starts[self.rows : self.rows + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.rows : self.rows + n] = lengths
        self.rows, self.used = self.rows + n, self.used + total

    def keep(self, rows: np.ndarray) -> None:
        """Only `rows` stay, in this order."""
        values, ends = self.gather(rows)
        self.flat, self.lengths = np.append(values, np.empty(1 << 16, np.uint32)), np.append(self.lengths[rows], np.zeros(1 << 14, np.int64))
        self.starts = np.append(ends, np.zeros(1 << 14, np.int64)) - self.lengths
        self.rows, self.used = len(rows), len(values)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their contents one after the other, and the end of each."""
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        if not len(rows):
            return self.flat[:0], ends
        at = np.repeat(self.starts[rows] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.flat[at], ends


class Codes:
    """Numbers for distinct words; `learn` is told the new ones in order.

    Up to `limit` words are remembered, from the second time they are met (one-off words, of
    which a corpus has many, would fill the room of frequent ones); the others get a number
    for one use. `full` says that it is time for `compact`, or to start anew.
    """

    def __init__(self, learn, limit: int | None = None, most: int = 2) -> None:
        self.numbers: dict[str, int] = {}
        self.met = np.zeros(1 << 21, bool)
        self.learn, self.limit, self.most, self.next = learn, limit or MAX_CHUNKS, most, 0

    @property
    def full(self) -> bool:
        return self.next > self.most * self.limit

    def of(self, words: list[str]) -> np.ndarray:
        """`words` are distinct."""
        found = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            self.learn(new)
            found[missing] = given = np.arange(self.next, self.next + len(new))
            self.next += len(new)
            at = np.fromiter(map(hash, new), np.int64, len(new)) & (len(self.met) - 1)
            again = np.flatnonzero(self.met[at])
            self.met[at] = True
            for i in again[: max(0, self.limit - len(self.numbers))].tolist():
                if len(new[i]) <= MAX_CHUNK_CHARS:
                    self.numbers[new[i]] = int(given[i])
        return found

    def compact(self) -> np.ndarray:
        """Numbers the remembered words anew from 0; their old numbers, in that order."""
        kept = np.fromiter(self.numbers.values(), np.int64, len(self.numbers))
        self.numbers = dict(zip(self.numbers, range(len(kept))))
        self.next = len(kept)
        return kept


def chunks(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks between ASCII white space, for each chunk its place among them, and each text's end in chunks."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    flat, ends = lists.flatten(), lists.offsets.to_numpy()[1:]
    real = pc.not_equal(flat, "")  # white space at an end, and nothing at all, give empty chunks
    if not pc.all(real, min_count=0).as_py():
        ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[ends]
        flat = flat.filter(real)
    coded = flat.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), ends


def groups(texts: Iterable[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[list[str], bool]]:
    """Texts (null: empty) in lists of about `limit` characters; a longer text comes in pieces, each alone.

    The flag says that more of the same text follows.
    """
    group: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if len(text) > limit:
            if group:
                yield group, False
                group, size = [], 0
            start = 0
            while len(text) - start > limit:
                ahead = _WHITE.search(text, start + limit)
                if not ahead:
                    break
                yield [text[start : ahead.end()]], True
                start = ahead.end()
            yield [text[start:]], False
            continue
        group.append(text)
        size += len(text)
        if size > limit:
            yield group, False
            group, size = [], 0
    if group:
        yield group, False


class WordTokenizer:
    """Ids of documents by one tokenizer file of the kind described above."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ids, self.run_ids = Ragged(), Ragged()
        self.codes = Codes(self._learn)
        self.runs = {"\n": 0}
        self.run_ids.append([b""])

    def _rows_of(self, runs: list[str]) -> np.ndarray:
        """Rows of `run_ids`, in which distinct runs are remembered while there is room."""
        rows = np.fromiter(map(self.runs.get, runs, repeat(-1)), np.int64, len(runs))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = [runs[i] for i in missing.tolist()]
            rows[missing] = given = np.arange(self.run_ids.rows, self.run_ids.rows + len(new))
            spelled = [r if r.isascii() else r.encode().decode("latin-1").translate(_BYTE_CHARS) for r in new]
            tokenize, flat, lengths = self.library.model.tokenize, array("I"), []
            for s in spelled:
                ids = [t.id for t in tokenize(s)]
                flat.extend(ids)
                lengths.append(len(ids))
            self.run_ids.extend(np.frombuffer(flat, np.uint32), np.array(lengths, np.int64))
            self.runs.update(zip(new, given.tolist()))
        return rows

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of known runs, one after the other, and the number of each: all are lowered and cut at once."""
        if len(self.runs) > MAX_CHUNKS:
            self.run_ids, self.runs = Ragged(), {"\n": 0}
            self.run_ids.append([b""])
        runs = pa.array(_RUNS.findall("\n".join([*words, ""]).lower()), pa.string()).dictionary_encode()
        rows = self._rows_of(runs.dictionary.to_pylist())[runs.indices.to_numpy()]
        flat, done = self.run_ids.gather(rows)  # the line feed behind each word has no ids
        return flat, np.diff(done[rows == 0], prepend=0)

    def _learn(self, words: list[str]) -> None:
        known = np.fromiter(map(bool, map(_PLAIN.fullmatch, words)), bool, len(words))
        lengths = np.zeros(len(words), np.int64)
        parts = []
        if known.any():
            flat, lengths[known] = self._plain([words[i] for i in np.flatnonzero(known).tolist()])
            parts.append(flat)
        if not known.all():
            rest = [e.ids for e in self.library.encode_batch_fast([words[i] for i in np.flatnonzero(~known).tolist()], add_special_tokens=False)]
            lengths[~known] = list(map(len, rest))
            parts.append(np.frombuffer(b"".join([array("I", r).tobytes() for r in rest]), np.uint32))
        # The others' ids lie behind those of plain words: each row from where it lies to its place.
        order = np.argsort(~known, kind="stable")
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        ends = np.cumsum(lengths)
        at = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])
        self.ids.extend(np.concatenate(parts)[at], lengths)

    def documents(self, texts: Iterable[str | None], end_id: int | None = None, block: int = BLOCK_CHARS) -> Iterator[np.ndarray]:
        """uint32 ids of each text (null: empty), in order, with `end_id` behind them."""
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        begun: list[np.ndarray] = []
        for group, more in groups(texts, block):
            if self.codes.full:
                self.ids.keep(self.codes.compact())
            words, which, last = chunks(group)
            flat, ends = self.ids.gather(self.codes.of(words)[which])
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], last])].tolist()
            if more:
                begun.append(flat)
                continue
            for a, b in zip(bounds[:-1], bounds[1:]):
                yield np.concatenate([*begun, flat[a:b], tail])
                begun = []


def load(path: str) -> WordTokenizer:
    """The tokenizer of this worker, kept from task to task."""
    return held(("words", path), lambda: WordTokenizer(path))
