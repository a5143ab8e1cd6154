"""SentencePiece encoding and decoding: one Viterbi pass over the matches of an Aho-Corasick automaton.

The automaton holds all pieces. It runs once over the characters of a chunk and, following
its output links, names every piece that ends at the current one; each relaxes the best
score there: the best score where the piece begins plus its own. For a unigram model that
is the whole rule. A BPE model (whose scores are merge ranks) accepts a piece only behind a
piece that merging would have left beside it: no merge across their border may come before
the merges inside either of them. Exactly one segmentation passes that, the one by merges.

Pieces hold the mark of a space at their beginning only, so chunks that begin with it
encode by themselves; each worker encodes a chunk once.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.word_ids import Codes, Ragged, groups
from reelspark.llm.worker import held

SPACE = "▁"
_CHUNKS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Pairs of pieces a worker remembers the verdict of.
MAX_PAIRS = 1_000_000


class Pieces:
    """The pieces of a model file: texts, scores, and which are bytes or control pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.scores = [model.get_score(i) for i in range(model.get_piece_size())]
        self.unknown = model.unk_id()
        self.bytes = {int(self.texts[i][3:5], 16): i for i in range(len(self.texts)) if model.is_byte(i)}
        hidden = {i for i in range(len(self.texts)) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.hidden = {i for i in hidden if i not in set(self.bytes.values())}
        self.ids = {t: i for i, t in enumerate(self.texts) if i not in hidden}
        scores = [self.scores[i] for t, i in self.ids.items() if t.strip(SPACE)]
        #: Merge ranks are whole, not above zero and all different (pieces of spaces alone may share one).
        self.by_merges = len(set(scores)) == len(scores) and all(s == int(s) and s <= 0 for s in scores)
        inner = [t for t in self.ids if SPACE in t.lstrip(SPACE)]
        if inner:
            raise ValueError(f"pieces hold a space inside, such as {inner[0]!r}")


class Encoder:
    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.parts: dict[int, tuple[int, int]] = {}
        """The two pieces whose merge makes a piece."""
        texts = self.pieces.ids
        if self.pieces.by_merges:
            texts = {t: i for t, i in texts.items() if self._merged(t, i)}
        self.matches = ahocorasick.Automaton()
        for text, i in texts.items():
            self.matches.add_word(text, (len(text), i))
        self.matches.make_automaton()
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}
        self.ids = Ragged()
        self.codes = Codes(self._learn)

    def _merged(self, text: str, piece: int) -> bool:
        """Whether merging the characters of a piece gives the piece; notes its last merge."""
        now = list(text)
        ids, scores = self.pieces.ids, self.pieces.scores
        while len(now) > 1:
            options = [(scores[ids[a + b]], -k) for k, (a, b) in enumerate(zip(now, now[1:])) if a + b in ids]
            if not options:
                return False
            k = -max(options)[1]
            if len(now) == 2:
                self.parts[piece] = ids.get(now[0], -1), ids.get(now[1], -1)
            now[k : k + 2] = [now[k] + now[k + 1]]
        return True

    def _edge(self, piece: int, side: int) -> list[tuple[str, float]]:
        """The pieces that lie at one edge while a piece is merged, from a character up, each with the score of the merge that ends it."""
        chain = self.edges[side].get(piece)
        if chain is None:
            inside = self.parts.get(piece)
            chain = [(self.pieces.texts[piece], -np.inf)]
            if inside is not None:
                below = self._edge(inside[side], side)
                chain = [*below[:-1], (below[-1][0], self.pieces.scores[piece]), *chain]
            self.edges[side][piece] = chain
        return chain

    def beside(self, left: int, right: int) -> bool:
        """Whether merging leaves `left` and `right` beside each other."""
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, i, j, fine = self._edge(left, 1), self._edge(right, 0), 0, 0, True
        ids, scores = self.pieces.ids, self.pieces.scores
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            across = ids.get(x + y)
            # Of equal merges the left one comes first.
            if across is not None and scores[across] > x_ends and scores[across] >= y_ends:
                fine = False
                break
            if x_ends == y_ends == -np.inf:
                break
            if x_ends >= y_ends:
                i += 1
            else:
                j += 1
        if len(self.pairs) < MAX_PAIRS:
            self.pairs[left, right] = fine
        return fine

    def segment(self, chunk: str) -> list[int]:
        """Ids of a chunk; characters in no piece become their bytes, or the unknown id."""
        n = len(chunk)
        last, size = [-1] * (n + 1), [1] * (n + 1)
        (self._relax_merges if self.pieces.by_merges else self._relax_scores)(chunk, last, size)
        out: list[int] = []
        at = n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += reversed(self._spelled(chunk[at - 1]))
            at -= size[at]
        return out[::-1]

    def _relax_merges(self, chunk: str, last: list[int], size: list[int]) -> None:
        """One piece at most is right at each position; where none ends, the character is unknown and nothing merges with it."""
        pairs, beside = self.pairs, self.beside
        for end, (length, piece) in self.matches.iter(chunk):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if before >= 0:
                fine = pairs.get((before, piece))
                if not (beside(before, piece) if fine is None else fine):
                    continue
            last[end], size[end] = piece, length

    def _relax_scores(self, chunk: str, last: list[int], size: list[int]) -> None:
        """The best sum of scores; a character that is no piece may stand as unknown, at a price no piece has."""
        score, closed = [0.0] + [-np.inf] * len(chunk), 0
        for end, (length, piece) in [*self.matches.iter(chunk), (len(chunk), (0, -1))]:
            for at in range(closed + 1, end + 1):
                if chunk[at - 1] not in self.pieces.ids and score[at - 1] - 1e6 > score[at]:
                    score[at], last[at], size[at] = score[at - 1] - 1e6, -1, 1
            closed, end = max(closed, end), end + 1
            if piece >= 0 and score[end - length] + self.pieces.scores[piece] > score[end]:
                score[end], last[end], size[end] = score[end - length] + self.pieces.scores[piece], piece, length

    def _spelled(self, character: str) -> list[int]:
        raw = character.encode()
        return [self.pieces.bytes[b] for b in raw] if all(b in self.pieces.bytes for b in raw) else [self.pieces.unknown]

    def _learn(self, chunks: list[str]) -> None:
        self.ids.append([array("I", self.segment(c)).tobytes() for c in chunks])

    def _looked_up(self, chunks: list[str]) -> np.ndarray:
        distinct = list(dict.fromkeys(chunks))
        given = dict(zip(distinct, self.codes.of(distinct).tolist()))
        return self.ids.gather(np.fromiter(map(given.__getitem__, chunks), np.int64, len(chunks)))[0]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """uint32 ids of each text (null: empty), in order; spaces count as their mark, one stands before the text."""
        first, begun, carried = True, [], ""
        for group, more in groups(texts):
            if self.codes.full:
                self.ids.keep(self.codes.compact())
            lists = pc.split_pattern(pa.array(group, pa.large_string()), " ")
            offsets, coded = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            which = coded.indices.to_numpy()
            plain = np.array([bool(w) and SPACE not in w for w in words], bool)[which]
            ok = np.minimum.reduceat(plain, offsets[:-1]) if len(plain) else np.zeros(len(group), bool)
            # Chunks of the texts that single spaces divide; the others are cut one by one.
            asked = np.flatnonzero(np.bincount(which[np.repeat(ok, np.diff(offsets))], minlength=len(words)))
            rows = np.full(len(words), -1, np.int64)
            rows[asked] = self.codes.of([SPACE + words[i] for i in asked.tolist()])
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if ok[k] and first and not more and not carried:
                    yield self.ids.gather(rows[which[a:b]])[0]
                    continue
                text, carried = carried + group[k], ""
                if more:
                    # What follows the last begin of a space goes with the next piece of the text.
                    cut = len(text[: text.rfind(" ") + 1].rstrip(" "))
                    text, carried = text[:cut], text[cut:]
                if text:
                    begun.append(self._looked_up(_CHUNKS.findall((SPACE * first + text).replace(" ", SPACE))))
                    first = False
                if not more:
                    yield np.concatenate([self.ids.flat[:0], *begun])
                    first, begun = True, []

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for: without control pieces and the space before the text."""
        spelled = {i: bytes([b]) for b, i in self.pieces.bytes.items()}
        parts = [spelled[i] if i in spelled else b"" if i in self.pieces.hidden else self.pieces.texts[i].encode() for i in ids.tolist()]
        text = b"".join(parts).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def load(path: str) -> Encoder:
    """The encoder of this worker, kept from task to task."""
    return held(("pieces", path), lambda: Encoder(path))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of every whole text; null and empty texts have no ids. Repeated rows are encoded each.

    Needs doc_id and text, ignores other columns; an empty table gives no rows.
    """

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(load(model).encode(texts)), dtype=object)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), run("text").alias("ids"))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of ids; null ids count as none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([load(model).decode(np.array([] if i is None else i, np.int64)) for i in rows], dtype=object)

    return encoded.select("doc_id", run("ids").alias("text"))


TRIP = "n_pieces long, ids_crc32 long, same boolean"


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, same): ids encoded, decoded again and held against the text.

    `same` takes null as empty and marks of spaces in a text as the spaces that they encode as.
    """

    @F.pandas_udf(TRIP)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = load(model)
        for batch in batches:
            texts = [t or "" for t in batch]
            ids = list(encoder.encode(texts))
            same = [encoder.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts)]
            crc = [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]
            yield pd.DataFrame({"n_pieces": [len(i) for i in ids], "ids_crc32": crc, "same": same})

    trip = docs.select(F.col("doc_id").cast("long").alias("doc_id"), run("text").alias("trip"))
    return trip.select("doc_id", "trip.*")
