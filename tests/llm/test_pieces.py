"""Piece encoding against the library, and the unigram rule against all segmentations."""

import zlib
from random import Random

import ahocorasick
import numpy as np
import public_tokenizers
import sentencepiece

from cases import frame, odd_texts, rows
from reelspark.llm import pieces, word_ids

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    random = Random(8)
    letters = ["".join(random.choice("abcdehinost") for _ in range(random.randrange(40))) for _ in range(3000)]
    return odd_texts(4000) + letters + [t or "" for _, t in rows()]


def test_ids_and_decoded_texts_are_the_librarys(monkeypatch):
    library, ours = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load(MODEL)
    made = texts()
    expected = library.encode(made)
    assert [x.tolist() for x in ours.encode(made)] == expected
    assert [ours.decode(np.array(e, np.int64)) for e in expected] == library.decode(expected)
    monkeypatch.setattr(word_ids, "BLOCK_CHARS", 500)
    assert [x.tolist() for x in ours.encode(made)] == expected


def test_long_texts_in_pieces():
    ours = pieces.load(MODEL)
    long = ["a word " * 40 + " two  spaces " * 30, "x\ny z" * 100]
    whole = [x.tolist() for x in ours.encode(long)]
    assert [x.tolist() for x in _in_pieces(ours, long)] == whole


def _in_pieces(ours, long):
    original = pieces.groups
    pieces.groups = lambda t, limit=50: original(t, 50)
    try:
        yield from list(ours.encode(long))
    finally:
        pieces.groups = original


def test_unigram_scores():
    """The best sum over every segmentation of short chunks."""
    random = Random(3)
    made = {}
    for _ in range(60):
        made["".join(random.choice("abc") for _ in range(random.randrange(1, 5)))] = -random.random() * 10
    made |= {"a": -9.0, "b": -9.5}
    made.pop("c", None)
    encoder = pieces.Encoder.__new__(pieces.Encoder)
    encoder.pieces = pieces.Pieces.__new__(pieces.Pieces)
    encoder.pieces.ids = {t: i for i, t in enumerate(made)}
    encoder.pieces.scores, encoder.pieces.by_merges = list(made.values()), False
    encoder.pieces.bytes, encoder.pieces.unknown = {}, 999
    encoder.matches = ahocorasick.Automaton()
    for t, i in encoder.pieces.ids.items():
        encoder.matches.add_word(t, (len(t), i))
    encoder.matches.make_automaton()

    def best(chunk):
        if not chunk:
            return 0.0
        options = [made[chunk[:k]] + best(chunk[k:]) for k in range(1, len(chunk) + 1) if chunk[:k] in made]
        return max([*options, -1e6 + best(chunk[1:])])

    for _ in range(300):
        chunk = "".join(random.choice("abc") for _ in range(random.randrange(9)))
        ids = encoder.segment(chunk)
        assert abs(sum(-1e6 if i == 999 else encoder.pieces.scores[i] for i in ids) - best(chunk)) < 1e-3


def test_round_trip(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    made = [(i, t or "") for i, t in rows()]
    expected = {}
    for i, t in made:
        ids = library.encode(t)
        expected[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), library.decode(ids) == t.replace("▁", " "))
    got = pieces.round_trip(frame(spark), MODEL).collect()
    assert len(got) == len(made) and all(tuple(rest) == expected[i] for i, *rest in got if i is not None)
    assert pieces.round_trip(frame(spark, []), MODEL).count() == 0
    encoded = pieces.encode(frame(spark), MODEL)
    back = {r.doc_id: r.text for r in pieces.decode(encoded, MODEL).collect()}
    assert all(back[i] == library.decode(library.encode(t)) for i, t in made if i is not None)
