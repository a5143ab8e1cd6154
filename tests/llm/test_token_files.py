"""Token ids, Simple-8b files, packing and token counts against whole-text calls of the library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cases import frame, odd_texts, rows
from reelspark.llm import packing, simple8b, token_counts, word_ids
from reelspark.llm.common import Stored

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library_ids(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_are_the_librarys(monkeypatch):
    texts = odd_texts(4000) + [t for _, t in rows()]
    expected = library_ids(WORDS, texts)
    assert [x.tolist() for x in word_ids.load(WORDS).documents(texts)] == expected
    monkeypatch.setattr(word_ids, "BLOCK_CHARS", 700)  # long texts in pieces
    assert [x.tolist() for x in word_ids.load(WORDS).documents(texts, 1)] == [[*e, 1] for e in expected]


def test_forgetting_words_changes_nothing():
    made = word_ids.WordTokenizer(WORDS)
    made.codes.limit = 5
    texts = odd_texts(300)
    for _ in range(3):
        assert [x.tolist() for t in texts for x in made.documents([t])] == library_ids(WORDS, texts)
    assert made.codes.next < 200 and len(made.codes.numbers) <= 5


@pytest.mark.parametrize("n", [0, 1, 5, 100, 40_000, 70_000])
@pytest.mark.parametrize("widest", [1, 2, 12, 16, 64])
def test_simple8b_gives_back_what_it_got(n, widest):
    random = np.random.default_rng(n + widest)
    bits = np.repeat(random.integers(1, widest + 1, n // 40 + 1), 40)[:n].astype(np.uint64)
    values = random.integers(0, 2**64, n, dtype=np.uint64) >> (np.uint64(64) - bits)
    payload = simple8b.encode(values)
    assert (simple8b.decode(payload) == values).all()
    for a, b in np.sort(random.integers(0, n + 1, (5, 2)), axis=1):
        assert (simple8b.decode(payload, a, b) == values[a:b]).all()
    if widest <= 16 and n > 1000:
        assert len(payload) < 2.6 * n


def test_simple8b_words_hold_full_selectors():
    words, escapes = simple8b.encode_block(np.array([1] * 60 + [2**63], np.uint64))
    assert len(words) == 2 and escapes.tolist() == [2**63]


def test_files_in_document_order(spark):
    written = simple8b.write(frame(spark), WORDS)
    got = [tuple(r) for r in simple8b.read(written.df).collect()]
    made = rows()
    expected = {i: (len(ids) + 1, crc([*ids, 1])) for (i, _), ids in zip(made, library_ids(WORDS, [t for _, t in made])) if i is not None}
    assert sorted(g[0] for g in got if g[0] is not None) == sorted(i for i, _ in made if i is not None)
    assert all(expected[i] == (n, c) for i, _, n, c in got if i is not None)
    got.sort(key=lambda g: g[1])
    assert [g[0] is not None for g in got] == sorted(g[0] is not None for g in got)  # nulls first
    assert [g[0] for g in got if g[0] is not None] == sorted(g[0] for g in got if g[0] is not None)
    assert [g[1] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])[:-1]]).tolist()
    assert simple8b.read(simple8b.write(frame(spark, []), WORDS).df).count() == 0


@pytest.mark.parametrize("least", [1, 300])
def test_packing_places_each_id_once(spark, least):
    made = rows()
    frame_ = Stored(frame(spark), "docs").df
    pieces = packing.pack(frame_, WORDS, least=least).collect()
    ids = defaultdict(list)
    for (i, _), x in zip(made, library_ids(WORDS, [t for _, t in made])):
        ids[i].append([*x, 1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for i, mine in by_doc.items():
        if len(ids[i]) == 1:
            mine.sort(key=lambda p: p.start)
            at = 0
            for p in mine:
                assert p.start == at and p.ids_crc32 == crc(ids[i][0][at : at + p.length]) and p.doc_tokens == len(ids[i][0])
                at += p.length
            assert at == len(ids[i][0])
        assert sum(p.length for p in mine) == sum(map(len, ids[i]))
    padding = 0
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding == 0 if least == 1 else padding <= 5 * packing.WINDOW
    assert packing.pack(frame(spark, []), WORDS).count() == 0


def test_levels_choose_the_smallest_sum_of_squares():
    random = np.random.default_rng(3)
    levels = packing.Levels(32)
    for _ in range(400):
        size = int(random.integers(1, 33))
        options = {}
        for level in range(0, 33 - size):
            if level == 0 or levels.counts[level]:
                after = levels.counts.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 32
                options[level] = int((after[1:32] ** 2).sum())
        assert options[levels.choose(size)] == min(options.values())
        levels.place((0, 0, np.zeros(size, np.uint32), size))
        assert levels.n_open == levels.counts.sum()


def test_packing_with_few_open_windows_loses_nothing(spark, monkeypatch):
    stream = packing._packer(WORDS, 1, 64, 0, 1)
    monkeypatch.setattr(packing, "OPEN_WINDOWS", 2)
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)}))
    import pandas as pd

    texts = [t for _, t in rows()]
    out = pd.concat(stream(iter([pd.DataFrame({"doc_id": [str(i) for i in range(len(texts))], "text": texts})])))
    assert out["length"].sum() == sum(len(x) + 1 for x in library_ids(WORDS, texts))
    assert (out.groupby("sequence_id")["length"].sum() <= 64).all()


def test_counts_are_the_librarys(spark):
    texts = odd_texts(4000) + [t for _, t in rows()]
    assert token_counts.Counter(BYTES).count(texts).tolist() == [len(x) for x in library_ids(BYTES, texts)]
    made = [(i, t) for i, t in rows() if i is not None]
    expected = {i: (len((t or "").encode()), len(x), len(x) > 512) for (i, t), x in zip(made, library_ids(BYTES, [t for _, t in made]))}
    got = token_counts.token_counts(frame(spark), BYTES).collect()
    assert all(expected[i] == tuple(rest) for i, *rest in got if i is not None) and len(got) == len(rows())
    assert token_counts.token_counts(frame(spark, []), BYTES).count() == 0
