"""Phrase collocations against counting by loops; tiles against a counter."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cases import frame
from reelspark.llm import phrases
from test_duplicates import lower


def plain(rows, min_count, max_words, top, share=50):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, max_words + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        longest = defaultdict(int)
        for p, a in chosen.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longest[p[i : i + size]] = max(longest[p[i : i + size]], a)
        found = []
        for p, a in chosen.items():
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not longest[p] or 100 * longest[p] < share * a:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("min_count, max_words, top", [(3, 3, 50), (2, 4, 100_000), (10, 2, 7)])
def test_phrases_of_odd_documents(spark, min_count, max_words, top):
    docs = frame(spark)
    extra = [(i, "one two, one two three. ONE\ttwo three four; one" + " two" * (i % 4), [None, "xx", "und"][i % 3]) for i in range(40)]
    extra += [(None, None, None), (7, "", "xx"), (8, "Ä ä Ä ä\x0bÄ ä", "xx")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string"), allowMissingColumns=True).repartition(7)
    got = phrases.collocations(docs, top=top, min_count=min_count, max_words=max_words)
    expected = plain([(r.lang, r.text) for r in docs.select("lang", "text").collect()], min_count, max_words, top)
    assert len(expected) > 10 and sorted(tuple(r) for r in got.collect()) == expected


def test_empty_tables_and_tables_without_phrases(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")).count() == 0


@pytest.mark.parametrize("high, sparse", [(40, 8), (3000, 8), (3000, 60_000), (1 << 31, 8)])
def test_dense_and_sparse_tiles(monkeypatch, high, sparse):
    monkeypatch.setattr(phrases, "SPARSE", sparse)
    random = np.random.default_rng(1)
    left, right = ((random.random(60_000) ** 3 * high).astype(np.int64) for _ in range(2))
    keys, counts = phrases.pair_counts(left, right)
    expected = Counter(zip(left.tolist(), right.tolist()))
    assert (np.diff(keys) > 0).all()
    assert {(k >> 32, k & 0xFFFFFFFF): n for k, n in zip(keys.tolist(), counts.tolist())} == expected


def test_long_texts_are_cut_at_piece_ends_only(monkeypatch):
    text = "Ab, cd e" * 40 + " long piece without any end " * 30 + ". z! y"
    whole, piece = phrases.runs(next(phrases.blocks(text)))
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 50)
    parts = [phrases.runs(b) for b in phrases.blocks(text)]
    assert len(parts) > 5 and [w for words, _ in parts for w in words.to_pylist()] == whole.to_pylist()
    assert sum(len(np.unique(p)) for _, p in parts) == len(np.unique(piece))
    assert phrases.runs(b"")[0].to_pylist() == [] and phrases.runs(b" \n ")[0].to_pylist() == []


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(10**12, 10**12 + 1, 3 * 10**12), (10**13 - 1, 10**13, 10**13 - 1), (10, 10, 10)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(phrases._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == [1_000_000 * a * a // (x * y) for a, x, y in rows]
