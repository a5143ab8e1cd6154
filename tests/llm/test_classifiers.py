"""Toxicity on held-out rows, licence scans on planted notices, and odd inputs of both."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import frame, rows
from reelspark.llm import licences, toxicity
from reelspark.llm.common import Stored

SF = "/root/testdata/sf0.1"
LABELS = "doc_id bigint, toxic int, quality int"


def test_toxicity_of_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id")
    held = scored.where(toxicity.default_held_out(F.col("doc_id"))).toPandas()
    assert (held["predicted"] == (held["score"] >= 0.3)).all() and held["score"].between(0, 1).all()
    hits = (held["predicted"] & held["toxic"]).sum()
    assert hits / held["predicted"].sum() > 0.85 and hits / held["toxic"].sum() > 0.75


def test_training_never_sees_held_out_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 0) for i in range(400)], LABELS)
    sample = toxicity.sample(docs, labels, toxicity.default_held_out, toxicity.TrainingSize(toxic=20, clean=70))
    assert len(sample) == 90 and (sample["toxic"] == 1).sum() == 20
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in sample["doc_id"])


def test_scores_of_odd_documents(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(i, int(i % 6 == 0), 1) for i, _ in rows() if i is not None] + [(None, 1, 1), (1, None, 1)], LABELS)
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model, ("new_score", "new_flag"))
    got = out.collect()
    assert len(got) == len(rows()) and all(0 <= r.new_score <= 1 for r in got)
    assert len({r.new_score for r in got if not (r.text or "").strip(" \t\n")}) == 1
    assert toxicity.drop_toxic(Stored(docs, "docs").df, labels).columns == docs.columns
    none = spark.createDataFrame([], LABELS)
    assert toxicity.drop_toxic(Stored(docs, "docs").df, none).count() == len(rows())
    assert toxicity.drop_toxic(frame(spark, []), none).count() == 0


def test_long_texts_score_as_whole(monkeypatch):
    texts = [t for _, t in rows() if t][:70] + ["the of and " + "word another longer " * 500 + "bad bad2 end"]
    labels = np.array([i % 4 == 0 for i in range(len(texts))]).astype(int)
    model = toxicity.fit(texts, labels, np.arange(len(texts)) % 5 == 0, toxicity.TrainingSize(epochs=2))
    whole = toxicity.Scorer(model).scores(texts)
    original = toxicity.groups
    monkeypatch.setattr(toxicity, "groups", lambda t, limit: original(t, 60))
    assert np.allclose(toxicity.Scorer(model).scores(texts), whole, atol=1e-6)


def test_thresholds_by_language():
    z = np.array([3.0, 2.0, 1.0, 0.0] * 30 + [-1.0, -2.0, -3.0, -4.0] * 30)
    y = np.array([1, 1, 0, 0] * 60)
    spoken = np.array([0] * 120 + [1] * 120)
    shift = toxicity.calibrated(z, spoken, y)
    score = 1 / (1 + np.exp(-(z + shift[spoken])))
    assert ((score >= toxicity.THRESHOLD) == (y == 1)).all()


def test_a_full_word_cache_between_pieces_loses_no_words(monkeypatch):
    model = toxicity.Model.fresh()
    model.shift = np.zeros(len(toxicity.LANGUAGES))
    texts = [" ".join(f"w{i * k % 101}x{i} the" for i in range(60)) for k in range(1, 30)]
    original = toxicity.groups
    monkeypatch.setattr(toxicity, "groups", lambda t, limit: original(t, 25))
    pooled = []
    monkeypatch.setattr(toxicity.Model, "logits", lambda self, x: pooled.append(x.copy()) or x.sum(axis=1))
    toxicity.Scorer(model).scores(texts)
    kept, pooled[:] = np.vstack(pooled), []
    monkeypatch.setattr(toxicity, "MAX_WORDS", 4)
    toxicity.Scorer(model).scores(texts)
    assert np.allclose(np.vstack(pooled), kept, atol=1e-6)


@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_planted_notices_are_found(spark, licence_model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = re.compile(
        "licensed under the (GNU) General Public License, version 3|Licensed under (CC) BY-NC|Released under the (MIT) License|under the (Apache) License"
    )
    got = {r.doc_id: r for r in licences.scan(docs, licence_model).collect()}
    for row in docs.select("doc_id", "text").collect():
        families = {next(filter(None, m.groups())).replace("GNU", "GPL") for m in planted.finditer(row.text)}
        assert set(filter(None, got[row.doc_id].families.split(","))) == families, row.doc_id
        assert got[row.doc_id].family in (families or {licences.UNKNOWN})


def test_notices_in_unseen_surroundings(spark, licence_model):
    made = [
        (1, "Thntblere of then edtioner in inea that " * 40 + "this software is licensed under the apache license, version 2.0. " + "Ing the anre ouonre " * 60),
        (2, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
        (3, "The licence of the driver was taken by the police; permission was not granted."),
        (4, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
    ]
    got = {r.doc_id: r.families for r in licences.scan(spark.createDataFrame(made, "doc_id bigint, text string"), licence_model).collect()}
    assert got == {1: "Apache", 2: "BSD", 3: "", 4: "CC,MIT"}


def test_every_family_of_a_line_and_every_notice_of_a_family(spark, licence_model):
    made = [
        (1, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
        (2, "Released under the MIT License. " + "the anre ouonre of then " * 20 + "Released under the MIT License."),
        (3, "Released under the MIT License. Released under the ISC License. This work is licensed under the GNU General Public License, version 3."),
        (4, "This work is licensed under the GNU Affero General Public License, version 3."),
        (5, "This work is licensed under the GNU Lesser General Public License, version 3."),
        (6, "the anre ouonre of then Released under the Unlicense. the anre ouonre of then"),
    ]
    got = {r.doc_id: (r.families, r.n_notices) for r in licences.scan(spark.createDataFrame(made, "doc_id bigint, text string"), licence_model).collect()}
    assert got == {1: ("CC,MIT", 2), 2: ("MIT", 2), 3: ("GPL,ISC,MIT", 3), 4: ("AGPL", 1), 5: ("LGPL", 1), 6: ("Unlicense", 1)}


def test_templates_wrapped_at_every_word(spark, licence_model):
    scanner = licences.Scanner(licence_model)
    for family, texts in licences.TEMPLATES.items():
        for text in texts:
            words = text.split()
            wrapped = [f"{' '.join(words[:k])}\n{' '.join(words[k:])}" for k in range(1, len(words))]
            inside = [f"Ing the anre ouonre\nof then edtioner in {w}\nin inea that" for w in [*wrapped, "\n".join(words), "\r\n".join(words)]]
            for found, body in zip(scanner.scan([*wrapped, *inside]), [*wrapped, *inside]):
                assert [f for f, _, _ in found] == [family], body
    assert list(scanner.scan(["Released under the\n \nMIT License."])) == [[]]


PROSE = [
    "He may rent the flat under the terms of the contract he signed in May.",
    "Under the terms of the lease he owes rent for any purpose with or without cause.",
    "She walked free of charge to any person obtaining a copy of her book",
    "You may not use this file except in compliance with company policy.",
    "You may use this software under the terms of the MIT licence.",
    "MIT License\n\nCopyright (c) 2020 X",
    "Released under the MIT Lisence.",
    "Released under the terms he had asked for.",
]
WORDS = "the of and to in is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would".split()


def test_prose_with_phrases_of_templates_holds_no_notice(licence_model):
    random = np.random.default_rng(8)
    long = [t.split() for texts in licences.TEMPLATES.values() for t in texts if len(t.split()) > 2 * licences.SHINGLE]
    made = []
    for k in range(200):
        words = long[k % len(long)]
        size = int(random.integers(licences.SHINGLE, licences.SHINGLE + 3))
        at = int(random.integers(len(words) - size + 1))
        around = [" ".join(random.choice(WORDS, int(random.integers(2, 12)))) for _ in range(2)]
        made.append(f"{around[0]} {' '.join(words[at : at + size])} {around[1]}.")
    scanner = licences.Scanner(licence_model)
    wrong = [t for t, found in zip([*PROSE, *made], scanner.scan([*PROSE, *made])) if found]
    assert not wrong


def test_one_misspelt_word_in_a_long_notice(licence_model):
    for family, texts in licences.TEMPLATES.items():
        text = max(texts, key=len)
        words = text.split()
        if len(words) > 29:
            words[1] = words[1][:-1] + "q"
            assert [f for f, _, _ in next(licences.Scanner(licence_model).scan([" ".join(words)]))] == [family]


def test_a_notice_at_every_offset_around_a_cut(licence_model, monkeypatch):
    monkeypatch.setattr(licences, "PIECE", 1500)
    scanner = licences.Scanner(licence_model)
    notice = " Released under the MIT License. "
    filler = " ".join(WORDS[i * 7 % len(WORDS)] for i in range(700))
    for at in range(1400, 1560):
        cut = filler.index(" ", at)
        text = filler[:cut] + notice + filler[cut:]
        assert [f for f, _, _ in next(scanner.scan([text]))] == ["MIT"], at
    # Notices behind each other, cut again and again: each counts once.
    text = (notice + " ".join(WORDS) + " " + " ".join(WORDS[::-1])) * 40
    assert len(next(scanner.scan([text]))) == 40
    assert [len(f) for f in scanner.scan([filler, text, "", None, notice])] == [0, 40, 0, 0, 1]


def test_the_regression_decides_the_family(licence_model):
    notices = [t for texts in licences.TEMPLATES.values() for t in texts]
    blind = licences.Model(np.zeros_like(licence_model.weights), np.zeros_like(licence_model.bias), 0.0, licence_model.least)
    assert not any(licences.Scanner(blind).scan(notices))
    # A regression that takes each family for the next one is confirmed by no template.
    order = [0, *np.roll(np.arange(1, len(licences.FAMILIES)), 1)]
    wrong = licences.Model(licence_model.weights[:, order], licence_model.bias[order], licence_model.threshold, licence_model.least[order], licence_model.scale)
    found = [f for one in licences.Scanner(wrong).scan(notices) for f, _, _ in one]
    assert len(found) < len(notices) / 10


def test_licences_of_odd_documents(spark, licence_model):
    got = licences.scan(frame(spark), licence_model).collect()
    assert len(got) == len(rows()) and all(r.family == licences.UNKNOWN and r.n_notices == 0 for r in got)
    assert licences.scan(frame(spark, []), licences.train(frame(spark, []))).count() == 0


def test_windows_cover_every_word():
    lengths = np.array([0, 1, 59, 60, 61, 90, 91, 1000])
    owner, start, size = licences.windows(lengths)
    for i, n in enumerate(lengths):
        covered = np.zeros(n, int)
        for a, b in zip(start[owner == i], size[owner == i]):
            assert 0 < b <= licences.WINDOW
            covered[a : a + b] += 1
        assert covered.all()
