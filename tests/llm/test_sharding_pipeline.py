"""The lookup table's evenness and stability, and the pipeline against a plain version of its stages."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cases import frame, rows
from reelspark.llm import sharding, toxicity
from test_duplicates import joined, lower, slow_fingerprint

SF = "/root/testdata/sf0.01"


def test_table_is_even_and_stable():
    shards = {f"s{i}": 1 for i in range(10)}
    full = sharding.fill(shards, 1009)
    sizes = Counter(full)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill({s: 1 for s in shards if s != "s3"}, 1009)
    moved = sum(a != b for a, b in zip(full, fewer) if a != "s3")
    assert moved < 0.1 * 1009
    weighted = Counter(sharding.fill({"a": 1, "b": 3}, 1009))
    assert 2.9 < weighted["b"] / weighted["a"] < 3.1
    for bad in (({}, 1009), ({"a": 0}, 1009), ({"a": 1}, 1000), ({f"x{i}": 1 for i in range(9)}, 7)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_placing(spark, tmp_path):
    docs, shards = frame(spark), {f"s{i}": 1 for i in range(4)}
    placed = sharding.place(docs, "doc_id", shards, 1009, ("at", "where"))
    assert placed.columns == [*docs.columns, "at", "where"] and placed.count() == len(rows())
    table = sharding.fill(shards, 1009)
    assert all(r.where == table[r.at] for r in placed.collect())
    assert len({r.where for r in placed.where("doc_id is null").collect()}) == 1
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan
    plain = docs.select("doc_id", "text")
    sharding.write(plain, "doc_id", shards, 1009, str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows()) and set(r.shard for r in back.select("shard").distinct().collect()) == set(shards)
    assert sharding.place(frame(spark, []), "doc_id", shards, 1009, ("at", "where")).count() == 0
    # Columns of the same names give way, one that is the key among them.
    clash = sharding.place(docs, "doc_id", shards, 1009)
    assert clash.columns == [c for c in docs.columns if c not in ("slot", "shard")] + ["slot", "shard"]
    assert sorted(map(repr, clash.select("doc_id", "shard").collect())) == sorted(repr(r).replace("where=", "shard=") for r in placed.select("doc_id", "where").collect())
    assert sharding.place(docs, "shard", shards, 1009).select("shard").distinct().count() == 1
    sharding.write(docs, "doc_id", shards, 1009, str(tmp_path / "clash"), 2)
    assert spark.read.parquet(str(tmp_path / "clash")).count() == len(rows())


def plain_pipeline(spark, docs, labels):
    """The decisions of the stages by loops over lists; the classifier itself is the trained one."""
    model = toxicity.train(docs, labels)
    kept = [r for r, p in zip(docs.collect(), toxicity.Scorer(model).scores([r.text for r in docs.collect()])) if p < toxicity.THRESHOLD]
    largest = defaultdict(int)
    for r in kept:
        largest[lower(r.text)] = max(largest[lower(r.text)], r.doc_id)
    kept = [r for r in kept if largest[lower(r.text)] == r.doc_id]
    kept.sort(key=lambda r: r.doc_id)
    prints = np.array([slow_fingerprint(r.text) for r in kept], np.uint64)
    linked = [(a, int(b)) for a in range(len(kept)) for b in np.flatnonzero(np.bitwise_count(prints[:a] ^ prints[a]) <= 4)]
    return [r for i, (r, c) in enumerate(zip(kept, joined(len(kept), linked))) if i == c]


def test_pipeline_keeps_what_a_plain_version_keeps(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = plain_pipeline(spark, docs, labels)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for p in corpus_pipeline.run(spark, SF).collect():
        pieces[p.doc_id].append(p)
    assert set(pieces) == {r.doc_id for r in kept} and len(kept) < docs.count()
    for r in kept:
        ids, at = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_stages_take_odd_documents(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(60)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count() > 0
    texts = [lower(r.text) for r in docs.collect()]
    assert len(texts) == len(set(texts)) and not any(re.search("\x00", t) for t in texts)
