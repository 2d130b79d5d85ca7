"""The pipeline's stages against what they promise, on the smallest tables."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from stratalake.core.storage import materialize
from stratalake.llm import simhash, toxicity
from stratalake.llm.queries import fold
from tests.llm.test_numbered import brute_contamination, brute_simhash


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], sf_dir), name))
    texts = [{r.doc_id: r.text for r in t.collect()} for t in tables[:5]]
    for t in tables[1:5]:
        assert t.columns == docs.columns
    # 1: as the scores say
    model = toxicity.learn(docs.where(fold(3) != 1), labels.where(fold(3) != 1))
    assert {r.doc_id for r in toxicity.score(docs, model).where("score < 0.7").collect()} == set(texts[1])
    # 2: exact groups of fingerprints at two bits or fewer
    fps = {i: brute_simhash(t) for i, t in texts[1].items()}
    groups = {}
    for i in sorted(fps):
        linked = [g for g in groups if any((fps[i] ^ fps[j]).bit_count() <= 2 for j in groups[g])]
        groups[i] = [i, *(j for g in linked for j in groups.pop(g))]
    assert {min(g) for g in groups.values()} == set(texts[2])
    # 3: the contamination rule
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {w[0] for w in brute_contamination(texts[2].items(), items) if not w[5]}
    assert clean == set(texts[3])
    # 4: at most three times each, whole texts
    mixed = tables[4].groupBy("doc_id").count().collect()
    assert mixed and all(1 <= r["count"] <= 3 for r in mixed) and all(texts[3][i] == t for i, t in texts[4].items())
    # 5: a place for each
    out = tables[5].collect()
    assert len(out) == tables[4].count()
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    word = re.compile(r"[^\x20\x09-\x0D]+")
    assert sum(len(word.findall(t)) for t in texts[4].values()) > 0
    assert simhash.simhash("") == 0


def test_rows_without_own_ids(spark):
    # Several null ids, and different texts under one id: each is a group of its own and its words go into the mix.
    words = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(6)]
    rows = [(None, words[0], "en", "a", 1), (None, words[1], "en", "b", 1), (None, words[2], None, None, 1), (7, words[3], "en", "a", 1), (7, words[4], "en", "a", 1)]
    rows += [(9, words[5], "en", "a", 1), (8, words[5], "en", "a", 1), (None, words[5], "en", "a", 1), (7, words[4], "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    order = lambda r: (str(r[0]), r[1])
    want = sorted([*rows[:5], rows[6]], key=order)
    for parts in (1, 5):
        assert sorted(map(tuple, simhash.keep_one(docs.repartition(parts)).collect()), key=order) == want
    lost = spark.createDataFrame([(None, *r[1:]) for r in rows[3:5]], docs.schema)
    # One source: each document's words are taken once, so each row is there once.
    assert sorted(map(tuple, corpus_pipeline.sources_to_weights(spark, lost, "").collect())) == sorted(map(tuple, lost.collect()))


def test_stages_keep_columns_of_any_name(spark):
    # Nulls in every column, empty and repeated rows, and columns that are named like those that the stages add.
    words = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(8)]
    rows = [(i, t, None, "a" if i % 2 else None, 1) for i, t in enumerate(words)] + [(None, words[2], "en", "a", None), (50, "", None, "a", 0), (51, None, None, None, None), (52, " ", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("copies", "m_id", "kept_id", "mix_id", "mix_times", "row_key_a", "copy", "size", "shard", "carried", "fp", "id", "root"):
        docs = docs.withColumn(name, F.lit(7))
    kept = corpus_pipeline.near_copies_go(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == sorted([*words, ""])
    mixed = corpus_pipeline.sources_to_weights(spark, kept, "")
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} <= set(words) and mixed.where("copies = 7 AND mix_id = 7").count() == mixed.count() > 0
    out = corpus_pipeline.shards(spark, materialize(mixed, "test-mix"), "")
    assert out.count() == mixed.count() and {"size_in", "shard_in", "shard", "slot", "text"} <= set(out.columns) and out.where("shard_in = 7").count() == out.count()
    for stage in (corpus_pipeline.near_copies_go, corpus_pipeline.sources_to_weights, corpus_pipeline.shards):
        assert stage(spark, docs.where("false"), "").count() == 0
