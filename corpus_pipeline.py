"""From raw documents to shards: toxicity, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.core.storage import materialize
from stratalake.llm import apportion, simhash, splitters, suffixes, toxicity
from stratalake.llm.queries import fold
from stratalake.llm.skew import unused

SEED = 42


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or higher go. Labels of the held-out third are not learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs.where(fold(3) != 1), labels.where(fold(3) != 1)))


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by SimHash, the row with the least doc_id stays, null last."""
    return simhash.keep_one(docs, shingle=3, radius=2)


def benchmark_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in verbatim matches with benchmark items go."""
    return suffixes.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)


def sources_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, a part of a time rounded by a seeded draw."""
    mix = materialize(apportion.mix_groups(docs), "pipeline-mix")
    # One row for each id, source and text, so that the join is many-to-one.
    draw = F.shiftrightunsigned(F.xxhash64("id", "source", "tie", F.lit(SEED)), 11) / float(2**53)
    times = mix.where("size > 0").withColumn("times", F.floor(F.col("taken") / (F.col("size") * F.col("n")) + draw).cast("int")).where("times > 0")
    key = unused(docs.columns, "mix_id", "mix_source", "mix_tie", "mix_times", "mix_copy")
    chosen = times.select("id", "source", "tie", "times").toDF(*key[:4])
    same = F.col("doc_id").eqNullSafe(F.col(key[0])) & F.col("source").eqNullSafe(F.col(key[1])) & (F.xxhash64("text") == F.col(key[2]))
    return docs.join(chosen, same).withColumn(key[4], F.explode(F.sequence(F.lit(1), F.col(key[3])))).select(*[F.col(f"`{c}`") for c in docs.columns])


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes: the documents with the shard of each and its place there."""
    return splitters.sampled_splitters(docs, n_shards=8, carry=True)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("simhash_near_dedup", near_copies_go),
    ("benchmark_decontamination", benchmark_documents_go),
    ("source_mixing", sources_to_weights),
    ("sharding", shards),
]

#: Neither the learned scores nor the hashes can be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
