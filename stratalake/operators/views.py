"""Read-side views: documents, sections as a tree, a node with its surroundings, a register with its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalake.functions.text import natural_key


def documents(docs: DataFrame, manifest: DataFrame, stats: DataFrame) -> DataFrame:
    """docs with what the manifest says of them and their counts; documents that either lacks keep nulls and zeros."""
    counts = [c for c in stats.columns if c != "doc_id"]
    return docs.join(manifest, "doc_id", "left").join(stats, "doc_id", "left").fillna(0, subset=counts)


def with_children(parents: DataFrame, edges: DataFrame, children: DataFrame, kind: str, order: list[Column]) -> DataFrame:
    """A row for each parent and child along edges of a kind, with the child's position by order."""
    e = edges.where(F.col("kind") == kind).select("src", "dst")
    found = parents.select(F.col("id").alias("parent_id")).join(e, F.col("parent_id") == F.col("src")).join(children, F.col("dst") == F.col("id")).drop("src", "dst")
    return found.withColumn("position", F.row_number().over(Window.partitionBy("parent_id").orderBy(*order)))


def chunk_evidence(wanted: DataFrame, chunks: DataFrame, blocks: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For wanted chunk ids: links (chunk_id, kind, id) to their blocks and entities, each block and entity once, and the
    ids that no chunk has."""
    have = chunks.join(wanted, "chunk_id", "left_semi")
    to_blocks = have.select("chunk_id", F.explode("block_ids").alias("id")).join(blocks.select("id"), "id", "left_semi").select("chunk_id", F.lit("block").alias("kind"), "id")
    to_nodes = nodes.select("id", F.explode("source_chunk_ids").alias("chunk_id")).join(have.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.lit("entity").alias("kind"), "id")
    links = to_blocks.unionByName(to_nodes).distinct()
    return have, links, wanted.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


#: Navigation text that isn't a section's name.
NOISE = r"(?i)^(contents|table of contents|list of (figures|tables)|index|目录|page \d+|\d+)$|\.{4,}"


def section_tree(sections: DataFrame) -> DataFrame:
    """doc_id, number, name, parent, depth and sort key from sections (doc_id, number, name, page): the best entry of each
    number, without navigation noise; the parent is the longest prefix of the number that the document has."""
    score = F.when(F.length("name").between(2, 80), 2).otherwise(0) + F.when(F.col("page").isNotNull(), 1).otherwise(0)
    kept = sections.where(~F.col("name").rlike(NOISE)).withColumn("score", score)
    best = Window.partitionBy("doc_id", "number").orderBy(F.desc("score"), F.col("page").asc_nulls_last(), "name")
    one = kept.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k", "score")
    parts = F.split("number", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    up = one.where(F.size(parts) > 1).select("doc_id", "number", F.explode(prefixes).alias("above"))
    known = one.select("doc_id", F.col("number").alias("above"))
    parent = up.join(known, ["doc_id", "above"]).groupBy("doc_id", "number").agg(F.max_by("above", F.length("above")).alias("parent"))
    return one.join(parent, ["doc_id", "number"], "left").withColumn("depth", F.size(parts)).withColumn("sort_key", natural_key(F.col("number")))


def entity_view(nodes: DataFrame) -> DataFrame:
    """The columns that are shown of an entity, and whether its source should be looked at."""
    check = F.col("status").isin("candidate", "needs_review", "conflict") | (F.coalesce("confidence", F.lit(0.0)) < 0.85) | F.coalesce(F.lower("method"), F.lit("")).rlike("llm|vlm|inferred")
    return nodes.select("id", "kind", "name", "doc_id", "status", "confidence", "method", check.alias("needs_source_check"))
