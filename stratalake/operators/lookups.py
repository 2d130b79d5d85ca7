"""Lookups in the layers: by id, by page, by conditions, by name in tiers; counts, fingerprints, deletions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalake.functions.text import blank_to_null


def scoped(df: DataFrame, doc_ids: list | None) -> DataFrame:
    """Rows of the documents: all without a list, none with an empty one."""
    return df if doc_ids is None else df.where(F.col("doc_id").isin(list(doc_ids)) if doc_ids else F.lit(False))


def with_aliases(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """nodes with the sorted aliases (node_id, alias) of each."""
    own = aliases.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return nodes.join(own, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def by_ids(df: DataFrame, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of df for wanted (pos, id), each id once at its first position; ids that df doesn't have are left out."""
    first = wanted.groupBy("id").agg(F.min("pos").alias("pos"))
    return df.join(first.withColumnRenamed("id", id_col), id_col)


def search_nodes(
    nodes: DataFrame, name: str | None = None, kind: str | None = None, doc_id=None, qualified_name: str | None = None, alias: str | None = None, aliases: DataFrame | None = None, fuzzy: str | None = None, limit: int = 100, offset: int = 0
) -> DataFrame:
    """Nodes that meet all the conditions that are given, a page in the order of name and id; fuzzy is part of a name."""
    tests = [F.col(c) == v for c, v in (("name", name), ("kind", kind), ("doc_id", doc_id), ("qualified_name", qualified_name)) if v is not None]
    if fuzzy is not None:
        tests.append(F.contains(F.lower("name"), F.lit(fuzzy.lower())) | F.contains(F.lower("qualified_name"), F.lit(fuzzy.lower())))
    found = reduce(lambda df, t: df.where(t), tests, nodes)
    if alias is not None:
        found = found.join(aliases.where(F.col("alias") == alias).select(F.col("node_id").alias("id")), "id", "left_semi")
    return found.orderBy("name", "id").offset(offset).limit(limit)


def search_edges(edges: DataFrame, among: DataFrame | None = None, kinds: list[str] | None = None, below: float | None = None, limit: int | None = None) -> DataFrame:
    """Edges with both ends among ids, of some kinds, with less than a confidence (null counts as 1), the least sure first."""
    found = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    if among is not None:
        found = found.join(among.select(F.col("id").alias("src")), "src", "left_semi").join(among.select(F.col("id").alias("dst")), "dst", "left_semi")
    sure = F.coalesce("confidence", F.lit(1.0))
    if below is not None:
        found = found.where(sure < below)
    return found if limit is None else found.orderBy(sure, "src", "dst", "kind").limit(limit)


def page_blocks(blocks: DataFrame, doc_id, page: int) -> DataFrame:
    return blocks.where((F.col("doc_id") == doc_id) & (F.col("page") == page)).orderBy("reading_order")


def first_match(nodes: DataFrame, name: str, kind: str | None = None, limit: int = 3) -> DataFrame:
    """Nodes (of a kind) of a name, else those that hold it as part of theirs, with tier; `limit` at most, by name and id."""
    low = F.lower("name")
    tier = F.when(F.col("name") == name, 1).when(F.contains(low, F.lit(name.lower())), 2)
    found = nodes if kind is None else nodes.where(F.col("kind") == kind)
    top = found.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", "name", "id").limit(limit)
    # At most `limit` rows are left here.
    return top.withColumn("best", F.min("tier").over(Window.partitionBy())).where("tier = best").drop("best")


def term_match(terms: DataFrame, aliases: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Glossary terms that hold a term in name or full form, with tier 1, else those of which it is an alias, with tier 2."""
    part = F.contains(F.lower("name"), F.lit(term.lower())) | F.contains(F.lower(F.coalesce("full", F.lit(""))), F.lit(term.lower()))
    named = terms.where(part).withColumn("tier", F.lit(1))
    known = terms.join(aliases.where(F.lower("alias") == term.lower()).select(F.col("node_id").alias("id")), "id", "left_semi").withColumn("tier", F.lit(2))
    top = named.unionByName(known).orderBy("tier", "name", "id").limit(limit)
    return top.withColumn("best", F.min("tier").over(Window.partitionBy())).where("tier = best").drop("best")


def outline(sections: DataFrame, limit: int | None = None) -> DataFrame:
    """Sections of documents by page, those without one last, path, name and id."""
    order = [F.coalesce("page", F.lit(10**9)), F.col("path").asc_nulls_first(), F.col("name"), F.col("id")]
    ranked = sections.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    return ranked if limit is None else ranked.where(F.col("position") <= limit)


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """df without the rows whose keys gone has."""
    return df.join(gone.select(keys), keys, "left_anti")


def counts_by_kind(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """layer, kind and n of nodes and edges, with a row for each layer in all (kind null)."""
    of = lambda df, layer: df.groupBy("kind").agg(F.count("*").alias("n")).unionByName(df.agg(F.count("*").alias("n")).withColumn("kind", F.lit(None).cast("string"))).select(F.lit(layer).alias("layer"), "kind", "n")
    return of(nodes, "nodes").unionByName(of(edges, "edges"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n and a hash that changes with any row, in any order: 32-bit pieces of the rows' SHA-256 are added up."""
    h = F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in columns]).cast("binary"), 256)
    piece = lambda at: F.coalesce(F.sum(F.conv(F.substring(h, at, 8), 16, 10).cast("long")), F.lit(0)).cast("string")
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", piece(1), piece(9), piece(17), piece(25)).cast("binary"), 256).alias("fingerprint"))


def recovered_section(nodes: DataFrame, chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """nodes (id, section_path, chunk_ids, block_ids) with section: their own, else that of their first chunk (id,
    section_path) that has one, else of their first block."""
    def first(ids: str, there: DataFrame, name: str) -> DataFrame:
        own = nodes.where(blank_to_null(F.col("section_path")).isNull()).select("id", F.posexplode(ids).alias("pos", "ref"))
        known = there.where(blank_to_null(F.col("section_path")).isNotNull()).select(F.col("id").alias("ref"), F.col("section_path").alias("p"))
        return own.join(known, "ref").groupBy("id").agg(F.min_by("p", "pos").alias(name))

    out = nodes.join(first("chunk_ids", chunks, "of_chunk"), "id", "left").join(first("block_ids", blocks, "of_block"), "id", "left")
    return out.withColumn("section", F.coalesce(blank_to_null(F.col("section_path")), "of_chunk", "of_block")).drop("of_chunk", "of_block")


def chunk_view(chunks: DataFrame) -> DataFrame:
    """What is shown of a chunk: pages default to its first one, text to nothing."""
    page = F.coalesce("page_start", "page")
    return chunks.select("id", "doc_id", "kind", "page", page.alias("page_start"), F.coalesce("page_end", page).alias("page_end"), F.coalesce("text", F.lit("")).alias("text"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))


def instance_key(doc_id: Column) -> Column:
    """What tells documents of one chip: a model that the document's name holds, else its family."""
    from stratalake.functions.text import chip_model, doc_name

    return F.coalesce(chip_model(doc_name(doc_id)), F.substring_index(doc_id, "::", 1))
