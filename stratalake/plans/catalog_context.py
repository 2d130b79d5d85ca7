"""Registered queries of search and context through a written index, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.core.storage import fresh_path
from stratalake.operators import context, graph, mentions, retrieval, search
from stratalake.plans import sql
from stratalake.plans.registered import query, table

TASK = "than ening"
CANDIDATES = 300


def _probe_sql(i: int, probe: str, most: int) -> str:
    """CTEs after CHUNKS that end in hits_i (chunk_id, rank): the phrase by BM25, then literal hits where those are too few."""
    return sql.bm25(probe, f"_{i}") + f"""
, fts_{i} AS (SELECT chunk_id, row_number() OVER (ORDER BY score, doc_id, chunk_id) AS r FROM bm25_{i} QUALIFY r <= {most + 1}),
low_{i} AS (SELECT doc_id, chunk_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM chunks),
like_{i} AS (SELECT chunk_id, {most + 1} + row_number() OVER (ORDER BY length(t) - length(replace(t, '{probe}', '')) DESC, length(t), doc_id, chunk_id) AS r FROM low_{i} WHERE contains(t, '{probe}') AND (SELECT count(*) FROM fts_{i}) <= {most} QUALIFY r <= {2 * most + 2}),
hits_{i} AS (SELECT chunk_id, row_number() OVER (ORDER BY min(r)) AS rank FROM (SELECT * FROM fts_{i} UNION ALL SELECT * FROM like_{i}) GROUP BY chunk_id QUALIFY rank <= {most})
"""


def _hybrid_sql(task: str, candidates: int) -> str:
    """CTEs after CHUNKS that end in scored (doc_id, chunk_id, text, score)."""
    terms = retrieval.query_terms(task)
    each = max(context.LEAST_PROBE, candidates // (1 + len(terms)))
    count = lambda c: " + ".join(f"CAST(contains({c}, '{t}') AS INT)" for t in terms)
    by_term = " UNION ALL ".join(f"SELECT * FROM hits_{i + 1}" for i in range(len(terms)))
    return "".join(_probe_sql(i, p, candidates if i == 0 else each) for i, p in enumerate([task, *terms])) + f"""
, term_hits AS (SELECT chunk_id, min(rank) AS rank FROM ({by_term}) GROUP BY chunk_id),
parts AS (SELECT doc_id, chunk_id, text, lower(text) AS low, lower(string_split(text, chr(10))[1]) AS line, a.rank AS text_rank, b.rank AS term_rank
    FROM chunks LEFT JOIN hits_0 a USING (chunk_id) LEFT JOIN term_hits b USING (chunk_id) WHERE a.rank IS NOT NULL OR b.rank IS NOT NULL),
scored AS (SELECT doc_id, chunk_id, text, least(({count('low')}) * 0.45::DOUBLE, 4.5) + least(({count('line')}) * 0.6::DOUBLE, 2.4) + CASE WHEN contains(low, '{task}') THEN 1.0 ELSE 0.0 END
    + CASE WHEN contains(line, '{task}') THEN 3.0 ELSE 0.0 END + CASE WHEN regexp_matches(line, '^\\s*\\d+(?:\\.\\d+){{0,5}}\\s*{task}') THEN 2.0 ELSE 0.0 END - 1.0
    + coalesce(61.0::DOUBLE / (60 + text_rank), 0) + coalesce(0.5::DOUBLE * 61 / (60 + term_rank), 0) AS score FROM parts)
"""


def _index(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> search.Index:
    from stratalake.plans.catalog import document_chunks

    return search.open_index(spark, search.write_index(document_chunks(spark, sf_dir), fresh_path(spark, "index"), nodes))


@query(sql.CHUNKS + _hybrid_sql(TASK, CANDIDATES) + f"SELECT doc_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INT) AS rank FROM scored QUALIFY rank <= {CANDIDATES}")
def hybrid_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task's candidates through a written index: ranks of BM25 and literal hits, fused, and the structural score."""
    index = _index(spark, sf_dir)
    found = context.hybrid_search(index, TASK, CANDIDATES, CANDIDATES)
    return context.ranked_page(found, index).withColumn("score", F.round("score", 6))


@query(
    sql.CHUNKS + _hybrid_sql(TASK, CANDIDATES) + f""", best AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS position FROM scored QUALIFY position <= {context.SEARCH_CHUNKS}),
    page AS (SELECT * FROM (SELECT *, sum(length(text)) OVER (ORDER BY position) AS used FROM best) WHERE used <= 40000),
    shown AS (SELECT 'doc:' || d.doc_id AS id FROM documents d WHERE d.lang = 'en' AND (d.doc_id || '#c0' IN (SELECT chunk_id FROM page) OR d.doc_id || '#c2' IN (SELECT chunk_id FROM page)))
    SELECT 'chunk' AS part, CAST(position AS INT) AS position, chunk_id AS id, round(score, 3) AS score FROM page UNION ALL SELECT 'entity', CAST(row_number() OVER (ORDER BY id) AS INT), id, NULL FROM shown"""
)
def context_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page for a task through a written index, with the entities that its chunks are evidence of: the English
    documents, by their first and third chunk."""
    chunk = lambda n: F.concat(F.col("doc_id"), F.lit(f"#c{n}"))
    nodes = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.lit("document").alias("kind"), F.array(chunk(0), chunk(2)).alias("source_chunk_ids"))
    page = context.document_context(_index(spark, sf_dir, nodes), TASK, "search", max_entity_chars=context.MOST_ENTITY_CHARS)
    rows = [("chunk", i + 1, c["chunk_id"], c["score"]) for i, c in enumerate(page["chunks"])] + [("entity", i + 1, e["id"], None) for i, e in enumerate(page["enrichments"])]
    return spark.createDataFrame(rows, "part string, position int, id string, score double")


# --- mentions and relations -----------------------------------------------------------------------------------------


@query(
    sql.CHUNKS + r""", firsts AS (SELECT doc_id, regexp_extract(text, '([A-Za-z]{3,})\s+([A-Za-z]{3,})', 1) AS a, regexp_extract(text, '([A-Za-z]{3,})\s+([A-Za-z]{3,})', 2) AS b FROM documents),
    names AS (SELECT doc_id, a || '_' || b AS key, lower(a || b) AS plain, true AS several FROM firsts WHERE a <> '' UNION SELECT doc_id, b, lower(b), false FROM firsts WHERE b <> '')
    SELECT n.doc_id, chunk_id, key FROM names n JOIN chunks c ON n.doc_id = c.doc_id
    WHERE CASE WHEN several THEN contains(replace(replace(lower(text), ' ', ''), '_', ''), plain) ELSE list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), plain) END"""
)
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of each document, together and the second alone, in all of its chunks."""
    from stratalake.plans.catalog import document_chunks

    word = lambda n: F.regexp_extract("text", r"([A-Za-z]{3,})\s+([A-Za-z]{3,})", n)
    firsts = table(spark, sf_dir, "documents").select("doc_id", word(1).alias("a"), word(2).alias("b")).where("a <> ''")
    names = firsts.select("doc_id", F.explode(F.array(F.concat_ws("_", "a", "b"), F.col("b"))).alias("key")).distinct()
    return mentions.mentions(document_chunks(spark, sf_dir).select("doc_id", "chunk_id", "text"), names)


@query(
    """WITH a AS (SELECT o_custkey AS c, o_orderkey AS k, 0.5::DOUBLE + (o_orderkey % 50) / 100.0::DOUBLE AS sure, 'ie::pin:Pin_' || (o_orderkey // 16 + 1000000) || '#' || o_custkey AS dst FROM orders),
    e AS (SELECT 'n' || c AS src, dst, 'drives' AS kind, max(sure) AS confidence, string_agg('o' || k, ',' ORDER BY 'o' || k) AS chunks, arg_min(sure, k) < 0.8 AS pending FROM a WHERE sure >= 0.6 AND k % 3 <> 0 GROUP BY ALL)
    SELECT src, dst, kind, round(confidence, 6) AS confidence, chunks, pending FROM e"""
)
def relations_from_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as what a model said of their customer's document: its core drives a pin, which is new, or itself."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    nodes = orders.select("o_custkey").distinct().select(F.concat(F.lit("n"), "o_custkey").alias("id"), F.lit("module").alias("kind"), F.lit("Core Unit").alias("name"), F.col("o_custkey").alias("doc_id"))
    key = F.col("o_orderkey")
    dst = F.when(key % 3 == 0, "Core_Unit").otherwise(F.concat(F.lit("Pin "), (F.floor(key / 16) + 1000000).cast("string")))
    told = F.struct(F.lit("the core unit").alias("src"), F.lit("Drives").alias("relation"), dst.alias("dst"), F.when(key % 3 != 0, "pin").alias("dst_type"), (F.lit(0.5) + (key % 50) / 100).alias("confidence"))
    answers = orders.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("o"), key).alias("chunk_id"), key.alias("place"), F.to_json(F.struct(F.array(told).alias("relations"))).alias("answer"))
    made, edges = mentions.link_relations(answers, nodes)
    joined = edges.join(made.select(F.col("id").alias("dst"), "pending"), "dst")
    return joined.select("src", "dst", "kind", F.round("confidence", 6).alias("confidence"), F.array_join("chunk_ids", ",").alias("chunks"), "pending")


# --- hierarchies ------------------------------------------------------------------------------------------------------


@query(
    sql.GRAPH + """, up AS (SELECT dst AS id, src AS above FROM edges UNION ALL SELECT up.id, e.src FROM up JOIN edges e ON e.dst = up.above),
    worth AS (SELECT 'order:' || o_orderkey AS id, o_orderkey % 1000 AS v FROM orders)
    SELECT n.id, 1 + count(up.id) AS members, CAST(coalesce(sum(w.v), 0) + coalesce(any_value(o.v), 0) AS BIGINT) AS total FROM nodes n LEFT JOIN up ON up.above = n.id LEFT JOIN worth w ON w.id = up.id LEFT JOIN worth o ON o.id = n.id GROUP BY n.id"""
)
def subtree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers and orders with the number of what lies below them, and a sum over its orders."""
    from stratalake.plans.catalog import graph_tables

    nodes, edges = graph_tables(spark, sf_dir)
    placed = nodes.join(edges.select(F.col("dst").alias("id"), F.col("src").alias("parent")), "id", "left")
    worth = F.when(F.col("kind") == "order", F.substring_index("id", ":", -1).cast("long") % 1000).otherwise(0)
    return graph.subtree_totals(placed, worth)
