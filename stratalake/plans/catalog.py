"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.core.ranks import with_global_rank
from stratalake.core.storage import fresh_path
from stratalake.functions import text as T
from stratalake.operators import audits, blocks, chunks, extract, graph, incremental, models, retrieval, views
from stratalake.operators.vectors import VectorTable
from stratalake.plans import registered, sql
from stratalake.sources import layout

PHRASE = "of the"

_query = registered.query
table = registered.table


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.line_chunks(table(spark, sf_dir, "documents"))


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers, suppliers and orders as nodes; contains and references edges."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string"))
    node = lambda df, kind, c, name: df.select(key(kind, c).alias("id"), F.lit(kind).alias("kind"), name.alias("name"))
    edge = lambda df, a, b, kind: df.select(key(*a).alias("src"), key(*b).alias("dst"), F.lit(kind).alias("kind"))
    nodes = (
        node(t("region"), "region", "r_regionkey", F.col("r_name")).unionByName(node(t("nation"), "nation", "n_nationkey", F.col("n_name"))).unionByName(node(t("customer"), "customer", "c_custkey", F.col("c_name")))
        .unionByName(node(t("supplier"), "supplier", "s_suppkey", F.col("s_name"))).unionByName(node(t("orders"), "order", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))))
    )
    edges = (
        edge(t("nation"), ("region", "n_regionkey"), ("nation", "n_nationkey"), "contains").unionByName(edge(t("customer"), ("nation", "c_nationkey"), ("customer", "c_custkey"), "contains"))
        .unionByName(edge(t("supplier"), ("nation", "s_nationkey"), ("supplier", "s_suppkey"), "contains")).unionByName(edge(t("orders"), ("customer", "o_custkey"), ("order", "o_orderkey"), "references"))
    )
    return nodes, edges


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks, ranked by BM25, cut to a budget of characters."""
    c = document_chunks(spark, sf_dir)
    ranked = retrieval.bm25_phrase(c, PHRASE, 20)
    page = ranked.join(c.select("chunk_id", "text"), "chunk_id")
    return retrieval.within_budget(page, ["score", "doc_id", "chunk_id"], 20_000, 20).select("doc_id", "chunk_id", "tf", F.round("score", 6).alias("score"), "position")


# --- L0 -------------------------------------------------------------------------------------------------------------


@_query(sql.BLOCKS + "SELECT id, doc_id, page, CAST(reading_order AS INTEGER) AS reading_order, kind, text FROM blocks")
def l0_blocks_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.text_blocks(table(spark, sf_dir, "documents"))


@_query(sql.BLOCKS + "SELECT kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM blocks GROUP BY kind")
def l0_block_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.text_blocks(table(spark, sf_dir, "documents")).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@_query(
    sql.BLOCKS
    + ", q AS (SELECT doc_id, page, CAST(sum(length(text)) AS BIGINT) AS text_chars, count(*) AS text_blocks, count(*) FILTER (kind = 'table') AS tables, "
    + ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS {name}" for name, p in blocks.PAGE_HITS.items())
    + """ FROM blocks GROUP BY doc_id, page),
    r AS (SELECT *, text_chars > 20 AS has_text_layer, concat_ws(',', CASE WHEN text_chars < 80 THEN 'scan_like_no_text' END, CASE WHEN register_hits >= 1 AND table_hits >= 1 AND tables = 0 THEN 'register_with_table' END,
      CASE WHEN pin_hits >= 1 AND table_hits >= 1 AND tables = 0 THEN 'pin_with_table' END, CASE WHEN timing_hits >= 1 AND table_hits >= 1 AND tables = 0 THEN 'timing_with_table' END) AS reasons FROM q)
    SELECT *, reasons <> '' AS needs_look FROM r"""
)
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.page_quality(blocks.text_blocks(table(spark, sf_dir, "documents")))


@_query(
    r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
    s AS (SELECT page_id, string_split(regexp_replace(h, '(?i)(</?(?:h[1-6]|p|li|ul|ol|article|nav|footer|div|body)(?:\s[^>]*)?>)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM c),
    k AS (SELECT page_id, list_filter(parts, lambda x: regexp_matches(x, '(?is)^<(?:h[1-6]|p|li)(?:\s[^>]*)?>')) AS f FROM s),
    r AS (SELECT page_id, unnest(f) AS raw, generate_subscripts(f, 1) - 1 AS reading_order FROM k),
    t AS (SELECT page_id, CAST(reading_order AS INTEGER) AS reading_order, lower(regexp_extract(raw, '^<([A-Za-z0-9]+)', 1)) AS tag,
      replace(replace(replace(replace(trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS text FROM r)
    SELECT page_id, reading_order, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'li' THEN 'list' ELSE 'paragraph' END AS kind, CASE WHEN tag LIKE 'h%' THEN CAST(substr(tag, 2, 1) AS INTEGER) END AS heading_level, text FROM t WHERE text <> ''"""
)
def l0_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.html_blocks(table(spark, sf_dir, "pages"))


# --- L1 -------------------------------------------------------------------------------------------------------------


@_query(sql.CHUNKS + "SELECT chunk_id, doc_id, CAST(part AS INTEGER) AS part, CAST(first_line AS INTEGER) AS first_line, text FROM chunks")
def l1_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chunks(spark, sf_dir)


@_query("SELECT doc_id, CAST(i AS INTEGER) AS part, substr(text, CAST(i * 2000 + 1 AS BIGINT), 2000) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(floor(greatest(length(text) - 1, 0) / 2000) AS BIGINT) + 1)) AS i FROM documents)")
def chunk_hard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.hard_split(F.col("text"), 2000)).alias("part", "piece"))


@_query(
    r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([。！？；!?.])\s+', '\1' || chr(1), 'g'), '\n\s*', chr(10) || chr(1), 'g'), chr(1)) AS p FROM documents),
    u AS (SELECT doc_id, unnest(p) AS sentence FROM s) SELECT doc_id, count(*) AS sentences, CAST(sum(length(trim(sentence, ' ' || chr(10)))) AS BIGINT) AS chars, max(length(trim(sentence, ' ' || chr(10)))) AS longest FROM u WHERE trim(sentence, ' ' || chr(10)) <> '' GROUP BY doc_id"""
)
def chunk_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.split_sentences(F.col("text"))).alias("s")).select("doc_id", F.length(F.regexp_replace("s", r"^[ \n]+|[ \n]+$", "")).cast("long").alias("n")).where("n > 0")
    return parts.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum("n").alias("chars"), F.max("n").alias("longest"))


@_query(
    sql.CHUNKS
    + """, h AS (SELECT *, sha256(chunk_id || chr(0) || text) AS x FROM chunks)
    SELECT count(*) AS chunk_count, CAST(sum(length(text)) AS BIGINT) AS total_chars, count(DISTINCT doc_id) AS document_count,
    sha256(concat_ws(':', """
    + ", ".join(f"CAST(CAST(sum(CAST(('0x' || substr(x, {i}, 8)) AS BIGINT)) AS BIGINT) AS VARCHAR)" for i in (1, 9, 17, 25))
    + ")) AS snapshot FROM h"
)
def chunk_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.corpus_stats(document_chunks(spark, sf_dir))


@_query(sql.CHUNKS + "SELECT doc_id, chunk_id, length(text) AS chars FROM chunks WHERE (doc_id, chunk_id) > (100, '100#c0') ORDER BY doc_id, chunk_id LIMIT 100")
def chunk_page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = retrieval.keyset_page(document_chunks(spark, sf_dir), ["doc_id", "chunk_id"], (100, "100#c0"), 100)
    return page.select("doc_id", "chunk_id", F.length("text").cast("long").alias("chars"))


# --- retrieval ------------------------------------------------------------------------------------------------------


@_query(sql.CHUNKS + sql.bm25("than") + "SELECT doc_id, chunk_id, tf, round(score, 6) AS score FROM bm25 ORDER BY bm25.score, doc_id, chunk_id LIMIT 20")
def fts_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_phrase(document_chunks(spark, sf_dir), "than", 20).withColumn("score", F.round("score", 6))


@_query(sql.CHUNKS + sql.bm25(PHRASE) + "SELECT doc_id, chunk_id, tf, round(score, 6) AS score FROM bm25")
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_phrase(document_chunks(spark, sf_dir), PHRASE, None).withColumn("score", F.round("score", 6))


@_query(sql.CHUNKS + f", t AS (SELECT chunk_id, unnest({sql.tokens('text')}) AS term FROM chunks) SELECT term, chunk_id, count(*) AS tf FROM t GROUP BY ALL")
def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.postings(document_chunks(spark, sf_dir))


@_query(
    sql.CHUNKS
    + """, l AS (SELECT doc_id, chunk_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM chunks)
    SELECT doc_id, chunk_id, length(t) - length(replace(t, 'ing in', '')) AS matched, length(t) AS text_length FROM l WHERE contains(t, 'ing in') ORDER BY matched DESC, text_length, doc_id, chunk_id LIMIT 50"""
)
def like_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.substring_hits(document_chunks(spark, sf_dir), "Ing In", 50)


@_query(
    "WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM conversations), "
    "f AS (SELECT conv_id, turn, list_filter(w, lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS) + ")) AS w FROM t), "
    "d AS (SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM f) SELECT conv_id, turn, array_to_string(list_slice(w, 1, 12), ' ') AS terms FROM d"
)
def retrieval_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(retrieval.latin_terms(F.col("text")), " ").alias("terms"))


def _rrf_sql() -> str:
    probes = [("than", 1.0), ("ening", 0.5), ("ofer", 0.5)]
    ctes = "".join(sql.bm25(p, f"_{i}") for i, (p, _) in enumerate(probes))
    ranked = " UNION ALL ".join(f"SELECT chunk_id, '{'text' if not i else 'term'}' AS channel, {w}::DOUBLE AS weight, row_number() OVER (ORDER BY score, doc_id, chunk_id) AS rank FROM bm25_{i}" for i, (_, w) in enumerate(probes))
    return (
        sql.CHUNKS + ctes + f", ranked AS ({ranked}), best AS (SELECT chunk_id, channel, min(rank) AS rank, max(weight) AS weight FROM ranked GROUP BY chunk_id, channel) "
        "SELECT chunk_id, round(sum(weight * 61 / (60 + rank)), 6) AS score FROM best GROUP BY chunk_id"
    )


@_query(_rrf_sql())
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks of three probes; each probe's chunks are ranked over range partitions."""
    probes = [("than", 1.0), ("ening", 0.5), ("ofer", 0.5)]
    counts, _ = retrieval.phrase_counts(document_chunks(spark, sf_dir), [p for p, _ in probes])
    ranked = None
    for i, (_, weight) in enumerate(probes):
        one = with_global_rank(retrieval.bm25_scores(counts, i), ["score", "doc_id", "chunk_id"]).select("chunk_id", F.lit("text" if i == 0 else "term").alias("channel"), F.lit(weight).alias("weight"), (F.col("rank") + 1).alias("rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return retrieval.fuse(ranked).withColumn("score", F.round("score", 6))


@_query(
    sql.CHUNKS + sql.bm25(PHRASE) + """, top AS (SELECT * FROM bm25 ORDER BY score, doc_id, chunk_id LIMIT 20),
    p AS (SELECT t.doc_id, t.chunk_id, tf, score, length(text) AS n FROM top t JOIN chunks USING (chunk_id)),
    w AS (SELECT *, sum(n) OVER (ORDER BY score, doc_id, chunk_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (ORDER BY score, doc_id, chunk_id) AS position FROM p)
    SELECT doc_id, chunk_id, tf, round(score, 6) AS score, CAST(position AS INTEGER) AS position FROM w WHERE used <= 20000 AND position <= 20"""
)
def context_search_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@_query(
    sql.CHUNKS + ", o AS (SELECT * FROM chunks ORDER BY doc_id, chunk_id LIMIT 81), w AS (SELECT *, sum(length(text)) OVER (ORDER BY doc_id, chunk_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (ORDER BY doc_id, chunk_id) AS position FROM o) "
    "SELECT doc_id, chunk_id, CAST(position AS INTEGER) AS position, CAST(used AS BIGINT) AS used FROM w WHERE used <= 40000 AND position <= 80"
)
def context_full_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = retrieval.keyset_page(document_chunks(spark, sf_dir), ["doc_id", "chunk_id"], None, 81)
    return retrieval.within_budget(page, ["doc_id", "chunk_id"], 40_000, 80).select("doc_id", "chunk_id", "position", "used")


# --- vectors --------------------------------------------------------------------------------------------------------

_NEAR = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])), 6) AS similarity FROM q, embeddings {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
"""


def _vector_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@_query(_NEAR.format(where="") + "SELECT query_id, id, similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector, for the stated query set: each row whose id is divisible by 50."""
    return retrieval.nearest(*_vector_queries(spark, sf_dir), k=10)


@_query(_NEAR.format(where="WHERE label = 3") + "SELECT query_id, id, similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def vector_scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, queries = _vector_queries(spark, sf_dir)
    return retrieval.nearest(vectors, queries, k=10, allowed=vectors.where("label = 3").select("vec_id"))


def _stored_vectors(spark: SparkSession, sf_dir: str) -> tuple[VectorTable, DataFrame]:
    """All embeddings in a vector table after three states: a fifth of them is stored with another vector at first, as are
    items that are gone later; then all come by their hashes, and the gone ones are pruned."""
    rows, queries = _vector_queries(spark, sf_dir)
    items = rows.select(F.col("vec_id").alias("item_id"), F.sha2(F.col("embedding").cast("string").cast("binary"), 256).alias("content_hash"), F.col("embedding").alias("vector"))
    old = items.where("item_id % 5 = 0").withColumns({"content_hash": F.lit("old"), "vector": F.reverse("vector")})
    gone = items.where("item_id % 5 = 1").withColumn("item_id", -F.col("item_id") - 1)
    stored = VectorTable(spark, fresh_path(spark, "vectors"), "item", "given", 64)
    stored.upsert(items.where("item_id % 5 > 1").unionByName(old).unionByName(gone))
    stored.upsert(items)
    stored.prune(items)
    return stored, queries


@_query(_NEAR.format(where="") + "SELECT query_id, id, similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def vector_table_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by a stored table of vectors: cells that can't hold one of them aren't read."""
    stored, queries = _stored_vectors(spark, sf_dir)
    return stored.search(queries, 10)


@_query(None)
def vector_table_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest within as many cells as nine tenths of them need, as measured on stored vectors; recall is tested."""
    stored, queries = _stored_vectors(spark, sf_dir)
    return stored.search(queries, 10, probes=stored.tune(10, 0.9), exact=False)


@_query(_NEAR.format(where="") + ", v AS (SELECT query_id, label, count(*) AS n, sum(similarity) AS s FROM r JOIN embeddings ON vec_id = id WHERE rank <= 10 AND id <> query_id GROUP BY ALL) SELECT query_id, CAST(arg_max(label, n * 1000 + s) AS INTEGER) AS label FROM v GROUP BY query_id")
def vector_label_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, queries = _vector_queries(spark, sf_dir)
    near = retrieval.nearest(vectors, queries, k=10).where("id <> query_id").join(vectors.select(F.col("vec_id").alias("id"), "label"), "id")
    votes = near.groupBy("query_id", "label").agg(F.count("*").alias("n"), F.sum("similarity").alias("s"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.col("n") * 1000 + F.col("s")).cast("int").alias("label"))


@_query(
    r"""WITH w AS (SELECT part.p_partkey AS p_partkey, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+')) AS w FROM part),
    h AS (SELECT p_partkey, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) AS h FROM w),
    s AS (SELECT p_partkey, h % 256 AS bucket, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY ALL HAVING sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) <> 0),
    n AS (SELECT p_partkey, sqrt(sum(v * v)) AS norm FROM s GROUP BY p_partkey) SELECT p_partkey, bucket, round(CAST(v / norm AS DOUBLE), 6) AS value FROM s JOIN n USING (p_partkey)"""
)
def hash_encode_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hash_encode(table(spark, sf_dir, "part"), "p_partkey", "p_name").withColumn("value", F.round("value", 6))


@_query(
    """WITH d AS (SELECT doc_id AS item_id, sha256(coalesce(text, '')) AS h FROM documents WHERE source <> 'src0'), s AS (SELECT doc_id AS item_id, sha256(CASE WHEN lang = 'de' THEN 'old' ELSE coalesce(text, '') END) AS h FROM documents WHERE lang <> 'fr')
    SELECT coalesce(d.item_id, s.item_id) AS item_id, CASE WHEN s.item_id IS NULL THEN 'missing' WHEN d.item_id IS NULL THEN 'prune' ELSE 'stale' END AS action FROM d FULL JOIN s ON d.item_id = s.item_id WHERE d.h IS DISTINCT FROM s.h"""
)
def embed_stale_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hashed = lambda df, c: df.select(F.col("doc_id").alias("item_id"), F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256).alias("content_hash"))
    return retrieval.stale_items(hashed(docs.where("source <> 'src0'"), F.col("text")), hashed(docs.where("lang <> 'fr'"), F.when(F.col("lang") == "de", "old").otherwise(F.col("text"))))


# --- graph ----------------------------------------------------------------------------------------------------------


@_query(
    sql.GRAPH + """, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    l1 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a = 'nation:3'), l2 AS (SELECT DISTINCT b AS id FROM both_ways JOIN l1 ON a = l1.id WHERE b <> 'nation:3' AND b NOT IN (SELECT id FROM l1)),
    lv AS (SELECT 'nation:3' AS id, 0 AS level UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2)
    SELECT id, kind, name, CAST(level AS INTEGER) AS level FROM lv JOIN nodes USING (id) ORDER BY level, id LIMIT 500"""
)
def graph_neighbors_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(*graph_tables(spark, sf_dir), "nation:3", depth=2, limit=500)[0]


@_query(
    sql.GRAPH + ", walk AS (SELECT id AS root, id, 0 AS level FROM nodes WHERE kind = 'region' UNION ALL SELECT root, dst, level + 1 FROM walk JOIN edges ON src = walk.id WHERE level < 3) SELECT root, id, CAST(level AS INTEGER) AS level FROM walk"
)
def graph_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything below each region, three steps down."""
    nodes, edges = graph_tables(spark, sf_dir)
    return graph.reachable(edges, nodes.where("kind = 'region'").select("id"), 3, directed=True)


@_query(
    sql.GRAPH + """, pairs AS (SELECT 'region:' || (c_nationkey % 5) AS from_id, 'customer:' || c_custkey AS to_id FROM customer),
    walk AS (SELECT DISTINCT from_id, from_id AS id, 0 AS length, from_id AS path FROM pairs UNION ALL SELECT from_id, dst, length + 1, path || '>' || dst FROM walk JOIN edges ON src = walk.id WHERE length < 5 AND edges.kind = 'contains')
    SELECT pairs.from_id, to_id, CAST(length AS INTEGER) AS length, path FROM pairs JOIN walk ON walk.from_id = pairs.from_id AND walk.id = to_id"""
)
def graph_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths from a region to each customer, where it lies below that region."""
    _, edges = graph_tables(spark, sf_dir)
    pairs = table(spark, sf_dir, "customer").select(F.concat(F.lit("region:"), (F.col("c_nationkey") % 5).cast("string")).alias("from_id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("to_id"))
    return graph.trace(edges.where("kind = 'contains'"), pairs).withColumn("path", F.array_join("path", ">"))


@_query(
    sql.GRAPH + """, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), l1 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a = 'customer:7'), l2 AS (SELECT DISTINCT b AS id FROM both_ways JOIN l1 ON a = l1.id WHERE b <> 'customer:7' AND b NOT IN (SELECT id FROM l1)),
    lv AS (SELECT id, 1 AS level FROM l1 UNION ALL SELECT id, 2 FROM l2), top AS (SELECT lv.id, kind, level FROM lv JOIN nodes ON lv.id = nodes.id ORDER BY level, lv.id LIMIT 499)
    SELECT kind, CAST(level AS INTEGER) AS level, count(*) AS n FROM top GROUP BY ALL"""
)
def graph_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(*graph_tables(spark, sf_dir), "customer:7").groupBy("kind", "level").agg(F.count("*").alias("n"))


@_query(
    sql.GRAPH + """, k AS (SELECT count(DISTINCT kind) AS k FROM nodes), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name, id) AS rn FROM nodes),
    s AS (SELECT id, kind, name, CAST(rn AS INTEGER) AS rn FROM r, k ORDER BY CASE WHEN rn <= 500 // k THEN 0 ELSE 1 END, kind, rn LIMIT 500) SELECT * FROM s"""
)
def quota_graph_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.quota_sample(*graph_tables(spark, sf_dir), 500)[0]


@_query("SELECT 'region:' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name, 1 AS level FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, n_name, 2 FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, c_name, 3 FROM customer")
def outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of an outline (regions, nations, customers) from levels and positions alone."""
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    n = nation.select("n_nationkey", "n_regionkey")
    r = region.select(F.col("r_regionkey").alias("top"), F.lit(1).alias("level"), F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit(-1).alias("mid"), F.lit(-1).cast("long").alias("low"))
    m = nation.select(F.col("n_regionkey").alias("top"), F.lit(2).alias("level"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("mid"), F.lit(-1).cast("long").alias("low"))
    c = customer.join(n, customer["c_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").alias("top"), F.lit(3).alias("level"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("mid"), F.col("c_custkey").alias("low"))
    toc = r.unionByName(m).unionByName(c).withColumn("doc_id", F.col("top")).withColumn("pos", F.struct("mid", "low"))
    return graph.section_parents(toc).select("id", "parent", "name", "level")


_PARTS = "SELECT 'part:' || p_partkey AS id, p_type AS kind, p_name AS name, split_part(p_brand, '#', 2) AS instance, p_size AS priority, CAST(p_partkey % 7 AS INTEGER) AS page FROM part"


def _part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("instance"),
        F.col("p_size").alias("priority"), (F.col("p_partkey") % 7).cast("int").alias("page"),
    )


@_query(
    f"WITH p AS ({_PARTS}), k AS (SELECT *, upper(regexp_replace(split_part(name, ' ', 1), '[\\s_\\-./]+', '', 'g')) AS name_key FROM p), "
    "r AS (SELECT *, first_value(id) OVER (PARTITION BY name_key, instance, kind ORDER BY -priority, CASE WHEN page = 0 THEN 9999 ELSE page END, length(split_part(name, ' ', 1)), id) AS top FROM k) "
    "SELECT id AS src, top AS dst, 'alias_of' AS kind, 0.95::DOUBLE AS confidence, name_key FROM r WHERE id <> top"
)
def entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one first word, brand and type are one entity."""
    nodes = _part_nodes(spark, sf_dir)
    return graph.alias_edges(nodes.withColumn("name", F.split_part("name", F.lit(" "), F.lit(1))))


@_query(
    f"WITH p AS ({_PARTS}), k AS (SELECT *, upper(split_part(name, ' ', 1)) AS key, page AS doc_id FROM p), g AS (SELECT key, instance, kind FROM k GROUP BY ALL HAVING count(DISTINCT doc_id) > 1), "
    "r AS (SELECT k.*, first_value(id) OVER w AS top, first_value(priority) OVER w AS top_prio FROM k JOIN g USING (key, instance, kind) WINDOW w AS (PARTITION BY key, instance, kind ORDER BY -priority, CAST(substr(id, 6) AS BIGINT), id)) "
    "SELECT top AS src, id AS dst, CASE WHEN top_prio > priority THEN 'supersedes' ELSE 'alias_of' END AS kind, CASE WHEN top_prio > priority THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM r WHERE id <> top"
)
def federation_supersedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _part_nodes(spark, sf_dir).withColumn("qualified_name", F.split_part("name", F.lit(" "), F.lit(1))).withColumn("doc_id", F.col("page")).withColumn("seq", F.substring("id", 6, 20).cast("long"))
    return graph.federation_edges(nodes)


@_query(
    """WITH m AS (SELECT n_regionkey AS doc_id, 'map:' || n_nationkey AS id, printf('0x%08x', (n_nationkey + 1) * 65536) AS address FROM nation),
    r AS (SELECT n_regionkey AS doc_id, 'reg:' || s_suppkey AS id, printf('0x%08x', (s_nationkey + 1) * 65536 + s_suppkey * 4) AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    j AS (SELECT r.id AS src, m.id AS dst, substr(m.address, 3) AS b, substr(r.address, 3) AS a FROM r JOIN m USING (doc_id)),
    k AS (SELECT *, greatest(4, length(b) - length(regexp_extract(b, '0*$'))) AS n FROM j) SELECT src, dst, 'contained_in' AS kind FROM k WHERE substr(a, 1, n) = substr(b, 1, n)"""
)
def contained_in_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of suppliers as registers under those of nations as memory maps, in a region's document."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    address = lambda c: F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(c), 8, "0")))
    maps = nation.select(F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("map:"), F.col("n_nationkey").cast("string")).alias("id"), address(((F.col("n_nationkey") + 1) * 65536).cast("long")).alias("address"))
    regs = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("reg:"), F.col("s_suppkey").cast("string")).alias("id"), address(((F.col("s_nationkey") + 1) * 65536 + F.col("s_suppkey") * 4).cast("long")).alias("address"))
    return graph.contained_in(maps, regs)


_EDGES = "SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, l_returnflag AS kind, l_discount AS confidence, l_linestatus AS extractor, l_linenumber AS seq FROM lineitem"


def _line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("kind"),
        F.col("l_discount").alias("confidence"), F.col("l_linestatus").alias("extractor"), F.col("l_linenumber").alias("seq"),
    )


@_query(f"WITH e AS ({_EDGES}), f AS (SELECT src, dst, kind, extractor, min(seq) AS seq FROM e GROUP BY ALL), x AS (SELECT src, dst, kind, string_agg(extractor, '+' ORDER BY seq, extractor) AS extractor FROM f GROUP BY ALL) SELECT src, dst, kind, max(confidence) AS confidence, any_value(x.extractor) AS extractor, count(*) AS observations FROM e JOIN x USING (src, dst, kind) GROUP BY src, dst, kind")
def edge_merge_max_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_edges(_line_edges(spark, sf_dir))


@_query(
    """WITH o AS (SELECT 'part:' || l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity > 10 THEN 'q' || CAST(l_quantity AS BIGINT) ELSE '' END AS name, CASE WHEN l_tax > 0.04 THEN l_linestatus END AS summary, md5(CAST(l_orderkey AS VARCHAR)) AS hash,
      CASE l_returnflag WHEN 'A' THEN 'rejected' WHEN 'N' THEN 'candidate' ELSE 'fact' END AS status, l_discount AS confidence FROM lineitem),
    r AS (SELECT *, CASE status WHEN 'rejected' THEN 0 WHEN 'candidate' THEN 1 ELSE 3 END AS k FROM o)
    SELECT id, arg_min(name, seq) FILTER (name <> '') AS name, arg_min(summary, seq) FILTER (summary <> '') AS summary, arg_max(hash, seq) AS hash, CASE max(k) WHEN 0 THEN 'rejected' WHEN 1 THEN 'candidate' ELSE 'fact' END AS status, max(confidence) AS confidence, count(*) AS observations FROM r GROUP BY id"""
)
def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations of parts."""
    none = F.array().cast("array<string>")
    seen = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.when(F.col("l_quantity") > 10, F.concat(F.lit("q"), F.col("l_quantity").cast("long").cast("string"))).otherwise("").alias("name"), F.when(F.col("l_tax") > 0.04, F.col("l_linestatus")).alias("summary"),
        F.md5(F.col("l_orderkey").cast("string").cast("binary")).alias("hash"), F.when(F.col("l_returnflag") == "A", "rejected").when(F.col("l_returnflag") == "N", "candidate").otherwise("fact").alias("status"),
        F.col("l_discount").alias("confidence"), none.alias("aliases"), none.alias("block_ids"),
    )
    return graph.merge_nodes(seen).drop("aliases", "block_ids")


@_query(
    sql.BLOCKS + r""", s AS (SELECT id AS src, doc_id, text FROM blocks), r AS (
    SELECT src, doc_id, 'section' AS target_kind, unnest(regexp_extract_all(text, '(?i)(?:section|sec\.|§|章节)\s+([0-9]+(?:\.[0-9]+){0,4})', 1)) AS target_key FROM s
    UNION SELECT src, doc_id, 'section', unnest(regexp_extract_all(text, '(?i)(?:chapter|chap\.|第)\s*([0-9]+(?:\.[0-9]+){0,2})\s*章?', 1)) FROM s
    UNION SELECT src, doc_id, 'figure', unnest(regexp_extract_all(text, '(?i)(?:figure|fig\.?|图)\s*([0-9A-Z]+(?:[-.][0-9]+){0,2})', 1)) FROM s
    UNION SELECT src, doc_id, 'table', unnest(regexp_extract_all(text, '(?i)(?:table|tbl\.?|表)\s*([0-9A-Z]+(?:[-.][0-9]+){0,2})', 1)) FROM s) SELECT * FROM r"""
)
def xref_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.references(blocks.text_blocks(table(spark, sf_dir, "documents")))


# --- audits ---------------------------------------------------------------------------------------------------------


@_query(
    sql.CHUNKS + ", " + sql.BLOCKS.strip()[5:].replace("raw AS", "raw_b AS").replace("FROM raw ", "FROM raw_b ") + """, b AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (kind = 'heading') AS headings, count(*) FILTER (kind = 'list') AS lists, count(*) FILTER (kind = 'table') AS tables FROM blocks GROUP BY doc_id),
    c AS (SELECT doc_id, count(*) AS chunks, count(*) FILTER (trim(text) = '') AS empty_chunks, max(length(text)) AS longest FROM chunks GROUP BY doc_id)
    SELECT doc_id, coalesce(blocks, 0) AS blocks, coalesce(headings, 0) AS headings, coalesce(lists, 0) AS lists, coalesce(tables, 0) AS tables, coalesce(chunks, 0) AS chunks, coalesce(empty_chunks, 0) AS empty_chunks, coalesce(longest, 0) AS longest FROM b FULL JOIN c USING (doc_id)"""
)
def audit_doc_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return audits.layer_counts(blocks.text_blocks(docs), chunks.line_chunks(docs))


@_query("WITH d AS (SELECT doc_id FROM labels UNION SELECT o_orderkey FROM orders), c AS (SELECT DISTINCT doc_id FROM documents WHERE trim(text) <> '') SELECT 'error' AS severity, 'l0.empty_doc' AS code, doc_id, 1::BIGINT AS n FROM d WHERE doc_id NOT IN (SELECT doc_id FROM c) UNION ALL SELECT 'error', 'l1.empty_doc', doc_id, 1 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM c)")
def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, and orders as documents that the layers may lack, against the layers of all documents."""
    docs = table(spark, sf_dir, "documents")
    named = table(spark, sf_dir, "labels").select("doc_id").unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")))
    return audits.layer_issues(named, blocks.text_blocks(docs), chunks.line_chunks(docs))


@_query(
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS low, epoch_us(ts) + CAST(floor(value * 1000000000) AS BIGINT) AS high FROM events), p AS (SELECT *, lag(event_id) OVER w AS prev_id, lag(high) OVER w AS prev_high FROM e WINDOW w AS (PARTITION BY user_id ORDER BY low, high, event_id))
    SELECT user_id, event_id AS id, prev_id FROM p WHERE low <= prev_high"""
)
def audit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of a user: those that begin before the one before has ended."""
    low = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", low.alias("low"), (low + F.floor(F.col("value") * 1_000_000_000).cast("long")).alias("high"))
    return audits.overlaps(e, "user_id", "low", "high", "event_id")


@_query(
    """WITH e AS (SELECT DISTINCT CAST(quality AS VARCHAR) AS kind, doc_id FROM labels), a AS (SELECT DISTINCT CASE WHEN n_chars >= 800 THEN '1' ELSE '0' END AS kind, doc_id FROM documents),
    j AS (SELECT coalesce(e.kind, a.kind) AS kind, e.doc_id AS e, a.doc_id AS a FROM e FULL JOIN a ON e.kind = a.kind AND e.doc_id = a.doc_id), c AS (SELECT kind, count(*) FILTER (e IS NOT NULL AND a IS NOT NULL) AS tp, count(*) FILTER (e IS NULL) AS fp, count(*) FILTER (a IS NULL) AS fn FROM j GROUP BY kind),
    p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0::DOUBLE ELSE round(tp::DOUBLE / (tp + fp), 4) END AS precision, CASE WHEN tp + fn = 0 THEN 0::DOUBLE ELSE round(tp::DOUBLE / (tp + fn), 4) END AS recall FROM c)
    SELECT *, CASE WHEN precision + recall = 0 THEN 0::DOUBLE ELSE round(2 * precision * recall / (precision + recall), 4) END AS f1 FROM p"""
)
def golden_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels as the golden set, a rule on length as the prediction."""
    expected = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("kind"), "doc_id")
    actual = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") >= 800, "1").otherwise("0").alias("kind"), "doc_id")
    return audits.golden_eval(expected, actual, ["doc_id"])


@_query(f"WITH e AS ({_EDGES}) SELECT src, dst, kind, max(confidence) AS confidence FROM e GROUP BY ALL HAVING max(confidence) < 0.05 ORDER BY confidence, src, dst, kind LIMIT 50")
def review_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.low_confidence(graph.merge_edges(_line_edges(spark, sf_dir)), 0.05, 50).select("src", "dst", "kind", "confidence")


@_query("SELECT kind, count(*) AS n FROM (" + sql.GRAPH.strip() + " SELECT kind FROM nodes) GROUP BY kind")
def status_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_tables(spark, sf_dir)[0].groupBy("kind").agg(F.count("*").alias("n"))


@_query("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def list_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").union(table(spark, sf_dir, "labels").select("doc_id")).distinct()


# --- incremental ----------------------------------------------------------------------------------------------------


@_query(
    """WITH b AS (SELECT doc_id, md5(text) AS h FROM documents WHERE source <> 'src1'), a AS (SELECT doc_id, md5(CASE WHEN lang = 'es' THEN text || '!' ELSE text END) AS h FROM documents WHERE source <> 'src2')
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM b FULL JOIN a ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h"""
)
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    state = lambda df, c: df.select("doc_id", F.md5(c.cast("binary")).alias("state"))
    return incremental.snapshot_diff(state(docs.where("source <> 'src1'"), F.col("text")), state(docs.where("source <> 'src2'"), F.when(F.col("lang") == "es", F.concat("text", F.lit("!"))).otherwise(F.col("text"))), "doc_id", "state")


@_query("SELECT user_id AS grp, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'failed' WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'degraded' ELSE 'success' END AS status, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS warnings FROM events GROUP BY user_id")
def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the report of a build."""
    report = table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("info").alias("severity"))
    return incremental.build_status(report, "grp")


@_query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 7200000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS burst FROM g) SELECT user_id, CAST(burst AS BIGINT) AS burst, epoch_us(min(ts)) AS begin_us, epoch_us(max(ts)) AS end_us, count(*) AS changes FROM b GROUP BY user_id, burst"""
)
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a user's events, two quiet hours apart."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    us = lambda c: F.unix_micros(c).alias(c.replace("_ts", "_us"))
    return incremental.debounced(e, "user_id", "ts", 7200).select("user_id", "burst", us("begin_ts"), us("end_ts"), "changes")


# --- views and merges -----------------------------------------------------------------------------------------------


@_query(
    sql.CHUNKS + """, c AS (SELECT doc_id, count(*) AS chunk_count, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks GROUP BY doc_id)
    SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, coalesce(c.chunk_count, 0) AS chunk_count, coalesce(c.chars, 0) AS chars FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN c USING (doc_id)"""
)
def documents_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels in the manifest's place and the counts of their chunks."""
    docs = table(spark, sf_dir, "documents")
    stats = chunks.line_chunks(docs).groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum(F.length("text")).cast("long").alias("chars"))
    return views.documents(docs.select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), stats)


@_query(
    """WITH l AS (SELECT l_orderkey, 'line:' || l_orderkey || '.' || l_linenumber AS id, max(l_quantity) AS high FROM lineitem GROUP BY ALL)
    SELECT 'order:' || o_orderkey AS parent_id, id, high, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY high DESC, id) AS INTEGER) AS position FROM orders JOIN l ON l_orderkey = o_orderkey"""
)
def register_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as registers, their lines as fields, highest first."""
    parent, child = F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")), F.concat(F.lit("line:"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").groupBy(parent.alias("src"), child.alias("id")).agg(F.max("l_quantity").alias("high"))
    parents = table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"))
    edges = lines.select("src", F.col("id").alias("dst"), F.lit("has_bitfield").alias("kind"))
    return views.with_children(parents, edges, lines.select("id", "high"), "has_bitfield", [F.desc("high"), F.col("id")])


@_query(
    """WITH s AS (SELECT n_regionkey AS doc_id, CAST(n_nationkey AS VARCHAR) AS number, n_name AS name, 1 AS page FROM nation UNION ALL SELECT n_regionkey, c_nationkey || '.' || c_custkey, c_name, CAST(NULL AS INTEGER) FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT n_regionkey, c_nationkey || '.' || c_custkey || '.7.' || (c_custkey % 3), c_mktsegment, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0)
    SELECT doc_id, number, name, page, CASE len(string_split(number, '.')) WHEN 2 THEN split_part(number, '.', 1) WHEN 4 THEN split_part(number, '.', 1) || '.' || split_part(number, '.', 2) END AS parent, CAST(len(string_split(number, '.')) AS INTEGER) AS depth,
      array_to_string(list_transform(string_split(number, '.'), lambda x: lpad(x, 12, '0')), '.') AS sort_key FROM s"""
)
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, customers and a level below that skips one, as numbered sections of a region's document."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    number = F.concat(F.col("c_nationkey").cast("string"), F.lit("."), F.col("c_custkey").cast("string"))
    row = lambda df, num, name, page: df.select(F.col("n_regionkey").alias("doc_id"), num.alias("number"), F.col(name).alias("name"), F.lit(page).cast("int").alias("page"))
    deep = row(c.where("c_acctbal > 0"), F.concat(number, F.lit(".7."), (F.col("c_custkey") % 3).cast("string")), "c_mktsegment", 2)
    return views.section_tree(row(n, F.col("n_nationkey").cast("string"), "n_name", 1).unionByName(row(c, number, "c_name", None)).unionByName(deep))


@_query("WITH n AS (SELECT l_orderkey AS o_orderkey, l_returnflag AS state, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 100000000 + l_partkey DESC, l_returnflag DESC) AS k FROM lineitem) SELECT o_orderkey, o_orderstatus AS state FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT o_orderkey, state FROM n WHERE k = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored rows; their lines replace them, the last one of each."""
    stored = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    new = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("state"), F.struct((F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).alias("n"), "l_returnflag").alias("seq"))
    return incremental.upsert(stored, new, ["o_orderkey"])


@_query(
    """WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'), e AS (SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, l_returnflag AS kind, l_orderkey FROM lineitem)
    SELECT src, dst, kind FROM e WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)"""
)
def delete_docs_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that are left when all orders of a priority go as a document."""
    nodes = table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("doc_id"))
    doc_ids = nodes.select("doc_id").distinct().where(F.col("doc_id").startswith("1"))
    return graph.delete_docs(doc_ids, nodes, _line_edges(spark, sf_dir).select("src", "dst", "kind"))[1]


@_query(f"WITH e AS ({_EDGES}), f AS (SELECT src, dst, kind, extractor, min(seq) AS seq FROM e GROUP BY ALL), x AS (SELECT src, dst, kind, string_agg(extractor, '+' ORDER BY seq, extractor) AS extractor FROM f GROUP BY ALL) SELECT src, dst, kind, extractor FROM x WHERE extractor <> 'F'")
def clear_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged edges without those that one producer alone has made."""
    return graph.without_derived(graph.merge_edges(_line_edges(spark, sf_dir)), ["F"]).select("src", "dst", "kind", "extractor")


@_query(
    r"""WITH s AS (SELECT 'nation:' || n_nationkey AS section_id, n_regionkey AS doc_id, CAST(n_nationkey AS VARCHAR) AS path, upper(regexp_replace(n_name, '[\s_\-./]+', '', 'g')) AS key FROM nation),
    m AS (SELECT n_regionkey AS doc_id, upper(regexp_replace(n_name, '[\s_\-./]+', '', 'g')) AS key, min('module:' || n_nationkey) AS module_id FROM nation WHERE n_nationkey % 2 = 0 GROUP BY ALL)
    SELECT 'supplier:' || s_suppkey AS src, coalesce(module_id, section_id) AS dst, 'belongs_to' AS kind, CASE WHEN module_id IS NULL THEN 0.85::DOUBLE ELSE 0.9::DOUBLE END AS confidence
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN s ON s.doc_id = n_regionkey AND s.path = CAST(s_nationkey AS VARCHAR) LEFT JOIN m ON m.doc_id = s.doc_id AND m.key = s.key"""
)
def belongs_to_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entities of nations as sections, half of which are modules as well."""
    n = table(spark, sf_dir, "nation")
    entities = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("n_regionkey").alias("doc_id"), F.col("s_nationkey").cast("string").alias("section_path"))
    named = lambda prefix: n.select(F.concat(F.lit(f"{prefix}:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").cast("string").alias("path"), F.col("n_name").alias("name"))
    return graph.belongs_to(entities, named("nation"), named("module").where("path % 2 = 0"))


@_query(
    sql.CHUNKS + r""", l AS (SELECT doc_id, chunk_id, lower(text) AS t, lower(string_split(text, chr(10))[1]) AS line FROM chunks),
    k AS (SELECT doc_id, chunk_id, t, line, contains(t, 'than')::INT + contains(t, 'ening')::INT AS n, contains(line, 'than')::INT + contains(line, 'ening')::INT AS h FROM l)
    SELECT doc_id, chunk_id, round(least(n * 0.45::DOUBLE, 4.5) + least(h * 0.6::DOUBLE, 2.4) + CASE WHEN contains(t, 'than ening') THEN 1 ELSE 0 END + CASE WHEN contains(line, 'than ening') THEN 3 ELSE 0 END
      + CASE WHEN regexp_matches(line, '^\s*[0-9]+(?:\.[0-9]+){0,5}\s*than ening') THEN 2 ELSE 0 END - 1, 6) AS score FROM k"""
)
def structural_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the structure of every chunk adds for one question."""
    score = retrieval.structural_score("than ening", F.col("text"), F.lit(None).cast("string"))
    return document_chunks(spark, sf_dir).select("doc_id", "chunk_id", F.round(score, 6).alias("score"))


@_query(
    """WITH p AS (SELECT source AS doc_id, count(*) AS pages, avg(length(text)) AS c, avg(CASE WHEN lang = 'en' THEN 0 ELSE 1 END) AS i, sum(len(regexp_extract_all(text, 'achlich|th[ei]nst'))) AS r, sum(len(regexp_extract_all(text, 'in the '))) AS t FROM documents GROUP BY source)
    SELECT doc_id, pages, CASE WHEN i >= 0.45 OR c < 80 OR r >= 12 OR r / pages >= 0.2 OR (r >= 4 AND t >= 2) OR NOT (t >= 8 OR t / pages >= 0.15) THEN 'ocr' ELSE 'layout' END AS parser FROM p"""
)
def parser_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as files, documents as their pages: which parser an accurate build takes."""
    foreign = F.when(F.col("lang") == "en", 0.0).otherwise(1.0)
    pages = table(spark, sf_dir, "documents").select(
        F.col("source").alias("doc_id"), F.lit(1).alias("page"), F.length("text").alias("text_chars"), F.lit(0).alias("images"), (foreign * 0.35 / 0.45).alias("image_ratio"),
        F.regexp_count("text", F.lit("achlich|th[ei]nst")).alias("register_hits"), F.regexp_count("text", F.lit("in the ")).alias("table_hits"),
    )
    return layout.pdf_profile(pages).select("doc_id", "pages", layout.choose_parser("accurate").alias("parser"))


@_query("SELECT event_type AS extractor, count(*) AS calls, CAST(sum(event_id % 1000) AS BIGINT) AS tokens_in, CAST(sum(user_id) AS BIGINT) AS tokens_out, round(sum(value), 6) AS cost_usd FROM events GROUP BY event_type")
def model_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a model, summed up by extractor."""
    return models.costs(table(spark, sf_dir, "events").select(F.col("event_type").alias("extractor"), (F.col("event_id") % 1000).alias("tokens_in"), F.col("user_id").alias("tokens_out"), F.col("value").alias("cost_usd")))


@_query(sql.BLOCKS + "SELECT id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{name}'" for name, p in extract.FIGURE_TYPES) + " ELSE 'unknown' END AS figure_type FROM blocks")
def figure_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block as a caption."""
    return blocks.text_blocks(table(spark, sf_dir, "documents")).select("id", extract.figure_type(F.col("text")).alias("figure_type"))


# The other modules of queries register themselves when they are imported.
from stratalake.plans import catalog_chunks, catalog_context, catalog_lookups, catalog_tables  # noqa: E402, F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registered.SQL)
