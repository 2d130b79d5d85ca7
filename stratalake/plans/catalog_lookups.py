"""Registered queries: lookups, views, trust, golden sets and embeddings over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.core.storage import materialize
from stratalake.functions import text as T
from stratalake.operators import audits, blocks, embed, extract, figures, lookups, retrieval, search
from stratalake.plans import sql
from stratalake.plans.registered import query, table


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from stratalake.plans.catalog import graph_tables

    return graph_tables(spark, sf_dir)


def _key(prefix: str, c: str) -> F.Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string"))


# --- lookups ---------------------------------------------------------------------------------------------------------


@query("SELECT 'customer:' || o_custkey AS id, c_name AS name, min(o_orderkey) AS pos FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def nodes_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of all orders, asked for one after another: each once, at its first place."""
    nodes, _ = _graph(spark, sf_dir)
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), _key("customer", "o_custkey").alias("id"))
    return lookups.by_ids(nodes, wanted).select("id", "name", "pos")


@query(sql.GRAPH + ", a AS (SELECT 'customer:' || o_custkey AS id, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS aliases FROM orders GROUP BY ALL) SELECT id, name, coalesce(aliases, '') AS aliases FROM nodes LEFT JOIN a USING (id)")
def nodes_with_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their orders' priorities as aliases."""
    nodes, _ = _graph(spark, sf_dir)
    aliases = table(spark, sf_dir, "orders").select(_key("customer", "o_custkey").alias("node_id"), F.col("o_orderpriority").alias("alias"))
    return lookups.with_aliases(nodes, aliases).select("id", "name", F.array_join("aliases", "|").alias("aliases"))


@query(sql.GRAPH + "SELECT id, kind, name FROM nodes WHERE kind = 'customer' AND contains(lower(name), '#00000001') ORDER BY name, id LIMIT 30 OFFSET 5")
def node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of customers by part of their names."""
    nodes, _ = _graph(spark, sf_dir)
    return lookups.search_nodes(nodes.withColumn("qualified_name", F.col("id")), kind="customer", fuzzy="#00000001", limit=30, offset=5).select("id", "kind", "name")


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_nationkey IN (3, 7)")
def node_ids_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the nodes of two documents, nations here."""
    docs = table(spark, sf_dir, "customer").select(_key("customer", "c_custkey").alias("id"), F.col("c_nationkey").alias("doc_id"))
    return lookups.scoped(docs, [3, 7]).select("id")


@query("SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, l_returnflag AS kind, l_discount AS confidence FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_discount < 0.03 ORDER BY l_discount, src, dst, kind LIMIT 200")
def edge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least sure of two kinds of edges."""
    edges = table(spark, sf_dir, "lineitem").select(_key("order", "l_orderkey").alias("src"), _key("part", "l_partkey").alias("dst"), F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("confidence"))
    return lookups.search_edges(edges, kinds=["A", "R"], below=0.03, limit=200)


@query(sql.GRAPH + "SELECT src, dst, edges.kind AS kind FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.kind IN ('region', 'nation') AND b.kind IN ('region', 'nation')")
def edges_among(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges both of whose ends are regions or nations."""
    nodes, edges = _graph(spark, sf_dir)
    return lookups.search_edges(edges, among=nodes.where("kind IN ('region', 'nation')")).select("src", "dst", "kind")


@query(sql.BLOCKS + "SELECT id, CAST(reading_order AS INTEGER) AS reading_order, text FROM blocks WHERE doc_id = 7 AND page = 1")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.page_blocks(blocks.text_blocks(table(spark, sf_dir, "documents")), 7, 1).select("id", "reading_order", "text")


@query("SELECT 'customer:' || c_custkey AS id, c_nationkey AS doc_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(nullif(CAST(c_custkey % 40 AS INTEGER), 0), 1000000000), c_mktsegment, c_name, 'customer:' || c_custkey) AS INTEGER) AS position FROM customer")
def section_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sections of nations: by page, those without one last, then by path and name."""
    page = F.when(F.col("c_custkey") % 40 != 0, (F.col("c_custkey") % 40).cast("int"))
    sections = table(spark, sf_dir, "customer").select(_key("customer", "c_custkey").alias("id"), F.col("c_nationkey").alias("doc_id"), page.alias("page"), F.col("c_mktsegment").alias("path"), F.col("c_name").alias("name"))
    return lookups.outline(sections).select("id", "doc_id", "position")


@query(sql.GRAPH + "SELECT id, name, CAST(2 AS INTEGER) AS tier FROM nodes WHERE kind = 'supplier' AND contains(lower(name), 'supplier#00000000') ORDER BY name, id LIMIT 3")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that no supplier has alone, but several as part of theirs."""
    return lookups.first_match(_graph(spark, sf_dir)[0], "Supplier#00000000", "supplier").select("id", "name", "tier")


@query("SELECT 'part:' || p_partkey AS id, p_name AS name, CAST(2 AS INTEGER) AS tier FROM part WHERE lower(p_brand) = 'brand#13' ORDER BY p_name, 'part:' || p_partkey LIMIT 10")
def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand, which is no part's name but the alias of some."""
    part = table(spark, sf_dir, "part")
    terms = part.select(_key("part", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("full"))
    aliases = part.select(_key("part", "p_partkey").alias("node_id"), F.col("p_brand").alias("alias"))
    return lookups.term_match(terms, aliases, "BRAND#13").select("id", "name", "tier")


@query(sql.GRAPH + "SELECT src, dst, kind FROM edges WHERE NOT (kind = 'references' AND src IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal < 0))")
def edges_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without those of customers in debt to their orders."""
    _, edges = _graph(spark, sf_dir)
    gone = edges.where("kind = 'references'").join(table(spark, sf_dir, "customer").where("c_acctbal < 0").select(_key("customer", "c_custkey").alias("src")), "src", "left_semi")
    return lookups.without(edges, gone, ["src", "dst", "kind"]).select("src", "dst", "kind")


@query(
    sql.GRAPH + """SELECT 'nodes' AS layer, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'nodes', NULL, count(*) FROM nodes UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'edges', NULL, count(*) FROM edges"""
)
def graph_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.counts_by_kind(*_graph(spark, sf_dir))


@query(
    sql.GRAPH + ", h AS (SELECT sha256(id || chr(0) || kind || chr(0) || name) AS x FROM nodes) SELECT count(*) AS n, sha256(concat_ws(':', " + ", ".join(f"CAST(CAST(sum(CAST(('0x' || substr(x, {i}, 8)) AS BIGINT)) AS BIGINT) AS VARCHAR)" for i in (1, 9, 17, 25)) + ")) AS fingerprint FROM h"
)
def graph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.fingerprint(_graph(spark, sf_dir)[0], ["id", "kind", "name"])


@query(
    """WITH c AS (SELECT l_orderkey, CASE WHEN count(*) FILTER (l_quantity > 30) > 0 THEN 's' || arg_min(l_suppkey, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey) FILTER (l_quantity > 30) END AS s FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'own' ELSE coalesce(s, 'c' || o_custkey) END AS section FROM orders LEFT JOIN c ON l_orderkey = o_orderkey"""
)
def recovered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entities: finished ones have a section, others get that of their first large line as a chunk, else their
    customer's as a block."""
    pos = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", pos.alias("pos"), F.when(F.col("l_quantity") > 30, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("section_path")).withColumn("id", F.concat_ws(".", "l_orderkey", "pos"))
    ids = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "id"))), lambda x: x["id"]).alias("chunk_ids"))
    nodes = table(spark, sf_dir, "orders").join(ids, "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "own").alias("section_path"), "chunk_ids", F.array(F.col("o_custkey").cast("string")).alias("block_ids"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("section_path"))
    return lookups.recovered_section(nodes, lines.select("id", "section_path").distinct(), customers).select("id", "section")


@query(sql.CHUNKS + "SELECT chunk_id AS id, doc_id, 'text' AS kind, CAST(part AS INTEGER) AS page, CAST(part AS INTEGER) AS page_start, CAST(part AS INTEGER) AS page_end, text, CAST(length(text) AS INTEGER) AS chars FROM chunks")
def chunk_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalake.plans.catalog import document_chunks

    none = F.lit(None).cast("int")
    return lookups.chunk_view(document_chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), "doc_id", F.lit("text").alias("kind"), F.col("part").alias("page"), none.alias("page_start"), none.alias("page_end"), "text"))


@query(
    sql.CHUNKS + sql.bm25("of the", "_0") + sql.bm25("than", "_1") + sql.bm25("the of the", "_2")
    + "SELECT 'of the' AS phrase, doc_id, chunk_id, tf, round(score, 6) AS score FROM bm25_0 UNION ALL SELECT 'than', doc_id, chunk_id, tf, round(score, 6) FROM bm25_1 UNION ALL SELECT 'the of the', doc_id, chunk_id, tf, round(score, 6) FROM bm25_2"
)
def index_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three phrases, searched in an index that is written once."""
    from stratalake.core.storage import fresh_path
    from stratalake.plans.catalog import document_chunks

    index = search.open_index(spark, search.write_index(document_chunks(spark, sf_dir), fresh_path(spark, "index")))
    out = None
    for phrase in ("of the", "than", "the of the"):
        one = search.phrase_scores(index, phrase, None).select(F.lit(phrase).alias("phrase"), "doc_id", "chunk_id", "tf", F.round("score", 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


# --- embeddings ------------------------------------------------------------------------------------------------------

_NODE_TEXT = "concat_ws(' | ', p_name, CASE WHEN p_brand <> p_name THEN p_brand END, CASE WHEN p_partkey % 2 = 0 THEN p_type END, CASE WHEN p_partkey % 3 = 0 THEN substr(repeat(p_name || ' ', 40), 1, 300) END)"


def _part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = lambda k, c: F.when(F.col("p_partkey") % k == 0, c)
    text = embed.node_text(F.col("p_name"), F.col("p_brand"), when(2, F.col("p_type")), when(3, F.repeat(F.concat("p_name", F.lit(" ")), F.lit(40))), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), text.alias("text"))


@query(f"SELECT p_partkey AS item_id, {_NODE_TEXT} AS text FROM part")
def node_embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be encoded of parts."""
    return _part_texts(spark, sf_dir)


@query(
    "SELECT p_partkey AS item_id, concat_ws(chr(10), 'section ' || nullif(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END, ''), CASE WHEN p_size > 25 THEN 'pages ' || p_partkey % 9 + 1 || '-' || p_size ELSE 'page ' || p_partkey % 9 + 1 END, "
    "CASE WHEN p_partkey % 2 = 0 THEN 'pin_table' END, CASE WHEN p_partkey % 2 = 0 THEN p_brand END, CASE WHEN p_partkey % 3 = 0 THEN 'headers: ' || p_type || ' | ' || p_name END, p_name) AS text FROM part"
)
def chunk_embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be encoded of parts as chunks, half of them tables."""
    when = lambda k, c: F.when(F.col("p_partkey") % k == 0, c)
    start = (F.col("p_partkey") % 9 + 1).cast("int")
    text = embed.chunk_text(F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_size").cast("string")), start, F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(start), when(2, F.lit("pin_table")), when(2, F.col("p_brand")), when(3, F.array("p_type", "p_name")), F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), text.alias("text"))


def _letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for an encoder: lengths and numbers of e."""
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query(f"WITH t AS (SELECT p_partkey AS item_id, p_size, {_NODE_TEXT} AS text FROM part) SELECT item_id, 'sha256:' || sha256(text) AS content_hash, CASE WHEN item_id % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(length(text) AS DOUBLE) END AS a, CASE WHEN item_id % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) END AS b FROM t")
def embedding_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of parts brought up to date: a fifth is stored as it should be, a fifth is stale, some are of parts that are gone."""
    items = _part_texts(spark, sf_dir)
    zero = F.array(F.lit(0.0), F.lit(0.0)).alias("vector")
    good = items.where("item_id % 5 = 0").select("item_id", T.content_hash(F.col("text")).alias("content_hash"), zero)
    stale = items.where("item_id % 5 = 1").select("item_id", F.lit("sha256:old").alias("content_hash"), zero)
    gone = items.where("item_id % 5 = 2").select((-F.col("item_id") - 1).alias("item_id"), F.lit("x").alias("content_hash"), zero)
    found = embed.embedded(items, good.unionByName(stale).unionByName(gone), _letters, 2)
    return found.select("item_id", "content_hash", F.col("vector")[0].alias("a"), F.col("vector")[1].alias("b"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, label AS l, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])), 6) AS similarity FROM q, embeddings),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 10),
    t AS (SELECT query_id, vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'text' ELSE 'term' END AS channel, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS rank FROM q JOIN embeddings ON label = l QUALIFY rank <= 10)
    SELECT coalesce(t.query_id, n.query_id) AS query_id, coalesce(t.id, n.id) AS id, round(coalesce(CASE channel WHEN 'text' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * 61 / (60 + t.rank), 0) + CASE WHEN similarity >= 0.2 THEN 0.8::DOUBLE * 61 / (60 + n.rank) + least(greatest((similarity - 0.2::DOUBLE) / 0.8::DOUBLE, 0), 1) * 0.5::DOUBLE ELSE 0 END, 6) AS score
    FROM t FULL JOIN (SELECT * FROM n WHERE similarity >= 0.2) n ON t.query_id = n.query_id AND t.id = n.id"""
)
def hybrid_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors as the semantic channel, those of the same label as two text channels, for every fiftieth vector."""
    from pyspark.sql.window import Window

    vectors = table(spark, sf_dir, "embeddings")
    wanted = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("l"))
    semantic = retrieval.nearest(vectors, wanted.drop("l"), k=10).select("query_id", "id", "similarity", "rank")
    # The first ten of a label are the same for all of its queries: they are ranked once a label, not once a query.
    first = vectors.select(F.col("vec_id").alias("id"), "label").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where("rank <= 10")
    ranked = wanted.select("query_id", "l").join(first, F.col("l") == F.col("label"))
    text = ranked.select("query_id", "id", F.when(F.col("id") % 2 == 0, "text").otherwise("term").alias("channel"), "rank")
    return retrieval.hybrid_scores(text, semantic, ["query_id", "id"]).withColumn("score", F.round("score", 6))


# --- names, figures, trust, golden sets -----------------------------------------------------------------------------


@query(
    r"""WITH p AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, CASE p_partkey % 5 WHEN 0 THEN 'Chapter ' || p_size || '  ' || p_name WHEN 1 THEN 'appendix b ' || p_name WHEN 2 THEN p_size || '.' || p_size || p_type WHEN 3 THEN p_name || ' .... ' || p_size ELSE p_size || p_type || '.' || p_size END AS title,
      CASE p_partkey % 4 WHEN 0 THEN 'Cortex-M' || p_size || ' guide' WHEN 1 THEN 'my STM32F' || p_size WHEN 2 THEN 'PCIe_Spec ' || p_name ELSE p_name END AS doc, CASE p_partkey % 3 WHEN 0 THEN 'Memory-Maps' WHEN 1 THEN ' timing ' ELSE p_type END AS k FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || ' ' || p_name WHEN 1 THEN 'B ' || p_name WHEN 2 THEN p_size || '.' || p_size || ' ' || p_type WHEN 3 THEN p_name || ' ' ELSE p_size || ' ' || p_type END AS title,
      CASE p_partkey % 5 WHEN 2 THEN p_size || '.' || p_size || ' ' || p_type ELSE title END AS spaced, CASE p_partkey % 4 WHEN 1 THEN 'stm32f' || p_size WHEN 2 THEN 'pcie-subsystem' WHEN 0 THEN 'cortex-m' || p_size END AS chip,
      CASE p_partkey % 3 WHEN 0 THEN 'memory_map' WHEN 1 THEN 'parameter' ELSE lower(p_type) END AS kind, lower(p_name) || ' x' AS name, CAST(p_size * 2 AS DOUBLE) AS area FROM p"""
)
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as titles, document names, kinds and boxes, in their plain forms."""
    part, size, key = table(spark, sf_dir, "part"), F.col("p_size").cast("string"), F.col("p_partkey")
    title = F.when(key % 5 == 0, F.concat(F.lit("Chapter "), size, F.lit("  "), F.col("p_name"))).when(key % 5 == 1, F.concat(F.lit("appendix b "), F.col("p_name"))).when(key % 5 == 2, F.concat(size, F.lit("."), size, F.col("p_type")))
    title = title.when(key % 5 == 3, F.concat(F.col("p_name"), F.lit(" .... "), size)).otherwise(F.concat(size, F.col("p_type"), F.lit("."), size))
    doc = F.when(key % 4 == 0, F.concat(F.lit("Cortex-M"), size, F.lit(" guide"))).when(key % 4 == 1, F.concat(F.lit("my STM32F"), size)).when(key % 4 == 2, F.concat(F.lit("PCIe_Spec "), F.col("p_name"))).otherwise(F.col("p_name"))
    kind = F.when(key % 3 == 0, "Memory-Maps").when(key % 3 == 1, " timing ").otherwise(F.col("p_type"))
    box = F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0) + F.col("p_size"), F.lit(4.0))
    return part.select("p_partkey", T.section_title(title).alias("title"), T.spaced_numbers(title).alias("spaced"), T.chip_model(doc).alias("chip"), T.golden_kind(kind).alias("kind"), T.golden_name(F.concat(F.lit(" "), F.upper("p_name"), F.lit("   X "))).alias("name"), T.box_area(box).alias("area"))


_MERMAID = r"(?i)^\s*(?:graph|flowchart|sequenceDiagram)\b"


@query(
    """SELECT p_partkey, p_partkey % 4 IN (0, 3) AS noise, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'chip' ELSE 'general' END AS domain,
      CASE p_partkey % 4 WHEN 0 THEN 'AXI4 ' || p_type WHEN 1 THEN NULL WHEN 2 THEN p_name ELSE 'apb' END AS interface,
      CASE WHEN p_partkey % 2 = 0 THEN 'graph ' || p_name END AS mermaid, p_partkey % 4 <> 1 AS mermaid_ok, CASE WHEN p_partkey % 3 = 0 THEN '{"signal": [' || p_size || ']}' END AS wave, p_partkey % 3 <> 1 AS wave_ok, p_partkey % 2 = 0 AS uml_ok FROM part"""
)
def figure_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as what a model says of figures, and what of it can be used."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    named = F.when(key % 4 == 0, F.concat(F.lit("Host DDR "), F.col("p_name"))).when(key % 4 == 3, F.lit("  ")).otherwise(F.col("p_name"))
    said = F.when(key % 4 == 0, F.concat(F.lit("an AXI bus of "), F.col("p_name"))).when(key % 4 == 1, F.concat(F.col("p_name"), F.lit(" 寄存器"))).otherwise(F.col("p_name"))
    interface = figures.interface_name(F.when(key % 4 == 2, F.col("p_name")).when(key % 4 == 3, "apb").otherwise("AXI4"), F.when(key % 4 == 1, "axi-4").when(key % 4 == 3, "").otherwise("AXI4"), F.when(key % 4 == 0, F.col("p_type")))
    mermaid = figures.diagram(F.when(key % 2 == 0, F.concat(F.lit("  graph "), F.col("p_name"))).when(key % 4 == 1, "no diagram"), _MERMAID)
    wave = figures.wavejson(F.when(key % 3 == 0, F.concat(F.lit('{"signal": ['), F.col("p_size").cast("string"), F.lit("]}"))).when(key % 3 == 1, '{"other": 1}'), ("signal", "reg"))
    uml = figures.plantuml(F.when(key % 2 == 0, F.concat(F.lit("@startuml\n"), F.col("p_name"), F.lit("\n@enduml"))).otherwise("none of it"), r"(?im)^\s*(?:state|participant)\b")
    return part.select("p_partkey", figures.is_noise(named).alias("noise"), figures.domain(said).alias("domain"), interface.alias("interface"), mermaid[0].alias("mermaid"), mermaid[1].alias("mermaid_ok"), wave[0].alias("wave"), wave[1].alias("wave_ok"), uml[1].alias("uml_ok"))


@query(
    """SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS n, any_value(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'fact' ELSE 'candidate' END) AS status FROM
    (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL) GROUP BY ALL"""
)
def fact_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as bit fields: facts if a rule found them, where, and their bits are in order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("state"))
    ids = F.when(F.col("state") == "O", F.array(F.lit("b"))).otherwise(F.array().cast("array<string>"))
    nodes = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("bitfield").alias("kind"), F.when(F.col("flag") == "A", "llm_inferred").otherwise("deterministic").alias("method"), F.lit("table").alias("extractor"), ids.alias("source_block_ids"),
        ids.alias("source_chunk_ids"), F.lit("r").alias("register_id"), F.when(F.col("flag") == "R", 0).otherwise(7).alias("bit_high"), F.lit(4).alias("bit_low"), F.lit(None).cast("string").alias("address"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("size"),
    )
    return extract.fact_issues(nodes).select("id", F.lit(1).cast("long").alias("n"), "status")


@query("SELECT o_orderkey AS src, c_custkey AS dst, CASE WHEN o_orderstatus = 'F' AND c_acctbal > 0 THEN 'fact' ELSE 'candidate' END AS status FROM orders JOIN customer ON c_custkey = o_custkey")
def edge_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from orders to customers: facts if the order is finished and the customer isn't in debt."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    edges = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(_key("o", "o_orderkey").alias("src"), _key("c", "c_custkey").alias("dst"))
    facts = orders.where("o_orderstatus = 'F'").select(_key("o", "o_orderkey").alias("id")).unionByName(customers.where("c_acctbal > 0").select(_key("c", "c_custkey").alias("id")))
    number = lambda c: F.substring(c, 3, 20).cast("long").alias(c)
    return extract.edge_trust(edges, facts).select(number("src"), number("dst"), "status")


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'document_entity' ELSE 'candidate' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'manual' WHEN o_orderkey % 3 = 0 THEN 'llm_inferred' WHEN o_orderkey % 3 = 1 THEN 'deterministic' ELSE 'merged' END AS method FROM orders"""
)
def default_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of which some lack a status or a method."""
    key = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select(
        key.alias("id"), F.when(key % 4 == 1, "section").otherwise("register").alias("kind"), F.when(key % 4 == 0, "fact").alias("status"), F.when(key % 5 == 0, "manual").alias("method"), F.when(key % 3 == 0, "the_LLM@1").otherwise("table").alias("source"),
        F.when(key % 3 == 1, "deterministic").alias("extraction_confidence"),
    )
    return extract.default_trust(items).select("id", "status", "method")


@query(
    """WITH e AS (SELECT DISTINCT c_mktsegment AS kind, lower(c_name) AS key, CASE WHEN c_mktsegment < 'F' THEN CAST(c_nationkey AS VARCHAR) END AS doc_id FROM customer WHERE c_custkey % 3 <> 0),
    a0 AS (SELECT c_mktsegment AS kind, lower(c_name) AS key, CAST(CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS VARCHAR) AS doc_id FROM customer WHERE c_custkey % 4 <> 0),
    docs AS (SELECT DISTINCT kind, doc_id FROM e WHERE doc_id IS NOT NULL), kinds AS (SELECT kind, bool_and(doc_id IS NOT NULL) AS strict, bool_or(doc_id IS NOT NULL) AS scoped FROM e GROUP BY kind),
    a AS (SELECT a0.*, strict FROM a0 JOIN kinds USING (kind) WHERE NOT scoped OR EXISTS (SELECT 1 FROM docs d WHERE d.kind = a0.kind AND d.doc_id = a0.doc_id))
    SELECT kind, key, doc_id, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.kind = e.kind AND a.key = e.key AND (e.doc_id IS NULL OR a.doc_id = e.doc_id)) THEN 'found' ELSE 'missing' END AS state FROM e
    UNION ALL SELECT kind, key, doc_id, 'unexpected' FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.kind = a.kind AND e.key = a.key AND ((strict AND e.doc_id = a.doc_id) OR (NOT strict AND e.doc_id IS NULL)))"""
)
def golden_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as golden and as found entities of their segments; some segments' golden rows name documents."""
    c, nation = table(spark, sf_dir, "customer"), F.col("c_nationkey").cast("string")
    expected = c.where("c_custkey % 3 <> 0").select(F.col("c_mktsegment").alias("kind"), F.concat(F.lit(" "), F.upper("c_name")).alias("name"), F.when(F.col("c_mktsegment") < "F", nation).alias("doc_id"))
    actual = c.where("c_custkey % 4 <> 0").select(F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 == 0, (F.col("c_nationkey") + 100).cast("string")).otherwise(nation).alias("doc_id"))
    return audits.golden_matches(expected, actual)


@query(
    """WITH t AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'timing' WHEN 1 THEN 'memory_map' END AS kind FROM orders)
    SELECT 'l2.table_no_schema_hits' AS code, CAST(doc_id AS VARCHAR) AS doc_id, CAST(NULL AS VARCHAR) AS kind FROM t WHERE kind IS NULL UNION ALL SELECT 'l2.matched_but_no_nodes', NULL, 'memory_map' WHERE EXISTS (SELECT 1 FROM t WHERE kind = 'memory_map')
    UNION ALL SELECT 'l2.schema_no_candidates', NULL, 'pin'"""
)
def candidate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order: what the audit of candidates finds wrong where only timing tables have become nodes."""
    key = F.col("o_orderkey")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    headers = F.when(key % 3 == 0, words("Symbol", "Min", "Max", "Unit")).when(key % 3 == 1, words("Region", "Base Address", "Size")).otherwise(words("A", "B"))
    tables = extract.with_schemas(table(spark, sf_dir, "orders").select(key.alias("doc_id"), key.cast("string").alias("id"), F.lit(None).cast("string").alias("caption"), headers.alias("headers")))
    tables = materialize(tables.select("doc_id", "id", "schemas"), "table-schemas")
    nodes = tables.where(F.array_contains("schemas", "timing")).select("doc_id", F.lit("timing").alias("kind"))
    return audits.candidate_audit(tables, ["timing", "memory_map", "pin"], nodes)[2]
