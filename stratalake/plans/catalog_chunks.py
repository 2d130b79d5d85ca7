"""Registered queries: chunks of structured blocks and of tables, evidence, identifiers and plausibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalake.functions import checks
from stratalake.functions import text as T
from stratalake.operators import audits, blocks, chunks, views
from stratalake.plans.registered import query, table


def _key(prefix: str, c: str) -> F.Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string"))


# --- chunks of pages -------------------------------------------------------------------------------------------------

_PAGE_BLOCKS = r"""WITH RECURSIVE c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
    s AS (SELECT page_id, string_split(regexp_replace(h, '(?i)(</?(?:h[1-6]|p|li|ul|ol|article|nav|footer|div|body)(?:\s[^>]*)?>)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM c),
    k AS (SELECT page_id, list_filter(parts, lambda x: regexp_matches(x, '(?is)^<(?:h[1-6]|p|li)(?:\s[^>]*)?>')) AS f FROM s),
    r AS (SELECT page_id, unnest(f) AS raw, generate_subscripts(f, 1) - 1 AS pos FROM k),
    t AS (SELECT page_id AS doc_id, pos, regexp_matches(raw, '(?i)^<h[1-6]') AS heading, replace(replace(replace(replace(trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS text FROM r),
    b AS (SELECT doc_id, heading, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM t WHERE text <> ''),
"""


@query(
    _PAGE_BLOCKS + """walk AS (SELECT doc_id, n, 0 AS part, length(text) AS held FROM b WHERE n = 1
      UNION ALL SELECT b.doc_id, b.n, CASE WHEN b.heading OR w.held >= 2000 THEN w.part + 1 ELSE w.part END, CASE WHEN b.heading OR w.held >= 2000 THEN length(b.text) ELSE w.held + length(b.text) END FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.n = w.n + 1)
    SELECT doc_id || '#section#p1#' || part AS id, doc_id, CAST(part AS INTEGER) AS ordinal, 'section' AS chunk_type, string_agg(text, chr(10) ORDER BY n) AS text, count(*) AS n_blocks FROM walk JOIN b USING (doc_id, n) GROUP BY doc_id, part"""
)
def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages, packed to chunks: a heading begins one, and one ends once it holds 2000 characters. Numbers at a
    heading's beginning don't count as section paths here."""
    found = blocks.html_blocks(table(spark, sf_dir, "pages"))
    flat = found.select(F.concat_ws("#", "page_id", "reading_order").alias("id"), F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.when(F.col("kind") == "heading", "heading").otherwise("paragraph").alias("kind"), "reading_order", "text", F.lit(None).cast("string").alias("section_path"))
    cut = chunks.segment_chunks(flat, numbered=False)
    return cut.select("id", "doc_id", "ordinal", "chunk_type", "text", F.size("block_ids").cast("long").alias("n_blocks"))


@query(None)
def oversized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks, those over 2000 characters split by sentences with an overlap; tested on small texts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return chunks.split_oversized(docs).select("id", "parent", "split_part", "split_total", "char_offset", F.length("text").alias("chars"))


# --- chunks of tables ------------------------------------------------------------------------------------------------


def _wide_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each two hundred orders; its rows are of one length."""
    o = table(spark, sf_dir, "orders")
    row = F.array(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lpad(F.col("o_custkey").cast("string"), 12, "0"))
    rows = o.groupBy(F.floor(F.col("o_orderkey") / 200).cast("string").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    return rows.select("id", F.concat(F.lit("Table "), F.col("id")).alias("caption"), F.array(F.lit("Order"), F.lit("Customer")).alias("headers"), "rows")


@query(
    """WITH t AS (SELECT o_orderkey // 200 AS tid, count(*) AS n FROM orders GROUP BY ALL), h AS (SELECT *, length('Table ' || tid || chr(10) || '| Order | Customer |' || chr(10) || '| --- | --- |') AS head FROM t),
    k AS (SELECT *, CASE WHEN head + n * 32 <= 2000 THEN n ELSE greatest(1, greatest(2000 - head, 200) // 32) END AS size FROM h), p AS (SELECT *, CAST(ceil(n / size::DOUBLE) AS BIGINT) AS parts FROM k), e AS (SELECT *, unnest(range(parts)) AS i FROM p)
    SELECT CASE WHEN parts > 1 THEN tid || '_part' || (i + 1) || 'of' || parts ELSE CAST(tid AS VARCHAR) END AS id, CAST(i * size AS INTEGER) AS row_start, CAST(least((i + 1) * size, n) - 1 AS INTEGER) AS row_end, CAST(n AS INTEGER) AS row_total, CAST(head + (least((i + 1) * size, n) - i * size) * 32 AS INTEGER) AS chars FROM e"""
)
def table_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of two hundred orders in batches of rows that repeat caption and header."""
    cut = chunks.split_tables(_wide_tables(spark, sf_dir))
    return cut.select("id", "row_start", "row_end", "row_total", F.length("text").alias("chars"))


_PARTS = """WITH t AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER w AS INTEGER) AS pos, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Table ' || o_orderstatus || ' of all' WHEN 1 THEN 'Table ' || o_orderstatus || ' (continued)' ELSE 'Orders' END AS caption,
    CAST(row_number() OVER w // 2 AS INTEGER) AS page FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), k AS (SELECT *, CASE WHEN o_orderkey % 3 = 2 THEN 'caption:Orders' ELSE 'caption:' || split_part(caption, ' ', 2) END AS group_key FROM t)"""


def _order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("pos", F.row_number().over(w))
    caption = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Table "), F.col("o_orderstatus"), F.lit(" of all"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Table "), F.col("o_orderstatus"), F.lit(" (continued)"))).otherwise("Orders")
    page = F.floor(F.col("pos") / 2).cast("int")
    return chunks.table_profiles(o.select(F.col("o_custkey").alias("doc_id"), "pos", F.col("o_orderkey").cast("string").alias("id"), page.alias("page_start"), page.alias("page_end"), caption.alias("caption"), F.array(F.lit("A"), F.lit("B")).alias("headers"), F.array(F.array(F.col("o_orderkey").cast("string"), F.lit("x"))).alias("rows")))


@query(_PARTS + " SELECT doc_id, CAST(o_orderkey AS VARCHAR) AS id, 'generic_table' AS table_kind, group_key, o_orderkey % 3 = 1 AS continued, '| A | B |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' | x |' AS table_text FROM k")
def table_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of one row: kind, what their parts share, whether they go on, and their text."""
    return _order_parts(spark, sf_dir).select("doc_id", "id", "table_kind", "group_key", "continued", "table_text")


@query(
    _PARTS + """, j AS (SELECT *, CASE WHEN lag(group_key) OVER w = group_key AND page - lag(page) OVER w <= 1 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM j)
    SELECT doc_id, min(o_orderkey) || CASE WHEN count(*) > 1 THEN '_logical_' || substr(sha256(string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY pos)), 1, 10) ELSE '' END AS id, min(page) AS page_start, max(page) AS page_end, count(*) AS parts FROM i GROUP BY doc_id, island"""
)
def logical_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as tables, adjacent ones of one caption merged."""
    parts = _order_parts(spark, sf_dir).withColumn("text", F.col("table_text"))
    return chunks.logical_tables(parts).select("doc_id", "id", "page_start", "page_end", "parts")


# --- evidence --------------------------------------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT DISTINCT l_orderkey, 'l' || l_partkey AS block, 'part:' || l_partkey AS node FROM lineitem), w AS (SELECT DISTINCT o_orderkey FROM orders)
    SELECT l_orderkey AS chunk_id, 'block' AS kind, block AS id FROM l JOIN part ON 'l' || p_partkey = block AND p_size > 10 JOIN w ON o_orderkey = l_orderkey UNION SELECT l_orderkey, 'entity', node FROM l JOIN w ON o_orderkey = l_orderkey"""
)
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks of their lines: the blocks that there are (parts over a size) and the entities that name the chunk."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_partkey").distinct()
    of = lines.groupBy("chunk_id").agg(F.collect_set(F.concat(F.lit("l"), F.col("l_partkey").cast("string"))).alias("block_ids"))
    there = table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("id"))
    nodes = lines.groupBy(_key("part", "l_partkey").alias("id")).agg(F.collect_set("chunk_id").alias("source_chunk_ids"))
    return views.chunk_evidence(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id")), of, there, nodes)[1]


@query(
    """SELECT o_orderkey AS id, 'l2.missing_source_blocks' AS code FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'l2.missing_source_chunks' FROM orders WHERE o_orderkey % 5 = 0
    UNION ALL SELECT o_orderkey, 'l2.bad_source_block' FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT o_orderkey, 'l2.bad_source_chunk' FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""
)
def provenance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entities of customers as blocks and of lines as chunks: sources that are not told, or not there."""
    ids = lambda k, c: F.when(F.col("o_orderkey") % k != 0, F.array(F.col(c).cast("string"))).otherwise(F.array().cast("array<string>"))
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ids(7, "o_custkey").alias("source_block_ids"), ids(5, "o_orderkey").alias("source_chunk_ids"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("id"))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id")).distinct()
    return audits.provenance_issues(nodes, b, c)


@query(
    """WITH n AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0)
    SELECT id, 'l2.fact_method' AS code FROM n WHERE s = 'P' UNION ALL SELECT id, 'l2.fact_unverified' FROM n WHERE s = 'O' UNION ALL SELECT id, 'l2.fact_has_errors' FROM n WHERE id % 3 = 0"""
)
def trust_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nodes, half of them facts: those that can't be."""
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    nodes = table(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 2 == 0, "fact").otherwise("candidate").alias("status"), F.when(state == "P", "llm_inferred").otherwise("manual").alias("method"), (state != "O").alias("verified"), F.when(key % 3 == 0, 1).otherwise(0).alias("errors"))
    return audits.trust_issues(nodes)


# --- identifiers and plausibility ------------------------------------------------------------------------------------


@query(
    r"""WITH p AS (SELECT p_partkey, p_name || ' / ' || p_brand AS q, 'fam::trm' || CASE WHEN p_partkey % 2 = 0 THEN '@v' || p_size ELSE '' END || '::docs/' || replace(p_name, ' ', '%20') || '/a.pdf' AS doc FROM part)
    SELECT p_partkey, regexp_replace(trim(q), '[^A-Za-z0-9_.\-]+', '_', 'g') AS name, 'fam::reg:' || regexp_replace(trim(q), '[^A-Za-z0-9_.\-]+', '_', 'g') || '#' || doc AS node_id, doc AS doc_id, 'docs/' || split_part(doc, '::docs/', 2) AS doc_name, 'sha256:' || sha256(q) AS hash FROM p"""
)
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as names of nodes and of documents."""
    q = F.concat("p_name", F.lit(" / "), "p_brand")
    version = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("v"), F.col("p_size").cast("string"))).otherwise("")
    doc = T.make_doc_id(F.lit("fam"), F.lit("trm"), version, F.concat(F.lit("./docs/"), F.col("p_name"), F.lit("/a.pdf")))
    named = table(spark, sf_dir, "part").select("p_partkey", q.alias("q"), doc.alias("doc_id"))
    return named.select("p_partkey", T.normalize_name(F.col("q")).alias("name"), T.node_id(F.lit("fam"), F.lit("reg"), F.col("q"), F.col("doc_id")).alias("node_id"), "doc_id", T.doc_name(F.col("doc_id")).alias("doc_name"), T.content_hash(F.col("q")).alias("hash"))


@query(
    """SELECT p_partkey, p_partkey % 4 = 3 AS empty, p_partkey % 4 <> 1 AS access_ok, p_partkey % 4 <> 0 AS width_ok, p_partkey % 4 <> 1 AS number_ok, p_partkey % 4 <> 3 AS address_ok FROM part"""
)
def plausible_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells of attributes: which could be what they should be."""
    key, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    cell = lambda a, b, c: F.when(key == 0, a).when(key == 1, b).when(key == 2, c).otherwise(" N/A ")
    none = F.lit("")
    return table(spark, sf_dir, "part").select(
        "p_partkey", checks.is_empty(cell(size, F.col("p_name"), F.lit("x"))).alias("empty"), checks.plausible_access(F.when(key == 3, none).otherwise(cell(F.lit("r / w"), F.col("p_name"), F.lit("W1C")))).alias("access_ok"),
        checks.plausible_width(cell(F.concat(F.lit("~"), size, F.lit(" % of it")), F.concat(size, F.lit(" bits")), F.concat(F.lit("["), size, F.lit(":0]")))).alias("width_ok"),
        checks.plausible_number(cell(size, F.col("p_name"), F.concat(F.lit("0x"), size))).alias("number_ok"), checks.plausible_address(cell(F.col("p_name"), F.concat(F.lit("0x"), size), F.lit("BAR"))).alias("address_ok"),
    )
