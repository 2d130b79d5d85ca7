"""L0: layout blocks, from plain text and from HTML, in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalake.functions.text import blank_to_null, heading_path


def block_kind(text: Column) -> Column:
    """heading for a numbered line of up to 200 characters, list for bullets, table for pipes at both ends, else paragraph."""
    return (
        F.when((F.length(text) <= 200) & heading_path(text).isNotNull() & text.rlike(r"^\s*[0-9A-Z][0-9.]*\.?\s+\S"), "heading")
        .when(text.rlike(r"^\s*[-*•]\s+\S"), "list")
        .when(text.rlike(r"^\s*\|.*\|\s*$"), "table")
        .otherwise("paragraph")
    )


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A block for each line that isn't blank; no shuffle."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("reading_order", "text")).where(F.trim("text") != "")
    return lines.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("#p1#b"), F.col("reading_order").cast("string")).alias("id"),
        "doc_id", F.lit(1).alias("page"), block_kind(F.col("text")).alias("kind"), "reading_order", "text",
    )


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Headings, paragraphs and list items in document order; scripts and styles go, entities for < > & " are undone."""
    clean = F.regexp_replace(F.col(html_col), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "")
    found = F.regexp_extract_all(clean, F.lit(r"(?is)(<(?:h[1-6]|p|li)(?:\s[^>]*)?>.*?)(?=</?(?:h[1-6]|p|li|ul|ol|article|nav|footer|div|body)(?:\s[^>]*)?>|$)"), 1)
    rows = pages.select(F.col(id_col), F.posexplode(found).alias("reading_order", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([A-Za-z0-9]+)", 1))
    body = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    kind = F.when(tag.startswith("h"), "heading").when(tag == "li", "list").otherwise("paragraph")
    level = F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int"))
    return rows.select(id_col, "reading_order", kind.alias("kind"), level.alias("heading_level"), body.alias("text")).where(F.col("text") != "")


def _own_path(blocks: DataFrame, numbered: bool = True) -> Column:
    """A heading's number, if headings are numbered, else the path that its parser counted."""
    counted = F.col("section_path") if "section_path" in blocks.columns else F.lit(None).cast("string")
    return F.coalesce(heading_path(F.col("text")), counted) if numbered else counted


def section_index(blocks: DataFrame, toc: DataFrame | None = None, numbered: bool = True) -> DataFrame:
    """doc_id and path of the sections that a document has: its table of contents first, then its headings."""
    heads = blocks.where("kind = 'heading'").select("doc_id", _own_path(blocks, numbered).alias("path")).where("path IS NOT NULL")
    if toc is not None:
        own = F.coalesce("section_path", heading_path(F.col("title")), F.substring(F.regexp_replace(F.trim("title"), r"[^A-Za-z0-9_.\-]+", "_"), 1, 64))
        heads = heads.unionByName(toc.select("doc_id", own.alias("path")).where("path IS NOT NULL"))
    return heads.distinct()


def with_section_path(blocks: DataFrame, index: DataFrame, numbered: bool = True) -> DataFrame:
    """blocks with path: a heading's own number, a block's indexed section_path, else what the blocks before carry on."""
    given = F.when(F.col("kind") == "heading", _own_path(blocks, numbered)).otherwise(F.col("section_path") if "section_path" in blocks.columns else F.lit(None).cast("string"))
    known = index.select(F.col("doc_id").alias("k_doc"), F.col("path").alias("known"))
    joined = blocks.withColumn("given", given).join(known, (F.col("doc_id") == F.col("k_doc")) & (F.col("given") == F.col("known")), "left").drop("k_doc")
    order = Window.partitionBy("doc_id").orderBy("page", "reading_order", "id").rowsBetween(Window.unboundedPreceding, 0)
    # Only headings change what is carried on; a paragraph's own path counts for itself.
    carried = F.last(F.when(F.col("kind") == "heading", F.col("known")), ignorenulls=True).over(order)
    return joined.withColumn("path", F.coalesce("known", carried)).drop("given", "known")


#: Captions and key words whose hits on a page are counted, and the characters that a page of text has.
PAGE_HITS = {
    "table_hits": r"(?i)\btable\s+[0-9]",
    "figure_hits": r"(?i)\bfigure\s+[0-9]|\bfig\.?\s+[0-9]",
    "register_hits": r"(?i)\b(register|bit\s*field|bit\s*assignments?|bit\s*description|register\s*description|register\s*summary)\b|寄存器|位域|位字段",
    "pin_hits": r"(?i)\b(pin\s*name|pin\s*no|signal\s*name|direction|function\b.*\bdescription|\bI/?O\b\s+(type|direction))\b|管脚|引脚|信号名",
    "timing_hits": r"(?i)\b(min\b.*\btyp\b.*\bmax|min\b.*\bmax\b.*\bunit|electrical\s*characteristics|timing\s*characteristics|timing\s*parameters?)\b|时序参数|电气特性",
}
PAGE_CHARS = 80


def page_quality(blocks: DataFrame) -> DataFrame:
    """For each page its characters and blocks, hits of key words, and why it would need a look at its image."""
    counts = {name: F.sum(F.regexp_count("text", F.lit(p))).cast("long").alias(name) for name, p in PAGE_HITS.items()}
    pages = blocks.groupBy("doc_id", "page").agg(
        F.sum(F.length("text")).cast("long").alias("text_chars"), F.count("*").alias("text_blocks"), F.count_if(F.col("kind") == "table").alias("tables"), *counts.values()
    )
    lost = (F.col("table_hits") >= 1) & (F.col("tables") == 0)
    wants = [F.when((F.col(f"{k}_hits") >= 1) & lost, f"{k}_with_table") for k in ("register", "pin", "timing")]
    reasons = F.array_compact(F.array(F.when(F.col("text_chars") < PAGE_CHARS, "scan_like_no_text"), *wants))
    return pages.withColumn("has_text_layer", F.col("text_chars") > 20).withColumn("reasons", F.array_join(reasons, ",")).withColumn("needs_look", F.size(reasons) > 0)


def boxes_outside(texts: DataFrame, tables: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Text boxes whose centre lies in no table of their page: an equi-join on the page with the containment behind it."""
    t = tables.select(F.col("doc_id").alias("t_doc"), F.col("page").alias("t_page"), *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(F.col("t_x0") - tolerance, F.col("t_x1") + tolerance) & cy.between(F.col("t_y0") - tolerance, F.col("t_y1") + tolerance)
    return texts.join(t, (F.col("doc_id") == F.col("t_doc")) & (F.col("page") == F.col("t_page")) & inside, "left_anti")


def nearest_table_heading(blocks: DataFrame) -> DataFrame:
    """For each table the closest heading among the eight blocks before it, else a short table-like paragraph among four."""
    order = Window.partitionBy("doc_id", "page").orderBy("reading_order", "id")
    like = F.lower("text").rlike("table|register|signal|pin|表") & (F.length("text") <= 240)
    head = F.last(F.when(F.col("kind") == "heading", F.col("text")), True).over(order.rowsBetween(-8, -1))
    near = F.last(F.when((F.col("kind") == "paragraph") & like, F.col("text")), True).over(order.rowsBetween(-4, -1))
    return blocks.withColumn("near_heading", F.coalesce(blank_to_null(head), near)).where("kind = 'table'")
