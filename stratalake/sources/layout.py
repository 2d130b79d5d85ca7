"""Layout JSON of external parsers to blocks, and the choice of a parser for a PDF, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYOUT = "pages array<struct<page_no:int,height:double,items:array<struct<label:string,text:string,level:int,bbox:array<double>,origin:string,caption:string,headers:array<string>,rows:array<array<string>>>>>>"
#: Labels of layout items and the kinds of block that they become.
LABELS = {"title": "heading", "section_header": "heading", "text": "paragraph", "paragraph": "paragraph", "list_item": "list", "code": "code", "formula": "formula", "interline_equation": "formula", "table": "table", "picture": "figure", "image": "figure", "figure": "figure"}
#: Tables and figures come after the text of their page, in these orders.
TABLE_ORDER, FIGURE_ORDER = 10_000, 20_000


def layout_blocks(docs: DataFrame, id_col: str = "doc_id", json_col: str = "layout") -> DataFrame:
    """Blocks of documents whose layout is JSON of pages with labelled items; boxes are turned to a top-left origin."""
    pages = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.from_json(F.col(json_col), LAYOUT)["pages"]).alias("p"))
    items = pages.select("doc_id", F.col("p.page_no").alias("page"), F.col("p.height").alias("height"), F.posexplode("p.items").alias("pos", "i"))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.lower("i.label")), F.lit("paragraph"))
    box = F.col("i.bbox")
    flipped = F.when(F.lower("i.origin") == "bottomleft", F.array(box[0], F.col("height") - box[3], box[2], F.col("height") - box[1])).otherwise(box)
    order = F.col("pos") + F.when(kind == "table", TABLE_ORDER).when(kind == "figure", FIGURE_ORDER).otherwise(0)
    out = items.select("doc_id", "page", kind.alias("kind"), order.alias("reading_order"), F.coalesce("i.text", "i.caption", F.lit("")).alias("text"), F.col("i.level").alias("heading_level"), flipped.alias("bbox"), F.col("i.caption").alias("caption"), F.col("i.headers").alias("headers"), F.col("i.rows").alias("rows"))
    return out.withColumn("id", F.concat(F.col("doc_id").cast("string"), F.lit("#p"), F.col("page").cast("string"), F.lit("#b"), F.col("reading_order").cast("string")))


def pdf_profile(pages: DataFrame, first_pages: int | None = 16) -> DataFrame:
    """For each document over its first pages (all of them without a number) (doc_id, page, text_chars, images, image_ratio, register_hits,
    table_hits): characters and images a page, the share that images take, hits, whether there is text or rather a scan."""
    sums = (pages if first_pages is None else pages.where(F.col("page") <= first_pages)).groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.avg("text_chars").alias("chars_per_page"), F.avg("images").alias("images_per_page"), F.avg("image_ratio").alias("image_ratio"),
        F.sum("register_hits").alias("register_hits"), F.sum("table_hits").alias("table_hits"),
    )
    text = F.col("chars_per_page") >= 80
    return sums.withColumn("has_text", text).withColumn("scan_like", ~text & ((F.col("images_per_page") >= 0.5) | (F.col("image_ratio") >= 0.25)))


def choose_parser(quality: str) -> Column:
    """The parser for a profile: text_layer reads the text that is there, layout finds its structure, ocr looks at images.

    fast always reads; scans and pages of images go to ocr; balanced then takes layout where there is text; accurate takes
    layout only for tables in text that isn't dense with registers."""
    if quality not in ("fast", "balanced", "accurate"):
        raise ValueError("quality must be fast, balanced or accurate")
    images = F.col("scan_like") | (F.col("image_ratio") >= 0.35) | (F.col("images_per_page") >= 2)
    if quality == "fast":
        return F.lit("text_layer")
    if quality == "balanced":
        return F.when(images | ~F.col("has_text"), "ocr").otherwise("layout")
    registers, tables = F.col("register_hits"), F.col("table_hits")
    dense = (registers >= 12) | (registers / F.col("pages") >= 0.2) | ((registers >= 4) & (tables >= 2))
    heavy = (tables >= 8) | (tables / F.col("pages") >= 0.15)
    return F.when(images | dense | ~F.col("has_text") | ~heavy, "ocr").otherwise("layout")


def parse_verdict(chars: Column, pages: Column) -> Column:
    """empty, scan_like or ok: what a parser gave for a document of so many pages."""
    return F.when(chars == 0, "empty").when(chars < F.greatest(F.lit(80), pages * 20), "scan_like").otherwise("ok")


def parser_chain(primary: Column, fallbacks: Column) -> Column:
    return F.array_distinct(F.concat(F.array(primary), fallbacks))
