"""Tables whose cells span rows and columns, as full grids; tables that a layout left empty, from the Markdown beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.sources.files import html_tables

CELLS = "array<struct<row:int,col:int,row_span:int,col_span:int,text:string,header:boolean>>"


def _upto(n: Column) -> Column:
    """0 to n - 1; nothing for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def span_grid(cells: Column) -> Column:
    """headers, rows and merged (the cells that span several) of cells (CELLS): each place has the text of the cell that
    covers it, of several the first by row and column; places that none covers are blank. Leading rows whose places are all
    headers', one at least, are joined to one header a column, each text once.

    Linear in the places but for a sort: every place is listed once for its cell and once as blank, each as one number, and the
    first of each place is kept. Negative places and spans under one count as 0 and 1."""
    at = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    span = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    plain = F.transform(F.coalesce(cells, F.array().cast(CELLS)), lambda x: F.struct(at(x["row"]).alias("row"), at(x["col"]).alias("col"), F.trim(F.coalesce(x["text"], F.lit(""))).alias("text"), F.coalesce(x["header"], F.lit(False)).alias("header"), span(x["row_span"]).alias("row_span"), span(x["col_span"]).alias("col_span")))
    # A one-element array binds what is used again, so that it is evaluated once.
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def sized(own: Column) -> Column:
        height = F.coalesce(F.array_max(F.transform(own, lambda x: x["row"] + x["row_span"])), F.lit(0))
        width = F.coalesce(F.array_max(F.transform(own, lambda x: x["col"] + x["col_span"])), F.lit(0))
        return let(F.struct(height.alias("h"), width.alias("w"), (F.size(own) + 1).cast("long").alias("m"), F.sort_array(own).alias("cells")), lambda size: placed(own, size))

    def placed(own: Column, size: Column) -> Column:
        # A place and the number of a cell by row and column, or of none (the last number), as place * m + number.
        m = size["m"]
        code = lambda x, k, i, j: ((x["row"] + i) * size["w"] + x["col"] + j).cast("long") * m + k
        covered = F.flatten(F.transform(size["cells"], lambda x, k: F.flatten(F.transform(_upto(x["row_span"]), lambda i: F.transform(_upto(x["col_span"]), lambda j: code(x, k, i, j))))))
        blank = F.transform(_upto(size["h"] * size["w"]), lambda p: p.cast("long") * m + m - 1)
        place = lambda x: x - x % m
        first = lambda s: F.filter(s, lambda x, i: (i == 0) | (place(F.get(s, i - 1)) != place(x)))
        nths = let(F.sort_array(F.concat(covered, blank)), lambda s: F.transform(first(s), lambda x: (x % m).cast("int")))
        return let(nths, lambda n: headed(own, size, n))

    def headed(own: Column, size: Column, nths: Column) -> Column:
        cell = lambda r, c: F.get(size["cells"], F.get(nths, r * size["w"] + c))
        text = lambda r, c: F.coalesce(cell(r, c)["text"], F.lit(""))
        header = lambda r, c: F.coalesce(cell(r, c)["header"], F.lit(False))
        body_from = F.coalesce(F.get(F.filter(_upto(size["h"]), lambda r: ~F.forall(_upto(size["w"]), lambda c: header(r, c))), F.lit(0)), size["h"])
        return let(F.greatest(body_from, F.least(F.lit(1), size["h"])), lambda heads: told(own, size, text, heads))

    def told(own: Column, size: Column, text: Callable[[Column, Column], Column], heads: Column) -> Column:
        headers = F.transform(_upto(size["w"]), lambda c: F.array_join(F.array_distinct(F.filter(F.transform(_upto(heads), lambda r: text(r, c)), lambda t: t != "")), " "))
        rows = F.transform(F.filter(_upto(size["h"]), lambda r: r >= heads), lambda r: F.transform(_upto(size["w"]), lambda c: text(r, c)))
        merged = F.transform(F.filter(own, lambda x: (x["row_span"] > 1) | (x["col_span"] > 1)), lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"), x["row_span"].alias("row_span"), x["col_span"].alias("col_span"), x["text"].alias("text")))
        return F.struct(headers.alias("headers"), rows.alias("rows"), merged.alias("merged"))

    return let(plain, sized)


def filled_from_sidecar(tables: DataFrame, sidecars: DataFrame) -> DataFrame:
    """tables (doc_id, nth from 0, headers, rows) where those without any cell get the cells of the table at the same place in
    the document's Markdown (doc_id, text), in which tables stand as HTML; filled tells which."""
    there = html_tables(sidecars, "doc_id", "text").select("doc_id", F.col("pos").alias("nth"), F.col("headers").alias("md_headers"), F.col("rows").alias("md_rows"))
    empty = (F.coalesce(F.size("headers"), F.lit(0)) <= 0) & (F.coalesce(F.size("rows"), F.lit(0)) <= 0)
    joined = tables.join(there, ["doc_id", "nth"], "left").withColumn("filled", empty & F.col("md_headers").isNotNull())
    return joined.withColumns({"headers": F.when(F.col("filled"), F.col("md_headers")).otherwise(F.col("headers")), "rows": F.when(F.col("filled"), F.col("md_rows")).otherwise(F.col("rows"))}).drop("md_headers", "md_rows")
