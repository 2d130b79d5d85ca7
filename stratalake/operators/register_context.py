"""Registers that are announced in one table and laid out in others: a queue of names that is carried over a document's tables.

A table that lists registers puts their names into the queue; a table of bit fields without a caption takes the first. That is
a queue from which nothing can be taken when it is empty, so its length after each table is the sum of what was put in and
asked for, less the least such sum so far (or zero): two running aggregates, which are made over stretches of a document and
then over the stretches, so that a document of any length is gone through by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.core.storage import materialize
from stratalake.operators import extract
from stratalake.operators.extract import AWAITED

#: Places in reading order of a stretch of a document.
STRETCH = 4096
#: Headers that tell a table of bit fields, beside one that holds "bit".
FIELD_HEADERS = ("name", "field", "bit field", "bitfield", "description", "function", "type")


def field_table(headers: Column, rows: Column) -> Column:
    """Whether a table looks like the bit fields of one register: bits and fields, but no numbers of registers."""
    plain = extract.plain_headers(headers)
    bits, named = F.exists(plain, lambda h: F.contains(h, F.lit("bit"))), F.exists(plain, lambda h: h.isin(*FIELD_HEADERS))
    return (F.coalesce(F.size(rows), F.lit(0)) > 0) & bits & named & extract.register_number_column(plain).isNull()


def queued(events: DataFrame) -> DataFrame:
    """events (doc_id, pos, table_id, puts, takes 0 or 1) with first (the number of the first name that is put in, from 1) and
    taken (the number of the name that is taken; null for none), in the order of pos and table_id."""
    step = F.col("puts") - F.col("takes")
    order = Window.partitionBy("doc_id", "stretch").orderBy("pos", "table_id")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("stretch", F.floor(F.col("pos") / STRETCH)).withColumns({"sum": F.sum(step).over(upto), "put": F.sum("puts").over(upto)})
    near = near.withColumn("least", F.min("sum").over(before))
    far = near.groupBy("doc_id", "stretch").agg(F.sum(step).alias("step"), F.sum("puts").alias("all_put"), F.min("sum").alias("own_least"))
    earlier = Window.partitionBy("doc_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    far = far.withColumns({"sum_before": F.coalesce(F.sum("step").over(earlier), F.lit(0)), "put_before": F.coalesce(F.sum("all_put").over(earlier), F.lit(0))})
    far = far.withColumn("least_before", F.min(F.col("sum_before") + F.col("own_least")).over(earlier)).select("doc_id", "stretch", "sum_before", "put_before", "least_before")
    told = near.join(far, ["doc_id", "stretch"])
    # What the queue holds before this table: sums up to the last one, less the least of them or zero.
    least = F.least(F.lit(0), F.col("least_before"), F.col("sum_before") + F.col("least"))
    held = F.col("sum_before") + F.col("sum") - step - least
    put = F.col("put_before") + F.col("put")
    return told.select(*events.columns, (put - F.col("puts") + 1).alias("first"), F.when((F.col("takes") == 1) & (held > 0), put - F.col("puts") - held + 1).alias("taken"))


def registers_in_order(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What extract.registers gives of tables (doc_id, id, pos, caption, headers, rows), where a table of bit fields without a
    caption belongs to the first register announced before it (in the order of pos and id) that has no fields yet. A table
    that would give no field takes none; one for which none is left gives none, but for rows that name their register."""
    blank = F.coalesce(F.trim("caption"), F.lit("")) == ""
    regs, fields = extract.registers(tables.withColumn("awaits", blank & field_table(F.col("headers"), F.col("rows"))))
    regs, fields = materialize(regs, "announced"), materialize(fields, "laid-out")
    with_fields = fields.select("doc_id", "table_id").distinct()
    lists = regs.join(with_fields, ["doc_id", "table_id"], "left_anti")
    puts = lists.groupBy("doc_id", "table_id").agg(F.count("*").alias("puts"))
    asks = F.coalesce(blank & field_table(F.col("headers"), F.col("rows")), F.lit(False))
    at = tables.select("doc_id", F.col("id").alias("table_id"), "pos", asks.alias("asks"))
    # What a table puts in and takes is joined to its place. A union of both below a join fails: Spark 4.1 counts on its parts
    # being dealt alike when it plans the join, but no longer does so where shuffles are used again ("Can't zip RDDs").
    both = at.join(puts, ["doc_id", "table_id"], "left").join(with_fields.withColumn("laid", F.lit(True)), ["doc_id", "table_id"], "left")
    both = both.withColumns({"puts": F.coalesce("puts", F.lit(0).cast("long")), "takes": F.coalesce(F.col("laid") & F.col("asks"), F.lit(False)).cast("long")})
    events = materialize(both.where("puts > 0 OR takes > 0").select("doc_id", "table_id", "puts", "takes", "pos"), "events")
    told = materialize(queued(events), "queued")
    nth = F.row_number().over(Window.partitionBy("doc_id", "table_id").orderBy("pos", "name"))
    names = lists.select("doc_id", "table_id", "name", nth.alias("nth")).join(told.select("doc_id", "table_id", "first"), ["doc_id", "table_id"]).select("doc_id", "name", (F.col("first") + F.col("nth") - 1).alias("taken"))
    of_table = told.where("taken IS NOT NULL").select("doc_id", "table_id", "taken").join(names, ["doc_id", "taken"]).select("doc_id", "table_id", F.col("name").alias("context"))

    def resolved(df: DataFrame, column: str) -> DataFrame:
        named = df.where(F.col(column) == AWAITED).join(of_table, ["doc_id", "table_id"]).withColumn(column, F.col("context")).select(df.columns)
        return df.where(F.col(column) != AWAITED).unionByName(named)

    return resolved(regs, "name"), resolved(fields, "register")
