"""Register descriptions as IP-XACT and SystemRDL, one document a component."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.core.session import few_at_once
from stratalake.core.storage import materialize
from stratalake.functions.text import format_reset, ipxact_access, rdl_access

#: Bytes of components' texts after which a task takes no further component.
GROUP_BYTES = 1 << 26
#: Bytes of heap for each byte of a long text: handing it on and writing it as Parquet keeps that many copies (a text of 580 MB
#: fails with 5 GB of heap and passes with 6).
COPIES = 9
#: What XML writes otherwise.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def _xml(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for char, entity in ENTITIES:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def _identifier(c: Column) -> Column:
    return F.regexp_replace(c, r"\W", "_")


def _joined(registers: DataFrame, fields: DataFrame, line: Column) -> DataFrame:
    """registers with the lines of their fields, highest bit first."""
    lines = fields.withColumn("line", line).groupBy("register").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("high")).alias("k"), "name", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return registers.join(lines, registers["name"] == lines["register"], "left").withColumn("lines", F.coalesce("lines", F.lit("")))


def _component(rows: DataFrame, line: Column, head: Callable[[str | None], str | None], tail: str) -> DataFrame:
    """One text for each component, its registers by name. A component's lines are sorted by Spark, which spills, and written in
    their order; then each long component has a task of its own, of which an executor runs as many at a time as its heap has
    room for (see few_at_once), as a component's text is one row, however long."""
    spark, tasks = rows.sparkSession, _tasks(rows)
    lines = rows.select(F.col("component").cast("string").alias("component"), "name", line.alias("text")).repartition(tasks, "component").sortWithinPartitions("component", "name", "text")
    ended = lines.select("component", F.concat("text", F.lit("\n")).cast("binary").alias("line"), F.monotonically_increasing_id().alias("place"))
    placed = materialize(ended.withColumn("bytes", F.coalesce(F.octet_length("line"), F.lit(0))), "component-lines")
    # The components that a task has sorted, cut into groups where GROUP_BYTES are full; places begin with the task's number.
    sizes = placed.groupBy("component").agg(F.sum("bytes").alias("bytes"), F.min("place").alias("first")).withColumn("task", F.shiftright("first", 33).cast("int"))
    of_task = Window.partitionBy("task")
    before = F.coalesce(F.sum("bytes").over(of_task.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = sizes.withColumn("full", F.floor(before / GROUP_BYTES)).withColumn("group", F.dense_rank().over(of_task.orderBy("full")) - 1)
    grouped = materialize(grouped.select(F.col("component").alias("own"), "task", "group", "bytes"), "component-groups")
    groups, longest = grouped.groupBy("task", "group").agg(F.sum("bytes").alias("bytes")).agg(F.max("group") + 1, F.max("bytes")).first()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def text_of(key: str | None, body: bytearray, n: int, told: bool) -> pa.RecordBatch:
            body += tail.encode() if told else f"\n{tail}".encode()
            text = pa.StringArray.from_buffers(1, pa.py_buffer(struct.pack("<2i", 0, len(body))), pa.py_buffer(body))
            return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([n], pa.int64()), text], ["component", "registers", "text"])

        key, body, n, told = None, bytearray(), 0, False
        for batch in batches:
            start = 0
            for own, count in _runs(batch.column(0)):
                if not n or own != key:
                    if n:
                        yield text_of(key, body, n, told)
                    key, n, told = own, 0, False
                    begun = head(key)
                    body = bytearray() if begun is None else bytearray(f"{begun}\n".encode())
                run = batch.column(1).slice(start, count)
                n, start, told = n + count, start + count, told or run.null_count < count
                body += _bytes(run)
        if n:
            yield text_of(key, body, n, told)

    dealt = placed.join(grouped.select("own", "task", "group"), F.col("component").eqNullSafe(F.col("own"))).repartitionById(tasks * (groups or 1), F.col("group") * tasks + F.col("task"))
    texts = dealt.sortWithinPartitions("place").select("component", "line")
    return texts.mapInArrow(whole, "component string, registers long, text string", profile=few_at_once(spark, COPIES * (longest or 0)))


def _runs(keys: pa.Array) -> Iterator[tuple[str | None, int]]:
    """Adjacent equal keys, which come one after another, and how many there are."""
    if len(keys) and keys[0].as_py() == keys[-1].as_py():
        yield keys[0].as_py(), len(keys)
    else:
        yield from ((own, len(list(run))) for own, run in groupby(keys.to_pylist()))


def _bytes(values: pa.Array) -> memoryview:
    """The bytes of adjacent values, one after another; none for nulls."""
    _, ends, data = values.buffers()
    at = memoryview(ends).cast("q" if pa.types.is_large_binary(values.type) else "i")
    return memoryview(data or b"")[at[values.offset] : at[values.offset + len(values)]]


def _tasks(df: DataFrame) -> int:
    """As many tasks as shuffles have; a stated number is not put together by adaptive execution, which looks at compressed sizes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ipxact(registers: DataFrame, fields: DataFrame, family: str = "unknown") -> DataFrame:
    """component, registers, text (IP-XACT 1685-2014 subset) from registers (component, name, offset, width, access,
    description) and fields (register, name, high, low, access, description)."""
    tag = lambda name, value: F.concat(F.lit(f"<ipxact:{name}>"), _xml(value.cast("string")), F.lit(f"</ipxact:{name}>"))
    width = F.col("high") - F.col("low") + 1
    field = F.concat(F.lit("<ipxact:field>"), tag("name", F.col("name")), tag("bitOffset", F.col("low")), tag("bitWidth", width), tag("access", ipxact_access(F.col("access"))), tag("description", F.col("description")), F.lit("</ipxact:field>"))
    rows = _joined(registers, fields, field)
    reg = F.concat(
        F.lit("<ipxact:register>"), tag("name", F.col("name")), tag("addressOffset", F.coalesce("offset", F.lit("0x0"))), tag("size", F.coalesce("width", F.lit(32))),
        tag("access", ipxact_access(F.col("access"))), F.col("lines"), F.lit("</ipxact:register>"),
    )
    plain = lambda value: reduce(lambda text, x: text.replace(*x), ENTITIES, value or "")
    head = lambda component: (
        '<?xml version="1.0" encoding="UTF-8"?>\n<ipxact:component xmlns:ipxact="http://www.accellera.org/XMLSchema/IPXACT/1685-2014">'
        f"<ipxact:vendor>{plain(family)}</ipxact:vendor><ipxact:name>{plain(component)}</ipxact:name><ipxact:memoryMaps><ipxact:memoryMap><ipxact:addressBlock>"
    )
    return _component(rows, reg, head, "</ipxact:addressBlock></ipxact:memoryMap></ipxact:memoryMaps></ipxact:component>")


def systemrdl(registers: DataFrame, fields: DataFrame) -> DataFrame:
    """component, registers, text (SystemRDL 2.0 subset); fields also have reset."""
    reset = format_reset(F.coalesce(F.col("reset"), F.lit("0")))
    place = F.concat(F.lit("["), F.col("high").cast("string"), F.lit(":"), F.col("low").cast("string"), F.lit("]"))
    field = F.concat(F.lit("    field { sw = "), rdl_access(F.col("access")), F.lit("; } "), _identifier(F.col("name")), place, F.lit(" = "), reset, F.lit(";"))
    rows = _joined(registers, fields, field)
    reg = F.concat(F.lit("  reg {\n"), F.col("lines"), F.lit("\n  } "), _identifier(F.col("name")), F.lit(" @ "), F.coalesce("offset", F.lit("0x0")), F.lit(";"))
    head = lambda component: None if component is None else f"addrmap {re.sub(r'\W', '_', component, flags=re.ASCII)} {{"
    return _component(rows, reg, head, "};")
