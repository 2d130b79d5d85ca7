"""Vectors of nodes and chunks: the texts that are encoded, what is stale, and an encoder that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.core.storage import materialize
from stratalake.functions.text import blank_to_null, content_hash
from stratalake.operators.retrieval import stale_items


def node_text(name: Column, qualified: Column, summary: Column, description: Column, full: Column) -> Column:
    """Name, qualified name if it is another, summary, the description's first 300 characters and the full form."""
    other = F.when(qualified != name, blank_to_null(qualified))
    return F.concat_ws(" | ", F.coalesce(name, F.lit("")), other, blank_to_null(summary), blank_to_null(F.substring(description, 1, 300)), blank_to_null(full))


def chunk_text(section: Column, start: Column, end: Column, kind: Column, caption: Column, headers: Column, text: Column) -> Column:
    """Section, pages, the table's kind, caption and twelve headers, and the text's first 4000 characters, a line each."""
    pages = F.when(end.isNotNull() & (end != start), F.concat(F.lit("pages "), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(F.concat(F.lit("page "), start.cast("string")))
    named = F.when(F.size(headers) > 0, F.concat(F.lit("headers: "), F.array_join(F.slice(headers, 1, 12), " | ")))
    return F.concat_ws("\n", F.concat(F.lit("section "), blank_to_null(section)), F.when(start > 0, pages), blank_to_null(kind), blank_to_null(caption), named, blank_to_null(F.substring(F.coalesce(text, F.lit("")), 1, 4000)))


def encoded(items: DataFrame, encoder: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 64) -> DataFrame:
    """items (item_id, text, content_hash) with vector. The encoder gets batches of texts and gives a vector of dim for each;
    anything else is an error, and nothing of the batch is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                vectors = encoder(part.column("text").to_pylist())
                if len(vectors) != part.num_rows or any(len(v) != dim for v in vectors):
                    raise ValueError(f"the encoder gave {len(vectors)} vectors for {part.num_rows} texts, or some without {dim} numbers")
                yield pa.RecordBatch.from_arrays([part.column("item_id"), part.column("content_hash"), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float64()))], ["item_id", "content_hash", "vector"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text", "content_hash").mapInArrow(run, f"item_id {kind}, content_hash string, vector array<double>")


def embedded(items: DataFrame, stored: DataFrame, encoder: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 64) -> DataFrame:
    """The vectors (item_id, content_hash, vector) that items (item_id, text) should have: stored ones whose text is the same
    stay, missing and changed ones are encoded, those of items that are gone go."""
    wanted = items.withColumn("content_hash", content_hash(F.col("text")))
    todo = materialize(stale_items(wanted.select("item_id", "content_hash"), stored.select("item_id", "content_hash")), "stale")
    new = encoded(wanted.join(todo.where("action <> 'prune'").select("item_id"), "item_id", "left_semi"), encoder, dim, batch)
    return stored.join(todo.select("item_id"), "item_id", "left_anti").select("item_id", "content_hash", "vector").unionByName(new)
