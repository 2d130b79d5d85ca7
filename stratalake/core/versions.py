"""Layers of older versions, read as the current one: each step adds or fills columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CURRENT = 4


def _with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def _chunks_2(df: DataFrame) -> DataFrame:
    out = _with_missing(df, {"block_ids": "array<string>"})
    return out.withColumn("block_ids", F.coalesce("block_ids", F.array().cast("array<string>")))


def _chunks_3(df: DataFrame) -> DataFrame:
    out = _with_missing(df, {"page": "int", "page_start": "int", "page_end": "int", "chunk_type": "string", "source_hash": "string"})
    return out.withColumns({"page_start": F.coalesce("page_start", "page"), "page_end": F.coalesce("page_end", "page_start", "page"), "chunk_type": F.coalesce("chunk_type", F.lit("section"))})


def _nodes_4(df: DataFrame) -> DataFrame:
    kind = "struct<chunk_ids:array<string>,pages:array<int>,extractor:string>"
    none = F.struct(F.array().cast("array<string>").alias("chunk_ids"), F.array().cast("array<int>").alias("pages"), F.lit(None).cast("string").alias("extractor"))
    out = _with_missing(df, {"evidence": kind})
    return out.withColumn("evidence", F.coalesce("evidence", none))


STEPS: dict[int, dict[str, Callable[[DataFrame], DataFrame]]] = {2: {"chunks": _chunks_2}, 3: {"chunks": _chunks_3}, 4: {"nodes": _nodes_4}}


def upgraded(df: DataFrame, layer: str, version: int) -> DataFrame:
    """A layer that was written by a version, with the current version's columns; ValueError for newer ones."""
    if not 1 <= version <= CURRENT:
        raise ValueError(f"unknown version {version}")
    for step in range(version + 1, CURRENT + 1):
        df = STEPS[step].get(layer, lambda x: x)(df)
    return df
