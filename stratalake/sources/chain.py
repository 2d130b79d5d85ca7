"""Parsers one after another: what one can't read, or reads poorly, goes to the next of its chain, with the reasons kept."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.core.storage import materialize
from stratalake.sources import files
from stratalake.sources.layout import parse_verdict

Parser = Callable[[bytes], list[dict]]

#: Names of the built-in parsers, and the chain of each ending.
PARSERS: dict[str, Parser] = {"markdown": files.PARSERS[".md"], "xlsx": files.xlsx_blocks, "docx": files.docx_blocks}
CHAINS: dict[str, list[str]] = {".md": ["markdown"], ".markdown": ["markdown"], ".xlsx": ["xlsx"], ".docx": ["docx"]}

_BLOCKS = f"array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in files.BLOCK_SCHEMA.split(', '))}>>"
_ATTEMPT = "struct<parser:string,status:string,reason:string>"


def _round(parsers: dict[str, Parser], nth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, reasons = [], []
            for content, chain in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parse = parsers.get(chain[nth])
                found, reason = [], None if parse else "not registered"
                if parse:
                    try:
                        found = parse(content)
                        reason = None if found else "no blocks"
                    except (OSError, KeyError, ValueError, RuntimeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                        reason = f"{type(e).__name__}: {e}"[:200]
                blocks.append(found)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(blocks, files._BLOCK_TYPE), pa.array(reasons, pa.string())], ["path", "chain", "blocks", "reason"])

    return run


def parse_chain(found: DataFrame, chains: dict[str, list[str]] | None = None, parsers: dict[str, Parser] | None = None, judged: tuple[str, ...] = (".pdf",)) -> tuple[DataFrame, DataFrame]:
    """Blocks (doc_id and those of files.parse_files) of files (path, content), and for each file doc_id, parser, status (ok,
    degraded: not by the first of its chain, failed, unsupported: there is no chain) and attempts (parser, status, reason).

    chains: for each ending of a name the parsers that are tried in order. A parser fails if it raises, gives no block or, for
    the endings in judged, so few characters that the pages look scanned (parse_verdict). There are as many rounds as the
    longest chain has parsers; each goes over the files that are left, and the last result of each is written."""
    chains, parsers = CHAINS if chains is None else chains, PARSERS if parsers is None else {**PARSERS, **parsers}
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    known = F.create_map(*[x for e, c in chains.items() for x in (F.lit(e), F.array(*[F.lit(p) for p in c]))]) if chains else F.lit(None).cast("map<string,array<string>>")
    left = found.select("path", "content", F.coalesce(F.try_element_at(known, ending), F.array().cast("array<string>")).alias("chain"))
    contents = left
    done, tried = None, None
    for nth in range(max((len(c) for c in chains.values()), default=0)):
        got = left.where(F.size("chain") > nth).mapInArrow(_round(parsers, nth), f"path string, chain array<string>, blocks {_BLOCKS}, reason string")
        chars = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.length(F.coalesce(b["text"], F.lit(""))) + F.aggregate(F.flatten(F.coalesce(b["rows"], F.array().cast("array<array<string>>"))), F.lit(0).cast("long"), lambda x, y: x + F.length(F.coalesce(y, F.lit("")))))
        pages = F.greatest(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["page"])), F.lit(1)), F.lit(1))
        verdict = F.when(ending.isin(*judged), parse_verdict(chars, pages)).otherwise("ok") if judged else F.lit("ok")
        told = got.withColumn("reason", F.coalesce("reason", F.when(verdict != "ok", F.concat(F.lit("quality: "), verdict))))
        told = materialize(told.withColumn("attempt", F.struct(F.get("chain", F.lit(nth)).alias("parser"), F.when(F.col("reason").isNull(), "succeeded").when(F.col("reason") == "not registered", "unavailable").otherwise("failed").alias("status"), "reason")), "parsed")
        attempts = told.select("path", F.lit(nth).alias("nth"), "attempt")
        tried = attempts if tried is None else tried.unionByName(attempts)
        good = told.where("reason IS NULL").select(F.col("path").alias("doc_id"), F.inline("blocks"))
        done = good if done is None else done.unionByName(good)
        left = contents.join(told.where("reason IS NOT NULL").select("path"), "path", "left_semi").select("path", "content", "chain")
        if told.where(F.col("reason").isNotNull() & (F.size("chain") > nth + 1)).isEmpty():
            break
    spark = found.sparkSession
    if done is None:
        done = spark.createDataFrame([], f"doc_id string, {files.BLOCK_SCHEMA}")
        tried = spark.createDataFrame([], f"path string, nth int, attempt {_ATTEMPT}")
    listed = tried.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "attempt"))), lambda x: x["attempt"]).alias("attempts"))
    report = contents.select("path").join(listed, "path", "left").withColumn("attempts", F.coalesce("attempts", F.array().cast(f"array<{_ATTEMPT}>")))
    last = F.element_at("attempts", -1)
    status = F.when(F.size("attempts") == 0, "unsupported").when(last["status"] != "succeeded", "failed").when(F.size("attempts") > 1, "degraded").otherwise("ok")
    told = report.select(F.col("path").alias("doc_id"), F.when(status.isin("ok", "degraded"), last["parser"]).alias("parser"), status.alias("status"), "attempts")
    ident = F.concat("doc_id", F.lit("#p"), F.col("page").cast("string"), F.lit("#b"), F.col("reading_order").cast("string"))
    return done.withColumn("id", ident), told


def fallback_reason(attempts: str = "attempts") -> Column:
    """What went wrong before the parser that succeeded; null if nothing did."""
    bad = F.filter(attempts, lambda a: a["status"] != "succeeded")
    said = F.array_join(F.transform(bad, lambda a: F.concat(a["parser"], F.lit(": "), F.coalesce(a["reason"], a["status"]))), "; ")
    return F.when(F.size(bad) > 0, said)
