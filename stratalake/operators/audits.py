"""Quality audits, golden-set evaluation and corpus fingerprints."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from stratalake.core.storage import materialize
from stratalake.functions.text import KIND_NAMES, f1, golden_kind, golden_name, safe_div


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, characters, documents and a snapshot that changes with any chunk's id or text, in any order.

    The snapshot adds up 60-bit pieces of each row's SHA-256, so that it is a sum and needs no sorted collection."""
    h = F.sha2(F.concat_ws("\x00", "chunk_id", "text").cast("binary"), 256)
    piece = lambda at: F.sum(F.conv(F.substring(h, at, 8), 16, 10).cast("long")).cast("string")
    return chunks.agg(
        F.count("*").alias("chunk_count"), F.sum(F.length("text")).cast("long").alias("total_chars"), F.countDistinct("doc_id").alias("document_count"),
        F.sha2(F.concat_ws(":", piece(1), piece(9), piece(17), piece(25)).cast("binary"), 256).alias("snapshot"),
    )


def layer_counts(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each document its blocks by kind, chunks, empty chunks, and characters of the longest chunk."""
    b = blocks.groupBy("doc_id").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "list").alias("lists"), F.count_if(F.col("kind") == "table").alias("tables")
    )
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.trim("text") == "").alias("empty_chunks"), F.max(F.length("text")).cast("long").alias("longest"))
    zero = ["blocks", "headings", "lists", "tables", "chunks", "empty_chunks", "longest"]
    return b.join(c, "doc_id", "full").fillna(0, subset=zero)


def layer_issues(docs: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """severity, code, doc_id and count: documents without blocks or chunks, empty chunks, chunks whose blocks are missing."""
    d = docs.select("doc_id").distinct()
    issue = lambda df, severity, code: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "doc_id", F.col("n").cast("long").alias("n"))
    no_blocks = d.join(blocks.select("doc_id"), "doc_id", "left_anti").withColumn("n", F.lit(1))
    no_chunks = d.join(chunks.select("doc_id"), "doc_id", "left_anti").withColumn("n", F.lit(1))
    empty = chunks.where(F.trim("text") == "").groupBy("doc_id").agg(F.count("*").alias("n"))
    out = issue(no_blocks, "error", "l0.empty_doc").unionByName(issue(no_chunks, "error", "l1.empty_doc")).unionByName(issue(empty, "error", "l1.empty_chunk_text"))
    if "block_ids" in chunks.columns:
        refs = chunks.select("doc_id", F.explode("block_ids").alias("id"))
        lost = refs.join(blocks.select("id"), "id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))
        orphan = chunks.where(F.size("block_ids") == 0).groupBy("doc_id").agg(F.count("*").alias("n"))
        out = out.unionByName(issue(lost, "error", "l1.missing_block_ref")).unionByName(issue(orphan, "error", "l1.orphan_chunk"))
    return out


def overlaps(intervals: DataFrame, group: str, low: str, high: str, id_col: str) -> DataFrame:
    """Intervals that begin before their predecessor in the group has ended, with that predecessor."""
    order = Window.partitionBy(group).orderBy(low, high, id_col)
    seen = intervals.withColumn("prev_id", F.lag(id_col).over(order)).withColumn("prev_high", F.lag(high).over(order))
    return seen.where(F.col(low) <= F.col("prev_high")).select(group, F.col(id_col).alias("id"), "prev_id")


def provenance_issues(nodes: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """node, code: entities without source blocks or chunks, and those that name missing ones."""
    lost = lambda col, there, code: nodes.select("id", F.explode(col).alias("ref")).join(there.select(F.col("id").alias("ref")), "ref", "left_anti").select("id", F.lit(code).alias("code")).distinct()
    none = lambda col, code: nodes.where(F.size(F.coalesce(col, F.array().cast("array<string>"))) <= 0).select("id", F.lit(code).alias("code"))
    return (
        none("source_block_ids", "l2.missing_source_blocks").unionByName(none("source_chunk_ids", "l2.missing_source_chunks"))
        .unionByName(lost("source_block_ids", blocks, "l2.bad_source_block")).unionByName(lost("source_chunk_ids", chunks, "l2.bad_source_chunk"))
    )


def trust_issues(nodes: DataFrame) -> DataFrame:
    """Facts that aren't verified, whose method isn't deterministic or manual, or that have errors."""
    bad = F.array_compact(F.array(
        F.when(~F.col("method").isin("deterministic", "manual"), "l2.fact_method"), F.when(~F.col("verified"), "l2.fact_unverified"), F.when(F.col("errors") > 0, "l2.fact_has_errors"),
    ))
    return nodes.where("status = 'fact'").select("id", F.explode(bad).alias("code"))


def golden_eval(expected: DataFrame, actual: DataFrame, key: list[str], group: str = "kind") -> DataFrame:
    """For each group true and false positives, false negatives, precision, recall and F1 over distinct keys."""
    e = expected.select(group, *key).distinct().withColumn("e", F.lit(1))
    a = actual.select(group, *key).distinct().withColumn("a", F.lit(1))
    both = e.join(a, [group, *key], "full")
    out = both.groupBy(group).agg(F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    p, r = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def low_confidence(edges: DataFrame, least: float = 0.85, limit: int = 50) -> DataFrame:
    """Edges to review, the least certain first."""
    return edges.where(F.col("confidence") < least).orderBy("confidence", "src", "dst", "kind").limit(limit)


def bits_clash(of_register: WindowSpec, low: str, high: str, idx: str) -> Column:
    """Whether a field has no valid bits or begins before the end of one that comes before it in its register (by low and idx)."""
    before = of_register.orderBy(low, idx).rowsBetween(Window.unboundedPreceding, -1)
    valid = F.coalesce((F.col(low) >= 0) & (F.col(low) <= F.col(high)), F.lit(False))
    return ~valid | F.coalesce(F.max(high).over(before) >= F.col(low), F.lit(False))


def best_bitfields(fields: DataFrame) -> DataFrame:
    """fields (register, idx, name, low, high) with kept: of each register's fields the set without overlaps that covers
    most bits, then holds most fields. A register whose fields don't overlap keeps all; the others, small groups, are
    scheduled in pandas."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").reset_index(drop=True)
        valid = [i for i in range(len(pdf)) if 0 <= pdf["low"][i] <= pdf["high"][i]]
        valid.sort(key=lambda i: (pdf["high"][i], pdf["low"][i], pdf["idx"][i]))
        best: list[tuple[int, int, tuple]] = [(0, 0, ())]
        ends = [pdf["high"][i] for i in valid]
        for n, i in enumerate(valid):
            before = max((k for k in range(n) if ends[k] < pdf["low"][i]), default=-1) + 1
            bits, count, chosen = best[before]
            take = (bits + int(pdf["high"][i] - pdf["low"][i]) + 1, count + 1, tuple(sorted((*chosen, int(pdf["idx"][i])))))
            best.append(max(best[n], take))
        pdf["kept"] = pdf["idx"].isin(best[-1][2])
        return pdf[["register", "idx", "name", "low", "high", "kept"]]

    named = fields.select("register", F.col("idx").cast("int").alias("idx"), "name", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"))
    of_register = Window.partitionBy("register")
    seen = materialize(named.withColumn("over", bits_clash(of_register, "low", "high", "idx")).withColumn("hard", F.max("over").over(of_register)).drop("over"), "bitfields")
    easy = seen.where("NOT hard").select("register", "idx", "name", "low", "high", F.lit(True).alias("kept"))
    return easy.unionByName(seen.where("hard").drop("hard").groupBy("register").applyInPandas(one, "register string, idx int, name string, low int, high int, kept boolean"))


def golden_entities(files: DataFrame) -> DataFrame:
    """kind, name, doc_id of golden files (path, content): a list whose kind the file's name tells (expected_<kind>.json), an
    object with a kind and a name, or an object of lists by kind. Names may be strings or objects; entries without one, and
    files that aren't JSON, are left out."""

    def items_of(path: str, content: str) -> list[tuple]:
        try:
            data = json.loads(content)
        except ValueError:
            return []
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        if isinstance(data, list):
            pairs = [(stem.removeprefix("expected_"), x) for x in data] if stem.startswith("expected_") else []
        elif not isinstance(data, dict):
            pairs = []
        elif "kind" in data and ("name" in data or "symbol" in data):
            pairs = [(str(data["kind"]), data)]
        else:
            pairs = [(k, x) for k, v in data.items() for x in (v if isinstance(v, list) else [v])]
        out = []
        for kind, x in pairs:
            fields = x if isinstance(x, dict) else {"name": x} if isinstance(x, str) else {}
            name = next((fields[c] for c in ("name", "symbol", "qualified_name", "id") if fields.get(c)), None)
            if name:
                out.append((kind, str(name), None if fields.get("doc_id") is None else str(fields["doc_id"])))
        return out

    def run(batches):
        for batch in batches:
            rows = [r for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in items_of(p, c or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["kind", "name", "doc_id"])

    found = files.select("path", F.col("content").cast("string")).mapInArrow(run, "kind string, name string, doc_id string")
    known = found.withColumn("kind", golden_kind(F.col("kind")))
    return known.where(F.col("kind").isin(*GOLDEN_KINDS))


#: Kinds that golden files can hold.
GOLDEN_KINDS = tuple(dict.fromkeys(KIND_NAMES.values()))


def golden_matches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """expected (kind, name, doc_id) and actual rows with what they are: found, missing or unexpected. Rows are compared by
    kind, name and document where the golden one names a document, else by kind and name; actual rows of other documents
    than those that a kind's golden rows name don't count."""
    e = expected.select("kind", golden_name(F.col("name")).alias("key"), "doc_id").distinct()
    docs = e.where("doc_id IS NOT NULL").select("kind", "doc_id").distinct()
    scoped = docs.select("kind").distinct().withColumn("scoped", F.lit(True))
    a = actual.select("kind", golden_name(F.col("name")).alias("key"), "doc_id").distinct().join(e.select("kind").distinct(), "kind", "left_semi")
    a = a.join(scoped, "kind", "left").join(docs.withColumn("own", F.lit(True)), ["kind", "doc_id"], "left").where("scoped IS NULL OR own").drop("scoped", "own")
    exact = a.where("doc_id IS NOT NULL").withColumn("hit", F.lit(True))
    loose = a.select("kind", "key").distinct().withColumn("hit", F.lit(True))
    told = e.where("doc_id IS NOT NULL").join(exact, ["kind", "key", "doc_id"], "left").unionByName(e.where("doc_id IS NULL").join(loose, ["kind", "key"], "left").select("kind", "key", "doc_id", "hit"))
    rows = told.select("kind", "key", "doc_id", F.when(F.col("hit"), "found").otherwise("missing").alias("state"))
    # A kind all of whose golden rows name documents is compared by document throughout.
    strict = e.groupBy("kind").agg((F.count_if(F.col("doc_id").isNull()) == 0).alias("strict"))
    by_doc = a.join(strict.where("strict").select("kind"), "kind", "left_semi").join(e.where("doc_id IS NOT NULL"), ["kind", "key", "doc_id"], "left_anti")
    by_name = a.join(strict.where("NOT strict").select("kind"), "kind", "left_semi").join(e.where("doc_id IS NULL").select("kind", "key"), ["kind", "key"], "left_anti")
    return rows.unionByName(by_doc.unionByName(by_name).select("kind", "key", "doc_id", F.lit("unexpected").alias("state")))


def candidate_audit(tables: DataFrame, kinds: list[str], nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For tables (doc_id, id, schemas: the kinds that they match): a row for each document, one for each kind, and the issues
    (code, doc_id, kind): documents whose tables match nothing, kinds that nothing matches, kinds that match but have no
    nodes (doc_id, kind)."""
    # What a table matches is told once and written: both counts and all issues read only that, a row a document.
    own = F.array_intersect("schemas", F.array(*[F.lit(k) for k in kinds]))
    matches = tables.select("doc_id", own.alias("own")).groupBy("doc_id").agg(F.count("*").alias("tables"), F.sum(F.greatest(F.size("own"), F.lit(0))).alias("hits"), *[F.count_if(F.array_contains("own", k)).alias(f"of_{i}") for i, k in enumerate(kinds)])
    told = materialize(matches, "matches")
    by_doc = told.select("doc_id", "tables", "hits").join(nodes.groupBy("doc_id").agg(F.count("*").alias("nodes")), "doc_id", "left").fillna(0)
    sums = told.agg(*[x for i in range(len(kinds)) for x in (F.sum(f"of_{i}").alias(f"n_{i}"), F.count_if((F.col(f"of_{i}") > 0) & F.col("doc_id").isNotNull()).alias(f"docs_{i}"))])
    per_kind = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{i}").alias("matched"), F.col(f"docs_{i}").alias("docs")) for i, k in enumerate(kinds) if k not in kinds[:i]])).alias("k")).select("k.*")
    names = tables.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    by_kind = names.join(per_kind, "kind", "left").join(nodes.groupBy("kind").agg(F.count("*").alias("nodes")), "kind", "left").fillna(0).withColumn("rate", safe_div(F.col("nodes"), F.col("matched")))
    none = F.lit(None).cast("string")
    issues = (
        told.where("hits = 0").select(F.lit("l2.table_no_schema_hits").alias("code"), F.col("doc_id").cast("string").alias("doc_id"), none.alias("kind"))
        .unionByName(by_kind.where("matched = 0").select(F.lit("l2.schema_no_candidates").alias("code"), none.alias("doc_id"), "kind"))
        .unionByName(by_kind.where("matched > 0 AND nodes = 0").select(F.lit("l2.matched_but_no_nodes").alias("code"), none.alias("doc_id"), "kind"))
    )
    return by_doc, by_kind, issues
