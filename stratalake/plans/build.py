"""The build: files to blocks, chunks, entities, edges and links; each stage runs again only for what has changed for it.

A stage's fingerprint of a document is made of its settings and of the fingerprints that it builds on, back to the file's
content. All layers of a build become visible at once, as a snapshot (core/snapshots.py)."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.core.snapshots import Store
from stratalake.core.storage import materialize
from stratalake.operators import chunks, extract, graph, register_context
from stratalake.sources import chain, files

#: Stages with the versions of their code and the stages that they build on; the last is of the whole corpus.
STAGES = {"parse": ("4", ()), "segment": ("2", ("parse",)), "extract": ("4", ("segment",)), "link": ("2", ("extract",))}
LAYERS = {"parse": ("blocks",), "segment": ("chunks",), "extract": ("nodes", "sections", "edges")}
DOC_STAGES = ("parse", "segment", "extract")

Linker = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


@dataclass
class Report:
    """What a build did: path and change of files, documents that each stage went over, and what went wrong on the way."""

    changes: DataFrame
    ran: dict[str, int]
    status: str
    warnings: list[dict] = field(default_factory=list)
    snapshot: int | None = None


def entities_of(blocks: DataFrame, cut: DataFrame) -> dict[str, DataFrame]:
    """nodes (with sources, method, issues and trust), sections and edges (contains between sections, has_bitfield between
    registers and fields) of blocks and their chunks."""
    tables = materialize(blocks.where("kind = 'table'").select("doc_id", "id", "caption", "headers", "rows", (F.col("page").cast("long") * 100_000 + F.col("reading_order")).alias("pos")), "tables")
    nodes = None
    for kind in extract.COLUMNS:
        one = extract.entities(tables.drop("pos"), kind).select("doc_id", "kind", "name", F.array("table_id").alias("source_block_ids"))
        nodes = one if nodes is None else nodes.unionByName(one)
    prose = blocks.where("kind IN ('paragraph', 'heading')")
    nodes = nodes.unionByName(extract.text_entities(prose).select("doc_id", "kind", "name", F.array("block_id").alias("source_block_ids")))
    terms = extract.glossary(prose.select("doc_id", "page", "text"), blocks.where("kind = 'heading'").select("doc_id", "page", F.col("text").alias("title")))
    lines = prose.select("doc_id", "page", "id", F.explode(F.split("text", "\n")).alias("line"))
    told = lines.join(terms, ["doc_id", "page"]).where(F.startswith(F.ltrim("line"), F.col("name"))).groupBy("doc_id", "name").agg(F.array_sort(F.collect_set("id")).alias("source_block_ids"))
    nodes = nodes.unionByName(told.select("doc_id", F.lit("term").alias("kind"), "name", "source_block_ids"))
    pictured = blocks.where("kind = 'figure'").select("doc_id", F.lit("figure").alias("kind"), F.coalesce(F.nullif("caption", F.lit("")), F.nullif("text", F.lit("")), F.col("id")).alias("name"), F.array("id").alias("source_block_ids"))
    nodes = nodes.unionByName(pictured.groupBy("doc_id", "kind", "name").agg(F.array_sort(F.flatten(F.collect_list("source_block_ids"))).alias("source_block_ids")))
    nodes = nodes.withColumn("id", F.concat("kind", F.lit(":"), "name", F.lit("#"), "doc_id"))
    registers, has = extract.register_graph(tables, register_context.registers_in_order)
    nodes = materialize(nodes.unionByName(registers.select("doc_id", "kind", "name", F.array("table_id").alias("source_block_ids"), "id")).withColumn("method", F.lit("deterministic")), "nodes")
    # The chunks that hold a node's blocks.
    homes = cut.select("doc_id", F.col("id").alias("chunk_id"), F.explode("block_ids").alias("block_id"))
    of = nodes.select("doc_id", "id", F.explode("source_block_ids").alias("block_id")).join(homes, ["doc_id", "block_id"]).groupBy("doc_id", "id").agg(F.array_sort(F.collect_set("chunk_id")).alias("source_chunk_ids"))
    sourced = nodes.join(of, ["doc_id", "id"], "left").withColumn("source_chunk_ids", F.coalesce("source_chunk_ids", F.array().cast("array<string>")))
    headings = blocks.where("kind = 'heading'").select("doc_id", F.col("reading_order").alias("pos"), F.coalesce("heading_level", F.lit(1)).alias("level"), F.col("text").alias("title"), "page", F.col("section_path").alias("path"))
    sections, contains = extract.section_graph(headings)
    edges = contains.unionByName(has).withColumn("doc_id", F.substring_index("src", "#", -1))
    return {"nodes": extract.trust(sourced), "sections": sections, "edges": edges}


def _stamp(name: str, settings: dict) -> str:
    """What a stage depends on beside its input."""
    return json.dumps([name, STAGES[name][0], settings.get(name)], sort_keys=True, default=str)


def _fingerprints(settings: dict) -> dict[str, Column]:
    """By stage the fingerprint of a file (content_hash)."""
    out: dict[str, Column] = {}
    for name in DOC_STAGES:
        before = [out[b] for b in STAGES[name][1]] or [F.col("content_hash")]
        out[name] = F.sha2(F.concat_ws("\x00", *before, F.lit(_stamp(name, settings))).cast("binary"), 256)
    return out


def _of_corpus(documents: DataFrame, settings: dict) -> str:
    """The fingerprint of the last stage: of all documents' ones, in any order, and its own settings."""
    piece = lambda at: F.sum(F.conv(F.substring("extract", at, 12), 16, 10).cast("long")).cast("string")
    whole = documents.agg(F.concat_ws(":", F.count("*"), piece(1), piece(13), piece(25))).first()[0]
    return f"{whole} {_stamp('link', settings)}"


def run_build(spark: SparkSession, root: str, out: str, include: str = "*", exclude: list[str] | None = None, settings: dict | None = None, chains: dict[str, list[str]] | None = None, parsers: dict[str, chain.Parser] | None = None, linkers: dict[str, Linker] | None = None) -> Report:
    """Brings the layers under out up to date with the files under root.

    settings: for each stage whatever its results depend on; a stage runs for the documents whose fingerprint has changed,
    from the stored results of the stages before it. chains and parsers are those of chain.parse_chain and count as settings
    of parse. A file that no parser reads keeps its old rows, degrades the build and is tried again by the next; so does a
    linker that fails, whose old links stay. linkers: name to a function of nodes, blocks and sections that gives edges."""
    settings = {**(settings or {}), "parse": [(settings or {}).get("parse"), chains, sorted(parsers or {})]}
    linkers = {"alias_xref": link} if linkers is None else linkers
    settings["link"] = [settings.get("link"), sorted(linkers)]
    store = Store(spark, out)
    before = store.read("documents")
    manifest = store.manifest()
    found = files.discover(spark, root, include, exclude)
    hashed = found.select(F.col("path").alias("doc_id"), F.sha2("content", 256).alias("content_hash"), "length")
    now = materialize(hashed.withColumns(_fingerprints(settings)), "now")
    if before is None:
        before = now.where("false").withColumns({"status": F.lit("ok"), "parser": F.lit(""), "reason": F.lit("")})
    old = before.select("doc_id", *[F.col(c).alias(f"old_{c}") for c in ("content_hash", *DOC_STAGES)])
    both = now.join(old, "doc_id", "full")
    stale = {name: F.col(name).isNotNull() & ~F.col(name).eqNullSafe(F.col(f"old_{name}")) for name in DOC_STAGES}
    change = F.when(F.col("content_hash").isNull(), "removed").when(F.col("old_content_hash").isNull(), "added").when(reduce(lambda a, b: a | b, stale.values()), "modified")
    todo = materialize(both.select("doc_id", change.alias("change"), *[c.alias(f"do_{n}") for n, c in stale.items()]).where("change IS NOT NULL"), "todo")
    changes = todo.select(F.col("doc_id").alias("path"), "change")
    gone = todo.where("change = 'removed'").select("doc_id")
    ran = dict.fromkeys(STAGES, 0)
    about = manifest["about"] if manifest else {}
    nothing = todo.isEmpty()
    if nothing and about.get("link") == _of_corpus(before, settings):
        return Report(changes, ran, about.get("status", "success"), about.get("warnings", []), manifest["snapshot"])
    size = now.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    draft = store.begin(size)
    warnings: list[dict] = []

    fresh = found.join(todo.where("do_parse").select(F.col("doc_id").alias("path")), "path", "left_semi")
    parsed, told = chain.parse_chain(fresh, chains, parsers)
    told = materialize(told.withColumn("reason", chain.fallback_reason()), "told")
    failed = told.where("status = 'failed'").select("doc_id")
    for r in told.where("status <> 'unsupported'").groupBy("status").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "reason")).alias("first")).orderBy("status").collect():
        ran["parse"] += r["n"]
        if r["status"] != "ok":
            warnings.append({"stage": "parse", "status": r["status"], "documents": r["n"], "first": r["first"]["doc_id"], "reason": r["first"]["reason"]})
    due = {n: todo.where(f"do_{n}").select("doc_id").join(failed, "doc_id", "left_anti") for n in DOC_STAGES}
    left = not gone.isEmpty()
    ran["segment"], ran["extract"] = due["segment"].count(), due["extract"].count()
    if ran["parse"] or left:
        draft.put("blocks", parsed, due["parse"].unionByName(gone))
    if ran["segment"] or left:
        cut = chunks.segment_chunks(draft.read("blocks").join(due["segment"], "doc_id", "left_semi").select("id", "doc_id", "page", "kind", "reading_order", F.coalesce("text", F.lit("")).alias("text"), "section_path"))
        draft.put("chunks", cut, due["segment"].unionByName(gone))
    if ran["extract"] or left:
        own = [draft.read(name).join(due["extract"], "doc_id", "left_semi") for name in ("blocks", "chunks")]
        for name, rows in entities_of(*own).items():
            draft.put(name, rows, due["extract"].unionByName(gone))

    # A document that failed keeps what is stored of it, and its stages' fingerprints are left open.
    open_ = now.join(failed.withColumn("failed", F.lit(True)), "doc_id", "left")
    states = before.select("doc_id", "status", "parser", "reason").join(told.select("doc_id"), "doc_id", "left_anti").unionByName(told.select("doc_id", "status", "parser", "reason"))
    documents = open_.select("doc_id", "content_hash", "length", *[F.when(F.col("failed").isNull(), F.col(n)).alias(n) for n in DOC_STAGES]).join(states, "doc_id", "left")
    draft.replace("documents", documents)
    wanted = _of_corpus(draft.read("documents"), settings)
    if about.get("link") != wanted:
        kept = draft.read("links")
        links = None
        for name, run in linkers.items():
            try:
                one = materialize(run(*[draft.read(x) for x in ("nodes", "blocks", "sections")]).select("src", "dst", "kind", F.col("confidence").cast("double"), "extractor").withColumn("linker", F.lit(name)), "links")
            except ImportError:
                raise
            except Exception as e:  # noqa: BLE001 - an injected linker may raise anything; the build goes on without it
                warnings.append({"stage": "link", "linker": name, "reason": f"{type(e).__name__}: {e}"[:300]})
                one = kept.where(F.col("linker") == name).drop("doc_id") if kept is not None else None
                wanted = None  # it is tried again by the next build
            if one is not None:
                links = one if links is None else links.unionByName(one)
        if links is not None:
            draft.replace("links", links.withColumn("doc_id", F.substring_index("src", "#", -1)))
        ran["link"] = len(linkers)
    status = "degraded" if warnings else "success"
    return Report(changes, ran, status, warnings, draft.commit(link=wanted, status=status, warnings=warnings))


def build(spark: SparkSession, root: str, out: str, include: str = "*", exclude: list[str] | None = None) -> DataFrame:
    """run_build with the built-in parsers and linkers: path and change of what was done."""
    return run_build(spark, root, out, include, exclude).changes


def read_layer(spark: SparkSession, out: str, name: str, snapshot: int | None = None) -> DataFrame:
    """A layer of the newest state, or of an earlier one."""
    found = Store(spark, out).read(name, snapshot)
    if found is None:
        raise ValueError(f"no layer {name}")
    return found


def link(nodes: DataFrame, blocks: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """Derived edges of the corpus: the same entity in several documents; with blocks and sections also the references in
    blocks' texts to sections, and to tables and figures by the numbers in their captions."""
    ready = nodes.select("id", "kind", "name", "doc_id", F.lit("").alias("instance"), F.lit(10).alias("priority"), F.lit(0).alias("page"))
    found = graph.alias_edges(ready).select("src", "dst", "kind", "confidence", F.lit("entity_resolver@1").alias("extractor"), F.lit(1).alias("seq"))
    if blocks is not None and sections is not None:
        numbered = F.regexp_extract(F.coalesce("caption", F.lit("")), r"(?i)^\s*(?:table|figure|fig\.?)\s+([0-9A-Z]+(?:[-.][0-9]+){0,2})", 1)
        targets = sections.select("id", "doc_id", F.lit("section").alias("kind"), F.col("path").alias("key")).where("key IS NOT NULL")
        targets = targets.unionByName(blocks.where("kind IN ('table', 'figure')").select("id", "doc_id", "kind", numbered.alias("key")).where("key <> ''"))
        refs = graph.references(blocks.where("kind IN ('paragraph', 'list')").select("id", "doc_id", "text"))
        told = graph.resolve_references(refs, targets)[0].select("src", "dst", "kind", "confidence", F.lit("xref@1").alias("extractor"), F.lit(2).alias("seq"))
        found = found.unionByName(told)
    return graph.merge_edges(found)
