"""Known entities in texts, by automata over the names of a document, and the relations that a model finds between them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalake.core.batches import pieces
from stratalake.core.storage import materialize
from stratalake.functions.text import normalize_name

EXTRACTOR = "llm_ie@0.2"
#: Kinds of entities that relations join, with the short names of their ids, and relations that count.
KINDS = {"register": "reg", "bitfield": "bf", "signal": "sig", "interrupt": "irq", "interface": "if", "memory_map": "mmap", "clock": "clk", "pin": "pin", "parameter": "param", "module": "mod"}
RELATIONS = ("belongs_to", "contained_in", "mapped_to", "drives", "clocks", "resets", "implements", "connects_to", "controls", "depends_on", "references")
#: Headings that are no entity's name, and words that tell nothing in one.
BOILERPLATE = ("about this document", "introduction", "overview", "preface", "contents", "table of contents", "revision history", "references", "figures", "tables", "abbreviations", "glossary", "appendix", "related documentation", "conventions")
NOISE_WORDS = ("the", "a", "an", "of", "for", "and", "to", "in", "on", "with")
#: Bounds on names (characters, words, CJK characters), on the names of a prompt, on chunks of a document and
#: their characters, requirement ids and names; how sure a relation and a new entity have to be, and how alike names.
NAME_CHARS, NAME_WORDS, NAME_CJK, LEAST_KEY = (2, 30), 4, 8, 3
PROMPT_NAMES, CHUNKS_OF_DOC, LEAST_CHARS, REQUIREMENTS, LEAST_NAMES = 40, 30, 80, 3, 2
LEAST_CONFIDENCE, SURE, DEFAULT_CONFIDENCE, LEAST_OVERLAP = 0.6, 0.8, 0.7, 0.75
#: Names of an automaton and chunks that one group goes through with it, about.
NAMES_OF_PIECE, CHUNKS_OF_SLICE = 50_000, 1_000


def matchable(name: Column) -> Column:
    """Whether a name looks like an entity's, not like a sentence or a common heading. Bounds are the fixed ones above."""
    n = F.trim(F.coalesce(name, F.lit("")))
    words = F.size(F.regexp_extract_all(n, F.lit(r"(\S+)"), 1))
    return F.length(n).between(*NAME_CHARS) & (words <= NAME_WORDS) & (F.regexp_count(n, F.lit("[一-鿿]")) <= NAME_CJK) & ~F.lower(n).isin(*BOILERPLATE)


def name_words(name: Column) -> Column:
    """Lower-case words of a name, letters and digits only, of two characters or more, without noise words."""
    parts = F.split(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("_"), F.lit(" ")), r"\s+")
    plain = F.transform(parts, lambda p: F.regexp_replace(p, r"[^\p{L}\p{N}]+", ""))
    return F.array_distinct(F.filter(plain, lambda p: (F.length(p) >= 2) & ~p.isin(*NOISE_WORDS)))


def name_index(nodes: DataFrame) -> DataFrame:
    """doc_id, key, name, id and place of nodes (id, kind, name, doc_id; qualified_name, extractor): for each document and
    normalised name the first node, by kind and id. Nodes that only this linker made aren't indexed."""
    has = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    raw = F.coalesce(F.nullif(has("qualified_name"), F.lit("")), F.col("name"), F.lit(""))
    owners = F.filter(F.transform(F.split(F.coalesce(has("extractor"), F.lit("")), r"\+"), lambda x: F.substring_index(F.substring_index(x, "@", 1), ":", 1)), lambda x: x != "")
    own = (F.size(owners) > 0) & F.forall(owners, lambda x: x == "llm_ie")
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    kept = nodes.where(F.col("kind").isin(*KINDS) & ~own & matchable(raw)).select("doc_id", normalize_name(raw).alias("key"), raw.alias("name"), "id", "kind", F.struct(place.alias("kind_place"), "id").alias("place"))
    first = F.min_by(F.struct("name", "id", "kind", "place"), "place")
    return kept.where("key <> ''").groupBy("doc_id", "key").agg(first.alias("first")).select("doc_id", "key", "first.*")


def _finder(names: list[str]) -> Callable[[str], list[int]]:
    """What finds the names in a text: those of one part as whole words, others anywhere in the text without spaces and
    underscores. One automaton for all names of several parts."""
    import ahocorasick

    words: dict[str, list[int]] = {}
    parts: dict[str, list[int]] = {}
    for i, key in enumerate(names):
        plain = key.lower().replace("_", "")
        if "_" not in key:
            words.setdefault(plain, []).append(i)
        elif plain:
            parts.setdefault(plain, []).append(i)
    automaton = ahocorasick.Automaton()
    for plain, own in parts.items():
        automaton.add_word(plain, own)
    if parts:
        automaton.make_automaton()

    def found(text: str) -> list[int]:
        low = text.lower()
        hits = {i for w in set(re.findall(r"\w+", low)) for i in words.get(w, ())}
        if parts:
            for _, own in automaton.iter(low.replace(" ", "").replace("_", "")):
                hits.update(own)
        return sorted(hits)

    return found


def mentions(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, chunk_id and key of each name (doc_id, key) of a document that one of its chunks (doc_id, chunk_id, text) holds.

    A document's names are cut into pieces and its chunks into slices, so that a group has some 50,000 names and 1,000 chunks
    of one document, whatever its size; each piece meets each slice. A task goes through its groups one after another, each
    one's names before its chunks, and holds one group's names and some megabytes of chunks."""
    keys = names.where(F.length("key") >= LEAST_KEY).select("doc_id", "key")
    sizes = keys.groupBy("doc_id").agg(F.ceil(F.count("*") / NAMES_OF_PIECE).cast("int").alias("pieces")).join(chunks.groupBy("doc_id").agg(F.ceil(F.count("*") / CHUNKS_OF_SLICE).cast("int").alias("slices")), "doc_id")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    n = keys.join(sizes, "doc_id").select("doc_id", "key", F.pmod(F.xxhash64("key"), "pieces").cast("int").alias("piece"), upto("slices").alias("slice"))
    c = chunks.where("text IS NOT NULL").join(sizes, "doc_id").select("doc_id", "chunk_id", "text", F.pmod(F.xxhash64("chunk_id"), "slices").cast("int").alias("slice"), upto("pieces").alias("piece"))
    kinds = {f.name: f.dataType.simpleString() for f in c.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known, found = None, [], None
        for batch in pieces(batches):
            rows, told = [], []
            for row, (*at, key, text) in enumerate(zip(*[batch.column(x).to_pylist() for x in ("doc_id", "piece", "slice", "key", "text")], strict=True)):
                if at != group:
                    group, known, found = at, [], None
                if text is None:
                    known.append(key)
                elif known:
                    found = found or _finder(known)
                    own = [known[i] for i in found(text)]
                    rows += [row] * len(own)
                    told += own
            of = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("chunk_id").take(of), pa.array(told, pa.string())], ["doc_id", "chunk_id", "key"])

    group = ["doc_id", "piece", "slice"]
    both = n.select(*group, F.lit(None).cast(kinds["chunk_id"]).alias("chunk_id"), "key", F.lit(None).cast("string").alias("text")).unionByName(c.select(*group, "chunk_id", F.lit(None).cast("string").alias("key"), "text"))
    in_order = both.repartition(*group).sortWithinPartitions(*group, F.col("text").isNotNull())
    return in_order.mapInArrow(run, f"doc_id {kinds['doc_id']}, chunk_id {kinds['chunk_id']}, key string")


def relation_candidates(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, chunk_id, text and names of chunks worth asking for relations: sections, long enough, fewer than three
    requirement ids, two known entities of the document or more; of each document the first CHUNKS_OF_DOC. names are of the
    first PROMPT_NAMES entities by key, as their nodes have them."""
    section = F.col("chunk_type") == "section" if "chunk_type" in chunks.columns else F.lit(True)
    fit = chunks.where(section & (F.length("text") >= LEAST_CHARS) & (F.regexp_count("text", F.lit(r"(?i)REQ_[A-Z0-9_]*\d+")) < REQUIREMENTS))
    names = materialize(name_index(nodes), "names")
    told = mentions(fit.select("doc_id", "chunk_id", "text"), names).join(names.select("doc_id", "key", "name"), ["doc_id", "key"])
    known = told.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("key", "name"))), 1, PROMPT_NAMES), lambda x: x["name"]).alias("names")).where(F.col("n") >= LEAST_NAMES)
    order = [c for c in ("page_start", "page_end", "page") if c in chunks.columns]
    first = Window.partitionBy("doc_id").orderBy(*order, "chunk_id")
    placed = fit.join(known, ["doc_id", "chunk_id"]).withColumn("place", F.row_number().over(first)).where(F.col("place") <= CHUNKS_OF_DOC)
    return placed.select("doc_id", "chunk_id", "text", "names", "place")


def relation_prompt(text: Column, names: Column) -> Column:
    """What is asked of a model: the explicit relations of the text, between the names it is given or new ones with a kind."""
    listed = F.array_join(F.transform(names, lambda n: F.concat(F.lit("- "), n)), "\n")
    head = (
        "Extract the semantic relations that this text states between hardware entities. Use the names of the list where they fit; give a new entity its type.\n"
        f"Relations: {', '.join(sorted(RELATIONS))}\nTypes: {', '.join(sorted(KINDS))}\nNo relation: an empty list. Answer with one JSON object only:\n"
        '{"relations": [{"src": "", "src_type": null, "relation": "", "dst": "", "dst_type": null, "confidence": 0.0}]}\n\nEntities:\n'
    )
    return F.concat(F.lit(head), F.when(F.size(names) > 0, listed).otherwise("- (none)"), F.lit("\n\nText:\n"), text)


_ANSWER = "struct<relations:array<struct<src:string,src_type:string,relation:string,dst:string,dst_type:string,confidence:double>>>"


def accepted_relations(answers: DataFrame) -> DataFrame:
    """answers (doc_id, chunk_id, answer, place and more) as one row for each relation of a known kind that is sure enough, with
    its position in the answer."""
    rows = answers.withColumn("told", F.from_json("answer", _ANSWER)["relations"]).drop("answer")
    each = rows.select(*[c for c in rows.columns if c != "told"], F.posexplode("told").alias("position", "r")).select("*", "r.*").drop("r", "told")
    plain = each.withColumns({"relation": F.replace(F.lower(F.trim("relation")), F.lit(" "), F.lit("_")), "confidence": F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))})
    return plain.where(F.col("relation").isin(*RELATIONS) & (F.col("confidence") >= LEAST_CONFIDENCE))


def _best_static(ends: DataFrame, names: DataFrame) -> DataFrame:
    """ends (doc_id, name) with exact_id, fuzzy_id and fuzzy_score: the node of the normalised name, and the first of those
    whose words overlap most, by equal words of the document."""
    wanted = ends.select("doc_id", "name").distinct().withColumns({"key": normalize_name(F.col("name")), "words": name_words(normalize_name(F.col("name")))})
    exact = wanted.join(names.select("doc_id", "key", F.col("id").alias("exact_id")), ["doc_id", "key"], "left")
    known = names.select("doc_id", "id", "place", F.col("key").alias("known_key"), name_words(F.col("key")).alias("known"))
    own = exact.where("exact_id IS NULL").select("doc_id", "name", F.size("words").alias("n"), F.explode("words").alias("word"))
    shared = own.join(known.select("doc_id", "id", "place", F.size("known").alias("m"), F.explode("known").alias("word")), ["doc_id", "word"])
    scored = shared.groupBy("doc_id", "name", "id", "place").agg((F.count("*") / F.least(F.first("n"), F.first("m"))).alias("score")).where(F.col("score") >= LEAST_OVERLAP)
    best = scored.groupBy("doc_id", "name").agg(F.min(F.struct((-F.col("score")).alias("less"), "place", "id")).alias("b")).select("doc_id", "name", F.col("b.id").alias("fuzzy_id"), (-F.col("b.less")).alias("fuzzy_score"))
    return exact.join(best, ["doc_id", "name"], "left").select("doc_id", "name", "key", "words", "exact_id", "fuzzy_id", "fuzzy_score")


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that relation ends without a known node of their name mean: one that an earlier end of the document made, else
    a new one where its kind is known. Rows come a document after another, in the order in which its answers tell them; what
    is held is one document's new names, of CHUNKS_OF_DOC answers at most."""
    document: object = None
    made: dict[str, tuple[str, set[str]]] = {}
    for batch in pieces(batches):
        nodes, new = [], []
        for r in batch.to_pylist():
            if r["doc_id"] != document:
                document, made = r["doc_id"], {}
            words, fresh = set(r["words"] or []), False
            node = made[r["key"]][0] if r["key"] in made else None
            if node is None:
                node, best = r["fuzzy_id"], r["fuzzy_score"] or 0.0
                for i, known in made.values():
                    score = len(words & known) / min(len(words), len(known)) if words and known else 0.0
                    if score >= LEAST_OVERLAP and score > best:
                        node, best = i, score
            if node is None and r["new_id"] is not None:
                node, fresh = r["new_id"], True
                made.setdefault(r["key"], (node, words))
            nodes.append(node), new.append(fresh)
        kept = [batch.column(c) for c in ("doc_id", "chunk_id", "position", "side")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(nodes, pa.string()), pa.array(new, pa.bool_())], ["doc_id", "chunk_id", "position", "side", "node", "new"])


def link_relations(answers: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New nodes and edges from answers (doc_id, chunk_id, place, answer; block_ids and page if there are) about nodes.

    An end is the document's node of that name, else the one whose words overlap most (three quarters of the shorter name);
    else, with a known type, a new node: a candidate, pending below SURE. Edges bear chunk, snippet and confidence; an edge
    that several answers tell is there once, with the highest confidence. What a model says is never a fact."""
    extra = [c for c in ("page", "block_ids") if c in answers.columns]
    told = materialize(accepted_relations(answers.select("doc_id", "chunk_id", "place", "answer", *extra)), "relations")
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("name"), F.lower(F.trim(F.col(f"{c}_type"))).alias("type")) for i, c in enumerate(("src", "dst"))]))
    ends = told.select("doc_id", "chunk_id", "place", "position", "confidence", *extra, sides.alias("e")).select("*", "e.*").drop("e").where("name IS NOT NULL")
    short = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    names = materialize(name_index(nodes), "names")
    static = _best_static(ends, names)
    new_id = F.when(F.col("type").isin(*KINDS) & (F.col("key") != ""), F.concat(F.lit("ie::"), F.try_element_at(short, F.col("type")), F.lit(":"), "key", F.lit("#"), F.col("doc_id").cast("string")))
    joined = materialize(ends.join(static, ["doc_id", "name"]).withColumn("new_id", new_id), "relation-ends")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    asked = joined.where("exact_id IS NULL").select("doc_id", "chunk_id", "place", "position", "side", "key", "words", "fuzzy_id", "fuzzy_score", "new_id")
    in_order = asked.repartition("doc_id").sortWithinPartitions("doc_id", "place", "chunk_id", "position", "side")
    told_ends = in_order.mapInArrow(_resolved, f"doc_id {kinds['doc_id']}, chunk_id {kinds['chunk_id']}, position int, side int, node string, new boolean")
    known = joined.where("exact_id IS NOT NULL").select("doc_id", "chunk_id", "position", "side", F.col("exact_id").alias("node"), F.lit(False).alias("new"))
    found = materialize(told_ends.unionByName(known), "relation-nodes")
    at = ["doc_id", "chunk_id", "position", "side"]
    one = joined.join(found.where("new"), at)
    block_ids = F.col("block_ids") if "block_ids" in extra else F.array().cast("array<string>")
    first = F.min_by(F.struct("type", "name", "confidence", "chunk_id", block_ids.alias("block_ids"), (F.col("page") if "page" in extra else F.lit(None).cast("int")).alias("page")), F.struct("place", "chunk_id", "position", "side"))
    fresh = one.groupBy(F.col("node").alias("id"), "doc_id").agg(first.alias("f"))
    made = fresh.select(
        "id", F.col("f.type").alias("kind"), F.col("f.name").alias("name"), F.col("f.name").alias("qualified_name"), "doc_id", "f.page", F.array(F.col("f.chunk_id").cast("string")).alias("source_chunk_ids"), F.col("f.block_ids").alias("source_block_ids"),
        F.lit(EXTRACTOR).alias("extractor"), F.col("f.confidence").alias("confidence"), (F.col("f.confidence") < SURE).alias("pending"), F.lit("candidate").alias("status"), F.lit("llm").alias("method"),
        F.substring(F.concat(F.lit("LLM-IE "), F.col("f.type"), F.lit(": "), F.col("f.name")), 1, 120).alias("summary"),
    )
    end = lambda side, name: found.where(F.col("side") == side).select("doc_id", "chunk_id", "position", F.col("node").alias(name))
    pairs = told.withColumn("snippet", F.concat_ws(" ", "src", "relation", "dst")).drop("src", "dst")
    edges = pairs.join(end(0, "src"), ["doc_id", "chunk_id", "position"]).join(end(1, "dst"), ["doc_id", "chunk_id", "position"]).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    best = F.max_by(F.struct("chunk_id", "snippet"), F.struct("confidence", -F.col("place"), -F.col("position")))
    merged = edges.groupBy("src", "dst", F.col("relation").alias("kind")).agg(F.least(F.max("confidence"), F.lit(1.0)).alias("confidence"), F.array_sort(F.collect_set(F.col("chunk_id").cast("string"))).alias("chunk_ids"), best.alias("b"))
    return made, merged.select("src", "dst", "kind", "confidence", "chunk_ids", F.col("b.snippet").alias("snippet"), F.lit(EXTRACTOR).alias("extractor"))


def run_relations(chunks: DataFrame, nodes: DataFrame, client: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """New nodes and edges of all chunks worth asking about; client answers one prompt and runs in the tasks. An answer that
    isn't JSON is asked for once more; a failure leaves the chunk out."""
    asked = relation_candidates(chunks, nodes).withColumn("prompt", relation_prompt(F.col("text"), F.col("names"))).drop("text", "names")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [_answer(client, p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(told, pa.string())], [*batch.schema.names[:-1], "answer"])

    answers = materialize(asked.mapInArrow(run, f"{kinds}, answer string"), "answers")
    extra = [c for c in ("page", "block_ids") if c in chunks.columns]
    return link_relations(answers.join(chunks.select("doc_id", "chunk_id", *extra), ["doc_id", "chunk_id"]), nodes)


def _answer(client: Callable[[str], str], prompt: str) -> str | None:
    from stratalake.operators.models import extract_json

    for more in ("", "The last answer was no valid JSON. Answer with the smallest valid JSON object.\n"):
        try:
            found = extract_json(client(more + prompt))
        except ImportError:
            raise
        except Exception:  # noqa: BLE001 - whatever a client raises leaves one chunk out
            return None
        if found is not None:
            return found
    return None
