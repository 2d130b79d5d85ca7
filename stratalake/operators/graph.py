"""The property graph: bounded traversals as frontier joins, merges by key, and linkers that derive relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalake.core.storage import discard, materialize
from stratalake.functions.text import blank_to_null, resolver_key


def _steps(edges: DataFrame, directed: bool, kinds: list[str] | None) -> DataFrame:
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    out = e.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    # Not made distinct here: a walk from a few roots meets few of the edges.
    return out if directed else out.unionByName(e.select(F.col("dst").alias("at"), F.col("src").alias("to")))


def reachable(edges: DataFrame, roots: DataFrame, depth: int, directed: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """root, id and level of all nodes within depth steps of each root (column id), the root at level 0.

    A breadth-first search: each level joins the frontier with the edges and drops what was seen; the frontier is written
    to the shared folder, so plans stay short."""
    steps = _steps(edges, directed, kinds)
    seen = materialize(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("level")).distinct(), "reach")
    frontier = seen
    for level in range(1, depth + 1):
        new = frontier.join(steps, frontier["id"] == steps["at"]).select("root", F.col("to").alias("id")).distinct()
        frontier = materialize(new.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("level", F.lit(level)), "reach")
        seen = seen.unionByName(frontier)
    return seen


def neighbors(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 1, limit: int = 50, kinds: list[str] | None = None, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth steps of root, at most limit by level and id, and the edges between them."""
    around = reachable(edges, nodes.where(F.col("id") == root).select("id"), depth, directed, kinds)
    kept = materialize(nodes.join(around.select("id", "level"), "id").orderBy("level", "id").limit(limit), "neighbors")
    inside = kept.select("id")
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    both = e.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, both


def trace(edges: DataFrame, pairs: DataFrame, max_depth: int = 5) -> DataFrame:
    """For each pair (from_id, to_id) a shortest directed path of at most max_depth steps as an array of nodes.

    Of several, the least by its nodes. A node is its own path; pairs without a path give no row. Paths are grown once for
    each from_id, whatever the number of its pairs, and no further than until all of them are found."""
    steps = _steps(edges, True, None)
    done = pairs.where("from_id = to_id").select("from_id", "to_id", F.array("from_id").alias("path"))
    asked = materialize(pairs.where("from_id <> to_id").select("from_id", "to_id").distinct(), "trace")
    live = materialize(asked.select("from_id", F.col("from_id").alias("at")).distinct().withColumn("path", F.array("from_id")), "trace")
    seen = live.select("from_id", "at")
    for step in range(1, max_depth + 1):
        grown = live.join(steps, "at").select("from_id", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
        new = materialize(grown.groupBy("from_id", "at").agg(F.min("path").alias("path")).join(seen, ["from_id", "at"], "left_anti"), "trace")
        met = asked.join(new, (asked["from_id"] == new["from_id"]) & (asked["to_id"] == new["at"])).select(asked["from_id"], asked["to_id"], "path")
        found = materialize(met, "trace")
        done = done.unionByName(found)
        if step < max_depth:
            seen = seen.unionByName(new.select("from_id", "at"))
            asked = materialize(asked.join(found.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti"), "trace")
            live = new.join(asked.select("from_id").distinct(), "from_id", "left_semi")
    return done.select("from_id", "to_id", (F.size("path") - 1).alias("length"), "path")


def impact(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 2, limit: int = 500) -> DataFrame:
    """Everything within depth steps in either direction, without the root."""
    kept, _ = neighbors(nodes, edges, root, depth, limit)
    return kept.where(F.col("id") != root)


def quota_sample(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """A sample of limit nodes with an equal quota for each kind; what a kind leaves goes to the others in their order."""
    kinds = nodes.groupBy("kind").agg(F.count("*").alias("n"))
    k = kinds.count()  # kinds are a closed set of names
    quota = max(1, limit // max(1, k))
    order = Window.partitionBy("kind").orderBy("name", "id")
    # No more than limit rows of a kind count, which each task prunes to before anything is moved.
    ranked = nodes.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)
    ranked = ranked.withColumn("round", F.when(F.col("rn") <= quota, 0).otherwise(1))
    kept = ranked.orderBy("round", "kind", "rn").limit(limit)
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept.drop("round"), inside


#: How much a trust state counts when nodes are merged.
TRUST_RANK = {"rejected": 0, "document_entity": 1, "candidate": 1, "needs_review": 2, "fact": 3, "conflict": 4}


def merge_nodes(observations: DataFrame) -> DataFrame:
    """One row for each id of observations (id, seq, name, summary, hash, status, confidence, aliases, block_ids).

    The first non-empty name and summary stay; aliases and blocks are united in order; the last hash counts; the trust
    state changes only to a higher rank."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TRUST_RANK.items() for x in kv]), F.col("status")), F.lit(1))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("seq")))
    plain = observations.groupBy("id").agg(
        first("name").alias("name"), first("summary").alias("summary"), F.max_by("hash", "seq").alias("hash"),
        F.max_by("status", F.struct(rank, -F.col("seq"))).alias("status"), F.max("confidence").alias("confidence"),
        F.count("*").alias("observations"),
    )

    def united(c: str) -> DataFrame:
        # Each value of a node once, before the node's values are collected.
        each = observations.select("id", "seq", F.posexplode(c).alias("pos", "value")).groupBy("id", "value").agg(F.min(F.struct("seq", "pos")).alias("at"))
        return each.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias(c))

    none = F.array().cast("array<string>")
    out = plain.join(united("aliases"), "id", "left").join(united("block_ids"), "id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("aliases", "block_ids")}).select("id", "name", "summary", "hash", "status", "confidence", "aliases", "block_ids", "observations")


def merge_edges(observations: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row for each (src, dst, kind): the highest confidence, extractors in order of appearance joined by +, and how
    often it was seen. With nodes, edges to missing ends go."""
    # First each extractor of an edge, so that what is collected are a few names, however often the edge was seen.
    each = observations.groupBy("src", "dst", "kind", "extractor").agg(F.max("confidence").alias("confidence"), F.min("seq").alias("seq"), F.count("*").alias("n"))
    names = F.transform(F.sort_array(F.collect_list(F.when(F.col("extractor").isNotNull(), F.struct("seq", "extractor")))), lambda x: x["extractor"])
    merged = each.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), F.array_join(names, "+").alias("extractor"), F.sum("n").alias("observations"))
    if nodes is not None:
        ids = nodes.select("id")
        merged = merged.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return merged.select("src", "dst", "kind", "confidence", "extractor", "observations")


def without_derived(items: DataFrame, producers: list[str]) -> DataFrame:
    """items without those whose producers (name@version:tag, joined by +) are all among the given ones."""
    names = F.transform(F.split("extractor", r"\+"), lambda x: F.regexp_extract(x, "^([^@:]*)", 1))
    return items.where(~F.forall(names, lambda n: n.isin(producers)) | F.col("extractor").isNull())


def delete_docs(doc_ids: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without a set of documents; edges that lose an end go with it."""
    kept = nodes.join(doc_ids, "doc_id", "left_anti")
    gone = nodes.join(doc_ids, "doc_id", "left_semi").select("id")
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept, left


def alias_edges(nodes: DataFrame) -> DataFrame:
    """Edges from each member of a bucket (normalised name, instance, kind) to its primary one.

    nodes: id, kind, name, instance, priority, page. Primary is the highest priority, then the lowest page, the shortest
    name, the least id: one aggregate for each bucket and a join back, no pairs."""
    keyed = nodes.withColumn("key", resolver_key(F.col("name")))
    order = F.struct(-F.coalesce("priority", F.lit(10)), F.coalesce(F.when(F.col("page") != 0, F.col("page")), F.lit(9999)), F.length("name"), F.col("id"))
    primary = keyed.groupBy("key", "instance", "kind").agg(F.min_by("id", order).alias("primary"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(primary, ["key", "instance", "kind"]).where("id <> primary").select(F.col("id").alias("src"), F.col("primary").alias("dst"), F.lit("alias_of").alias("kind"), F.lit(0.95).alias("confidence"), F.col("key").alias("name_key"))


def federation_edges(nodes: DataFrame) -> DataFrame:
    """Edges from a bucket's primary node to the others, where two documents or more share it.

    nodes: id, kind, doc_id, name, qualified_name, instance, priority, seq. supersedes where the primary's priority is
    strictly higher, else alias_of."""
    keyed = nodes.withColumn("key", F.upper(F.coalesce(blank_to_null(F.col("qualified_name")), F.col("name")))).withColumn("prio", F.coalesce("priority", F.lit(0)))
    first = F.struct(-F.col("prio"), F.col("seq"), F.col("id"))
    best = keyed.groupBy("key", "instance", "kind").agg(F.min_by("id", first).alias("primary"), F.max("prio").alias("top"), (F.min("doc_id") != F.max("doc_id")).alias("several")).where("several")
    sup = F.col("top") > F.col("prio")
    return keyed.join(best, ["key", "instance", "kind"]).where("id <> primary").select(
        F.col("primary").alias("src"), F.col("id").alias("dst"), F.when(sup, "supersedes").otherwise("alias_of").alias("kind"), F.when(sup, 0.95).otherwise(0.9).alias("confidence")
    )


def belongs_to(entities: DataFrame, sections: DataFrame, modules: DataFrame) -> DataFrame:
    """entity -> module whose name is the section's title (0.9), else -> section (0.85), by document and section path."""
    s = sections.select("doc_id", F.col("path").alias("section_path"), F.col("id").alias("section_id"), resolver_key(F.col("name")).alias("key"))
    m = modules.groupBy("doc_id", resolver_key(F.col("name")).alias("key")).agg(F.min("id").alias("module_id"))
    found = entities.join(s, ["doc_id", "section_path"]).join(m, ["doc_id", "key"], "left")
    target = F.coalesce("module_id", "section_id")
    return found.where(F.col("id") != target).select(F.col("id").alias("src"), target.alias("dst"), F.lit("belongs_to").alias("kind"), F.when(F.col("module_id").isNotNull(), 0.9).otherwise(0.85).alias("confidence"))


def contained_in(maps: DataFrame, registers: DataFrame) -> DataFrame:
    """register -> memory map in the same document whose base is a prefix of the register's address (see prefix_matches).

    An equi-join on the document, the number of significant digits and these digits: a register has a row for each number
    that its address has digits for, four at least."""
    digits = lambda c: F.regexp_replace(F.lower(c), "^0x", "")
    base = digits(F.col("address"))
    n = F.greatest(F.lit(4), F.length(base) - F.length(F.regexp_extract(base, "0*$", 0)))
    m = maps.where(F.length(base) >= 4).select("doc_id", F.col("id").alias("dst"), n.alias("n"), F.substring(base, F.lit(1), n).alias("head"))
    of = registers.where(F.length(base) >= 4).select("doc_id", F.col("id").alias("src"), base.alias("a"))
    # A base without four significant digits but more digits than the address still compares what there is.
    wide = of.select("doc_id", "src", "a", F.explode(F.sequence(F.lit(4), F.greatest(F.lit(16), F.length("a")))).alias("n"))
    return wide.select("doc_id", "src", "n", F.substring("a", F.lit(1), F.col("n")).alias("head")).join(m, ["doc_id", "n", "head"]).select("src", "dst", F.lit("contained_in").alias("kind"))


#: How texts refer to sections, figures and tables, in English and Chinese.
REFERENCES = (
    ("section", r"(?i)(?:section|sec\.|§|章节)\s+([0-9]+(?:\.[0-9]+){0,4})"),
    ("section", r"(?i)(?:chapter|chap\.|第)\s*([0-9]+(?:\.[0-9]+){0,2})\s*章?"),
    ("figure", r"(?i)(?:figure|fig\.?|图)\s*([0-9A-Z]+(?:[-.][0-9]+){0,2})"),
    ("table", r"(?i)(?:table|tbl\.?|表)\s*([0-9A-Z]+(?:[-.][0-9]+){0,2})"),
)


def references(texts: DataFrame) -> DataFrame:
    """src, doc_id, target_kind and target_key of all references in texts (id, doc_id, text)."""
    out = None
    for kind, pattern in REFERENCES:
        one = texts.select(F.col("id").alias("src"), "doc_id", F.lit(kind).alias("target_kind"), F.explode(F.regexp_extract_all(F.col("text"), F.lit(pattern), 1)).alias("target_key"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def resolve_references(refs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """references edges (0.85) to targets (id, doc_id, kind, key), same document first; and the references left over.

    In its document a reference goes to the target of its key, else to the first one whose key begins with it (Table 3 to
    Table 3-1); what finds none there goes to the least target of its key anywhere, one row a key."""
    t = targets.select(F.col("id").alias("dst"), "doc_id", F.col("kind").alias("target_kind"), F.col("key").alias("key"))
    # A key's openings, up to a dot or hyphen, are looked up like keys.
    parts = F.regexp_extract_all("key", F.lit(r"([^.\-]+[.\-]?)"), 1)
    openings = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.regexp_replace(F.array_join(F.slice(parts, 1, k), ""), r"[.\-]$", ""))
    known = t.withColumn("target_key", F.explode(F.array_distinct(F.array_append(openings, F.col("key")))))
    near = known.groupBy("doc_id", "target_kind", "target_key").agg(F.min_by("dst", F.struct((F.col("key") != F.col("target_key")).cast("int"), "key", "dst")).alias("near"))
    far = t.groupBy("target_kind", F.col("key").alias("target_key")).agg(F.min("dst").alias("far"))
    found = refs.join(near, ["doc_id", "target_kind", "target_key"], "left").join(far, ["target_kind", "target_key"], "left").withColumn("dst", F.coalesce("near", "far"))
    edges = found.where("dst IS NOT NULL AND src <> dst").select("src", "dst", F.lit("references").alias("kind"), F.lit(0.85).alias("confidence"))
    return edges, found.where("dst IS NULL").select(refs.columns)


def section_parents(toc: DataFrame) -> DataFrame:
    """toc (doc_id, pos, level, id) with parent: the nearest entry before with a smaller level. The levels that there are, as
    many as headings are nested, come to the driver."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted(r[0] for r in toc.select("level").where("level IS NOT NULL").distinct().collect())
    last = [(k, F.max(F.when(F.col("level") == k, F.struct("pos", "id"))).over(order)) for k in levels[:-1]]
    if not last:
        return toc.withColumn("parent", F.lit(None).cast(toc.schema["id"].dataType))
    above: Column = F.array_max(F.array_compact(F.array(*[F.when(F.col("level") > k, x) for k, x in last])))
    return toc.withColumn("parent", above["id"])


def subtree_totals(nodes: DataFrame, value: Column | None = None) -> DataFrame:
    """id, members and total of nodes (id, parent and more) of a forest: the nodes of each one's subtree, itself included, and
    the sum of value (1 if there is none) over them.

    In round k each node's sums, of what lies less than 2^k below it, are added to those of its ancestor 2^k above, which a
    self-join then doubles: as many rounds as the logarithm of the depth, each with a row a node. A parent that isn't there
    counts as none; a circle is an error."""
    value = F.lit(1).cast("long") if value is None else value
    known = nodes.select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("members"), value.alias("total"))
    state = materialize(known.join(known.select(F.col("id").alias("there")), F.col("up") == F.col("there"), "left").withColumn("up", F.col("there")).drop("there"), "subtrees")
    n = state.count()
    for k in range(n.bit_length() + 1):
        if state.where("up IS NOT NULL").isEmpty():
            return state.drop("up")
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("members").alias("more_members"), F.sum("total").alias("more"))
        higher = state.select(F.col("id").alias("via"), F.col("up").alias("higher"))
        added = state.join(below, "id", "left").join(higher, F.col("up") == F.col("via"), "left")
        before, state = state, materialize(added.select("id", F.col("higher").alias("up"), (F.col("members") + F.coalesce("more_members", F.lit(0))).alias("members"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")), "subtrees")
        discard(before)
    raise ValueError("the parents form a circle")
