"""Source divergence: what groups of documents say more and less often, by a K-squared quadtree over the matrix of groups
and terms.

Counts are made where the texts are and meet by (lang, term) once. The matrix of a language is cut into tiles of SIDE groups
by SIDE terms, both by falling count, so that what is zero lies together. A tile's tree tells which of its quadrants are
empty; pairs of groups go down both of their trees together, and where both are empty the difference is the number of terms
times that of the shares of a count of zero."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.core.ranks import with_global_rank
from stratalake.core.storage import materialize

#: A term is kept for a language that has it in so many documents.
LEAST_DOCS = 30
#: Terms that tell a group from its language, at most: the report is cut there.
TOP_TERMS = 50
#: Added to each count, and what shares are parts of.
SMOOTHING, UNIT = 5, 1_000_000_000
#: Groups and terms of a tile, a power of two; groups and terms of a leaf.
SIDE, LEAF = 512, 8
#: Terms that a task holds before it passes counts on (or those of one text, where it has more).
HELD = 1 << 20

#: For each byte its lower case if it can be part of a term (A-Z, a-z, all of UTF-8 beyond ASCII), else a space.
TERM_TABLE = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_TABLE).split()


_COUNTS = "lang string, source string, term string, n long, docs long"


def _summed(groups: list[tuple[bytes, bytes]], texts: list[tuple[int, list[bytes]]]) -> pa.RecordBatch:
    """Occurrences and documents of each (group, term); texts: each text's group and terms."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(own for _, own in texts)), dtype=np.int64)
    sizes = [len(own) for _, own in texts]
    group = np.array([g for g, _ in texts], dtype=np.int64)
    # Equal terms of a text, then those of a group's texts, are counted by sorting; the products stay below 2 ** 63.
    both, n = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(known) + ids, return_counts=True)
    both = group[both // max(1, len(known))] * len(known) + both % max(1, len(known))
    order = np.argsort(both, kind="stable")
    cells, first, docs = np.unique(both[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(n[order], first) if len(first) else first
    take = lambda values, at: pa.array(values, pa.binary()).cast(pa.string()).take(pa.array(at))
    of = cells // max(1, len(known))
    columns = [take([g[0] for g in groups], of), take([g[1] for g in groups], of), take(list(known), cells % max(1, len(known)))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms and of documents that hold them, by group, summed up over HELD terms. For each group of the task
    there is a term of a space and the source, which no text has."""
    groups: dict[tuple[bytes, bytes], int] = {}
    texts: list[tuple[int, list[bytes]]] = []
    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = terms_of(text)
            if (lang, source) not in groups:
                groups[lang, source] = len(groups)
                own.append(b" " + source)
            texts.append((groups[lang, source], own))
            held += len(own)
            if held >= HELD:
                yield _summed(list(groups), texts)
                texts, held = [], 0
    if texts:
        yield _summed(list(groups), texts)


def kept_cells(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n and lang_n for each kept term that occurs in a group; for each group a term that begins with a
    space."""
    raw = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")]).mapInArrow(_count, _COUNTS)
    # One shuffle by (lang, term) serves the sums by group and those by language.
    summed = raw.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counted = summed.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term)})
    return counted.where((F.col("lang_docs") >= least_docs) | _of_group()).select("lang", "source", "term", "n", "lang_n")


def _of_group() -> Column:
    return F.startswith("term", F.lit(" "))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * terms)), exact; null where there is no term."""
    whole = lambda x: x.cast("decimal(19,0)")
    # The function name is asked for, as `/` on decimals rounds.
    quotient = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * whole(count + SMOOTHING), whole(total + SMOOTHING * terms))
    return F.when(terms > 0, quotient + 1)


class Quadtree:
    """The nonzero cells of a tile: for each level from the whole tile down to leaves, which of a node's four quadrants
    hold any; the nodes below are numbered by the ones before them. Leaves hold shares, rows' shares of zero where a cell
    is zero."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, shares: np.ndarray, zero: np.ndarray, width: int) -> None:
        """Cells by row and column of the tile; zero: for each of the tile's rows its share of zero; width: columns there
        are."""
        self.levels: list[np.ndarray] = []
        side = len(zero)
        parents = np.zeros(min(1, len(rows)), dtype=np.int64)  # the root is node 0, of an empty tile there is none
        node = np.zeros(len(rows), dtype=np.int64)
        while side > LEAF:
            side //= 2
            code = node * 4 + (rows // side % 2) * 2 + cols // side % 2
            bits = np.zeros(len(parents) * 4, dtype=bool)
            bits[code] = True
            rank = np.cumsum(bits) - 1
            self.levels.append(np.where(bits, rank, -1).reshape(-1, 2, 2))
            node = rank[code] if len(code) else code
            parents = np.flatnonzero(bits)
        # The place of each leaf, for its rows' shares of zero and for the columns there are.
        first_row, first_col = np.zeros(len(parents), dtype=np.int64), np.zeros(len(parents), dtype=np.int64)
        first_row[node], first_col[node] = rows // LEAF * LEAF, cols // LEAF * LEAF
        self.leaves = np.repeat(zero[first_row[:, None] + np.arange(LEAF)][:, :, None], LEAF, axis=2)
        self.leaves[node, rows % LEAF, cols % LEAF] = shares
        self.leaves[(first_col[:, None] + np.arange(LEAF) >= width)[:, None, :].repeat(LEAF, axis=1)] = 0

    def below(self, level: int, nodes: np.ndarray, row: int, col: int) -> np.ndarray:
        """The quadrants of these nodes, -1 where there is none."""
        if not len(self.levels[level]):
            return np.full(len(nodes), -1)
        return np.where(nodes >= 0, self.levels[level][np.maximum(nodes, 0), row, col], -1)


def differences(a: Quadtree, b: Quadtree, zero_a: np.ndarray, zero_b: np.ndarray, rows: tuple[int, int], width: int, half: bool) -> np.ndarray:
    """Sums of absolute differences of the shares of each row of a and each of b, of which the first `rows` are there. half: a and b are the same, and only blocks of rows in which a's isn't after b's are wanted."""
    whole = side = len(zero_a)
    many = whole // LEAF
    empty_terms = np.zeros((many, many), dtype=np.int64)  # by leaf rows: terms in quadrants that are empty in both
    sums = np.zeros((many, many, LEAF, LEAF), dtype=np.int64)
    root = lambda t: np.array([0 if len(t.levels[0]) else -1])
    na, nb, ra, rb, c = root(a), root(b), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(len(a.levels) + 1):
        both = (na < 0) & (nb < 0)
        terms = np.clip(width - c[both] * side, 0, side)
        span = side // LEAF
        marked = np.zeros((whole // side, whole // side), dtype=np.int64)
        np.add.at(marked, (ra[both], rb[both]), terms)
        empty_terms += np.kron(marked, np.ones((span, span), dtype=np.int64))
        na, nb, ra, rb, c = (x[~both] for x in (na, nb, ra, rb, c))
        if side == LEAF or not len(c):
            break
        side //= 2
        found = [(a.below(level, na, i, k), b.below(level, nb, j, k), ra * 2 + i, rb * 2 + j, c * 2 + k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
        na, nb, ra, rb, c = (np.concatenate(x) for x in zip(*found, strict=True))
        there = (ra * side < rows[0]) & (rb * side < rows[1]) & (c * side < width)
        if half:
            there &= ra <= rb
        na, nb, ra, rb, c = (x[there] for x in (na, nb, ra, rb, c))
    for at in range(0, len(c), 2048):
        s = slice(at, at + 2048)
        valid = c[s, None] * LEAF + np.arange(LEAF) < width

        def leaf(tree: Quadtree, node: np.ndarray, row: np.ndarray, zero: np.ndarray) -> np.ndarray:
            blank = zero[row[:, None] * LEAF + np.arange(LEAF)][:, :, None] * valid[:, None, :]  # noqa: B023
            return np.where((node >= 0)[:, None, None], tree.leaves[np.maximum(node, 0)], blank) if len(tree.leaves) else blank

        x, y = leaf(a, na[s], ra[s], zero_a), leaf(b, nb[s], rb[s], zero_b)
        np.add.at(sums, (ra[s], rb[s]), np.abs(x[:, :, None, :] - y[:, None, :, :]).sum(axis=-1))
    wide = lambda m: np.repeat(np.repeat(m, LEAF, axis=0), LEAF, axis=1)
    return sums.transpose(0, 2, 1, 3).reshape(whole, whole) + wide(empty_terms) * np.abs(zero_a[:, None] - zero_b[None, :])


_SUMS = "lang string, source string, other string, value long"


def _tile(table: pa.Table, side: int) -> pa.Table:
    """Differences within a tile of each two groups of which the first's row is before the second's. Rows without a column
    tell a group's share of zero."""
    names = ("above", "below", "row", "col", "p", "width")
    above, below, row, col, p, width = (table.column(c).to_numpy() for c in names)
    block, told = row // side, col < 0
    source = table.column("source").combine_chunks()
    trees, zeros, groups, width = [], [], [], int(width[told][0])
    for k in dict.fromkeys((int(above[0]), int(below[0]))):
        head, cells = np.flatnonzero(told & (block == k)), ~told & (block == k)
        zero = np.zeros(side, dtype=np.int64)
        zero[row[head] % side] = p[head]
        trees.append(Quadtree(row[cells] % side, col[cells] % side, p[cells], zero, width))
        zeros.append(zero)
        groups.append(head[np.argsort(row[head])])
    found = differences(trees[0], trees[-1], zeros[0], zeros[-1], (len(groups[0]), len(groups[-1])), width, half=len(trees) == 1)
    i, j = np.triu_indices(len(groups[0]), 1) if len(trees) == 1 else (x.ravel() for x in np.indices((len(groups[0]), len(groups[1]))))
    lang = pa.repeat(table.column("lang")[0], len(i)) if len(i) else pa.array([], pa.string())
    return pa.table({"lang": lang.cast(pa.string()), "source": source.take(pa.array(groups[0][i])), "other": source.take(pa.array(groups[-1][j])), "value": found[i, j]})


def _tiler(side: int) -> Callable[[pa.Table], pa.Table]:
    def tile(table: pa.Table) -> pa.Table:
        return _tile(table, side)

    return tile


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, side: int = SIDE) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: for each group (lang, source) each other source of its language
    with the sum of the absolute differences of their shares of each kept term. Part `term`: the top_terms terms of which a
    group has a larger share than its language, with the difference.

    Reads lang, source and text; null reads as empty, and so do missing terms in empty texts; other columns are left alone,
    whatever their names. A language without a kept term gives pairs of difference 0. Equal values are ranked by item. Long
    texts and long terms are counted whole. Equal rows count as often as they are there; an empty table gives an empty one.
    Exact for languages of under 9 * 10^15 terms."""
    cells = materialize(kept_cells(docs, least_docs), "divergence-cells")
    kept = cells.where(~_of_group())
    vocabulary = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).withColumn("falling", -F.col("lang_n"))
    ranked = with_global_rank(vocabulary, ["lang", "falling", "term"], "at")
    langs = ranked.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("total"), F.min("at").alias("first_at"))
    columns = ranked.join(langs, "lang").select("lang", "term", (F.col("at") - F.col("first_at")).alias("col"), share(F.col("lang_n"), F.col("total"), F.col("terms")).alias("q"))

    sums = cells.groupBy("lang", "source").agg(F.sum(F.when(~_of_group(), F.col("n")).otherwise(0)).alias("total")).withColumn("falling", -F.col("total"))
    placed = with_global_rank(sums, ["lang", "falling", "source"], "at")
    first = placed.groupBy("lang").agg(F.min("at").alias("first_at"), F.count("*").alias("groups"))
    totals = langs.select("lang", "terms")
    groups = placed.join(first, "lang").join(totals, "lang", "left").select("lang", "source", "total", "groups", (F.col("at") - F.col("first_at")).alias("row"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = materialize(groups.withColumn("zero", F.coalesce(share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0))), "divergence-groups")

    priced = kept.join(columns, ["lang", "term"]).join(groups, ["lang", "source"])
    priced = materialize(priced.select("lang", "source", "term", "row", "col", "groups", "terms", "q", share(F.col("n"), F.col("total"), F.col("terms")).alias("p")), "divergence-shares")

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(order))

    terms = best(priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))).where(F.col("rank") <= top_terms)

    # A block of side groups meets each block of its language, in each stripe of side terms.
    others = F.explode(F.sequence(F.lit(0), ((F.col("groups") - 1) / side).cast("int")))
    stripes = F.explode(F.sequence(F.lit(0), (F.greatest(F.col("terms") - 1, F.lit(0)) / side).cast("int")))
    told = groups.select("lang", "source", "row", "groups", "terms", F.col("zero").alias("p"), stripes.alias("stripe")).withColumns({"col": F.lit(-1).cast("long"), "width": F.least(F.col("terms") - F.col("stripe") * side, F.lit(side)).cast("long")})
    inside = priced.select("lang", F.lit(None).cast("string").alias("source"), "row", "groups", "terms", "p", (F.col("col") / side).cast("int").alias("stripe"), "col").withColumn("width", F.lit(0).cast("long"))
    block = (F.col("row") / side).cast("int")
    tiles = told.unionByName(inside).withColumn("other_block", others).select("lang", "source", F.least(block, "other_block").alias("above"), F.greatest(block, "other_block").alias("below"), "stripe", "row", "col", "p", "width")
    pairs = tiles.groupBy("lang", "above", "below", "stripe").applyInArrow(_tiler(side), _SUMS).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = pairs.withColumn("to", F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("other").alias("b")), F.struct(F.col("other").alias("a"), F.col("source").alias("b")))))
    pair = best(both.select("lang", F.col("to.a").alias("source"), F.lit("pair").alias("part"), F.col("to.b").alias("item"), "value"))
    return pair.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
