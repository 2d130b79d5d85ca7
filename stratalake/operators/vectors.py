"""Stored vectors: a table by coarse cells with upserts by content hash, pruning, and searches that read only some cells."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalake.core.snapshots import Draft, Store
from stratalake.core.storage import discard, materialize

#: Cells at most, drawn vectors for each (so that some 32,000 vectors at most are drawn to lay the cells), queries a block.
MOST_CELLS, DRAWN, BLOCK = 1024, 32, 4096
#: The cell of vectors without a direction or of another length; their similarity is 0.
NOWHERE = -1
#: Similarities are rounded to six digits; a bound has to be that much lower to leave a cell out.
SLACK = 2e-6


def _directions(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of vectors of dim numbers that have a direction, and these as rows of unit length."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    rows = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norms = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return at[good], rows[good] / norms[good, None]


def centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """At most so many directions that the sample's different rows gather around: k-means by cosine."""
    points = np.unique(sample, axis=0)
    random = np.random.default_rng(seed)
    now = points[random.permutation(len(points))[:cells]]
    for _ in range(rounds):
        own = np.argmax(points @ now.T, axis=1)
        sums = np.zeros_like(now)
        np.add.at(sums, own, points)
        norms = np.sqrt((sums * sums).sum(axis=1))
        now = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], now)
    return now


class VectorTable:
    """The vectors of one namespace and model under a folder: item_id, doc_id, content_hash, vector, cell, cos.

    Each row lies in the cell of the centroid nearest to it, cos is its cosine with that; a change writes the cells that it
    touches and becomes visible as a whole, as a snapshot. Centroids come from a bounded sample of the first rows; every row
    is in a cell. Rows without an item_id are left out; of several rows of one item the last by content_hash and vector
    counts. A cell is never one task's: large ones are written and read in several pieces."""

    def __init__(self, spark: SparkSession, root: str, namespace: str, model: str, dim: int) -> None:
        self.spark, self.dim = spark, dim
        self.store = Store(spark, f"{root.rstrip('/')}/{quote(namespace, safe='')}/{quote(model, safe='')}")

    def rows(self) -> DataFrame | None:
        return self.store.read("vectors")

    def hashes(self) -> DataFrame | None:
        """item_id and content_hash of all rows: what an encoder has to be asked for follows from it (stale_items)."""
        rows = self.rows()
        return None if rows is None else rows.select("item_id", "content_hash")

    def count(self) -> int:
        rows = self.rows()
        return 0 if rows is None else rows.count()

    def _lay_cells(self, new: DataFrame, cells: int | None) -> np.ndarray:
        n = new.count()
        wanted = cells or max(1, min(MOST_CELLS, int(n**0.5)))
        share = min(1.0, wanted * DRAWN / max(n, 1))
        drawn = new.where(F.pmod(F.xxhash64("item_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vector").toArrow().column(0).combine_chunks()
        points = _directions(drawn, self.dim)[1]
        return centroids(points, wanted) if len(points) else np.zeros((0, self.dim))

    def _placed(self, new: DataFrame, centres: np.ndarray) -> DataFrame:
        held = self.spark.sparkContext.broadcast(centres)  # at most MOST_CELLS x dim numbers
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, cos = np.full(batch.num_rows, NOWHERE, dtype=np.int32), np.zeros(batch.num_rows)
                at, units = _directions(batch.column("vector"), dim)
                if len(at) and len(held.value):
                    near = units @ held.value.T
                    cell[at] = near.argmax(axis=1)
                    cos[at] = near.max(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(cos)], [*batch.schema.names, "cell", "cos"])

        kind = new.schema["item_id"].dataType.simpleString()
        return new.select("item_id", "doc_id", "content_hash", "vector").mapInArrow(run, f"item_id {kind}, doc_id string, content_hash string, vector array<float>, cell int, cos double")

    def _cells(self, draft: Draft | None = None) -> DataFrame | None:
        return self.store.read("cells") if draft is None else draft.read("cells")

    def _commit(self, draft: Draft, old: DataFrame | None, new: DataFrame | None, gone: DataFrame, centres: np.ndarray) -> int:
        """The rows of the items gone (item_id) go, new ones (placed) come; only cells that this touches are written."""
        touched = None if old is None else old.join(gone, "item_id", "left_semi").select("cell")
        if new is not None:
            touched = new.select("cell") if touched is None else touched.unionByName(new.select("cell"))
        touched = materialize(touched.distinct(), "touched-cells")
        rows = new
        if old is not None:
            kept = old.join(F.broadcast(touched), "cell", "left_semi").join(gone, "item_id", "left_anti")  # a row a cell
            rows = kept if new is None else kept.unionByName(new)
        draft.put("vectors", rows, touched, key="cell")
        bounds = draft.read("vectors").groupBy("cell").agg(F.min("cos").alias("least"), F.count("*").alias("n"))
        kind = "cell int, centre array<double>"
        table = self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)] + [(NOWHERE, None)], kind)
        draft.replace("cells", table.join(bounds, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0))), key="cell")
        number = draft.commit()
        discard(touched)
        return number

    def _centres(self) -> np.ndarray:
        rows = self._cells().where(F.col("cell") >= 0).orderBy("cell").select("centre").collect()
        return np.array([r[0] for r in rows], dtype=np.float64).reshape(len(rows), self.dim)

    def upsert(self, new: DataFrame, cells: int | None = None) -> int:
        """Puts rows (item_id, content_hash, vector, and doc_id if there is one) in place of those with their item_id. Rows
        that are stored with the same hash and length stay untouched. Returns the number of rows that were written; cells:
        how many to lay at first, else the root of the number of rows, at most MOST_CELLS."""
        doc = F.col("doc_id").cast("string") if "doc_id" in new.columns else F.lit(None).cast("string")
        given = new.where("item_id IS NOT NULL").select("item_id", doc.alias("doc_id"), "content_hash", F.col("vector").cast("array<float>").alias("vector"))
        last = F.max(F.struct("content_hash", "vector", "doc_id")).alias("last")
        given = given.groupBy("item_id").agg(last).select("item_id", "last.doc_id", "last.content_hash", "last.vector")
        old = self.rows()
        if old is not None:
            known = old.select("item_id", F.col("content_hash").alias("o_hash"), F.size("vector").alias("o_dim"), F.col("doc_id").alias("o_doc"))
            # A row without a hash may be another vector, so it is written.
            same = (F.col("content_hash") == F.col("o_hash")) & (F.size("vector") == F.col("o_dim")) & F.col("doc_id").eqNullSafe(F.col("o_doc"))
            given = given.join(known, "item_id", "left").where(~F.coalesce(same, F.lit(False))).drop("o_hash", "o_dim", "o_doc")
        given = materialize(given, "vectors-given")
        n = given.count()
        if n or old is None:
            centres = self._lay_cells(given, cells) if old is None or not old.head(1) else self._centres()
            placed = materialize(self._placed(given, centres), "vectors-placed")
            size = n * self.dim * 4
            self._commit(self.store.begin(size), old, placed, placed.select("item_id"), centres)
            discard(placed)
        discard(given)
        return n

    def _remove(self, gone: DataFrame, old: DataFrame) -> int:
        gone = materialize(gone, "vectors-gone")
        n = gone.count()
        if n:
            self._commit(self.store.begin(), old, None, gone, self._centres())
        discard(gone)
        return n

    def prune(self, wanted: DataFrame) -> int:
        """Removes the rows of all items that aren't in wanted (item_id); returns how many."""
        old = self.rows()
        return 0 if old is None else self._remove(old.select("item_id").join(wanted.select("item_id"), "item_id", "left_anti"), old)

    def delete_docs(self, docs: DataFrame) -> int:
        """Removes the rows of documents (doc_id); returns how many."""
        old = self.rows()
        return 0 if old is None else self._remove(old.join(docs.select(F.col("doc_id").cast("string")), "doc_id", "left_semi").select("item_id"), old)

    def _scan(self, names: pa.Array, units: np.ndarray, has: np.ndarray, wanted: dict[int, np.ndarray], k: int, kind: str, allowed: DataFrame | None) -> DataFrame:
        """The k best of each query within the cells wanted for it (cell to places of queries): query_id, id, similarity."""
        buckets = self._cells().where(F.col("cell").isin([int(c) for c in wanted])).select(Draft.bucket_of("cell", self.store.manifest()["buckets"])).distinct().collect()
        rows = self.store.read_buckets("vectors", [str(b[0]) for b in buckets]).where(F.col("cell").isin([int(c) for c in wanted]))
        if allowed is not None:
            rows = rows.join(allowed.select("item_id"), "item_id", "left_semi")
        held = self.spark.sparkContext.broadcast((names.to_pylist(), names.type, units, has, wanted))
        dim, out = self.dim, f"query_id {kind}, id {rows.schema['item_id'].dataType.simpleString()}, similarity double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, names_kind, units, has, wanted = held.value
            best: dict[int, list[tuple]] = {}
            ids_kind = None
            for batch in batches:
                ids_kind = batch.column(0).type
                ids, cells = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                at, own = _directions(batch.column(2), dim)
                place = np.full(len(ids), -1)
                place[at] = np.arange(len(at))
                for cell in np.unique(cells):
                    asked, here = wanted[int(cell)], np.flatnonzero(cells == cell)
                    sims = np.zeros((len(asked), len(here)))
                    left, right = np.flatnonzero(has[asked]), np.flatnonzero(place[here] >= 0)
                    if len(left) and len(right):
                        sims[np.ix_(left, right)] = units[asked[left]] @ own[place[here[right]]].T
                    sims = np.round(sims, 6) + 0.0
                    for row, q in enumerate(asked):
                        near = range(len(here))
                        if len(here) > k:
                            near = np.flatnonzero(sims[row] >= np.partition(sims[row], len(here) - k)[len(here) - k])
                        best[q] = sorted([*best.get(q, []), *((-sims[row, j], ids[here[j]]) for j in near)])[:k]
            flat = [(names[q], i, -s) for q, found in best.items() for s, i in found]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], names_kind), pa.array([f[1] for f in flat], ids_kind), pa.array([f[2] for f in flat], pa.float64())], ["query_id", "id", "similarity"])

        return rows.select("item_id", "cell", "vector").mapInArrow(run, out)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = True, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, id, similarity and rank of each query's k nearest items by cosine, ties by id; queries (query_id,
        query_vec) is a stated set, gone through in blocks.

        At first the `probes` cells with the centroids nearest to a query are read (an eighth of all, eight at least). With
        exact, all other cells follow that can hold a vector as near as the k-th: no vector of a cell is nearer to a query
        than the angle between query and centroid less the cell's widest angle allows. Without, the first cells are all,
        and there may be less than k. allowed (item_id) is applied before the ranking. Queries of another length or without
        a direction have similarity 0 with everything."""
        found = self._cells()
        if found is None:
            raise ValueError("nothing is stored")
        cells = sorted(found.where("n > 0").collect(), key=lambda r: r.cell)  # at most MOST_CELLS rows
        kinds = queries.schema["query_id"].dataType.simpleString(), self.rows().schema["item_id"].dataType.simpleString()
        out = self.spark.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, similarity double")
        probes = probes or max(8, -(-len(cells) // 8))
        blocks = -(-queries.count() // BLOCK) if cells else 0
        for part in range(blocks):
            own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == part)
            table = own.select("query_id", F.col("query_vec").cast("array<double>")).toArrow()
            names = table.column(0).combine_chunks()
            if not len(names):
                continue
            units, has = np.zeros((len(names), self.dim)), np.zeros(len(names), dtype=bool)
            at, rows = _directions(table.column(1).combine_chunks(), self.dim)
            units[at], has[at] = rows, True
            near, reach = self._bounds(cells, units, has)
            first = np.zeros(near.shape, dtype=bool)
            np.put_along_axis(first, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
            asked = lambda mask: {r.cell: np.flatnonzero(mask[:, c]) for c, r in enumerate(cells) if mask[:, c].any()}
            hits = materialize(self._scan(names, units, has, asked(first), k, kinds[0], allowed), "vector-hits")
            out = out.unionByName(hits)
            if exact:
                order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
                kth = {r.query_id: r.similarity for r in hits.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).collect()}  # a row a query of the block
                floor = np.array([kth.get(n, -2.0) for n in names.to_pylist()])
                more = ~first & (reach + SLACK >= floor[:, None])
                if more.any():
                    out = out.unionByName(self._scan(names, units, has, asked(more), k, kinds[0], allowed))
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def tune(self, k: int = 10, recall: float = 0.9, drawn: int = 512) -> int:
        """How many cells a search without exact has to read so that it finds the stated share of the k nearest, and two
        hundredths more: measured by exact searches for some `drawn` stored vectors."""
        rows, n = self.rows(), self.count()
        share = int(min(1.0, drawn / max(n, 1)) * (1 << 20)) + 1
        own = rows.where((F.col("cell") != NOWHERE) & (F.pmod(F.xxhash64("item_id"), F.lit(1 << 20)) < share)).select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vec"))
        own = materialize(own, "vectors-drawn")
        hits = self.search(own, k + 1).where("id <> query_id").join(rows.select(F.col("item_id").alias("id"), "cell"), "id").join(own, "query_id")
        table = hits.select("cell", "query_vec").toArrow()  # some drawn x k rows
        if not table.num_rows:
            return 1
        cells = sorted(self._cells().where("n > 0").collect(), key=lambda r: r.cell)
        units = _directions(table.column(1).combine_chunks(), self.dim)[1]
        near = self._bounds(cells, units, np.ones(len(units), dtype=bool))[0]
        numbers = np.array([r.cell for r in cells])
        place = np.argmax(numbers[np.argsort(-near, axis=1, kind="stable")] == table.column(0).to_numpy()[:, None], axis=1)
        discard(own)
        return int(np.quantile(place, min(1.0, recall + 0.02), method="higher")) + 1

    def _bounds(self, cells: list, units: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By query and cell: the cosine with the centroid, and the most that the cosine with a vector of the cell can be."""
        centres = np.array([r.centre or [0.0] * self.dim for r in cells])
        least = np.array([1.0 if r.least is None else r.least for r in cells])
        near = np.clip(units @ centres.T, -1, 1)
        angle = np.arccos(near) - np.arccos(np.clip(least, -1, 1))[None, :]
        reach = np.cos(np.clip(angle, 0, np.pi))
        nowhere = np.array([r.cell == NOWHERE for r in cells])
        reach[:, nowhere] = 0.0
        reach[~has] = 0.0
        return near, reach
