"""SimHash near-duplicates: tiled exact comparison of fingerprints with exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.core.storage import materialize
from stratalake.llm.components import connected_components
from stratalake.llm.skew import join_to_one, unused

#: A tile holds this many fingerprints at most; two tiles are compared in blocks of this many rows.
TILE, BLOCK = 4096, 256
#: Pairs of tiles with fewer comparisons than this are compared many at once.
SMALL = 1 << 14
#: A fingerprint's population counts are taken over its quarters.
PARTS = 4


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64 bits that over half of the word shingles' XXH64 have set; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        spans = zip([0, *(ends[: len(words) - shingle] + 1).tolist()], ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """id, the longs that keys names, and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(fps)], ["id", *keys, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    named = "".join(f", {k} long" for k in keys)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keys).mapInArrow(run, f"id {kind}{named}, fp long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    """The population counts of the 16-bit quarters, as rows."""
    return np.bitwise_count(fp.view(np.uint64)[:, None] >> np.array([48, 32, 16, 0], dtype=np.uint64) & np.uint64(0xFFFF)).astype(np.int64)


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Changes of the four counts that radius flipped bits can make, one of each pair of opposites."""
    axis = np.arange(-radius, radius + 1)
    every = np.stack(np.meshgrid(*[axis] * PARTS, indexing="ij"), -1).reshape(-1, PARTS)
    near = every[np.abs(every).sum(axis=1) <= radius]
    return sorted(t for t in map(tuple, near.tolist()) if t >= (0,) * PARTS)


def _forest(links: np.ndarray) -> np.ndarray:
    """Of links (rows of two fingerprints), as many as connect the same fingerprints: each to the least of its group."""
    if not len(links):
        return links
    names, flat = np.unique(links, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    least = np.arange(len(names))
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, least[a], low)
        np.minimum.at(new, least[b], low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    rest = least != np.arange(len(names))
    return np.stack([names[least[rest]], names[rest]], axis=1)


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Index pairs of fingerprints at radius or fewer differing bits, all of left against all of right."""
    found = []
    for at in range(0, len(left), BLOCK):
        i, j = np.nonzero(np.bitwise_count(left[at : at + BLOCK, None] ^ right[None, :]) <= radius)
        found.append(np.stack([i + at, j], axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in a row, and where each list begins."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[at[0] : at[-1]].view(np.uint64), at - at[0]


def _runs(rows: np.ndarray, work: np.ndarray, most: int = 1 << 21) -> Iterator[np.ndarray]:
    """rows in runs of some `most` comparisons."""
    if len(rows):
        yield from np.split(rows, np.flatnonzero(np.diff(np.cumsum(work[rows]) // most)) + 1)


def _small_pairs(left: np.ndarray, l_at: np.ndarray, right: np.ndarray, r_at: np.ndarray, rows: np.ndarray, radius: int) -> np.ndarray:
    """Links of many small pairs of tiles at once."""
    wide = r_at[rows + 1] - r_at[rows]
    work = (l_at[rows + 1] - l_at[rows]) * wide
    k = np.arange(work.sum()) - np.repeat(np.cumsum(work) - work, work)
    w = np.repeat(wide, work)
    a, b = left[np.repeat(l_at[rows], work) + k // w], right[np.repeat(r_at[rows], work) + k % w]
    near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
    return np.stack([a[near].view(np.int64), b[near].view(np.int64)], axis=1)


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints, as many as connect all that are within radius differing bits.

    Fingerprints are tiled by the population counts of their four quarters; a pair of tiles whose counts differ by more
    than the radius in sum is skipped. Each tile, in pieces of TILE fingerprints, is sent to those of its own pieces and
    of its neighbours' pieces with which it has to be compared; a row is one pair of pieces, so a full tile's comparisons
    are spread over its pieces. A comparison passes on a spanning forest, not all pairs.
    """
    steps = _steps(radius)

    def tiles(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups:
            fp = batch.column(0).to_numpy()
            own = _quarters(fp)
            tile = own @ np.array([17**3, 17**2, 17, 1])
            yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(fp)], ["tile", "fp"])

    tiled = materialize(fps.select("fp").distinct().mapInArrow(tiles, "tile long, fp long"), "simhash-tiled")
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / TILE).cast("int").alias("pieces"))
    # At most 17 ** 4 tiles exist, so this table is bounded.
    pieces = materialize(
        tiled.join(F.broadcast(sizes), "tile").withColumn("piece", F.pmod(F.xxhash64("fp"), "pieces").cast("int")).groupBy("tile", "piece").agg(F.collect_list("fp").alias("fps")), "simhash-tiles"
    )
    near = F.array(*[F.lit(sum(c * 17 ** (PARTS - 1 - i) for i, c in enumerate(s))) for s in steps])
    moved = pieces.select(F.col("tile").alias("l_tile"), F.col("piece").alias("l_piece"), F.col("fps").alias("l_fps"), F.explode(near).alias("step")).withColumn("tile", F.col("l_tile") + F.col("step"))
    pairs = moved.join(F.broadcast(sizes), "tile").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).where("step <> 0 OR l_piece <= piece").join(pieces, ["tile", "piece"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, l_at), (right, r_at) = (_lists(c) for c in batch.columns)
            work = np.diff(l_at) * np.diff(r_at)
            for rows in _runs(np.flatnonzero(work < SMALL), work):
                kept = _forest(_small_pairs(left, l_at, right, r_at, rows, radius))
                yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["a", "b"])
            for i in np.flatnonzero(work >= SMALL):
                own, other = left[l_at[i] : l_at[i + 1]], right[r_at[i] : r_at[i + 1]]
                # A pair of pieces is compared band by band, so that the links at hand stay few.
                kept = np.empty((0, 2), dtype=np.int64)
                for at in range(0, len(own), BLOCK):
                    ij = close_pairs(own[at : at + BLOCK], other, radius)
                    a, b = own[at + ij[:, 0]].view(np.int64), other[ij[:, 1]].view(np.int64)
                    kept = _forest(np.concatenate([kept, np.stack([a, b], axis=1)[a != b]]))
                yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["a", "b"])

    return pairs.select("l_fps", "fps").mapInArrow(compared, "a long, b long").distinct()


def _rooted(fps: DataFrame, least: Column, radius: int) -> DataFrame:
    """fp, root and least for each fingerprint: the root is its group's, least an aggregate over the fingerprint's rows."""
    component = connected_components(links(fps, radius))
    own = fps.groupBy("fp").agg(least.alias("least"))
    rooted = own.join(component, own["fp"] == component["node"], "left").select(own["fp"], F.coalesce("root", own["fp"]).alias("root"), "least")
    return materialize(rooted, "simhash-roots")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """id, fp and component: the least id that is reachable over links of radius or fewer differing bits.

    Null and empty texts, and texts of white space, have fingerprint 0, which links like any other. Texts of fewer words
    than a shingle are one shingle. Rows of a null id are linked and get their component from the others' ids (null if
    there is none). Repeated rows give repeated rows. An empty table gives an empty result; other columns are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    rooted = _rooted(fps, F.min("id"), radius)
    best = rooted.groupBy("root").agg(F.min("least").alias("component"))
    # A component can have very many fingerprints, and a fingerprint very many rows.
    found = join_to_one(fps, materialize(join_to_one(rooted.select("fp", "root"), best, ["root"]).select("fp", "component"), "simhash-components"), ["fp"])
    return found.select(F.col("id").alias(id_col), "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """docs with one row of each group of simhash_groups: the least id, null last, then the least hash of the whole row.

    Rows are told apart by 128 bits of hashes of all their columns, not by their ids: several null ids and different
    rows of a repeated id are rows of their own. Of exactly equal rows one stays. A rerun keeps the same rows."""
    keys = tuple(unused(["id", "fp", "text", "root", "least", "lost", *docs.columns], "row_key_a", "row_key_b"))
    columns = [c for name in docs.columns for c in (F.col(f"`{name}`"), F.isnull(F.col(f"`{name}`")))]
    keyed = docs.withColumns({k: F.xxhash64(F.lit(i), *columns) for i, k in enumerate(keys)})
    fps = materialize(fingerprints(keyed, id_col, text_col, shingle, keys), "simhash")
    rooted = _rooted(fps, F.min(F.struct(F.isnull("id").alias("lost"), "id", *keys)), radius)
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(*[F.col("least")[k].alias(k) for k in keys])
    return keyed.join(kept, list(keys), "left_semi").dropDuplicates(list(keys)).drop(*keys)
