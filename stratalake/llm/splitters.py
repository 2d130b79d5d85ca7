"""Sampled splitters: shards of nearly equal bytes from size-weighted key samples. DataFrame functions only."""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalake.core.storage import materialize

LOW = -(2**63)
#: Cuts are looked up by the top bits of the key, so a row meets few of them.
LOOKUP_BITS = 12
#: Ranges at the shards' borders are cut to this part of the quota.
FINE = 32
#: Rows that are numbered in one window, at most some twice as many.
ROWS_PER_BIN = 1 << 18

NEW = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "range")


def _lookup(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def _range_of(cuts: list[tuple[int, int]]) -> Column:
    """How many of the sorted cuts lie at or below the row's (key, sub)."""
    if not cuts:
        return F.lit(0)
    buckets = [{"base": 0, "cuts": []} for _ in range(2**LOOKUP_BITS)]
    for k, s in cuts:
        buckets[(k >> (64 - LOOKUP_BITS)) + 2 ** (LOOKUP_BITS - 1)]["cuts"].append({"k": k, "s": s})
    seen = 0
    for b in buckets:
        b["base"] = seen
        seen += len(b["cuts"])
    table = _lookup(buckets, "array<struct<base:int,cuts:array<struct<k:bigint,s:bigint>>>>")
    own = F.element_at(table, (F.shiftright("key", 64 - LOOKUP_BITS) + 2 ** (LOOKUP_BITS - 1) + 1).cast("int"))
    below = F.filter(own["cuts"], lambda c: (c["k"] < F.col("key")) | ((c["k"] == F.col("key")) & (c["s"] <= F.col("sub"))))
    return own["base"] + F.size(below)


def _sampled(rows: DataFrame, quota: float, samples: int, seed: int) -> dict[int, list]:
    """By range, rows drawn with a chance of size over step, sorted by key, each standing for max(size, step) bytes.

    About samples rows for each quota of bytes come to the driver, whatever the table's size."""
    step = quota / samples
    u = F.shiftrightunsigned(F.xxhash64("key", "sub", F.lit(seed)), 11) / float(2**53)
    drawn = rows.where(u < F.col("size") / F.lit(step)).select("rng", "key", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("w"))
    out: dict[int, list] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["rng"], r["key"])):
        out.setdefault(r["rng"], []).append((r["key"], r["w"]))
    return out


def _cuts_within(drawn: dict[int, list], over: list, quota: float) -> list[tuple[int, int]]:
    """Quantile boundaries inside each range of over. A boundary is a whole key, so equal texts stay together; each range
    gets one at least, in the middle of its keys where the sample gives none."""
    cuts: list[tuple[int, int]] = []
    for row in over:
        mass: dict[int, float] = {}
        for key, w in drawn.get(row["rng"], []):
            mass[key] = mass.get(key, 0.0) + w
        whole, pieces = sum(mass.values()), max(2, round(row["bytes"] / quota))
        at, due, new = 0.0, 1, []
        for key, w in mass.items():
            if (at >= due * whole / pieces or w >= quota) and key > row["lo"]:
                new.append((key, LOW))
            while at >= due * whole / pieces:
                due += 1
            if w >= quota and key < row["hi"]:
                new.append((key + 1, LOW))  # a frequent text gets a range of its own
            at += w
        cuts += new or [((row["lo"] + row["hi"] + 1) // 2, LOW)]
    return cuts


def _levels(loads: list[float], ordinary: float) -> list[float]:
    """How many more bytes each shard takes, so that all of ordinary is taken and the shards end as even as they can."""
    order = sorted(loads)
    level = ordinary
    for k in range(len(order), 0, -1):
        level = (ordinary + sum(order[:k])) / k
        if level >= order[k - 1]:
            break
    return [max(0.0, level - x) for x in loads]


def _assigned(stats: list, n_shards: int, quota: float) -> tuple[dict[int, int], list]:
    """A shard for each range, and the ranges that a border between shards would cut.

    Ranges of a single frequent text are dealt out largest first. The others, in the order of their keys, fill the shards
    one after another: each shard has one stretch of them."""
    single = [r for r in stats if r["lo"] == r["hi"] and r["bytes"] > quota / 2]
    place: dict[int, int] = {}
    load = [(0, s) for s in range(n_shards)]
    for r in sorted(single, key=lambda r: (-r["bytes"], r["rng"])):
        got, s = heapq.heappop(load)
        heapq.heappush(load, (got + r["bytes"], s))
        place[r["rng"]] = s
    loads = [got for got, _ in sorted(load, key=lambda x: x[1])]
    rest = sorted((r for r in stats if r["rng"] not in place), key=lambda r: r["rng"])
    room = _levels(loads, sum(r["bytes"] for r in rest))
    border, s, at, cut = room[0], 0, 0, []
    for r in rest:
        before = at
        while s + 1 < n_shards and before + r["bytes"] / 2 > border:
            s += 1
            border += room[s]
        place[r["rng"]] = s
        at += r["bytes"]
        # Borders inside this range: the one before it and the one after it are looked at.
        if any(before < b < at for b in (border, border - room[s])):
            cut.append(r)
    return place, cut


def sampled_splitters(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 64, samples_per_range: int = 32, rows_per_bin: int = ROWS_PER_BIN, seed: int = 42, carry: bool = False
) -> DataFrame:
    """A row for each document: its shard and its gapless slot there; the shards' bytes are nearly equal.

    The key is a hash of the text, so equal texts lie side by side. Size-weighted samples of the keys give quantile
    boundaries for n_shards * ranges_per_shard ranges; ranges that turn out to hold over twice their quota are sampled
    again and subdivided until none is left. The records are range-partitioned: a shard is a stretch of ranges, whose
    borders are cut finer, and besides holds frequent texts, which have ranges of their own and are dealt out largest
    first. A text whose rows hold more than a whole shard is subdivided by a hash of its rows, so even equal rows are
    spread; smaller groups of equal texts are never split.

    The driver holds some samples_per_range rows a range, a few numbers a range, and a count for each rows_per_bin rows.

    size is the text's UTF-8 bytes plus 1. Null texts have no bytes, so size 1 and CRC-32 0, and form one group. Null or repeated
    doc_ids and repeated rows each get a slot of their own. An empty table gives an empty result. Other columns of docs,
    whatever their names, are not looked at. With carry they come first in the result, all of them; one that is named like
    a new column ends in `_in` there.
    """
    given = [F.struct(*[F.col(f"`{c}`").alias(f"{c}_in" if c in NEW else c) for c in docs.columns]).alias("carried")] if carry else []
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"),
            F.xxhash64(text_col).alias("key"),
            F.xxhash64(id_col, F.lit(seed)).alias("base"),
            F.monotonically_increasing_id().alias("row"),
            *given,
        ),
        "splitters",
    )
    cuts: list[tuple[int, int]] = []
    quota = max(1.0, (rows.agg(F.sum("size")).first()[0] or 0) / (n_shards * ranges_per_shard))
    # Rows of one text and id that fill a range: fewer than there are ranges. Each of them is told apart by its row.
    equal = rows.groupBy("key", "base").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > quota) & (F.col("n") > 1)).collect()
    told = F.col("key").isin([r["key"] for r in equal]) & F.col("base").isin([r["base"] for r in equal]) if equal else F.lit(False)
    rows = rows.withColumn("sub", F.when(told, F.xxhash64("base", "row", F.lit(seed))).otherwise(F.col("base")))

    def measured() -> tuple[DataFrame, list]:
        ranged = rows.withColumn("rng", _range_of(cuts))
        return ranged, ranged.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()

    def subdivided(over: list, quota: float, turn: int) -> None:
        drawn = _sampled(ranged.where(F.col("rng").isin([r["rng"] for r in over])), quota, samples_per_range * (turn + 1), seed + turn)
        cuts[:] = sorted({*cuts, *_cuts_within(drawn, over, quota)})

    turn = 0
    while True:
        ranged, stats = measured()
        total = sum(r["bytes"] for r in stats)
        over = [r for r in stats if r["bytes"] > 2 * quota and r["lo"] < r["hi"]]
        if not over:
            break
        subdivided(over, quota, turn)
        turn += 1
    # What is left over the size of a shard holds a single text: it is cut by the hash of its rows.
    whole = [r for r in stats if r["bytes"] > total / n_shards and r["n"] > 1]
    for r in whole:
        pieces = max(2, round(r["bytes"] / quota))
        cuts += [(r["lo"], LOW + 2**64 * i // pieces) for i in range(1, pieces)]
    cuts.sort()
    # Once more at the shards' borders, in finer pieces.
    if whole:
        ranged, stats = measured()
    place, border = _assigned(stats, n_shards, quota)
    border = [r for r in border if r["lo"] < r["hi"] and r["bytes"] > 2 * quota / FINE]
    if border:
        subdivided(border, quota / FINE, turn)
        ranged, stats = measured()
        place, _ = _assigned(stats, n_shards, quota)
    # A range of many small rows is numbered in bins by the hash of its rows, so that no task gets all of a frequent text.
    even = max(1.0, min(rows_per_bin, sum(r["n"] for r in stats) / (n_shards * ranges_per_shard)))
    bins = {r["rng"]: round(r["n"] / even) if r["n"] > 2 * even else 1 for r in stats}
    counts = _lookup([bins.get(i, 1) for i in range(len(cuts) + 1)], "array<bigint>")
    ranged = ranged.withColumn("bin", F.pmod("sub", F.element_at(counts, F.col("rng") + 1)).cast("int"))
    in_bins: dict[int, dict[int, int]] = {}
    for r in ranged.groupBy("rng", "bin").agg(F.count("*").alias("n")).collect():
        in_bins.setdefault(r["rng"], {})[r["bin"]] = r["n"]
    slots, where = [0] * n_shards, {}
    for r in sorted(stats, key=lambda r: r["rng"]):
        s, first = place[r["rng"]], []
        for b in range(bins[r["rng"]]):
            first.append(slots[s])
            slots[s] += in_bins[r["rng"]].get(b, 0)
        where[r["rng"]] = {"shard": s, "first": first}
    table = _lookup([where.get(i, {"shard": 0, "first": [0]}) for i in range(len(cuts) + 1)], "array<struct<shard:int,first:array<bigint>>>")
    own = F.element_at(table, F.col("rng") + 1)
    in_range = Window.partitionBy("rng", "bin").orderBy("key", "sub", "id", "crc", "size")
    return ranged.withColumn("k", F.row_number().over(in_range)).select(
        *(["carried.*"] if carry else [F.col("id").alias(id_col)]),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        own["shard"].alias("shard"),
        (F.element_at(own["first"], F.col("bin") + 1) + F.col("k") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("rng").alias("range"),
    )
