"""Mixing sources to target weights: equal-token blocks, shared out by Sainte-Laguë's highest quotients."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalake.core.ranks import with_global_rank
from stratalake.core.storage import materialize
from stratalake.llm.skew import join_to_one

#: A word is a run of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: Words of a block and documents of a shard of a source, at most.
BLOCK_WORDS, SHARD_ROWS = 1 << 20, 1 << 16
#: Equal rows that one task writes.
EQUAL_ROWS = 4096


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Integer seats by the highest quotients votes / (2 * won + 1); nobody wins over most. Ties go to the first."""
    most = [seats] * len(votes) if most is None else most
    won = [0] * len(votes)
    heap = [(-v, i) for i, v in enumerate(votes) if v > 0 and most[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        won[i] += 1
        if won[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    return won


def capped_targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight; targets stop at cap times the size, the excess is reshared until none is above."""
    total, fixed = float(sum(sizes)), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        left, by = total - sum(fixed.values()), sum(weights[i] for i in rest)
        share = {i: left * weights[i] / by if by else 0.0 for i in rest}
        above = [i for i in rest if share[i] > cap * sizes[i]]
        if not above:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in above}


def cell_quotas(words: list[int], target: float, seats: int, block: int, cap: float = 3.0) -> list[int]:
    """How many words each cell of a source gives: its target to the word, if cap times its cells' words hold so many.

    Whole blocks go to the cells by Sainte-Laguë, as many of the source's seats as its target holds. What is then left up
    to the target, which for a small source is all of it, goes to the cells that are below their part of the target.
    """
    full, holds = sum(words), [int(cap * w) for w in words]
    want = min(round(target), sum(holds))
    got = sainte_lague(words, min(seats, want // block), [h // block for h in holds])
    quota = [q * block for q in got]
    gaps = [max(0.0, min(h, want * w / full) - q) if full else 0.0 for w, h, q in zip(words, holds, quota, strict=True)]
    left, below = want - sum(quota), sum(gaps)
    quota = [q + int(left * g / below) if below else q for q, g in zip(quota, gaps, strict=True)]
    # Single words that rounding left over: first to the cells with gaps, a word each, then wherever there is room.
    left = want - sum(quota)
    for only_gaps in (True, False):
        for i, h in enumerate(holds):
            more = max(0, min(left, h - quota[i], 1 if only_gaps else left)) if gaps[i] or not only_gaps else 0
            quota[i], left = quota[i] + more, left - more
    return quota


def source_targets(sources: DataFrame, cap: float) -> DataFrame:
    """sources (words, weight) with target: capped_targets without a driver that holds the sources.

    Sources that would get more than cap times their words get that; what all others share by weight rises by what is left
    over, until no other source is above. Each step is one aggregate."""
    total = sources.agg(F.sum("words").alias("words")).first()["words"] or 0
    level, before = 0.0, None
    while True:
        stops = F.col("words") * cap < F.lit(level) * F.col("weight")
        fixed, rest = sources.agg(F.coalesce(F.sum(F.when(stops, F.col("words"))), F.lit(0)), F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0.0))).first()
        if fixed == before or not rest:
            break
        before, level = fixed, (total - cap * fixed) / rest
    return sources.withColumn("target", F.least(F.col("words") * F.lit(float(cap)), F.lit(level) * F.col("weight")))


def source_seats(sources: DataFrame, seats: int, width: int = 63) -> DataFrame:
    """sources (target, most, rank) with seats: sainte_lague over any number of sources.

    The least quotient that wins is found by counting, for `width` quotients at once, how many seats would be won at each;
    seats that are left to equal quotients go to the first sources."""
    won = lambda q: F.least(F.col("most"), F.floor((F.col("target") / F.lit(q) + 1) / 2).cast("long"))
    most, high = sources.agg(F.coalesce(F.sum(F.when(F.col("target") > 0, F.col("most"))), F.lit(0)), F.coalesce(F.max("target"), F.lit(0.0))).first()
    if most <= seats or not high:
        return sources.withColumn("seats", F.when(F.col("target") > 0, F.col("most")).otherwise(0).cast("long"))
    low, high = high / (2.0 * seats + 2), high * 1.000001
    while sources.agg(F.sum(won(low))).first()[0] < seats:
        low /= 1024
    while True:
        between = [low + (high - low) * k / (width + 1) for k in range(1, width + 1)]
        between = [q for q in between if low < q < high]
        if not between:
            break
        counts = sources.agg(*[F.sum(won(q)).alias(f"n{k}") for k, q in enumerate(between)]).first()
        k = sum(n >= seats for n in counts)
        low, high = between[k - 1] if k else low, between[k] if k < len(between) else high
        if k and counts[k - 1] == seats:
            high = low
            break
    first = sources.withColumn("seats", won(high))
    left = seats - (first.agg(F.sum("seats")).first()[0] or 0)
    if not left:
        return first
    following = first.where("seats < most AND target > 0").orderBy(F.desc(F.col("target") / (2 * F.col("seats") + 1)), "rank").limit(left).select(F.col("rank").alias("next"), F.lit(1).alias("one"))
    return first.join(following, F.col("rank") == F.col("next"), "left").withColumn("seats", F.col("seats") + F.coalesce("one", F.lit(0))).drop("next", "one")


def mix_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, blocks: int = 8192, block_words: int = BLOCK_WORDS, shards: int = 64, shard_rows: int = SHARD_ROWS, seed: int = 42
) -> DataFrame:
    """A row for each id, source and text (tie, its XXH64), with the size, n, the number of equal rows, source_size, target,
    and taken, the words that the mix takes of all n rows; see mix_sources."""
    groups = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(text_col).alias("tie"),
        )
        .groupBy("id", "source", "tie", "size")
        .agg(F.count("*").alias("n"))
        .withColumn("mixed", F.xxhash64("id", "tie", F.lit(seed))),
        "mix",
    )
    summed = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count_if(F.col("size") > 0).alias("parts")).withColumn("last", F.col("source").isNull())
    ranked = with_global_rank(summed, ["last", "source"]).drop("last")
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialize(source_targets(ranked.withColumn("weight", share), cap), "mix-targets")
    words, targets = sources.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    block = max(1, min(round(words / blocks), block_words))
    sources = sources.withColumn("most", F.floor(F.lit(cap) * F.col("words") / block).cast("long"))
    sources = materialize(source_seats(sources, round(targets / block)).withColumn("cells", F.greatest(F.lit(shards), F.ceil(F.col("parts") / shard_rows)).cast("long")), "mix-sources")
    with_source = join_to_one(groups, sources.select("source", F.col("words").alias("source_size"), "target", "cells"), ["source"])
    laid = with_source.withColumns({"cell": F.pmod(F.xxhash64("mixed", F.lit(seed)), F.col("cells")), "words": F.col("size") * F.col("n")})
    in_cell = Window.partitionBy("source", "cell").orderBy("mixed", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    laid = materialize(laid.where("size > 0").withColumn("end", F.sum("words").over(in_cell)).withColumn("row", F.monotonically_increasing_id()), "mix-laid")

    def quotas(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("cell")
        quota = cell_quotas(own["words"].tolist(), float(own["target"].iloc[0]), int(own["seats"].iloc[0]), block, cap)
        return pd.DataFrame({"source": own["source"], "cell": own["cell"], "words": own["words"], "quota": quota})

    # One row for each source and cell: at most one in shard_rows of the source's rows, beyond the first `shards`.
    cells = laid.groupBy("source", "cell").agg(F.sum("words").alias("words"))
    told = join_to_one(materialize(cells, "mix-cells"), sources.select("source", "target", "seats"), ["source"])
    quota = materialize(
        told.groupBy("source").applyInPandas(quotas, "source string, cell long, words long, quota long").select("source", "cell", "words", F.floor(F.col("quota") / F.col("words")).alias("rounds"), (F.col("quota") % F.col("words")).alias("rest")),
        "mix-quotas",
    )
    # The blocks of each cell in seeded order, until the rest is covered.
    in_order = Window.partitionBy("source", "cell").orderBy(F.xxhash64("source", "cell", "b", F.lit(seed + 1)), "b")
    picked = (
        quota.where("rest > 0")
        .select("source", "cell", "words", "rest", F.explode(F.expr(f"sequence(0L, (words - 1) div {block}L)")).alias("b"))
        .withColumn("long", F.least(F.lit(block), F.col("words") - F.col("b") * block))
        .withColumn("before", F.sum("long").over(in_order) - F.col("long"))
        .where("before < rest")
        .select("source", "cell", "b", F.least("long", F.col("rest") - F.col("before")).alias("long"))
    )
    parts = laid.select("row", "source", "cell", (F.col("end") - F.col("words")).alias("first"), F.col("end").alias("last"), F.explode(F.expr(f"sequence((end - words) div {block}L, (end - 1) div {block}L)")).alias("b"))
    same = parts["source"].eqNullSafe(picked["source"]) & (parts["cell"] == picked["cell"]) & (parts["b"] == picked["b"])
    overlap = F.least(parts["last"], parts["b"] * block + picked["long"]) - F.greatest(parts["first"], parts["b"] * block)
    taken = parts.join(picked, same).select("row", F.greatest(overlap, F.lit(0)).alias("got")).groupBy("row").agg(F.sum("got").alias("part"))
    rounds = quota.select(F.col("source").alias("q_source"), F.col("cell").alias("q_cell"), "rounds")
    full = (
        laid.join(taken, "row", "left")
        .join(rounds, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("cell") == F.col("q_cell")), "left")
        .withColumn("taken", F.coalesce("rounds", F.lit(0)) * F.col("words") + F.coalesce("part", F.lit(0)))
    )
    columns = ("id", "source", "tie", "size", "n", "source_size", "target", "taken")
    return full.select(*columns).unionByName(with_source.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*columns))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """A row for each document: how many of its words the mix takes, repeats counted.

    Sources, by code point and null last, weigh weights, repeated. The words of all documents are shared out as targets
    (see capped_targets) and cut into `blocks` equal blocks of tokens, of at most block_words. Sainte-Laguë gives each source
    its number of blocks and, within a source, each of its hash shards: `shards` of them, or so many that one has some
    shard_rows. A part of a block makes up each source's target to the word (see cell_quotas), so sources of less than a
    block have their words too. A shard's documents lie in seeded order, one after another; whole rounds over the shard are
    taken first, then seeded blocks of it, the last one cut to what is missing.

    Nothing is held for each source on the driver. Equal rows (of one id, source and text) are one place in a shard, and
    what is taken there is dealt out to them evenly, so not even a third of all rows being equal makes a large shard.

    Null texts and texts without words have size 0 and taken 0. Null doc_ids, repeated doc_ids and repeated rows are
    rows of their own. Equal rows may differ in taken by one word; their multiset doesn't change on a rerun. An empty table
    gives an empty result. Other columns are not looked at.
    """
    mixed = materialize(mix_groups(docs, id_col, text_col, source_col, **options), "mix-groups")
    row = lambda k: (F.floor(F.col("taken") / F.col("n")) + F.when(k < F.col("taken") % F.col("n"), 1).otherwise(0)).cast("long")
    out = lambda df: df.select(F.col("id").alias(id_col), "size", "source_size", "target", row(F.col("k")).alias("taken"), F.col("source").alias(source_col))
    # Very many equal rows are written by many tasks.
    few = mixed.where(F.col("n") <= EQUAL_ROWS).withColumn("k", F.explode(F.expr("sequence(0L, n - 1)")))
    many = mixed.where(F.col("n") > EQUAL_ROWS).withColumn("c", F.explode(F.expr(f"sequence(0L, (n - 1) div {EQUAL_ROWS}L)"))).repartition("id", "tie", "c")
    many = many.withColumn("k", F.explode(F.expr(f"sequence(c * {EQUAL_ROWS}L, least(n, (c + 1) * {EQUAL_ROWS}L) - 1)"))).drop("c")
    return out(few).unionByName(out(many))
