"""Global positions of sorted rows without a single task or a window over everything."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.core.storage import materialize


def with_global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with a gapless long from 0 by the given columns; written to the shared folder.

    The rows are range-partitioned, so a frequent first column is spread by the next ones; the driver holds a count for
    each partition."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    counts = {r["p"]: r["n"] for r in laid.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, before = [], 0
    for p in range(max(counts, default=0) + 1):
        offsets.append(before)
        before += counts.get(p, 0)
    table = F.from_json(F.lit(json.dumps(offsets)), "array<bigint>")
    return laid.withColumn(name, F.element_at(table, (part + 1).cast("int")) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")
