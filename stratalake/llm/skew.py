"""Joins to one row a key where a key may hold a third of all rows; names that no column has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent if it holds more than one in PARTS of the rows and more than LEAST rows: fewer than PARTS keys are.
PARTS, LEAST = 10_000, 10_000


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column is called so, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def join_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the columns of right, which has one row for each of its keys; null keys meet each other.

    Frequent keys' rows of right, fewer than PARTS, are broadcast, so that no task gets all of left's rows of a key; the
    rest is shuffled. left is read three times, right twice: both should be tables or cheap."""
    other = unused([*left.columns, *right.columns], *[f"{k}_right" for k in keys])
    named = right.withColumnsRenamed(dict(zip(keys, other, strict=True)))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, other, strict=True)])
    counted = left.groupBy(*keys).agg(F.count("*").alias("rows_of_key"))
    n = left.count() if left.columns else 0
    frequent = counted.where(F.col("rows_of_key") > max(LEAST, n / PARTS)).select(*keys).collect() if n > LEAST else []
    if not frequent:
        return left.join(named, on, how).drop(*other)
    kinds = ", ".join(f"`{o}` {left.schema[k].dataType.simpleString()}" for k, o in zip(keys, other, strict=True))
    hot = F.broadcast(left.sparkSession.createDataFrame([tuple(r) for r in frequent], kinds))
    common = left.join(hot, on, "left_semi").join(F.broadcast(named.join(hot.select([F.col(o).alias(k) for k, o in zip(keys, other, strict=True)]), on, "left_semi")), on, how)
    return common.unionByName(left.join(hot, on, "left_anti").join(named, on, how)).drop(*other)
