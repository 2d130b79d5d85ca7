"""What changed between two snapshots, what a build has to do again, and how it ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, state: str) -> DataFrame:
    """key and change (added, removed, modified) between two snapshots (key, state)."""
    b, a = before.select(F.col(key).alias("b_key"), F.col(state).alias("b_state")), after.select(F.col(key).alias("a_key"), F.col(state).alias("a_state"))
    change = F.when(F.col("b_key").isNull(), "added").when(F.col("a_key").isNull(), "removed").when(~F.col("a_state").eqNullSafe(F.col("b_state")), "modified")
    return b.join(a, F.col("b_key") == F.col("a_key"), "full").select(F.coalesce("a_key", "b_key").alias(key), change.alias("change")).where("change IS NOT NULL")


def build_fingerprint(source_hash: Column, *parts: str) -> Column:
    """A hash of a file's content hash and of everything else that its build depends on."""
    return F.sha2(F.concat_ws("\x00", source_hash, *[F.lit(p) for p in parts]).cast("binary"), 256)


def to_build(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (path, fingerprint) that the manifest (path, fingerprint, status, warnings) doesn't have as cleanly built."""
    done = manifest.where("status = 'extracted' AND warnings = 0").select("path", "fingerprint")
    return files.join(done, ["path", "fingerprint"], "left_anti")


def build_status(report: DataFrame, group: str) -> DataFrame:
    """failed if there is an error, degraded if there is a warning, else success."""
    bad, odd = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    return report.groupBy(group).agg(F.when(bad > 0, "failed").when(odd > 0, "degraded").otherwise("success").alias("status"), bad.alias("errors"), odd.alias("warnings"))


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """stored with new rows in place of those with their key; of several new ones, the last by seq."""
    last = new.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("seq")))).where("k = 1").drop("k", "seq")
    return stored.join(last.select(*key), key, "left_anti").unionByName(last)


def debounced(events: DataFrame, key: str, ts: str, quiet_seconds: int) -> DataFrame:
    """Bursts of changes of one key: a burst ends with a gap of quiet_seconds; begin, end and number of changes."""
    order = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(order)) >= quiet_seconds * 1_000_000
    bursts = events.select(key, ts).withColumn("burst", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(order))
    return bursts.groupBy(key, "burst").agg(F.min(ts).alias("begin_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("changes"))
