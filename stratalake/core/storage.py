"""Where intermediate results go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: By application, the paths that fresh_path gave out and discard hasn't deleted.
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one on a local master (tests), an error
    on a cluster, whose machines don't share such a folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = context.applicationId
    if app not in _LOCAL:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='stratalake-')}"
        context.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/stratalake-{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratalake_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote for df: for rounds of a loop whose rows nothing reads any more."""
    path = getattr(df, "_stratalake_path", None)
    made = _MADE.get(df.sparkSession.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> int:
    """Delete all intermediates of this application and say how many: once its results have been written elsewhere."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        _delete(spark, path)
    return len(made)
