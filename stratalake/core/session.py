"""Session defaults for local runs, tests and the benchmark."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "stratalake") -> SparkSession:
    """A local session with adaptive execution, UTC and a partition count near the core count."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """A scan of at most four partitions, dealt out to all cores where over half of them would idle; else df as it is.

    A partition of a scan is some spark.sql.files.maxPartitionBytes (or one row group), so no large input is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= min(cores, 8) else df


def few_at_once(spark: SparkSession, need: int) -> ResourceProfile | None:
    """Cores that each task of a stage asks for so that an executor's heap has room for those that it runs at a time, with
    `need` bytes each; None where all cores fit, and where the cores of an executor aren't told or can't be asked for (local
    masters, dynamic allocation)."""
    context = spark.sparkContext
    conf = context.getConf()
    cluster = re.match(r"local-cluster\s*\[[^,]*,\s*(\d+)", context.master)
    if context.master.startswith("local") and not cluster or conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return None
    cores = int(conf.get("spark.executor.cores", cluster[1] if cluster else "1"))
    heap = context._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.executor.memory", "1g"))
    fit = max(1, heap // max(1, need))
    return None if fit >= cores else ResourceProfileBuilder().require(TaskResourceRequests().cpus(-(-cores // fit))).build


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that they find it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="stratalake-code-")) / f"{home.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, f"{home.name}/{path.relative_to(home)}")
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
