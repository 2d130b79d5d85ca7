"""Snapshots of layers: Parquet folders that are never changed, and a manifest for each state, written last.

A manifest says for each layer and bucket of documents which snapshot's folder holds it, so a new state shares all buckets
that it doesn't touch. Readers take the newest manifest; until that is there, they see the state before. One writer at a
time."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stratalake.core.storage import materialize
from stratalake.core.versions import CURRENT, upgraded

#: Bytes of a bucket, about, and bounds on their number, which is settled by the first state.
BUCKET_BYTES, BUCKETS = 1 << 30, (16, 4096)
#: A layer that lies in more folders is written anew as a whole.
MOST_FOLDERS = 16


class Store:
    """The states of the layers under a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def snapshots(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("snapshots") if n.endswith(".json"))

    def manifest(self, snapshot: int | None = None) -> dict | None:
        """The manifest of a snapshot, of the newest if none is named; None where there is none yet."""
        known = self.snapshots()
        if snapshot is None and not known:
            return None
        if snapshot is not None and snapshot not in known:
            raise ValueError(f"unknown snapshot {snapshot}")
        wanted = known[-1] if snapshot is None else snapshot
        text = self.spark.read.text(f"{self.root}/snapshots/{wanted:08}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> int:
        """The manifest is written beside and then given its name: until then the state before counts."""
        target = self._path(f"{self.root}/snapshots/{manifest['snapshot']:08}.json")
        if self._fs.exists(target):
            raise ValueError(f"snapshot {manifest['snapshot']} was written by another build")
        draft = self._path(f"{self.root}/snapshots/_{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
        out.close()
        if not self._fs.rename(draft, target):
            raise ValueError(f"snapshot {manifest['snapshot']} was written by another build")
        return manifest["snapshot"]

    def read(self, layer: str, snapshot: int | None = None) -> DataFrame | None:
        """A layer's rows, of the newest state if none is named, with the current version's columns; None if there is no such
        layer."""
        manifest = self.manifest(snapshot)
        return None if manifest is None else self._read(manifest, layer)

    def read_buckets(self, layer: str, buckets: list[str]) -> DataFrame | None:
        """The rows of some buckets of the newest state."""
        return self._read(self.manifest(), layer, buckets)

    def _read(self, manifest: dict, layer: str, only: list[str] | None = None) -> DataFrame | None:
        if not 1 <= manifest["version"] <= CURRENT:
            raise ValueError(f"unknown version {manifest['version']}")
        kept = manifest["layers"].get(layer)
        if kept is None:
            return None
        schema = StructType.fromJson(kept["schema"])
        homes: dict[str, list[int]] = {}
        for bucket, home in kept["at"].items():
            if only is None or bucket in only:
                homes.setdefault(str(home), []).append(int(bucket))
        if not homes:
            return upgraded(self.spark.createDataFrame([], schema), layer, manifest["version"])
        base = f"{self.root}/data/{layer}"
        placed = StructType([*schema.fields, StructField("snapshot", IntegerType()), StructField("bucket", IntegerType())])
        read = self.spark.read.schema(placed).option("basePath", base)
        found = read.parquet(*[f"{base}/snapshot={h}" for h in sorted(homes)])
        here = reduce(lambda a, b: a | b, [(F.col("snapshot") == int(h)) & F.col("bucket").isin(own) for h, own in homes.items()])
        return upgraded(found.where(here).drop("snapshot", "bucket"), layer, manifest["version"])

    def begin(self, size: int = 0) -> Draft:
        """A state to come; size: bytes that the first state is made for."""
        before = self.manifest()
        number = self.snapshots()[-1] + 1 if before else 1
        buckets = before["buckets"] if before else max(BUCKETS[0], min(BUCKETS[1], -(-size // BUCKET_BYTES)))
        layers = {k: {"schema": v["schema"], "at": dict(v["at"])} for k, v in before["layers"].items()} if before else {}
        return Draft(self, {"snapshot": number, "version": before["version"] if before else CURRENT, "buckets": buckets, "layers": layers, "about": dict(before["about"]) if before else {}})

    def upgrade(self) -> list[int]:
        """Writes a layer set of an older version as a new snapshot of the current one; returns the versions that were gone
        through. The old state stays and can be gone back to."""
        before = self.manifest()
        if before is None or before["version"] == CURRENT:
            return []
        old = {layer: self._read(before, layer) for layer in before["layers"]}
        draft = self.begin()
        draft.manifest["version"] = CURRENT
        for layer, rows in old.items():
            draft.replace(layer, rows)
        draft.commit()
        return list(range(before["version"] + 1, CURRENT + 1))

    def roll_back(self, snapshot: int) -> int:
        """A new state that is the same as an earlier one."""
        wanted = self.manifest(snapshot)
        return self._commit({**wanted, "snapshot": self.snapshots()[-1] + 1, "about": {**wanted["about"], "restored": snapshot}})

    def prune(self, keep: int) -> list[int]:
        """Deletes all but the last `keep` states and the folders that only those had; returns them."""
        known = self.snapshots()
        gone, kept = known[:-keep], known[-keep:]
        used = {(layer, int(home)) for n in kept for layer, v in self.manifest(n)["layers"].items() for home in v["at"].values()}
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/snapshots/{n:08}.json"), False)
        for layer in self._names("data"):
            for name in self._names(f"data/{layer}"):
                home = int(name.split("=")[1])
                if (layer, home) not in used and home <= known[-1]:
                    self._fs.delete(self._path(f"{self.root}/data/{layer}/{name}"), True)
        return gone


class Draft:
    """A state that isn't there yet: its folders are written, its manifest is not."""

    def __init__(self, store: Store, manifest: dict) -> None:
        self.store, self.manifest = store, manifest

    @staticmethod
    def bucket_of(key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def bucket(self, key: str = "doc_id") -> Column:
        return self.bucket_of(key, self.manifest["buckets"])

    def read(self, layer: str) -> DataFrame | None:
        return self.store._read(self.manifest, layer)

    def put(self, layer: str, new: DataFrame, touched: DataFrame, key: str = "doc_id") -> None:
        """Replaces the rows of the touched documents (doc_id, or what else a layer is laid out by) by new ones; only their
        buckets are written."""
        touched = materialize(touched.select(key).distinct(), "touched")
        here = [str(r[0]) for r in touched.select(self.bucket(key)).distinct().collect()]  # as many as there are buckets
        kept = self.manifest["layers"].get(layer)
        if kept and len(set(kept["at"].values())) >= MOST_FOLDERS:
            here = sorted({*here, *kept["at"]})
        old = self.store._read(self.manifest, layer, here)
        rows = new if old is None else new.unionByName(old.join(touched, key, "left_anti"), allowMissingColumns=True)
        self._write(layer, rows, here, key)

    def replace(self, layer: str, rows: DataFrame, key: str = "doc_id") -> None:
        """Replaces all rows of a layer."""
        self._write(layer, rows, None, key)

    def _write(self, layer: str, rows: DataFrame, buckets: list[str] | None, key: str = "doc_id") -> None:
        folder = f"data/{layer}/snapshot={self.manifest['snapshot']}"
        self.store._fs.delete(self.store._path(f"{self.store.root}/{folder}"), True)  # of a build that didn't end
        # A bucket has as many writers as its bytes ask for.
        rows.withColumn("bucket", self.bucket(key)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.store.root}/{folder}")
        at = self.manifest["layers"].get(layer, {"at": {}})["at"] if buckets is not None else {}
        kept = {b: home for b, home in at.items() if b not in (buckets or [])}
        own = {n.split("=")[1]: self.manifest["snapshot"] for n in self.store._names(folder) if n.startswith("bucket=")}
        self.manifest["layers"][layer] = {"schema": rows.schema.jsonValue(), "at": {**kept, **own}}

    def commit(self, **about: object) -> int:
        self.manifest["about"] = {**self.manifest["about"], **about}
        return self.store._commit(self.manifest)
