"""A stored corpus of chunks that is upserted in place of being written anew.

Chunks lie in buckets by a hash of their id. An upsert rewrites the buckets that hold an id of the batch, and the new version shares
the files of all others with the version before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from basketwise.functions.durable import durable
from basketwise.sources.versions import Versions, VersionTaken

#: Buckets of a new store; choose it so that a bucket is a few hundred megabytes when the corpus is grown up.
BUCKETS = 64
_BUCKET = "_bucket"


class ChunkStore:
    """Versions of a table with one row per ``id``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, key: str = "id"):
        """Open the store at ``path``; ``buckets`` and ``key`` count when it is first written, later its own are taken."""
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)
        self._first = {"buckets": buckets, "key": key, "schema": None, "folders": {}}

    def manifest(self, version: int | None = None) -> dict:
        number = self.versions.latest() if version is None else version
        return self.versions.read(number) if number else self._first

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Bucket and folder of all data of a version."""
        return {int(bucket): folder for bucket, folder in self.manifest(version)["folders"].items()}

    def read(self, version: int | None = None) -> DataFrame | None:
        """The chunks of a version, by default the newest; None if nothing was ever stored."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            return None
        return self._read(manifest, list(manifest["folders"].values()))

    def _read(self, manifest: dict, folders: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}" for folder in folders])

    @staticmethod
    def _bucket(manifest: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(manifest["key"]).cast("string")), F.lit(manifest["buckets"])).cast("int")

    def upsert(self, batch: DataFrame, reset: bool = False) -> int:
        """Store ``batch``, one row per key: equal keys are replaced, all others stay, also those that an earlier, longer
        version of a document left behind. ``reset`` keeps nothing. Returns the number of the new version.

        If another writer commits first, the batch is merged into what that writer left. An empty batch makes a version
        without new files.
        """
        batch = durable(batch)
        while True:
            number = self.versions.latest()
            manifest = dict(self.manifest(number))
            if manifest["schema"] is not None and not reset:
                known = T.StructType.fromJson(manifest["schema"])
                if set(known.names) != set(batch.columns):
                    raise ValueError(f"the store has the columns {known.names}, the batch {batch.columns}")
                batch = batch.select(*[F.col(field.name).cast(field.dataType) for field in known])
            else:
                manifest["schema"] = batch.schema.jsonValue()
            try:
                self.versions.commit(number + 1, self._merged(manifest, batch, reset))
                return number + 1
            except VersionTaken:
                continue

    def _merged(self, manifest: dict, batch: DataFrame, reset: bool) -> dict:
        """The manifest after the batch; writes the buckets it touches."""
        key, bucket = manifest["key"], self._bucket(manifest)
        touched = {row[0] for row in batch.select(bucket.alias(_BUCKET)).distinct().collect()}  # no more than the buckets
        folders = {} if reset else {int(b): f for b, f in manifest["folders"].items()}
        old = [folder for b, folder in folders.items() if b in touched]
        rows = batch
        if old:
            stays = self._read(manifest, old).join(batch.select(key), key, "left_anti")
            rows = stays.select(*batch.columns).unionByName(batch)
        if touched:
            target = self.versions.new_folder("data")
            rows.withColumn(_BUCKET, bucket).repartition(F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{self.path}/{target}")
            folders |= {b: f"{target}/{_BUCKET}={b}" for b in touched}
        return manifest | {"folders": folders}
