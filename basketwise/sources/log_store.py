"""The action log as a log-structured store: records and changes are appended, and folded together by compaction.

An update never rewrites a record. It is stored as a change that names the record by its place, so writing it costs what the update
holds and not what the log holds. Readers merge the changes into their records, the later ones on top. Compaction writes
the merged log as one new base, and the switch to it is one manifest: a crash before leaves the log as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketwise.functions.durable import durable
from basketwise.functions.expressions import to_time
from basketwise.sources.action_log import LOG_FIELDS, OTHER_FIELDS, as_fields, utc_now
from basketwise.sources.versions import Versions, VersionTaken

#: The place of a record: the version that appended it, and its line there. Later places come later in the log.
PLACE = "_place"
_PLACE = f"{PLACE} struct<version: long, line: long>"
_FIELDS = ", ".join(f"`{name}` {kind}" for name, kind in LOG_FIELDS.items()) + f", {OTHER_FIELDS} map<string, string>"
_RECORDS = f"{_FIELDS}, {_PLACE}"
_CHANGES = f"{_FIELDS}, {_PLACE}, _version long"


class ActionLog:
    """The log stored at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)

    def manifest(self, version: int | None = None) -> dict:
        number = self.versions.latest() if version is None else version
        return self.versions.read(number) if number else {"records": [], "changes": []}

    def _folders(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}" for folder in folders])

    def _commit(self, kind: str, rows: Callable[[int], DataFrame]) -> int:
        """Write the rows that ``rows`` makes for the next version and add them to ``kind``; anew if another writer came first."""
        while True:
            number = self.versions.latest()
            manifest, folder = self.manifest(number), self.versions.new_folder(kind)
            rows(number + 1).write.parquet(f"{self.path}/{folder}")
            try:
                self.versions.commit(number + 1, manifest | {kind: [*manifest[kind], folder]})
                return number + 1
            except VersionTaken:
                continue

    def append(self, records: DataFrame) -> int:
        """Append records, stamped with the time where they have none. Columns without a field go to ``other_fields``.

        Returns the new version. The rows' order is that of their partitions.
        """
        given = F.col("timestamp") if "timestamp" in records.columns else F.lit(None)
        stamped = as_fields(records.withColumn("timestamp", F.coalesce(given.cast("string"), utc_now())))

        def placed(number: int) -> DataFrame:
            place = F.struct(F.lit(number).cast("long").alias("version"), F.monotonically_increasing_id().alias("line"))
            return stamped.withColumn(PLACE, place)

        return self._commit("records", placed)

    def update(self, updates: DataFrame) -> int:
        """Change the most recent record of each reference_id that ``updates`` names, one row per id: fields that aren't null replace
        the record's, and status_checked_at is stamped where it is missing. Ids the log doesn't know change nothing.

        Only the change is written. Returns the new version.
        """
        checked = F.col("status_checked_at") if "status_checked_at" in updates.columns else F.lit(None)
        fields = durable(as_fields(updates.withColumn("status_checked_at", F.coalesce(checked.cast("string"), utc_now()))))

        def changes(number: int) -> DataFrame:
            log = self.read(number - 1)
            # summed per id before it meets the updates, so that an id with very many records stays spread
            newest = log.groupBy("reference_id").agg(F.max(F.struct(to_time(log, "timestamp"), PLACE)).alias("_newest"))
            return newest.select("reference_id", f"_newest.{PLACE}").join(fields, "reference_id").withColumn("_version", F.lit(number).cast("long"))

        return self._commit("changes", changes)

    def read(self, version: int | None = None) -> DataFrame:
        """All records of a version, by default the newest, with every change made to them, and their place in the log."""
        manifest = self.manifest(version)
        records = self._folders(manifest["records"], _RECORDS)
        if not manifest["changes"]:
            return records
        changes = self._folders(manifest["changes"], _CHANGES)

        def last(name: str) -> Column:
            return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("_version"))).alias(f"_new_{name}")

        entries = F.struct("_version", F.map_entries(OTHER_FIELDS).alias("entries"))  # maps have no order
        others = F.array_sort(F.collect_list(F.when(F.col(OTHER_FIELDS).isNotNull(), entries)))
        fields = [name for name in LOG_FIELDS if name != "reference_id"]
        # one change per update at most, so the list of a record is as long as there were updates since the last compaction
        merged = changes.groupBy(PLACE).agg(*[last(name) for name in fields], others.alias("_others"))

        def put(fields_of: Column, change: Column) -> Column:
            newer = F.map_from_entries(change["entries"])
            return F.map_concat(F.map_filter(fields_of, lambda name, _: ~F.map_contains_key(newer, name)), newer)

        empty = F.create_map().cast("map<string, string>")
        with_others = F.aggregate(F.coalesce("_others", F.array()), F.coalesce(F.col(OTHER_FIELDS), empty), put)
        return records.join(merged, PLACE, "left").select(
            "reference_id",
            *[F.coalesce(f"_new_{name}", name).alias(name) for name in fields],
            F.when(F.size(with_others) > 0, with_others).alias(OTHER_FIELDS),
            PLACE,
        ).select(*LOG_FIELDS, OTHER_FIELDS, PLACE)

    def compact(self) -> int:
        """Fold all changes into the records and write them as one base; places stay. Returns the new version.

        Older versions can still be read. If another writer commits meanwhile, its version is compacted.
        """
        while True:
            number = self.versions.latest()
            base = self.versions.new_folder("records")
            self.read(number).write.parquet(f"{self.path}/{base}")
            try:
                self.versions.commit(number + 1, {"records": [base], "changes": []})
                return number + 1
            except VersionTaken:
                continue
