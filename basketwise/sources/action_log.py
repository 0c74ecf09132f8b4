"""The append-only action log as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from basketwise.functions.expressions import let, parse_json
from basketwise.sources.tables import ROW_SEQ

# The fields of a record and their types. Every field may be absent.
LOG_FIELDS = {
    "reference_id": "string",
    "recommendation": "string",
    "source_section": "string",
    "reason": "string",
    "merchant_approved": "boolean",
    "amount_inr": "int",
    "payment_link_id": "string",
    "payment_link_url": "string",
    "result": "string",
    "timestamp": "string",
    "status_checked_at": "string",
}


def utc_now() -> Column:
    """Now, as ISO-8601 text in UTC."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


#: The fields of a record that have no column of their own, or a value their column can't hold, as JSON by name.
OTHER_FIELDS = "other_fields"


def as_fields(records: DataFrame) -> DataFrame:
    """Records in the columns of a log: a field they lack is null, and further columns go to ``other_fields`` as JSON.

    An entry of ``other_fields`` gives way to a column of its name."""
    own = [c for c in records.columns if c not in LOG_FIELDS and c not in (OTHER_FIELDS, ROW_SEQ)]
    given = F.col(OTHER_FIELDS) if OTHER_FIELDS in records.columns else F.lit(None).cast("map<string, string>")
    others = F.coalesce(given, F.create_map().cast("map<string, string>"))
    if own:
        values = F.try_variant_get(F.parse_json(F.to_json(F.struct(*own))), "$", "map<string, variant>")
        named = F.transform_values(values, lambda _, value: F.to_json(value))
        others = F.map_concat(F.map_filter(others, lambda name, _: ~F.map_contains_key(named, name)), named)
    fields = [
        (F.col(name) if name in records.columns else F.lit(None)).cast(kind).alias(name) for name, kind in LOG_FIELDS.items()
    ]
    return records.select(*fields, F.when(F.size(others) > 0, others).alias(OTHER_FIELDS))


def append_log(records: DataFrame, path: str) -> None:
    """Append records, stamped with the time where they have none. Null fields are not written.

    Every column is a field of the record; those in ``other_fields`` are written beside them.
    """
    given = F.col("timestamp") if "timestamp" in records.columns else F.lit(None).cast("string")
    stamped = records.withColumn("timestamp", F.coalesce(given, utc_now())).drop(ROW_SEQ)
    line = F.to_json(F.struct(*[c for c in stamped.columns if c != OTHER_FIELDS]))
    if OTHER_FIELDS in stamped.columns:
        values = F.transform_values(OTHER_FIELDS, lambda _, v: F.try_parse_json(v))
        others = F.to_json(values)
        some = F.coalesce(F.size(OTHER_FIELDS), F.lit(0)) > 0
        # the timestamp is always there, so neither part is empty
        line = F.when(some, F.concat(F.substring(line, F.lit(1), F.length(line) - 1), F.lit(","), F.substring(others, 2, 1 << 30))).otherwise(line)
    stamped.select(line.alias("value")).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All records with their position in the log; blank and corrupt lines are skipped, and a log that
    does not exist is empty. Sort by time and position for oldest first.

    No field is lost: those without a column, and values their column can't hold, are in ``other_fields``."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        columns = ", ".join(f"`{name}` {kind}" for name, kind in LOG_FIELDS.items())
        return spark.createDataFrame(
            [], f"{columns}, {OTHER_FIELDS} map<string, string>, {ROW_SEQ} struct<file: string, block: bigint, row: bigint>"
        )
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    # a generator is evaluated once per row, where a projection would be repeated in every expression that reads it
    parsed = lines.select(F.array(parse_json(F.col("value"))).alias("parsed"), place.alias(ROW_SEQ))
    records = parsed.select(F.explode("parsed").alias("record"), ROW_SEQ).filter(F.col("record").isNotNull())
    fields = {name: F.try_variant_get("record", f"$.{name}", kind) for name, kind in LOG_FIELDS.items()}
    readable = F.array_compact(F.array(*[F.when(value.isNotNull(), F.lit(name)) for name, value in fields.items()]))
    entries = F.try_variant_get("record", "$", "map<string, variant>")

    def left_over(taken: Column) -> Column:
        return F.map_filter(entries, lambda name, value: ~F.is_variant_null(value) & ~F.array_contains(taken, name))

    given = let(readable, left_over)  # the names are told once, not for each entry
    others = F.transform_values(given, lambda _, value: F.to_json(value))
    return records.select(
        *[value.alias(name) for name, value in fields.items()],
        let(others, lambda found: F.when(F.size(found) > 0, found)).alias(OTHER_FIELDS),
        ROW_SEQ,
    )
