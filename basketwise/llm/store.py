"""Intermediate tables in the shared folder, and running values along a globally sorted table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from basketwise.functions.durable import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back.

    Lineage ends there, columns can be pruned on each read, and a lost executor costs no earlier work.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_parts(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows sorted by range over all tasks, kept, with the number of their range in ``_part``.

    ``order`` ends with a unique column, so that no range outgrows the others.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    return kept(ranged.withColumn("_part", F.spark_partition_id()), "ranges")


def _with_carry(parts: DataFrame, per_part: DataFrame) -> DataFrame:
    """Rows joined with what the ranges before theirs hand over: one small row per range."""
    return parts.join(F.broadcast(per_part), "_part", "left")


def running_sum(parts: DataFrame, order: list[str], value: str, to: str) -> DataFrame:
    """Add the running sum of ``value`` over the whole sorted table; ``parts`` comes from range_parts."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))  # as many rows as ranges
    carry = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    within = Window.partitionBy("_part").orderBy(*_keys(order)).rowsBetween(Window.unboundedPreceding, 0)
    return _with_carry(parts, carry).withColumn(to, F.sum(value).over(within) + F.col("_carry")).drop("_carry")


def numbered(df: DataFrame, group: str, order: list[str], to: str) -> DataFrame:
    """The rows, kept, with their position from 0 among the rows of their ``group``, along ``order`` (nulls first).

    Rows are sorted by range over (group, order), so a group of any size is spread over tasks; rows alike in all of
    these come in any order. ``df`` is read twice.
    """
    order = [*order, "_tie"]  # unique: no range outgrows the others
    parts = range_parts(df.withColumn("_tie", F.monotonically_increasing_id()), [group, *order])
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_rows"))
    carry = counts.select("_part", F.col(group).alias("_group"), F.sum("_rows").over(before).alias("_before"))
    carry = carry.filter(F.col("_before") > 0)  # only the first group of a range can have begun before it
    within = Window.partitionBy("_part", group).orderBy(*_keys(order))
    placed = parts.withColumn("_row", F.row_number().over(within) - 1).alias("rows").join(
        F.broadcast(carry.withColumnRenamed("_part", "_range")),
        (F.col("_part") == F.col("_range")) & F.col(group).eqNullSafe(F.col("_group")),
        "left",
    )
    place = (F.coalesce("_before", F.lit(0)) + F.col("_row")).cast("long")
    return kept(placed.select(*df.columns, place.alias(to)), "numbered")


def last_seen(parts: DataFrame, order: list[str], value: str, to: str) -> DataFrame:
    """Add the last ``value`` that isn't null up to each row of the whole sorted table."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(*order)
    ends = parts.groupBy("_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), key)).alias("_end"))
    carry = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    within = Window.partitionBy("_part").orderBy(*_keys(order)).rowsBetween(Window.unboundedPreceding, 0)
    here = F.last(value, ignorenulls=True).over(within)
    return _with_carry(parts, carry).withColumn(to, F.coalesce(here, F.col("_carry"))).drop("_carry")


def _keys(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]
