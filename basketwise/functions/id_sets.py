"""Exact sets of ids that can be merged: counts of distinct ids over weeks, months or groups from the sets of their days.

Ids are numbered without gap once. A set is then bits in buckets of 32,768 numbers, built by ``bitmap_construct_agg`` and merged by
``bitmap_or_agg``; a distinct count is a sum of bit counts. Unlike ``count(DISTINCT ...)`` nothing is expanded or counted
again over the lines, and unlike a sketch the count is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketwise.functions.durable import kept_table

NUMBER, BUCKET, MEMBERS = "_number", "_bucket", "_members"


def number_ids(df: DataFrame, id_col: str, order: list[str] | None = None) -> DataFrame:
    """(id, _number): every distinct id that isn't null, numbered from 0 without gap.

    Numbers ascend by the least values of ``order``, then by id: with the first day an id was seen on, the ids of a day share few
    buckets. Ids are sorted by range over all tasks.
    """
    others = [c for c in order or [] if c != id_col]
    given = df.select(id_col, *others).filter(F.col(id_col).isNotNull())
    distinct = given.groupBy(id_col).agg(*[F.min(c).alias(c) for c in others]) if others else given.distinct()
    keys = [*others, id_col]  # unique, so that no range outgrows the others
    ranged = kept_table(distinct.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))  # one row per range
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return ranged.withColumn("_row", row).join(starts, "_part").select(id_col, (F.col("_before") + F.col("_row")).alias(NUMBER))


def id_sets(df: DataFrame, keys: list[str], number: str = NUMBER) -> DataFrame:
    """(keys, _bucket, _members): the set of numbers of each group; rows without number count for no set."""
    given = df.filter(F.col(number).isNotNull())
    return given.groupBy(*keys, F.bitmap_bucket_number(number).alias(BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias(MEMBERS)
    )


def is_member(number: str = NUMBER) -> Column:
    """Is the number in the set joined to its row by bucket? False without a set."""
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(MEMBERS, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def merge_sets(sets: DataFrame, keys: list[str | Column]) -> DataFrame:
    """The sets of coarser groups: ``keys`` are columns of ``sets``, or made of them."""
    return sets.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(MEMBERS).alias(MEMBERS))


def count_members(sets: DataFrame, keys: list[str], to: str) -> DataFrame:
    """(keys, to): the number of ids in each group's set."""
    return sets.groupBy(*keys).agg(F.sum(F.bitmap_count(MEMBERS)).alias(to))
