"""Exact ranks and quantiles over whole tables, without one task that holds the table.

The rows are sorted by range and kept; only the few keys found at the wanted ranks come back to the driver. Values
of several columns are stacked, so they share one sort. Nulls have no rank.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F

from basketwise.functions.durable import kept_table

LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row number within it below


def keys_at_ranks(df: DataFrame, order: list[str], ranks: list[int]) -> dict[int, Row]:
    """The ``order`` values found at the given 1-based ranks of the ascending sort by ``order``.

    ``order`` should end with a unique column: then no range is larger than the others, even where
    a third of the rows have one and the same leading value.
    """
    ranged = (
        df.select(*order)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    ranged = kept_table(ranged, "ranged")
    part = F.shiftrightunsigned("_place", LOCAL_BITS).alias("part")
    sizes = ranged.groupBy(part).count().orderBy("part").collect()  # one row per partition
    place_of = {}
    for rank in ranks:
        before = 0
        for size in sizes:
            if rank <= before + size["count"]:
                place_of[rank] = (size["part"] << LOCAL_BITS) + rank - before - 1
                break
            before += size["count"]
    found = {
        row["_place"]: row
        for row in ranged.filter(F.col("_place").isin(list(place_of.values()))).collect()
    }
    return {rank: found[place] for rank, place in place_of.items()}


def _values(df: DataFrame, columns: list[str], unique: str) -> DataFrame:
    """(_name, _value, _unique): the given values of each column, stacked."""
    parts = [
        df.select(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_value"), F.col(unique).alias("_unique"))
        for c in columns
    ]
    return reduce(DataFrame.unionByName, parts).filter(F.col("_value").isNotNull())


def quantile(df: DataFrame, value: str, unique: str, p: float) -> float | None:
    """The exact quantile of the values given, with linear interpolation; null if there are none. ``df`` is read twice."""
    n = df.filter(F.col(value).isNotNull()).count()
    if n == 0:
        return None
    position = p * (n - 1)
    low, high = math.floor(position) + 1, math.ceil(position) + 1
    keys = keys_at_ranks(_values(df, [value], unique), ["_name", "_value", "_unique"], sorted({low, high}))
    a, b = keys[low]["_value"], keys[high]["_value"]
    return a if a == b else (low - position) * a + (position - low + 1) * b


def quartile_scores(df: DataFrame, scores: dict[str, tuple[str, bool]], unique: str) -> DataFrame:
    """Add 1..4 scores: {new column: (value column, higher is better)}; ``df`` is read several times.

    Rows are ranked by value, ties by ``unique``; the rank r of n falls into bucket
    max(1, ceil(4(r-1)/(n-1))), and the bucket is turned round where lower is better. A value column
    with fewer than two distinct values scores 2 throughout; a null value has no score.
    """
    values = sorted({value for value, _ in scores.values()})
    bounds = df.agg(
        *[F.count(v).alias(f"n_{v}") for v in values],
        *[(F.min(v).eqNullSafe(F.max(v))).alias(v) for v in values],
    ).first()
    ranked = [v for v in values if not bounds[v]]
    wanted, before = {}, 0
    for v in ranked:  # the stacked sort holds one column after the other
        n = bounds[f"n_{v}"]
        wanted[v] = [before + k * (n - 1) // 4 + 1 for k in (1, 2, 3)]
        before += n
    ranks = sorted({rank for three in wanted.values() for rank in three})
    order = ["_name", "_value", "_unique"]
    keys = keys_at_ranks(_values(df, ranked, unique), order, ranks) if ranked else {}
    columns = {}
    for name, (value, higher) in scores.items():
        if value not in wanted:
            columns[name] = F.lit(2)
        else:
            bucket = _bucket_by_cuts(df, value, unique, [keys[rank] for rank in wanted[value]])
            columns[name] = bucket if higher else (F.lit(5) - bucket).cast("int")
    return df.withColumns(columns)


def _bucket_by_cuts(df: DataFrame, value: str, unique: str, cuts: list[Row]) -> Column:
    """The bucket, told by comparing with the rows at the last rank of buckets 1, 2 and 3."""
    bucket = F.when(F.col(value).isNotNull(), F.lit(4))
    for k in (3, 2, 1):
        cut_value = F.lit(cuts[k - 1]["_value"])
        cut_id = F.lit(cuts[k - 1]["_unique"]).cast(df.schema[unique].dataType)
        upto = (F.col(value) < cut_value) | ((F.col(value) == cut_value) & (F.col(unique) <= cut_id))
        bucket = F.when(upto, F.lit(k)).otherwise(bucket)
    return bucket
