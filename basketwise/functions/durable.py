"""Cutting lineage, and broadcasting only what was measured."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side is broadcast only when its measured size stays under this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Partitions over which the rows without key of a large join are spread.
NULL_SALT = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    A folder of our own is made only where none is named and the session is local, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):  # executors are other processes
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="basketwise-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder; survives the loss of executors."""
    if getattr(df, "_kept", False):
        return df
    shared_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    kept._kept = True
    return kept


def measured_size(df: DataFrame) -> tuple[int, int]:
    """(rows, estimated bytes) of a frame, by one aggregation over its text form."""
    text = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    return rows, size + 16 * rows * len(df.columns)


def kept_table(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder: later reads prune columns and push filters."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept = True
    return kept


class Measured(NamedTuple):
    frame: DataFrame  # kept
    rows: int
    small: bool  # may be broadcast


def measured(df: DataFrame) -> Measured:
    """The frame, kept and measured."""
    kept = durable(df)
    rows, size = measured_size(kept)
    return Measured(kept, rows, size <= BROADCAST_BYTES)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """The frame, kept, and marked for broadcast if its measured size allows that."""
    kept = measured(df)
    return F.broadcast(kept.frame) if kept.small else kept.frame


def broadcast_table(df: DataFrame) -> DataFrame:
    """A table that is cheap to read twice, marked for broadcast if its measured size allows that.

    Spark decides by the size of the files and only up to 10 MB; a catalogue of some hundred thousand rows is
    larger than that, and without the mark every order line would be shuffled to meet it.
    """
    _, size = measured_size(df)
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def join_keyed(left: DataFrame, keyed: DataFrame, on: str) -> DataFrame:
    """Left-join ``keyed`` (one row per ``on``) to a table that may hold one key very often.

    A small ``keyed`` is broadcast, so ``left`` is not shuffled at all. A large one is joined by one shuffle: a hot key
    is split there by the session's skew handling, and rows without key are spread over many partitions,
    as they meet nothing.
    """
    keyed, _, small = measured(keyed)
    if small:
        return left.join(F.broadcast(keyed), on, "left")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(NULL_SALT)).cast("string")
    met = F.when(F.col(on).isNull(), F.concat(F.lit("n"), salt)).otherwise(F.concat(F.lit("k"), F.col(on).cast("string")))
    right = keyed.select(F.concat(F.lit("k"), F.col(on).cast("string")).alias("_met"), *[c for c in keyed.columns if c != on])
    return left.withColumn("_met", met).join(right, "_met", "left").drop("_met")
