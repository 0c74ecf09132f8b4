"""Questions to the action log: latest status, status updates, display, newest open action.

A log has reference_id, timestamp and a unique position; "latest" is the latest moment, then the last position. The
latest record of an id is found by aggregation, so an id with very many records costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basketwise.functions.durable import join_keyed
from basketwise.functions.expressions import to_time
from basketwise.sources.action_log import utc_now
from basketwise.sources.tables import ROW_SEQ

# The columns shown of a log, in order.
VIEW_COLUMNS = (
    "timestamp",
    "recommendation",
    "reason",
    "merchant_approved",
    "amount_inr",
    "payment_link_id",
    "result",
    "status_checked_at",
)


def _time(log: DataFrame) -> Column:
    """The moment a timestamp names, whatever its offset or precision; null if it names none."""
    return to_time(log, "timestamp")


def _newest(log: DataFrame, position: str) -> Column:
    return F.struct(_time(log), position)


def latest_status(log: DataFrame, position: str = ROW_SEQ) -> DataFrame:
    """(reference_id, timestamp, result) of the most recent record of every id."""
    return (
        log.filter(F.col("reference_id").isNotNull())
        .groupBy("reference_id")
        .agg(F.max_by(F.struct("timestamp", "result"), _newest(log, position)).alias("last"))
        .select("reference_id", "last.timestamp", "last.result")
    )


def apply_status_updates(log: DataFrame, updates: DataFrame, position: str = ROW_SEQ) -> DataFrame:
    """The log with the most recent record of every updated id changed and stamped.

    ``updates`` has one row per reference_id and any fields; a null leaves the field as it is, and a field the log
    lacks is added. Ids the log does not know change nothing; see unmatched_updates. The latest moment is the most recent
    record, and of equal or unreadable ones the last in the log.
    """
    fields = [c for c in updates.columns if c not in ("reference_id", "status_checked_at")]
    renamed = updates.select(
        "reference_id",
        *[F.col(c).alias(f"_new_{c}") for c in fields],
        (F.col("status_checked_at") if "status_checked_at" in updates.columns else utc_now()).alias("_checked"),
    )
    # aggregated before it meets the updates, so that an id with very many records stays spread
    newest = log.groupBy("reference_id").agg(F.max(_newest(log, position)).alias("_newest"))
    changes = newest.join(renamed, "reference_id")
    joined = join_keyed(log, changes, "reference_id")
    hit = F.coalesce(_newest(log, position).eqNullSafe(F.col("_newest")) & F.col("_newest").isNotNull(), F.lit(False))

    def old(name: str) -> Column:
        return F.col(name) if name in log.columns else F.lit(None)

    merged = {c: F.when(hit, F.coalesce(F.col(f"_new_{c}"), old(c))).otherwise(old(c)) for c in fields}
    merged["status_checked_at"] = F.when(hit, F.col("_checked")).otherwise(old("status_checked_at"))
    columns = [*log.columns, *[c for c in merged if c not in log.columns]]
    return joined.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in columns])


def unmatched_updates(log: DataFrame, updates: DataFrame) -> DataFrame:
    return updates.join(log.select("reference_id").distinct(), "reference_id", "left_anti")


def log_view(log: DataFrame) -> DataFrame:
    """The display columns that the log has."""
    return log.select(*[c for c in VIEW_COLUMNS if c in log.columns])


def latest_open_action(log: DataFrame, position: str = ROW_SEQ) -> DataFrame:
    """The newest record that has both a payment link and a reference; no row if there is none."""
    both = (F.coalesce("payment_link_id", F.lit("")) != "") & (
        F.coalesce(F.col("reference_id").cast("string"), F.lit("")) != ""
    )
    return log.filter(both).orderBy(_time(log).desc_nulls_last(), F.desc(position)).limit(1)
