"""Customer performance, RFM segments, high-value and churn-risk customers.

``facts`` may be order facts, order lines or an order roll-up.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from basketwise.functions.durable import durable
from basketwise.functions.expressions import DAY_MICROS, as_double, micros, money, round2
from basketwise.functions.ranking import quantile, quartile_scores
from basketwise.operators.facts import filter_completed


def _per_customer(facts: DataFrame) -> DataFrame:
    """The one aggregation per customer; its first exchange is by customer and order, so hot customers spread."""
    return (
        filter_completed(facts)
        .filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.sum(money(facts, "revenue")).alias("amount"),
            F.count_distinct("order_id").alias("orders"),
            as_double(F.sum(money(facts, "quantity"))).alias("units_sold"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
        )
    )


def customer_performance(facts: DataFrame) -> DataFrame:
    """One row per customer with a completed order."""
    return _per_customer(facts).select(
        "customer_id",
        as_double(F.round("amount", 2)).alias("revenue"),
        "orders",
        "units_sold",
        round2(F.try_divide(as_double(F.col("amount")), F.col("orders"))).alias("aov"),
        "first_order_date",
        "last_order_date",
    )


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    """Segment of three 1..4 scores; the first rule that holds decides."""
    valued = (f >= 3) & (m >= 3)
    return (
        F.when((r >= 3) & valued, "Champions")
        .when(valued, "At Risk")
        .when((r >= 3) & (f <= 2), "New Customers")
        .when((r <= 2) & (f <= 2) & (m <= 2), "Hibernating / Lost")
        .otherwise("Others")
    )


def rfm_segmentation(
    facts: DataFrame,
    reference_date: datetime.datetime | None = None,
) -> DataFrame:
    """Recency, frequency, monetary value, their quartile scores and the segment of every customer.

    Recency counts whole days to ``reference_date``, by default the last completed order. The
    per-customer table is computed once and kept, since the scores read it several times.
    """
    base = durable(
        _per_customer(facts).select(
            "customer_id",
            micros(F.col("last_order_date")).alias("last_order"),
            F.col("orders").alias("frequency"),
            as_double(F.round("amount", 2)).alias("monetary"),
        )
    )
    if reference_date is None:
        until = base.agg(F.max("last_order").cast("long")).scalar()
    else:
        until = micros(F.lit(reference_date))
    base = base.select(
        "customer_id",
        F.floor((until - F.col("last_order")) / F.lit(DAY_MICROS)).cast("long").alias("recency_days"),
        "frequency",
        "monetary",
    )
    scored = quartile_scores(
        base,
        {
            "r_score": ("recency_days", False),
            "f_score": ("frequency", True),
            "m_score": ("monetary", True),
        },
        "customer_id",
    )
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.select("*", (r + f + m).alias("rfm_score"), rfm_segment(r, f, m).alias("segment"))


def high_value_customers(rfm: DataFrame, top_pct: float = 0.15) -> DataFrame:
    """Customers whose monetary value reaches the (1 - top_pct) quantile; highest first."""
    rfm = durable(rfm)
    cutoff = quantile(rfm, "monetary", "customer_id", 1 - top_pct)
    return rfm.filter(F.col("monetary") >= F.lit(cutoff).cast("double")).orderBy(
        F.desc("monetary"), "customer_id"
    )


def churn_risk_customers(rfm: DataFrame, recency_days_threshold: int = 60) -> DataFrame:
    """Customers with a frequency or monetary score of 3 or more who have not ordered lately."""
    return rfm.filter(
        (F.col("recency_days") > recency_days_threshold) & ((F.col("f_score") >= 3) | (F.col("m_score") >= 3))
    ).orderBy(F.desc("monetary"), "customer_id")


def segment_counts(rfm: DataFrame) -> DataFrame:
    return (
        rfm.groupBy("segment")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy(F.desc("customers"), "segment")
    )
