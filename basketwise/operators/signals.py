"""Rule-based growth signals, each with the numbers it rests on and a sentence about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketwise.functions.expressions import as_double, money, round2
from basketwise.operators.customers import churn_risk_customers, rfm_segmentation
from basketwise.operators.facts import filter_completed
from basketwise.operators.products import high_margin_low_volume, product_performance
from basketwise.operators.sales import revenue_by_channel

# The sentences of the four signals.
SPIKE_TEXT = (
    "%s revenue in %s was %sx its average monthly revenue — a seasonal spike worth planning "
    "inventory/marketing around."
)
CHANNEL_TEXT = (
    "%s customers have an AOV of %s vs the overall %s (%s%% higher) — a candidate channel to scale spend on."
)
MARGIN_TEXT = (
    "%s carries a %s%% margin but sold only %s unit(s) — a strong candidate for a marketing push "
    "or bundling rather than a price cut."
)
CHURN_TEXT = (
    "Customer %s generated %s in revenue across %s order(s) but hasn't ordered in %s days — "
    "a retention/win-back candidate."
)


def _fixed(value: Column, places: int) -> Column:
    """A number with so many decimals, as text."""
    return F.round(value.cast("decimal(32,6)"), places).cast(f"decimal(32,{places})").cast("string")


def seasonal_category_spikes(facts: DataFrame, spike_ratio_threshold: float = 1.4) -> DataFrame:
    """Categories whose best month reaches so many times the mean of their months present."""
    monthly = (
        filter_completed(facts)
        .filter(F.col("category").isNotNull())
        .groupBy("category", "year_month")
        .agg(F.sum(money(facts, "revenue")).alias("amount"))
    )
    # one row per category and month from here on; the earliest of equal months is the peak
    per_category = monthly.groupBy("category").agg(
        F.count(F.lit(1)).alias("months"),
        F.sum("amount").alias("total"),
        F.max("amount").alias("peak"),
        F.min_by("year_month", F.struct(-F.col("amount"), F.col("year_month"))).alias("peak_month"),
    )
    mean = as_double(F.col("total")) / F.col("months")
    peak = as_double(F.col("peak"))
    ratio = F.when(mean > 0, F.try_divide(peak, mean)).otherwise(F.lit(0.0))
    return (
        per_category.filter((F.col("months") >= 2) & (ratio >= spike_ratio_threshold))
        .select(
            F.lit("seasonal_category_spike").alias("signal_type"),
            "category",
            "peak_month",
            round2(peak).alias("peak_month_revenue"),
            round2(mean).alias("category_avg_monthly_revenue"),
            round2(ratio).alias("spike_ratio"),
            F.format_string(SPIKE_TEXT, "category", "peak_month", _fixed(ratio, 1)).alias("description"),
        )
        .orderBy(F.desc("spike_ratio"), "category")
    )


def high_aov_channels(facts: DataFrame, customers: DataFrame, lift_threshold_pct: float = 10.0) -> DataFrame:
    """Channels whose average order value exceeds the overall one by at least so many percent."""
    everything = Window.partitionBy()  # one row per channel
    channels = revenue_by_channel(facts, customers).withColumn(
        "overall",
        F.try_divide(
            as_double(F.sum(F.col("revenue").cast("decimal(28,2)")).over(everything)),
            F.sum("orders").over(everything),
        ),
    )
    lift = F.try_divide(F.col("aov") - F.col("overall"), F.col("overall")) * 100
    return (
        channels.filter((F.col("overall") > 0) & (lift >= lift_threshold_pct))
        .select(
            F.lit("high_aov_channel").alias("signal_type"),
            F.col("acquisition_channel").alias("channel"),
            F.col("aov").alias("channel_aov"),
            round2(F.col("overall")).alias("overall_aov"),
            round2(lift).alias("lift_pct"),
            "customers",
            F.format_string(
                CHANNEL_TEXT,
                F.coalesce("acquisition_channel", F.lit("nan")),
                _fixed(F.col("aov"), 0),
                _fixed(F.col("overall"), 0),
                _fixed(lift, 0),
            ).alias("description"),
        )
        .orderBy(F.desc("lift_pct"), "channel")
    )


def high_margin_low_volume_signals(
    table: DataFrame,
    margin_threshold_pct: float = 50.0,
    volume_percentile: float = 0.25,
    top_n: int = 10,
) -> DataFrame:
    """The first rows of high_margin_low_volume as signals."""
    products = high_margin_low_volume(
        table, margin_threshold_pct, volume_percentile
    ).limit(top_n)
    return products.select(
        F.lit("high_margin_low_volume_product").alias("signal_type"),
        "product_id",
        "product_name",
        "category",
        "margin_pct",
        "units_sold",
        "revenue",
        F.format_string(
            MARGIN_TEXT, "product_name", _fixed(F.col("margin_pct"), 0), F.col("units_sold").cast("string")
        ).alias("description"),
    )


def churn_risk_signals(rfm: DataFrame, recency_days_threshold: int = 60, top_n: int = 15) -> DataFrame:
    """The first rows of churn_risk_customers as signals."""
    return (
        churn_risk_customers(rfm, recency_days_threshold)
        .limit(top_n)
        .select(
            F.lit("churn_risk_high_value_customer").alias("signal_type"),
            "customer_id",
            "recency_days",
            "frequency",
            "monetary",
            "segment",
            F.format_string(
                CHURN_TEXT,
                F.col("customer_id").cast("string"),
                _fixed(F.col("monetary"), 0),
                F.col("frequency").cast("string"),
                F.col("recency_days").cast("string"),
            ).alias("description"),
        )
    )


def growth_signals(facts: DataFrame, products: DataFrame, customers: DataFrame) -> dict[str, DataFrame]:
    """All four detectors by name."""
    return signals_from(
        facts, customers, product_performance(facts, products), rfm_segmentation(facts)
    )


def signals_from(
    facts: DataFrame,
    customers: DataFrame,
    product_table: DataFrame,
    rfm: DataFrame,
    category_months: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The same from tables already at hand; ``category_months`` is a product roll-up with categories."""
    return {
        "seasonal_category_spikes": seasonal_category_spikes(
            facts if category_months is None else category_months
        ),
        "high_aov_channels": high_aov_channels(facts, customers),
        "high_margin_low_volume_products": high_margin_low_volume_signals(product_table),
        "churn_risk_customers": churn_risk_signals(rfm),
    }


def union_signals(signals: dict[str, DataFrame]) -> DataFrame:
    """One table of all signals; fields a detector does not have are null."""
    tagged = [df.withColumn("detector", F.lit(name)) for name, df in signals.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def signal_counts(signals: dict[str, DataFrame]) -> DataFrame:
    """Signals per detector; detectors that found nothing count 0."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("signals")).select(F.lit(name).alias("detector"), "signals")
        for name, df in signals.items()
    ]
    return reduce(DataFrame.unionByName, counts)
