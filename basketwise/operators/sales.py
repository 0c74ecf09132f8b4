"""Headline numbers and revenue by period, category and channel.

``facts`` may be order facts, order lines or an order roll-up; product attributes are needed
by revenue_by_category only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketwise.functions import id_sets
from basketwise.functions.durable import broadcast_table, kept_table
from basketwise.functions.expressions import DAY_MICROS, as_double, micros, money, round2, whole_days
from basketwise.operators.facts import COMPLETED, filter_completed, order_rollup


def executive_kpis(facts: DataFrame, customers: DataFrame | None) -> DataFrame:
    """One row: revenue, orders, units, average order value, customers, growth, cancelled and returned lines.

    Lines are summed per order first, and the roll-up is kept: all numbers, the growth among them, come from it.
    """
    if "line_count" not in facts.columns:
        facts = kept_table(order_rollup(facts), "by-order")
    done = F.col("order_status") == COMPLETED
    lines = F.col("line_count")
    totals = facts.agg(
        F.sum(F.when(done, money(facts, "revenue"))).alias("revenue"),
        F.count_distinct(F.when(done, F.col("order_id"))).alias("orders"),
        as_double(F.sum(F.when(done, money(facts, "quantity")))).alias("units"),
        F.count_distinct(F.when(done, F.col("customer_id"))).alias("active"),
        F.sum(F.when(F.col("order_status") == "Cancelled", lines).otherwise(0)).alias("cancelled"),
        F.sum(F.when(F.col("order_status") == "Returned", lines).otherwise(0)).alias("returned"),
    )
    registered = F.lit(0).cast("long")
    if customers is not None:
        registered = customers.agg(F.count_distinct("customer_id")).scalar()
    revenue = F.coalesce(as_double(F.col("revenue")), F.lit(0.0))
    return totals.select(
        round2(revenue).alias("total_revenue"),
        F.col("orders").alias("total_orders"),
        F.coalesce(F.col("units"), F.lit(0.0)).cast("long").alias("total_units_sold"),
        round2(F.coalesce(F.try_divide(revenue, F.col("orders")), F.lit(0.0))).alias("average_order_value"),
        F.col("active").alias("active_customers"),
        registered.alias("total_registered_customers"),
        round2(revenue_growth_30d(facts).scalar()).alias("revenue_growth_pct_30d"),
        F.coalesce(F.col("cancelled"), F.lit(0).cast("long")).alias("cancelled_orders"),
        F.coalesce(F.col("returned"), F.lit(0).cast("long")).alias("returned_orders"),
    )


def revenue_growth_30d(facts: DataFrame) -> DataFrame:
    """One row: percent change of the last 30 days against the 30 before, seen from the last completed order.

    Null with fewer than 60 whole days of history or without prior revenue. The two bounds are
    computed at once, the sums when the result is asked for.
    """
    completed = filter_completed(facts)
    day = F.col("order_date")
    bounds = completed.agg(
        F.max(micros(day)).alias("latest"), whole_days(F.min(day), F.max(day)).alias("span")
    ).first()
    if bounds["span"] is None or bounds["span"] < 60:
        return facts.sparkSession.range(1).select(F.lit(None).cast("double").alias("growth_pct"))
    # the date as a literal reaches the scan, which then skips older data
    start = F.timestamp_micros(F.lit(bounds["latest"] - 60 * DAY_MICROS)).cast(facts.schema["order_date"].dataType)
    age = F.lit(bounds["latest"]) - micros(day)
    amount = money(facts, "revenue")
    sums = completed.filter(day > start).agg(
        F.sum(F.when(age < 30 * DAY_MICROS, amount)).alias("last"),
        F.sum(F.when(age >= 30 * DAY_MICROS, amount)).alias("prior"),
    )
    last = F.coalesce(as_double(F.col("last")), F.lit(0.0))
    prior = as_double(F.col("prior"))
    growth = F.try_divide(last - prior, prior) * 100
    return sums.select(F.when(prior > 0, growth).alias("growth_pct"))


#: What day_sets counts, and the column of its distinct counts.
_SETS = {"order_id": "orders", "customer_id": "customers"}


def day_sets(facts: DataFrame) -> DataFrame:
    """(counted, day, _bucket, _members): the exact sets of order and customer ids of every day.

    Each day's set is made from that day alone; coarser periods are merged from them, see distinct_by_period. Ids are numbered by
    the first day they occur on, so that a day's ids share few buckets.
    """
    dated = facts.withColumn("day", F.col("order_date").cast("date"))
    parts = []
    for column, counted in _SETS.items():
        seen = kept_table(dated.filter(F.col(column).isNotNull()).groupBy(column, "day").agg(F.count(F.lit(1)).alias("_rows")), "seen")
        numbers = id_sets.number_ids(seen, column, ["day", column])
        sets = id_sets.id_sets(seen.join(numbers, column), ["day"])
        parts.append(sets.select(F.lit(counted).alias("counted"), "*"))
    return kept_table(reduce(DataFrame.unionByName, parts), "day-sets")


def distinct_by_period(sets: DataFrame, period: Column) -> DataFrame:
    """(period, orders, customers): distinct ids by any period that is made of whole days; ``period`` is an expression of ``day``.

    No line and no id is read: the days' sets are merged bit by bit. Equal to count(DISTINCT) over the lines.
    """
    merged = id_sets.merge_sets(sets, ["counted", period.alias("period")])
    counts = id_sets.count_members(merged, ["counted", "period"], "n")
    named = [F.coalesce(F.sum(F.when(F.col("counted") == c, F.col("n"))), F.lit(0)).alias(c) for c in _SETS.values()]
    return counts.groupBy("period").agg(*named)


def _period_label(freq: str) -> Column:
    day = F.col("order_date")
    if freq == "M":
        return F.date_format(day, "yyyy-MM")
    if freq == "D":
        return F.date_format(day, "yyyy-MM-dd")
    if freq == "W":
        monday = F.date_trunc("week", day).cast("date")
        return F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string"))
    raise ValueError(f"freq must be 'D', 'W' or 'M', not {freq!r}")


def revenue_by_period(facts: DataFrame, freq: str = "M") -> DataFrame:
    """Revenue, orders and units per day, week (Monday to Sunday) or month; periods without orders are absent."""
    return (
        filter_completed(facts)
        .groupBy(_period_label(freq).alias("period"))
        .agg(
            F.sum(money(facts, "revenue")).alias("amount"),
            F.count_distinct("order_id").alias("orders"),
            as_double(F.sum(money(facts, "quantity"))).alias("units_sold"),
        )
        .select("period", as_double(F.round("amount", 2)).alias("revenue"), "orders", "units_sold")
        .orderBy("period")
    )


def monthly_growth(facts: DataFrame) -> DataFrame:
    """Percent change of each month's rounded revenue against the month present before it."""
    monthly = revenue_by_period(facts, "M")
    # one row per month: the window's single partition stays small whatever the data size
    before = F.lag("revenue").over(Window.orderBy("period"))
    change = F.try_divide(F.col("revenue") - before, before) * 100
    return monthly.select("period", "revenue", "orders", round2(change).alias("revenue_growth_pct")).orderBy("period")


def revenue_by_category(facts: DataFrame) -> DataFrame:
    """Revenue, orders, units and revenue share per category; lines without category form a group."""
    grouped = (
        filter_completed(facts)
        .groupBy("category")
        .agg(
            F.sum(money(facts, "revenue")).alias("amount"),
            F.count_distinct("order_id").alias("orders"),
            as_double(F.sum(money(facts, "quantity"))).alias("units_sold"),
        )
    )
    # one row per category from here on
    amount = as_double(F.col("amount"))
    total = as_double(F.sum("amount").over(Window.partitionBy()))
    share = F.when(total > 0, round2(F.try_divide(amount, total) * 100)).otherwise(F.lit(0.0))
    return grouped.select(
        "category",
        as_double(F.round("amount", 2)).alias("revenue"),
        "orders",
        "units_sold",
        share.alias("revenue_share_pct"),
    ).orderBy(F.desc("revenue"), F.asc_nulls_last("category"))


def revenue_by_channel(facts: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue, orders, customers and average order value per acquisition channel.

    Lines are summed per customer and order before customers are joined, so a customer with very
    many lines reaches the join with one row per order. No customers at all means no channels.
    """
    per_order = (
        filter_completed(facts)
        .groupBy("customer_id", "order_id")
        .agg(F.sum(money(facts, "revenue")).alias("amount"))
    )
    channels = broadcast_table(customers.select("customer_id", "acquisition_channel"))
    joined = per_order.join(channels, "customer_id", "left")
    grouped = (
        joined.filter(customers.select("customer_id").exists())
        .groupBy("acquisition_channel")
        .agg(
            F.sum("amount").alias("amount"),
            F.count_distinct("order_id").alias("orders"),
            F.count_distinct("customer_id").alias("customers"),
        )
    )
    return grouped.select(
        "acquisition_channel",
        as_double(F.round("amount", 2)).alias("revenue"),
        "orders",
        "customers",
        round2(F.try_divide(as_double(F.col("amount")), F.col("orders"))).alias("aov"),
    ).orderBy(F.desc("aov"), F.asc_nulls_last("acquisition_channel"))
