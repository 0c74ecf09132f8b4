"""Product performance, rankings, and products with high margin but low volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketwise.functions.durable import durable
from basketwise.functions.expressions import as_double, money, round2, to_number
from basketwise.functions.ranking import quantile
from basketwise.operators.facts import filter_completed


def product_performance(facts: DataFrame, products: DataFrame) -> DataFrame:
    """One row per catalogue product, unsold ones included; sales of unknown products are left out.

    Sales are summed per product before the catalogue is joined. ``facts`` may also be order lines
    or a product roll-up: cost is the catalogue's cost times the units, summed exactly.
    """
    completed = filter_completed(facts)
    sales = completed.groupBy("product_id").agg(
        as_double(F.sum(money(facts, "quantity"))).alias("units"),
        F.sum(money(facts, "revenue")).alias("amount"),
    )
    base = products.select(
        "product_id",
        "product_name",
        "category",
        F.coalesce(to_number(products, "cost_price"), F.lit(0.0)).alias("cost_price"),
        F.coalesce(to_number(products, "selling_price"), F.lit(0.0)).alias("selling_price"),
    )
    cost, price = F.col("cost_price"), F.col("selling_price")
    units = F.coalesce(F.col("units"), F.lit(0.0))
    amount = F.coalesce(F.col("amount"), F.lit(0))
    profit = amount - (cost * units).cast("decimal(32,6)")
    return base.join(sales, "product_id", "left").select(
        "product_id",
        "product_name",
        "category",
        "cost_price",
        "selling_price",
        F.when(price > 0, round2(F.try_divide(price - cost, price) * 100)).otherwise(0.0).alias("margin_pct"),
        units.cast("long").alias("units_sold"),
        as_double(F.round(amount, 2)).alias("revenue"),
        as_double(F.round(profit, 2)).alias("profit"),
    )


def _check_column(table: DataFrame, by: str) -> None:
    if by not in table.columns:
        raise ValueError(f"no column {by!r} to sort by; there are {table.columns}")


def top_n_products(table: DataFrame, n: int = 10, by: str = "revenue") -> DataFrame:
    _check_column(table, by)
    return table.orderBy(F.desc_nulls_last(by), "product_id").limit(n)


def bottom_n_products(table: DataFrame, n: int = 10, by: str = "revenue") -> DataFrame:
    _check_column(table, by)
    return table.orderBy(F.asc_nulls_last(by), "product_id").limit(n)


def high_margin_low_volume(
    table: DataFrame,
    margin_threshold_pct: float = 50.0,
    volume_percentile: float = 0.25,
    approx: bool = False,
) -> DataFrame:
    """Products with at least the given margin whose units are at or below the given quantile of all units."""
    if approx:
        low = F.col("units_sold") <= table.agg(F.percentile_approx("units_sold", volume_percentile)).scalar()
    else:
        table = durable(table)
        cutoff = quantile(table, "units_sold", "product_id", volume_percentile)
        low = F.col("units_sold") <= F.lit(cutoff).cast("double")
    return table.filter((F.col("margin_pct") >= margin_threshold_pct) & low).orderBy(
        F.desc("margin_pct"), "units_sold", "product_id"
    )
