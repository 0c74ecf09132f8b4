"""Order lines and order facts: one enriched row per order line, whatever its status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from basketwise.functions.durable import broadcast_table
from basketwise.functions.dates import read_dates
from basketwise.functions.expressions import as_double, money, to_number, to_time

COMPLETED = "Completed"

PRODUCT_ATTRIBUTES = ("product_name", "category", "sub_category", "cost_price", "selling_price")


def prepare_order_lines(orders: DataFrame, formats: tuple[str, ...] | None = None) -> DataFrame:
    """Typed order lines with revenue and month, without product attributes.

    Whatever needs no product attribute reads this and so avoids the product join. Dates given as text are read in the
    order that the column tells, for which the column is read when this is called, or by ``formats`` beside ISO.
    """
    dated = (
        read_dates(orders, ["order_date"])
        if formats is None
        else orders.withColumn("order_date", to_time(orders, "order_date", formats))
    )
    typed = dated.withColumns(
        {name: F.coalesce(to_number(orders, name), F.lit(0.0)) for name in ("quantity", "unit_price", "discount_pct")}
    )
    return typed.filter(F.col("order_date").isNotNull()).select(
        "order_id",
        "customer_id",
        "product_id",
        "order_date",
        "quantity",
        "unit_price",
        "discount_pct",
        "order_status",
        (F.col("unit_price") * F.col("quantity") * (1 - F.col("discount_pct") / 100)).alias("revenue"),
        F.date_format("order_date", "yyyy-MM").alias("year_month"),
    )


def prepare_order_facts(
    orders: DataFrame, products: DataFrame | None, formats: tuple[str, ...] | None = None
) -> DataFrame:
    """Order lines left-joined to their product, with revenue, cost and profit; 17 columns.

    ``products`` holds one row per product_id, as its contract says. It is measured when this is
    called, and broadcast if it is small enough.
    """
    lines = prepare_order_lines(orders, formats)
    if products is None:
        attributes = [F.lit(None).cast("string").alias(c) for c in PRODUCT_ATTRIBUTES[:3]]
        attributes += [F.lit(0.0).alias("cost_price"), F.lit(None).cast("double").alias("selling_price")]
        joined = lines.select("*", *attributes)
    else:
        known = [c for c in PRODUCT_ATTRIBUTES if c in products.columns]
        catalogue = broadcast_table(products.select("product_id", *known))
        joined = lines.join(catalogue, "product_id", "left")
        for name in PRODUCT_ATTRIBUTES:
            if name not in known:
                kind = T.DoubleType() if name.endswith("price") else T.StringType()
                joined = joined.withColumn(name, F.lit(None).cast(kind))
        joined = joined.withColumn("cost_price", F.coalesce(to_number(joined, "cost_price"), F.lit(0.0)))
    cost = F.col("cost_price") * F.col("quantity")
    return joined.select(
        "order_id",
        "customer_id",
        "product_id",
        "order_date",
        "quantity",
        "unit_price",
        "discount_pct",
        "order_status",
        *PRODUCT_ATTRIBUTES,
        "revenue",
        cost.alias("cost"),
        (F.col("revenue") - cost).alias("profit"),
        "year_month",
    )


def filter_completed(facts: DataFrame) -> DataFrame:
    """Only the lines that count towards revenue."""
    return facts.filter(F.col("order_status") == COMPLETED)


def order_rollup(lines: DataFrame) -> DataFrame:
    """Lines summed per (order, customer, date, status), with the number of lines.

    Sums, distinct orders, distinct customers, dates and line counts are the same as over the lines,
    so every operator that needs no product can read this in their place. It is several times
    smaller, and a hot customer or date stays spread because the key contains the order.
    """
    return (
        lines.groupBy("order_id", "customer_id", "order_date", "order_status")
        .agg(
            as_double(F.sum(money(lines, "quantity"))).alias("quantity"),
            F.sum(money(lines, "revenue")).alias("revenue"),
            F.count(F.lit(1)).alias("line_count"),
        )
        .withColumn("year_month", F.date_format("order_date", "yyyy-MM"))
    )


def product_rollup(lines: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Completed lines summed per (product, month): the input of product tables and category months.

    The sums are made before products are joined, so the join sees at most one row per product and month.
    """
    completed = filter_completed(lines)
    summed = completed.groupBy("product_id", "year_month", "order_status").agg(
        as_double(F.sum(money(lines, "quantity"))).alias("quantity"), F.sum(money(lines, "revenue")).alias("revenue")
    )
    if products is None:
        return summed
    return summed.join(products.select("product_id", "category"), "product_id", "left")
