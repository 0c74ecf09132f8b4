"""The full analysis of three tables in one go, and the curated context taken from it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from basketwise.functions.durable import kept_table
from basketwise.operators import customers as cust, facts as fact, products as prod, sales, signals
from basketwise.plans.load import LoadedTables
from basketwise.sources.tables import write_tables


def full_analysis(
    customers: DataFrame, products: DataFrame, orders: DataFrame, names: tuple[str, ...] | None = None
) -> dict[str, DataFrame]:
    """All results by name, or those asked for; signals under ``growth_signals`` and ``signals:<detector>``.

    The order lines are read three times at most, whatever the number of results: once into a roll-up per
    order and once into a roll-up per product and month, both kept as Parquet in the shared folder, and once for
    the distinct orders per category. Everything else is computed from the roll-ups. What no result asked for needs isn't made.
    """
    lines = fact.prepare_order_lines(orders)
    by_order = cache(lambda: kept_table(fact.order_rollup(lines), "by-order"))
    by_product = cache(lambda: kept_table(fact.product_rollup(lines), "by-product"))
    return analysis_of(by_order, by_product, lambda: fact.prepare_order_facts(orders, products), customers, products, names)


def analysis_of(
    by_order: Callable[[], DataFrame],
    by_product: Callable[[], DataFrame],
    by_category: Callable[[], DataFrame],
    customers: DataFrame,
    products: DataFrame,
    names: tuple[str, ...] | None = None,
) -> dict[str, DataFrame]:
    """The results of full_analysis from roll-ups, each made when a result first needs it: per order, per product and
    month, and whatever has order and category of completed lines."""

    @cache
    def product_table() -> DataFrame:
        return kept_table(prod.product_performance(by_product(), products), "product-table")

    @cache
    def rfm() -> DataFrame:
        return kept_table(cust.rfm_segmentation(by_order()), "rfm")

    def category_months() -> DataFrame:
        return by_product().join(products.select("product_id", "category"), "product_id", "left")

    detectors = {
        "seasonal_category_spikes": lambda: signals.seasonal_category_spikes(category_months()),
        "high_aov_channels": lambda: signals.high_aov_channels(by_order(), customers),
        "high_margin_low_volume_products": lambda: signals.high_margin_low_volume_signals(product_table()),
        "churn_risk_customers": lambda: signals.churn_risk_signals(rfm()),
    }
    makers = {
        "executive_kpis": lambda: sales.executive_kpis(by_order(), customers),
        "revenue_by_month": lambda: sales.revenue_by_period(by_order(), "M"),
        "revenue_by_day": lambda: sales.revenue_by_period(by_order(), "D"),
        "monthly_growth": lambda: sales.monthly_growth(by_order()),
        "revenue_by_category": lambda: sales.revenue_by_category(by_category()),
        "revenue_by_channel": lambda: sales.revenue_by_channel(by_order(), customers),
        "product_table": product_table,
        "top_products": lambda: prod.top_n_products(product_table()),
        "bottom_products": lambda: prod.bottom_n_products(product_table()),
        "high_margin_low_volume_products": lambda: prod.high_margin_low_volume(product_table()),
        "customer_table": lambda: cust.customer_performance(by_order()),
        "rfm_table": rfm,
        "high_value_customers": lambda: cust.high_value_customers(rfm()),
        "churn_risk_customers": lambda: cust.churn_risk_customers(rfm()),
        "segment_counts": lambda: cust.segment_counts(rfm()),
        "growth_signals": lambda: signals.union_signals({name: make() for name, make in detectors.items()}),
        **{f"signals:{name}": make for name, make in detectors.items()},
    }
    return {name: makers[name]() for name in (makers if names is None else names)}


def validated_analysis(loaded: LoadedTables, names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """full_analysis over the clean tables of a load; an error where any dataset failed its validation.

    The clean tables were kept when they were validated, so the sources aren't read again.
    """
    failed = [row.dataset for row in loaded.summary().filter(~F.col("is_valid")).select("dataset").collect()]
    if failed:
        raise ValueError(f"validation failed for {failed}")
    return full_analysis(*[loaded.tables[name] for name in ("customers", "products", "orders")], names)


def write_analysis(results: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Every result as Parquet."""
    return write_tables({name.replace(":", "_"): table for name, table in results.items()}, folder)


#: The results that business_context reads.
CONTEXT_RESULTS = (
    "executive_kpis", "revenue_by_category", "revenue_by_channel", "top_products", "bottom_products", "segment_counts",
    "signals:seasonal_category_spikes", "signals:high_aov_channels", "signals:high_margin_low_volume_products",
    "signals:churn_risk_customers",
)

PRODUCT_FIELDS = ["product_id", "product_name", "category", "revenue", "units_sold", "margin_pct"]


def _payload(table: DataFrame, fields: list[str]) -> Column:
    """A row as JSON; amounts in plain decimal notation, NaN as null, times in ISO form."""
    values = []
    for name in fields:
        kind, value = table.schema[name].dataType, F.col(name)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value.cast("decimal(32,2)"))
        values.append(value.alias(name))
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def _section(name: str, table: DataFrame, order: list, fields: list[str] | None = None, n: int | None = None):
    """The first ``n`` rows of a small table, numbered."""
    if n is not None:
        table = table.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.orderBy(*order))
    return table.select(
        F.lit(name).alias("section"), rank.alias("rank"), _payload(table, fields or table.columns).alias("payload")
    )


def business_context(results: dict[str, DataFrame]) -> DataFrame:
    """(section, rank, payload): the numbers a strategy report may rest on.

    Only small tables go in: one row of KPIs, five categories, the channels, five best and five worst
    products, the segments and the signals.
    """
    by_revenue = [F.desc("revenue"), "product_id"]
    parts = [
        _section("executive_kpis", results["executive_kpis"], [F.lit(1)]),
        _section(
            "top_categories_by_revenue", results["revenue_by_category"],
            [F.desc("revenue"), F.asc_nulls_last("category")], n=5,
        ),
        _section(
            "channel_performance", results["revenue_by_channel"],
            [F.desc("aov"), F.asc_nulls_last("acquisition_channel")],
        ),
        _section("top_products_by_revenue", results["top_products"], by_revenue, PRODUCT_FIELDS, 5),
        _section(
            "bottom_products_by_revenue", results["bottom_products"], ["revenue", "product_id"], PRODUCT_FIELDS, 5
        ),
        _section(
            "customer_segment_counts", results["segment_counts"], [F.desc("customers"), "segment"]
        ),
    ]
    orders = {
        "seasonal_category_spikes": [F.desc("spike_ratio"), "category"],
        "high_aov_channels": [F.desc("lift_pct"), "channel"],
        "high_margin_low_volume_products": [F.desc("margin_pct"), "units_sold", "product_id"],
        "churn_risk_customers": [F.desc("monetary"), "customer_id"],
    }
    for name, order in orders.items():
        parts.append(_section(f"growth_signals.{name}", results[f"signals:{name}"], order))
    return reduce(DataFrame.unionByName, parts)
