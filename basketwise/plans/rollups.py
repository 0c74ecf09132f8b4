"""Roll-ups of order lines stored by day, so that a new day costs what that day holds.

Every result of the full analysis is computed from three roll-ups: per order, per product and per order and category. Each row
belongs to one day, and sums, distinct orders and extreme dates over days are those over the lines. So a stored day stays as it is until its
own lines change: a refresh reads the lines of the days it names, puts their rows in place of what was stored for these days, and
commits one manifest. Days are filed by month, so that files stay few; the months a refresh doesn't touch keep their
files. All roll-ups of a store change together or not at all.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from basketwise.functions.durable import broadcast_table, kept_table
from basketwise.functions.expressions import as_double, money
from basketwise.operators import facts as fact
from basketwise.plans.bundle import analysis_of
from basketwise.sources.versions import Versions, VersionTaken

_DAY, _MONTH = "day", "_month"

ROLLUPS = ("by_order", "by_product", "by_category")
#: The roll-ups that a result of the full analysis is computed from; all others come from the roll-up per order.
_ROLLUPS_OF = {
    "product_table": ("by_product",),
    "top_products": ("by_product",),
    "bottom_products": ("by_product",),
    "high_margin_low_volume_products": ("by_product",),
    "revenue_by_category": ("by_category",),
    "growth_signals": ("by_order", "by_product"),
    "signals:seasonal_category_spikes": ("by_product",),
    "signals:high_margin_low_volume_products": ("by_product",),
}


def rollups_of(results: Iterable[str]) -> tuple[str, ...]:
    """The roll-ups that these results of the full analysis need."""
    needed = {rollup for result in results for rollup in _ROLLUPS_OF.get(result, ("by_order",))}
    return tuple(name for name in ROLLUPS if name in needed)


def _summed(lines: DataFrame, *keys: str) -> DataFrame:
    return lines.groupBy(*keys, _DAY, "year_month", "order_status").agg(
        as_double(F.sum(money(lines, "quantity"))).alias("quantity"), F.sum(money(lines, "revenue")).alias("revenue")
    )


def day_rollups(lines: DataFrame, products: DataFrame, names: Iterable[str] = ROLLUPS) -> dict[str, DataFrame]:
    """The named roll-ups of order lines, with the ``day`` of each row. Products and categories count completed lines only."""
    day = F.col("order_date").cast("date")
    completed = fact.filter_completed(lines).withColumn(_DAY, day)

    def by_category() -> DataFrame:
        categories = broadcast_table(products.select("product_id", "category"))
        return _summed(completed.join(categories, "product_id", "left"), "order_id", "category")

    makers = {
        "by_order": lambda: fact.order_rollup(lines).withColumn(_DAY, day),
        "by_product": lambda: _summed(completed, "product_id"),
        "by_category": by_category,
    }
    return {name: makers[name]() for name in names}


def spans(days: Iterable[dt.date]) -> list[tuple[dt.date, dt.date]]:
    """The days as spans (first, day after the last)."""
    one, out = dt.timedelta(days=1), []
    for day in sorted(set(days)):
        if out and out[-1][1] == day:
            out[-1] = (out[-1][0], day + one)
        else:
            out.append((day, day + one))
    return out


def within(column: Column, days: Iterable[dt.date]) -> Column:
    """Is the time on one of the days? Ranges, which reach a scan."""
    parts = [(column >= F.lit(first)) & (column < F.lit(last)) for first, last in spans(days)]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


class DayRollups:
    """The roll-ups stored at ``path``; ``names`` are those that this store keeps, the same at every refresh."""

    def __init__(self, spark: SparkSession, path: str, names: Iterable[str] = ROLLUPS):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)
        self.names = tuple(names)

    def manifest(self, version: int | None = None) -> dict:
        """{"schemas": {roll-up: schema}, "months": {roll-up: {month: folder}}}"""
        number = self.versions.latest() if version is None else version
        return self.versions.read(number) if number else {"schemas": {}, "months": {}}

    def refresh(self, orders: DataFrame, products: DataFrame, days: Iterable[dt.date] | None = None) -> int:
        """Take the lines of ``days`` from ``orders`` in place of what is stored for these days; without ``days``, store all anew.

        A named day without lines is empty afterwards. Only lines of the named days are read: the condition on order_date
        reaches the scan. A product's category is that of its day's last refresh. Returns the new version; if another writer commits
        first, the days are merged into what that writer left.
        """
        lines = fact.prepare_order_lines(orders)
        if days is not None:
            days = sorted(set(days))
            lines = lines.filter(within(F.col("order_date"), days))
        fresh = day_rollups(lines, products, self.names)
        if days is not None:
            fresh = {name: kept_table(rollup, "days") for name, rollup in fresh.items()}  # read again if another writer comes first
        while True:
            number = self.versions.latest()
            manifest = self.manifest(number) if days is not None else {"schemas": {}, "months": {}}
            if manifest["schemas"] and set(manifest["schemas"]) != set(self.names):
                raise ValueError(f"{sorted(manifest['schemas'])} are stored at {self.path}, not {sorted(self.names)}")
            schemas = {name: rollup.schema.jsonValue() for name, rollup in fresh.items()}
            months = {name: self._merged(manifest, name, rollup, days) for name, rollup in fresh.items()}
            try:
                self.versions.commit(number + 1, {"schemas": schemas, "months": months})
                return number + 1
            except VersionTaken:
                continue

    def _merged(self, manifest: dict, name: str, fresh: DataFrame, days: list[dt.date] | None) -> dict[str, str]:
        """Month and folder of one roll-up after a refresh; writes the months it touches."""
        folders = dict(manifest["months"].get(name, {}))
        touched = {f"{day:%Y-%m}" for day in days or ()}
        old = [folders.pop(month) for month in sorted(touched) if month in folders]
        rows = fresh
        if old:
            stays = self._read(fresh.schema, old).filter(~within(F.col(_DAY), days))
            rows = stays.unionByName(fresh)
        target = f"{self.versions.new_folder('data')}/{name}"
        # rebalanced by month: small months share a task, a large one is split
        filed = rows.withColumn(_MONTH, F.date_format(_DAY, "yyyy-MM")).hint("rebalance", _MONTH)
        filed.write.partitionBy(_MONTH).parquet(f"{self.path}/{target}")
        schema = T.StructType([*fresh.schema, T.StructField(_MONTH, T.StringType())])
        found = self.spark.read.schema(schema).parquet(f"{self.path}/{target}").select(_MONTH).distinct().collect()  # one row per month
        return folders | {row[0]: f"{target}/{_MONTH}={row[0]}" for row in found}

    def _read(self, schema: T.StructType, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}" for folder in folders])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """One roll-up of a version, by default the newest, over all days."""
        manifest = self.manifest(version)
        if name not in manifest["schemas"]:
            raise ValueError(f"nothing is stored at {self.path}, or no roll-up {name!r}")
        schema, folders = T.StructType.fromJson(manifest["schemas"][name]), list(manifest["months"][name].values())
        return self._read(schema, folders) if folders else self.spark.createDataFrame([], schema)

    def analysis(self, customers: DataFrame, products: DataFrame, names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
        """The results of the full analysis, from the stored days; no order line is read."""

        @cache
        def by_product() -> DataFrame:
            # days summed to months once: several results read it
            days = self.read("by_product")
            summed = days.groupBy("product_id", "year_month", "order_status").agg(
                as_double(F.sum(money(days, "quantity"))).alias("quantity"), F.sum("revenue").alias("revenue")
            )
            return kept_table(summed, "by-product")

        by_order = cache(lambda: self.read("by_order"))
        return analysis_of(by_order, by_product, lambda: self.read("by_category"), customers, products, names)
