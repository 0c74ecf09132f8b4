"""Reading and validating the three datasets together; nothing is passed on unvalidated."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketwise.contracts import LOAD_ORDER
from basketwise.operators.quality import Validation, validate
from basketwise.sources.tables import read_dataset


@dataclass
class LoadedTables:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    validations: dict[str, Validation] = field(default_factory=dict)

    def is_valid(self) -> bool:
        return all(v.is_valid() for v in self.validations.values())

    def summary(self) -> DataFrame:
        """One row per dataset."""
        return reduce(DataFrame.unionByName, [v.summary for v in self.validations.values()])

    def row_counts(self) -> DataFrame:
        """(dataset, rows, is_valid) of what is passed on."""
        parts = [
            validation.metrics.select(
                F.lit(name).alias("dataset"),
                F.col("clean_rows").alias("rows"),
                F.col("error").isNull().alias("is_valid"),
            )
            for name, validation in self.validations.items()
        ]
        return reduce(DataFrame.unionByName, parts)


def load_tables(
    tables: dict[str, DataFrame],
    order_cols: dict[str, list[str]] | None = None,
    formats: tuple[str, ...] | None = None,
) -> LoadedTables:
    """Validate tables already at hand, parents first; the foreign keys see the cleaned parents."""
    loaded = LoadedTables()
    for name in LOAD_ORDER:
        validation = validate(
            tables[name], name, parents=loaded.tables, order_cols=(order_cols or {}).get(name), formats=formats
        )
        loaded.tables[name] = tables[name] if validation.clean is None else validation.clean
        loaded.validations[name] = validation
    return loaded


def load_all(
    spark: SparkSession,
    paths: dict[str, str | list[str]],
    multi_line: bool = False,
    formats: tuple[str, ...] | None = None,
) -> LoadedTables:
    """The same from files: {dataset: path}."""
    return load_tables({name: read_dataset(spark, paths[name], multi_line) for name in LOAD_ORDER}, formats=formats)
