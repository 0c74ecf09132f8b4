"""Dates given as text.

Whether 01/02/2024 lies in January or in February is a property of the column and not of the value: every value is read in
both orders, the order that reads more values of a column is taken for all of them, and a column that both orders
read equally well, but differently, is reported.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from basketwise.functions.expressions import to_time

# Dates in digits, by what comes first, and all other forms that are read beside ISO.
MONTH_FIRST, DAY_FIRST = "month first", "day first"
ORDERS = {MONTH_FIRST: "M/d/yyyy[ H:mm[:ss]]", DAY_FIRST: "d/M/yyyy[ H:mm[:ss]]"}
OTHER_FORMATS = (
    "yyyy/M/d[ H:mm[:ss]]", "MMM d yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy",
)

#: Three numbers, the year last, between equal slashes, points or hyphens; perhaps a time.
IN_DIGITS = r"^\d{1,2}([/.-])\d{1,2}\1\d{4}( |$)"
#: What every form of OTHER_FORMATS holds: a year.
A_YEAR = r"\d{4}"


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def in_order(text: Column, order: str) -> Column:
    """A date in digits as a timestamp; null for any other text, and for what the order doesn't read."""
    return F.when(text.rlike(IN_DIGITS), F.try_to_timestamp(F.translate(text, ".-", "//"), F.lit(ORDERS[order])))


def in_any_order(df: DataFrame, name: str) -> Column:
    """A column as timestamps where no order is in question: ISO and the other forms; dates in digits are null."""
    if not is_text(df, name):
        return to_time(df, name)
    text = F.col(name)
    # most values are ISO; the forms are tried only on texts that have their shape
    other = F.when(text.rlike(A_YEAR) & ~text.rlike(IN_DIGITS), F.coalesce(*[F.try_to_timestamp(text, F.lit(form)) for form in OTHER_FORMATS]))
    return F.coalesce(F.try_to_timestamp(text), other)


def votes(df: DataFrame, readings: dict[str, dict[str, Column]]) -> DataFrame:
    """(column, month_first, day_first, differ) for each column: values read in each order, and those both read differently."""
    counts = []
    for name, by_order in readings.items():
        month, day = by_order[MONTH_FIRST], by_order[DAY_FIRST]
        counts.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(month).alias("month_first"),
                F.count(day).alias("day_first"),
                F.count_if(month != day).alias("differ"),
            )
        )
    return df.agg(F.array(*counts).alias("votes")).select(F.inline("votes"))


def decided(votes: DataFrame) -> DataFrame:
    """The votes with the order taken, and whether it is undecided; the month comes first where nothing tells otherwise."""
    even = F.col("month_first") == F.col("day_first")
    taken = F.when(F.col("day_first") > F.col("month_first"), DAY_FIRST).otherwise(MONTH_FIRST)
    return votes.withColumns({"taken": taken, "undecided": even & (F.col("differ") > 0)})


def date_orders(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """(column, month_first, day_first, differ, taken, undecided) of the named columns of text, in one reading of them."""
    readings = {name: {order: in_order(F.col(name), order) for order in ORDERS} for name in names}
    return decided(votes(df, readings))


def read_dates(df: DataFrame, names: Iterable[str], taken: dict[str, str] | None = None) -> DataFrame:
    """The table with the named columns as timestamps, each column of text read in one order; unreadable values become null.

    ``taken`` names the order of columns for which it is known. The votes on the others are counted when this is called, one
    row per column.
    """
    names, taken = list(names), dict(taken or {})
    open_columns = [name for name in names if is_text(df, name) and name not in taken]
    if open_columns:
        taken |= {row["column"]: row["taken"] for row in date_orders(df, open_columns).collect()}

    def read(name: str) -> Column:
        plain = in_any_order(df, name)
        return F.coalesce(plain, in_order(F.col(name), taken[name])) if is_text(df, name) else plain

    return df.withColumns({name: read(name) for name in names})


def date_orders_by(df: DataFrame, group: str, names: Iterable[str]) -> DataFrame:
    """The same per value of ``group``, such as the file a row comes from: (group, column, ...)."""
    parts = []
    for name in names:
        month, day = (in_order(F.col(name), order) for order in ORDERS)
        counted = df.groupBy(group).agg(
            F.count(month).alias("month_first"), F.count(day).alias("day_first"), F.count_if(month != day).alias("differ")
        )
        parts.append(counted.select(group, F.lit(name).alias("column"), "month_first", "day_first", "differ"))
    return decided(reduce(DataFrame.unionByName, parts))
