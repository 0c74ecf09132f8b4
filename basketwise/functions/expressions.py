"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The characters that count as white space when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The forms of dates that are read beside ISO; of 01/02/2024 the month comes first.
DATE_FORMATS = (
    "M/d/yyyy", "M/d/yyyy H:mm[:ss]", "yyyy/M/d", "yyyy/M/d H:mm[:ss]", "MMM d yyyy", "MMM d, yyyy", "MMMM d yyyy",
    "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy",
)
#: Numbers from here on can't be added up exactly as money, and count as unreadable.
NUMBER_LIMIT = 1e14

DAY_MICROS = 86_400_000_000
MONEY = T.DecimalType(18, 4)


def strip(text: Column) -> Column:
    """Text without white space at either end."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def to_number(df: DataFrame, name: str) -> Column:
    """A column as DOUBLE; what is no number in digits, or beyond NUMBER_LIMIT, becomes null."""
    value = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        # the cast would also read "1.5d", "1.5f", "NaN" and "Infinity", and makes "1e400" infinite
        number = F.when(~value.rlike("[dDfFnN]"), value.try_cast("double"))
    else:
        number = value.cast("double")
    return F.when(F.abs(number) < NUMBER_LIMIT, number)  # NaN and infinity are above it


def to_time(df: DataFrame, name: str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """A column as a timestamp; ISO text is read as it is, other text by ``formats``; the rest becomes null."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name)
    if isinstance(kind, T.DateType):
        return F.col(name).cast("timestamp")
    text = F.col(name).cast("string")
    tries = [F.try_to_timestamp(text)]
    tries += [F.try_to_timestamp(text, F.lit(pattern)) for pattern in formats]
    return F.coalesce(*tries)


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def whole_days(start: Column, end: Column) -> Column:
    """Whole days between two times, rounded down; not the number of midnights."""
    return F.floor((micros(end) - micros(start)) / F.lit(DAY_MICROS)).cast("long")


def money(df: DataFrame, name: str) -> Column:
    """An amount as an exact decimal, so that sums do not depend on their order; null where it has more than 14 digits."""
    if isinstance(df.schema[name].dataType, T.DecimalType):
        return F.col(name)
    return F.col(name).try_cast(MONEY)


def as_double(amount: Column) -> Column:
    return amount.cast("double")


def round2(value: Column) -> Column:
    """Two decimals, half up, decided on the decimal text and not on the binary value."""
    return F.round(value.cast("decimal(32,6)"), 2).cast("double")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def parse_json(text: Column) -> Column:
    """The JSON value of a text as VARIANT, or null where the text is not exactly one JSON value.

    Spark's parser stops after the first value. Inside an array whose last item must be the end
    mark, anything that follows the value makes the whole fail. The mark is the digest of the text, which no text holds.
    """
    mark = F.sha2(text.cast("binary"), 256)

    def only_value(pair: Column) -> Column:
        ends = F.try_variant_get(pair, "$[1]", "string") == mark
        alone = F.try_variant_get(pair, "$[2]", "variant").isNull()
        return F.when(ends & alone, F.variant_get(pair, "$[0]", "variant"))

    return let(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]'))), only_value)


def python_list(names) -> str:
    """['a', 'b'] as messages print it."""
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def python_list_column(names: Column) -> Column:
    """The same for an array column."""
    return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))
