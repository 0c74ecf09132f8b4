"""Validation of a table against its contract: flags per row, counts per rule, clean rows and quarantine.

The source is scanned once: coerced columns and flags are plain expressions, and are kept as Parquet. The two checks
that look beyond the row reduce to one bit for each first row of a key, and to the foreign keys without parent (aggregated before
any shuffle), and are joined to the rows. The flagged table is kept too; clean rows, quarantine and counts are read from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from basketwise.contracts import ColumnRule, Contract, contract_of
from basketwise.functions import id_sets
from basketwise.functions.durable import join_keyed, kept_table
from basketwise.functions.dates import DAY_FIRST, MONTH_FIRST, ORDERS, decided, in_any_order, in_order, is_text, read_dates, votes
from basketwise.functions.expressions import python_list, to_number, to_time
from basketwise.sources.tables import ROW_SEQ

# The sentences of a validation summary.
MISSING_COLUMNS = "Missing required columns: {}"
EXTRA_COLUMNS = "Ignoring unexpected extra columns: {}"
MISSING_VALUES = "Column '{column}' has %s missing value(s)."
UNREADABLE = "Column '{column}': %s value(s) could not be parsed as {kind} and were flagged invalid."
BELOW_MINIMUM = "Column '{column}': %s value(s) below minimum allowed value ({minimum})."
UNDECIDED_ORDER = "Column '{column}': %s date(s) could have day or month first; the {taken} was assumed."
NOT_ALLOWED = "Column '{column}': %s value(s) outside allowed set {allowed}."
DUPLICATES = "%s duplicate '{key}' value(s) found; keeping first occurrence only."
ORPHANS = "Column '{column}': %s value(s) do not match any '{key}' in {parent}."
NO_ROWS = "No valid rows remained after validation."
TOO_MANY_INVALID = "More than 50%% of rows (%s/%s) failed validation."

_KEY, _ROW = "_order_key", "_row"


@dataclass(frozen=True)
class _Check:
    """One boolean column of the flagged table."""

    flag: str  # column name
    reason: str  # what the quarantine says
    message: str  # what the summary says, with the count as %s
    fatal: bool  # does it make the row invalid?


@dataclass(frozen=True)
class Validation:
    """Outcome for one dataset; all frames read the flagged table that was kept."""

    dataset: str
    flagged: DataFrame | None  # contract columns, flags, _problems, _invalid, _duplicate
    clean: DataFrame | None
    quarantine: DataFrame | None
    metrics: DataFrame  # one row: counts per rule
    summary: DataFrame  # one row: the record a reader wants

    def is_valid(self) -> bool:
        return self.summary.select("is_valid").first()[0]


def check_required_columns(df: DataFrame, dataset: str) -> list[str]:
    """Required columns that the table does not have."""
    return [c for c in contract_of(dataset).required if c not in df.columns]


def unexpected_columns(df: DataFrame, dataset: str) -> list[str]:
    known = set(contract_of(dataset).columns) | {ROW_SEQ}
    return [c for c in df.columns if c not in known]


def project_contract_columns(df: DataFrame, dataset: str) -> DataFrame:
    """Only the columns of the contract, in its order."""
    return df.select(*[c for c in contract_of(dataset).columns if c in df.columns])


def missing_value_profile(df: DataFrame, dataset: str) -> DataFrame:
    """(column, missing) of the contract columns with any missing value, before coercion."""
    columns = [c for c in contract_of(dataset).columns if c in df.columns]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "missing").filter(F.col("missing") > 0)


def coerced(df: DataFrame, rule: ColumnRule, formats: tuple[str, ...] | None = None) -> Column:
    """The column as its declared kind; unreadable values become null. Without ``formats``, dates in digits are left to
    the order that their column tells, and are null here."""
    if rule.numeric:
        return to_number(df, rule.name)
    if rule.kind == "date":
        return in_any_order(df, rule.name) if formats is None else to_time(df, rule.name, formats)
    return F.col(rule.name).cast("string")


def _open_dates(df: DataFrame, rules: list[ColumnRule], formats: tuple[str, ...] | None) -> list[str]:
    """The columns of dates whose order of day and month is to be told by their values."""
    return [r.name for r in rules if r.kind == "date" and formats is None and is_text(df, r.name)]


def coerce_columns(df: DataFrame, dataset: str) -> DataFrame:
    """The contract columns as their declared kinds, and the names of those whose text was unreadable.

    Columns of dates are read once more when this is called, for the order of day and month in each.
    """
    present = [r for r in contract_of(dataset).rules if r.name in df.columns]
    raw = {r.name: f"_raw_{r.name}" for r in present}
    dates = read_dates(df.withColumns({raw[r.name]: F.col(r.name) for r in present}), _open_dates(df, present, None))
    values = {r.name: F.col(r.name) if r.kind == "date" and is_text(df, r.name) else coerced(df, r) for r in present}
    lost = [F.when(F.col(raw[name]).isNotNull() & value.isNull(), F.lit(name)) for name, value in values.items()]
    return dates.select(
        *[value.alias(name) for name, value in values.items()], F.array_compact(F.array(*lost)).alias("unreadable")
    )


def rule_counts(validation: Validation) -> DataFrame:
    """(rule, rows) of every rule that any row breaks: missing, unreadable, below, outside, orphan."""
    flags = [c for c in validation.metrics.columns if c.startswith("_")]
    counts = validation.metrics.unpivot([], flags, "rule", "rows").filter(F.col("rows") > 0)
    return counts.withColumn("rule", F.ltrim("rule", F.lit("_")))


def _rule_checks(rule: ColumnRule, value: Column) -> list[tuple[_Check, Column]]:
    """The checks of one column from its text and its coerced ``value``."""
    name = rule.name
    given = F.col(name).isNotNull()
    checks = [
        (
            _Check(f"_missing_{name}", f"{name} missing",
                   MISSING_VALUES.format(column=name) if rule.required else "", rule.required),
            ~given,
        ),
        (
            _Check(f"_unreadable_{name}", f"{name} unreadable",
                   UNREADABLE.format(column=name, kind=rule.kind), True),
            given & value.isNull(),
        ),
    ]
    if rule.minimum is not None and rule.numeric:
        message = BELOW_MINIMUM.format(column=name, minimum=rule.minimum)
        low = F.coalesce(value < rule.minimum, F.lit(False))
        checks.append((_Check(f"_below_{name}", f"{name} below minimum", message, True), low))
    if rule.allowed:
        message = NOT_ALLOWED.format(column=name, allowed=rule.allowed)
        outside = F.coalesce(~value.isin(*rule.allowed), F.lit(False))
        checks.append((_Check(f"_outside_{name}", f"{name} not allowed", message, True), outside))
    return checks


def _holds(rule: ColumnRule) -> Column:
    """Does the coerced value satisfy its rule?"""
    value = F.col(rule.name)
    holds = value.isNotNull()
    if rule.minimum is not None and rule.numeric:
        holds = F.coalesce(value >= rule.minimum, F.lit(False))
    elif rule.allowed:
        holds = F.coalesce(value.isin(*rule.allowed), F.lit(False))
    return holds if rule.required else holds | F.col(f"_missing_{rule.name}")


def _with_order_key(df: DataFrame, order_cols: list[str] | None) -> DataFrame:
    """Add the key that tells which of two rows comes first; it is unique.

    A table without row position gets one here, which is only sure to be the same on every read once the
    rows are kept.
    """
    if ROW_SEQ not in df.columns:
        df = df.withColumn(ROW_SEQ, F.monotonically_increasing_id())
    return df.withColumn(_KEY, F.struct(*[F.col(c) for c in order_cols or []], F.col(ROW_SEQ)))


def _first_rows(df: DataFrame, key: str) -> DataFrame:
    """(_bucket, _members): the numbers of the rows that are the first of their key, as bits.

    One aggregation that combines before its shuffle, so a key with many rows stays spread; only the key, its least order
    key and that row's number are shuffled.
    """
    first = F.min(F.struct(_KEY, _ROW))[_ROW]
    return id_sets.id_sets(df.filter(F.col(key).isNotNull()).groupBy(key).agg(first.alias(_ROW)), [], _ROW)


def _flag_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Add _duplicate: the row is not the first of its key, by the unique order key. ``df`` is kept, with numbered rows.

    The first rows come back as one bit per row, small enough to be broadcast where keys are not: the rows themselves aren't shuffled.
    Rows without key are not compared; they count as duplicates of each other in the metrics.
    """
    joined = join_keyed(df.withColumn(id_sets.BUCKET, F.bitmap_bucket_number(_ROW)), _first_rows(df, key), id_sets.BUCKET)
    later = F.col(key).isNotNull() & ~id_sets.is_member(_ROW)
    return joined.withColumn("_duplicate", later).drop(id_sets.BUCKET, id_sets.MEMBERS, _ROW)


def duplicate_key_check(df: DataFrame, key: str, order_cols: list[str] | None = None) -> DataFrame:
    """The table with _duplicate set on every row but the first of its key; its rows are kept with their numbers."""
    numbered = df if ROW_SEQ in df.columns else df.withColumn(ROW_SEQ, F.monotonically_increasing_id())
    numbered = kept_table(numbered.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    return _flag_duplicates(_with_order_key(numbered, order_cols), key).select(*df.columns, "_duplicate")


def _unknown_keys(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(column, _unknown) of the non-null keys that no parent has, compared as text."""
    known = parent.select(F.col(parent_key).cast("string").alias(column)).distinct()
    return (
        df.select(F.col(column).cast("string").alias(column))
        .filter(F.col(column).isNotNull())
        .distinct()
        .join(known, column, "left_anti")
        .withColumn("_unknown", F.lit(True))
    )


def _flag_orphans(df: DataFrame, unknown: DataFrame, column: str) -> DataFrame:
    """Add _orphan_<column>: no parent has this key, or the key is null. ``column`` is text here."""
    joined = join_keyed(df, unknown, column)
    orphan = F.col(column).isNull() | F.col("_unknown").isNotNull()
    return joined.withColumn(f"_orphan_{column}", orphan).drop("_unknown")


def foreign_key_check(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """The rows whose key no parent has, with the key as text."""
    text = df.withColumn(column, F.col(column).cast("string"))
    flagged = _flag_orphans(text, _unknown_keys(df, column, parent, parent_key), column)
    return flagged.filter(f"_orphan_{column}").drop(f"_orphan_{column}")


def validate(
    df: DataFrame,
    dataset: str,
    parents: dict[str, DataFrame] | None = None,
    drop_invalid: bool = True,
    order_cols: list[str] | None = None,
    formats: tuple[str, ...] | None = None,
) -> Validation:
    """Check a table against the contract of ``dataset``.

    ``parents`` are already cleaned datasets for the foreign-key checks. ``order_cols`` say which of
    two rows with one key comes first; without them the row position of the source decides.
    Whether dates in digits have the day or the month first is told by their column, see ``functions/dates.py``;
    ``formats`` in its place are the forms of dates that are read beside ISO.
    """
    contract = contract_of(dataset)
    absent = check_required_columns(df, dataset)
    if absent:
        return _without_columns(df, contract, absent)
    extra = unexpected_columns(df, dataset)
    keyed = _with_order_key(df, order_cols)

    present = [r for r in contract.rules if r.name in df.columns]
    # numbers and dates are read in a projection of their own, once for the value and all checks on it
    read = {r.name: f"_value_{r.name}" for r in present if r.numeric or r.kind == "date"}
    values = {r.name: F.col(read[r.name]) if r.name in read else coerced(df, r, formats) for r in present}
    checks: list[_Check] = []
    flags: dict[str, Column] = {}
    for rule in present:
        for check, flag in _rule_checks(rule, values[rule.name]):
            checks.append(check)
            flags[check.flag] = flag
    open_dates = _open_dates(df, present, formats)
    readings = {name: {order: f"_{order}_{name}".replace(" ", "_") for order in ORDERS} for name in open_dates}
    scanned = keyed.withColumns({read[r.name]: coerced(df, r, formats) for r in present if r.name in read}).select(
        *[value.alias(name) for name, value in values.items()],
        *[flag.alias(name) for name, flag in flags.items()],
        *[in_order(F.col(name), order).alias(to) for name, by_order in readings.items() for order, to in by_order.items()],
        _KEY,
        F.monotonically_increasing_id().alias(_ROW),
    )
    # typed and flagged once; the offending keys are then looked up in what was kept, each reading its own columns
    scanned = kept_table(scanned, f"{dataset}-scanned")
    scanned, undecided = _settle_dates(scanned, readings)
    rows = _flag_duplicates(scanned, contract.key)
    parent_checks = []
    for column, parent_name in contract.parents.items():
        parent = (parents or {}).get(parent_name)
        parent_key = contract_of(parent_name).key
        if parent is None or parent_key not in parent.columns:
            continue
        rows = _flag_orphans(rows, _unknown_keys(scanned, column, parent, parent_key), column)
        message = ORPHANS.format(column=column, key=parent_key, parent=parent_name)
        parent_checks.append(_Check(f"_orphan_{column}", f"{column} unknown", message, True))

    every = checks + parent_checks
    # over the coerced values, not the flags: the filter is pushed to the scan, and stays short there
    invalid = F.lit(False)
    for rule in present:
        invalid = invalid | ~_holds(rule)
    for check in parent_checks:
        invalid = invalid | F.col(check.flag)
    reasons = [F.when(F.col(c.flag), F.lit(c.reason)) for c in every if c.fatal]
    reasons.append(F.when(F.col("_duplicate"), F.lit(f"{contract.key} duplicate")))
    # a row without key repeats every other row without key; all of them are invalid already
    flagged = rows.withColumns(
        {"_invalid": invalid, "_problems": F.array_compact(F.array(*reasons))}
    ).drop(_KEY)
    flagged = kept_table(flagged, f"{dataset}-flagged")

    bad = F.col("_invalid") | F.col("_duplicate")
    names = [rule.name for rule in present]
    clean = (flagged.filter(~bad) if drop_invalid else flagged).select(*names)
    quarantine = flagged.filter(bad).select(*names, F.col("_problems").alias("problems"))

    keyless = F.count_if(F.col(contract.key).isNull())
    metrics = flagged.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("_invalid").alias("invalid_rows"),
        (F.count_if("_duplicate") + F.greatest(keyless - 1, F.lit(0))).alias("duplicate_rows"),
        (F.count_if(~bad) if drop_invalid else F.count(F.lit(1))).alias("clean_rows"),
        *[F.count_if(c.flag).alias(c.flag) for c in every],
    )
    text = [F.col(c).cast("string") for c in ("invalid_rows", "total_rows")]
    too_many = F.col("invalid_rows") * 2 > F.col("total_rows")
    error = F.when(F.col("clean_rows") == 0, F.lit(NO_ROWS)).when(
        too_many, F.format_string(TOO_MANY_INVALID, *text)
    )
    metrics = metrics.withColumn("error", error)
    summary = _summary(metrics, contract, extra, checks, parent_checks, undecided)
    return Validation(dataset, flagged, clean, quarantine, metrics, summary)


def _settle_dates(scanned: DataFrame, readings: dict[str, dict[str, str]]) -> tuple[DataFrame, list[str]]:
    """Both readings of the columns of dates turned into the one their column tells, and what to say of undecided columns."""
    if not readings:
        return scanned, []
    columns = {name: {order: F.col(to) for order, to in by_order.items()} for name, by_order in readings.items()}
    said, settled = [], {}
    for row in decided(votes(scanned, columns)).collect():  # one row per column
        name = row["column"]
        settled[name] = F.coalesce(F.col(name), columns[name][row["taken"]])
        settled[f"_unreadable_{name}"] = ~F.col(f"_missing_{name}") & settled[name].isNull()
        if row["undecided"]:
            first = {MONTH_FIRST: "month", DAY_FIRST: "day"}[row["taken"]]
            said.append(UNDECIDED_ORDER.format(column=name, taken=first) % row["differ"])
    return scanned.withColumns(settled).drop(*[to for by_order in readings.values() for to in by_order.values()]), said


def _counted(flag: str, message: str) -> Column:
    return F.when(F.col(flag) > 0, F.format_string(message, F.col(flag).cast("string")))


def _summary(
    metrics: DataFrame, contract: Contract, extra: list[str], checks: list[_Check], parent_checks: list[_Check], undecided: list[str]
) -> DataFrame:
    warnings = [F.lit(EXTRA_COLUMNS.format(python_list(extra)))] if extra else []
    warnings += [_counted(c.flag, c.message) for c in checks if c.message]
    warnings.append(_counted("duplicate_rows", DUPLICATES.format(key=contract.key)))
    warnings += [_counted(c.flag, c.message) for c in parent_checks]
    warnings += [F.lit(text) for text in undecided]
    missing = F.map_filter(
        F.create_map(
            *[
                x
                for c in checks
                if c.flag.startswith("_missing_")
                for x in (F.lit(c.flag.removeprefix("_missing_")), F.col(c.flag))
            ]
        ),
        lambda _, n: n > 0,
    )
    return metrics.select(
        F.lit(contract.name).alias("dataset"),
        F.col("error").isNull().alias("is_valid"),
        "total_rows",
        F.col("invalid_rows").alias("invalid_rows_dropped"),
        F.col("duplicate_rows").alias("duplicate_rows_dropped"),
        missing.alias("missing_values"),
        F.array_compact(F.array("error")).alias("errors"),
        F.array_compact(F.array(*warnings)).alias("warnings"),
    )


def _without_columns(df: DataFrame, contract: Contract, absent: list[str]) -> Validation:
    """Nothing can be checked without the required columns."""
    zero = F.lit(0).cast("long")
    metrics = df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows",
        zero.alias("invalid_rows"),
        zero.alias("duplicate_rows"),
        F.col("total_rows").alias("clean_rows"),  # the raw rows are passed on
        F.lit(MISSING_COLUMNS.format(python_list(absent))).alias("error"),
    )
    summary = metrics.select(
        F.lit(contract.name).alias("dataset"),
        F.lit(False).alias("is_valid"),
        "total_rows",
        F.col("invalid_rows").alias("invalid_rows_dropped"),
        F.col("duplicate_rows").alias("duplicate_rows_dropped"),
        F.from_json(F.lit("{}"), "map<string,long>").alias("missing_values"),
        F.array("error").alias("errors"),
        F.array().cast("array<string>").alias("warnings"),
    )
    return Validation(contract.name, None, None, None, metrics, summary)
