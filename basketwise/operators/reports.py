"""Batch audit of machine-written JSON reports: parsing, shape, citations, verdict, and the actions in them.

Input: reports(report_id, raw, known_sources array<string>). Everything a report needs lies in its own
row, so the whole audit is one narrow projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basketwise.functions.expressions import is_blank, let, parse_json, python_list, python_list_column, strip

# The sections of a report, in order.
SUMMARY = "executive_summary"
LIST_SECTIONS = (
    "revenue_opportunities",
    "customer_growth_opportunities",
    "product_opportunities",
    "risks",
    "recommended_actions",
)
REQUIRED_SECTIONS = (SUMMARY, *LIST_SECTIONS)
#: Sections whose items can become actions, in the order they are offered.
ACTION_SECTIONS = (
    "revenue_opportunities",
    "product_opportunities",
    "customer_growth_opportunities",
    "recommended_actions",
)

# Sentences and constants of the audit.
NO_OBJECT = "the response did not contain a JSON object"
NOT_JSON = "the response could not be parsed as JSON"
NOT_TOP_LEVEL = "the JSON response was not an object at the top level (got %s)"
EMPTY_SUMMARY = "Missing or empty 'executive_summary' in model output."
MISSING_SECTION = "Missing section '{}' in model output — defaulted to an empty list."
WRAPPED_SECTION = "Section '{}' was a single object, not a list — wrapped automatically."
ODD_SECTION = "Section '{}' had an unexpected type (%s) — defaulted to an empty list."
EXTRA_KEYS = "Model output included unexpected extra key(s), ignored: %s"
ABSENT_SECTIONS = "Validator: missing required section(s) in strategy report: {}"
NO_CITATIONS = (
    "Validator: no policy citations found anywhere in the strategy report — "
    "recommendations may not be grounded in company policy."
)
UNKNOWN_CITATIONS = (
    "Validator: strategy report cites policy source(s) not among the chunks retrieved this run "
    "(possible hallucinated citation): %s"
)
INVALID_REPORT = "Validator: strategy report is empty or missing an executive summary — treating as invalid."
FENCE_START = r"(?U)^```(?:json)?\s*"
FENCE_END = r"(?U)\s*```$"
DEFAULT_TITLE = "AI-recommended growth action"
ACTION_AMOUNT = 499
DESCRIPTION_LENGTH = 2048

_EMPTY = "cast(array() as array<variant>)"


# JSON texts that count as missing.
FALSY = ("null", '""', "false", "0", "0.0", "-0.0", "[]", "{}")


def _kind(schema: Column) -> Column:
    """The type of a JSON value, given by its schema, as its Python name; null for absent and null."""
    # whole numbers beyond 64 bits; shorter decimals without scale come from texts like 1.0
    digits = F.regexp_extract(schema, r"^DECIMAL\((\d+),0\)", 1).try_cast("int")
    return (
        F.when(schema.startswith("OBJECT"), "dict")
        .when(schema.startswith("ARRAY"), "list")
        .when(schema == "STRING", "str")
        .when(schema == "BOOLEAN", "bool")
        .when((schema == "BIGINT") | (digits > 18), "int")
        .when(schema.startswith("DECIMAL") | (schema == "DOUBLE"), "float")
    )


def _get(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def _text(item: Column, key: str) -> Column:
    """A field as text, whatever its type."""
    other = F.nullif(F.to_json(_get(item, key)), F.lit("null"))
    return F.coalesce(F.try_variant_get(item, f"$.{key}", "string"), other)


def _truthy_text(item: Column, key: str) -> Column:
    """A field as text; null where it is absent, null, empty, false or zero."""
    return F.when(~F.to_json(_get(item, key)).isin(*FALSY), _text(item, key))


def _parsed(text: Column) -> Column:
    """struct(report, error): the text as JSON, else the part from its first to its last brace."""

    def from_braces(braces: Column) -> Column:
        error = F.when(braces == "", NO_OBJECT).otherwise(NOT_JSON)
        return let(
            parse_json(braces),
            lambda report: F.struct(report.alias("report"), F.when(report.isNull(), error).alias("error")),
        )

    def from_whole(report: Column) -> Column:
        good = F.struct(report.alias("report"), F.lit(None).cast("string").alias("error"))
        return F.when(report.isNotNull(), good).otherwise(
            let(F.regexp_extract(text, r"(?s)\{.*\}", 0), from_braces)
        )

    return let(parse_json(text), from_whole)


def _unfenced(text: Column) -> Column:
    opened = F.regexp_replace(text, FENCE_START, "")
    return F.when(text.startswith("```"), F.regexp_replace(opened, FENCE_END, "")).otherwise(text)


def parse_reports(reports: DataFrame) -> DataFrame:
    """Add ``report`` (the JSON value) and ``error``; code fences around the text are removed."""
    raw = F.col("raw")
    bare = raw.startswith("{") & raw.endswith("}")
    text = F.when(bare, raw).otherwise(let(strip(raw), _unfenced))
    outcome = let(text, _parsed)
    return (
        reports.withColumn("_parsed", outcome)
        .withColumns({"report": F.col("_parsed.report"), "error": F.col("_parsed.error")})
        .drop("_parsed")
    )


def rejected_reports(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull())


def normalize_reports(parsed: DataFrame) -> DataFrame:
    """Summary as text, five sections as array<variant>, and the warnings about what had to be mended.

    A report that could not be parsed, or is no object, keeps ``error`` and gets nulls.
    """
    report = F.col("report")
    schemas = {f"_schema_{s}": F.schema_of_variant(_get(report, s)) for s in REQUIRED_SECTIONS}
    rows = parsed.withColumns({"_schema": F.schema_of_variant(report), **schemas})
    rows = rows.withColumn("_kind", F.coalesce(_kind(F.col("_schema")), F.lit("NoneType")))
    rows = rows.withColumns({f"_kind_{s}": _kind(F.col(f"_schema_{s}")) for s in REQUIRED_SECTIONS})
    rows = rows.withColumn(
        "error",
        F.when(F.col("error").isNotNull(), F.col("error")).when(
            F.col("_kind") != "dict", F.format_string(NOT_TOP_LEVEL, F.col("_kind"))
        ),
    )
    usable = F.col("error").isNull()

    is_text = F.col(f"_kind_{SUMMARY}") == "str"
    summary = F.when(is_text, F.try_variant_get(report, f"$.{SUMMARY}", "string")).otherwise("")
    rows = rows.withColumn(SUMMARY, F.when(usable, summary))

    warnings = [F.when(is_blank(F.col(SUMMARY)), EMPTY_SUMMARY)]
    lists = {}
    for section in LIST_SECTIONS:
        kind, value = F.col(f"_kind_{section}"), _get(report, section)
        items = (
            F.when(kind == "list", F.try_variant_get(report, f"$.{section}", "array<variant>"))
            .when(kind == "dict", F.array(value))
            .otherwise(F.expr(_EMPTY))
        )
        lists[section] = F.when(usable, items)
        warnings.append(
            F.when(kind.isNull(), MISSING_SECTION.format(section))
            .when(kind == "dict", WRAPPED_SECTION.format(section))
            .when(kind != "list", F.format_string(ODD_SECTION.format(section), kind))
        )
    keys = F.map_keys(report.cast("map<string,variant>"))
    extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(s) for s in REQUIRED_SECTIONS])))
    rows = rows.withColumns({**lists, "_extra": F.when(usable, extra)})
    warnings.append(
        F.when(F.size("_extra") > 0, F.format_string(EXTRA_KEYS, python_list_column(F.col("_extra"))))
    )
    helpers = [f"_{what}_{s}" for what in ("kind", "schema") for s in REQUIRED_SECTIONS]
    return rows.withColumn("warnings", F.when(usable, F.array_compact(F.array(*warnings)))).drop(
        "_kind", "_schema", "_extra", "report", "raw", *helpers
    )


def section_presence(normalized: DataFrame) -> DataFrame:
    """One boolean per required section, and whether all are there."""
    has = {f"has_{s}": F.col(s).isNotNull() for s in REQUIRED_SECTIONS}
    all_present = F.lit(True)
    for present in has.values():
        all_present = all_present & present
    return normalized.withColumns({**has, "all_sections_present": all_present})


def _citations(section: str) -> Column:
    """The policy references in a section; items that are no objects have none."""
    refs = F.transform(F.col(section), lambda item: _truthy_text(item, "policy_reference"))
    return F.coalesce(F.array_compact(refs), F.array().cast("array<string>"))


def citation_audit(normalized: DataFrame) -> DataFrame:
    """Add total_citations, cited_sources, sections_with_citations and unrecognized_citations."""
    rows = normalized.withColumns({f"_refs_{s}": _citations(s) for s in LIST_SECTIONS})
    refs = F.concat(*[F.col(f"_refs_{s}") for s in LIST_SECTIONS])
    where = [F.when(F.size(f"_refs_{s}") > 0, F.lit(s)) for s in LIST_SECTIONS]
    known = F.coalesce(F.col("known_sources"), F.array().cast("array<string>"))
    return (
        rows.withColumn("_refs", refs)
        .withColumns(
            {
                "total_citations": F.size("_refs").cast("long"),
                "cited_sources": F.array_sort(F.array_distinct("_refs")),
                "sections_with_citations": F.array_compact(F.array(*where)),
            }
        )
        .withColumn("unrecognized_citations", F.array_except("cited_sources", known))
        .drop("_refs", *[f"_refs_{s}" for s in LIST_SECTIONS])
    )


def report_verdict(reports: DataFrame) -> DataFrame:
    """The whole audit: one row per report with presence, citations, is_valid, status and all warnings."""
    audited = citation_audit(section_presence(normalize_reports(parse_reports(reports))))
    valid = F.coalesce(F.col("error").isNull() & ~is_blank(F.col(SUMMARY)), F.lit(False))
    absent = F.when(~F.col("all_sections_present"), ABSENT_SECTIONS.format(python_list(REQUIRED_SECTIONS)))
    found = F.array_compact(
        F.array(
            absent,
            F.when(F.col("total_citations") == 0, NO_CITATIONS),
            F.when(
                F.size("unrecognized_citations") > 0,
                F.format_string(UNKNOWN_CITATIONS, python_list_column(F.col("unrecognized_citations"))),
            ),
            F.when(~F.col("is_valid"), INVALID_REPORT),
        )
    )
    rows = audited.withColumn("is_valid", valid).withColumn("audit_warnings", found)
    status = (
        F.when(~F.col("is_valid"), "error")
        .when(F.size("audit_warnings") == 0, "success")
        .otherwise("warning")
    )
    return rows.withColumn("status", status)


def action_candidates(normalized: DataFrame) -> DataFrame:
    """(report_id, position, source_section, item): items that have a title or an action."""
    def tagged(section: str) -> Column:
        return F.transform(
            F.coalesce(F.col(section), F.expr(_EMPTY)),
            lambda item: F.struct(F.lit(section).alias("source_section"), item.alias("item")),
        )

    offered = F.filter(
        F.concat(*[tagged(s) for s in ACTION_SECTIONS]),
        lambda t: F.coalesce(_truthy_text(t["item"], "title"), _truthy_text(t["item"], "action")).isNotNull(),
    )
    return normalized.select("report_id", F.posexplode(offered).alias("position", "t")).select(
        "report_id", "position", "t.source_section", "t.item"
    )


def map_actions(candidates: DataFrame, prefix: str = "Growth action") -> DataFrame:
    """The action each candidate stands for. The amount is fixed and never taken from the report;
    ``prefix`` opens the description."""
    item = F.col("item")

    def first_of(*keys: str, default: str) -> Column:
        return F.coalesce(*[_truthy_text(item, k) for k in keys], F.lit(default))

    rows = candidates.withColumn("title", first_of("title", "action", default=DEFAULT_TITLE))
    described = F.concat(F.lit(f"{prefix} — "), F.col("title"))
    return rows.select(
        "report_id",
        "position",
        "source_section",
        "title",
        first_of("description", "rationale", default="").alias("reason"),
        first_of("supporting_metric", default="").alias("supporting_metric"),
        _text(item, "estimated_impact").alias("estimated_impact"),
        _text(item, "policy_reference").alias("policy_reference"),
        F.lit(ACTION_AMOUNT).alias("amount_inr"),
        F.substring(described, 1, DESCRIPTION_LENGTH).alias("description"),
    )
