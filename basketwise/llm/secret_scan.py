"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds which
(blob, rule version) pairs were scanned and what was found in them; a run scans the pairs it has not seen,
appends them, and joins the findings back to all paths. Expressions only, no Python in the tasks.
"""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from basketwise.functions.durable import scratch_path
from basketwise.llm.store import table


class Rule(NamedTuple):
    kind: str
    pattern: str  # leftmost, non-overlapping; a match that fails the length test still uses up its text
    group: int  # the group whose length is tested
    least: int  # characters


#: Fixed values. The order tells which kind comes first where two spans start together. The last two match runs
#: of one class of characters, so asking for the length within the pattern finds the same spans.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
RULE_VERSION = "base-1"

LEDGER = "blob string, n_found long, found array<struct<start: int, place: int, kind: string, stop: int>>, rule_version string"


def blob_address(text: Column) -> Column:
    """Content address; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) -> one row per blob with all spans, sorted by start, then by the order of the rules.

    The gaps between the matches (split) and the matches themselves give every position in code points as a
    running sum, without searching again. Only blobs with a match are taken apart into rows.
    """
    looked = blobs.withColumns(
        {
            f"_m{i}": F.transform(
                F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), lambda m: F.length(m)
            )
            for i, r in enumerate(rules)
        }
    )
    any_match = F.lit(False)
    for i in range(len(rules)):
        any_match = any_match | (F.size(f"_m{i}") > 0)
    per_rule = [
        F.when(
            F.size(f"_m{i}") > 0,
            F.arrays_zip(
                F.transform(F.split("text", r.pattern, -1), lambda gap: F.length(gap)).alias("gap"),
                F.col(f"_m{i}").alias("size"),
                F.transform(
                    F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), lambda m: F.length(m)
                ).alias("tested"),
            ),
        )
        for i, r in enumerate(rules)
    ]
    hits = looked.filter(any_match).select("blob", F.posexplode(F.array(*per_rule)).alias("place", "hits"))
    rows = hits.select("blob", "place", F.posexplode("hits").alias("at", "hit")).select(
        "blob", "place", "at", "hit.gap", "hit.size", "hit.tested"
    )
    upto = Window.partitionBy("blob", "place").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(upto)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("place") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("place") + 1)
    spans = rows.withColumn("stop", stop).filter(F.col("size").isNotNull() & (F.col("tested") >= least))
    span = F.struct(
        (F.col("stop") - F.col("size")).cast("int").alias("start"),
        F.col("place").cast("int").alias("place"),
        kind.alias("kind"),
        F.col("stop").cast("int").alias("stop"),
    )
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("found"))


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; a folder that holds none yet is an empty ledger."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.range(0).select(F.from_json(F.lit(None).cast("string"), LEDGER).alias("row")).select("row.*")


def rules_address(rules: tuple[Rule, ...], label: str = RULE_VERSION) -> str:
    """The version that the ledger files findings under: the label and a digest of the rules, so changed rules never meet old findings."""
    return f"{label}-{hashlib.sha256(json.dumps(rules).encode()).hexdigest()[:32]}"


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> None:
    """Scan what the ledger lacks. ``versions``: (blob, text), any number of rows per blob.

    Blobs without finding are kept too (found is empty), so they aren't scanned again. A run that is repeated
    after a failure scans the same pairs and appends them once. Changed rules scan every blob again, whatever ``rule_version`` says.
    """
    version = rules_address(rules, rule_version)
    ledger = open_ledger(versions.sparkSession, path)
    seen = ledger.filter(F.col("rule_version") == version).select("blob")
    unseen = versions.join(seen, "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))
    found = findings_of_all(unseen, rules)
    found.withColumn("rule_version", F.lit(version)).write.mode("append").partitionBy("rule_version").parquet(path)


def findings_of_all(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """findings(), with a row for each blob in which nothing was found."""
    spans = findings(blobs, rules).select("blob", "found")
    none = blobs.select("blob", F.lit(None).cast(spans.schema["found"].dataType).alias("found"))
    both = spans.unionByName(none).groupBy("blob").agg(F.first("found", ignorenulls=True).alias("found"))
    return both.select("blob", F.size(F.coalesce("found", F.array())).cast("long").alias("n_found"), "found")


def secret_scan(
    versions: DataFrame,
    ledger_path: str,
    path_col: str = "path",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    rule_version: str = RULE_VERSION,
) -> DataFrame:
    """Every row of ``versions`` as (path, blob, found): the spans found in its content.

    Null or empty text: no span. Repeated rows and equal texts: scanned once, reported on every row. A null path
    stays null. An empty table gives no rows. ``found`` is null where nothing was found.
    """
    addressed = versions.select(
        F.col(path_col).alias("path"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        blob_address(F.col(text_col)).alias("blob"),
    )
    update_ledger(addressed.select("blob", "text"), ledger_path, rules, rule_version)
    ledger = open_ledger(versions.sparkSession, ledger_path).filter(F.col("rule_version") == rules_address(rules, rule_version))
    # only blobs with findings are worth a join; most rows then meet nothing
    hits = ledger.filter(F.col("n_found") > 0).select("blob", "found")
    return addressed.select("path", "blob").join(hits, "blob", "left").select("path", "blob", "found")


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: counts per kind, the spans, and their digest."""
    docs = table(spark, folder, "documents")
    scanned = secret_scan(docs, scratch_path(spark, "ledger"), path_col="doc_id")
    found = F.coalesce("found", F.array().cast("array<struct<start: int, place: int, kind: string, stop: int>>"))
    text = F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
    kinds = F.transform(found, lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}")
        for kind in ("assign", "access", "hex")
    ]
    return scanned.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans")
    )


# regexp flags and classes are spelt out: RE2 folds more letters than A-Z
_ASSIGN = (
    "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    "|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?"
)
SQL = {
    "op1_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS (
  SELECT rid, 0 AS place, 'assign' AS kind,
    unnest(regexp_split_to_array(t, '{_ASSIGN}[A-Za-z0-9+/_.=-]+')[1:-2]) AS gap,
    unnest(regexp_extract_all(t, '{_ASSIGN}[A-Za-z0-9+/_.=-]+')) AS m,
    unnest(regexp_extract_all(t, '{_ASSIGN}([A-Za-z0-9+/_.=-]+)', 1)) AS tested,
    generate_subscripts(regexp_extract_all(t, '{_ASSIGN}[A-Za-z0-9+/_.=-]+'), 1) AS i, 8 AS least FROM d
  UNION ALL
  SELECT rid, 1, 'access',
    unnest(regexp_split_to_array(t, 'AKIA[A-Z0-9]+')[1:-2]), unnest(regexp_extract_all(t, 'AKIA[A-Z0-9]+')),
    unnest(regexp_extract_all(t, 'AKIA[A-Z0-9]+')), generate_subscripts(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), 1), 16 FROM d
  UNION ALL
  SELECT rid, 2, 'hex',
    unnest(regexp_split_to_array(t, '[0-9a-f]{{32,}}')[1:-2]), unnest(regexp_extract_all(t, '[0-9a-f]{{32,}}')),
    unnest(regexp_extract_all(t, '[0-9a-f]{{32,}}')), generate_subscripts(regexp_extract_all(t, '[0-9a-f]{{32,}}'), 1), 32 FROM d
),
q AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, place ORDER BY i) AS stop FROM p),
s AS (SELECT rid, place, kind, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM q WHERE length(tested) >= least),
g AS (
  SELECT rid, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS b, count(*) FILTER (place = 2) AS c,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM s GROUP BY rid
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
}
