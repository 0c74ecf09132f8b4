"""URL filters: a sorted sweep over reversed-host keys with a stack of active nested rules.

A rule (host, path) fits a url whose host is the rule's or a subdomain of it and whose path starts with the
rule's. Written in reversed order of labels, ``com.example.`` starts the key of every host below example.com, so
a rule's host is an interval of keys; within one host, a path prefix is an interval of paths. Two intervals of
either kind are nested or apart, so a sweep in key order has the active ones on a stack. Expressions only.

The stack needs no state of its own: an interval that opens at depth d is the d-th from below until one opens at
depth d again. So the d-th active interval of a point is the last one opened at depth d before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketwise.llm.store import last_seen, range_parts, running_sum, table

#: Upper and lower case of A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sorts before every other character; stands after each label, so that a host sorts before those below it.
LABEL_END = "\x01"
#: Comes after every text that starts with the key before it.
LAST = "\U0010ffff\U0010ffff"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null and for texts without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def host_key(host: Column) -> Column:
    """The labels in reversed order, each with its end mark; example.com gives com|example|."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), LABEL_END), F.lit(LABEL_END))


def active_intervals(points: DataFrame, prefixes: DataFrame, innermost: bool) -> DataFrame:
    """For each point the prefixes its key starts with: (point, prefix), all of them or the longest only.

    ``points``: (point, key), ``prefixes``: (prefix, key), both unique. One sort by range over points and interval
    ends gives the depth at each point, a second one by (depth, key) the interval on the stack at that depth.
    Neither groups by a key, so a host or prefix with a third of all points is spread like any other.
    """
    none = F.lit(None).cast("long")
    opens = prefixes.select("key", F.lit(1).alias("kind"), F.col("prefix").alias("id"), F.lit(1).alias("step"))
    closes = prefixes.select(
        F.concat("key", F.lit(LAST)).alias("key"), F.lit(0).alias("kind"), F.col("prefix").alias("id"), F.lit(-1).alias("step")
    )
    marks = points.select("key", F.lit(2).alias("kind"), F.col("point").alias("id"), F.lit(0).alias("step"))
    order = ["key", "kind", "id"]
    swept = running_sum(range_parts(opens.unionByName(closes).unionByName(marks), order), order, "step", "depth")
    swept = swept.filter((F.col("kind") > 0) & (F.col("depth") > 0))
    if innermost:
        deep = swept
    else:
        every = F.when(F.col("kind") == 2, F.sequence(F.lit(1).cast("long"), F.col("depth"))).otherwise(F.array("depth"))
        deep = swept.withColumn("depth", F.explode(every))
    opened = F.when(F.col("kind") == 1, F.col("id")).otherwise(none)
    order = ["depth", *order]
    levels = range_parts(deep.select("depth", "key", "kind", "id", opened.alias("opened")), order)
    stacked = last_seen(levels, order, "opened", "prefix").filter(F.col("kind") == 2)
    return stacked.select(F.col("id").alias("point"), "prefix")


def numbered(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of the columns with a number each, the same on every run."""
    return df.select(*columns).distinct().withColumn("id", F.xxhash64(*columns))


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str, url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: (id, host, path, rule, verdict).

    ``rules``: (host, path, verdict). Of the rules that fit, the longest (host and path together) wins, then the one
    with the longer host. Rules with equal host and path count as one that blocks if any of them does; rules with a
    null host or path fit nothing. Where no rule fits, ``rule`` is null and the verdict is ``default``. Null urls and
    texts without ``://`` have an empty host and path. Repeated rows are judged alike; empty tables give no rows.
    """
    parts = urls.select(
        F.col(id_col).alias("_row"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    rules = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))
    )
    pairs = numbered(parts, "host", "path").withColumnRenamed("id", "page")

    # which rule hosts lie above each host
    hosts = numbered(parts.filter(F.col("host") != ""), "host")
    rule_hosts = numbered(rules, "rule_host")
    above = active_intervals(
        hosts.select(F.col("id").alias("point"), host_key(F.col("host")).alias("key")),
        rule_hosts.select(F.col("id").alias("prefix"), host_key(F.col("rule_host")).alias("key")),
        innermost=False,
    )
    host_rules = (
        above.join(hosts.select(F.col("id").alias("point"), "host"), "point")
        .join(rule_hosts.select(F.col("id").alias("prefix"), "rule_host"), "prefix")
        .select("host", "rule_host")
    )

    # under each of them, the longest rule path that the url's path starts with
    under = pairs.join(host_rules, "host").withColumn("point", F.xxhash64("page", "rule_host"))
    paths = numbered(rules, "rule_host", "rule_path")
    end = F.lit(LABEL_END + LABEL_END)
    best = active_intervals(
        under.select("point", F.concat("rule_host", end, "path").alias("key")),
        paths.select(F.col("id").alias("prefix"), F.concat("rule_host", end, "rule_path").alias("key")),
        innermost=True,
    )
    fitting = (
        best.join(under.select("point", "page"), "point")
        .join(paths.select(F.col("id").alias("prefix"), "rule_host", "rule_path"), "prefix")
        .join(rules, ["rule_host", "rule_path"])
    )
    size = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    rule = F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    won = fitting.groupBy("page").agg(F.max_by(rule, size).alias("won"))
    judged = pairs.join(won, "page").select("host", "path", "won")
    return parts.join(judged, ["host", "path"], "left").select(
        F.col("_row").alias(id_col),
        "host",
        "path",
        F.col("won.rule").alias("rule"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
    )


#: The rules of the query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url with the rule that decides and the verdict."""
    rules = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS rules(host, path, verdict)")
    return judge_urls(table(spark, folder, "pages"), rules, "page_id")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = {
    "op6_url_filter": f"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(h, p, v) AS (VALUES {_VALUES}),
f AS (SELECT rid, h || p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (rid)
"""
}
