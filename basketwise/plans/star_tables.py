"""The driver's star-schema tables seen as customers, products, orders, chunks, reports and log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketwise.functions.expressions import let
from basketwise.sources.tables import ROW_SEQ, read_parquet


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("n_name").alias("city"),
            F.col("c_mktsegment").alias("acquisition_channel"),
        )
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("p_retailprice")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        (price * (30 + F.col("p_partkey") % 50) / 100).alias("cost_price"),
        price.alias("selling_price"),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line; an order has several lines, so distinct counts mean something."""
    line = table(spark, folder, "lineitem")
    head = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    status = (
        F.when(F.col("l_returnflag") == "R", "Returned")
        .when(F.col("o_orderstatus") == "P", "Cancelled")
        .otherwise("Completed")
    )
    return line.join(head, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_discount") * 100).alias("discount_pct"),
        status.alias("order_status"),
    )


def raw_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as text before validation, with faults told by the account balance."""
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    rows = read_parquet(spark, f"{folder}/customer.parquet")
    balance = F.col("c_acctbal")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int"))
    return rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.when(balance < -900, "not-a-date").otherwise(day.cast("string")).alias("signup_date"),
        F.col("n_name").alias("city"),
        F.when(balance < 9800, F.lit("25-34")).alias("age_group"),
        F.col("c_mktsegment").alias("acquisition_channel"),
        F.col("c_name").alias("remark"),
        ROW_SEQ,
    )


def raw_products(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_parquet(spark, f"{folder}/part.parquet")
    price = F.col("p_retailprice")
    return rows.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        F.when(F.col("p_size") == 50, "-1")
        .otherwise((price * 6 / 10).cast("decimal(18,4)").cast("string"))
        .alias("cost_price"),
        F.when(F.col("p_size") != 49, price.cast("decimal(18,4)").cast("string")).alias("selling_price"),
        F.lit("2019-06-01").alias("launch_date"),
        ROW_SEQ,
    )


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as text before validation; order and line number repeat, other faults are told by the tax."""
    line = read_parquet(spark, f"{folder}/lineitem.parquet")
    head = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"
    )
    number, tax = F.col("l_linenumber"), F.round(F.col("l_tax") * 100)
    quantity = F.col("l_quantity").cast("decimal(18,2)").cast("string")
    price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(32,8)").cast("string")
    discount = (F.col("l_discount") * 100).cast("decimal(18,2)").cast("string")
    status = (
        F.when((tax == 0) & (number == 2), "Shipped")
        .when(F.col("l_returnflag") == "R", "Returned")
        .when(F.col("o_orderstatus") == "P", "Cancelled")
        .otherwise("Completed")
    )
    return line.join(head, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.when((F.col("o_orderpriority") == "5-LOW") & (number == 3), "not-a-date")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("order_date"),
        F.when((tax == 8) & (number == 7), F.concat(F.lit("-"), quantity)).otherwise(quantity).alias("quantity"),
        F.when((tax == 7) & (number == 6), "free").otherwise(price).alias("unit_price"),
        F.when(~((tax == 6) & (number == 1)), discount).alias("discount_pct"),
        status.alias("order_status"),
        ROW_SEQ,
    )


def uploaded_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as users write them: four forms of dates, and prices that are no amounts."""
    day, tax, number = F.col("l_shipdate"), F.round(F.col("l_tax") * 100), F.col("l_linenumber")
    return read_parquet(spark, f"{folder}/lineitem.parquet").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("order_id"),
        F.col("l_suppkey").cast("string").alias("customer_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.when(number % 4 == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(number % 4 == 2, F.date_format(day, "yyyy/MM/dd"))
        .when(number % 4 == 3, F.date_format(day, "MMM d yyyy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
        .alias("order_date"),
        F.lit("1").alias("quantity"),
        F.when(tax == 8, "1e400").when(tax == 7, "1e300").otherwise("12.5").alias("unit_price"),
        F.lit("0").alias("discount_pct"),
        F.lit("Completed").alias("order_status"),
        ROW_SEQ,
    )


def dated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Ship dates as text in three columns: the day first, the month first, and days up to the twelfth only."""
    day = F.col("l_shipdate")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") == 7, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd/MM/yyyy")).alias("day_first"),
        F.when(F.col("l_linenumber") == 6, "31-31-2024").otherwise(F.date_format(day, "M-d-yyyy")).alias("month_first"),
        F.when(F.dayofmonth(day) <= 12, F.date_format(day, "d.M.yyyy")).alias("either"),
    )


def day_first_customers(spark: SparkSession, folder: str) -> DataFrame:
    """raw_customers as a European export has them."""
    raw = raw_customers(spark, folder)
    day = F.try_to_timestamp(F.col("signup_date"), F.lit("yyyy-MM-dd"))
    return raw.withColumn("signup_date", F.coalesce(F.date_format(day, "dd.MM.yyyy"), F.col("signup_date")))


def undecided_products(spark: SparkSession, folder: str) -> DataFrame:
    """raw_products with a date that could be in June or in January."""
    return raw_products(spark, folder).withColumn("launch_date", F.lit("06/01/2019"))


#: Which of two lines with one order_id comes first.
RAW_ORDER_COLS = ["product_id", "quantity", "unit_price", "discount_pct", "order_status"]


# --- corpus ---------------------------------------------------------------------------------


def markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text): every document as Markdown, its lines as paragraphs of the second of three sections."""
    doc = table(spark, folder, "documents")
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return doc.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source"),
        F.concat(
            F.lit("Note "), F.col("doc_id").cast("string"), F.lit("\n\n## "), F.col("source"), F.lit("\n\n"),
            body, F.lit("\n\n## Language\n\n"), F.col("lang"),
        ).alias("text"),
    )


def manifest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The same documents, with very short ones blank."""
    doc = table(spark, folder, "documents")
    return doc.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source"),
        F.when(F.col("n_chars") < 100, " \n ").otherwise(F.col("text")).alias("text"),
    )


def expected_sources(spark: SparkSession, folder: str) -> DataFrame:
    """What the corpus should hold: all labelled documents and all benchmark items."""
    labelled = table(spark, folder, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    items = table(spark, folder, "benchmark").select(F.concat(F.lit("item_"), F.col("item_id").cast("string")))
    return labelled.union(items).toDF("source").distinct()


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, embedding)"""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def sourced_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, source, embedding): a vector belongs to the document of its number."""
    doc = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source")
    return vectors(spark, folder).join(doc, "id", "left")


def chunk_table(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "source", F.col("doc_id").cast("int").alias("chunk_index"), "text"
    )


def topics(spark: SparkSession, folder: str) -> DataFrame:
    """(topic, topic_order, embedding): the mean vector of every label."""
    parts = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # one row per component: 64 per label
    return (
        means.groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("parts"))
        .select(
            F.concat(F.lit("label_"), F.col("label").cast("string")).alias("topic"),
            F.col("label").alias("topic_order"),
            F.col("parts.x").alias("embedding"),
        )
    )


# --- reports and log ------------------------------------------------------------------------


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """(report_id, raw, known_sources): one machine-written report per document, with faults told by its source."""
    doc = table(spark, folder, "documents")
    lang, source = F.col("lang"), F.col("source")

    def quoted(value):
        """A text as JSON string."""
        return let(F.to_json(F.struct(value.alias("t"))), lambda j: F.substring(j, 6, F.length(j) - 6))

    def is_one(*names: str):
        return source.isin(*names)

    text = quoted(F.col("text"))
    item = F.concat(
        F.lit('{"title": "Push '), source, F.lit('", "description": '), text,
        F.lit(', "supporting_metric": '), F.col("n_chars").cast("string"),
        F.lit(', "policy_reference": "'), lang, F.lit('_policy", "estimated_impact": null}'),
    )
    revenue = F.when(is_one("src4"), item).otherwise(F.concat(F.lit("["), item, F.lit(", 5]")))
    growth = F.when(is_one("src5"), F.lit('"none"')).otherwise(
        F.concat(F.lit('[{"title": "", "action": "Call '), lang,
                 F.lit('", "rationale": "", "policy_reference": "'), source, F.lit('"}]'))
    )
    actions = F.concat(
        F.lit('[{"action": "Review '), source, F.lit('", "rationale": '), text,
        F.lit(', "policy_reference": "", "priority": "High"}]'),
    )
    body = F.concat(
        F.lit('{"executive_summary": '),
        F.when(is_one("src6"), F.lit('"  "')).otherwise(text),
        F.lit(', "revenue_opportunities": '), revenue,
        F.lit(', "customer_growth_opportunities": '), growth,
        F.when(is_one("src7"), F.lit("")).otherwise(F.lit(', "product_opportunities": []')),
        F.lit(', "risks": [{"risk": "r", "description": "d"}], "recommended_actions": '), actions,
        F.when(is_one("src8"), F.lit(', "notes": 1, "author": "x"}')).otherwise(F.lit("}")),
    )
    raw = (
        F.when(is_one("src1"), F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(is_one("src2"), F.concat(F.lit("Here it is: "), body, F.lit(" Hope it helps.")))
        .when(is_one("src3"), F.concat(F.lit("No report: {"), F.substring_index(F.col("text"), "{", 1)))
        .when(is_one("src9"), F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(body)
    )
    known = F.array(F.lit("en_policy"), F.lit("de_policy"), F.lit("src10"))
    return doc.select(F.col("doc_id").alias("report_id"), raw.alias("raw"), known.alias("known_sources"))


def action_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as action records; event_id is the position in the log. Odd ones are written in another zone."""
    there = F.date_format(F.col("ts") + F.expr("INTERVAL 5 HOURS 30 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+05:30'")
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("reference_id"),
        F.concat(F.lit("Offer "), F.col("event_type")).alias("recommendation"),
        F.col("props").alias("reason"),
        (F.col("event_type") != "error").alias("merchant_approved"),
        F.lit(499).alias("amount_inr"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("link_"), F.col("event_id").cast("string")))
        .alias("payment_link_id"),
        F.col("event_type").alias("result"),
        F.when(F.col("event_id") % 2 == 1, there)
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")).alias("timestamp"),
        "event_id",
    )


def status_updates(spark: SparkSession, folder: str) -> DataFrame:
    """One status per customer; the log knows only some of them."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("reference_id"),
        F.when(F.col("c_acctbal") >= 0, "paid").alias("result"),
        F.concat(F.lit("link_of_"), F.col("c_name")).alias("payment_link_id"),
        F.lit("2024-06-01T00:00:00+00:00").alias("status_checked_at"),
        F.lit("card").alias("payment_method"),  # a field the log doesn't have
    )


def refunds(spark: SparkSession, folder: str) -> DataFrame:
    """Later updates of customers in debt: another result and a field of their own, and no other field."""
    return table(spark, folder, "customer").filter("c_acctbal < 1000").select(
        F.col("c_custkey").cast("string").alias("reference_id"),
        F.lit("refunded").alias("result"),
        F.lit("2024-07-01T00:00:00+00:00").alias("status_checked_at"),
        F.struct(F.col("c_nationkey").alias("nation")).alias("refund"),
    )
