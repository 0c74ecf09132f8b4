import pytest
from pyspark.sql import functions as F

from basketwise.functions import durable as durable_module
from basketwise.functions.durable import join_keyed, measured_size
from basketwise.functions.expressions import money
from basketwise.operators import quality
from basketwise.operators.facts import prepare_order_lines
from basketwise.operators.quality import validate
from basketwise.plans import registry
from basketwise.plans.load import load_all
from basketwise.sources.tables import ROW_SEQ, read_csv, read_dataset

CUSTOMER = "customer_id string, signup_date string, city string, age_group string, acquisition_channel string"
ORDER = (
    "order_id string, customer_id string, product_id string, order_date string, quantity string, "
    "unit_price string, discount_pct string, order_status string"
)
PRODUCT = (
    "product_id string, product_name string, category string, sub_category string, cost_price string, "
    "selling_price string, launch_date string"
)


def customers(spark, *ids, date="2024-03-01"):
    return spark.createDataFrame([(i, date, "Lyon", "25-34", "Email") for i in ids], CUSTOMER)


def order(order_id="A1", customer="K1", product="W1", date="2024-03-05", qty="2", price="9.5", disc="0",
          status="Completed"):
    return (order_id, customer, product, date, qty, price, disc, status)


def orders(spark, *rows):
    return spark.createDataFrame(list(rows), ORDER)


def record(validation):
    return validation.summary.first().asDict(recursive=True)


def test_good_rows_pass(spark):
    v = validate(customers(spark, "K1", "K2"), "customers")
    assert record(v) == {
        "dataset": "customers", "is_valid": True, "total_rows": 2, "invalid_rows_dropped": 0,
        "duplicate_rows_dropped": 0, "missing_values": {}, "errors": [], "warnings": [],
    }
    assert v.is_valid() and v.clean.count() == 2 and v.quarantine.count() == 0


def test_missing_columns_stop_validation(spark):
    v = validate(spark.createDataFrame([("K1", "Lyon")], "customer_id string, city string"), "customers")
    r = record(v)
    assert not r["is_valid"] and r["total_rows"] == 1 and v.clean is None
    assert r["errors"] == ["Missing required columns: ['signup_date', 'age_group', 'acquisition_channel']"]


def test_unknown_dataset_is_an_error(spark):
    with pytest.raises(ValueError):
        validate(customers(spark, "K1"), "suppliers")


def test_low_quantity_and_unreadable_date(spark):
    v = validate(orders(spark, order(), order("A2", qty="-5"), order("A3", date="soon")), "orders")
    r = record(v)
    assert r["invalid_rows_dropped"] == 2 and not r["is_valid"]
    assert r["errors"] == ["More than 50% of rows (2/3) failed validation."]
    assert r["warnings"] == [
        "Column 'order_date': 1 value(s) could not be parsed as date and were flagged invalid.",
        "Column 'quantity': 1 value(s) below minimum allowed value (1).",
    ]
    assert [x.order_id for x in v.clean.collect()] == ["A1"]
    problems = {x.order_id: x.problems for x in v.quarantine.collect()}
    assert problems == {"A2": ["quantity below minimum"], "A3": ["order_date unreadable"]}


def test_coercion_and_rule_counts(spark):
    frame = orders(spark, order(), order("A2", date="soon", price="free"), order("A3", qty="0", status="Shipped"))
    rows = quality.coerce_columns(frame, "orders").orderBy("order_id").collect()
    assert [r.unreadable for r in rows] == [[], ["order_date", "unit_price"], []]
    assert rows[1].order_date is None and rows[0].unit_price == 9.5
    counts = {r["rule"]: r["rows"] for r in quality.rule_counts(validate(frame, "orders")).collect()}
    assert counts == {
        "unreadable_order_date": 1, "unreadable_unit_price": 1, "below_quantity": 1, "outside_order_status": 1
    }


def test_exactly_half_invalid_is_still_valid(spark):
    assert validate(orders(spark, order(), order("A2", qty="0")), "orders").is_valid()


def test_status_outside_the_set_is_case_sensitive(spark):
    v = validate(orders(spark, order(), order("A2", status="completed"), order("A3", status="Returned")), "orders")
    r = record(v)
    assert r["invalid_rows_dropped"] == 1
    assert r["warnings"] == [
        "Column 'order_status': 1 value(s) outside allowed set ('Completed', 'Cancelled', 'Returned')."
    ]


def test_numbers(spark):
    texts = {"1.5": True, " 2 ": True, "1e2": True, "2d": False, "3f": False, "NaN": False, "x": False, "0.99": False}
    rows = [order(f"A{i}", qty=t) for i, t in enumerate(texts)]
    clean = validate(orders(spark, *rows), "orders").clean
    kept = {x.order_id for x in clean.collect()}
    assert kept == {f"A{i}" for i, good in enumerate(texts.values()) if good}
    assert clean.schema["quantity"].dataType.simpleString() == "double"


def test_foreign_keys_use_cleaned_parents(spark):
    parents = {
        "customers": customers(spark, "K1"),
        "products": spark.createDataFrame([("W1", "w", "c", "s", "1", "2", "2023-01-01")], PRODUCT),
    }
    v = validate(orders(spark, order(), order("A2", customer="K9"), order("A3", customer=None)), "orders", parents)
    r = record(v)
    assert [x.order_id for x in v.clean.collect()] == ["A1"]
    assert r["invalid_rows_dropped"] == 2 and r["missing_values"] == {"customer_id": 1}
    assert "Column 'customer_id': 2 value(s) do not match any 'customer_id' in customers." in r["warnings"]


def test_foreign_key_is_skipped_without_parent_or_its_key(spark):
    parents = {"customers": spark.createDataFrame([("x",)], "other string")}
    assert record(validate(orders(spark, order()), "orders", parents))["warnings"] == []


def test_duplicates_keep_the_first_row(spark):
    frame = customers(spark, "K1", "K1", "K2").withColumn("age_group", F.lit("25-34"))
    v = validate(frame, "customers")
    r = record(v)
    assert r["duplicate_rows_dropped"] == 1 and v.clean.count() == 2
    assert r["warnings"] == ["1 duplicate 'customer_id' value(s) found; keeping first occurrence only."]


def test_invalid_first_row_takes_its_duplicates_along(spark):
    v = validate(orders(spark, order(qty="0"), order(), order("A2")), "orders")
    assert [x.order_id for x in v.clean.collect()] == ["A2"]


def test_order_columns_decide_which_row_is_first(spark):
    frame = orders(spark, order(price="5"), order(price="3"), order(price="4"))
    v = validate(frame, "orders", order_cols=["unit_price"])
    assert [x.unit_price for x in v.clean.collect()] == [3.0]


def test_null_keys_equal_each_other(spark):
    v = validate(customers(spark, None, None, None, "K1", "K2", "K3", "K4"), "customers")
    r = record(v)
    assert v.quarantine.count() == 3
    assert r["duplicate_rows_dropped"] == 2 and r["invalid_rows_dropped"] == 3
    assert r["missing_values"] == {"customer_id": 3} and v.clean.count() == 4


def test_keeping_invalid_rows(spark):
    v = validate(orders(spark, order(), order("A2", qty="0")), "orders", drop_invalid=False)
    assert v.clean.count() == 2 and record(v)["invalid_rows_dropped"] == 1


def test_no_rows_left(spark):
    v = validate(orders(spark, order(qty="0")), "orders")
    assert record(v)["errors"] == ["No valid rows remained after validation."]


def test_extra_columns_are_named_and_dropped(spark):
    v = validate(customers(spark, "K1").withColumn("note", F.lit(1)), "customers")
    assert record(v)["warnings"] == ["Ignoring unexpected extra columns: ['note']"]
    assert "note" not in v.clean.columns


def test_missing_profile_and_projection(spark):
    frame = orders(spark, order(qty=None), order("A2", qty=None, disc=None), order("A3")).withColumn("z", F.lit(1))
    profile = {r["column"]: r["missing"] for r in quality.missing_value_profile(frame, "orders").collect()}
    assert profile == {"quantity": 2, "discount_pct": 1}
    assert quality.project_contract_columns(frame, "orders").columns == ORDER.replace(" string", "").split(", ")


def skewed(spark):
    """A third of 3,000 rows has one key, the rest few rows each."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string")))
    return spark.range(3000).select(key.alias("key"), "id")


@pytest.mark.parametrize("limit", [64 * 1024 * 1024, 0])
def test_duplicates_of_a_hot_key(spark, monkeypatch, limit):
    monkeypatch.setattr(durable_module, "BROADCAST_BYTES", limit)
    flagged = quality.duplicate_key_check(skewed(spark), "key", ["id"])
    firsts = flagged.filter(~F.col("_duplicate"))
    want = skewed(spark).groupBy("key").agg(F.min("id").alias("id"))
    assert flagged.count() == 3000
    assert sorted(firsts.select("key", "id").collect()) == sorted(want.collect())


@pytest.mark.parametrize("limit", [64 * 1024 * 1024, 0])
def test_join_keyed_keeps_every_row(spark, monkeypatch, limit):
    monkeypatch.setattr(durable_module, "BROADCAST_BYTES", limit)
    left = skewed(spark).unionByName(spark.range(500).select(F.lit(None).cast("string").alias("key"), "id"))
    keyed = left.groupBy("key").agg(F.max("id").alias("top")).filter("key <> 'k5'")
    joined = join_keyed(left, keyed, "key").select("key", "id", "top")
    plain = left.join(keyed, "key", "left").select("key", "id", "top")
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, plain.collect()))
    assert joined.filter("key is null and top is null").count() == 500


@pytest.mark.parametrize("limit", [64 * 1024 * 1024, 0])
def test_validation_reads_its_source_once(spark, monkeypatch, limit):
    monkeypatch.setattr(durable_module, "BROADCAST_BYTES", limit)
    loaded = registry._loaded(spark, "/root/testdata/sf0.001")
    clean = loaded.tables["orders"]
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem") <= 3 and plan.count("Exchange") <= 10
    counts = loaded.validations["orders"].metrics.first()
    assert clean.count() == counts.clean_rows > 0


def test_measured_size(spark):
    rows, size = measured_size(spark.range(10).select(F.repeat(F.lit("x"), 100).alias("t")))
    assert rows == 10 and size >= 1000
    assert measured_size(spark.range(0)) == (0, 0)


def test_broadcast_only_what_is_small(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    small = spark.range(10).select("id", F.lit("x").alias("t"))
    assert "strategy=broadcast" in plan(spark.range(5).join(durable_module.broadcast_table(small), "id"))
    monkeypatch.setattr(durable_module, "BROADCAST_BYTES", 100)
    assert "strategy=broadcast" not in plan(spark.range(5).join(durable_module.broadcast_table(small), "id"))
    assert "strategy=broadcast" not in plan(spark.range(5).join(durable_module.broadcast_if_small(small), "id"))


def test_csv_reading(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(
        'customer_id,signup_date,city,age_group,acquisition_channel\n'
        '001,2024-01-01,"New\nTown, ""East""",NA,Email\n'
        '002,,null,25-34, None\n'
    )
    rows = read_csv(spark, str(path), multi_line=True).orderBy(ROW_SEQ).collect()
    assert [r.customer_id for r in rows] == ["001", "002"]  # text stays text
    assert rows[0].city == 'New\nTown, "East"' and rows[0].age_group is None
    assert rows[1].signup_date is None and rows[1].city is None and rows[1].acquisition_channel == " None"


def test_csv_position_is_the_file_order(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(ORDER.replace(" string", "").replace(" ", "") + "\n" + "\n".join(
        ",".join(order(f"A{i % 5}", price=str(i + 1))) for i in range(40)) + "\n")
    for multi_line in (True, False):
        v = validate(read_csv(spark, str(path), multi_line), "orders")
        assert sorted(x.unit_price for x in v.clean.collect()) == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_load_all(spark, tmp_path):
    customers(spark, "K1", "K2").coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    spark.createDataFrame([("W1", "w", "c", "s", "1", "2", "2023-01-01")], PRODUCT).write.parquet(
        str(tmp_path / "p.parquet")
    )
    orders(spark, order(), order("A2", customer="K7"), order("A3")).coalesce(1).write.option("header", True).csv(
        str(tmp_path / "o")
    )
    paths = {"customers": f"{tmp_path}/c", "products": f"{tmp_path}/p.parquet", "orders": f"{tmp_path}/o"}
    loaded = load_all(spark, paths)
    assert loaded.is_valid()
    assert {(r["dataset"], r["rows"], r["is_valid"]) for r in loaded.row_counts().collect()} == {
        ("customers", 2, True), ("products", 1, True), ("orders", 2, True)
    }
    assert loaded.summary().count() == 3
    assert ROW_SEQ in read_dataset(spark, paths["products"]).columns


def test_csv_columns_are_told_by_name(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    (folder / "a.csv").write_text("customer_id,city\nK1,Delhi\n")
    (folder / "b.csv").write_text("city,customer_id,note\nPune,K2,x\n")
    (folder / "c.csv").write_text("")
    rows = read_dataset(spark, str(folder)).orderBy("customer_id").collect()
    assert [(r.customer_id, r.city, r.note) for r in rows] == [("K1", "Delhi", None), ("K2", "Pune", "x")]


def test_the_form_of_a_dataset_is_not_guessed(spark, tmp_path):
    customers(spark, "K1").write.parquet(f"{tmp_path}/plain")
    assert read_dataset(spark, f"{tmp_path}/plain").count() == 1
    (tmp_path / "odd.txt").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="form"):
        read_dataset(spark, f"{tmp_path}/odd.txt")
    assert read_dataset(spark, f"{tmp_path}/odd.txt", form="csv").columns[:2] == ["a", "b"]


def test_uploaded_dates_and_numbers(spark):
    dates = ["2024-01-15", "01/15/2024", "2024/01/16", "Jan 17 2024", "17 January 2024", "15.1", "1/15/2024 10:30"]
    rows = [order(f"A{i}", date=d) for i, d in enumerate(dates)] + [order("B1", price="1e400"), order("B2", price="1e300")]
    v = validate(orders(spark, *rows), "orders")
    assert {r.order_id for r in v.quarantine.collect()} == {"A5", "B1", "B2"}
    lines = prepare_order_lines(orders(spark, *rows))
    assert {r.order_id for r in lines.collect()} == {f"A{i}" for i in range(7) if i != 5} | {"B1", "B2"}
    assert lines.agg(F.sum(money(lines, "revenue"))).first()[0] is not None


def test_first_rows_are_told_by_bits(spark, tmp_path):
    """Half of the keys repeat: the rows are neither joined by key nor shuffled with all their columns."""
    from basketwise.functions import durable

    rows = spark.range(100_000).select(
        F.when(F.col("id") % 10 > 0, F.concat(F.lit("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40_000))).alias("key"),
        (-F.col("id")).alias("n"),
        F.col("id").alias("_row_seq"),
    )
    limit, durable.BROADCAST_BYTES = durable.BROADCAST_BYTES, 1 << 20  # far less than the repeated keys
    try:
        flagged = quality.duplicate_key_check(rows, "key", ["n"])
    finally:
        durable.BROADCAST_BYTES = limit
    assert "SortMergeJoin" not in flagged._jdf.queryExecution().executedPlan().toString()
    firsts = rows.filter("key is not null").groupBy("key").agg(F.min("n").alias("n")).withColumn("first", F.lit(True))
    wrong = flagged.join(firsts, ["key", "n"], "left").filter("_duplicate != (key is not null and first is null)")
    assert wrong.count() == 0 and flagged.count() == 100_000
    assert flagged.filter("not _duplicate").count() == firsts.count() + rows.filter("key is null").count()


def test_numbers_and_dates_are_read_once(spark, monkeypatch):
    """The scan that is kept names each reading of a text once, however many checks look at it."""
    plans, keep = {}, quality.kept_table

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, label)

    monkeypatch.setattr(quality, "kept_table", noted)
    rows = [("o1", "c", "p", "2024-01-02", "1", "1.5", "0", "Completed"), ("o2", "c", "p", "Jan 3 2024", "1", "1.5d", "0", "Completed"),
            ("o3", "c", "p", "never", "1", "x", "0", "Completed")]
    names = "order_id customer_id product_id order_date quantity unit_price discount_pct order_status".split()
    flagged = quality.validate(spark.createDataFrame(rows, names), "orders").flagged.orderBy("order_id").collect()
    assert [(r.unit_price, r._unreadable_unit_price, r._unreadable_order_date) for r in flagged] == [
        (1.5, False, False), (None, True, False), (None, True, True)
    ]
    assert plans["orders-scanned"].count("MMMM d yyyy") == 1
