"""Roll-ups by day: equal to a full run, and cheap to refresh."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from basketwise.plans import bundle, rollups, star_tables as star

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def tables(spark):
    return star.customers(spark, FOLDER), star.products(spark, FOLDER), star.orders(spark, FOLDER)


def last_days(orders, n):
    last = orders.agg(F.max(F.col("order_date").cast("date"))).first()[0]
    return [last - dt.timedelta(days=k) for k in range(n)]


def test_all_results_equal_the_full_run(spark, tables, tmp_path):
    customers, products, orders = tables
    days = last_days(orders, 3)
    store = rollups.DayRollups(spark, f"{tmp_path}/r")
    store.refresh(orders.filter(~rollups.within(F.col("order_date"), days)), products)
    assert store.refresh(orders, products, days) == 2
    assert store.refresh(orders, products, days[:1]) == 3  # again: nothing is counted twice
    full, merged = bundle.full_analysis(customers, products, orders), store.analysis(customers, products)
    assert set(full) == set(merged)
    for name in full:
        assert rows(merged[name]) == rows(full[name]), name


@pytest.fixture
def by_day(spark, tmp_path):
    """Orders of three days in two months, partitioned by their date."""
    data = [
        (f"o{d}{i % 2}", f"c{i % 3}", f"p{i % 2}", dt.date(2024, 1, 30) + dt.timedelta(days=d), float(i + 1), 2.5, 0.0, ("Completed", "Returned")[i % 4 == 3])
        for d in (1, 2, 3) for i in range(6)
    ]
    columns = "order_id string, customer_id string, product_id string, order_date date, quantity double, unit_price double, discount_pct double, order_status string"
    orders = spark.createDataFrame(data, columns)
    path = f"{tmp_path}/orders"
    orders.write.partitionBy("order_date").parquet(path)
    products = spark.createDataFrame([("p0", "n", "cat", "s", 1.0, 2.0)], "product_id string, product_name string, category string, sub_category string, cost_price double, selling_price double")
    return path, spark.read.schema(orders.schema).parquet(path), products


def test_one_day_reads_its_own_lines_only(spark, by_day, tmp_path):
    path, orders, products = by_day
    store = rollups.DayRollups(spark, f"{tmp_path}/r")
    store.refresh(orders, products)
    before = store.manifest()["months"]
    for file in glob.glob(f"{path}/order_date=2024-01-31/*.parquet") + glob.glob(f"{path}/order_date=2024-02-02/*.parquet"):
        os.truncate(file, 10)  # whoever reads these fails
    store.refresh(orders, products, [dt.date(2024, 2, 1)])
    after = store.manifest()["months"]
    for name in before:
        assert {m for m in before[name] if before[name][m] != after[name][m]} == {"2024-02"}
    assert store.read("by_order").agg(F.sum("line_count")).first()[0] == 18
    with pytest.raises(Exception):
        store.refresh(orders, products, [dt.date(2024, 1, 31)])
    assert store.manifest()["months"] == after  # a failed refresh leaves all as it was


def test_a_day_that_lost_its_lines_is_empty(spark, by_day, tmp_path):
    _, orders, products = by_day
    store = rollups.DayRollups(spark, f"{tmp_path}/r")
    store.refresh(orders, products)
    left = orders.filter("order_date not in ('2024-01-31', '2024-02-01')")
    store.refresh(left, products, [dt.date(2024, 1, 31), dt.date(2024, 2, 1)])
    assert sorted(store.manifest()["months"]["by_order"]) == ["2024-02"]
    assert [r[0] for r in store.read("by_order").select("day").distinct().collect()] == [dt.date(2024, 2, 2)]
    assert store.read("by_product", 1).count() > store.read("by_product").count()  # the version before is still there


def test_no_lines_at_all(spark, by_day, tmp_path):
    _, orders, products = by_day
    store = rollups.DayRollups(spark, f"{tmp_path}/r")
    with pytest.raises(ValueError):
        store.read("by_order")
    store.refresh(orders.limit(0), products)
    customers = spark.createDataFrame([], "customer_id string, acquisition_channel string")
    assert store.analysis(customers, products, ("executive_kpis",))["executive_kpis"].first().total_orders == 0


def test_spans_join_days_that_follow_each_other():
    day = dt.date(2024, 2, 28)
    days = [day + dt.timedelta(days=k) for k in (2, 0, 1, 5, 5)]
    assert rollups.spans(days) == [(day, dt.date(2024, 3, 2)), (dt.date(2024, 3, 4), dt.date(2024, 3, 5))]
    assert rollups.spans([]) == []


def test_merged_sets_count_distinct_ids(spark, by_day):
    from basketwise.functions import id_sets
    from basketwise.operators import sales

    _, orders, _ = by_day
    orders = orders.unionByName(orders.withColumn("customer_id", F.lit(None).cast("string")))
    sets = sales.day_sets(orders)
    for period in (F.date_format("day", "yyyy-MM"), F.col("day").cast("string"), F.lit("all")):
        got = sales.distinct_by_period(sets, period)
        assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
        day = orders.withColumn("day", F.col("order_date"))
        want = day.groupBy(period.alias("period")).agg(F.count_distinct("order_id"), F.count_distinct("customer_id"))
        assert rows(got.toDF(*"abc")) == rows(want.toDF(*"abc"))
    many = spark.range(100_000).select((F.col("id") * 7 % 100_003).alias("id"), (F.col("id") % 3).alias("k"))
    numbers = id_sets.number_ids(many, "id")
    assert numbers.agg(F.min("_number"), F.max("_number"), F.count_distinct("_number")).first()[:] == (0, 99_999, 100_000)
    counts = id_sets.count_members(id_sets.id_sets(many.join(numbers, "id"), ["k"]), ["k"], "n")
    assert {r.k: r.n for r in counts.collect()} == {0: 33_334, 1: 33_333, 2: 33_333}
    assert sales.distinct_by_period(sales.day_sets(orders.limit(0)), F.lit("all")).count() == 0


def test_a_query_costs_and_sees_the_same_whatever_ran_before(spark, tmp_path):
    from basketwise.plans import registry

    lineitem = star.table(spark, FOLDER, "lineitem")
    for name in ("orders", "customer", "nation", "part"):
        star.table(spark, FOLDER, name).write.parquet(f"{tmp_path}/{name}.parquet")
    lineitem.filter("l_orderkey % 2 = 0").write.parquet(f"{tmp_path}/lineitem.parquet")
    query = registry.QUERIES["days_kpis"]
    first = query(spark, str(tmp_path)).first()
    lineitem.filter("l_orderkey % 2 = 1").write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    assert query(spark, str(tmp_path)).first() == query(spark, FOLDER).first() != first


def test_a_store_keeps_the_roll_ups_it_is_asked_for(spark, by_day, tmp_path):
    _, orders, products = by_day
    assert rollups.rollups_of(["growth_signals", "customer_table"]) == ("by_order", "by_product")
    assert rollups.rollups_of(["revenue_by_category"]) == ("by_category",)
    store = rollups.DayRollups(spark, f"{tmp_path}/r", ("by_order",))
    store.refresh(orders, products)
    assert set(store.manifest()["months"]) == {"by_order"}
    with pytest.raises(ValueError):  # the other roll-ups would lack the days before
        rollups.DayRollups(spark, f"{tmp_path}/r").refresh(orders, products, [dt.date(2024, 1, 31)])
