import datetime

import pytest
from pyspark.sql import functions as F

from basketwise.operators import facts as fact, products as prod, sales, signals

ORDER = (
    "order_id string, customer_id string, product_id string, order_date string, quantity double, "
    "unit_price double, discount_pct double, order_status string"
)
PRODUCT = (
    "product_id string, product_name string, category string, sub_category string, cost_price double, "
    "selling_price double"
)


def orders(spark, rows):
    """Rows of (order, customer, product, date, quantity, price[, discount[, status]])."""
    full = [tuple(r) + (0.0, "Completed")[len(r) - 6 :] if len(r) < 8 else r for r in rows]
    return spark.createDataFrame(full, ORDER)


def catalogue(spark, rows):
    return spark.createDataFrame(rows, PRODUCT)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def shop(spark):
    products = catalogue(
        spark,
        [
            ("P1", "mug", "Home", "k", 4.0, 10.0),
            ("P2", "pen", "Office", "w", 1.0, 2.0),
            ("P3", "lamp", "Home", "l", 30.0, 0.0),
        ],
    )
    frame = orders(
        spark,
        [
            ("A", "c1", "P1", "2024-01-31", 2.0, 10.0, 5.0, "Completed"),
            ("A", "c1", "P2", "2024-01-31", 1.0, 2.0, 0.0, "Completed"),
            ("B", "c2", "P1", "2024-03-01 23:59:59", 1.0, 10.0, 0.0, "Completed"),
            ("C", "c2", "P9", "2024-03-02", 3.0, 1.5, 0.0, "Completed"),
            ("D", "c3", "P1", "2024-02-01", 1.0, 10.0, 0.0, "Cancelled"),
            ("D", "c3", "P2", "2024-02-01", 1.0, 2.0, 0.0, "Cancelled"),
            ("E", "c3", "P1", "2024-02-02", 1.0, 10.0, 0.0, "Returned"),
            ("F", "c3", "P1", "nonsense", 1.0, 10.0, 0.0, "Completed"),
            ("G", None, "P1", "2024-03-03", None, None, None, None),
        ],
    )
    customers = spark.createDataFrame(
        [("c1", "Email"), ("c2", "Email"), ("c4", "Ads")], "customer_id string, acquisition_channel string"
    )
    return frame, products, customers


def test_facts(shop):
    frame, products, _ = shop
    facts = fact.prepare_order_facts(frame, products)
    assert facts.columns == [
        "order_id", "customer_id", "product_id", "order_date", "quantity", "unit_price", "discount_pct",
        "order_status", "product_name", "category", "sub_category", "cost_price", "selling_price", "revenue",
        "cost", "profit", "year_month",
    ]
    rows = {(r.order_id, r.product_id): r for r in facts.collect()}
    assert len(rows) == 8  # the unreadable date is gone, every status stays
    a = rows["A", "P1"]
    assert (a.revenue, a.cost, a.profit, a.year_month) == (19.0, 8.0, 11.0, "2024-01")
    assert rows["C", "P9"].category is None and rows["C", "P9"].cost_price == 0.0
    assert rows["C", "P9"].selling_price is None
    assert (rows["G", "P1"].quantity, rows["G", "P1"].revenue) == (0.0, 0.0)
    assert fact.filter_completed(facts).count() == 4


def test_facts_without_products(shop):
    frame, _, _ = shop
    row = fact.prepare_order_facts(frame, None).filter("order_id = 'A'").first()
    assert row.category is None and row.cost_price == 0.0 and row.profit == row.revenue


def test_facts_with_some_attributes(shop):
    frame, products, _ = shop
    facts = fact.prepare_order_facts(frame, products.select("product_id", "category"))
    assert len(facts.columns) == 17 and facts.filter("category = 'Home'").first().cost_price == 0.0


def test_facts_of_text_columns(spark, shop):
    frame, products, _ = shop
    text = frame.select(*[F.col(c).cast("string") for c in frame.columns])
    same = fact.prepare_order_facts(text, products).orderBy("order_id", "product_id")
    assert rows_of(same) == rows_of(fact.prepare_order_facts(frame, products).orderBy("order_id", "product_id"))


def test_no_orders(spark, shop):
    _, products, customers = shop
    facts = fact.prepare_order_facts(orders(spark, []), products)
    assert facts.count() == 0 and len(facts.columns) == 17
    assert rows_of(sales.executive_kpis(facts, customers)) == [(0.0, 0, 0, 0.0, 0, 3, None, 0, 0)]
    assert rows_of(sales.revenue_growth_30d(facts)) == [(None,)]
    for table in (sales.revenue_by_period(facts), sales.monthly_growth(facts), sales.revenue_by_category(facts),
                  sales.revenue_by_channel(facts, customers), signals.seasonal_category_spikes(facts),
                  signals.high_aov_channels(facts, customers)):
        assert table.count() == 0


def test_kpis(shop):
    frame, products, customers = shop
    lines = fact.prepare_order_lines(frame)
    want = [(35.5, 3, 7, 11.83, 2, 3, None, 2, 1)]
    for view in (lines, fact.prepare_order_facts(frame, products), fact.order_rollup(lines)):
        assert rows_of(sales.executive_kpis(view, customers)) == want
    assert sales.executive_kpis(lines, None).first().total_registered_customers == 0


def growth_of(spark, rows):
    frame = orders(spark, [(str(i), "c", "p", day, 1.0, float(price)) for i, (day, price) in enumerate(rows)])
    return sales.revenue_growth_30d(fact.prepare_order_lines(frame)).first()[0]


def test_growth_30d(spark):
    # 60 days of history, windows (max-30d, max] and (max-60d, max-30d]
    assert growth_of(spark, [("2024-03-01", 9), ("2024-03-31", 50), ("2024-04-30", 75)]) == 50.0
    # the first day lies exactly 60 days back: outside, so there is no prior revenue
    assert growth_of(spark, [("2024-03-01", 9), ("2024-04-30", 75)]) is None
    # 59 days and 23 hours are not 60 days
    assert growth_of(spark, [("2024-03-01 01:00:00", 9), ("2024-03-31", 5), ("2024-04-30 00:00:00", 75)]) is None
    assert growth_of(spark, [("2024-02-01", 9), ("2024-03-31", 0), ("2024-04-30", 75)]) is None


def test_periods(spark):
    lines = fact.prepare_order_lines(
        orders(spark, [
            ("A", "c", "p", "2024-12-29", 1.0, 10.0), ("A", "c", "p", "2024-12-30", 1.0, 1.0),
            ("B", "c", "p", "2025-01-05 22:00:00", 2.0, 2.0), ("C", "c", "p", "2025-03-01", 1.0, 22.0),
        ])
    )
    assert rows_of(sales.revenue_by_period(lines, "W")) == [
        ("2024-12-23/2024-12-29", 10.0, 1, 1.0),
        ("2024-12-30/2025-01-05", 5.0, 2, 3.0),
        ("2025-02-24/2025-03-02", 22.0, 1, 1.0),
    ]
    assert [r[0] for r in rows_of(sales.revenue_by_period(lines, "D"))] == [
        "2024-12-29", "2024-12-30", "2025-01-05", "2025-03-01"
    ]
    # the missing February is not filled in
    assert rows_of(sales.monthly_growth(lines)) == [
        ("2024-12", 11.0, 1, None), ("2025-01", 4.0, 1, -63.64), ("2025-03", 22.0, 1, 450.0)
    ]
    with pytest.raises(ValueError):
        sales.revenue_by_period(lines, "Q")


def test_growth_after_a_month_without_revenue(spark):
    lines = fact.prepare_order_lines(
        orders(spark, [("A", "c", "p", "2024-01-01", 1.0, 0.0), ("B", "c", "p", "2024-02-01", 1.0, 5.0)])
    )
    assert [r.revenue_growth_pct for r in sales.monthly_growth(lines).collect()] == [None, None]


def test_categories(shop):
    frame, products, _ = shop
    assert rows_of(sales.revenue_by_category(fact.prepare_order_facts(frame, products))) == [
        ("Home", 29.0, 2, 3.0, 81.69), (None, 4.5, 1, 3.0, 12.68), ("Office", 2.0, 1, 1.0, 5.63)
    ]


def test_channels(spark, shop):
    frame, products, customers = shop
    lines = fact.prepare_order_lines(frame)
    some = customers.filter("customer_id <> 'c2'")
    assert rows_of(sales.revenue_by_channel(lines, customers)) == [("Email", 35.5, 3, 2, 11.83)]
    assert rows_of(sales.revenue_by_channel(lines, some)) == [("Email", 21.0, 1, 1, 21.0), (None, 14.5, 2, 1, 7.25)]
    assert sales.revenue_by_channel(lines, customers.limit(0)).count() == 0


def test_product_table(shop):
    frame, products, _ = shop
    lines = fact.prepare_order_lines(frame)
    want = [
        ("P1", "mug", "Home", 4.0, 10.0, 60.0, 3, 29.0, 17.0),
        ("P2", "pen", "Office", 1.0, 2.0, 50.0, 1, 2.0, 1.0),
        ("P3", "lamp", "Home", 30.0, 0.0, 0.0, 0, 0.0, 0.0),  # unsold; no price, no margin
    ]
    for view in (lines, fact.prepare_order_facts(frame, products), fact.product_rollup(lines)):
        assert rows_of(prod.product_performance(view, products).orderBy("product_id")) == want


def table(spark, rows):
    return spark.createDataFrame(
        rows, "product_id string, product_name string, category string, margin_pct double, units_sold long, "
        "revenue double"
    )


def test_rankings(spark):
    t = table(spark, [(f"P{i}", "n", "c", 1.0, i, float(i // 2)) for i in range(8)])
    assert [r.product_id for r in prod.top_n_products(t, 3).collect()] == ["P6", "P7", "P4"]
    assert [r.product_id for r in prod.bottom_n_products(t, 3, by="units_sold").collect()] == ["P0", "P1", "P2"]
    for rank in (prod.top_n_products, prod.bottom_n_products):
        with pytest.raises(ValueError):
            rank(t, by="price")


def test_high_margin_low_volume(spark):
    # units 0, 10, 20, 30, 40, 50: the lower quartile is 12.5
    t = table(spark, [(f"P{i}", "n", "c", m, 10 * i, 1.0) for i, m in enumerate([50.0, 70.0, 90.0, 80.0, 60.0, 55.0])])
    found = prod.high_margin_low_volume(t)
    assert [r.product_id for r in found.collect()] == ["P1", "P0"]
    assert prod.high_margin_low_volume(t, 50.0, 0.5).count() == 3
    assert prod.high_margin_low_volume(t.limit(0)).count() == 0
    assert prod.high_margin_low_volume(t, approx=True).count() == 2


def test_spikes(spark):
    def month(category, m, amount):
        return ("o" + m, "c", category, f"2024-{m}-01", 1.0, amount)

    products = catalogue(spark, [(c, c, c, "s", 1.0, 2.0) for c in ("A", "B", "C", "D")] + [("N", "n", None, "s", 1.0, 2.0)])
    rows = [month("A", "01", 100.0), month("A", "02", 250.0), month("A", "03", 250.0), month("A", "04", 100.0)]
    rows += [month("B", "01", 100.0), month("B", "02", 110.0), month("C", "01", 900.0)]
    rows += [month("D", "01", 30.0), month("D", "05", 70.0), month("N", "01", 1.0), month("N", "02", 9.0)]
    lines = fact.prepare_order_lines(orders(spark, rows))
    want = [
        ("seasonal_category_spike", "A", "2024-02", 250.0, 175.0, 1.43,
         "A revenue in 2024-02 was 1.4x its average monthly revenue — a seasonal spike worth planning "
         "inventory/marketing around."),
        ("seasonal_category_spike", "D", "2024-05", 70.0, 50.0, 1.4,
         "D revenue in 2024-05 was 1.4x its average monthly revenue — a seasonal spike worth planning "
         "inventory/marketing around."),
    ]
    facts = fact.prepare_order_facts(orders(spark, rows), products)
    assert rows_of(signals.seasonal_category_spikes(facts)) == want
    assert rows_of(signals.seasonal_category_spikes(fact.product_rollup(lines, products))) == want


def test_channel_lift(spark):
    # the one number known of the sample data: 5852.77 against 5173.59 is a lift of 13.13 %
    rows = [(f"r{i}", "R", "p", "2024-01-01", 1.0, 5852.77) for i in range(1)]
    rest = 2 * 5173.59 - 5852.77
    rows += [("e1", "E", "p", "2024-01-01", 1.0, rest)]
    customers = spark.createDataFrame(
        [("R", "Referral"), ("E", "Email")], "customer_id string, acquisition_channel string"
    )
    found = signals.high_aov_channels(fact.prepare_order_lines(orders(spark, rows)), customers)
    assert rows_of(found) == [
        ("high_aov_channel", "Referral", 5852.77, 5173.59, 13.13, 1,
         "Referral customers have an AOV of 5853 vs the overall 5174 (13% higher) — a candidate channel to "
         "scale spend on.")
    ]


def test_margin_signals_stop_at_top_n(spark):
    t = table(spark, [(f"P{i:02}", f"thing {i}", "c", 60.0, 0, 0.0) for i in range(30)])
    found = signals.high_margin_low_volume_signals(t)
    assert [r.product_id for r in found.collect()] == [f"P{i:02}" for i in range(10)]
    assert found.first().description == (
        "thing 0 carries a 60% margin but sold only 0 unit(s) — a strong candidate for a marketing push "
        "or bundling rather than a price cut."
    )


def test_reference_dates_are_timestamps(shop):
    frame, _, _ = shop
    assert fact.prepare_order_lines(frame).filter("order_id = 'B'").first().order_date == datetime.datetime(
        2024, 3, 1, 23, 59, 59
    )
