"""Every registered query against its SQL, and the shape of the plans."""

import __spark_entry__ as entry
import pytest
from compare import duck, frame_difference

from basketwise.operators import customers as cust, facts as fact, products as prod, sales
from basketwise.plans import bundle, registry, star_tables as star

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = plan_of(df)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in plan
    problem, _ = frame_difference(df, con, entry.oracle_sql()[name])
    assert not problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_bundle_equals_single_operators(spark, tmp_path):
    customers, products, orders = (f(spark, FOLDER) for f in (star.customers, star.products, star.orders))
    results = bundle.full_analysis(customers, products, orders)
    lines = fact.prepare_order_lines(orders)
    for name, single in {
        "executive_kpis": sales.executive_kpis(lines, customers),
        "revenue_by_day": sales.revenue_by_period(lines, "D"),
        "revenue_by_channel": sales.revenue_by_channel(lines, customers),
        "product_table": prod.product_performance(fact.prepare_order_facts(orders, products), products),
        "customer_table": cust.customer_performance(lines),
        "rfm_table": cust.rfm_segmentation(lines),
    }.items():
        assert sorted(map(repr, results[name].collect())) == sorted(map(repr, single.collect())), name
    paths = bundle.write_analysis({n: results[n] for n in ("executive_kpis", "rfm_table")}, str(tmp_path))
    assert spark.read.parquet(paths["rfm_table"]).count() == results["rfm_table"].count()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(registry.revenue_by_channel(spark, FOLDER))
    assert "l_shipdate" not in plan and "l_comment" not in plan
    assert "product" not in plan_of(registry.executive_kpis(spark, FOLDER))
    completed = fact.filter_completed(fact.prepare_order_facts(star.orders(spark, FOLDER), star.products(spark, FOLDER)))
    scan = plan_of(completed.select("revenue"))
    assert "l_returnflag" in scan and "p_brand" not in scan


def test_signals_join_their_lines_once(spark):
    """The detectors read lines that were kept; none joins lines and orders again."""
    for signal in registry._all_signals(spark, entry.SMOKE_DIR).values():
        assert not any("lineitem" in file or "/orders.parquet" in file for file in signal.inputFiles())
