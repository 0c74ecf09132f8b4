"""The order of day and month is told by the column."""

import datetime

import pytest

from basketwise.functions import dates
from basketwise.operators import facts, quality


def day(y, m, d, *time):
    return datetime.datetime(y, m, d, *time)


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        ("13/02/2024", "02/13/2024", "03/04/2024", "05/05/2024", "2024-01-02", None),
        ("01/02/2024", "1-2-2024 10:30", "05.06.2024", "6/6/2024", "Jan 3 2024", ""),
        ("31.12.2024 23:59:58", "x", "5/5/2024", None, "2024/1/9", "32/13/2024"),
        ("2024-03-01", "13/13/2024", None, None, "4 March 2024", "1/2/24"),
    ]
    return spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")


def test_the_order_that_reads_more_is_taken(table):
    got = {r["column"]: tuple(r)[1:] for r in dates.date_orders(table, "abcdef").collect()}
    assert got == {
        "a": (1, 3, 1, "day first", False),
        "b": (2, 1, 1, "month first", False),
        "c": (3, 3, 2, "month first", True),
        "d": (2, 2, 0, "month first", False),  # both orders read the same: nothing to decide
        "e": (0, 0, 0, "month first", False),
        "f": (0, 0, 0, "month first", False),
    }


def test_a_column_is_read_whole_in_its_order(table):
    rows = dates.read_dates(table, "abcde").collect()
    assert [r.a for r in rows] == [day(2024, 2, 13), day(2024, 2, 1), day(2024, 12, 31, 23, 59, 58), day(2024, 3, 1)]
    assert [r.b for r in rows] == [day(2024, 2, 13), day(2024, 1, 2, 10, 30), None, None]
    assert [r.c for r in rows] == [day(2024, 3, 4), day(2024, 5, 6), day(2024, 5, 5), None]
    assert [r.e for r in rows] == [day(2024, 1, 2), day(2024, 1, 3), day(2024, 1, 9), day(2024, 3, 4)]


def test_a_known_order_needs_no_vote(table):
    rows = dates.read_dates(table, ["c"], {"c": dates.DAY_FIRST}).collect()
    assert [r.c for r in rows] == [day(2024, 4, 3), day(2024, 6, 5), day(2024, 5, 5), None]


def test_each_file_has_its_own_order(spark):
    rows = [("us", "01/02/2024"), ("us", "12/31/2024"), ("eu", "01/02/2024"), ("eu", "31/12/2024"), (None, "1/1/2024")]
    votes = dates.date_orders_by(spark.createDataFrame(rows, "file string, at string"), "file", ["at"])
    assert {r.file: r.taken for r in votes.collect()} == {"us": "month first", "eu": "day first", None: "month first"}


def test_dates_and_times_need_no_reading(spark):
    df = spark.sql("SELECT DATE'2024-02-01' AS a, TIMESTAMP'2024-02-01 10:00:00' AS b")
    assert tuple(dates.read_dates(df, "ab").first()) == (day(2024, 2, 1), day(2024, 2, 1, 10))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "a string")
    assert tuple(dates.date_orders(empty, "a").first()) == ("a", 0, 0, 0, "month first", False)
    assert dates.read_dates(empty, "a").count() == 0


def customers(spark, *signed):
    rows = [(str(i), at, "c", "a", "ch") for i, at in enumerate(signed)]
    return spark.createDataFrame(rows, "customer_id string, signup_date string, city string, age_group string, acquisition_channel string")


def test_validation_keeps_a_day_first_file(spark):
    checked = quality.validate(customers(spark, "13/02/2024", "01/02/2024", "02/30/2024"), "customers")
    summary = checked.summary.first()
    assert (summary.total_rows, summary.invalid_rows_dropped, summary.is_valid) == (3, 1, True)
    assert sorted(r.signup_date for r in checked.clean.collect()) == [day(2024, 2, 1), day(2024, 2, 13)]
    assert [r.problems for r in checked.quarantine.collect()] == [["signup_date unreadable"]]


def test_validation_reports_an_undecided_file(spark):
    checked = quality.validate(customers(spark, "03/02/2024", "01/02/2024"), "customers")
    assert checked.summary.first().warnings == ["Column 'signup_date': 2 date(s) could have day or month first; the month was assumed."]
    assert sorted(r.signup_date for r in checked.clean.collect()) == [day(2024, 1, 2), day(2024, 3, 2)]


def test_given_formats_are_not_voted_on(spark):
    checked = quality.validate(customers(spark, "03/02/2024", "01/02/2024"), "customers", formats=("d/M/yyyy",))
    assert checked.summary.first().warnings == []
    assert sorted(r.signup_date for r in checked.clean.collect()) == [day(2024, 2, 1), day(2024, 2, 3)]


def test_order_lines_read_their_column(spark):
    rows = [("1", "1", "1", at, "1", "5", "0", "Completed") for at in ("13/02/2024", "14/02/2024", "01/03/2024", "02/13/2024")]
    names = "order_id customer_id product_id order_date quantity unit_price discount_pct order_status".split()
    lines = facts.prepare_order_lines(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)))
    assert sorted(r.year_month for r in lines.collect()) == ["2024-02", "2024-02", "2024-03"]
