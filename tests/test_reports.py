import json

import pytest
from pyspark.sql import functions as F

from basketwise.operators import actions, reports
from basketwise.sources.action_log import append_log, read_log
from basketwise.sources.tables import ROW_SEQ

ITEM = {"title": "Sell mugs", "description": "d", "supporting_metric": "m", "policy_reference": "a.md",
        "estimated_impact": "estimated 3%"}


def full(**changes):
    body = {
        "executive_summary": "All well.",
        "revenue_opportunities": [ITEM],
        "customer_growth_opportunities": [],
        "product_opportunities": [],
        "risks": [{"risk": "r", "description": "d", "supporting_metric": "m"}],
        "recommended_actions": [{"action": "Do it", "rationale": "why", "policy_reference": None}],
    }
    body.update(changes)
    return {k: v for k, v in body.items() if v != "drop"}


def frame(spark, *raws, known=("a.md",)):
    texts = [r if isinstance(r, str) else json.dumps(r) for r in raws]
    return spark.createDataFrame(
        [(i, t, list(known)) for i, t in enumerate(texts)], "report_id long, raw string, known_sources array<string>"
    )


def normalized(spark, *raws, **options):
    return reports.normalize_reports(reports.parse_reports(frame(spark, *raws, **options)))


def warnings(spark, *raws):
    return [r.warnings for r in normalized(spark, *raws).orderBy("report_id").collect()]


GOOD = json.dumps(full())


@pytest.mark.parametrize(
    "raw",
    [
        GOOD,
        f"  {GOOD}\n",
        f"```json\n{GOOD}\n```",
        f"```\n{GOOD}```",
        f"Here you are: {GOOD} Hope it helps.",
        f"```json\nSure!\n{GOOD}\n```",
        GOOD + " trailing words",
    ],
)
def test_parsing(spark, raw):
    row = normalized(spark, raw).first()
    assert row.error is None and row.executive_summary == "All well." and row.warnings == []


@pytest.mark.parametrize(
    "raw, error",
    [
        ("no braces", reports.NO_OBJECT),
        ("", reports.NO_OBJECT),
        ("} {", reports.NO_OBJECT),
        ("{broken", reports.NO_OBJECT),
        ("{broken}", reports.NOT_JSON),
        ('{"a": 1} and {"b": 2}', reports.NOT_JSON),
        ('{"a": 1}, "tail": 0', None),
    ],
)
def test_rejects(spark, raw, error):
    parsed = reports.parse_reports(frame(spark, raw))
    assert parsed.first().error == error
    assert reports.rejected_reports(parsed).count() == (error is not None)


@pytest.mark.parametrize("raw, kind", [("[1]", "list"), ('"x"', "str"), ("3", "int"), ("2.5", "float"), ("true", "bool"),
                                       ("null", "NoneType")])
def test_top_level_must_be_an_object(spark, raw, kind):
    row = normalized(spark, raw).first()
    assert row.error == f"the JSON response was not an object at the top level (got {kind})"
    assert row.executive_summary is None and row.risks is None


def test_shape_warnings(spark):
    got = warnings(
        spark,
        full(risks="drop"),
        full(risks=None),
        full(risks={"risk": "r"}),
        full(risks="none"),
        full(risks=4),
        full(risks=4.5),
        full(risks=4.0),
        full(risks=10**25),
        full(risks=False),
        full(executive_summary="  "),
        full(executive_summary=5),
        full(zeta=1, alpha=2),
    )
    missing = "Missing section 'risks' in model output — defaulted to an empty list."
    odd = "Section 'risks' had an unexpected type ({}) — defaulted to an empty list."
    blank = "Missing or empty 'executive_summary' in model output."
    assert got == [
        [missing], [missing],
        ["Section 'risks' was a single object, not a list — wrapped automatically."],
        [odd.format("str")], [odd.format("int")], [odd.format("float")], [odd.format("float")], [odd.format("int")],
        [odd.format("bool")], [blank], [blank],
        ["Model output included unexpected extra key(s), ignored: ['alpha', 'zeta']"],
    ]


def test_summary_text_is_kept_as_it_is(spark):
    rows = normalized(spark, full(executive_summary="  "), full(executive_summary=5)).orderBy("report_id").collect()
    assert [r.executive_summary for r in rows] == ["  ", ""]


def test_sections_keep_their_items(spark):
    row = normalized(spark, full(risks={"risk": "r"}, product_opportunities=[1, "x", ITEM])).select(
        F.size("risks").alias("risks"), F.size("product_opportunities").alias("products"),
        F.try_variant_get(F.col("risks")[0], "$.risk", "string").alias("risk"),
    ).first()
    assert tuple(row) == (1, 3, "r")


def audit(spark, *raws, **options):
    return reports.report_verdict(frame(spark, *raws, **options)).orderBy("report_id").collect()


def test_citations(spark):
    cite = lambda *refs: [{"policy_reference": r} for r in refs]
    row, none = audit(
        spark,
        full(revenue_opportunities=cite("b.md", "a.md", "", None, False) + [7, "a.md"], risks=cite("a.md", "z.md")),
        full(revenue_opportunities=[]),
        known=("a.md", "c.md"),
    )
    assert row.total_citations == 4 and row.cited_sources == ["a.md", "b.md", "z.md"]
    assert row.sections_with_citations == ["revenue_opportunities", "risks"]
    assert row.unrecognized_citations == ["b.md", "z.md"]
    assert row.status == "warning" and row.is_valid
    assert row.audit_warnings == [
        "Validator: strategy report cites policy source(s) not among the chunks retrieved this run "
        "(possible hallucinated citation): ['b.md', 'z.md']"
    ]
    assert none.total_citations == 0 and none.status == "warning" and none.cited_sources == []
    assert none.audit_warnings == [reports.NO_CITATIONS]


def test_verdicts(spark):
    good, blank, broken, listed = audit(spark, full(), full(executive_summary=" "), "nothing", [1])
    assert (good.is_valid, good.status, good.audit_warnings, good.all_sections_present) == (True, "success", [], True)
    assert (blank.is_valid, blank.status, blank.audit_warnings) == (False, "error", [reports.INVALID_REPORT])
    for row in (broken, listed):
        assert (row.is_valid, row.status, row.all_sections_present, row.has_risks) == (False, "error", False, False)
        assert len(row.audit_warnings) == 3 and "executive_summary" in row.audit_warnings[0]


def test_actions(spark):
    body = full(
        revenue_opportunities=[ITEM, {"description": "no title"}, "text", None],
        product_opportunities=[{"title": "", "action": "Fallback", "description": "", "rationale": "because",
                                "supporting_metric": 0}],
        customer_growth_opportunities={"title": 12, "policy_reference": "", "estimated_impact": {"x": 1}},
        risks=[{"title": "never offered"}],
        recommended_actions=[{"action": "y" * 3000}],
    )
    found = reports.map_actions(reports.action_candidates(normalized(spark, body))).orderBy("position").collect()
    assert [(r.position, r.source_section, r.title[:9], r.reason) for r in found] == [
        (0, "revenue_opportunities", "Sell mugs", "d"),
        (1, "product_opportunities", "Fallback", "because"),
        (2, "customer_growth_opportunities", "12", ""),
        (3, "recommended_actions", "yyyyyyyyy", ""),
    ]
    first, second, third, last = found
    assert (first.supporting_metric, first.policy_reference, first.estimated_impact) == ("m", "a.md", "estimated 3%")
    assert second.supporting_metric == "" and second.policy_reference is None and second.estimated_impact is None
    assert third.policy_reference == "" and third.estimated_impact == '{"x":1}'
    assert {r.amount_inr for r in found} == {499}
    assert first.description == "Growth action — Sell mugs" and len(last.description) == 2048
    named = reports.map_actions(reports.action_candidates(normalized(spark, body)), "Shop").first()
    assert named.description == "Shop — Sell mugs"


# --- action log -----------------------------------------------------------------------------


def test_log_round_trip(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert read_log(spark, path).count() == 0
    record = spark.createDataFrame(
        [("r1", "Sell", True, 499, None, "pending")],
        "reference_id string, recommendation string, merchant_approved boolean, amount_inr int, "
        "payment_link_id string, result string",
    )
    append_log(record, path)
    append_log(record.withColumns({"reference_id": F.lit("r2"), "timestamp": F.lit("2001-01-01T00:00:00+00:00")}), path)
    log = read_log(spark, path)
    rows = log.orderBy("timestamp", ROW_SEQ).collect()
    assert [r.reference_id for r in rows] == ["r2", "r1"]
    assert rows[0].timestamp == "2001-01-01T00:00:00+00:00" and rows[1].timestamp.endswith("+00:00")
    assert rows[1].amount_inr == 499 and rows[1].merchant_approved is True and rows[1].payment_link_id is None

    update = spark.createDataFrame([("r1", "l1", "created"), ("rx", "l2", "created")],
                                   "reference_id string, payment_link_id string, result string")
    changed = {r.reference_id: r for r in actions.apply_status_updates(log, update).collect()}
    assert (changed["r1"].payment_link_id, changed["r1"].result) == ("l1", "created")
    assert changed["r1"].status_checked_at is not None and changed["r2"].status_checked_at is None
    assert changed["r2"].result == "pending" and len(changed) == 2
    assert [r.reference_id for r in actions.unmatched_updates(log, update).collect()] == ["rx"]


def test_bad_lines_are_skipped(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text(
        '{"reference_id": "a", "result": "x", "new_field": 1, "timestamp": "1"}\n\n   \nnot json\n'
        '{"reference_id": "b"\n{"reference_id": "c", "timestamp": "2"} {"d": 1}\n'
        '{"reference_id": "e", "amount_inr": "many", "timestamp": "3"}\n'
    )
    rows = read_log(spark, str(path)).orderBy("timestamp").collect()
    assert [(r.reference_id, r.amount_inr) for r in rows] == [("a", None), ("e", None)]


def log_of(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"r{i % 7}", f"t{i // 4:03}", f"s{i}", f"l{i}" if i % 5 == 0 else None)
            for i in range(200)]
    return spark.createDataFrame(
        rows, "pos int, reference_id string, timestamp string, result string, payment_link_id string"
    )


def test_only_the_most_recent_record_changes(spark):
    log = log_of(spark)
    updates = spark.createDataFrame([("hot", "paid"), ("r2", None)], "reference_id string, result string")
    rows = actions.apply_status_updates(log, updates, "pos").collect()
    touched = {r.pos: r.result for r in rows if r.status_checked_at is not None}
    assert touched == {198: "paid", 191: "s191"} and len(rows) == 200


def test_latest(spark):
    log = log_of(spark)
    latest = {r.reference_id: r.result for r in actions.latest_status(log, "pos").collect()}
    assert latest["hot"] == "s198" and latest["r1"] == "s197" and len(latest) == 8
    assert actions.latest_open_action(log, "pos").first().pos == 195
    assert actions.latest_open_action(log.filter("payment_link_id is null"), "pos").count() == 0
    assert actions.log_view(log).columns == ["timestamp", "payment_link_id", "result"]


def test_a_record_is_parsed_once(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"reference_id": "a", "amount_inr": "many", "note": {"x": 1}, "reason": null}\n{"reference_id": "b"}\n\n{"c"\n')
    log = read_log(spark, str(path))
    assert [(r.reference_id, r.amount_inr, r.other_fields) for r in log.orderBy("reference_id").collect()] == [
        ("a", None, {"amount_inr": '"many"', "note": '{"x":1}'}), ("b", None, None)
    ]
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 2  # the end mark, written and compared
