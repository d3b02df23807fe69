"""Verdicts on facts and the guard of reviews, by example."""

from pyspark.sql import functions as F

from trivalent.operators import verification

DDL = "i long, text string, type string, field string, value double, op string, periodicity string, connector string, eligible boolean, mandatory boolean, date string, category string"
CASES = [
    ("General | 5\nSC | 2 lakh", {"category": "sc", "value": 200000.0}, "SUPPORTED", "DIRECT_MATCH"), ("SC | 5", {"category": "sc", "value": 6.0}, "CONTRADICTED", "VALUE_CONFLICT"), ("aged 18 years, 5 per month", {"periodicity": "ANNUAL", "value": 5.0}, "CONTRADICTED", "PERIOD_CONFLICT"),
    ("monthly or annual 5", {"periodicity": "ANNUAL", "value": 5.0}, "SUPPORTED", "NORMALIZED_EQUIVALENCE"), ("प्रति वर्ष", {"periodicity": "MONTHLY"}, "CONTRADICTED", "PERIOD_CONFLICT"), ("applicant income 5", {"field": "family_income", "value": 5.0}, "CONTRADICTED", "SUBJECT_MISMATCH"),
    ("पारिवारिक आय", {"field": "applicant_income"}, "CONTRADICTED", "SUBJECT_MISMATCH"), ("land or house", {"type": "LOGICAL_CONNECTOR", "connector": "AND"}, "CONTRADICTED", "LOGICAL_CONNECTOR_CONFLICT"), ("a तथा b", {"type": "LOGICAL_CONNECTOR", "connector": "AND"}, "SUPPORTED", "NORMALIZED_EQUIVALENCE"),
    ("for all", {"type": "LOGICAL_CONNECTOR", "connector": "OR"}, "NOT_ENOUGH_EVIDENCE", "INSUFFICIENT_CONTEXT"), ("He shall NOT be eligible", {"type": "EXCLUSION", "eligible": True}, "CONTRADICTED", "NEGATION_CONFLICT"), ("may submit it", {"type": "DOCUMENT", "mandatory": True}, "CONTRADICTED", "OPERATOR_CONFLICT"),
    ("may submit it", {"type": "DOCUMENT", "mandatory": False}, "NOT_ENOUGH_EVIDENCE", "INSUFFICIENT_CONTEXT"), ("from ५.३.2024 on", {"type": "DATE", "date": "2024-03-05"}, "SUPPORTED", "NORMALIZED_EQUIVALENCE"), ("older than 60", {"op": "GTE", "value": 60.0}, "CONTRADICTED", "OPERATOR_CONFLICT"),
    ("up to 60", {"op": "EQ", "value": 60.0}, "CONTRADICTED", "OPERATOR_CONFLICT"), ("60 से अधिक नहीं", {"op": "GT", "value": 60.0}, "CONTRADICTED", "OPERATOR_CONFLICT"), ("60 से अधिक नहीं", {"op": "LTE", "value": 60.0}, "SUPPORTED", "NORMALIZED_EQUIVALENCE"), ("60 or more", {"op": "GTE", "value": 60.0}, "SUPPORTED", "NORMALIZED_EQUIVALENCE"),
    ("less than 60", {"op": "LT", "value": 60.0}, "SUPPORTED", "NUMERIC_MATCH"), ("61", {"value": 60.0}, "CONTRADICTED", "VALUE_CONFLICT"), (None, {"value": 60.0}, "NOT_ENOUGH_EVIDENCE", "EVIDENCE_MISSING"), ("  ", {}, "NOT_ENOUGH_EVIDENCE", "EVIDENCE_MISSING"), ("nothing", {"value": 60.0}, "NOT_ENOUGH_EVIDENCE", "INSUFFICIENT_CONTEXT"),
]


def test_each_check_decides_in_its_turn(spark):
    names = [c.split(" ")[0] for c in DDL.split(", ")]
    rows = [tuple({"i": i, "text": text, **fact}.get(n) for n in names) for i, (text, fact, *_) in enumerate(CASES)]
    got = {r.i: (r.v.result, r.v.reason) for r in spark.createDataFrame(rows, DDL).select("i", verification.verdict(F.col("text")).alias("v")).collect()}
    assert {CASES[i][0]: v for i, v in got.items() if v != CASES[i][2:]} == {}


def test_reviews_are_complete_without_any_reason(spark):
    items = [(1, "APPROVED", "SUPPORTED", None), (2, None, "SUPPORTED", None), (2, "PENDING", "SUPPORTED", None), (3, "APPROVED", "CONTRADICTED", " "), (4, "APPROVED", "CONTRADICTED", "seen"), (4, "REJECTED", "NOT_ENOUGH_EVIDENCE", None), (5, "APPROVED", None, None)]
    sessions = [(1, "h", "h", 0), (2, "h", "i", 1), (3, "h", "h", None), (4, "h", "h", 0), (5, None, "h", 0), (6, "h", "h", 0)]
    out = verification.completion(spark.createDataFrame(items, "s long, decision string, result string, reason string"), spark.createDataFrame(sessions, "s long, reviewed_hash string, current_hash string, blockers int"), "s")
    got = {r.s: (r.reasons, r.complete) for r in out.collect()}
    assert got == {1: ([], True), 2: (["STALE", "PENDING", "BLOCKERS"], False), 3: (["UNEXPLAINED"], False), 4: ([], True), 5: (["STALE"], False), 6: ([], True)}
