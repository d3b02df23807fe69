"""Facts against the text of their evidence: checks in order, the first that decides counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ascii_digits, bound_operator, indian_number

# What texts say of periods, of whose income is meant, of alternatives, refusals, choice and limits; | is or.
MONTHLY = "प्रति माह | मासिक | monthly | per month"
ANNUAL = "वार्षिक | प्रति वर्ष | annual | per annum | yearly"
PERSONAL_INCOME = "व्यक्तिगत आय | applicant income"
FAMILY_INCOME = "पारिवारिक आय | family income"
EITHER = "या | अथवा | or"
BOTH = "तथा | एवं | और | and"
REFUSES = "नहीं | shall not be eligible | not eligible | disqualified | वर्जित"
OPTIONAL = "वैकल्पिक | optional | may submit | may provide | may be used"
STRICT = "older than | above 60 | strictly above"
AT_MOST = "up to | अधिकतम"
NOT_MORE = "से अधिक नहीं | से ज्यादा नहीं | not exceeding | not more than"
AT_LEAST = "या अधिक | or older | or more | न्यूनतम | at least"
VERDICT = "struct<result:string,reason:string>"


def _says(text: Column, phrases: str, words: bool = False) -> Column:
    """Whether a lower-case text holds a phrase, as words of their own if asked for."""
    pattern = "|".join(p.strip() for p in phrases.split("|"))
    return text.rlike(rf"(?:^|\s)(?:{pattern})(?:\s|$)" if words else pattern)


def monthly(text: Column) -> Column:
    return _says(text, MONTHLY)


def annual(text: Column) -> Column:
    return _says(text, ANNUAL)


def _verdict(result: str, reason: str) -> Column:
    return F.struct(F.lit(result).alias("result"), F.lit(reason).alias("reason"))


def checks(text: Column) -> list[Column]:
    """VERDICT of each check, null where it does not decide, in this order, for a fact with the columns type, field, value (a number), op, periodicity,
    connector (AND or OR), eligible, mandatory, date (ISO) and category, any of them null.

    The fact's row of a table; its period; whose income it is; the connector; a refusal of what is called eligible; choice
    in what is called mandatory; the date; the number, and the bound that goes with it."""
    t = F.lower(ascii_digits(F.coalesce(text, F.lit(""))))
    no, same, other = (lambda why: _verdict("CONTRADICTED", why)), _verdict("SUPPORTED", "NORMALIZED_EQUIVALENCE"), _verdict("CONTRADICTED", "VALUE_CONFLICT")
    value, op, field = F.col("value").cast("double"), F.upper("op"), F.lower(F.coalesce("field", F.lit("")))

    cells = F.transform(F.filter(F.split(text, "\n"), lambda line: line.contains("|")), lambda line: F.split(line, r"\|"))
    rows = F.filter(cells, lambda c: F.lower(F.get(c, F.lit(0))).contains(F.lower("category")) & (F.col("category") != ""))
    limit = F.get(F.array_compact(F.transform(rows, lambda c: indian_number(F.get(c, F.lit(1))))), F.lit(0))
    table = F.when(F.col("category").isNotNull() & limit.isNotNull() & value.isNotNull(), F.when(F.abs(limit - value) < 0.001, _verdict("SUPPORTED", "DIRECT_MATCH")).otherwise(other))

    period = F.upper("periodicity")
    wrong = (period.contains("ANNUAL") & monthly(t) & ~annual(t)) | (period.contains("MONTHLY") & annual(t) & ~monthly(t))
    subject = (field.contains("family_income") & _says(t, PERSONAL_INCOME)) | (field.rlike("applicant_income|personal_income") & _says(t, FAMILY_INCOME))
    either, both = _says(t, EITHER, True), _says(t, BOTH, True)
    connector = F.when(F.col("type") == "LOGICAL_CONNECTOR", F.when((F.col("connector") == "AND") & either & ~both, no("LOGICAL_CONNECTOR_CONFLICT")).when((F.col("connector") == "OR") & either, same).when((F.col("connector") == "AND") & both, same))
    refused = (F.col("type") == "EXCLUSION") & F.col("eligible") & _says(t, REFUSES)
    choice = F.coalesce(F.col("mandatory"), F.lit(False)) & _says(t, OPTIONAL)
    parts = [F.regexp_extract(t, r"([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})", n) for n in (3, 2, 1)]
    day = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    dated = ((F.col("type") == "DATE") | F.col("date").isNotNull()) & (parts[0] != "") & (day == F.col("date"))

    n = indian_number(text)
    bound = (
        F.when(F.abs(n - value) > 0.001, other).when(_says(t, STRICT) & (op == "GTE"), no("OPERATOR_CONFLICT")).when(_says(t, AT_MOST) & (op == "EQ"), no("OPERATOR_CONFLICT"))
        .when(_says(t, NOT_MORE) & (op == "GT"), no("OPERATOR_CONFLICT")).when(_says(t, NOT_MORE) & (op == "LTE"), same).when(_says(t, AT_LEAST) & (op == "GTE"), same)
        .when(bound_operator(text) == op, _verdict("SUPPORTED", "NUMERIC_MATCH")).otherwise(same)
    )
    return [
        table, F.when(wrong, no("PERIOD_CONFLICT")), F.when(subject, no("SUBJECT_MISMATCH")), connector, F.when(refused, no("NEGATION_CONFLICT")), F.when(choice, no("OPERATOR_CONFLICT")),
        F.when(dated, same), F.when(value.isNotNull() & n.isNotNull(), bound),
    ]


def verdict(text: Column) -> Column:
    """The first check's verdict that decides (see checks); without any text evidence is missing, and where no check decides more context is needed."""
    nothing = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", _verdict("NOT_ENOUGH_EVIDENCE", "EVIDENCE_MISSING"))
    return F.coalesce(nothing, *checks(text), _verdict("NOT_ENOUGH_EVIDENCE", "INSUFFICIENT_CONTEXT")).cast(VERDICT)


def completion(items, sessions, by: str):
    """by, reasons and complete for review items (by, decision, result, reason) and sessions (by, reviewed_hash, current_hash, blockers).

    A review is complete without any of: STALE (the draft changed since), PENDING (items without a decision), BLOCKERS (issues that block), and
    UNEXPLAINED (contradicted or unsupported items that were approved without a reason). A session without items has none pending."""
    pending = F.col("decision").isNull() | (F.col("decision") == "PENDING")
    unexplained = (F.col("decision") == "APPROVED") & F.col("result").isin("CONTRADICTED", "NOT_ENOUGH_EVIDENCE") & (F.trim(F.coalesce("reason", F.lit(""))) == "")
    counts = items.groupBy(by).agg(F.count_if(pending).alias("n_pending"), F.count_if(F.coalesce(unexplained, F.lit(False))).alias("n_unexplained"))
    s = sessions.join(counts, by, "left")
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("reviewed_hash").eqNullSafe(F.col("current_hash")), "STALE"), F.when(F.col("n_pending") > 0, "PENDING"), F.when(F.coalesce("blockers", F.lit(0)) > 0, "BLOCKERS"), F.when(F.col("n_unexplained") > 0, "UNEXPLAINED"),
        )
    )
    return s.select(by, reasons.alias("reasons"), (F.size(reasons) == 0).alias("complete"))
