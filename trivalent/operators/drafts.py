"""Quality rules of extracted drafts by kind of row, evidence references, and the cascade that verifies facts against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import host
from ..functions.text import indian_number
from . import verification
from .validation import issues

Rule = tuple[str, str, Column]
#: Ages above this are suspicious; confidence of recognised text below this is low.
OLDEST, CONFIDENT = 120, 0.60


def number_rules() -> list[Rule]:
    """For conditions (field, low, high): a single value has low = high."""
    field, low, high = F.lower("field"), F.col("low"), F.col("high")
    age, money, share = field.contains("age") & ~field.contains("percentage"), field.contains("income") | field.contains("amount"), field.contains("percent")
    negative = F.least(low, high) < 0
    return [
        ("AGE_NEGATIVE", "ERROR", age & negative), ("AGE_SUSPICIOUS", "WARNING", age & (F.greatest(low, high) > OLDEST)), ("AGE_RANGE_INVALID", "ERROR", age & (low > high)),
        ("INCOME_NEGATIVE", "ERROR", money & negative), ("PERCENTAGE_INVALID", "ERROR", share & (negative | (F.greatest(low, high) > 100))),
    ]


def date_rules() -> list[Rule]:
    """For dates (kind, day: ISO text) with the draft's first day and last day (valid_from, valid_until)."""
    exact = (F.col("kind") == "EXACT") & F.col("day").isNotNull()
    return [("DATE_INVALID", "ERROR", exact & F.try_to_date("day", "yyyy-MM-dd").isNull()), ("DATE_RANGE_INVALID", "ERROR", F.col("valid_from") > F.col("valid_until"))]


def benefit_rules() -> list[Rule]:
    """For benefits (type, amount, currency)."""
    cash, kind, amount = F.col("type") == "CASH", F.col("type") == "IN_KIND", F.col("amount")
    return [("BENEFIT_NEGATIVE_AMOUNT", "ERROR", amount < 0), ("BENEFIT_TYPE_INCONSISTENT", "WARNING", (cash & amount.isNull()) | (kind & amount.isNotNull() & F.col("currency").isNotNull()))]


def application_rules() -> list[Rule]:
    """For contacts and portals (kind: email, phone, helpline or url; value)."""
    kind, value = F.lower("kind"), F.trim("value")
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return [
        ("APPLICATION_URL_UNSAFE", "BLOCKER", (kind == "url") & (~value.rlike("(?i)^https?://") | (host(value) == ""))),
        ("CONTACT_INVALID", "WARNING", ((kind == "email") & ~value.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")) | (kind.isin("phone", "helpline") & (digits < 4))),
    ]


def evidence_issues(facts: DataFrame, registry: DataFrame, key: list[str]) -> DataFrame:
    """key, code, severity: facts (kind, refs) without a reference, and references that the draft's registry (first of key, evidence_id, page,
    confidence) lacks, that are on no page, or that were badly recognised. Documents and dates without one are warnings only."""
    none = facts.where(F.coalesce(F.size("refs"), F.lit(0)) <= 0).select(*key, F.lit("EVIDENCE_REF_MISSING").alias("code"), F.when(F.col("kind").isin("DOCUMENT", "DATE"), "WARNING").otherwise("ERROR").alias("severity"))
    cited = facts.select(*key, F.explode(F.array_distinct("refs")).alias("evidence_id"))
    found = cited.join(registry.withColumn("known", F.lit(True)), [key[0], "evidence_id"], "left")
    rules = [
        ("EVIDENCE_REGISTRY_MISSING", "BLOCKER", F.col("known").isNull()), ("EVIDENCE_PAGE_INVALID", "ERROR", F.col("page") <= 0),
        ("LOW_CONFIDENCE_OCR_EVIDENCE", "WARNING", F.col("confidence") < CONFIDENT),
    ]
    return none.unionByName(issues(found, key, rules))


def verified(facts: DataFrame, evidence: DataFrame, key: list[str]) -> DataFrame:
    """key, result, reason for facts (value: a number, periodicity, refs) against evidence (first of key, evidence_id, text).

    In this order: no reference; a reference to nothing; evidence that names several numbers; another period than the source's; the number
    itself, the same or another; else more context is needed."""
    cited = facts.select(*key, F.explode_outer("refs").alias("evidence_id"))
    joined = cited.join(evidence.withColumn("known", F.lit(True)), [key[0], "evidence_id"], "left")
    monthly, annual = verification.monthly(F.lower("text")), verification.annual(F.lower("text"))
    seen = joined.groupBy(*key).agg(
        F.count("evidence_id").alias("refs_n"), F.count_if(F.col("evidence_id").isNotNull() & F.col("known").isNull()).alias("broken"), F.array_sort(F.collect_set(indian_number(F.col("text")))).alias("numbers"),
        F.max(F.when(monthly, 1).otherwise(0)).alias("monthly"), F.max(F.when(annual, 1).otherwise(0)).alias("annual"),
    )
    rows = facts.drop("refs").join(seen, key)
    period = F.upper("periodicity")
    wrong_period = ((period == "ANNUAL") & (F.col("monthly") == 1) & (F.col("annual") == 0)) | ((period == "MONTHLY") & (F.col("annual") == 1) & (F.col("monthly") == 0))
    same = F.abs(F.get("numbers", F.lit(0)) - F.col("value").cast("double")) < 0.001
    steps = [
        (F.col("refs_n") == 0, "NOT_ENOUGH_EVIDENCE", "EVIDENCE_MISSING"), (F.col("broken") > 0, "NOT_ENOUGH_EVIDENCE", "FACT_NOT_PRESENT"), (F.size("numbers") > 1, "NOT_ENOUGH_EVIDENCE", "AMBIGUOUS_SOURCE"),
        (wrong_period, "CONTRADICTED", "PERIOD_CONFLICT"), (same, "SUPPORTED", "DIRECT_MATCH"), (~same, "CONTRADICTED", "VALUE_CONFLICT"),
    ]
    result, reason = F.lit("NOT_ENOUGH_EVIDENCE"), F.lit("INSUFFICIENT_CONTEXT")
    for holds, name, why in reversed(steps):
        result, reason = F.when(holds, name).otherwise(result), F.when(holds, why).otherwise(reason)
    return rows.select(*key, result.alias("result"), reason.alias("reason"))


def completed(facts: DataFrame, by: str) -> DataFrame:
    """by, open, rejected, complete: a review is complete when no critical fact (risk CRITICAL or HIGH) is undecided and none is left without a decision."""
    critical, decided = F.col("risk").isin("CRITICAL", "HIGH"), F.col("decision").isNotNull()
    return facts.groupBy(by).agg(F.count_if(~decided).alias("open"), F.count_if(critical & ~decided).alias("critical_open"), F.count_if(F.col("decision") == "REJECT").alias("rejected"), F.coalesce(F.bool_and(decided), F.lit(True)).alias("complete"))
