"""Quality rules and verification over the tables as drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drafts, validation, verification
from .read_plans import _pick, _read, _sql_pick

_FIELDS = ["min_age", "family_income", "marks_percentage", "land"]
_CONTACTS = [("email", "a@b.org"), ("email", "no at"), ("phone", "+91 12-34"), ("helpline", "12"), ("url", "https://x.example/a"), ("url", "ftp://x"), ("url", "http://")]
_DAYS = ["2024-02-29", "2023-02-29", "soon", None]
_TEXTS = ["5 per month", "income of 12 annual", "no number", "5 and then", "5 per year"]


def draft_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as conditions, orders as dates, parts as benefits, suppliers as contacts: broken rules by code."""
    line, o, p, s = (_read(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "supplier"))
    k = F.col("l_partkey")
    conditions = line.select(k.alias("key"), _pick(_FIELDS, k).alias("field"), (F.col("l_quantity") * 3 - 10).alias("low"), F.when(k % 3 == 0, F.col("l_quantity") * 2 + 20).otherwise(F.col("l_quantity") * 3 - 10).alias("high"))
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    dates = o.select(k.alias("key"), F.when(k % 4 != 1, "EXACT").alias("kind"), _pick(_DAYS, k).alias("day"), day.alias("valid_from"), F.when(k % 6 != 0, F.date_add(day, (k % 30 - 5).cast("int"))).alias("valid_until"))
    k = F.col("p_partkey")
    benefits = p.select(k.alias("key"), _pick(["CASH", "IN_KIND", "OTHER"], k).alias("type"), F.when(k % 4 != 0, k % 50 - 5).alias("amount"), F.when(k % 2 == 0, "INR").alias("currency"))
    k = F.col("s_suppkey")
    contacts = s.select(k.alias("key"), _pick([c[0] for c in _CONTACTS], k).alias("kind"), _pick([c[1] for c in _CONTACTS], k).alias("value"))
    found = None
    for rows, rules in ((conditions, drafts.number_rules()), (dates, drafts.date_rules()), (benefits, drafts.benefit_rules()), (contacts, drafts.application_rules())):
        one = validation.issues(rows, ["key"], rules)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("code", "severity").agg(F.count("*").alias("n"))


def _facts(spark, sf_dir):
    """Order lines as facts of their order with up to three references."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    refs = F.when(k % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.array(n, k % 3 + n, n), 1, (k % 3 + 1).cast("int")).cast("array<bigint>"))
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    value = F.element_at(F.array(F.lit(5), F.lit(12), F.lit(7)), (k % 3 + 1).cast("int"))
    return lines.select(k.alias("draft"), n.alias("fact"), _pick(["INCOME", "DOCUMENT", "DATE"], n).alias("kind"), refs.alias("refs"), value.alias("value"), _pick(["ANNUAL", "MONTHLY", None], k + n).alias("periodicity"))


def _evidence(spark, sf_dir):
    """Each order has evidence of the numbers 1 to 5, but for one of them."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draft"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("evidence_id"))
    k, e = F.col("draft"), F.col("evidence_id")
    return o.where((k + e) % 7 != 0).select("draft", "evidence_id", _pick(_TEXTS, k * 3 + e).alias("text"), (e - 1).alias("page"), (((k + e) % 10) / 10).alias("confidence"))


def evidence_rule_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _evidence(spark, sf_dir).select("draft", "evidence_id", "page", "confidence")
    return drafts.evidence_issues(_facts(spark, sf_dir), registry, ["draft", "fact"]).groupBy("code", "severity").agg(F.count("*").alias("n"))


def fact_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drafts.verified(_facts(spark, sf_dir), _evidence(spark, sf_dir).select("draft", "evidence_id", "text"), ["draft", "fact"])
    return out.groupBy("result", "reason").agg(F.count("*").alias("n"), F.min(F.col("draft") * 100 + F.col("fact")).alias("first"))


def review_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") + F.col("l_linenumber")
    facts = _read(spark, sf_dir, "lineitem").select("l_orderkey", _pick(["LOW", "HIGH", "CRITICAL"], k).alias("risk"), F.when((k % 4 != 0) | (F.col("l_orderkey") % 3 == 0), _pick(["APPROVE", "REJECT"], k)).alias("decision"))
    return drafts.completed(facts, "l_orderkey")


def _statements(spark, sf_dir):
    """Orders as facts of eight kinds, each with the text that is its evidence."""
    k, kind = F.col("o_custkey"), F.col("o_orderkey") % 8
    n = k * 10 + 10
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    s = n.cast("string")
    pick = lambda by, *options: F.element_at(F.array(*(o if not isinstance(o, str) else F.lit(o) for o in options)), (by % len(options) + 1).cast("int"))
    said = pick(
        kind, text("General | 5\nSC families | ", s, "\nST | 7"), text("Rs ", s, pick(k, " monthly", " per annum", " in all")), text(pick(k, "applicant income ", "family income "), s), text("land", pick(k, " or ", " and ", " "), "house"),
        pick(k, "shall not be eligible", "is eligible"), text(pick(k, "may submit ", "must submit "), "a form"), text("on ", (k % 28 + 1).cast("string"), "/", (k % 12 + 1).cast("string"), "/2024"),
        pick(k, text("not more than ", s), text(s, " or more"), text("older than ", s), text("up to ", s), text("exactly ", s), ""),
    )
    o = _read(spark, sf_dir, "orders")
    off = F.when(k % 3 == 0, n + 1).otherwise(n)
    none = F.lit(None).cast("string")
    return o.select(
        "o_orderkey", said.alias("text"), pick(kind, "INCOME", "INCOME", "INCOME", "LOGICAL_CONNECTOR", "EXCLUSION", "DOCUMENT", "DATE", "INCOME").alias("type"), F.when(kind == 2, "family_income").alias("field"),
        F.when(kind.isin(0, 2, 7), off).when(kind == 1, n).cast("double").alias("value"), F.when(kind == 7, pick(F.floor(k / 6), "GT", "GTE", "LTE", "EQ")).alias("op"), F.when(kind == 1, "ANNUAL").alias("periodicity"),
        F.when(kind == 3, pick(F.floor(k / 3), "AND", "OR")).alias("connector"), (kind == 4).alias("eligible"), F.when(kind == 5, True).alias("mandatory"),
        F.when(kind == 6, F.concat(F.lit("2024-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((k % 27 + 1).cast("string"), 2, "0"))).otherwise(none).alias("date"), F.when(kind == 0, "sc").alias("category"),
    )


def fact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact's verdict by its evidence's text."""
    return _statements(spark, sf_dir).select("o_orderkey", verification.verdict(F.col("text")).alias("v")).select("o_orderkey", "v.result", "v.reason")


def review_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviews, their lines as items: why a review can't be completed."""
    line, o = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    decision = F.when(F.col("l_discount") > 0.005, F.when(F.col("l_returnflag") == "R", "REJECTED").otherwise("APPROVED"))
    result = F.when(F.col("l_quantity") > 48, "CONTRADICTED").when(F.col("l_quantity") < 2, "NOT_ENOUGH_EVIDENCE").otherwise("SUPPORTED")
    items = line.select("l_orderkey", decision.alias("decision"), result.alias("result"), F.when(F.col("l_tax") > 0.02, "seen by hand").when(F.col("l_tax") > 0.01, " ").alias("reason"))
    sessions = o.select(F.col("o_orderkey").alias("l_orderkey"), F.md5("o_orderpriority").alias("reviewed_hash"), F.md5(F.when(F.col("o_totalprice") > 400000, "changed").otherwise(F.col("o_orderpriority"))).alias("current_hash"), F.when(F.col("o_orderstatus") == "P", F.floor("o_totalprice") % 2).alias("blockers"))
    return verification.completion(items, sessions, "l_orderkey").select("l_orderkey", F.array_join("reasons", ",").alias("reasons"), "complete")


QUERIES = {f.__name__: f for f in (draft_issues, evidence_rule_issues, fact_verification, review_completion, fact_checks, review_guard)}
_FACTS = f"""f AS (SELECT DISTINCT l_orderkey AS draft, l_linenumber AS fact, {_sql_pick(["INCOME", "DOCUMENT", "DATE"], "l_linenumber")} AS kind, {_sql_pick(["ANNUAL", "MONTHLY", None], "l_orderkey + l_linenumber")} AS period, (CASE l_orderkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 12 ELSE 7 END) AS value,
  CASE WHEN l_orderkey % 5 = 0 THEN [] ELSE list_slice([l_linenumber, l_orderkey % 3 + l_linenumber, l_linenumber]::BIGINT[], 1, (l_orderkey % 3 + 1)::BIGINT) END AS refs FROM lineitem),
e AS (SELECT o_orderkey AS draft, i AS id, {_sql_pick(_TEXTS, "o_orderkey * 3 + i")} AS text, i - 1 AS page, ((o_orderkey + i) % 10) / 10 AS confidence FROM orders, range(1, 6) t(i) WHERE (o_orderkey + i) % 7 <> 0),
x AS (SELECT draft, fact, unnest(list_distinct(refs)) AS id FROM f), j AS (SELECT x.*, e.id AS known, text, page, confidence FROM x LEFT JOIN e ON e.draft = x.draft AND e.id = x.id)"""
ORACLE_SQL = {
    "draft_issues": f"""WITH c AS (SELECT {_sql_pick(_FIELDS, "l_partkey")} AS f, l_quantity * 3 - 10 AS lo, CASE WHEN l_partkey % 3 = 0 THEN l_quantity * 2 + 20 ELSE l_quantity * 3 - 10 END AS hi FROM lineitem),
      d AS (SELECT o_orderkey AS k, {_sql_pick(_DAYS, "o_orderkey")} AS day, o_orderdate::DATE AS a, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate::DATE + (o_orderkey % 30 - 5)::INT END AS b FROM orders),
      b AS (SELECT p_partkey % 3 AS t, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 50 - 5 END AS amount, p_partkey % 2 = 0 AS inr FROM part),
      i AS (SELECT unnest([CASE WHEN f = 'min_age' AND least(lo, hi) < 0 THEN 'AGE_NEGATIVE' END, CASE WHEN f = 'min_age' AND greatest(lo, hi) > 120 THEN 'AGE_SUSPICIOUS' END, CASE WHEN f = 'min_age' AND lo > hi THEN 'AGE_RANGE_INVALID' END,
          CASE WHEN f = 'family_income' AND least(lo, hi) < 0 THEN 'INCOME_NEGATIVE' END, CASE WHEN f = 'marks_percentage' AND (least(lo, hi) < 0 OR greatest(lo, hi) > 100) THEN 'PERCENTAGE_INVALID' END]) AS code FROM c
        UNION ALL SELECT unnest([CASE WHEN k % 4 <> 1 AND day IS NOT NULL AND try_cast(day AS DATE) IS NULL THEN 'DATE_INVALID' END, CASE WHEN a > b THEN 'DATE_RANGE_INVALID' END]) FROM d
        UNION ALL SELECT unnest([CASE WHEN amount < 0 THEN 'BENEFIT_NEGATIVE_AMOUNT' END, CASE WHEN (t = 0 AND amount IS NULL) OR (t = 1 AND amount IS NOT NULL AND inr) THEN 'BENEFIT_TYPE_INCONSISTENT' END]) FROM b
        UNION ALL SELECT CASE WHEN s_suppkey % 7 IN (5, 6) THEN 'APPLICATION_URL_UNSAFE' WHEN s_suppkey % 7 IN (1, 3) THEN 'CONTACT_INVALID' END FROM supplier)
      SELECT code, CASE WHEN code = 'APPLICATION_URL_UNSAFE' THEN 'BLOCKER' WHEN code IN ('AGE_SUSPICIOUS', 'BENEFIT_TYPE_INCONSISTENT', 'CONTACT_INVALID') THEN 'WARNING' ELSE 'ERROR' END AS severity, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY ALL""",
    "evidence_rule_issues": f"""WITH {_FACTS} SELECT 'EVIDENCE_REF_MISSING' AS code, CASE WHEN kind IN ('DOCUMENT', 'DATE') THEN 'WARNING' ELSE 'ERROR' END AS severity, count(*) AS n FROM f WHERE len(refs) = 0 GROUP BY ALL
      UNION ALL SELECT 'EVIDENCE_REGISTRY_MISSING', 'BLOCKER', count(*) FROM j WHERE known IS NULL HAVING count(*) > 0 UNION ALL SELECT 'EVIDENCE_PAGE_INVALID', 'ERROR', count(*) FROM j WHERE page <= 0 HAVING count(*) > 0
      UNION ALL SELECT 'LOW_CONFIDENCE_OCR_EVIDENCE', 'WARNING', count(*) FROM j WHERE confidence < 0.6 HAVING count(*) > 0""",
    "fact_verification": f"""WITH {_FACTS}, g AS (SELECT draft, fact, count(*) FILTER (known IS NULL) AS broken, list_sort(list(DISTINCT try_cast(regexp_extract(text, '[0-9]+') AS DOUBLE)) FILTER (regexp_matches(text, '[0-9]'))) AS nums,
        coalesce(bool_or(text LIKE '%per month%'), false) AS mo, coalesce(bool_or(text LIKE '%annual%' OR text LIKE '%yearly%'), false) AS an FROM j GROUP BY 1, 2),
      v AS (SELECT f.draft, f.fact, CASE WHEN len(refs) = 0 THEN 'EVIDENCE_MISSING' WHEN broken > 0 THEN 'FACT_NOT_PRESENT' WHEN len(nums) > 1 THEN 'AMBIGUOUS_SOURCE' WHEN (period = 'ANNUAL' AND mo AND NOT an) OR (period = 'MONTHLY' AND an AND NOT mo) THEN 'PERIOD_CONFLICT'
        WHEN nums[1] = value THEN 'DIRECT_MATCH' WHEN nums[1] IS NOT NULL THEN 'VALUE_CONFLICT' ELSE 'INSUFFICIENT_CONTEXT' END AS reason FROM f LEFT JOIN g USING (draft, fact))
      SELECT CASE WHEN reason = 'DIRECT_MATCH' THEN 'SUPPORTED' WHEN reason LIKE '%_CONFLICT' THEN 'CONTRADICTED' ELSE 'NOT_ENOUGH_EVIDENCE' END AS result, reason, count(*) AS n, min(draft * 100 + fact) AS first FROM v GROUP BY ALL""",
    "review_completion": """WITH l AS (SELECT l_orderkey, (l_orderkey + l_linenumber) % 3 > 0 AS critical, CASE WHEN (l_orderkey + l_linenumber) % 4 <> 0 OR l_orderkey % 3 = 0 THEN CASE (l_orderkey + l_linenumber) % 2 WHEN 0 THEN 'APPROVE' ELSE 'REJECT' END END AS d FROM lineitem)
      SELECT l_orderkey, count(*) FILTER (d IS NULL) AS open, count(*) FILTER (critical AND d IS NULL) AS critical_open, count(*) FILTER (d = 'REJECT') AS rejected, count(*) FILTER (d IS NULL) = 0 AS complete FROM l GROUP BY 1""",
    "fact_checks": """WITH f AS (SELECT o_orderkey, o_custkey AS k, o_orderkey % 8 AS kind, o_custkey % 3 = 0 AS off, (['GT', 'GTE', 'LTE', 'EQ'])[(o_custkey // 6) % 4 + 1] AS op FROM orders),
      r AS (SELECT o_orderkey, CASE kind WHEN 0 THEN CASE WHEN off THEN 'VALUE_CONFLICT' ELSE 'DIRECT_MATCH' END
        WHEN 1 THEN CASE k % 3 WHEN 0 THEN 'PERIOD_CONFLICT' ELSE 'NORMALIZED_EQUIVALENCE' END
        WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'SUBJECT_MISMATCH' WHEN off THEN 'VALUE_CONFLICT' ELSE 'NORMALIZED_EQUIVALENCE' END
        WHEN 3 THEN CASE WHEN k % 3 = 0 THEN CASE WHEN (k // 3) % 2 = 0 THEN 'LOGICAL_CONNECTOR_CONFLICT' ELSE 'NORMALIZED_EQUIVALENCE' END WHEN k % 3 = 1 AND (k // 3) % 2 = 0 THEN 'NORMALIZED_EQUIVALENCE' ELSE 'INSUFFICIENT_CONTEXT' END
        WHEN 4 THEN CASE WHEN k % 2 = 0 THEN 'NEGATION_CONFLICT' ELSE 'INSUFFICIENT_CONTEXT' END WHEN 5 THEN CASE WHEN k % 2 = 0 THEN 'OPERATOR_CONFLICT' ELSE 'INSUFFICIENT_CONTEXT' END
        WHEN 6 THEN CASE WHEN k % 28 = k % 27 THEN 'NORMALIZED_EQUIVALENCE' ELSE 'INSUFFICIENT_CONTEXT' END
        ELSE CASE WHEN k % 6 = 5 THEN 'EVIDENCE_MISSING' WHEN off THEN 'VALUE_CONFLICT' WHEN (k % 6 = 2 AND op = 'GTE') OR (k % 6 = 3 AND op = 'EQ') OR (k % 6 = 0 AND op = 'GT') THEN 'OPERATOR_CONFLICT'
          WHEN (k % 6 = 0 AND op = 'LTE') OR (k % 6 = 1 AND op = 'GTE') THEN 'NORMALIZED_EQUIVALENCE' WHEN (k % 6 = 3 AND op = 'LTE') OR (k % 6 IN (2, 4) AND op = 'EQ') THEN 'NUMERIC_MATCH' ELSE 'NORMALIZED_EQUIVALENCE' END END AS reason FROM f)
      SELECT o_orderkey, CASE WHEN reason IN ('EVIDENCE_MISSING', 'INSUFFICIENT_CONTEXT') THEN 'NOT_ENOUGH_EVIDENCE' WHEN reason LIKE '%CONFLICT' OR reason = 'SUBJECT_MISMATCH' THEN 'CONTRADICTED' ELSE 'SUPPORTED' END AS result, reason FROM r""",
    "review_guard": """WITH i AS (SELECT l_orderkey, count(*) FILTER (NOT l_discount > 0.005) AS open, count(*) FILTER (l_discount > 0.005 AND l_returnflag <> 'R' AND (l_quantity > 48 OR l_quantity < 2) AND NOT l_tax > 0.02) AS bare FROM lineitem GROUP BY 1),
      s AS (SELECT o_orderkey AS l_orderkey, list_filter([CASE WHEN o_totalprice > 400000 THEN 'STALE' END, CASE WHEN open > 0 THEN 'PENDING' END, CASE WHEN o_orderstatus = 'P' AND floor(o_totalprice)::BIGINT % 2 = 1 THEN 'BLOCKERS' END, CASE WHEN bare > 0 THEN 'UNEXPLAINED' END], lambda x: x IS NOT NULL) AS why
        FROM orders LEFT JOIN i ON i.l_orderkey = o_orderkey) SELECT l_orderkey, array_to_string(why, ',') AS reasons, len(why) = 0 AS complete FROM s""",
}
