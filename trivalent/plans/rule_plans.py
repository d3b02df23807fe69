"""Rule matching over customers as profiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import questions, rules

ON = date(2024, 6, 1)
SCHEMES = [
    {
        "id": "S1", "valid_from": date(2024, 1, 1), "valid_until": None,
        "rule": {"type": "AND", "children": [
            {"field": "age", "operator": "GTE", "value": 45}, {"field": "income", "operator": "LTE", "value": 6000},
            {"type": "OR", "children": [{"field": "segment", "operator": "IN", "value": ["BUILDING", "Machinery"]}, {"field": "has_card", "operator": "EQ", "value": True}]}]},
        "exclusions": [{"id": "X1", "mandatory_check": True, "rule": {"field": "segment", "operator": "EQ", "value": " household "}}],
        "preferences": [{"field": "age", "operator": "GTE", "value": 70}],
    },
    {
        "id": "S2", "valid_from": None, "valid_until": date(2024, 3, 31),
        "rule": {"type": "AND", "children": [{"field": "income", "operator": "BETWEEN", "value": [0, 5000]}, {"type": "NOT", "children": [{"field": "segment", "operator": "EQ", "value": "FURNITURE"}]}]},
        "exclusions": [{"id": "X2", "mandatory_check": False, "rule": {"field": "has_card", "operator": "EQ", "value": False}}],
    },
    {
        "id": "S3", "valid_from": date(2024, 9, 1), "valid_until": None,
        "rule": {"type": "OR", "children": [{"field": "age", "operator": "LT", "value": 30}, {"type": "AND", "children": [{"field": "segment", "operator": "EQ", "value": "automobile"}, {"field": "income", "operator": "GT", "value": 7000}]}]},
    },
]


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as profiles; some fields are unknown for some."""
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("profile_id"),
        F.when(k % 7 != 0, (18 + k % 60).cast("int")).alias("age"),
        F.when(k % 5 != 0, F.col("c_acctbal")).alias("income"),
        F.when(k % 11 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(k % 3 != 0, k % 2 == 0).alias("has_card"),
    )


_PROFILES = """p AS (SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 7 <> 0 THEN (18 + c_custkey % 60)::INT END AS age, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS income,
  CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 2 = 0 END AS has_card FROM customer)"""
_STATES = (
    f"WITH {_PROFILES}"
    """, r AS (SELECT *, age >= 45 AND income <= 6000 AND (lower(segment) IN ('building', 'machinery') OR has_card) AS p1, lower(segment) = 'household' AS x1,
    income BETWEEN 0 AND 5000 AND NOT lower(segment) = 'furniture' AS p2, NOT has_card AS x2, age < 30 OR (lower(segment) = 'automobile' AND income > 7000) AS p3 FROM p),
  s AS (
    SELECT profile_id, 'S1' AS scheme_id, 'ACTIVE' AS availability, CASE WHEN p1 = false OR x1 THEN 'NOT_ELIGIBLE' WHEN p1 IS NULL OR x1 IS NULL THEN 'MORE_INFORMATION_REQUIRED' ELSE 'ELIGIBLE' END AS status FROM r
    UNION ALL SELECT profile_id, 'S2', 'EXPIRED', CASE WHEN p2 = false OR x2 THEN 'NOT_ELIGIBLE' WHEN p2 IS NULL THEN 'MORE_INFORMATION_REQUIRED' ELSE 'ELIGIBLE' END FROM r
    UNION ALL SELECT profile_id, 'S3', 'NOT_YET_ACTIVE', CASE WHEN p3 = false THEN 'NOT_ELIGIBLE' WHEN p3 IS NULL THEN 'MORE_INFORMATION_REQUIRED' ELSE 'ELIGIBLE' END FROM r)"""
)


def rule_eval_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profile's status under each scheme."""
    return rules.evaluate(profiles(spark, sf_dir), SCHEMES, ON).select("profile_id", "scheme_id", "availability", "status")


def rule_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_eval_status(spark, sf_dir).groupBy("scheme_id", "status").agg(F.count("*").alias("n"))


def rule_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each open decision needs, in the order of evaluation."""
    out = rules.evaluate(profiles(spark, sf_dir), SCHEMES, ON).where("status = 'MORE_INFORMATION_REQUIRED'")
    return out.select("profile_id", "scheme_id", F.array_join("missing", ",").alias("missing"))


def rule_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.evaluate(profiles(spark, sf_dir), SCHEMES, ON)
    return out.where("exclusion is not null").groupBy("scheme_id", "exclusion").agg(F.count("*").alias("n"))


def rule_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trees as rows: states by profile and scheme."""
    p = profiles(spark, sf_dir)
    none = F.lit(None)
    fact = lambda name, num=none, text=none, flag=none: F.struct(F.lit(name).alias("field"), num.cast("double").alias("num"), text.cast("string").alias("str"), flag.cast("boolean").alias("flag_value"))
    facts = p.select("profile_id", F.explode(F.array(fact("age", F.col("age")), fact("income", F.col("income")), fact("segment", text=F.col("segment")), fact("has_card", flag=F.col("has_card")))).alias("f")).select("profile_id", "f.*")
    rows = rules.nodes_of(SCHEMES)
    return rules.evaluate_nodes(facts, spark.createDataFrame(rows, rules.NODES), max(r[3] for r in rows)).withColumn("state", F.col("state").cast("long"))


def next_question_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profile's most useful question."""
    results = rules.evaluate(profiles(spark, sf_dir), SCHEMES, ON)
    relevance = F.when(F.col("scheme_id") == "S1", 0.8).when(F.col("scheme_id") == "S2", 0.5).otherwise(0.2)
    scores = questions.utilities(results, "profile_id", relevance, asked=["age"], sensitive={"income": 1.0})
    return questions.next_question(scores, "profile_id").select("profile_id", "field", "affected", F.round("utility", 4).alias("utility"))


def one_field_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemes that a single known field would decide, by field."""
    out = rules.evaluate(profiles(spark, sf_dir), SCHEMES, ON).where("status = 'MORE_INFORMATION_REQUIRED' and size(missing) = 1")
    return out.groupBy(F.col("missing")[0].alias("field")).agg(F.count("*").alias("n"), F.countDistinct("profile_id").alias("profiles"))


def near_miss_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far profiles that fail S1 by income alone are above its limit, ranked by the gap."""
    from pyspark.sql import Window

    rest, _ = rules.compiled({"type": "AND", "children": SCHEMES[0]["rule"]["children"][0::2]})
    gap = F.round(F.col("income") - 6000, 2)
    out = profiles(spark, sf_dir).where(rest & (F.col("income") > 6000)).select("profile_id", "segment", gap.alias("gap"))
    w = Window.partitionBy("segment").orderBy("gap", "profile_id")
    return out.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


# A condition's field is missing when null; the SQL walks the trees by hand.
_MISSING = f"""WITH {_PROFILES}, a AS (SELECT *, age >= 45 AS c1, income <= 6000 AS c2, lower(segment) IN ('building', 'machinery') AS c3, lower(segment) = 'household' AS x1,
    income BETWEEN 0 AND 5000 AS d1, lower(segment) = 'furniture' AS d2, age < 30 AS e1, lower(segment) = 'automobile' AS e2, income > 7000 AS e3 FROM p),
  b AS (SELECT *, c1 AND c2 AND (c3 OR has_card) AS p1, d1 AND NOT d2 AS p2, e1 OR (e2 AND e3) AS p3 FROM a),
  m AS (
    SELECT profile_id, 'S1' AS scheme_id, list_filter([CASE WHEN age IS NULL THEN 'age' END, CASE WHEN c1 IS DISTINCT FROM false AND income IS NULL THEN 'income' END,
      CASE WHEN c1 IS DISTINCT FROM false AND c2 IS DISTINCT FROM false AND (c3 OR has_card) IS NOT TRUE AND segment IS NULL THEN 'segment' END,
      CASE WHEN c1 IS DISTINCT FROM false AND c2 IS DISTINCT FROM false AND (c3 OR has_card) IS NOT TRUE AND has_card IS NULL THEN 'has_card' END,
      CASE WHEN x1 IS NULL AND (c3 OR has_card) IS TRUE THEN 'segment' END], lambda x: x IS NOT NULL) AS f FROM b WHERE (p1 = false OR x1) IS NOT TRUE AND (p1 IS NULL OR x1 IS NULL)
    UNION ALL SELECT profile_id, 'S2', list_filter([CASE WHEN income IS NULL THEN 'income' END, CASE WHEN d1 IS DISTINCT FROM false AND segment IS NULL THEN 'segment' END], lambda x: x IS NOT NULL)
      FROM b WHERE p2 IS NULL AND (has_card = false) IS NOT TRUE
    UNION ALL SELECT profile_id, 'S3', list_filter([CASE WHEN age IS NULL THEN 'age' END, CASE WHEN segment IS NULL THEN 'segment' END, CASE WHEN e2 IS DISTINCT FROM false AND income IS NULL THEN 'income' END], lambda x: x IS NOT NULL)
      FROM b WHERE p3 IS NULL)"""

QUERIES = {f.__name__: f for f in (rule_eval_status, rule_status_counts, rule_missing_fields, rule_exclusions, rule_tree_rollup, next_question_utility, one_field_away, near_miss_gap)}
ORACLE_SQL = {
    "rule_eval_status": f"{_STATES} SELECT * FROM s",
    "rule_status_counts": f"{_STATES} SELECT scheme_id, status, count(*) AS n FROM s GROUP BY ALL",
    "rule_missing_fields": f"{_MISSING} SELECT profile_id, scheme_id, array_to_string(f, ',') AS missing FROM m",
    "rule_exclusions": f"{_STATES} SELECT 'S1' AS scheme_id, 'X1' AS exclusion, count(*) AS n FROM r WHERE x1 AND p1 IS DISTINCT FROM false UNION ALL SELECT 'S2', 'X2', count(*) FROM r WHERE x2 AND p2 IS DISTINCT FROM false",
    "rule_tree_rollup": f"{_STATES} SELECT profile_id, k AS scheme_id, CASE WHEN v THEN 2 WHEN NOT v THEN 0 ELSE 1 END::BIGINT AS state FROM (SELECT profile_id, 'S1' AS k, p1 AS v FROM r UNION ALL SELECT profile_id, 'S2', p2 FROM r UNION ALL SELECT profile_id, 'S3', p3 FROM r)",
    "next_question_utility": f"""{_MISSING}, u AS (SELECT profile_id, unnest(f) AS field, len(f) = 1 AS last, CASE scheme_id WHEN 'S1' THEN 0.8 WHEN 'S2' THEN 0.5 ELSE 0.2 END::DOUBLE AS rel FROM m),
  g AS (SELECT profile_id, field, count(*) AS affected, round(sum(1 + 1.5::DOUBLE * rel + 2.0::DOUBLE * last::INT) - CASE WHEN field = 'income' THEN 0.5 ELSE 0 END::DOUBLE - CASE WHEN field = 'age' THEN 3 ELSE 0 END, 4) AS utility FROM u GROUP BY profile_id, field)
  SELECT profile_id, field, affected, utility FROM g QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY utility DESC, affected DESC, field) = 1""",
    "one_field_away": f"{_MISSING} SELECT f[1] AS field, count(*) AS n, count(DISTINCT profile_id) AS profiles FROM m WHERE len(f) = 1 GROUP BY ALL",
    "near_miss_gap": f"""WITH {_PROFILES} SELECT profile_id, segment, round(income - 6000, 2) AS gap, row_number() OVER (PARTITION BY segment ORDER BY round(income - 6000, 2), profile_id)::INT AS rank
  FROM p WHERE age >= 45 AND (lower(segment) IN ('building', 'machinery') OR has_card) AND income > 6000 QUALIFY rank <= 10""",
}
