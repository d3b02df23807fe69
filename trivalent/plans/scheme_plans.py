"""Schemes in words: their criteria as rules, their sections, and the documents that they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import title_tokens
from ..operators import candidates, criteria, diffs, rules, sections
from ..operators.sizes import written


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worded_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as schemes: criteria on age, income or poverty, and on who may apply, in either language."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    years, lakhs = (18 + k).cast("string"), (r + 1).cast("string")
    age = F.when(k % 2 == 0, F.concat(F.lit("Age not less than "), years)).otherwise(F.concat(F.lit("आयु "), years, F.lit(" वर्ष या अधिक")))
    income = F.concat(F.lit("annual income up to "), lakhs, F.lit(".5 lakh or\nBPL card holder"))
    who = F.when(k % 3 == 0, "women or ST category and disability at least 40%").when(k % 3 == 1, "SC, ST; disability of 60 percent")
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat_ws("; ", age, income, who).alias("said"))


def citizen_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as facts; some are not known."""
    k = F.col("c_custkey")
    none = F.lit(None)
    fact = lambda name, num=none, text=none, flag=none: F.struct(F.lit(name).alias("field"), num.cast("double").alias("num"), text.cast("string").alias("str"), flag.cast("boolean").alias("flag_value"))
    facts = F.array(
        fact("age", F.when(k % 7 != 0, 18 + k % 60)), fact("annual_income", F.when(k % 5 != 0, F.col("c_acctbal") * 50)), fact("bpl_status", flag=F.when(k % 9 != 0, k % 4 == 0)),
        fact("gender", text=F.when(k % 11 != 0, F.when(k % 2 == 0, "Female").otherwise("male"))), fact("social_category", text=F.element_at(F.array(F.lit("SC"), F.lit("st"), none.cast("string"), F.lit("OBC")), (k % 4 + 1).cast("int"))),
        fact("disability_percentage", F.when(k % 13 != 0, k % 100)),
    )
    return _read(spark, sf_dir, "customer").select(k.alias("profile_id"), F.explode(facts).alias("f")).select("profile_id", "f.*")


def worded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers each nation's worded criteria take (2), refuse (0) or leave open (1)."""
    nodes = written(criteria.tree_rows(worded_schemes(spark, sf_dir), "id", "said"))  # read by each level
    out = rules.evaluate_nodes(citizen_facts(spark, sf_dir), nodes, 3)
    return out.groupBy(F.col("scheme_id").cast("long").alias("n_nationkey"), F.col("state").cast("long").alias("state")).agg(F.count("*").alias("n"))


WORDED_RULES = """
WITH p AS (SELECT c_custkey % 7 <> 0 AS has_age, 18 + c_custkey % 60 AS age, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal * 50 END AS income, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 4 = 0 END AS bpl,
  CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 2 = 0 END AS female, ['sc', 'st', NULL, 'obc'][c_custkey % 4 + 1] AS cat, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 100 END AS dis FROM customer),
s AS (SELECT n_nationkey, CASE WHEN has_age THEN age >= 18 + n_nationkey END AND (income <= (n_regionkey + 1.5::DOUBLE) * 100000 OR bpl)
  AND CASE n_nationkey % 3 WHEN 0 THEN female OR (cat = 'st' AND dis >= 40) WHEN 1 THEN cat IN ('sc', 'st') AND dis >= 60 ELSE true END AS ok FROM nation, p)
SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN ok THEN 2 WHEN NOT ok THEN 0 ELSE 1 END::BIGINT AS state, count(*) AS n FROM s GROUP BY ALL
"""


def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings above every line of every document; a line's length makes it a heading of one of three levels, or none."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(diffs.lines(F.col("text"))).alias("line", "said"))
    n = F.length("said") % 7
    rows = sections.heading_paths(docs.withColumn("level", F.when(n < 3, n + 1)), "doc_id", "line", "level", "said", 3)
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.size("path").cast("long").alias("depth"), F.md5(F.array_join("path", ">")).alias("path"))


SECTION_PATHS = """
WITH l AS (SELECT doc_id, CASE WHEN text = '' OR text IS NULL THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS ls FROM documents),
r AS (SELECT doc_id, ls, i, length(ls[i]) % 7 AS k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
h AS (SELECT doc_id, ls, i, coalesce(max(CASE WHEN k = 0 THEN i END) OVER w, 0) AS a, coalesce(max(CASE WHEN k = 1 THEN i END) OVER w, 0) AS b, coalesce(max(CASE WHEN k = 2 THEN i END) OVER w, 0) AS c FROM r
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT doc_id, i, list_filter([CASE WHEN a > 0 THEN ls[a] END, CASE WHEN b > a THEN ls[b] END, CASE WHEN c > greatest(a, b) THEN ls[c] END], lambda x: x IS NOT NULL) AS path FROM h)
SELECT doc_id, (i - 1)::BIGINT AS line, len(path)::BIGINT AS depth, md5(array_to_string(path, '>')) AS path FROM p
"""


def _titled(spark: SparkSession, sf_dir: str, id: str) -> DataFrame:
    """Documents with their first line as title, their language as department, and the first long number as citation."""
    title = F.substring_index("text", "\n", 1)
    number = F.regexp_extract("text", "([0-9]{7,})", 1)
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias(id), number.alias("citation"), title.alias("title"), title_tokens(title).alias("tokens"), F.col("lang").alias("department"))


def base_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the earlier one that it most likely belongs to, by citation, name or title."""
    found = candidates.candidates(_titled(spark, sf_dir, "new_id"), _titled(spark, sf_dir, "base_id")).where("base_id < new_id")
    return candidates.best_base(found)


BASE_DOCUMENTS = r"""
WITH d AS (SELECT doc_id, regexp_extract(text, '([0-9]{7,})', 1) AS cite, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '\s+', ' ', 'g')) AS name, lang, string_split(text, chr(10))[1] AS title FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[\p{L}\p{M}\p{N}_]+'), lambda x: length(x) > 2 AND NOT regexp_matches(x, '^[0-9]+$')
  AND x NOT IN ('final', 'copy', 'download', 'new', 'latest', 'doc', 'pdf', 'file', 'draft', 'scan', 'circular', 'notification')))) AS ts FROM d),
c AS (SELECT cite, min(doc_id) AS base, count(*) AS same FROM w WHERE cite <> '' GROUP BY 1), t AS (SELECT lang, name, min(doc_id) AS base, count(*) AS same, min(ts) AS ts FROM w WHERE name <> '' GROUP BY 1, 2),
p AS (SELECT w.doc_id AS n, c.base AS b, 1.0::DOUBLE AS score, 'CITATION' AS kind, same FROM w JOIN c USING (cite)
  UNION ALL SELECT w.doc_id, t.base, 0.95::DOUBLE, 'NAME', t.same FROM w JOIN t ON t.lang = w.lang AND t.name = w.name
  UNION ALL SELECT * FROM (SELECT w.doc_id, t.base, len(list_intersect(w.ts, t.ts))::DOUBLE / (len(w.ts) + len(t.ts) - len(list_intersect(w.ts, t.ts))) AS s, 'TITLE', t.same FROM w JOIN t ON t.lang = w.lang WHERE len(w.ts) > 0 AND len(t.ts) > 0) WHERE s >= 0.5),
q AS (SELECT n, b, round(score, 4) AS score, kind, same FROM p WHERE b < n QUALIFY row_number() OVER (PARTITION BY n, b ORDER BY p.score DESC, kind DESC, same DESC) = 1),
x AS (SELECT *, max(score) OVER (PARTITION BY n) AS top, count(*) OVER (PARTITION BY n) AS many FROM q),
y AS (SELECT *, count(*) FILTER (round(top - score, 4) < 0.1) OVER (PARTITION BY n) AS near FROM x)
SELECT n AS new_id, b AS base_id, kind, score, many AS n_bases, near > 1 OR same > 1 AS conflict FROM y QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, b) = 1
"""

QUERIES = {f.__name__: f for f in (worded_rules, section_paths, base_documents)}
ORACLE_SQL = {"worded_rules": WORDED_RULES, "section_paths": SECTION_PATHS, "base_documents": BASE_DOCUMENTS}
