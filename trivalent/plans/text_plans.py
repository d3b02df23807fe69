"""Scalar functions over the tables, and over literal rows where no table has such text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

PHRASES = [
    (1, "income not exceeding 2.5 lakh per annum"), (2, "आयु ६० वर्ष से अधिक"), (3, "between 18 and 40 years"), (4, "at least 40% marks"), (5, "pension of Rs 1,150 per month"),
    (6, "on or before 31/03/2026"), (7, "effective 2024-04-01"), (8, "less than 5 crore"), (9, "up to 75 percent subsidy"), (10, "one time grant"), (11, "no limit"), (12, "कम से कम १.५ लाख"), (13, ""),
    (14, "income exceeding 5 lakh"), (15, "60 वर्ष या अधिक"), (16, "आयु 18 से ज्यादा"), (17, "18 से 40 वर्ष"), (18, "२ लाख से ज्यादा नहीं"), (19, "5/6/2027 for 3 months"), (20, "31-13-2026"), (21, "not less than 3 days, quarterly")
]
_VALUES = "p(id, s) AS (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in PHRASES) + "), q AS (SELECT id::BIGINT AS id, s, lower(translate(s, '०१२३४५६७८९', '0123456789')) AS t FROM p)"


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PHRASES, "id long, s string")


def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(spark).select("id", t.indian_number(F.col("s")).alias("value"), t.percentage(F.col("s")).alias("percent"))


def bound_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(spark).select("id", t.bound_operator(F.col("s")).alias("operator"), t.periodicity(F.col("s")).alias("period"), t.unit(F.col("s")).alias("unit"))


def date_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, unit = t.duration(F.col("s"))
    return phrases(spark).select("id", t.parsed_date(F.col("s")).cast("string").alias("day"), value.cast("long").alias("n"), unit.alias("unit"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", t.estimated_tokens(F.col("text")).alias("tokens"))


def turn_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.groupBy("role", t.intent(F.col("text")).alias("intent"), t.negated(F.col("text")).alias("negated")).agg(F.count("*").alias("n"))


def garbled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy(t.ocr_decision(F.col("text")).alias("decision")).agg(F.count("*").alias("n"))


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", t.normalized_url(F.col("url")).alias("url"), t.resource_type(F.col("url")).alias("kind"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct links of a page, without fragments."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = F.transform(F.regexp_extract_all("html", F.lit(r'href="([^"#]*)'), F.lit(1)), lambda u: u)
    return pages.select("page_id", F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("links"))


def body_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page without comments and with white space made plain, hashed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    body = t.collapsed(F.regexp_replace("html", r"(?s)<!--.*?-->", ""))
    return pages.select("page_id", F.sha2(body, 256).alias("fingerprint"))


_SCALE = "CASE regexp_extract(t, '[0-9][0-9,]*[.]?[0-9]*\\s*(thousand|lakh|crore|लाख)', 1) WHEN 'thousand' THEN 1000 WHEN 'lakh' THEN 100000 WHEN 'लाख' THEN 100000 WHEN 'crore' THEN 10000000 END"
_BOUNDS = " ".join(f"WHEN regexp_matches(t, '{t.phrase_pattern(phrases)}') THEN '{operator}'" for operator, phrases in t.BOUNDS)
QUERIES = {f.__name__: f for f in (number_parse, bound_operator, date_expression, token_estimate, turn_intents, garbled_text, url_normalize, page_links, body_fingerprint)}
ORACLE_SQL = {
    "number_parse": rf"""WITH {_VALUES} SELECT id, coalesce(try_cast(replace(regexp_extract(t, '([0-9][0-9,]*[.]?[0-9]*)\s*(thousand|lakh|crore|लाख)', 1), ',', '') AS DOUBLE) * {_SCALE},
      try_cast(replace(regexp_extract(t, '([0-9][0-9,]*(?:[.][0-9]+)?)', 1), ',', '') AS DOUBLE)) AS value, try_cast(regexp_extract(t, '([0-9]+(?:[.][0-9]+)?)\s*(%|percent)', 1) AS DOUBLE) AS percent FROM q""",
    "bound_operator": rf"""WITH {_VALUES} SELECT id, CASE
      WHEN NOT regexp_matches(t, 'से\s*(अधिक|ज्यादा|कम)') AND regexp_matches(t, 'between\s+[0-9].*and\s+[0-9]|(^|[^0-9-])[0-9]+\s*(-|to|से)\s*[0-9]+($|[^0-9-])') THEN 'BETWEEN'
      {_BOUNDS} WHEN regexp_matches(t, '[0-9]') THEN 'EQ' END AS operator,
      CASE WHEN regexp_matches(t, 'month|प्रति माह|मासिक') THEN 'MONTHLY' WHEN regexp_matches(t, 'quarter|त्रैमासिक') THEN 'QUARTERLY' WHEN regexp_matches(t, 'annual|year|per annum|वार्षिक|प्रति वर्ष') THEN 'ANNUAL'
      WHEN regexp_matches(t, 'one.?time|lump ?sum|एकमुश्त') THEN 'ONE_TIME' END AS period,
      CASE WHEN regexp_matches(t, 'वर्ष|साल|year|yr') THEN 'years' WHEN regexp_matches(t, 'माह|महीने|month') THEN 'months' WHEN regexp_matches(t, 'दिन|day') THEN 'days' WHEN regexp_matches(t, '%|प्रतिशत|percent') THEN 'PERCENT'
      WHEN regexp_matches(t, '₹|rs|rupee|रुपये|रुपए') THEN 'INR' END AS unit FROM q""",
    "date_expression": rf"""WITH {_VALUES}, e AS (SELECT id, regexp_extract(t, '((19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS iso, regexp_extract(t, '\b([0-9]{{1,2}})[/.-]([0-9]{{1,2}})[/.-](20[23][0-9])\b', ['d', 'm', 'y']) AS p,
        regexp_extract(t, '([0-9]+)\s*(year|month|week|day|वर्ष|माह|दिन)', ['n', 'u']) AS r FROM q)
      SELECT id, coalesce(try_cast(nullif(iso, '') AS DATE), try_cast(p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') AS DATE))::VARCHAR AS day, try_cast(r.n AS BIGINT) AS n,
        CASE WHEN r.u IN ('year', 'वर्ष') THEN 'YEAR' WHEN r.u IN ('month', 'माह') THEN 'MONTH' WHEN r.u = 'week' THEN 'WEEK' WHEN r.u IN ('day', 'दिन') THEN 'DAY' END AS unit FROM e""",
    "token_estimate": r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM documents), h AS (SELECT doc_id, length(w) AS n, length(regexp_replace(w, '[\x{0900}-\x{097F}]', '', 'g')) AS o FROM w)
      SELECT doc_id, sum(greatest(1, round_even((n - o) * 0.45::DOUBLE, 0) + round_even(o * 0.28::DOUBLE, 0)))::BIGINT AS tokens FROM h GROUP BY doc_id""",
    "turn_intents": r"""SELECT role, CASE WHEN regexp_matches(t, '[?]|^(what|which|how|when|where|why|who)\b') THEN 'QUERY' WHEN regexp_matches(t, '\b(actually|correction|i meant|change)\b') THEN 'CORRECTION'
      WHEN regexp_matches(t, '\b(skip|prefer not|decline)\b|won.t say') THEN 'DECLINE' WHEN regexp_matches(t, 'don.t know|do not know|not sure|no idea') THEN 'UNKNOWN' ELSE 'INFORMATION' END AS intent,
      regexp_matches(t, '(^|[^\p{L}])(not|no|never|none|without|nicht|kein|keine|pas|sans|sin|nunca)($|[^\p{L}])') AS negated, count(*) AS n FROM (SELECT role, lower(trim(text)) AS t FROM conversations) GROUP BY ALL""",
    "garbled_text": r"""WITH g AS (SELECT text, length(text) - length(regexp_replace(text, '[\x{E000}-\x{F8FF}\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g')) AS bad, length(regexp_replace(text, '[^\x{FFFD}]', '', 'g')) AS lost FROM documents)
      SELECT CASE WHEN length(text) > 0 AND bad / length(text) > 0.15 THEN 'GARBLED' WHEN lost >= 3 THEN 'REPLACEMENTS' WHEN length(trim(text)) < 50 THEN 'LITTLE_TEXT' ELSE 'NOT_NEEDED' END AS decision, count(*) AS n FROM g GROUP BY ALL""",
    "url_normalize": r"""SELECT page_id, lower(regexp_extract(url, '^([^:]*)://', 1)) || '://' || lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') || regexp_extract(url, '([?][^#]*)', 1) AS url,
      CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '[.]html?$|/$|/[^./]*$') THEN 'HTML' ELSE 'OTHER' END AS kind FROM pages""",
    "page_links": """SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"#]*)', 1))), ' ') AS links FROM pages""",
    "body_fingerprint": r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '\s+', ' ', 'g'))) AS fingerprint FROM pages",
}
