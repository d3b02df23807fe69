"""Watched pages, candidate quality and more document functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as d
from ..functions import speech
from ..functions.text import indian_number
from ..operators import dedup, evaluation, pages, retrieval
from .read_plans import _read
from .search_plans import ORACLE_SQL as _SEARCH
from .text_plans import PHRASES, phrases

_LINES = [
    "Eligibility criteria", "पात्रता की शर्तें", "Who is ineligible", "Documents required:", "monthly pension of Rs. 1,150", "Scholarship of ₹ 2 lakh in 2025", "How to apply", "Helpline", "loan up to 5 lakh rupees", "a line that says nothing", "2026",
    "Benefits: " + "x" * 90, "y" * 90 + " benefits", "Budget ceiling", "नकद सहायता रुपये 500", "",
]


def _looks(spark, sf_dir):
    """The pages now, and as they were: every fourth link was another, and every fifth had another text."""
    now = pages.links(_read(spark, sf_dir, "pages"), "page_id", "url", "html")
    n = F.length("link") + F.col("page_id")
    before = now.select("page_id", F.when(n % 4 == 0, F.concat("link", F.lit("/old"))).otherwise(F.col("link")).alias("link"), F.when(n % 5 == 0, "was").otherwise(F.col("anchor")).alias("anchor"))
    return before, now


def page_link_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page, resolved against its url, and the first text of each."""
    out = pages.links(_read(spark, sf_dir, "pages"), "page_id", "url", "html")
    return out.groupBy("page_id").agg(F.count("*").alias("n"), F.min("link").alias("first"), F.max("link").alias("last"), F.min("anchor").alias("anchor"))


def page_link_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.link_changes(*_looks(spark, sf_dir), "page_id").groupBy("page_id", "change").agg(F.count("*").alias("n"), F.min("link").alias("first"))


def links_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two changed links a page, by reason and address."""
    return pages.to_fetch(pages.link_changes(*_looks(spark, sf_dir), "page_id"), "page_id", 2).withColumn("rank", F.col("rank").cast("long"))


def candidate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines of large quantity as relevant, those of low price as candidates: recall, precision and lost ones, also of open orders alone."""
    n = F.col("l_linenumber")
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_quantity") > 25, n)).alias("gold"), F.collect_set(F.when(F.col("l_extendedprice") < 40000, n)).alias("found"), F.max(F.col("l_linestatus") == "O").alias("unknown"))
    hit, gold, found = F.size(F.array_intersect("gold", "found")), F.size("gold"), F.size("found")
    total = lambda c: F.sum(c).cast("double")
    one = lambda c: F.when(F.col("unknown"), c).otherwise(0)
    return lines.agg(
        F.count("*").alias("cases"), F.round(evaluation.ratio(total(hit), total(gold), 1.0), 4).alias("recall"), F.round(evaluation.ratio(total(hit), total(found)), 4).alias("precision"),
        F.round(evaluation.ratio(total(one(hit)), total(one(gold)), 1.0), 4).alias("unknown_recall"), F.sum(one(gold - hit)).alias("unknown_lost"),
    )


def benefit_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([*enumerate(_LINES)], "id long, s string")
    c = F.col("s")
    return rows.select("id", d.benefit_type(c).alias("type"), d.benefit_amount(indian_number(c)).alias("amount"), d.currency(c).alias("currency"))


def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([*enumerate(_LINES)], "id long, s string").select("id", d.section_heading(F.col("s")).alias("section"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", d.transcript(F.col("text")).alias("s"))
    return turns.unionByName(phrases(spark).select("id", F.lit(-1).cast("long").alias("turn"), d.transcript(F.col("s")).alias("s")))


_SPOKEN = [
    ("डेढ़ लाख", 150000), ("ढाई हजार रुपये", 2500), ("सवा दो लाख", 225000), ("साढ़े तीन हजार", 3500), ("पौने दो लाख", 175000), ("मेरी उम्र साठ वर्ष", 60), ("पांच लाख", 500000), ("२.५ लाख", 250000), ("Rs 1,150 a month", 1150), ("sadhe 4 lakh", 450000),
    ("sawa lakh", 125000), ("दो सौ", 200), ("nothing said", None), ("", None), ("पचास हजार।", 50000), ("dhai crore", 25000000),
]
_PLACES = {"jaipur": "Jaipur", "pink city": "Jaipur", "kota": "Kota", "sri ganganagar": "Ganganagar", "जयपुर": "Jaipur", "ba": "Banswara"}
_SAID = ["Jaipur", "I live in the Pink City, sir", "from Kota.", "Sri Ganganagar", "near sri  ganganagar", "मैं जयपुर से", "ba", "in ba now", "nowhere", ""]


def spoken_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_SPOKEN)], "id long, s string")
    return rows.select("id", speech.spoken_number(F.col("s")).alias("value"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([*enumerate(_SAID)], "id long, s string").select("id", speech.place(F.col("s"), _PLACES).alias("place"))


def filtered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status and the start of their priority; the filters that are not given (customer, least price) filter nothing."""
    o = _read(spark, sf_dir, "orders")
    wanted = {"o_orderstatus": "O", "o_custkey": None, "o_totalprice": None}
    return retrieval.listed(o, wanted, {"o_orderpriority": "urg"}, [F.desc("o_totalprice"), F.col("o_orderkey")], 5, 15).select("o_orderkey", "o_totalprice")


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's most similar earlier one, versions (here: of even ids) first."""
    pairs = dedup.classify(dedup.jaccard_pairs(_read(spark, sf_dir, "documents"), "doc_id", "text", dedup.VERSION), F.col("a") % 2 == 0)
    best = F.max_by(F.struct("a", "similarity", "kind"), F.struct((F.col("kind") == "POSSIBLE_VERSION").alias("v"), "similarity", (-F.col("a")).alias("a")))
    return pairs.groupBy("b").agg(best.alias("r")).select("b", "r.*")


QUERIES = {f.__name__: f for f in (spoken_numbers, places, filtered_listing, best_candidates, page_link_list, page_link_changes, links_to_fetch, candidate_quality, benefit_phrases, section_headings, transcripts)}
_L = r"""a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS h, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS t,
    generate_subscripts(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>', 1), 1) AS i FROM pages),
  l AS (SELECT page_id, origin || h AS link, coalesce(arg_min(trim(regexp_replace(t, '\s+', ' ', 'g')), i) FILTER (trim(t) <> ''), '') AS anchor FROM a WHERE h LIKE '/%' GROUP BY 1, 2),
  b AS (SELECT page_id, CASE WHEN (length(link) + page_id) % 4 = 0 THEN link || '/old' ELSE link END AS link, CASE WHEN (length(link) + page_id) % 5 = 0 THEN 'was' ELSE anchor END AS anchor FROM l),
  c AS (SELECT page_id, link, coalesce(l.anchor, b.anchor) AS anchor, CASE WHEN b.anchor IS NULL THEN 'LINK_ADDED' WHEN l.anchor IS NULL THEN 'LINK_REMOVED' WHEN l.anchor <> b.anchor THEN 'LINK_CHANGED' END AS change FROM b FULL JOIN l USING (page_id, link))"""
_ROWS = ", ".join(f"({i}::BIGINT, '{s}')" for i, s in enumerate(_LINES))
_T = "trim(regexp_replace(regexp_replace(lower(translate({}, '०१२३४५६७८९', '0123456789')), '[।॥.,!?;:\"''()\\[\\]{{}}\\-–—_/\\\\]', ' ', 'g'), '\\s+', ' ', 'g'))"
# A number's parts are looked up word by word: the first word that is a number, the fraction before it and the scale after it.
_NUMBERS = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in (speech.CARDINALS | speech.ALONE).items())
_FRACTIONS = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in speech.FRACTIONS.items())
_SCALES = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in speech._HUNDRED.items())
ORACLE_SQL = {
    "spoken_numbers": f"""WITH p(id, s) AS (VALUES {", ".join(f"({i}::BIGINT, '{t}')" for i, (t, _) in enumerate(_SPOKEN))}), n(w, v) AS (VALUES {_NUMBERS}), f(w, v) AS (VALUES {_FRACTIONS}), k(w, v) AS (VALUES {_SCALES}),
      l AS (SELECT id, string_split(lower(translate(replace(s, '।', ''), '०१२३४५६७८९', '0123456789')), ' ') AS w FROM p), ws AS (SELECT id, w AS ws, unnest(range(1, len(w) + 1)) AS i FROM l),
      v AS (SELECT id, i, ws, coalesce(n.v, try_cast(replace(ws[i], ',', '') AS DOUBLE)) AS v, f.v AS f FROM ws LEFT JOIN n ON n.w = ws[i] LEFT JOIN f ON f.w = ws[i]),
      b AS (SELECT * FROM v WHERE v IS NOT NULL OR f IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) = 1),
      x AS (SELECT b.id, coalesce(b.v, n.v, try_cast(replace(b.ws[b.i + 1], ',', '') AS DOUBLE), 1) + coalesce(b.f, 0) AS v, b.ws[b.i + CASE WHEN b.v IS NULL AND (n.v IS NOT NULL OR try_cast(b.ws[b.i + 1] AS DOUBLE) IS NOT NULL) THEN 2 ELSE 1 END] AS scale FROM b LEFT JOIN n ON n.w = b.ws[b.i + 1])
      SELECT p.id, x.v * coalesce(k.v, 1) AS value FROM p LEFT JOIN x ON x.id = p.id LEFT JOIN k ON k.w = x.scale""",
    "places": f"""WITH p(id, s) AS (VALUES {", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(_SAID))}), n(k, v) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _PLACES.items())}),
      t AS (SELECT id, trim(regexp_replace(lower(s), '[,.!?।\\s]+', ' ', 'g')) AS t FROM p), w AS (SELECT id, string_split(t, ' ') AS w, unnest(range(1, len(string_split(t, ' ')) + 1)) AS i FROM t),
      c AS (SELECT id, 0 AS o, 0 AS i, t AS k FROM t UNION ALL SELECT id, 1, i, w[i] || ' ' || w[i + 1] FROM w WHERE i < len(w) UNION ALL SELECT id, 2, i, w[i] FROM w WHERE length(w[i]) > 2)
      SELECT id, (SELECT v FROM c JOIN n USING (k) WHERE c.id = p.id ORDER BY o, i LIMIT 1) AS place FROM p""",
    "filtered_listing": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority ILIKE '%urg%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5",
    "best_candidates": f"SELECT b, a, similarity, kind FROM ({_SEARCH['jaccard_pairs']}) QUALIFY row_number() OVER (PARTITION BY b ORDER BY kind = 'POSSIBLE_VERSION' DESC, similarity DESC, a) = 1",
    "page_link_list": f"WITH {_L} SELECT page_id, count(*) AS n, min(link) AS first, max(link) AS last, min(anchor) AS anchor FROM l GROUP BY 1",
    "page_link_changes": f"WITH {_L} SELECT page_id, change, count(*) AS n, min(link) AS first FROM c WHERE change IS NOT NULL GROUP BY 1, 2",
    "links_to_fetch": f"""WITH {_L}, r AS (SELECT page_id, link, CASE WHEN change = 'LINK_CHANGED' THEN 'CHANGED_LINK' ELSE 'NEW_LINK' END AS reason FROM c WHERE change IN ('LINK_ADDED', 'LINK_CHANGED'))
      SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY reason = 'CHANGED_LINK', link) AS rank FROM r QUALIFY rank <= 2""",
    "candidate_quality": """WITH o AS (SELECT l_orderkey, coalesce(list(DISTINCT l_linenumber) FILTER (l_quantity > 25), []) AS g, coalesce(list(DISTINCT l_linenumber) FILTER (l_extendedprice < 40000), []) AS f, bool_or(l_linestatus = 'O') AS u FROM lineitem GROUP BY 1),
      n AS (SELECT len(list_intersect(g, f)) AS hit, len(g) AS g, len(f) AS f, u FROM o)
      SELECT count(*) AS cases, round(CASE WHEN sum(g) > 0 THEN sum(hit) / sum(g) ELSE 1 END, 4) AS recall, round(CASE WHEN sum(f) > 0 THEN sum(hit) / sum(f) ELSE 0 END, 4) AS precision,
        round(CASE WHEN sum(g) FILTER (u) > 0 THEN sum(hit) FILTER (u) / sum(g) FILTER (u) ELSE 1 END, 4) AS unknown_recall, coalesce(sum(g - hit) FILTER (u), 0)::BIGINT AS unknown_lost FROM n""",
    "benefit_phrases": rf"""WITH p(id, s) AS (VALUES {_ROWS}), q AS (SELECT id, lower(translate(s, '०१२३४५६७८९', '0123456789')) AS t FROM p),
      n AS (SELECT *, coalesce(try_cast(replace(regexp_extract(t, '([0-9][0-9,]*[.]?[0-9]*)\s*lakh', 1), ',', '') AS DOUBLE) * 100000, try_cast(replace(regexp_extract(t, '([0-9][0-9,]*([.][0-9]+)?)', 1), ',', '') AS DOUBLE)) AS v FROM q)
      SELECT id, CASE WHEN t LIKE '%pension%' THEN 'PENSION' WHEN t LIKE '%scholarship%' THEN 'SCHOLARSHIP' WHEN t LIKE '%loan%' THEN 'LOAN' WHEN t LIKE '%नकद%' THEN 'CASH' ELSE 'OTHER' END AS type, CASE WHEN v NOT IN (2024, 2025, 2026, 2027) THEN v END AS amount,
        CASE WHEN regexp_matches(t, '₹|\brs\b|rupee|रुपये') THEN 'INR' END AS currency FROM n""",
    "section_headings": rf"""WITH p(id, s) AS (VALUES {_ROWS}), h AS (SELECT id, lower(CASE WHEN length(s) <= 80 THEN s ELSE regexp_extract(s, '^([^:]{{1,40}}):', 1) END) AS t FROM p)
      SELECT id, CASE WHEN regexp_matches(t, '\bineligible\b') THEN 'EXCLUSIONS' WHEN regexp_matches(t, '\b(eligibility|criteria)\b|पात्रता') THEN 'ELIGIBILITY' WHEN regexp_matches(t, '\b(benefits?|scholarship)\b') THEN 'BENEFITS' WHEN regexp_matches(t, '\bdocuments?\b') THEN 'DOCUMENTS_REQUIRED'
        WHEN t LIKE '%how to apply%' THEN 'APPLICATION_PROCESS' WHEN regexp_matches(t, '\b(budget|ceiling)\b') THEN 'FINANCIAL_RULES' WHEN regexp_matches(t, '\bhelpline\b') THEN 'CONTACTS' END AS section FROM h""",
    "transcripts": f"SELECT conv_id AS id, turn, {_T.format('text')} AS s FROM conversations UNION ALL SELECT id, -1, {_T.format('s')} FROM (VALUES {', '.join(f'({i}::BIGINT, {s!r})' for i, s in PHRASES)}) AS p(id, s)",
}
