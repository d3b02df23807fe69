"""The read path over the tables: profiles, candidates, discovery, conditions and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import conditions, discovery, profiles, retrieval, validation

_STATES = ["Rajasthan", " raj ", "राजस्थान", "Gujarat", None]
_GENDERS = ["m", "Female", "महिला", "other", None]
_PLACES = ["rural", "शहरी", " Both", "hill", None]
_DISTRICTS = {"jaipur": "Jaipur", "jpr": "Jaipur", "kota": "Kota"}


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql_pick(values, n):
    return f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[({n}) % {len(values)} + 1]"


def raw_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as profiles in many spellings."""
    k = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        k.alias("profile_id"), F.when(k % 6 != 0, (k * 7 % 140 - 5).cast("int")).alias("age"), F.col("c_acctbal").alias("family_income"), _pick(["MONTHLY", "annual", None], k).alias("family_income_frequency"),
        _pick(_STATES, k).alias("state"), _pick(_GENDERS, F.floor(k / 3)).alias("gender"), _pick(_PLACES, F.floor(k / 2)).alias("rural_urban"), _pick(["JPR", " Kota ", "Ajmer", None], k).alias("district"),
        _pick([None, "yes"], k).alias("domicile"), _pick(["Punjab ", None, "1"], k).alias("domicile_status"), F.when(k % 4 == 0, k % 90).alias("land_area_bigha"), (k % 7 - 1).alias("family_size"),
    )


_RAW = f"""r AS (SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey * 7 % 140 - 5 END AS age, c_acctbal AS family_income, {_sql_pick(["MONTHLY", "annual", None], "c_custkey")} AS often,
  {_sql_pick(_STATES, "c_custkey")} AS state, {_sql_pick(_GENDERS, "c_custkey // 3")} AS gender, {_sql_pick(_PLACES, "c_custkey // 2")} AS place, {_sql_pick(["JPR", " Kota ", "Ajmer", None], "c_custkey")} AS district,
  {_sql_pick([None, "yes"], "c_custkey")} AS domicile, {_sql_pick(["Punjab ", None, "1"], "c_custkey")} AS domicile_status, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 90 END AS land, c_custkey % 7 - 1 AS family_size FROM customer)"""
_NORMAL = f"""{_RAW}, p AS (SELECT profile_id, age, CASE WHEN often = 'MONTHLY' THEN family_income * 12 ELSE family_income END AS family_income, CASE WHEN often = 'MONTHLY' THEN 'ANNUAL' ELSE often END AS family_income_frequency,
  CASE WHEN lower(trim(state)) IN ('rajasthan', 'raj', 'राजस्थान') THEN 'Rajasthan' ELSE state END AS state,
  CASE WHEN gender IN ('m') THEN 'MALE' WHEN gender IN ('Female', 'महिला') THEN 'FEMALE' ELSE upper(gender) END AS gender,
  CASE trim(place) WHEN 'rural' THEN 'RURAL' WHEN 'शहरी' THEN 'URBAN' WHEN 'Both' THEN 'BOTH' ELSE place END AS rural_urban, CASE lower(trim(district)) WHEN 'jpr' THEN 'Jaipur' WHEN 'kota' THEN 'Kota' ELSE district END AS district,
  CASE WHEN coalesce(domicile, domicile_status) IN ('yes', '1') THEN 'Rajasthan' ELSE trim(coalesce(domicile, domicile_status)) END AS domicile, land AS land_holding, family_size FROM r)"""


def profile_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profiles.normalized(raw_profiles(spark, sf_dir), _DISTRICTS)
    return out.select("profile_id", "age", F.round("family_income", 2).alias("family_income"), "family_income_frequency", "state", "gender", "rural_urban", "district", "domicile", "land_holding", "family_size")


def profile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are out of range, by code."""
    out = profiles.normalized(raw_profiles(spark, sf_dir))
    return validation.issues(out, ["profile_id"], profiles.range_rules(out.columns)).groupBy("code").agg(F.count("*").alias("n"), F.min("profile_id").alias("first"))


_ORIGINS = ["RAJASTHAN_STATE", "CENTRAL", "UNKNOWN", "CENTRALLY_SPONSORED"]
_SCHEME_STATES = [None, "Rajasthan", "ALL_INDIA", "gujarat", "Punjab"]


def schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as schemes with all that the candidate filter looks at."""
    k, day = F.col("p_partkey"), F.lit("2024-01-01").cast("date")
    lists = F.when(k % 3 == 0, F.array(F.lit("Jaipur"), F.lit("kota"))).when(k % 3 == 1, F.array().cast("array<string>"))
    return _read(spark, sf_dir, "part").select(
        k.alias("scheme_id"), (k % 10 != 0).alias("verified"), (k % 9 != 0).alias("active"), F.when(k % 4 != 0, F.date_add(day, (k % 300).cast("int"))).alias("valid_from"),
        F.when(k % 5 != 0, F.date_add(day, (k % 300 + 100).cast("int"))).alias("valid_until"), _pick(_ORIGINS, k).alias("origin"), _pick(_SCHEME_STATES, k).alias("state"), lists.alias("districts"),
        _pick(["RURAL", "URBAN", "BOTH", "ALL"], F.floor(k / 5)).alias("rural_urban"), F.col("p_brand").alias("category"), F.col("p_size").alias("least_age"), F.col("p_retailprice").alias("price"),
    )


_SCHEMES = f"""s AS (SELECT p_partkey AS scheme_id, CASE WHEN p_partkey % 4 <> 0 THEN DATE '2024-01-01' + (p_partkey % 300)::INT END AS f, CASE WHEN p_partkey % 5 <> 0 THEN DATE '2024-01-01' + (p_partkey % 300 + 100)::INT END AS u,
  {_sql_pick(_ORIGINS, "p_partkey")} AS origin, {_sql_pick(_SCHEME_STATES, "p_partkey")} AS sstate, CASE p_partkey % 3 WHEN 0 THEN ['Jaipur', 'kota'] WHEN 1 THEN [] END AS districts,
  {_sql_pick(["RURAL", "URBAN", "BOTH", "ALL"], "p_partkey // 5")} AS place, p_size, p_retailprice FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 9 <> 0),
c AS (SELECT p.*, s.scheme_id, s.p_size, s.p_retailprice FROM p, s WHERE profile_id % 50 = 0 AND (f IS NULL OR f <= DATE '2024-06-01') AND (u IS NULL OR u >= DATE '2024-06-01') AND origin <> 'CENTRAL'
  AND (state IS NULL OR CASE WHEN state = 'Rajasthan' THEN sstate IS NULL OR lower(sstate) IN ('rajasthan', 'all_india') ELSE lower(sstate) = lower(state) END)
  AND (district IS NULL OR districts IS NULL OR len(districts) = 0 OR list_contains(districts, district) OR list_contains(districts, lower(district)))
  AND (rural_urban IS NULL OR upper(rural_urban) NOT IN ('RURAL', 'URBAN') OR place IN ('BOTH', 'ALL') OR place = upper(rural_urban)) QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY scheme_id) <= 200)"""


def _candidates(spark, sf_dir):
    """Every profile whose id is divisible by 50 against all schemes."""
    asked = profiles.normalized(raw_profiles(spark, sf_dir), _DISTRICTS).where("profile_id % 50 = 0")
    asked = asked.select("profile_id", "age", "family_income", F.col("state").alias("p_state"), F.col("district").alias("p_district"), F.col("rural_urban").alias("p_rural_urban"))
    return discovery.candidates(asked, schemes(spark, sf_dir), F.lit("2024-06-01").cast("date"))


def candidate_filter_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conditions of the filter: the first 200 candidates of each profile."""
    return _candidates(spark, sf_dir).select("profile_id", "scheme_id", F.col("rank").cast("long").alias("rank"))


def discover_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, verdicts, ranking by the similarity of a scheme's vector to the profile's, five of each bucket."""
    found = _candidates(spark, sf_dir)
    holds = (F.col("age") >= F.col("least_age")) & (F.col("family_income") <= F.col("price") * 60)
    found = found.withColumn("status", F.when(holds.isNull(), "MORE_INFORMATION_REQUIRED").when(holds, "ELIGIBLE").otherwise("NOT_ELIGIBLE"))
    v = _read(spark, sf_dir, "embeddings")
    one, two = v.select(F.col("vec_id").alias("profile_id"), F.col("embedding").alias("asked")), v.select(F.col("vec_id").alias("scheme_id"), F.col("embedding").alias("own"))
    found = found.join(one, "profile_id", "left").join(two, "scheme_id", "left").withColumn("similarity", F.round(retrieval.cosine(F.col("asked"), F.col("own")), 4))
    known = F.col("asked").isNotNull() & F.col("own").isNotNull()
    found = found.withColumn("similarity", F.when(known, F.col("similarity"))).drop("rank")
    return discovery.buckets(found, "similarity").select("profile_id", "status", F.col("rank").cast("long").alias("rank"), "scheme_id", "similarity")


def _conditions(spark, sf_dir):
    """Order lines as extracted conditions, the first five of each in the order of lines."""
    n = F.col("l_linenumber")
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document"), n.alias("place"), _pick(["age", "family_income", "marks", "age"], F.col("l_partkey")).alias("field"), _pick(["GTE", "LTE"], F.col("l_suppkey")).alias("operator"),
        (F.col("l_quantity") % 3).cast("int").cast("string").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit("ANNUAL").alias("periodicity"), F.when(F.col("l_returnflag") == "R", "SC").alias("context"),
        F.array(n.cast("string"), (n % 2).cast("string")).alias("refs"),
    )


_CONDITIONS = f"""l AS (SELECT l_orderkey AS document, l_linenumber AS place, {_sql_pick(["age", "family_income", "marks", "age"], "l_partkey")} AS field, {_sql_pick(["GTE", "LTE"], "l_suppkey")} AS operator,
  (l_quantity % 3)::INT::VARCHAR AS value, CASE WHEN l_returnflag = 'R' THEN 'SC' END AS context, [l_linenumber::VARCHAR, (l_linenumber % 2)::VARCHAR] AS refs FROM lineitem),
x AS (SELECT document, field, operator, value, context, place * 10 + i AS pos, r FROM (SELECT *, unnest(refs) AS r, generate_subscripts(refs, 1) AS i FROM l)),
f AS (SELECT document, field, operator, value, context, r, min(pos) AS pos FROM x GROUP BY ALL)"""


def condition_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conditions.merged(_conditions(spark, sf_dir), ["document"], "place")
    return out.select("document", "field", "operator", "value", "context", "place", F.array_join("refs", ",").alias("refs"))


def condition_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conditions.conflicts(_conditions(spark, sf_dir), ["document"], "place")
    return out.select("document", "conflict_id", "field", "context", F.array_join("values", ",").alias("vals"), F.array_join("refs", ",").alias("refs"))


def evidence_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different words of each conversation's turns, numbered by their first occurrence."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), " ")).alias("at", "word"))
    return conditions.evidence_registry(turns, "conv_id", ["turn", "at"], "word").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("evidence_id").alias("last"), F.min_by("word", "evidence_id").alias("first_word"))


def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents and their lines as chunks; some lines have no run."""
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), (F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")).alias("chunk"), "l_quantity", "l_returnflag", "l_suppkey")
    status = F.when(F.col("l_returnflag") == "A", "FAILED").when(F.col("l_quantity") > 45, "REVIEW").otherwise("SUCCESS")
    runs = lines.where(F.col("l_suppkey") % 7 != 0).select("document", "chunk", status.alias("status"), F.col("l_quantity").cast("long").alias("facts"), F.when(F.col("l_quantity") > 10, F.concat(F.lit("S"), F.col("l_suppkey") % 4)).alias("scheme"))
    return conditions.extraction_summary(lines, runs, "document", "chunk").withColumn("schemes", F.array_join("schemes", ","))


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order."""
    o = _read(spark, sf_dir, "orders")
    last = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("r")
    return o.groupBy("o_custkey").agg(last).select("o_custkey", "r.*")


def band_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document up to 25 earlier ones, the last first, that have at most five pages (of 500 characters) more or less.

    A document is shown in the lists of all page counts near its own, and those before it in the list of its own are its candidates:
    eleven rows a document, whatever the counts' distribution."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.ceil(F.col("n_chars") / 500).alias("pages"))
    shown = docs.withColumn("list", F.explode(F.sequence(F.col("pages") - 5, F.col("pages") + 5)))
    before = F.collect_list("doc_id").over(Window.partitionBy("list").orderBy("doc_id").rowsBetween(-25, -1))
    out = shown.withColumn("before", before).where("list = pages")
    return out.select("doc_id", F.size("before").cast("long").alias("n"), F.array_join(F.reverse("before"), ",").alias("candidates"))


def count_and_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty of the urgent orders, the dearest first, and how many there are."""
    rows = _read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").offset(40).limit(20)
    return page.join(F.broadcast(total))  # one row


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("customer", "documents", "events", "orders", "pages"):
        one = _read(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders with late lines: the second page of ten by priority, lateness and key, all descending but the key."""
    late = _read(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = _read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(late, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.orderBy(F.desc("o_orderpriority"), F.desc("n"), "o_orderkey").offset(10).limit(10).select("o_orderkey", "o_orderpriority", "n")


def candidate_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the documents that are in French: a semi-join."""
    d = _read(spark, sf_dir, "documents").where("lang = 'fr'")
    return _read(spark, sf_dir, "embeddings").join(d, F.col("vec_id") == F.col("doc_id"), "left_semi").select("vec_id", "label")


QUERIES = {
    f.__name__: f
    for f in (profile_normalize, profile_ranges, candidate_filter_full, discover_schemes, condition_merge, condition_conflicts, evidence_registry, extraction_summary, latest_per_key, band_candidates, count_and_page, table_counts, review_queue, candidate_embeddings)
}
_COS = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))"
ORACLE_SQL = {
    "profile_normalize": f"WITH {_NORMAL} SELECT * REPLACE (round(family_income, 2) AS family_income) FROM p",
    "profile_ranges": f"""WITH {_NORMAL}, i AS (SELECT profile_id, unnest([CASE WHEN age < 0 OR age > 130 THEN 'AGE_RANGE' END, CASE WHEN family_income < 0 THEN 'FAMILY_INCOME_RANGE' END, CASE WHEN land_holding < 0 THEN 'LAND_HOLDING_RANGE' END,
      CASE WHEN family_size < 1 THEN 'FAMILY_SIZE_RANGE' END]) AS code FROM p) SELECT code, count(*) AS n, min(profile_id) AS first FROM i WHERE code IS NOT NULL GROUP BY code""",
    "candidate_filter_full": f"WITH {_NORMAL}, {_SCHEMES} SELECT profile_id, scheme_id, row_number() OVER (PARTITION BY profile_id ORDER BY scheme_id) AS rank FROM c",
    "discover_schemes": f"""WITH {_NORMAL}, {_SCHEMES}, e AS (SELECT profile_id, scheme_id, CASE WHEN age < p_size OR family_income > p_retailprice * 60 THEN 'NOT_ELIGIBLE' WHEN age IS NULL THEN 'MORE_INFORMATION_REQUIRED' ELSE 'ELIGIBLE' END AS status FROM c),
      m AS (SELECT e.*, round(greatest(0, least(1, {_COS})), 4) AS similarity FROM e LEFT JOIN embeddings q ON q.vec_id = profile_id LEFT JOIN embeddings v ON v.vec_id = scheme_id WHERE status <> 'NOT_ELIGIBLE'),
      n AS (SELECT profile_id, status, scheme_id, CASE WHEN profile_id IN (SELECT vec_id FROM embeddings) AND scheme_id IN (SELECT vec_id FROM embeddings) THEN similarity END AS similarity FROM m)
      SELECT *, row_number() OVER (PARTITION BY profile_id, status ORDER BY coalesce(similarity, -1) DESC, scheme_id) AS rank FROM n QUALIFY rank <= 5""",
    "condition_merge": f"""WITH {_CONDITIONS} SELECT document, field, operator, value, context, min(pos) // 10 AS place, string_agg(r, ',' ORDER BY pos) AS refs FROM f GROUP BY document, field, operator, value, context""",
    "condition_conflicts": f"""WITH {_CONDITIONS}, g AS (SELECT document, field, coalesce(context, 'DEFAULT') AS context, min(pos) // 10 AS first, array_to_string(list_sort(list_distinct(list(value))), ',') AS vals, count(DISTINCT value) AS n, array_to_string(list_sort(list_distinct(list(r))), ',') AS refs
      FROM f WHERE field IN ('age', 'family_income') GROUP BY 1, 2, 3 HAVING n > 1)
      SELECT document, 'CONF-' || lpad(row_number() OVER (PARTITION BY document ORDER BY first, field, context)::VARCHAR, 3, '0') AS conflict_id, field, context, vals, refs FROM g""",
    "evidence_registry": """WITH w AS (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS word, generate_subscripts(string_split(lower(text), ' '), 1) AS pos FROM conversations),
      d AS (SELECT conv_id, word, min(turn * 1000000 + pos) AS first FROM w WHERE length(trim(word)) > 0 GROUP BY 1, 2)
      SELECT conv_id, count(*) AS n, 'EV-' || lpad(count(*)::VARCHAR, 4, '0') AS last, arg_min(word, first) AS first_word FROM d GROUP BY conv_id""",
    "extraction_summary": """WITH l AS (SELECT *, CASE WHEN l_suppkey % 7 <> 0 THEN CASE WHEN l_returnflag = 'A' THEN 'FAILED' WHEN l_quantity > 45 THEN 'REVIEW' ELSE 'SUCCESS' END END AS status, CASE WHEN l_suppkey % 7 <> 0 AND l_quantity > 10 THEN 'S' || (l_suppkey % 4) END AS scheme FROM lineitem),
      k AS (SELECT l_orderkey, scheme, min(l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey) AS pos FROM l WHERE scheme IS NOT NULL GROUP BY 1, 2), n AS (SELECT l_orderkey, string_agg(scheme, ',' ORDER BY pos) AS schemes FROM k GROUP BY 1),
      g AS (SELECT l_orderkey AS document, count(*) AS chunks, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'REVIEW') AS review,
        coalesce(sum(l_quantity::BIGINT) FILTER (status IS NOT NULL), 0)::BIGINT AS facts, count(status) AS run FROM l GROUP BY 1)
      SELECT document, chunks, success, failed, review, facts, coalesce(schemes, '') AS schemes, CASE WHEN failed = chunks THEN 'FAILED' WHEN failed > 0 THEN 'PARTIAL_FAILURE' WHEN run < chunks THEN 'PENDING' ELSE 'COMPLETED' END AS state FROM g LEFT JOIN n ON l_orderkey = document""",
    "latest_per_key": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "band_candidates": """WITH d AS (SELECT doc_id, ceil(n_chars / 500)::BIGINT AS pages FROM documents),
      p AS (SELECT a.doc_id, b.doc_id AS other FROM d a JOIN d b ON b.doc_id < a.doc_id AND b.pages BETWEEN a.pages - 5 AND a.pages + 5 QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id DESC) <= 25),
      g AS (SELECT doc_id, count(*) AS n, string_agg(other::VARCHAR, ',' ORDER BY other DESC) AS candidates FROM p GROUP BY 1) SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(candidates, '') AS candidates FROM d LEFT JOIN g USING (doc_id)""",
    "count_and_page": "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS total FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "documents", "events", "orders", "pages")),
    "review_queue": """SELECT o_orderkey, o_orderpriority, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'
      ORDER BY o_orderpriority DESC, n DESC, o_orderkey LIMIT 10 OFFSET 10""",
    "candidate_embeddings": "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')",
}
