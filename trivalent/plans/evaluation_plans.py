"""Evaluation, versions and document functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import documents as d
from ..operators import dedup, evaluation, metrics, retrieval
from .text_plans import PHRASES, phrases

_DAYS = ["2024-03-01", "01-04-2024", "5/6/2024", "07/06/2024", "८.९.२०२४", "09.10.2024", "3 March 2024", "4 Apr 2024", "May 6, 2024", "2024-13-01", "next week", ""]
_CLASSES = ["GOOD", "BAD", "TOXIC"]


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranking_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and nDCG at 1, 3, 5 and 10 of every vector whose id is divisible by 50: its label is relevant, low ids more."""
    v = _read(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("wanted"))  # a stated query set against all
    worth = F.when(F.col("vec_id") < 100, 2).otherwise(1)
    ranked = retrieval.nearest_by_cosine(q, v.select("vec_id", "embedding", "label"), "vec_id", "embedding", 10, 6).join(q.select("query_id", "wanted"), "query_id")
    ranked = ranked.withColumn("gain", F.when(F.col("label") != F.col("wanted"), 0).otherwise(worth))
    judged = evaluation.label_gains(v.select("vec_id", "label"), q.select("query_id", "wanted"), "vec_id", "label", worth)
    out = evaluation.ranking_at(ranked, "query_id", "rank", "gain", evaluation.largest_gains(judged, "query_id", "gain", n=F.col("n")))
    return out.select("query_id", *(F.round(c, 4).alias(c) for c in out.columns[1:]))


def class_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as three classes against a rule of length and language."""
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents"), "doc_id")
    expected = F.when(F.col("toxic") == 1, "TOXIC").when(F.col("quality") == 1, "GOOD").otherwise("BAD")
    predicted = F.when(F.col("n_chars") > 3000, "TOXIC").when((F.col("n_chars") > 600) | (F.col("lang") != "en"), "GOOD").otherwise("BAD")
    return evaluation.confusion(rows.select(expected.alias("expected"), predicted.alias("predicted")), "expected", "predicted", _CLASSES)


def missing_field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of large quantity as expected missing fields, those of high price as found ones; means over orders."""
    field = F.concat(F.lit("f"), F.col("l_linenumber"))
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_quantity") > 30, field)).alias("e"), F.collect_set(F.when(F.col("l_extendedprice") > 30000, field)).alias("f")
    )
    p, r, f1 = evaluation.set_scores(F.col("e"), F.col("f"))
    scores = lines.select((F.col("l_orderkey") % 10).alias("slice"), p.alias("p"), r.alias("r"), f1.alias("f1"))
    return scores.groupBy("slice").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in ("p", "r", "f1")))


def fact_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as expected facts against altered ones: outcomes by field."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("v"))
    name = F.element_at(F.array(*map(F.lit, ("age", "income", "land", "marks", "size", "x", "y"))), F.col("l_linenumber"))
    facts = lines.where("l_linenumber <= 7").select("l_orderkey", k.alias("k"), name.alias("field"), F.col("v").cast("string").alias("value"), F.lit("GTE").alias("op"))
    other = F.when(F.col("field") == "land", "Land_Area_Bigha").when(F.col("field") == "income", " annual_income ").otherwise(F.upper("field"))
    found = facts.where("k % 7 <> 0").select("l_orderkey", other.alias("field"), F.when(F.col("k") % 5 == 0, "1,0").otherwise(F.concat(F.lit(" "), "value", F.lit(".0"))).alias("value"), F.when(F.col("k") % 6 == 0, "lte").otherwise("gte").alias("op"))
    out = evaluation.fact_matches(facts.where("k % 11 <> 0").drop("k"), found, ["l_orderkey"], "field", "value", "op", {"land_area_bigha": "land", "annual_income": "income"})
    return out.groupBy("field", "outcome").agg(F.count("*").alias("n"))


def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile between neighbours, by event type."""
    return metrics.interpolated_percentile(_read(spark, sf_dir, "events"), "event_type", "value", 0.95).withColumn("value", F.round("value", 6))


def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' searches: the first cause that explains a bad outcome, in the order of causes."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    users = _read(spark, sf_dir, "events").groupBy("user_id").agg(*(n(k).alias(k) for k in ("error", "view", "click", "purchase", "signup")))
    causes = [("LEAKAGE", F.col("error") > F.col("view")), ("DUPLICATE", F.col("signup") > F.col("view")), ("NO_RESULT", F.col("click") == 0), ("RANKING", F.col("purchase") < F.col("click"))]
    return evaluation.attributed(users, causes).groupBy("cause").agg(F.count("*").alias("n"))


def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of neighbouring parts as titles."""
    p = _read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Final "), "p_name", F.lit(" "), "p_type", F.lit(" 2024 pdf")).alias("title"))
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("title").alias("other")), "p_partkey")
    return both.select("p_partkey", d.jaccard(d.title_tokens(F.col("title")), d.title_tokens(F.col("other"))).alias("similarity"))


def line_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the one before."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.join(docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("old")), "doc_id")
    added, removed = d.line_changes(F.col("old"), F.col("text"))
    return both.select("doc_id", F.size(added).cast("long").alias("added"), F.size(removed).cast("long").alias("removed"), d.year_shift(F.col("old"), F.col("text")).alias("later"))


def stable_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = d.stable_embedding(F.col("n_name"), 8)
    return _read(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(v).alias("i", "x")).select("n_nationkey", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def host_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of pages, a third of them with addresses made of their ids instead, against a list of domains."""
    k = F.col("page_id")
    first = F.element_at(F.array(*map(F.lit, (10, 100, 127, 169, 172, 192, 198, 224, 8))), (k % 9 + 1).cast("int"))
    address = F.concat_ws(".", *(c.cast("string") for c in (first, F.when(k % 2 == 0, k * 37 % 256).otherwise(F.when(first == 192, 168).otherwise(254)), k % 256, k * 7 % 256)))
    forms = (address, F.lit("localhost."), F.concat(F.lit("10."), k.cast("string"), F.lit(".example.com")), F.concat(F.lit("[fd00::"), F.lower(F.hex(k % 4096)), F.lit("]")), F.concat(F.lit("u:p@"), address, F.lit(":80")), F.concat(F.lit("[::ffff:"), address, F.lit("]")))
    other = F.concat(F.lit("http://"), F.element_at(F.array(*forms), (k / 3 % 6 + 1).cast("int")), F.lit("/x"))
    urls = _read(spark, sf_dir, "pages").select("page_id", F.when(k % 3 == 0, other).otherwise(F.col("url")).alias("url"))
    return urls.groupBy(d.allowed(F.col("url"), ["example.com", "example.org"]).alias("allowed"), d.private_host(F.col("url")).alias("private")).agg(F.count("*").alias("n"))


def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region as a table."""
    n = _read(spark, sf_dir, "nation")
    rows = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("a|name"), F.lit("note"))), F.transform("l", lambda x: F.array(x.n_nationkey.cast("string"), x.n_name)))
    return rows.select("n_regionkey", d.markdown_table(cells).alias("table"))


def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties, with two more in any order, as canonical JSON, hashed."""
    own = F.from_json("props", "map<string,string>")
    more = F.create_map(F.lit("z"), F.col("event_type"), F.lit("a"), F.col("user_id").cast("string"))
    return _read(spark, sf_dir, "events").select("event_id", F.sha2(d.canonical_json(F.map_concat(more, own)), 256).alias("hash"))


def dates_in_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([*enumerate(_DAYS)], "id long, s string").select("id", d.any_date(F.col("s")).cast("string").alias("day"))


def numeric_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(spark).select("id", d.numeric_change(F.col("s")).alias("numeric"))


def shingle_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class: the smallest id with the same set of shingles; what jaccard_pairs pairs are classes."""
    return dedup.shingle_classes(_read(spark, sf_dir, "documents"), "doc_id", "text")


def version_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as versions: one that isn't in force yet stays verified, the last other one is active and closes those before."""
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("start"))
    w = Window.partitionBy("o_custkey").orderBy("start", "o_orderkey")
    out = o.withColumn("version", F.row_number().over(w)).withColumn("next", F.lead("start").over(w)).withColumn("future", F.col("start") > F.lit("1996-06-01").cast("date"))
    replaced = ~F.col("future") & F.coalesce(F.col("next") <= F.lit("1996-06-01").cast("date"), F.lit(False))
    status = F.when(F.col("future"), "HUMAN_VERIFIED").when(replaced, "SUPERSEDED").otherwise("ACTIVE")
    return out.select("o_orderkey", F.col("version").cast("long").alias("version"), status.alias("status"), F.when(replaced, F.date_sub("next", 1)).cast("string").alias("until"))


def page_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a document's pages: pages without text, with little, and what the document's text is worth."""
    pages = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("page")).select("doc_id", F.length(F.trim("page")).alias("n"))
    none, low = F.count_if(F.col("n") == 0), F.count_if((F.col("n") > 0) & (F.col("n") < 100))
    quality = F.when(none == F.count("*"), "NO_TEXT").when(none + low > F.count("*") / 2, "LOW_TEXT").otherwise("GOOD")
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), none.alias("without"), low.alias("low"), quality.alias("quality"))


def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of as many seconds as their value says: those with gaps of ten minutes or less are one."""
    e = _read(spark, sf_dir, "events").where("value is not null").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), (F.unix_seconds(F.col("ts").cast("timestamp")) + F.floor("value")).alias("e"))
    w = Window.partitionBy("user_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col("s") - F.max("e").over(w) > 600).cast("int"), F.lit(1))
    rows = e.withColumn("run", F.sum(new).over(Window.partitionBy("user_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "run").agg((F.max("e") - F.min("s")).alias("length")).groupBy("user_id").agg(F.count("*").alias("runs"), F.max("length").alias("longest"))


def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of three words each part's name contains, the ten best."""
    n = sum((F.col("p_name").contains(w).cast("long") for w in ("a", "e", "1")), F.lit(0).cast("long"))
    return _read(spark, sf_dir, "part").select("p_partkey", n.alias("n")).where("n > 0").orderBy(F.desc("n"), "p_partkey").limit(10)


QUERIES = {
    f.__name__: f
    for f in (ranking_at_k, class_confusion, missing_field_scores, fact_outcomes, value_percentiles, failure_causes, title_similarity, line_diffs, stable_embeddings, host_checks, markdown_tables, canonical_hashes, dates_in_formats, numeric_changes, shingle_classes, version_activation, page_diagnostics, merged_intervals, search_counts)
}
_COS = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))"
_KS = (1, 3, 5, 10)
_W = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: length(x) > 1)"
_TOKENS = rf"list_distinct(list_filter({_W}, lambda x: length(x) > 2 AND x NOT IN ('final', 'copy', 'download', 'new', 'latest', 'doc', 'pdf', 'file', 'draft', 'scan', 'circular', 'notification') AND NOT regexp_full_match(x, '[0-9]+')))"
_LINES = "list_distinct(list_filter(list_transform(string_split({}, chr(10)), lambda s: trim(s)), lambda s: s <> ''))"
_VALUES = ", ".join(f"({i}::BIGINT, '{s}')" for i, s in PHRASES)
ORACLE_SQL = {
    "ranking_at_k": f"""WITH r AS (SELECT q.vec_id AS query_id, v.vec_id, CASE WHEN q.label <> v.label THEN 0 WHEN v.vec_id < 100 THEN 2 ELSE 1 END AS gain, round(greatest(0, least(1, {_COS})), 6) AS s
      FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
      k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS i, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS j FROM r)
      SELECT query_id, round(coalesce(1 / min(i) FILTER (gain > 0 AND i <= 10), 0), 4) AS mrr, {", ".join(f'''round(CASE WHEN count(*) FILTER (gain > 0) > 0 THEN count(*) FILTER (gain > 0 AND i <= {n}) / count(*) FILTER (gain > 0) ELSE 1 END, 4) AS recall_{n},
      round(count(*) FILTER (gain > 0 AND i <= {n}) / {n}, 4) AS precision_{n}, round(CASE WHEN count(*) FILTER (gain > 0) > 0 THEN sum(CASE WHEN i <= {n} THEN gain / log2(i + 1) ELSE 0 END) / sum(CASE WHEN j <= {n} THEN gain / log2(j + 1) ELSE 0 END) ELSE 0 END, 4) AS ndcg_{n}''' for n in _KS)} FROM k GROUP BY query_id""",
    "class_confusion": """WITH l AS (SELECT CASE WHEN toxic = 1 THEN 'TOXIC' WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS e, CASE WHEN n_chars > 3000 THEN 'TOXIC' WHEN n_chars > 600 OR lang <> 'en' THEN 'GOOD' ELSE 'BAD' END AS p FROM labels JOIN documents USING (doc_id)),
      c AS (SELECT unnest(['GOOD', 'BAD', 'TOXIC']) AS class), n AS (SELECT class, count(*) FILTER (e = class AND p = 'GOOD') AS good, count(*) FILTER (e = class AND p = 'BAD') AS bad, count(*) FILTER (e = class AND p = 'TOXIC') AS toxic,
        count(*) FILTER (e = class AND p = class) AS tp, count(*) FILTER (p = class) AS found, count(*) FILTER (e = class) AS there FROM c, l GROUP BY class),
      s AS (SELECT *, CASE WHEN found > 0 THEN tp / found ELSE 0 END AS pr, CASE WHEN there > 0 THEN tp / there ELSE 0 END AS re FROM n)
      SELECT class, good, bad, toxic, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1 FROM s""",
    "missing_field_scores": """WITH o AS (SELECT l_orderkey, coalesce(list(DISTINCT l_linenumber) FILTER (l_quantity > 30), []) AS e, coalesce(list(DISTINCT l_linenumber) FILTER (l_extendedprice > 30000), []) AS f FROM lineitem GROUP BY 1),
      b AS (SELECT *, len(list_intersect(e, f)) AS n FROM o), s AS (SELECT l_orderkey % 10 AS slice, CASE WHEN len(e) = 0 AND len(f) = 0 THEN 1 WHEN len(f) = 0 THEN 0 ELSE n / len(f) END AS p, CASE WHEN len(e) = 0 THEN 1 ELSE n / len(e) END AS r FROM b)
      SELECT slice, count(*) AS n, round(avg(p), 4) AS p, round(avg(r), 4) AS r, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 4) AS f1 FROM s GROUP BY slice""",
    "fact_outcomes": """WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS k, min(l_quantity)::INT AS v, (['age', 'income', 'land', 'marks', 'size', 'x', 'y'])[l_linenumber] AS field FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1, 2),
      o AS (SELECT field, CASE WHEN k % 11 <> 0 AND k % 7 = 0 THEN 'MISSING' WHEN k % 11 = 0 AND k % 7 <> 0 THEN 'EXTRA' WHEN k % 11 = 0 THEN NULL WHEN k % 6 = 0 THEN 'WRONG_OPERATOR' WHEN k % 5 = 0 AND v <> 10 THEN 'WRONG_VALUE' ELSE 'MATCH' END AS outcome FROM l)
      SELECT field, outcome, count(*) AS n FROM o WHERE outcome IS NOT NULL GROUP BY ALL""",
    "value_percentiles": "SELECT event_type, round(quantile_cont(value, 0.95::DOUBLE), 6) AS value FROM events GROUP BY 1",
    "failure_causes": """WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'signup') AS s FROM events GROUP BY 1)
      SELECT CASE WHEN e > v THEN 'LEAKAGE' WHEN s > v THEN 'DUPLICATE' WHEN c = 0 THEN 'NO_RESULT' WHEN p < c THEN 'RANKING' ELSE 'NONE' END AS cause, count(*) AS n FROM u GROUP BY 1""",
    "title_similarity": f"""WITH t AS (SELECT p_partkey, {_TOKENS.format("'Final ' || p_name || ' ' || p_type || ' 2024 pdf'")} AS t FROM part)
      SELECT a.p_partkey, CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 4) ELSE 0 END AS similarity FROM t a JOIN t b ON b.p_partkey = a.p_partkey + 1""",
    "line_diffs": f"""WITH l AS (SELECT doc_id, {_LINES.format("coalesce(text, '')")} AS l, list_max(list_transform(regexp_extract_all(text, '(^|[^0-9])(20[0-9][0-9])($|[^0-9])', 2), lambda x: x::INT)) AS y FROM documents)
      SELECT b.doc_id, len(b.l) - len(list_intersect(a.l, b.l)) AS added, len(a.l) - len(list_intersect(a.l, b.l)) AS removed, coalesce(b.y > a.y, false) AS later FROM l a JOIN l b ON b.doc_id = a.doc_id + 1""",
    "stable_embeddings": """WITH r AS (SELECT n_nationkey, i, md5(n_name || ':' || i) AS h FROM nation, range(8) t(i)), x AS (SELECT n_nationkey, i, ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT / 4294967296::DOUBLE - 0.5::DOUBLE AS x FROM r)
      SELECT n_nationkey, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY n_nationkey)), 6) AS x FROM x""",
    "host_checks": """WITH u AS (SELECT page_id % 3 = 0 AS own, (page_id // 3) % 6 AS form, ([10, 100, 127, 169, 172, 192, 198, 224, 8])[page_id % 9 + 1] AS a, page_id, page_id % 256 AS c, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS h FROM pages),
      v AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN page_id * 37 % 256 WHEN a = 192 THEN 168 ELSE 254 END AS b FROM u),
      x AS (SELECT *, a IN (10, 127, 224) OR (a = 100 AND b // 64 = 1) OR (a = 169 AND b = 254) OR (a = 172 AND b // 16 = 1) OR (a = 192 AND (b = 168 OR (b = 0 AND c IN (0, 2)))) OR (a = 198 AND (b // 2 = 9 OR (b = 51 AND c = 100))) AS closed FROM v)
      SELECT CASE WHEN own THEN form = 2 ELSE h IN ('example.com', 'example.org') OR h LIKE '%.example.com' OR h LIKE '%.example.org' END AS allowed, own AND CASE form WHEN 2 THEN false WHEN 1 THEN true WHEN 3 THEN true ELSE closed END AS private, count(*) AS n FROM x GROUP BY ALL""",
    "markdown_tables": r"""SELECT n_regionkey, '| key | a\|name | note |' || chr(10) || '| --- | --- | --- |' || string_agg(chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |  |', '' ORDER BY n_nationkey) AS "table" FROM nation GROUP BY 1""",
    "canonical_hashes": """SELECT event_id, sha256('{"a":"' || user_id || '","k":"' || json_extract_string(props, '$.k') || '","z":"' || event_type || '"}') AS hash FROM events""",
    "dates_in_formats": f"""WITH t(id, s) AS (VALUES {", ".join(f"({i}::BIGINT, '{s}')" for i, s in enumerate(_DAYS))}), u AS (SELECT id, translate(s, '०१२३४५६७८९', '0123456789') AS s FROM t)
      SELECT id, coalesce(CASE WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime(s, '%Y-%m-%d') END, CASE WHEN regexp_full_match(s, '[0-9]{{2}}([-/.])[0-9]{{2}}[-/.][0-9]{{4}}') THEN try_strptime(replace(replace(s, '/', '-'), '.', '-'), '%d-%m-%Y') END,
        try_strptime(s, '%d %B %Y'), try_strptime(s, '%d %b %Y'), try_strptime(s, '%B %d, %Y'))::DATE::VARCHAR AS day FROM u""",
    "numeric_changes": rf"""WITH p(id, s) AS (VALUES {_VALUES}), q AS (SELECT id, lower(translate(s, '०१२३४५६७८९', '0123456789')) AS t FROM p)
      SELECT id, regexp_matches(t, 'rs\.? ?[0-9]') OR regexp_matches(t, '[0-9.]+ ?(lakh|crore|लाख)') OR regexp_matches(t, '[0-9]+ ?(%|percent)') OR regexp_matches(t, '[0-9] ?(year|वर्ष)') OR regexp_matches(t, '[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{4}}') OR regexp_matches(t, '[0-9] ?day') AS numeric FROM q""",
    "shingle_classes": f"""WITH w AS (SELECT doc_id, {_W.format("text")} AS w FROM documents),
      g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w)
      SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id, len(s) AS shingles FROM g""",
    "version_activation": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS s, row_number() OVER w AS version, lead(o_orderdate::DATE) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey))
      SELECT o_orderkey, version, CASE WHEN s > DATE '1996-06-01' THEN 'HUMAN_VERIFIED' WHEN n <= DATE '1996-06-01' THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status, CASE WHEN n <= DATE '1996-06-01' THEN (n - 1)::VARCHAR END AS until FROM o""",
    "page_diagnostics": """WITH p AS (SELECT doc_id, length(trim(unnest(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents), c AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (n = 0) AS without, count(*) FILTER (n BETWEEN 1 AND 99) AS low FROM p GROUP BY 1)
      SELECT *, CASE WHEN without = pages THEN 'NO_TEXT' WHEN (without + low) * 2 > pages THEN 'LOW_TEXT' ELSE 'GOOD' END AS quality FROM c""",
    "merged_intervals": """WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + floor(value)::BIGINT AS e FROM events WHERE value IS NOT NULL),
      g AS (SELECT *, coalesce((s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 600)::INT, 1) AS new FROM e),
      r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM g), m AS (SELECT user_id, run, max(e) - min(s) AS length FROM r GROUP BY 1, 2) SELECT user_id, count(*) AS runs, max(length) AS longest FROM m GROUP BY 1""",
    "search_counts": "SELECT p_partkey, (p_name LIKE '%a%')::BIGINT + (p_name LIKE '%e%')::BIGINT + (p_name LIKE '%1%')::BIGINT AS n FROM part WHERE n > 0 ORDER BY n DESC, p_partkey LIMIT 10",
}
