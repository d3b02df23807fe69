"""Metrics, monitoring, validation and administration over orders, events, labels and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import changes, evaluation, metrics, retrieval, validation


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 as a query: what has the query's label is relevant (gain 2 below id 100, else 1); metrics at 10 of the cosine ranking."""
    v = _read(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("wanted"))  # a stated query set against all
    worth = F.when(F.col("vec_id") < 100, 2).otherwise(1)
    ranked = retrieval.nearest_by_cosine(q, v.select("vec_id", "embedding", "label"), "vec_id", "embedding", 10, 6).join(q.select("query_id", "wanted"), "query_id")
    ranked = ranked.withColumn("gain", F.when(F.col("label") != F.col("wanted"), 0).otherwise(worth))
    judged = evaluation.label_gains(v.select("vec_id", "label"), q.select("query_id", "wanted"), "vec_id", "label", worth)
    out = metrics.ranking_metrics(ranked, "query_id", "rank", "gain", metrics.ideal_gains(judged, "query_id", "gain", 10, F.col("n")), 10)
    return out.select("query_id", *(F.round(c, 4).alias(c) for c in ("recall", "precision", "mrr", "ndcg")))


def confusion_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of length against labelled quality, by language."""
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents"), "doc_id")
    return metrics.precision_recall(rows, ["lang"], F.col("n_chars") > 1000, F.col("quality") == 1)


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents"), "doc_id")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    return rows.select("quality", size.alias("size")).groupBy("quality").pivot("size", ["short", "middle", "long"]).agg(F.count(F.lit(1))).fillna(0)


def slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by language, by source, and over all, in one pass."""
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents"), "doc_id")
    return rows.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 4).alias("quality"))


TRANSCRIPTS = [(1, "my age is sixty", "my age is sixteen"), (2, "income two lakh", "income two lakh"), (3, "", "noise"), (4, "", ""), (5, "the farmer has land", "farmer had no land"), (6, "yes", "")]


def transcription_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(TRANSCRIPTS, "id long, reference string, hypothesis string")
    cer, wer = (f(F.col("reference"), F.col("hypothesis")) for f in (metrics.character_error_rate, metrics.word_error_rate))
    return rows.select("id", F.round(cer, 4).alias("cer"), F.round(wer, 4).alias("wer"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.index_percentile(_read(spark, sf_dir, "events").where("value is not null"), "event_type", "value", 0.95)


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by stage: counts, the oldest, and how many are stuck."""
    stage = F.when(F.col("o_orderstatus") == "O", "waiting").when(F.col("o_orderstatus") == "P", "processing").otherwise("done")
    late = (F.col("o_orderstatus") != "F") & (F.col("o_orderdate") <= F.lit("1996-01-01").cast("timestamp_ntz"))
    return _read(spark, sf_dir, "orders").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.min("o_orderdate").cast("string").alias("oldest"), F.count_if(late).alias("stuck"))


def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts in one pass, and a status from them."""
    e = F.count_if(F.col("event_type") == "error")
    out = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), e.alias("errors"), F.count_if(F.col("value").isNull()).alias("no_value"))
    status = F.when(F.col("errors") * 2 > F.col("n"), "DOWN").when(F.col("errors") > 0, "DEGRADED").otherwise("HEALTHY")
    return out.withColumn("status", status).groupBy("status").agg(F.count("*").alias("users"), F.sum("n").alias("events"), F.sum("errors").alias("errors"))


def activity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 latest of orders and events together: each source is cut before they are merged."""
    o = _read(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    e = _read(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    order = [F.desc("at"), F.col("kind"), F.col("id")]
    return o.orderBy(*order).limit(20).unionByName(e.orderBy(*order).limit(20)).orderBy(*order).limit(20).select("kind", "id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def global_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive containment over customers, suppliers and parts, the first ten of each."""
    found = []
    for kind, name, key, text in (("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name")):
        rows = _read(spark, sf_dir, name).where(F.col(text).ilike("%1%")).orderBy(key).limit(10)
        found.append(rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(text).alias("name")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def validate_rules_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items against coded rules, with each order's status; orders by status."""
    li = _read(spark, sf_dir, "lineitem")
    rules = [
        ("DISCOUNT_TOO_HIGH", "BLOCKER", (F.col("l_discount") > 0.09) & (F.col("l_quantity") > 45)),
        ("PRICE_PER_UNIT", "ERROR", F.col("l_extendedprice") / F.col("l_quantity") > 1900),
        ("RETURNED_LATE", "WARNING", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")),
    ]
    found = validation.issues(li, ["l_orderkey"], rules)
    runs = validation.run_status(found, ["l_orderkey"])
    return runs.groupBy("status").agg(F.count("*").alias("orders"), *(F.sum(c).alias(c) for c in ("blockers", "errors", "warnings")))


def interval_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as bounds: odd ones lower, even ones upper; orders whose bounds exclude each other."""
    n = F.col("l_linenumber")
    op = F.when(n % 4 == 1, "GTE").when(n % 4 == 3, "GT").when(n % 4 == 2, "LTE").otherwise("LT")
    branch = F.when(n > 2, (n % 2 + F.col("l_orderkey") % 2).cast("string"))  # the first two hold in all alternatives
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.lit("quantity").alias("field"), branch.alias("alternative"), op.alias("op"), F.col("l_quantity").alias("value"))
    return validation.contradictions(rows, "l_orderkey", "field", "alternative")


def fingerprint_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as looks at a source: the type is its body, the properties its links."""
    out = changes.change_states(_read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "props")
    return out.groupBy("state", "kind").agg(F.count("*").alias("n"))


def adaptive_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next look at each user, from failures and quiet events."""
    g = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.count_if(F.col("event_type") == "view").alias("quiet"), F.count("*").alias("n"))
    k = F.col("user_id")
    priority = F.concat(F.lit("TIER_"), (k % 5 + 1).cast("string"))  # there is no fifth
    outcome = F.element_at(F.array(*map(F.lit, ("CHECK_FAILED", "UNCHANGED", "CHANGED", "ACCESS_FORBIDDEN", "BASELINE_CREATED", "TIMEOUT"))), (F.col("n") % 6 + 1).cast("int"))
    retry = F.when(k % 9 == 0, (k * 31) % 3000)
    return g.select("user_id", changes.next_interval(priority, outcome, F.col("failures") % 8, F.col("quiet"), retry, F.when(k % 7 == 0, k % 200)).alias("seconds"))


def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after 45 minutes without an event."""
    s = changes.sessions(_read(spark, sf_dir, "events"), "user_id", "ts", 45)
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


MOVES = {("idle", "signup"): "asking", ("idle", "view"): "browsing", ("browsing", "click"): "asking", ("asking", "purchase"): "done", ("asking", "error"): "idle", ("browsing", "error"): "idle", ("done", "view"): "browsing"}


def fsm_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.folded(_read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", MOVES, "idle").groupBy("state").agg(F.count("*").alias("users"))


def _versions(spark, sf_dir):
    """A customer's orders as versions; every third stays open for a year, others for 100 days."""
    o = _read(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.to_date("o_orderdate")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("version"), day.alias("start"), F.date_add(day, F.when(F.col("o_orderkey") % 3 == 0, 365).otherwise(100)).alias("end"))


def version_gap_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.version_issues(_versions(spark, sf_dir), "o_custkey", "version", "start", "end").groupBy("issue").agg(F.count("*").alias("n"))


def asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of each customer that holds on a day of its own."""
    v = _versions(spark, sf_dir)
    days = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")).alias("day"))
    v = v.withColumn("start", F.when(F.col("o_orderkey") % 11 != 0, F.col("start"))).withColumn("end", F.when(F.col("o_orderkey") % 13 != 0, F.col("end")))
    return changes.as_of(days, v, "o_custkey", "day", "start", "end", "version", "o_custkey", F.col("o_orderkey") % 5 != 0)


def catalogue_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of the parts: prices of some change, some go, some come."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    k = F.col("p_partkey")
    new = p.where(k % 17 != 0).withColumn("p_retailprice", F.when(k % 13 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")))
    return changes.full_diff(p.where(k % 19 != 0), new, "p_partkey", ["p_retailprice", "p_size"]).groupBy("change").agg(F.count("*").alias("n"))


def due_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a due date first, then those that are due, oldest first: the next 25."""
    k = F.col("o_orderkey")
    due = F.when(k % 10 != 0, F.date_add(F.to_date("o_orderdate"), 30))
    rows = _read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", due.alias("due"))
    rows = rows.where(F.col("due").isNull() | (F.col("due") <= F.lit("1997-01-01").cast("date"))).orderBy(F.asc_nulls_first("due"), "o_orderkey").limit(25)
    return rows.select("o_orderkey", F.col("due").cast("string").alias("due"))


_LABELLED = "labels JOIN documents USING (doc_id)"
_VERSIONS = """v AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS version, o_orderdate::DATE AS s,
  o_orderdate::DATE + CASE WHEN o_orderkey % 3 = 0 THEN 365 ELSE 100 END::INT AS e FROM orders)"""
_COS = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))"
_PARTS = "p_partkey, p_retailprice, p_size"
QUERIES = {
    f.__name__: f
    for f in (ranking_quality, confusion_prf, confusion_matrix, slice_metrics, transcription_errors, latency_percentiles, status_rollup, health_counts, activity_feed, global_search, validate_rules_severity, interval_contradiction, fingerprint_change, adaptive_schedule, session_ttl, fsm_fold, version_gap_overlap, asof_version, catalogue_diff, due_work)
}
ORACLE_SQL = {
    "ranking_quality": f"""WITH r AS (SELECT q.vec_id AS query_id, v.vec_id, CASE WHEN q.label <> v.label THEN 0 WHEN v.vec_id < 100 THEN 2 ELSE 1 END AS gain, round(greatest(0, least(1, {_COS})), 6) AS s
      FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
      k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS i, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS j FROM r),
      m AS (SELECT query_id, sum((gain > 0)::INT) AS relevant, sum((gain > 0 AND i <= 10)::INT) AS hits, min(CASE WHEN gain > 0 AND i <= 10 THEN i END) AS first,
        sum(CASE WHEN i <= 10 THEN gain / log2(i + 1) ELSE 0 END) AS dcg, sum(CASE WHEN j <= 10 THEN gain / log2(j + 1) ELSE 0 END) AS best FROM k GROUP BY query_id)
      SELECT query_id, round(CASE WHEN relevant > 0 THEN hits / relevant ELSE 1 END, 4) AS recall, round(hits / 10, 4) AS precision, round(coalesce(1 / first, 0), 4) AS mrr, round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 4) AS ndcg FROM m""",
    "confusion_prf": f"""WITH c AS (SELECT lang, count(*) FILTER (n_chars > 1000 AND quality = 1) AS tp, count(*) FILTER (n_chars > 1000 AND quality <> 1) AS fp, count(*) FILTER (n_chars <= 1000 AND quality = 1) AS fn FROM {_LABELLED} GROUP BY lang),
      s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
      SELECT lang, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM s""",
    "confusion_matrix": f"SELECT quality, count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (n_chars >= 500 AND n_chars < 3000) AS middle, count(*) FILTER (n_chars >= 3000) AS long FROM {_LABELLED} GROUP BY quality",
    "slice_metrics": f"SELECT lang, source, count(*) AS n, round(avg(quality), 4) AS quality FROM {_LABELLED} GROUP BY GROUPING SETS ((lang), (source), ())",
    "transcription_errors": r"""WITH t(id, r, h) AS (VALUES """ + ", ".join(f"({i}::BIGINT, '{r}', '{h}')" for i, r, h in TRANSCRIPTS) + r"""),
      w AS (SELECT id, regexp_replace(r, '\s+', '', 'g') AS r, regexp_replace(h, '\s+', '', 'g') AS h, list_filter(regexp_split_to_array(lower(r), '\s+'), lambda x: x <> '') AS rw, list_filter(regexp_split_to_array(lower(h), '\s+'), lambda x: x <> '') AS hw FROM t),
      c AS (SELECT *, list_distinct(list_concat(rw, hw)) AS k FROM w),
      d AS (SELECT *, array_to_string(list_transform(rw, lambda x: chr((47 + list_position(k, x))::INT)), '') AS rc, array_to_string(list_transform(hw, lambda x: chr((47 + list_position(k, x))::INT)), '') AS hc FROM c)
      SELECT id, round(CASE WHEN length(r) > 0 THEN levenshtein(r, h) / length(r) WHEN length(h) > 0 THEN 1 ELSE 0 END, 4) AS cer, round(CASE WHEN len(rw) > 0 THEN levenshtein(rc, hc) / len(rw) WHEN len(hw) > 0 THEN 1 ELSE 0 END, 4) AS wer FROM d""",
    "latency_percentiles": "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE i = least(floor(n * 0.95::DOUBLE), n - 1)",
    "status_rollup": """SELECT CASE o_orderstatus WHEN 'O' THEN 'waiting' WHEN 'P' THEN 'processing' ELSE 'done' END AS stage, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS oldest,
      count(*) FILTER (o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '1996-01-01') AS stuck FROM orders GROUP BY 1""",
    "health_counts": """WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id)
      SELECT CASE WHEN errors * 2 > n THEN 'DOWN' WHEN errors > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status, count(*) AS users, sum(n)::BIGINT AS events, sum(errors)::BIGINT AS errors FROM u GROUP BY 1""",
    "activity_feed": """SELECT kind, id, strftime(a, '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS a FROM orders UNION ALL SELECT 'event', event_id, ts FROM events) ORDER BY a DESC, kind, id LIMIT 20""",
    "global_search": """(SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer WHERE c_name ILIKE '%1%' ORDER BY 2 LIMIT 10) UNION ALL
      (SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE s_name ILIKE '%1%' ORDER BY 2 LIMIT 10) UNION ALL (SELECT 'part', p_partkey, p_name FROM part WHERE p_name ILIKE '%1%' ORDER BY 2 LIMIT 10)""",
    "validate_rules_severity": """WITH c AS (SELECT l_orderkey, count(*) FILTER (l_discount > 0.09::DOUBLE AND l_quantity > 45) AS b, count(*) FILTER (l_extendedprice / l_quantity > 1900) AS e, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS w FROM lineitem GROUP BY 1)
      SELECT CASE WHEN b > 0 THEN 'FAILED' WHEN e > 0 THEN 'REVIEW_REQUIRED' ELSE 'PASSED' END AS status, count(*) AS orders, sum(b)::BIGINT AS blockers, sum(e)::BIGINT AS errors, sum(w)::BIGINT AS warnings FROM c WHERE b + e + w > 0 GROUP BY 1""",
    "interval_contradiction": """WITH l AS (SELECT l_orderkey, l_linenumber % 2 = 1 AS lower, l_quantity AS v, l_linenumber % 4 IN (0, 3) AS strict, CASE WHEN l_linenumber > 2 THEN (l_linenumber % 2 + l_orderkey % 2)::VARCHAR END AS branch FROM lineitem),
      k AS (SELECT DISTINCT l_orderkey, branch FROM l),
      m AS (SELECT k.l_orderkey, k.branch, max(v) FILTER (lower) AS low, min(v) FILTER (NOT lower) AS high FROM k JOIN l ON l.l_orderkey = k.l_orderkey AND (l.branch IS NULL OR l.branch = k.branch) GROUP BY ALL)
      SELECT l_orderkey, 'quantity' AS field, branch, low, high FROM m WHERE low > high OR (low = high AND EXISTS (SELECT 1 FROM l WHERE l.l_orderkey = m.l_orderkey AND (l.branch IS NULL OR l.branch = m.branch) AND v = low AND strict))""",
    "fingerprint_change": """WITH e AS (SELECT *, row_number() OVER w AS i, lag(event_type) OVER w AS pe, lag(props) OVER w AS pp FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      SELECT CASE WHEN i = 1 THEN 'BASELINE' WHEN event_type IS DISTINCT FROM pe OR props IS DISTINCT FROM pp THEN 'CHANGED' ELSE 'UNCHANGED' END AS state,
        CASE WHEN i = 1 THEN NULL WHEN event_type IS DISTINCT FROM pe AND props IS DISTINCT FROM pp THEN 'BOTH' WHEN event_type IS DISTINCT FROM pe THEN 'BODY' WHEN props IS DISTINCT FROM pp THEN 'LINKS' END AS kind, count(*) AS n FROM e GROUP BY ALL""",
    "adaptive_schedule": """WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'error') % 8 AS f, count(*) FILTER (event_type = 'view') AS q, count(*) % 6 AS o, CASE WHEN user_id % 9 = 0 THEN user_id * 31 % 3000 END AS retry,
        CASE WHEN user_id % 7 = 0 AND user_id % 200 > 0 THEN user_id % 200 ELSE CASE user_id % 5 WHEN 0 THEN 60 WHEN 1 THEN 360 WHEN 2 THEN 1440 WHEN 3 THEN 10080 ELSE 1440 END END AS own FROM events GROUP BY 1),
      b AS (SELECT *, greatest(15, least(own, 10080))::DOUBLE AS base FROM g)
      SELECT user_id, CASE WHEN retry > 0 THEN greatest(retry, 900)::DOUBLE WHEN o IN (0, 5) THEN greatest(15, least(15 * power(2, greatest(least(f, 5) - 1, 0)), 10080)) * 60
        WHEN o = 3 THEN 1440 * 60 WHEN o IN (1, 4) THEN greatest(15, least(base * CASE WHEN q >= 10 THEN 2.25 WHEN q >= 5 THEN 1.5 ELSE 1 END, 10080)) * 60 ELSE base * 60 END::DOUBLE AS seconds FROM b""",
    "session_ttl": """WITH e AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 45 MINUTE)::INT, 1) AS new FROM events),
      s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    "fsm_fold": f"""WITH RECURSIVE m(s, e, t) AS (VALUES {", ".join(f"('{s}', '{e}', '{t}')" for (s, e), t in MOVES.items())}), o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      f AS (SELECT user_id, 0::BIGINT AS i, 'idle' AS state FROM events GROUP BY user_id UNION ALL SELECT f.user_id, o.i, coalesce(m.t, f.state) FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1 LEFT JOIN m ON m.s = f.state AND m.e = o.event_type),
      l AS (SELECT user_id, arg_max(state, i) AS state FROM f GROUP BY 1) SELECT state, count(*) AS users FROM l GROUP BY 1""",
    "version_gap_overlap": f"WITH {_VERSIONS}, n AS (SELECT *, lead(s) OVER (PARTITION BY o_custkey ORDER BY version) AS nx FROM v) SELECT CASE WHEN e > nx THEN 'OVERLAP' ELSE 'GAP' END AS issue, count(*) AS n FROM n WHERE e > nx OR nx - e > 1 GROUP BY 1",
    "asof_version": f"WITH {_VERSIONS} SELECT c_custkey AS o_custkey, coalesce(max(version) FILTER (o_orderkey % 5 <> 0), max(version)) AS version FROM customer LEFT JOIN v ON o_custkey = c_custkey AND (o_orderkey % 11 = 0 OR s <= DATE '1995-01-01' + (c_custkey % 900)::INT) AND (o_orderkey % 13 = 0 OR DATE '1995-01-01' + (c_custkey % 900)::INT <= e) GROUP BY 1",
    "catalogue_diff": f"""WITH a AS (SELECT {_PARTS} FROM part WHERE p_partkey % 19 <> 0), b AS (SELECT p_partkey, p_retailprice + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS p_retailprice, p_size FROM part WHERE p_partkey % 17 <> 0)
      SELECT CASE WHEN a.p_partkey IS NULL THEN 'ADDED' WHEN b.p_partkey IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change, count(*) AS n FROM a FULL JOIN b ON a.p_partkey = b.p_partkey
      WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_retailprice <> b.p_retailprice GROUP BY 1""",
    "due_work": """SELECT o_orderkey, due::VARCHAR AS due FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE + 30 END AS due FROM orders WHERE o_orderstatus <> 'F') d
      WHERE d.due IS NULL OR d.due <= DATE '1997-01-01' ORDER BY d.due NULLS FIRST, o_orderkey LIMIT 25""",
}
