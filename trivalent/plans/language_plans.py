"""Amounts as they are said, names in texts, and facts against what was expected of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import dictionary, matching
from ..operators.sizes import dealt


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spoken_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' amounts said in one of eight ways and read again: the number, the range and the bounds that are understood."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.floor("o_totalprice").alias("n"))
    o = dealt(o, "o_orderkey")  # reading a text is much work, and a file may have few row groups
    say = lambda c: numbers.hindi_words(c)
    small = F.col("k") % 90 + 2
    ways = [
        say(F.col("n")), F.concat(F.lit("मेरी आय "), say(F.col("n") * 100), F.lit(" रुपये है")), F.concat(F.lit("₹"), F.format_number(F.col("n"), 0), F.lit(" से कम")), F.concat(F.lit("साढ़े "), say(small), F.lit(" लाख")),
        F.concat(say(small), F.lit(" से "), say(small + 5), F.lit(" लाख के बीच")), F.concat(F.lit("पौने "), say(small), F.lit(" हजार से ज्यादा")), F.concat(F.lit("about "), small.cast("string"), F.lit(".5 crore")), F.concat(F.lit("no. "), say(small), F.lit(" "), say(small)),
    ]
    said = F.lit(None).cast("string")
    for i, way in reversed([*enumerate(ways)]):  # only the way that is asked for is said, not all of an array
        said = F.when(F.col("o_orderkey") % 8 == i, way).otherwise(said)
    read = o.select("o_orderkey", said.alias("said")).select("o_orderkey", "said", F.explode(F.array(numbers.numbers(F.col("said")))).alias("found"))  # read once
    c, found = F.col("said"), F.col("found")
    out = read.select("o_orderkey", numbers.number(c, found).alias("value"), F.size(found).cast("long").alias("n"), numbers.number_range(c, found).alias("r"), numbers.bounds(c, found).alias("b"), numbers.about(c).alias("about"))
    return out.select("o_orderkey", "value", "n", "r.low", "r.high", "b.least", "b.most", "about")


SPOKEN_AMOUNTS = """
WITH a AS (SELECT o_orderkey, o_orderkey % 8 AS way, floor(o_totalprice) AS n, (o_custkey % 90 + 2)::DOUBLE AS k FROM orders),
v AS (SELECT *, CASE way WHEN 0 THEN n WHEN 1 THEN n * 100 WHEN 2 THEN n WHEN 3 THEN (k + 0.5) * 100000 WHEN 4 THEN k WHEN 5 THEN (k - 0.25) * 1000 WHEN 6 THEN (k + 0.5) * 10000000 ELSE k END AS value FROM a)
SELECT o_orderkey, value, (CASE WHEN way IN (4, 7) THEN 2 ELSE 1 END)::BIGINT AS n, CASE WHEN way = 4 THEN k * 100000 END AS low, CASE WHEN way = 4 THEN (k + 5) * 100000 END AS high, CASE WHEN way = 5 THEN value END AS least, CASE WHEN way = 2 THEN value END AS most, way = 6 AS about FROM v
"""


def dictionary_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold, as whole words, the first three words of each document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    heads = docs.select(F.array_join(F.slice(F.split(dictionary.plain_words(F.col("text")), " "), 1, 3), " ").alias("name")).distinct()
    found = dictionary.mentions(docs, "doc_id", "text", heads, "name", overlapping=True)
    return found.select("doc_id", "name").distinct().groupBy("name").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


DICTIONARY_MENTIONS = r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS t FROM documents),
h AS (SELECT DISTINCT array_to_string(string_split(t, ' ')[1:3], ' ') AS name FROM d WHERE t <> '')
SELECT name, count(*) AS n_docs, min(doc_id) AS first_doc FROM h JOIN d ON contains(' ' || t || ' ', ' ' || name || ' ') GROUP BY name
"""


def _facts(lines: DataFrame, found: bool) -> DataFrame:
    """Facts of orders: what is expected of their lines, and what was found in those with a discount, in other spelling and partly wrong."""
    topic = F.element_at(F.array(*(F.lit(x) for x in ("age", "income", "amount"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    if not found:
        return lines.select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"), F.concat(F.lit("benefits."), topic).alias("field"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("op"), F.col("l_quantity").cast("int").cast("string").alias("value"))
    off = F.col("l_quantity").cast("int") + (F.col("l_tax") > 0.06).cast("int")
    return lines.where("l_discount > 0.02").select("l_orderkey", (100 - F.col("l_linenumber")).cast("long").alias("n"), F.concat(F.lit(" Benefits/x["), F.col("l_linenumber").cast("string"), F.lit("]/"), topic).alias("field"), F.lower("l_returnflag").alias("op"), F.concat(off.cast("string"), F.lit(".0")).alias("value"))


def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all orders as cases, by the order's status."""
    lines, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    scores = matching.case_scores(matching.fact_pairs(_facts(lines, False), _facts(lines, True), "l_orderkey"), "l_orderkey")
    return matching.totals(scores.join(orders, "l_orderkey"), "o_orderstatus")


EXTRACTION_SCORES = """
WITH e AS (SELECT l_orderkey AS c, l_suppkey % 3 AS topic, l_linenumber AS i, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS op, l_quantity::INT AS v, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END NULLS FIRST, l_quantity::INT::VARCHAR) AS nth FROM lineitem),
f AS (SELECT l_orderkey AS c, l_suppkey % 3 AS topic, l_returnflag AS op, l_quantity::INT + (l_tax > 0.06)::INT AS v, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber DESC, lower(l_returnflag), (l_quantity::INT + (l_tax > 0.06)::INT) || '.0') AS nth FROM lineitem WHERE l_discount > 0.02),
j AS (SELECT coalesce(e.c, f.c) AS c, e.c IS NOT NULL AND f.c IS NOT NULL AS hit, e.c IS NULL AS extra, f.c IS NULL AS lost, e.v = f.v AS v, e.op IS NULL OR e.op = f.op AS op FROM e FULL JOIN f ON e.c = f.c AND e.topic = f.topic AND e.nth = f.nth),
s AS (SELECT c, count(*) FILTER (hit) AS tp, count(*) FILTER (extra) AS fp, count(*) FILTER (lost) AS fn, count(*) FILTER (hit AND v) AS vs, count(*) FILTER (hit AND op) AS ops FROM j GROUP BY c),
t AS (SELECT o_orderstatus, count(*) AS cases, count(*) FILTER (fp = 0 AND fn = 0 AND vs = tp AND ops = tp) AS strict, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, sum(vs)::DOUBLE AS vs, sum(ops)::DOUBLE AS ops FROM s JOIN orders ON o_orderkey = c GROUP BY 1)
SELECT o_orderstatus, cases, round(strict / cases, 4) AS strict_rate, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(vs / tp, 4) AS value_accuracy, round(ops / tp, 4) AS op_accuracy FROM t
"""


def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and finished lines of each order, paired one to one by how near their prices are."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    lines = dealt(lines, "l_orderkey")  # lines, pairs and their grouping have these partitions
    a = lines.where("l_linestatus = 'O'").select("l_orderkey", F.col("l_linenumber").alias("open_line"), F.col("cents").alias("a"))
    b = lines.where("l_linestatus = 'F'").select("l_orderkey", F.col("l_linenumber").alias("done_line"), F.col("cents").alias("b"))
    pairs = a.join(b, "l_orderkey").select("l_orderkey", "open_line", "done_line", (-F.floor(F.abs(F.col("a") - F.col("b")) / 1000000)).cast("double").alias("score"))
    return matching.one_to_one(pairs, "l_orderkey", "open_line", "done_line", "score")


GREEDY_PAIRS = """
WITH RECURSIVE l AS (SELECT l_orderkey AS c, l_linenumber AS i, l_linestatus AS s, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem),
p AS (SELECT a.c, a.i AS a, b.i AS b, (-min(floor(abs(a.cents - b.cents) / 1000000.0)::BIGINT))::DOUBLE AS score FROM l a JOIN l b ON a.c = b.c AND a.s = 'O' AND b.s = 'F' GROUP BY 1, 2, 3),
g AS (
  SELECT c, [a] AS ua, [b] AS ub, a, b, score FROM p QUALIFY row_number() OVER (PARTITION BY c ORDER BY score DESC, a, b) = 1
  UNION ALL
  SELECT g.c, list_append(ua, p.a), list_append(ub, p.b), p.a, p.b, p.score FROM g JOIN p ON p.c = g.c WHERE NOT list_contains(ua, p.a) AND NOT list_contains(ub, p.b) QUALIFY row_number() OVER (PARTITION BY g.c ORDER BY p.score DESC, p.a, p.b) = 1)
SELECT c AS l_orderkey, a AS open_line, b AS done_line, score FROM g
"""

QUERIES = {f.__name__: f for f in (spoken_amounts, dictionary_mentions, extraction_scores, greedy_pairs)}
ORACLE_SQL = {"spoken_amounts": SPOKEN_AMOUNTS, "dictionary_mentions": DICTIONARY_MENTIONS, "extraction_scores": EXTRACTION_SCORES, "greedy_pairs": GREEDY_PAIRS}
