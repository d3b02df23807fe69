"""Differences, trees and traces: texts and their versions, documents under patches, rule trees against one another, how rules came to their verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diffs, json_trees, rules, trees
from . import rule_plans

TITLES = ("Circular", "Amendment", "Revised list", "संशोधन आदेश")


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _title(number):
    return F.concat(F.element_at(F.array(*(F.lit(t) for t in TITLES)), (number % 4 + 1).cast("int")), F.lit(" "), (2020 + number % 5).cast("string"))


def text_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the first that begins with the same line: lines that came and went, and whether that makes them a version of it."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    head = F.xxhash64(F.substring_index("text", "\n", 1))
    rows = docs.select("doc_id", head.alias("head"))
    first = rows.groupBy("head").agg(F.min("doc_id").alias("base_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = rows.join(first, "head").where("doc_id <> base_id").select("doc_id", "base_id")
    pairs = pairs.join(docs.withColumnRenamed("text", "new"), "doc_id").join(docs.select(F.col("doc_id").alias("base_id"), F.col("text").alias("old")), "base_id")
    pairs = pairs.select("*", _title(F.col("base_id")).alias("old_title"), _title(F.col("doc_id")).alias("new_title"))
    out = diffs.text_changes(pairs, "old", "new", "old_title", "new_title")
    return out.select("doc_id", "base_id", "n_added", "n_removed", F.array_join("words", ",").alias("words"), "year_changed", "is_version")


# The longest common subsequence by rows of a table: each line of the old text raises the counts where it equals one of the new.
_LINES = "CASE WHEN {0} = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace({0}, '\\n$', ''), chr(10)) END"
TEXT_VERSIONS = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS head FROM documents WHERE text IS NOT NULL),
f AS (SELECT head, min(doc_id) AS base_id FROM d GROUP BY head HAVING count(*) > 1),
p AS (SELECT n.doc_id, f.base_id, {_LINES.format("o.text")} AS old, {_LINES.format("n.text")} AS new FROM d n JOIN f ON n.head = f.head AND n.doc_id <> f.base_id JOIN d o ON o.doc_id = f.base_id),
m AS (SELECT *, list_concat([list_transform(new, lambda y: 0)], list_transform(old, lambda x: list_transform(new, lambda y: (x = y)::INT))) AS same FROM p),
l AS (SELECT *, coalesce(list_max(list_reduce(same, lambda row, hit:
    list_transform(range(1, len(row) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(row[i], hit[i] + CASE WHEN i > 1 THEN row[i - 1] ELSE 0 END)))))), 0) AS common FROM m),
t AS (SELECT doc_id, base_id, len(new) - common AS n_added, len(old) - common AS n_removed, doc_id % 5 <> base_id % 5 AS year_changed,
    list_sort(list_distinct(list_filter([CASE WHEN doc_id % 4 = 1 OR base_id % 4 = 1 THEN 'amendment' END, CASE WHEN doc_id % 4 = 2 OR base_id % 4 = 2 THEN 'revised' END,
      CASE WHEN doc_id % 4 = 3 OR base_id % 4 = 3 THEN 'आदेश' END, CASE WHEN doc_id % 4 = 3 OR base_id % 4 = 3 THEN 'संशोधन' END], lambda w: w IS NOT NULL))) AS words FROM l)
SELECT doc_id, base_id, n_added::BIGINT AS n_added, n_removed::BIGINT AS n_removed, array_to_string(words, ',') AS words, year_changed, (n_added > 0 OR n_removed > 0) AND (len(words) > 0 OR year_changed) AS is_version FROM t
"""


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, j: a customer with its orders as JSON."""
    orders = _read(spark, sf_dir, "orders").select("o_custkey", F.struct(F.concat(F.lit("o"), F.col("o_orderkey")).alias("name"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).alias("o"))
    lists = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o")).alias("orders"))  # one customer's
    c = _read(spark, sf_dir, "customer").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    place = F.struct(F.col("c_nationkey").alias("nation"))
    none = F.array().cast("array<struct<name:string,priority:string,status:string>>")
    return c.select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), place.alias("address"), F.coalesce("orders", none).alias("orders"), F.col("c_mktsegment").alias("segment"))).alias("j"))


def customer_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are closed and urgent ones taken out again, large ones listed on their own; debtors are blocked, builders have a yard."""
    o, c = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    name = F.concat(F.lit("o"), F.col("o_orderkey"))
    patch = lambda df, id, path, value, seq: df.select(F.col(id).alias("id"), path.alias("path"), value.alias("value"), seq.cast("long").alias("seq"), F.lit("orders" if id == "o_custkey" else "customer").alias("origin"))
    at = F.concat(F.lit("/orders/"), name)
    return (
        patch(o.where("o_orderstatus = 'F'"), "o_custkey", F.concat(at, F.lit("/status")), F.lit('"closed"'), F.col("o_orderkey") * 2)
        .union(patch(o.where("o_orderpriority = '1-URGENT'"), "o_custkey", at, F.lit(None).cast("string"), F.col("o_orderkey") * 2 + 1))
        .union(patch(o.where("o_totalprice > 300000"), "o_custkey", F.concat(F.lit("/flags/large/"), name), F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), F.col("o_orderkey")))
        .union(patch(c.where("c_acctbal < 0"), "c_custkey", F.lit("/address"), F.lit('{"nation":null,"blocked":true}'), F.lit(0)))
        .union(patch(c.where("c_mktsegment = 'BUILDING'"), "c_custkey", F.lit("/address/site"), F.lit('"yard"'), F.lit(1)))
    )


def patched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' documents walked, patched and folded back: the hash of what they have become, and how many nodes came from patches."""
    out = json_trees.patched_texts(customer_documents(spark, sf_dir), customer_patches(spark, sf_dir), "id", "j", ("name",))
    return out.select("id", F.sha2("json", 256).alias("hash"), "n_nodes", "n_patched")


PATCHED_DOCUMENTS = """
WITH o AS (SELECT *, 'o' || o_orderkey AS name, o_orderpriority = '1-URGENT' AS gone FROM orders),
l AS (SELECT o_custkey, string_agg('{"name":"' || name || '","priority":"' || o_orderpriority || '","status":"' || CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderstatus END || '"}', ',' ORDER BY name) FILTER (WHERE NOT gone) AS list,
  string_agg('"' || name || '":' || round(o_totalprice * 100)::BIGINT, ',' ORDER BY name) FILTER (WHERE o_totalprice > 300000) AS large,
  count(*) FILTER (WHERE NOT gone) AS n, count(*) FILTER (WHERE NOT gone AND o_orderstatus = 'F') AS closed, count(*) FILTER (WHERE o_totalprice > 300000) AS n_large FROM o GROUP BY o_custkey),
c AS (SELECT *, c_acctbal < 0 AS debt, c_mktsegment = 'BUILDING' AS yard, coalesce(n, 0) AS orders_left, coalesce(n_large, 0) AS many FROM customer LEFT JOIN l ON c_custkey = o_custkey)
SELECT c_custkey AS id, sha256('{"address":{' || CASE WHEN debt THEN '"blocked":true,"nation":null' ELSE '"nation":' || c_nationkey END || CASE WHEN yard THEN ',"site":"yard"' ELSE '' END || '}'
  || CASE WHEN many > 0 THEN ',"flags":{"large":{' || large || '}}' ELSE '' END || ',"id":' || c_custkey || ',"name":"' || c_name || '","orders":[' || coalesce(list, '') || '],"segment":"' || c_mktsegment || '"}') AS hash,
  7 + debt::INT + yard::INT + 4 * orders_left + CASE WHEN many > 0 THEN 2 + many ELSE 0 END AS n_nodes, CASE WHEN debt THEN 3 ELSE 0 END + yard::INT + coalesce(closed, 0) + CASE WHEN many > 0 THEN 2 + many ELSE 0 END AS n_patched FROM c
"""


def part_rules(spark: SparkSession, sf_dir: str, turned: bool = False) -> DataFrame:
    """id, j: a rule tree made of a part; turned, its children are in another order."""
    value = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    condition = lambda field, op, v: F.concat(F.lit(f'{{"field":"{field}","operator":"{op}","value":'), v, F.lit("}"))
    group = lambda kind, children: F.concat(F.lit('{"type":"'), kind, F.lit('","children":['), F.array_join(children, ","), F.lit("]}"))
    word = lambda n: F.element_at(F.split("p_name", " "), n)
    cents = F.round(F.col("p_retailprice") * 100).cast("long").cast("string")
    either = [condition("category", "IN", F.concat(F.lit("["), value(F.col("p_brand")), F.lit(","), value(word(1)), F.lit("]"))), condition("income", "LTE", cents)]
    children = [
        condition("age", "GTE", F.col("p_size").cast("string")),
        F.when(F.col("p_type") != "ECONOMY", condition("Occupation", "EQ", value(F.col("p_type")))),
        group(F.lit("any"), F.array(*(either[::-1] if turned else either))),
        group(F.lit("NOT"), F.array(condition("district", "EQ", value(word(2))))),
    ]
    kind = F.when(F.col("p_size") > 10, "AND").otherwise("OR")
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), group(kind, F.array_compact(F.array(*(children[::-1] if turned else children)))).alias("j"))


def rule_tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes a part's rules differ from those of the part before it, the children's order apart, where these are an amendment."""
    base, new = trees.nodes(part_rules(spark, sf_dir), "id", "j"), trees.nodes(part_rules(spark, sf_dir, turned=True), "id", "j")
    return trees.changes(base.withColumn("id", F.col("id") + 1), new, "id").withColumnRenamed("id", "p_partkey")


_CONDITIONS = """k AS (SELECT p_partkey AS id, unnest(['age', 'occupation', 'category', 'income', 'district']) AS field,
  unnest(['GTE ' || p_size, CASE WHEN p_type <> 'ECONOMY' THEN 'EQ ' || lower(p_type) END,
    'IN [' || array_to_string(list_sort([lower(p_brand), lower(string_split(p_name, ' ')[1])]), ',') || ']', 'LTE ' || round(p_retailprice * 100)::BIGINT, 'EQ ' || lower(string_split(p_name, ' ')[2])]) AS says FROM part)"""
RULE_TREE_CHANGES = f"""
WITH {_CONDITIONS}, r AS (SELECT p_partkey AS id, CASE WHEN p_size > 10 THEN 'AND' ELSE 'OR' END AS kind FROM part)
SELECT n.id AS p_partkey, n.field, CASE WHEN b.says IS NULL THEN 'ADD' ELSE 'REPLACE' END AS change, CASE WHEN n.field IN ('age', 'category', 'income') THEN 'CRITICAL' ELSE 'NORMAL' END AS risk, b.says AS old, n.says AS new
FROM k n JOIN k b ON b.id = n.id - 1 AND b.field = n.field WHERE n.says IS NOT NULL AND n.says IS DISTINCT FROM b.says
UNION ALL SELECT n.id, '0', 'MODIFY', 'CRITICAL', b.kind, n.kind FROM r n JOIN r b ON b.id = n.id - 1 WHERE n.kind <> b.kind
"""


def equal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many suppliers share each supplier's rules, whatever the order of their parts, and the first of these."""
    s = _read(spark, sf_dir, "supplier")
    condition = lambda field, v: F.concat(F.lit(f'{{"field":"{field}","operator":"gte","value":'), v, F.lit("}"))
    one, two = condition("age", F.col("s_nationkey").cast("string")), condition(" Income", F.floor(F.col("s_acctbal") / 5000).cast("string"))
    turned = F.when(F.col("s_acctbal") % 2 < 1, F.concat(one, F.lit(","), two)).otherwise(F.concat(two, F.lit(","), one))
    tree = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit('{"logic":"or","children":['), turned, F.lit("]}")).alias("j"))
    roots = trees.signatures(trees.nodes(tree, "id", "j"), "id").where("depth = 0")
    same = roots.groupBy("signature").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return roots.join(same, "signature").select(F.col("id").alias("s_suppkey"), "first", "n")


EQUAL_RULES = "SELECT s_suppkey, min(s_suppkey) OVER w AS first, count(*) OVER w AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey, floor(s_acctbal / 5000))"


def rule_facts(profiles: DataFrame) -> DataFrame:
    none = F.lit(None)
    fact = lambda name, num=none, text=none, flag=none: F.struct(F.lit(name).alias("field"), num.cast("double").alias("num"), text.cast("string").alias("str"), flag.cast("boolean").alias("flag_value"))
    facts = F.array(fact("age", F.col("age")), fact("income", F.col("income")), fact("segment", text=F.col("segment")), fact("has_card", flag=F.col("has_card")))
    return profiles.select("profile_id", F.explode(facts).alias("f")).select("profile_id", "f.*")


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.nodes_of(rule_plans.SCHEMES)
    return rules.trace_nodes(rule_facts(rule_plans.profiles(spark, sf_dir)), spark.createDataFrame(rows, rules.NODES), max(r[3] for r in rows))


def rule_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of every node of every tree for every profile, in the order of evaluation."""
    return _traces(spark, sf_dir).select("profile_id", "scheme_id", F.col("step").cast("long").alias("step"), "path", "outcome")


CONDITIONS = [
    ("S1", "0.0", "GTE", "45"), ("S1", "0.1", "LTE", "6000"), ("S1", "0.2.0", "IN", "building, machinery"), ("S1", "0.2.1", "EQ", "true"), ("S2", "0.0", "BETWEEN", "0 and 5000"), ("S2", "0.1.0", "EQ", "furniture"),
    ("S3", "0.0", "LT", "30"), ("S3", "0.1.0", "EQ", "automobile"), ("S3", "0.1.1", "GT", "7000"),
]


def decisive_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decided each profile's tree, and how much of that which plain comparisons of age and income expect it tells."""
    conditions = spark.createDataFrame(CONDITIONS, "scheme_id string, path string, op string, required string")
    told = rules.decisive(_traces(spark, sf_dir), conditions)
    young = F.when(F.col("age") < 45, F.lit("Age  < 45")).when(F.col("age") >= 45, "age >= 45")
    rich = F.when(F.col("income") > 6000, "income > 6000")
    gold = rule_plans.profiles(spark, sf_dir).select("profile_id", F.lit("S1").alias("scheme_id"), F.array_compact(F.array(young, rich)).alias("expected"))
    return rules.decisive_recall(told, gold).select("profile_id", "scheme_id", "outcome", F.array_join("told", "; ").alias("told"), "recall")


_SAYS = "CASE WHEN {0} THEN 'TRUE' WHEN NOT {0} THEN 'FALSE' ELSE 'UNKNOWN' END"
_UNLESS = "CASE WHEN {1} THEN 'SKIPPED' ELSE " + _SAYS + " END"
_TRACE = f"""{rule_plans._MISSING}, z AS (SELECT *, c3 OR has_card AS either, e2 AND e3 AS pair, coalesce(c1 = false, false) AS s1, coalesce(c1 = false, false) OR coalesce(c2 = false, false) AS s2, coalesce(c3, false) AS s3, coalesce(d1 = false, false) AS s4, coalesce(e1, false) AS s5, coalesce(e2 = false, false) AS s6 FROM b),
  tr AS (SELECT profile_id, unnest(['S1', 'S1', 'S1', 'S1', 'S1', 'S1', 'S2', 'S2', 'S2', 'S2', 'S3', 'S3', 'S3', 'S3', 'S3']) AS scheme_id, unnest([0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 0, 1, 2, 3, 4]) AS step,
    unnest(['0', '0.0', '0.1', '0.2', '0.2.0', '0.2.1', '0', '0.0', '0.1', '0.1.0', '0', '0.0', '0.1', '0.1.0', '0.1.1']) AS path,
    unnest([{_SAYS.format("p1")}, {_SAYS.format("c1")}, {_UNLESS.format("c2", "s1")}, {_UNLESS.format("either", "s2")}, {_UNLESS.format("c3", "s2")}, {_UNLESS.format("has_card", "s2 OR s3")},
      {_SAYS.format("p2")}, {_SAYS.format("d1")}, {_UNLESS.format("(NOT d2)", "s4")}, {_UNLESS.format("d2", "s4")},
      {_SAYS.format("p3")}, {_SAYS.format("e1")}, {_UNLESS.format("pair", "s5")}, {_UNLESS.format("e2", "s5")}, {_UNLESS.format("e3", "s5 OR s6")}]) AS outcome FROM z)"""
DECISIVE_CONDITIONS = f"""{_TRACE}, n(scheme_id, path, yes, no, open) AS (VALUES ('S1', '0.0', 'age >= 45', 'age < 45', 'age'), ('S1', '0.1', 'income <= 6000', 'income > 6000', 'income'),
    ('S1', '0.2.0', 'segment IN building, machinery', 'segment != building, machinery', 'segment'), ('S1', '0.2.1', 'has_card == true', 'has_card != true', 'has_card'),
    ('S2', '0.0', 'income BETWEEN 0 and 5000', 'income != 0 and 5000', 'income'), ('S2', '0.1.0', 'segment == furniture', 'segment != furniture', 'segment'),
    ('S3', '0.0', 'age < 30', 'age >= 30', 'age'), ('S3', '0.1.0', 'segment == automobile', 'segment != automobile', 'segment'), ('S3', '0.1.1', 'income > 7000', 'income <= 7000', 'income')),
  root AS (SELECT profile_id, scheme_id, outcome FROM tr WHERE path = '0'),
  t AS (SELECT r.profile_id, r.scheme_id, r.outcome, list_sort(list_distinct(coalesce(list(CASE t.outcome WHEN 'TRUE' THEN yes WHEN 'FALSE' THEN no ELSE open || ' is missing' END)
      FILTER (WHERE t.outcome = r.outcome OR (r.outcome = 'UNKNOWN' AND t.outcome = 'TRUE')), []))) AS told FROM root r JOIN tr t USING (profile_id, scheme_id) JOIN n USING (scheme_id, path) GROUP BY ALL),
  g AS (SELECT t.*, CASE WHEN scheme_id = 'S1' THEN list_filter([CASE WHEN age < 45 THEN 'age < 45' WHEN age >= 45 THEN 'age >= 45' END, CASE WHEN income > 6000 THEN 'income > 6000' END], lambda x: x IS NOT NULL) ELSE [] END AS gold FROM t JOIN p USING (profile_id))
SELECT profile_id, scheme_id, outcome, array_to_string(told, '; ') AS told, CASE WHEN len(gold) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(gold, told))::DOUBLE / len(gold), 4) END AS recall FROM g"""

QUERIES = {f.__name__: f for f in (text_versions, patched_documents, rule_tree_changes, equal_rules, rule_traces, decisive_conditions)}
ORACLE_SQL = {
    "text_versions": TEXT_VERSIONS,
    "patched_documents": PATCHED_DOCUMENTS,
    "rule_tree_changes": RULE_TREE_CHANGES,
    "equal_rules": EQUAL_RULES,
    "rule_traces": f"{_TRACE} SELECT profile_id, scheme_id, step::BIGINT AS step, path, outcome FROM tr",
    "decisive_conditions": DECISIVE_CONDITIONS,
}
