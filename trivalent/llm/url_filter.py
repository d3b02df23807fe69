"""URL filter: rules first, else a tree of path templates for each host, with smoothed purities of labelled pages.

A segment's shape comes first: numbers, hexadecimal names, dates and the like are wildcards
of their kind, which leaves few distinct paths a host; they are counted before anything is
joined. Then the tree is walked from the host down. Below a node that has many distinct
children, nearly one a page, all are one wildcard; other children whose share of good pages
doesn't differ significantly from their siblings' are merged into one branch, the rest stay.
A template's purity is its share of good labelled pages, smoothed by its host's, and that by
the whole table's; templates below the threshold are rejected. Everything is DataFrame code.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: (verdict, host, path), the contract's rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: A node's children are a wildcard from so many distinct ones on, at so many a page.
DISTINCT, RATIO = 20, 0.5
#: Deviations at which siblings differ.
DIFFERENT = 1.96
STRENGTH, THRESHOLD = 4.0, 0.5
#: Keys, of about 200 bytes, that are sent to all tasks at most.
FREQUENT = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def shapes(path: Column) -> Column:
    """The path's segments with variable ones by their kind."""

    def kind(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^[0-9]+$"), "<n>")
            .when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "<date>")
            .when(s.rlike(r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$|^[0-9a-fA-F]{16,}$"), "<hex>")
            .otherwise(F.regexp_replace(s, "[0-9]+", "<n>"))
        )

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), kind)


def template_tree(paths: DataFrame) -> DataFrame:
    """paths (host, shape, n, good, bad) with template: the host's and shape's place in the tree.

    Levels are walked as long as any node has more than one shape below it; a single shape's other segments stay as they are."""
    rows, finished, level = paths.withColumn("template", F.lit("")), [], 0
    while True:
        out = rows.withColumn("segment", F.get("shape", F.lit(level)))
        child = out.where("segment is not null").groupBy("host", "template", "segment").agg(F.count("*").alias("shapes"), *(F.sum(c).alias(c) for c in ("n", "good", "bad")))
        node = child.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("shapes").alias("all_shapes"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "good", "bad")))
        child = child.join(node, ["host", "template"])
        own, rest = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad") - F.col("good") - F.col("bad")
        pooled = F.col("all_good") / (F.col("all_good") + F.col("all_bad"))
        gap = F.abs(F.col("good") / own - (F.col("all_good") - F.col("good")) / rest) / F.sqrt(pooled * (1 - pooled) * (1 / own + 1 / rest))
        differs = F.coalesce((own > 0) & (rest > 0) & (pooled > 0) & (pooled < 1) & (gap > DIFFERENT), F.lit(False))
        wild = (F.col("children") >= DISTINCT) & (F.col("children") >= RATIO * F.col("all_n"))
        label = F.when(wild, "*").when(differs | (F.col("children") == 1), F.col("segment")).otherwise("~")
        child = child.select("host", "template", "segment", F.concat("template", F.lit("/"), label).alias("below"), (F.col("all_shapes") == 1).alias("alone"))
        rest_of = F.concat("template", F.lit("/"), F.array_join(F.slice("shape", level + 1, F.size("shape")), "/"))
        out = out.join(child, ["host", "template", "segment"], "left").withColumn("template", F.when(F.col("alone"), rest_of).otherwise(F.coalesce("below", "template")))
        out = checkpointed(out.withColumn("over", F.coalesce("alone", F.lit(True))).drop("below", "segment", "alone"))  # each level uses the one before more than once
        finished.append(out.where("over").drop("over"))
        rows, level = out.where("not over").drop("over"), level + 1
        if rows.isEmpty():
            return checkpointed(functools.reduce(DataFrame.unionByName, finished))


def judged_templates(paths: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """host, shape, n, template, purity."""
    placed = template_tree(checkpointed(paths))
    total = placed.agg(F.sum("good"), F.sum("bad")).first()
    prior = ((total[0] or 0) + 1) / ((total[0] or 0) + (total[1] or 0) + 1)
    smooth = lambda good, bad, p: (good + strength * p) / (good + bad + strength)
    hosts = placed.groupBy("host").agg(smooth(F.sum("good"), F.sum("bad"), F.lit(prior)).alias("host_purity"))
    templates = placed.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).join(hosts, "host")
    templates = templates.select("host", "template", smooth(F.col("good"), F.col("bad"), F.col("host_purity")).alias("purity"))
    return placed.select("host", "shape", "template", "n").join(templates, ["host", "template"])


def _with_frequent(rows: DataFrame, keyed: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with keyed (one row a key, with n, how many of rows have it). The FREQUENT keys of most rows are sent to all tasks, so
    that of those that are shuffled none has more than a FREQUENT-th of all rows."""
    if keyed.count() <= FREQUENT:
        return rows.join(F.broadcast(keyed), on)
    most = checkpointed(keyed.orderBy(F.desc("n"), *on).limit(FREQUENT))
    return rows.join(F.broadcast(most), on).unionByName(rows.join(F.broadcast(most.select(*on)), on, "left_anti").join(keyed.join(F.broadcast(most.select(*on)), on, "left_anti"), on))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of pages: page_id, host, path, rule, verdict, template, purity.

    labels has label_id and good (boolean). A page's label is that with the last number in its path; pages without
    are unlabelled, and repeated labels count as good if all are. A null url, or one without ://, has empty host and path
    and is judged like any other host. Repeated pages count as often and are each reported; an empty table gives an empty result;
    columns of pages but page_id and url are ignored. With no labels at all every template is allowed. A purity of just the
    threshold is allowed."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    number = F.regexp_extract("path", r"([0-9]{1,18})[^0-9/]*/*$", 1).try_cast("long")
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": name, "own": verdict, "shape": F.array_join(shapes(F.col("path")), "/"), "label_id": number})
    known = labels.where("label_id is not null").groupBy("label_id").agg(F.min(F.col("good").cast("int")).alias("good"))
    # pages are counted before the join, and only those with a number take part in it
    numbered = rows.where("label_id is not null").groupBy("host", "shape", "label_id").agg(F.count("*").alias("n")).join(known, "label_id")
    labelled = numbered.groupBy("host", "shape").agg(F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * (1 - F.col("good"))).alias("bad"))
    paths = rows.groupBy("host", "shape").agg(F.count("*").alias("n")).join(labelled, ["host", "shape"], "left").fillna(0, ["good", "bad"])
    templates = checkpointed(judged_templates(paths.withColumn("shape", F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/")))))
    templates = checkpointed(templates.withColumn("shape", F.array_join("shape", "/")))
    out = _with_frequent(rows, templates, ["host", "shape"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("purity") < threshold, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the contract's rules; a page is good if the document it names has quality 1 and isn't toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return judge(table(spark, sf_dir, "pages", "page_id", "url"), labels)
