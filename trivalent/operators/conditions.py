"""Extracted conditions: duplicates merged, conflicts found, evidence numbered, runs summed up by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What makes two conditions the same, and fields that have one value in a context.
SAME = ("field", "operator", "value", "unit", "periodicity", "context")
SINGLE = ("annual_income", "family_income", "age", "residency")


def merged(conditions: DataFrame, by: list[str], order: str, refs: str = "refs") -> DataFrame:
    """One row for each different condition (SAME; nulls are alike) within `by`, with its place and the distinct references of all in order."""
    lists = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(refs).alias("r"))))
    out = conditions.groupBy(*by, *SAME).agg(F.min(order).alias(order), lists.alias("l"))
    return out.withColumn(refs, F.array_distinct(F.flatten("l.r"))).drop("l")


def conflicts(conditions: DataFrame, by: list[str], order: str, refs: str = "refs") -> DataFrame:
    """Fields of SINGLE that have several values in one context (none is 'DEFAULT'), numbered in the order of their first condition."""
    rows = merged(conditions.where(F.col("field").isin(*SINGLE)), by, order, refs).withColumn("context", F.coalesce("context", F.lit("DEFAULT")))
    found = rows.groupBy(*by, "field", "context").agg(F.min(order).alias("first"), F.array_sort(F.collect_set(F.col("value").cast("string"))).alias("values"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(refs)))).alias(refs))
    w = Window.partitionBy(*by).orderBy("first", "field", "context")
    return found.where(F.size("values") > 1).withColumn("conflict_id", F.format_string("CONF-%03d", F.row_number().over(w))).drop("first")


def evidence_registry(snippets: DataFrame, by: str, order: list[str], text: str) -> DataFrame:
    """by, text, evidence_id: each different snippet of a document, numbered by its first occurrence."""
    first = snippets.where(F.length(F.trim(text)) > 0).groupBy(by, text).agg(F.min(F.struct(*order)).alias("first"))
    return first.select(by, text, F.format_string("EV-%04d", F.row_number().over(Window.partitionBy(by).orderBy("first"))).alias("evidence_id"))


def extraction_summary(chunks: DataFrame, runs: DataFrame, document: str, chunk: str) -> DataFrame:
    """Each document's chunks against the last run of each (status, facts, scheme): counts, facts, names in order, and a status.

    Chunks without a run are pending; any failed one makes a partial failure, all failed a failure."""
    out = chunks.select(document, chunk).join(runs, [document, chunk], "left")
    n = {s: F.count_if(F.col("status") == s) for s in ("SUCCESS", "FAILED", "REVIEW")}
    state = F.when(n["FAILED"] == F.count("*"), "FAILED").when(n["FAILED"] > 0, "PARTIAL_FAILURE").when(F.count("status") < F.count("*"), "PENDING").otherwise("COMPLETED")
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("scheme").isNotNull(), F.struct(chunk, "scheme")))), lambda x: x.scheme))
    return out.groupBy(document).agg(
        F.count("*").alias("chunks"), *(c.alias(s.lower()) for s, c in n.items()), F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"), names.alias("schemes"), state.alias("state")
    )
