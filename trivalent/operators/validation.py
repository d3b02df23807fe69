"""Coded data-quality rules: one Column a rule, rows of issues, and a run's status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def issues(df: DataFrame, key: list[str], rules: list[tuple[str, str, Column]]) -> DataFrame:
    """key, code, severity for every rule (code, severity, condition that is broken) that a row breaks; an unknown condition is none."""
    found = F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, broken in rules)))
    return df.select(*key, F.explode(found).alias("i")).select(*key, "i.code", "i.severity")


def run_status(found: DataFrame, by: list[str]) -> DataFrame:
    """Counts by severity; a blocker fails a run, an error sends it to review, warnings pass."""
    n = {s: F.count_if(F.col("severity") == s) for s in ("BLOCKER", "ERROR", "WARNING")}
    status = F.when(n["BLOCKER"] > 0, "FAILED").when(n["ERROR"] > 0, "REVIEW_REQUIRED").otherwise("PASSED")
    return found.groupBy(*by).agg(*(c.alias(s.lower() + "s") for s, c in n.items()), status.alias("status"))


def contradictions(bounds: DataFrame, key: str, field: str, branch: str | None = None) -> DataFrame:
    """Fields whose greatest lower bound (op, value) is above their least upper one, or equal to it where either is strict.

    Bounds of different branches (alternatives of an OR) don't contradict each other; those without a branch hold in all."""
    low, high = F.col("op").isin("GT", "GTE"), F.col("op").isin("LT", "LTE")
    strict = F.col("op").isin("GT", "LT").cast("int")
    rows = bounds.withColumn("branch", F.col(branch) if branch else F.lit(None).cast("string"))
    g = rows.groupBy(key, field, "branch").agg(F.max(F.when(low, F.struct("value", strict.alias("strict")))).alias("lo"), F.min(F.when(high, F.struct("value", (-strict).alias("strict")))).alias("hi"))
    w = Window.partitionBy(key, field)
    shared = F.col("branch").isNull()
    g = g.withColumn("all_lo", F.max(F.when(shared, F.col("lo"))).over(w)).withColumn("all_hi", F.min(F.when(shared, F.col("hi"))).over(w))
    g = g.withColumn("lo", F.greatest("lo", "all_lo")).withColumn("hi", F.least("hi", "all_hi"))
    clash = (F.col("lo.value") > F.col("hi.value")) | ((F.col("lo.value") == F.col("hi.value")) & ((F.col("lo.strict") == 1) | (F.col("hi.strict") == -1)))
    return g.where(clash).select(key, field, *(["branch"] if branch else []), F.col("lo.value").alias("low"), F.col("hi.value").alias("high"))
