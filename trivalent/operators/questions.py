"""Which missing field to ask for next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of relevance, of schemes that need one field only, of repetition and of sensitive fields.
RELEVANCE, LAST_FIELD, REPEAT, SENSITIVE = 1.5, 2.0, 3.0, 0.5


def utilities(results: DataFrame, key: str, relevance: Column, asked: list[str] = (), sensitive: dict[str, float] | None = None) -> DataFrame:
    """key, field, affected, utility: every missing field's worth to the schemes that wait for it."""
    open_ = results.where("status = 'MORE_INFORMATION_REQUIRED'").select(key, F.explode("missing").alias("field"), relevance.alias("relevance"), (F.size("missing") == 1).cast("double").alias("last"))
    gain = F.sum(1 + RELEVANCE * F.col("relevance") + LAST_FIELD * F.col("last"))
    levels = F.create_map(*(F.lit(x) for pair in sensitive.items() for x in pair)) if sensitive else None
    cost = F.coalesce(levels[F.col("field")], F.lit(0.0)) * SENSITIVE if sensitive else F.lit(0.0)
    out = open_.groupBy(key, "field").agg(F.count("*").alias("affected"), gain.alias("gain"))
    return out.select(key, "field", "affected", (F.col("gain") - cost - REPEAT * F.col("field").isin(list(asked)).cast("double")).alias("utility"))


def next_question(scores: DataFrame, key: str) -> DataFrame:
    """The field of greatest utility for each key; ties go to more affected schemes, then to the smaller name."""
    best = F.max_by(F.struct("field", "affected", "utility"), F.struct("utility", "affected", F.transform(F.split("field", ""), lambda c: -F.ascii(c))))
    return scores.groupBy(key).agg(best.alias("b")).select(key, "b.*")
