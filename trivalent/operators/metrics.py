"""Retrieval, classification and transcription metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import largest_gains
from .sizes import hinted


def ranking_metrics(ranked: DataFrame, query: str, rank: str, gain: str, ideal: DataFrame, k: int) -> DataFrame:
    """query, recall, precision, reciprocal rank and nDCG at k.

    ranked has a gain (0 if irrelevant) for each row; ideal has query, relevant (how many there are) and best (their
    DCG at k). Precision divides by k; with nothing relevant recall is 1 and nDCG is 0."""
    hit = (F.col(gain) > 0) & (F.col(rank) <= k)
    seen = ranked.groupBy(query).agg(
        F.sum(hit.cast("long")).alias("hits"),
        F.min(F.when(F.col(gain) > 0, F.col(rank))).alias("first"),
        F.sum(F.when(F.col(rank) <= k, F.col(gain) / F.log2(F.col(rank) + 1)).otherwise(0.0)).alias("dcg"),
    )
    out = ideal.join(seen, query, "left").fillna({"hits": 0, "dcg": 0.0})
    return out.select(
        query,
        F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(1.0).alias("recall"),
        (F.col("hits") / k).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"),
    )


def ideal_gains(judged: DataFrame, query: str, gain: str, k: int, n: Column | None = None) -> DataFrame:
    """query, relevant, best (the DCG of the k largest gains) from all judgments, as largest_gains has them. Gains are few different
    numbers, which are counted: no query's judgments are sorted."""
    ideal = largest_gains(judged, query, gain, k, n)
    best = F.aggregate(F.transform("gains", lambda g, i: g / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
    return ideal.select(query, "relevant", best.alias("best"))


def precision_recall(df: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """Counts and scores of a binary decision; 0 of 0 counts as 0."""
    n = df.groupBy(*by).agg(*(F.sum(c.cast("long")).alias(a) for a, c in (("tp", predicted & actual), ("fp", predicted & ~actual), ("fn", ~predicted & actual))))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select(*by, "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length, without white space; an empty reference has rate 0 against an empty hypothesis, else 1."""
    r, h = F.regexp_replace(reference, r"\s+", ""), F.regexp_replace(hypothesis, r"\s+", "")
    return F.when(F.length(r) > 0, F.levenshtein(r, h) / F.length(r)).otherwise(F.when(F.length(h) > 0, 1.0).otherwise(0.0))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over words: each distinct word of the two texts becomes one character."""
    split = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    r, h = split(reference), split(hypothesis)
    known = F.array_distinct(F.concat(r, h))
    coded = lambda a: F.array_join(F.transform(a, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0x4E00), 4, "0")), "UTF-16BE")), "")
    return F.when(F.size(r) > 0, F.levenshtein(coded(r), coded(h)) / F.size(r)).otherwise(F.when(F.size(h) > 0, 1.0).otherwise(0.0))


#: How far from a quantile its approximation's bounds are asked for, and the accuracy, whose error is far below that.
AROUND, ACCURACY = 0.001, 10_000


def index_percentile(df: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """The value at place int(n * q) of each group's sorted values, counted from 0; exact. Null values must be left out before.

    A group's approximate quantiles just below and above q bound the place; only the different values between these are put in order, and
    what is smaller is a count: no group is sorted whole."""
    bounds = F.percentile_approx(value, F.array(F.lit(max(0.0, q - AROUND)), F.lit(min(1.0, q + AROUND))), F.lit(ACCURACY))
    groups = df.groupBy(by).agg(F.count("*").alias("n"), bounds.alias("bounds"))
    rows = df.select(by, value).join(hinted(groups), by).where(F.col(value) <= F.col("bounds")[1])
    counts = rows.groupBy(by, F.when(F.col(value) >= F.col("bounds")[0], F.col(value)).alias("value")).agg(F.count("*").alias("own"), F.first("n").alias("n"))
    upto = F.sum("own").over(Window.partitionBy(by).orderBy(F.asc_nulls_first("value")))
    place = F.least(F.floor(F.col("n") * q), F.col("n") - 1)
    return counts.withColumn("upto", upto).where(F.col("upto") > place).groupBy(by).agg(F.min("value").alias("value"))


def interpolated_percentile(df: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """The q-quantile of each group between the two nearest values, exact. Null values are left out.

    As in index_percentile approximate quantiles just below and above q bound the place, and only what lies between them is put in
    order; of what is below the largest value is kept, and of what is above the smallest, as these may be neighbours in small groups."""
    rows = df.select(by, F.col(value).cast("double").alias("v")).where("v is not null")
    bounds = F.percentile_approx("v", F.array(F.lit(max(0.0, q - AROUND)), F.lit(min(1.0, q + AROUND))), F.lit(ACCURACY))
    groups = rows.groupBy(by).agg(F.count("*").alias("n"), bounds.alias("bounds"))
    v, low, high = F.col("v"), F.col("bounds")[0], F.col("bounds")[1]
    zone = F.when(v < low, 0).when(v <= high, 1).otherwise(2)
    counts = rows.join(hinted(groups, 50), by).groupBy(by, zone.alias("zone"), F.when(zone == 1, v).alias("own")).agg(F.count("*").alias("k"), F.min("v").alias("least"), F.max("v").alias("most"), F.first("n").alias("n"))
    near = F.when(F.col("zone") == 0, F.col("most")).otherwise(F.col("least"))
    upto = F.sum("k").over(Window.partitionBy(by).orderBy("zone", "own"))  # the different values near the quantile
    place = (F.col("n") - 1) * F.lit(float(q))
    at = lambda p: F.min(F.when(F.col("upto") > p, F.struct("zone", "near")))["near"]
    out = counts.withColumn("near", near).withColumn("upto", upto).groupBy(by).agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"), F.first(place - F.floor(place)).alias("part"))
    return out.select(by, (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))
