"""One-to-one matching of what was expected with what was found, and the scores of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import ratio
from .sizes import PART_ROWS, written


def one_to_one(pairs: DataFrame, case: str, left: str, right: str, score: str) -> DataFrame:
    """The pairs that greed takes: of each case the best first, then the best of those whose ends are both free, and so on.

    The best has the highest score, then the smallest left, then the smallest right; a null score is below all. In each round all pairs are taken that
    are the best of both their ends: greed takes these too, whatever else it takes before. Repeated pairs count once; pairs
    without an end are left out. Rounds go on until no pair is left; a round reads and writes only what is left, in partitions that grow with it.
    The first grouping is partitioned as pairs are, if that is by case."""
    rank = F.struct((-F.coalesce(score, F.lit(float("-inf")))).alias("s"), left, right)
    rest = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(case, left, right).agg(F.max(score).alias(score))
    rest, taken = written(rest.withColumn("rank", rank)), None
    while True:
        n = -(-rest.count() // (4 * PART_ROWS)) or 1  # a row is little work
        by_left, by_right = (rest.repartition(n, case, end).groupBy(case, end).agg(F.min("rank").alias("best")).select(case, f"best.{left}", f"best.{right}", "best.s").repartition(n, case, left, right) for end in (left, right))
        best = written(by_left.join(by_right.drop("s"), [case, left, right]).select(case, left, right, (-F.col("s")).alias(score)))  # a pair has one rank
        taken = best if taken is None else taken.union(best)
        for end in (left, right):
            rest = rest.repartition(n, case, end).join(best.select(case, end).repartition(n, case, end), [case, end], "left_anti")
        rest = written(rest)
        if rest.isEmpty():
            return taken.withColumn(score, F.when(F.col(score) > float("-inf"), F.col(score)))


def field_name(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """A field's path in lower case with dots: no places in lists, slashes are dots, dashes underscores; aliases last."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"\[.*?\]", "")
    t = F.trim(F.regexp_replace(F.translate(t, "/-", "._"), r"\.+", "."), F.lit("."))
    if not aliases:
        return t
    return F.coalesce(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))[t], t)


def field_key(c: Column) -> Column:
    """What fields must share to be compared: the first and the last part of their paths."""
    parts = F.split(c, r"\.")
    return F.struct(F.element_at(parts, 1).alias("first"), F.element_at(parts, -1).alias("last"))


def fact_pairs(expected: DataFrame, found: DataFrame, case: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """case, e, f, and both sides' value and op for facts (case, n, field, op, value), each expected one with the first of the same field that is free, in order of n (of ties by op and value, null first).

    Facts of one case and field are ranked on both sides and joined by rank: that is what greed in order gives, as all of a field fit one another."""
    from pyspark.sql import Window

    def ranked(df, s):
        key = field_key(field_name(F.col("field"), aliases))
        w = Window.partitionBy(case, "key").orderBy("n", "op", "value")  # a case's facts of one field
        return df.withColumn("key", key).select(case, "key", F.row_number().over(w).alias("nth"), F.col("n").alias(s), F.col("op").alias(f"{s}_op"), F.col("value").alias(f"{s}_value"))

    return ranked(expected, "e").join(ranked(found, "f"), [case, "key", "nth"], "full_outer").drop("nth")


def plain_value(c: Column) -> Column:
    """A value for comparison: yes and no in either language are 1 and 0, numbers numbers, other text is without signs, in upper case."""
    t = F.lower(F.trim(c))
    number = F.regexp_replace(t, ",", "").try_cast("double").cast("string")
    word = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}_\s]", ""), r"\s+", " "))
    return F.when(t.isin("true", "yes", "हाँ"), "1.0").when(t.isin("false", "no", "नहीं"), "0.0").otherwise(F.coalesce(number, F.upper(word)))


def case_scores(pairs: DataFrame, case: str) -> DataFrame:
    """case, tp, fp, fn, precision, recall, f1, value and operator accuracy of what was matched (0 without any), and whether all is right.

    Nothing found has a precision of 1, nothing expected a recall of 1; a case without anything is right. A missing operator asks for none."""
    both, only_found = F.col("e").isNotNull() & F.col("f").isNotNull(), F.col("e").isNull()
    same_value = plain_value(F.col("e_value")).eqNullSafe(plain_value(F.col("f_value")))
    same_op = F.col("e_op").isNull() | F.upper("e_op").eqNullSafe(F.upper("f_op"))
    sums = pairs.groupBy(case).agg(
        F.count_if(both).alias("tp"), F.count_if(only_found).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"),
        F.count_if(both & same_value).alias("values"), F.count_if(both & same_op).alias("ops"),
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    strict = (F.col("fp") == 0) & (F.col("fn") == 0) & (F.col("values") == F.col("tp")) & (F.col("ops") == F.col("tp"))
    return sums.select(
        case, "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"),
        F.round(ratio(F.col("values"), F.col("tp")), 4).alias("value_accuracy"), F.round(ratio(F.col("ops"), F.col("tp")), 4).alias("op_accuracy"), strict.alias("strict"), "values", "ops",
    )


def totals(scores: DataFrame, by: str) -> DataFrame:
    """by, cases, strict rate, and precision, recall, f1 and accuracies over all facts of its cases."""
    s = scores.groupBy(by).agg(F.count("*").alias("cases"), F.count_if("strict").alias("n_strict"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "values", "ops")))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    return s.select(
        by, "cases", F.round(F.col("n_strict") / F.col("cases"), 4).alias("strict_rate"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"),
        F.round(ratio(F.col("values"), F.col("tp")), 4).alias("value_accuracy"), F.round(ratio(F.col("ops"), F.col("tp")), 4).alias("op_accuracy"),
    )
