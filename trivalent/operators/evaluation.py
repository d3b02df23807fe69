"""Evaluation of rankings, verdicts, missing fields and extracted facts against gold answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def ranking_at(ranked: DataFrame, query: str, rank: str, gain: str, ideal: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """query, reciprocal rank, and for each k recall, precision (divided by k) and nDCG.

    ranked needs the rows up to the largest k only; ideal has query, relevant (how many) and gains (the largest gains, in falling order)."""
    hit = F.col(gain) > 0
    worth = F.col(gain) / F.log2(F.col(rank) + 1)
    parts = [F.min(F.when(hit, F.col(rank))).alias("first")]
    for k in ks:
        near = F.col(rank) <= k
        parts += [F.count_if(hit & near).alias(f"hits_{k}"), F.sum(F.when(near, worth).otherwise(0.0)).alias(f"dcg_{k}")]
    out = ideal.join(ranked.groupBy(query).agg(*parts), query, "left")
    columns = [F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        best = F.aggregate(F.transform(F.slice("gains", 1, k), lambda g, i: g / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
        hits = F.coalesce(f"hits_{k}", F.lit(0))
        columns += [ratio(hits, F.col("relevant"), 1.0).alias(f"recall_{k}"), (hits / k).alias(f"precision_{k}"), ratio(F.coalesce(f"dcg_{k}", F.lit(0.0)), best).alias(f"ndcg_{k}")]
    return out.select(query, *columns)


def largest_gains(judged: DataFrame, query: str, gain: str, most: int = 10, n: Column | None = None) -> DataFrame:
    """query, relevant, gains: how many judgments have a gain, and the `most` largest. Gains are few different numbers, so they are
    counted, and no query's judgments are gathered. A row of judged stands for n judgments; a query has a row without any judgment of a gain, if all its n are 0."""
    counts = judged.groupBy(query, gain).agg(F.sum(F.lit(1) if n is None else n).alias("n"))
    real = (F.col(gain) > 0) & (F.col("n") > 0)
    lists = F.sort_array(F.collect_list(F.when(real, F.struct(F.col(gain).alias("g"), "n"))), asc=False)
    some = counts.groupBy(query).agg(F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("relevant"), lists.alias("l"))
    gains = F.flatten(F.transform("l", lambda x: F.array_repeat(x.g, F.least(x.n, F.lit(most)).cast("int"))))
    return some.select(query, "relevant", F.slice(gains, 1, most).alias("gains"))


def label_gains(rows: DataFrame, queries: DataFrame, id: str, label: str, gain: Column) -> DataFrame:
    """query_id, gain, n: how many of the rows but those of its own id have which gain for each query (query_id, wanted), where gain holds for
    rows of the wanted label and those where either is unknown, and others have 0. Counted by label: no pairs are made."""
    counted = lambda df, *by: df.groupBy(*by, gain.alias("gain")).agg(F.count("*").alias("n"))
    every, one = counted(rows), F.col("wanted")
    by_label = counted(rows.where(F.col(label).isNotNull()), F.col(label).alias("wanted"))
    unknown = counted(rows.where(F.col(label).isNull()))
    known = queries.where(one.isNotNull())
    alike = known.join(by_label, "wanted").select("query_id", "gain", "n").unionByName(known.crossJoin(F.broadcast(unknown)).select("query_id", "gain", "n"))
    alike = alike.unionByName(queries.where(one.isNull()).crossJoin(F.broadcast(every)).select("query_id", "gain", "n"))
    own = queries.join(rows, F.col("query_id") == F.col(id))
    fits = one.isNull() | F.col(label).isNull() | (one == F.col(label))
    alike = alike.unionByName(own.where(fits).select("query_id", gain.alias("gain"), F.lit(-1).cast("long").alias("n")))
    total = rows.agg(F.count("*").alias("total"))
    alone = own.groupBy("query_id").agg(F.count("*").alias("own")).crossJoin(F.broadcast(total)).where("own = total")  # nothing to judge
    none = queries.select("query_id", F.lit(0).alias("gain"), F.lit(0).cast("long").alias("n"))
    return alike.unionByName(none).join(alone, "query_id", "left_anti")


def confusion(df: DataFrame, expected: str, predicted: str, classes: list[str]) -> DataFrame:
    """class, predicted as each class, precision, recall and f1 (0 of 0 is 0), for every class; from a single aggregation."""
    cells = df.groupBy(expected, predicted).agg(F.count("*").alias("n"))
    of = lambda e, p: F.coalesce(F.sum(F.when(e & p, F.col("n"))), F.lit(0))
    is_class = lambda column, c: F.col(column) == c
    rows = []
    for c in classes:
        tp, found, there = of(is_class(expected, c), is_class(predicted, c)), of(F.lit(True), is_class(predicted, c)), of(is_class(expected, c), F.lit(True))
        p, r = ratio(tp, found), ratio(tp, there)
        rows.append(F.struct(F.lit(c).alias("class"), *(of(is_class(expected, c), is_class(predicted, x)).alias(x.lower()) for x in classes), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1")))
    return cells.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def set_scores(expected: Column, found: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and f1 of a set of names: nothing expected and nothing found is perfect, nothing found of some has
    no precision, and something found where nothing is expected has lost nothing."""
    both, e, f = F.size(F.array_intersect(expected, found)), F.size(F.array_distinct(expected)), F.size(F.array_distinct(found))
    nothing = (e == 0) & (f == 0)
    p, r = F.when(nothing, 1.0).otherwise(ratio(both, f)), ratio(both, e, 1.0)
    return p, r, ratio(2 * p * r, p + r)


def fact_matches(expected: DataFrame, found: DataFrame, keys: list[str], field: str, value: str, operator: str, aliases: dict[str, str]) -> DataFrame:
    """keys, field, outcome for expected and found facts: MATCH, WRONG_VALUE, WRONG_OPERATOR, MISSING or EXTRA.

    Fields are compared by their canonical name (aliases), values as numbers or trimmed text; a case has a field once."""
    names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))

    def plain(df, prefix):
        name = F.lower(F.trim(field))
        number = F.regexp_replace(F.col(value), ",", "").try_cast("double").cast("string")
        return df.select(*keys, F.coalesce(names[name], name).alias("field"), F.coalesce(number, F.lower(F.trim(value))).alias(f"{prefix}_value"), F.upper(operator).alias(f"{prefix}_operator"), F.lit(True).alias(prefix))

    both = plain(expected, "e").join(plain(found, "f"), [*keys, "field"], "full_outer")
    outcome = (
        F.when(F.col("f").isNull(), "MISSING").when(F.col("e").isNull(), "EXTRA").when(~F.col("e_operator").eqNullSafe(F.col("f_operator")), "WRONG_OPERATOR")
        .when(~F.col("e_value").eqNullSafe(F.col("f_value")), "WRONG_VALUE").otherwise("MATCH")
    )
    return both.select(*keys, "field", outcome.alias("outcome"))


def attributed(cases: DataFrame, causes: list[tuple[str, Column]], fallback: str = "NONE") -> DataFrame:
    """cases with cause: the first that holds."""
    out = F.lit(fallback)
    for name, holds in reversed(causes):
        out = F.when(holds, name).otherwise(out)
    return cases.withColumn("cause", out)
