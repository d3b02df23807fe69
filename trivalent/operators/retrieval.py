"""Candidate filters, lexical and vector scores, and top-k."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words

K1, B = 1.5, 0.75
DENSE = 0.65


def open_between(start: Column, end: Column, day: Column) -> Column:
    """Closed interval whose missing ends are open."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (day <= end))


def matches_or_unknown(scheme: Column, wanted: Column) -> Column:
    """An unknown wish filters nothing; an unknown attribute of the scheme admits all."""
    return wanted.isNull() | scheme.isNull() | (scheme == wanted)


def listed(df: DataFrame, equal: dict, containing: dict, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of df: rows whose columns equal the given values and contain the given texts (in any case); what is None filters nothing."""
    for name, value in equal.items():
        df = df if value is None else df.where(F.col(name) == F.lit(value))
    for name, part in containing.items():
        df = df if part is None else df.where(F.contains(F.lower(name), F.lit(part.lower())))
    return df.orderBy(*order).offset(offset).limit(limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Clamped to 0 to 1; a zero vector has similarity 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered from 1; the sort must be total. Spark cuts groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


#: Queries and rows of a block at most, how many queries of it are compared at a time, and blocks' pairs at least.
QUERY_BLOCK, ROW_BLOCK, SLICE, LEAST_PAIRS = 4096, 8192, 128, 24


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(m * m, axis=1)[:, -1])


def _units(m: np.ndarray) -> np.ndarray:
    n = _norms(m)[:, None]
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _half_up(q: np.ndarray, m: np.ndarray, digits: int) -> np.ndarray:
    """Cosines of q and each row of m, with sums in the entries' order, rounded as decimals."""
    c = np.clip(np.cumsum(q * m, axis=1)[:, -1] / (_norms(q[None, :]) * _norms(m)), 0.0, 1.0)
    different, place = np.unique(c, return_inverse=True)
    return np.array([float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for x in different])[place]


def _nearest_of_blocks(k: int, digits: int, columns: list[str]):
    """The k nearest rows of a block for each query of another. Products of matrices give all cosines up to rounding errors; those that are
    within these of a rounding's border are taken exactly."""
    scale, error = 10.0**digits, 1e-9

    def nearest(_, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        which, near_rows, values = [], [np.zeros(0, int)], [np.zeros(0)]
        if len(queries) and len(rows):
            q_len, r_len = queries["v"].map(len).to_numpy(), rows["v"].map(len).to_numpy()
            width = max(1, *q_len, *r_len)
            q, m = _matrix(queries["v"], width), _matrix(rows["v"], width)
            q_odd, r_odd = ~np.isfinite(q).all(axis=1), ~np.isfinite(m).all(axis=1)
            q[q_odd], m[r_odd] = 0.0, 0.0
            q_unit, r_unit = _units(q), _units(m).T.copy()
            q_none, r_none, q_ids, ids = queries["none"].to_numpy(bool), rows["none"].to_numpy(bool), queries["query_id"].to_numpy(), rows["id"].to_numpy()
            plain = not (q_odd.any() or r_odd.any() or q_none.any() or r_none.any()) and len({*q_len, *r_len}) == 1
            for start in range(0, len(queries), SLICE):
                part = slice(start, start + SLICE)
                s = np.clip(q_unit[part] @ r_unit, 0.0, 1.0)
                if not plain:
                    s[q_len[part, None] != r_len[None, :]] = 0.0
                    s[q_odd[part, None] | r_odd[None, :]] = 1.0
                    s[q_none[part, None] | r_none[None, :]] = 0.0
                s[q_ids[part, None] == ids[None, :]] = -1.0
                n = min(k, len(rows))
                last = -np.partition(-s, n - 1, axis=1)[:, n - 1]
                least = np.maximum((np.floor((last - error) * scale + 0.5) - 0.5) / scale - error, -0.5)
                for i in range(len(s)):
                    take = np.flatnonzero(s[i] >= least[i])
                    value = s[i, take]
                    near = np.floor((value - error) * scale + 0.5) != np.floor((value + error) * scale + 0.5)
                    value = np.floor(value * scale + 0.5) / scale
                    if near.any():
                        value[near] = _half_up(q[start + i], m[take[near]], digits)
                    best = np.lexsort((ids[take], -value))[:k]
                    which.append(np.full(len(best), start + i))
                    near_rows.append(take[best])
                    values.append(value[best])
        found = rows.drop(columns=["v", "none"]).iloc[np.concatenate(near_rows)]
        asked = queries["query_id"].iloc[np.concatenate([np.zeros(0, int), *which])]
        return found.assign(query_id=asked.to_numpy(), similarity=np.concatenate(values))[columns]

    return nearest


def nearest_by_cosine(queries: DataFrame, rows: DataFrame, id: str, vector: str, k: int, digits: int) -> DataFrame:
    """The k nearest rows (id, vector, and what more they have but vectors) of every query (query_id, vector) but those of the query's own id, with query_id,
    similarity and rank; exact.

    Similarities are cosines rounded to so many digits, ties go to smaller ids. Null vectors and null entries make it 0, as do zero vectors and
    different lengths; what is not finite makes it 1. Queries and rows are dealt to blocks, and a task compares one of each, so that it
    holds no more whatever the tables' sizes: all pairs are compared, but only k rows a query leave a task."""
    none = F.col(vector).isNull() | F.coalesce(F.exists(vector, lambda x: x.isNull()), F.lit(True))
    kept = F.when(none, F.array().cast(rows.schema[vector].dataType)).otherwise(F.col(vector)).alias("v")
    more = [c for c in rows.columns if c not in (id, vector)]
    a = queries.select("query_id", kept, none.alias("none"))
    b = rows.select(F.col(id).alias("id"), *more, kept, none.alias("none"))
    a_n = -(-queries.count() // QUERY_BLOCK) or 1
    b_n = max(-(-rows.count() // ROW_BLOCK), -(-LEAST_PAIRS // a_n))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = a.withColumn("a", F.pmod(F.xxhash64("query_id"), F.lit(a_n)).cast("int")).withColumn("b", blocks(b_n))
    b = b.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(b_n)).cast("int")).withColumn("a", blocks(a_n))
    kinds = {**{f.name: f.dataType for f in rows.schema if f.name in more}, "id": rows.schema[id].dataType, "query_id": queries.schema["query_id"].dataType}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("query_id", "id", *more)] + [T.StructField("similarity", T.DoubleType())])
    dealt = lambda df: df.repartition(2 * a_n * b_n, "a", "b").groupBy("a", "b")  # noqa: E731  (their bytes don't tell the work, by which they would be put together)
    found = dealt(a).cogroup(dealt(b)).applyInPandas(_nearest_of_blocks(k, digits, schema.names), schema)
    return top_k(found, ["query_id"], [F.desc("similarity"), F.col("id")], k).withColumnRenamed("id", id)


def _is(token: str):
    return lambda w: w == F.lit(token)


def bm25_tf(docs: DataFrame, id: str, text: str, queries: list[tuple[int, str]]) -> DataFrame:
    """query_id, id, score: term frequencies saturated and normalised by length, without document frequencies.

    A token that a query repeats counts as often. Queries are few and become literals; tokens are counted where they are read, once
    for all queries, and the counts are kept for the mean length and the scores."""
    asked = list(dict.fromkeys(token for _, s in queries for token in s.lower().split()))
    tokens = docs.select(id, F.explode(F.array(words(F.col(text)))).alias("w"))  # the generator keeps the words from being split again
    counts = tokens.select(id, F.size("w").alias("n"), *(F.size(F.filter("w", _is(token))).cast("double").alias(f"tf{i}") for i, token in enumerate(asked))).checkpoint()
    mean = counts.agg(F.avg("n").alias("mean"))
    scored = counts.crossJoin(F.broadcast(mean))  # one row
    out = []
    for q, s in queries:
        parts = F.lit(0.0)
        for token in s.lower().split():
            tf = F.col(f"tf{asked.index(token)}")
            parts = parts + tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.col("mean")))
        out.append(F.struct(F.lit(q).cast("long").alias("query_id"), parts.alias("score")))
    return scored.select(id, F.explode(F.array(*out)).alias("r")).select("r.query_id", id, "r.score").where("score > 0")


def hybrid(rows: DataFrame, query: str, dense: str, lexical: str) -> DataFrame:
    """rows with score: dense and lexical mixed, the lexical part relative to its best; lexical only where no dense score is positive."""
    best = rows.groupBy(query).agg(F.max(lexical).alias("best"), F.max(dense).alias("any"))
    out = rows.join(best, query)
    relative = F.col(lexical) / F.greatest(F.col("best"), F.lit(1.0))
    return out.withColumn("score", F.when(F.col("any") > 0, DENSE * F.col(dense) + (1 - DENSE) * relative).otherwise(relative)).drop("best", "any")
