"""Whitening of embeddings from an exact scatter matrix.

Vectors become integers. Their scatter is formed without any rounding: a shift is subtracted, differences are cut into limbs of 20 bits,
whose products over a block are exact in double precision, and the sums are carried on in words of 32 bits that Spark adds up as longs.
n XᵀX - SSᵀ is formed from these in integers of any size, and only then becomes a float, to be decomposed. Only sums pass from task to
task: a number of rows that is set by the vectors' length, however many vectors there are. Vectors of each length are a space of their own."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, schema_of, table

SCALE = 256
COMPONENTS = 4
#: The largest long that is a double: scaled entries beyond it, of either sign, count as this.
MOST = (1 << 63) - 1024
LIMB, WORD, WORDS, BLOCK = 20, 32, 6, 4096
_WORDS = [f"w{k}" for k in range(WORDS)]


def whole(vector: Column, scale: int = SCALE) -> Column:
    """Each entry times the scale, rounded down to a long."""
    entry = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST))))
    return F.transform(vector, lambda c: entry(c) + F.lit(0).cast("long"))


def usable(vector: Column) -> Column:
    """Vectors that aren't null, nor hold null or what is no finite number."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _less(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """x - shift, as longs where these hold it."""
    large = max(map(abs, [*shift, int(x.min(initial=0)), int(x.max(initial=0))])) >= 1 << 62
    return x.astype(object) - np.array(shift, object) if large else x - np.array(shift, np.int64)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Floats l with x = sum of l[k] 2^(20 k); the last one is signed."""
    out = []
    while x.min(initial=0) < -(1 << LIMB) or x.max(initial=0) > 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def scatter(x: np.ndarray) -> np.ndarray:
    """xᵀx for integers, as integers of any size."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), BLOCK):
        limbs = _limbs(x[at : at + BLOCK])  # products under 2^40, sums of 2^12 of them under 2^53
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def _words(n: int) -> list[int]:
    return [*(n >> WORD * k & (1 << WORD) - 1 for k in range(WORDS - 1)), n >> WORD * (WORDS - 1)]


def sums(vectors: DataFrame, shifts: dict[int, list[int]]) -> DataFrame:
    """d, i, j and words: sums over vectors (x) of length d less their length's shift. i = j = -1 counts them, j = -1 is the sum of
    entry i, others are the products of entries i <= j."""
    names = ["d", "i", "j", *_WORDS]

    def run(batches):
        held = {}
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                x = _less(_matrix(column.take(pa.array(np.flatnonzero(sizes == d))), d), shifts[d])
                n, s, m = held.get(d, (0, 0, 0))
                held[d] = n + len(x), s + x.astype(object).sum(0), m + scatter(x)
        for d, (n, s, m) in held.items():
            rows = [(-1, -1, n), *((i, -1, v) for i, v in enumerate(s)), *((i, j, m[i, j]) for i in range(d) for j in range(i, d))]
            words = np.array([_words(int(v)) for _, _, v in rows], np.int64)
            ij = np.array([r[:2] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d)), *map(pa.array, ij.T), *map(pa.array, words.T)], names=names)

    each = vectors.select("x").mapInArrow(run, schema_of(", ".join(f"{c} long" for c in names)))
    return each.groupBy("d", "i", "j").agg(*(F.sum(w).alias(w) for w in _WORDS))


@dataclass
class Model:
    """Of vectors of one length: n of them, less shift; their sums; eigenvalues and unit eigenvectors by falling eigenvalue."""

    n: int
    shift: list[int]
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x less the sums, as integers."""
        x = _less(x, self.shift)
        small = x.dtype != object and max(int(np.abs(x).max(initial=0)), 1) * self.n + max(map(abs, self.sums)) < 1 << 62
        return x * self.n - np.array(self.sums, np.int64) if small else x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        mean_free = centred.astype(np.float64) / self.n if centred.dtype != object else np.array([[v / self.n for v in row] for row in centred], np.float64).reshape(centred.shape)
        return mean_free @ self.vectors / np.sqrt(self.values)


def covariance(n: int, s: list[int], m: np.ndarray) -> np.ndarray:
    """m / n - s sᵀ / n², each entry rounded once."""
    s = np.array(s, object)
    exact, square = n * m - np.outer(s, s), n * n
    return np.array([[v / square for v in row] for row in exact], np.float64).reshape(m.shape)


def decomposed(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their unit eigenvectors; those that are nought but for rounding are left out."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > max(values[0], 0.0) * len(v) * np.finfo(float).eps).sum()))
    return values[:kept], vectors[:, :kept]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each length for different integer vectors (x). A length's matrix is decomposed in one task, of a size set by the
    length; the driver gets what is a multiple of the length."""
    first = vectors.groupBy(F.size("x").alias("d")).agg(F.min("x").alias("shift")).where("d > 0").collect()
    shifts = {r.d: r.shift for r in first}

    def decompose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d = int(key[0])
        n, s, m = 0, [0] * d, np.zeros((d, d), object)
        for i, j, *words in rows[["i", "j", *_WORDS]].itertuples(index=False):
            v = sum(int(w) << WORD * k for k, w in enumerate(words))
            if i < 0:
                n = v
            elif j < 0:
                s[i] = v
            else:
                m[i, j] = m[j, i] = v
        cov = covariance(n, s, m)
        values, basis = decomposed(cov, components)
        return pd.DataFrame({"d": [d], "n": [n], "sums": [json.dumps(s)], "eigenvalues": [values.tolist()], "basis": [basis.ravel().tolist()], "trace": [float(np.trace(cov))]})

    ddl = "d long, n long, sums string, eigenvalues array<double>, basis array<double>, trace double"
    rows = sums(vectors.where(F.size("x") > 0), shifts).groupBy("d").applyInPandas(decompose, ddl).collect()
    models = {r.d: Model(r.n, shifts[r.d], json.loads(r.sums), np.array(r.eigenvalues), np.array(r.basis).reshape(r.d, len(r.eigenvalues)), r.trace) for r in rows}
    for d, error in _identity_errors(vectors, models).items():
        models[d].identity_error = error
    return models


def _by_length(column, models):
    """For each length: its model, the places of its vectors, and these."""
    sizes = np.diff(column.offsets.to_numpy())
    for d in np.unique(sizes).tolist():
        if d in models and len(models[d].values):
            at = np.flatnonzero(sizes == d)
            yield models[d], at, _matrix(column.take(pa.array(at)), d)


def _identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """The largest entry of the whitened vectors' covariance less the identity, measured on the vectors themselves."""
    held = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        total = {}
        for batch in batches:
            for m, _, x in _by_length(batch.column(0), held.value):
                z = m.whitened(m.centred(x))  # centred by an exact mean
                total[x.shape[1]] = total.get(x.shape[1], 0) + z.T @ z
        for d, t in total.items():
            i, j = np.indices(t.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size, d)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(t.ravel())], names=["d", "i", "j", "v"])

    rows = vectors.select("x").mapInArrow(run, "d long, i long, j long, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect()
    errors = {}
    for r in rows:  # as many as components squared, a length
        errors[r.d] = max(errors.get(r.d, 0.0), abs(r.v / models[r.d].n - (r.i == r.j)))
    return errors


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error for vectors (vec_id, embedding).

    Null vectors and those that hold null, NaN or infinite entries take no part, nor do empty ones. The fit takes each different integer
    vector once, so that copies, however many, weigh as one; every row is whitened, repeated ones and those with null ids too. Vectors of
    another length are fitted among their own. There are no rows for components without variance (all vectors alike, or fewer
    than components), nor for an empty table. Deviations beyond 38 digits are null. Extra columns are left out."""
    rows = vectors.where(usable(F.col("embedding"))).select("vec_id", whole(F.col("embedding"), scale).alias("x"))
    models = fit(checkpointed(rows.select("x").distinct()), components)
    held = vectors.sparkSession.sparkContext.broadcast(models)
    decimal = pa.decimal128(38, 0)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for batch in batches:
            for m, at, x in _by_length(batch.column(1), held.value):
                k, centred = len(m.values), m.centred(x)
                largest = float(np.abs(centred).max(initial=0))
                if centred.dtype != object and largest**2 * x.shape[1] < 1 << 62:
                    deviation = pa.array((centred**2).sum(1)).cast(decimal)
                else:
                    exact = (centred.astype(object) ** 2).sum(1)
                    deviation = pa.array([str(v) if v < 10**38 else None for v in exact], pa.string()).cast(decimal)
                order = np.repeat(np.arange(len(x)), k)
                columns = [
                    batch.column(0).take(pa.array(at)).take(pa.array(order)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(order), m.n)),
                    deviation.take(pa.array(order)),
                    pa.array(m.whitened(centred).ravel()),
                    pa.array(np.tile(m.values / m.trace, len(x))),
                    pa.array(np.full(len(order), m.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema_of("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four largest components of every embedding; a deviation that no long holds is null."""
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding")).withColumn("deviation", F.col("deviation").try_cast("long"))
