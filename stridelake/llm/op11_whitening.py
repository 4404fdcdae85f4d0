"""Embedding whitening: the covariance from squares alone, by polarisation.

An entry c counts as the whole number floor(64 c) + 1000000. For every dimension and every sum of two dimensions the squared
centred values are added exactly; half of the difference of such sums is the exact cross-covariance, since
2 a b = (a + b)^2 - a^2 - b^2. Entries are centred at the whole part of their mean before they are squared, and the driver
corrects for the fraction that is left in exact integers. A task adds up its rows in numpy and emits a row for each pair of
dimensions, in limbs of 40 bits, which Spark adds; the driver gets d (d + 1) / 2 sums, a number that the width of the vectors
sets, whatever the number of rows.

Defined results: a vector that is null, or holds a null, a NaN or an infinity, is dropped; an entry beyond 6e16 counts as 6e16; equal vectors count once
in the fit and each have their rows in the result; a null vec_id stays null; the fit takes vectors of the commonest length (of
equal ones the longest), and vectors of other lengths come back with deviation and whitened null; a component whose eigenvalue is
zero up to rounding has whitened null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm import common

COMPONENTS, SCALE, SHIFT, LARGEST = 16, 64, 1_000_000, 6e16
#: Entries of a slice that numpy works on at once.
SLICE = 1 << 20
#: An eigenvalue below this share of the largest is zero up to rounding.
ZERO = 1e-13
LIMB = 40
SUMS = "i int, j int, low long, mid long, high long"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"


def whole(c: Column) -> Column:
    """An entry as a whole number."""
    bounded = F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.floor(bounded * SCALE) + F.lit(SHIFT).cast("long")


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, an array of longs, of the rows whose vector is whole."""
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = embeddings.where(F.col("embedding").isNotNull() & ~bad)
    return kept.select("vec_id", F.transform("embedding", whole).alias("x"))


def _slices(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    step = max(1, SLICE // d)
    for at in range(0, len(x), step):
        yield x[at : at + step]


def _limbs(total: int) -> tuple[int, int, int]:
    mask = (1 << LIMB) - 1
    return total & mask, total >> LIMB & mask, total >> 2 * LIMB


def _rows(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    columns = zip(*[(i, j, *_limbs(t)) for (i, j), t in totals.items()], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), *[pa.int64()] * 3), strict=True)], ["i", "j", "low", "mid", "high"])


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """x as an array whose sums can't overflow: Python integers where 64 bits don't hold most."""
    return x if most < 1 << 62 else x.astype(object)


def _added(fit: DataFrame, d: int, part) -> dict[tuple[int, int], int]:
    """Sums over all rows of what part(x) gives for a slice: pairs of dimensions and exact sums."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            for x in _slices(batch, d):
                for key, value in part(x):
                    totals[key] = totals.get(key, 0) + int(value)
        if totals:
            yield _rows(totals)

    limbs = fit.mapInArrow(tasks, SUMS).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("low", "mid", "high")])
    return {(r["i"], r["j"]): r["low"] + (r["mid"] << LIMB) + (r["high"] << 2 * LIMB) for r in limbs.collect()}


def means(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def part(x: np.ndarray):
        x = _exact(x, len(x) * int(np.abs(x).max(initial=0)))
        yield (-1, -1), len(x)
        for i in range(d):
            yield (i, i), x[:, i].sum()

    found = _added(fit, d, part)
    return found.pop((-1, -1), 0), [found.get((i, i), 0) for i in range(d)]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance with divisor n: each entry is the exact value, rounded once."""
    d, at = len(sums), [s // n for s in sums]
    left = [s - n * b for s, b in zip(sums, at, strict=True)]

    def part(x: np.ndarray):
        c = x - np.array(at, np.int64)
        c = _exact(c, len(c) * 4 * int(np.abs(c).max(initial=0)) ** 2)
        for i in range(d):
            both = c[:, i:] + c[:, i : i + 1]
            both[:, 0] = c[:, i]  # the pair (i, i) is the dimension itself
            for j, total in enumerate((both * both).sum(0), i):
                yield (i, j), total

    squares = _added(fit, d, part)
    # Centred at S/n and times n, a value is n c - r; the sums of squares of it and of a sum of two of it follow from those of c.
    one = [n * squares[i, i] - left[i] ** 2 for i in range(d)]
    out = np.zeros((d, d))
    for i in range(d):
        out[i, i] = one[i] / n**2
        for j in range(i + 1, d):
            both = n * squares[i, j] - (left[i] + left[j]) ** 2
            out[i, j] = out[j, i] = (both - one[i] - one[j]) / (2 * n**2)
    return out


def components(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (d x k), eigenvalues and shares of the trace of the first components. The largest entry of a component is positive;
    a component without variance has weights NaN."""
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    q = q * np.sign(q[np.abs(q).argmax(0), np.arange(q.shape[1])])
    trace = np.trace(v)
    good = e > ZERO * max(e.max(initial=0), 0)
    weights = np.where(good, q / np.sqrt(np.where(good, e, 1)), np.nan)
    return weights, e, np.maximum(e, 0) / trace if trace > 0 else np.zeros(len(e))


def _projected(x: np.ndarray, n: int, at: np.ndarray, left: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return ((x - at).astype(float) - left.astype(float) / n) @ weights


def _deviations(x: np.ndarray, n: int, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    c = x - at
    most = n * (int(np.abs(c).max(initial=0)) + 1)
    wide = x.shape[1] * most * most >= 1 << 62
    c, left = (c.astype(object), left.astype(object)) if wide else (c, left)
    return ((n * c - left) ** 2).sum(1)


def identity_error(fit: DataFrame, n: int, sums: list[int], weights: np.ndarray) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, from the whitened vectors themselves."""
    at, left = np.array([s // n for s in sums]), np.array([s % n for s in sums])
    good = np.flatnonzero(~np.isnan(weights).any(0))
    k = len(good)
    if not k:
        return 0.0

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            for x in _slices(batch, len(sums)):
                w = _projected(x, n, at, left, weights[:, good])
                total += np.hstack([w.T @ w, w.sum(0)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(total.ravel()), pa.array(np.arange(total.size, dtype=np.int64))], ["total", "place"])

    summed = fit.mapInArrow(tasks, "total double, place long").groupBy("place").agg(F.sum("total").alias("total")).collect()
    total = np.array([r["total"] for r in sorted(summed, key=lambda r: r["place"])]).reshape(k, k + 1) / n
    return float(np.abs(total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k)).max())


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """A row for each whole vector and component: its whitened value and the exact squared distance to the mean, times n squared.

    deviation is null where a long can't hold it; deviation_digits then has its digits, and is null elsewhere.
    """
    rows = vectors(embeddings)
    spark = embeddings.sparkSession
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    if not d:
        return rows.select("vec_id").limit(0).select("vec_id", *[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in RESULT.split(", ")[1:]])
    fit = common.written(rows.where(F.size("x") == d).select("x").distinct(), "fit-list")
    n, sums = means(fit, d)
    weights, _, shares = components(covariance(fit, n, sums), k)
    error = identity_error(fit, n, sums, weights)
    at, left, k = np.array([s // n for s in sums]), np.array([s % n for s in sums]), weights.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, start = batch.column("vec_id"), 0
            for x in _slices(batch, d):
                w, far = _projected(x, n, at, left, weights), _deviations(x, n, at, left)
                fits = [int(v) if v < 1 << 63 else None for v in far] if far.dtype == object else far
                digits = [None if v < 1 << 63 else str(v) for v in far] if far.dtype == object else [None] * len(x)
                each = np.repeat(np.arange(len(x)), k)
                columns = [
                    ids.slice(start, len(x)).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n)),
                    pa.array(fits, pa.int64()).take(pa.array(each)),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    pa.array(np.tile(shares, len(x))),
                    pa.array(np.full(len(each), error)),
                    pa.array(digits, pa.string()).take(pa.array(each)),
                ]
                start += len(x)
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    rows = rows.withColumn("vec_id", F.col("vec_id").cast("long"))
    out = rows.where(F.size("x") == d).mapInArrow(project, RESULT)
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("component"))
    other = rows.where(F.size("x") != d).select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("component"))
    other = other.select("vec_id", "component", F.lit(n).cast("long").alias("n"), F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("double").alias("whitened"), share.alias("explained"), F.lit(error).alias("identity_error"), F.lit(None).cast("string").alias("deviation_digits"))
    return out.unionByName(other)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every embedding."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
