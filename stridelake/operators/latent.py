"""The joint model of item quality from ratings and pair judgments, fitted without gathering its parameters.

An item's quality is its source's baseline plus its own effect. A rating from 1 to 7 is a cumulative logit whose thresholds a
session shifts and stretches and whose noise is the rater's; a pair judgment has one of four outcomes. The mode is found by
scoring steps, and by Newton steps once they are short: each cell of equal judgments gives a 4 x 4 matrix in its quality (or difference of
qualities), threshold shift, threshold scale and noise, and the sum over cells is one sparse matrix, a table of (a, b, h). Steps and
the variances of the qualities are solved by conjugate gradients whose products are joins with that table. Parameters, like judgments, stay
in tables; the driver holds two numbers for each right-hand side. Only a system of at most DIRECT parameters is solved on the driver,
where it fits whole: it is the same system, and a small one costs more in jobs than in arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.sources import scratch

#: Thresholds between the ratings, outcomes of a pair, weights of the squared parameters by kind, first values.
THRESHOLDS = np.array([-1.5, -1.0, -0.5, 0.0, 0.5, 1.0])
OUTCOMES = ("first_better", "second_better", "effectively_equal", "not_sure")
PENALTY = {"source": 0.08, "item": 0.12, "offset": 0.1, "scale": 0.1, "noise": 0.15, "tie": 0.03, "unsure": 0.03}
START = {"tie": -0.6, "unsure": -1.0}
LEAST_RATINGS, LEAST_ITEMS = 8, 3
LARGEST_LOG, FLOOR = 3.0, 1e-12
#: After steps shorter than this the exact second derivatives take the place of the information, which is positive everywhere.
SHORT = 0.5
#: Right-hand sides of random signs from which the variances come.
PROBES = 64
#: Parameters of a system that the driver solves (8 bytes for each pair of them).
DIRECT = 2_000


def rating_terms(z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, slope, information and negative second derivatives of ratings n (cells x 7) in z = (quality, offset,
    log scale, log noise)."""
    q, offset, scale, sigma = z[:, 0, None], z[:, 1, None], np.exp(z[:, 2, None]), np.exp(z[:, 3, None])
    y = (offset + scale * THRESHOLDS - q) / sigma
    below = 0.5 * (1 + np.tanh(y / 2))
    edge = np.zeros((len(z), 1))
    p = np.maximum(np.diff(np.hstack([edge, below, edge + 1]), axis=1), FLOOR)
    density, each = below * (1 - below), np.broadcast_to(1 / sigma, y.shape)
    slopes = np.stack([-each, each, scale * THRESHOLDS * each, -y], 2)
    second = np.zeros((*y.shape, 4, 4))
    second[..., 2, 2], second[..., 3, 3] = slopes[..., 2], y
    for d in range(3):
        second[..., d, 3] = second[..., 3, d] = -slopes[..., d]
    second = density[..., None, None] * ((1 - 2 * below)[..., None, None] * slopes[..., :, None] * slopes[..., None, :] + second)
    between = lambda x: np.diff(np.concatenate([np.zeros_like(x[:, :1]), x, np.zeros_like(x[:, :1])], 1), axis=1)
    dp, ddp, share = between(density[..., None] * slopes), between(second), n / p
    bend = np.einsum("kc,kcd,kce->kde", share / p, dp, dp) - np.einsum("kc,kcde->kde", share, ddp)
    return (n * np.log(p)).sum(1), np.einsum("kc,kcd->kd", share, dp), np.einsum("k,kcd,kce->kde", n.sum(1), dp / p[:, :, None], dp), bend


def pair_terms(z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of outcomes n (cells x 4) in z = (difference of qualities, log noise, tie, unsure)."""
    inverse = np.exp(-z[:, 1])
    half = 0.5 * z[:, 0] * inverse
    logits = np.stack([half, -half, z[:, 2], z[:, 3]], 1)
    logits -= logits.max(1, keepdims=True)
    logp = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    p, total = np.exp(logp), n.sum(1)
    jac = np.zeros((len(z), 4, 4))
    jac[:, 0, 0], jac[:, 1, 0] = 0.5 * inverse, -0.5 * inverse
    jac[:, 0, 1], jac[:, 1, 1] = -half, half
    jac[:, 2, 2] = jac[:, 3, 3] = 1
    mean = np.einsum("kc,kcd->kd", p, jac)
    info = total[:, None, None] * (np.einsum("kc,kcd,kce->kde", p, jac, jac) - mean[:, :, None] * mean[:, None])
    rest = n - total[:, None] * p
    bend, pull = info.copy(), rest[:, 0] - rest[:, 1]
    bend[:, 0, 1] += pull * 0.5 * inverse
    bend[:, 1, 0] += pull * 0.5 * inverse
    bend[:, 1, 1] -= pull * half
    return (n * logp).sum(1), np.einsum("kc,kcd->kd", rest, jac), info, bend


def _part(kind: str, dim: int, sign: int, *names: str):
    key = F.concat_ws(":", F.lit(kind), *names) if names else F.lit(kind)
    return F.struct(key.alias("param"), F.lit(kind).alias("kind"), F.lit(dim).alias("dim"), F.lit(float(sign)).alias("sign"))


def cells(ratings: DataFrame, pairs: DataFrame, items: DataFrame) -> DataFrame:
    """kind, counts and parts of all cells: a part says which parameter adds to which of the cell's four values, with which sign."""
    own = items.where("item IS NOT NULL AND source IS NOT NULL").groupBy(F.col("item").cast("string").alias("item")).agg(F.min(F.col("source").cast("string")).alias("source"))
    text = [F.col(c).cast("string").alias(c) for c in ("session", "rater")]
    rated = ratings.where("rating BETWEEN 1 AND 7 AND session IS NOT NULL AND rater IS NOT NULL").select(F.col("item").cast("string").alias("item"), *text, "rating").join(own, "item")
    counts = F.array(*[F.count_if(F.col("rating") == k) for k in range(1, 8)])
    single = rated.groupBy("item", "source", "session", "rater").agg(counts.alias("counts"))
    parts = F.array(_part("source", 0, 1, "source"), _part("item", 0, 1, "item"), _part("offset", 1, 1, "session"), _part("scale", 2, 1, "session"), _part("noise", 3, 1, "rater"))
    single = single.select(F.lit("rating").alias("kind"), "counts", parts.alias("parts"))
    known = pairs.where(F.col("outcome").isin(*OUTCOMES) & F.col("rater").isNotNull()).select(*[F.col(c).cast("string").alias(c) for c in ("first", "second", "rater")], "outcome")
    for c in ("first", "second"):
        known = known.join(own.select(F.col("item").alias(c), F.col("source").alias(f"{c}_source")), c)
    counts = F.array(*[F.count_if(F.col("outcome") == o) for o in OUTCOMES])
    double = known.groupBy("first", "second", "first_source", "second_source", "rater").agg(counts.alias("counts"))
    sides = [_part(kind, 0, sign, column) for side, sign in (("first", 1), ("second", -1)) for kind, column in (("source", f"{side}_source"), ("item", side))]
    double = double.select(F.lit("pair").alias("kind"), "counts", F.array(*sides, _part("noise", 1, 1, "rater"), _part("tie", 2, 1), _part("unsure", 3, 1)).alias("parts"))
    return single.unionByName(double).withColumn("cell", F.monotonically_increasing_id())


def _linear(rows: DataFrame) -> DataFrame:
    """Log likelihood, slope, information and negative second derivatives of cells (kind, counts, parts, z)."""
    numbers = pa.list_(pa.float64())

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            rated = np.array(batch.column("kind").to_pylist(), object) == "rating"
            counts = batch.column("counts").to_pylist()
            ll, slope, info, bend = np.zeros(len(z)), np.zeros((len(z), 4)), np.zeros((len(z), 4, 4)), np.zeros((len(z), 4, 4))
            for which, terms in ((rated, rating_terms), (~rated, pair_terms)):
                at = np.flatnonzero(which)
                if len(at):
                    ll[at], slope[at], info[at], bend[at] = terms(z[at], np.array([counts[k] for k in at], float))
            yield pa.RecordBatch.from_arrays([batch.column("parts"), pa.array(ll), pa.array(list(slope), numbers), *[pa.array(list(x.reshape(-1, 16)), numbers) for x in (info, bend)]], ["parts", "ll", "slope", "info", "bend"])

    parts = rows.schema["parts"].dataType.simpleString()
    return rows.select("kind", "counts", "parts", "z").mapInArrow(tasks, f"parts {parts}, ll double, slope array<double>, info array<double>, bend array<double>")


def _weighted(kind) -> object:
    out = F.lit(0.0)
    for k, w in PENALTY.items():
        out = F.when(kind == k, w).otherwise(out)
    return out


def _conjugate(matrix: DataFrame, start: DataFrame, sides: int, tolerance: float, most: int = 80) -> DataFrame:
    """x (param, k, x) of matrix x = rhs for the right-hand sides k of start (param, diag, k, rhs); one job for a product.

    Both inner products of a step come from one pass (the single-reduction form of the method), so a step is one written table.
    """

    def multiplied(now: DataFrame) -> DataFrame:
        product = matrix.join(now.select(F.col("param").alias("b"), "k", "u"), "b").groupBy(F.col("a").alias("param"), "k").agg(F.sum(F.col("h") * F.col("u")).alias("w"))
        return scratch.stored(now.join(product, ["param", "k"]), "gradients")

    zero = F.lit(0.0)
    now = multiplied(start.select("param", "diag", "k", zero.alias("x"), F.col("rhs").alias("r"), zero.alias("p"), zero.alias("s"), (F.col("rhs") / F.col("diag")).alias("u")))
    first, before, alpha = None, np.zeros(sides), np.zeros(sides)
    for _ in range(most):
        gamma, delta = np.zeros(sides), np.zeros(sides)
        for k, g, d in now.groupBy("k").agg(F.sum(F.col("r") * F.col("u")), F.sum(F.col("w") * F.col("u"))).collect():
            gamma[k], delta[k] = g, d
        first = gamma if first is None else first
        going = gamma > tolerance**2 * first
        if not going.any():
            break
        beta = np.where(before > 0, gamma / np.where(before > 0, before, 1), 0.0)
        below = delta - beta * gamma / np.where(alpha > 0, alpha, 1) * (alpha > 0)
        alpha, before = np.where(going, gamma / np.where(below > 0, below, 1), 0.0), gamma
        a, b = (F.element_at(F.array(*[F.lit(float(v)) for v in x]), F.col("k") + 1) for x in (alpha, beta))
        p, s = F.col("u") + b * F.col("p"), F.col("w") + b * F.col("s")
        step = now.select("param", "diag", "k", (F.col("x") + a * p).alias("x"), (F.col("r") - a * s).alias("r"), p.alias("p"), s.alias("s"))
        now = multiplied(step.withColumn("u", F.col("r") / F.col("diag")))
    return now.select("param", "k", "x")


def _dense(matrix: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """The numbers of the parameters and the matrix as an array."""
    rows = matrix.collect()
    at = {name: k for k, name in enumerate(sorted({r["a"] for r in rows}))}
    out = np.zeros((len(at), len(at)))
    for r in rows:
        out[at[r["a"]], at[r["b"]]] = r["h"]
    return at, out


class Fit:
    """params (param, kind, theta, sd of an item's quality through its cells): the mode. matrix (a, b, h): the second derivatives there."""

    def __init__(self, ratings: DataFrame, pairs: DataFrame, items: DataFrame, steps: int = 40, tolerance: float = 1e-3, direct: int = DIRECT):
        self.cells = scratch.stored(cells(ratings, pairs, items), "cells")
        parts = self.cells.select("cell", F.explode("parts").alias("p")).select("cell", "p.*")
        self.parts = scratch.stored(parts, "parts")
        kinds = self.parts.where("kind = 'item'").agg(F.count_distinct("param")).first()[0]
        rated = self.cells.where("kind = 'rating'").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
        first = F.when(F.col("kind") == "tie", START["tie"]).when(F.col("kind") == "unsure", START["unsure"]).otherwise(0.0)
        self.params = scratch.stored(self.parts.select("param", "kind").distinct().withColumn("theta", first), "params")
        self.small = self.params.count() <= direct
        self.converged, self.enough = False, rated >= LEAST_RATINGS and kinds >= LEAST_ITEMS
        self.status, self.short = "insufficient_human_observations", False
        if not self.enough:
            return
        value, grad = self._linearised()
        for _ in range(steps):
            step = scratch.stored(self.params.join(self._step(grad), "param"), "step")
            size = step.agg(F.max(F.abs("x"))).first()[0]
            share, before, was_short = min(1.0, 2.0 / max(size, 1e-12)), value, self.short
            self.short = size < SHORT
            while True:
                log = F.col("kind").isin("scale", "noise")
                moved = F.col("theta") + share * F.col("x")
                moved = F.when(log, F.greatest(F.lit(-LARGEST_LOG), F.least(F.lit(LARGEST_LOG), moved))).otherwise(moved)
                self.params = scratch.stored(step.select("param", "kind", moved.alias("theta")), "params")
                value, grad = self._linearised()
                if value <= before + 1e-9 * (1 + abs(before)) or share < 1e-3:
                    break
                share, self.short = share / 2, False
            if size * share < tolerance and was_short:
                self.converged = True
                break
        self.value, self.status = value, "fit" if self.converged else "fit_with_optimizer_warning"

    def _linearised(self) -> tuple[float, DataFrame]:
        """The negative log posterior at params, and its negative gradient (param, diag, grad); sets matrix."""
        at = self.parts.join(self.params.select("param", "theta"), "param").groupBy("cell")
        z = at.agg(F.array(*[F.sum(F.when(F.col("dim") == d, F.col("sign") * F.col("theta")).otherwise(0.0)) for d in range(4)]).alias("z"))
        lin = scratch.stored(_linear(self.cells.join(z, "cell")), "linear")
        weight = _weighted(F.col("kind"))
        value = self.params.agg(F.sum(weight * F.col("theta") ** 2)).first()[0] - lin.agg(F.sum("ll")).first()[0]
        which = "bend" if self.short else "info"
        sides = lin.select(which, "parts", F.explode("parts").alias("a")).select(which, "a", F.explode("parts").alias("b"))
        entry = F.col("a.sign") * F.col("b.sign") * F.element_at(which, 4 * F.col("a.dim") + F.col("b.dim") + 1)
        entries = sides.select(F.col("a.param").alias("a"), F.col("b.param").alias("b"), entry.alias("h"))
        own = self.params.select(F.col("param").alias("a"), F.col("param").alias("b"), (2 * weight).alias("h"))
        self.matrix = scratch.stored(entries.unionByName(own).groupBy("a", "b").agg(F.sum("h").alias("h")), "matrix")
        slopes = lin.select("slope", F.explode("parts").alias("a")).groupBy(F.col("a.param").alias("param")).agg(F.sum(F.col("a.sign") * F.element_at("slope", F.col("a.dim") + 1)).alias("slope"))
        diag = self.matrix.where("a = b").select(F.col("a").alias("param"), F.col("h").alias("diag"))
        grad = self.params.join(slopes, "param").join(diag, "param").select("param", "diag", (F.col("slope") - 2 * weight * F.col("theta")).alias("grad"))
        return value, scratch.stored(grad, "grad")

    def _step(self, grad: DataFrame) -> DataFrame:
        """param and x, the step of the mode."""
        if not self.small:
            return _conjugate(self.matrix, grad.withColumn("k", F.lit(0)).withColumnRenamed("grad", "rhs"), 1, 0.03).drop("k")
        at, matrix = _dense(self.matrix)
        rhs = np.zeros(len(at))
        for r in grad.select("param", "grad").collect():
            rhs[at[r["param"]]] = r["grad"]
        x = np.linalg.solve(matrix, rhs)
        return grad.sparkSession.createDataFrame([(name, float(x[k])) for name, k in at.items()], "param string, x double")

    def variances(self, probes: int = PROBES) -> DataFrame:
        """item, source (as parameters) and the variance of source baseline plus item effect, from the inverse of the matrix.

        The driver inverts a small matrix. Else a probe z of random signs gives (w z)(w H^-1 z), whose mean is w H^-1 w; only the part that the diagonal alone does not
        give is left to the probes. No estimate is below what the item's or the source's own information allows.
        """
        if self.small:
            at, matrix = _dense(self.matrix)
            inverse = np.linalg.inv(matrix)
            own = [(r["item"], r["source"], at[r["item"]], at[r["source"]]) for r in self.owners().collect()]
            return self.matrix.sparkSession.createDataFrame([(i, s, float(inverse[a, a] + inverse[b, b] + 2 * inverse[a, b])) for i, s, a, b in own], "item string, source string, variance double")
        diag = self.matrix.where("a = b").select(F.col("a").alias("param"), F.col("h").alias("diag"))
        sign = 2 * F.xxhash64("param", "k").bitwiseAND(F.lit(1)).cast("double") - 1
        start = scratch.stored(diag.withColumn("k", F.explode(F.array(*map(F.lit, range(probes))))).withColumn("rhs", sign), "probes")
        found = scratch.stored(_conjugate(self.matrix, start, probes, 0.01).join(start, ["param", "k"]).select("param", "k", "x", "rhs", "diag"), "inverse")
        owners = self.owners()
        side = lambda name: found.select(F.col("param").alias(name), "k", *[F.col(c).alias(f"{name}_{c}") for c in ("x", "rhs", "diag")])
        both = owners.join(side("item"), "item").join(side("source"), ["source", "k"])
        z = F.col("item_rhs") + F.col("source_rhs")
        more = z * (F.col("item_x") + F.col("source_x") - F.col("item_rhs") / F.col("item_diag") - F.col("source_rhs") / F.col("source_diag"))
        own = [1 / F.first("item_diag"), 1 / F.first("source_diag")]
        return both.groupBy("item", "source").agg(F.greatest(own[0] + own[1] + F.avg(more), *own).alias("variance"))

    def owners(self) -> DataFrame:
        """item and source as parameters."""
        parts = self.cells.select(F.col("parts").alias("p"), "kind")
        pick = lambda at: F.struct(F.element_at("p", at + 1)["param"].alias("item"), F.element_at("p", at)["param"].alias("source"))
        return parts.select(F.explode(F.when(F.col("kind") == "rating", F.array(pick(1))).otherwise(F.array(pick(1), pick(3)))).alias("o")).select("o.*").distinct()


def latent_quality(ratings: DataFrame, pairs: DataFrame, items: DataFrame, probes: int = PROBES, direct: int = DIRECT) -> DataFrame:
    """The fit of ratings (item, session, rater, rating), pairs (first, second, rater, outcome) and items (item, source).

    kind, id, estimate, spread, low, high, n, status: of an item its quality, its effect beside the source, the 95 % interval and its
    number of judgments; of a source its baseline; of a session the thresholds' offset and scale; of a rater the noise and its inverse;
    tie and unsure, their log propensities. Judgments with nulls, other ratings or outcomes, or items that have no source, are left out.
    Fewer than 8 ratings or 3 items give no estimates.
    """
    fit = Fit(ratings, pairs, items, direct=direct)
    name = F.regexp_replace("param", "^[a-z]+:", "")
    status = F.lit(fit.status).alias("status")
    none = lambda kind="double": F.lit(None).cast(kind)
    if not fit.enough:
        return fit.params.where("kind = 'item'").select("kind", name.alias("id"), *[none().alias(c) for c in ("estimate", "spread", "low", "high")], none("long").alias("n"), status)
    theta = fit.params.select("param", "theta")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    judged = fit.cells.select(total.alias("n"), F.explode("parts").alias("p")).where("p.kind = 'item'").groupBy(F.col("p.param").alias("item")).agg(F.sum("n").alias("n"))
    rows = fit.variances(probes).join(judged, "item").join(theta.select(F.col("param").alias("item"), F.col("theta").alias("own")), "item").join(theta.select(F.col("param").alias("source"), F.col("theta").alias("base")), "source")
    quality, half = F.col("own") + F.col("base"), 1.96 * F.sqrt("variance")
    out = rows.select(F.lit("item").alias("kind"), F.col("item").alias("param"), quality.alias("estimate"), F.col("own").alias("spread"), (quality - half).alias("low"), (quality + half).alias("high"), "n")
    scale = theta.select(F.regexp_replace("param", "^scale:", "offset:").alias("param"), F.exp("theta").alias("scale"), F.col("param").startswith("scale:").alias("is_scale")).where("is_scale")
    others = fit.params.where("kind NOT IN ('item', 'scale')").join(scale, "param", "left")
    estimate = F.when(F.col("kind") == "noise", F.exp("theta")).otherwise(F.col("theta"))
    spread = F.when(F.col("kind") == "noise", F.exp(-F.col("theta"))).when(F.col("kind") == "offset", F.col("scale"))
    kind = F.when(F.col("kind") == "offset", "session").when(F.col("kind") == "noise", "rater").otherwise(F.col("kind"))
    others = others.select(kind.alias("kind"), "param", estimate.alias("estimate"), spread.alias("spread"), none().alias("low"), none().alias("high"), none("long").alias("n"))
    return out.unionByName(others).select("kind", name.alias("id"), "estimate", "spread", "low", "high", "n", status)
