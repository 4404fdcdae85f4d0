"""Calibration of old 1 to 7 scores against direct answers, held out by source, with a cluster bootstrap and a gate.

The answers of a source are 21 counts (score by answer). Leaving a source out is the render's counts less its own, so every such
fit is a row; a replicate of the bootstrap weighs a source by a Poisson number from a hash of source and replicate, so all
replicates come from one pass over the sources. Fits run many at a time in numpy inside the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.sources import scratch

REPLICATES = 64
#: First parameters, their bounds, and mean and variance of their priors.
FIRST = np.array([-0.5, 0.2, 1.0])
LOW, HIGH = np.array([-12.0, 0.0, 0.03]), np.array([12.0, 8.0, 12.0])
MEAN, VARIANCE = np.array([0.0, 0.0, 1.0]), np.array([9.0, 1.0, 4.0])
LEAST_ITEMS, LEAST_SOURCES, LEAST_CLASS, GAIN, FLOOR = 30, 4, 3, 0.95, 1e-9
SCORES = np.arange(1, 8) - 4.0
#: Bounds of a uniform number below which a Poisson number with mean 1 is 0, 1, 2 ...
POISSON = np.cumsum([exp(-1) / factorial(k) for k in range(12)])


def probabilities(params: np.ndarray) -> np.ndarray:
    """fits x 7 x 3: the chances of the answers at each score."""
    at = params[:, :1] + params[:, 1:2] * SCORES
    one, two = (0.5 * (1 + np.tanh(x / 2)) for x in (at, at + params[:, 2:]))
    return np.stack([one, two - one, 1 - two], 2)


def _loss(params: np.ndarray, counts: np.ndarray) -> np.ndarray:
    logs = np.log(np.maximum(probabilities(params), FLOOR))
    return ((params - MEAN) ** 2 / VARIANCE).sum(1) / 2 - (counts * logs).sum((1, 2))


def fit_many(counts: np.ndarray) -> np.ndarray:
    """Intercept, slope and gap of each of the fits' counts (fits x 7 x 3): projected Newton steps; the loss is convex."""
    params = np.tile(FIRST, (len(counts), 1))
    one, two = np.stack([np.ones(7), SCORES, np.zeros(7)], 1), np.stack([np.ones(7), SCORES, np.ones(7)], 1)
    for _ in range(100):
        p = np.maximum(probabilities(params), FLOOR)
        low, high = p[..., 0], 1 - p[..., 2]
        f, g = low * (1 - low), high * (1 - high)
        share = counts / p
        bend = share / p
        s, t = share[..., 0] - share[..., 1], share[..., 1] - share[..., 2]
        grad = (params - MEAN) / VARIANCE - (f * s) @ one - (g * t) @ two
        aa = f * f * (bend[..., 0] + bend[..., 1]) - f * (1 - 2 * low) * s
        bb = g * g * (bend[..., 1] + bend[..., 2]) - g * (1 - 2 * high) * t
        ab = -f * g * bend[..., 1]
        curve = np.einsum("kx,xd,xe->kde", aa, one, one) + np.einsum("kx,xd,xe->kde", bb, two, two) + np.einsum("kx,xd,xe->kde", ab, one, two) + np.einsum("kx,xd,xe->kde", ab, two, one) + np.diag(1 / VARIANCE)
        fixed = (params <= LOW) & (grad > 0) | (params >= HIGH) & (grad < 0)
        grad[fixed] = 0
        curve[fixed[:, :, None] | fixed[:, None]] = 0
        curve += fixed[:, :, None] * np.eye(3)
        step = np.linalg.solve(curve, grad[..., None])[..., 0]
        size, now = np.ones((len(counts), 1)), _loss(params, counts)
        for _ in range(40):
            new = np.clip(params - size * step, LOW, HIGH)
            worse = _loss(new, counts) > now + 1e-12 * (1 + np.abs(now))
            if not worse.any():
                break
            size[worse] /= 2
        new[worse] = params[worse]
        moved, params = np.abs(new - params).max(initial=0), new
        if moved < 1e-10:
            break
    return params


def poisson(hashes: np.ndarray) -> np.ndarray:
    """Poisson numbers with mean 1 from 64-bit hashes."""
    return np.searchsorted(POISSON, (hashes.view(np.uint64) >> np.uint64(11)) / 2.0**53, "right").astype(float)


def _counts() -> Column:
    """The 21 counts of a group of cells (score, label, n)."""
    return F.array(*[F.sum(F.when((F.col("score") == s) & (F.col("label") == k), F.col("n")).otherwise(0)) for s in range(1, 8) for k in range(3)])


class Calibration:
    """matches: render, source, family, style, observation_id, score 1 to 7, label 0 to 2 (NO, MAYBE, YES). Rows with nulls or other values are left out."""

    def __init__(self, matches: DataFrame, replicates: int = REPLICATES):
        self.replicates = replicates
        known = matches.where("render IS NOT NULL AND source IS NOT NULL AND score BETWEEN 1 AND 7 AND label BETWEEN 0 AND 2")
        keys = [F.col(c).cast("string").alias(c) for c in ("render", "source", "family", "style")]
        known = known.select(*keys, "observation_id", F.col("score").cast("int").alias("score"), F.col("label").cast("int").alias("label"))
        self.cells = scratch.stored(known.groupBy("render", "source", "family", "style", "score", "label").agg(F.count(F.lit(1)).alias("n")), "cells")
        self.sources = scratch.stored(self.cells.groupBy("render", "source").agg(_counts().alias("counts")), "sources")
        items = known.groupBy("render").agg(F.count_distinct("observation_id").alias("items"))
        count = self.sources.groupBy("render").agg(F.count(F.lit(1)).alias("sources"))
        total = self.cells.groupBy("render").agg(_counts().alias("total"))
        self.renders = scratch.stored(total.join(count, "render").join(items, "render"), "renders")

    def held_out(self) -> DataFrame:
        """The cells with the chances that a fit without their source gives (held) and those of the other sources' answers (prior)."""
        schema = "render string, source string, held array<double>, prior array<double>"

        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                total, own = (np.array(batch.column(c).to_pylist(), float).reshape(-1, 7, 3) for c in ("total", "counts"))
                left = total - own
                held = probabilities(fit_many(left)).reshape(-1, 21)
                prior = (left.sum(1) + 1) / (left.sum((1, 2))[:, None] + 3)
                yield pa.RecordBatch.from_arrays([batch.column("render"), batch.column("source"), *[pa.array(list(x), pa.list_(pa.float64())) for x in (held, prior)]], ["render", "source", "held", "prior"])

        both = self.sources.join(self.renders.where("sources >= 2").select("render", "total"), "render").select("render", "source", "counts", "total")
        fits = both.mapInArrow(tasks, schema)
        held = F.slice("held", 3 * F.col("score") - 2, F.lit(3)).alias("held")
        return self.cells.join(fits, ["render", "source"]).select("render", "source", "family", "style", "score", "label", "n", held, "prior")

    def metrics(self) -> DataFrame:
        """Log loss, Brier score and accuracy held out, of the fit and of the prior, for each render, and in it each source, style and family."""
        rows = self.held_out()
        group = F.explode(F.array(*[F.struct(F.lit(kind).alias("by"), value.alias("group")) for kind, value in (("all", F.lit("")), *[(c, F.col(c)) for c in ("source", "style", "family")])]))

        def figures(p: str) -> list[Column]:
            own = F.element_at(p, F.col("label") + 1)
            square = sum(((F.element_at(p, k + 1) - (F.col("label") == k).cast("double")) ** 2 for k in range(3)), F.lit(0.0))
            hit = F.array_position(p, F.array_max(p)) == F.col("label") + 1
            mean = lambda x: F.sum(F.col("n") * x) / F.sum("n")
            return [mean(-F.log(F.greatest(own, F.lit(FLOOR)))).alias(f"{p}_log_loss"), mean(square).alias(f"{p}_brier"), mean(hit.cast("double")).alias(f"{p}_accuracy")]

        confusion = [F.sum(F.when((F.col("label") == a) & (F.array_position("held", F.array_max("held")) == b + 1), F.col("n")).otherwise(0)) for a in range(3) for b in range(3)]
        return rows.select("*", group.alias("g")).groupBy("render", "g.by", "g.group").agg(F.sum("n").alias("count"), *figures("held"), *figures("prior"), F.array(*confusion).alias("confusion"))

    def curves(self) -> DataFrame:
        """A row for each render and score: count, the chances of the answers, and their 95 % interval over the replicates."""
        n = self.replicates
        hashes = F.transform(F.array(*map(F.lit, range(n))), lambda r: F.xxhash64(F.col("source"), r))

        def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                weights = poisson(np.array(batch.column("hashes").to_pylist(), np.int64))
                counts = np.array(batch.column("counts").to_pylist(), float)
                names = np.array(batch.column("render").to_pylist(), object)
                for name in set(names):
                    at = names == name
                    sums[name] = sums.get(name, 0) + weights[at].T @ counts[at]
            for name, total in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["render", "replicate", "counts"])

        parts = self.sources.select("render", "counts", hashes.alias("hashes")).mapInArrow(weighed, "render string, replicate int, counts array<double>")
        summed = parts.groupBy("render", "replicate").agg(F.array(*[F.sum(F.element_at("counts", k)) for k in range(1, 22)]).alias("counts"))
        drawn = summed.groupBy("render").agg(F.sort_array(F.collect_list(F.struct("replicate", "counts"))).alias("drawn"))
        names = [f"{a}{end}" for a in ("no", "maybe", "yes") for end in ("", "_low", "_high")]
        schema = "render string, score int, count long, supported boolean, " + ", ".join(f"{c} double" for c in names)

        def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    total = np.array(r["total"], float).reshape(7, 3)
                    sets = np.array([d["counts"] for d in r["drawn"]]).reshape(-1, 7, 3)
                    curve, *draws = probabilities(fit_many(np.concatenate([total[None], sets])))
                    ends = np.quantile(draws, [0.025, 0.975], axis=0) if r["sources"] >= 2 else np.full((2, 7, 3), np.nan)
                    for s in range(7):
                        count = int(total[s].sum())
                        values = [float(x) for k in range(3) for x in (curve[s, k], *ends[:, s, k])]
                        rows.append((r["render"], s + 1, count, count >= 3 and r["sources"] >= 3, *[None if np.isnan(v) else v for v in values]))
                columns = zip(*rows, strict=True) if rows else [[]] * (4 + len(names))
                types = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), *[pa.float64()] * len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in schema.split(", ")])

        return self.renders.join(drawn, "render").select("render", "total", "sources", "drawn").mapInArrow(fitted, schema)

    def gates(self) -> DataFrame:
        """render, items, sources, the held-out figures, and whether proxies may be made of it: at least 30 items, 4 sources and 3 of each
        answer, and over 5 % less log loss and Brier score than the prior."""
        by_class = [F.expr(f"aggregate(filter(total, (x, i) -> i % 3 = {k}), 0L, (a, x) -> a + x)") for k in range(3)]
        enough = (F.col("items") >= LEAST_ITEMS) & (F.col("sources") >= LEAST_SOURCES) & (F.least(*by_class) >= LEAST_CLASS)
        figures = self.metrics().where("by = 'all'").drop("by", "group", "count", "confusion")
        better = F.coalesce((F.col("held_log_loss") < GAIN * F.col("prior_log_loss")) & (F.col("held_brier") < GAIN * F.col("prior_brier")), F.lit(False))
        return self.renders.withColumn("enough", enough).join(figures, "render", "left").select("*", (F.col("enough") & better).alias("gate_passed")).drop("total")


def ordinal_calibration(matches: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """The calibration curve of each render with its gate."""
    fit = Calibration(matches, replicates)
    return fit.curves().join(fit.gates(), "render")
