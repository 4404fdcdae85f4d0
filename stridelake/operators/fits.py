"""Iterative fits and draws (E16, E53, G6, G7, G9). Fits take count cells that Spark makes, never raw rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        t = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + t * d, 1e-300) if 1 + t * d > 0 else 1 / min(1 + t * d, -1e-300)
        c = 1 + t / c
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _incomplete_beta(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def notice_rates(ladder: DataFrame) -> DataFrame:
    """Answers of each level with the Jeffreys interval of the YES rate."""
    counts = ladder.groupBy("level").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("answer") == a).alias(a.lower()) for a in ("YES", "MAYBE", "NO")])

    @F.pandas_udf("low double, high double")
    def interval(yes: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[beta_quantile(q, y + 0.5, m - y + 0.5) for q in (0.025, 0.975)] for y, m in zip(yes, n, strict=True)], columns=["low", "high"])

    return counts.withColumn("jeffreys", interval("yes", "n")).select("level", "n", "yes", "maybe", "no", "jeffreys.*")


def psychometric(ladder: DataFrame, ridge: float = 0.02) -> DataFrame:
    """Ridge logistic fit of YES on level for each ladder, from level counts; threshold and just-noticeable difference.

    A threshold needs 4 levels, 24 answers, 3 at each level, a YES rate below one half at the first level and above it at the last, and
    has to lie between these levels. Levels are scaled to 0 .. 1 for the ridge.
    """
    cells = ladder.where("ladder IS NOT NULL AND level IS NOT NULL AND answer IS NOT NULL").groupBy("ladder", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer") == "YES").alias("yes"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("level")
        x, n, y = (rows[c].to_numpy(float) for c in ("level", "n", "yes"))
        found = [None, None, None, "not enough evidence"]
        span = x[-1] - x[0]
        if len(x) >= 4 and n.sum() >= 24 and n.min() >= 3 and y[0] / n[0] < 0.5 < y[-1] / n[-1]:
            design, w = np.stack([np.ones(len(x)), (x - x[0]) / span], 1), np.zeros(2)
            loss = lambda v: (n * np.logaddexp(0, design @ v)).sum() - y @ (design @ v) + ridge * (v @ v)
            for _ in range(100):
                p = 1 / (1 + np.exp(-design @ w))
                step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 2 * ridge * np.eye(2), design.T @ (y - n * p) - 2 * ridge * w)
                size = 1.0
                while loss(w + size * step) > loss(w) and size > 1e-9:
                    size /= 2
                w = w + size * step
                if np.abs(step).max() < 1e-10:
                    break
            threshold = x[0] - span * w[0] / w[1] if w[1] > 0 else np.nan
            found[0] = w[1] / span
            if x[0] <= threshold <= x[-1]:
                found = [found[0], threshold, span * math.log(3) / w[1], "ok"]
        return pd.DataFrame([[rows["ladder"].iloc[0], int(n.sum()), *found]], columns=["ladder", "n", "slope", "threshold", "jnd", "status"])

    return cells.groupBy("ladder").applyInPandas(fit, "ladder long, n long, slope double, threshold double, jnd double, status string")


def balanced_sample(scores: DataFrame, draws: int = 200, seed: int = 5) -> DataFrame:
    """Seeded draws with replacement, half from positives cycling through families, half from controls."""
    pools = scores.select("sample_id", F.col("target").cast("int").alias("half"), "family").withColumn("place", F.row_number().over(Window.partitionBy("half", "family").orderBy("sample_id")) - 1)
    sizes = pools.groupBy("half", "family").agg(F.count(F.lit(1)).alias("size")).withColumn("turn", F.row_number().over(Window.partitionBy("half").orderBy("family")) - 1).withColumn("turns", F.count(F.lit(1)).over(Window.partitionBy("half")))
    wanted = scores.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("half", (F.col("draw") % 2).cast("int"))
    picked = wanted.join(F.broadcast(sizes), "half").where((F.col("draw") / 2).cast("long") % F.col("turns") == F.col("turn"))
    picked = picked.withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "draw"), F.col("size")))
    return picked.join(pools, ["half", "family", "place"]).select("draw", "half", "family", "sample_id")


def stratified_overlap(observations: DataFrame, count: int = 40) -> DataFrame:
    """A pick of `count` rows, one for each (rater, item), that favours values of task, family and rating picked least.

    A pick depends on the row's stratum only and takes a stratum's rows in the order of their ids, so the greedy pass goes over
    strata (at most the product of the three columns' values) with their first `count` ids; rows never leave the executors.
    """
    keys = ("task", "family", "rating")
    first = observations.groupBy("rater", "stimulus").agg(F.min_by(F.struct("observation_id", *keys), "observation_id").alias("o")).select("o.*")
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("observation_id"))).where(F.col("k") <= count)
    strata = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list("observation_id")).alias("ids")).collect()
    ids = {tuple(r[c] for c in keys): r["ids"] for r in strata}
    used, seen, picks = dict.fromkeys(ids, 0), Counter(), []
    while len(picks) < count and (open_ := [s for s in ids if used[s] < len(ids[s])]):
        gain = {s: sum(1 / (1 + seen[c]) for c in enumerate(s)) for s in open_}
        stratum = min(open_, key=lambda s: (-gain[s], ids[s][used[s]]))
        picks.append((ids[stratum][used[stratum]], len(picks) + 1))
        used[stratum] += 1
        seen.update(enumerate(stratum))
    return observations.sparkSession.createDataFrame(picks, "observation_id long, place long")


def query_schedule(observations: DataFrame, size: int = 12, per_family: int = 4, spacing: int = 2) -> DataFrame:
    """For each rater, a schedule of the least-seen items with caps on families and a gap between items of one family.

    A family's items enter in their order and no more than per_family of them can, so the first per_family of each family are all that a
    schedule can need; the rest of the rows never reach the greedy pass.
    """
    items = observations.groupBy("rater", "stimulus", "family").agg(F.count(F.lit(1)).alias("seen"))
    top = items.withColumn("k", F.row_number().over(Window.partitionBy("rater", "family").orderBy("seen", "stimulus"))).where(F.col("k") <= per_family)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        left, out, used = rows.sort_values(["seen", "stimulus", "family"]).to_dict("records"), [], {}
        while left and len(out) < size:
            recent = {r["family"] for r in out[-spacing:]}
            best = next((r for r in left if used.get(r["family"], 0) < per_family and r["family"] not in recent), None)
            if best is None:
                break
            left.remove(best)
            out.append(best)
            used[best["family"]] = used.get(best["family"], 0) + 1
        return pd.DataFrame([(r["rater"], k + 1, r["stimulus"], r["family"]) for k, r in enumerate(out)], columns=["rater", "place", "stimulus", "family"])

    return top.groupBy("rater").applyInPandas(pick, "rater long, place long, stimulus long, family long")
