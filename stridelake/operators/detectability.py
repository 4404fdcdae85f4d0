"""How detectable each stimulus is, by a cumulative logit with item effects, a shared threshold gap and session effects.

A judgment is NO, MAYBE or YES with thresholds -gap/2 and gap/2 on item effect plus session effect (mean zero). The
penalised likelihood is solved by Newton steps on a block-arrow system. Given the gap and the session effects the items do not
depend on each other, so a task solves each item of its own and then eliminates it: what it sends is the profile's value, gradient
and curvature in the gap and the sessions, summed over its items. The driver solves that system, of one row for each session.
Item effects never leave the executors; an item's row holds a cell for each of its sessions, whatever its number of judgments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.sources import scratch

ANSWERS = ("NO", "MAYBE", "YES")
ITEM_SD, GAP_SD, SESSION_WEIGHT = 1.5, 1.0, 4.0
LEAST_SESSIONS, LEAST_CROSSING, LEAST_ROWS = 2, 10, 20
BOUND, FLOOR = 8.0, 1e-9
#: Items whose rows of the curvature a task holds at once.
CHUNK = 512
RESULT = "item long, n long, no long, maybe long, yes long, detectability double, p_yes double, low double, high double"


def expit(x):
    return 0.5 * (1 + np.tanh(np.asarray(x) / 2))


def terms(x: np.ndarray, gap: float, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Log likelihood of counts n (cells x 3) at x, its slopes in x and in the gap's logarithm, and its negative second derivatives."""
    q = gap / 2
    a, b = expit(-q - x), expit(q - x)
    da, db = a * (1 - a), b * (1 - b)
    dda, ddb = da * (1 - 2 * a), db * (1 - 2 * b)
    p = np.maximum(np.stack([a, b - a, 1 - b], 1), FLOOR)
    px, pg = np.stack([-da, da - db, db], 1), q * np.stack([-da, da + db, -db], 1)
    pxx, pxg = np.stack([dda, ddb - dda, -ddb], 1), q * np.stack([dda, -dda - ddb, ddb], 1)
    pgg = pg + q * q * np.stack([dda, ddb - dda, -ddb], 1)
    second = lambda u, v, uv: (n * (u * v / p - uv) / p).sum(1)
    return (n * np.log(p)).sum(1), (n * px / p).sum(1), (n * pg / p).sum(1), second(px, px, pxx), second(px, pg, pxg), second(pg, pg, pgg)


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell: the place of its item in the batch, its session's number, its counts."""
    cells = batch.column("cells")
    flat = cells.flatten()
    column = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(batch.num_rows), cells.value_lengths().to_numpy(zero_copy_only=False))
    return at, column("session"), np.stack([column(c) for c in ("no", "maybe", "yes")], 1).astype(float)


def _solved(at: np.ndarray, offset: np.ndarray, n: np.ndarray, gap: float, items: int) -> tuple[np.ndarray, np.ndarray]:
    """Each item's effect at the offsets of its cells, and its curvature there. The function of one item is concave."""
    d = np.zeros(items)
    for _ in range(60):
        _, slope, _, bend, _, _ = terms(d[at] + offset, gap, n)
        curve = np.bincount(at, bend, items) + ITEM_SD**-2
        step = np.clip((np.bincount(at, slope, items) - d / ITEM_SD**2) / curve, -1, 1)
        d = np.clip(d + step, -BOUND, BOUND)
        if np.abs(step).max(initial=0) < 1e-10:
            break
    _, _, _, bend, _, _ = terms(d[at] + offset, gap, n)
    return d, np.bincount(at, bend, items) + ITEM_SD**-2


def _evaluated(items: DataFrame, u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log posterior at u = (log gap, session effects), items at their best; gradient and curvature in u."""
    size = len(u)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, grad, curve = 0.0, np.zeros(size), np.zeros((size, size))
        gap, effects = float(np.exp(u[0])), u[1:] if size > 1 else np.zeros(1)
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                at, session, n = _cells(batch)
                d, own = _solved(at, effects[session], n, gap, batch.num_rows)
                ll, x, g, xx, xg, gg = terms(d[at] + effects[session], gap, n)
                value += 0.5 * float((d**2).sum()) / ITEM_SD**2 - float(ll.sum())
                grad[0] -= g.sum()
                arm = np.zeros((batch.num_rows, size))
                arm[:, 0] = np.bincount(at, xg, batch.num_rows)
                curve[0, 0] += gg.sum()
                if size > 1:
                    grad[1:] -= np.bincount(session, x, size - 1)
                    np.add.at(arm, (at, session + 1), xx)
                    side = np.bincount(session, xg, size - 1)
                    curve[0, 1:] += side
                    curve[1:, 0] += side
                    curve[np.arange(1, size), np.arange(1, size)] += np.bincount(session, xx, size - 1)
                curve -= (arm / own[:, None]).T @ arm
        a, b = np.nonzero(curve)
        rows = np.concatenate([[-1], np.arange(size), a]), np.concatenate([[-1], np.full(size, -1), b]), np.concatenate([[value], grad, curve[a, b]])
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.float64())], ["a", "b", "value"])

    value, grad, curve = 0.0, np.zeros(size), np.zeros((size, size))
    for a, b, v in items.mapInArrow(tasks, "a int, b int, value double").groupBy("a", "b").agg(F.sum("value")).collect():
        if a < 0:
            value = v
        elif b < 0:
            grad[a] = v
        else:
            curve[a, b] = v
    weights = np.concatenate([[GAP_SD**-2], np.full(size - 1, SESSION_WEIGHT)])
    return value + 0.5 * float(weights @ u**2), grad + weights * u, curve + np.diag(weights)


def _step(grad: np.ndarray, curve: np.ndarray, ridge: float) -> np.ndarray:
    """The Newton step whose session effects add up to zero."""
    size = len(grad)
    system = np.zeros((size + 1, size + 1))
    system[:size, :size] = curve + ridge * np.eye(size)
    system[size, 1:size] = system[1:size, size] = 1
    if size == 1:
        return -grad / (curve[0, 0] + ridge)
    return np.linalg.solve(system, np.append(-grad, 0))[:size]


def latent_detectability(judgments: DataFrame, steps: int = 60) -> DataFrame:
    """A row for each item of judgments (item, session, answer): its counts, effect, probability of YES and 95 % interval.

    The interval is that of the item's curvature, at the fitted gap and sessions. Session effects enter with 2 sessions or more, 10 items
    or more that several sessions share, and 20 judgments in each session. A fit that does not converge has null estimates and
    says so in status. Rows without an item or with another answer are left out; a null session is one session.
    """
    known = judgments.where(F.col("item").isNotNull() & F.col("answer").isin(*ANSWERS))
    counts = [F.count_if(F.col("answer") == a).alias(a.lower()) for a in ANSWERS]
    cells = scratch.stored(known.groupBy("item", F.coalesce(F.col("session").cast("string"), F.lit("")).alias("session")).agg(*counts), "cells")
    sizes = cells.groupBy("session").agg(F.sum(F.col("no") + F.col("maybe") + F.col("yes")).alias("rows")).orderBy("session").collect()
    crossing = cells.groupBy("item").count().where("count > 1").count()
    with_sessions = len(sizes) >= LEAST_SESSIONS and crossing >= LEAST_CROSSING and min(r["rows"] for r in sizes) >= LEAST_ROWS
    numbers = judgments.sparkSession.createDataFrame([(r["session"], k if with_sessions else 0) for k, r in enumerate(sizes)], "session string, number int")
    cell = F.struct(F.col("number").alias("session"), "no", "maybe", "yes")
    items = scratch.stored(cells.join(numbers, "session").groupBy(F.col("item").cast("long").alias("item")).agg(F.collect_list(cell).alias("cells")), "items")
    u = np.zeros(1 + len(sizes) * with_sessions)
    now, ridge, converged = _evaluated(items, u) if sizes else (0.0, u, np.eye(1)), 0.0, False
    for _ in range(steps if sizes else 0):
        step = np.clip(_step(now[1], now[2], ridge), -2, 2)
        new = np.clip(u + step, -BOUND, BOUND)
        then = _evaluated(items, new)
        if then[0] > now[0] + 1e-9 * (1 + abs(now[0])):
            ridge = max(4 * ridge, 1e-2 * float(np.abs(np.diag(now[2])).max()))
            continue
        u, now, ridge = new, then, ridge / 8 if ridge > 1e-6 else 0.0
        if np.abs(step).max() < 1e-6 and not ridge:
            converged = True
            break
    gap = float(np.exp(u[0]))

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        effects = u[1:] if len(u) > 1 else np.zeros(1)
        for batch in batches:
            at, session, n = _cells(batch)
            d, own = _solved(at, effects[session], n, gap, batch.num_rows)
            total = np.stack([np.bincount(at, n[:, k], batch.num_rows) for k in range(3)], 1).astype(np.int64)
            half = 1.96 / np.sqrt(own)
            good = [d, expit(d - gap / 2), expit(d - half - gap / 2), expit(d + half - gap / 2)]
            columns = [batch.column("item"), *map(pa.array, (total.sum(1), *total.T)), *[pa.array(x, mask=np.full(len(x), not converged)) for x in good]]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    status = "exploratory_regularized_fit" if converged else "latent_model_did_not_converge"
    return items.mapInArrow(estimated, RESULT).select("*", F.lit(gap).alias("gap"), F.lit(bool(with_sessions)).alias("session_effects"), F.lit(status).alias("status"))
