"""Calibration by plain loops: leaving out, weighing, quantiles and the gate; fits by the conditions of a minimum."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.operators import calibration as op
from stridelake.operators import fits

SCHEMA = "render string, source string, family string, style string, observation_id long, score int, label int"


def made(seed, sources, rows, noise=0.3):
    draw = random.Random(seed)
    out = []
    for k in range(rows):
        score = draw.randint(1, 7)
        label = min(2, max(0, 2 - (score - 1) // 3 if draw.random() > noise else draw.randint(0, 2)))
        out.append((draw.choice("ab"), f"s{draw.randrange(sources)}", draw.choice("fg"), "t", k % 50, score, label))
    return out


def loss(p, counts):
    total = ((p - op.MEAN) ** 2 / op.VARIANCE).sum() / 2
    for x in range(7):
        a = p[0] + p[1] * (x - 3)
        one, two = 1 / (1 + np.exp(-a)), 1 / (1 + np.exp(-a - p[2]))
        total -= (counts[x] * np.log(np.maximum([one, two - one, 1 - two], 1e-9))).sum()
    return total


def test_fits_are_minima():
    draw = np.random.default_rng(3)
    counts = draw.integers(0, 9, (40, 7, 3)).astype(float)
    counts[0] = 0
    counts[1, :, 0], counts[1, :, 1:] = 50, 0
    counts[2] = counts[2][::-1]
    for p, c in zip(op.fit_many(counts), counts, strict=True):
        for d in range(3):
            e = 1e-5 * np.eye(3)[d]
            slope = (loss(p + e, c) - loss(p - e, c)) / 2e-5
            assert abs(slope) < 1e-3 or (p[d] <= op.LOW[d] and slope > 0) or (p[d] >= op.HIGH[d] and slope < 0)


def tally(rows):
    out = np.zeros((7, 3))
    for r in rows:
        out[r[5] - 1, r[6]] += 1
    return out


@pytest.mark.parametrize(("seed", "sources", "rows", "noise"), [(1, 6, 400, 0.2), (2, 2, 60, 0.9), (3, 1, 30, 0.3)])
def test_against_loops(spark, seed, sources, rows, noise):
    data = made(seed, sources, rows, noise)
    docs = spark.createDataFrame(data + [(None, "s", "f", "t", 1, 1, 1), ("a", "s0", "f", "t", 1, 9, 1), ("a", None, "f", "t", 1, 1, None)], SCHEMA)
    got = {(r["render"], r["score"]): r for r in op.ordinal_calibration(docs).collect()}
    by_group = {(r["render"], r["by"], r["group"]): r for r in op.Calibration(docs).metrics().collect()}
    names = sorted({r[1] for r in data})
    hashes = spark.createDataFrame([(s,) for s in names], "source string").select("source", *[F.xxhash64("source", F.lit(k)).alias(f"h{k}") for k in range(64)]).collect()
    weight = {r["source"]: op.poisson(np.array(list(r)[1:], np.int64)) for r in hashes}
    for render in "ab":
        own = [r for r in data if r[0] == render]
        here = sorted({r[1] for r in own})
        curve = op.probabilities(op.fit_many(tally(own)[None]))[0]
        draws = []
        for k in range(64):
            total = sum(weight[s][k] * tally([r for r in own if r[1] == s]) for s in here)
            draws.append(op.probabilities(op.fit_many(total[None]))[0])
        ends = np.quantile(draws, [0.025, 0.975], axis=0)
        held, groups = [], {}
        for s in here if len(here) > 1 else []:
            rest = tally([r for r in own if r[1] != s])
            p, prior = op.probabilities(op.fit_many(rest[None]))[0], (rest.sum(0) + 1) / (rest.sum() + 3)
            for r in own:
                if r[1] == s:
                    one = np.eye(3)[r[6]]
                    q = p[r[5] - 1]
                    held.append((-np.log(q[r[6]]), ((q - one) ** 2).sum(), -np.log(prior[r[6]]), ((prior - one) ** 2).sum(), float(q.argmax() == r[6])))
                    for key in (("source", s), ("family", r[2]), ("style", r[3]), ("all", "")):
                        groups.setdefault(key, []).append(held[-1])
        means = np.mean(held, 0) if held else None
        enough = len({r[4] for r in own}) >= 30 and len(here) >= 4 and min(tally(own).sum(0)) >= 3
        for s in range(7):
            r = got[render, s + 1]
            assert r["count"] == tally(own)[s].sum() and r["supported"] == (r["count"] >= 3 and len(here) >= 3)
            assert np.allclose([r["no"], r["maybe"], r["yes"]], curve[s], atol=1e-6)
            if len(here) > 1:
                assert np.allclose([r["no_low"], r["maybe_low"], r["yes_low"]], ends[0, s], atol=1e-5)
                assert np.allclose([r["no_high"], r["maybe_high"], r["yes_high"]], ends[1, s], atol=1e-5)
                assert np.allclose([r["held_log_loss"], r["held_brier"], r["prior_log_loss"], r["prior_brier"], r["held_accuracy"]], means, atol=1e-6)
            else:
                assert r["no_low"] is None and r["held_log_loss"] is None
            assert r["enough"] == enough and r["gate_passed"] == bool(enough and means[0] < 0.95 * means[2] and means[1] < 0.95 * means[3])
        assert {k[1:] for k in by_group if k[0] == render} == set(groups)
        for key, rows_ in groups.items():
            r = by_group[(render, *key)]
            assert r["count"] == len(rows_) == sum(r["confusion"]) and np.isclose(r["held_log_loss"], np.mean(rows_, 0)[0])
    assert seed != 1 or any(r["gate_passed"] for r in got.values())


def test_empty(spark):
    assert op.ordinal_calibration(spark.createDataFrame([], SCHEMA)).count() == 0


def test_poisson_numbers(spark):
    w = op.poisson(np.array([r[0] for r in spark.range(20000).select(F.xxhash64("id")).collect()], np.int64))
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05 and abs((w == 0).mean() - np.exp(-1)) < 0.02


def test_psychometric(spark):
    draw = random.Random(6)
    rows = [(1, level, "YES" if draw.random() < 1 / (1 + np.exp(3 - 1.5 * level)) else draw.choice(["NO", "MAYBE"])) for level in range(5) for _ in range(30)]
    rows += [(2, level, "YES" if level in (1, 2) else "NO") for level in range(5) for _ in range(9)]  # crosses in the middle only
    rows += [(3, level, "YES" if level > 1 else "NO") for level in range(3) for _ in range(20)] + [(None, 1, "YES"), (3, None, "YES"), (4, 1, None)]
    got = {r["ladder"]: r for r in fits.psychometric(spark.createDataFrame(rows, "ladder long, level long, answer string")).collect()}
    assert set(got) == {1, 2, 3} and got[2]["status"] == got[3]["status"] == "not enough evidence" and got[2]["threshold"] is None
    own = [(r[1] / 4, r[2] == "YES") for r in rows if r[0] == 1]
    b = got[1]["slope"] * 4
    a = -b * got[1]["threshold"] / 4
    loss = lambda u, v: sum(np.logaddexp(0, u + v * x) - y * (u + v * x) for x, y in own) + 0.02 * (u * u + v * v)
    assert abs(loss(a + 1e-5, b) - loss(a - 1e-5, b)) < 1e-7 and abs(loss(a, b + 1e-5) - loss(a, b - 1e-5)) < 1e-7
    assert abs(got[1]["jnd"] - np.log(3) / got[1]["slope"]) < 1e-9 and abs(got[1]["threshold"] - 2) < 0.5
