"""The joint quality model against a dense fit of the summed likelihood, and against planted parameters."""

import math
import random

import numpy as np
import pytest

from stridelake.operators import latent

BASE = (-1.5, -1.0, -0.5, 0.0, 0.5, 1.0)
OUTCOMES = ("first_better", "second_better", "effectively_equal", "not_sure")


def expit(x):
    return 1 / (1 + math.exp(-max(-500, min(500, x))))


def drawn(seed, items, sources, sessions, raters, singles, pairs):
    draw = random.Random(seed)
    base, own = [draw.gauss(0, 0.8) for _ in range(sources)], [draw.gauss(0, 0.8) for _ in range(items)]
    offset, scale, noise = [draw.gauss(0, 0.4) for _ in range(sessions)], [math.exp(draw.gauss(0, 0.2)) for _ in range(sessions)], [math.exp(draw.gauss(-0.6, 0.3)) for _ in range(raters)]
    quality = [base[i % sources] + own[i] for i in range(items)]
    rated, compared = [], []
    for k in range(singles):
        i, s, r = k % items, draw.randrange(sessions), draw.randrange(raters)
        u = quality[i] + noise[r] * math.log((x := draw.uniform(1e-9, 1)) / (1 - x + 1e-12))
        rated.append((i, f"s{s}", r, 1 + sum(u > offset[s] + scale[s] * t for t in BASE)))
    for _ in range(pairs):
        (i, j), r = draw.sample(range(items), 2), draw.randrange(raters)
        d = (quality[i] - quality[j]) / noise[r]
        w = [math.exp(v) for v in (d / 2, -d / 2, -0.5, -1.2)]
        compared.append((i, j, r, draw.choices(OUTCOMES, w)[0]))
    return rated, compared, [(i, f"c{i % sources}") for i in range(items)], quality


def frames(spark, rated, compared, items):
    return spark.createDataFrame(rated, "item long, session string, rater long, rating int"), spark.createDataFrame(compared, "first long, second long, rater long, outcome string"), spark.createDataFrame(items, "item long, source string")


class Dense:
    """The posterior as one function of one vector, row by row."""

    def __init__(self, rated, compared, items):
        self.rated, self.compared, self.source = rated, compared, dict(items)
        self.names = sorted({("source", s) for _, s in items} | {("item", i) for i, _ in items} | {(k, r[1]) for r in rated for k in ("offset", "scale")} | {("noise", r[2]) for r in rated + compared} | ({("tie", ""), ("unsure", "")} if compared else set()), key=str)
        self.at = {n: k for k, n in enumerate(self.names)}

    def quality(self, p, i):
        return p[self.at["source", self.source[i]]] + p[self.at["item", i]]

    def loss(self, p):
        g, total = lambda *n: p[self.at[n]], 0.0
        for i, s, r, c in self.rated:
            y = [(g("offset", s) + math.exp(g("scale", s)) * t - self.quality(p, i)) / math.exp(g("noise", r)) for t in BASE]
            low, high = 0.0 if c == 1 else expit(y[c - 2]), 1.0 if c == 7 else expit(y[c - 1])
            total -= math.log(max(high - low, 1e-12))
        for i, j, r, o in self.compared:
            d = (self.quality(p, i) - self.quality(p, j)) / math.exp(g("noise", r))
            logits = [d / 2, -d / 2, g("tie", ""), g("unsure", "")]
            total -= logits[OUTCOMES.index(o)] - math.log(sum(map(math.exp, logits)))
        weights = {"source": 0.08, "item": 0.12, "offset": 0.1, "scale": 0.1, "noise": 0.15, "tie": 0.03, "unsure": 0.03}
        return total + sum(weights[n[0]] * v * v for n, v in zip(self.names, p, strict=True))

    def curvature(self, p, h=1e-3):
        eye = h * np.eye(len(p))
        at = {}
        f = lambda x: at.setdefault(x.tobytes(), self.loss(x))
        return np.array([[(f(p + a + b) - f(p + a - b) - f(p - a + b) + f(p - a - b)) / (4 * h * h) for b in eye] for a in eye])

    def slope(self, p, h=1e-5):
        return np.array([(self.loss(p + e) - self.loss(p - e)) / (2 * h) for e in h * np.eye(len(p))])


def test_mode_and_inverse_against_dense(spark):
    rated, compared, items, _ = drawn(2, 8, 3, 2, 3, 160, 80)
    dense = Dense(rated, compared, items)
    noisy = rated + [(None, "s0", 1, 3), (5, None, 1, 3), (5, "s0", 1, 9), (77, "s0", 1, 2)]
    got = latent.latent_quality(*frames(spark, noisy, compared + [(1, 77, 0, "not_sure"), (1, 2, 0, "?")], items)).collect()
    assert {r["status"] for r in got} == {"fit"}
    by = {(r["kind"], r["id"]): r for r in got}
    p = np.zeros(len(dense.names))
    for (kind, name), k in dense.at.items():
        if kind == "item":
            p[k] = by["item", str(name)]["spread"]
        elif kind == "scale":
            p[k] = math.log(by["session", name]["spread"])
        elif kind == "noise":
            p[k] = math.log(by["rater", str(name)]["estimate"])
        else:
            p[k] = by[{"offset": "session"}.get(kind, kind), str(name) or kind]["estimate"]
    slope, curve = dense.slope(p), dense.curvature(p)
    assert np.abs(np.linalg.solve(curve, slope)).max() < 5e-3  # the mode is a step of that size away
    inverse = np.linalg.inv(curve)
    for i, s in items:
        r = by["item", str(i)]
        a, b = dense.at["item", i], dense.at["source", s]
        want = 1.96 * math.sqrt(inverse[a, a] + inverse[b, b] + 2 * inverse[a, b])
        assert abs(r["estimate"] - dense.quality(p, i)) < 1e-9 and 0.9 < (r["high"] - r["low"]) / 2 / want < 1.1
        assert r["n"] == sum(x[0] == i for x in rated) + sum(i in x[:2] for x in compared)


def test_tables_solve_as_the_driver_does(spark):
    """Steps and variances by conjugate gradients over tables."""
    rated, compared, items, _ = drawn(4, 12, 3, 2, 2, 300, 60)
    fit = latent.Fit(*frames(spark, rated, compared, items), steps=3)
    exact = {r["item"]: r["variance"] for r in fit.variances().collect()}
    _, grad = fit._linearised()
    want = {r["param"]: r["x"] for r in fit._step(grad).collect()}
    fit.small = False
    start = grad.withColumnRenamed("grad", "rhs").selectExpr("*", "explode(array(0, 1)) AS k").selectExpr("param", "diag", "k", "CASE WHEN k = 0 THEN rhs ELSE -2 * rhs END AS rhs")
    for r in latent._conjugate(fit.matrix, start, 2, 1e-7).collect():
        assert abs(r["x"] - want[r["param"]] * (1 if r["k"] == 0 else -2)) < 1e-5
    shares = [r["variance"] / exact[r["item"]] for r in fit.variances(64).collect()]
    assert 0.6 < np.median(shares) < 1.5 and min(shares) > 0.1 and max(shares) < 3


def test_information_is_the_expected_curvature():
    draw = np.random.default_rng(1)
    for terms, k in ((latent.rating_terms, 7), (latent.pair_terms, 4)):
        z = draw.normal(0, 0.5, (5, 4))
        for row in z:
            unit = np.eye(k)
            probs = np.exp(np.array([terms(row[None], e[None])[0][0] for e in unit]))
            slopes = np.array([terms(row[None], e[None])[1][0] for e in unit])
            assert abs(probs.sum() - 1) < 1e-9 and np.abs(probs @ slopes).max() < 1e-9
            assert np.allclose(terms(row[None], unit[:1])[2][0], np.einsum("c,cd,ce->de", probs, slopes, slopes), atol=1e-9)
            step = 1e-6
            for d in range(4):
                up, down = (terms((row + s * np.eye(4)[d])[None], unit[:1] * 3)[0][0] for s in (step, -step))
                assert abs((up - down) / (2 * step) - terms(row[None], unit[:1] * 3)[1][0][d]) < 1e-5
                up, down = (terms((row + s * np.eye(4)[d])[None], unit[1:2] * 3)[1][0] for s in (step, -step))
                assert np.allclose((down - up) / (2 * step), terms(row[None], unit[1:2] * 3)[3][0][d], atol=1e-4)


def test_planted_quality(spark):
    rated, compared, items, quality = drawn(5, 40, 8, 4, 6, 4000, 1500)
    got = {r["id"]: r for r in latent.latent_quality(*frames(spark, rated, compared, items)).collect() if r["kind"] == "item"}
    found = [got[str(k)]["estimate"] for k in range(40)]
    assert np.corrcoef(found, quality)[0, 1] > 0.98


@pytest.mark.parametrize("rows", [0, 7])
def test_too_few(spark, rows):
    rated, compared, items, _ = drawn(2, 8, 3, 2, 3, 160, 20)
    got = latent.latent_quality(*frames(spark, rated[:rows], compared[:rows], items)).collect()
    assert all(r["status"] == "insufficient_human_observations" and r["estimate"] is None for r in got) and (rows or not got)
