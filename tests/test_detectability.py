"""The detectability model against a dense fit of all parameters at once, and against planted effects."""

import math
import random

import numpy as np
import pytest

from stridelake.operators import detectability as model


def expit(x):
    return 1 / (1 + math.exp(-x))


def drawn(seed, items, sessions, per, crossing=True):
    draw = random.Random(seed)
    effect, shift = [draw.gauss(0, 1.2) for _ in range(items)], [draw.gauss(0, 0.5) for _ in range(sessions)]
    rows = []
    for k in range(items * per):
        i = k % items
        s = draw.randrange(sessions) if crossing else i % sessions
        x = effect[i] + shift[s] - sum(shift) / sessions
        u = draw.random()
        rows.append((i, f"s{s}", "NO" if u < expit(-0.7 - x) else "MAYBE" if u < expit(0.7 - x) else "YES"))
    return rows, effect


def dense(rows, with_sessions):
    """The posterior's mode by Newton steps with numerical derivatives of the whole sum, in all parameters."""
    items, sessions = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    ix, sx = np.array([items.index(r[0]) for r in rows]), np.array([sessions.index(r[1]) for r in rows])
    y = np.array([("NO", "MAYBE", "YES").index(r[2]) for r in rows])
    k, m = len(items), len(sessions) if with_sessions else 0

    def loss(p):
        x = p[:k][ix] + (p[k + 1 :][sx] - p[k + 1 :].mean() if m else 0)
        low, high = 1 / (1 + np.exp(math.exp(p[k]) / 2 + x)), 1 / (1 + np.exp(-math.exp(p[k]) / 2 + x))
        chosen = np.where(y == 0, low, np.where(y == 1, high - low, 1 - high))
        return -np.log(np.maximum(chosen, 1e-9)).sum() + (p[:k] ** 2).sum() / 4.5 + p[k] ** 2 / 2 + 2 * (p[k + 1 :] ** 2).sum()

    p, h = np.zeros(k + 1 + m), 1e-4
    eye = h * np.eye(len(p))
    for _ in range(25):
        grad = np.array([(loss(p + e) - loss(p - e)) / (2 * h) for e in eye])
        hess = np.array([[(loss(p + a + b) - loss(p + a - b) - loss(p - a + b) + loss(p - a - b)) / (4 * h * h) for b in eye] for a in eye])
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(p)), -grad)
        p = p + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return items, p, np.diag(hess)[:k]


@pytest.mark.parametrize(("sessions", "crossing", "expected"), [(3, True, True), (3, False, False), (1, True, False)])
def test_against_dense_fit(spark, sessions, crossing, expected):
    rows, _ = drawn(sessions, 14, sessions, 12, crossing)
    got = model.latent_detectability(spark.createDataFrame(rows + [(None, "s0", "YES"), (3, "s0", "?")], "item long, session string, answer string")).collect()
    items, p, curve = dense(rows, expected)
    gap = math.exp(p[len(items)])
    assert {r["item"] for r in got} == set(items) and {r["session_effects"] for r in got} == {expected} and {r["status"] for r in got} == {"exploratory_regularized_fit"}
    for r in got:
        d, half = p[items.index(r["item"])], 1.96 / math.sqrt(curve[items.index(r["item"])])
        assert [r["no"], r["maybe"], r["yes"], r["n"]] == [sum(x[0] == r["item"] and x[2] == a for x in rows) for a in ("NO", "MAYBE", "YES")] + [12]
        assert abs(r["detectability"] - d) < 1e-3 and abs(r["gap"] - gap) < 1e-3
        assert np.allclose([r["p_yes"], r["low"], r["high"]], [expit(d - gap / 2), expit(d - half - gap / 2), expit(d + half - gap / 2)], atol=1e-3)


def test_planted_effects(spark):
    rows, effect = drawn(9, 60, 4, 400)
    got = {r["item"]: r for r in model.latent_detectability(spark.createDataFrame(rows, "item long, session string, answer string")).collect()}
    assert abs(got[0]["gap"] - 1.4) < 0.1
    assert np.corrcoef(effect, [got[k]["detectability"] for k in range(60)])[0, 1] > 0.99
    inside = sum(got[k]["low"] <= expit(effect[k] - 0.7) <= got[k]["high"] for k in range(60))
    assert inside >= 50


def test_gates_and_empty(spark):
    schema = "item long, session string, answer string"
    few = [(k % 12, f"s{k // 12}", "YES") for k in range(24)]
    assert not model.latent_detectability(spark.createDataFrame(few, schema)).first()["session_effects"]
    assert model.latent_detectability(spark.createDataFrame([], schema)).count() == 0
