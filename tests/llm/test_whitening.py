"""Whitening against plain fractions and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from stridelake.llm import op11_whitening


def plain(rows, d):
    """n, exact covariance and exact deviations by dense loops over (vec_id, vector)."""
    xs = [(v, [math.floor(64 * float(c)) + 1000000 for c in e]) for v, e in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n = len(fit)
    s = [sum(x[i] for x in fit) for i in range(d)]
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(d):
            cov[i, j] = float(Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3))
    return n, s, xs, fit, cov


def test_against_fractions(spark, sf):
    rows = [(r[0], list(r[1])[:8]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").limit(120).collect()]
    rows += [(None, rows[3][1]), (7, rows[7][1]), (7, rows[9][1])]
    bad = [(900, None), (901, [*rows[0][1][:7], None]), (902, [*rows[0][1][:7], float("nan")]), (903, [*rows[0][1][:7], float("inf")])]
    other = [(904, [1.0, 2.0]), (905, [])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows + bad + other], "vec_id long, embedding array<float>, n long, x string")
    got = op11_whitening.whiten(docs).collect()
    n, s, xs, fit, cov = plain(rows, 8)
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    assert len(got) == 8 * (len(rows) + 2) and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    mean = np.array(s) / n
    for v, x in xs:
        w = (np.array(x) - mean) @ q / np.sqrt(e)
        far = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        for c in range(8):
            found = by[v, c + 1]
            assert any(r["deviation"] == far and math.isclose(abs(r["whitened"]), abs(w[c]), rel_tol=1e-6, abs_tol=1e-7) for r in found)
            assert all(math.isclose(r["explained"], e[c] / np.trace(cov), rel_tol=1e-9) and r["identity_error"] < 1e-9 for r in found)
    assert all(by[v, c][0]["whitened"] is None and by[v, c][0]["deviation"] is None for v in (904, 905) for c in range(1, 9))


def test_polarised_sums_are_exact(spark):
    """Entries too wide for 64 bits once squared."""
    rows = [(k, [3e15 * (k % 3), -1e16 + k, 5e16 * (k % 2), 1e300]) for k in range(40)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fit = op11_whitening.vectors(docs)
    n, s = op11_whitening.means(fit, 4)
    xs = [r["x"] for r in fit.collect()]
    assert (n, s) == (40, [sum(x[i] for x in xs) for i in range(4)])
    want = [[float(Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in xs), n**3)) for j in range(4)] for i in range(4)]
    assert op11_whitening.covariance(fit, n, s).tolist() == want
    got = op11_whitening.whiten(docs).collect()
    assert all(r["deviation"] is None and int(r["deviation_digits"]) == sum((n * a - b) ** 2 for a, b in zip(xs[r["vec_id"]], s, strict=True)) for r in got)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, []), (2, None)]])
def test_small_tables(spark, rows):
    got = op11_whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    width = len(rows[0][1]) if rows else 0
    assert len(got) == len(rows) * width and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 for r in got)


def test_whole_table(spark, sf):
    got = op11_whitening.op11_whitening(spark, sf).toPandas()
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert len(got) == 16 * n and got["identity_error"].max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(16)).max() < 1e-9
