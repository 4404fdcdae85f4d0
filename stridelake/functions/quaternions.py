"""SQL expressions over quaternions (w, x, y, z), vectors and matrices given as tuples of column names or expressions."""

from __future__ import annotations

A, B = ("aw", "ax", "ay", "az"), ("bw", "bx", "by_", "bz")
Q = ("w", "x", "y", "z")


def num(x: str) -> str:
    """Rounded for output, without a negative zero."""
    return f"round({x}, 6) + 0e0"


def dot(a: tuple, b: tuple) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b, strict=True)) + ")"


def norm(a: tuple) -> str:
    return f"sqrt({dot(a, a)})"


def cross(a: tuple, b: tuple) -> tuple:
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def conjugate(q: tuple) -> tuple:
    return (q[0], *(f"(-{c})" for c in q[1:]))


def multiply(a: tuple, b: tuple) -> tuple:
    """Hamilton product; the right rotation comes first."""
    w, x, y, z = a
    i, j, k, m = b
    return (f"({w} * {i} - {x} * {j} - {y} * {k} - {z} * {m})", f"({w} * {j} + {x} * {i} + {y} * {m} - {z} * {k})", f"({w} * {k} - {x} * {m} + {y} * {i} + {z} * {j})", f"({w} * {m} + {x} * {k} - {y} * {j} + {z} * {i})")


def rotate(q: tuple, v: tuple) -> tuple:
    """v + 2w(u x v) + 2u x (u x v) for a unit q."""
    once = cross(q[1:], v)
    twice = cross(q[1:], once)
    return tuple(f"({v[k]} + 2 * {q[0]} * {once[k]} + 2 * {twice[k]})" for k in range(3))


def log_vector(q: tuple) -> tuple:
    """Shortest axis-angle vector of a unit q."""
    n, sign = norm(q[1:]), f"(CASE WHEN {q[0]} < 0 THEN -1 ELSE 1 END)"
    scale = f"(CASE WHEN {n} < 1e-12 THEN 2e0 ELSE 2 * atan2({n}, abs({q[0]})) / {n} END)"
    return tuple(f"({sign} * {scale} * {c})" for c in q[1:])


def exp_vector(v: tuple) -> tuple:
    a = norm(v)
    scale = f"(CASE WHEN {a} < 1e-7 THEN 0.5e0 - {a} * {a} / 48 + {a} * {a} * {a} * {a} / 3840 ELSE sin({a} / 2) / {a} END)"
    return (f"cos({a} / 2)", *(f"({scale} * {c})" for c in v))


def matrix(q: tuple) -> list[str]:
    """Row by row, of a unit q."""
    w, x, y, z = q
    return [f"(1 - 2 * ({y} * {y} + {z} * {z}))", f"(2 * ({x} * {y} - {w} * {z}))", f"(2 * ({x} * {z} + {w} * {y}))", f"(2 * ({x} * {y} + {w} * {z}))", f"(1 - 2 * ({x} * {x} + {z} * {z}))", f"(2 * ({y} * {z} - {w} * {x}))", f"(2 * ({x} * {z} - {w} * {y}))", f"(2 * ({y} * {z} + {w} * {x}))", f"(1 - 2 * ({x} * {x} + {y} * {y}))"]


def geodesic(a: tuple, b: tuple) -> str:
    return f"(2 * acos(least(1e0, abs({dot(a, b)}))))"


def named(exprs, names: str) -> str:
    """Rounded expressions under the names."""
    return ", ".join(f"{num(e)} AS {n}" for e, n in zip(exprs, names.split(), strict=True))


def raw(exprs, names: str) -> str:
    return ", ".join(f"{e} AS {n}" for e, n in zip(exprs, names.split(), strict=True))
