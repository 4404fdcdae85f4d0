"""Forward kinematics as one fold over the rig's joints for each frame.

A frame's pose is gathered into one array (one shuffle by clip and frame; a frame has as many rows as the rig has joints),
the rig comes along as one broadcast row, and the fold walks the joints in depth order, so each finds its parent's place done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Q, P = ("w", "x", "y", "z"), ("px", "py", "pz")


def _multiply(a: tuple, b: tuple) -> tuple:
    w, x, y, z = a
    i, j, k, m = b
    return (w * i - x * j - y * k - z * m, w * j + x * i + y * m - z * k, w * k - x * m + y * i + z * j, w * m + x * k - y * j + z * i)


def _cross(a: tuple, b: tuple) -> tuple:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _rotate(q: tuple, v: tuple) -> tuple:
    once = _cross(q[1:], v)
    twice = _cross(q[1:], once)
    return tuple(v[k] + 2 * q[0] * once[k] + 2 * twice[k] for k in range(3))


def _fields(s: Column, names: tuple) -> tuple:
    return tuple(s[n] for n in names)


def _named(values: tuple, names: tuple) -> list[Column]:
    return [v.alias(n) for v, n in zip(values, names, strict=True)]


def world(poses: DataFrame, roots: DataFrame, joints: DataFrame) -> DataFrame:
    """motion_id, frame, joint, world rotation and position. A frame that lacks a joint gives null for it and what hangs on it."""
    order = Window.orderBy("depth", "joint")  # over the rig alone
    placed = joints.withColumn("at", F.row_number().over(order) - 1)
    parents = placed.select(F.col("joint").alias("parent"), F.col("at").alias("parent_at"))
    placed = placed.join(parents, "parent", "left")
    rig = placed.agg(F.sort_array(F.collect_list(F.struct("at", "joint", F.coalesce("parent_at", F.lit(-1)).alias("parent_at"), "ox", "oy", "oz"))).alias("rig"))
    frames = poses.groupBy("motion_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct("joint", F.struct(*Q)))).alias("pose"))
    frames = frames.join(roots.select("motion_id", "frame", *[F.col(c).alias(f"p{c}") for c in "xyz"]), ["motion_id", "frame"]).crossJoin(F.broadcast(rig))  # one row of rig
    empty = F.array().cast("array<struct<joint:bigint,w:double,x:double,y:double,z:double,px:double,py:double,pz:double>>")

    def step(done: Column, j: Column) -> Column:
        own = _fields(F.try_element_at("pose", j["joint"]), Q)
        up = F.get(done, j["parent_at"])
        turn, shift = _fields(up, Q), _fields(up, P)
        moved = _rotate(turn, _fields(j, ("ox", "oy", "oz")))
        root = j["parent_at"] < 0
        q = tuple(F.when(root, a).otherwise(b) for a, b in zip(own, _multiply(turn, own), strict=True))
        p = tuple(F.when(root, F.col(n)).otherwise(s + m) for n, s, m in zip(P, shift, moved, strict=True))
        return F.array_append(done, F.struct(j["joint"].cast("bigint").alias("joint"), *_named(q, Q), *_named(p, P)))

    found = frames.select("motion_id", "frame", F.explode(F.aggregate("rig", empty, step)).alias("j"))
    return found.select("motion_id", "frame", "j.*")


def markers(places: DataFrame, offset: tuple[float, float, float]) -> DataFrame:
    """motion_id, frame, marker, x, y, z of markers fixed to joints at one offset in the joint's frame."""
    moved = _rotate(tuple(F.col(c) for c in Q), tuple(map(F.lit, offset)))
    return places.select("motion_id", "frame", F.col("joint").alias("marker"), *[(F.col(n) + m).alias(c) for n, m, c in zip(P, moved, "xyz", strict=True)])
