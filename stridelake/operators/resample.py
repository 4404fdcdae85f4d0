"""Series and clips on another time grid, by an as-of merge: known rows are sorted, a window carries the row that follows to each of
them, and a row makes the grid points from its own time up to that one. One shuffle and one sort by series, no range join; the work grows
with the rows and points of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE, TINY = 0.9995, 1e-12


def between(known: DataFrame, keys: list[str], values: list[str], rate: float) -> DataFrame:
    """Grid points (keys, n, t) of each series of known rows (keys, t, values), with the rows before (at or before t) and after.

    The grid has floor(duration * rate + 1e-9) + 1 points, n / rate from the first row on; a last part of an interval gets no point.
    `after` is null past the last row. Of rows at one time the last by their values counts.
    """
    series, row = Window.partitionBy(*keys), F.struct("t", *values)
    pairs = known.where("t IS NOT NULL").select(*keys, "t", row.alias("before"), F.lead(row).over(series.orderBy("t", row)).alias("after"), F.min("t").over(series).alias("from"), F.max("t").over(series).alias("to"))
    at = lambda t: F.floor((t - F.col("from")) * rate)
    # Points at most this far from where the product says they are, as sums of floats are rounded; the exact bounds are in the last filter.
    slack = 1 + F.floor(F.greatest(F.abs("from"), F.abs("to")) * rate * 1e-15)
    last = F.floor((F.col("to") - F.col("from")) * rate + 1e-9)
    low, high = F.greatest(F.lit(0), at(F.col("t")) - slack), F.when(F.col("after").isNull(), last).otherwise(F.least(last, at(F.col("after.t")) + slack))
    points = pairs.where("after IS NULL OR t < after.t").withColumns({"low": low, "high": high}).where("low <= high").withColumn("n", F.explode(F.sequence("low", "high")))
    found = points.select(*keys, "n", F.col("t").alias("since"), (F.col("from") + F.col("n") / rate).alias("t"), "before", "after")
    return found.where("t >= since AND (after IS NULL OR t < after.t)").drop("since")


def fraction() -> Column:
    """How far a point is from its row before to the one after."""
    return F.when(F.col("after").isNull(), 0.0).otherwise((F.col("t") - F.col("before.t")) / (F.col("after.t") - F.col("before.t")))


def resampled_series(series: DataFrame, rate: float, value: str = "x") -> DataFrame:
    """motion_id, frame and value of series (motion_id, t_s, value) at rate, linear between rows."""
    found = between(series.select("motion_id", F.col("t_s").alias("t"), value), ["motion_id"], [value], rate)
    a, b = F.col(f"before.{value}"), F.coalesce(F.col(f"after.{value}"), F.col(f"before.{value}"))
    return found.select("motion_id", F.col("n").alias("frame"), (a + (b - a) * fraction()).alias(value))


def slerp(a: list[Column], b: list[Column], u: Column) -> list[Column]:
    """Along the shorter arc of two unit quaternions; nearly equal ones are blended and scaled."""
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    sign, size = F.when(dot < 0, -1.0).otherwise(1.0), F.least(F.abs(dot), F.lit(1.0))
    angle = F.acos(size)
    sine = F.when(F.sin(angle) < TINY, 1.0).otherwise(F.sin(angle))
    one = F.when(size > CLOSE, 1 - u).otherwise(F.sin((1 - u) * angle) / sine)
    two = F.when(size > CLOSE, u).otherwise(F.sin(u * angle) / sine) * sign
    mixed = [one * x + two * y for x, y in zip(a, b, strict=True)]
    norm = F.sqrt(sum((m * m for m in mixed), F.lit(0.0)))
    return [m / norm for m in mixed]


def resampled_motion(poses: DataFrame, roots: DataFrame, fps: float, target: float) -> tuple[DataFrame, DataFrame]:
    """Poses (motion_id, frame, joint, w, x, y, z) and roots (motion_id, frame, x, y, z) at another frame rate: rotations by SLERP, roots
    linear. An equal rate gives the clip back; a clip of one frame keeps it."""
    if not target > 0 or target == float("inf"):
        raise ValueError("the target rate must be finite and positive")
    if abs(target - fps) <= 1e-12:
        return poses, roots
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in "wxyz"), F.lit(0.0)))
    unit = poses.select("motion_id", "joint", (F.col("frame") / fps).alias("t"), *[(F.col(c) / norm).alias(c) for c in "wxyz"])
    turned = between(unit, ["motion_id", "joint"], list("wxyz"), target)
    ends = [[F.col(f"before.{c}") for c in "wxyz"], [F.coalesce(F.col(f"after.{c}"), F.col(f"before.{c}")) for c in "wxyz"]]
    moved = between(roots.select("motion_id", (F.col("frame") / fps).alias("t"), "x", "y", "z"), ["motion_id"], list("xyz"), target)
    line = lambda c: F.col(f"before.{c}") + (F.coalesce(F.col(f"after.{c}"), F.col(f"before.{c}")) - F.col(f"before.{c}")) * fraction()
    new_poses = turned.select("motion_id", F.col("n").alias("frame"), "joint", *[q.alias(c) for q, c in zip(slerp(*ends, fraction()), "wxyz", strict=True)])
    return new_poses, moved.select("motion_id", F.col("n").alias("frame"), *[line(c).alias(c) for c in "xyz"])
