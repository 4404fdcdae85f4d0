"""BVH motion text to joints and frames (A1)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = "path string, joint int, name string, parent int, ox double, oy double, oz double, channel string, place int, frames int, frame_time double"


def _header(text: str) -> list[tuple]:
    """Rows of one file's hierarchy: a row for each channel; joints without channels are end sites and have none."""
    names, rows, open_, at, tokens = [], [], [], 0, text.split("MOTION")[0].split()
    offsets: list[list[float]] = []
    place, k = 0, 0
    while k < len(tokens):
        t = tokens[k]
        if t in ("ROOT", "JOINT", "End"):
            names.append(tokens[k + 1])
            offsets.append([0.0] * 3)
            open_.append((len(names) - 1, open_[-1][0] if open_ else -1, t))
            k += 2
        elif t == "OFFSET":
            offsets[open_[-1][0]] = [float(x) for x in tokens[k + 1 : k + 4]]
            k += 4
        elif t == "CHANNELS":
            n = int(tokens[k + 1])
            joint, parent, kind = open_[-1]
            for c in tokens[k + 2 : k + 2 + n]:
                if c.endswith("position") and kind != "ROOT":
                    raise ValueError(f"position channel on {names[joint]}")
                rows.append((joint, names[joint], parent, *offsets[joint], c, place))
                place += 1
            k += 2 + n
        else:
            if t == "}":
                open_.pop()
            k += 1
    motion = text.split("MOTION")[1].split("\n")
    at = next(x for x in motion if x.strip().startswith("Frames"))
    dt = next(x for x in motion if x.strip().startswith("Frame Time"))
    return [(*r, int(at.split(":")[1]), float(dt.split(":")[1])) for r in rows]


def channels(spark: SparkSession, path: str) -> DataFrame:
    """One row for each channel of each file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *r) for p, c in zip(batch["path"], batch["content"], strict=True) for r in _header(bytes(c).decode())]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHANNELS.split(", ")])

    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content").mapInPandas(parse, CHANNELS)


def frames(spark: SparkSession, path: str, scale: float = 0.01) -> DataFrame:
    """path, frame, joint, name, the joint's quaternion in its declared channel order, and the root's position in metres."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    motion = F.split(F.regexp_extract(F.decode("content", "UTF-8"), r"(?s)Frame Time:[^\n]*\n(.*)", 1), "\n")
    lines = files.select("path", F.posexplode(F.filter(motion, lambda x: F.trim(x) != "")).alias("frame", "line"))
    values = lines.select("path", "frame", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("place", "value"))
    known = values.join(channels(spark, path), ["path", "place"]).withColumn("value", F.col("value").cast("double"))
    half = F.radians("value") / 2
    axis = F.lower(F.substring("channel", 1, 1))
    turn = F.struct(F.col("place"), F.cos(half).alias("w"), *[F.when(axis == a, F.sin(half)).otherwise(0.0).alias(a) for a in "xyz"])
    turns = F.sort_array(F.collect_list(F.when(F.col("channel").endswith("rotation"), turn)))
    unit = F.struct(F.lit(1.0).alias("w"), *[F.lit(0.0).alias(a) for a in "xyz"])

    def product(a, b):
        w, x, y, z = (a[c] for c in "wxyz")
        i, j, k, m = (b[c] for c in "wxyz")
        return F.struct((w * i - x * j - y * k - z * m).alias("w"), (w * j + x * i + y * m - z * k).alias("x"), (w * k - x * m + y * i + z * j).alias("y"), (w * m + x * k - y * j + z * i).alias("z"))

    place = [F.max(F.when(F.col("channel") == f"{a.upper()}position", (F.col("value") + F.col(f"o{a}")) * scale)).alias(f"root_{a}") for a in "xyz"]
    grouped = known.groupBy("path", "frame", "joint", "name").agg(turns.alias("turns"), *place)
    return grouped.select("path", "frame", "joint", "name", F.aggregate("turns", unit, product).alias("q"), "root_x", "root_y", "root_z")


def bvh_text(roots: DataFrame) -> DataFrame:
    """A small BVH file (root and one joint) for each clip of roots (motion_id, frame, x, y, z); a clip is one row of text."""
    header = "HIERARCHY\nROOT hips\n{\nOFFSET 0 1 0\nCHANNELS 6 Xposition Yposition Zposition Zrotation Xrotation Yrotation\nJOINT spine\n{\nOFFSET 0 10 0\nCHANNELS 3 Zrotation Xrotation Yrotation\nEnd Site\n{\nOFFSET 0 5 0\n}\n}\n}\nMOTION\n"
    number = lambda c: F.format_string("%.6f", c)
    line = F.concat_ws(" ", *[number(F.col(c) * 100) for c in "xyz"], *[number(F.col(c) * 30) for c in ("z", "x", "y", "y", "z", "x")])
    body = roots.groupBy("motion_id").agg(F.sort_array(F.collect_list(F.struct("frame", line.alias("line")))).alias("rows"))
    return body.select("motion_id", F.concat(F.lit(header + "Frames: "), F.size("rows").cast("string"), F.lit("\nFrame Time: 0.0166667\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("value"))
