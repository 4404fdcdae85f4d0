"""The lineage of derived clips. A source is assigned once; each derivation names its parent, operation, kind and seed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.sources import scratch

KINDS = ("source", "transform", "retarget", "corruption", "repair", "slice")
STEP = ("motion_id", "parent_id", "operation", "kind", "seed")


def lineage(rows: DataFrame) -> DataFrame:
    """motion_id, source_id, split, depth, steps (from the source on) and status of rows (motion_id, parent_id, operation, kind, seed, split).

    Each row starts with its own step and takes its parent's steps, then those of the row these reach to, so a chain of n derivations is whole
    after log2(n) joins; rows that have reached a source leave the joins. The split is the source's. status: ok; unknown kind; no operation;
    source with a parent; no source (a row without a parent whose kind is not source); missing parent; other split (a derivation that states a
    split of its own); cycle; repeated id (one id with several rows; its first step stays).
    """
    own = F.struct(*STEP)
    wrong = F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind").when(F.trim(F.coalesce("operation", F.lit(""))) == "", "no operation")
    wrong = wrong.when((F.col("kind") == "source") & F.col("parent_id").isNotNull(), "source with a parent").when((F.col("kind") != "source") & F.col("parent_id").isNull(), "no source")
    known = rows.where("motion_id IS NOT NULL").groupBy("motion_id").agg(F.min(F.struct("parent_id", "operation", "kind", "seed", "split")).alias("r"), F.count(F.lit(1)).alias("n")).select("motion_id", "r.*", "n")
    known = known.select("motion_id", "split", "parent_id", F.array(own).alias("steps"), F.when(F.col("n") > 1, "repeated id").otherwise(wrong).alias("wrong"))
    there = known.select(F.col("motion_id").alias("parent_id"), F.lit(True).alias("there"))
    first = known.where("parent_id IS NULL").withColumn("jump", F.col("parent_id"))
    later = known.where("parent_id IS NOT NULL").join(there, "parent_id", "left")
    later = later.withColumns({"jump": F.when(F.col("there"), F.col("parent_id")), "wrong": F.coalesce("wrong", F.when(F.col("there").isNull(), "missing parent"))})
    columns = ["motion_id", "jump", "split", "steps", "wrong"]
    state = scratch.stored(first.select(*columns).unionByName(later.select(*columns)), "lineage")
    done, open_ = state.where("jump IS NULL"), state.where("jump IS NOT NULL")
    for _ in range(math.ceil(math.log2(max(2, state.count()))) + 1):
        if not open_.limit(1).count():
            break
        above = done.unionByName(open_).select(F.col("motion_id").alias("jump"), F.col("jump").alias("further"), F.col("split").alias("above_split"), F.col("steps").alias("above"), F.col("wrong").alias("above_wrong"))
        merged = open_.join(above, "jump").select("motion_id", F.col("further").alias("jump"), "split", "above_split", F.concat("above", "steps").alias("steps"), F.coalesce("wrong", "above_wrong").alias("wrong"))
        other = F.col("jump").isNull() & F.col("split").isNotNull() & (F.col("split") != F.coalesce("above_split", "split"))
        ended = F.when(F.col("jump").isNull(), F.col("above_split")).otherwise(F.col("split"))
        state = scratch.stored(merged.select("motion_id", "jump", ended.alias("split"), "steps", F.coalesce("wrong", F.when(other, "other split")).alias("wrong")), "lineage")
        done, open_ = done.unionByName(state.where("jump IS NULL")), state.where("jump IS NOT NULL")
    ends = done.select("motion_id", F.element_at("steps", 1)["motion_id"].alias("source_id"), "split", (F.size("steps") - 1).cast("long").alias("depth"), "steps", F.coalesce("wrong", F.lit("ok")).alias("status"))
    none = F.lit(None)
    loops = open_.select("motion_id", none.cast(rows.schema["motion_id"].dataType).alias("source_id"), none.cast("string").alias("split"), none.cast("long").alias("depth"), F.slice("steps", -1, 1).alias("steps"), F.lit("cycle").alias("status"))
    return ends.unionByName(loops)


def steps(found: DataFrame) -> DataFrame:
    """A row for each step of each clip of lineage()."""
    rows = found.select("motion_id", "source_id", "split", "status", F.posexplode("steps").alias("step", "s"))
    return rows.select("motion_id", "source_id", "split", "status", F.col("step").cast("long").alias("step"), F.col("s.motion_id").alias("ancestor_id"), "s.operation", "s.kind", "s.seed")
