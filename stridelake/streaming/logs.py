"""Stream forms of the judgment logs and of contact state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ENTER, LEAVE = (0.03, 0.15), (0.05, 0.25)
STATE = "active boolean, last long"
CONTACTS = "motion_id long, marker long, frame long, active boolean, late boolean"


def unique_observations(stream: DataFrame, key: str = "observation_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """An append-only log without repeated ids; the watermark bounds the ids that are kept."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def amended(primary: DataFrame, later: DataFrame, delay: str = "1 hour") -> DataFrame:
    """S3: each primary judgment (observation_id, rater, stimulus, ts) with its inspection, if one follows within a day."""
    a = primary.withWatermark("ts", delay)
    b = later.select(F.col("rater").alias("r"), F.col("stimulus").alias("s"), F.col("ts").alias("at"), F.col("rating").alias("amended")).withWatermark("at", delay)
    return a.join(b, F.expr("rater = r AND stimulus = s AND at > ts AND at <= ts + INTERVAL 1 DAY"), "left_outer")


def contact_states(stream: DataFrame) -> DataFrame:
    """Contact state of frames (motion_id, marker, frame, height, speed) as they come; a frame behind its series' last is late."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, last = state.get if state.exists else (False, -1)
        got = pd.concat(list(batches)).sort_values("frame", kind="stable")
        out = []
        for frame, height, speed in zip(got["frame"], got["height"], got["speed"], strict=True):
            late = frame <= last
            if not late:
                bound = LEAVE if active else ENTER
                active, last = bool(height <= bound[0] and speed <= bound[1]), int(frame)
            out.append((*key, frame, None if late else active, late))
        state.update((active, last))
        yield pd.DataFrame(out, columns=["motion_id", "marker", "frame", "active", "late"])

    return stream.groupBy("motion_id", "marker").applyInPandasWithState(step, CONTACTS, STATE, "append", GroupStateTimeout.NoTimeout)


def staircase(responses: DataFrame, top: int = 5, start: int = 3) -> DataFrame:
    """Level after each track's responses (track, step, answer) in order: up on NO, down on YES, clamped to 0 .. top.

    A step is x -> min(hi, max(lo, x + c)), and steps compose to a step of that form, so a track folds in any grouping; here one
    fold over the ordered answers of a track does.
    """
    ordered = responses.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("step", "answer"))).alias("rows"))
    move = lambda level, r: F.greatest(F.lit(0), F.least(F.lit(top), level + F.when(r["answer"] == "NO", 1).when(r["answer"] == "YES", -1).otherwise(0)))
    return ordered.select("track", F.size("rows").alias("responses"), F.aggregate("rows", F.lit(start), move).alias("level"))


def drained(stream: DataFrame, out: str, checkpoint: str, provider: str | None = None) -> DataFrame:
    """Runs the stream over what there is, into Parquet, and reads the result. provider: the state store for this stream alone."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    try:
        if provider:
            spark.conf.set(key, provider)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
