"""User-defined metrics, mechanisms and scorers (U1 to U3): functions from DataFrame to DataFrame, held in a registry."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRIC = "motion_id long, metric string, value double, units string, confidence double"
_metrics: dict[str, Callable[[DataFrame], DataFrame]] = {}
_mechanisms: dict[str, tuple[Callable[[DataFrame, float], DataFrame], tuple[float, float]]] = {}


def register_metric(name: str, function: Callable[[DataFrame], DataFrame]) -> None:
    """function maps frames to (motion_id, value, units, confidence)."""
    _metrics[name] = function


def measure(frames: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows of the metric schema from all registered metrics, or the named ones."""
    parts = [_metrics[n](frames).select(F.col("motion_id").cast("long").alias("motion_id"), F.lit(n).alias("metric"), F.col("value").cast("double").alias("value"), "units", F.col("confidence").cast("double").alias("confidence")) for n in names or sorted(_metrics)]
    return reduce(DataFrame.unionByName, parts)


def register_mechanism(name: str, function: Callable[[DataFrame, float], DataFrame], bounds: tuple[float, float]) -> None:
    """function maps frames and a parameter within bounds to changed frames."""
    _mechanisms[name] = (function, bounds)


def inject(frames: DataFrame, name: str, parameter: float) -> DataFrame:
    function, (low, high) = _mechanisms[name]
    if not low <= parameter <= high:
        raise ValueError(f"{name}: {parameter} is not within {low} and {high}")
    return function(frames, parameter).withColumn("mechanism", F.lit(name))


def rank_with(candidates: DataFrame, scorer: Callable[[DataFrame], DataFrame], by: str, key: str) -> DataFrame:
    """Candidates of each group `by` ordered by the scores (key, score) of a user's scorer, highest first, then by key."""
    from pyspark.sql import Window

    scored = candidates.join(scorer(candidates), key, "left")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last("score"), key)))


def whitelisted(features: DataFrame, allowed: list[str], forbidden: list[str]) -> DataFrame:
    """The allowed feature columns alone; a forbidden name among them, or a missing column, is an error."""
    if leaks := sorted(set(allowed) & set(forbidden)):
        raise ValueError(f"metadata as features: {leaks}")
    if missing := sorted(set(allowed) - set(features.columns)):
        raise ValueError(f"missing features: {missing}")
    return features.select(*allowed)
