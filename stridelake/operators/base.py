"""An operator is a SQL text over named inputs; it runs on any DataFrames of these schemas.

The texts keep to the SQL that Spark and other engines share, so that an oracle engine can run them on the same tables.
The few functions whose names differ are listed in NAMES.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Spark's name: the name in DuckDB.
NAMES = {"percentile": "quantile_cont", "unix_micros": "epoch_us", "element_at": "list_extract", "collect_list": "list", "array_size": "len"}
#: An average that a threshold is applied to: exact in Spark, avg in the other engine.
EXACT = "exact_avg"


def _counted(sql: str) -> str:
    """count_if(x) as count(CASE WHEN x THEN 1 END), whose type is the same in both engines."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def _calls(sql: str, name: str, to: Callable[[str], str]) -> str:
    """Each call name(x) as to(x)."""
    while (found := re.search(rf"\b{name}\(", sql)) is not None:
        end, depth = found.end(), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[: found.start()]}{to(sql[found.end() : end - 1])}{sql[end:]}"
    return sql


def _exact(x: str) -> str:
    """The average of x added as decimals, which no order of the rows changes; of doubles that are no such decimals the plain one."""
    d = f"try_cast({x} AS DECIMAL(38, 20))"
    return f"CASE WHEN count({d}) = count({x}) THEN coalesce(CAST(try_avg({d}) AS DOUBLE), avg({x})) ELSE avg({x}) END"


def spark_dialect(sql: str) -> str:
    return _calls(sql, EXACT, _exact)


def other_dialect(sql: str) -> str:
    sql = _calls(_counted(sql), EXACT, lambda x: f"avg({x})")
    for ours, theirs in NAMES.items():
        sql = re.sub(rf"\b{ours}\(", f"{theirs}(", sql)
    return re.sub(r"\bsha2\((.*?), 256\)", r"sha256(\1)", sql)


@dataclass(frozen=True)
class Operator:
    """row: the operator's key. inputs: names of the DataFrames that the text reads."""

    row: str
    inputs: tuple[str, ...]
    sql: str

    def __call__(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        return spark.sql(spark_dialect(self.sql), **{k: frames[k] for k in self.inputs})


def operators(**texts: str) -> dict[str, Operator]:
    """Operators from texts, their inputs being the names in braces."""
    return {k: Operator(k, tuple(dict.fromkeys(re.findall(r"\{(\w+)\}", v))), v.strip()) for k, v in texts.items()}
