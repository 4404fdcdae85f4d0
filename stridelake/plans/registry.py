"""All registered queries of the library and the SQL that each must agree with."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from stridelake.operators import joins, reports, rotations, selection, statistics, transforms, validation, windows
from stridelake.operators.base import Operator, other_dialect
from stridelake.plans import extra, fixtures

FLAGSHIP = "e1_clip_report"

OPERATORS: dict[str, Operator] = {}
for _module in (rotations, validation, joins, statistics, reports, windows, selection, transforms):
    OPERATORS |= _module.OPERATORS


def _run(operator: Operator, spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator(spark, **fixtures.frames(spark, sf_dir, operator.inputs))


def queries() -> dict:
    return {k: partial(_run, op) for k, op in OPERATORS.items()} | extra.QUERIES


def _oracle(operator: Operator) -> str:
    views = []
    for name in fixtures.needed(operator.inputs):
        text = f"SELECT range AS n FROM range({fixtures.NUMBERS})" if name == "numbers" else fixtures.VIEWS[name].sql
        views.append(f"{name} AS MATERIALIZED ({text})")
    text = f"SELECT * FROM ({operator.sql}) result"
    text = f"WITH {', '.join(views)} {text}" if views else text
    for name in {*fixtures.TABLES, *fixtures.VIEWS, "numbers"}:
        text = text.replace("{" + name + "}", name)
    return other_dialect(text)


def oracle_sql() -> dict[str, str]:
    texts = {k: _oracle(op) for k, op in OPERATORS.items()}
    names = "|".join([*fixtures.TABLES, *fixtures.VIEWS])
    for k, sql in extra.TEXTS.items():
        texts[k] = _oracle(Operator(k, tuple(dict.fromkeys(re.findall(rf"\{{({names})\}}", sql))), sql))
    return texts | {"s4_stream_contacts": texts["f4_contact_hysteresis"]}
