"""Averages that are compared with a threshold: the exact one, whatever the order of the rows."""

import random

import pytest

from stridelake.operators import reports, validation

SCHEMA = "motion_id long, marker long, frame long, height double, speed double, qty double"


def orders():
    """Speeds of average 0.16 in two orders: added one by one, one ends above it and the other below."""
    draw, found = random.Random(4), {}
    while len(found) < 2:
        half = [4 * draw.randrange(9) / 100 for _ in range(40)]
        speeds = [v for a in half for v in (a, round(0.32 - a, 2))]
        draw.shuffle(speeds)
        total = 0.0
        for v in speeds:
            total += v
        if total / len(speeds) != 0.16:
            found.setdefault(total / len(speeds) > 0.16, speeds)
    return found[True], found[False]


def frame(spark, clips, partitions):
    rows = [(m, 0, k, 0.0, v, 10.0) for m, speeds in clips.items() for k, v in enumerate(speeds)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions) if partitions > 1 else spark.createDataFrame(rows, SCHEMA).coalesce(1)


@pytest.mark.parametrize("partitions", [1, 4])
def test_hard_constraints_at_the_threshold(spark, partitions):
    above, below = orders()
    clips = {1: above, 2: below, 3: [*above, 0.1600001], 4: [*above, 0.1599999], 5: [*above, float("nan")], 6: [*above, float("inf")], 7: [1e300] * 10, 8: [*above, 1e-30], 9: [9e17] * 200}
    got = {r["motion_id"]: r["reasons"] for r in validation.OPERATORS["c6_hard_constraint_reasons"](spark, contacts=frame(spark, clips, partitions)).collect()}
    assert {m for m, reasons in got.items() if reasons == "target speed"} == {3, 5, 6, 7, 9} and len(got) == len(clips)


@pytest.mark.parametrize("partitions", [1, 4])
def test_failure_classes_at_the_threshold(spark, partitions):
    above, below = orders()
    contacts = frame(spark, {1: above, 2: below, 3: [*above, 0.1600001], 4: [*above, 0.17], 5: [*below, 0.1]}, partitions).selectExpr("motion_id", "marker", "frame", "CASE WHEN motion_id = 4 OR motion_id = 1 THEN 0.1D ELSE 0D END AS height", "speed", "qty")
    got = reports.OPERATORS["e59_failure_classes"](spark, contacts=contacts, numbers=spark.range(8).withColumnRenamed("id", "n"))
    assert {r["cause"]: r["n"] for r in got.collect()} == {"height": 1, "speed": 1, "budget": 0, "none": 3}
