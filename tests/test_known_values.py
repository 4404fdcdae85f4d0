"""Known values, null cases and invariants on small literal tables."""

import math

import pytest
from pyspark.sql import functions as F

from stridelake.operators import extend, fits, rotations, windows
from stridelake.operators.base import operators
from stridelake.plans import registry
from stridelake.sources import bvh, logs
from stridelake.streaming import logs as streams


def test_slerp_half_of_ninety_degrees(spark):
    h = math.sqrt(0.5)
    steps = spark.createDataFrame([(1, 0, 1, 1.0, 0.0, 0.0, 0.0, h, h, 0.0, 0.0)], "motion_id long, frame long, joint long, aw double, ax double, ay double, az double, bw double, bx double, by_ double, bz double")
    r = rotations.OPERATORS["b11_quat_slerp"](spark, steps=steps).first()
    assert abs(math.degrees(2 * math.acos(r["w"])) - 45) < 1e-3
    back = rotations.OPERATORS["b9_quat_geodesic"](spark, steps=steps).first()
    assert abs(math.degrees(back["angle"]) - 90) < 1e-3


def contacts(spark, heights):
    return spark.createDataFrame([(1, 0, k, h, 0.0, 1.0) for k, h in enumerate(heights)], "motion_id long, marker long, frame long, height double, speed double, qty double")


def test_hysteresis(spark):
    got = windows.OPERATORS["f4_contact_hysteresis"](spark, contacts=contacts(spark, [0.06, 0.03, 0.045, 0.06, 0.045])).orderBy("frame").collect()
    assert [r["active"] for r in got] == [False, True, True, False, False]


def test_clean_mask(spark):
    mask = [0, 1, 1, 1, 0, 1, 1, 1, 0, 0, 0, 1, 0]  # the gap of one is filled, the single frame dropped
    got = windows.OPERATORS["f6_clean_mask"](spark, contacts=contacts(spark, [0.01 if m else 0.09 for m in mask])).collect()
    assert [(r["frame_start"], r["frame_stop"]) for r in got] == [(1, 8)]


def test_finite_difference_of_a_parabola(spark):
    series = spark.createDataFrame([(1, k, k / 60, (k / 60) ** 2) for k in range(6)] + [(2, 0, 0.0, 5.0)], "motion_id long, frame long, t_s double, x double")
    got = windows.OPERATORS["f1_finite_difference"](spark, series=series).orderBy("motion_id", "frame").collect()
    assert all(abs(r["v"] - 2 * r["frame"] / 60) < 1e-5 for r in got if r["motion_id"] == 1) and got[-1]["v"] == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = contacts(spark, [0.06, 0.03, 0.045, 0.06, 0.045, 0.01]).select("motion_id", "marker", "frame", "height", "speed")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = streams.drained(streams.contact_states(stream), f"{tmp_path}/out", f"{tmp_path}/state").orderBy("frame").collect()
    assert [r["active"] for r in got] == [False, True, True, False, False, True]


def test_staircase_against_loop(spark):
    answers = ["NO", "YES", "MAYBE", "YES", "YES", "YES", "YES", "NO"] * 5
    level = 3
    for a in answers:
        level = max(0, min(5, level + {"NO": 1, "YES": -1}.get(a, 0)))
    rows = spark.createDataFrame([(1, k, a) for k, a in enumerate(answers)], "track long, step long, answer string").repartition(4)
    assert streams.staircase(rows).first()["level"] == level


def test_jeffreys_interval():
    assert abs(fits.beta_quantile(0.5, 1, 1) - 0.5) < 1e-9
    low, high = (fits.beta_quantile(q, 0.5, 10.5) for q in (0.025, 0.975))
    assert abs(fits._incomplete_beta(0.5, 10.5, high) - 0.975) < 1e-6 and low < 1e-3 and 0.2 < high < 0.24


def test_psychometric_threshold(spark):
    rows = [(1, x, "YES" if k < 100 / (1 + math.exp(-2 * (x - 2.5))) else "NO") for x in range(6) for k in range(100)]
    r = fits.psychometric(spark.createDataFrame(rows, "ladder long, level long, answer string")).first()
    assert abs(r["threshold"] - 2.5) < 0.1 and r["status"] == "ok"


def test_bvh(spark, tmp_path):
    roots = spark.createDataFrame([(1, 0, 0.1, 0.9, 0.2), (1, 1, 0.2, 0.9, 0.3)], "motion_id long, frame long, x double, y double, z double")
    bvh.bvh_text(roots).select("value").write.text(f"{tmp_path}/b")
    got = bvh.frames(spark, f"{tmp_path}/b/*.txt").orderBy("frame", "joint").collect()
    assert [(r["frame"], r["name"]) for r in got] == [(0, "hips"), (0, "spine"), (1, "hips"), (1, "spine")]
    assert abs(got[0]["root_x"] - 0.1) < 1e-6 and abs(got[0]["root_y"] - 0.91) < 1e-6 and got[1]["root_x"] is None
    assert all(abs(sum(r["q"][c] ** 2 for c in "wxyz") - 1) < 1e-9 for r in got)
    half = [math.radians(30 * v) / 2 for v in (0.2, 0.1, 0.9)]  # Z, X, Y
    assert abs(got[0]["q"]["w"] - (math.cos(half[0]) * math.cos(half[1]) * math.cos(half[2]) - math.sin(half[0]) * math.sin(half[1]) * math.sin(half[2]))) < 1e-6


def test_log_prefix(spark, tmp_path):
    (tmp_path / "log").mkdir()
    file = tmp_path / "log" / "a.jsonl"
    file.write_text('{"a":1}\n{"a":2}\n{"a"')
    frozen = logs.freeze_prefix(spark, str(tmp_path / "log")).cache()
    assert frozen.first()["rows"] == 2 and frozen.first()["bytes"] == 16
    now = lambda: spark.read.format("binaryFile").load(str(tmp_path / "log")).select("path", "content")
    file.write_text('{"a":1}\n{"a":2}\n{"a":3}\n')
    assert logs.drifted(frozen, now()).count() == 0
    file.write_text('{"a":9}\n{"a":2}\n')
    assert logs.drifted(frozen, now()).count() == 1


def test_jsonl_rejects_nan(spark, tmp_path):
    with pytest.raises(Exception, match="NaN"):
        logs.write_jsonl(spark.range(1).select(F.lit(float("nan")).alias("v")), f"{tmp_path}/x")


def test_user_functions(spark):
    frames = spark.createDataFrame([(1, 0, 0.0), (1, 1, 2.0)], "motion_id long, frame long, z double")
    extend.register_metric("range", lambda f: f.groupBy("motion_id").agg((F.max("z") - F.min("z")).alias("value")).select("motion_id", "value", F.lit("m").alias("units"), F.lit(1.0).alias("confidence")))
    assert extend.measure(frames, ["range"]).first()["value"] == 2.0
    extend.register_mechanism("up", lambda f, p: f.withColumn("z", F.col("z") + p), (0, 1))
    assert extend.inject(frames, "up", 0.5).agg(F.min("z")).first()[0] == 0.5
    with pytest.raises(ValueError):
        extend.inject(frames, "up", 3)


def test_leaks_are_errors(spark):
    df = spark.range(1).select("id", F.lit("x").alias("split"))
    assert extend.whitelisted(df, ["id"], ["split"]).columns == ["id"]
    for allowed in (["id", "split"], ["id", "more"]):
        with pytest.raises(ValueError):
            extend.whitelisted(df, allowed, ["split"])


def test_partitions_do_not_matter(spark, sf):
    series = spark.createDataFrame([(k % 3, k // 3, k / 60, float((k * 37) % 11)) for k in range(90)], "motion_id long, frame long, t_s double, x double")
    for name in ("f1_finite_difference", "i24_repair_smooth", "f15_smallest_energy_interval"):
        run = registry.OPERATORS[name]
        assert sorted(run(spark, series=series).collect()) == sorted(run(spark, series=series.repartition(7)).collect())


def test_inputs_come_from_the_text():
    assert operators(x="SELECT 1 FROM {a} JOIN {b} ON TRUE JOIN {a} c ON TRUE")["x"].inputs == ("a", "b")
