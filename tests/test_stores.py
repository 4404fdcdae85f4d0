"""Stores: reruns, changed states and contents, broken and missing files, versions and shapes."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from stridelake.sources import stores
from stridelake.sources.stores import StoreError


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, part string, x double")


ROWS = [(k, f"p{k % 3}", k / 7) for k in range(40)] + [(99, None, None)]


def test_append_and_resume(spark, tmp_path):
    path, state = str(tmp_path / "s"), {"seed": 1}
    with pytest.raises(StoreError, match="no store"):
        stores.load(spark, path, "v1")
    assert stores.publish(table(spark, ROWS[:25]), path, ["id"], "v1", state) == {"written": 25, "reused": 0}
    files = sorted(glob.glob(f"{path}/**", recursive=True))
    assert stores.publish(table(spark, ROWS[:25]), path, ["id"], "v1", state) == {"written": 0, "reused": 25}
    assert sorted(glob.glob(f"{path}/**", recursive=True)) == files  # a rerun writes nothing
    assert stores.publish(table(spark, ROWS + ROWS[:5]), path, ["id"], "v1", state, ("part",)) == {"written": 16, "reused": 25}
    assert sorted(map(tuple, stores.load(spark, path, "v1").collect()), key=str) == sorted(ROWS, key=str)
    assert [e["rows"] for e in stores.entries(spark, path)] == [25, 16]


def test_what_is_refused(spark, tmp_path):
    path, state = str(tmp_path / "s"), {"seed": 1}
    for bad, why in (([(1, "a", 0.0), (1, "a", 1.0)], "two contents"), ([(None, "a", 0.0)], "null")):
        with pytest.raises(StoreError, match=why):
            stores.publish(table(spark, bad), path, ["id"], "v1", state)
    assert stores.publish(table(spark, []), path, ["id"], "v1", state) == {"written": 0, "reused": 0} and stores.entries(spark, path) == []
    stores.publish(table(spark, ROWS), path, ["id"], "v1", state)
    for rows, version, own, why in ((ROWS, "v1", {"seed": 2}, "another state"), (ROWS, "v2", state, "format version"), ([(3, "p0", 9.0)], "v1", state, "other content")):
        with pytest.raises(StoreError, match=why):
            stores.publish(table(spark, rows), path, ["id"], version, own)
    with pytest.raises(StoreError, match="other columns"):
        stores.publish(table(spark, ROWS).withColumn("y", F.lit(1)), path, ["id"], "v1", state)
    with pytest.raises(StoreError, match="of another type: y, x"):
        stores.load(spark, path, "v1", {"y": "double", "x": "bigint", "id": "bigint"})
    assert stores.load(spark, path, "v1").count() == len(ROWS) and len(stores.entries(spark, path)) == 1


def test_broken_batches(spark, tmp_path):
    path = str(tmp_path / "s")
    stores.publish(table(spark, ROWS).repartition(3), path, ["id"], "v1", {})
    folder = stores.entries(spark, path)[0]["folder"]
    os.makedirs(f"{path}/batches/half-written")  # of a job that died: the log does not name it
    assert stores.load(spark, path, "v1").count() == len(ROWS)
    parts = sorted(glob.glob(f"{path}/batches/{folder}/*.parquet"), key=os.path.getsize, reverse=True)
    os.rename(parts[0], tmp_path / "gone")
    with pytest.raises(StoreError, match="has .* rows, declared 41"):
        stores.load(spark, path, "v1")
    os.rename(tmp_path / "gone", parts[0])
    changed = table(spark, [(i, p, None if x is None else x + (i == 5)) for i, p, x in ROWS])
    for f in glob.glob(f"{path}/batches/{folder}/*"):
        os.remove(f)
    changed.write.mode("append").parquet(f"{path}/batches/{folder}")
    with pytest.raises(StoreError, match="other content"):
        stores.load(spark, path, "v1")


def report(spark):
    dense = spark.createDataFrame([(m, name, "frame_values", f, j, f * j / 3) for m in (1, 2) for name in ("slip", "jerk") for f in range(6) for j in range(3)], "motion_id long, metric string, field string, frame long, joint long, value double")
    return spark.createDataFrame([(m, name, 1.5) for m in (1, 2) for name in ("slip", "jerk", "seam")], "motion_id long, metric string, value double"), dense


def test_report(spark, tmp_path):
    path, (summary, dense) = str(tmp_path / "r"), report(spark)
    assert stores.save_report(summary, dense, path, {})["arrays"]["written"] == 4
    assert all(v["written"] == 0 for v in stores.save_report(summary, dense, path, {}).values())
    got = stores.load_report(spark, path)
    assert [x.count() for x in got] == [6, 72]
    arrays = {(r["motion_id"], r["metric"]): (r["frames"], r["joints"]) for r in stores.load(spark, f"{path}/arrays", stores.REPORT_VERSION).collect()}
    assert set(arrays.values()) == {(6, 3)}
    stores.publish(dense.where("motion_id = 1 AND metric = 'slip'").withColumn("field", F.lit("more")), f"{path}/dense", [*stores.ARRAY, "frame", "joint"], stores.REPORT_VERSION, {})
    with pytest.raises(StoreError, match="undeclared array slip.more of 1"):
        stores.load_report(spark, path)


def test_report_faults(spark, tmp_path):
    summary, dense = report(spark)
    for k, (s, d, why) in enumerate([(summary, dense.where("frame < 5 OR motion_id = 1"), "changed array"), (summary, dense.where("metric <> 'jerk'"), "missing array jerk"), (summary.where("metric <> 'slip'"), dense, "without a summary array slip")]):
        path = str(tmp_path / f"r{k}")
        stores.publish(d, f"{path}/dense", [*stores.ARRAY, "frame", "joint"], stores.REPORT_VERSION, {})
        stores.publish(stores._declared(dense), f"{path}/arrays", stores.ARRAY, stores.REPORT_VERSION, {})
        stores.publish(s, f"{path}/summary", ["motion_id", "metric"], stores.REPORT_VERSION, {})
        with pytest.raises(StoreError, match=why):
            stores.load_report(spark, path)


def test_clips(spark, tmp_path):
    frames = spark.createDataFrame([(m, f, 60.0, "train" if m else "test", 0.1 * f) for m in range(3) for f in range(5)], "motion_id long, frame long, fps double, split string, x double")
    path = str(tmp_path / "c")
    assert stores.save_clips(frames, path, {"rig": "a"})["written"] == 15
    got = stores.load_clips(spark, path)
    assert got.where("split = 'test'").count() == 5 and sorted(map(tuple, got.collect())) == sorted(map(tuple, frames.collect()))
    assert {os.path.basename(p) for p in glob.glob(f"{path}/batches/*/split=*")} == {"split=train", "split=test"}
    with pytest.raises(StoreError, match="of another type: fps"):
        stores.publish(frames.drop("fps"), str(tmp_path / "d"), ["motion_id", "frame"], stores.CLIP_VERSION, {})
        stores.load_clips(spark, str(tmp_path / "d"))
