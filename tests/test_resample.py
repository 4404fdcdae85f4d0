"""Resampling and gait phase against loops."""

import math
import random

import numpy as np
import pytest

from stridelake.operators import resample, windows


def blend(a, b, u):
    d = float(np.dot(a, b))
    b, d = (-b, -d) if d < 0 else (b, d)
    if d > 0.9995:
        q = a + u * (b - a)
    else:
        w = math.acos(min(1.0, d))
        q = (math.sin((1 - u) * w) * a + math.sin(u * w) * b) / math.sin(w)
    return q / np.linalg.norm(q)


@pytest.mark.parametrize(("frames", "target"), [(1, 24.0), (2, 24.0), (31, 24.0), (31, 100.0), (31, 30.0), (31, 60.0)])
def test_motion(spark, frames, target):
    draw = np.random.default_rng(frames)
    q = draw.normal(size=(2, frames, 4)) if frames < 31 else np.cumsum(draw.normal(0, 0.1, (2, frames, 4)), 1) + [1, 0, 0, 0]
    root = draw.normal(size=(frames, 3))
    poses = spark.createDataFrame([(5, f, j, *map(float, q[j, f])) for j in range(2) for f in range(frames)], "motion_id long, frame long, joint long, w double, x double, y double, z double")
    roots = spark.createDataFrame([(5, f, *map(float, root[f])) for f in range(frames)], "motion_id long, frame long, x double, y double, z double")
    new_poses, new_roots = resample.resampled_motion(poses, roots, 60.0, target)
    got = {(r["frame"], r["joint"]): np.array([r[c] for c in "wxyz"]) for r in new_poses.collect()}
    moved = {r["frame"]: [r[c] for c in "xyz"] for r in new_roots.collect()}
    if target == 60.0:
        assert len(got) == 2 * frames
        return
    count = math.floor((frames - 1) / 60 * target + 1e-9) + 1
    assert set(moved) == set(range(count)) and len(got) == 2 * count
    unit = q / np.linalg.norm(q, axis=2, keepdims=True)
    for n in range(count):
        at = n / target * 60
        left = min(math.floor(at + 1e-9), frames - 1)
        right, u = min(left + 1, frames - 1), at - left
        assert np.allclose(moved[n], root[left] + (root[right] - root[left]) * u, atol=1e-6)
        for j in range(2):
            want = blend(unit[j, left], unit[j, right], u)
            assert min(np.abs(got[n, j] - want).max(), np.abs(got[n, j] + want).max()) < 1e-6
    with pytest.raises(ValueError):
        resample.resampled_motion(poses, roots, 60.0, 0.0)


def test_series_of_odd_times(spark):
    draw = random.Random(1)
    rows = [(k, float(t), draw.random()) for k in range(4) for t in sorted(draw.sample(range(1000), 12) if k else [7])]
    got = {(r["motion_id"], r["frame"]): r["x"] for r in resample.resampled_series(spark.createDataFrame(rows, "motion_id long, t_s double, x double"), 0.05).collect()}
    want = {}
    for k in range(4):
        t, x = np.array([r[1] for r in rows if r[0] == k]), np.array([r[2] for r in rows if r[0] == k])
        for n in range(math.floor((t[-1] - t[0]) * 0.05 + 1e-9) + 1):
            want[k, n] = np.interp(t[0] + n * 20, t, x)
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_gait_phase(spark):
    """Contacts of 4 frames at the given strikes of side 0 and 1; marker 0 is the left heel, marker 1 the right one."""
    clips = {1: [(5, 0), (15, 1), (25, 0), (40, 0), (55, 1)], 2: [(8, 1), (20, 0)], 3: [(9, 0)], 4: [(6, 0), (6, 1), (16, 1), (30, 0)], 5: []}
    rows = []
    for m, strikes in clips.items():
        for f in range(70):
            for side in (0, 1):
                near = any(s == side and k <= f < k + 4 for k, s in strikes)
                rows.append((m, side, f, 0.0 if near else 1.0, 0.0 if near else 1.0))
    got = {(r["motion_id"], r["frame"]): r for r in windows.OPERATORS["f8_gait_phase"](spark, contacts=spark.createDataFrame(rows, "motion_id long, marker long, frame long, height double, speed double")).collect()}
    for m, strikes in clips.items():
        kept = [(f, s) for f, s in strikes if len({b for a, b in strikes if a == f}) == 1]
        frames, sides = [f for f, _ in kept], [s for _, s in kept]
        anchors, repeats = [], 0
        for k, s in enumerate(sides):
            if not k:
                anchors.append(math.pi * s)
            else:
                repeats += s == sides[k - 1]
                anchors.append(anchors[-1] + math.pi * (2 if s == sides[k - 1] else 1))
        for f in range(70):
            r = got[m, f]
            assert r["valid"] == (len(kept) >= 2)
            if len(kept) < 2:
                assert r["phase"] == 0 and r["structure_confidence"] == 0
                continue
            if f < frames[0]:
                want = anchors[0] + (f - frames[0]) * (anchors[1] - anchors[0]) / (frames[1] - frames[0])
            elif f > frames[-1]:
                want = anchors[-1] + (f - frames[-1]) * (anchors[-1] - anchors[-2]) / (frames[-1] - frames[-2])
            else:
                want = np.interp(f, frames, anchors)
            assert abs(r["phase"] - want) < 1e-5 and abs(r["phase_sin"] - math.sin(want)) < 1e-5
            assert r["repeats"] == repeats and abs(r["structure_confidence"] - min(1, (len(kept) - 1) / 3) * max(0, 1 - repeats / (len(kept) - 1))) < 1e-6


def test_no_frame_to_the_end(spark):
    """A window frame from each row to the end of its series takes work of the square of the series."""
    plan = resample.between(spark.createDataFrame([(1, 0.0, 1.0)], "k long, t double, x double"), ["k"], ["x"], 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "RowFrame, 1, unboundedfollowing" not in plan


@pytest.mark.parametrize(("start", "rate"), [(0.0, 24.0), (1.7e9, 1000.0), (-5.25, 3.0)])
def test_rows_before_and_after_against_a_loop(spark, start, rate):
    """Rows at one time, at a point's own time, long gaps, a time of null; one series of a single row."""
    draw = random.Random(start)
    rows = [(k, start + draw.choice([draw.random(), draw.randrange(24) / 24, draw.randrange(48) / rate]), float(n)) for k in range(3) for n in range(40)]
    rows += [(0, start + 9.0, -1.0), (3, start, 5.0), (1, None, 7.0)]
    got = {(r["k"], r["n"]): (r["t"], tuple(r["before"]), r["after"] and tuple(r["after"])) for r in resample.between(spark.createDataFrame(rows, "k long, t double, x double").repartition(3), ["k"], ["x"], rate).collect()}
    want = {}
    for k in range(4):
        own = sorted((t, x) for key, t, x in rows if key == k and t is not None)
        for n in range(math.floor((own[-1][0] - own[0][0]) * rate + 1e-9) + 1):
            t = own[0][0] + n / rate
            want[k, n] = (t, max(r for r in own if r[0] <= t), min((r for r in own if r[0] > t), default=None))
    assert got == want
