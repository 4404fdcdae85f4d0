"""Operators against plain loops that are written from the operators' rows, not from their SQL."""

import math
import random

import numpy as np
import pytest

from stridelake.operators import fits, joins, reports, rotations, statistics, validation, windows


def smooth(x):
    return x * x * (3 - 2 * x)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 40, 120])
def test_envelopes(spark, n):
    """One value for each frame, from how far it is from either end."""
    got = rotations.OPERATORS["b17_envelopes"](spark, series=spark.createDataFrame([(1, k, 0.0, 0.0) for k in range(n)], "motion_id long, frame long, t_s double, x double")).orderBy("frame").collect()
    width = n // 4 if n < 48 else 12
    for k, r in enumerate(got):
        left, right = k, n - 1 - k
        lock = math.prod(smooth(min(1.0, end / width)) for end in (left, right)) if width else 1.0
        near = min(left, right)
        if width > 1:
            edit = smooth(min(1.0, near / (width - 1)))
        else:
            edit = 0.0 if near == 0 else 1.0
        pulse = math.sin(math.pi * left / (left + right)) ** 2 if near else 0.0
        assert np.allclose([r["locks"], r["edit"], r["pulse"]], [lock, edit, pulse], atol=1e-5)


@pytest.mark.parametrize("seed", range(3))
def test_donor(spark, seed):
    draw = random.Random(seed)
    rows = [(k, draw.choice([1, 1, 1, 2, 3, 4]), "f", "m", 1.0, draw.choice(["train", "test"])) for k in range(60)] + [(99, 7, "f", "m", 1.0, "alone")]
    got = joins.OPERATORS["d17_same_split_donor"](spark, samples=spark.createDataFrame(rows, "sample_id long, group_id long, family string, mechanism string, severity double, split string"))
    want = {}
    for split in ("train", "test", "alone"):
        inside = [r for r in rows if r[5] == split]
        for p, r in enumerate(inside):
            others = [o[0] for o in inside if o[1] != r[1]]
            if others:
                want[r[0]] = others[p % len(others)]
    assert {r["sample_id"]: r["donor"] for r in got.collect()} == want


def scores(spark, rows):
    return spark.createDataFrame([(k, t, s, "en", "web", False) for k, (t, s) in enumerate(rows)], "sample_id long, target boolean, score double, family string, source string, toxic boolean")


def test_operating_point(spark):
    draw = random.Random(1)
    rows = [(True, round(draw.uniform(0.5, 1), 2)) for _ in range(60)] + [(False, round(draw.uniform(0, 0.62), 2)) for _ in range(90)]
    best = None
    for t in sorted({s for _, s in rows} | {0.0, 1.0}):
        alarm, recall = (sum(s > t for u, s in rows if u is kind) / sum(u is kind for u, _ in rows) for kind in (False, True))
        if alarm <= 0.05 and recall >= 0.8 and (best is None or (recall, -alarm, -t) > best):
            best = recall, -alarm, -t
    got = statistics.OPERATORS["e32_operating_point_sweep"](spark, scores=scores(spark, rows)).collect()
    assert best and len(got) == 1 and got[0]["status"] == "candidate_requires_review"
    assert np.allclose((got[0]["recall"], -got[0]["false_alarm"], -got[0]["tau"]), best, atol=1e-5)


def test_no_operating_point(spark):
    op = statistics.OPERATORS["e32_operating_point_sweep"]
    few = op(spark, scores=scores(spark, [(True, 0.9), (False, 0.1)])).first()
    assert few["status"] == "insufficient_held_out_human_support" and few["tau"] is None
    mixed = op(spark, scores=scores(spark, [(k % 2 == 0, 0.5) for k in range(100)])).first()
    assert mixed["status"] == "no_supported_operating_point" and mixed["tau"] is None


def test_spectral_energy(spark):
    draw, want, rows = np.random.default_rng(3), {}, []
    for clip, n in enumerate((1, 2, 17, 64)):
        x = np.cumsum(draw.normal(size=n)) + 3
        rows += [(clip, k, 0.0, float(v)) for k, v in enumerate(x)]
        t = np.arange(n)
        c = np.array([(x * np.cos(np.pi * (2 * t + 1) * k / (2 * n))).sum() * math.sqrt((1 if k == 0 else 2) / n) for k in range(n)])
        assert np.isclose((c**2).sum(), (x**2).sum())  # the transform keeps the energy
        upto = 0.0
        for place, k in enumerate(np.argsort(-(c**2)), 1):
            want[clip, int(k)] = (float(c[k]), place)
            upto += c[k] ** 2
            if upto >= 0.95 * (c**2).sum():
                break
    got = reports.OPERATORS["e50_spectral_energy"](spark, series=spark.createDataFrame(rows, "motion_id long, frame long, t_s double, x double")).collect()
    assert {(r["motion_id"], r["k"]): r["place"] for r in got} == {k: place for k, (_, place) in want.items()}
    assert all(math.isclose(r["coefficient"], want[r["motion_id"], r["k"]][0], abs_tol=1e-3) for r in got)


def test_residual_energy(spark):
    """One joint turned by 0.2 about x, one by 0.1 about y, one by 0.02 about z, in one frame of two."""
    turns = {0: (0.2, 0, 0), 1: (0, 0.1, 0), 2: (0, 0, 0.02)}
    clean = [(1, f, j, 1.0, 0.0, 0.0, 0.0) for f in (0, 1) for j in turns]
    bad = [(1, f, j, *((1.0, 0.0, 0.0, 0.0) if f else (math.cos(sum(v) / 2), *(math.sin(c / 2) for c in v)))) for f in (0, 1) for j, v in turns.items()]
    schema = "motion_id long, frame long, joint long, w double, x double, y double, z double"
    got = reports.OPERATORS["e49_residual_energy"](spark, poses=spark.createDataFrame(clean, schema), posed=spark.createDataFrame(bad, schema)).collect()
    by = {(r["joint"], r["component"], r["frame"]): r for r in got}
    assert math.isclose(by[None, None, None]["energy"], 0.0504, abs_tol=1e-4) and by[None, None, 0]["fraction"] == 1
    assert math.isclose(by[0, None, None]["fraction"], 0.04 / 0.0504, abs_tol=1e-3) and math.isclose(by[None, "y", None]["fraction"], 0.01 / 0.0504, abs_tol=1e-3)
    assert {k[:2] for k, r in by.items() if r["active"]} == {(0, "x"), (1, "y")}


def test_repair_path(spark):
    """A repair that lowers the height first raises the measure, as the speed that counts below 0.08 grows."""
    c = spark.createDataFrame([(1, 0, 0, 0.0, 0.1, 1.0), (2, 0, 0, 0.05, 1.0, 1.0)], "motion_id long, marker long, frame long, height double, speed double, qty double")
    k = spark.createDataFrame([(1, 0, 0, 0.079, 2.0), (2, 0, 0, 0.05, 2.0)], "motion_id long, marker long, frame long, height double, speed double")
    numbers = spark.range(512).withColumnRenamed("id", "n")
    got = {r["motion_id"]: r for r in reports.OPERATORS["e51_repair_path_order"](spark, contacts=c, candidate=k, numbers=numbers).collect()}
    v = [(2 + a * (0.1 - 2)) * max(0, 0.08 - 0.079 - a * (0 - 0.079)) for a in np.linspace(0, 1, 21)]
    d = np.diff(v)
    assert got[1]["inversions"] == (d > 1e-9).sum() > 0 and math.isclose(got[1]["ordered"], (d <= 1e-9).mean(), abs_tol=1e-5)
    assert math.isclose(got[1]["total"], d[d > 0].sum(), abs_tol=1e-4) and math.isclose(got[1]["largest"], d.max(), abs_tol=1e-4)
    assert got[2]["inversions"] == 0 and got[2]["ordered"] == 1 and got[2]["spearman"] == -1


def test_acceptance(spark):
    """Clip 0 needs all six bands, clip 1 four of them; one has no stance to slip, one leaves the height at its seam."""
    rows = [(0, 0, 0, 0.03, 0.16, 40.0), (0, 0, 1, 0.05, 0.16, 47.0), (1, 1, 0, 0.06, 0.3, 50.0), (1, 1, 1, 0.01, 0.02, 50.0)]
    c = spark.createDataFrame(rows, "motion_id long, marker long, frame long, height double, speed double, qty double")
    got = {r["motion_id"]: r for r in validation.OPERATORS["c5_acceptance_bands"](spark, contacts=c, numbers=spark.range(512).withColumnRenamed("id", "n")).collect()}
    # Clip 0: nothing floats (no slow frame): 1; limits: 2 over 0, relative to the least divisor.
    assert (got[0]["required"], got[0]["absent"], got[0]["outside"], got[0]["accepted"]) == (6, 1, 1, False) and math.isclose(got[0]["penalty"], 1 + 2 / 1e-6, rel_tol=1e-9)
    assert (got[1]["required"], got[1]["absent"], got[1]["outside"], got[1]["accepted"]) == (4, 0, 0, True) and got[1]["penalty"] == 0


def pairs(spark, rows):
    return spark.createDataFrame([(k, preference, family, split, *p) for k, (preference, family, split, p) in enumerate(rows)], "pair_id long, preference string, family string, split string, p_a double, p_b double, p_tie double")


def test_agreement_and_policy(spark):
    sure = (0.7, 0.2, 0.1)
    rows = [("a_better", "x", "validation", sure)] * 8 + [("b_better", "x", "validation", sure)] * 2 + [("approximately_equal", "e", "validation", sure), ("a_better", "y", "validation", sure), ("a_better", "x", "train", sure)]
    answers = spark.createDataFrame([(k, 120.0) for k in range(len(rows))], "l_orderkey long, l_quantity double")
    got = {r["family"]: r for r in reports.OPERATORS["e43_synthetic_agreement"](spark, lineitem=answers, pairs=pairs(spark, rows)).collect()}
    x = got["x"]
    assert (x["comparisons"], x["generated_agree"], x["n"], x["agree"], x["missing"], x["rate"]) == (11, 9, 10, 10, 1, 1.0)
    assert math.isclose(x["low"], 0.7224, abs_tol=1e-3) and x["high"] == 1  # 10 of 10
    policy = reports.OPERATORS["e44_human_audit_policy"]
    got = {r["family"]: r for r in policy(spark, lineitem=answers, pairs=pairs(spark, rows)).collect()}
    assert [(got[f]["policy"], got[f]["labeled"], got[f]["agree"]) for f in "xey"] == [("CERTAIN", 10, 8), ("CERTAIN", 1, 0), ("CERTAIN", 1, 1)]
    assert got["e"]["reason"] == "exact equivalence" and math.isclose(got["x"]["low"], 0.4901, abs_tol=1e-3)
    got = {r["family"]: r for r in policy(spark, lineitem=answers.where("l_orderkey <> 11"), pairs=pairs(spark, rows)).collect()}
    assert got["x"]["policy"] == "HUMAN_REQUIRED" and got["x"]["reason"] == "audit incomplete" and got["y"]["low"] is None


def test_mask_overlap(spark):
    draw = random.Random(5)
    masks = {(m, f): (draw.random() < 0.4, draw.random() < 0.4) for m in (0, 1) for f in range(30)} | {(2, 0): (False, False)}
    c = spark.createDataFrame([(m, 0, f, 0.01 if t else 0.09, 0.0, 0.0) for (m, f), (t, _) in masks.items()], "motion_id long, marker long, frame long, height double, speed double, qty double")
    k = spark.createDataFrame([(m, 0, f, 0.01 if p else 0.09, 0.0) for (m, f), (_, p) in masks.items()], "motion_id long, marker long, frame long, height double, speed double")
    for r in statistics.OPERATORS["e23_localization_f1_iou"](spark, contacts=c, candidate=k).collect():
        both = [v for (m, _), v in masks.items() if m == r["motion_id"]]
        tp, fp, fn = sum(t and p for t, p in both), sum(p and not t for t, p in both), sum(t and not p for t, p in both)
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, fn)
        assert math.isclose(r["f1"], 2 * tp / max(1, 2 * tp + fp + fn), abs_tol=1e-5) and math.isclose(r["iou"], tp / max(1, tp + fp + fn), abs_tol=1e-5)


def shortest(energy, halo=1, least=4):
    """All windows, by length and then start."""
    n, whole = len(energy), sum(energy)
    if whole <= 1e-20:
        return 0, n
    start, stop = min(((a, b) for a in range(n) for b in range(a + 1, n + 1) if sum(energy[a:b]) >= 0.95 * whole * (1 - 1e-9)), key=lambda w: (w[1] - w[0], w[0]))
    start, stop = max(0, start - halo), min(n, stop + halo)
    for k in range(max(0, least - (stop - start))):
        start, stop = (max(0, start - 1), stop) if k % 2 == 0 else (start, min(n, stop + 1))
    return max(0, min(start, stop - least)), stop


def test_smallest_interval(spark):
    draw, clips = random.Random(7), [[0.0, 0.0, 9.0, 0.0, 0.0, 0.0, 0.0], [9.0, 0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 9.0], [1.0], [0.0] * 6]
    clips += [[draw.choice([0.0, 0.0, 1.0, 5.0, 30.0]) for _ in range(12)] for _ in range(8)]
    rows = [(m, f, 0.0, math.sqrt(e)) for m, clip in enumerate(clips) for f, e in enumerate(clip)]
    got = windows.OPERATORS["f15_smallest_energy_interval"](spark, series=spark.createDataFrame(rows, "motion_id long, frame long, t_s double, x double")).collect()
    assert {r["motion_id"]: (r["start_"], r["stop_"]) for r in got} == {m: shortest(clip) for m, clip in enumerate(clips)}


def turns(q):
    """Rotation vectors from each quaternion to the next one."""
    out = []
    for (w, *u), (v, *t) in zip(q, q[1:], strict=False):
        d = np.array([w * v + np.dot(u, t), *(w * np.array(t) - v * np.array(u) - np.cross(u, t))])
        d = -d if d[0] < 0 else d
        n = np.linalg.norm(d[1:])
        out.append(2 * math.atan2(n, d[0]) / n * d[1:] if n > 1e-12 else 2 * d[1:])
    return np.array(out).reshape(-1, 3)


@pytest.mark.parametrize("frames", [1, 2, 3, 4, 60])
def test_angular_smoothness(spark, frames):
    draw = np.random.default_rng(frames)
    poses, rows = {}, []
    for joint in range(3):
        angle = np.cumsum(draw.normal(0, 0.02, (frames, 4)), 0) + [1, 0, 0, 0]
        angle[frames // 2 : frames // 2 + 2, 1] += 0.4 * (joint == 1)
        poses[joint] = angle / np.linalg.norm(angle, axis=1, keepdims=True)
        rows += [(1, f, joint, *map(float, poses[joint][f])) for f in range(frames)]
    df = spark.createDataFrame(rows, "motion_id long, frame long, joint long, w double, x double, y double, z double")
    jerk = {}
    for joint, q in poses.items():
        v = 60 * turns(q)
        v = np.concatenate([v, v[-1:]]) if len(v) else np.zeros((1, 3))
        for _ in range(2):
            v = np.zeros_like(v) if frames == 1 else np.gradient(v, 1 / 60, axis=0, edge_order=min(2, frames - 1))
        jerk[joint] = np.linalg.norm(v, axis=1)
    everything = np.concatenate(list(jerk.values()))
    got = reports.OPERATORS["e5_angular_smoothness"](spark, poses=df).first()
    assert np.allclose([got["jerk_p99"], got["jerk_median"], got["jerk_max"]], [np.percentile(everything, 99), np.median(everything), everything.max()], rtol=1e-6, atol=2e-3)
    want = []
    for joint, x in jerk.items():
        bound = np.median(x) + max(6 * 1.4826 * np.median(np.abs(x - np.median(x))), 1e-3)
        start = None
        for f in range(frames + 1):
            over = f < frames and x[f] > bound
            if over and start is None:
                start = f
            if not over and start is not None:
                want.append((joint, "joint_jitter" if f - start > max(5, frames // 8) else "joint_pop", start, f, x[start:f].max()))
                start = None
    found = sorted((r["joint"], r["event"], r["start_"], r["stop_"], r["severity"]) for r in reports.OPERATORS["e5_smoothness_events"](spark, poses=df).collect())
    assert [f[:4] for f in found] == [w[:4] for w in sorted(want)] and np.allclose([f[4] for f in found], [w[4] for w in sorted(want)], rtol=1e-6)
    assert frames < 60 or found


def test_repair_effect(spark):
    rows = [(1, "slip", 2.0, 1.0, 0.5), (2, "slip", 2.0, 0.55, 0.5), (3, "slip", 0.5, 0.5, 0.5), (4, "slip", 2.0, 3.0, 0.5), (5, "slip", 1.0, 0.9995, 2.0)]
    got = {r["motion_id"]: (r["repaired"], r["meaningful"], r["near_clean"]) for r in reports.OPERATORS["e52_repair_effect"](spark, repairs=spark.createDataFrame(rows, "motion_id long, metric string, before double, after double, clean double")).collect()}
    assert got == {1: (round(1 / 1.5, 6), True, False), 2: (round(1.45 / 1.5, 6), True, True), 3: (None, False, True), 4: (round(-1 / 1.5, 6), False, False), 5: (None, False, False)}


def product(a, b):
    return np.array([a[0] * b[0] - np.dot(a[1:], b[1:]), *(a[0] * b[1:] + b[0] * a[1:] + np.cross(a[1:], b[1:]))])


def axis_turn(axis, degrees_):
    half = math.radians(degrees_) / 2
    q = np.zeros(4)
    q[0], q[1 + "xyz".index(axis)] = math.cos(half), math.sin(half)
    return q


def test_joint_limits(spark):
    """Poses are built from the angles that the coordinates must give back."""
    draw = random.Random(9)
    schema = "joint long, representation string, w double, x double, y double, z double, lo0 double, hi0 double, lo1 double, hi1 double, lo2 double, hi2 double, valid boolean, confidence double, axis_confidence double"
    limits, rows, angle, beyond = [], [], {}, {}
    for joint in range(6):
        rest = product(axis_turn("x", 30 * joint), axis_turn("z", 50))
        kind = "euler_xyz" if joint % 2 else "swing_twist"
        bounds = [-20.0, 25.0, None if joint == 4 else -15.0, 18.0, -30.0, 30.0]
        limits.append((joint, kind, *map(float, rest), *bounds, joint != 5, 0.8, 0.5 if joint else 1.0))
        for f in range(40):
            a = [draw.uniform(-60, 60) if 10 < f < 30 else draw.uniform(-10, 10) for _ in range(3)]
            if kind == "euler_xyz":
                q = product(product(axis_turn("x", a[0]), axis_turn("y", a[1])), axis_turn("z", a[2]))
            else:
                v = np.radians([a[0], 0, a[1]])
                n = np.linalg.norm(v)
                q = product(np.array([math.cos(n / 2), *(math.sin(n / 2) * v / n)]), axis_turn("y", a[2]))
            angle[joint, f] = a
            q = product(rest, q) * draw.choice([1, -1]) * draw.choice([1, 2.5])
            rows.append((1, f, joint, *map(float, q)))
            if joint < 4:
                beyond[joint, f] = [max(0, bounds[2 * k] - a[k], a[k] - bounds[2 * k + 1]) for k in range(3)]
    poses = spark.createDataFrame(rows, "motion_id long, frame long, joint long, w double, x double, y double, z double")
    given = {"poses": poses, "limits": spark.createDataFrame(limits, schema)}
    for r in rotations.OPERATORS["b13_limit_coordinates"](spark, **given).collect():
        assert np.allclose([r["first_deg"], r["second_deg"], r["third_deg"]], angle[r["joint"], r["frame"]], atol=1e-5)
    worst = {k: max(v) for k, v in beyond.items()}
    got = reports.OPERATORS["e8_joint_limits"](spark, **given).first()
    want = [max(worst.values()), np.mean([v > 1e-6 for v in worst.values()]), sum(worst.values()) / 60, 6, 4, 4 / 6, np.mean([0.8, 0.4, 0.4, 0.4]) * 4 / 6]
    assert np.allclose(list(got)[1:], want, atol=1e-4)
    events = []
    for joint in range(4):
        start = None
        for f in range(41):
            over = f < 40 and worst[joint, f] > 1e-6
            if over and start is None:
                start = f
            if not over and start is not None:
                part = np.array([beyond[joint, k] for k in range(start, f)])
                peak = int(part.argmax())
                events.append((joint, start, f, part.max(), start + peak // 3, peak % 3, part.max(1).sum() / 60))
                start = None
    found = sorted((r["joint"], r["start_"], r["stop_"], r["severity"], r["peak_frame"], r["peak_channel"], r["degree_seconds"]) for r in reports.OPERATORS["e8_limit_events"](spark, **given).collect())
    assert np.allclose(found, sorted(events), atol=1e-4) and len(found) > 4
    none = reports.OPERATORS["e8_joint_limits"](spark, poses=poses, limits=given["limits"].where("joint > 3")).first()
    assert none["degrees_beyond"] is None and none["confidence"] == 0 and none["valid_joints"] == 0


def test_schedule_over_all_rows(spark):
    """One family fills the first places; the greedy pass over all items finds those of other families behind it."""
    draw = random.Random(3)
    rows = [(rater, k, 0 if k < 200 else draw.randrange(1, 6)) for rater in range(3) for k in range(260) for _ in range(1 if k < 200 else draw.choice([2, 3]))]
    got = {}
    for r in fits.query_schedule(spark.createDataFrame(rows, "rater long, stimulus long, family long")).collect():
        got.setdefault(r["rater"], []).append((r["place"], r["stimulus"], r["family"]))
    for rater in range(3):
        seen = {}
        for _, k, family in (r for r in rows if r[0] == rater):
            seen[k, family] = seen.get((k, family), 0) + 1
        order, picked = sorted(seen, key=lambda x: (seen[x], *x)), []
        while len(picked) < 12:
            best = next((x for x in order if x not in picked and sum(p[1] == x[1] for p in picked) < 4 and x[1] not in {p[1] for p in picked[-2:]}), None)
            if best is None:
                break
            picked.append(best)
        assert sorted(got[rater]) == [(n + 1, *x) for n, x in enumerate(picked)] and len({x[1] for x in picked}) > 1
