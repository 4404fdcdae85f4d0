"""Window and time-series operators (F1 to F21). All windows are keyed by series and ordered by frame."""

from __future__ import annotations

from stridelake.functions.quaternions import A, B, conjugate, dot, log_vector, multiply, named, num, raw
from stridelake.operators.base import operators

FD = """SELECT motion_id, frame, CASE WHEN n = 1 THEN 0e0 WHEN n = 2 THEN d01 / dt WHEN frame = 0 THEN (-3 * x + 4 * n1 - n2) / (2 * dt) WHEN frame = n - 1 THEN (3 * x - 4 * p1 + p2) / (2 * dt) ELSE (n1 - p1) / (2 * dt) END AS v FROM (
  SELECT motion_id, frame, x, 1 / 60e0 AS dt, count(*) OVER (PARTITION BY motion_id) AS n, lag(x, 1) OVER w AS p1, lag(x, 2) OVER w AS p2, lead(x, 1) OVER w AS n1, lead(x, 2) OVER w AS n2,
    coalesce((lead(x, 1) OVER w) - x, x - (lag(x, 1) OVER w)) AS d01 FROM {series} WINDOW w AS (PARTITION BY motion_id ORDER BY frame)) s"""
#: Entry implies exit, so the state is what the last frame says at which either rule speaks: the greatest 2 * frame + z so far.
HYSTERESIS = """SELECT motion_id, marker, frame, height, speed, coalesce(max(2 * frame + z) OVER (PARTITION BY motion_id, marker ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) % 2 = 1 AS active
  FROM (SELECT *, CASE WHEN height <= 0.03e0 AND speed <= 0.15e0 THEN 1 WHEN NOT (height <= 0.05e0 AND speed <= 0.25e0) THEN 0 END AS z FROM {contacts}) s"""


def runs(source: str, flag: str) -> str:
    """Half-open runs of one value of flag."""
    return f"""SELECT motion_id, marker, on_, min(frame) AS start_, max(frame) + 1 AS stop_ FROM (
  SELECT *, sum(change) OVER (PARTITION BY motion_id, marker ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (
    SELECT motion_id, marker, frame, {flag} AS on_, CASE WHEN lag({flag}) OVER (PARTITION BY motion_id, marker ORDER BY frame) = {flag} THEN 0 ELSE 1 END AS change FROM ({source}) src) c) r GROUP BY motion_id, marker, run, on_"""


RUNS = runs(HYSTERESIS, "active")
#: Runs of true shorter than 3 are dropped, then inner gaps of at most 2 are filled.
KEPT = f"SELECT motion_id, marker, start_, stop_, lead(start_) OVER (PARTITION BY motion_id, marker ORDER BY start_) AS next_start, lag(stop_) OVER (PARTITION BY motion_id, marker ORDER BY start_) AS last_stop FROM ({RUNS}) rr WHERE on_ AND stop_ - start_ >= 3"
CLEAN = f"""SELECT motion_id, marker, min(start_) AS start_, max(stop_) AS stop_ FROM (
  SELECT *, sum(CASE WHEN start_ - last_stop <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY motion_id, marker ORDER BY start_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM ({KEPT}) k) g GROUP BY motion_id, marker, grp"""
EVENTS = f"""SELECT motion_id, marker % 2 AS side, 'heel_strike' AS kind, start_ AS frame FROM ({CLEAN}) c1 WHERE start_ > 0 UNION ALL SELECT motion_id, marker % 2 AS side, 'toe_off' AS kind, stop_ AS frame FROM ({CLEAN}) c2"""
STRIKES = f"""SELECT motion_id, frame, max(side) AS side FROM (SELECT DISTINCT motion_id, side, frame FROM ({EVENTS}) ev WHERE kind = 'heel_strike') d GROUP BY motion_id, frame HAVING count(*) = 1"""
#: Strikes with their phase: a left one first has 0, a right one half a turn; the other side adds half a turn, the same side a whole one.
ANCHORS = f"""SELECT motion_id, frame, k, n, CAST(sum(again) OVER (PARTITION BY motion_id) AS BIGINT) AS repeats, 3.141592653589793e0 * sum(step) OVER (PARTITION BY motion_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phase FROM (
  SELECT motion_id, frame, row_number() OVER w AS k, count(*) OVER (PARTITION BY motion_id) AS n, CASE WHEN lag(side) OVER w = side THEN 1 ELSE 0 END AS again, CASE WHEN lag(side) OVER w IS NULL THEN side WHEN lag(side) OVER w = side THEN 2 ELSE 1 END AS step FROM ({STRIKES}) st WINDOW w AS (PARTITION BY motion_id ORDER BY frame)) s"""
#: Each frame's energy, the energy up to it, and the whole.
PREFIX = "(SELECT motion_id, frame, x * x AS e, sum(x * x) OVER (PARTITION BY motion_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(x * x) OVER (PARTITION BY motion_id) AS whole FROM {series}) p"

#: Windows of 32 frames at every 16th: each frame lies in the two that start at or before it.
SLIDING = """(SELECT w.motion_id, w.window_start, w.frame, w.x FROM (
  SELECT motion_id, frame, x, frame - frame % 16 AS window_start FROM {series} UNION ALL SELECT motion_id, frame, x, frame - frame % 16 - 16 AS window_start FROM {series} WHERE frame >= 16) w
  JOIN (SELECT motion_id, count(*) AS t FROM {series} GROUP BY motion_id) c ON w.motion_id = c.motion_id AND w.window_start + 32 <= c.t)"""

OPERATORS = operators(
    f1_finite_difference=f"SELECT motion_id, frame, {num('v')} AS v FROM ({FD}) fd",
    f2_angular_velocity=f"SELECT motion_id, frame, joint, {named([f'60 * {c}' for c in log_vector(('dw', 'dx', 'dy', 'dz'))], 'x y z')} FROM (SELECT motion_id, frame, joint, {raw(multiply(conjugate(A), B), 'dw dx dy dz')} FROM {{steps}}) s",
    f3_unwrap_signs=f"""
SELECT motion_id, frame, joint, CAST(1 - 2 * (flips % 2) AS BIGINT) AS sgn FROM (
  SELECT motion_id, frame + 1 AS frame, joint, sum(CASE WHEN {dot(A, B)} < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY motion_id, joint ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flips FROM {{steps}}) s""",
    f4_contact_hysteresis=f"SELECT motion_id, marker, frame, active FROM ({HYSTERESIS}) h",
    f5_true_intervals=f"SELECT motion_id, marker, start_ AS frame_start, stop_ AS frame_stop FROM ({RUNS}) r WHERE on_",
    f6_clean_mask=f"SELECT motion_id, marker, start_ AS frame_start, stop_ AS frame_stop FROM ({CLEAN}) c",
    f7_gait_events=f"SELECT motion_id, side, kind, frame, count(*) AS n FROM ({EVENTS}) e GROUP BY motion_id, side, kind, frame",
    f8_gait_phase=f"""
SELECT motion_id, frame, valid, {num('phase')} AS phase, {num('sin(phase)')} AS phase_sin, {num('cos(phase)')} AS phase_cos, repeats, {num('structure')} AS structure_confidence FROM (
  SELECT t.motion_id, t.frame, coalesce(c.n >= 2, false) AS valid, CASE WHEN c.n >= 2 THEN c.repeats ELSE 0 END AS repeats, CASE WHEN c.n >= 2 THEN least(1e0, (c.n - 1) / 3e0) * greatest(0e0, 1 - c.repeats / CAST(c.n - 1 AS DOUBLE)) ELSE 0e0 END AS structure,
    CASE WHEN c.n IS NULL OR c.n < 2 THEN 0e0 WHEN t.frame < c.f1 THEN c.p1 + (t.frame - c.f1) * (c.p2 - c.p1) / (c.f2 - c.f1) WHEN t.frame >= c.f9 THEN c.p9 + (t.frame - c.f9) * (c.p9 - c.p8) / (c.f9 - c.f8)
      ELSE t.pa + (t.frame - t.fa) * (t.pb - t.pa) / (t.fb - t.fa) END AS phase FROM (
    SELECT f.motion_id, f.frame, max(a.frame) OVER upto AS fa, max(a.phase) OVER upto AS pa, min(a.frame) OVER beyond AS fb, min(a.phase) OVER beyond AS pb FROM (SELECT DISTINCT motion_id, frame FROM {{contacts}}) f LEFT JOIN ({ANCHORS}) a ON a.motion_id = f.motion_id AND a.frame = f.frame
    WINDOW upto AS (PARTITION BY f.motion_id ORDER BY f.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), beyond AS (PARTITION BY f.motion_id ORDER BY f.frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) t
  LEFT JOIN (SELECT motion_id, max(n) AS n, max(repeats) AS repeats, min(frame) AS f1, min(phase) AS p1, min(CASE WHEN k = 2 THEN frame END) AS f2, min(CASE WHEN k = 2 THEN phase END) AS p2, max(frame) AS f9, max(phase) AS p9, max(CASE WHEN k = n - 1 THEN frame END) AS f8, max(CASE WHEN k = n - 1 THEN phase END) AS p8 FROM ({ANCHORS}) c0 GROUP BY motion_id) c
  ON c.motion_id = t.motion_id) p""",
    f9_robust_outliers=f"""
SELECT motion_id, frame, {num('x')} AS x, {num('threshold')} AS threshold, {num('CASE WHEN threshold < 0.1e0 THEN 0e0 ELSE x / threshold END')} AS ratio FROM (
  SELECT s.motion_id, s.frame, s.x, m.med + greatest(6 * 1.4826e0 * m.mad, 1e-3) AS threshold FROM {{series}} s JOIN (
    SELECT d.motion_id, max(d.med) AS med, percentile(abs(d.x - d.med), 0.5) AS mad FROM (SELECT a.motion_id, a.x, b.med FROM {{series}} a JOIN (SELECT motion_id, percentile(x, 0.5) AS med FROM {{series}} GROUP BY motion_id) b ON a.motion_id = b.motion_id) d GROUP BY d.motion_id) m ON s.motion_id = m.motion_id) t WHERE x > threshold""",
    f10_cycle_candidates=f"""
SELECT c.motion_id, c.side, c.frame AS frame_start, c.next_frame AS frame_stop, {num('abs(a.height - b.height) * 4 + 0.25e0 * abs(a.speed - b.speed)')} AS score FROM (
  SELECT *, lead(frame) OVER (PARTITION BY motion_id, side ORDER BY frame) AS next_frame FROM ({STRIKES}) st) c
JOIN {{contacts}} a ON a.motion_id = c.motion_id AND a.marker = c.side AND a.frame = c.frame JOIN {{contacts}} b ON b.motion_id = c.motion_id AND b.marker = c.side AND b.frame = c.next_frame WHERE c.next_frame - c.frame >= 8""",
    f11_best_cycle=f"""
SELECT motion_id, frame_start, frame_stop - 1 AS last_frame FROM (
  SELECT *, row_number() OVER (PARTITION BY motion_id ORDER BY score, frame_start, side) AS k FROM (
    SELECT c.motion_id, c.side, c.frame AS frame_start, c.next_frame AS frame_stop, round(abs(a.height - b.height) * 4 + 0.25e0 * abs(a.speed - b.speed), 9) AS score FROM (
      SELECT *, lead(frame) OVER (PARTITION BY motion_id, side ORDER BY frame) AS next_frame FROM ({STRIKES}) st) c
    JOIN {{contacts}} a ON a.motion_id = c.motion_id AND a.marker = c.side AND a.frame = c.frame JOIN {{contacts}} b ON b.motion_id = c.motion_id AND b.marker = c.side AND b.frame = c.next_frame WHERE c.next_frame - c.frame >= 8) s) r WHERE k = 1""",
    f12_sliding_windows=f"SELECT motion_id, window_start, frame, round(x, 6) AS x FROM {SLIDING} s",
    f13_canonicalize=f"""
SELECT r.motion_id, r.frame, {named(['cos(yaw) * (r.x - e.x0) - sin(yaw) * (r.z - e.z0)', 'r.y', 'sin(yaw) * (r.x - e.x0) + cos(yaw) * (r.z - e.z0)'], 'x y z')} FROM {{roots}} r JOIN (
  SELECT motion_id, x0, z0, atan2(x1 - x0, z1 - z0) AS yaw FROM (SELECT motion_id, min_by(x, frame) AS x0, max_by(x, frame) AS x1, min_by(z, frame) AS z0, max_by(z, frame) AS z1 FROM {{roots}} GROUP BY motion_id) f) e ON r.motion_id = e.motion_id""",
    f14_facing_features=f"""
SELECT r.motion_id, r.frame, {named(['cos(y.yaw) * (r.x - y.x0) - sin(y.yaw) * (r.z - y.z0)', 'sin(y.yaw) * (r.x - y.x0) + cos(y.yaw) * (r.z - y.z0)'], 'side forward')}, {num('(coalesce(lead(r.z) OVER w, r.z) - r.z) * 60')} AS forward_speed, {named(['p.x', 'p.y', 'p.z'], 'px py pz')}
FROM {{roots}} r JOIN (SELECT motion_id, min_by(x, frame) AS x0, min_by(z, frame) AS z0, atan2(max_by(x, frame) - min_by(x, frame), max_by(z, frame) - min_by(z, frame)) AS yaw FROM {{roots}} GROUP BY motion_id) y ON r.motion_id = y.motion_id
JOIN {{poses}} p ON p.motion_id = r.motion_id AND p.frame = r.frame AND p.joint = 0 WINDOW w AS (PARTITION BY r.motion_id ORDER BY r.frame)""",
    # As-of join on prefix sums: for each start, the first frame whose prefix reaches 95 of 100 of the energy from there.
    # One frame of halo; intervals under four frames grow, the odd frame to the left. A clip without energy is taken whole.
    f15_smallest_energy_interval=f"""
SELECT motion_id, CAST(CASE WHEN absent > 0 THEN greatest(0, least(t, b + floor(absent / 2e0)) - 4) ELSE a END AS BIGINT) AS start_, CAST(CASE WHEN absent > 0 THEN least(t, b + floor(absent / 2e0)) ELSE b END AS BIGINT) AS stop_ FROM (SELECT *, 4 - (b - a) AS absent FROM (
  SELECT c.motion_id, t, CASE WHEN whole <= 1e-20 OR start_ IS NULL THEN 0 ELSE greatest(0, start_ - 1) END AS a, CASE WHEN whole <= 1e-20 OR start_ IS NULL THEN t ELSE least(t, stop_ + 1) END AS b FROM (SELECT motion_id, count(*) AS t, max(whole) AS whole FROM {PREFIX} GROUP BY motion_id) c
  LEFT JOIN (SELECT motion_id, start_, stop_ FROM (SELECT *, row_number() OVER (PARTITION BY motion_id ORDER BY stop_ - start_, start_) AS k FROM (
    SELECT motion_id, kind, frame AS start_, min(CASE WHEN kind = 1 THEN frame END) OVER (PARTITION BY motion_id ORDER BY v, kind, frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1 AS stop_ FROM (
      SELECT motion_id, frame, 0 AS kind, upto - e + 0.95e0 * whole - 1e-9 * whole AS v FROM {PREFIX} UNION ALL SELECT motion_id, frame, 1 AS kind, upto AS v FROM {PREFIX}) u) s WHERE kind = 0 AND stop_ > start_) r WHERE k = 1) w ON w.motion_id = c.motion_id) h) g""",
    f16_rank_percentiles=f"""
SELECT family, sample_id, {num('(below + (same - 1) / 2e0) / greatest(1, n - 1)')} AS midrank, {num('1 / sqrt(n + 1e0)')} AS coverage FROM (
  SELECT family, sample_id, rank() OVER (PARTITION BY family ORDER BY score) - 1 AS below, count(*) OVER (PARTITION BY family, score) AS same, count(*) OVER (PARTITION BY family) AS n FROM {{scores}}) s""",
    f17_repeat_spacing="SELECT observation_id, rater, session_id, stimulus, CAST(trial - before AS BIGINT) AS gap, trial - before < 4 AS too_close FROM (SELECT *, lag(trial) OVER (PARTITION BY rater, session_id, stimulus ORDER BY trial) AS before FROM {observations}) s WHERE before IS NOT NULL",
    f18_verify_ordinal_chain=f"""
SELECT group_id, family, count(*) AS n, {num('min(severity)')} AS low, bool_and(before IS NULL OR severity > before) AS rising, count(DISTINCT mechanism) = 1 AS one_mechanism FROM (
  SELECT *, lag(severity) OVER (PARTITION BY group_id, family ORDER BY sample_id) AS before FROM {{samples}}) s GROUP BY group_id, family""",
    f19_severity_chains="SELECT source, family, count(DISTINCT band) AS bands, count(DISTINCT band) = 5 AS complete FROM {attempts} GROUP BY source, family",
    f20_localize_events="""
SELECT motion_id, greatest(CAST(0 AS BIGINT), coalesce(min(CASE WHEN x > 100 THEN frame END), CAST(0 AS BIGINT)) - 8) AS start_, least(count(*), coalesce(max(CASE WHEN x > 100 THEN frame END) + 1, count(*)) + 8) AS stop_ FROM {series} GROUP BY motion_id""",
    f21_observation_state=f"SELECT stimulus, count(*) AS n, count(DISTINCT session_id) AS sessions, max(trial) AS last_trial, {num('(max(rating) - min(rating)) / 6e0')} AS spread FROM {{observations}} GROUP BY stimulus",
)
