"""Clip metrics, dataset audits and judgment reports."""

from __future__ import annotations

from stridelake.functions.quaternions import A, B, conjugate, log_vector, multiply, num, raw
from stridelake.operators.base import operators
from stridelake.operators.rotations import COORDINATES
from stridelake.operators.windows import CLEAN, EVENTS, FD, HYSTERESIS

SLIDES = f"""(SELECT motion_id, marker, start_, max(frame) + 1 AS stop_, sum(step) AS slip FROM (
  SELECT c.motion_id, c.marker, c.start_, f.frame, f.speed / 60 * least(1 - f.height, coalesce(lead(1 - f.height) OVER (PARTITION BY c.motion_id, c.marker, c.start_ ORDER BY f.frame), 0e0)) AS step
  FROM ({CLEAN}) c JOIN {{contacts}} f ON c.motion_id = f.motion_id AND c.marker = f.marker AND f.frame >= c.start_ AND f.frame < c.stop_) s GROUP BY motion_id, marker, start_)"""
PER_CLIP = f"""SELECT motion_id, 'height_max' AS metric, max(height) AS value FROM ({HYSTERESIS}) h WHERE active GROUP BY motion_id UNION ALL SELECT motion_id, 'contact_share' AS metric, avg(CASE WHEN active THEN 1e0 ELSE 0e0 END) AS value FROM ({HYSTERESIS}) h2 GROUP BY motion_id
  UNION ALL SELECT motion_id, 'speed_mean' AS metric, avg(speed) AS value FROM {{contacts}} GROUP BY motion_id UNION ALL SELECT motion_id, 'slip' AS metric, max(slip) AS value FROM {SLIDES} sl GROUP BY motion_id
  UNION ALL SELECT motion_id, 'strikes' AS metric, CAST(count(*) AS DOUBLE) AS value FROM ({EVENTS}) ev WHERE kind = 'heel_strike' GROUP BY motion_id"""
FIRST_TWO = "(SELECT rater, task, stimulus, max(CASE WHEN k = 1 THEN rating END) AS a, max(CASE WHEN k = 2 THEN rating END) AS b FROM (SELECT *, row_number() OVER (PARTITION BY rater, task, stimulus ORDER BY observation_id) AS k FROM {observations}) o WHERE k <= 2 GROUP BY rater, task, stimulus HAVING count(*) = 2)"
VELOCITY = f"(SELECT motion_id, frame, joint, {raw(log_vector(('dw', 'dx', 'dy', 'dz')), 'ex ey ez')} FROM (SELECT motion_id, frame, joint, {raw(multiply(conjugate(A), B), 'dw dx dy dz')} FROM {{steps}}) d)"
#: Angular velocity in rad/s of every frame: of the turn to the next frame, at the last frame that of the one before.
SPIN = f"""(SELECT motion_id, frame, joint, {raw(tuple(f'60e0 * coalesce({e}, 0e0)' for e in log_vector(('dw', 'dx', 'dy', 'dz'))), 'ex ey ez')} FROM (SELECT motion_id, frame, joint, {raw(multiply(conjugate(A), B), 'dw dx dy dz')} FROM (
  SELECT motion_id, frame, joint, {', '.join(f'CASE WHEN nw IS NULL THEN p{c} ELSE {c} END AS a{c}, CASE WHEN nw IS NULL THEN {c} ELSE n{c} END AS {b}' for c, b in zip('wxyz', B, strict=True))} FROM (
    SELECT *, {', '.join(f'lead({c}) OVER p AS n{c}, lag({c}) OVER p AS p{c}' for c in 'wxyz')} FROM {{poses}} WINDOW p AS (PARTITION BY motion_id, joint ORDER BY frame)) n) t) v)"""


def differences(source: str, columns: str) -> str:
    """Second-order finite differences at 60 frames a second of each joint's columns."""
    value = lambda c: f"CASE WHEN n < 2 THEN 0e0 WHEN n = 2 THEN 60e0 * coalesce({c}1 - {c}, {c} - {c}9) WHEN {c}9 IS NULL THEN 30e0 * (4 * {c}1 - 3 * {c} - {c}2) WHEN {c}1 IS NULL THEN 30e0 * (3 * {c} - 4 * {c}9 + {c}8) ELSE 30e0 * ({c}1 - {c}9) END"
    near = ", ".join(f"lead({c}) OVER w AS {c}1, lead({c}, 2) OVER w AS {c}2, lag({c}) OVER w AS {c}9, lag({c}, 2) OVER w AS {c}8" for c in columns.split())
    return f"(SELECT motion_id, frame, joint, {', '.join(f'{value(c)} AS {c}' for c in columns.split())} FROM (SELECT *, count(*) OVER (PARTITION BY motion_id, joint) AS n, {near} FROM {source} s WINDOW w AS (PARTITION BY motion_id, joint ORDER BY frame)) d)"


#: Size of the angular jerk of every frame and joint.
JERK = f"SELECT motion_id, frame, joint, sqrt(ex * ex + ey * ey + ez * ez) AS jerk FROM {differences(differences(SPIN, 'ex ey ez'), 'ex ey ez')} jj"


def rounded(x: str, digits: int) -> str:
    return f"round({x}, {digits}) + 0e0"


#: A limit counts if it is switched on, has all its bounds, and both it and the joint's axes are trusted.
VALID = "valid AND lo0 + hi0 + lo1 + hi1 + lo2 + hi2 IS NOT NULL AND confidence > 0 AND axis_confidence > 0"
#: Degrees outside the bounds of each channel and of all, for joints whose limit counts. The window keeps planners from copying the
#: coordinates' long expressions into each place that reads them.
BEYOND = f"(SELECT motion_id, frame, joint, representation, trust, v0, v1, v2, greatest(v0, v1, v2) AS beyond FROM (SELECT *, {', '.join(f'greatest(0e0, lo{k} - c{k}, c{k} - hi{k}) AS v{k}' for k in range(3))} FROM (SELECT *, count(*) OVER (PARTITION BY motion_id, joint) AS frames FROM {COORDINATES} c WHERE valid) w) o)"
#: The rotation that repairs each joint: the logarithm of the turn from the corrupted pose to the clean one.
RESIDUAL = f"(SELECT motion_id, frame, joint, {raw(log_vector(('dw', 'dx', 'dy', 'dz')), 'ex ey ez')} FROM (SELECT motion_id, frame, joint, {raw(multiply(conjugate(A), B), 'dw dx dy dz')} FROM (SELECT p.motion_id, p.frame, p.joint, k.w AS aw, k.x AS ax, k.y AS ay, k.z AS az, p.w AS bw, p.x AS bx, p.y AS by_, p.z AS bz FROM {{poses}} p JOIN {{posed}} k ON p.motion_id = k.motion_id AND p.frame = k.frame AND p.joint = k.joint) b) d)"
ENERGY = f"(SELECT motion_id, frame, joint, ex * ex + ey * ey + ez * ez AS energy FROM {VELOCITY} v)"

#: One human answer for each pair that was shown.
ANSWERS = "(SELECT CAST(l_orderkey AS BIGINT) AS pair_id, CASE WHEN sum(l_quantity) > 100 THEN 'a_better' WHEN sum(l_quantity) > 60 THEN 'b_better' ELSE 'approximately_equal' END AS answer FROM {lineitem} GROUP BY l_orderkey)"


def wilson(k: str, n: str) -> str:
    """Columns low and high: the 95 % interval of k successes in n, null where n is 0."""
    p, z = f"({k} / CAST({n} AS DOUBLE))", "1.96e0 * 1.96e0"
    ends = [num(f"least(1e0, greatest(0e0, ({p} + {z} / (2 * {n}) {sign} 1.96e0 * sqrt({p} * (1 - {p}) / {n} + {z} / (4e0 * {n} * {n}))) / (1 + {z} / {n})))") for sign in "-+"]
    return f"CASE WHEN {n} > 0 THEN {ends[0]} END AS low, CASE WHEN {n} > 0 THEN {ends[1]} END AS high"


OPERATORS = operators(
    e1_clip_report=f"""
SELECT motion_id, {', '.join(f"{num(f'''max(CASE WHEN metric = '{m}' THEN value END)''')} AS {m}" for m in ('height_max', 'contact_share', 'speed_mean', 'slip', 'strikes'))}, count(*) AS metrics FROM ({PER_CLIP}) m GROUP BY motion_id""",
    e2_root_speed=f"SELECT motion_id, {num('avg(abs(v))')} AS mean_speed, {num('percentile(abs(v), 0.5)')} AS median_speed, {num('abs(avg(abs(v)) - 100) / greatest(100e0, 1e-6)')} AS relative_error, abs(avg(abs(v)) - 100) > 2 AS mismatch FROM ({FD}) f GROUP BY motion_id",
    e3_foot_sliding=f"SELECT motion_id, {num('100 * max(slip)')} AS slip_cm, count_if(100 * slip > 0.05e0) AS slides FROM {SLIDES} s GROUP BY motion_id",
    e4_ground_contact=f"SELECT motion_id, {num('100 * max(greatest(0e0, 0.02e0 - height))')} AS penetration_cm, {num('100 * max(greatest(0e0, height - 0.02e0))')} AS floating_cm, count(*) AS frames FROM ({HYSTERESIS}) h WHERE active GROUP BY motion_id",
    e5_angular_smoothness=f"SELECT motion_id, {rounded('percentile(jerk, 0.99)', 3)} AS jerk_p99, {rounded('percentile(jerk, 0.5)', 3)} AS jerk_median, {rounded('max(jerk)', 3)} AS jerk_max FROM ({JERK}) j GROUP BY motion_id",
    e5_smoothness_events=f"""
SELECT motion_id, joint, CASE WHEN stop_ - start_ > greatest(5, CAST(floor(frames / 8e0) AS BIGINT)) THEN 'joint_jitter' ELSE 'joint_pop' END AS event, start_, stop_, {rounded('peak', 3)} AS severity, {rounded('bound', 3)} AS threshold, 0.75e0 AS confidence FROM (
  SELECT motion_id, joint, min(frame) AS start_, max(frame) + 1 AS stop_, max(jerk) AS peak, max(bound) AS bound, max(frames) AS frames FROM (
    SELECT *, frame - row_number() OVER (PARTITION BY motion_id, joint ORDER BY frame) AS run FROM (
      SELECT *, middle + greatest(6 * 1.4826e0 * percentile(abs(jerk - middle), 0.5) OVER (PARTITION BY motion_id, joint), 1e-3) AS bound FROM (
        SELECT *, percentile(jerk, 0.5) OVER (PARTITION BY motion_id, joint) AS middle, count(*) OVER (PARTITION BY motion_id, joint) AS frames FROM ({JERK}) j) m) b WHERE jerk > bound) r GROUP BY motion_id, joint, run) e""",
    e6_loop_seam=f"SELECT motion_id, CASE WHEN score < 1e-6 THEN 0e0 ELSE {num('score')} END AS seam, score > 1e-4 AS event FROM (SELECT motion_id, 4 * (abs(max_by(x, frame) - min_by(x, frame)) + abs(max_by(y, frame) - min_by(y, frame))) + 0.25e0 * abs(max_by(z, frame) - min_by(z, frame)) AS score FROM {{roots}} GROUP BY motion_id) s",
    e7_gait_metrics=f"""
SELECT motion_id, count(*) AS strikes, {num('avg(60e0 * 60 / gap)')} AS cadence, {num('avg(gap / 60e0)')} AS step_time, {num('avg(CASE WHEN side <> before THEN 1e0 ELSE 0e0 END)')} AS alternation FROM (
  SELECT motion_id, side, frame - lag(frame) OVER w AS gap, lag(side) OVER w AS before FROM (SELECT DISTINCT motion_id, side, frame FROM ({EVENTS}) e WHERE kind = 'heel_strike') d WINDOW w AS (PARTITION BY motion_id ORDER BY frame, side)) s WHERE gap > 0 GROUP BY motion_id""",
    e8_joint_limits=f"""
SELECT t.motion_id, {num('v.worst')} AS degrees_beyond, {num('coalesce(v.outside, 0e0)')} AS violating_fraction, {num('coalesce(v.integrated, 0e0)')} AS degree_seconds, l.configured, l.valid_joints, {num('l.valid_joints / CAST(t.joints AS DOUBLE)')} AS coverage, {num('CASE WHEN l.valid_joints > 0 THEN l.trust * l.valid_joints / l.configured ELSE 0e0 END')} AS confidence
FROM (SELECT motion_id, count(DISTINCT joint) AS joints FROM {{poses}} GROUP BY motion_id) t CROSS JOIN (SELECT count(*) AS configured, count_if({VALID}) AS valid_joints, avg(CASE WHEN {VALID} THEN confidence * axis_confidence END) AS trust FROM {{limits}}) l
LEFT JOIN (SELECT motion_id, max(beyond) AS worst, avg(CASE WHEN beyond > 1e-6 THEN 1e0 ELSE 0e0 END) AS outside, sum(beyond) / 60e0 AS integrated FROM {BEYOND} b GROUP BY motion_id) v ON v.motion_id = t.motion_id""",
    e8_limit_events=f"""
SELECT motion_id, joint, representation, min(frame) AS start_, max(frame) + 1 AS stop_, {num('max(beyond)')} AS severity, {num('max(trust)')} AS confidence, min(CASE WHEN beyond = peak THEN frame END) AS peak_frame, min(CASE WHEN beyond = peak THEN frame * 3 + CASE WHEN v0 = beyond THEN 0 WHEN v1 = beyond THEN 1 ELSE 2 END END) % 3 AS peak_channel, {num('sum(beyond) / 60e0')} AS degree_seconds FROM (
  SELECT *, max(beyond) OVER (PARTITION BY motion_id, joint, run) AS peak FROM (
    SELECT *, sum(change) OVER (PARTITION BY motion_id, joint ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (
      SELECT *, CASE WHEN lag(beyond > 1e-6) OVER (PARTITION BY motion_id, joint ORDER BY frame) = (beyond > 1e-6) THEN 0 ELSE 1 END AS change FROM {BEYOND} b) c) r) p WHERE peak > 1e-6 GROUP BY motion_id, joint, representation, run""",
    e9_normalization_fit=f"SELECT channel, count(*) AS n, {num('avg(v)')} AS mean, {num('greatest(1e-6, sqrt(greatest(0e0, avg(v * v) - avg(v) * avg(v))))')} AS scale FROM (SELECT 'x' AS channel, x AS v FROM {{roots}} WHERE motion_id % 10 < 7 UNION ALL SELECT 'y' AS channel, y AS v FROM {{roots}} WHERE motion_id % 10 < 7 UNION ALL SELECT 'z' AS channel, z AS v FROM {{roots}} WHERE motion_id % 10 < 7) c GROUP BY channel",
    e10_normalization_apply=f"SELECT r.motion_id, r.frame, {num('(r.x - s.mx) / greatest(1e-6, s.sx)')} AS x, {num('(r.y - s.my) / greatest(1e-6, s.sy)')} AS y, {num('r.z')} AS z FROM {{roots}} r CROSS JOIN (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM {{roots}} WHERE motion_id % 10 < 7) s",
    e11_audit_breakdowns=f"""
SELECT coalesce(family, 'all') AS family, coalesce(band, 'all') AS band, count(*) AS attempted, count_if(accepted) AS accepted, {num('count_if(accepted) / CAST(count(*) AS DOUBLE)')} AS fraction, count_if(NOT accepted AND reason = 'O') AS reason_o, count_if(NOT accepted AND reason = 'F') AS reason_f FROM {{attempts}} GROUP BY GROUPING SETS ((), (family), (band), (family, band))""",
    e12_quantiles=f"SELECT family, count(*) AS n, {num('min(severity)')} AS low, {num('percentile(severity, 0.1)')} AS p10, {num('percentile(severity, 0.5)')} AS p50, {num('percentile(severity, 0.9)')} AS p90, {num('max(severity)')} AS high, {num('avg(severity)')} AS mean FROM {{attempts}} GROUP BY family",
    e13_dataset_diagnostics="""
SELECT m.mechanism, b.band, coalesce(c.n, 0) AS n, coalesce(c.sources, 0) AS sources FROM (SELECT DISTINCT mechanism FROM {attempts}) m JOIN (SELECT CASE n WHEN 0 THEN 'near_threshold' WHEN 1 THEN 'subtle' WHEN 2 THEN 'moderate' WHEN 3 THEN 'clear' WHEN 4 THEN 'severe' ELSE 'extreme' END AS band FROM {numbers} WHERE n < 6) b ON b.band IS NOT NULL
LEFT JOIN (SELECT mechanism, band, count(*) AS n, count(DISTINCT source) AS sources FROM {attempts} GROUP BY mechanism, band) c ON m.mechanism = c.mechanism AND b.band = c.band""",
    e14_rating_distribution=f"SELECT r.rating, count(o.observation_id) AS n, {num('count(o.observation_id) / CAST(max(t.whole) AS DOUBLE)')} AS share FROM (SELECT CAST(n AS BIGINT) AS rating FROM {{numbers}} WHERE n BETWEEN 1 AND 8) r LEFT JOIN {{observations}} o ON o.rating = r.rating CROSS JOIN (SELECT count(*) AS whole FROM {{observations}}) t GROUP BY r.rating",
    e15_difficulty_summary=f"SELECT coalesce(task, 'all') AS task, coalesce(family, -1) AS family, count(*) AS n, {num('avg(CASE WHEN rating <= 2 THEN 1e0 ELSE 0e0 END)')} AS easy, {num('avg(CASE WHEN rating >= 6 THEN 1e0 ELSE 0e0 END)')} AS difficult FROM {{observations}} GROUP BY GROUPING SETS ((), (task), (family))",
    e17_notice_report=f"SELECT ladder, count(*) AS n, {num('avg(CASE WHEN level = 0 AND answer = ' + chr(39) + 'YES' + chr(39) + ' THEN 1e0 WHEN level = 0 THEN 0e0 END)')} AS false_alarms, {num('avg(CASE WHEN level >= 4 AND answer = ' + chr(39) + 'NO' + chr(39) + ' THEN 1e0 WHEN level >= 4 THEN 0e0 END)')} AS misses, count_if(answer = 'MAYBE') AS maybe FROM {{ladder}} GROUP BY ladder",
    e33_repeat_metrics=f"SELECT task, count(*) AS pairs, {num('avg(CASE WHEN a = b THEN 1e0 ELSE 0e0 END)')} AS exact, {num('avg(abs(a - b))')} AS mean_difference FROM {FIRST_TWO} f GROUP BY task",
    e34_inspection_usage=f"SELECT rater, task, count(*) AS n, {num('sum(response_ms)')} AS wall_ms, {num('sum(response_ms) / sum(sum(response_ms)) OVER (PARTITION BY rater)')} AS share FROM {{observations}} GROUP BY rater, task",
    e35_anchor_drift=f"SELECT rater, session_id, count(*) AS n, {num('regr_slope(rating, trial)')} AS slope FROM {{observations}} WHERE stimulus % 10 = 0 GROUP BY rater, session_id HAVING count(*) >= 3",
    e36_swap_consistency="""
SELECT rater, sum(forth * back) AS swaps, sum(forth_lo * back_lo + forth_hi * back_hi + (forth - forth_lo - forth_hi) * (back - back_lo - back_hi)) AS agree FROM (
  SELECT rater, lo, hi, count_if(chosen_first IS NOT NULL AND first_lo) AS forth, count_if(chosen_first IS NOT NULL AND NOT first_lo) AS back,
    count_if(first_lo AND chosen_first = 1) AS forth_lo, count_if(first_lo AND chosen_first = -1) AS forth_hi, count_if(NOT first_lo AND chosen_first = -1) AS back_lo, count_if(NOT first_lo AND chosen_first = 1) AS back_hi FROM (
    SELECT rater, least(stimulus, second) AS lo, greatest(stimulus, second) AS hi, stimulus < second AS first_lo, CASE WHEN rating < 4 THEN 1 WHEN rating > 4 THEN -1 ELSE 0 END AS chosen_first FROM {observations} WHERE task = 'pair') o
  GROUP BY rater, lo, hi) p WHERE forth > 0 AND back > 0 GROUP BY rater""",
    e37_transitivity="""
WITH wins AS (SELECT DISTINCT rater, CASE WHEN rating > 3 THEN stimulus ELSE second END AS winner, CASE WHEN rating > 3 THEN second ELSE stimulus END AS loser FROM {observations} WHERE task = 'pair' AND stimulus <> second AND rating <> 4),
edges AS (SELECT rater, least(winner, loser) AS a, greatest(winner, loser) AS b, max(CASE WHEN winner < loser THEN 1 ELSE 0 END) AS up FROM wins GROUP BY rater, least(winner, loser), greatest(winner, loser))
SELECT x.rater, count(*) AS triples, count_if((x.up = 1 AND y.up = 1 AND z.up = 0) OR (x.up = 0 AND y.up = 0 AND z.up = 1)) AS cyclic_ FROM edges x JOIN edges y ON x.rater = y.rater AND x.b = y.a JOIN edges z ON x.rater = z.rater AND x.a = z.a AND y.b = z.b GROUP BY x.rater""",
    e38_severity_order_accuracy=f"""
SELECT l.rater, {num('sum(l.n * r.n * CASE WHEN l.rating < r.rating THEN 1e0 WHEN l.rating = r.rating THEN 0.5e0 ELSE 0e0 END) / sum(l.n * r.n)')} AS accuracy FROM (SELECT rater, family, rating, count(*) AS n FROM {{observations}} GROUP BY rater, family, rating) l JOIN (SELECT rater, family, rating, count(*) AS n FROM {{observations}} GROUP BY rater, family, rating) r ON l.rater = r.rater AND l.family < r.family GROUP BY l.rater""",
    e39_family_perceptibility=f"SELECT family, n, score, CAST(rank() OVER (ORDER BY score DESC, family) AS BIGINT) AS place FROM (SELECT family, count(*) AS n, {num('(avg(rating) / 7 + count_if(rating >= 6) / CAST(count(*) AS DOUBLE)) / 2')} AS score FROM {{observations}} GROUP BY family HAVING count(DISTINCT rater) >= 3) s",
    e40_protocol_quality=f"SELECT CASE WHEN trial % 2 = 0 THEN 'fixed' ELSE 'free' END AS protocol, count(*) AS n, {num('avg(response_ms)')} AS response_ms, {num('stddev_pop(rating)')} AS spread FROM {{observations}} GROUP BY CASE WHEN trial % 2 = 0 THEN 'fixed' ELSE 'free' END",
    e41_reliability_breakdown=f"SELECT f.stimulus % 5 AS family, count(*) AS pairs, {num('avg(CASE WHEN f.a = f.b THEN 1e0 ELSE 0e0 END)')} AS agreement FROM {FIRST_TWO} f GROUP BY f.stimulus % 5",
    e42_needs_more_judgments=f"SELECT stimulus, {num('1 / (n + 1e0) + width + (hi - lo) / 6e0')} AS priority FROM (SELECT stimulus, count(*) AS n, 1.96e0 * stddev_pop(rating) / sqrt(count(*)) AS width, max(rating) AS hi, min(rating) AS lo FROM {{observations}} GROUP BY stimulus) s ORDER BY round(1 / (n + 1e0) + width + (hi - lo) / 6e0, 9) DESC, stimulus LIMIT 20",
    e43_synthetic_agreement=f"""
SELECT family, comparisons, generated_agree, n, agree, CASE WHEN n > 0 THEN {num('agree / CAST(n AS DOUBLE)')} END AS rate, {wilson('agree', 'n')}, missing FROM (
  SELECT p.family, count(*) AS comparisons, count_if(h.answer = p.preference) AS generated_agree, count(d.predicted) AS n, count_if(h.answer = d.predicted) AS agree, count_if(d.predicted IS NULL) AS missing FROM {ANSWERS} h JOIN {{pairs}} p ON p.pair_id = h.pair_id
  LEFT JOIN (SELECT pair_id, CASE WHEN p_a > p_b AND p_a > p_tie THEN 'a_better' WHEN p_b > p_tie THEN 'b_better' ELSE 'approximately_equal' END AS predicted FROM {{pairs}} WHERE split <> 'train') d ON d.pair_id = h.pair_id GROUP BY p.family) s""",
    e44_human_audit_policy=f"""
SELECT family, required, labeled, agree, CASE WHEN labeled > 0 THEN {num('agree / CAST(labeled AS DOUBLE)')} END AS agreement, {wilson('agree', 'labeled')}, CASE WHEN equivalent OR confirmed THEN 'CERTAIN' ELSE 'HUMAN_REQUIRED' END AS policy,
  CASE WHEN equivalent THEN 'exact equivalence' WHEN confirmed THEN 'audit confirms the order' WHEN remaining > 0 THEN 'audit incomplete' ELSE 'no automatic order or too little agreement' END AS reason FROM (
  SELECT *, remaining = 0 AND labeled > 0 AND certain > 0 AND agree >= 0.7e0 * labeled AS confirmed FROM (
    SELECT *, sum(required - labeled) OVER () AS remaining FROM (
      SELECT p.family, count(*) AS required, count(h.answer) AS labeled, count_if(h.answer = p.preference) AS agree, bool_and(p.preference = 'approximately_equal') AS equivalent, count_if(greatest(p.p_a, p.p_b, p.p_tie) >= 0.6e0) AS certain
      FROM {{pairs}} p LEFT JOIN {ANSWERS} h ON p.pair_id = h.pair_id WHERE p.split = 'validation' GROUP BY p.family) f) g) s""",
    e45_preference_eval=f"SELECT split, count_if(preference <> 'approximately_equal') AS directional, {num(chr(10) + 'avg(CASE WHEN preference = ' + chr(39) + 'a_better' + chr(39) + ' THEN CASE WHEN p_a > p_b THEN 1e0 ELSE 0e0 END WHEN preference = ' + chr(39) + 'b_better' + chr(39) + ' THEN CASE WHEN p_b > p_a THEN 1e0 ELSE 0e0 END END)')} AS accuracy, count_if(preference = 'approximately_equal' AND abs(p_a / (p_a + p_b) - 0.5e0) > 0.1e0) AS false_preference FROM {{pairs}} GROUP BY split",
    e46_comparator_readiness="SELECT coalesce(p.family, 'unexpected') AS family, count(p.pair_id) AS expected, count(q.o_orderkey) AS predicted, count_if(p.pair_id IS NULL) AS unexpected, count_if(q.o_orderkey IS NULL) AS missing FROM (SELECT * FROM {pairs} WHERE source % 11 <> 0) p FULL OUTER JOIN (SELECT o_orderkey FROM {orders} WHERE o_custkey % 13 <> 0) q ON p.pair_id = q.o_orderkey GROUP BY coalesce(p.family, 'unexpected')",
    e47_ordinal_vs_direct=f"""
SELECT d.family, count(*) AS n, count_if((d.rating > 4) = (a.quality > b.quality)) AS agree, {num('avg(CASE WHEN abs(a.quality - b.quality) <= a.width + b.width THEN 1e0 ELSE 0e0 END)')} AS overlap FROM {{observations}} d
JOIN (SELECT stimulus, avg(rating) AS quality, 1.96e0 * stddev_pop(rating) / sqrt(count(*)) AS width FROM {{observations}} WHERE task <> 'pair' GROUP BY stimulus) a ON d.stimulus = a.stimulus JOIN (SELECT stimulus, avg(rating) AS quality, 1.96e0 * stddev_pop(rating) / sqrt(count(*)) AS width FROM {{observations}} WHERE task <> 'pair' GROUP BY stimulus) b ON d.second = b.stimulus
WHERE d.task = 'pair' AND d.rating <> 4 GROUP BY d.family""",
    e48_completion_audit="SELECT rater, count(DISTINCT stimulus) AS done, count(DISTINCT stimulus) = 60 AS complete FROM {observations} WHERE observation_id % 97 <> 0 GROUP BY rater",
    e49_residual_energy=f"""
SELECT motion_id, joint, component, frame, round(energy, 4) AS energy, CASE WHEN total > 0 THEN round(energy / total, 4) END AS fraction, CASE WHEN kind = 'channel' THEN coalesce(upto, 0e0) < 0.95e0 * total - 1e-6 END AS active FROM (
  SELECT *, sum(energy) OVER (PARTITION BY motion_id, kind) AS total, sum(energy) OVER (PARTITION BY motion_id, kind ORDER BY energy DESC, joint, component, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM (
    SELECT motion_id, joint, component, frame, CASE WHEN frame IS NOT NULL THEN 'frame' WHEN joint IS NULL AND component IS NULL THEN 'clip' WHEN component IS NULL THEN 'joint' WHEN joint IS NULL THEN 'component' ELSE 'channel' END AS kind, round(sum(e * e), 6) AS energy FROM (
      SELECT motion_id, frame, joint, 'x' AS component, ex AS e FROM {RESIDUAL} v UNION ALL SELECT motion_id, frame, joint, 'y' AS component, ey AS e FROM {RESIDUAL} v UNION ALL SELECT motion_id, frame, joint, 'z' AS component, ez AS e FROM {RESIDUAL} v) c
    GROUP BY GROUPING SETS ((motion_id), (motion_id, joint), (motion_id, component), (motion_id, frame), (motion_id, joint, component))) g) r""",
    e50_spectral_energy=f"""
SELECT motion_id, k, round(coefficient, 4) AS coefficient, place FROM (
  SELECT *, row_number() OVER (PARTITION BY motion_id ORDER BY energy DESC, k) AS place, sum(energy) OVER (PARTITION BY motion_id) AS total, sum(energy) OVER (PARTITION BY motion_id ORDER BY energy DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM (
    SELECT motion_id, k, coefficient, round(coefficient * coefficient, 3) AS energy FROM (
      SELECT s.motion_id, f.frame AS k, sum(s.x * cos(3.141592653589793e0 * (2 * s.frame + 1) * f.frame / (2e0 * c.t))) * sqrt((CASE WHEN f.frame = 0 THEN 1e0 ELSE 2e0 END) / max(c.t)) AS coefficient
      FROM {{series}} s JOIN (SELECT motion_id, count(*) AS t FROM {{series}} GROUP BY motion_id) c ON s.motion_id = c.motion_id JOIN {{series}} f ON f.motion_id = s.motion_id GROUP BY s.motion_id, f.frame) d) e) r
WHERE energy > 1e-10 * total AND coalesce(upto, 0e0) < 0.95e0 * total""",
    e51_repair_path_order="""
SELECT motion_id, round(avg(CASE WHEN nxt - v <= 1e-9 THEN 1e0 WHEN nxt IS NOT NULL THEN 0e0 END), 6) AS ordered, count_if(nxt - v > 1e-9) AS inversions, round(sum(greatest(0e0, nxt - v)), 6) AS total, round(max(greatest(0e0, nxt - v)), 6) AS largest,
  CASE WHEN min(v) < max(v) THEN round(corr(alpha, place), 6) END AS spearman FROM (
  SELECT *, lead(v) OVER (PARTITION BY motion_id ORDER BY alpha) AS nxt, rank() OVER (PARTITION BY motion_id ORDER BY v) + (count(*) OVER (PARTITION BY motion_id, v) - 1) / 2e0 AS place FROM (
    SELECT c.motion_id, a.n / 20e0 AS alpha, round(avg((k.speed + a.n / 20e0 * (c.speed - k.speed)) * greatest(0e0, 0.08e0 - k.height - a.n / 20e0 * (c.height - k.height))), 8) AS v
    FROM {contacts} c JOIN {candidate} k ON c.motion_id = k.motion_id AND c.marker = k.marker AND c.frame = k.frame JOIN {numbers} a ON a.n <= 20 GROUP BY c.motion_id, a.n) p) q GROUP BY motion_id""",
    e52_repair_effect=f"""
SELECT metric, {num('before')} AS before, {num('after')} AS after, {num('clean')} AS clean, {num('before - after')} AS improvement, {num('CASE WHEN before - clean > 1e-12 THEN (before - after) / (before - clean) END')} AS repaired, before - after >= 0.001e0 AS meaningful, abs(after - clean) <= greatest(1e-6, 0.1e0 * abs(before - clean)) AS near_clean, motion_id FROM {{repairs}}""",
    e57_paired_target_metric=f"SELECT c.motion_id, c.marker, {num('max(k.height)')} AS near_peak, {num('percentile(k.speed, 0.95)')} AS speed_p95 FROM (SELECT motion_id, marker, max_by(frame, height * 1000000 + frame) AS top FROM {{contacts}} GROUP BY motion_id, marker) c JOIN {{contacts}} k ON k.motion_id = c.motion_id AND k.marker = c.marker AND k.frame BETWEEN c.top - 2 AND c.top + 2 GROUP BY c.motion_id, c.marker",
    e58_ablation_summary=f"SELECT family, {num('avg(CASE WHEN target THEN score END)')} AS positive, {num('avg(CASE WHEN NOT target THEN score END)')} AS negative FROM {{scores}} GROUP BY family",
    e59_failure_classes="SELECT c.cause, count(f.motion_id) AS n FROM (SELECT CASE n WHEN 0 THEN 'height' WHEN 1 THEN 'speed' WHEN 2 THEN 'budget' ELSE 'none' END AS cause FROM {numbers} WHERE n < 4) c LEFT JOIN (SELECT motion_id, CASE WHEN max(height) > 0.0999e0 AND exact_avg(speed) > 0.16e0 THEN 'height' WHEN exact_avg(speed) > 0.16e0 THEN 'speed' ELSE 'none' END AS cause FROM {contacts} GROUP BY motion_id) f ON c.cause = f.cause GROUP BY c.cause",
    s2_presentation_auth=f"""
SELECT a.rater, a.session_id, a.trial, count(*) AS answers, {num('min(a.response_ms)')} AS fastest,
  CASE WHEN max(s.stimulus) IS NULL THEN 'unserved' WHEN count(*) > 1 THEN 'answered twice' WHEN max(s.stimulus) <> max(a.stimulus) THEN 'other stimulus' WHEN min(a.response_ms) < 100 THEN 'too fast' ELSE 'authentic' END AS verdict
FROM {{observations}} a LEFT JOIN (SELECT rater, session_id, trial, CASE WHEN rating = 7 THEN second ELSE stimulus END AS stimulus FROM {{observations}} WHERE task <> 'style') s ON a.rater = s.rater AND a.session_id = s.session_id AND a.trial = s.trial GROUP BY a.rater, a.session_id, a.trial""",
    s3_amendments="""
SELECT p.observation_id, p.rating, a.rating AS amended, coalesce(a.rating, p.rating) AS final_rating FROM (SELECT * FROM {observations} WHERE task = 'naturalness') p LEFT JOIN (
  SELECT rater, stimulus, min(observation_id) AS id, min_by(rating, observation_id) AS rating FROM {observations} WHERE task = 'style' GROUP BY rater, stimulus) a ON p.rater = a.rater AND p.stimulus = a.stimulus AND a.id > p.observation_id""",
    e60_head_to_head="SELECT source, CASE WHEN s IS NULL OR g IS NULL THEN 'unavailable' WHEN abs(s - g) <= greatest(1e-12, 1e-9 * abs(g)) THEN 'tie' WHEN s < g THEN 'specialist' ELSE 'generic' END AS winner FROM (SELECT source, min(CASE WHEN flag = 'A' THEN severity END) AS s, min(CASE WHEN flag = 'N' THEN severity END) AS g FROM {attempts} GROUP BY source) c",
)
