"""Joins (D1 to D25)."""

from __future__ import annotations

from stridelake.functions.quaternions import A, B, geodesic, multiply, named, norm, num, rotate
from stridelake.operators.base import operators
from stridelake.operators.windows import SLIDING

#: Each window smoothed on its own, so that two windows differ near their ends only.
SMOOTHED = f"(SELECT motion_id, window_start, frame, round(avg(x) OVER (PARTITION BY motion_id, window_start ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS v FROM {SLIDING} s)"
STIMULI = "(SELECT CAST(n AS BIGINT) AS stimulus, CAST(n % 5 AS BIGINT) AS kind, CASE WHEN n % 4 = 0 THEN 'direct' ELSE 'generated' END AS population FROM {numbers} WHERE n < 60)"
EXPLODED = "(SELECT observation_id, rater, stimulus FROM {observations} UNION ALL SELECT observation_id, rater, second AS stimulus FROM {observations} WHERE task = 'pair')"
WORLD = f"""WITH RECURSIVE posed AS (SELECT p.motion_id, p.frame, p.joint, p.w, p.x, p.y, p.z, j.parent, j.ox, j.oy, j.oz FROM {{poses}} p JOIN {{joints}} j ON p.joint = j.joint),
world AS (
  SELECT p.motion_id, p.frame, p.joint, p.w AS aw, p.x AS ax, p.y AS ay, p.z AS az, r.x AS px, r.y AS py, r.z AS pz FROM posed p JOIN {{roots}} r ON p.motion_id = r.motion_id AND p.frame = r.frame WHERE p.parent = -1
  UNION ALL
  SELECT c.motion_id, c.frame, c.joint, {', '.join(multiply(('u.aw', 'u.ax', 'u.ay', 'u.az'), ('c.w', 'c.x', 'c.y', 'c.z')))}, {', '.join(f'u.p{k} + {e}' for k, e in zip('xyz', rotate(('u.aw', 'u.ax', 'u.ay', 'u.az'), ('c.ox', 'c.oy', 'c.oz')), strict=True))}
  FROM posed c JOIN world u ON c.motion_id = u.motion_id AND c.frame = u.frame AND c.parent = u.joint)"""

OPERATORS = operators(
    d1_explode_metadata_join=f"SELECT o.observation_id, count(DISTINCT m.kind) AS families, min(m.population) AS low_population, max(m.population) AS high_population FROM {EXPLODED} o JOIN {STIMULI} m ON o.stimulus = m.stimulus GROUP BY o.observation_id",
    d2_overlay_latest_labels="""
SELECT p.pair_id, coalesce(h.answer, p.preference) AS preference, p.preference AS generated, h.answer IS NOT NULL AS human FROM {pairs} p LEFT JOIN (
  SELECT pair_id, answer FROM (SELECT l_orderkey AS pair_id, CASE WHEN l_returnflag = 'A' THEN 'a_better' WHEN l_returnflag = 'N' THEN 'b_better' ELSE 'approximately_equal' END AS answer,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS k FROM {lineitem}) s WHERE k = 1) h ON p.pair_id = h.pair_id""",
    d3_apply_supervision_policy="SELECT p.pair_id, CASE WHEN q.policy = 'CERTAIN' THEN p.preference END AS preference, coalesce(q.policy, 'HUMAN_REQUIRED') AS policy FROM {pairs} p LEFT JOIN (SELECT family, CASE WHEN avg(p_a) > 0.33e0 THEN 'CERTAIN' ELSE 'HUMAN_REQUIRED' END AS policy FROM {pairs} GROUP BY family) q ON p.family = q.family",
    d4_prefer_direct="""
SELECT rater, stimulus, 'direct' AS origin, count(*) AS n FROM {observations} WHERE task = 'naturalness' GROUP BY rater, stimulus
UNION ALL SELECT p.rater, p.stimulus, 'proxy' AS origin, count(*) AS n FROM {observations} p LEFT JOIN (SELECT DISTINCT rater, stimulus FROM {observations} WHERE task = 'naturalness') d ON p.rater = d.rater AND p.stimulus = d.stimulus WHERE p.task <> 'naturalness' AND d.rater IS NULL GROUP BY p.rater, p.stimulus""",
    d5_migrate_proxies=f"SELECT o.observation_id, {num('c.low')} AS p_no, {num('1 - c.low - c.high')} AS p_maybe, {num('c.high')} AS p_yes, 0.2e0 AS weight FROM {{observations}} o JOIN (SELECT stimulus, avg(CASE WHEN rating <= 2 THEN 1e0 ELSE 0e0 END) AS low, avg(CASE WHEN rating >= 6 THEN 1e0 ELSE 0e0 END) AS high, count(*) AS n FROM {{observations}} GROUP BY stimulus) c ON o.stimulus = c.stimulus WHERE c.n >= 5 AND o.task = 'style'",
    d6_matched_overlap="SELECT a.observation_id AS old_id, b.observation_id AS new_id, a.rating AS old_rating, b.rating AS new_rating FROM {observations} a JOIN {observations} b ON a.stimulus = b.stimulus AND a.rater = b.rater AND a.session_id = b.session_id AND a.trial < b.trial",
    d7_interval_frame_join="""
SELECT s.motion_id, s.frame, count(e.start_) AS events FROM {series} s LEFT JOIN (SELECT motion_id, frame AS start_, frame + 5 AS stop_ FROM {series} WHERE x > 100) e ON s.motion_id = e.motion_id AND s.frame >= e.start_ AND s.frame < e.stop_ GROUP BY s.motion_id, s.frame""",
    d9_retarget_by_role=f"""
SELECT p.motion_id, p.frame, j.joint AS target_joint, {named(multiply(('cos(0.1e0 * j.depth)', 'sin(0.1e0 * j.depth)', '0e0', '0e0'), ('p.w', 'p.x', 'p.y', 'p.z')), 'w x y z')} FROM {{joints}} j JOIN (SELECT joint, parent, row_number() OVER (PARTITION BY parent ORDER BY joint) AS k FROM {{joints}}) s ON s.parent = j.parent AND s.k = 1 JOIN {{poses}} p ON p.joint = s.joint WHERE j.joint < 10""",
    d10_forward_kinematics=f"{WORLD} SELECT motion_id, frame, joint, {named(('aw', 'ax', 'ay', 'az', 'px', 'py', 'pz'), 'w x y z px py pz')} FROM world",
    d11_marker_positions=f"{WORLD} SELECT motion_id, frame, joint AS marker, {named([f'p{k} + {e}' for k, e in zip('xyz', rotate(A, ('0.01e0', '-0.05e0', '0.02e0')), strict=True)], 'x y z')} FROM world WHERE joint BETWEEN 11 AND 14",
    d12_served_key_join="SELECT o.rater, o.task, count(*) AS answered, count(s.observation_id) AS served FROM {observations} o LEFT JOIN (SELECT * FROM {observations} WHERE observation_id % 97 <> 0) s ON o.rater = s.rater AND o.session_id = s.session_id AND o.trial = s.trial AND o.stimulus = s.stimulus AND o.second = s.second GROUP BY o.rater, o.task",
    d13_forensics_unlock="SELECT o.stimulus, count(DISTINCT o.rater) AS raters, count(DISTINCT CASE WHEN d.done THEN o.rater END) AS finished, count(DISTINCT o.rater) = count(DISTINCT CASE WHEN d.done THEN o.rater END) AS unlocked FROM {observations} o JOIN (SELECT rater, count(DISTINCT stimulus) >= 50 AS done FROM {observations} GROUP BY rater) d ON o.rater = d.rater GROUP BY o.stimulus",
    d14_consistency_pairs=f"SELECT l.sample_id AS a, r.sample_id AS b, {num('abs(l.severity - r.severity) / greatest(l.severity, r.severity)')} AS gap FROM {{samples}} l JOIN {{samples}} r ON l.group_id = r.group_id AND l.family = r.family AND l.mechanism < r.mechanism WHERE abs(l.severity - r.severity) <= 0.25e0 * greatest(l.severity, r.severity)",
    d15_preference_edges="SELECT better, worse, group_id, family FROM (SELECT sample_id AS better, lead(sample_id) OVER (PARTITION BY group_id, family ORDER BY severity, sample_id) AS worse, group_id, family FROM {samples}) s WHERE worse IS NOT NULL",
    d16_neighbour_pairs="""
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (
  SELECT sample_id AS a, lead(sample_id, 1) OVER (PARTITION BY source, family ORDER BY score, sample_id) AS b FROM {scores} UNION ALL SELECT sample_id AS a, lead(sample_id, 2) OVER (PARTITION BY source, family ORDER BY score, sample_id) AS b FROM {scores}) s WHERE b IS NOT NULL""",
    # `place` in the split without a source's own rows: own row i (from 0) at place r stands before alternative t if r - i <= t.
    d17_same_split_donor="""
SELECT q.sample_id, d.sample_id AS donor FROM (
  SELECT sample_id, split, spot + sum(own) OVER (PARTITION BY split, group_id ORDER BY spot, own DESC, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place, own FROM (
    SELECT sample_id, split, group_id, place - mine AS spot, 1 AS own FROM {placed} p UNION ALL SELECT sample_id, split, group_id, place % (n - held) AS spot, 0 AS own FROM {placed} p WHERE n > held) e) q
JOIN (SELECT sample_id, split, place FROM {placed} p) d ON q.split = d.split AND q.place = d.place WHERE q.own = 0""".replace("{placed}", """(SELECT *, row_number() OVER (PARTITION BY split, group_id ORDER BY sample_id) - 1 AS mine, count(*) OVER (PARTITION BY split) AS n, count(*) OVER (PARTITION BY split, group_id) AS held FROM (
      SELECT sample_id, split, group_id, row_number() OVER (PARTITION BY split ORDER BY sample_id) - 1 AS place FROM {samples}) r)"""),
    d18_clip_distance_join=f"""
SELECT q.motion_id, rotation_rms, root_rms FROM (SELECT a.motion_id, {num(f'degrees(sqrt(avg({geodesic(A, B)} * {geodesic(A, B)})))')} AS rotation_rms FROM (
    SELECT p.motion_id, p.w AS aw, p.x AS ax, p.y AS ay, p.z AS az, k.w AS bw, k.x AS bx, k.y AS by_, k.z AS bz FROM {{poses}} p JOIN {{posed}} k ON p.motion_id = k.motion_id AND p.frame = k.frame AND p.joint = k.joint) a GROUP BY a.motion_id) q
JOIN (SELECT r.motion_id, {num('sqrt(avg((k.x - r.x) * (k.x - r.x) + (k.z - r.z) * (k.z - r.z)))')} AS root_rms FROM {{roots}} r JOIN (SELECT motion_id, frame, x + 0.01e0 * (frame % 4) AS x, z - 0.02e0 * (frame % 3) AS z FROM {{roots}}) k ON r.motion_id = k.motion_id AND r.frame = k.frame GROUP BY r.motion_id) t ON q.motion_id = t.motion_id""",
    d19_metric_delta=f"SELECT coalesce(a.source, b.source) AS metric, {num('b.v - a.v')} AS delta FROM (SELECT source, avg(score) AS v FROM {{scores}} WHERE target GROUP BY source) a FULL OUTER JOIN (SELECT source, avg(score) AS v FROM {{scores}} WHERE NOT target GROUP BY source) b ON a.source = b.source",
    d20_window_overlap_compare=f"""
SELECT a.motion_id, {num('max(abs(a.v - b.v))')} AS largest, round(avg(abs(a.v - b.v)), 4) + 0e0 AS mean, {num('max(CASE WHEN a.frame BETWEEN b.window_start + 2 AND a.window_start + 29 THEN abs(a.v - b.v) ELSE 0e0 END)')} AS interior FROM {SMOOTHED} a JOIN {SMOOTHED} b ON a.motion_id = b.motion_id AND b.window_start = a.window_start + 16 AND a.frame = b.frame GROUP BY a.motion_id""",
    d21_joint_halo="SELECT DISTINCT joint FROM (SELECT joint FROM {joints} WHERE joint IN (3, 9) UNION ALL SELECT parent AS joint FROM {joints} WHERE joint IN (3, 9) UNION ALL SELECT joint FROM {joints} WHERE parent IN (3, 9)) s WHERE joint >= 0",
    d22_paired_contact_evidence=f"SELECT c.motion_id, c.marker, c.frame, {num('k.height')} AS height, {num('k.height - c.height')} AS height_change, {num('k.speed - c.speed')} AS speed_change, c.height <= 0.03e0 AS clean_contact, k.height <= 0.03e0 AS candidate_contact FROM {{contacts}} c JOIN {{candidate}} k ON c.motion_id = k.motion_id AND c.marker = k.marker AND k.frame = c.frame",
    d23_decode_samples=f"SELECT p.motion_id, p.frame, {named(('r.x - f.x', 'r.y', 'r.z - f.z'), 'x y z')}, {num(norm(('p.x', 'p.y', 'p.z')))} AS vector_norm FROM {{poses}} p JOIN {{roots}} r ON p.motion_id = r.motion_id AND p.frame = r.frame JOIN {{roots}} f ON p.motion_id = f.motion_id AND f.frame = 0 WHERE p.joint = 0",
    d24_pair_orientation_join="SELECT p.pair_id, CASE WHEN p.source % 3 = 0 THEN 'direct' WHEN p.source % 3 = 1 THEN 'reversed' ELSE 'violation' END AS orientation, CASE WHEN p.source % 3 = 1 AND p.preference = 'a_better' THEN 'b_better' WHEN p.source % 3 = 1 AND p.preference = 'b_better' THEN 'a_better' WHEN p.source % 3 = 2 THEN NULL ELSE p.preference END AS preference FROM {pairs} p JOIN {customer} c ON p.source = c.c_custkey",
    d25_align_predictions=f"""
SELECT pair_id, 'scalar' AS variant, CASE WHEN abs(p_a - p_b) <= 0.1e0 THEN 'approximately_equal' WHEN p_a > p_b THEN 'a_better' ELSE 'b_better' END AS predicted, {num('1 / (1 + exp(p_b - p_a))')} AS probability FROM {{pairs}}
UNION ALL SELECT pair_id, 'classes' AS variant, CASE WHEN p_a >= p_b AND p_a >= p_tie THEN 'a_better' WHEN p_b >= p_tie THEN 'b_better' ELSE 'approximately_equal' END AS predicted, {num('greatest(p_a, p_b, p_tie)')} AS probability FROM {{pairs}}""",
)
