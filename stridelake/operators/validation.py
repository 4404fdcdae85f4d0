"""Filters, predicates and validation (C1 to C17). A validator returns its violations; no row means valid."""

from __future__ import annotations

from stridelake.functions.quaternions import Q, norm, num
from stridelake.operators.base import operators

OPERATORS = operators(
    c1_validate_clips=f"""
SELECT 'unit quaternion' AS rule, motion_id, count(*) AS n FROM (SELECT motion_id, w * (1 + frame % 7) AS w, x, y, z FROM {{poses}}) p WHERE abs({norm(Q)} - 1) > 1e-5 GROUP BY motion_id
UNION ALL SELECT 'frame count' AS rule, p.motion_id, count(*) AS n FROM (SELECT motion_id, count(DISTINCT frame) AS n FROM {{poses}} GROUP BY motion_id) p JOIN (SELECT motion_id, count(*) AS n FROM {{roots}} GROUP BY motion_id) r ON p.motion_id = r.motion_id WHERE p.n <> r.n GROUP BY p.motion_id
UNION ALL SELECT 'finite root' AS rule, motion_id, count(*) AS n FROM {{roots}} WHERE abs(x) > 0.35e0 OR isnan(y) GROUP BY motion_id""",
    c2_validate_rigs="""
WITH RECURSIVE reached AS (SELECT joint, CAST(0 AS BIGINT) AS steps FROM {joints} WHERE parent = -1 UNION ALL SELECT j.joint, r.steps + 1 AS steps FROM {joints} j JOIN reached r ON j.parent = r.joint)
SELECT j.joint, j.depth, r.steps, CASE WHEN r.joint IS NULL THEN 'unreachable' WHEN r.steps <> j.depth THEN 'depth' WHEN j.parent = j.joint THEN 'self parent' ELSE 'ok' END AS rule FROM {joints} j LEFT JOIN reached r ON j.joint = r.joint""",
    c3_validate_contacts="SELECT 'exit thresholds' AS rule, motion_id, marker, count(*) AS n FROM {contacts} WHERE speed > 0.3e0 GROUP BY motion_id, marker UNION ALL SELECT 'height range' AS rule, motion_id, marker, count(*) AS n FROM {contacts} WHERE height < 0 OR height > 0.095e0 GROUP BY motion_id, marker",
    c4_qualify_clean_clips=f"""
SELECT motion_id, {num('speed')} AS speed, slip_ok, height_ok, speed_ok, confidence_ok, slip_ok AND height_ok AND speed_ok AND confidence_ok AS qualified FROM (
  SELECT motion_id, avg(speed) AS speed, max(speed) <= 0.32e0 AS slip_ok, max(height) <= 0.1e0 AS height_ok, avg(speed) BETWEEN 0.1e0 AND 3e0 AS speed_ok, avg(1 - height / 0.1e0) >= 0.25e0 AS confidence_ok FROM {{contacts}} GROUP BY motion_id) s""",
    # Fixed values, the largest of each band: slip 2.5 cm, penetration 2 cm, floating 5 cm, speed error 0.05 m/s, loop seam 0.2, joint limits 0 degrees.
    c5_acceptance_bands=f"""
SELECT motion_id, {num('sum(CASE WHEN NOT required OR coalesce(value <= top + 1e-12, FALSE) THEN 0e0 WHEN value IS NULL THEN 1e0 ELSE (value - top) / greatest(top, 1e-6) END)')} AS penalty, bool_and(NOT required OR coalesce(value <= top + 1e-12, FALSE)) AS accepted,
  count_if(required) AS required, count_if(required AND value IS NULL) AS absent, count_if(required AND value > top + 1e-12) AS outside FROM (
  SELECT m.motion_id, CASE n WHEN 0 THEN slip WHEN 1 THEN penetration WHEN 2 THEN floating WHEN 3 THEN speed_error WHEN 4 THEN seam ELSE excess END AS value,
    CASE n WHEN 0 THEN 2.5e0 WHEN 1 THEN 2e0 WHEN 2 THEN 5e0 WHEN 3 THEN 0.05e0 WHEN 4 THEN 0.2e0 ELSE 0e0 END AS top, n < 4 OR n = 4 AND motion_id % 3 = 0 OR n = 5 AND motion_id % 2 = 0 AS required FROM (
    SELECT motion_id, round(max(CASE WHEN height <= 0.03e0 THEN 100 * speed / 60 END), 6) AS slip, round(100 * max(greatest(0e0, 0.02e0 - height)), 6) AS penetration, round(100 * max(CASE WHEN speed < 0.1e0 THEN height END), 6) AS floating,
      round(abs(avg(speed) - 0.16e0), 6) AS speed_error, round(abs(max_by(height, frame) FILTER (WHERE marker = 0) - min_by(height, frame) FILTER (WHERE marker = 0)), 6) AS seam, greatest(0e0, max(qty) - 45) AS excess FROM {{contacts}} GROUP BY motion_id) m
  JOIN {{numbers}} k ON k.n < 6) b GROUP BY motion_id""",
    c6_hard_constraint_reasons="""
SELECT motion_id, concat_ws(',', CASE WHEN top > 0.095e0 THEN 'penetration' END, CASE WHEN mean > 0.16e0 THEN 'target speed' END, CASE WHEN travel < 100 THEN 'displacement' END) AS reasons FROM (SELECT motion_id, max(height) AS top, exact_avg(speed) AS mean, sum(qty) AS travel FROM {contacts} WHERE marker = 0 GROUP BY motion_id) s""",
    c7_experiment_regimes="""
SELECT sample_id, CASE WHEN split = 'heldout' AND mechanism = 'P' THEN 'adversarial' WHEN split = 'heldout' THEN 'heldout_mechanism' ELSE split END AS regime FROM {samples}""",
    c8_mechanism_filter="SELECT mechanism, family, count(*) AS n, bool_or(flag = 'N') AS hard FROM {attempts} WHERE mechanism LIKE '%A%' OR family LIKE '%1%' GROUP BY mechanism, family",
    c9_validate_dataset="""
SELECT 'lineage split' AS rule, CAST(group_id AS VARCHAR(20)) AS key, count(DISTINCT split) AS n FROM {samples} GROUP BY group_id HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'duplicate id' AS rule, CAST(sample_id AS VARCHAR(20)) AS key, count(*) AS n FROM {samples} GROUP BY sample_id HAVING count(*) > 1
UNION ALL SELECT 'heldout in train' AS rule, CAST(sample_id AS VARCHAR(20)) AS key, CAST(1 AS BIGINT) AS n FROM {samples} WHERE split = 'train' AND mechanism = 'P'
UNION ALL SELECT 'dangling group' AS rule, CAST(s.group_id AS VARCHAR(20)) AS key, count(*) AS n FROM {samples} s LEFT JOIN {customer} c ON s.group_id = c.c_custkey WHERE c.c_custkey IS NULL GROUP BY s.group_id""",
    c10_validate_candidate_pool="SELECT 'eligibility' AS rule, sample_id, source FROM {scores} WHERE toxic AND target UNION ALL SELECT 'no lineage' AS rule, sample_id, source FROM {scores} WHERE NOT target AND source IS NULL",
    c11_validate_observations="""
SELECT rule, count(*) AS n FROM (SELECT CASE WHEN task = 'pair' AND stimulus = second THEN 'pair of one' WHEN task <> 'pair' AND rating > 6 THEN 'rating range' WHEN response_ms < 0 THEN 'negative time' ELSE 'ok' END AS rule FROM {observations}) s GROUP BY rule""",
    c12_training_eligibility="""
SELECT o.observation_id, bool_and(m.eligible) AS eligible, count(*) AS stimuli FROM (SELECT observation_id, stimulus FROM {observations} UNION ALL SELECT observation_id, second AS stimulus FROM {observations} WHERE task = 'pair') o
JOIN (SELECT CAST(n AS BIGINT) AS stimulus, n % 7 <> 0 AS eligible FROM {numbers} WHERE n < 60) m ON o.stimulus = m.stimulus GROUP BY o.observation_id""",
    c14_feasible_query_candidates="SELECT stimulus, count(*) AS seen, min(coalesce(nullif(family, 4), 0)) AS family FROM {observations} WHERE stimulus % 11 <> 0 GROUP BY stimulus HAVING count(*) <= 400",
    c15_modality_masks=f"""
SELECT p.motion_id, p.frame, p.joint, coalesce(f.valid, j.valid, TRUE) AS valid, CASE WHEN coalesce(f.valid, j.valid, TRUE) THEN {num('coalesce(f.confidence, j.confidence, 1e0)')} ELSE 0e0 END AS confidence FROM {{poses}} p
LEFT JOIN (SELECT motion_id, frame, y > 0.93e0 AS valid, abs(z) / (1 + abs(z)) AS confidence FROM {{roots}} WHERE frame % 2 = 0) f ON p.motion_id = f.motion_id AND p.frame = f.frame LEFT JOIN (SELECT joint, joint % 3 <> 0 AS valid, 1 / (1e0 + depth) AS confidence FROM {{joints}} WHERE joint < 8) j ON p.joint = j.joint""",
    c16_benchmark_eligibility=f"""
SELECT motion_id, {num('coalesce(task_speed, measured)')} AS target_speed, abs(measured - coalesce(task_speed, measured)) <= 0.02e0 AS eligible, concat_ws(',', CASE WHEN top > 0.099e0 THEN 'endpoint' END, CASE WHEN abs(measured - coalesce(task_speed, measured)) > 0.02e0 THEN 'speed' END) AS reasons
FROM (SELECT motion_id, avg(speed) AS measured, max(height) AS top, CASE WHEN motion_id % 2 = 0 THEN 0.15e0 END AS task_speed FROM {{contacts}} GROUP BY motion_id) s""",
    c17_equivalence_control="SELECT pair_id, coalesce(CASE WHEN source % 3 = 0 THEN source % 2 = 0 END, preference = 'approximately_equal' AND family = '1-URGENT' AND split = 'heldout') AS control FROM {pairs}",
)
