"""Sort, top-k, selection and set operations (G1 to G15, H1 to H4). Every order ends in an id, so ties have one result."""

from __future__ import annotations

from stridelake.functions.quaternions import num
from stridelake.operators.base import operators

PRIORITY = "0.4e0 * (1 - abs(2 * score - 1)) + 0.3e0 * CASE WHEN toxic THEN 1e0 ELSE 0e0 END + 0.2e0 * CASE WHEN target THEN 0e0 ELSE 1e0 END"

OPERATORS = operators(
    g1_rank_repairs="SELECT family, source, mechanism, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY family ORDER BY ok DESC, allok DESC, penalty, mechanism, source) AS BIGINT) AS place FROM (SELECT family, source, mechanism, bool_or(accepted) AS ok, bool_and(accepted) AS allok, round(sum(severity), 3) AS penalty FROM {attempts} GROUP BY family, source, mechanism) s) r WHERE place <= 5",
    g2_specialized_first="""
SELECT family, mechanism, reason FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY tier, severity, mechanism) AS k FROM (
  SELECT family, mechanism, severity, CASE WHEN accepted AND flag = 'A' THEN 0 WHEN accepted THEN 1 WHEN reason = 'O' THEN 2 ELSE 3 END AS tier, CASE WHEN accepted AND flag = 'A' THEN 'specialist' WHEN accepted THEN 'fallback' WHEN reason = 'O' THEN 'feasible' ELSE 'best' END AS reason FROM {attempts}) s) r WHERE k = 1""",
    g3_labeling_queue=f"""
SELECT p.pair_id, {num("1 - greatest(p.p_a, p.p_b, p.p_tie) + CASE WHEN p.preference = 'a_better' AND p.p_b > p.p_a THEN 1e0 ELSE 0e0 END + CASE WHEN p.split = 'heldout' THEN 0.35e0 ELSE 0e0 END")} AS priority FROM {{pairs}} p LEFT JOIN (SELECT DISTINCT l_orderkey FROM {{lineitem}} WHERE l_quantity > 25) d ON p.pair_id = d.l_orderkey WHERE d.l_orderkey IS NULL""",
    g4_audit_queue="SELECT pair_id, family, CAST(row_number() OVER (PARTITION BY family ORDER BY CASE WHEN preference = 'approximately_equal' THEN 0 ELSE 1 END, round(greatest(p_a, p_b), 9), pair_id) AS BIGINT) AS place, concat_ws(',', CASE WHEN split = 'heldout' THEN 'heldout' END, CASE WHEN preference = 'approximately_equal' THEN 'mandatory' END) AS reasons FROM {pairs} WHERE split = 'heldout'",
    g5_balanced_selection="SELECT family, pair_id FROM (SELECT family, pair_id, row_number() OVER (PARTITION BY family ORDER BY sha2(concat('7-', CAST(pair_id AS VARCHAR(20))), 256), pair_id) AS k FROM {pairs}) s ORDER BY k, family LIMIT 40",
    g8_query_priority=f"SELECT sample_id, {num(f'greatest(0e0, least(1e0, {PRIORITY}))')} AS priority, CAST(rank() OVER (PARTITION BY family ORDER BY round({PRIORITY}, 9) DESC, sample_id) AS BIGINT) AS place FROM {{scores}}",
    g10_adaptive_followup="""
SELECT rater, stimulus FROM (SELECT r.rater, p.stimulus, row_number() OVER (PARTITION BY r.rater ORDER BY p.n, p.stimulus) AS k FROM (SELECT DISTINCT rater FROM {observations}) r JOIN (SELECT stimulus, count(*) AS n FROM {observations} GROUP BY stimulus) p ON p.n > 0
LEFT JOIN (SELECT DISTINCT rater, stimulus FROM {observations} WHERE rating > 4) u ON u.rater = r.rater AND u.stimulus = p.stimulus WHERE u.rater IS NULL) s WHERE k = 1""",
    g11_benchmark_cases="SELECT family, source, severity FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY severity DESC, source) AS place FROM (SELECT family, source, round(max(severity), 6) AS severity FROM {attempts} WHERE accepted GROUP BY family, source) s) r WHERE place <= 3",
    g12_diagnose_family="SELECT motion_id, CASE WHEN pop >= floating AND pop >= slide THEN 'pop' WHEN floating >= slide THEN 'floating' ELSE 'slide' END AS family FROM (SELECT motion_id, max(qty) / 10 AS pop, max(height) * 1000 / 20 AS floating, max(speed) * 30 / 2 AS slide FROM {contacts} GROUP BY motion_id) s",
    g13_failure_examples=f"SELECT source, sample_id, {num('wrongness')} AS wrongness, CAST(k AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(wrongness, 9) DESC, sample_id) AS k FROM (SELECT source, sample_id, abs(score - CASE WHEN target THEN 1 ELSE 0 END) AS wrongness FROM {{scores}}) s) r WHERE k <= 10",
    g14_validation_plan=f"SELECT l.ladder, CAST(k.n AS BIGINT) AS step, CAST(r.n AS BIGINT) AS replicate, {num('greatest(0e0, least(5e0, l.threshold + (k.n - 2) * 0.75e0))')} AS level FROM (SELECT ladder, avg(level) AS threshold FROM {{ladder}} WHERE answer = 'MAYBE' GROUP BY ladder) l JOIN {{numbers}} k ON k.n < 5 JOIN {{numbers}} r ON r.n < 3",
    g15_select_variant="""
SELECT variant, loss FROM (SELECT variant, loss, row_number() OVER (ORDER BY loss, variant) AS place FROM (
  SELECT family AS variant, round(avg(-ln(greatest(CASE preference WHEN 'a_better' THEN p_a WHEN 'b_better' THEN p_b ELSE p_tie END, 1e-9))), 6) AS loss FROM {pairs} WHERE split = 'validation' GROUP BY family) v) r WHERE place = 1""",
    h1_id_set_checks="""
SELECT 'missing' AS rule, count(*) AS n FROM (SELECT o_orderkey FROM {orders} EXCEPT SELECT l_orderkey FROM {lineitem}) a UNION ALL SELECT 'unexpected' AS rule, count(*) AS n FROM (SELECT l_orderkey FROM {lineitem} EXCEPT SELECT o_orderkey FROM {orders}) b
UNION ALL SELECT 'both' AS rule, count(*) AS n FROM (SELECT o_orderkey FROM {orders} INTERSECT SELECT l_orderkey FROM {lineitem}) c UNION ALL SELECT 'repeated' AS rule, count(*) AS n FROM (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING count(*) > 1) d""",
    h2_mask_union=f"SELECT motion_id, frame, bool_or(active) AS active, {num('max(weight)')} AS weight FROM (SELECT motion_id, frame, height < 0.03e0 AS active, 1 - height AS weight FROM {{contacts}} WHERE marker < 2 UNION ALL SELECT motion_id, frame, speed < 0.1e0 AS active, 1 - speed AS weight FROM {{contacts}} WHERE marker >= 2) s GROUP BY motion_id, frame",
    h3_training_export="SELECT observation_id, CASE WHEN stimulus % 10 = 0 THEN 'calibration' WHEN rating = 4 THEN 'undecided' ELSE 'exported' END AS disposition, CASE WHEN family < 3 THEN 'train' ELSE 'validation' END AS split, sha2(concat(CAST(rater AS VARCHAR(20)), ':', CAST(observation_id AS VARCHAR(20))), 256) AS export_id FROM {observations}",
    h4_legacy_registry="SELECT observation_id, count(*) AS logs FROM (SELECT observation_id FROM {observations} WHERE task = 'pair' UNION ALL SELECT observation_id FROM {observations} WHERE rating > 5) s GROUP BY observation_id HAVING count(*) > 1",
)
