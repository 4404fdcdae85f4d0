"""Evaluation statistics (E18 to E32). Ranks come from counts of distinct scores, so no window holds all rows of a table."""

from __future__ import annotations

from stridelake.functions.quaternions import num
from stridelake.operators.base import operators

#: Positives and negatives of each distinct score, and how many stand above it, by family.
COUNTS = """(SELECT family, score, pos, neg, (sum(pos) OVER w) - pos AS pos_above, (sum(neg) OVER w) - neg AS neg_above, sum(pos) OVER (PARTITION BY family) AS p, sum(neg) OVER (PARTITION BY family) AS n FROM (
  SELECT family, score, count_if(target) AS pos, count_if(NOT target) AS neg FROM {scores} GROUP BY family, score) g WINDOW w AS (PARTITION BY family ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) c"""
PICKED = "CASE WHEN p_a >= p_b AND p_a >= p_tie THEN 'a_better' WHEN p_b >= p_tie THEN 'b_better' ELSE 'approximately_equal' END"
OWN = "CASE preference WHEN 'a_better' THEN p_a WHEN 'b_better' THEN p_b ELSE p_tie END"
RATED = "(SELECT rater, a, b, count(*) AS c FROM (SELECT x.rater, x.rating AS a, y.rating AS b FROM (SELECT rater, stimulus, min_by(rating, observation_id) AS rating FROM {observations} WHERE task = 'naturalness' GROUP BY rater, stimulus) x JOIN (SELECT rater, stimulus, max_by(rating, observation_id) AS rating FROM {observations} WHERE task = 'naturalness' GROUP BY rater, stimulus) y ON x.rater = y.rater AND x.stimulus = y.stimulus) s GROUP BY rater, a, b)"

OPERATORS = operators(
    e18_weighted_kappa=f"""
SELECT o.rater, CASE WHEN max(o.n) < 2 OR max(e.expected) <= 1e-12 THEN NULL ELSE {num('1 - max(o.observed) / nullif(max(e.expected), 0)')} END AS kappa FROM (
  SELECT rater, sum(c) AS n, sum(c * (a - b) * (a - b)) / (36e0 * sum(c)) AS observed FROM {RATED} j GROUP BY rater) o
JOIN (SELECT l.rater, sum(l.p * r.p * (l.a - r.b) * (l.a - r.b)) / 36e0 AS expected FROM (SELECT rater, a, sum(c) / CAST(sum(sum(c)) OVER (PARTITION BY rater) AS DOUBLE) AS p FROM {RATED} j1 GROUP BY rater, a) l
  JOIN (SELECT rater, b, sum(c) / CAST(sum(sum(c)) OVER (PARTITION BY rater) AS DOUBLE) AS p FROM {RATED} j2 GROUP BY rater, b) r ON l.rater = r.rater GROUP BY l.rater) e ON o.rater = e.rater GROUP BY o.rater""",
    e19_spearman=f"""
SELECT family, CASE WHEN count(*) < 3 OR stddev_pop(rx) = 0 OR stddev_pop(ry) = 0 THEN NULL ELSE {num('corr(rx, ry)')} END AS rho FROM (
  SELECT family, rank() OVER (PARTITION BY family ORDER BY severity) + (count(*) OVER (PARTITION BY family, severity) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY family ORDER BY group_id) + (count(*) OVER (PARTITION BY family, group_id) - 1) / 2e0 AS ry FROM {{samples}}) s GROUP BY family""",
    e20_binary_auroc=f"SELECT family, CASE WHEN max(p) = 0 OR max(n) = 0 THEN NULL ELSE {num('sum(neg * (pos_above + pos / 2e0)) / nullif(CAST(max(p) AS DOUBLE) * max(n), 0)')} END AS auroc FROM {COUNTS} GROUP BY family",
    e21_average_precision=f"""
SELECT t.family, t.threshold_ap, r.row_ap FROM (SELECT family, CASE WHEN max(p) = 0 THEN NULL ELSE {num('sum(pos * (pos_above + pos) / CAST(pos_above + neg_above + pos + neg AS DOUBLE)) / nullif(max(p), 0)')} END AS threshold_ap FROM {COUNTS} GROUP BY family) t
JOIN (SELECT family, {num('avg(CASE WHEN target THEN hits / CAST(k AS DOUBLE) END)')} AS row_ap FROM (SELECT family, target, row_number() OVER w AS k, sum(CASE WHEN target THEN 1 ELSE 0 END) OVER (PARTITION BY family ORDER BY score DESC, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM {{scores}} WINDOW w AS (PARTITION BY family ORDER BY score DESC, sample_id)) s GROUP BY family) r ON t.family = r.family""",
    e22_ece=f"""
SELECT {num('sum(CASE WHEN edge = 10 THEN n * gap / whole END)')} AS ece10, {num('sum(CASE WHEN edge = 5 THEN n * gap / whole END)')} AS ece5 FROM (
  SELECT edge, bin, count(*) AS n, abs(avg(CASE WHEN target THEN 1e0 ELSE 0e0 END) - avg(score)) AS gap, max(whole) AS whole FROM (
    SELECT s.target, s.score, e.n AS edge, CASE WHEN e.n = 5 THEN least(4e0, floor(s.score * 5)) ELSE floor(s.score * 10) END AS bin, w.whole FROM {{scores}} s JOIN {{numbers}} e ON e.n IN (5, 10) CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS whole FROM {{scores}}) w) b WHERE edge = 5 OR bin < 10 GROUP BY edge, bin) g""",
    e23_localization_f1_iou=f"""
SELECT motion_id, tp, fp, fn, {num('2 * tp / greatest(1e0, 2 * tp + fp + fn)')} AS f1, {num('tp / greatest(1e0, tp + fp + fn)')} AS iou FROM (
  SELECT c.motion_id, count_if(c.height <= 0.03e0 AND k.height <= 0.03e0) AS tp, count_if(c.height > 0.03e0 AND k.height <= 0.03e0) AS fp, count_if(c.height <= 0.03e0 AND k.height > 0.03e0) AS fn
  FROM {{contacts}} c JOIN {{candidate}} k ON c.motion_id = k.motion_id AND c.marker = k.marker AND c.frame = k.frame GROUP BY c.motion_id) m""",
    e24_per_family_metrics=f"SELECT family, CAST(max(p) AS BIGINT) AS positives, CAST(max(n) AS BIGINT) AS negatives, CASE WHEN max(p) = 0 OR max(n) = 0 THEN NULL ELSE {num('sum(neg * (pos_above + pos / 2e0)) / nullif(CAST(max(p) AS DOUBLE) * max(n), 0)')} END AS auroc, {num('sum((pos + neg) * score) / sum(pos + neg)')} AS mean_score FROM {COUNTS} GROUP BY family",
    e25_severity_bin_recall=f"""
SELECT f.family, b.band, count(s.sample_id) AS n, {num('avg(CASE WHEN s.score >= 0.5e0 THEN 1e0 WHEN s.score IS NOT NULL THEN 0e0 END)')} AS recall, {num('avg(s.score)')} AS mean_probability FROM (SELECT DISTINCT family FROM {{scores}}) f JOIN (SELECT CAST(n AS BIGINT) AS band FROM {{numbers}} WHERE n < 5) b ON b.band >= 0
LEFT JOIN (SELECT c.sample_id, c.family, c.score, CAST(floor(least(4e0, m.severity / 80)) AS BIGINT) AS band FROM {{scores}} c JOIN {{samples}} m ON c.sample_id = m.sample_id WHERE c.target) s ON s.family = f.family AND s.band = b.band GROUP BY f.family, b.band""",
    e26_pairwise_ranking=f"SELECT b.family, count(*) AS edges, {num('avg(CASE WHEN w.score > b.score THEN 1e0 ELSE 0e0 END)')} AS accuracy, {num('min(w.score - b.score)')} AS worst FROM (SELECT sample_id AS better, lead(sample_id) OVER (PARTITION BY family ORDER BY sample_id) AS worse FROM {{scores}}) e JOIN {{scores}} b ON e.better = b.sample_id JOIN {{scores}} w ON e.worse = w.sample_id GROUP BY b.family",
    e27_cross_mechanism_consistency=f"SELECT l.family, count(*) AS n, {num('avg(abs(l.score - r.score))')} AS mean_gap, {num('max(abs(l.score - r.score))')} AS max_gap FROM {{scores}} l JOIN {{scores}} r ON l.family = r.family AND r.sample_id = l.sample_id + 1 GROUP BY l.family",
    e28_single_metric_baseline=f"SELECT family, {num('sum(neg * (pos_above + pos / 2e0)) / nullif(CAST(max(p) AS DOUBLE) * max(n), 0)')} AS auroc, {num('sum(pos * (pos_above + pos) / CAST(pos_above + neg_above + pos + neg AS DOUBLE)) / nullif(max(p), 0)')} AS ap FROM {COUNTS.replace('{scores}', '(SELECT * FROM {scores} WHERE NOT toxic) primary_rows')} GROUP BY family",
    e29_sham_false_positives=f"SELECT source, count(*) AS controls, {num('avg(CASE WHEN score > 0.8e0 THEN 1e0 ELSE 0e0 END)')} AS false_positive_rate, count_if(score > 0.8e0 AND toxic) AS real_artifact, count_if(score > 0.8e0 AND NOT toxic) AS shortcut, count_if(score <= 0.8e0) AS none FROM {{scores}} WHERE NOT target GROUP BY source",
    e30_multiclass_scores=f"""
SELECT split, count(*) AS n, {num(f'avg(-ln(greatest({OWN}, 1e-9)))')} AS log_loss, {num("avg((p_a - CASE WHEN preference = 'a_better' THEN 1 ELSE 0 END) * (p_a - CASE WHEN preference = 'a_better' THEN 1 ELSE 0 END) + (p_b - CASE WHEN preference = 'b_better' THEN 1 ELSE 0 END) * (p_b - CASE WHEN preference = 'b_better' THEN 1 ELSE 0 END) + (p_tie - CASE WHEN preference = 'approximately_equal' THEN 1 ELSE 0 END) * (p_tie - CASE WHEN preference = 'approximately_equal' THEN 1 ELSE 0 END))")} AS brier,
  {num(f'avg(CASE WHEN {PICKED} = preference THEN 1e0 ELSE 0e0 END)')} AS accuracy, count_if(preference = 'a_better' AND {PICKED} = 'b_better') AS a_as_b, count_if(preference = 'b_better' AND {PICKED} = 'a_better') AS b_as_a FROM {{pairs}} GROUP BY split""",
    e31_detector_metrics=f"SELECT family, count(*) AS n, count_if(toxic) AS maybe, {num('avg(CASE WHEN NOT toxic THEN (score - CASE WHEN target THEN 1 ELSE 0 END) * (score - CASE WHEN target THEN 1 ELSE 0 END) END)')} AS brier, {num('count_if(target AND NOT toxic AND score >= 0.7e0) / nullif(CAST(count_if(target AND NOT toxic) AS DOUBLE), 0)')} AS recall, {num('count_if(NOT target AND NOT toxic AND score >= 0.7e0) / nullif(CAST(count_if(NOT target AND NOT toxic) AS DOUBLE), 0)')} AS false_positive FROM {{scores}} GROUP BY family",
    e32_operating_point_sweep=f"""
SELECT CASE WHEN g.p < 20 OR g.n < 40 THEN 'insufficient_held_out_human_support' WHEN b.tau IS NULL THEN 'no_supported_operating_point' ELSE 'candidate_requires_review' END AS status, {num('b.tau')} AS tau, {num('b.recall')} AS recall, {num('b.alarm')} AS false_alarm
FROM (SELECT count_if(target) AS p, count_if(NOT target) AS n FROM {{scores}}) g LEFT JOIN (SELECT tau, recall, alarm FROM (
  SELECT score AS tau, pos_above / CAST(p AS DOUBLE) AS recall, neg_above / CAST(n AS DOUBLE) AS alarm FROM {COUNTS.replace("{scores}", "(SELECT 'all' AS family, score, target FROM {scores}) every_row")} WHERE p > 0 AND n > 0
  UNION ALL SELECT 0e0 AS tau, 1e0 AS recall, 1e0 AS alarm UNION ALL SELECT 1e0 AS tau, 0e0 AS recall, 0e0 AS alarm) s
  WHERE alarm <= 0.05e0 AND recall >= 0.8e0 ORDER BY recall DESC, alarm, tau LIMIT 1) b ON g.p >= 20 AND g.n >= 40""",
)
