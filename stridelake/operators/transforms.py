"""Series transforms: defect injection, labels, repair and packaging (I1 to I27), and clip tables."""

from __future__ import annotations

from stridelake.functions.quaternions import A, B, Q, exp_vector, multiply, named, num, rotate
from stridelake.operators.base import operators

PI = "3.141592653589793e0"
ROOT = "(SELECT r.*, c.t, CASE WHEN frame >= 8 AND frame < 32 THEN sin({pi} * (frame - 8) / 23e0) * sin({pi} * (frame - 8) / 23e0) ELSE 0e0 END AS e FROM {roots} r JOIN (SELECT motion_id AS m, count(*) AS t FROM {roots} GROUP BY motion_id) c ON r.motion_id = c.m) r".replace("{pi}", PI)
POSE = "(SELECT p.*, CASE WHEN frame >= 8 AND frame < 32 THEN sin({pi} * (frame - 8) / 23e0) * sin({pi} * (frame - 8) / 23e0) ELSE 0e0 END AS e FROM {poses} p) p".replace("{pi}", PI)
KEY = "motion_id, frame, joint"
SHIFTED = """(SELECT a.motion_id, a.frame, a.joint, a.w AS aw, a.x AS ax, a.y AS ay, a.z AS az, b.w AS bw, b.x AS bx, b.y AS by_, b.z AS bz, 0.5e0 AS f FROM {poses} a JOIN (SELECT motion_id AS m, count(DISTINCT frame) AS t FROM {poses} GROUP BY motion_id) c ON a.motion_id = c.m
  JOIN {poses} b ON b.motion_id = a.motion_id AND b.joint = a.joint AND b.frame = (a.frame + c.t - 3) % c.t)"""


def blend(source: str) -> str:
    """Normalised linear blend of (a) toward (b) along the shorter way by f."""
    sign = "(CASE WHEN aw * bw + ax * bx + ay * by_ + az * bz < 0 THEN -1 ELSE 1 END)"
    mixed = [f"((1 - f) * {a} + f * {sign} * {b})" for a, b in zip(A, B, strict=True)]
    n = "sqrt(" + " + ".join(f"{m} * {m}" for m in mixed) + ")"
    return f"SELECT {KEY}, {named([f'{m} / {n}' for m in mixed], 'w x y z')} FROM {source} s"


def turned(vector: tuple, where: str) -> str:
    """Poses with an enveloped rotation of some joints."""
    return f"SELECT {KEY}, {named(multiply(Q, exp_vector(vector)), 'w x y z')} FROM {POSE} WHERE {where} UNION ALL SELECT {KEY}, {named(Q, 'w x y z')} FROM {POSE} WHERE NOT ({where})"


OPERATORS = operators(
    a2_clip_tables="SELECT v.motion_id, count(*) AS frames, round(60e0, 6) AS fps, CASE WHEN v.motion_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM {vectors} v GROUP BY v.motion_id",
    a3_rig_tables=f"SELECT j.joint, j.parent, j.depth, count(c.joint) AS children, {num('max(j.oy)')} AS offset_y FROM {{joints}} j LEFT JOIN {{joints}} c ON c.parent = j.joint GROUP BY j.joint, j.parent, j.depth",
    a6_report_split_sink="SELECT motion_id, marker, count(*) AS frames, sha2(concat(CAST(motion_id AS VARCHAR(20)), ':', CAST(marker AS VARCHAR(20)), ':', CAST(count(*) AS VARCHAR(20)), ':', CAST(CAST(round(sum(height) * 100) AS BIGINT) AS VARCHAR(20))), 256) AS checksum FROM {contacts} GROUP BY motion_id, marker",
    a7_resumable_append="SELECT s.sample_id, s.split FROM {samples} s LEFT JOIN (SELECT sample_id FROM {samples} WHERE group_id % 3 = 0) e ON s.sample_id = e.sample_id WHERE e.sample_id IS NULL",
    a8_frame_cuts_source="SELECT s.motion_id, s.frame - c.start_ AS frame, round(s.x, 6) AS x, c.split FROM {series} s JOIN (SELECT DISTINCT motion_id, 4 + motion_id % 5 AS start_, 30 + motion_id % 7 AS stop_, CASE WHEN motion_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM {series}) c ON s.motion_id = c.motion_id AND s.frame >= c.start_ AND s.frame < c.stop_",
    i1_inject_root_drift=f"SELECT motion_id, frame, {named(('x + 0.1e0 * e * 0.6e0', 'y', 'z + 0.1e0 * e * 0.8e0'), 'x y z')} FROM {ROOT}",
    i2_inject_hip_drift=turned(("0.2e0 * e", "0e0", "0e0"), "joint = 1"),
    i3_inject_penetration_floating=f"SELECT motion_id, frame, {num('y - 0.03e0 * e')} AS penetrating, {num('y + 0.05e0 * e')} AS floating FROM {ROOT}",
    i4_inject_pop=f"SELECT {KEY}, {named(multiply(Q, ('cos(0.2e0)', 'sin(0.2e0)', '0e0', '0e0')), 'w x y z')} FROM {{poses}} WHERE frame = 20 AND joint = 4 UNION ALL SELECT {KEY}, {named(Q, 'w x y z')} FROM {{poses}} WHERE NOT (frame = 20 AND joint = 4)",
    i5_inject_jitter=f"""
SELECT motion_id, frame, {num('x + 0.01e0 * noise / greatest(1e-9, sqrt(avg(noise * noise) OVER (PARTITION BY motion_id)))')} AS x FROM (
  SELECT motion_id, frame, x, 0.15e0 * coalesce(lag(u) OVER w, 0e0) + 0.35e0 * u + 0.35e0 * coalesce(lead(u) OVER w, 0e0) + 0.15e0 * coalesce(lead(u, 2) OVER w, 0e0) AS noise FROM (
    SELECT motion_id, frame, x, (((motion_id * 7919 + frame) * 1103515245 + 12345) % 2147483648) / 2147483648e0 - 0.5e0 AS u FROM {{series}}) d WINDOW w AS (PARTITION BY motion_id ORDER BY frame)) s""",
    i6_inject_limb_shift=blend(SHIFTED),
    i7_inject_time_warp=f"""
SELECT w.motion_id, w.frame, {named(('a.x + w.f * (b.x - a.x)', 'a.y + w.f * (b.y - a.y)', 'a.z + w.f * (b.z - a.z)'), 'x y z')} FROM (SELECT *, u - lo AS f FROM (SELECT *, least(t - 2e0, floor(u)) AS lo FROM (
  SELECT r.motion_id, r.frame, c.t, greatest(0e0, least(c.t - 1e0, (c.t - 1) * (r.frame / (c.t - 1e0) + 0.3e0 * sin(2 * {PI} * r.frame / (c.t - 1e0)) / (2 * {PI})))) AS u FROM {{roots}} r JOIN (SELECT motion_id, count(*) AS t FROM {{roots}} GROUP BY motion_id) c ON r.motion_id = c.motion_id) p) q) w
JOIN {{roots}} a ON a.motion_id = w.motion_id AND a.frame = w.lo JOIN {{roots}} b ON b.motion_id = w.motion_id AND b.frame = w.lo + 1""",
    i8_inject_speed_scale=f"SELECT r.motion_id, r.frame, {named(('f.x + 1.2e0 * (r.x - f.x)', 'r.y', 'f.z + 1.2e0 * (r.z - f.z)'), 'x y z')} FROM {{roots}} r JOIN {{roots}} f ON r.motion_id = f.motion_id AND f.frame = 0",
    i9_inject_amplitude_scale=f"SELECT r.motion_id, r.frame, {num('m.mean + 1.5e0 * (r.y - m.mean)')} AS y FROM {{roots}} r JOIN (SELECT motion_id, avg(y) AS mean FROM {{roots}} GROUP BY motion_id) m ON r.motion_id = m.motion_id",
    i10_inject_seam=f"SELECT motion_id, frame, {num('z + CASE WHEN frame >= t - 8 THEN 0.02e0 * (frame - (t - 8)) / 7e0 ELSE 0e0 END')} AS z FROM {ROOT}",
    i11_inject_limit_excess=turned(("0e0", "0.5e0 * e", "0e0"), "joint < 3"),
    i12_blend_region=blend("(SELECT a.motion_id, a.frame, a.joint, a.w AS aw, a.x AS ax, a.y AS ay, a.z AS az, b.w AS bw, b.x AS bx, b.y AS by_, b.z AS bz, CASE WHEN a.joint < 5 THEN 0.4e0 ELSE 0e0 END AS f FROM {poses} a JOIN (SELECT motion_id, coalesce(lead(motion_id) OVER (ORDER BY motion_id), min(motion_id) OVER ()) AS donor FROM (SELECT DISTINCT motion_id FROM {vectors}) ids) d ON d.motion_id = a.motion_id JOIN {poses} b ON b.motion_id = d.donor AND b.frame = a.frame AND b.joint = a.joint)"),
    i13_perturb_variants=f"SELECT motion_id, frame, 'origin_shift' AS variant, 'equivalent' AS claim, {named(('x + 1', 'y', 'z + 2'), 'x y z')} FROM {{roots}} UNION ALL SELECT motion_id, frame, 'lateral_weight' AS variant, 'worse' AS claim, {named((f'x + 0.03e0 * sin(2 * {PI} * frame / 30e0)', 'y', 'z'), 'x y z')} FROM {{roots}}",
    i14_heading_equivalents=f"SELECT r.motion_id, CAST(45 * k.n AS BIGINT) AS degrees, r.frame, {named(rotate(('cos(radians(22.5e0 * k.n))', '0e0', 'sin(radians(22.5e0 * k.n))', '0e0'), ('(r.x - f.x)', 'r.y', '(r.z - f.z)')), 'x y z')} FROM {{roots}} r JOIN {{roots}} f ON r.motion_id = f.motion_id AND f.frame = 0 JOIN {{numbers}} k ON k.n < 4",
    i15_verify_worsening=f"SELECT motion_id, marker, {num('after - before')} AS delta, after - before >= 0.005e0 AS worse, {num('greatest(0e0, after - before)')} AS severity, {num('least(1e0, greatest(0e0, after - before) / greatest(abs(after), 0.005e0))')} AS confidence FROM (SELECT c.motion_id, c.marker, round(avg(c.height), 9) AS before, round(avg(k.height), 9) AS after FROM {{contacts}} c JOIN {{candidate}} k ON c.motion_id = k.motion_id AND c.marker = k.marker AND c.frame = k.frame GROUP BY c.motion_id, c.marker) s",
    i16_target_severity=f"""
SELECT motion_id, band, parameter FROM (SELECT *, row_number() OVER (PARTITION BY motion_id, band ORDER BY round(abs(delta - (lo + hi) / 2), 9), parameter) AS k FROM (
  SELECT m.motion_id, b.n AS band, g.n AS parameter, m.spread * g.n / 20e0 AS delta, 0.01e0 * b.n AS lo, 0.01e0 * (b.n + 1) AS hi FROM (SELECT motion_id, stddev_pop(height) AS spread FROM {{contacts}} GROUP BY motion_id) m JOIN {{numbers}} b ON b.n < 4 JOIN {{numbers}} g ON g.n BETWEEN 1 AND 40) s WHERE delta >= lo AND delta < hi) r WHERE k = 1""",
    i17_collateral_check="SELECT c.source, c.family, bool_or(r.action = 'reject' AND c.worst > r.top) AS rejected, bool_or(r.action = 'label' AND c.worst > r.top) AS labelled FROM (SELECT source, family, max(severity) AS worst FROM {attempts} GROUP BY source, family) c JOIN (SELECT CASE n WHEN 0 THEN 'reject' ELSE 'label' END AS action, CASE n WHEN 0 THEN 60 ELSE 45 END AS top FROM {numbers} WHERE n < 2) r ON r.top > 0 GROUP BY c.source, c.family",
    i18_compose_defects=f"SELECT motion_id, frame, {named(('f_x + 1.1e0 * (x + 0.05e0 * e - f_x)', 'y - 0.02e0 * e', 'z'), 'x y z')} FROM (SELECT r.*, first_value(x) OVER (PARTITION BY motion_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f_x FROM {ROOT}) s",
    i19_dense_labels=f"SELECT motion_id, frame, CASE WHEN e > 0.5e0 THEN 'core' ELSE 'edge' END AS part, {num('e')} AS weight FROM {ROOT} WHERE e > 1e-9",
    i21_repair_close_loop=f"SELECT motion_id, frame, {named(('x + k * (x0 - x1)', 'y + k * (y0 - y1)'), 'x y')} FROM (SELECT r.motion_id, r.frame, r.x, r.y, g.x0, g.x1, g.y0, g.y1, u * u * (3 - 2 * u) AS k FROM (SELECT r.*, greatest(0e0, (frame - (t - 13)) / 12e0) AS u FROM {ROOT}) r JOIN (SELECT motion_id, min_by(x, frame) AS x0, max_by(x, frame) AS x1, min_by(y, frame) AS y0, max_by(y, frame) AS y1 FROM {{roots}} GROUP BY motion_id) g ON r.motion_id = g.motion_id) s",
    i22_repair_height_grid="SELECT motion_id, round(min_by(offset_, cost), 6) AS offset_ FROM (SELECT c.motion_id, (k.n - 8) / 100e0 AS offset_, round(avg(abs(c.height + (k.n - 8) / 100e0 - 0.0123e0)), 9) + k.n * 1e-9 AS cost FROM {contacts} c JOIN {numbers} k ON k.n < 17 WHERE c.marker = 0 GROUP BY c.motion_id, k.n) s GROUP BY motion_id",
    i23_repair_speed_rescale=f"SELECT r.motion_id, r.frame, CASE WHEN s.k > 3 THEN NULL ELSE {num('f.z + s.k * (r.z - f.z)')} END AS z FROM {{roots}} r JOIN {{roots}} f ON r.motion_id = f.motion_id AND f.frame = 0 JOIN (SELECT motion_id, 1.3e0 / nullif(abs(max_by(z, frame) - min_by(z, frame)) / max(t_s), 0) AS k FROM {{roots}} GROUP BY motion_id) s ON r.motion_id = s.motion_id",
    i24_repair_smooth=f"SELECT motion_id, frame, {num('(0.1e0 * coalesce(lag(x, 2) OVER w, x) + 0.2e0 * coalesce(lag(x, 1) OVER w, x) + 0.4e0 * x + 0.2e0 * coalesce(lead(x, 1) OVER w, x) + 0.1e0 * coalesce(lead(x, 2) OVER w, x))')} AS x FROM {{series}} WINDOW w AS (PARTITION BY motion_id ORDER BY frame)",
    i25_pad_batches="SELECT b.motion_id, k.frame, v.frame IS NOT NULL AS mask FROM (SELECT motion_id, max(count(*)) OVER () AS top FROM {vectors} GROUP BY motion_id) b JOIN (SELECT DISTINCT frame FROM {vectors}) k ON k.frame < b.top LEFT JOIN {vectors} v ON v.motion_id = b.motion_id AND v.frame = k.frame",
    i26_candidate_pool="SELECT identity, min(origin) AS origin, count(*) - 1 AS dropped FROM (SELECT concat(family, '/', mechanism) AS identity, 'corrupted' AS origin FROM {attempts} WHERE accepted UNION ALL SELECT concat(family, '/', mechanism) AS identity, 'perturbed' AS origin FROM {attempts} WHERE band = 'subtle') s GROUP BY identity",
    i27_encode_targets=f"SELECT source, family, max(CASE WHEN accepted THEN 1 ELSE 0 END) AS present, {num('max(CASE WHEN accepted THEN CASE band WHEN ' + chr(39) + 'severe' + chr(39) + ' THEN 1e0 WHEN ' + chr(39) + 'clear' + chr(39) + ' THEN 0.8e0 ELSE 0.5e0 END ELSE 0e0 END)')} AS severity FROM {{attempts}} GROUP BY source, family",
)
