"""Scalar functions: rotations, planes, confidences, envelopes, ids, roles, intervals and bands."""

from __future__ import annotations

from stridelake.functions.quaternions import A, B, Q, conjugate, cross, dot, exp_vector, geodesic, log_vector, matrix, multiply, named, norm, num, raw, rotate
from stridelake.operators.base import operators

KEY = "motion_id, frame, joint"
#: A pose whose quaternion is not of unit length.
SCALED = "(SELECT motion_id, frame, joint, w * (1 + frame % 3) AS w, x * (1 + frame % 3) AS x, y * (1 + frame % 3) AS y, z * (1 + frame % 3) AS z FROM {poses}) s"
V, U = ("vx", "vy", "vz"), ("ux", "uy", "uz")
#: Two unit vectors for each pair of poses; joint 15 has them antiparallel.
VECTORS = f"""(SELECT {KEY}, ax / {norm(A[1:])} AS ux, ay / {norm(A[1:])} AS uy, az / {norm(A[1:])} AS uz,
  CASE WHEN joint = 15 THEN -ax / {norm(A[1:])} ELSE bx / {norm(B[1:])} END AS vx, CASE WHEN joint = 15 THEN -ay / {norm(A[1:])} ELSE by_ / {norm(B[1:])} END AS vy,
  CASE WHEN joint = 15 THEN -az / {norm(A[1:])} ELSE bz / {norm(B[1:])} END AS vz FROM {{steps}}) v"""
ARC = ("(1 + d)", *cross(U, V))
SLERP = f"""SELECT {KEY}, d, t, sw * aw + tw * sgn * bw AS w, sw * ax + tw * sgn * bx AS x, sw * ay + tw * sgn * by_ AS y, sw * az + tw * sgn * bz AS z FROM (
  SELECT *, CASE WHEN d > 0.9995e0 THEN 1 - t ELSE sin((1 - t) * acos(d)) / sin(acos(d)) END AS sw, CASE WHEN d > 0.9995e0 THEN t ELSE sin(t * acos(d)) / sin(acos(d)) END AS tw FROM (
    SELECT *, least(1e0, abs({dot(A, B)})) AS d, CASE WHEN {dot(A, B)} < 0 THEN -1 ELSE 1 END AS sgn, 0.25e0 * (1 + joint % 5) AS t FROM {{steps}}) a) b"""
MATRIX = f"(SELECT {KEY}, {raw(matrix(Q), 'a b c d e f g h i')} FROM {{poses}}) m"

#: The turn away from rest, w not negative, and from it intrinsic X, Y, Z angles or swing about x and z and twist about y, in degrees.
RELATIVE = f"""(SELECT motion_id, frame, joint, representation, lo0, hi0, lo1, hi1, lo2, hi2, trust, valid, {raw(tuple(f'(CASE WHEN w < 0 THEN -1 ELSE 1 END) * {c} / {norm(Q)}' for c in Q), 'w x y z')} FROM (
  SELECT p.motion_id, p.frame, p.joint, l.representation, l.lo0, l.hi0, l.lo1, l.hi1, l.lo2, l.hi2, l.confidence * l.axis_confidence AS trust,
    coalesce(l.valid AND l.lo0 + l.hi0 + l.lo1 + l.hi1 + l.lo2 + l.hi2 IS NOT NULL AND l.confidence > 0 AND l.axis_confidence > 0, false) AS valid, {raw(multiply(conjugate(('l.w', 'l.x', 'l.y', 'l.z')), ('p.w', 'p.x', 'p.y', 'p.z')), 'w x y z')}
  FROM {{poses}} p JOIN {{limits}} l ON l.joint = p.joint) r)"""
_TWIST = ("tw", "0e0", "(-ty)", "0e0")
_EULER = ("degrees(atan2(-f, i))", "degrees(asin(greatest(-1e0, least(1e0, c))))", "degrees(atan2(-b, a))")
_SWING = log_vector(("sw", "sx", "sy", "sz"))
COORDINATES = f"""(SELECT motion_id, frame, joint, representation, lo0, hi0, lo1, hi1, lo2, hi2, trust, valid, {', '.join(f"CASE WHEN representation = 'euler_xyz' THEN {e} ELSE {t} END AS c{k}" for k, (e, t) in enumerate(zip(_EULER, (f'degrees({_SWING[0]})', f'degrees({_SWING[2]})', 'degrees(2 * atan2(ty, tw))'), strict=True)))} FROM (
  SELECT *, {raw(matrix(Q), 'a b c d e f g h i')}, {raw(multiply(Q, _TWIST), 'sw sx sy sz')} FROM (
    SELECT *, CASE WHEN sqrt(w * w + y * y) < 1e-8 THEN 1e0 ELSE w / sqrt(w * w + y * y) END AS tw, CASE WHEN sqrt(w * w + y * y) < 1e-8 THEN 0e0 ELSE y / sqrt(w * w + y * y) END AS ty FROM {RELATIVE} q) t) m)"""

OPERATORS = operators(
    b1_quat_normalize=f"SELECT {KEY}, CASE WHEN {norm(Q)} < 1e-8 THEN NULL ELSE {num('w / ' + norm(Q))} END AS w, {named([f'{c} / nullif({norm(Q)}, 0)' for c in Q[1:]], 'x y z')} FROM {SCALED}",
    b2_quat_inverse=f"SELECT {KEY}, {named(conjugate(Q), 'cw cx cy cz')}, {named([f'{c} / {dot(Q, Q)}' for c in conjugate(Q)], 'iw ix iy iz')} FROM {SCALED}",
    b3_quat_multiply=f"SELECT {KEY}, {named(multiply(A, B), 'w x y z')} FROM {{steps}}",
    b4_quat_rotate=f"SELECT {KEY}, {named(rotate(A, ('1e0', '0.5e0', '-2e0')), 'x y z')} FROM {{steps}}",
    b5_quat_shortest_arc=f"""
SELECT {KEY}, {named([f'q{c} / sqrt(qw * qw + qx * qx + qy * qy + qz * qz)' for c in 'wxyz'], 'w x y z')} FROM (
  SELECT {KEY}, CASE WHEN d < -1 + 1e-7 THEN 0e0 ELSE {ARC[0]} END AS qw,
    CASE WHEN d >= -1 + 1e-7 THEN {ARC[1]} WHEN least_axis = 0 THEN 0e0 WHEN least_axis = 1 THEN -uz ELSE uy END AS qx,
    CASE WHEN d >= -1 + 1e-7 THEN {ARC[2]} WHEN least_axis = 0 THEN uz WHEN least_axis = 1 THEN 0e0 ELSE -ux END AS qy,
    CASE WHEN d >= -1 + 1e-7 THEN {ARC[3]} WHEN least_axis = 0 THEN -uy WHEN least_axis = 1 THEN ux ELSE 0e0 END AS qz
  FROM (SELECT *, {dot(U, V)} AS d, CASE WHEN abs(ux) <= abs(uy) AND abs(ux) <= abs(uz) THEN 0 WHEN abs(uy) <= abs(uz) THEN 1 ELSE 2 END AS least_axis FROM {VECTORS}) w) arcs""",
    b6_quat_exp=f"SELECT {KEY}, {named(exp_vector(('vx', 'vy', 'vz')), 'w x y z')} FROM (SELECT {KEY}, x * (frame % 4) AS vx, y * (frame % 4) AS vy, z * (frame % 4) AS vz FROM {{poses}}) s",
    b7_quat_log=f"SELECT {KEY}, {named(log_vector(Q), 'x y z')} FROM {{poses}}",
    b8_quat_difference=f"SELECT {KEY}, {named([f'd{c} / sqrt(dw * dw + dx * dx + dy * dy + dz * dz)' for c in 'wxyz'], 'w x y z')} FROM (SELECT {KEY}, {raw(multiply(conjugate(A), B), 'dw dx dy dz')} FROM {{steps}}) s",
    b9_quat_geodesic=f"SELECT {KEY}, {num(geodesic(A, B))} AS angle FROM {{steps}}",
    b10_matrix_round_trip=f"""
SELECT {KEY}, {named('a b c d e f g h i'.split(), 'm00 m01 m02 m10 m11 m12 m20 m21 m22')}, {named([f'sgn * {c}' for c in ('qw', 'qx', 'qy', 'qz')], 'w x y z')} FROM (
  SELECT *, CASE WHEN qw < 0 THEN -1 ELSE 1 END AS sgn FROM (
    SELECT *, CASE branch WHEN 0 THEN s / 4 WHEN 1 THEN (h - f) / s WHEN 2 THEN (c - g) / s ELSE (d - b) / s END AS qw, CASE branch WHEN 0 THEN (h - f) / s WHEN 1 THEN s / 4 WHEN 2 THEN (b + d) / s ELSE (c + g) / s END AS qx,
      CASE branch WHEN 0 THEN (c - g) / s WHEN 1 THEN (b + d) / s WHEN 2 THEN s / 4 ELSE (f + h) / s END AS qy, CASE branch WHEN 0 THEN (d - b) / s WHEN 1 THEN (c + g) / s WHEN 2 THEN (f + h) / s ELSE s / 4 END AS qz FROM (
      SELECT *, 2 * sqrt(greatest(1e-12, CASE branch WHEN 0 THEN 1 + a + e + i WHEN 1 THEN 1 + a - e - i WHEN 2 THEN 1 + e - a - i ELSE 1 + i - a - e END)) AS s FROM (
        SELECT *, CASE WHEN a + e + i > 0 THEN 0 WHEN a >= e AND a >= i THEN 1 WHEN e >= i THEN 2 ELSE 3 END AS branch FROM {MATRIX}) n) o) p) r""",
    b11_quat_slerp=f"SELECT {KEY}, {named([f'{c} / {norm(Q)}' for c in Q], 'w x y z')} FROM ({SLERP}) blended",
    b12_rot6d=f"""
SELECT {KEY}, {named('a d g b e h'.split(), 'r0 r1 r2 r3 r4 r5')}, {named([f'x{k}' for k in range(3)] + [f'y{k} / yn' for k in range(3)], 'd0 d1 d2 d3 d4 d5')} FROM (
  SELECT *, sqrt(y0 * y0 + y1 * y1 + y2 * y2) AS yn FROM (
    SELECT *, b - p * x0 AS y0, e - p * x1 AS y1, h - p * x2 AS y2 FROM (
      SELECT *, x0 * b + x1 * e + x2 * h AS p FROM (SELECT *, a / sqrt(a * a + d * d + g * g) AS x0, d / sqrt(a * a + d * d + g * g) AS x1, g / sqrt(a * a + d * d + g * g) AS x2 FROM {MATRIX}) n) o) q) r""",
    b13_limit_coordinates=f"SELECT motion_id, frame, joint, representation, {named(('c0', 'c1', 'c2'), 'first_deg second_deg third_deg')} FROM {COORDINATES} c",
    b14_axis_remap=f"SELECT motion_id, frame, {named(['0.01e0 * x', '0.01e0 * z', '-0.01e0 * y'], 'x y z')}, {named(['100e0 * (0.01e0 * x)', '-100e0 * (-0.01e0 * y)', '100e0 * (0.01e0 * z)'], 'bx by_ bz')} FROM {{roots}}",
    b15_plane_split=f"""
SELECT motion_id, frame, {named(['height', 'tx', 'ty', 'tz', 'sqrt(tx * tx + ty * ty + tz * tz)'], 'height tx ty tz tangential')} FROM (
  SELECT motion_id, frame, along + 0.1e0 AS height, x - along * nx AS tx, y - along * ny AS ty, z - along * nz AS tz FROM (
    SELECT *, x * nx + y * ny + z * nz AS along FROM (SELECT *, 0.1e0 / sqrt(1.02e0) AS nx, 1 / sqrt(1.02e0) AS ny, 0.1e0 / sqrt(1.02e0) AS nz FROM {{roots}}) r) s) t""",
    b16_contact_confidence=f"SELECT motion_id, marker, frame, {num('1 / (1 + exp(-greatest(-60e0, least(60e0, (0.05e0 - height) / 0.02e0)))) / (1 + exp(-greatest(-60e0, least(60e0, (0.25e0 - speed) / 0.1e0))))')} AS confidence FROM {{contacts}}",
    b17_envelopes=f"""
SELECT motion_id, frame, {num('CASE WHEN frame = 0 OR frame = n - 1 THEN 0e0 ELSE sin(3.141592653589793e0 * u) * sin(3.141592653589793e0 * u) END')} AS pulse, {num('a * a * (3 - 2 * a) * b * b * (3 - 2 * b)')} AS locks, {num('e * e * (3 - 2 * e)')} AS edit FROM (
  SELECT *, CASE WHEN m = 0 THEN 1e0 ELSE least(1e0, frame / m) END AS a, CASE WHEN m = 0 THEN 1e0 ELSE least(1e0, (n - 1 - frame) / m) END AS b,
    CASE WHEN least(frame, n - 1 - frame) < greatest(1e0, m) THEN least(frame, n - 1 - frame) / greatest(1e0, m - 1) ELSE 1e0 END AS e FROM (
    SELECT motion_id, frame, n, frame / greatest(1e0, n - 1e0) AS u, least(12e0, floor(n / 4e0)) AS m FROM (SELECT motion_id, frame, count(*) OVER (PARTITION BY motion_id) AS n FROM {{series}}) s) t) v""",
    b18_content_ids="""
SELECT CAST(o_orderkey AS BIGINT) AS sample_id, concat('record-', sha2(concat(o_orderstatus, '|', o_orderpriority, '|', CAST(o_orderkey AS VARCHAR(20))), 256)) AS record_id,
  sha2(concat('ds', '#', CAST(o_custkey AS VARCHAR(20))), 256) AS lineage_id FROM {orders}""",
    b19_role_part_side="""
SELECT role, CASE WHEN role LIKE 'left%' THEN 'left' WHEN role LIKE 'right%' THEN 'right' ELSE 'center' END AS side, CASE WHEN role LIKE '%foot' OR role LIKE '%toe' THEN 'foot' WHEN role LIKE '%knee' OR role LIKE '%hip' THEN 'leg' WHEN role LIKE '%hand' THEN 'hand' WHEN role LIKE '%elbow' THEN 'arm' WHEN role IN ('pelvis', 'root') THEN 'pelvis' WHEN role LIKE 'spine%' THEN 'torso' WHEN role = 'head' THEN 'head' ELSE 'accessory' END AS part, count(*) AS n
FROM (SELECT concat(CASE WHEN p_size % 3 = 0 THEN 'left_' WHEN p_size % 3 = 1 THEN 'right_' ELSE '' END, CASE WHEN p_size % 3 = 2 THEN CASE WHEN p_size < 20 THEN 'pelvis' WHEN p_size < 35 THEN 'spine2' ELSE 'prop' END WHEN p_size < 15 THEN 'foot' WHEN p_size < 25 THEN 'knee' WHEN p_size < 35 THEN 'elbow' ELSE 'hand' END) AS role FROM {part}) r GROUP BY role""",
    b20_canonical_preference="""
SELECT pair_id, preference, CASE WHEN source % 2 = 0 OR preference = 'approximately_equal' THEN preference WHEN preference = 'a_better' THEN 'b_better' ELSE 'a_better' END AS shown FROM {pairs}""",
    b21_wilson_interval=f"""
SELECT family, n, k, CASE WHEN n = 0 THEN NULL ELSE {num('greatest(0e0, (p + 1.96e0 * 1.96e0 / (2 * n) - 1.96e0 * sqrt(p * (1 - p) / n + 1.96e0 * 1.96e0 / (4e0 * n * n))) / (1 + 1.96e0 * 1.96e0 / n))')} END AS low,
  CASE WHEN n = 0 THEN NULL ELSE {num('least(1e0, (p + 1.96e0 * 1.96e0 / (2 * n) + 1.96e0 * sqrt(p * (1 - p) / n + 1.96e0 * 1.96e0 / (4e0 * n * n))) / (1 + 1.96e0 * 1.96e0 / n))')} END AS high
FROM (SELECT family, count(*) AS n, count_if(target) AS k, count_if(target) / CAST(count(*) AS DOUBLE) AS p FROM {{scores}} GROUP BY family) s""",
    b22_relative_asymmetry=f"SELECT motion_id, CASE WHEN l IS NULL OR r IS NULL THEN NULL WHEN 0.5e0 * (abs(l) + abs(r)) < 1e-9 THEN 0e0 ELSE {num('100 * abs(l - r) / (0.5e0 * (abs(l) + abs(r)))')} END AS percent FROM (SELECT motion_id, avg(CASE WHEN marker = 0 THEN height END) AS l, avg(CASE WHEN marker = 1 THEN height END) AS r FROM {{contacts}} GROUP BY motion_id) s",
    b23_severity_band="""
SELECT s.sample_id, b.label, b.ordinal FROM {samples} s JOIN (SELECT CASE n WHEN 0 THEN 'near_threshold' WHEN 1 THEN 'subtle' WHEN 2 THEN 'moderate' WHEN 3 THEN 'clear' ELSE 'severe' END AS label, round(0.2e0 * (n + 1), 6) AS ordinal,
  CASE n WHEN 0 THEN 0 WHEN 1 THEN 40 WHEN 2 THEN 100 WHEN 3 THEN 200 ELSE 300 END AS lo, CASE n WHEN 0 THEN 40 WHEN 1 THEN 100 WHEN 2 THEN 200 WHEN 3 THEN 300 ELSE 100000 END AS hi FROM {numbers} WHERE n < 5) b ON s.severity >= b.lo AND s.severity < b.hi""",
    b24_phase_octant=f"SELECT motion_id, frame, CAST(floor(phase / 0.7853981633974483e0) AS BIGINT) % 8 AS octant, {num('sin(phase)')} AS sin_phase, {num('cos(phase)')} AS cos_phase FROM (SELECT motion_id, frame, t_s * 0.001e0 - 6.283185307179586e0 * floor(t_s * 0.001e0 / 6.283185307179586e0) AS phase FROM {{series}}) s",
)
