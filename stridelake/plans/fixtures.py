"""Views over the test tables that stand in for the library's own tables (FIXTURES.md). Each reads base tables or views above it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stridelake.operators.base import operators

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Whole numbers from 0 for grids of a fixed size: joints, steps, bands. What follows the length of the data never reads it.
NUMBERS = 512

VIEWS = operators(
    series="""
SELECT CAST(user_id AS BIGINT) AS motion_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
  (unix_micros(CAST(ts AS TIMESTAMP)) - min(unix_micros(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id)) / 1e6 AS t_s, value AS x
FROM {events}""",
    vectors="""
SELECT CAST(label AS BIGINT) AS motion_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame, embedding FROM {embeddings}""",
    poses="""
SELECT motion_id, frame, joint, w / s AS w, x / s AS x, y / s AS y, z / s AS z FROM (
  SELECT *, sqrt(w * w + x * x + y * y + z * z) AS s FROM (
    SELECT v.motion_id, v.frame, CAST(k.n AS BIGINT) AS joint, CAST(element_at(v.embedding, CAST(4 * k.n + 1 AS INT)) AS DOUBLE) AS w, CAST(element_at(v.embedding, CAST(4 * k.n + 2 AS INT)) AS DOUBLE) AS x,
      CAST(element_at(v.embedding, CAST(4 * k.n + 3 AS INT)) AS DOUBLE) AS y, CAST(element_at(v.embedding, CAST(4 * k.n + 4 AS INT)) AS DOUBLE) AS z
    FROM {vectors} v JOIN {numbers} k ON k.n < 16) raw) normed""",
    roots="""
SELECT motion_id, frame, 0.1e0 * CAST(element_at(embedding, 1) AS DOUBLE) AS x, 0.93e0 + 0.05e0 * CAST(element_at(embedding, 2) AS DOUBLE) AS y,
  1.2e0 * frame / 60 + 0.1e0 * CAST(element_at(embedding, 3) AS DOUBLE) AS z, frame / 60e0 AS t_s FROM {vectors}""",
    steps="""
SELECT * FROM (
  SELECT motion_id, frame, joint, w AS aw, x AS ax, y AS ay, z AS az, lead(w) OVER p AS bw, lead(x) OVER p AS bx, lead(y) OVER p AS by_, lead(z) OVER p AS bz
  FROM {poses} WINDOW p AS (PARTITION BY motion_id, joint ORDER BY frame)) q WHERE bw IS NOT NULL""",
    joints="""
SELECT CAST(n AS BIGINT) AS joint, CASE WHEN n = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(floor((n - 1) / 2e0) AS BIGINT) END AS parent,
  CASE WHEN n = 0 THEN CAST(0 AS BIGINT) WHEN n < 3 THEN 1 WHEN n < 7 THEN 2 WHEN n < 15 THEN 3 ELSE 4 END AS depth,
  0.02e0 * n AS ox, 0.1e0 + 0.01e0 * n AS oy, 0.03e0 * (n % 3) AS oz FROM {numbers} WHERE n < 16""",
    contacts="""
SELECT CAST(l_suppkey AS BIGINT) AS motion_id, CAST(l_linenumber % 4 AS BIGINT) AS marker,
  CAST(row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 4 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS frame,
  l_discount AS height, 4 * l_tax AS speed, l_quantity AS qty FROM {lineitem}""",
    candidate="""
SELECT motion_id, marker, frame, height + 0.04e0 * e AS height, speed * (1 + 0.5e0 * e) AS speed FROM (
  SELECT *, CASE WHEN frame % 16 BETWEEN 4 AND 11 THEN (frame % 16 - 3) * (12 - frame % 16) / 20e0 ELSE 0e0 END AS e FROM {contacts}) c""",
    limits="""
SELECT joint, CASE WHEN joint % 2 = 0 THEN 'euler_xyz' ELSE 'swing_twist' END AS representation, w, x, y, z, -60e0 + joint AS lo0, 50e0 + joint AS hi0, CASE WHEN joint <> 7 THEN -40e0 END AS lo1, 45e0 AS hi1, -70e0 AS lo2, 80e0 - joint AS hi2, joint % 5 <> 4 AS valid,
  CASE WHEN joint = 3 THEN 0e0 ELSE 0.5e0 + joint / 40e0 END AS confidence, CASE WHEN joint % 3 = 0 THEN 0.25e0 ELSE 1e0 END AS axis_confidence FROM {poses} WHERE motion_id = 0 AND frame = 0""",
    repairs="""
SELECT c.motion_id, 'height' AS metric, round(avg(k.height), 9) AS before, round(avg(k.smooth), 9) AS after, round(avg(c.height), 9) AS clean FROM {contacts} c JOIN (
  SELECT motion_id, marker, frame, height, (height + coalesce(lag(height, 4) OVER w, height) + coalesce(lead(height, 4) OVER w, height) + coalesce(lag(height, 8) OVER w, height) + coalesce(lead(height, 8) OVER w, height)) / 5
    * (1 - 0.1e0 * (motion_id % 7)) AS smooth FROM {candidate} WINDOW w AS (PARTITION BY motion_id, marker ORDER BY frame)) k ON c.motion_id = k.motion_id AND c.marker = k.marker AND c.frame = k.frame GROUP BY c.motion_id""",
    posed="""
SELECT motion_id, frame, joint, w * c - y * s AS w, x * c - z * s AS x, w * s + y * c AS y, x * s + z * c AS z FROM (
  SELECT *, cos(0.05e0 * (1 + joint % 3) * (frame % 4)) AS c, sin(0.05e0 * (1 + joint % 3) * (frame % 4)) AS s FROM {poses}) p""",
    attempts="""
SELECT p_brand AS family, p_type AS mechanism, CASE WHEN l_quantity < 10 THEN 'near_threshold' WHEN l_quantity < 20 THEN 'subtle' WHEN l_quantity < 30 THEN 'moderate' WHEN l_quantity < 40 THEN 'clear' ELSE 'severe' END AS band,
  l_returnflag <> 'R' AS accepted, l_linestatus AS reason, l_extendedprice / 1000 AS severity, l_returnflag AS flag, CAST(l_suppkey AS BIGINT) AS source, l_quantity AS qty
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    samples="""
SELECT CAST(o_orderkey AS BIGINT) AS sample_id, CAST(o_custkey AS BIGINT) AS group_id, o_orderpriority AS family, o_orderstatus AS mechanism, o_totalprice / 1000 AS severity,
  CASE WHEN o_custkey % 10 < 7 THEN 'train' WHEN o_custkey % 10 = 7 THEN 'validation' WHEN o_custkey % 10 = 8 THEN 'known_test' ELSE 'heldout' END AS split FROM {orders}""",
    scores="""
SELECT CAST(d.doc_id AS BIGINT) AS sample_id, l.quality = 1 AS target, 1 / (1 + exp(-(ln(d.n_chars + 1) - 6))) AS score, d.lang AS family, d.source AS source, l.toxic = 1 AS toxic
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    pairs="""
SELECT *, pa / s AS p_a, pb / s AS p_b, pt / s AS p_tie FROM (
  SELECT *, pa + pb + pt AS s FROM (
    SELECT CAST(o_orderkey AS BIGINT) AS pair_id, CASE o_orderstatus WHEN 'F' THEN 'a_better' WHEN 'O' THEN 'b_better' ELSE 'approximately_equal' END AS preference, o_orderpriority AS family,
      CASE WHEN o_custkey % 10 < 7 THEN 'train' WHEN o_custkey % 10 < 9 THEN 'validation' ELSE 'heldout' END AS split, CAST(o_custkey AS BIGINT) AS source,
      1 + o_totalprice % 97 AS pa, 1 + CAST(o_custkey % 89 AS DOUBLE) AS pb, 1 + o_totalprice % 31 AS pt FROM {orders}) raw) summed""",
    observations="""
SELECT CAST(event_id AS BIGINT) AS observation_id, CAST(user_id % 20 AS BIGINT) AS rater, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS session_id,
  CAST(row_number() OVER (PARTITION BY user_id % 20, CAST(ts AS DATE) ORDER BY ts, event_id) AS BIGINT) AS trial, CAST(event_id % 60 AS BIGINT) AS stimulus, CAST((77 - event_id % 60) % 60 AS BIGINT) AS second,
  CASE event_type WHEN 'purchase' THEN 'pair' WHEN 'error' THEN 'style' ELSE 'naturalness' END AS task, CAST(1 + CAST(floor(abs(value)) AS BIGINT) % 7 AS BIGINT) AS rating, 100 * value AS response_ms,
  CAST(event_id % 5 AS BIGINT) AS family FROM {events}""",
    ratings="""
SELECT stimulus AS item, session_id AS session, rater, rating FROM {observations} WHERE task = 'naturalness'""",
    comparisons="""
SELECT stimulus AS first, second, rater, CASE WHEN rating <= 2 THEN 'first_better' WHEN rating <= 4 THEN 'second_better' WHEN rating <= 6 THEN 'effectively_equal' ELSE 'not_sure' END AS outcome
FROM {observations} WHERE task = 'pair' AND stimulus <> second""",
    item_sources="""
SELECT DISTINCT stimulus AS item, stimulus % 12 AS source FROM {observations}""",
    matches="""
SELECT 'r' || CAST(family % 2 AS VARCHAR(2)) AS render, 's' || CAST(stimulus % 10 AS VARCHAR(4)) AS source, 'f' || CAST(family AS VARCHAR(4)) AS family, task AS style, observation_id, rating AS score,
  CASE WHEN response_ms > 10000 THEN 0 WHEN response_ms > 4000 THEN 1 ELSE 2 END AS label FROM {observations}""",
    rig_joints="""
SELECT rig, joint, CASE WHEN joint = 0 THEN CAST(-1 AS BIGINT) ELSE CAST((n * 7919) % joint AS BIGINT) END AS parent, name,
  CASE WHEN joint % 3 = 1 THEN CASE (n * 31) % 8 WHEN 0 THEN 'pelvis' WHEN 1 THEN 'spine_1' WHEN 2 THEN 'head' WHEN 3 THEN 'left_elbow' WHEN 4 THEN 'right_hand' WHEN 5 THEN 'left_knee' WHEN 6 THEN 'right_foot' ELSE 'prop' END END AS role FROM (
  SELECT CAST(c_nationkey AS BIGINT) AS rig, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS joint, CAST(c_custkey AS BIGINT) AS n, c_name AS name FROM {customer}) c""",
    derivations="""
SELECT motion_id, CASE WHEN k % 6 = 0 THEN NULL ELSE before END AS parent_id, operation, CASE WHEN k % 6 = 0 THEN 'source' ELSE kind END AS kind, seed, CASE WHEN k % 6 = 0 THEN split END AS split, owner, CAST(floor(k / 6e0) AS BIGINT) AS take FROM (
  SELECT CAST(o_orderkey AS BIGINT) AS motion_id, lag(CAST(o_orderkey AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS owner,
    o_orderpriority AS operation, CASE o_orderstatus WHEN 'F' THEN 'corruption' WHEN 'O' THEN 'repair' ELSE 'slice' END AS kind, CAST(o_orderkey % 1000 AS BIGINT) AS seed, CASE WHEN o_custkey % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM {orders}) o""",
    notices="""
SELECT stimulus AS item, session_id AS session, CASE WHEN rating <= 2 THEN 'NO' WHEN rating <= 4 THEN 'MAYBE' ELSE 'YES' END AS answer FROM {observations}""",
    ladder="""
SELECT CAST(l_suppkey % 8 AS BIGINT) AS ladder, CAST(floor(l_quantity / 10) AS BIGINT) AS level, CASE WHEN l_discount + l_quantity / 1000 > 0.07e0 THEN 'YES' WHEN l_discount + l_quantity / 1000 > 0.04e0 THEN 'MAYBE' ELSE 'NO' END AS answer,
  CAST(l_suppkey % 20 AS BIGINT) AS rater, CAST(l_partkey % 40 AS BIGINT) AS item FROM {lineitem}""",
)


def frames(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The named tables and views as DataFrames."""
    out = {}
    for name in names:
        if name == "numbers":
            out[name] = spark.range(NUMBERS).withColumnRenamed("id", "n")
        elif name in TABLES:
            out[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            out[name] = VIEWS[name](spark, **frames(spark, sf_dir, VIEWS[name].inputs))
    return out


def needed(names: tuple[str, ...]) -> list[str]:
    """The views that names need, each after those that it reads."""
    out: list[str] = []
    for name in names:
        if name in VIEWS:
            out += [x for x in [*needed(VIEWS[name].inputs), name] if x not in out]
        elif name == "numbers" and name not in out:
            out.append(name)
    return out
