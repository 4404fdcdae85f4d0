"""Registered queries that are no SQL text: sources and sinks, streams, fits and user-defined functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators import calibration, detectability, extend, fits, graphs, kinematics, latent, lineage, resample
from stridelake.plans import fixtures
from stridelake.sources import bvh, logs, stores
from stridelake.sources.scratch import folder
from stridelake.streaming import authentication
from stridelake.streaming import logs as streams


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixtures.frames(spark, sf_dir, (name,))[name]


def a1_bvh_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "bvh")
    text = bvh.bvh_text(_view(spark, sf_dir, "roots"))
    text.write.partitionBy("motion_id").text(path)
    found = bvh.frames(spark, f"{path}/*/*.txt").withColumn("motion_id", F.regexp_extract("path", r"motion_id=(\d+)", 1).cast("long"))
    return found.select("motion_id", "frame", "joint", "name", *[F.round(f"q.{c}", 6).alias(c) for c in "wxyz"], *[F.round(f"root_{c}", 6).alias(f"root_{c}") for c in "xyz"])


def _world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.world(*(_view(spark, sf_dir, n) for n in ("poses", "roots", "joints")))


def d10_forward_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _world(spark, sf_dir).select("motion_id", "frame", "joint", *[F.round(c, 6).alias(c) for c in ("w", "x", "y", "z", "px", "py", "pz")])


def d11_marker_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kinematics.markers(_world(spark, sf_dir).where("joint BETWEEN 11 AND 14"), (0.01, -0.05, 0.02))
    return found.select("motion_id", "frame", "marker", *[F.round(c, 6).alias(c) for c in "xyz"])


def a4_jsonl_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _view(spark, sf_dir, "observations").select("observation_id", "rater", "task", "rating"), folder(spark, "jsonl")
    logs.write_jsonl(rows, path)
    return logs.read_jsonl(spark, path, rows.schema)


def a5_jsonl_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "jsonl")
    logs.write_jsonl(_view(spark, sf_dir, "observations").select("task", "rating", "observation_id"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def a9_log_prefix_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "jsonl")
    logs.write_jsonl(_view(spark, sf_dir, "observations").select("observation_id", "rater", "rating"), path)
    return logs.freeze_prefix(spark, path).select("bytes", "rows", "sha256")


def a2_clip_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips through a store that is written, checked and read again."""
    clips = _view(spark, sf_dir, "roots").select("motion_id", "frame", F.lit(60.0).alias("fps"), F.when(F.col("motion_id") % 10 < 7, "train").otherwise("test").alias("split"), "x", "y", "z")
    path = folder(spark, "clips")
    stores.save_clips(clips, path, {"source": "embeddings"})
    return stores.load_clips(spark, path).groupBy("motion_id", "fps", "split").agg(F.count(F.lit(1)).alias("frames"))


def a6_report_split_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights as dense arrays of a report, split from its summary, verified and counted."""
    rows = _view(spark, sf_dir, "contacts")
    dense = rows.select("motion_id", F.concat(F.lit("height_"), F.col("marker").cast("string")).alias("metric"), F.lit("frame_values").alias("field"), "frame", F.lit(0).cast("long").alias("joint"), F.col("height").cast("double").alias("value"))
    path = folder(spark, "report")
    stores.save_report(dense.groupBy("motion_id", "metric").agg(F.max("value").alias("value")), dense, path, {"source": "lineitem"})
    found = stores.load_report(spark, path)[1].groupBy("motion_id", F.expr("CAST(substr(metric, 8) AS BIGINT)").alias("marker")).agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("value") * 100).cast("long").cast("string").alias("total"))
    text = F.concat_ws(":", F.col("motion_id").cast("string"), F.col("marker").cast("string"), F.col("frames").cast("string"), "total")
    return found.select("motion_id", "marker", "frames", F.sha2(text, 256).alias("checksum"))


def a7_resumable_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run adds to a store that a first run left unfinished."""
    samples, path = _view(spark, sf_dir, "samples"), folder(spark, "samples")
    stores.publish(samples.where("group_id % 3 = 0"), path, ["sample_id"], "samples.v1", {"source": "orders"})
    stores.publish(samples, path, ["sample_id"], "samples.v1", {"source": "orders"})
    first, *later = stores.entries(spark, path)
    stores.load(spark, path, "samples.v1")
    found = spark.read.parquet(f"{path}/batches/{first['folder']}").limit(0)
    for entry in later:
        found = found.unionByName(spark.read.parquet(f"{path}/batches/{entry['folder']}"))
    return found.select("sample_id", "split")


def _presented(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A trial for each event: its rows, with a fault that its id gives, and the trials' facts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("n"), F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string")).alias("rater"), F.col("ts").cast("timestamp").alias("start"))
    kind = F.col("n") % 8
    step = lambda name, at: F.struct(F.lit(name).alias("event"), at.cast("double").alias("after"))
    steps = F.array(step("served", F.when(kind == 4, 1.5).otherwise(0.0)), step("started", F.lit(1.0)), step("completed", F.when(kind == 1, 1.5).otherwise(3.4)), step("answered", F.lit(4.0)), step("answered", F.when(kind == 2, 9.0).when(kind == 3, 200.0)))
    steps = F.filter(steps, lambda s: s["after"].isNotNull() & ~((kind == 0) & (s["event"] == "started")))
    rows = events.select("n", "rater", "start", F.explode(steps).alias("s"))
    stimulus = F.when(kind == 5, "other").otherwise("shown")
    rows = rows.select(F.lit(None).cast("string").alias("row_id"), "rater", F.lit("s").alias("session"), F.col("n").cast("string").alias("trial"), F.lit(1).alias("trial_index"), "s.event", F.expr("start + make_dt_interval(0, 0, 0, CAST(s.after AS DECIMAL(18, 6)))").alias("ts"), stimulus.alias("stimulus"), F.when(F.col("s.event") == "answered", 2.0).alias("initial_s"))
    trials = events.select(F.col("n").cast("string").alias("trial"), F.lit("shown").alias("stimulus"), F.lit(1).alias("trial_index"), F.lit(None).cast("string").alias("eligible_rater"), F.lit(2.0).alias("duration_s"), F.lit(10.0).alias("fps")).distinct()
    return rows.withColumn("row_id", authentication.identity()), trials


def s2_authenticated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authentication.authenticated(*_presented(spark, sf_dir)).select("rater", F.col("trial").cast("long").alias("trial"), "verdict")


def s2_stream_authentication(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, trials = _presented(spark, sf_dir)
    path = folder(spark, "stream")
    last = rows.agg(F.max("ts").alias("ts")).select(*[F.expr("ts + INTERVAL 1 DAY").alias("ts") if c == "ts" else F.lit("tick").alias(c) if c in ("event", "rater", "trial", "row_id") else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    rows.unionByName(last).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    found = streams.drained(authentication.authenticated_stream(stream, trials), folder(spark, "out"), folder(spark, "state"), provider=authentication.ROCKS)
    return found.where("rater <> 'tick'").select("rater", F.col("trial").cast("long").alias("trial"), "verdict")


def b19_inherited_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.inherited_parts(_view(spark, sf_dir, "rig_joints")).withColumn("distance", F.col("distance").cast("long"))


def i25_padded_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = _view(spark, sf_dir, "poses")
    clips = poses.select("motion_id").distinct().select("motion_id", (F.col("motion_id") % 3).alias("rig"), (F.col("motion_id") % 4).alias("batch"))
    nodes = graphs.canonical_nodes(_view(spark, sf_dir, "rig_joints").join(clips.select("rig").distinct(), "rig", "left_semi"))
    return graphs.padded(poses, clips, nodes).select("batch", "motion_id", "frame", "place", "node_key", "part", "frame_mask", "joint_mask", *[F.round(c, 6).alias(c) for c in "wxyz"])


def d8_resample_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's values on an hourly grid."""
    return resample.resampled_series(_view(spark, sf_dir, "series"), 1 / 3600).select("motion_id", "frame", F.round("x", 6).alias("x"))


def d8_resample_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of 60 frames a second at 24."""
    poses, roots = resample.resampled_motion(_view(spark, sf_dir, "poses"), _view(spark, sf_dir, "roots"), 60.0, 24.0)
    moved = roots.select("motion_id", "frame", *[F.round(c, 6).alias(f"root_{c}") for c in "xyz"])
    return poses.select("motion_id", "frame", "joint", *[F.round(c, 6).alias(c) for c in "wxyz"]).join(moved, ["motion_id", "frame"])


def i20_lineage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.steps(lineage.lineage(_view(spark, sf_dir, "derivations")))


def c13_leakage_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extend.whitelisted(_view(spark, sf_dir, "samples"), ["sample_id", "family", "severity"], ["split", "group_id", "mechanism"])


def s1_stream_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("observation_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id")
    path = folder(spark, "stream")
    events.union(events.where("observation_id % 5 = 0")).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    found = streams.drained(streams.unique_observations(stream, delay="3650 days"), folder(spark, "out"), folder(spark, "state"))
    return found.select("observation_id", "user_id")


def s4_stream_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _view(spark, sf_dir, "contacts").select("motion_id", "marker", "frame", "height", "speed"), folder(spark, "stream")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    found = streams.drained(streams.contact_states(stream), folder(spark, "out"), folder(spark, "state"))
    return found.select("motion_id", "marker", "frame", "active")


def s5_stream_staircase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    answers = F.when(F.col("l_discount") + F.col("l_quantity") / 1000 > 0.07, "YES").when(F.col("l_discount") + F.col("l_quantity") / 1000 > 0.04, "MAYBE").otherwise("NO")
    step = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return streams.staircase(rows.select(F.col("l_suppkey").alias("track"), step.alias("step"), answers.alias("answer")))


def e16_notice_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.notice_rates(_view(spark, sf_dir, "ladder"))


def e53_psychometric_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.psychometric(_view(spark, sf_dir, "ladder"))


def e54_ordinal_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.ordinal_calibration(_view(spark, sf_dir, "matches"))


def e54_held_out_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.Calibration(_view(spark, sf_dir, "matches")).metrics()


def e55_latent_detectability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectability.latent_detectability(_view(spark, sf_dir, "notices"))


def e56_latent_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.latent_quality(*(_view(spark, sf_dir, n) for n in ("ratings", "comparisons", "item_sources")))


def g6_balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.balanced_sample(_view(spark, sf_dir, "scores"))


def g7_stratified_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.stratified_overlap(_view(spark, sf_dir, "observations"))


def g9_query_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.query_schedule(_view(spark, sf_dir, "observations"))


def u1_register_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    extend.register_metric("travel", lambda f: f.groupBy("motion_id").agg((F.max("z") - F.min("z")).alias("value")).select("motion_id", "value", F.lit("m").alias("units"), F.lit(1.0).alias("confidence")))
    return extend.measure(_view(spark, sf_dir, "roots"), ["travel"])


def u2_register_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    extend.register_mechanism("lift", lambda f, p: f.withColumn("y", F.col("y") + p), (0.0, 0.2))
    return extend.inject(_view(spark, sf_dir, "roots"), "lift", 0.1)


def u3_score_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _view(spark, sf_dir, "scores").select("sample_id", "family", F.col("score").alias("base"))
    ranked = extend.rank_with(scores, lambda c: c.select("sample_id", (1 - F.col("base")).alias("score")), "family", "sample_id")
    return ranked.where("place <= 10")


QUERIES = {f.__name__: f for f in (a1_bvh_ingest, a2_clip_tables, a6_report_split_sink, a7_resumable_append, b19_inherited_parts, d8_resample_series, d8_resample_motion, i20_lineage_log, i25_padded_graphs, s2_authenticated_answers, s2_stream_authentication, d10_forward_kinematics, d11_marker_positions, a4_jsonl_source, a5_jsonl_sink, a9_log_prefix_freeze, c13_leakage_whitelist, s1_stream_observations, s4_stream_contacts, s5_stream_staircase, e16_notice_rates, e53_psychometric_fit, e54_ordinal_calibration, e54_held_out_metrics, e55_latent_detectability, e56_latent_quality, g6_balanced_sample, g7_stratified_overlap, g9_query_schedule, u1_register_metric, u2_register_mechanism, u3_score_callback)}

#: What each planted fault must lead to.
VERDICTS = """SELECT concat('r', CAST(user_id % 20 AS VARCHAR(20))) AS rater, CAST(event_id AS BIGINT) AS trial, CASE CAST(event_id % 8 AS BIGINT) WHEN 0 THEN 'not served' WHEN 1 THEN 'incomplete' WHEN 2 THEN 'duplicate answer' WHEN 4 THEN 'order' WHEN 5 THEN 'wrong trial' ELSE 'authentic' END AS verdict FROM {events}
  UNION ALL SELECT concat('r', CAST(user_id % 20 AS VARCHAR(20))) AS rater, CAST(event_id AS BIGINT) AS trial, CASE CAST(event_id % 8 AS BIGINT) WHEN 2 THEN 'duplicate answer' ELSE 'after close' END AS verdict FROM {events} WHERE event_id % 8 IN (2, 3)"""

#: Every walk from a joint without a role to the first joint with one; the shortest wins, then the one whose steps come first.
WALKS = """SELECT rig, joint, part, distance FROM (
  WITH RECURSIVE near AS MATERIALIZED (SELECT rig, joint AS a, parent AS b, 1000000 + parent AS rank FROM {rig_joints} WHERE parent >= 0 UNION ALL SELECT rig, parent AS a, joint AS b, joint AS rank FROM {rig_joints} WHERE parent >= 0),
    parts AS MATERIALIZED (SELECT rig, joint, role, CASE role WHEN 'pelvis' THEN 1 WHEN 'spine_1' THEN 2 WHEN 'head' THEN 3 WHEN 'left_elbow' THEN 4 WHEN 'right_hand' THEN 5 WHEN 'left_knee' THEN 6 WHEN 'right_foot' THEN 7 ELSE 8 END AS part FROM {rig_joints}),
    walk AS (SELECT rig, joint AS start_, CAST(-1 AS BIGINT) AS before, joint AS at, 0 AS distance, CAST([] AS BIGINT[]) AS steps FROM {rig_joints} WHERE role IS NULL
      UNION ALL SELECT w.rig, w.start_, w.at, n.b, w.distance + 1, list_append(w.steps, n.rank) FROM walk w JOIN near n ON n.rig = w.rig AND n.a = w.at AND n.b <> w.before JOIN parts p ON p.rig = w.rig AND p.joint = w.at WHERE p.role IS NULL)
  SELECT rig, joint, part, CAST(0 AS BIGINT) AS distance FROM parts WHERE role IS NOT NULL
  UNION ALL SELECT rig, start_, part, distance FROM (SELECT w.rig, w.start_, p.part, CAST(w.distance AS BIGINT) AS distance, row_number() OVER (PARTITION BY w.rig, w.start_ ORDER BY w.distance, w.steps) AS k FROM walk w JOIN parts p ON p.rig = w.rig AND p.joint = w.at WHERE p.role IS NOT NULL) f WHERE k = 1) found"""

#: Texts over the fixture views, for those queries whose result SQL can state.
TEXTS = {
    "c13_leakage_whitelist": "SELECT sample_id, family, severity FROM {samples}",
    "a4_jsonl_source": "SELECT observation_id, rater, task, rating FROM {observations}",
    "a5_jsonl_sink": """SELECT concat('{"observation_id":', CAST(observation_id AS VARCHAR(20)), ',"rating":', CAST(rating AS VARCHAR(20)), ',"task":"', task, '"}') AS line FROM {observations}""",
    "b19_inherited_parts": WALKS,
    "d8_resample_series": """SELECT g.motion_id, g.n AS frame, round(arg_max(a.x, a.frame) + coalesce((arg_max(b.x, a.frame) - arg_max(a.x, a.frame)) * (max(g.t) - arg_max(a.t_s, a.frame)) / (arg_max(b.t_s, a.frame) - arg_max(a.t_s, a.frame)), 0), 6) AS x FROM (
  SELECT motion_id, n, CAST(n AS DOUBLE) / (1e0 / 3600) AS t FROM (SELECT motion_id, unnest(range(CAST(floor(max(t_s) * (1e0 / 3600) + 1e-9) AS BIGINT) + 1)) AS n FROM {series} GROUP BY motion_id) m) g
JOIN {series} a ON a.motion_id = g.motion_id AND a.t_s <= g.t LEFT JOIN {series} b ON b.motion_id = a.motion_id AND b.frame = a.frame + 1 GROUP BY g.motion_id, g.n""",
    "i20_lineage_log": """SELECT d.motion_id, s.motion_id AS source_id, s.split, 'ok' AS status, row_number() OVER (PARTITION BY d.motion_id ORDER BY a.motion_id) - 1 AS step, a.motion_id AS ancestor_id, a.operation, a.kind, a.seed
FROM {derivations} d JOIN {derivations} a ON a.owner = d.owner AND a.take = d.take AND a.motion_id <= d.motion_id JOIN {derivations} s ON s.owner = d.owner AND s.take = d.take AND s.kind = 'source'""",
    "s2_authenticated_answers": VERDICTS,
    "s2_stream_authentication": VERDICTS,
    "s1_stream_observations": "SELECT DISTINCT CAST(event_id AS BIGINT) AS observation_id, user_id FROM {events}",
}
