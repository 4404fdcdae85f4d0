"""Presentation checks: the stream under late, repeated and reordered rows against the batch form, and both against loops."""

import random
from datetime import UTC, datetime, timedelta
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from stridelake.streaming import authentication as auth
from stridelake.streaming import logs

START = datetime(2024, 5, 1, tzinfo=UTC)
TRIALS = "trial string, stimulus string, trial_index int, eligible_rater string, duration_s double, fps double"


def made(seed, n):
    """Events of n trials, most of them faulty in some way; and the trials."""
    draw, rows, trials = random.Random(seed), [], []
    for k in range(n):
        trials.append((f"t{k}", f"m{k % 7}", k, draw.choice([None, None, "r0", "r1"]), 2.0, 10.0))
        rater, at = draw.choice(["r0", "r1"]), START + timedelta(seconds=30 * k + draw.random())
        steps = [(e, at + timedelta(seconds=s)) for e, s in (("served", 0), ("started", 1), ("completed", draw.choice([2.0, 2.8, 3.4, 3.4])), ("answered", 4))]
        fault = draw.choice(["none", "none", "none", "drop", "twice", "again", "swap", "session", "stimulus", "short"])
        if fault == "drop":
            steps.pop(draw.randrange(4))
        if fault == "twice":
            steps.append(("answered", at + timedelta(seconds=9)))
        if fault == "again":
            steps.append(("answered", at + timedelta(seconds=200)))
        if fault == "swap":
            steps[0] = ("served", at + timedelta(seconds=1.5))
        for e, t in steps:
            session = "other" if fault == "session" and e == "started" else "s"
            rows.append((rater, session, f"t{k}", k, e, t, "wrong" if fault == "stimulus" else f"m{k % 7}", (0.5 if fault == "short" else 2.0) if e == "answered" else None))
    return rows, trials


def loops(rows, wait=60):
    """rows: (row, trial facts, id is right); verdicts by plain Python over each trial's rows."""
    out = []
    for (rater, trial), group in groupby(sorted(rows, key=lambda x: (x[0]["rater"], x[0]["trial"])), key=lambda x: (x[0]["rater"], x[0]["trial"])):
        group = list(group)
        out += [(rater, trial, r["row_id"], "hash mismatch") for r, _, good in group if not good]
        own = list({r["row_id"]: (r, f) for r, f, good in group if good}.values())
        answers = sorted((r["ts"], r["row_id"], r, f) for r, f in own if r["event"] == "answered")
        if not answers:
            continue
        at, _, a, fact = answers[0]
        inside = [x for x in answers if x[0] <= at + timedelta(seconds=wait)]
        times = {e: min((r["ts"] for r, _ in own if r["event"] == e and r["session"] == a["session"] and r["trial_index"] == a["trial_index"]), default=None) for e in auth.EVENTS}
        least = fact[4] - 2 / fact[5]
        if len(inside) > 1:
            said = "duplicate answer"
        elif a["stimulus"] != fact[1] or a["trial_index"] != fact[2] or fact[3] not in (None, rater):
            said = "wrong trial"
        elif None in times.values():
            said = "not served"
        elif not times["served"] <= times["started"] <= times["completed"] <= at:
            said = "order"
        else:
            said = "incomplete" if (times["completed"] - times["started"]).total_seconds() < least or a["initial_s"] < least else "authentic"
        out.append((rater, trial, a["row_id"], said))
        out += [(rater, trial, x[1], "duplicate answer" if x in inside else "after close") for x in answers[1:]]
    return sorted(out)


def test_batch_against_loops_and_stream_against_batch(spark, tmp_path):
    rows, trials = made(3, 60)
    plain = spark.createDataFrame([(None, *r) for r in rows], auth.ROW)
    signed = plain.withColumn("row_id", auth.identity()).withColumn("row_id", F.when((F.col("trial_index") % 9 == 4) & (F.col("event") == "completed"), "forged").otherwise(F.col("row_id")))
    known = spark.createDataFrame(trials, TRIALS)
    got = sorted(tuple(r)[:3] + (r["verdict"],) for r in auth.authenticated(signed.union(signed), known).distinct().collect())
    listed = signed.collect()
    facts = {t[0]: t for t in trials}
    want = loops([(r, facts[r["trial"]], r["row_id"] != "forged") for r in listed])
    assert got == want and {"authentic", "duplicate answer", "wrong trial", "not served", "order", "incomplete", "after close", "hash mismatch"} == {x[3] for x in want}
    # The stream: rows shuffled within two minutes, some of them twice, in seven files; at the end a row that moves the watermark.
    draw = random.Random(5)
    arriving = sorted(listed + draw.sample(listed, 40), key=lambda r: r["ts"] + timedelta(seconds=draw.uniform(0, 120)))
    size = -(-len(arriving) // 7)
    for k in range(7):
        spark.createDataFrame(arriving[k * size : (k + 1) * size], auth.ROW).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    end = spark.createDataFrame([("x", "nobody", "s", "none", 0, "tick", START + timedelta(days=3), None, None), ("late", "r0", "s", "t0", 0, "answered", START, None, None)], auth.ROW)
    end.where("row_id = 'x'").coalesce(1).write.parquet(f"{tmp_path}/in/8")
    end.coalesce(1).write.parquet(f"{tmp_path}/in/9")
    stream = spark.readStream.schema(signed.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = logs.drained(auth.authenticated_stream(stream, known, delay="3 minutes"), f"{tmp_path}/out", f"{tmp_path}/state", provider=auth.ROCKS)
    streamed = sorted({tuple(r)[:3] + (r["verdict"],) for r in found.collect() if r["rater"] != "nobody"})
    assert streamed == want
    counts = [tuple(r)[:3] for r in found.where("verdict <> 'hash mismatch'").collect()]
    assert len(counts) == len(set(counts))
    before = spark.conf.get(auth.PROVIDER)
    assert "RocksDB" not in before


@pytest.mark.parametrize("n", [0, 1])
def test_small(spark, n):
    rows, trials = made(1, n)
    signed = spark.createDataFrame([(None, *r) for r in rows], auth.ROW).withColumn("row_id", auth.identity())
    assert auth.authenticated(signed, spark.createDataFrame(trials, TRIALS)).count() == sum(r[4] == "answered" for r in rows)


def test_calls_grow_with_buckets(spark):
    """A call of the state machine for each trial costs far more than its rows, so trials are put into a bounded number of groups."""
    stream = spark.readStream.format("rate").load().selectExpr("CAST(value AS STRING) AS row_id", "'r' AS rater", "'s' AS session", "CAST(value AS STRING) AS trial", "1 AS trial_index", "'served' AS event", "timestamp AS ts", "'m' AS stimulus", "0D AS initial_s")
    plan = auth.authenticated_stream(stream, spark.createDataFrame([], TRIALS), buckets=7)._jdf.queryExecution().analyzed().toString()
    assert "xxhash64(rater" in plan and "TransformWithStateInPySpark" in plan


@pytest.mark.parametrize("buckets", [1, 7])
def test_trials_of_one_bucket(spark, tmp_path, buckets):
    """Many trials share a state; a second answer that comes after the close, twice, has one verdict; an earlier one moves the close."""
    rows, trials = made(11, 80)
    listed = spark.createDataFrame([(None, *r) for r in rows], auth.ROW).withColumn("row_id", auth.identity()).collect()
    known = spark.createDataFrame(trials, TRIALS)
    late = spark.createDataFrame([(None, "r0", "s", "t0", 0, "answered", START + timedelta(days=d), "m0", 2.0) for d in (2, 2)] + [(None, "r1", "s", "t0", 0, "answered", START + timedelta(days=2, seconds=9), "m0", 2.0)], auth.ROW).withColumn("row_id", auth.identity()).collect()
    tick = lambda d: [("x", "nobody", "s", "none", 0, "tick", START + timedelta(days=d), None, None)]
    files = [listed[150:], listed[:150], tick(1), late[:1], late[1:], tick(3), tick(5)]
    for k, part in enumerate(files):
        spark.createDataFrame(part, auth.ROW).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(auth.ROW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = logs.drained(auth.authenticated_stream(stream, known, delay="1 hour", buckets=buckets), f"{tmp_path}/out", f"{tmp_path}/state", provider=auth.ROCKS)
    streamed = sorted(tuple(r)[:3] + (r["verdict"],) for r in found.collect() if r["rater"] != "nobody")
    every = spark.createDataFrame(listed + late, auth.ROW)
    assert streamed == sorted(tuple(r)[:3] + (r["verdict"],) for r in auth.authenticated(every, known).collect())
