"""Which answers were really shown to their rater, as a keyed state machine over a stream and as one batch query.

Rows are events of a trial: served, started, completed, answered. A row's id is the digest of its content; rows whose id is another are
reported and count for nothing. A trial closes `wait` after its first answer, when the watermark has passed, so rows may come in
any order until then; rows that come again under one id count once. Of several events of a kind with the answer's session and index
the first counts.

Verdicts of an answer: authentic; duplicate answer (another answer before the trial closed); wrong trial (stimulus, index or
rater are not the trial's); not served (an event is missing); order (served, started, completed, answered do not follow each other);
incomplete (shown for less than its duration less two frames, by the events or by the answer itself); after close; hash mismatch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = ("served", "started", "completed")
ROW = "row_id string, rater string, session string, trial string, trial_index int, event string, ts timestamp, stimulus string, initial_s double"
RESULT = "rater string, trial string, row_id string, at long, verdict string"
RESULT_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
#: Groups that trials and raters are put into by hash; a task holds the open trials of one of them.
BUCKETS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def identity() -> Column:
    """The id that a row's content gives: a digest of its fields as JSON with sorted keys."""
    fields = sorted(c.split()[0] for c in ROW.split(", ") if not c.startswith("row_id"))
    return F.sha2(F.to_json(F.struct(*[F.unix_micros("ts").alias("ts") if c == "ts" else F.col(c) for c in fields])), 256)


def prepared(rows: DataFrame, trials: DataFrame) -> DataFrame:
    """Rows with their trial's facts (trial, stimulus, trial_index, rater, least_s) as flags; trials: one row for each trial, static."""
    facts = trials.select("trial", F.struct(F.col("stimulus"), F.col("trial_index"), F.col("eligible_rater"), (F.col("duration_s") - 2 / F.col("fps")).alias("least_s")).alias("fact"))
    joined = rows.join(facts, "trial", "left")
    own = (F.col("stimulus") == F.col("fact.stimulus")) & (F.col("trial_index") == F.col("fact.trial_index")) & F.coalesce(F.col("fact.eligible_rater") == F.col("rater"), F.lit(True))
    return joined.select("row_id", "rater", "session", "trial", "trial_index", "event", "ts", F.unix_micros("ts").alias("at"), (F.col("row_id") == identity()).alias("good"), F.coalesce(own, F.lit(False)).alias("own"), F.coalesce("initial_s", F.lit(0.0)).alias("initial_s"), F.coalesce("fact.least_s", F.lit(0.0)).alias("least_s"))


OPEN = pa.schema([("rater", pa.string()), ("trial", pa.string()), ("event", pa.string()), ("at", pa.int64()), ("session", pa.string()), ("trial_index", pa.int32()), ("row_id", pa.string()), ("own", pa.bool_()), ("initial_s", pa.float64()), ("least_s", pa.float64())])
SHUT = pa.schema([("rater", pa.string()), ("trial", pa.string())])
SEEN = pa.schema([("rater", pa.string()), ("trial", pa.string()), ("row_id", pa.string()), ("at", pa.int64())])
TRIAL = ["rater", "trial"]


def packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    """Rows as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(pa.Table.from_pandas(rows[schema.names], schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def typed(table: pa.Table) -> pd.DataFrame:
    """A table as pandas columns that hold nulls without a change of type."""
    return table.to_pandas(types_mapper={pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype(), pa.string(): pd.StringDtype("python")}.get)


def unpacked(data: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    return typed(pa.ipc.open_stream(data).read_all() if data else schema.empty_table())


def verdicts(rows: pd.DataFrame, wait: int) -> pd.DataFrame:
    """Verdict of each answer of closed trials (rows: OPEN, times in microseconds)."""
    answers = rows[rows["event"] == "answered"].sort_values(["at", "row_id"])
    first = answers.drop_duplicates(TRIAL)
    closes = answers.merge(first[TRIAL].assign(closes=first["at"] + wait), on=TRIAL)
    inside = closes["at"] <= closes["closes"]
    first = first.merge(closes[inside].groupby(TRIAL, dropna=False).size().rename("answers").reset_index(), on=TRIAL)
    presented = [*TRIAL, "session", "trial_index"]
    for event in EVENTS:
        found = rows[rows["event"] == event].groupby(presented, dropna=False)["at"].min().rename(event).reset_index()
        first = first.merge(found, on=presented, how="left")
        first[event] = first[event].where(first[event] <= first["at"] + wait)
    served, started, completed, at = (first[c] for c in (*EVENTS, "at"))
    missing = served.isna() | started.isna() | completed.isna()
    ordered = ((served <= started) & (started <= completed) & (completed <= at)).fillna(False)
    short = ((completed - started).astype("Float64") / 1e6 < first["least_s"]).fillna(False) | (first["initial_s"] < first["least_s"])
    tests = [first["answers"] > 1, ~first["own"], missing, ~ordered, short]
    said = np.select([t.to_numpy(bool) for t in tests], ["duplicate answer", "wrong trial", "not served", "order", "incomplete"], "authentic")
    others = closes.assign(verdict=np.where(inside.to_numpy(bool), "duplicate answer", "after close"))[closes.duplicated(TRIAL).to_numpy(bool)]
    return pd.concat([first.assign(verdict=said), others])[RESULT_COLUMNS]


class Trials(StatefulProcessor):
    """State of a bucket of trials and raters, as Arrow tables that are read and written whole: the first time of each event by session and
    index and the answers of trials that are open, which trials are closed, and the ids of answers to these that can still come again (the
    watermark drops what is older). One timer, for the open trial that closes first; then all that are due close."""

    def __init__(self, wait_s: int):
        self.wait = wait_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open, self.shut, self.seen = (handle.getValueState(name, "data binary") for name in ("open", "shut", "seen"))
        self.timer = handle.getValueState("timer", "ms long")

    def held(self, state: Any, schema: pa.Schema) -> pd.DataFrame:
        return unpacked(bytes(state.get()[0]) if state.exists() else None, schema)

    def kept(self, rows: pd.DataFrame) -> None:
        """Stores the open trials' rows and sets the timer."""
        self.open.update((packed(rows, OPEN),))
        answered = rows.loc[rows["event"] == "answered", "at"]
        due = (int(answered.min()) + self.wait) // 1000 + 1 if len(answered) else None
        before = self.timer.get()[0] if self.timer.exists() else None
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(due)
                self.timer.update((due,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        good = got["good"].to_numpy(bool)
        out = [got[~good].assign(verdict="hash mismatch")[RESULT_COLUMNS]]
        new = got.loc[good & got["event"].isin([*EVENTS, "answered"]).to_numpy(bool), OPEN.names]
        new = typed(pa.Table.from_pandas(new, OPEN, preserve_index=False))
        shut = new.merge(self.held(self.shut, SHUT).assign(known=1), on=TRIAL, how="left")["known"].notna().to_numpy(bool)
        later = new[shut & (new["event"] == "answered").to_numpy(bool)].drop_duplicates([*TRIAL, "row_id"])
        if len(later):
            seen = self.held(self.seen, SEEN)
            later = later[later.merge(seen[[*TRIAL, "row_id"]].assign(known=1), on=[*TRIAL, "row_id"], how="left")["known"].isna().to_numpy(bool)]
            out.append(later.assign(verdict="after close")[RESULT_COLUMNS])
            self.seen.update((packed(pd.concat([seen, later[SEEN.names]]), SEEN),))
        if not shut.all():
            both = pd.concat([self.held(self.open, OPEN), new[~shut]])
            answered = (both["event"] == "answered").to_numpy(bool)
            times = both[~answered].sort_values("at").drop_duplicates([*TRIAL, "event", "session", "trial_index"])
            times = times.assign(**{c: pd.Series(pd.NA if c in ("row_id", "own") else np.nan, times.index, both[c].dtype) for c in ("row_id", "own", "initial_s", "least_s")})
            self.kept(pd.concat([both[answered].drop_duplicates([*TRIAL, "row_id"]), times]))
        yield pd.concat(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = self.held(self.open, OPEN)
        closes = rows[rows["event"] == "answered"].groupby(TRIAL, dropna=False)["at"].min().rename("closes").reset_index()
        closes = closes[((closes["closes"] + self.wait) // 1000 + 1 <= now).to_numpy(bool)]
        due = rows.merge(closes, on=TRIAL, how="left")["closes"].notna().to_numpy(bool)
        self.timer.clear()
        self.kept(rows[~due])
        self.shut.update((packed(pd.concat([self.held(self.shut, SHUT), closes[TRIAL]]), SHUT),))
        ended = rows[due]
        seen = pd.concat([self.held(self.seen, SEEN), ended.loc[(ended["event"] == "answered").to_numpy(bool), SEEN.names]])
        self.seen.update((packed(seen[(seen["at"] >= now * 1000).to_numpy(bool)], SEEN),))
        yield verdicts(ended, self.wait)

    def close(self) -> None:
        pass


def authenticated_stream(rows: DataFrame, trials: DataFrame, wait_s: int = 60, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """The stream form. The state is kept by bucket, as a call for each trial costs far more than its rows. A closed trial is never opened
    again, and a repeat of one of its answers gets no second verdict. buckets can't change under one checkpoint."""
    checked = prepared(rows, trials).withColumn("bucket", F.pmod(F.xxhash64("rater", "trial"), F.lit(buckets))).withWatermark("ts", delay)
    return checked.groupBy("bucket").transformWithStateInPandas(Trials(wait_s), RESULT, "append", "eventtime")


def authenticated(rows: DataFrame, trials: DataFrame, wait_s: int = 60) -> DataFrame:
    """The batch form: one shuffle by rater and trial."""
    checked = prepared(rows, trials)
    key = Window.partitionBy("rater", "trial")
    good = checked.where("good").dropDuplicates(["rater", "trial", "row_id"])
    first = F.min(F.when(F.col("event") == "answered", F.struct("at", "row_id", "session", "trial_index"))).over(key)
    marked = good.withColumn("first", first).where("first IS NOT NULL").withColumn("inside", F.col("at") <= F.col("first.at") + wait_s * 1_000_000)
    matched = F.col("inside") & F.col("session").eqNullSafe(F.col("first.session")) & F.col("trial_index").eqNullSafe(F.col("first.trial_index"))
    times = [F.min(F.when(matched & (F.col("event") == e), F.col("at"))).over(key).alias(e) for e in EVENTS]
    answers = F.count_if(F.col("inside") & (F.col("event") == "answered")).over(key)
    found = marked.select("*", *times, answers.alias("answers")).where("event = 'answered'")
    served, started, completed = (F.col(e) for e in EVENTS)
    said = F.when(~F.col("inside"), "after close").when(F.col("answers") > 1, "duplicate answer").when(~F.col("own"), "wrong trial").when(served.isNull() | started.isNull() | completed.isNull(), "not served")
    said = said.when(~((served <= started) & (started <= completed) & (completed <= F.col("at"))), "order")
    said = said.when(((completed - started) / 1e6 < F.col("least_s")) | (F.col("initial_s") < F.col("least_s")), "incomplete").otherwise("authentic")
    bad = checked.where("NOT good").select("rater", "trial", "row_id", "at", F.lit("hash mismatch").alias("verdict"))
    return found.select("rater", "trial", "row_id", "at", said.alias("verdict")).unionByName(bad)
