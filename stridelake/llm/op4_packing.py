"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source, null too, is a queue of its documents' ids in document order. The first x ids are dealt out by a binary tree over
the queues: a node that has got y ids gives round(y * left / whole) of them to its left half and the others to its right half,
for the weights of both. So each window of `size` ids is filled to its last id, a queue never gives back an id, its deficit
stays below the depth of the tree (log2 of the queues) and is carried on where it earns less than one id a window, and the
state at any window or partition follows from its number alone. Every task cuts its own documents, and no task replays the
windows before it. A queue that runs dry ends a phase; the others share from there.

The default weights are the sources' shares of all ids, which keep the mixture up to the last window; the tree is then a table
with one row for each source, joined to the rows. Sources with a weight given by the caller are dealt out on the driver first,
and all others share the weight that is left in proportion to their ids.

Defined results: a null text is empty and keeps its end id; null is a source; repeated rows are packed each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm import common, tokens

END_ID = 1
SIZE = 2048
#: Documents that are cut at once.
CUT = 4096
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int"


def _share(y: np.ndarray, part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """y * part / whole, rounded, without overflow."""
    y, part, whole = (np.asarray(a, np.int64) for a in (y, part, whole))
    whole = np.maximum(whole, 1)
    if int(y.max(initial=0)) * int(part.max(initial=0)) + int(whole.max(initial=0)) < 2**62:
        return (y * part + whole // 2) // whole
    near = (y.astype(np.longdouble) * part / whole).astype(np.int64)
    return near + (y * part + whole // 2 - near * whole) // whole  # the wrapped difference is less than a few wholes


def _walk(y: np.ndarray, left: np.ndarray, whole: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What leaves get of y ids, and what the leaves before them get. Rows of left, whole and right are the levels of the tree."""
    below = np.zeros(len(y), np.int64)
    for at, total, turn in zip(left, whole, right, strict=True):
        part = _share(y, at, total)
        below, y = below + np.where(turn, part, 0), np.where(turn, y - part, part)
    return y, below


class Schedule:
    """Who takes how many ids by when. totals: ids of each queue; weights: targets, by default the totals."""

    def __init__(self, totals: list[int], weights: list[int] | None = None):
        self.n, self.depth = sum(totals), max(0, len(totals) - 1).bit_length()
        left, taken, at, self.phases = list(totals), [0] * len(totals), 0, []
        weights, every = list(weights) if weights else list(totals), np.arange(len(totals))
        while any(left):
            w = [weights[k] if n else 0 for k, n in enumerate(left)]
            run = sum(left) if w == left else min((left[k] - max(1, self.depth)) * sum(w) // x for k, x in enumerate(w) if x)
            if run <= len(left):  # some queue is nearly dry: its few ids go out at once
                w = [n if n <= 2 * len(left) else 0 for n in left]
                run = sum(w)
            cum = np.concatenate([[0], np.cumsum(np.array(w, np.int64)), np.full((1 << self.depth) - len(w), sum(w), np.int64)])
            self.phases.append((at, np.array(taken, np.int64), np.concatenate([[0], np.cumsum(np.array(taken, np.int64))]), cum))
            more = self._dealt(cum, np.full(len(w), run, np.int64), every)[0].tolist()
            taken, left, at = [a + b for a, b in zip(taken, more, strict=True)], [a - b for a, b in zip(left, more, strict=True)], at + run
        self.starts = np.array([p[0] for p in self.phases], np.int64)

    def _dealt(self, cum: np.ndarray, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spans = [1 << k for k in range(self.depth, 0, -1)]
        first = [s // k * k for k in spans]
        left = [cum[f + k // 2] - cum[f] for f, k in zip(first, spans, strict=True)]
        return _walk(y, left, [cum[f + k] - cum[f] for f, k in zip(first, spans, strict=True)], [s >= f + k // 2 for f, k in zip(first, spans, strict=True)])

    def split(self, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids that queue s, and the queues before s, have taken among the first x."""
        x, s = np.minimum(x, self.n), np.asarray(s)
        own, below, phase = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.searchsorted(self.starts, x, "right") - 1
        for k in np.unique(phase):
            at = phase == k
            start, taken, before, cum = self.phases[k]
            a, b = self._dealt(cum, x[at] - start, s[at])
            own[at], below[at] = taken[s[at]] + a, before[s[at]] + b
        return own, below

    def taken(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        return self.split(x, s)[0]


class Queues:
    """The queues of some rows: s in the schedule, and below it the way down the tree of those that share one place."""

    def __init__(self, schedule: Schedule, s: np.ndarray, leaf: np.ndarray, left: np.ndarray, whole: np.ndarray):
        self.schedule, self.s, self.left, self.whole = schedule, s, left, whole
        self.right = np.array([leaf >> (len(left) - 1 - k) & 1 for k in range(len(left))], bool).reshape(left.shape)

    def split(self, x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids that the queue of each row, and the queues before it, have taken among the first x."""
        y, before = self.schedule.split(x, self.s[row])
        own, below = _walk(y, self.left[:, row], self.whole[:, row], self.right[:, row])
        return own, before + below

    def window_of(self, token: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
        """The window in which the queue of each row gives its id number `token`."""
        lo, hi = np.zeros(len(token), np.int64), np.full(len(token), (self.schedule.n - 1) // size, np.int64)
        while len(lo) and (lo < hi).any():
            mid = (lo + hi) // 2
            done = self.split((mid + 1) * size, row)[0] > token
            hi, lo = np.where(done, mid, hi), np.where(done, lo, mid + 1)
        return lo


def tree(totals: DataFrame, first: int) -> tuple[DataFrame, int]:
    """source, queue (from first on), leaf, and left and whole of each node on the way to it, of rows (source, n); the depth."""
    spark = totals.sparkSession
    rows, parts = common.numbered(totals, "source", name="sources")
    at, starts = 0, []
    for r in parts.orderBy("_part").collect():  # one row for each partition
        starts.append((r["_part"], at))
        at += r["_n"]
    depth = max(0, at - 1).bit_length()
    leaves = rows.join(F.broadcast(spark.createDataFrame(starts, "_part long, _start long")), "_part").select("source", "n", (F.col("_start") + F.col("_idx")).alias("leaf"))
    out = ["source", (F.col("leaf") + first).cast("int").alias("queue"), "leaf"]
    if not depth:
        return leaves.select(*out, *[F.array().cast("array<long>").alias(x) for x in ("left", "whole")]), 0
    levels = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("node", F.expr(f"shiftright(leaf, {depth} - level)"))
    sums = common.written(levels.groupBy("level", "node").agg(F.sum("n").alias("whole")), "nodes")
    halves = sums.where("node % 2 = 0 and level > 0").select((F.col("level") - 1).alias("level"), F.shiftright("node", 1).alias("node"), F.col("whole").alias("left"))
    ways = levels.where(F.col("level") < depth).join(sums.join(halves, ["level", "node"]), ["level", "node"])
    ways = ways.groupBy("source", "leaf").agg(F.array_sort(F.collect_list(F.struct("level", "left", "whole"))).alias("way"))
    return ways.select(*out, F.col("way.left").alias("left"), F.col("way.whole").alias("whole")), depth


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """uid, doc_id, source, n_tokens and the ids (16 bits each where they fit)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, uid = tokens.encoder(tokenizer, False), TaskContext.get().partitionId() << 33
        kind = "<u2" if encoder.tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else "<u4"
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                ids, n = encoder.encode([x or "" for x in some.column(1).to_pylist()])
                ends = np.cumsum(n)
                raw = [np.append(ids[e - m : e], end_id).astype(kind).tobytes() for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(n))), some.column(0), some.column(2), pa.array(n + 1), pa.array(raw, pa.binary()), pa.array([kind] * len(n))], ["uid", "doc_id", "source", "n_tokens", "ids", "kind"])
                uid += len(n)

    return docs.select("doc_id", "text", "source").mapInArrow(rows, "uid long, doc_id long, source string, n_tokens long, ids binary, kind string")


def pack(docs: DataFrame, weights: dict[str, float] | None = None, size: int = SIZE, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents (doc_id, text, source) in windows of `size` ids. weights: target share of each source."""
    stored = common.written(encoded(docs, tokenizer or tokens.public_path(tokens.WORD_BPE), end_id), "ids")
    totals = stored.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    whole = totals.agg(F.sum("n")).first()[0] or 0
    # The driver holds what the caller's weights name; all other sources stay in a table.
    named = {k: w for k, w in (weights or {}).items() if w > 0}
    known = F.col("source").isin([k for k in named if k is not None])
    known = F.coalesce(known, F.lit(None in named))
    own = {r["source"]: r["n"] for r in totals.where(known).orderBy("source").collect()} if named else {}
    sizes = [*own.values(), whole - sum(own.values())]
    shares = [max(1, round(named[s] * 1e6)) for s in own] + [max(1, round(1e6 * (1 - min(1.0, sum(named[s] for s in own)))))] if weights is not None else None
    schedule = Schedule(sizes, shares)
    queues, depth = tree(totals.where(~known) if named else totals, len(own))
    queues = queues.withColumn("place", F.lit(len(own)))
    if own:
        listed = docs.sparkSession.createDataFrame([(s, k, (1 << depth) - 1, [0] * depth, [1] * depth, k) for k, s in enumerate(own)], "source string, queue int, leaf long, left array<long>, whole array<long>, place int")
        queues = queues.unionByName(listed)
    queues = common.written(queues, "queues")

    of = queues.select(F.col("source").alias("_source"), "queue")
    narrow = stored.select("source", "doc_id", "uid", "n_tokens").join(of, F.col("source").eqNullSafe(F.col("_source"))).select("queue", "doc_id", "uid", "n_tokens")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, total = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            q, n = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            if not len(q):
                continue
            first = np.append(True, q[1:] != q[:-1])
            start = np.cumsum(n) - n
            start -= start[first][np.cumsum(first) - 1]
            start[q == last] += total
            last, total = q[-1], int(start[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(start), pa.array(np.full(len(n), part, np.int64))], ["queue", "uid", "n_tokens", "in_part", "part"])

    order = ["queue", "doc_id", "uid"]
    placed = narrow.repartitionByRange(common.partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    placed = common.written(placed.mapInArrow(running, "queue int, uid long, n_tokens long, in_part long, part long"), "queue")
    parts = placed.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n"))
    # One row for each partition of the sort, and one more for each queue.
    before = parts.select("queue", "part", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("before"))
    starts = placed.join(before, ["queue", "part"]).select("uid", "queue", (F.col("before") + F.col("in_part")).alias("at"))
    starts = starts.join(queues.drop("source"), "queue")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(k, CUT) for x in batches for k in range(0, x.num_rows, CUT)):
            at, n, s, leaf, place = (batch.column(k).to_numpy() for k in (3, 1, 4, 6, 9))
            left, whole = (batch.column(k).flatten().to_numpy().reshape(len(n), depth).T for k in (7, 8))
            taking, row = Queues(schedule, place, leaf, left, whole), np.arange(len(n))
            first, last = taking.window_of(at, row, size), taking.window_of(at + n - 1, row, size)
            many = last - first + 1
            wide = many > n  # fewer ids than windows: by ids
            count = np.where(wide, n, many)
            doc = np.repeat(row, count)
            w = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            thin = wide[doc]
            w[~thin] += first[doc[~thin]]
            w[thin] = taking.window_of(at[doc[thin]] + w[thin], doc[thin], size)
            new = np.append(True, (w[1:] != w[:-1]) | (doc[1:] != doc[:-1]))[: len(w)]
            doc, w = doc[new], w[new]
            opens, below = taking.split(w * size, doc)
            closes, under = taking.split((w + 1) * size, doc)
            lo, hi = np.maximum(at[doc], opens), np.minimum(at[doc] + n[doc], closes)
            offset = under - below + lo - opens
            some = hi > lo
            doc, w, lo, hi, offset = doc[some], w[some], lo[some], hi[some], offset[some]
            raw, kinds, crc, held, ids = batch.column(2), batch.column(5), np.zeros(len(doc), np.int64), -1, None
            a, b = (lo - at[doc]).tolist(), (hi - at[doc]).tolist()
            for k, d in enumerate(doc.tolist()):
                if d != held:
                    held, ids = d, memoryview(np.frombuffer(raw[d].as_buffer(), kinds[d].as_py()).astype("<u4")).cast("B")
                crc[k] = zlib.crc32(ids[4 * a[k] : 4 * b[k]])
            arrays = [batch.column(0).take(pa.array(doc)), *map(pa.array, (lo - at[doc], hi - lo, crc, n[doc], w, offset)), pa.array(s[doc].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in OUT.split(", ")])

    joined = stored.join(starts, "uid").select("doc_id", "n_tokens", "ids", "at", "queue", "kind", "leaf", "left", "whole", "place")
    return joined.mapInArrow(pieces, OUT)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
