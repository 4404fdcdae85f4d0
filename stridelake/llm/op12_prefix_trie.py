"""Conversation prefix trie: a ternary search tree of each range of conversations, then the nodes that ranges share are merged.

A conversation becomes its path: a SHA-256 digest for each turn (role and text), joined. Paths are range-partitioned and sorted, so
the members of a node stand together. A task cuts its range into blocks of BLOCK turns; for each block it numbers the distinct
turns, inserts the paths median first into a ternary search tree, which that keeps balanced, and goes over the nodes from the
last made to the first, so that children come before parents, to add up members, leaves and savings.
Only the nodes on the first and the last path of a block can go on in another block. They stay open, named by a digest of their
prefix; open nodes are merged over the blocks of a task, then over FAN ranges at a time, and a node that leaves both outer
paths is closed. The members that end at an open node are hashed from one text for each block, in the order of the ranges;
that SHA-256 is one stream for each node by its definition, and the task holds one part of it at a time.

Equal SHA-256 digests count as equal turns or prefixes. The unit is the conversation: its digests (44 bytes a turn) fit in a row.

Defined results: turns of one conversation go by turn, null first, and turns of equal number by their digest; a repeated row is
a turn of its own; a null role or text is empty; a negative conv_id has the remainder of SQL, which is not positive; rows with a null conv_id belong to no conversation and are left out; an empty table has no nodes; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm import common

#: Length of a turn's digest in base64.
WIDTH = 44
#: Turns of a block, and ranges that one task merges.
BLOCK, FAN = 200_000, 256
GROUP, HEADS = 20, 4
EMPTY = hashlib.sha256().hexdigest()
NODES = "kind string, part long, block long, key string, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, first boolean, last boolean, ends string"
NAMES = [c.split()[0] for c in NODES.split(", ")]
TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in NODES.split(", ")]
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, the turn's digest and its number of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.base64(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("key"), words.alias("words"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path, words: the turns of each conversation as they are."""
    grouped = turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "words"))).alias("own"))
    return _joined(grouped, F.col("own"))


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """conv_id, path, words: each conversation behind the first turns of its group's first conversation."""
    rows = turns(conversations).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    # One shuffle: the groups' rows stay where the base puts them.
    placed = rows.repartition(common.partitions(conversations.sparkSession), "base")
    own = placed.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "words"))).alias("own"))
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, heads - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    with_head = own.withColumn("head", F.coalesce(first, F.slice("own", 1, 0))).withColumn("h", h)
    return _joined(with_head, F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own"))))


def _joined(df: DataFrame, sequence) -> DataFrame:
    rows = df.select("conv_id", sequence.alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["key"]), "").alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, list[bytes], list[np.ndarray]]]:
    """Ids, paths and words of the sorted rows, cut after `most` turns."""
    ids, found, words, size = [], [], [], 0
    for batch in batches:
        counts = batch.column("words")
        flat, ends = counts.flatten().to_numpy(zero_copy_only=False), np.cumsum(counts.value_lengths().to_numpy(zero_copy_only=False))
        for k, (conv, path) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), strict=True)):
            depth = len(path) // WIDTH
            ids.append(conv)
            found.append(path.encode())
            words.append(flat[ends[k] - depth : ends[k]])
            size += depth + 1
            if size >= most:
                yield np.array(ids), found, words
                ids, found, words, size = [], [], [], 0
    if ids:
        yield np.array(ids), found, words


class Tree:
    """A ternary search tree of distinct sequences. Node 0 is the root of all; down is the tree of a node's next turns."""

    def __init__(self):
        self.symbol, self.low, self.high, self.down, self.parent, self.depth, self.words = [-1], [-1], [-1], [-1], [-1], [0], [0]
        self.members, self.least, self.ends = [0], [None], [-1]

    def _node(self, symbol: int, parent: int, words: int) -> int:
        for column, value in ((self.symbol, symbol), (self.low, -1), (self.high, -1), (self.down, -1), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.words, words), (self.members, 0), (self.least, None), (self.ends, -1)):
            column.append(value)
        return len(self.symbol) - 1

    def _child(self, parent: int, symbol: int, words: int) -> int:
        at = self.down[parent]
        if at < 0:
            self.down[parent] = at = self._node(symbol, parent, words)
            return at
        while (here := self.symbol[at]) != symbol:
            side = self.low if symbol < here else self.high
            if side[at] < 0:
                side[at] = new = self._node(symbol, parent, words)
                return new
            at = side[at]
        return at

    def insert(self, symbols: list[int], words: list[int], members: int, least: int, group: int) -> None:
        at = 0
        self._count(0, members, least)
        for symbol, w in zip(symbols, words, strict=True):
            at = self._child(at, symbol, w)
            self._count(at, members, least)
        self.ends[at] = group

    def _count(self, at: int, members: int, least: int) -> None:
        self.members[at] += members
        if self.least[at] is None or least < self.least[at]:
            self.least[at] = least

    def path(self, symbols: list[int]) -> list[int]:
        found = [0]
        for symbol in symbols:
            found.append(self._child(found[-1], symbol, 0))
        return found


def _medians(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle of each stretch before its halves."""
    open_ = [(0, n)]
    while open_:
        a, b = open_.pop()
        if a < b:
            yield (a + b) // 2
            open_ += [((a + b) // 2 + 1, b), (a, (a + b) // 2)]


def _keys(path: bytes) -> list[str]:
    """The digests of a path's prefixes, from the empty one on."""
    h, out = hashlib.sha256(), [EMPTY]
    for at in range(0, len(path), WIDTH):
        h.update(path[at : at + WIDTH])
        out.append(h.hexdigest())
    return out


def _row(kind: str, **values) -> dict:
    return dict.fromkeys(NAMES) | {"kind": kind} | values


def block_nodes(ids: np.ndarray, found: list[bytes], words: list[np.ndarray], part: int, block: int) -> list[dict]:
    """Closed nodes, open nodes and end texts of one block of sorted rows."""
    starts = [k for k in range(len(found)) if not k or found[k] != found[k - 1]]
    stops = [*starts[1:], len(found)]
    tokens = np.frombuffer(b"".join(found[k] for k in starts), f"S{WIDTH}")
    symbols = np.unique(tokens, return_inverse=True)[1].ravel()
    cuts = np.concatenate([[0], np.cumsum([len(found[k]) // WIDTH for k in starts])])
    of = lambda g: symbols[cuts[g] : cuts[g + 1]].tolist()
    tree = Tree()
    for g in _medians(len(starts)):
        tree.insert(of(g), words[starts[g]].tolist(), stops[g] - starts[g], int(ids[starts[g]]), g)
    key: dict[int, str] = {}
    outer = []
    for g in (0, len(starts) - 1):
        outer.append(tree.path(of(g)))
        key |= dict(zip(outer[-1], _keys(found[starts[g]]), strict=True))
    first, last = map(set, outer)
    text = lambda v: ",".join(map(str, ids[starts[tree.ends[v]] : stops[tree.ends[v]]].tolist()))
    n = len(tree.symbol)
    children, leaves, saved, out = [0] * n, [0] * n, [0] * n, []
    for v in range(n - 1, -1, -1):
        p = tree.parent[v]
        if v in key:
            out.append(_row("open", part=part, key=key[v], parent_key=key.get(p), conv_id=tree.least[v], depth=tree.depth[v], n_convs=tree.members[v], n_children=children[v], n_leaves=leaves[v], saved_tokens=saved[v], words=tree.words[v], first=v in first, last=v in last))
            if tree.ends[v] >= 0:
                out.append(_row("ends", part=part, block=block, key=key[v], ends=text(v)))
            continue
        leaves[v] += not children[v]
        saved[v] += (tree.members[v] - 1) * tree.words[v]
        children[p], leaves[p], saved[p] = children[p] + 1, leaves[p] + leaves[v], saved[p] + saved[v]
        digest = EMPTY if tree.ends[v] < 0 else hashlib.sha256(text(v).encode()).hexdigest()
        out.append(_row("closed", parent_key=key.get(p), conv_id=tree.least[v], depth=tree.depth[v], parent_conv_id=None if p in key else tree.least[p], n_convs=tree.members[v], n_children=children[v], n_leaves=leaves[v], saved_tokens=saved[v], ends=digest))
    return out


def merged(rows: list[dict], part: int, final: bool) -> list[dict]:
    """Open nodes of neighbouring ranges as open nodes of the range that they make up; those within it come out as "shared".

    rows: of ranges numbered by part, a node at most once in a range. final: nothing stays open.
    """
    ends = [f([r["part"] for r in rows]) for f in (min, max)] if rows else []
    nodes: dict[str, dict] = {}
    for r in rows:
        v = nodes.setdefault(r["key"], r | {"part": part, "first": False, "last": False, "conv_id": r["conv_id"]} | dict.fromkeys(("n_convs", "n_children", "n_leaves", "saved_tokens"), 0))
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            v[c] += r[c]
        v["conv_id"] = min(v["conv_id"], r["conv_id"])
        v["first"] |= not final and r["first"] and r["part"] == ends[0]
        v["last"] |= not final and r["last"] and r["part"] == ends[1]
    out = []
    for v in sorted(nodes.values(), key=lambda v: -v["depth"]):
        if not (v["first"] or v["last"]):
            v["kind"] = "shared"
            v["n_leaves"] += not v["n_children"]
            v["saved_tokens"] += (v["n_convs"] - 1) * v["words"]
            if v["parent_key"] is not None:
                p = nodes[v["parent_key"]]
                p["n_children"] += 1
                p["n_leaves"] += v["n_leaves"]
                p["saved_tokens"] += v["saved_tokens"]
        out.append(v)
    return out


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(NAMES, TYPES, strict=True)], NAMES)


def _shard_nodes(ordered: DataFrame, most: int) -> DataFrame:
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_ = TaskContext.get().partitionId(), []
        for k, block in enumerate(_blocks(batches, most)):
            rows = block_nodes(*block, part, k)
            open_ += [r | {"part": k} for r in rows if r["kind"] == "open"]
            yield _batch([r for r in rows if r["kind"] != "open"])
        yield _batch(merged(open_, part, False))

    return ordered.mapInArrow(tasks, NODES)


def _merged_ranges(open_: DataFrame, fan: int, final: bool) -> DataFrame:
    def group(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(merged(rows.select(NAMES).to_pylist(), key[0].as_py(), final))])

    return open_.withColumn("range", F.floor(F.col("part") / fan)).groupBy("range").applyInArrow(group, NODES)


def _hashed(ends: DataFrame) -> DataFrame:
    """key and digest of its members' text, whose parts come in the order of the ranges."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, hashlib.sha256()
        for batch in batches:
            keys, digests = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if key == now:
                    h.update(b"," + text.encode())
                    continue
                if now is not None:
                    keys.append(now)
                    digests.append(h.hexdigest())
                now, h = key, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["key", "digest"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([h.hexdigest()])], ["key", "digest"])

    placed = ends.select("key", "part", "block", "ends").repartition(common.partitions(ends.sparkSession), "key").sortWithinPartitions("key", "part", "block")
    return placed.mapInArrow(tasks, "key string, digest string")


def trie(sequences: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """The nodes of the prefix trie of sequences (conv_id, path, words), conv_id without repeats."""
    spark = sequences.sparkSession
    n = common.partitions(spark)
    rows = common.written(sequences, "paths")
    ordered = rows.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = common.written(_shard_nodes(ordered, block), "nodes")
    open_, shared = found.where("kind = 'open'"), found.where("kind = 'shared'")
    while n > fan:
        step = common.written(_merged_ranges(open_, fan, False), "merged")
        open_, shared, n = step.where("kind = 'open'"), shared.unionByName(step.where("kind = 'shared'")), -(-n // fan)
    shared = common.written(shared.unionByName(_merged_ranges(open_, fan, True)), "shared")
    parents = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    digests = _hashed(found.where("kind = 'ends'"))
    inner = found.where("kind = 'closed' AND parent_key IS NULL").select(*RESULT, F.col("ends").alias("ends_sha256"))
    top = found.where("kind = 'closed' AND parent_key IS NOT NULL").select("parent_key", *RESULT, "ends")
    of_shared = shared.join(digests, "key", "left").select("parent_key", *RESULT, F.coalesce("digest", F.lit(EMPTY)).alias("ends"))
    above = top.unionByName(of_shared).join(parents, "parent_key", "left")
    return inner.unionByName(above.select(*[F.col("above").alias(c) if c == "parent_conv_id" else F.col(c) for c in RESULT], F.col("ends").alias("ends_sha256")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt behind the first turns of its group."""
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
