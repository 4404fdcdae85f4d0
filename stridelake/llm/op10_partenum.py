"""N-gram Jaccard join by PartEnum signatures, and the groups that its links make.

A document's set holds its distinct 5-word shingles as 64-bit hashes; equal sets are one node. Sets are dealt into bands of
size. In a band the hash domain is cut into N1 parts of N2 parts each, and every subset of N2 - K2 parts of a first-level part
makes one signature. Two sets that link differ in at most k elements, k from the band's largest size, so they share at least
one signature; sets of given sizes differ in fewer, so they share `least` of them. A set near the upper end of its band also
signs for the next band. A set that shares fewer signatures with others than any link of its size needs is done.

For the sets that are left the same count is taken over single elements (`_open`), and then they are linked exactly:
1. Turns of stars: of its least elements' holders each node is compared with one, and links merge labels, while turns find links.
2. Nodes that may still link with another label, by the elements which other labels hold, are counted against whole labels:
   a node and a label are a case only if the label's sets together hold as many of the node's elements as one partner must.
   Cases come from the node's rarest elements, so many that any link must show one, then so many that it must show most of
   them; members of the label likewise. A label of at most FEW nodes is compared node by node instead of counted.
Every comparison is exact on whole sets; no bucket, partner or candidate is capped, and no group's pairs are listed: a pair of
nodes is compared as a star, or if both hold nearly all that a link takes.

Hot signatures: a task tells those that two of its own sets hold apart, so that only one row of a task goes to the signature's
group. Elements are summed before they are shuffled, and the joins on them are ones that Spark splits where a key is hot.

Defined results: a null or empty text, or one without words, has an empty set, links with nothing and is its own component;
with fewer than five words the whole sequence is the one shingle; a null doc_id keeps its row, links with nothing and has a
null component; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm import common

WORDS = 5
SIMILARITY = 80
N2, K2 = 3, 1
#: A band's largest size over its smallest.
BAND = 2.0
#: Ids up to this many are broadcast (about 24 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Elements of a node that stars go by.
LEAST_ELEMENTS = 32
#: Stars go on until two turns in a row, one of each kind, link a smaller share of the nodes each.
TURN_SHARE = 0.02
#: A label of up to so many nodes is compared node by node; a larger one is counted first.
FEW = 8
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
#: A-Z in lower case; other bytes stay.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of words: all but white space and the mark between texts, which UTF-8 never has.
_BETWEEN = 0xFF
_IN_WORD = np.array([c not in (0x20, *range(0x09, 0x0E), _BETWEEN) for c in range(256)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


#: Of a number's bytes the first k, k up to 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each word raw[start:end]: its length and its bytes, eight at a time, each mixed into what came before."""
    import xxhash

    eights = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from each place on
    n = ends - starts
    out = _mix(_mix((eights[starts] & _FIRST[np.minimum(n, 8)]) + np.uint64(seed)) + n.astype(np.uint64))
    at, k = np.flatnonzero((n > 8) & (n <= LONG_WORD)), 8
    while len(at):
        out[at] = _mix(out[at] ^ _mix(eights[starts[at] + k] & _FIRST[np.minimum(n[at] - k, 8)]))
        k += 8
        at = at[n[at] > k]
    for at in np.flatnonzero(n > LONG_WORD).tolist():
        out[at] = xxhash.xxh3_64_intdigest(raw[starts[at] : ends[at]], seed)
    return out


def batch_shingles(texts: list[str | None], seed: int = 0) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles."""
    raw = bytes([_BETWEEN]).join((t or "").encode("utf-8", "surrogatepass") for t in texts).translate(_LOWER)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IN_WORD[np.frombuffer(raw, np.uint8)]
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    h = _word_hashes(raw, starts, ends, seed)
    marks = np.flatnonzero(np.frombuffer(raw, np.uint8) == _BETWEEN)
    bounds = np.concatenate([[0], np.searchsorted(starts, marks), [len(starts)]])
    rolled = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled += h[k : k + len(rolled)] * _WEIGHTS[k]
    rolled, out = _mix(rolled), []
    for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - at >= WORDS:
            own = np.sort(rolled[at : end - WORDS + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif end > at:
            own = (h[at:end] * _WEIGHTS[: end - at]).sum(dtype=np.uint64)
            out.append(_mix(np.array([own], np.uint64) + np.uint64(end - at)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


#: (smallest, largest) size of each band, made as far as sets need them.
_bands: list[tuple[int, int]] = [(1, 1)]


def instances(n: int) -> list[tuple[int, int, int]]:
    """Number and largest size of the bands for which a set of n elements signs, and the size of its largest partner there."""
    while _bands[-1][0] <= 2 * n:
        low = _bands[-1][1] + 1
        _bands.append((low, max(low, int(low * BAND))))
    own = next(k for k, (low, high) in enumerate(_bands) if low <= n <= high)
    most = 100 * n // SIMILARITY
    out = [(own, _bands[own][1], min(most, _bands[own][1]))]
    if most >= _bands[own + 1][0]:
        out.append((own + 1, _bands[own + 1][1], most))
    return out


def differ(n: int, m: int) -> int:
    """Elements that are in one of two linked sets only, at most."""
    return (n + m) * (100 - SIMILARITY) // (100 + SIMILARITY)


#: By the number of the band.
_layouts: dict[int, tuple] = {}


def layout(number: int, largest: int) -> tuple:
    """k, N1, and the parts' first hashes and salts, for band `number` of sets of up to `largest` elements.

    Part j is the part j // N1 of the first-level part j % N1."""
    if number not in _layouts:
        k = differ(largest, largest)
        n1 = math.ceil((k + 1) / (K2 + 1))
        starts = np.array([(j << 64) // (n1 * N2) for j in range(n1 * N2)], np.uint64)
        _layouts[number] = (k, n1, starts, _mix(np.arange(n1 * N2, dtype=np.uint64) + np.uint64(number << 32)))
    return _layouts[number]


def least_shared(n1: int, h: int) -> int:
    """Signatures that two sets share at least if they differ in h of the parts: each part that differs takes subsets away."""
    left = [math.comb(N2 - d, N2 - K2) for d in range(K2 + 2)]
    shared = n1 * left[0]
    for d in range(K2 + 1):
        hit = min(h, n1)
        shared, h = shared - hit * (left[d] - left[d + 1]), h - hit
    return shared


_SUBSETS = list(combinations(range(N2), N2 - K2))


def signatures(u: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each band that the set signs for: its signatures, and how many of them a link must share at least."""
    out, sums = [], np.zeros(len(u) + 1, np.uint64)
    np.cumsum(_mix(u + np.uint64(1)), out=sums[1:])
    for number, largest, partner in instances(len(u)) if len(u) else []:
        k, n1, starts, salts = layout(number, largest)
        if k == 0:
            continue  # only equal sets link
        at = np.append(u.searchsorted(starts), len(u))
        upto = sums[at]
        total, none = (upto[1:] - upto[:-1] + salts).reshape(N2, n1), (at[1:] == at[:-1]).reshape(N2, n1)
        made, empty = np.empty((len(_SUBSETS), n1), np.uint64), np.empty((len(_SUBSETS), n1), bool)
        for c, subset in enumerate(_SUBSETS):
            np.add.reduce([total[j] for j in subset], out=made[c])
            np.logical_and.reduce([none[j] for j in subset], out=empty[c])
        made = _mix(made.ravel())
        least, gone = least_shared(n1, differ(len(u), partner)), int(np.count_nonzero(empty))
        out.append((made[~empty.ravel()] if gone else made, least - gone) if gone < least else (made, least))
    return out


def _sets(batch: pa.RecordBatch, seed: int) -> Iterator[list[np.ndarray]]:
    """The sets of a few texts at a time."""
    for at in range(0, batch.num_rows, 256):
        yield batch_shingles(batch.column("text").slice(at, 256).to_pylist(), seed)


def _digest(u: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        one, two = _mix(u ^ _A).sum(dtype=np.uint64), _mix(u ^ _B).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def set_sizes(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, and two digests of the set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(len(u), *_digest(u)) for sets in _sets(batch, seed) for u in sets]
            n, one, two = (np.array([g[k] for g in got], np.int64) for k in range(3))
            arrays = [batch.column("doc_id"), batch.column("text_hash"), pa.array(n), pa.array(one), pa.array(two)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "n_shingles", "node", "check"])

    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return docs.mapInArrow(rows, "doc_id long, text_hash long, n_shingles long, node long, check long")


#: Signatures that a task holds before it passes them on.
HELD = 1 << 21


#: Rows of a batch that a task passes on; a worker and its JVM each hold such a batch whole.
PASSED = 1 << 16


def _signed_batches(nodes: np.ndarray, tags: np.ndarray, sigs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(sigs), PASSED):
        own = slice(k, k + PASSED)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(tags[own].astype(np.int32)), pa.array(sigs[own].view(np.int64))], ["node", "tag", "sig"])


def _passed_on(runs: array, held: bytearray) -> Iterator[pa.RecordBatch]:
    """Rows of signatures: where two nodes here hold one, their rows are known as shared and scattered, and one row more tells others.

    runs: node, tag and number of signatures of each stretch of held. Both are emptied."""
    node, tag, count = np.array(runs).reshape(-1, 3).T
    del runs[:]
    run, sigs = np.repeat(np.arange(len(count), dtype=np.int32), count), np.frombuffer(held, np.uint64)
    order = np.argsort(sigs)
    ranked, several = sigs[order], np.zeros(len(sigs), bool)
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    several[order[same + 1]] = several[order[same]] = True
    del order, ranked, same
    # In the order of the nodes, whose repeated ids a shuffle compresses.
    for k in range(0, len(sigs), PASSED):
        at = k + np.flatnonzero(~several[k : k + PASSED])
        yield from _signed_batches(node[run[at]], tag[run[at]] * 2, sigs[at])
    sigs, run = sigs[several], run[several]
    del several
    held.clear()
    if not len(sigs):
        return
    rank = np.unique(node, return_inverse=True)[1].astype(np.int32)  # nodes in order, in fewer bytes
    order = np.lexsort((rank[run], sigs))
    sigs, run = sigs[order], run[order]
    del order
    new = np.append(True, sigs[1:] != sigs[:-1])
    own = rank[run]
    fresh = np.append(True, own[1:] != own[:-1]) | new  # a node's copies count once
    del own
    sigs, run, new = sigs[fresh], run[fresh], new[fresh]
    starts = np.flatnonzero(new)
    known = np.repeat(np.diff(starts, append=len(new)) > 1, np.diff(starts, append=len(new)))
    for k in range(0, len(sigs), PASSED):
        at = k + np.flatnonzero(new[k : k + PASSED])
        yield from _signed_batches(node[run[at]], tag[run[at]] * 2, sigs[at])
        at = k + np.flatnonzero(known[k : k + PASSED])
        yield from _signed_batches(node[run[at]], tag[run[at]] * 2 + 1, _mix(sigs[at] ^ _mix(node[run[at]].view(np.uint64))))


def signed(docs: DataFrame, seed: int) -> DataFrame:
    """node, tag (least shared signatures * 4 + 2 * which of its bands + whether it is known as shared), sig."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = array("q"), bytearray()
        for batch in batches:
            for u in (u for sets in _sets(batch, seed) for u in sets):
                own = _digest(u)[0] if len(u) else 0
                for which, (s, least) in enumerate(signatures(u)):
                    held += s.tobytes()
                    runs.extend((own, least * 2 + which, len(s)))
                if len(held) > 8 * HELD:
                    yield from _passed_on(runs, held)
        if held:
            yield from _passed_on(runs, held)

    return docs.mapInArrow(rows, "node long, tag int, sig long")


def candidates(rows: DataFrame) -> DataFrame:
    """Nodes that share as many signatures with others as a link needs."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by sig and node, one for each node that holds a signature with others. `first` is the row of the
        node that began the signature's group, until another node follows."""
        sig, node, first = None, None, None
        for batch in batches:
            nodes, tags, sigs = (batch.column(k).to_numpy() for k in range(3))
            if not len(sigs):
                continue
            new = np.append(sigs[0] != sig, sigs[1:] != sigs[:-1])
            fresh = np.append(new[0] or nodes[0] != node, nodes[1:] != nodes[:-1]) | new
            starts = np.flatnonzero(new)
            later = fresh & ~new  # second and further nodes of a group
            begun = np.cumsum(new) - 1  # -1: the group that the last batch left open
            out = later | (tags % 2 == 1) & fresh
            joined = np.unique(begun[later])
            out[starts[joined[joined >= 0]]] = True
            got = [nodes[out], tags[out]]
            if first is not None and len(joined) and joined[0] < 0:
                got = [np.append(x, y) for x, y in zip(got, first, strict=True)]
                first = None
            if len(starts):
                at = starts[-1]
                first = None if out[at] else (nodes[at], tags[at])
            sig, node = sigs[-1], nodes[-1]
            if len(got[0]):
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1] >> 1)], ["node", "tag"])

    held = rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(shared, "node long, tag int")
    return held.groupBy("node", "tag").count().where(F.col("count") >= F.shiftright("tag", 1)).select("node").distinct()


def set_arrays(docs: DataFrame, seed: int) -> DataFrame:
    """node, n and the sorted elements."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for got in _sets(batch, seed):
                node, n = [_digest(u)[0] for u in got], [len(u) for u in got]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array([u.view(np.int64) for u in got], pa.list_(pa.int64()))], ["node", "n", "items"])

    return docs.mapInArrow(rows, "node long, n int, items array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that links (a, b) reach. Least labels of neighbours and then of labels, until none changes."""
    both = common.written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = common.written(labels, "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = labels.join(near, "node").join(up, "label", "left").select("node", F.least("label", "near", F.coalesce("up", "label")).alias("label"), F.col("label").alias("old"))
        new = common.written(new, "labels")
        common.drop(labels)
        changed = new.where("label <> old").limit(1).count()
        labels = new
        if not changed:
            common.drop(both)
            return labels.select("node", "label")


def _needs(n: Column, m: Column) -> Column:
    """Elements that sets of n and m elements have in common at least if they link."""
    return F.ceil(F.lit(SIMILARITY) * (n + m) / (100 + SIMILARITY) - 1e-9)


def _open(items: DataFrame) -> DataFrame:
    """Of rows (node, n, label, item) those that count for a link with another label, for the nodes that may have one.

    smallest: no partner by this element is smaller; partner: nor is any partner of the node; weight: how often others hold
    its elements. A node stays if for some size m
    it has as many elements with partners of up to m elements as a link with a set of m takes.
    """
    held = items.groupBy("item").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("held")).where("lo <> hi").drop("lo", "hi")
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * SIMILARITY / 100 - 1e-9).cast("int"))
    rows = items.join(held, "item").withColumn("smallest", smallest).where(f"{SIMILARITY} * smallest <= 100 * n and 100 * most >= {SIMILARITY} * n")
    own = Window.partitionBy("node")
    rows = rows.withColumn("place", F.row_number().over(own.orderBy("smallest")))
    rows = rows.withColumn("open", F.max(F.col("place") >= _needs(F.col("n"), F.col("smallest"))).over(own)).withColumn("partner", F.min("smallest").over(own)).withColumn("weight", F.sum("held").over(own))
    return rows.where("open").select("node", "n", "label", "item", "place", "smallest", "partner", "weight")


def _compared(pairs: DataFrame, arrays: DataFrame, *more: str) -> DataFrame:
    """The pairs (a, b) that link, and their columns named in more."""
    one, two = arrays.select(F.col("node").alias("a"), F.col("items").alias("x")), arrays.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.where(100 * both >= SIMILARITY * (F.size("x") + F.size("y") - both)).select("a", "b", *more)


def _starred(opened: DataFrame, arrays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels and links (a, b) after turns of stars: a node is compared with the centre of most of its least elements.

    An element's centre is the heaviest holder (or, in every third turn, one drawn by a hash) of the label of highest rank: at
    first each node is a label and ranks by its weight, then the label of most nodes and one drawn by a hash take turns. A
    label moves to the highest one that it links with; nodes of one label are linked, but linked labels may still differ.
    """
    nodes = opened.where("place = 1").select("node", "weight")
    labels = common.written(nodes.select("node", F.col("node").alias("label")), "labels")
    least = arrays.join(nodes, "node").select("node", "weight", F.explode(F.slice("items", 1, LEAST_ELEMENTS)).alias("item"))
    least = common.written(least.join(least.groupBy("item").count().where("count > 1").select("item"), "item"), "least")
    whole, links, turn, poor = labels.count(), None, 0, 0
    while True:
        if turn == 0:
            rows = least.select("node", "item", "weight", F.col("node").alias("label"), F.col("weight").alias("rank"))
        elif turn % 2:
            sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("rank"))
            rows = least.join(labels.join(sizes, "label"), "node")
        else:
            rows = least.join(labels, "node").withColumn("rank", F.xxhash64(F.lit(turn), "label"))
        drawn = F.xxhash64(F.lit(turn), "node") if turn % 3 == 2 else F.col("weight")
        centres = rows.groupBy("item").agg(F.max(F.struct("rank", "label", drawn.alias("drawn"), "node")).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        # Of one label and element many nodes may look for a centre; the counts tell which centre a node meets most.
        met = rows.join(centres, "item").where("label <> c.label").groupBy("node", "label", F.col("c.rank").alias("rank"), F.col("c.label").alias("to"), F.col("c.node").alias("b")).count()
        pairs = met.groupBy(F.col("node").alias("a")).agg(F.max_by(F.struct("b", "label", "rank", "to"), F.struct("count", "b")).alias("p")).select("a", "p.*")
        found = common.written(_compared(pairs, arrays, "label", "rank", "to"), "links")
        moves = found.groupBy("label").agg(F.max_by("to", F.struct("rank", "to")).alias("to"))
        further = moves.select(F.col("label").alias("to"), F.col("to").alias("further"))
        moves = moves.join(further, "to", "left").select("label", F.coalesce("further", "to").alias("to"))
        labels = common.written(labels.join(moves, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        now = found.select("a", "b")
        links, turn = now if links is None else links.union(now), turn + 1
        poor = poor + 1 if found.count() < max(1, TURN_SHARE * whole) else 0
        if poor == 2:
            return labels, links


def _across(items: DataFrame, arrays: DataFrame) -> DataFrame:
    """All links (a, b) between different labels that nodes of rows (node, n, label, item) have."""
    before, left = None, 0
    while before is None or left < 0.9 * before:
        before, rows = left, common.written(_open(items), "open")
        left, items = rows.where("place = 1").count(), rows.select("node", "n", "label", "item")
        before = before or 2 * left
    # The label with fewer nodes looks for partners in the other.
    members = rows.select("node", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    held = rows.groupBy("item", "label").agg(F.count(F.lit(1)).alias("holders"), F.min("n").alias("smallest_there"))
    least = rows.groupBy("label").agg(F.min("n").alias("least"))
    held = held.join(members, "label").join(least, "label")
    held = common.written(held.select("item", F.col("label").alias("other"), F.col("members").alias("others"), "least", "holders", "smallest_there"), "held")
    own = Window.partitionBy("node")
    rows = rows.drop("place").join(members, "label").join(held.groupBy("item").agg(F.count(F.lit(1)).alias("labels")), "item")
    rows = rows.withColumn("place", F.row_number().over(own.orderBy("labels", "item"))).withColumn("all", F.count(F.lit(1)).over(own))
    # A label with a partner lacks `spare` of the node's elements at most: it holds one of the rarest spare + 1, and of any more
    # all but spare. No partner is smaller than the label's least set, so a label of large sets may lack fewer.
    rows = common.written(rows.withColumn("spare", F.col("all") - _needs(F.col("n"), F.col("partner"))), "rows")
    cases = rows.where("place <= spare + 1").join(held, "item").where("members < others or members = others and label < other")
    cases = cases.where(f"100 * n >= {SIMILARITY} * least").where(F.col("place") <= F.col("all") - _needs(F.col("n"), F.greatest("partner", "least")) + 1)
    cases = common.written(cases.select("node", "other", "others").distinct(), "cases")
    ends = rows.where("place = 1").select("node", "n", "label")
    small = cases.where(F.col("others") <= FEW).select("node", "other").join(ends.select("node", "n"), "node")
    small = small.join(ends.select(F.col("label").alias("other"), F.col("node").alias("b"), F.col("n").alias("m")), "other").select("node", "n", "b", "m")
    cases = cases.where(F.col("others") > FEW).select("node", "other")
    some = rows.where("place <= 2 * spare + 1").select("node", "item", "spare", F.least("all", F.col("spare") * 2 + 1).alias("seen"))
    some = some.join(cases, "node").join(held.select("item", "other"), ["item", "other"]).groupBy("node", "other", "seen", "spare").count()
    cases = common.written(some.where("count >= seen - spare").select("node", "other"), "cases")
    case = Window.partitionBy("node", "other")
    shown = rows.select("node", "n", "item").join(cases, "node").join(held, ["item", "other"])
    shown = shown.withColumn("shared", F.count(F.lit(1)).over(case)).withColumn("m", F.min("smallest_there").over(case))
    shown = shown.withColumn("needs", _needs(F.col("n"), F.greatest(F.col("m"), F.ceil(F.col("n") * SIMILARITY / 100 - 1e-9)))).where("shared >= needs")
    shown = shown.withColumn("place", F.row_number().over(case.orderBy("holders", "item"))).where("place <= shared - needs + 1").select("node", "n", "item", "other")
    partners = rows.select("item", F.col("label").alias("other"), F.col("node").alias("b"), F.col("n").alias("m"))
    near = f"100 * n >= {SIMILARITY} * m and 100 * m >= {SIMILARITY} * n"
    large = shown.join(partners, ["item", "other"]).select("node", "n", "b", "m")
    pairs = common.written(large.union(small).where(near).select(F.col("node").alias("a"), "b").distinct(), "pairs")
    return _compared(pairs, arrays)


def link_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, label (null: links with nothing by rule) and component_id of documents (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    seed = 0
    while True:
        sizes = common.written(set_sizes(docs, seed), "sizes")
        twice = sizes.where("n_shingles > 0").groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), F.min("n_shingles").alias("n"), F.max("n_shingles").alias("m"))
        if not twice.where("lo <> hi or n <> m").limit(1).count():
            break
        seed += 1  # two different sets have one digest: hash anew
    known = docs.where("doc_id is not null")
    nodes = common.written(candidates(signed(known, seed)), "nodes")
    ids = common.written(sizes.where("n_shingles > 0 and doc_id is not null").join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    arrays = set_arrays(known.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), seed)
    arrays = common.written(arrays.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "arrays")
    items = arrays.select("node", "n", F.col("node").alias("label"), F.explode("items").alias("item"))
    opened = common.written(_open(items).select("node", "n", "item", "place", "weight"), "open")
    labels, links = _starred(opened, arrays)
    found = _across(opened.join(labels, "node").select("node", "n", "label", "item"), arrays)
    labels = components(links.union(found))
    for table in (nodes, ids, arrays, opened):
        common.drop(table)
    filled = "doc_id is not null and n_shingles > 0"
    linked = sizes.where(filled).join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = linked.groupBy("node", "label").agg(F.min("doc_id").alias("least"))
    least = least.join(least.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "label", "component_id")
    out = ["doc_id", "text_hash", "n_shingles", "label", "component_id"]
    one = sizes.where(f"not ({filled})").withColumn("label", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    return sizes.where(filled).join(least, "node").select(*out).union(one.select(*out))


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of documents (doc_id, text)."""
    return link_rows(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component the row with the least id (then the least hash of its text); rows that link
    with nothing, and each null doc_id, stay."""
    found = common.written(link_rows(docs), "components")
    kept = found.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"), F.count(F.lit(1)).alias("rows"))
    kept = common.written(kept.select("k.*", "rows"), "kept")
    empty = found.where("n_shingles = 0 and doc_id is not null").select("doc_id", "text_hash").distinct()
    keyed = F.struct(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    rows = docs.select(keyed.alias("r")).select("r.*")
    # Only a component of several rows can hold the kept row twice.
    alone = kept.where("rows = 1").select("doc_id", "text_hash").union(empty)
    several = kept.where("rows > 1").select("doc_id", "text_hash")
    one = rows.join(several, ["doc_id", "text_hash"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("doc_id"))).where("n = 1")
    out = rows.join(alone, ["doc_id", "text_hash"], "left_semi").select("row").union(one.select("row")).union(rows.where("doc_id is null").select("row"))
    return out.select("row.*")


def op10_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
