"""Re-Pair grammar compression of token ids, stored block by block with random access.

Documents are range-partitioned by id, encoded, and cut into blocks of whole documents (the shards of the grammar).
In each block frequent pairs of ids are replaced by nonterminals, round after round; the block keeps the rules, the
expansion length of each nonterminal, the sequence of symbols that is left, and the place of each document in it.
Blocks are rows of a Parquet table, written by Spark's own committer, so a lost executor's blocks are written anew.

Defined results: a null text is empty (its end id alone); a null doc_id sorts first; repeated rows each keep their own
entry, equal ids in the order of their text; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm import common, tokens

END_ID = 2
#: The first nonterminal; all vocabularies in use are smaller.
FIRST_RULE = 1 << 17
BLOCK_IDS = 1 << 20
#: Documents and bytes of text that are encoded at once (one longer text is a batch of its own).
BATCH_DOCS, BATCH_BYTES = 1024, 1 << 22
BLOCK_SCHEMA = "part long, block long, n_ids long, doc_ids binary, null_ids binary, doc_lens binary, rules binary, rule_lens binary, symbols binary"


def replace_pairs(ids: np.ndarray, per_round: int = 1 << 14, least: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (left, right) and expansion lengths. Rounds go on until a round over all pairs finds none that can be replaced
    `least` / 2 times among those that occur `least` times.

    In each round the most frequent pairs, up to per_round, become rules at once; where occurrences overlap, the one that starts
    first is replaced. Counts of older pairs only fall, so a round looks at the pairs with a symbol that the last one made; when these
    give nothing more, a round over all pairs follows.
    """
    seq, rules, lens, fresh = ids.astype(np.int64), [], np.ones(0, np.int64), 0
    while len(seq) > 1:
        new = seq >= fresh
        place = np.flatnonzero(new[:-1] | new[1:]) if fresh else np.arange(len(seq) - 1)
        keys = (seq[place] << 20) | seq[place + 1]
        bits = len(keys).bit_length()
        if bits <= 23:  # a key and its place fit in one number, which sorts faster
            ordered = np.sort((keys << bits) | np.arange(len(keys)))
            which, ordered = ordered & ((1 << bits) - 1), ordered >> bits
        else:
            which = np.argsort(keys)
            ordered = keys[which]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
        counts = np.diff(np.concatenate([first, [len(ordered)]]))
        often = np.flatnonzero(counts >= least)
        if len(often) > per_round:
            often = np.sort(often[np.argsort(-counts[often], kind="stable")[:per_round]])
        chosen = ordered[first[often]]
        number = np.full(len(counts), -1, np.int32)
        number[often] = np.arange(len(often))
        rank = np.empty(len(keys), np.int32)
        rank[which] = np.repeat(number, counts)
        hit = np.flatnonzero(rank >= 0)
        at, rank = place[hit], rank[hit]
        starts, count = np.concatenate([[True], np.diff(at) > 1])[: len(at)], np.arange(len(at))
        even = (count - np.maximum.accumulate(np.where(starts, count, 0))) % 2 == 0
        at, rank = at[even], rank[even]
        enough = np.bincount(rank, minlength=len(chosen)) >= least // 2
        at, rank = at[enough[rank]], rank[enough[rank]]
        if not len(at):
            if not fresh:
                break
            fresh = 0
            continue
        used = np.flatnonzero(enough)
        number = np.cumsum(enough) - 1
        left, right = chosen[used] >> 20, chosen[used] & ((1 << 20) - 1)
        length = lambda s: np.where(s < FIRST_RULE, 1, lens[np.maximum(s - FIRST_RULE, 0)] if len(lens) else 1)
        fresh = FIRST_RULE + len(lens)
        rules.append(np.stack([left, right], 1))
        lens = np.concatenate([lens, length(left) + length(right)])
        seq[at] = fresh + number[rank]
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        seq = seq[kept]
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return seq.astype("<u4"), pairs.astype("<u4"), lens.astype("<u4")


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that the symbols stand for. Each rule that they use is expanded once."""
    at = np.flatnonzero(symbols >= FIRST_RULE)
    used = np.zeros(len(rules), bool)
    used[symbols[at] - FIRST_RULE] = True
    seq = (np.flatnonzero(used) + FIRST_RULE).astype(symbols.dtype)
    owner = np.arange(len(seq))
    while len(open_at := np.flatnonzero(seq >= FIRST_RULE)):
        size = np.ones(len(seq), np.int64)
        size[open_at] = 2
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), seq.dtype)
        out[start] = seq
        pair = rules[seq[open_at] - FIRST_RULE]
        out[start[open_at]], out[start[open_at] + 1] = pair[:, 0], pair[:, 1]
        seq, owner = out, np.repeat(owner, size)
    length = np.bincount(owner, minlength=int(used.sum()))
    rule = (np.cumsum(used) - 1)[symbols[at] - FIRST_RULE]
    lengths, offsets = np.ones(len(symbols), np.int64), len(seq) + np.arange(len(symbols))
    lengths[at], offsets[at] = length[rule], (np.cumsum(length) - length)[rule]
    return tokens.laid(np.concatenate([seq, symbols]), offsets, lengths)


def slice_ids(symbols: np.ndarray, rules: np.ndarray, rule_lens: np.ndarray, start: int, length: int) -> np.ndarray:
    """Random access: ids start .. start + length of a block; only the symbols that cover them are expanded."""
    size = np.ones(len(symbols), np.int64)
    at = symbols >= FIRST_RULE
    size[at] = rule_lens[symbols[at] - FIRST_RULE]
    ends = np.cumsum(size)
    lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length, "left")
    skipped = start - (ends[lo] - size[lo]) if lo < len(ends) else 0
    return expand(symbols[lo : hi + 1], rules)[skipped : skipped + length]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of at most BATCH_DOCS rows and, but for single rows, BATCH_BYTES of text."""
    ends, at = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64)), 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, BATCH_BYTES + (int(ends[at - 1]) if at else 0), "right"))
        stop = max(at + 1, min(full, at + BATCH_DOCS, batch.num_rows))
        yield batch.slice(at, stop - at)
        at = stop


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the table of blocks for documents (doc_id, text) at path."""
    tokenizer = tokenizer or tokens.public_path(tokens.BYTE_BPE)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, block = tokens.encoder(tokenizer, True), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            nonlocal block, held
            ids, lens = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            symbols, rules, rule_lens = replace_pairs(ids)
            values = [part, block, len(ids), np.concatenate([h[2] for h in held]).tobytes(), np.concatenate([h[3] for h in held]).tobytes(), lens.astype("<i8").tobytes(), rules.tobytes(), rule_lens.tobytes(), symbols.tobytes()]
            block, held = block + 1, []
            names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
            kinds = [pa.int64()] * 3 + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for some in (x for batch in batches for x in _slices(batch)):
            ids, n = encoder.encode([x or "" for x in some.column(1).to_numpy(zero_copy_only=False).tolist()])
            ends = np.cumsum(n + 1)
            out = np.full(int(ends[-1]), end_id, np.uint32)
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = ids
            doc, null = some.column(0).fill_null(0).to_numpy().astype("<i8"), some.column(0).is_null().to_numpy(zero_copy_only=False)
            begin, at = 0, 0
            while begin < len(n):
                stop = min(int(np.searchsorted(ends, at + block_ids - sum(len(h[0]) for h in held))) + 1, len(n))
                end = int(ends[stop - 1])
                held.append((out[at:end], n[begin:stop] + 1, doc[begin:stop], null[begin:stop]))
                begin, at = stop, end
                if sum(len(h[0]) for h in held) >= block_ids:
                    yield row()
        if held:
            yield row()

    n = common.partitions(docs.sparkSession)
    placed = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each document's row from the blocks: doc_id, start, n_tokens, ids_crc32, and its place (part, block, block_start)."""
    table = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each partition of the writing job.
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = table.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("in_part")).join(before, "part")
    places = places.select("part", "block", (F.col("part_start") + F.col("in_part")).alias("block_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lens = np.frombuffer(r["doc_lens"], "<i8")
                ids = expand(np.frombuffer(r["symbols"], "<u4"), np.frombuffer(r["rules"], "<u4").reshape(-1, 2)).astype("<u4", copy=False)
                ends, raw = np.cumsum(lens), memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                doc = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["null_ids"], bool))
                place = [pa.array(np.full(len(lens), r[k], np.int64)) for k in ("part", "block")]
                yield pa.RecordBatch.from_arrays([doc, pa.array(ends - lens), pa.array(lens), pa.array(crc, pa.int64()), *place], ["doc_id", "in_block", "n_tokens", "ids_crc32", "part", "block"])

    wanted = table.select("part", "block", "doc_ids", "null_ids", "doc_lens", "rules", "symbols")
    found = wanted.mapInArrow(documents, "doc_id long, in_block long, n_tokens long, ids_crc32 long, part long, block long")
    return found.join(places, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32", "part", "block", "block_start")


def op3_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "repair")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
