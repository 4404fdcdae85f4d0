"""Benchmark decontamination: a generalised suffix automaton of the items' words, through which documents are streamed.

The items' words go into one automaton for each block of at most about BLOCK bytes of items, which is what the driver holds and broadcasts at a time; the
benchmark is dealt to as many blocks as its size asks for, and long items in pieces that overlap by a window less one word, so
that every window lies in a piece. A document's words move through the automaton, which knows the longest match that ends at
each word: from `window` words on, that match is a window of an item; items with fewer words are found on the suffix links.
Stretches that can't hold the shortest window are skipped before: those where too few neighbouring words follow each other
in any item, by a table of hashed word pairs that never misses one. Documents are never shuffled: each
block's pass adds its spans to those of the passes before.

Defined results: a null text or item has no words; a null item_id counts as the empty string; items of one id count once; repeated
rows are scanned each; an item without words matches nothing; an empty benchmark leaves all documents clean; other columns are
ignored by scan() and kept by clean().
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm import common

WINDOW = 10
#: Bytes of the items of one automaton, words of a piece of an item, bytes of text that are cut into words at once.
BLOCK, PIECE, CHUNK = 2_000_000, 4_000, 1 << 20
PAIRS = 1 << 22
#: Every byte as the byte of a word in lower case, or as a space. Bytes of non-ASCII characters stay.
NORMAL = bytes(b if b >= 0x80 or chr(b) in string.digits + string.ascii_lowercase else b + 32 if chr(b) in string.ascii_uppercase else 32 for b in range(256))
#: A word in a text whose letters are still in either case, and what lies between words.
WORD_RE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No byte of UTF-8, so no word of a text: stands between texts that are cut together.
END = b"\xff"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


class Automaton:
    """Suffix automaton of several items (id, words). State 0 is the empty match."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, sorted({i for i, _ in items})
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        number = {i: k for k, i in enumerate(self.ids)}
        coded = [(number[i], [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        self.unknown, self.end = len(self.vocabulary), len(self.vocabulary) + 1
        self.shortest = min((min(len(w), window) for _, w in coded), default=0)
        for _, words in coded:
            last = 0
            for c in words:
                last = self._extended(last, c)
        self._label(coded)
        self.pairs = np.zeros(PAIRS, bool)
        for _, words in coded:
            w = np.array(words, np.int64)
            self.pairs[self._pair(w[:-1], w[1:])] = True
        self.vocabulary[END] = self.end

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b) & (PAIRS - 1)

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest match followed by c, parted from longer matches of the state that c leads to."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = part
            p = self.link[p]
        return part

    def _extended(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        self.link[new] = self._split(last, c) if last >= 0 else 0
        return new

    def _label(self, coded: list[tuple[int, list[int]]]) -> None:
        """holders: the items of each state of a window's length. near: the next state on the suffix links at which a short item ends."""
        n = len(self.next)
        self.holders: dict[int, list[int]] = {}
        self.ending: dict[int, list[tuple[int, int]]] = {}
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        self.window_state, self.near = [0] * n, [0] * n
        for v in by_length:
            if self.length[v] >= self.window:
                self.window_state[v] = v if self.length[self.link[v]] < self.window else self.window_state[self.link[v]]
        seen: dict[int, int] = {}
        for k, (item, words) in enumerate(coded):
            v = 0
            for at, c in enumerate(words, 1):
                v = self.next[v][c]
                u = self.window_state[v] if at >= self.window else 0
                if u and seen.get(u) != k:
                    seen[u] = k
                    self.holders.setdefault(u, []).append(item)
            if len(words) < self.window:
                self.ending.setdefault(v, []).append((len(words), item))
        for v in by_length:
            self.near[v] = v if v in self.ending else self.near[self.link[v]]

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words that may hold a window."""
        if not self.shortest or len(ids) < self.shortest:
            return []
        if self.shortest == 1:
            good, more = ids < self.unknown, 0
        else:
            good, more = self.pairs[self._pair(ids[:-1], ids[1:])], 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]])))
        starts, stops = edges[::2], edges[1::2] + more
        keep = stops - starts >= self.shortest
        return list(zip(starts[keep].tolist(), stops[keep].tolist(), strict=True))

    def stream(self, ids: list[int], at: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of the windows that occur in ids, whose first word has place `at`, and the items that they are of."""
        spans, found, v, size = [], set(), 0, 0
        following, link, length, near, ending = self.next, self.link, self.length, self.near, self.ending
        for i, c in enumerate(ids, at + 1):
            while v and c not in following[v]:
                v = link[v]
                size = length[v]
            if c not in following[v]:
                continue
            v = following[v][c]
            size += 1
            if size >= self.window:
                spans.append((i - size, i))
                found.update(self.holders[self.window_state[v]])
            u = near[v]
            while u:
                for m, item in ending[u]:
                    if m <= size:
                        spans.append((i - m, i))
                        found.add(item)
                u = near[link[u]]
        return spans, found

    def coded(self, blob: bytes) -> np.ndarray:
        words = blob.translate(NORMAL).split() if END not in blob else END.join(x.translate(NORMAL) for x in blob.split(END)).split()
        return np.fromiter(map(self.vocabulary.get, words, repeat(self.unknown)), np.int64, len(words))

    def together(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """Number of words, spans and items of each of several short texts, cut into words at once."""
        ids = self.coded(b" \xff ".join([*texts, b""]))
        stops = np.flatnonzero(ids == self.end)
        starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
        out = [(n, [], set()) for n in (stops - starts).tolist()]
        for a, b in self.stretches(ids):
            spans, items = self.stream(ids[a:b].tolist(), a)
            for start, stop in spans:
                k = int(np.searchsorted(stops, start, "right"))
                out[k][1].append((start - int(starts[k]), stop - int(starts[k])))
            if spans:
                out[k][2].update(items)
        return out

    def long(self, text: bytes, chunk: int) -> tuple[int, list[tuple[int, int]], set[int]]:
        """The same of one text in chunks that overlap by a window less one word."""
        at, before, spans, items, tail = 0, 0, [], set(), np.zeros(0, np.int64)
        normal = text.translate(NORMAL)
        while at < len(normal):
            stop = normal.find(b" ", at + chunk)
            stop = len(normal) if stop < 0 else stop
            ids = np.concatenate([tail, self.coded(normal[at:stop])])
            for a, b in self.stretches(ids):
                more, found = self.stream(ids[a:b].tolist(), a)
                spans += [(s + before - len(tail), e + before - len(tail)) for s, e in more]
                items |= found
            before += len(ids) - len(tail)
            tail, at = ids[max(0, len(ids) - self.window + 1) :], stop
        return before, spans, items


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as disjoint ones in their order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((start, stop))
    return out


def _grouped(texts: list[str | None], chunk: int) -> Iterator[list[bytes]]:
    """Texts in their order, in groups of about a chunk; a text of over a chunk is alone."""
    group, size = [], 0
    for t in texts:
        blob = (t or "").encode()
        if group and size + len(blob) > chunk:
            yield group
            group, size = [], 0
        group.append(blob)
        size += len(blob)
    if group:
        yield group


def _scanned(rows: DataFrame, automaton: Automaton, chunk: int, text_kept: bool) -> DataFrame:
    """rows with the automaton's spans and items added to those that they have."""
    sent = rows.sparkSession.sparkContext.broadcast(automaton)
    schema = (rows if text_kept else rows.drop("text")).schema
    names = schema.names

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        for batch in batches:
            found = []
            for group in _grouped(batch.column("text").to_pylist(), chunk):
                found += [a.long(group[0], chunk)] if len(group[0]) > chunk else a.together(group)
            before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
            spans, items = [], []
            for (old, old_items), (_, new, new_items) in zip(before, found, strict=True):
                spans.append([{"start": s, "stop": e} for s, e in joined([(x["start"], x["stop"]) for x in old] + new)] if new else old)
                items.append(sorted({*old_items, *(a.ids[k] for k in new_items)}) if new_items else old_items)
            columns = {c: batch.column(c) for c in names} | {"n_words": pa.array([n for n, _, _ in found], pa.int64()), "spans": pa.array(spans, SPANS), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(tasks, schema)


def pieces(benchmark: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """item_id and words of the items' pieces."""
    text = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(text, BETWEEN), lambda w: w != "")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(piece))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s + 1, F.lit(piece + window - 1)))).alias("words")).distinct()


def blocks(found: DataFrame, block: int = BLOCK) -> int:
    """The number of automata that the pieces ask for; at least one."""
    size = found.agg(F.sum(F.length(F.array_join("words", " ")))).first()[0] or 0
    return max(1, -(-size // block))


def automaton(found: DataFrame, k: int, n: int, window: int = WINDOW) -> Automaton:
    """The automaton of the k-th of n blocks of the pieces."""
    rows = found.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k).collect()
    return Automaton([(r["item_id"], [w.encode() for w in r["words"]]) for r in rows], window)


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, chunk: int = CHUNK, text_kept: bool = True) -> DataFrame:
    """The documents with n_words, n_hit, spans (word places, stop exclusive) and items (sorted ids) of the windows in their texts."""
    found = pieces(benchmark, window)
    n = blocks(found, block)
    empty = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start: long, stop: long>>").alias("spans"), F.array().cast("array<string>").alias("items")]
    rows = documents.select(*[c for c in documents.columns if c not in ("n_words", "n_hit", "spans", "items")], *empty)
    for k in range(n):
        rows = _scanned(rows, automaton(found, k, n, window), chunk, text_kept or k < n - 1)
        if k < n - 1:  # so that a task holds one automaton at a time
            rows = common.written(rows, "scanned")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return rows.withColumn("n_hit", hit)


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5, **limits) -> DataFrame:
    """The documents without the spans of benchmark windows, from the first letter of a span's first word to the last of its last.

    A document of which more than `coverage` of the words are hit is left out whole. Texts without a span stay as they are.
    """
    packed = documents.select("text", F.struct(*documents.columns).alias("_all"))
    found = scan(packed, benchmark, window, **limits).where(F.col("n_hit") <= coverage * F.col("n_words"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, place in zip(texts, places, strict=True):
            if not len(place):
                out.append(text)
                continue
            words, at, kept = [m.span() for m in WORD_RE.finditer(text)], 0, []
            for start, stop in joined([(p["start"], p["stop"]) for p in place]):
                kept.append(text[at : words[start][0]])
                at = words[stop - 1][1]
            out.append("".join([*kept, text[at:]]))
        return pd.Series(out, dtype=object)

    text = cut("text", "spans").alias("text")
    return found.select(*[text if c == "text" else F.col(f"_all.{c}").alias(c) for c in documents.columns])


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit words and the matched benchmark items of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_kept=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
