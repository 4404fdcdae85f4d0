"""Quality rules: fixed rules, and gradient-boosted trees over document statistics.

The trees are fitted on at most SAMPLE labelled documents (those with the least hash of their id), by histograms of the
statistics, with monotonic constraints: more symbols, repeats, list marks or capitals never raise a score. The fitted
trees are flattened into arrays of nodes and every document is scored by walking all rows of a batch down at once.

Defined results: a null text has no words and fails the base rules; an empty one too; labels that are null or name no
document are left out; without labels of both kinds no tree is fitted and the base rules decide; repeated rows are judged
each; other columns stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 20_000
MARKS = b"#*$%&|<>"
FEATURES = ["log_words", "mean_word", "symbols", "dup_lines", "repeats", "capitals", "digits", "distinct", "exclaims", "line_words", "ends", "top_word"]
#: -1: a higher value never raises the score; 0: free.
MONOTONE = [0, 0, -1, -1, -1, -1, 0, 0, -1, 0, 0, -1]
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
WINDOW = 8
THRESHOLD = 0.5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _repeats(codes: np.ndarray) -> int:
    """Words in windows of WINDOW words that the text has twice or more."""
    n = len(codes) - WINDOW + 1
    if n < 2:
        return 0
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x100000001B3) + mixed[k : k + n]
        key ^= key >> np.uint64(31)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The five counts and the features of each text."""
    counts, features = np.zeros((len(texts), 5), np.int64), np.zeros((len(texts), len(FEATURES)))
    for k, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = len(words)
        ids: dict[bytes, int] = {}
        codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        solid = b"".join(words)
        chars = len(solid) - len(solid.translate(None, bytes(range(0x80, 0xC0)))) if not text.isascii() else 0
        chars = len(solid) - chars
        marks = len(raw) - len(raw.translate(None, MARKS))
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        dups = len(lines) - len(set(lines))
        repeats = _repeats(codes) if len(ids) < n else 0
        counts[k] = n, chars, marks, dups, repeats
        if n:
            plain = len(solid) - len(solid.translate(None, bytes(range(65, 91))))
            digits = len(solid) - len(solid.translate(None, b"0123456789"))
            top = int(np.bincount(codes).max()) / n
            features[k] = np.log1p(n), chars / n, marks / n, dups / len(lines), repeats / n, plain / len(solid), digits / len(solid), len(ids) / n, raw.count(b"!") / n, np.log1p(n / len(lines)), raw.count(b".") / n, top if n > 20 else 0.0
    return counts, features


class Trees:
    """Boosted trees as arrays of nodes: feature (-1 in leaves), threshold, left, right, value; roots: a node for each tree."""

    def __init__(self, feature, threshold, left, right, value, roots, base):
        self.feature, self.threshold, self.left, self.right = (np.asarray(x) for x in (feature, threshold, left, right))
        self.value, self.roots, self.base = np.asarray(value, float), list(roots), base

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while len(inner := np.flatnonzero(self.feature[node] >= 0)):
                at = node[inner]
                down = x[rows[inner], self.feature[at]] <= self.threshold[at]
                node[inner] = np.where(down, self.left[at], self.right[at])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 5, monotone: list[int] | None = None) -> Trees:
    """Logistic boosting with second-order gains; a split that breaks a constraint is refused, and the values below a split
    on a constrained feature are kept on their sides of its middle."""
    monotone = MONOTONE if monotone is None else monotone
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    margin = np.full(len(y), base)

    def node(v: float) -> int:
        for column, item in zip((feature, threshold, left, right, value), (-1, 0.0, -1, -1, v * rate), strict=True):
            column.append(item)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        leaf = lambda a, b, lo, hi: float(np.clip(-a / (b + ridge), lo, hi))
        roots.append(node(leaf(g.sum(), h.sum(), -np.inf, np.inf)))
        open_nodes = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while open_nodes:
            at, rows, level, lo, hi = open_nodes.pop()
            margin_rows = value[at]
            if level < depth and len(rows) >= 2 * least:
                best = (1e-6, -1, 0)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    size = len(e) + 1
                    cg, ch, cn = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    lv = np.clip(-cg / (ch + ridge), lo, hi)
                    rv = np.clip(-(total_g - cg) / (total_h - ch + ridge), lo, hi)
                    gain = cg**2 / (ch + ridge) + (total_g - cg) ** 2 / (total_h - ch + ridge) - total_g**2 / (total_h + ridge)
                    gain[(cn < least) | (len(rows) - cn < least) | (monotone[f] * (rv - lv) < 0)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
                if best[1] >= 0:
                    _, f, cut = best
                    down = binned[rows, f] <= cut
                    a, b = rows[down], rows[~down]
                    lv, rv = leaf(g[a].sum(), h[a].sum(), lo, hi), leaf(g[b].sum(), h[b].sum(), lo, hi)
                    mid = (lv + rv) / 2
                    feature[at], threshold[at], left[at], right[at] = f, float(edges[f][cut]), node(lv), node(rv)
                    l_range, r_range = {0: ((lo, hi), (lo, hi)), -1: ((mid, hi), (lo, mid)), 1: ((lo, mid), (mid, hi))}[monotone[f]]
                    open_nodes += [(left[at], a, level + 1, *l_range), (right[at], b, level + 1, *r_range)]
                    continue
            margin[rows] += margin_rows
    return Trees(feature, threshold, left, right, value, roots, base)


def fit_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees from labelled documents; at most `sample` rows of statistics come to the driver."""
    rows = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("array<double>")
    def features(text: pd.Series) -> pd.Series:
        return pd.Series(list(text_stats(text.tolist())[1]))

    # The broadcast side has at most `sample` rows of two numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("doc_id", "quality", F.struct(F.xxhash64("text"), features("text").alias("x")).alias("s"))
    # One text of each id, and in the order of the ids, so that each run adds up the same numbers in the same order.
    got = sorted(found.groupBy("doc_id", "quality").agg(F.min("s").alias("s")).select("doc_id", "quality", "s.x").collect())
    y = np.array([float(r["quality"] > 0) for r in got])
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([r["x"] for r in got], float), y)


def judged(text: Column, trees: Trees | None) -> Column:
    """A struct of the five counts, base_failed, the trees' score and kept."""

    @F.pandas_udf(f"{STATS}, base_failed boolean, score double, kept boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        counts, features = text_stats(texts.tolist())
        failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
        score = trees.score(features) if trees else np.ones(len(counts))
        out = pd.DataFrame(counts, columns=[x.split()[0] for x in STATS.split(", ")])
        return out.assign(base_failed=failed, score=score, kept=~failed & (score >= THRESHOLD))

    return judge(text)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select("doc_id", judged(F.col("text"), trees).alias("q")).select("doc_id", "q.*")
