"""Soft-membership mixing: document rates whose expected domain token totals match targets. All in DataFrame functions.

1. A naive Bayes classifier over hashed words is fitted on at most SAMPLE labelled documents (least hash of their id). Its
   weights are a table of BUCKETS rows, so the broadcast has a fixed bound. Domains: good, poor (quality 0), toxic.
2. Every document's words are looked up and added up to its domain posteriors; a document counts as EFFECTIVE words at
   most, so that posteriors stay soft.
3. Rates r >= 0 minimise the squared errors of sum(r * tokens * posterior) against the targets, by projected gradient steps:
   r' = max(0, r - sum of p_k * g_k), where g is the gradient of the totals in the metric of the rows whose rate is above 0
   (a 3 x 3 matrix), so that a step would meet the targets if it brought no further rate to 0. A step that makes the error no
   smaller is halved. Totals and matrix are one aggregate over all documents' tokens and posteriors, so a step is one job and
   nothing but a dozen sums comes to the driver; a rate is a fold over the steps.

Defined results: a null or empty text has no tokens, the prior as posteriors and the rate they give; a label that is null or
names no document is left out; without labelled documents all posteriors are equal; repeated rows have equal rates; an
empty table gives an empty result; a domain without tokens cannot meet its target and is left out of the fit.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm import common

SAMPLE = 4000
BUCKETS = 4096
EFFECTIVE = 40
DOMAINS = ["good", "poor", "toxic"]
TARGETS = {"good": 0.95, "poor": 0.03, "toxic": 0.02}
STEPS = 40
#: A step is halved down to this share of itself; when that is no better either, the error is least.
LEAST_SHARE = 1 / 64
#: Largest error of a domain, as a share of all tokens, at which the steps end.
CLOSE = 1e-5
SEED = 11


def _words(text: Column) -> Column:
    """Lower-case words; marks at the end of a word make a word of their own."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"([\p{L}\p{N}])([^\p{L}\p{N}\s]+)", "$1 $2")
    return F.filter(F.split(spaced, r"\s+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    shout = F.when((F.upper(word) == word) & (F.lower(word) != word), "^").otherwise("")
    return F.pmod(F.xxhash64(F.concat(shout, F.lower(word))), F.lit(BUCKETS)).cast("int")


def weights(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, list[float]]:
    """bucket and one log-likelihood for each domain, and the domains' log-priors. At most `sample` labels are used."""
    domain = F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).otherwise(1)
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = rows.select("doc_id", domain.alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The broadcast side has at most `sample` rows of two numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    words = found.select("domain", F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).select("domain", _bucket(F.col("word")).alias("bucket"))
    counts = words.groupBy("bucket").pivot("domain", [0, 1, 2]).count().na.fill(0)
    counts = common.written(counts.select("bucket", *[F.col(str(k)).alias(f"c{k}") for k in range(3)]), "counts")
    total = counts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in range(3)]).first()
    known = {r["domain"]: r["count"] for r in found.groupBy("domain").count().collect()}
    n = sum(known.values())
    prior = [log((known.get(k, 0) + 1) / (n + 3)) for k in range(3)]
    like = [F.log((F.col(f"c{k}") + 1) / F.lit(float(total[k] + BUCKETS))).alias(f"l{k}") for k in range(3)]
    return counts.select("bucket", *like), prior


def posteriors(docs: DataFrame, model: DataFrame, prior: list[float]) -> DataFrame:
    """doc_id, text_hash, tokens and p0 .. p2 of documents (doc_id, text)."""
    numbered = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).withColumn("row", F.monotonically_increasing_id())
    words = numbered.select("row", "doc_id", "text_hash", F.explode_outer(_words(F.col("text"))).alias("word")).withColumn("bucket", _bucket(F.col("word")))
    scored = words.join(F.broadcast(model), "bucket", "left")
    sums = scored.groupBy("row", "doc_id", "text_hash").agg(F.count("word").alias("tokens"), F.count("l0").alias("seen"), *[F.coalesce(F.sum(f"l{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(3)])
    scale = F.least(F.lit(1.0), F.lit(float(EFFECTIVE)) / F.greatest("seen", F.lit(1)))
    logits = sums.select("doc_id", "text_hash", "tokens", *[(F.lit(prior[k]) + F.col(f"s{k}") * scale).alias(f"z{k}") for k in range(3)])
    top = F.greatest("z0", "z1", "z2")
    odds = logits.select("doc_id", "text_hash", "tokens", *[F.exp(F.col(f"z{k}") - top).alias(f"e{k}") for k in range(3)])
    whole = F.col("e0") + F.col("e1") + F.col("e2")
    return odds.select("doc_id", "text_hash", "tokens", *[(F.col(f"e{k}") / whole).alias(f"p{k}") for k in range(3)])


def rate(past: list[list[float]]) -> Column:
    """The rate after the steps in past, from the posteriors p0 .. p2."""
    if not past:
        return F.lit(1.0)
    rows = ", ".join("named_struct('g0', {!r}D, 'g1', {!r}D, 'g2', {!r}D)".format(*map(float, step)) for step in past)
    return F.aggregate(F.expr(f"array({rows})"), F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - sum(F.col(f"p{k}") * g[f"g{k}"] for k in range(3))))


def fit(members: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, steps: int = STEPS) -> list[list[float]]:
    """Steps of the projected gradient on rows (tokens, p0 .. p2). budget: tokens to give out, all by default."""
    cells = [(i, j) for i in range(3) for j in range(i, 3)]

    def totals(past: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens given to each domain, and sum(tokens * p_i * p_j) over the rows that still get some."""
        now = members.select("p0", "p1", "p2", "tokens", rate(past).alias("r"))
        given = [F.coalesce(F.sum(F.col("r") * F.col("tokens") * F.col(f"p{k}")), F.lit(0.0)) for k in range(3)]
        held = F.when(F.col("r") > 0, F.col("tokens")).otherwise(0)
        got = now.agg(*given, *[F.coalesce(F.sum(held * F.col(f"p{i}") * F.col(f"p{j}")), F.lit(0.0)) for i, j in cells]).first()
        metric = np.zeros((3, 3))
        for (i, j), v in zip(cells, got[3:], strict=True):
            metric[i, j] = metric[j, i] = v
        return np.array(got[:3], float), metric

    given, metric = totals([])
    budget = float(given.sum()) if budget is None else budget
    goal = np.array([targets.get(d, 0.0) for d in DOMAINS])
    used, scale = given > 0, budget if budget > 0 else 1.0
    goal = np.where(used, budget * goal / (goal.sum() or 1.0), 0.0)
    past: list[list[float]] = []
    error, share = np.where(used, given - goal, 0.0) / scale, 1.0
    while len(past) < steps and np.abs(error).max() >= CLOSE and share >= LEAST_SHARE:
        near = metric / scale
        step = np.linalg.lstsq(near + np.eye(3) * 1e-12 * max(1e-300, np.trace(near)), error, rcond=1e-10)[0]
        more, metric_then = totals([*past, (share * step).tolist()])
        error_then = np.where(used, more - goal, 0.0) / scale
        if np.linalg.norm(error_then) < np.linalg.norm(error) * (1 - 1e-3):
            past, error, metric, share = [*past, (share * step).tolist()], error_then, metric_then, min(1.0, 2 * share)
        else:
            share /= 2
    return past


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, tokens, posteriors, rate and copies (the rate rounded by a seeded draw) of documents (doc_id, text)."""
    model, prior = weights(docs, labels)
    members = common.written(posteriors(docs, model, prior), "members")
    past = fit(members, targets)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.lit(1 << 30)) / float(1 << 30)
    rated = members.withColumn("rate", rate(past))
    return rated.withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, seed: int = SEED) -> DataFrame:
    """docs, each row as often as its copies say."""
    copies = mix(docs, labels, targets, seed).select(F.struct("doc_id", "text_hash").alias("key"), "copies").distinct()
    # Structs, so that no column of docs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key"))
    joined = rows.join(copies, rows.key.eqNullSafe(copies.key)).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return joined.select("row.*")


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = mix(docs, labels)
    return found.select("doc_id", "tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies")
