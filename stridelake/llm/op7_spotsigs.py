"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Each anchor and the CHAIN content words after it make one signature; a document's fingerprint is its set of signatures,
written as sorted 32-bit hashes in base64. A text without anchors has its whole word sequence as one signature, so only
texts without words have an empty fingerprint. Likeness is the Jaccard similarity of two sets.

pairs() joins all documents: equal fingerprints are one class; sets are partitioned by length, so that only partitions next
to each other are compared; and within them only sets that share one of their rarest signatures.

Defined results: a null text is empty; equal fingerprints (two empty ones as well) have likeness 1; a null doc_id sorts
last in descending order; repeated rows follow each other; a lone document is its own neighbour; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm import common

CHAIN = 2
#: Common words of the four languages of the corpus.
ANCHORS = "the a is was are it le la les est une el los es un una der die das ist ein eine".split()
CACHED_WORDS = 500_000
#: Letters and digits of ASCII stay, in lower case; its other characters part words; bytes of other characters stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ANCHORS = {a.encode() for a in ANCHORS}
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Words(dict):
    """A word's hash, its lowest bit set for anchors."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word) & ~1 | (word in _ANCHORS)
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def spots(text: str) -> np.ndarray:
    """Sorted distinct signatures, 32 bits each."""
    words = text.encode("utf-8", "surrogatepass").translate(TABLE).split()
    if not words:
        return np.zeros(0, np.uint32)
    if len(_words) > CACHED_WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    is_anchor = (h & np.uint64(1)).astype(bool)
    anchor, content = np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor)
    first = np.searchsorted(content, anchor)
    full = first + CHAIN <= len(content)
    anchor, first = anchor[full], first[full]
    out = _mix(h[anchor])
    for k in range(CHAIN):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[content[first + k]])
    if not len(out):
        out = np.array([int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little")], np.uint64)
    return np.unique((out >> np.uint64(32)).astype(np.uint32))


def fingerprint(spots: np.ndarray) -> str:
    return base64.b64encode(spots.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0 without comparing where the lengths alone keep it below least."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    n = int((both[1:] == both[:-1]).sum())
    return n / (len(both) - n)


def _row(doc_id, text: str, own: np.ndarray, after: str, after_spots: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    other = spots(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, fingerprint(own), fingerprint(other), likeness(own, other), likeness(own, after_spots)


def neighbours(docs: DataFrame) -> DataFrame:
    """Documents in partitions, descending by id, each partition followed by the first document of the one after it."""
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    narrow = docs.select(key.alias("key"))
    n = common.partitions(docs.sparkSession)
    bounds = np.array(sorted(set(narrow.approxQuantile("key", [k / n for k in range(1, n)], 0.001))) if n > 1 else [], float)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy().astype(float), side="right").astype(np.int32))

    # One row for each partition: its greatest key, and the partition before it in descending order (a ring).
    tops = narrow.groupBy(place("key").alias("part")).agg(F.max("key").alias("top")).orderBy("part").collect()
    before = {tops[k]["top"]: tops[(k + 1) % len(tops)]["part"] for k in range(len(tops))}

    @F.pandas_udf("int")
    def also(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: before.get(k, -1)).astype("int32")

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    rows = rows.withColumn("own", place("key")).withColumn("other", also("key"))
    copies = F.array(F.struct(F.col("own").alias("part"), F.lit(0).alias("halo")), F.struct(F.col("other").alias("part"), F.lit(1).alias("halo")))
    rows = rows.select("doc_id", "text", "key", F.explode(F.filter(copies, lambda c: c["part"] >= 0)).alias("to"))
    rows = rows.select("doc_id", "text", "key", F.col("to.part").alias("part"), F.col("to.halo").alias("halo"))
    return rows.repartitionById(max(n, len(bounds) + 1), "part").sortWithinPartitions(F.asc("halo"), F.desc("key"), F.asc("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents (doc_id, text), of their edited texts, and likenesses to the edited text and the next document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, False
        for batch in batches:
            out = []
            for doc_id, text, halo in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4)), strict=True):
                if last:
                    break
                own = spots(text)
                if held:
                    out.append(_row(*held, text, own))
                held, last = (doc_id, text, own), bool(halo)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in OUT.split(", ")])

    return neighbours(docs).mapInArrow(rows, OUT)


def pairs(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, likeness) of at least `least` between class representatives, and each document's representative."""

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: spots(t or "").astype(np.int64))

    own = docs.where("doc_id is not null").select("doc_id", sets("text").alias("items"))
    members = common.written(own.withColumn("class", F.sha2(F.array_join("items", ","), 256)), "spots")
    classes = members.groupBy("class").agg(F.min("doc_id").alias("representative"), F.any_value("items").alias("items"))
    classes = common.written(classes.where(F.size("items") > 0).withColumn("n", F.size("items")), "classes")
    # Sets in partition p have lengths from least^-p on; a partner's partition is p or next to it.
    part = F.floor(F.log("n") / math.log(1 / least) + 1e-9).cast("int")
    items = classes.select("representative", "n", part.alias("part"), F.explode("items").alias("item"))
    frequency = items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    window = Window.partitionBy("representative")
    ranked = items.join(frequency, "item").withColumn("rank", F.row_number().over(window.orderBy("df", "item"))).withColumn("total", F.count(F.lit(1)).over(window))
    rare = ranked.where(F.col("rank") <= F.col("total") - F.ceil(F.col("n") * least - 1e-9) + 1)
    one = rare.select("item", "part", F.col("representative").alias("a"), F.col("n").alias("na"))
    two = rare.select("item", F.explode(F.sequence(F.col("part") - 1, F.col("part") + 1)).alias("part"), F.col("representative").alias("b"), F.col("n").alias("nb"))
    found = one.join(two, ["part", "item"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    x, y = classes.select(F.col("representative").alias("a"), F.col("items").alias("x")), classes.select(F.col("representative").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    scored = found.join(x, "a").join(y, "b").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("likeness"))
    names = members.groupBy("class").agg(F.min("doc_id").alias("representative"))
    return scored.where(F.col("likeness") >= least - 1e-12), members.select("doc_id", "class").join(names, "class").select("doc_id", "representative")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
