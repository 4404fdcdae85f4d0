"""Proportional stratified interleaving into shards.

Rows of each source are put in a seeded random order and ranked; a row's fractional rank is (rank + 1/2) / rows of its
source. All rows sorted by that are a stream in which any stretch has the mixture of the whole, and the stream is cut into
shards whose counts differ by one at most. Ranks come from two range-partitioned sorts of narrow rows: each partition
numbers its own rows, and the counts of the partitions before it are added, so no source is gathered in one task.

Defined results: a null source is a source of its own; a null or empty text has size 1; equal rows get different slots; a
null doc_id sorts first; fewer rows than shards leave some shards empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm import common

SHARDS = 16
SEED = 17


def _global_rank(rows: DataFrame, counts: DataFrame, within: list[str]) -> DataFrame:
    """Adds rank from the rows' places in their partitions and the counts of partitions before; counts has one row for
    each partition (and source that it holds)."""
    by = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(by), F.lit(0)))
    return rows.join(F.broadcast(before) if not within else before, ["_part", *within]).withColumn("rank", F.col("_idx") - F.col("_first") + F.col("_before"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of documents (doc_id, text, source)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", F.concat(F.when(F.col("source").isNull(), "").otherwise("="), F.coalesce("source", F.lit(""))).alias("stratum"), F.col("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    narrow = narrow.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    rows, _ = common.numbered(narrow, "stratum", "draw", "doc_id", name="strata")
    counts = rows.groupBy("_part", "stratum").agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    totals = counts.groupBy("stratum").agg(F.sum("_n").alias("total"))
    ranked = _global_rank(rows, counts, ["stratum"]).join(totals, "stratum")
    fraction = (F.col("rank") + 0.5) / F.col("total")
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", "stratum", "rank", fraction.alias("fraction"))
    stream, sizes = common.numbered(ranked, "fraction", "stratum", "rank", name="stream")
    # One row for each partition of the stream.
    sizes = sizes.withColumn("_first", F.lit(0))
    n = F.coalesce(sizes.agg(F.sum("_n").alias("n")).select("n").scalar(), F.lit(0))
    placed = _global_rank(stream, sizes, []).withColumn("rows", n)
    # Whole-number division, exact for ranks of any size.
    cut = F.expr(f"cast(rank * {shards} div rows as int)")
    placed = placed.withColumn("shard", cut)
    first = F.expr(f"(shard * rows + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("rank") - first).alias("slot"))


def op6_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
