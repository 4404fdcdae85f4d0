"""JSON Lines logs and their frozen prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, keys sorted; a NaN is an error."""
    columns = sorted(df.columns)
    checked = [F.when(F.isnan(c), F.raise_error(F.lit(f"{c} is NaN"))).otherwise(F.col(c)).alias(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c) for c in columns]
    df.select(F.to_json(F.struct(*checked)).alias("value")).write.text(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Malformed rows are errors."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def freeze_prefix(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, rows and sha256 of the complete lines of each log file under path; a last line without its end is left out."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    text = F.decode("content", "UTF-8")
    whole = F.regexp_extract(text, r"(?s)^(.*\n)", 1)
    return files.select("path", F.octet_length(whole).cast("long").alias("bytes"), (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit("")))).cast("long").alias("rows"), F.sha2(whole, 256).alias("sha256"))


def drifted(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """Frozen files that are gone, shorter, or whose frozen prefix has changed (now: path, content)."""
    joined = frozen.join(now, "path", "left")
    prefix = F.substring(F.col("content"), F.lit(1), F.col("bytes").cast("int"))
    return joined.where(F.col("content").isNull() | (F.sha2(prefix, 256) != F.col("sha256"))).select("path")
