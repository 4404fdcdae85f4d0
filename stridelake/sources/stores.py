"""Stores that are written once and verified when they are read.

A store is a folder of batches and a log with one entry for each. A batch is written under a new name, counted and digested while it
is written, read again and compared, and only then entered in the log; what the log does not name is not part of the store, so
a job that dies half-way leaves nothing behind that is read. An entry holds the batch's schema, rows and digest, the format version
and the state of the job that wrote it. The digest is a sum over rows, so it needs no order and no gathering.
"""

from __future__ import annotations

import json
import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Each row's digest is below this, so that sums over 10^14 rows fit in 38 digits.
MODULUS = Decimal(10) ** 24


class StoreError(ValueError):
    """What is stored, or would be, is not what it should be."""


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def row_digest(columns: list[str]) -> Column:
    """A number for a row's content, from two hashes of its columns in the order of their names."""
    own = [F.col(c) for c in sorted(columns)]
    return F.xxhash64(*own).cast("decimal(38,0)") * 4294967296 + F.hash(*own)


def _summary(columns: list[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.pmod(row_digest(columns), F.lit(MODULUS))), F.lit(0)).cast("string").alias("digest")]


def entries(spark: SparkSession, path: str) -> list[dict]:
    """The log's entries in their order."""
    if not _exists(spark, f"{path}/log"):
        return []
    rows = spark.read.option("recursiveFileLookup", "true").text(f"{path}/log").collect()
    return sorted((json.loads(r["value"]) for r in rows), key=lambda e: e["number"])


def _read(spark: SparkSession, path: str, entry: dict) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(entry["schema"]))
    return spark.read.schema(schema).parquet(f"{path}/batches/{entry['folder']}").select(*schema.names)


def load(spark: SparkSession, path: str, version: str, required: dict[str, str] | None = None, verify: bool = True) -> DataFrame:
    """All rows of the store. Another format version, a required column that is missing or of another type, and a batch whose
    rows or digest are not those of its entry are errors."""
    log = entries(spark, path)
    if not log:
        raise StoreError(f"no store at {path}")
    parts = []
    for entry in log:
        if entry["version"] != version:
            raise StoreError(f"format version {entry['version']!r}, expected {version!r}")
        kinds = {f["name"]: f for f in json.loads(entry["schema"])["fields"]}
        wrong = [c for c, kind in (required or {}).items() if c not in kinds or T.StructField.fromJson(kinds[c]).dataType.simpleString() != kind]
        if wrong:
            raise StoreError(f"missing or of another type: {', '.join(wrong)}")
        part = _read(spark, path, entry)
        if verify:
            found = part.agg(*_summary(part.columns)).first()
            if (found["rows"], found["digest"]) != (entry["rows"], entry["digest"]):
                raise StoreError(f"batch {entry['number']} has {found['rows']} rows, declared {entry['rows']}, or other content")
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def publish(rows: DataFrame, path: str, keys: list[str], version: str, state: dict, partition_by: tuple[str, ...] = ()) -> dict:
    """Adds the rows whose key the store lacks; returns the numbers of rows written and reused.

    A store that another state or version wrote, one key with two contents in the rows, and a known key with other content are
    errors, and then nothing is written. A rerun writes nothing. Keys must not be null.
    """
    spark, log = rows.sparkSession, entries(rows.sparkSession, path)
    if log and log[0]["state"] != state:
        raise StoreError("the store was written with another state")
    columns = rows.columns
    digested = rows.withColumn("_digest", row_digest(columns))
    nulls = F.count_if(F.greatest(*[F.col(k).isNull() for k in [*keys, keys[0]]]))
    if rows.agg(nulls).first()[0]:
        raise StoreError(f"null in {', '.join(keys)}")
    if digested.groupBy(*keys).agg(F.min("_digest").alias("lo"), F.max("_digest").alias("hi")).where("lo <> hi").limit(1).count():
        raise StoreError("one key has two contents")
    fresh, reused = rows.dropDuplicates(keys), 0
    if log:
        known = load(spark, path, version)
        if sorted(known.columns) != sorted(columns):
            raise StoreError("the store has other columns")
        known = known.select(*keys, row_digest(columns).alias("_known"))
        both = digested.dropDuplicates(keys).join(known, keys).agg(F.count(F.lit(1)), F.count_if(F.col("_digest") != F.col("_known"))).first()
        if both[1]:
            raise StoreError(f"{both[1]} known keys have other content")
        fresh, reused = fresh.join(known.select(*keys), keys, "left_anti").select(*columns), both[0]
    seen, folder = Observation(), uuid.uuid4().hex
    at = f"{path}/batches/{folder}"
    fresh.observe(seen, *_summary(columns)).write.partitionBy(*partition_by).parquet(at)
    written = seen.get
    if not written["rows"]:
        _remove(spark, at)
        return {"written": 0, "reused": reused}
    entry = {"number": len(log), "folder": folder, "version": version, "state": state, "schema": fresh.schema.json(), **written}
    read = _read(spark, path, entry)
    again = read.agg(*_summary(read.columns)).first()
    if (again["rows"], again["digest"]) != (written["rows"], written["digest"]):
        _remove(spark, at)
        raise StoreError("what was read again is not what was written")
    # A second writer of the same number fails here, as the folder is there.
    spark.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/log/{entry['number']:08d}")
    return {"written": written["rows"], "reused": reused}


CLIP_FIELDS = {"motion_id": "bigint", "frame": "bigint", "fps": "double", "split": "string"}
CLIP_VERSION, REPORT_VERSION = "clips.v1", "report.v1"
ARRAY = ["motion_id", "metric", "field"]


def save_clips(frames: DataFrame, path: str, state: dict) -> dict:
    """A2: frames of clips, by motion_id and frame, in folders by split."""
    return publish(frames, path, ["motion_id", "frame"], CLIP_VERSION, state, ("split",))


def load_clips(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, CLIP_VERSION, CLIP_FIELDS)


def _declared(dense: DataFrame) -> DataFrame:
    """Shape and digest of each dense array of rows (motion_id, metric, field, frame, joint, value)."""
    digest = F.sum(F.pmod(row_digest(["frame", "joint", "value"]), F.lit(MODULUS))).cast("string")
    return dense.groupBy(*ARRAY).agg(F.count_distinct("frame").alias("frames"), F.count_distinct("joint").alias("joints"), F.count(F.lit(1)).alias("values"), digest.alias("digest"))


def save_report(summary: DataFrame, dense: DataFrame, path: str, state: dict) -> dict:
    """A report as compact rows (motion_id, metric, value), declared arrays, and the arrays' values (ARRAY, frame, joint, value)."""
    out = {"dense": publish(dense, f"{path}/dense", [*ARRAY, "frame", "joint"], REPORT_VERSION, state)}
    out["arrays"] = publish(_declared(load(dense.sparkSession, f"{path}/dense", REPORT_VERSION)), f"{path}/arrays", ARRAY, REPORT_VERSION, state)
    out["summary"] = publish(summary, f"{path}/summary", ["motion_id", "metric"], REPORT_VERSION, state)
    return out


def load_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Summary and dense values. Arrays that are missing, undeclared, or of another shape or content, and arrays of a metric that the
    summary lacks, are errors."""
    summary, dense, arrays = (load(spark, f"{path}/{name}", REPORT_VERSION, verify=name != "dense") for name in ("summary", "dense", "arrays"))
    said, found = (df.select(*ARRAY, F.struct("frames", "joints", "values", "digest").alias(name)) for df, name in ((arrays, "said"), (_declared(dense), "found")))
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("said").isNull(), "undeclared").when(F.col("said") != F.col("found"), "changed")
    faults = said.join(found, ARRAY, "full_outer").select(*ARRAY, fault.alias("fault")).where("fault IS NOT NULL")
    faults = faults.unionByName(arrays.join(summary, ["motion_id", "metric"], "left_anti").select(*ARRAY, F.lit("without a summary").alias("fault")))
    if bad := faults.limit(5).collect():
        raise StoreError("; ".join(f"{r['fault']} array {r['metric']}.{r['field']} of {r['motion_id']}" for r in bad))
    return summary, dense
