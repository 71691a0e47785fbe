"""A keyed table in buckets, of which an upsert rewrites only those that it touches.

Under its path a table has ``data``, with a folder for each bucket of each write, and ``versions``, with a small file
for each version that names the folder of every bucket. A version's file is made in one step and never replaced, so
that a write that fails, or meets another one, leaves the table as it was; rows of a failed write are in folders that no
version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import upsert


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _commit(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Make the version's file, whole or not at all; another writer's version is an error."""
    fs, to = _fs(spark, f"{path}/versions/{version:012}.json")
    _, made = _fs(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    fs.mkdirs(to.getParent())
    out = fs.create(made, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(to) or not fs.rename(made, to):
        fs.delete(made, False)
        raise RuntimeError(f"version {version} of {path} is there already: another write was faster")


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/versions")
    found = fs.listStatus(folder) if fs.exists(folder) else []
    names = (f.getPath().getName() for f in found)
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def _version(spark: SparkSession, path: str, version: int | None) -> tuple[int, dict]:
    number = max(versions(spark, path)) if version is None else version
    fs, p = _fs(spark, f"{path}/versions/{number:012}.json")
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return number, json.loads(text)


def create(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 256) -> None:
    """An empty table. A bucket is one task's in a write: choose so many that each is a few hundred MB."""
    _commit(spark, path, 0, {"schema": schema, "keys": keys, "buckets": buckets, "folders": {}})


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as it is, or as an earlier version had it."""
    _, now = _version(spark, path, version)
    return _rows(spark, path, now, now["folders"].values())


def _rows(spark: SparkSession, path: str, now: dict, folders) -> DataFrame:
    at = [f"{path}/{f}" for f in sorted(folders)]
    return spark.read.schema(now["schema"]).parquet(*at) if at else spark.createDataFrame([], now["schema"])


def write(new: DataFrame, path: str, order: str | None = None) -> int:
    """Put rows over those of the same keys, as :func:`tables.upsert` does, and return the new version's number. Only
    buckets that have new keys are read and rewritten; the same write again changes nothing but
    files; no rows make no version."""
    spark = new.sparkSession
    number, now = _version(spark, path, None)
    bucket = F.pmod(F.xxhash64(*(F.col(k) for k in now["keys"])), F.lit(now["buckets"])).cast("int")
    new = new.select(*spark.createDataFrame([], now["schema"]).columns)
    touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())  # at most as many as there are buckets
    if not touched:
        return number
    old = _rows(spark, path, now, [f for b, f in now["folders"].items() if int(b) in set(touched)])
    folder = f"data/{uuid.uuid4().hex}"
    merged = upsert(old, new, now["keys"], order).withColumn("_bucket", bucket)
    merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    _commit(spark, path, number + 1, now | {"folders": now["folders"] | {str(b): f"{folder}/_bucket={b}" for b in touched}})
    return number + 1
