"""Tables of frames, vectors, transcripts and their readers and writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME_FIELDS = "split STRING, video_id STRING, frame_name STRING, frame_index INT, global_frame_id BIGINT, timestamp DOUBLE, fps DOUBLE"
FRAMES = f"faiss_id BIGINT, {FRAME_FIELDS}"
OCR = "faiss_id BIGINT, video_id STRING, frame_name STRING, split STRING, global_frame_id BIGINT, timestamp DOUBLE, ocr_text STRING, language STRING"
ASR = "video_id STRING, start_time DOUBLE, end_time DOUBLE, text STRING, nearest_faiss_id BIGINT, nearest_frame_name STRING"
EMBEDDINGS = "faiss_id BIGINT, embedding ARRAY<FLOAT>"
#: Field types of an index mapping, as Spark types.
MAPPED = {"integer": "BIGINT", "keyword": "STRING", "text": "STRING", "float": "DOUBLE"}
#: Named vectors of a multi-vector point and their sizes (fixed values); another set can be given.
POINT_VECTORS = {"openclip": 512, "siglip": 768, "beit3": 768}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def frame_records(spark: SparkSession, path: str) -> DataFrame:
    """(key, frame, record): the members {id: frame} of a JSON object, or frames one after another (with ``faiss_id``, as in
    JSON lines), of each file; ``frame`` is null where a record can't be read. A missing path has no records.

    Files are read in splits, however long their lines: what ends with a brace is a piece, and pieces between
    which a text runs on (its braces are inside quotes) are put together again. Frames have no members
    that are objects themselves."""
    kind = f"faiss_id BIGINT, {FRAME_FIELDS}"
    if not exists(spark, path):
        return spark.createDataFrame([], f"key STRING, frame STRUCT<{kind}>, record STRING")
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '[^"]', ""))
    # texts with a brace: their pieces have an odd number of quotes, the first and the last of each in turn
    odd = pieces.where(quotes % 2 == 1).select("file", "at")
    order = W.partitionBy("file").orderBy("at")
    begun = odd.withColumns({"n": F.row_number().over(order), "upto": F.lead("at").over(order)}).where("n % 2 = 1")
    ranges = begun.select(F.col("file").alias("_file"), F.col("at").alias("since"), "upto", F.explode(F.array_distinct(F.array("at.block", F.coalesce("upto.block", "at.block")))).alias("_block"))
    inside = (F.col("file") == F.col("_file")) & (F.col("at.block") == F.col("_block")) & (F.col("at") >= F.col("since")) & (F.col("at") <= F.col("upto"))
    marked = pieces.join(ranges, inside, "left").select("file", "at", "value", "since")
    whole = marked.where("since is not null").groupBy("file", "since").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "}").alias("value"))
    records = marked.where("since is null").select("value").union(whole.select("value")).where(~F.col("value").rlike(r"^[\s,\[\]{]*$"))
    named = r'^[\s,{\[]*"((?:[^"\\]|\\.)*+)"\s*:\s*(\{[\s\S]*)$'
    of_key = F.col("value").rlike(named)
    body = F.concat(F.when(of_key, F.regexp_extract("value", named, 2)).otherwise(F.regexp_replace("value", r"^[\s,\[]+", "")), F.lit("}"))
    read = F.from_json(body, T.StructType.fromDDL(f"{kind}, _bad STRING"), {"columnNameOfCorruptRecord": "_bad"})
    out = records.select(F.when(of_key, F.regexp_extract("value", named, 1)).alias("key"), read.alias("r"), body.alias("record"))
    names = [f.name for f in T.StructType.fromDDL(kind).fields]
    frame = F.struct(*(F.col(f"r.{n}").alias(n) for n in names))
    id_ = F.coalesce(F.expr("try_cast(key as bigint)"), F.col("r.faiss_id"))
    return out.select(F.coalesce("key", F.col("r.faiss_id").cast("string")).alias("key"), F.when(F.col("r._bad").isNull() & id_.isNotNull(), frame.withField("faiss_id", id_)).alias("frame"), "record")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames of :func:`frame_records`; a record that can't be read, or a frame without a required field, is an error."""
    found = frame_records(spark, path)
    required = ["split", "video_id", "frame_name", "frame_index", "global_frame_id"]
    wrong = F.concat(F.lit("frame without a required field: "), F.coalesce("key", F.substring("record", 1, 100)))
    missing = F.col("frame").isNull() | F.greatest(*(F.col(f"frame.{c}").isNull() for c in required))
    return found.select(F.when(missing, F.raise_error(wrong).cast("bigint")).otherwise(F.col("frame.faiss_id")).alias("faiss_id"), *(F.col(f"frame.{n}") for n in T.StructType.fromDDL(FRAME_FIELDS).names))


def read_frames_or_none(spark: SparkSession, path: str) -> DataFrame:
    """Like :func:`read_frames`, but fields may be missing, and a record that can't be read, or a missing file, has no
    rows; :func:`bad_frames` has such records."""
    return frame_records(spark, path).where("frame is not null").select("frame.*")


def bad_frames(spark: SparkSession, path: str) -> DataFrame:
    """(key, record) of the records that can't be read."""
    return frame_records(spark, path).where("frame is null").select("key", "record")


def read_ocr(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of text boxes' documents for each file (or a document a line); a missing file has no rows, a malformed document is dropped."""
    return _documents(spark, path, OCR, lines)


def read_asr(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _documents(spark, path, ASR, lines)


def _documents(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)


def mapping_schema(properties: dict[str, dict]) -> str:
    """Spark DDL of an index mapping's ``properties``."""
    return ", ".join(f"`{name}` {MAPPED[field['type']]}" for name, field in properties.items())


def create_if_absent(spark: SparkSession, tables: dict[str, str]) -> list[str]:
    """Write an empty Parquet table for each {path: DDL} that isn't there; the paths created."""
    made = [path for path in tables if not exists(spark, path)]
    for path in made:
        spark.createDataFrame([], tables[path]).write.parquet(path)
    return made


def append(df: DataFrame, path: str) -> int:
    """Add rows and say how many; a second run adds them again."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def write_vectors(df: DataFrame, path: str) -> None:
    df.select(F.col("faiss_id").cast("bigint"), F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    """A folder for each split; a video's rows lie together in frame order."""
    df.repartition("split", "video_id").sortWithinPartitions("split", "video_id", "frame_index").write.mode("overwrite").partitionBy("split").parquet(path)


def write_json(df: DataFrame, path: str, force: bool = False) -> bool:
    """Write if there are rows, or anyway if ``force``; whether it did."""
    if not force and df.isEmpty():
        return False
    df.write.mode("overwrite").json(path)
    return True


def point_schema(vectors: dict[str, int] | None = None) -> str:
    return ", ".join(["id BIGINT", *(f"{v} ARRAY<FLOAT>" for v in vectors or POINT_VECTORS), "video_id STRING, frame_name STRING, timestamp DOUBLE, split STRING"])


def vectors_fit(vectors: dict[str, int] | None = None) -> Column:
    """Whether each named vector of a point has its size."""
    fits = [F.coalesce(F.size(v) == n, F.lit(False)) for v, n in (vectors or POINT_VECTORS).items()]
    out = fits[0]
    for f in fits[1:]:
        out = out & f
    return out


def recreate_points(spark: SparkSession, path: str, vectors: dict[str, int] | None = None) -> None:
    spark.createDataFrame([], point_schema(vectors)).write.mode("overwrite").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Rows of both, one for each key: the new side's, and of several the one with the highest ``version``, or,
    of equal or no versions, always the same one. A maximum, so it is combined before the shuffle."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    others = [c for c in old.columns if c not in keys]
    order = F.struct("_side", *([version] if version else []), F.xxhash64(*(F.col(c) for c in old.columns)))
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row"))
    return latest.select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in old.columns))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's name under ``spark.checkpoint.dir``; under one of our own where that is unset (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in a :func:`scratch_dir`: computed once, its lineage cut."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
