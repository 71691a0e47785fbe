"""Joins in time and by key, and assembling rows from parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written

#: Most indices that :func:`dense_fill` makes at once.
CHUNK = 1 << 16


def nearest_in_time(segments: DataFrame, frames: DataFrame, keys: list[str], time: str, frame_time: str, segment_id: str, frame_id: str) -> DataFrame:
    """(segment columns, nearest frame's id and time): the frame of the same keys with the least
    time difference; equally near, the earlier frame, then the smaller id. Segments without a
    frame, or without a time, are left out.

    Both sides are sorted in ranges of (keys, time), so that a long video is several tasks'; what a range
    lacks are the last frame before it and the first one after it, which are carried to it from
    the ranges' ends. No pairs are made."""
    s = segments.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_seg"), F.lit(None).cast(frames.schema[frame_id].dataType).alias("_f"), F.struct(*segments.columns).alias("_s"))
    f = frames.groupBy(*keys, F.col(frame_time).alias("_t")).agg(F.min(frame_id).alias("_f")).select(*keys, "_t", F.lit(0).alias("_seg"), "_f", F.lit(None).cast(s.schema["_s"].dataType).alias("_s"))
    both = s.unionByName(f).where(F.col("_t").isNotNull())
    ranged = written(both.repartitionByRange(*keys, "_t", "_seg", F.xxhash64("_s")).withColumn("_p", F.spark_partition_id()))
    frame = F.when(F.col("_seg") == 0, F.struct(F.col("_t").alias("t"), F.col("_f").alias("f")))
    ends = W.partitionBy(*keys).orderBy("_p")  # a row for each range of a video
    before, after = ends.rowsBetween(W.unboundedPreceding, -1), ends.rowsBetween(1, W.unboundedFollowing)
    carried = ranged.groupBy("_p", *keys).agg(F.max(frame).alias("_a"), F.min(frame).alias("_b"))
    carried = carried.withColumns({"_a": F.last("_a", ignorenulls=True).over(before), "_b": F.first("_b", ignorenulls=True).over(after)})
    carried = carried.select("_p", *keys, F.explode(F.array("_a", "_b")).alias("_n")).where("_n is not null")
    carried = carried.select(*keys, F.col("_n.t").alias("_t"), F.lit(0).alias("_seg"), F.col("_n.f").alias("_f"), F.lit(None).cast(ranged.schema["_s"].dataType).alias("_s"), "_p")
    upto = W.unboundedPreceding, 0
    one = W.partitionBy("_p", *keys)
    up, down = one.orderBy("_t", "_seg").rowsBetween(*upto), one.orderBy(F.desc("_t"), "_seg").rowsBetween(*upto)
    near = ranged.unionByName(carried).withColumn("_a", F.last(frame, ignorenulls=True).over(up)).withColumn("_b", F.last(frame, ignorenulls=True).over(down)).where("_seg = 1")
    first = F.col("_b").isNull() | (F.col("_a").isNotNull() & ((F.col("_t") - F.col("_a.t")) <= (F.col("_b.t") - F.col("_t"))))
    chosen = near.select("_s.*", F.when(first, F.col("_a")).otherwise(F.col("_b")).alias("_n"))
    return chosen.where("_n is not null").select("*", F.col("_n.f").alias("nearest_faiss_id"), F.col("_n.t").alias("nearest_time")).drop("_n")


def segment_midpoint(start: Column, end: Column) -> Column:
    return (start + end) / 2


def unmatched(segments: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with segments but no frame, and how many segments."""
    return segments.join(frames.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.count("*").alias("n_segments"))


def enrich(docs: DataFrame, frames: DataFrame, on: str = "faiss_id") -> DataFrame:
    """Documents with their frame's columns; one without a frame keeps nulls. ``frames`` has a row for each id."""
    return docs.join(frames, on, "left")


def with_fallback_path(rows: DataFrame, files: DataFrame, first: Column, second: Column) -> DataFrame:
    """``asset``: ``first`` if ``files`` (path) has it, else ``second``, else null."""
    a, b = (files.select(F.col("path").alias(n)).distinct() for n in ("_a", "_b"))
    return rows.join(a, first == F.col("_a"), "left").join(b, second == F.col("_b"), "left").withColumn("asset", F.coalesce("_a", "_b")).drop("_a", "_b")


def grouped_by_video(frames: DataFrame) -> DataFrame:
    """Each (split, video_id) in one task, its frames in order."""
    return frames.repartition("split", "video_id").sortWithinPartitions("split", "video_id", "frame_index", "faiss_id")


def dense_fill(features: DataFrame, keys: list[str], dim: int, index: str = "frame_index", vector: str = "embedding") -> DataFrame:
    """A row for each index from 0 to the largest of its keys; gaps have zero vectors. Indices are made ``CHUNK`` at
    a time, however large the largest."""
    last = features.groupBy(*keys).agg(F.max(index).cast("bigint").alias("_m")).where("_m >= 0")
    chunks = last.select(*keys, "_m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"_m div {CHUNK}"))).alias("_c"))
    rows = chunks.select(*keys, F.explode(F.sequence(F.col("_c") * CHUNK, F.least("_m", F.col("_c") * CHUNK + CHUNK - 1))).alias(index))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return rows.join(features.select(*keys, F.col(index).cast("bigint").alias(index), vector), [*keys, index], "left").withColumn(vector, F.coalesce(vector, zero))


def assemble_text(boxes: DataFrame, keys: list[str], position: str, text: str, language: str = "vi") -> DataFrame:
    """Texts of each key joined by a space in order; empty ones don't count, keys without any are left out."""
    kept = boxes.where((F.col(text).isNotNull()) & (F.trim(F.col(text)) != ""))
    parts = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t"))))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("ocr_text"), F.count("*").alias("n_boxes")).withColumn("language", F.lit(language))
