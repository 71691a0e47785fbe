"""Frame metadata: normalising, keys of assets, and checks over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import FPS, folder_of_split, frame_seconds, normal_key

#: File name endings of videos (fixed values).
VIDEO_ENDINGS = ("mp4", "mkv", "avi", "mov", "webm", "m4v", "ts", "wmv")


def normalize_metadata(frames: DataFrame, fps: float = FPS) -> DataFrame:
    """Eight columns with defaults for what is null."""
    gfid = F.coalesce(F.col("global_frame_id").cast("bigint"), F.lit(0).cast("bigint"))
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("video_id", "frame_name")]
    return frames.select(F.col("faiss_id").cast("bigint").alias("faiss_id"), *text, F.coalesce(F.col("frame_index").cast("bigint"), F.col("faiss_id").cast("bigint")).alias("frame_index"), F.coalesce("split", F.lit("")).alias("split"), gfid.alias("global_frame_id"), frame_seconds(gfid, fps).alias("timestamp"), F.lit(fps).alias("fps"))


def frame_keys(split: Column, video: Column, frame: Column) -> Column:
    """Distinct normalised names under which a frame's video may be stored, in order of preference."""
    folder = folder_of_split(split)
    stem = F.regexp_replace(frame, r"\.[^.]*$", "")
    parts = F.split(F.regexp_replace(stem, "keyframe_", ""), "_")
    two = F.when(F.size(parts) >= 2, F.concat_ws("_", F.get(parts, 0), F.get(parts, 1)))
    names = [video, F.concat_ws("/", split, video), F.concat_ws("_", folder, video), stem, two]
    return F.filter(F.array_distinct(F.array(*map(normal_key, names))), lambda k: k != "")


def asset_keys(path: Column) -> Column:
    """Normalised keys of a file: its stem alone, with its folder, with two folders."""
    parts = F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/")
    n = F.size(parts)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(3))), lambda k: normal_key(F.array_join(F.slice(parts, n - k + 1, k), "/"))))


def asset_index(files: DataFrame, path: str = "path", endings: tuple[str, ...] = VIDEO_ENDINGS) -> DataFrame:
    """(key, path): the first file in path order of each key, of files with one of ``endings``."""
    ending = F.lower(F.regexp_extract(F.col(path), r"\.([^./]*)$", 1))
    keyed = files.where(ending.isin(*endings)).select(F.explode(asset_keys(F.col(path))).alias("key"), F.col(path).alias("path"))
    return keyed.where("key <> ''").groupBy("key").agg(F.min("path").alias("path"))


def explicit_assets(entries: DataFrame) -> DataFrame:
    """(key, path) of entries (name, path, ord): normalised names; of equal ones the last."""
    return entries.groupBy(normal_key(F.col("name")).alias("key")).agg(F.max_by("path", "ord").alias("path"))


def resolve_assets(frames: DataFrame, keys: Column, scanned: DataFrame, explicit: DataFrame | None = None, id_col: str = "faiss_id") -> DataFrame:
    """(id, path): any key in the explicit map, else any in the scan, in key order; null without one."""
    wanted = frames.select(id_col, F.posexplode_outer(keys).alias("ord", "key"))
    sources = scanned.select("key", "path", F.lit(1).alias("source"))
    if explicit is not None:
        sources = sources.union(explicit.select("key", "path", F.lit(0)))
    return wanted.join(sources, "key", "left").groupBy(id_col).agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.struct("source", "ord"))).alias("path"))


def frame_numbers(frames: DataFrame, base: int = 0) -> tuple[DataFrame, DataFrame]:
    """Frames with their number from ``base``; those whose number is negative."""
    numbered = frames.withColumn("frame_number", F.col("global_frame_id") - F.lit(base))
    return numbered.where("frame_number >= 0"), numbered.where("frame_number < 0")


def without_existing(items: DataFrame, done: DataFrame, on: str) -> DataFrame:
    return items.join(done.select(on).distinct(), on, "left_anti")


def with_assets(frames: DataFrame, assets: DataFrame, on: str, strict: bool = False) -> DataFrame:
    """Frames that have an asset; if ``strict``, one without is an error."""
    if strict and not frames.join(assets, on, "left_anti").isEmpty():
        raise ValueError("frames without an asset")
    return frames.join(assets, on, "left_semi")


def extraction_plan(items: DataFrame, path: str = "path") -> DataFrame:
    """``items`` in the order in which each file is best read; one file's items are in one task."""
    return items.repartition(path).sortWithinPartitions(path, "global_frame_id")


def plan_steps(items: DataFrame, path: str = "path") -> DataFrame:
    """``items`` with their step number within their file."""
    return items.withColumn("step", F.row_number().over(W.partitionBy(path).orderBy("global_frame_id", "faiss_id")).cast("bigint"))


def coverage(items: DataFrame, status: str = "status", example: str = "example", examples: int = 20) -> DataFrame:
    """(status, n, examples): counts, and the first few examples in order, gathered from each task's first few."""
    w = W.partitionBy(status).orderBy(example)
    few = items.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= examples)
    few = few.groupBy(status).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return items.groupBy(status).agg(F.count("*").alias("n")).join(few, status, "left")


def first_by_id(frames: DataFrame, n: int, id_col: str = "faiss_id") -> DataFrame:
    return frames.orderBy(id_col).limit(n)


def first_with_assets(frames: DataFrame, assets: DataFrame, n: int, on: str, order: str = "faiss_id") -> DataFrame:
    """The first ``n`` of the frames that have an asset."""
    return with_assets(frames, assets, on).orderBy(order).limit(n)


def deterministic_sample(df: DataFrame, id_col: str, n: int = 25, seed: int = 42) -> DataFrame:
    """``n`` rows, always the same ones of a table: those with the least digests of seed and id."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col))), id_col).limit(n)


def check_counts(vectors: DataFrame, frames: DataFrame) -> DataFrame:
    both = vectors.select(F.lit(1).alias("v"), F.lit(0).alias("m")).union(frames.select(F.lit(0), F.lit(1)))
    out = both.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("n_vectors"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_frames"))
    return out.withColumn("ok", F.col("n_vectors") == F.col("n_frames"))


def check_bounds(frames: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Videos whose largest frame index has no feature row."""
    most = frames.groupBy(*keys).agg(F.max("frame_index").cast("bigint").alias("max_index"))
    rows = features.groupBy(*keys).agg(F.count("*").alias("n_features"))
    both = most.join(rows, keys, "left").withColumn("n_features", F.coalesce("n_features", F.lit(0).cast("bigint")))
    return both.where("n_features <= max_index")


def check_shape(features: DataFrame, vector: str = "embedding") -> DataFrame:
    out = features.agg(F.min(F.size(vector)).cast("bigint").alias("min_dim"), F.max(F.size(vector)).cast("bigint").alias("max_dim"))
    return out.withColumn("ok", F.coalesce(F.col("min_dim") == F.col("max_dim"), F.lit(False)))


def check_duplicates(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_assets(frames: DataFrame, assets: DataFrame, on: str) -> DataFrame:
    return frames.join(assets.select(on), on, "left_anti")


def verdict(checks: DataFrame) -> DataFrame:
    """Of checks (name, ok): whether all passed, and how many didn't."""
    return checks.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"), F.coalesce(F.sum((~F.col("ok")).cast("bigint")), F.lit(0)).alias("failed"))


def checked(vectors: DataFrame, frames: DataFrame, features: DataFrame, keys: list[str], dim: int | None = None, vector: str = "embedding", index: str = "frame_index") -> DataFrame:
    """(name, ok, bad_rows) of all checks in one scan of each table: ``counts`` (as many vectors as frames), ``shape``
    (vectors whose length isn't ``dim``, or, if that isn't given, not the largest), ``bounds`` (videos, by ``keys``, whose largest
    ``index`` has no row in ``features``), ``duplicates`` (indices that a video has several times)."""
    zero = F.lit(0).cast("bigint")
    lengths = vectors.groupBy(F.coalesce(F.size(vector), F.lit(-1)).alias("dim")).agg(F.count("*").alias("n"))  # a row for each length
    of_vectors = lengths.agg(F.coalesce(F.sum("n"), zero).alias("n_vectors"), F.coalesce(F.max("dim"), F.lit(-1)).alias("most"), F.collect_list(F.struct("dim", "n")).alias("x"))
    fits = F.col("most") if dim is None else F.lit(dim)
    bad_shape = F.aggregate("x", zero, lambda a, x: a + F.when(x["dim"] == fits, zero).otherwise(x["n"]))
    of_vectors = of_vectors.select("n_vectors", bad_shape.alias("bad_shape"))
    of_video = frames.groupBy(*keys, index).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"), F.max(index).alias("last"), F.sum((F.col("n") > 1).cast("bigint")).alias("twice"))
    rows = features.groupBy(*keys).agg(F.count("*").alias("rows"))
    both = of_video.join(rows, keys, "left")
    of_frames = both.agg(F.coalesce(F.sum("n"), zero).alias("n_frames"), F.coalesce(F.sum("twice"), zero).alias("twice"), F.coalesce(F.sum((F.coalesce("rows", zero) <= F.col("last")).cast("bigint")), zero).alias("out_of_bounds"))
    one = of_vectors.join(of_frames, F.lit(True))  # a row each
    found = {"counts": F.abs(F.col("n_vectors") - F.col("n_frames")), "shape": F.col("bad_shape"), "bounds": F.col("out_of_bounds"), "duplicates": F.col("twice")}
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (bad == 0).alias("ok"), bad.alias("bad_rows")) for name, bad in found.items())))
    return one.select(each.alias("x")).select("x.*")
