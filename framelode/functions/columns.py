"""Column functions on vectors, frame metadata, keys and query texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FPS = 25.0
#: Substrings that show that a query is about speech (fixed values).
SPEECH_WORDS = ("nghe tiếng", "nói rằng", "âm thanh", "có tiếng", "nói", "nghe")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column, eps: float = 0.0) -> Column:
    """Components over (norm + eps); without eps, a zero vector gives nulls."""
    n = norm(v) + F.lit(eps)
    return F.transform(v, lambda x: F.when(n != 0, x.cast("double") / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_or_zero(v: Column, dim: int) -> Column:
    return F.when(F.size(v) == dim, v).otherwise(F.array_repeat(F.lit(0.0).cast("float"), dim))


def frame_seconds(frame: Column, fps: float = FPS) -> Column:
    return frame.cast("double") / F.lit(fps)


def asset_path(split: Column, video: Column, name: Column) -> Column:
    return F.concat_ws("/", split, video, name)


def feature_path(split: Column, video: Column) -> Column:
    return F.concat(split, F.lit("/"), video, F.lit(".npy"))


def folder_of_split(split: Column) -> Column:
    """The second part of a name like ``videos-l21-a``, in upper case; the whole name if it has no dash."""
    return F.when(F.contains(split, F.lit("-")), F.upper(F.split_part(split, F.lit("-"), F.lit(2)))).otherwise(split)


def frame_name_parts(name: Column) -> Column:
    """STRUCT<folder_key, video_key, frame_key> of a name like ``keyframe_L21_V001_000017.jpg``."""
    parts = F.split(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "keyframe_", ""), "_")
    return F.struct(F.get(parts, 0).alias("folder_key"), F.concat_ws("_", F.get(parts, 0), F.get(parts, 1)).alias("video_key"), F.try_element_at(parts, F.lit(-1)).alias("frame_key"))


def normal_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def stripped(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")


def clean_query(c: Column) -> Column:
    return F.lower(stripped(c))


def yes_probability(yes: Column, no: Column) -> Column:
    """Softmax of two logits; 0 where one is missing."""
    return F.coalesce(1 / (1 + F.exp(no.cast("double") - yes.cast("double"))), F.lit(0.0))


def yes_no_question(query: Column, translated: Column | None = None) -> Column:
    plain = stripped(F.regexp_replace(F.coalesce(translated, query) if translated is not None else query, '"', ""))
    return F.concat(F.lit("Is there a "), F.lower(plain), F.lit("?"))


def query_plan(query: Column) -> Column:
    """STRUCT<original_query, visual_query, ocr_query, asr_query, weights STRUCT<visual, ocr, asr>>.

    Quoted text is looked for on frames, the rest is the visual query; a speech word anywhere
    makes the rest a speech query too. Without a visual query its weight goes to the others."""
    quoted = F.regexp_extract_all(query, F.lit('"([^"]*)"'), F.lit(1))
    has_ocr = F.size(quoted) > 0
    ocr = F.when(has_ocr, stripped(F.array_join(quoted, " "))).otherwise("")
    visual = F.when(has_ocr, stripped(F.regexp_replace(query, '"[^"]*"', ""))).otherwise(query)
    speech = F.exists(F.array(*map(F.lit, SPEECH_WORDS)), lambda w: F.contains(F.lower(query), w))
    asr = F.when(speech, visual).otherwise("")

    def weights(v: float, o: float, a: float) -> Column:
        return F.struct(F.lit(v).alias("visual"), F.lit(o).alias("ocr"), F.lit(a).alias("asr"))

    seen = F.when(has_ocr & speech, weights(0.4, 0.3, 0.3)).when(has_ocr, weights(0.5, 0.5, 0.0)).when(speech, weights(0.7, 0.0, 0.3)).otherwise(weights(1.0, 0.0, 0.0))
    unseen = F.when(has_ocr & speech, weights(0.0, 0.5, 0.5)).when(has_ocr, weights(0.0, 1.0, 0.0)).when(speech, weights(0.0, 0.0, 1.0)).otherwise(weights(0.0, 0.0, 0.0))
    return F.struct(query.alias("original_query"), visual.alias("visual_query"), ocr.alias("ocr_query"), asr.alias("asr_query"), F.when(visual == "", unseen).otherwise(seen).alias("weights"))


def runs(plan: Column, source: str) -> Column:
    """Whether a query plan searches ``source``: its part of the query isn't empty and has a weight."""
    return (plan[f"{source}_query"] != "") & (plan["weights"][source] > 0)
