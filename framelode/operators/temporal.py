"""Sequences of events in one video by beam search, for a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written
from .models import Use, used

#: Columns that a candidate has besides query_id, event_idx and the video's key.
CANDIDATE = ("faiss_id", "global_frame_id", "timestamp", "score", "split", "cand_rank")


def candidates(hits: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` best hits of each (query_id, event_idx) with their rank; ties to the smaller id; a missing timestamp is 0."""
    order = W.partitionBy("query_id", "event_idx").orderBy(F.desc("score"), "faiss_id")
    ranked = hits.withColumn("cand_rank", F.row_number().over(order).cast("bigint")).where(F.col("cand_rank") <= n)
    return ranked.withColumn("timestamp", F.coalesce(F.col("timestamp").cast("double"), F.lit(0.0)))


def with_all_events(found: DataFrame, keys: list[str], n_events: int) -> DataFrame:
    """Candidates of videos that have one for every event."""
    full = found.groupBy("query_id", *keys).agg(F.count_distinct("event_idx").alias("_n")).where(F.col("_n") == n_events)
    return found.join(full.select("query_id", *keys), ["query_id", *keys], "left_semi")


def decayed(base: Column, gap: Column, alpha: float) -> Column:
    return F.when(gap > 0, base * F.exp(F.lit(-alpha) * gap)).otherwise(base)


def beam_search(found: DataFrame, keys: list[str], n_events: int, beam: int = 50, alpha: float = 0.01) -> DataFrame:
    """(query_id, *keys, frames, base_score, total_score, first, order): up to ``beam`` chains of each video;
    ``first`` is the rank of the video's best candidate of the first event.

    A chain takes one candidate of each event, each with a larger ``global_frame_id`` than the
    one before. Its score is the sum of scores, decayed by the time since its first frame. Ties
    keep the order of the parent chains, then of frame numbers, then of candidates. All steps
    have the same key, so chains move only to meet the next event's candidates.
    """
    group = ["query_id", *keys]
    frame = F.struct(*CANDIDATE)
    start = found.where("event_idx = 0").select(*group, F.array(frame).alias("frames"), F.col("score").alias("base_score"), F.col("score").alias("total_score"), F.min("cand_rank").over(W.partitionBy(*group)).alias("first"), F.row_number().over(W.partitionBy(*group).orderBy(F.desc("score"), "cand_rank")).alias("order"))
    chains = start.where(F.col("order") <= beam)
    for step in range(1, n_events):
        nxt = found.where(F.col("event_idx") == step).select(*group, frame.alias("_f"))
        last = F.element_at("frames", -1)["global_frame_id"]
        longer = chains.join(nxt, group).where(F.col("_f.global_frame_id") > last)
        base = F.col("base_score") + F.col("_f.score")
        gap = F.col("_f.timestamp") - F.element_at("frames", 1)["timestamp"]
        longer = longer.select(*group, F.concat("frames", F.array("_f")).alias("frames"), base.alias("base_score"), decayed(base, gap, alpha).alias("total_score"), "first", F.col("order").alias("_parent"), F.col("_f.global_frame_id").alias("_g"), F.col("_f.cand_rank").alias("_c"))
        order = W.partitionBy(*group).orderBy(F.desc("total_score"), "_parent", "_g", "_c")
        chains = longer.withColumn("order", F.row_number().over(order)).where(F.col("order") <= beam).drop("_parent", "_g", "_c")
    return chains


def splits_of(frames: str = "frames") -> Column:
    return F.array_sort(F.array_distinct(F.transform(frames, lambda f: f["split"])))


def ranked_sequences(chains: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The ``n`` best chains of each query, ``seq`` from 1; ties go to the video that came first among
    the first event's candidates, then in the video's order."""
    order = W.partitionBy("query_id").orderBy(F.desc("total_score"), "first", *keys, "order")
    return chains.withColumn("seq", F.row_number().over(order).cast("bigint")).where(F.col("seq") <= n)


def validated(sequences: DataFrame, scores: DataFrame | Use, n_events: int, keep: float = 0.7, blend: float = 0.3, asked: DataFrame | None = None, assets: DataFrame | None = None) -> DataFrame:
    """``sequences`` with ``vqa_confidence`` (the mean of their frames' scores; a missing one is 0) blended into
    ``total_score``, and numbered anew.

    ``scores`` is a table ([query_id, event_idx,] faiss_id, vqa), or a model that makes ``vqa`` of columns of
    ``asked`` (query_id, event_idx, ...), ``assets`` (faiss_id, ...) and the frame's id. The model gets each
    (query_id, event_idx, faiss_id) of the sequences once, and only those that have an asset."""
    frames = sequences.select("query_id", "seq", F.struct(*sequences.columns).alias("_s"), F.posexplode("frames").alias("event_idx", "_f")).withColumn("faiss_id", F.col("_f.faiss_id"))
    if isinstance(scores, Use):
        pool = frames.select("query_id", "event_idx", "faiss_id").distinct()
        pool = pool if assets is None else pool.join(assets, "faiss_id")
        pool = pool if asked is None else pool.join(asked, ["query_id", "event_idx"])
        scores = used(pool, scores, "vqa double").select("query_id", "event_idx", "faiss_id", F.nanvl("vqa", F.lit(0.0)).alias("vqa"))
    on = [c for c in ("query_id", "event_idx", "faiss_id") if c in scores.columns]
    means = frames.join(scores.select(*on, "vqa"), on, "left").groupBy("query_id", "seq").agg(F.avg(F.coalesce("vqa", F.lit(0.0))).alias("vqa_confidence"), F.first("_s").alias("_s"))
    blended = means.select("_s.*", "vqa_confidence").withColumn("total_score", F.lit(keep) * F.col("total_score") + F.lit(blend) * F.col("vqa_confidence") * F.lit(n_events))
    order = W.partitionBy("query_id").orderBy(F.round("total_score", 9).desc(), "seq")
    return blended.withColumn("new_seq", F.row_number().over(order).cast("bigint"))


def nested_output(sequences: DataFrame, video: Column) -> DataFrame:
    """(query_id, id, frames ARRAY<STRUCT<id, folder_key, video_key, frame_key, timestamp>>), ids from 0."""
    frames = F.transform("frames", lambda f, i: F.struct(i.cast("bigint").alias("id"), f["split"].alias("folder_key"), video.alias("video_key"), f["faiss_id"].alias("frame_key"), f["timestamp"].alias("timestamp")))
    return sequences.select("query_id", (F.col("seq") - 1).alias("id"), frames.alias("frames"))


def temporal_search(hits: DataFrame, keys: list[str], n_events: int, per_event: int = 100, beam: int = 50, alpha: float = 0.01, top: int = 20) -> DataFrame:
    """Candidates, videos with all events, beam search and ranking as one plan."""
    found = with_all_events(candidates(hits, per_event), keys, n_events)
    return ranked_sequences(beam_search(found, keys, n_events, beam, alpha), keys, top)


def most_possible(found: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, *keys, bound): no chain of the video scores more than the sum of its best candidates, or 0 if that is less."""
    best = found.groupBy("query_id", *keys, "event_idx").agg(F.max("score").alias("best"))
    return best.groupBy("query_id", *keys).agg(F.greatest(F.lit(0.0), F.sum("best")).alias("bound"))


def bounded_search(hits: DataFrame, keys: list[str], n_events: int, per_event: int = 100, beam: int = 50, alpha: float = 0.01, top: int = 20, first: int = 20) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`temporal_search`, and the videos (query_id, *keys) that went through the beam.

    A query's ``first`` most promising videos go first; their ``top``-th chain is the least that counts,
    and of the others only those go whose bound reaches it. ``alpha`` isn't negative."""
    found = written(with_all_events(candidates(hits, per_event), keys, n_events))
    bounds = written(most_possible(found, keys).withColumn("_nth", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), *keys))))
    chosen = bounds.where(F.col("_nth") <= first)

    def chains(videos: DataFrame) -> DataFrame:
        return beam_search(found.join(videos.select("query_id", *keys), ["query_id", *keys], "left_semi"), keys, n_events, beam, alpha)

    one = written(chains(chosen))
    nth = one.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("total_score")))).where(F.col("_n") == top).select("query_id", F.col("total_score").alias("_least"))
    rest = bounds.where(F.col("_nth") > first).join(nth, "query_id", "left").where(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - 1e-9 * F.abs("_least")))
    return ranked_sequences(one.unionByName(chains(rest)), keys, top), chosen.select("query_id", *keys).union(rest.select("query_id", *keys))
