"""Hard negatives by slots between the positives' upper limits.

An anchor's positives are its best rows of its own label. Each allows negatives up to a share of its
score, so the positives' windows overlap; their upper limits, in descending order, split all scores
into disjoint slots. Tasks keep the best few rows of each (anchor, slot), which combine as any maximum
does. A window's best are then those of its upper limit's slot and, where that has too few, of the
slots below: one merge of slots from the bottom up answers all windows, and the lower limit cuts it.

Anchors in blocks meet all rows in parts, once for positives and once for negatives: a task holds a
block of anchors and what it has found for them, and rows stream past it as matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, table, written

#: Anchors in a block, rows in a part, most parts; scores that are made at once.
ANCHORS, ROWS, PARTS, TILE = 16_384, 8_192, 4_096, 1 << 21
#: No score counts as more or less than this, so that its multiples by 100 are longs too.
MOST = 1 << 56
_CELL = ("dim", "block", "part")
_FOUND = "anchor long, slot int, score long, id long, row long"


def quantized(df: DataFrame, scale: int, id_col: str, label_col: str, vec_col: str, anchor: Column) -> DataFrame:
    """(row, id, label, dim, vec, anchor): components times ``scale``, rounded down, as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
            fine = np.isfinite(flat)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.clip(np.floor(scale * flat), -1e300, 1e300).astype("<f8")
            size = lists.value_lengths().to_numpy()
            end = np.cumsum(size)
            kept = [k for k, (a, b) in enumerate(zip(end - size, end, strict=True)) if fine[a:b].all()]
            row, ids, label, _, asks = (c.take(pa.array(kept, pa.int64())) for c in batch.columns)
            vecs = [flat[end[k] - size[k] : end[k]].tobytes() for k in kept]
            yield pa.RecordBatch.from_arrays([row, ids, label, pa.array(size[kept], pa.int32()), pa.array(vecs, pa.binary()), asks], names=["row", "id", "label", "dim", "vec", "anchor"])

    numbered = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    return numbered.where("id is not null and label is not null and v is not null").mapInArrow(run, "row long, id long, label long, dim int, vec binary, anchor boolean")


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows of whole numbers, exact, between ``-MOST`` and ``MOST``; no component of ``a`` is larger than ``most``."""
    if not a.shape[1] or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if a.shape[1] * most * np.abs(b).max() < 2**53:
        return np.clip((a @ b.T).astype(np.int64), -MOST, MOST)
    whole = [[[int(x) for x in r] for r in m.tolist()] for m in (a, b)]
    return np.array([[max(-MOST, min(MOST, sum(x * y for x, y in zip(r, s, strict=True)))) for s in whole[1]] for r in whole[0]], dtype=np.int64)


def begins_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where runs of equal pairs begin; there is at least one."""
    return np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


def first_of(k: int, anchor: np.ndarray, slot: np.ndarray, *ranked: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``k`` best (score, id, row) of each (anchor, slot): higher scores first, then smaller ids."""
    score, ids, row = ranked
    order = np.lexsort((row, ids, -score, slot, anchor))
    begins = begins_of(anchor[order], slot[order])
    nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return tuple(x[order[nth < k]] for x in (anchor, slot, *ranked))


def best_in_slots(anchors: DataFrame, rows: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(anchor, slot, score, id, row): of rows of the anchor's label (or of others), the ``k`` best of each slot as each
    part of the rows has them. ``anchors`` are rows with ``high``, their slots' upper limits in descending
    order, of which each excludes itself and what is above, and ``low``, below which nothing counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            if found is not None and len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held["row"][found[0]], found[1].astype(np.int32), *found[2:])], names=["anchor", "slot", "score", "id", "row"])

        now, held, found, arriving = None, None, None, []
        for batch in batches:
            cells = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
            is_row = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1) | (is_row[1:] != is_row[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if a == b:
                    continue
                if tuple(cells[a]) != now:
                    yield from out()
                    now, held, found, arriving = tuple(cells[a]), None, None, []
                some = batch.slice(a, b - a)
                if not is_row[a]:
                    arriving.append(some)
                    continue
                if held is None and not arriving:
                    continue
                if held is None:
                    held = block_of(pa.Table.from_batches(arriving))
                    found = tuple(np.empty(0, dtype=np.int64) for _ in range(5))
                    arriving = []
                found = scan(held, found, some)
        yield from out()

    def block_of(t: pa.Table) -> dict:
        dim, high = t.column("dim")[0].as_py(), t.column("high").to_pylist()
        slots = max(1, max(map(len, high)))
        limits = np.full((t.num_rows, slots), np.iinfo(np.int64).min)
        for i, x in enumerate(high):
            limits[i, : len(x)] = x
        held = {c: t.column(c).to_numpy() for c in ("row", "label", "low")}
        m = np.frombuffer(b"".join(t.column("vec").to_pylist()), dtype="<f8").reshape(t.num_rows, dim)
        return held | {"m": m, "most": np.abs(m).max(initial=0), "limits": limits, "least": np.repeat(held["low"][:, None], slots, axis=1)}

    def scan(held: dict, found: tuple, batch: pa.RecordBatch) -> tuple:
        ids, row, label = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "row", "label"))
        vecs, dim = batch.column(batch.schema.get_field_index("vec")).to_pylist(), held["m"].shape[1]
        step = max(1, TILE // len(held["m"]))
        for at in range(0, len(ids), step):
            of = slice(at, at + step)
            score = products(held["m"], np.frombuffer(b"".join(vecs[of]), dtype="<f8").reshape(len(vecs[of]), dim), held["most"])
            same = held["label"][:, None] == label[of]
            fits = (same & (held["row"][:, None] != row[of]) if same_label else ~same) & (score <= held["limits"][:, :1]) & (score >= held["low"][:, None])
            i, j = np.nonzero(fits)
            s = score[i, j]
            slot = (held["limits"][i] >= s[:, None]).sum(axis=1) - 1
            could = s >= held["least"][i, slot]
            i, j, s, slot = i[could], j[could], s[could], slot[could]
            if not len(i):
                continue
            found = first_of(k, *(np.concatenate(x) for x in zip(found, (i, slot, s, ids[of][j], row[of][j]), strict=True)))
            begins = begins_of(found[0], found[1])
            begins = begins[np.diff(np.append(begins, len(found[0]))) == k]
            held["least"][found[0][begins], found[1][begins]] = found[2][begins + k - 1]
        return found

    blocks, parts = max(1, -(-anchors.count() // ANCHORS)), min(PARTS, max(1, -(-rows.count() // ROWS)))
    hashed = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = (F.lit(None).cast("array<long>").alias("high"), F.lit(None).cast("long").alias("low"))
    one = anchors.select("dim", hashed(blocks, 1).alias("block"), every(parts).alias("part"), F.lit(False).alias("is_row"), "row", "id", "label", "vec", "high", "low")
    two = rows.select("dim", every(blocks).alias("block"), hashed(parts, 2).alias("part"), F.lit(True).alias("is_row"), "row", "id", "label", "vec", *none)
    return one.union(two).repartition(*_CELL).sortWithinPartitions(*_CELL, "is_row").mapInArrow(run, _FOUND)


def hard_negatives(df: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where ``anchor`` holds.

    Scores are inner products of components times ``scale``, rounded down; higher ones come first, ties by
    smaller id. An anchor's positives are its first ``n_positives`` other rows of the same label; for each,
    the first ``n_negatives`` rows of other labels with a score from ``low`` to ``high`` percent of the positive's
    are its negatives (a negative score has none). Rows with a null id or label, and vectors that are null
    or have null or non-finite components, take no part; vectors of different lengths don't meet; a score
    beyond 2^56 counts as that. Rows that share an id are rows of their own, also as anchors. Other
    columns are not read; an empty table gives no rows.
    """
    rows = written(quantized(df, scale, id_col, label_col, vec_col, anchor))
    asked = rows.where("anchor").drop("anchor")
    order = (F.desc("score"), "id", "row")

    def first(found: DataFrame, k: int, *keys: str) -> DataFrame:
        return found.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= k)

    whole = asked.withColumns({"high": F.array(F.lit(MOST)), "low": F.lit(-MOST)})
    positives = first(best_in_slots(whole, rows, n_positives, True), n_positives, "anchor")
    # upper and lower limits in whole numbers: 95 * p rounded down, 50 * p rounded up
    upto, least = (F.expr(x) for x in (f"score * {high} div 100 - if(pmod(score * {high}, 100) <> 0 and score < 0, 1, 0)", f"score * {low} div 100 + if(pmod(score * {low}, 100) <> 0 and score > 0, 1, 0)"))
    positives = written(positives.select("anchor", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), upto.alias("upto"), least.alias("least")))
    limits = positives.where("least <= upto").groupBy("anchor").agg(F.sort_array(F.collect_set("upto"), asc=False).alias("high"), F.min("least").alias("low"))
    limited = written(asked.join(limits, asked["row"] == limits["anchor"]))
    slots = first(best_in_slots(limited.drop("anchor"), rows, n_negatives, False), n_negatives, "anchor", "slot")
    slots = slots.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "nth", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("slots"))
    slots = limited.select("anchor", F.col("id").alias("anchor_id"), "high").join(slots, "anchor")

    # slots come from the top down: a window's are those from its upper limit's on
    merged = F.slice(F.filter("slots", lambda x: x["slot"] >= F.array_position("high", F.col("upto")) - 1), 1, n_negatives)
    answered = positives.where("least <= upto").join(slots, "anchor").select("anchor_id", "positive_id", "positive_score", F.posexplode(F.filter(merged, lambda x: x["negative_score"] >= F.col("least"))).alias("rank", "x"))
    return answered.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), "x.negative_id", "positive_score", "x.negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.pmod("vec_id", F.lit(50)) == 0)


OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM (SELECT * FROM e WHERE vec_id % 50 = 0) a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
