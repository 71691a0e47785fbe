"""Shards of near-equal bytes by sampled splitters.

Records are ordered by (hash of the text, id, row number), so that equal texts are neighbours and
no two keys are equal. A size-weighted sample of keys gives quantile boundaries of many small
ranges; ranges that turn out overfull are sampled again and subdivided. Exact range totals then say
where each shard begins, and only the ranges are ordered, each by itself: no task ever sees a whole
shard. There are ``MOST`` ranges at most, whatever the input, and the driver gets a bounded sample
for each; only keys and sizes are sorted, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, table, written

_LEAST = -(1 << 63)
#: Most ranges, before overfull ones are subdivided.
MOST = 4096
KEY = ("key_hash", "key_id", "key_row")
#: Names that results and keys have.
RESULTS = frozenset({*KEY, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "range", "row", "begin", "upto", "shift"})


def ranges_of(*keys_and_bounds: np.ndarray) -> np.ndarray:
    """How many boundaries are at or below each key. Given are a key's columns, and last the boundaries
    in ascending rows; only keys that share a boundary's first column look at the next one."""
    *keys, bounds = keys_and_bounds
    low, high = (np.searchsorted(bounds[:, 0], keys[0], side) for side in ("left", "right"))
    if len(keys) == 1:
        return high
    out, shared = low.copy(), high > low
    for a in np.unique(low[shared]):
        at = np.flatnonzero(shared & (low == a))
        out[at] += ranges_of(*(k[at] for k in keys[1:]), bounds[a : high[at[0]], 1:])
    return out


def _with_range(base: DataFrame, bounds: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in KEY)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranges_of(*keys, bounds).astype(np.int64))], names=[*batch.schema.names, "range"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("range", T.LongType())]))


def splitters(base: DataFrame, rows: int, total: int, ranges: int, each: int = 32) -> np.ndarray:
    """Boundaries (rows of ``KEY``), ascending, from about ``ranges * each`` sampled keys.

    A key's chance is the mean of its shares of bytes and of rows: many tiny records fill a range too."""
    share = (F.col("size") / F.lit(float(total)) + F.lit(1.0 / rows)) / 2

    def drawn(df: DataFrame, want: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        chance = share * want
        hit = F.pmod(F.xxhash64(*KEY, "size", F.lit(seed)), F.lit(1 << 31)) / float(1 << 31) < chance
        got = df.where(hit).select(*KEY, F.greatest(chance, F.lit(1.0)).alias("w")).toArrow()
        out = np.stack([got.column(c).to_numpy() for c in KEY], axis=1).astype(np.int64).reshape(-1, len(KEY))
        order = np.lexsort(out.T[::-1])
        return out[order], got.column("w").to_numpy()[order]

    def quantiles(keys: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        if not len(keys):
            return keys
        mid = np.cumsum(weight) / weight.sum()
        return keys[np.minimum(np.searchsorted(mid, np.arange(1, n) / n), len(keys) - 1)]

    bounds = np.unique(quantiles(*drawn(base, ranges * each, 5), ranges), axis=0)
    for again in range(3):
        sizes = _with_range(base, bounds).groupBy("range").agg(F.sum(share).alias("share"), F.count("*").alias("n"))
        full = {r[0]: r[1] for r in sizes.where((F.col("share") > 2 / ranges) & (F.col("n") > 1)).collect()}  # fewer than half of ``ranges``
        if not full:
            break
        keys, weight = drawn(_with_range(base, bounds).where(F.col("range").isin(list(full))), ranges * each * 4, 50 + again)
        of = ranges_of(*keys.T, bounds)
        more = [quantiles(keys[of == r], weight[of == r], int(np.ceil(s * ranges)) + 1) for r, s in full.items()]
        bounds = np.unique(np.concatenate([bounds, *more]), axis=0)
    return bounds


def assign_shards(docs: DataFrame, shards: int = 8, rows_per_range: int = 100_000, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, *carry) for every row.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1); a very long text is one record. Law ``bytes``: a shard begins with the
    first record whose preceding bytes reach its share of all bytes, so shards differ by less
    than the longest record. ``slot`` counts from 0 in each shard without gaps. Null ids order
    as the least id; rows equal in text and id are told apart by their place in the table. An
    empty table gives no rows. ``carry`` names columns to keep; one whose name is a result's is
    given as ``carried_`` and its name.
    """
    kept = [F.col(f"`{c}`").alias(f"carried_{c}" if c.lower() in RESULTS else c) for c in carry]
    carry = tuple(f"carried_{c}" if c.lower() in RESULTS else c for c in carry)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key_hash"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("key_id"), F.monotonically_increasing_id().alias("key_row"), *kept)
    base = written(base)
    rows, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MOST, max(8 * shards, rows // rows_per_range))
    bounds = splitters(base, rows, total, ranges) if rows else np.empty((0, len(KEY)), dtype=np.int64)
    ranged = written(_with_range(base, bounds))
    discard(base)
    spark, begin, before = docs.sparkSession, [], 0
    for r, size in sorted(tuple(x) for x in ranged.groupBy("range").agg(F.sum("size")).collect()):  # a row for each range
        begin.append((r, before))
        before += size
    starts = spark.createDataFrame(begin, "range long, begin long")
    w = W.partitionBy("range").orderBy(*KEY)
    placed = ranged.withColumn("row", F.row_number().over(w).cast("long")).withColumn("upto", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.join(F.broadcast(starts), "range").withColumn("shard", F.expr(f"least({shards - 1}, (begin + upto - size) * {shards} div {max(1, total)})").cast("int")).drop("begin", "upto")
    placed = written(placed)
    discard(ranged)
    counts = sorted(tuple(x) for x in placed.groupBy("range", "shard").agg(F.count("*")).collect())
    shift, used, seen = [], dict.fromkeys(range(shards), 0), {}
    for r, s, n in counts:
        shift.append((r, s, used[s] - seen.get(r, 0) - 1))
        used[s] += n
        seen[r] = seen.get(r, 0) + n
    slots = spark.createDataFrame(shift, "range long, shard int, shift long")
    out = placed.join(F.broadcast(slots), ["range", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry)


def write_shards(assigned: DataFrame, path: str) -> None:
    """A folder for each shard, its files in slot order."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
