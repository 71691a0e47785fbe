"""Nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into balanced partitions; a small network learns which
partitions a vector's neighbours are in. It then names the partition of every row, and the
several most probable ones of each query; those rows are reranked by exact distance. How many
partitions are searched is set on held-out sample rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_group, discard, table, written
from .vectors import matrix, usable


def neighbours(m: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's ``k`` nearest other rows, in blocks."""
    sq, out = (m * m).sum(axis=1), []
    for at in range(0, len(m), 256):
        d = sq[at : at + 256, None] + sq - 2 * m[at : at + 256] @ m.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_partitions(m: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.05, sweeps: int = 8) -> np.ndarray:
    """Halve at the median of the widest direction until there are ``parts`` (a power of two), then
    move vertices to the part that has most of their neighbours, while no part outgrows its share."""
    part = np.zeros(len(m), dtype=np.int64)
    for _ in range(parts.bit_length() - 1):
        new = np.zeros_like(part)
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            centred = m[at] - m[at].mean(axis=0)
            direction = np.linalg.svd(centred, full_matrices=False)[2][0] if len(at) > 1 else np.zeros(m.shape[1])
            rank = np.argsort(np.argsort(centred @ direction, kind="stable"))
            new[at] = 2 * p + (rank >= (len(at) + 1) // 2)
        part = new
    room = int(np.ceil(len(m) / parts * (1 + slack)))
    size = np.bincount(part, minlength=parts)
    for _ in range(sweeps):
        votes = np.zeros((len(m), parts))
        for column in graph.T:
            votes[np.arange(len(m)), part[column]] += 1
            np.add.at(votes, (column, part), 1)
        gain = votes.max(axis=1) - votes[np.arange(len(m)), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            to = int(votes[v].argmax())
            if size[to] < room:
                size[part[v]] -= 1
                size[to] += 1
                part[v] = to
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """One hidden layer; which partitions a vector's neighbours are in, as probabilities."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    power: int = 0
    probes: int = 1

    def probabilities(self, m: np.ndarray) -> np.ndarray:
        x = np.clip((np.ldexp(m, -self.power) - self.mean) / self.scale, -1e6, 1e6)
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_router(m: np.ndarray, parts: int, k: int, recall: float, hidden: int = 128, epochs: int = 30, seed: int = 7) -> Router:
    """Fit on seven eighths of the sample; set ``probes`` on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(m))
    held = order[: len(m) // 8] if len(m) >= 64 else order
    train = order[len(m) // 8 :] if len(m) >= 64 else order
    k = min(k, len(train) - 1)
    power = int(np.frexp(np.abs(m).max())[1])
    small = np.ldexp(m, -power)
    mean = small[train].mean(axis=0)
    scale = float(np.sqrt(((small[train] - mean) ** 2).mean())) or 1.0
    even = (small - mean) / scale
    x = even[train]
    graph = neighbours(x, k)
    part = balanced_partitions(x, graph, parts)
    target = np.zeros((len(train), parts))
    np.add.at(target, (np.arange(len(train)).repeat(k), part[graph].reshape(-1)), 0.5 / k)
    target[np.arange(len(train)), part] += 0.5
    weights = [rng.standard_normal((m.shape[1], hidden)) * np.sqrt(2 / m.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[at] @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = (z / z.sum(axis=1, keepdims=True) - target[at]) / len(at)
            gh = (g @ weights[2].T) * (h > 0)
            step += 1
            for i, grad in enumerate((x[at].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                weights[i] = weights[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(mean, scale, *weights, power)
    home = router.probabilities(m).argmax(axis=1)
    chance = router.probabilities(m[held])
    place = np.argsort(np.argsort(-chance, axis=1, kind="stable"), axis=1, kind="stable")
    near = neighbours(even, min(k, len(m) - 1))[held]
    met = place[np.arange(len(held))[:, None], home[near]]
    router.probes = next((p for p in range(1, parts) if (met < p).mean() >= recall), parts)
    return router


def parts_for(rows: int, sampled: int) -> int:
    """A power of two near the root of ``rows``, with 16 sampled rows for each part; two at least, for eight rows or more."""
    if sampled < 8:
        return 1
    return 1 << max(1, min(int(np.log2(rows)) // 2, int(np.log2(sampled / 16)) if sampled > 32 else 1))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to ``q``, whether their squares overflow or vanish or not."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = x - q
        square = (d * d).sum(axis=1)
    out = np.sqrt(square)
    if (odd := ~np.isfinite(square) | ((square < 1e-290) & (d != 0).any(axis=1))).any():
        shift = np.where(np.isfinite(square[odd]), 0, 4)[:, None]
        y = np.ldexp(x[odd], -shift) - np.ldexp(q, -shift)
        e = np.frexp(np.abs(y).max(axis=1, keepdims=True))[1]
        with np.errstate(over="ignore"):
            out[odd] = np.ldexp(np.sqrt((np.ldexp(y, -e) ** 2).sum(axis=1)), (e + shift)[:, 0])
    return out


def best_of(ids: np.ndarray, x: np.ndarray, q_ids: list[int], q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, distances) of each query's ``k`` nearest rows. One matrix product tells which rows can be among
    them, given its rounding error; those are compared by their exact distances."""
    power = max(0, int(np.frexp(max(np.abs(x).max(), np.abs(q).max()))[1]) - 200)
    centre = np.ldexp(x, -power).mean(axis=0)
    xs, qs = np.ldexp(x, -power) - centre, np.ldexp(q, -power) - centre
    x2, q2 = (xs * xs).sum(axis=1), (qs * qs).sum(axis=1)
    near = q2[:, None] + x2 - 2 * qs @ xs.T
    for i, query in enumerate(q_ids):
        own = np.flatnonzero(ids != query)
        if len(own) > k:
            d = near[i, own]
            doubt = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (x2.max() + q2[i])
            own = own[d <= np.partition(d, k - 1)[k - 1] + doubt]
        exact = distances(x[own], q[i])
        first = np.lexsort((ids[own], exact))[:k]
        if len(first):
            yield query, ids[own[first]], exact[first]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, parts: int | None = None, recall: float = 0.97, sample: int = 4096, block: int = 1024, query_block: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows found, by Euclidean distance.

    A query's own id is no candidate; all candidates are returned if they are fewer than ``k``
    in all. Ties go to the smaller id. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do rows without an id; vectors are compared with
    those of their own length, and the index is fitted for the commonest length of the sample
    (others are searched whole). Repeated ids of rows are rows of their own, all of them
    candidates; repeated query ids are one query, with the least of their vectors. An empty
    table gives no rows; other columns are not read. ``sample`` bounds the rows that the index
    is fitted on: those with the least hashes of their ids. ``parts`` grows with the table's rows
    unless given.
    """
    base = written(usable(rows, id_col, vec_col))
    fitted = base.orderBy(F.xxhash64("id"), "id").limit(sample).select("dim", "vec").collect()
    if not fitted:
        return base.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    dims, counts = np.unique([r["dim"] for r in fitted], return_counts=True)
    dim = int(dims[counts.argmax()])
    m = matrix([r["vec"] for r in fitted if r["dim"] == dim])
    parts = parts or parts_for(base.count(), len(m))
    router = fit_router(m, parts, k, recall) if parts > 1 else None

    def routed(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = batch.column(1).to_numpy()
                where = np.zeros((batch.num_rows, 1), dtype=np.int64)
                own = np.flatnonzero(d == dim)
                if router is not None and len(own):
                    chance = router.probabilities(matrix(batch.column(2).take(pa.array(own)).to_pylist()))
                    where = np.full((batch.num_rows, probes), -1, dtype=np.int64)
                    where[:, 0] = 0
                    where[own] = np.argsort(-chance, axis=1, kind="stable")[:, :probes]
                row, column = np.nonzero(where >= 0)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(where[row, column].astype(np.int32))], names=["id", "dim", "vec", "part"])

        return run

    kinds = "id long, dim int, vec binary, part int"
    homes = written(base.mapInArrow(routed(1), kinds))
    discard(base)
    sizes = written(homes.groupBy("dim", "part").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("_n")))
    data = by_group(homes, sizes, ["dim", "part"]).groupBy("dim", "part", F.pmod(F.xxhash64("id"), "blocks").alias("block")).agg(F.collect_list("id").alias("ids"), F.collect_list("vec").alias("vecs"))
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("x")).select("id", "x.dim", "x.vec").mapInArrow(routed(router.probes if router else 1), kinds)
    total = queries.count()
    asked = asked.join(sizes, ["dim", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    asked = asked.groupBy("dim", "part", "block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(max(1, -(-total // query_block)))).alias("q")).agg(F.collect_list("id").alias("q_ids"), F.collect_list("vec").alias("q_vecs"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vecs, q_ids, q_vecs in zip(*(batch.column(i) for i in range(4)), strict=True):
                found = list(best_of(np.array(ids.as_py()), matrix(vecs.as_py()), q_ids.as_py(), matrix(q_vecs.as_py()), k))
                if found:
                    columns = np.repeat([f[0] for f in found], [len(f[1]) for f in found]), *(np.concatenate([f[c] for f in found]) for c in (1, 2))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["query_id", "vec_id", "score"])

    met = data.join(asked, ["dim", "part", "block"]).select("ids", "vecs", "q_ids", "q_vecs").mapInArrow(rerank, "query_id long, vec_id long, score double")
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
