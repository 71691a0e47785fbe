"""Embedding near-duplicates by sorted projection passes.

In each pass, vectors are ordered by a random hash (signs of random projections) and
range-partitioned. Each is compared with the next ones in that order, whether their hashes are equal
or not, and all that share the whole hash are compared, however many they are. Two
vectors agree in a bit with a chance that only their angle sets, so the number of passes follows
from the number of bits: a pair at the threshold is missed with a probability of at most ``miss``,
however the vectors lie. The number of bits is the one that costs least on a sample. Pairs that
pass the exact cosine test are united across passes. Within each component, links are then
counted exactly. Long runs and large components are compared in cells, each of two of their
parts, so that no task gets a whole one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_group, components, discard, in_cells, table, written
from .simhash import joined
from .vectors import matrix, scaled, usable

BITS = 60
#: How many rows after it in a pass's order a row is compared with.
NEXT = 32


def passes_of(bits: float, threshold: float, miss: float) -> int:
    """Passes in which two vectors at the threshold never agree in all ``bits`` with a chance of at most ``miss``."""
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return max(4, math.ceil(math.log(miss) / math.log1p(-met)))


def passes_for(largest: int, window: int, threshold: float, miss: float) -> int:
    """Passes if each bit halves the largest label, to runs of about half a window."""
    return passes_of(max(1.0, math.log2(max(2.0, largest / window)) + 1), threshold, miss)


def hashed(m: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """(rows, passes): the signs of ``bits`` projections each, as numbers."""
    return ((scaled(m) @ planes) > 0).reshape(len(m), -1, bits) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def bits_for(reps: DataFrame, window: int, threshold: float, miss: float, seed: int, sample: int = 1 << 15) -> int:
    """Bits with the least passes times comparisons, as about ``sample`` vectors show; a row's shuffle counts as ``window``."""
    rows = reps.count()
    part = reps.select("id", "grp", "dim", "vec").where(F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(1 << 20)) < F.lit(math.ceil(min(1.0, sample / max(1, rows)) * (1 << 20))))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [int(hashed(matrix([v.as_py()]), np.random.default_rng([seed, d]).standard_normal((d, BITS)), BITS)[0, 0]) for d, v in zip(batch.column(2).to_pylist(), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(keys, pa.int64())], names=["grp", "dim", "key"])

    got = part.mapInArrow(keyed, "grp long, dim int, key long").toArrow()
    if not got.num_rows:
        return 1
    grp, dim, key = (c.to_numpy() for c in got.columns)
    label = np.unique(np.stack([grp, dim.astype(np.int64)]), axis=1, return_inverse=True)[1].reshape(-1)
    cost = {}
    for bits in range(1, 41):
        one, n = np.unique(np.stack([label, key >> (BITS - bits)]), axis=1, return_counts=True)
        met = float((n * (n - 1)).sum()) / len(key) * rows / len(key)  # comparisons a row
        cost[bits] = passes_of(bits, threshold, miss) * (window + met)
    return min(cost, key=cost.get)


def sorted_pass_edges(reps: DataFrame, bits: int, passes: int, window: int, threshold: float, seed: int) -> DataFrame:
    """Edges (u, v) between vectors (id, grp, dim, vec) with equal ``grp`` and ``dim`` that share all
    ``bits`` in a pass, or are within ``NEXT`` rows of one another in a task's part of its order; at
    most one for each row and block. Runs longer than ``window``, or that may
    go on in another task, are blocks that meet in pairs."""
    schema = "u long, v long, pass int, grp long, dim int, key long, ids binary, vecs binary"
    names = ["u", "v", "pass", "grp", "dim", "key", "ids", "vecs"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, grp, dim, vec = batch.columns
            for d in np.unique(dim.to_numpy()).tolist():
                at = pa.array(np.flatnonzero(dim.to_numpy() == d))
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, passes * bits))
                some = vec.take(at)
                keys = hashed(matrix(some.to_pylist()), planes[d], bits)
                for p in range(passes):
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, dtype=np.int32)), grp.take(at), pa.array(np.full(n, d, dtype=np.int32)), pa.array(np.ascontiguousarray(keys[:, p])), ids.take(at), some], names=["pass", "grp", "dim", "key", "id", "vec"])

    def unit(vecs: bytes | pa.Buffer, n: int) -> np.ndarray:
        m = scaled(np.frombuffer(vecs, dtype="<f8").reshape(n, -1))
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))

    def linked(own: np.ndarray, near: np.ndarray, right: int) -> tuple[np.ndarray, np.ndarray] | None:
        label = np.arange(len(own))
        i, j = np.nonzero(near)
        joined(label, i, j + right)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return (own[moved], own[label[moved]]) if len(moved) else None

    def beside(batches: Iterator[pa.RecordBatch], out: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same batches; ``out`` gets the edges between each row and the next ones, the last rows of a batch carried over."""
        now, ids, m = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            of, own, vec = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)]), batch.column(4).to_numpy(), batch.column(5)
            begin = np.frombuffer(vec.buffers()[1], dtype=np.int32)[vec.offset : vec.offset + len(vec) + 1]
            cuts = np.flatnonzero((np.diff(of) != 0).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
                some = unit(vec.buffers()[2][begin[a] : begin[b]], b - a)
                same = now == tuple(of[:, a])
                ids, m = (np.concatenate([ids, own[a:b]]), np.concatenate([m, some])) if same else (own[a:b], some)
                now, label = tuple(of[:, a]), np.arange(len(ids))
                for at in range(0, len(ids), NEXT):
                    i, j = np.nonzero(m[at : at + NEXT] @ m[at : at + 2 * NEXT].T >= threshold)
                    next_ = (j > i) & (j - i <= NEXT)
                    joined(label, at + i[next_], at + j[next_])
                moved = np.flatnonzero(label != np.arange(len(label)))
                if len(moved):
                    out.append(pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]]), *(pa.nulls(len(moved), k) for k in (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=names))
                ids, m = ids[-NEXT:], m[-NEXT:]
            yield batch

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.RecordBatch] = []
        batches = beside(batches, found)

        def blocks(key: tuple, ids: np.ndarray, vecs: list[bytes], edge: bool) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(ids), window):
                own, raw = ids[at : at + window], b"".join(vecs[at : at + window])
                if len(own) > 1:
                    m = unit(raw, len(own))
                    if (out := linked(own, np.triu(m @ m.T >= threshold, 1), 0)) is not None:
                        n = len(out[0])
                        yield pa.RecordBatch.from_arrays([*map(pa.array, out), *(pa.nulls(n, k) for k in (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=names)
                if edge or len(ids) > window:
                    none = pa.nulls(1, pa.int64())
                    held = [pa.array([int(x)], k) for x, k in zip(key, (pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([none, none, *held, pa.array([own.astype("<i8").tobytes()], pa.binary()), pa.array([raw], pa.binary())], names=names)

        def cut() -> Iterator[tuple[tuple, np.ndarray, list[bytes]]]:
            """Runs in order; those of one row only at a task's ends."""
            now, ids, vecs = None, [], []
            for batch in batches:
                if not batch.num_rows:
                    continue
                key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
                own, vec = batch.column(4).to_numpy(), batch.column(5)
                at = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1, [len(own)]])
                last = len(at) - 2
                for k in sorted({0, last, *np.flatnonzero(np.diff(at) > 1).tolist()}):
                    a, b = at[k], at[k + 1]
                    if now is not None and tuple(key[:, a]) != now:
                        yield now, np.concatenate(ids), vecs
                        ids, vecs = [], []
                    now = tuple(key[:, a])
                    ids.append(own[a:b])
                    vecs += vec.slice(a, b - a).to_pylist()
            if now is not None:
                yield now, np.concatenate(ids), vecs

        before, first = None, True
        for run in cut():
            if before is not None:
                yield from blocks(*before, first)
                first = False
            before = run
            yield from found
            found.clear()
        if before is not None:
            yield from blocks(*before, True)
        yield from found

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other, blocks in zip(*batch.columns, strict=True):
                one, other, sides = one.as_py(), other.as_py(), ([], [])
                for x in blocks.as_py():
                    sides[x["part"] != one].append(x)
                if len(blocks) < 2 or (one != other and not all(sides)):
                    continue
                ids = [np.frombuffer(b"".join(x["ids"] for x in side), dtype="<i8") for side in sides]
                m = [unit(b"".join(x["vecs"] for x in side), len(i)) if side else None for side, i in zip(sides, ids, strict=True)]
                near = np.triu(m[0] @ m[0].T >= threshold, 1) if one == other else m[0] @ m[1].T >= threshold
                if (out := linked(np.concatenate(ids), near, 0 if one == other else len(ids[0]))) is not None:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, out)], names=["u", "v"])

    order = ["pass", "grp", "dim", "key", "id"]
    rows = reps.select("id", "grp", "dim", "vec").mapInArrow(keyed, "pass int, grp long, dim int, key long, id long, vec binary")
    found = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs, schema)
    found = written(found.withColumn("node", F.monotonically_increasing_id()))
    blocks = found.where("ids is not null").drop("u", "v")
    cross = in_cells(blocks, order[:4], 8, "node", F.struct("part", "ids", "vecs")).mapInArrow(across, "u long, v long")
    edges = written(found.where("ids is null").select("u", "v").union(cross))
    discard(found)
    return edges


def link_counts(members: DataFrame, threshold: float, part: int = 1024) -> DataFrame:
    """(id, links): for each of ``members`` (component, id, n, vec), how many rows the vectors of its
    component at the threshold or above stand for, itself left out. Parts of a component meet in
    cells; only counts leave a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(z: list[dict]) -> tuple[list[int], np.ndarray, np.ndarray]:
            m = scaled(matrix([r["vec"] for r in z]))
            return [r["id"] for r in z], np.array([r["n"] for r in z], dtype=np.int64), m / np.sqrt((m * m).sum(axis=1, keepdims=True))

        for batch in batches:
            for one, other, x in zip(*batch.columns, strict=True):
                one, other, sides = one.as_py(), other.as_py(), ([], [])
                for r in x.as_py():
                    sides[r["part"] != one].append(r)
                if one != other and not all(sides):
                    continue
                ids, n, m = side(sides[0])
                if one != other:
                    more, k, w = side(sides[1])
                    near = m @ w.T >= threshold
                    ids, links = ids + more, np.concatenate([near @ k, n @ near])
                else:
                    near = m @ m.T >= threshold
                    np.fill_diagonal(near, False)
                    links = near @ n
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links)], names=["id", "links"])

    cells = in_cells(members, ["component"], part, "id", F.struct("part", "id", "n", "vec"))
    return cells.mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def embedding_duplicates(df: DataFrame, threshold: float = 0.98, window: int = 128, miss: float = 1e-4, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link if their labels are equal and not null, their vectors have one length, and their
    cosine in double precision is at least ``threshold``. A row with a null id or label, or with
    a null, empty or zero vector or one with null or non-finite components, links with nothing
    and is kept. Equal vectors of one label are one member that counts for all its rows, so a
    large group of copies is neither compared nor listed in pairs. Repeated ids are rows of
    their own, each linked with the others of its vector; a component has its smallest id's name.
    Other columns are not read. An empty table gives no rows.
    """
    named = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"), F.col(label_col).cast("long").alias("label"))
    copy = F.md5(F.concat_ws("|", F.col("grp"), F.col("dim"), F.hex("vec")))
    rows = written(usable(named.where("label is not null"), more=("label",)).withColumnRenamed("id", "vec_id").withColumnRenamed("label", "grp").withColumn("copy", copy))
    reps = rows.groupBy("copy").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("grp").alias("grp"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    reps = written(reps.withColumn("id", F.monotonically_increasing_id()))
    bits = bits_for(reps, window, threshold, miss, seed)
    edges = sorted_pass_edges(reps, bits, passes_of(bits, threshold, miss), window, threshold, seed)
    members = written(reps.join(components(edges).withColumnRenamed("node", "id"), "id").select("component", "id", "least", "n", "vec"))
    names = members.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    of = by_group(members.select("id", "component"), names, ["component"]).select("id", "component_id")
    found = reps.select("copy", "id", "n", "least").join(link_counts(members, threshold), "id", "left").join(of, "id", "left")
    found = written(found.select("copy", F.col("n").alias("_n"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    discard(reps, edges, members)
    linked = by_group(rows.select("vec_id", "copy"), found, ["copy"]).select("vec_id", "n_links", "component_id")
    whole = F.expr("vec_id is not null and label is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    alone = named.withColumn("v", F.col("embedding").cast("array<double>")).where(~F.coalesce(whole, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(u, w) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.u, links.w FROM reach JOIN links ON reach.w = links.u),
comp AS (SELECT u, MIN(w) AS component_id FROM reach GROUP BY u),
deg AS (SELECT u, COUNT(*) AS n_links FROM links GROUP BY u)
SELECT e.vec_id, CAST(COALESCE(deg.n_links, 0) AS BIGINT) AS n_links, comp.component_id, e.vec_id = comp.component_id AS kept
FROM embeddings e JOIN comp ON comp.u = e.vec_id LEFT JOIN deg ON deg.u = e.vec_id
"""
