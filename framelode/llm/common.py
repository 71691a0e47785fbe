"""What the operators of this subpackage share: reading, cutting lineage, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping
from ..operators.joins import by_group

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Let the executors import this package, wherever the driver has it from.

    Unless the session says otherwise, tasks get whole texts in batches of 1,000 rows: with the
    usual 10,000, a batch of long ones takes much of a worker's memory."""
    if spark.sparkContext.getConf().get(_BATCH) is None:
        spark.conf.set(_BATCH, "1000")
    shipping.ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own where it is unset (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[id(again)] = again, path
    return again


_written: dict[int, tuple[DataFrame, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`written` wrote, once all that was made of it is written itself or on the driver."""
    for df in tables:
        _, path = _written.pop(id(df))
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def kept_by(docs: DataFrame, text_col: str, scored: Callable[[DataFrame, str], DataFrame], good: Callable[[Column], Column]) -> DataFrame:
    """The rows of ``docs`` whose score is ``good``, with the columns of ``docs``. ``scored`` gets them
    with the text once more as the last column, and a name that no column has for the score instead of it."""
    taken = {c.lower() for c in docs.columns}
    text, score = (next(n for n in (f"_{kind}{i}" for i in range(len(taken) + 1)) if n not in taken) for kind in ("text", "score"))
    others = [F.col(f"`{c}`") for c in docs.columns]
    wide = scored(docs.select(*others, F.col(text_col).alias(text)), score)
    return wide.where(good(F.col(score))).select(*others)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def in_cells(rows: DataFrame, keys: list[str], size: int, by: str, kept: Column, weight: str | None = None) -> DataFrame:
    """(one, other, x): each key's rows are dealt to parts of about ``size`` rows (or of that much ``weight``) by
    the hash of ``by``, and each two parts, and each part with itself, meet in a cell. Keys with a
    single row are left out; ``kept`` is what a row brings, its ``part`` among it."""
    parts = rows.groupBy(*keys).agg(F.count("*").alias("_n"), (F.count("*") if weight is None else F.sum(weight)).alias("all"))
    parts = parts.where("_n > 1").withColumn("parts", F.least("_n", F.greatest(F.lit(1), F.ceil(F.col("all") / size)))).drop("all")
    dealt = by_group(rows, parts, keys).withColumn("part", F.pmod(F.xxhash64(by), "parts")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = dealt.groupBy(*keys, F.least("part", "with").alias("one"), F.greatest("part", "with").alias("other"))
    return cells.agg(F.collect_list(kept).alias("x")).select("one", "other", "x")


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the sets of ``i`` and ``j``: labels become the least index of each set."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (deeper := label[label] != label).any():
            label[deeper] = label[label[deeper]]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) by the edges (u, v) of one task, at most ``EDGES`` of them."""
    edges = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not edges:
        return
    u, v = (np.concatenate(x) for x in zip(*edges, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(nodes))
    joined(label, at[: len(u)], at[len(u) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


#: Edges in a partition between the steps of :func:`components`.
EDGES = 100_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): the smallest node reachable.

    At most ``EDGES`` edges, which one partition holds, are joined in its task: rounds would cost
    the driver dozens of plans and thousands of tasks. More of them go through alternating
    large-star and small-star steps. Each step is a grouped minimum (combined before the shuffle)
    joined back, the few nodes with very many edges by broadcast, so that no node's edges are one
    task's. Between steps, edges lie in as few partitions as their number needs. Self-loops and
    repeated edges are harmless; nodes without an edge don't appear; an empty table gives an
    empty table.
    """

    def kept(df: DataFrame) -> DataFrame:
        return checkpointed(df.coalesce(max(1, -(-rows // EDGES))))

    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct()
    e = checkpointed(e)
    before, rows = None, e.count()
    if rows <= EDGES:
        ship(e.sparkSession)
        return e.coalesce(1).mapInArrow(_linked, "node long, component long")
    e = e.coalesce(-(-rows // EDGES))
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n"))
        large = by_group(both.where("v > u"), least, ["u"], 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = kept(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = by_group(down, least, ["u"], 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = kept(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1000003)))).first()
        if now == before:
            break
        before, rows = now, now[0]
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.union(roots.join(stars.select("node"), "node", "left_anti"))
