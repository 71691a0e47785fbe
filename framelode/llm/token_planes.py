"""Token ids as a binary table of bit- or byte-plane blocks.

Ids of consecutive documents are cut into blocks of a fixed number of ids. A block is
transposed (all first bytes or bits, then all second ones, ...), each plane is compressed by
zstandard, and a plane of zeros is left out. A row of the table is a chunk: where it stands
(``shard``, ``chunk``, ``first`` id within the shard, ``n_ids``), the plane sizes, the planes,
and the documents that start in it. Spark's own writer commits the files, so that a lost or
repeated task leaves no half-written shard, on any file system that Spark knows.
"""

from __future__ import annotations

import math
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .encoding import encoder, tokenizer_path

CHUNKS = "shard int, chunk int, first long, n_ids int, planes string, sizes array<int>, payload binary, docs array<struct<doc_id:long,start:long,n_tokens:long>>"
DOCS = "doc_id long, shard int, start long, n_tokens long, ids binary"
_DOC = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def to_planes(ids: np.ndarray, planes: str = "byte", level: int = 3) -> tuple[list[int], bytes]:
    """The compressed size of each plane (0: all zero) and the compressed planes in a row."""
    import zstandard

    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    if planes == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=0, bitorder="little").reshape(32, -1), axis=1)
    squeeze = zstandard.ZstdCompressor(level=level)
    parts = [squeeze.compress(np.ascontiguousarray(r).tobytes()) if r.any() else b"" for r in rows]
    return [len(p) for p in parts], b"".join(parts)


def from_planes(n_ids: int, planes: str, sizes: list[int], payload: bytes) -> np.ndarray:
    import zstandard

    expand, parts, at = zstandard.ZstdDecompressor(), [], 0
    width = n_ids if planes == "byte" else (n_ids + 7) // 8
    for size in sizes:
        raw = expand.decompress(payload[at : at + size]) if size else bytes(width)
        parts.append(np.frombuffer(raw, dtype=np.uint8))
        at += size
    rows = np.stack(parts)
    if planes == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n_ids).reshape(4, 8, n_ids), axis=1, bitorder="little").reshape(4, n_ids)
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


def write_token_planes(docs: DataFrame, path: str, tokenizer: str, cut: str | None = None, end_id: int | None = None, block: int = 65_536, planes: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write the ids in ascending ``id_col`` order.

    A null text is empty and has only ``end_id``; a very long one is encoded whole. Null ids come first; rows with the same id
    follow one another in text order. Other columns, whatever their names, are not read. An
    empty table gives a table without rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc = TaskContext.get().partitionId(), encoder(tokenizer, cut)
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        held, waiting, docs_here, total, chunk, first = [], 0, [], 0, 0, 0

        def out(n: int) -> pa.RecordBatch:
            nonlocal held, waiting, docs_here, chunk, first
            raw = b"".join(held)
            sizes, payload = to_planes(np.frombuffer(raw[: 4 * n], dtype="<u4"), planes)
            # a document belongs to the chunk that has its first id
            here = [d for d in docs_here if d["start"] < first + n or n < block]
            row = [[shard], [chunk], [first], [n], [planes], pa.array([sizes], pa.list_(pa.int32())), [payload], pa.array([here], pa.list_(_DOC))]
            docs_here = docs_here[len(here) :]
            held, waiting, chunk, first = [raw[4 * n :]], waiting - n, chunk + 1, first + n
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), None, pa.binary(), None)
            return pa.RecordBatch.from_arrays([x if k is None else pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["shard", "chunk", "first", "n_ids", "planes", "sizes", "payload", "docs"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for doc_id, ids in zip(doc_ids, enc.ids(batch.column(1).to_pylist()), strict=True):
                n = (len(ids) + len(end)) // 4
                docs_here.append({"doc_id": doc_id, "start": total, "n_tokens": n})
                held += (ids, end)
                waiting, total = waiting + n, total + n
                while waiting >= block:
                    yield out(block)
        if waiting or docs_here:
            yield out(waiting)

    ordered = in_ranges(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    ordered.mapInArrow(encode, CHUNKS).write.option("compression", "none").parquet(path)


def in_ranges(docs: DataFrame, rows_per_range: int = 1000) -> DataFrame:
    """``docs`` (doc_id, text) in ranges of ids, each sorted by (id, text). Boundaries are quantiles of the ids, so that
    texts are read once; there are at most as many ranges as the session has shuffle partitions. An id
    that several ranges would begin with is dealt to these by the hash of the text."""
    n = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // rows_per_range)))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    if not bounds:
        return docs.coalesce(1).sortWithinPartitions("doc_id", "text")
    step = math.isqrt(len(bounds)) + 1  # rows look for their range among every so many bounds, and then among those that follow
    coarse, fine = bounds[step - 1 :: step], [bounds[k : k + step] for k in range(0, len(bounds), step)]

    def below(fits: Callable[[Column], Column]) -> Column:
        at = F.size(F.filter(F.array(*map(F.lit, coarse)), fits)) if coarse else F.lit(0)
        of = F.coalesce(F.get(F.array(*(F.array(*map(F.lit, f)) for f in fine)), at), F.array().cast("array<bigint>"))
        return at * step + F.size(F.filter(of, fits))

    low, high = below(lambda x: x < F.col("doc_id")), below(lambda x: x <= F.col("doc_id"))
    part = F.when(F.col("doc_id").isNull(), 0).when(low < high, low + F.pmod(F.xxhash64("text"), (high - low + 1).cast("long")).cast("int")).otherwise(high)
    return docs.repartitionById(n, part).sortWithinPartitions("doc_id", "text")


def read_token_planes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, start, n_tokens, ids): ``start`` counts all ids before the document.

    A shard's chunks are read in order by one task, as many shards as there are tasks at once;
    only a count for each shard goes to the driver.
    """
    chunks = spark.read.schema(CHUNKS).parquet(path)
    starts, total = {}, 0
    for shard, n in sorted(tuple(r) for r in chunks.groupBy("shard").agg(F.sum("n_ids")).collect()):
        starts[shard], total = total, total + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, raw, base, docs = None, bytearray(), 0, deque()
        for batch in batches:
            rows = []
            for c in batch.to_pylist():
                if c["shard"] != shard:
                    if docs:
                        raise ValueError(f"shard {shard} ends within a document")
                    shard, raw, base = c["shard"], bytearray(), 0
                if c["first"] != base + len(raw) // 4:
                    raise ValueError(f"shard {shard}: chunk {c['chunk']} doesn't follow the one before")
                raw += from_planes(c["n_ids"], c["planes"], c["sizes"], c["payload"]).tobytes()
                docs.extend(c["docs"])
                at = 0
                while docs and docs[0]["start"] + docs[0]["n_tokens"] <= base + len(raw) // 4:
                    d = docs.popleft()
                    at = 4 * (d["start"] - base)
                    end = at + 4 * d["n_tokens"]
                    rows.append((d["doc_id"], shard, starts[shard] + d["start"], d["n_tokens"], bytes(raw[at:end])))
                    at = end
                del raw[:at]
                base += at // 4
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "shard", "start", "n_tokens", "ids"])
        if docs:
            raise ValueError(f"shard {shard} ends within a document")

    return chunks.repartition("shard").sortWithinPartitions("shard", "chunk").mapInArrow(decode, DOCS)


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the written table, read back from it."""
    path = f"{shared_dir(spark)}/planes-{uuid.uuid4().hex}"
    write_token_planes(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), cut="words", end_id=1)
    return read_token_planes(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "shard")
