"""Packing along a space-filling curve.

Each document's hashed id counts are projected to a few dimensions by fixed random signs; the
direction, on a grid, gives a Hilbert key. Documents are range-sorted by that key, and each
range is cut into full sequences in curve order, so that a sequence holds alike documents. What
a range has left over is cut into sequences whose lengths are powers of two: nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, written
from .encoding import encoder, tokenizer_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
DIMS, BITS, HASHED = 4, 12, 65_536
#: Bytes of ids that a task sorts and packs.
RANGE = 64 << 20


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Each row's place on the Hilbert curve through the grid of ``2**bits`` cells a side."""
    x = grid.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections, from the coarsest cell to the finest
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents, none of them empty."""
    at = np.cumsum([0, *(len(x) for x in ids[:-1])])
    v = np.add.reduceat(signs[np.concatenate(ids) % HASHED], at, axis=0)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    unit = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    return hilbert_keys(np.clip(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)


def pack(docs: DataFrame, tokenizer: str, cut: str | None = None, end_id: int = 0, length: int = 1024, seed: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` ids (a power of two).

    A null text is empty: its only id is ``end_id``. A very long one is encoded whole and cut. Null and repeated ids are documents of
    their own. Documents with one key (copies) are told apart by their id and row, so that a
    large group of copies spreads over ranges. Other columns are not read; an empty table gives
    no pieces. ``sequence_id`` has the range in its upper bits and counts from 0 within it.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, cut)
        signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (HASHED, DIMS))
        end = np.array([end_id], dtype="<u4").tobytes()

        def out(doc_ids: list, raw: list[bytes]) -> pa.RecordBatch:
            keys = curve_keys([np.frombuffer(x, dtype="<u4") for x in raw], signs)
            ids = [short(x) for x in raw]
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(map(len, ids), pa.int64(), size=len(ids)), pa.array(ids, pa.binary())], names=["doc_id", "key", "bytes", "ids"])

        for batch in batches:
            doc_ids, raw, size = [], [], 0
            for doc_id, x in zip(batch.column(0).to_pylist(), enc.ids(batch.column(1).to_pylist()), strict=True):
                doc_ids.append(doc_id)
                raw.append(x + end)
                size += len(x)
                if size > 4_000_000:
                    yield out(doc_ids, raw)
                    doc_ids, raw, size = [], [], 0
            if raw:
                yield out(doc_ids, raw)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, held, room = TaskContext.get().partitionId() << 32, [], length
        rows: list[tuple] = []

        def put(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, total in pieces:
                raw = ids.tobytes()
                rows.append((doc_id, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw))
                offset += len(ids)
            sequence += 1

        def batch_out() -> pa.RecordBatch:
            nonlocal rows
            some, rows = rows, []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i == 7 else pa.int64()) for i, x in enumerate(zip(*some, strict=True))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = long(raw)
                at = 0
                while at < len(ids):
                    part = ids[at : at + room]
                    held.append((doc_id, at, part, len(ids)))
                    at, room = at + len(part), room - len(part)
                    if room == 0:
                        put(held)
                        held, room = [], length
                    if len(rows) >= 5_000:
                        yield batch_out()
        left = length - room
        for power in (1 << b for b in range(length.bit_length() - 1, -1, -1) if left & (1 << b)):
            some, room = [], power
            while room:
                doc_id, start, part, total = held.pop(0)
                if len(part) > room:
                    held.insert(0, (doc_id, start + room, part[room:], total))
                    part = part[:room]
                some.append((doc_id, start, part, total))
                room -= len(part)
            put(some)
        if rows:
            yield batch_out()

    ship(docs.sparkSession)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, key long, bytes long, ids binary")
    keyed = written(keyed.withColumn("row", F.monotonically_increasing_id()))
    order = ["key", "doc_id", "row"]
    # ranges of about RANGE bytes, where the usual number of partitions would make them larger
    ranges = -(-(keyed.agg(F.sum("bytes")).first()[0] or 0) // RANGE)
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(ranges, *order) if ranges > usual else keyed.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(fill, PIECES)


def short(raw: bytes) -> bytes:
    """Ids in 16 bits each, where all fit; the first byte tells."""
    ids = np.frombuffer(raw, dtype="<u4")
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 65_536 else b"\4" + raw


def long(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype("<u4")


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), cut="ranks").drop("ids")
