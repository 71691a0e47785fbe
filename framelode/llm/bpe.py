"""Byte-level BPE by overlapping chunks, and back.

A text longer than a chunk is cut into chunks of ``chunk`` characters that overlap the next one.
Tasks pre-tokenise the chunks apart from each other. Where two neighbours' pre-token boundaries
coincide within their overlap (after a visible character), they agree on everything that
follows, so the text is cut there and the pieces between such cuts are encoded in parallel. A
text with a joint that never falls in step is encoded in one piece. Decoding concatenates the
ids' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table
from .encoding import tokenizer_path

CHUNK, OVERLAP = 32_768, 512
#: A match that ends this close to a chunk's end may depend on what follows the chunk.
AHEAD = 4
_encodings: dict = {}


def encoding(path: str, pattern: str):
    """The rank file at ``path``; one for each worker process."""
    if (path, pattern) not in _encodings:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        words = {i: b for b, i in ranks.items()}
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), words, regex.compile(pattern)
    return _encodings[path, pattern]


def boundaries(matcher, text: str, low: int, high: int) -> list[int]:
    """Ends of matches within [low, high] that no later text can move and that follow a visible character."""
    sure = len(text) - AHEAD
    return [e for m in matcher.finditer(text) if low <= (e := m.end()) <= high and e <= sure and not text[e - 1].isspace()]


def cut_text(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, chunk with its overlap); one for an empty text."""
    return [(s, text[s : s + chunk + overlap]) for s in range(0, max(1, len(text)), chunk)]


def _parts(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The pieces of texts up to ``chunk`` characters, one each; those of longer texts."""
    one_piece = "row long, doc_id long, piece int, n_pieces int, n_tokens long, ids string, decoded binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, words, _ = encoding(ranks, pattern)
        for batch in batches:
            row, doc_id, piece, n, text = (c.to_pylist() for c in batch.columns)
            for a in range(0, len(row), 500):
                ids = [enc.encode_ordinary(t or "") for t in text[a : a + 500]]
                b = a + 500
                yield pa.RecordBatch.from_arrays([pa.array(row[a:b], pa.int64()), pa.array(doc_id[a:b], pa.int64()), pa.array(piece[a:b], pa.int32()), pa.array(n[a:b], pa.int32()), pa.array(map(len, ids), pa.int64(), size=len(ids)), pa.array([",".join(map(str, x)) for x in ids], pa.string()), pa.array([b"".join(map(words.__getitem__, x)) for x in ids], pa.binary())], names=["row", "doc_id", "piece", "n_pieces", "n_tokens", "ids", "decoded"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cut = cut_text(t, chunk, overlap)
                n = len(cut)
                yield pa.RecordBatch.from_arrays([pa.array([r] * n, pa.int64()), pa.array([d] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array([x for _, x in cut], pa.large_string()).cast(pa.string())], names=["row", "doc_id", "piece", "n_pieces", "text"])

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, matcher = encoding(ranks, pattern)
        for batch in batches:
            _, _, piece, n, text = (c.to_pylist() for c in batch.columns)
            head = [boundaries(matcher, t[: overlap + 64], 1, overlap) if p else [] for p, t in zip(piece, text, strict=True)]
            tail = [[e - chunk for e in boundaries(matcher, t, chunk + 1, chunk + overlap)] if p < m - 1 else [] for p, m, t in zip(piece, n, text, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], names=["row", "doc_id", "piece", "n_pieces", "text", "head", "tail"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk
    brief = rows.where(~is_long).select("row", "doc_id", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), "text")
    cut = rows.where(is_long).mapInArrow(chunks, "row long, doc_id long, piece int, n_pieces int, text string").repartition("row", "piece")
    cut = cut.mapInArrow(pre_tokenise, "row long, doc_id long, piece int, n_pieces int, text string, head array<int>, tail array<int>")
    by = W.partitionBy("row").orderBy("piece")
    met = F.array_min(F.array_intersect(F.lag("tail").over(by), "head"))
    cut = cut.withColumn("begin", F.when(F.col("piece") == 0, 0).otherwise(met))
    cut = cut.withColumn("end", F.lead("begin").over(by)).withColumn("apart", F.max(F.col("begin").isNull()).over(W.partitionBy("row")))
    chars = F.when(F.col("piece") == F.col("n_pieces") - 1, F.length("text")).otherwise(F.lit(chunk) + F.col("end")) - F.col("begin")
    in_step = cut.where("not apart").select("row", "doc_id", "piece", "n_pieces", F.substring("text", F.col("begin") + 1, chars).alias("text"))
    whole = cut.where("apart").groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", F.substring("text", 1, chunk).alias("text")))).alias("all"))
    whole = whole.select("row", "doc_id", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.array_join("all.text", "").alias("text"))
    spread = in_step.union(whole).repartition("row", "piece")
    return brief.mapInArrow(encode, one_piece), spread.mapInArrow(encode, one_piece)


def encoded(docs: DataFrame, ranks: str, pattern: str, **options) -> DataFrame:
    """(row, doc_id, piece, n_pieces, n_tokens, ids, decoded): the ids of each document's pieces, comma-joined, and their bytes.

    A null text is empty: one piece without ids. Null and repeated ``id_col`` values are
    documents of their own, told apart by ``row``. Other columns are not read. An empty table
    gives no pieces.
    """
    brief, spread = _parts(docs, ranks, pattern, **options)
    return brief.union(spread)


def digests(docs: DataFrame, ranks: str, pattern: str, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_pieces) of each document; only long texts are shuffled.

    A null text is empty: no ids, and the digests of nothing. A very long one is encoded whole, in
    pieces. Null and repeated ids are documents of their own; other columns, whatever their names,
    are not read; an empty table gives no rows."""
    brief, spread = _parts(docs, ranks, pattern, **options)
    one = brief.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_pieces")
    many = spread.groupBy("row", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("piece", "ids", "decoded"))).alias("all"), F.max("n_pieces").alias("n_pieces"))
    text = F.array_join(F.filter("all.ids", lambda x: x != ""), ",")
    raw = F.aggregate("all", F.lit(b""), lambda acc, x: F.concat(acc, x["decoded"]))
    return one.union(many.select("doc_id", "n_tokens", F.sha2(text, 256), F.sha2(raw, 256), "n_pieces"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
