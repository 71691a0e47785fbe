"""SimHash near-duplicates by a Gray-order hierarchical index.

Any two fingerprints within ``max_bits`` of each other agree on some whole blocks of bits. For
each choice of blocks (a table), the bits are permuted so that those blocks lead, and
fingerprints are range-sorted by the Gray rank of the permuted bits. Runs that share the leading
blocks become nodes; a node factors the bits that all its members share into a mask and a
pattern, and so do the nodes above it. Two nodes whose patterns differ in more than ``max_bits``
shared bits are pruned with all that is below them; differences accumulate on the way down.
Nothing within ``max_bits`` is lost, whatever the size of a run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_group, components, discard, in_cells, joined, ship, table, written

#: Fingerprints in the largest run that one task compares at once; longer runs are several nodes.
RUN = 2048
FAN = 16
#: Minima in a band of ``near_duplicates``.
ROWS = 5
#: Shingles that are compared at once in it, with one text and with one another.
PART, CELL = 1 << 14, 1 << 17
_TOP = np.uint64(1 << 63)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of characters but space and U+0009 to U+000D, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``n`` words, repeats included; of all words, if fewer; none without words."""
    import xxhash

    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, size = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    first = (end - size)[: max(1, len(words) - n + 1)].tolist()
    last = end[min(n, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(first, last, strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """Each bit is 1 if it is set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 32_768):
        ones += np.unpackbits(hashes[at : at + 32_768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_key): the fingerprint as a signed long; a hash of the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            fps, keys = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                fps.append(fingerprint(shingle_hashes(words, shingle_words)))
                keys.append(xxhash.xxh128_digest(b" ".join(words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.binary())], names=["doc_id", "fp", "text_key"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long, text_key binary")


def block_tables(max_bits: int) -> tuple[list[np.ndarray], int]:
    """Permutations of the 64 bits, leading bits first, and the least number of bits that lead.

    One whole block of ``max_bits + 1`` stays equal, or two of ``max_bits + 2``: the fewest
    tables whose leading bits are 12 or more.
    """
    lead = 1 if max_bits < 5 else 2
    edges = np.linspace(0, 64, max_bits + lead + 1).round().astype(int)
    blocks = [np.arange(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    orders = []
    for chosen in combinations(range(len(blocks)), lead):
        rest = [i for i in range(len(blocks)) if i not in chosen]
        orders.append(np.concatenate([blocks[i] for i in (*chosen, *rest)]))
    return orders, [int(sum(len(blocks[i]) for i in chosen)) for chosen in combinations(range(len(blocks)), lead)]


def permuted(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The bit that ``order`` names first becomes the highest one."""
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits[:, order[::-1]], axis=1, bitorder="little")).view("<u8").reshape(-1)


def restored(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.empty_like(bits)
    out[:, order[::-1]] = bits
    return np.ascontiguousarray(np.packbits(out, axis=1, bitorder="little")).view("<u8").reshape(-1)


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in Gray order; its leading bits depend on leading bits alone."""
    b = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        b ^= b >> np.uint64(s)
    return b


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


def index_levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(masks, patterns) from the codes themselves up to at most ``FAN`` nodes."""
    levels = [(np.full(len(codes), ~np.uint64(0)), codes)]
    while len(levels[-1][1]) > FAN:
        masks, patterns = levels[-1]
        at = np.arange(0, len(patterns), FAN)
        odd = np.bitwise_or.reduceat(patterns ^ np.repeat(patterns[at], FAN)[: len(patterns)], at)
        shared = np.bitwise_and.reduceat(masks, at) & ~odd
        levels.append((shared, patterns[at] & shared))
    return levels


def within(a: np.ndarray, b: np.ndarray | None, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes at most ``max_bits`` apart: i < j within ``a``, or of ``a`` and ``b``."""
    la = index_levels(a)
    lb = la if b is None else index_levels(b)
    while len(lb) < len(la):
        lb.append(lb[-1])
    while len(la) < len(lb):
        la.append(la[-1])

    def down(level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (ma, pa_), (mb, pb) = la[level], lb[level]
        near = np.bitwise_count((pa_[i] ^ pb[j]) & ma[i] & mb[j]) <= max_bits
        i, j = i[near], j[near]
        if level == 0:
            if b is None:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            return
        na, nb = len(la[level - 1][1]), len(lb[level - 1][1])
        fa, fb = (FAN if na > len(pa_) else 1), (FAN if nb > len(pb) else 1)
        for at in range(0, len(i), 4096):
            x = (i[at : at + 4096, None] * fa + np.arange(fa)).repeat(fb, axis=1).reshape(-1)
            y = np.tile(j[at : at + 4096, None] * fb + np.arange(fb), (1, fa)).reshape(-1)
            real = (x < na) & (y < nb)
            if b is None:
                real &= x <= y
            yield from down(level - 1, x[real], y[real])

    top = len(la) - 1
    i, j = np.meshgrid(np.arange(len(la[top][1])), np.arange(len(lb[top][1])), indexing="ij")
    i, j = i.reshape(-1), j.reshape(-1)
    if b is None:
        i, j = i[i <= j], j[i <= j]
    yield from down(top, i, j)


def near_fingerprints(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints of ``fps`` (fp, distinct) that chains of
    links of at most ``max_bits`` connect. A run of n alike fingerprints gives at most n edges
    a table, not all its pairs."""
    orders, leads = block_tables(max_bits)

    def rank_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, order in enumerate(orders):
                rank = (gray_rank(permuted(x, order)) ^ _TOP).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(rank)], names=["tbl", "rank"])

    def edges_out(t: int, codes: np.ndarray, label: np.ndarray) -> pa.RecordBatch | None:
        moved = np.flatnonzero(label != np.arange(len(label)))
        if not len(moved):
            return None
        u, v = (restored(codes[k], orders[t]).view(np.int64) for k in (moved, label[moved]))
        n = len(u)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(n, pa.int32()), none, none, none, none, pa.nulls(n, pa.binary())], names=["u", "v", "tbl", "lead", "node", "mask", "pattern", "codes"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges within each node; and the nodes of runs that are longer than a node or may go on in another task."""

        def node(t: int, lead: int, codes: np.ndarray, keep: bool) -> Iterator[pa.RecordBatch]:
            label = np.arange(len(codes))
            if len(codes) > 1:
                for i, j in within(codes, None, max_bits):
                    joined(label, i, j)
                if (out := edges_out(t, codes, label)) is not None:
                    yield out
            if keep:
                odd = np.bitwise_or.reduce(codes ^ codes[0])
                mask = np.array([~odd, codes[0] & ~odd, gray_rank(codes[:1])[0]], dtype=np.uint64).view(np.int64)
                one = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([one, one, pa.array([t], pa.int32()), pa.array([lead], pa.int64()), pa.array(mask[2:]), pa.array(mask[:1]), pa.array(mask[1:2]), pa.array([codes.astype("<u8").tobytes()], pa.binary())], names=["u", "v", "tbl", "lead", "node", "mask", "pattern", "codes"])

        def run(t: int, lead: int, ranks: np.ndarray, edge: bool) -> Iterator[pa.RecordBatch]:
            codes = gray_code(ranks)
            for at in range(0, len(codes), RUN):
                yield from node(t, lead, codes[at : at + RUN], edge or len(codes) > RUN)

        def cut() -> Iterator[tuple[int, int, np.ndarray]]:
            held: list[np.ndarray] = []
            key = None
            for batch in batches:
                tbl = batch.column(0).to_numpy()
                rank = batch.column(1).to_numpy().view(np.uint64) ^ _TOP
                lead = rank >> (np.uint64(64) - np.array(leads, dtype=np.uint64)[tbl])
                at = np.flatnonzero((np.diff(tbl) != 0) | (np.diff(lead) != 0)) + 1
                for a, b in zip([0, *at], [*at, len(tbl)], strict=True):
                    if b == a:
                        continue
                    now = (int(tbl[a]), int(lead[a]))
                    if key is not None and now != key:
                        yield *key, np.concatenate(held)
                        held = []
                    key = now
                    held.append(rank[a:b])
            if held:
                yield *key, np.concatenate(held)

        before, first = None, True
        for now in cut():
            if before is not None:
                yield from run(*before, first)
                first = False
            before = now
        if before is not None:
            yield from run(*before, True)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(z, dtype="<u8") for z in (x, y))
                label = np.arange(len(a) + len(b))
                for i, j in within(a, b, max_bits):
                    joined(label, i, j + len(a))
                if (out := edges_out(t, np.concatenate([a, b]), label)) is not None:
                    yield out.select(["u", "v"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of nodes of a cell whose shared bits differ in no more than ``max_bits``; all others are pruned here, whole."""
        for batch in batches:
            for one, other, x in zip(*batch.columns, strict=True):
                one, sides = one.as_py(), ([], [])
                for r in x.as_py():
                    sides[r["part"] != one].append(r)
                whole = one == other.as_py()
                a, b = sides[0], sides[0] if whole else sides[1]
                (na, ma, pa_), (nb, mb, pb) = (tuple(np.array([r[c] for r in z], dtype=np.int64) for c in ("nid", "mask", "pattern")) for z in (a, b))
                near = np.bitwise_count(((pa_[:, None] ^ pb) & ma[:, None] & mb).view(np.uint64)) <= max_bits
                i, j = np.nonzero(np.triu(near, 1) if whole else near)
                yield pa.RecordBatch.from_arrays([pa.array(na[i]), pa.array(nb[j])], names=["a", "b"])

    ranked = fps.select("fp").mapInArrow(rank_rows, "tbl int, rank long")
    found = ranked.repartitionByRange("tbl", "rank").sortWithinPartitions("tbl", "rank").mapInArrow(runs, "u long, v long, tbl int, lead long, node long, mask long, pattern long, codes binary")
    found = written(found.withColumn("nid", F.monotonically_increasing_id()))
    nodes = found.where("codes is not null")
    cells = in_cells(nodes.select("tbl", "lead", "nid", "mask", "pattern"), ["tbl", "lead"], 1024, "nid", F.struct("part", "nid", "mask", "pattern"))
    pairs = cells.mapInArrow(alike, "a long, b long")
    a = nodes.select("tbl", F.col("nid").alias("a"), F.col("codes").alias("x"))
    b = nodes.select(F.col("nid").alias("b"), F.col("codes").alias("y"))
    cross = pairs.join(a, "a").join(b, "b").select("tbl", "x", "y").mapInArrow(across, "u long, v long")
    edges = written(found.where("codes is null").select("u", "v").union(cross))
    discard(found)
    return edges


def simhash_components(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest id reachable over links of at most ``max_bits``.

    A null text is empty; a text without words has fingerprint zero and links like any other. A
    null id is never a component's name: such a row has its group's smallest id, or null. Rows
    with one fingerprint are one member, so groups of copies cost their first row. Other columns
    are not read; an empty table gives no rows.
    """
    rows = written(fingerprints(docs, shingle_words, id_col, text_col).select("doc_id", "fp"))
    members = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")))
    comps = components(near_fingerprints(members, max_bits)).withColumnRenamed("node", "fp")
    grouped = written(members.drop("_n").join(comps, "fp"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    of_fp = by_group(grouped.select("fp", "component"), least, ["component"]).select("fp", "component_id")
    of_fp = written(members.join(of_fp, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "_n"))
    discard(members, grouped)
    return by_group(rows, of_fp, ["fp"]).select("doc_id", "fp", "component_id")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    at = np.searchsorted(a, b)
    same = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0
    return same / (len(a) + len(b) - same)


def bands_for(min_similarity: float, miss: float) -> int:
    """Bands of ``ROWS`` minima so that sets at the similarity share none with a chance of at most ``miss``."""
    met = min_similarity**ROWS
    return max(1, math.ceil(math.log(miss) / math.log1p(-met))) if met < 1 else 1


def band_keys(shingles: np.ndarray, factors: np.ndarray) -> list[int]:
    """A signed long for each ``ROWS`` of ``factors``: a hash of the least products of the shingles with them; none without shingles."""
    import xxhash

    if not len(shingles):
        return []
    least = np.full(len(factors), ~np.uint64(0))
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * factors).min(axis=0), out=least)
    bands = least.astype("<u8").reshape(-1, ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(bands)], dtype=np.uint64).view(np.int64).tolist()


def similar(sets: list[np.ndarray], group: np.ndarray, least: float, rows_at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted sets of different groups with a Jaccard similarity of at least ``least``. Members that
    several sets have are counted in columns, some rows and columns at once, in bounded memory; pairs
    within the largest group aren't looked at."""
    n = np.array([len(x) for x in sets], dtype=np.float32)
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), n.astype(np.int64)), often[at] > 1
    owner, column = owner[shared], (np.cumsum(often > 1) - 1)[at[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    names, counts = np.unique(group, return_counts=True)
    others = np.flatnonzero(group != names[counts.argmax()])
    width = max(1, (1 << 22) // len(sets))
    for first in range(0, len(others), rows_at_once):
        rows = others[first : first + rows_at_once]
        both = np.zeros((len(rows), len(sets)), dtype=np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [low, low + width])
            some = np.zeros((len(sets), width), dtype=np.float32)
            some[owner[a:b], column[a:b] - low] = 1
            both += some[rows] @ some.T
        i, j = np.nonzero((both >= least * (n[rows, None] + n - both) - 1e-3) & (group[rows, None] != group))
        sure = both[i, j] >= least * (n[rows[i]].astype(float) + n[j] - both[i, j]) - 1e-6
        yield rows[i[sure]], j[sure]


def near_duplicates(docs: DataFrame, verify_words: int = 5, min_similarity: float = 0.8, miss: float = 1e-6, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, raw, component_id) of rows to remove: near copies of the row that has the smallest id of
    their group. ``raw`` is Spark's hash of the text, which tells rows of one id apart.

    Texts link if the sets of their ``verify_words``-word shingles have a Jaccard similarity of at
    least ``min_similarity``. Candidates share a bucket: a chain of fingerprints within
    ``max_bits`` in the Gray-order index, or a band of minima, of which a pair at
    ``min_similarity`` shares none with a chance of at most ``miss``, wherever the texts differ
    (fingerprints alone see few such pairs: they differ in 10 of 64 bits). Each text is first
    compared with the first one of each of its buckets. Texts of buckets that this leaves in
    several groups are then searched exactly: two sets at the similarity share a member among
    their rarest, so many as may be missing and one more; texts of different groups in a chain
    of such members are compared, in cells.

    Texts with the same words are one member; a null text has no words; a very long one is read
    whole. Rows with a null id are never removed; an empty table gives no rows.
    """
    factors = np.random.default_rng(3).integers(0, 1 << 64, ROWS * bands_for(min_similarity, miss), dtype=np.uint64) | np.uint64(1)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, bands, fps = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                hashes = shingle_hashes(words, verify_words)
                keys.append(xxhash.xxh128_digest(b" ".join(words)))
                fps.append(fingerprint(hashes))
                bands.append(band_keys(np.unique(hashes), factors))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "raw", "text_key", "fp", "bands"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, sets = [], []
            for text in batch.column(0):
                words = words_of(text.as_py())
                keys.append(xxhash.xxh128_digest(b" ".join(words)))
                sets.append(np.unique(shingle_hashes(words, verify_words)).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary()), pa.array([len(x) // 8 for x in sets], pa.int64())], names=["text_key", "shingles", "size"])

    def of_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pivot, own, others in zip(*batch.columns, strict=True):
                own, u = np.frombuffer(own.as_py(), dtype="<u8"), []
                for other in others.as_py():
                    x = np.frombuffer(other["shingles"], dtype="<u8")
                    if min(len(own), len(x)) >= min_similarity * max(len(own), len(x)) and jaccard(own, x) >= min_similarity:
                        u.append(other["node"])
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([pivot.as_py()] * len(u), pa.int64())], names=["u", "v"])

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, size, raw in zip(*batch.columns, strict=True):
                x = np.frombuffer(raw.as_py(), dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), node.as_py())), pa.array(np.full(len(x), size.as_py())), pa.array(x)], names=["node", "size", "member"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(2):
                x = x.as_py()
                nodes, group = (np.array([r[c] for r in x], dtype=np.int64) for c in ("node", "group"))
                if len(np.unique(group)) < 2:
                    continue
                label = np.arange(len(x))
                for i, j in similar([np.frombuffer(r["shingles"], dtype="<u8") for r in x], group, min_similarity):
                    joined(label, i, j)
                moved = np.flatnonzero(label != np.arange(len(x)))
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["u", "v"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("raw")).where("doc_id is not null")
    rows = written(named.mapInArrow(banded, "doc_id long, raw long, text_key binary, fp long, bands array<long>"))
    members = written(rows.groupBy("text_key").agg(F.min(F.struct("doc_id", "raw")).alias("row"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    fps = written(members.where("size(bands) > 0").select("fp").distinct())
    chains = components(near_fingerprints(fps, max_bits)).withColumnRenamed("node", "fp")
    by_fp = members.where("size(bands) > 0").select("node", "fp").join(chains, "fp", "left").select("node", F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("bucket"))
    keyed = members.select("node", F.explode("bands").alias("bucket")).union(by_fp)
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    held = written(keyed.join(shared, "bucket"))
    pairs = written(held.where("node <> pivot").select("pivot", "node").distinct())

    met = pairs.select("node").union(pairs.select("pivot")).distinct().join(members.select("node", "text_key", F.col("row.doc_id").alias("doc_id")), "node")
    met = written(met)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(met.select("doc_id"), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(shingled, "text_key binary, shingles binary, size long").dropDuplicates(["text_key"])
    sets = written(met.select("node", "text_key").join(sets, "text_key").select("node", "shingles", "size"))

    # each text with the first of each of its buckets; a first one's texts in parts of about PART shingles
    parts = pairs.join(sets.select("node", "size"), "node").groupBy("pivot").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / PART)).alias("parts"), F.count("*").alias("_n"))
    dealt = written(by_group(pairs, parts, ["pivot"]).select("pivot", "node", F.pmod(F.xxhash64("node"), "parts").alias("part")))
    own = dealt.select("pivot", "part").distinct().join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("own")), "pivot")
    others = dealt.join(sets, "node").groupBy("pivot", "part").agg(F.collect_list(F.struct("node", "shingles")).alias("others"))
    first = written(others.join(own, ["pivot", "part"]).select("pivot", "own", "others").mapInArrow(of_first, "u long, v long"))

    discard(fps, pairs, dealt)

    # texts of buckets of three or more that are in several groups still
    groups = written(met.select("node").join(components(first), "node", "left").select("node", F.coalesce("component", "node").alias("group")))
    apart = held.where("n > 2").join(groups, "node").groupBy("bucket").agg(F.min("group").alias("a"), F.max("group").alias("b"), F.count("*").alias("_n")).where("a <> b").select("bucket", "_n")
    rest = written(by_group(held.where("n > 2"), apart, ["bucket"]).select("node").distinct().join(groups, "node").join(sets, "node"))
    exploding = written(rest.select("node", "size", "shingles").mapInArrow(exploded, "node long, size long, member long"))
    often = exploding.groupBy("member").agg(F.count("*").alias("n")).where("n > 1")
    many = by_group(exploding, often.withColumn("_n", F.col("n")), ["member"]).groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "member"))).alias("all"))
    # members that only one text has come first in the order, and lead to no other text
    missing = F.col("size") - F.ceil(F.lit(min_similarity) * F.col("size") - 1e-6) + 1
    rare = F.slice("all", F.lit(1), F.greatest(F.lit(0), missing - (F.col("size") - F.size("all"))).cast("int"))
    sub = written(many.select("node", F.explode(rare).alias("x")).select("node", "x.member").join(groups, "node"))
    tested = sub.groupBy("member").agg(F.min("node").alias("least"), F.min("group").alias("a"), F.max("group").alias("b"), F.count("*").alias("_n")).where("a <> b").select("member", "least", "_n")
    discard(held, met, sets, exploding)
    clusters = components(by_group(sub, tested, ["member"]).select(F.col("node").alias("u"), F.col("least").alias("v")))
    near = written(rest.join(clusters, "node").withColumn("weight", F.col("size") + 64))  # short texts take room too
    cells = in_cells(near, ["component"], CELL, "node", F.struct("part", "node", "group", "shingles"), "weight")
    discard(groups, sub)
    links = written(first.union(cells.mapInArrow(compared, "u long, v long")))
    discard(near)

    member_of = written(members.join(components(links), "node", "left").select("text_key", "row", F.coalesce("component", "node").alias("group")))
    kept = member_of.groupBy("group").agg(F.min("row").alias("kept"), F.count("*").alias("_n"))
    copies = rows.groupBy("text_key").agg(F.count("*").alias("_n"))
    of_text = written(by_group(member_of, kept, ["group"]).select("text_key", "kept").join(copies, "text_key"))
    discard(members, first, rest, links, member_of)
    gone = by_group(rows.select("doc_id", "raw", "text_key"), of_text, ["text_key"]).where("doc_id <> kept.doc_id or raw <> kept.raw")
    return gone.select("doc_id", "raw", F.col("kept.doc_id").alias("component_id"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id; of repeated rows, one.

    Columns are as they were, whatever their names. Rows with a null id stay; a null or empty text
    is like any other without words; of an id with several texts, those that are no copies stay; an
    empty table stays empty."""
    ship(docs.sparkSession)
    key, text = (F.col(options.get(c, d)) for c, d in (("id_col", "doc_id"), ("text_col", "text")))
    taken = {c.lower() for c in docs.columns}
    gone_id, gone_raw, n = (next(x for x in (f"_{c}{i}" for i in range(len(taken) + 1)) if x not in taken) for c in ("id", "raw", "n"))
    found = written(near_duplicates(docs, **options))
    gone = found.select(F.col("doc_id").alias(gone_id), F.col("raw").alias(gone_raw)).distinct()
    left = docs.join(gone, (key.cast("long") == F.col(gone_id)) & (F.xxhash64(text) == F.col(gone_raw)), "left_anti")
    repeated = docs.where(key.isNotNull()).groupBy(key.alias(gone_id)).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(gone_id)
    if repeated.isEmpty():
        return left
    same = key == F.col(gone_id)
    again = left.join(repeated, same, "left_semi").dropDuplicates([options.get("id_col", "doc_id"), options.get("text_col", "text")])
    return left.join(repeated, same, "left_anti").union(again)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
