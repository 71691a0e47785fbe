"""Toxicity by class-conditional Kneser-Ney models.

A bigram model for toxic and one for ordinary text: absolute discounting, backing off to the
class's words, and from there to continuation counts that both classes share. What is held back,
and some virtual counts of each expression, are split between the classes by their sizes, so that
a rare expression tells little, and one that neither class has nothing. A text counts an expression once.
Log-likelihood ratios are normalised by length (their mean, and the strong ones by the root of the
length), and a logistic map fitted on rows that the models haven't seen turns them into a score.

All counts are of the whole labelled corpus and every expression is counted. A model is a sketch
of fixed size, whatever the corpus: words are numbers of ``WORD_BITS`` bits, and pairs of them
share ``PAIRS`` cells; a pair's count is at most its first word's and its second word's, whatever
else is in its cell. Nothing that the driver holds or sends grows with the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, kept_by, ship, table, written

STRONG = 1.5
DISCOUNT, VIRTUAL = 0.75, 10.0
WORD_BITS = 20
#: The number of a text's start; words have the numbers below it.
START = 1 << WORD_BITS
SPAN = START + 1
#: Cells of the pairs' counts: a prime, by which a pair's number is divided.
PAIRS = 1_048_573
#: Most words that a worker remembers; beyond it, it starts anew.
REMEMBERED = 100_000
_WORD = re.compile(r"\w+")


def word_numbers(words: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 6) >> (64 - WORD_BITS) for w in words]


class Words:
    """Words of texts as numbers; a worker remembers those that it met."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def numbers(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(words).difference(self.known))
        self.known.update(zip(new, word_numbers(new), strict=True))
        return np.array(list(map(self.known.__getitem__, words)), dtype=np.int64)


def pair_numbers(two: np.ndarray) -> np.ndarray:
    """Of a text's words, each with the one before it (or the text's start)."""
    return np.concatenate([[START], two[:-1]]) * SPAN + two if len(two) else two


def squeezed(state: dict) -> dict:
    """Arrays of single floats as compressed bytes of one byte plane after the other: most counts are small."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    return {k: squeeze.compress(v.view(np.uint8).reshape(-1, 4).T.tobytes()) if isinstance(v, np.ndarray) and v.dtype == np.float32 else v for k, v in state.items()}


def expanded(state: dict) -> dict:
    import zstandard

    expand = zstandard.ZstdDecompressor()
    return {k: np.ascontiguousarray(np.frombuffer(expand.decompress(v), dtype=np.uint8).reshape(4, -1).T).view("<f4").reshape(-1) if isinstance(v, bytes) else v for k, v in state.items()}


@dataclass
class Class:
    """Counts of one class: texts with a word, pairs by first word, kinds of followers, texts in a pair's cell."""

    words: np.ndarray
    context: np.ndarray
    followers: np.ndarray
    pairs: np.ndarray

    def __getstate__(self) -> dict:
        return squeezed(self.__dict__)

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(expanded(state))


@dataclass
class Model:
    toxic: Class
    ordinary: Class
    ends: np.ndarray  # kinds of pairs that end in a word, and a half
    weights: np.ndarray  # of 1 and the two kinds of evidence
    prior: float

    def __getstate__(self) -> dict:
        return squeezed(self.__dict__)

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(expanded(state))

    def __post_init__(self):
        classes = (self.ordinary, self.toxic)
        total = np.array([c.words.sum(dtype=float) for c in classes]) + 0.5
        self.sizes = total / total.sum()
        self.kinds = float(((self.ordinary.words + self.toxic.words) > 0).sum())
        self.every = float(self.ends.sum(dtype=float))

    def ratios(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Log-likelihood ratios of words ``two`` after ``one``; 0 for words that neither class has.

        A word's discounted count in a class, and the class's share by its size of what is held
        back: ``VIRTUAL`` counts, and discounts spread by the shared continuation counts. A pair's
        likewise, the class's share being that of the first word, and what is held back going
        by the class's chance of the second word. Chances are over those of both classes together."""
        classes = (self.ordinary, self.toxic)
        shared = self.ends[two] / self.every
        back = VIRTUAL + DISCOUNT * self.kinds * shared
        held = [np.maximum(c.words[two] - DISCOUNT, 0) for c in classes]
        word = [(n / share + back) / (held[0] + held[1] + back) for n, share in zip(held, self.sizes, strict=True)]
        cell = (one * SPAN + two) % len(self.toxic.pairs)
        near = [np.maximum(np.minimum(np.minimum(c.pairs[cell], c.context[one]), c.words[two]) - DISCOUNT, 0) for c in classes]
        context = [c.context[one] + VIRTUAL * share for c, share in zip(classes, self.sizes, strict=True)]
        after = VIRTUAL + DISCOUNT * (classes[0].followers[one] + classes[1].followers[one]) * shared
        p = [n * (context[0] + context[1]) / c + after * w for n, c, w in zip(near, context, word, strict=True)]
        return np.log(p[1]) - np.log(p[0])

    def evidence(self, docs: list[np.ndarray]) -> np.ndarray:
        """Of each document, the mean ratio, and the sum of its strong ratios over the square root of
        its words; zeros without words."""
        out = np.zeros((len(docs), 2))
        size = np.array([len(d) for d in docs])
        full = np.flatnonzero(size)
        if not len(full):
            return out
        two = np.concatenate([docs[k] for k in full])
        first = np.cumsum([0, *size[full][:-1]])
        one = np.concatenate([[0], two[:-1]])
        one[first] = START
        n = size[full]
        # a document's repetitions of an expression say nothing more
        doc = np.repeat(np.arange(len(full)), n)
        order = np.lexsort((one * SPAN + two, doc))
        again = np.zeros(len(two), dtype=bool)
        again[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        ratio = np.where(again, 0.0, self.ratios(one, two))
        out[full, 0] = np.add.reduceat(ratio, first) / n
        out[full, 1] = np.add.reduceat(np.where(ratio > STRONG, ratio, 0.0), first) / np.sqrt(n)
        return out

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        x = self.evidence(docs)
        z = self.weights[0] + x @ self.weights[1:]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return np.where([len(d) > 0 for d in docs], p, self.prior)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counted(keys: list[np.ndarray], cell: list[int]) -> pa.RecordBatch:
    """Distinct keys with their counts in four cells, of fold 0 and 1, ordinary and toxic."""
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    where = np.repeat(np.array(cell), [len(k) for k in keys])
    n = np.bincount(inverse * 4 + where, minlength=4 * len(found)).reshape(-1, 4).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(np.ascontiguousarray(n[:, i])) for i in range(4))], names=["k", *CELLS])


CELLS = ("n0", "n1", "n2", "n3")  # 2 * fold + toxic


def _counts(labelled: DataFrame) -> DataFrame:
    """(k, n0, n1, n2, n3) over all labelled texts, summed in each task before the shuffle: of each
    pair of words by its number, and of each word by -1 less its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys, cell, size = Words(), [], [], 0
        for batch in batches:
            for f, t, text in zip(*batch.columns, strict=True):
                two = words.numbers(text.as_py())
                if len(two):  # once for each text, however often it repeats it
                    keys.append(np.concatenate([np.unique(pair_numbers(two)), -1 - np.unique(two)]))
                    cell.append(2 * f.as_py() + t.as_py())
                    size += len(keys[-1])
                if size > 500_000:
                    yield _counted(keys, cell)
                    keys, cell, size = [], [], 0
        if keys:
            yield _counted(keys, cell)

    rows = labelled.select("fold", "toxic", "text").mapInArrow(run, ", ".join(["k long", *(f"{c} int" for c in CELLS)]))
    return rows.groupBy("k").agg(*(F.sum(c).alias(c) for c in CELLS))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a task as one: how many, and each column's bytes, by planes and compressed; the first column as steps."""
    import zstandard

    parts = list(batches)
    if not sum(p.num_rows for p in parts):
        return
    squeeze = zstandard.ZstdCompressor(level=1)
    columns = [np.concatenate([p.column(i).to_numpy() for p in parts]).astype(np.int32) for i in range(parts[0].num_columns)]
    order = np.argsort(columns[0])
    columns = [np.diff(columns[0][order], prepend=np.int32(0)), *(c[order] for c in columns[1:])]
    raw = [squeeze.compress(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 4).T.tobytes()) for c in columns]
    yield pa.RecordBatch.from_arrays([pa.array([len(order)], pa.int32()), pa.array([raw], pa.list_(pa.binary()))], names=["n", "x"])


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(4, n).T).view("<i4").reshape(-1)


def fit(labelled: DataFrame, calibration_rows: int = 20_000, cells: int = PAIRS) -> Model:
    """``labelled``: (doc_id, fold 0 or 1, toxic 0 or 1, text). Counts are of all its rows.

    The score's map is fitted on at most ``calibration_rows`` rows of fold 1 (those with the least
    hashes of their ids) under models of fold 0; the models that score are of both folds. The
    driver gets the sketch: at most a row for each word number and each of ``cells`` for pairs.
    """
    counts = written(_counts(labelled))
    pairs = counts.where("k >= 0")

    def packed(df: DataFrame) -> list:
        """``df``'s columns, the first of which says where, compressed: some MB."""
        return df.mapInArrow(_packed, "n int, x array<binary>").collect()

    def spread(got: list, size: int, *columns: tuple[int, ...]) -> np.ndarray:
        """A row for each of ``columns``, the sum of those after the first."""
        out = np.zeros((len(columns), size), dtype=np.float32)
        for n, raw in got:
            at = np.cumsum(_unpacked(raw[0], n))
            for i, some in enumerate(columns):
                out[i, at] = sum(_unpacked(raw[1 + c], n).astype(np.float32) for c in some)
        return out

    def capped(c: Column) -> Column:
        return F.least(c, F.lit((1 << 31) - 1)).cast("int")

    of_word = packed(counts.where("k < 0").select(F.expr("int(-1 - k)"), *(capped(F.col(c)) for c in CELLS)))
    kinds = [(F.col(f"n{t}") > 0).cast("long") for t in (0, 1)] + [((F.col(f"n{t}") + F.col(f"n{t + 2}")) > 0).cast("long") for t in (0, 1)]
    by_first = packed(pairs.groupBy(F.expr(f"int(k div {SPAN})")).agg(*(capped(F.sum(c)) for c in CELLS), *(capped(F.sum(x)) for x in kinds)))
    by_last = packed(pairs.groupBy(F.expr(f"int(k % {SPAN})")).agg(capped(F.sum(kinds[0] + kinds[1])), capped(F.sum(kinds[2] + kinds[3]))))
    of_pair = packed(pairs.groupBy(F.expr(f"int(k % {cells})")).agg(*(capped(F.sum(c)) for c in CELLS)))
    discard(counts)

    def model(folds: int, weights: np.ndarray, prior: float) -> Model:
        """Only what this model needs is spread."""
        of = [(0,), (1,)] if folds == 1 else [(0, 2), (1, 3)]
        words, first, pairs = spread(of_word, SPAN, *of), spread(by_first, SPAN, *of, (2 + 2 * folds,), (3 + 2 * folds,)), spread(of_pair, cells, *of)
        ends = spread(by_last, SPAN, (folds - 1,))[0]
        ends += np.float32(0.5)
        classes = [Class(words[t], first[t], first[2 + t], pairs[t]) for t in (0, 1)]
        return Model(classes[1], classes[0], ends, weights, prior)

    held, sent = _scored(labelled.where("fold = 1").select("doc_id", "toxic", "text"), model(1, np.zeros(3), 0.0), ["_mean", "_strong"])
    got = held.orderBy(F.xxhash64("doc_id"), "_mean", "_strong").limit(calibration_rows).select("toxic", "_mean", "_strong").collect()
    sent.destroy()
    x, y = np.array([(r["_mean"], r["_strong"]) for r in got]).reshape(-1, 2), np.array([r["toxic"] for r in got], dtype=float)
    weights = logistic(x, y) if len(y) else np.array([-5.0, 0.0, 5.0])
    return model(2, weights, float(y.mean()) if len(y) else 0.0)


def _scored(docs: DataFrame, model: Model, names: list[str]) -> tuple[DataFrame, Broadcast]:
    """``docs``, whose last column is the text, with two columns of evidence or one of scores instead of
    that; and the model as it is sent, a sketch of fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    give_evidence = len(names) == 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            values, part, size = [], [], 0

            def flush() -> None:
                nonlocal part, size
                if part:
                    values.append(sent.value.evidence(part) if give_evidence else sent.value.score(part)[:, None])
                part, size = [], 0

            for text in batch.columns[-1]:
                part.append(words.numbers(text.as_py()))
                size += len(part[-1]) + 1
                if size > 200_000:
                    flush()
            flush()
            if values:
                both = np.concatenate(values)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.ascontiguousarray(both[:, i])) for i in range(len(names)))], names=[*batch.schema.names[:-1], *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:-1], *(T.StructField(n, T.DoubleType()) for n in names)])), sent


#: Bits of the map that tells most texts without a label before they are shuffled.
MAPPED = 1 << 23


def _likely(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` whose id may be one of ``known``: all that are, and few others. A map of ``MAPPED`` bits is broadcast, whatever the
    number of ids; with more ids it lets more of the others through."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(MAPPED))
    bits = known.select(F.expr("doc_id")).select(F.floor(at / 64).alias("_cell"), F.expr(f"shiftleft(1L, int(pmod(xxhash64(doc_id), {MAPPED}) % 64))").alias("_bit")).groupBy("_cell").agg(F.bit_or("_bit").alias("_bits"))
    mine = F.expr(f"shiftrightunsigned(_bits, int(pmod(xxhash64(doc_id), {MAPPED}) % 64)) & 1L") == 1
    return docs.join(F.broadcast(bits), (F.floor(at / 64) == F.col("_cell")) & mine, "left_semi")


def training_rows(docs: DataFrame, labels: DataFrame, fold: Column | None = None) -> DataFrame:
    """Labelled texts; ``fold`` is null for rows that nothing may be learnt from. A label without a
    text, a null label or id, and every label but 0 and 1 are left out; of repeated labels the larger counts."""
    fold = held_fold() if fold is None else fold
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(fold.isNotNull())
    # the same join at every size: labels grow with the documents, so they are never broadcast, only a bitmap of fixed size
    return _likely(docs.select("doc_id", "text"), known).join(known.hint("shuffle_hash"), "doc_id").select("doc_id", fold.cast("int").alias("fold"), "toxic", "text").where("fold is not null")


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row. A null or empty text, or one without words, has the share of
    toxic rows as its score; a very long one is scored whole; null and repeated ids are rows like
    others; other columns are not read; an empty table gives no rows."""
    ship(docs.sparkSession)
    return _scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model, ["score"])[0]


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is at least ``threshold``, its columns as they are,
    whatever their names. A null or empty text has the share of toxic rows as its score; rows with
    null or repeated ids, and repeated rows, are judged one by one; an empty table stays empty."""
    ship(docs.sparkSession)
    return kept_by(docs, text_col, lambda wide, name: _scored(wide, model, [name])[0], lambda score: score < threshold)


def held_fold(id_col: str = "doc_id") -> Column:
    """1 for the fifth of the rows that calibrate, else 0."""
    return (F.pmod(F.xxhash64(F.col(id_col)), F.lit(5)) == 0).cast("int")


def third(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def learnt_fold(id_col: str = "doc_id") -> Column:
    """The fold of rows that may be learnt from; null for the third that is held out."""
    return F.when(third(id_col) != 1, held_fold(id_col))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = written(training_rows(docs, table(spark, sf_dir, "labels"), learnt_fold()))
    model = fit(rows)
    discard(rows)
    scored = toxicity_scores(docs, model)
    return scored.select("doc_id", F.coalesce(third() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
