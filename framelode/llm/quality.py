"""A quality classifier from weak labels.

Heuristic labellers vote on every document (good, bad, or no opinion). Expectation-maximisation
over the counts of all vote patterns estimates how accurate each labeller is and how common each
class; the posterior labels of a bounded sample then train a hashed linear scorer that scores
every document by its words and their shapes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_by, ship, table

HASHED = 1 << 12
#: Documents below this score are rejected: clean ones with odd passages lie between it and 0.5.
REJECT = 0.3
#: Most words that a worker remembers; beyond it, it starts anew.
REMEMBERED = 150_000
#: Common words of the corpus's languages.
FUNCTION_WORDS = frozenset("the of and to in a is that it for was on are as with they be at this have from or by an not he had his but de la que el en y los del las un por con no una su para es al lo le et les des est du dans qui pour au une sur pas plus ce se der die und das von den mit ist im dem nicht ein eine auf sich auch als".split())
LABELLERS = ("symbols", "capitals", "stutter", "bars", "function_words", "same_lines", "variety")
_MARKED = re.compile(r"[^\w\s]{2,}")
_RUNS = re.compile(r"(.)\1+")


def votes(text: str) -> int:
    """A base-3 number, a digit for each labeller: 0 no opinion, 1 bad, 2 good."""
    words = text.split()
    n = len(words)
    if n < 8:
        return 0
    out = []

    def vote(value: float, good_to: float, bad_from: float, enough: bool = True) -> None:
        out.append(0 if not enough else 2 if value <= good_to else 1 if value >= bad_from else 0)

    vote(len(_MARKED.findall(text)) / n, 0.05, 0.3)
    letters = list(filter(str.isalpha, text))
    vote(sum(map(str.isupper, letters)) / max(1, len(letters)), 0.25, 0.6)
    vote(sum(map(str.__eq__, words[1:], words)) / n, 0.02, 0.1, n >= 20)
    vote(words.count("|") / n, 0.0, 0.15)
    low = sum(w.lower().strip(".,!?") in FUNCTION_WORDS for w in words) / n
    vote(-low, -0.12, -0.03, n >= 20)
    lines = [x for x in text.split("\n") if x]
    out.append(0 if len(lines) < 4 else 1 if len(set(lines)) <= 0.5 * len(lines) else 2)
    runs = {tuple(words[i : i + 4]) for i in range(n - 3)}
    vote(1 - len(runs) / (n - 3), 0.15, 0.5)
    code = 0
    for v in reversed(out):
        code = 3 * code + v
    return code


def posterior(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """(chance of good for each pattern, each labeller's accuracy on [bad, good], share of good).

    A labeller has an accuracy on either class: one that looks for a single fault calls most bad
    documents good. The first guess is that any bad vote is right; weak priors keep a labeller
    that rarely votes from certainty. Without a vote, the share of good stands."""
    v = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    good, bad = v == 2, v == 1
    p = np.where(bad.any(axis=1), 0.1, 0.95)
    right, share = np.full((2, len(LABELLERS)), 0.5), 0.5
    for _ in range(rounds):
        w, u = counts * p, counts * (1 - p)
        found = np.stack([(u @ bad + 1) / (u @ (bad | good) + 2), (w @ good + 9) / (w @ (bad | good) + 10)])
        found, share_found = np.clip(found, 0.01, 0.9995), float(np.clip((w.sum() + 8) / (counts.sum() + 10), 0.05, 0.98))
        done = np.abs(found - right).max() < 1e-9 and abs(share_found - share) < 1e-9
        right, share = found, share_found
        of_good = np.log(share) + good @ np.log(right[1]) + bad @ np.log(1 - right[1])
        of_bad = np.log(1 - share) + bad @ np.log(right[0]) + good @ np.log(1 - right[0])
        p = 1 / (1 + np.exp(np.clip(of_bad - of_good, -500, 500)))
        if done:
            break
    return p, right, share


def word_features(word: str) -> tuple[int, int]:
    """Hashed features of a word: its shape, and itself in lower case."""
    core = word[:-1] if word[-1:] in ".," else word
    if core.isalpha() and core[1:].islower() and len(core) <= 60:  # most words: a letter, then small ones
        shape = ("A" if core[0].isupper() else "a") + ("aa" if core[0].isupper() and len(core) > 2 else "a") + word[len(core) :]
    else:
        shape = _RUNS.sub(r"\1\1", "".join(["A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word]))
    return zlib.crc32(b"s" + shape.encode("utf-8", "surrogatepass")) % HASHED, zlib.crc32(b"w" + word.lower().encode("utf-8", "surrogatepass")) % HASHED


def features(text: str) -> np.ndarray:
    """Counts of hashed word features and of a word that repeats the one before, over the number of words."""
    words = text.split()
    if not words:
        return np.zeros(HASHED + 1)
    ids = np.array(list(map(word_features, words)), dtype=np.int64).reshape(-1)
    same = sum(map(str.__eq__, words[1:], words))
    return np.append(np.bincount(ids, minlength=HASHED), 4.0 * same) / len(words)


def fit_linear(x: np.ndarray, y: np.ndarray, epochs: int = 60, ridge: float = 1e-5, seed: int = 1) -> np.ndarray:
    """Logistic weights (the last is the bias) for soft labels, by adaptive gradients."""
    rng, w = np.random.default_rng(seed), np.zeros(x.shape[1] + 1)
    square = np.full(len(w), 1e-8)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            p = 1 / (1 + np.exp(-np.clip(x[at] @ w[:-1] + w[-1], -30, 30)))
            g = np.append(x[at].T @ (p - y[at]) / len(at), (p - y[at]).mean()) + ridge * w
            square += g * g
            w -= 0.5 * g / np.sqrt(square)
    return w


def fit(docs: DataFrame, sample: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, dict]:
    """Scorer weights, and what expectation-maximisation found. Votes are of all documents; the
    scorer is trained on the ``sample`` documents with the least hashes of their text."""
    ship(docs.sparkSession)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = [votes(t.as_py() or "") for t in batch.column(0)]
            found, n = np.unique(np.array(code, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pattern", "n"])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                x = features(text.as_py() or "").astype(np.float32)
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([votes(text.as_py() or "")], pa.int64()), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([x[at]], pa.list_(pa.float32()))], names=["pattern", "at", "x"])

    texts = docs.select(F.col(text_col).alias("text"))
    counts = texts.mapInArrow(voted, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    got = sorted(tuple(r) for r in counts.collect())  # at most 3 ** len(LABELLERS) patterns
    patterns, n = (np.array(c, dtype=np.int64) for c in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 2
    p, right, share = posterior(patterns, n)
    rows = docs.count()
    part = texts.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(1 << 20)) <= F.lit(int(min(1.0, 1.25 * sample / max(1, rows)) * (1 << 20))))
    part = part.dropDuplicates(["h"]).orderBy("h").limit(sample).select("text")
    few = part.mapInArrow(sampled, "pattern long, at array<int>, x array<float>").toArrow()
    x = np.zeros((few.num_rows, HASHED + 1), dtype=np.float32)
    for i, (at, v) in enumerate(zip(few.column("at"), few.column("x"), strict=True)):
        x[i, np.asarray(at.values)] = np.asarray(v.values)
    y = p[np.searchsorted(patterns, few.column("pattern").to_numpy())] if few.num_rows else np.empty(0)
    weights = fit_linear(x, y) if few.num_rows else np.zeros(HASHED + 2)
    return weights, {"accuracy": dict(zip(LABELLERS, right.T.tolist(), strict=True)), "share_good": share, "patterns": dict(zip(patterns.tolist(), p.tolist(), strict=True))}


def _scored(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """``docs``, whose last column is the text, with the score under ``name`` instead of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_feature, same_w, bias = weights[:HASHED], 4.0 * weights[HASHED], weights[-1]
        known: dict[str, float] = {}
        for batch in batches:
            score = []
            for text in batch.columns[-1]:
                words, z = (text.as_py() or "").split(), 0.0
                if len(known) > REMEMBERED:
                    known.clear()
                for w in set(words).difference(known):
                    a, b = word_features(w)
                    known[w] = of_feature[a] + of_feature[b]
                if words:
                    z = (sum(map(known.__getitem__, words)) + same_w * sum(map(str.__eq__, words[1:], words))) / len(words)
                score.append(z + bias)
            p = 1 / (1 + np.exp(-np.clip(np.array(score, dtype=float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*batch.schema.names[:-1], name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:-1], T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, weights: np.ndarray, threshold: float = REJECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, kept) for every row. A null text is empty; an empty one has the bias as its
    evidence; a very long one is scored whole; null and repeated ids are rows like others; other
    columns are not read; an empty table gives no rows."""
    scored = _scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), weights)
    return scored.withColumn("kept", F.col("score") >= threshold)


def good_only(docs: DataFrame, weights: np.ndarray, threshold: float = REJECT, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``, its columns as they are, whatever
    their names. A null text is judged as an empty one; rows with null or repeated ids, and repeated
    rows, are judged one by one; an empty table stays empty."""
    ship(docs.sparkSession)
    return kept_by(docs, text_col, lambda wide, name: _scored(wide, weights, name), lambda score: score >= threshold)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, _ = fit(docs)
    return quality_scores(docs, weights)
