"""Personal data by boosted candidate spans.

Fixed patterns give base spans, which always stay. High-recall generators propose further,
possibly overlapping spans; boosted trees score them by format and context, and those at or
above their kind's calibrated threshold are added. The trees are fitted on the candidates of a
bounded sample of documents: candidates on base spans, and rewritings of base spans in the other
generators' formats, are positive; the others are negative, but for IPv6 addresses, which no base
pattern can tell, so that they are judged by rewritings alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_AREA = re.compile(r"\+?\(?[0-9](?:[ ().\-/]*[0-9])*")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# a mailbox has at most 64 characters and a label 63, so these bounds lose no address
_VEILED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,64}){1,8}", re.IGNORECASE)
_SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_RUN = re.compile(r"[0-9]+")
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def base_spans(text: str, areas: list[tuple[int, int]]) -> list[Span]:
    """By start, then kind. Digits only match within ``areas``; each step is linear in the text."""
    out, done = [], 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        low = a
        while low > done and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
            low -= 1
        if low < a:
            out.append((low, 0, m.end()))
            done = m.end()
    for s, e in areas:
        if e - s < 7:
            continue
        for m in _IP.finditer(text, s, e):
            if all(len(g.lstrip("0")) <= 3 and int(g[-4:]) <= 255 for g in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, s, e):
            digits = "".join(_RUN.findall(m.group())) if m.end() - m.start() < 64 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if text[s] == "+":
            for m in _PHONE.finditer(text, s, e):
                if 9 <= sum(map(len, _RUN.findall(m.group()))) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def proposals(text: str, areas: list[tuple[int, int]]) -> list[Span]:
    """High-recall candidates of each kind; they may overlap one another and base spans."""
    out = [(m.start(), 0, m.end()) for m in _VEILED.finditer(text)] if "at" in text and ("(" in text or "[" in text) else []
    if text.count(":") >= 7:
        out += [(m.start(), 1, m.end()) for m in _SIX.finditer(text)]
    for s, e in areas:
        if e - s >= 7:  # the shortest: seven digits, or four with dots
            out += numbers(text, s, e)
    return out


def numbers(text: str, s: int, e: int) -> list[Span]:
    """Of an area, the spans from a start of a run of digits to an end of a later one, or the same,
    with 7 to 15 digits (phone), 12 to 19 (card), or four runs with dots between (ip). At most 19
    runs fit, so there are a bounded number of spans for each start."""
    out, runs = [], [m.span() for m in _RUN.finditer(text, s, e)]
    for i, (a, _) in enumerate(runs):
        start = a
        while start > s and text[start - 1] in "(+" and a - start < 2:
            start -= 1
        digits = dots = 0
        for j in range(i, len(runs)):
            digits += runs[j][1] - runs[j][0]
            if digits > 19:
                break
            dots += j > i and "." in text[runs[j - 1][1] : runs[j][0]]
            end = runs[j][1]
            if 7 <= digits <= 15:
                out.append((start, 3, end))
            if 12 <= digits:
                out.append((a, 2, end))
            if j == i + 3 and dots == 3:
                out.append((a, 1, end))
    return out


class Taken:
    """Disjoint stretches of a text in order; those given may overlap."""

    def __init__(self, stretches: Iterable[tuple[int, int]] = ()):
        self.starts, self.ends = [], []
        for s, e in sorted(stretches):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, span: Span) -> bool:
        at = bisect_right(self.ends, span[0])
        return at < len(self.starts) and self.starts[at] < span[2]

    def add(self, span: Span) -> None:
        at = bisect_right(self.ends, span[0])
        self.starts.insert(at, span[0])
        self.ends.insert(at, span[2])


FEATURES = 24
_HINTS = tuple(re.compile(p, re.IGNORECASE) for p in (r"mail|contact|write", r"\bip\b|server|host|addr", r"card|visa|pay|credit|konto|tarjeta|carte", r"tel|phone|call|mobil|fax|number"))


def features(text: str, span: Span) -> list[float]:
    start, kind, end = span
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    runs = _RUN.findall(s)
    digits = "".join(runs)
    four = [int(r) for r in runs[:4] if len(r) < 10] if len(runs) == 4 else []
    return [
        float(kind), float(len(s)), float(len(digits)), float(len(runs)), float(max(map(len, runs), default=0)), float(min(map(len, runs), default=0)),
        float(s.count(" ")), float(s.count("-")), float(s.count(".")), float(s.count("(")), float(s.count("/")), float(s.count(":")),
        float(s.startswith("+")), float(s.startswith("00")), float(s.startswith("0") and not s.startswith("00")), float(s.startswith("(")),
        float(len(digits) >= 12 and luhn(digits)), float(bool(four) and max(four) <= 255), float("at" in s.lower()), float("dot" in s.lower()),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(len(set(digits))), float(sum(bool(h.search(before)) << i for i, h in enumerate(_HINTS))),
    ]


def rewritten(s: str, kind: int) -> str:
    """A base span as people also write it, where the base pattern no longer finds it."""
    if kind == 0:
        return s.replace("@", " (at) ")
    digits = "".join(_RUN.findall(s))
    if kind == 1:  # eight groups that its digits give
        return ":".join(f"{hash_of(f'{digits} {i}') & (0xFFFF if i % 3 else 0xFFF):x}" for i in range(8))
    if kind == 2:
        return "/".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return "00" + s[1:]


def misread(s: str) -> str:
    """Of an address, eight two-digit groups, as of hardware or times: no address."""
    return ":".join(f"{hash_of(f'{s} {i}') % 60:02d}" for i in range(8))


@dataclass
class Trees:
    """Boosted trees of depth 3: seven tests and eight leaves each; one threshold a kind."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    threshold: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > c[node])
            z += leaf[node - 7]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, rate: float = 0.2, bins: int = 32) -> Trees:
    """Gradient boosting of the logistic loss with histogram splits."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base, z = float(np.log(share / (1 - share))), np.full(len(y), np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    feats, points, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(7, dtype=np.int64), np.full(7, np.inf)
        for at in range(7):
            rows = np.flatnonzero(node == at)
            best = 1e-6
            split = None
            if len(rows) > 1:
                for f, c in enumerate(cuts):
                    gs, hs = (np.cumsum(np.bincount(binned[rows, f], v[rows], minlength=len(c) + 1)) for v in (g, h))
                    gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                    gain = np.where((hl > 0.1) & (hr > 0.1), gl**2 / (hl + 1) + gr**2 / (hr + 1) - gs[-1] ** 2 / (hs[-1] + 1), 0)
                    if len(gain) and gain.max() > best:
                        best, split = gain.max(), (f, c[gain.argmax()])
            if split:
                feature[at], cut[at] = split
            node[rows] = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        own = node - 7
        leaf = -rate * np.bincount(own, g, minlength=8) / (np.bincount(own, h, minlength=8) + 1)
        z += leaf[own]
        feats.append(feature)
        points.append(cut)
        leaves.append(leaf)
    return Trees(base, np.array(feats), np.array(points), np.array(leaves), np.full(len(KINDS), 2.0))


def areas_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _AREA.finditer(text)]


def fit(docs: DataFrame, sample_docs: int = 20_000, sample_spans: int = 20_000, least: int = 20, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees fitted on at most ``sample_spans`` candidates of about ``sample_docs`` documents, chosen by hash.

    A third of the candidates, by the hash of what is in and around them, only calibrate: a kind's
    threshold lies above all its negatives there and is 0.9 at least. A kind with fewer than
    ``least`` positives gets no further spans. The trees depend on the documents alone, not on how
    they lie in partitions. Null texts have no candidates; without any, no spans are added.
    """
    share = min(1.0, sample_docs / max(1, docs.count()))
    part = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < F.lit(round(share * (1 << 20)))).where("text is not null")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels, places = [], [], []

            def add(text: str, span: Span, label: int) -> None:
                rows.append(features(text, span))
                labels.append(label)
                # the same wherever the row is: by what is in and around the span
                places.append(hash_of(f"{span[1]} {label} {text[max(0, span[0] - 24) : span[2] + 8]}"))

            for text in batch.column(1).to_pylist():
                areas = areas_of(text)
                known = base_spans(text, areas)
                exact, alike = set(known), [Taken((s, e) for s, k, e in known if k == kind) for kind in range(len(KINDS))]
                for span in proposals(text, areas):
                    unsure = span[1] == 1 and ":" in text[span[0] : span[2]]
                    if span in exact or not unsure and not alike[span[1]].meets(span):
                        add(text, span, int(span in exact))  # a part of a base span, or more than it, is neither
                for s, k, e in known:
                    add(text, (s, k, e), 1)
                    for other, label in [(rewritten(text[s:e], k), 1), *([(misread(text[s:e]), 0)] if k == 1 else [])]:
                        at = min(s, 24)
                        add(text[s - at : s] + other + text[e : e + 8], (at, k, at + len(other)), label)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(labels, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["place", "label", "x"])

    got = part.mapInArrow(candidates, "place long, label int, x array<double>").orderBy("place", "label", "x").limit(sample_spans).collect()
    if not got:
        return Trees(0.0, np.zeros((0, 7), dtype=np.int64), np.zeros((0, 7)), np.zeros((0, 8)), np.full(len(KINDS), 2.0))
    x, y = np.array([r["x"] for r in got]), np.array([r["label"] for r in got], dtype=float)
    held = np.array([r["place"] % 3 == 2 for r in got])
    trees = boost(x[~held], y[~held])
    p = trees.score(x)
    for k in range(len(KINDS)):
        own = x[:, 0] == k
        if (own & (y == 1)).sum() >= least:
            worst = p[own & held & (y == 0)].max(initial=0.0)
            trees.threshold[k] = max(0.9, worst + (1 - worst) / 2)
    return trees


def hash_of(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def all_spans(texts: list[str], trees: Trees) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; an added span overlaps no base span and no better added one."""
    found, owner, asked, rows = [], [], [], []
    for i, text in enumerate(texts):
        areas = areas_of(text)
        known = base_spans(text, areas)
        found.append(known)
        base = Taken((s, e) for s, _, e in known)
        for span in proposals(text, areas):
            if trees.threshold[span[1]] <= 1 and not base.meets(span):
                owner.append(i)
                asked.append(span)
                rows.append(features(text, span))
    added: dict[int, list[Span]] = {}
    taken: dict[int, Taken] = {}
    if rows:
        x = np.array(rows)
        p = trees.score(x)
        for k in np.lexsort((-x[:, 1], -p)):
            span, held = asked[k], taken.setdefault(owner[k], Taken())
            if p[k] >= trees.threshold[span[1]] and not held.meets(span):
                held.add(span)
                added.setdefault(owner[k], []).append(span)
    return [(known, sorted(known + added.get(i, []))) for i, known in enumerate(found)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping ones, becomes its first kind's name in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += (text[at:s], f"[{KINDS[k].upper()}]")
        at = max(at, e)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, trees: Trees | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted) for every row.

    Counts and the hash are of base spans; ``spans`` has all. A null text is empty and has none; a
    very long one is searched whole; null and repeated ids are rows like others; other columns are not read; an empty table
    gives no rows. Positions are code points, ends exclusive.
    """
    ship(docs.sparkSession)
    trees = trees or fit(docs, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a in range(0, len(texts), 500):
                some = texts[a : a + 500]
                both = all_spans(some, trees)
                counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in both], pa.int64()) for kind in range(len(KINDS))]
                sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both]
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(some)), *counts, pa.array(sha), pa.array([joined(x) for _, x in both]), pa.array([redacted(t, x) for t, (_, x) in zip(some, both, strict=True)])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")


def redact(docs: DataFrame, trees: Trees | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the same columns, its texts redacted and their lengths brought up to date.

    Null texts stay null, and their lengths as they are; very long texts are redacted whole; rows with
    null or repeated ids, and repeated rows, are redacted one by one; other columns, whatever their
    names, stay as they are; an empty table stays empty."""
    ship(docs.sparkSession)
    trees = trees or fit(docs, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            both = all_spans([t or "" for t in texts], trees)
            new = pa.array([t if t is None else redacted(t, x) for t, (_, x) in zip(texts, both, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(docs.schema[length_col].dataType), F.col(length_col)))
    return out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("redacted")
