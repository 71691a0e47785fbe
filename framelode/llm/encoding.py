"""Whole texts to token ids inside a task, each distinct word encoded once.

A text is cut only where its tokenizer can never join two sides, so the ids are those of the
whole text: ``words`` cuts at spaces and line feeds (for a tokenizer that drops white space),
``spaced`` cuts before a space that a visible character follows (for one that keeps the space
with the word after it), ``None`` encodes whole texts. ``ranks`` (for a byte-level tokenizer with
the usual pattern) reads the same file's vocabulary as merge ranks, with which whole texts take
a third of the time; a test holds its ids against the tokenizers library for every code point.
A text that has the literal string of one of the file's special tokens is encoded whole, so that
the string becomes that token, as the library makes of it.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

#: Most words that a worker remembers; beyond it, it starts anew.
REMEMBERED = 700_000
#: Characters of text that are cut at once.
SLICE = 1_000_000
_CUT = re.compile(r"(?= \S)")
_ODD = re.compile(r" \s")
_LETTERS = re.compile(r"[^\W\d_]+")
_CLOSING = frozenset(",.;:!?)")
_encoders: dict = {}


class Encoder:
    def __init__(self, path: str, cut: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.cut, self.known = cut, {}
        if cut == "ranks":
            self.ranks = _ranks(path)
            self.special = tuple(self.ranks.special_tokens_set)
            return
        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # where a run of letters begins or ends in a row of ids, by the mark that the vocabulary has for it
        vocab = self.tokenizer.get_vocab()
        self.mark = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.mark[i] = token.endswith("</w>") if cut == "words" else token.startswith("\u0120")

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        part, size = [], 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= SLICE:
                yield from self._slice(part)
                part, size = [], 0
        yield from self._slice(part)

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            yield np.array(e.ids, dtype="<u4").tobytes()

    def _odd(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def _slice(self, texts: list[str]) -> Iterator[bytes]:
        if self.cut == "ranks":
            for t in texts:
                ids = self.ranks.encode(t, allowed_special="all") if self._odd(t) else self.ranks.encode_ordinary(t)
                yield np.array(ids, dtype="<u4").tobytes()
            return
        if self.cut is None:
            yield from self._whole(texts)
            return
        if len(self.known) > REMEMBERED:
            self.known.clear()
        whole = {k: next(self._whole([t])) for k, t in enumerate(texts) if self._odd(t)}
        if whole:
            texts = ["" if k in whole else t for k, t in enumerate(texts)]
        if self.cut == "words":
            cut = [text.replace("\n", " ").split(" ") for text in texts]
        else:  # words that follow a space are remembered without it
            plain = [not (_ODD.search(t) or t.endswith(" ")) for t in texts]
            cut = [t.split(" ") if fine else [p[1:] if p[:1] == " " else "\0" + p for p in _CUT.split(t)] for t, fine in zip(texts, plain, strict=True)]
            for pieces, fine in zip(cut, plain, strict=True):
                if fine:
                    pieces[0] = "\0" + pieces[0]
        new = set().union(*cut).difference(self.known)
        self._learn(new)
        get = self.known.__getitem__
        for k, pieces in enumerate(cut):
            yield whole[k] if k in whole else b"".join(map(get, pieces))
        for w in new:
            if len(w) > 200:
                del self.known[w]

    def _learn(self, new: set[str]) -> None:
        """A word's letters and what follows them are encoded apart where that can't change the ids."""
        parts, letters, others, lower = [], set(), set(), self.cut == "words"
        for w in new:
            if w.isalpha():
                run, rest = w, ""
            elif w[-1:] in _CLOSING and w[:-1].isalpha():
                run, rest = w[:-1], w[-1]
            elif (m := _LETTERS.match(w)) and m.group().isalpha() and w[m.end()] < "\x80" and w[m.end()] != "'":
                run, rest = m.group(), w[m.end() :]
            else:
                others.add(w)
                continue
            if lower:  # what the tokenizer's normaliser makes of it must be letters too
                if run.isascii():
                    run = run.lower()
                elif not unicodedata.normalize("NFC", run).lower().isalpha():
                    others.add(w)
                    continue
            parts.append((w, run, rest))
            letters.add(run)
            if rest:
                others.add("\0" + rest if not lower else rest)
        self._learn_runs([r for r in letters if r not in self.known])
        plain = [o for o in others if o not in self.known]
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            asked = some if lower else [o[1:] if o[:1] == "\0" else " " + o for o in some]
            self.known.update(zip(some, self._whole(asked), strict=True))
        known, mark = self.known, "" if lower else "\0"
        for w, run, rest in parts:
            if rest:
                known[w] = known[run] + known[mark + rest]
            elif run is not w:
                known[w] = known[run]

    def _learn_runs(self, runs: list[str]) -> None:
        """Many runs of letters as one text; marks in the vocabulary tell where each is in the ids."""
        for at in range(0, len(runs), 5_000):
            some = runs[at : at + 5_000]
            text = " ".join(some) if self.cut == "words" else " " + " ".join(some)
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
            marked = np.flatnonzero(self.mark[ids])
            if len(marked) != len(some):
                self.known.update(zip(some, self._whole(some if self.cut == "words" else [" " + r for r in some]), strict=True))
                continue
            ends = [*(4 * (marked + 1))] if self.cut == "words" else [*(4 * marked[1:]), 4 * len(ids)]
            raw, begin = ids.tobytes(), 0
            for r, end in zip(some, ends, strict=True):
                self.known[r] = raw[begin:end]
                begin = end


def _ranks(path: str):
    """The byte-level vocabulary of a tokenizers file as merge ranks: ids follow the order of the merges."""
    import json

    import public_tokenizers
    import tiktoken

    # printable Latin-1 bytes stand for themselves, the others for the code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(path: str, cut: str | None) -> Encoder:
    """One for each worker process, file and way of cutting."""
    if (path, cut) not in _encoders:
        _encoders[path, cut] = Encoder(path, cut)
    return _encoders[path, cut]


def tokenizer_path(name: str) -> str:
    """Where the named vocabulary is installed; any other path can be given instead."""
    import public_tokenizers

    return public_tokenizers.path(name)
