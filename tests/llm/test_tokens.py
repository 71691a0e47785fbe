import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from framelode.llm import bpe, packing, token_planes
from framelode.llm.common import ship
from framelode.llm.encoding import Encoder

from .helpers import empty, odd_docs, odd_texts


#: Literal strings of special tokens, which the library maps to their ids, and others that only look like them.
SPECIAL = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "so  <|endoftext|>\n\n end ", "<|endoftext|><|endoftext|>"]


def plain_ids(name, texts):
    t = Tokenizer.from_file(P.path(name))
    return [np.array(e.ids, dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("name", "cut"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced"), ("byte_bpe_50k.json", "ranks")])
def test_words_encoded_once_give_the_ids_of_whole_texts(name, cut):
    texts = [*odd_texts(), "the The THE the, the. <|endoftext|> don't we'll क़x á b ́c"]
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in Encoder(P.path(name), cut).ids(texts)]
    assert got == [x.tolist() for x in plain_ids(name, texts)]


def test_ranks_agree_on_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}{c} \n1{c}" for c in points[i : i + 2000]) for i in range(0, len(points), 2000)]
    path = P.path("byte_bpe_50k.json")
    assert all(x == y for x, y in zip(Encoder(path, "ranks").ids(texts), Encoder(path, None).ids(texts), strict=True))


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    sizes, payload = token_planes.to_planes(ids, planes)
    assert token_planes.from_planes(n, planes, sizes, payload).tolist() == ids.tolist()


@pytest.mark.parametrize(("planes", "block"), [("byte", 64), ("bit", 1000), ("byte", 65_536)])
def test_written_ids_are_read_back(spark, tmp_path, planes, block):
    ship(spark)
    rows, docs = odd_docs(spark, [*odd_texts(), *SPECIAL])
    path = f"{tmp_path}/planes"
    token_planes.write_token_planes(docs, path, P.path("word_bpe_49k.json"), "words", 1, block, planes)
    got = token_planes.read_token_planes(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    want = Counter((i, (*x.tolist(), 1)) for (i, _), x in zip(rows, plain_ids("word_bpe_49k.json", [t for _, t in rows]), strict=True))
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], dtype="<u4").tolist())) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert spark.read.parquet(path).where("n_ids > 0").count() >= at // block


def test_ranges_of_ids_follow_one_another(spark, tmp_path):
    ship(spark)
    rows = [(i * 37 % 1009, f"text {i}") for i in range(1000)] + [(500, f"of a frequent id {i}") for i in range(700)] + [(None, f"no id {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        ranged = token_planes.in_ranges(docs, 100)
        parts = ranged.rdd.glom().collect()
        path = f"{tmp_path}/planes"
        token_planes.write_token_planes(docs, path, P.path("word_bpe_49k.json"), "words", 1, 64)
        got = token_planes.read_token_planes(spark, path).orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for p in parts for r in p]
    assert len(parts) == 12 and order == sorted(order) and Counter(map(tuple, (r for p in parts for r in p))) == Counter(rows)
    assert max(map(len, parts)) < 500 and sum(any(r["doc_id"] == 500 for r in p) for p in parts) > 3
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))


def test_no_documents(spark, tmp_path):
    ship(spark)
    token_planes.write_token_planes(empty(spark), f"{tmp_path}/none", P.path("word_bpe_49k.json"), "words", 1)
    assert token_planes.read_token_planes(spark, f"{tmp_path}/none").count() == 0
    assert packing.pack(empty(spark), P.path("byte_bpe_50k.json"), "spaced").count() == 0
    assert bpe.digests(empty(spark), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_hilbert_neighbours_touch():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = packing.hilbert_keys(grid, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_packing_places_each_id_once(spark):
    ship(spark)
    rows, docs = odd_docs(spark, [*odd_texts(), *SPECIAL])
    got = packing.pack(docs, P.path("byte_bpe_50k.json"), "ranks", length=64).collect()
    want = Counter((i, (*x.tolist(), 0)) for (i, _), x in zip(rows, plain_ids("byte_bpe_50k.json", [t for _, t in rows]), strict=True))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["length"] > 0
    order = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    docs_back, held = Counter(), b""
    for r in order:  # a document's pieces follow one another
        held += r["ids"]
        if len(held) == 4 * r["doc_tokens"]:
            docs_back[r["doc_id"], tuple(np.frombuffer(held, dtype="<u4").tolist())] += 1
            held = b""
    assert docs_back == want
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64 and at & (at - 1) == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(100, 40), (256, 64), (32_768, 512)])
def test_stitched_chunks_equal_the_library(spark, chunk, overlap):
    ship(spark)
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows, docs = odd_docs(spark)
    want = Counter()
    for i, t in rows:
        x = enc.encode_ordinary(t or "")
        want[i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = bpe.digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, chunk=chunk, overlap=overlap)
    assert Counter(map(tuple, got.drop("n_pieces").collect())) == want
    if chunk == 100:
        assert got.where("n_pieces > 1").count() > 5
