"""Every registered query of the subpackage, the pipeline on odd tables, and very long texts."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from framelode.llm import bpe, packing, pii, quality, queries, sharding, simhash, token_planes, toxicity
from framelode.llm.common import ship, table

from .helpers import empty, odd_docs
from .test_near import plain_fingerprint
from .test_text_models import plain_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def results(spark):
    return {}


def run(spark, results, name):
    if name not in results:
        results[name] = queries.QUERIES[name](spark, SF).collect()
    return results[name]


def test_every_query_has_a_test():
    assert set(queries.QUERIES) == {"op1_quality", "op2_embedding_dedup", "op3_simhash", "op4_token_planes", "op5_sampled_splitters", "op6_toxicity", "op7_learned_partitions", "op8_curve_packing", "op9_pii", "op10_byte_bpe", "op11_hard_negatives", "op12_url_filter", "op13_merkle"}


@pytest.mark.parametrize("name", ["op1_quality", "op3_simhash", "op4_token_planes", "op5_sampled_splitters", "op6_toxicity", "op9_pii", "op10_byte_bpe"])
def test_a_row_for_each_document(spark, results, texts, name):
    assert Counter(r["doc_id"] for r in run(spark, results, name)) == Counter(dict.fromkeys(texts, 1))


def test_quality_equals_a_plain_version(spark, results, texts):
    docs = table(spark, SF, "documents")
    weights, found = quality.fit(docs)
    counts = Counter(map(quality.votes, texts.values()))
    assert set(found["patterns"]) == set(counts)
    # expectation-maximisation, a document at a time
    right, share = {}, 0.5
    good = {p: 0.1 if any(p // 3**k % 3 == 1 for k in range(7)) else 0.95 for p in counts}
    for _ in range(500):
        for k in range(7):
            voted = [(p, p // 3**k % 3) for p in texts_patterns(texts)]
            on_bad = [(1 - good[p], v) for p, v in voted if v]
            on_good = [(good[p], v) for p, v in voted if v]
            right[0, k] = min(0.9995, max(0.01, (sum(w for w, v in on_bad if v == 1) + 1) / (sum(w for w, _ in on_bad) + 2)))
            right[1, k] = min(0.9995, max(0.01, (sum(w for w, v in on_good if v == 2) + 9) / (sum(w for w, _ in on_good) + 10)))
        share = min(0.98, max(0.05, (sum(good[p] for p in texts_patterns(texts)) + 8) / (len(texts) + 10)))
        before = dict(good)
        for p in counts:
            a, b = share, 1 - share
            for k in range(7):
                v = p // 3**k % 3
                a *= 1 if v == 0 else right[1, k] if v == 2 else 1 - right[1, k]
                b *= 1 if v == 0 else right[0, k] if v == 1 else 1 - right[0, k]
            good[p] = a / (a + b)
        if max(abs(good[p] - before[p]) for p in counts) < 1e-12:
            break
    assert all(abs(good[p] - found["patterns"][p]) < 1e-6 for p in counts)
    scores = {r["doc_id"]: (r["score"], r["kept"]) for r in run(spark, results, "op1_quality")}
    for i, t in texts.items():
        z = float(quality.features(t) @ weights[:-1] + weights[-1])
        assert abs(scores[i][0] - 1 / (1 + np.exp(-z))) < 1e-9 and scores[i][1] == (scores[i][0] >= 0.3)


def texts_patterns(texts, known={}):  # noqa: B006
    if id(texts) not in known:
        known[id(texts)] = [quality.votes(t) for t in texts.values()]
    return known[id(texts)]


def test_simhash_equals_a_plain_version(spark, results, texts):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in run(spark, results, "op3_simhash")}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    name = {i: i for i in fps}
    for _ in range(20):
        for a in fps:
            name[a] = min(name[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= 3)
    assert got == {i: (fps[i], name[i]) for i in fps}


def test_token_planes_equal_the_library(spark, results, texts):
    tok, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, results, "op4_token_planes")}
    for i in sorted(texts):
        ids = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 1], dtype="<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_shards_follow_their_law(spark, results, texts):
    slots, sizes = defaultdict(list), Counter()
    for r in run(spark, results, "op5_sampled_splitters"):
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * (max(len(t.encode()) for t in texts.values()) + 1)


def test_toxicity_never_learns_from_held_out_rows(spark, results):
    for r in run(spark, results, "op6_toxicity"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_neighbours_by_brute_force(spark, sf):
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in table(spark, sf, "embeddings").collect()}
    ids, m = np.array(sorted(rows)), np.stack([rows[i] for i in sorted(rows)])
    found = defaultdict(dict)
    for r in queries.QUERIES["op7_learned_partitions"](spark, sf).collect():
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == {i for i in rows if i % 100 == 0}
    hits = 0
    for q, near in found.items():
        d = np.sqrt(((m - rows[q]) ** 2).sum(axis=1))
        assert sorted(near) == list(range(1, 11)) and all(s == d[np.searchsorted(ids, v)] for v, s in near.values())
        d[ids == q] = np.inf
        hits += len({v for v, _ in near.values()} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(found)


def test_packing_equals_the_library(spark, results, texts):
    tok, pieces, sequences = Tokenizer.from_file(P.path("byte_bpe_50k.json")), defaultdict(list), defaultdict(list)
    for r in run(spark, results, "op8_curve_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids, at = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    held = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        held += at if at & (at - 1) == 0 else 1024
    assert held <= 1.02 * sum(r["length"] for p in pieces.values() for r in p)


def test_pii_base_equals_the_patterns(spark, results, texts):
    kinds = ("email", "ip", "card", "phone")
    for r in run(spark, results, "op9_pii"):
        base = plain_spans(texts[r["doc_id"]])
        n = Counter(k for _, k, _ in base)
        named = [f"{kinds[k]}:{s}:{e}" for s, k, e in base]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(n[k] for k in range(4))
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r["spans"].split(",")) | {""}


def tiktoken_plain():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(spark, results, texts):
    enc = tiktoken_plain()
    for r in run(spark, results, "op10_byte_bpe"):
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


LONG = ["one two three four five six " * 40_000, "x" * 1_000_000, "é中 don't 12.5, " * 70_000, "4111 1111 1111 1111 " * 50_000]


def test_texts_of_a_million_characters(spark, tmp_path):
    ship(spark)
    rows, docs = odd_docs(spark, [*LONG, LONG[0], "short", None])
    plain = {i: t or "" for i, t in rows if i is not None and (i, t) != (0, "") and t != "another row of id seven"}
    weights, _ = quality.fit(docs)
    assert quality.quality_scores(docs, weights).count() == len(rows)
    fps = {r["doc_id"]: r["fp"] for r in simhash.simhash_components(docs).collect() if r["doc_id"] in plain}
    assert all(int(np.int64(fps[i]).view(np.uint64)) == plain_fingerprint(plain[i]) for i in (0, 1, 5))
    assert {r["doc_id"] for r in simhash.without_near_duplicates(docs).collect()} == {None, 0, 1, 2, 3, 5, 6, 7}
    path, tok = f"{tmp_path}/planes", Tokenizer.from_file(P.path("word_bpe_49k.json"))
    token_planes.write_token_planes(docs, path, P.path("word_bpe_49k.json"), "words", 1)
    back = {r["doc_id"]: r["ids"] for r in token_planes.read_token_planes(spark, path).collect()}
    assert all(np.frombuffer(back[i], dtype="<u4").tolist() == [*tok.encode(plain[i], add_special_tokens=False).ids, 1] for i in (1, 2, 3))
    assert sharding.assign_shards(docs).count() == len(rows)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(docs, toxicity.fit(toxicity.training_rows(docs, labels))).where("score between 0 and 1").count() == len(rows)
    pieces, byte_tok = packing.pack(docs, P.path("byte_bpe_50k.json"), "ranks").collect(), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i in (1, 2, 3):
        ids = b"".join(r["ids"] for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"]))
        assert np.frombuffer(ids, dtype="<u4").tolist() == [*byte_tok.encode(plain[i], add_special_tokens=False).ids, 0]
    spans = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert spans[0]["spans"] == spans[1]["spans"] == "" and spans[3]["n_card"] == sum(k == 2 for _, k, _ in plain_spans(plain[3]))  # the plain version would take hours for the other
    enc, decoded = tiktoken_plain(), {r["doc_id"]: r for r in bpe.digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    for i in range(4):
        assert decoded[i]["n_tokens"] == len(enc.encode_ordinary(plain[i])) and decoded[i]["decoded_sha256"] == hashlib.sha256(plain[i].encode()).hexdigest()
    assert decoded[0]["n_pieces"] > 1 and decoded[2]["n_pieces"] > 1


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_on_odd_tables(spark, tmp_path, kind):
    ship(spark)
    rows, docs = odd_docs(spark)
    docs = docs if kind == "odd" else empty(spark)
    docs = docs.selectExpr("*", "1 as score", "2 as _text0", "3 as _score0", "4 as _id0", "5 as toxic", "6 as fold", "7 as bucket", "8 as text_key", "9 as bands")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    whole = docs.union(docs.where("doc_id in (3, 4)"))  # repeated rows
    for name, stage in corpus_pipeline.STAGES:
        before = whole
        stage(spark, whole, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        whole = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert whole.columns == before.columns
        if name == "near_duplicates":
            assert whole.groupBy("doc_id", "text").count().where("count > 1 and doc_id is not null").isEmpty()
    assert (whole.count() > 0) == (kind == "odd")


def test_shards_are_written_in_slot_order(spark, tmp_path):
    rows, docs = odd_docs(spark)
    assigned = sharding.assign_shards(docs, 3, carry=("text", "row"))
    sharding.write_shards(assigned, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(rows)
    for shard in range(3):
        files = sorted((tmp_path / "shards" / f"shard={shard}").glob("part-*.parquet"))
        slots = [r["slot"] for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots))) and slots
