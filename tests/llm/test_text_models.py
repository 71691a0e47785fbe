import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from framelode.llm import pii, quality, sharding, toxicity
from framelode.llm.common import ship, table

from .helpers import empty, odd_docs

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, kind in enumerate(PLAIN):
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            odd = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and odd % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def pii_texts():
    rng = random.Random(9)
    alphabet = ["1", "2", "5", "0", "255", "256", "4111 1111 1111 1111", "4111111111111111", ".", ".", "-", " ", "+", "+1 (555) 123-4567", "(", ")", "@", "a@b.co", "x.y", "@c-d.e", "_", "%", "é", "word ", "/", "001", "\n"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["", "1" * 5000, "1." * 4000, "+(" * 3000, "a@" * 3000, "1 " * 3000 + "x"]


def test_base_spans_equal_the_patterns():
    for t in pii_texts():
        assert pii.base_spans(t, pii.areas_of(t)) == plain_spans(t), t


def test_pii_of_odd_documents(spark):
    ship(spark)
    texts = [None, *pii_texts()[:200]]
    rows, docs = odd_docs(spark, texts)
    got = Counter(tuple(r) for r in pii.find_pii(docs).drop("spans", "redacted").collect())
    want = Counter()
    for i, t in rows:
        spans = plain_spans(t or "")
        n = Counter(k for _, k, _ in spans)
        want[i, n[0], n[1], n[2], n[3], hashlib.sha256(",".join(f"{list(PLAIN)[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()] += 1
    assert got == want
    assert pii.find_pii(empty(spark)).count() == 0


def test_trees_find_rewritten_spans_and_leave_others(spark):
    ship(spark)
    rng = random.Random(2)

    def card():
        d = [rng.randrange(10) for _ in range(15)]
        body = "4" + "".join(map(str, d[:14]))
        return next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))

    texts = []
    for _ in range(400):
        texts += [f"pay by card {card()} now", f"call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} soon", f"order {rng.randint(10**13, 10**14)} shipped on 2024.01.{rng.randint(10, 28)}", f"mail bob{rng.randrange(99)}@mail.example.com today", "version 2.0 of the thing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trees = pii.fit(docs)
    number = card()
    veiled = f"my card {'/'.join(number[i : i + 4] for i in range(0, 16, 4))} is new and bob7 (at) mail.example.com is me"
    (base, spans), (_, clean) = pii.all_spans([veiled, "order 12345678901234 of 10/10/2024 10:30, room 5 4 3"], trees)
    assert not base and {k for _, k, _ in spans} == {0, 2} and not clean
    assert "4" not in pii.redacted(veiled, spans) and "[CARD]" in pii.redacted(veiled, spans)
    out = pii.redact(docs.selectExpr("*", "length(text) as n_chars"), trees)
    assert out.columns == ["doc_id", "text", "n_chars"] and out.where("n_chars <> length(text)").isEmpty()
    assert out.where("text rlike '@|4[0-9]{15}|555-'").isEmpty()


def test_every_generator_adds_spans_and_the_layout_changes_nothing(spark):
    ship(spark)
    rng = random.Random(12)
    texts = [t for i in range(400) for t in (f"the server at {rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)} is up", f"write to bob{i}@mail.example.com soon", f"version {rng.randint(256, 999)}.2.0.1 of it at 10:20:{rng.randint(10, 59)}", f"call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} soon")]
    texts += [f"host 2001:0db8:85a3:0:0:8a2e:{rng.randrange(1 << 16):04x}:{rng.randrange(1 << 16):04x} answers" for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, other = pii.fit(docs.coalesce(1)), pii.fit(docs.repartition(7))
    for name in ("feature", "cut", "leaf", "threshold"):
        assert np.array_equal(getattr(one, name), getattr(other, name)), name
    spans = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs, one).collect()}
    assert all(spans[i].startswith("ip:5:") for i in range(1600, 1700))
    ((_, got),) = pii.all_spans(["my address is bob7 (at) mail.example.com or 0044 (555) 123-4567 now, disk 00:25:90:11:12:13:14:15"], one)
    assert [k for _, k, _ in got] == [0, 3]


def test_numbers_beside_others_are_proposed_and_found(spark):
    ship(spark)
    rng = random.Random(4)

    def card():
        body = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
        return next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))

    def proposed(text):
        return {(k, text[s:e]) for s, k, e in pii.proposals(text, pii.areas_of(text))}

    assert (3, "0049 30 1234567") in proposed("Room 12 / 0049 30 1234567")
    assert (3, "0049 30 1234567") in proposed("on 2024-01-05 0049 30 1234567 (2)")
    cards = [card() for _ in range(8)]
    row = " ".join(cards)
    assert {(2, c) for c in cards} <= proposed(row) and len(row) > 64
    assert len(proposed("1 " * 3000 + "x")) <= 20 and len(pii.proposals("1 " * 3000, [(0, 5999)])) <= 20 * 3000
    texts = [t for _ in range(400) for t in (f"pay by card {card()} now", f"order {rng.randint(10**13, 10**14)} shipped on 2024.01.{rng.randint(10, 28)}")]
    trees = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    ((base, spans),) = pii.all_spans([f"pay by card {row} now"], trees)
    assert not base and not any(c in pii.redacted(f"pay by card {row} now", spans) for c in cards)


def test_shards_follow_the_bytes(spark):
    rng = random.Random(3)
    texts = ["copy of a text"] * 2000 + [""] * 1500 + [None] * 100 + ["x" * rng.randint(1, 4000) + str(i) for i in range(1500)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, 1, 1, 1) for i, t in enumerate(texts)], "doc_id long, text string, size int, range int, shard int").repartition(5)
    got = sharding.assign_shards(docs, rows_per_range=200).collect()
    assert len(got) == len(texts)
    by = {}
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(8))
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    sizes = [sum(r["size"] for r in rows) for rows in by.values()]
    assert max(sizes) - min(sizes) <= 2 * 4100
    rows, odd = odd_docs(spark)
    assert Counter(r["doc_id"] for r in sharding.assign_shards(odd).collect()) == Counter(i for i, _ in rows)
    assert sharding.assign_shards(empty(spark)).count() == 0


def test_shards_split_rows_equal_in_text_and_id(spark):
    rows = [(None, "hot text", i) for i in range(3000)] + [(7, "hot too", i) for i in range(2000)] + [(i, f"text {i}", i) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(4)
    got = sharding.assign_shards(docs, rows_per_range=100, carry=("size",)).collect()
    assert sorted(r["carried_size"] for r in got) == sorted(r[2] for r in rows)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * 9
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in sizes)


def test_ranges_do_not_grow_beyond_their_bound(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST", 16)
    seen = []
    real = sharding.splitters
    monkeypatch.setattr(sharding, "splitters", lambda *a: seen.append(real(*a)) or seen[-1])
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('text ', id) as text")
    assert sharding.assign_shards(docs, rows_per_range=10).count() == 20_000 and len(seen[0]) <= 3 * 16


def test_ranges_split_equal_hashes_by_id():
    bounds = np.array([(5, 10), (5, 20), (9, 0)], dtype=np.int64)
    got = sharding.ranges_of(np.array([4, 5, 5, 5, 5, 9, 10]), np.array([99, 9, 10, 15, 20, -1, 0]), bounds)
    assert got.tolist() == [0, 0, 1, 1, 2, 2, 3]


@pytest.fixture(scope="module")
def labelled():
    return "/root/testdata/sf0.1"


def test_toxicity_on_held_out_rows(spark, labelled):
    got = toxicity.op6_toxicity(spark, labelled).join(table(spark, labelled, "labels"), "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    hit = sum(r["toxic"] and r["predicted"] for r in got)
    assert hit >= 0.99 * sum(r["predicted"] for r in got)
    assert hit >= 0.85 * sum(r["toxic"] for r in got)  # a tenth of the toxic labels are of texts without a toxic word


def test_toxicity_of_odd_documents(spark):
    ship(spark)
    rows, docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, None), (None, 1, 1), (999, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    got = toxicity.toxicity_scores(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.fit(toxicity.training_rows(docs, labels.limit(0)))
    assert toxicity.toxicity_scores(docs, none).where("score >= 0.7").count() == 0
    assert toxicity.without_toxic(empty(spark), model).columns == docs.columns


def plain_ratios(said, text):
    """Log-likelihood ratios of a text's words by the definition, from texts (text, toxic) and Python counts."""
    words, pairs = ([Counter() for _ in range(2)] for _ in range(2))
    for x, t in said:
        w = ["<s>", *re.findall(r"\w+", x.lower())]
        words[t].update(set(w[1:]))
        pairs[t].update(set(zip(w, w[1:])))
    sizes = [sum(w.values()) + 0.5 for w in words]
    share = [n / sum(sizes) for n in sizes]
    kinds = len(words[0] + words[1])
    every = sum(len(p) for p in pairs) + 0.5 * toxicity.SPAN  # a word number has half a kind of pair more
    out, w = [], ["<s>", *re.findall(r"\w+", text.lower())]
    for one, two in zip(w, w[1:]):
        continues = (sum(b == two for p in pairs for _, b in p) + 0.5) / every
        back = 10 + 0.75 * kinds * continues
        held = [max(x[two] - 0.75, 0) for x in words]
        alone = [(n / s + back) / (sum(held) + back) for n, s in zip(held, share)]
        before = [sum(n for (a, _), n in p.items() if a == one) + 10 * s for p, s in zip(pairs, share)]
        after = 10 + 0.75 * sum(a == one for p in pairs for a, _ in p) * continues
        chance = [max(p[one, two] - 0.75, 0) * sum(before) / c + after * u for p, c, u in zip(pairs, before, alone)]
        out.append(math.log(chance[1] / chance[0]))
    return out


def test_kneser_ney_equals_its_definition(spark):
    ship(spark)
    rng = random.Random(8)
    said = [("you stupid fool", 1), ("a nice day", 0), ("a nice walk", 0), ("stupid fool again", 1), ("a day again", 0)] * 6
    said += [(" ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(30))), rng.randrange(2)) for _ in range(200)]
    rows = spark.createDataFrame([(i, i % 2, t, x) for i, (x, t) in enumerate(said)], "doc_id long, fold int, toxic int, text string")
    model, words = toxicity.fit(rows), toxicity.Words()
    for text in ["stupid fool", "a nice walk", "unheard words", "stupid again a w3", *(x for x, _ in said[30:60] if x)]:
        two = words.numbers(text)
        got = model.ratios(np.concatenate([[toxicity.START], two[:-1]]), two)
        assert np.allclose(got, plain_ratios(said, text), atol=1e-3), text
    e = model.evidence([words.numbers(t) for t in ("you stupid fool", "a nice walk", "", "unheard words", "fool fool fool")])
    assert e[0, 0] > 0.3 and e[1, 0] < -0.3 and e[2].tolist() == [0, 0] and np.allclose(e[3], 0, atol=1e-6) and e[4, 0] > 0


def test_rare_toxic_expressions_count_beside_many_commoner_ones(spark):
    ship(spark)
    rows = [(f"w{i % 60} x{i % 60} again", i % 2) for i in range(3000)] + [("vile wretch", 1)] * 20 + [("mean cur", 1)] * 2
    model, words = toxicity.fit(spark.createDataFrame([(i, i // 2 % 2, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, fold int, toxic int, text string")), toxicity.Words()
    often, twice, common, unheard = model.evidence([words.numbers(t) for t in ("vile wretch", "mean cur", "w1 x1", "zig zag")])[:, 0]
    assert often > 0.3 and often > twice > 0 and abs(unheard) < 1e-6


def test_counts_in_one_cell_are_bound_by_their_words(spark):
    ship(spark)
    rows = [(f"w{i % 60} x{i % 60} again", 0) for i in range(600)] + [("vile wretch", 1)] * 20
    rows = spark.createDataFrame([(i, i // 2 % 2, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, fold int, toxic int, text string")
    model, words = toxicity.fit(rows, cells=1), toxicity.Words()  # all pairs in one, as in a corpus with far more pairs than cells
    toxic, ordinary = model.evidence([words.numbers(t) for t in ("vile wretch", "w1 x1 again")])[:, 0]
    assert toxic > 0.3 and ordinary < 0


def test_quality_agrees_with_labels_it_never_saw(spark, labelled):
    docs = table(spark, labelled, "documents")
    weights, found = quality.fit(docs)
    got = quality.quality_scores(docs, weights).join(table(spark, labelled, "labels"), "doc_id").select("quality", "kept").collect()
    good, bad = ([r["kept"] for r in got if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.995 * len(good)
    assert len(bad) - sum(bad) >= 0.9 * len(bad)
    assert found["share_good"] > 0.5


def test_quality_reads_whole_texts_and_words():
    row = "LOUD calm calm calm "  # a stride of four would see the first column only
    assert quality.votes(row * 400) // 3 % 3 == 2
    assert quality.votes(("calm LOUD LOUD LOUD " * 400)) // 3 % 3 == 1
    assert quality.word_features("9" + "a" * 70 + "|B")[0] != quality.word_features("9" + "a" * 70)[0]
    assert quality.word_features("9-" * 40)[0] != quality.word_features("9-" * 40 + "|")[0]


def test_expectation_maximisation_recovers_accuracies():
    rng, n = np.random.default_rng(0), 20_000
    right = np.array([0.95, 0.9, 0.7, 0.85, 0.9, 0.6, 0.8])
    good = rng.random(n) < 0.7
    vote = np.where(rng.random((n, 7)) < right, good[:, None], ~good[:, None])
    voted = np.where(rng.random((n, 7)) < 0.8, np.where(vote, 2, 1), 0)
    patterns, counts = np.unique(voted @ 3 ** np.arange(7), return_counts=True)
    p, accuracy, share = quality.posterior(patterns, counts)
    assert np.abs(accuracy - right).max() < 0.05 and abs(share - 0.7) < 0.03
    assert p.min() >= 0 and p.max() <= 1


def test_quality_of_odd_documents(spark):
    rows, docs = odd_docs(spark)
    weights, _ = quality.fit(docs)
    got = quality.quality_scores(docs, weights).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert all(math.isfinite(r["score"]) for r in got)
    assert quality.good_only(docs, weights).columns == docs.columns
    none, _ = quality.fit(empty(spark))
    assert quality.quality_scores(empty(spark), none).count() == 0


def test_texts_without_a_label_are_left_out_before_the_shuffle(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(0, 2000, 10)] + [(5000, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels, toxicity.learnt_fold())
    wanted = {i for i in range(0, 2000, 10) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {r["doc_id"] for r in rows.collect()} == wanted
    likely = {r["doc_id"] for r in toxicity._likely(docs, labels).collect()}
    assert wanted <= likely and len(likely) <= 210


def test_the_driver_keeps_no_counts_beside_the_model(spark):
    import tracemalloc

    ship(spark)
    rows = spark.createDataFrame([(i, i % 2, i // 2 % 2, f"some words {i} of text {i % 7}") for i in range(60)], "doc_id long, fold int, toxic int, text string")
    tracemalloc.start()
    model = toxicity.fit(rows)
    left, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    one = 4 * (7 * toxicity.SPAN + 2 * toxicity.PAIRS)  # words, first words, followers, pairs of both classes and ends
    assert len(model.ends) == toxicity.SPAN and left < 1.2 * one
