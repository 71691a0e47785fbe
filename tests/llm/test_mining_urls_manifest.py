"""Hard negatives, URL filters and the Merkle manifest against their SQL and plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from framelode.llm import hard_negatives as H
from framelode.llm import merkle, queries, url_filter

from ..oracle import compare, connect
from .helpers import empty, odd_docs


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_url_filter", "op13_merkle"])
def test_query_equals_its_sql(spark, name, sf):
    assert compare(spark, connect(sf), queries.QUERIES[name], queries.ORACLES[name], sf) == ""


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    """Of rows (id, label, vector), by comparing everything with everything."""
    fine = []
    for n, (i, label, v) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((n, i, label, [math.floor(256 * x) for x in v]))
    out = []
    for a in (r for r in fine if is_anchor(r[1])):
        scored = [(-max(-H.MOST, min(H.MOST, sum(x * y for x, y in zip(a[3], b[3], strict=True)))), b[1], b[0], b[2]) for b in fine if b[0] != a[0] and len(b[3]) == len(a[3])]
        for s, p, _, _ in sorted(x for x in scored if x[3] == a[2])[:positives]:
            window = [(t, i) for t, i, _, label in sorted(scored) if label != a[2] and low * -s <= 100 * -t <= high * -s]
            out += [(a[1], p, k + 1, i, -s, -t) for k, (t, i) in enumerate(window[:negatives])]
    return Counter(out)


def mined(df, **options):
    return Counter(map(tuple, H.hard_negatives(df, F.col("vec_id") % 5 == 0, **options).collect()))


def vectors_with_ties(n, seed=3):
    random.seed(seed)
    return [(i, random.choice([0, 0, 0, 1, 2]), [random.randint(-2, 6) / 8 for _ in range(6)]) for i in range(n)]


ODD_VECTORS = [
    (0, None, [0.5] * 6), (5, 1, None), (10, 1, [0.5, None, 0.5, 0.5, 0.5, 0.5]), (15, 1, [float("nan")] * 6), (20, 2, [float("inf")] * 6), (None, 1, [0.5] * 6),
    (25, 1, []), (26, 2, []), (30, 1, [0.5, 0.5]), (31, 1, [0.75, 0.5]), (32, 2, [0.5, 0.25]), (35, 1, [0.0] * 6), (40, 0, [1e30] * 6), (41, 0, [3e10] * 6), (42, 1, [1.5e10] * 6), (5, 0, [0.5] * 6), (5, 0, [0.5] * 6), (7, 2, [0.25] * 6),
]
VECTORS = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize(("anchors", "part"), [(16_384, 8_192), (7, 16)])
def test_negatives_equal_a_plain_version(spark, monkeypatch, anchors, part):
    monkeypatch.setattr(H, "ANCHORS", anchors)
    monkeypatch.setattr(H, "ROWS", part)
    rows = vectors_with_ties(120) + ODD_VECTORS
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    want = plain_negatives(rows, lambda i: i % 5 == 0)
    assert len(want) > 200 and mined(df.withColumns({"row": F.lit(1), "anchor": F.lit("x"), "dim": F.lit(2), "score": F.lit(0)})) == want


def test_wide_and_narrow_windows(spark):
    rows = vectors_with_ties(90, 8)
    df = spark.createDataFrame(rows, VECTORS)
    for n, k, low, high in ((1, 1, 50, 95), (30, 10, 0, 100), (8, 4, 90, 91)):
        assert mined(df, n_positives=n, n_negatives=k, low=low, high=high) == plain_negatives(rows, lambda i: i % 5 == 0, n, k, low, high)


def test_no_rows_no_negatives(spark):
    none = spark.createDataFrame([], VECTORS)
    assert not mined(none) and not mined(spark.createDataFrame([(3, 1, [1.0])], VECTORS)) and not mined(spark.createDataFrame([(5, 1, [1.0])], VECTORS))


def test_scores_are_exact(spark):
    big = [(0, 1, [2.0**20 + 1, 1.0]), (1, 1, [2.0**20 + 1, 3.0]), (2, 2, [2.0**20 - 3, 1.0]), (3, 2, [2.0**19 + 5, 2.0])]
    assert mined(spark.createDataFrame(big, VECTORS)) == plain_negatives(big, lambda i: i % 5 == 0)


# ---------------------------------------------------------------- URL filters


def plain_judgement(url, rules, otherwise="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else otherwise


URLS = [
    None, "", "example.net/en/", "http://example.net/en/1", "HTTP://WWW.Example.NET/en/1?x#y", "https://example.net/en", "https://example.net/EN/1", "http://notexample.net/en/2", "http://net", "http://net/", "http://x.net?q=/en/", "http://x.net#/a", "a://b://net/c",
    "http://a.example.com/de/../x", "http://org/fr/", "http://org.uk/fr/", "http://w.org/fr/x", "http://w.org/fr", "http://x.net:80/a", "http://u@x.net/a", "http://x.net./a", "http://.net/a", "http://..net/a", "http:///net/", "://", "http://É.net/É", "http://İ.NET/x\n/y", "http://x.net\n/a", " http://x.net/a",
    "http://" + "a." * 20_000 + "net/" + "x/" * 500_000, "http://x.net/" + "é" * 100_000, "http://" + "." * 50_000,
]


@pytest.mark.parametrize("sent", [url_filter.SENT, 0])
def test_judgements_equal_a_plain_version(spark, sent):
    random.seed(4)
    labels, parts = ["a", "b", "net", "org", "example"], ["", "/", "/a", "/a/", "/a/b", "/b/", "/en/", "/en/1"]
    rules = {(".".join(random.choices(labels, k=random.randint(1, 3))), random.choice(parts)): random.choice(["allow", "block"]) for _ in range(80)}
    rules = [(h, p, v) for (h, p), v in rules.items()] + [r for r in url_filter.RULES if r[:2] not in rules]
    urls = URLS + ["http://" + ".".join(random.choices([*labels, "X"], k=random.randint(1, 5))) + random.choice(parts) + random.choice(["", "1", "/c", "?a", "#b"]) for _ in range(400)]
    urls += ["http://w.example.net/en/1"] * 300  # a URL that many rows have
    more = [(None, "/", "block"), ("net", None, "block"), ("a", "no-slash", "block"), ("b", "/", "perhaps")]
    pages = spark.createDataFrame([(i if i % 50 else None, u, 1, "h") for i, u in enumerate(urls)], "page_id long, url string, row int, host string").repartition(3)
    got = url_filter.judged(pages, spark.createDataFrame(rules + more, "host string, path string, verdict string"), "block", sent)
    want = Counter((i if i % 50 else None, *plain_judgement(u, rules, "block")) for i, u in enumerate(urls))
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("sent", [url_filter.SENT, 0])
def test_rules_and_tables_without_rows(spark, sent):
    rules = spark.createDataFrame([("a", "/", "block"), ("a", "/", "allow"), ("b.a", "", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "x://a/"), (2, "x://b.a/"), (3, "x://b.a"), (4, "x://A")], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judged(pages, rules, sent=sent).collect()} == {1: ("a/", "block"), 2: ("b.a", "allow"), 3: ("b.a", "allow"), 4: (None, "allow")}
    assert url_filter.judged(pages.limit(0), rules, sent=sent).count() == 0
    assert {r["verdict"] for r in url_filter.judged(pages, rules.limit(0), sent=sent).collect()} == {"allow"}


def test_short_digests_that_meet_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHORT", 1)
    urls = [f"http://h{i}.x/p" for i in range(200)]
    rules = [(f"h{i}.x", "/", "block") for i in range(0, 200, 3)]
    for sent in (url_filter.SENT, 0):
        got = url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), sent=sent)
        assert {r["page_id"]: r["verdict"] for r in got.collect()} == {i: "allow" if i % 3 else "block" for i in range(200)}


# ---------------------------------------------------------------- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves):
    """The last digest, and for each leaf its siblings' digests on either side in each level."""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for k, i in enumerate(at):
            run = leaves[i // 16 * 16 : i // 16 * 16 + 16]
            paths[k].append((run[: i % 16], run[i % 16 + 1 :]))
        leaves, at = [sha(*leaves[i : i + 16]) for i in range(0, len(leaves), 16)], [i // 16 for i in at]
    return leaves[0], paths


def plain_manifest(rows):
    by, out = defaultdict(list), []
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, upper = plain_tree([trees[s][0] for s in names])
    for s, above in zip(names, upper, strict=True):
        for (_, _, leaf, r), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = plain_leaf(*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for left, right in path + above:
                node = sha(*left, node, *right)
            out.append((r[0], leaf, trees[s][0], root, sha(*(x for left, right in path + above for x in left + right)), node, node == root))
    return Counter(out)


def manifest_of(spark, monkeypatch, docs):
    monkeypatch.setattr(merkle, "table", lambda *_: docs)
    return Counter(map(tuple, merkle.op13_merkle(spark, "").collect()))


DOC_COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest_equals_a_plain_version(spark, monkeypatch):
    # a source of more than a block, sources of one leaf, one run and a leaf more; names that order by bytes
    sizes = {"hot": 4096 + 17, "one": 1, None: 16, "": 17, "\U0001f600": 3, "\uffff": 2, "é": 257} | {f"s{i}": 1 for i in range(20)}
    rows, n = [], 0
    for s, size in sizes.items():
        for _ in range(size):
            n = (n * 7919 + 13) % 1_000_003
            rows.append((n, s, "en" if n % 3 else None, n % 50 if n % 7 else None, f"Text {n} É" if n % 4 else None))
    rows += [(None, "hot", None, None, "no id"), (None, "hot", None, None, None), (rows[0][0], "hot", "en", 1, "a second text of the id"), rows[5], rows[5], (77, "one", "", 0, ""), (-5, "é", "de", 1, "LONG " * 200_000)]
    docs = spark.createDataFrame(rows, DOC_COLUMNS).repartition(5).withColumns({"grp": F.lit(1), "at": F.lit(2), "x": F.lit("k"), "key": F.lit(0)})
    assert manifest_of(spark, monkeypatch, docs) == plain_manifest(rows)


def test_small_manifests(spark, monkeypatch):
    one = [(3, None, None, None, "A")]
    assert manifest_of(spark, monkeypatch, spark.createDataFrame(one, DOC_COLUMNS)) == plain_manifest(one)
    assert not manifest_of(spark, monkeypatch, empty(spark))
    _, docs = odd_docs(spark)
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    assert manifest_of(spark, monkeypatch, docs) == plain_manifest(rows)


def test_more_groups_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "_BLOCK", 16)
    rows = [(i, f"s{i % 40 if i % 3 else 0}", "en", i, f"Words {i}") for i in range(900)]
    assert manifest_of(spark, monkeypatch, spark.createDataFrame(rows, DOC_COLUMNS)) == plain_manifest(rows)
