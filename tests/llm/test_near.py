import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from framelode.llm import ann, common, embed_dedup, simhash
from framelode.llm.common import components, ship

from .helpers import empty, least_components, odd_docs


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 200)] + [(300, 300), (201, 202), (202, 201)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    links.remove((300, 300))
    want = least_components({n for e in links for n in e}, links)
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_few_edges_are_joined_in_a_job_or_two_and_more_in_rounds(spark, monkeypatch):
    rng = random.Random(4)
    links = [(rng.randrange(-3000, 3000), rng.randrange(-3000, 3000)) for _ in range(2500)] + [(i + 1, i) for i in range(9000, 9400)]
    edges = spark.createDataFrame(links, "u long, v long")
    want = least_components({n for u, v in links if u != v for n in (u, v)}, [e for e in links if e[0] != e[1]])
    spark.sparkContext.setJobGroup("few edges", "")
    got = components(edges).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")
    spark.sparkContext.setJobGroup("many edges", "")
    assert dict(map(tuple, got)) == want and len(got) == len(want)
    assert len(jobs) <= 8, "each round is a dozen jobs, which the driver plans and remembers"
    monkeypatch.setattr(common, "EDGES", 1000)
    assert dict(map(tuple, components(edges).collect())) == want


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_matches_the_definition():
    for t in (None, "", "One", "one two", "a b c d A B C", "the cat sat on the mat " * 50, "é x y z"):
        assert int(simhash.fingerprint(simhash.shingle_hashes(simhash.words_of(t), 3))) == plain_fingerprint(t)


@pytest.mark.parametrize("bits", [3, 8])
def test_index_loses_no_pair(spark, bits):
    ship(spark)
    rng = random.Random(bits)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(900):  # near ones, and a long run that shares its leading bits
        x = rng.choice(fps)
        fps.append(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, bits + 2))))
    fps += [(7 << 50) | rng.getrandbits(12) for _ in range(3000)]
    signed = sorted({int(np.uint64(x).view(np.int64)) for x in fps})
    x = np.array(signed, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x) <= bits
    links = [(signed[i], signed[j]) for i, j in np.argwhere(np.triu(near, 1))]
    want = least_components({n for e in links for n in e}, links)
    edges = simhash.near_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long"), bits)
    got = {r[0]: r[1] for r in components(edges).collect()}
    assert got == want
    assert edges.count() <= len(signed) * len(simhash.block_tables(bits)[0]) * 3


def test_simhash_components_of_odd_documents(spark):
    ship(spark)
    rows, docs = odd_docs(spark)
    got = Counter(map(tuple, simhash.simhash_components(docs).collect()))
    fps = {t: plain_fingerprint(t) for _, t in rows}
    least = {}
    for i, t in rows:
        if i is not None:
            least[fps[t]] = min(least.get(fps[t], i), i)
    distinct = list(set(fps.values()))
    links = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3]
    of = least_components(distinct, links)
    name = {}
    for f in distinct:
        if f in least:
            name[of[f]] = min(name.get(of[f], least[f]), least[f])
    assert got == Counter((i, int(np.uint64(fps[t]).view(np.int64)), name.get(of[fps[t]])) for i, t in rows)
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_one_document_of_each_near_duplicate_group_stays(spark):
    ship(spark)
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [[rng.choice(vocabulary) for _ in range(300)] for _ in range(20)]
    rows, near = [], []
    for k, words in enumerate(base):
        rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(words).upper() if k % 2 else " ".join(words)))
        near.append(rows[-1][0])
        changed = list(words)
        changed[rng.randrange(300)] = "other"
        rows.append((len(rows), "  ".join(changed)))
        near.append(rows[-1][0])
    rows += [(None, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    left = simhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    got = Counter(r["doc_id"] for r in left.collect())
    assert all(n == 1 for n in got.values()) and None in got
    kept = set(got) - {None}
    assert {i for i in range(len(rows) - 2) if i % 3 == 0} <= kept
    assert len(kept) <= 20 + 2  # one word of 300: similarity 0.967
    assert simhash.without_near_duplicates(spark.createDataFrame([], docs.schema)).count() == 0


def test_near_copies_with_replaced_and_appended_passages_go(spark):
    ship(spark)
    rng = random.Random(6)

    def some(n):
        return [f"w{rng.randrange(20_000)}" for _ in range(n)]

    def shingles(words):
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    rows, copies = [], []
    for k in range(240):
        words = some(300)
        at, n = rng.randrange(270), rng.randint(11, 28)
        other = words + some(rng.randint(33, 74)) if k % 2 else words[:at] + some(n) + words[at + n :]
        a, b = shingles(words), shingles(other)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        if len(a & b) >= 0.8 * len(a | b):
            copies.append(2 * k + 1)
    assert len(copies) > 200
    left = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - set(copies)


def test_one_id_of_several_texts_keeps_the_ones_that_are_no_copies(spark):
    ship(spark)
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (5, c), (2, c), (7, b), (7, b.upper()), (8, "one"), (8, "One"), (8, "one")]
    left = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r["doc_id"], r["text"].lower()) for r in left.collect())
    assert got == Counter([(3, a), (5, b), (2, c), (8, "one")])


def vector_rows():
    rng = np.random.default_rng(3)
    rows = []
    for g in range(6):
        centre = rng.standard_normal(16)
        for _ in range([1, 2, 40, 300, 5, 12][g]):
            v = centre + rng.standard_normal(16) * 0.11 * np.linalg.norm(centre) / 4
            rows.append((len(rows), [float(np.float32(x)) for x in v], g % 2))
    rows += [(len(rows) + i, rows[3][1], rows[3][2]) for i in range(60)]  # copies
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [1.0, None] * 8, 0), (n + 3, [float("nan")] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0)]
    return rows


def test_links_equal_brute_force(spark):
    ship(spark)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], "vec_id long, embedding array<float>, label int, id long, component string")
    ok = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], dtype=np.float64), np.array(b[1], dtype=np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((a[0], b[0]))
    degree = Counter(n for e in links for n in e)
    comp = least_components([r[0] for r in rows], links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.embedding_duplicates(df).collect()}
    assert got == {r[0]: (degree[r[0]], comp[r[0]], comp[r[0]] == r[0]) for r in rows}
    assert len(links) > 1000
    none = spark.createDataFrame([], df.schema)
    assert embed_dedup.embedding_duplicates(none).count() == 0


def test_pairs_in_a_dense_cone_are_found(spark):
    ship(spark)
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(64)
    m = centre / np.linalg.norm(centre) + rng.standard_normal((12_000, 64)) * 0.25 / 8
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    noise = rng.standard_normal((400, 64))
    noise -= (noise * m[:400]).sum(axis=1, keepdims=True) * m[:400]
    m[400:800] = 0.9805 * m[:400] + np.sqrt(1 - 0.9805**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    near = m @ m.T >= 0.98
    np.fill_diagonal(near, False)
    i, j = np.nonzero(np.triu(near))
    want = least_components(range(len(m)), zip(i.tolist(), j.tolist(), strict=True))
    df = spark.createDataFrame(list(enumerate(m.tolist())), "vec_id long, embedding array<double>").selectExpr("*", "1 as label")
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in embed_dedup.embedding_duplicates(df).collect()}
    assert 400 <= len(i) < 2000
    assert got == {k: (want[k], int(near[k].sum())) for k in range(len(m))}


def test_unusable_rows_of_an_id_that_is_also_usable_stay(spark):
    ship(spark)
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, None, 0), (2, [0.0, -0.0], 0), (2, [], 0), (2, [1.0, 0.0], None), (2, [1.0, None], 0), (1, [nan, 1.0], 0), (1, [1.0, -inf], 0), (None, [1.0, 0.0], 0), (3, [1.0, None], 0)]
    got = Counter(map(tuple, embed_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == Counter({(1, 1, 1, True): 1, (2, 1, 1, False): 1, (2, 0, 2, True): 5, (1, 0, 1, True): 2, (None, 0, None, True): 1, (3, 0, 3, True): 1})


def test_repeated_ids_and_extreme_norms_link_like_others(spark):
    ship(spark)
    rows = [(5, [1.0, 0.0], 0), (5, [1.0, 0.01], 0), (6, [2.0, 0.0], 0), (None, [1.0, 0.0], 0), (9, [0.0, 1.0], 0), (9, [0.0, 1.0], 0)]
    rows += [(20, [1e200, 1e200], 1), (21, [1e-200, 1e-200], 1), (22, [3.0, 3.1], 1), (23, [5e-324, 0.0], 1), (24, [1.7e308, 0.0], 1)]
    schema = "vec_id long, embedding array<double>, label int, n long, copy string, least long, part long"
    got = Counter(tuple(r) for r in embed_dedup.embedding_duplicates(spark.createDataFrame([(*r, 1, "c", 2, 3) for r in rows], schema)).collect())
    want = Counter({(5, 2, 5, True): 2, (6, 2, 5, False): 1, (None, 0, None, True): 1, (9, 1, 9, True): 2, (20, 2, 20, True): 1, (21, 2, 20, False): 1, (22, 2, 20, False): 1, (23, 1, 23, True): 1, (24, 1, 23, False): 1})
    assert got == want


@pytest.mark.parametrize("mean", [0.0, 0.8, 0.95])
def test_labels_of_20000_vectors_lose_no_link(spark, mean):
    ship(spark)
    rng = np.random.default_rng(11)
    n, centre = 20_000, np.zeros(64)
    centre[0] = 1.0
    m = rng.standard_normal((n, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m = np.sqrt(mean) * centre + np.sqrt(1 - mean) * m
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    side = rng.standard_normal((2000, 64))
    side -= (side * m[:2000]).sum(axis=1, keepdims=True) * m[:2000]
    m[2000:4000] = 0.981 * m[:2000] + np.sqrt(1 - 0.981**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    degree, links = np.zeros(n, dtype=int), []
    for at in range(0, n, 2000):
        near = m[at : at + 2000] @ m.T >= 0.98
        i, j = np.nonzero(near)
        other = i + at != j
        i, j = i[other] + at, j[other]
        degree += np.bincount(i, minlength=n)
        links += [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b]
    want = least_components(range(n), links)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(m.reshape(-1)), 64).cast(pa.list_(pa.float64()))})).selectExpr("*", "1 as label")
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in embed_dedup.embedding_duplicates(df).select("vec_id", "component_id", "n_links").collect()}
    assert got == {k: (want[k], int(degree[k])) for k in range(n)} and len(links) >= 2000


def test_sql_of_embedding_links_on_a_table_that_has_them(spark, tmp_path):
    ship(spark)
    import duckdb

    rows = [r for r in vector_rows() if r[1] != []]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/e")
    want = duckdb.connect()
    want.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = Counter(want.execute(embed_dedup.OP2_SQL).fetchall())
    got = Counter(tuple(r) for r in embed_dedup.embedding_duplicates(spark.read.parquet(f"{tmp_path}/e")).collect())
    assert got == want and sum(r[1] > 0 for r in got) > 300


def test_neighbours_in_the_order_are_compared_across_keys(spark):
    """Of vectors whose hashes differ, only the neighbour windows find the links."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    near = np.concatenate([base, base + 0.05 * rng.standard_normal(base.shape)])
    reps = spark.createDataFrame([(i, 0, 16, bytearray((v / np.linalg.norm(v)).astype("<f8").tobytes())) for i, v in enumerate(near)], "id long, grp long, dim int, vec binary").coalesce(1)
    edges = {tuple(sorted(e)) for e in embed_dedup.sorted_pass_edges(reps, 60, 2, 128, 0.98, 2).collect()}
    cosine = lambda u, v: near[u] @ near[v] / np.linalg.norm(near[u]) / np.linalg.norm(near[v])
    assert len(edges) >= 25 and all(cosine(u, v) >= 0.98 for u, v in edges)  # equal hashes alone give about two


def test_passes_grow_with_the_input():
    few, many = (embed_dedup.passes_for(n, 128, 0.98, 1e-4) for n in (1_000, 10_000_000))
    assert 4 <= few < many < 200


def test_neighbours_found(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    m = rng.standard_normal((3000, 16)).astype(np.float32)
    m[100:160] = m[99]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(m)] + [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [1.0], 0), (5300, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int")
    got = ann.nearest(df, df.where("vec_id % 100 = 0"), block=500, query_block=16).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert 5000 not in found and 5100 not in found and 5300 not in found and 5200 not in found
    hits = 0
    x = m.astype(np.float64)
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        order = np.lexsort((np.arange(3000), d))[:10]
        assert sorted(found[q]) == list(range(1, 11))
        for v, s in found[q].values():
            assert s == d[v]
        hits += len({v for v, _ in found[q].values()} & set(order.tolist()))
        if q == 100:
            assert [found[q][k][0] for k in range(1, 11)] == order.tolist()
    assert hits >= 0.9 * 300
    few = df.where("vec_id < 4")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 3
    none = spark.createDataFrame([], df.schema)
    assert ann.nearest(none, none).count() == 0


def recall_of(spark, m, **options):
    ids = np.arange(len(m)) * 10
    df = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": pa.array(m.tolist(), pa.list_(pa.float64()))}))
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0"), **options).collect():
        found.setdefault(r["query_id"], set()).add((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, len(m), 10):
        d = np.sqrt(((m - m[q]) ** 2).sum(axis=1))
        assert all(s == d[v // 10] for v, s in found[10 * q])
        d[q] = np.inf
        hits += len({v for v, _ in found[10 * q]} & set((10 * np.lexsort((ids, d))[:10]).tolist()))
    return hits / (len(m) // 10 * 10)


@pytest.mark.parametrize("kind", ["small", "clustered", "offset"])
def test_partitions_find_what_brute_force_finds(spark, kind):
    ship(spark)
    rng = np.random.default_rng(6)
    m = rng.standard_normal((500 if kind == "small" else 3000, 16))
    if kind == "clustered":
        m = 6 * rng.standard_normal((40, 16))[rng.integers(0, 40, len(m))] + m
    if kind == "offset":
        m = m + 1e8
    assert recall_of(spark, m) >= 0.9


def test_partitions_grow_with_the_rows():
    assert [ann.parts_for(n, min(n, 4096)) for n in (4, 8, 40, 500, 2000, 50_000, 10**9)] == [1, 2, 2, 16, 32, 128, 256]


def test_distances_of_extreme_vectors(spark):
    ship(spark)
    x = np.array([[1e200, 0.0], [3e200, 4e200], [1e-200, 0.0], [4e-200, 4e-200], [-1.7e308, 1e308], [1.7e308, 0.0]])
    assert np.allclose(ann.distances(x[:4] , x[0]), [0, np.hypot(2e200, 4e200), 1e200, 1e200], rtol=1e-15)
    assert np.isclose(ann.distances(x[2:4], x[2])[1], 5e-200, rtol=1e-15) and np.isinf(ann.distances(x[4:5], x[5])[0])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(0, [1e200, 1e200]), (0, [2e200, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id = 2")).orderBy("rank").collect()]
    assert got == [(1, 3), (2, 0), (3, 0), (4, 0), (5, 1), (6, 5), (7, 4)]


def test_partitions_are_balanced():
    m = np.random.default_rng(0).standard_normal((512, 8))
    part = ann.balanced_partitions(m, ann.neighbours(m, 5), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(64 * 1.05)
