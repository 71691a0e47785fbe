"""Small cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from framelode.functions import columns as C
from framelode.operators import align, frames, fusion, models, search, temporal, text, vectors
from framelode.sources import stored, tables


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(("scores", "want"), [([10.0, 5.0, 0.0], [1.0, 0.5, 0.0]), ([5.0, 5.0], [0.0, 0.0]), ([None, 2.0], [0.0, 1.0])])
def test_minmax(spark, scores, want):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "q int, i int, score double")
    assert [r["norm"] for r in fusion.minmax(df, ["q"]).orderBy("i").collect()] == want


def test_weighted_merge(spark):
    hits = [(1, "visual", 1, 1, 1.0), (1, "visual", 2, 2, 0.5), (1, "ocr", 1, 2, 1.0), (1, "ocr", 2, 3, 0.8), (1, "asr", 1, 3, 1.0), (1, "asr", 2, 1, 0.5)]
    df = spark.createDataFrame(hits, "query_id int, source string, rank int, id int, norm double")
    w = spark.createDataFrame([(1, 0.5, 0.3, 0.2)], "query_id int, visual double, ocr double, asr double")
    got = {r["id"]: round(r["final_score"], 6) for r in fusion.weighted_merge(df, w).collect()}
    assert got == {1: 0.6, 2: 0.55, 3: 0.44}
    alone = fusion.weighted_merge(df, w.limit(0))
    assert {r["id"]: r["final_score"] for r in alone.collect()} == {1: 1.0, 2: 0.5, 3: 0.0}


def test_last_hit_of_a_source_wins_unless_asked_otherwise(spark):
    df = spark.createDataFrame([(1, "asr", 1, 7, 1.0), (1, "asr", 2, 7, 0.25)], "query_id int, source string, rank int, id int, norm double")
    w = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "query_id int, visual double, ocr double, asr double")
    assert fusion.weighted_merge(df, w).first()["final_score"] == 0.25
    assert fusion.weighted_merge(df, w, "max", limit=1).first()["final_score"] == 1.0


def test_reciprocal_ranks(spark):
    hits = [(1, n, r, 100 if r == 5 else 200 if (n, r) == (0, 1) else 1000 * n + r, f"l{n}") for n in range(3) for r in range(1, 6)] + [(1, 0, 6, None, "l0")]
    got = fusion.rrf(spark.createDataFrame(hits, "query_id int, list_no int, rank int, id int, source string")).orderBy("rank").collect()
    assert got[0]["id"] == 100 and math.isclose(got[0]["rrf_score"], 3 / 65)
    assert got[1]["id"] == 200 and math.isclose(got[1]["rrf_score"], 1 / 61)
    assert all(r["id"] is not None for r in got)


def test_additive_merge_leaves_a_single_list_alone(spark):
    one = spark.createDataFrame([(1, 0, 1, 5, 9.0), (1, 0, 2, 6, 3.0)], "query_id int, list_no int, rank int, id int, score double")
    assert [(r["id"], r["score"]) for r in fusion.additive_merge(one).orderBy("rank").collect()] == [(5, 9.0), (6, 3.0)]
    two = one.union(spark.createDataFrame([(1, 1, 1, 6, 4.0), (1, 1, 2, 8, 2.0)], one.schema))
    got = {r["id"]: r["score"] for r in fusion.additive_merge(two).collect()}
    assert math.isclose(got[6], 2 / (2 + 1e-6)) and math.isclose(got[5], 6 / (6 + 1e-6))


# the sentences and their plans are fixed values
@pytest.mark.parametrize(
    ("query", "visual", "ocr", "asr", "weights"),
    [
        ('Xe cứu thương có chữ "Ambulance" chạy trên đường', "Xe cứu thương có chữ  chạy trên đường", "Ambulance", "", (0.5, 0.5, 0.0)),
        ('người đàn ông nói rằng "Cảm ơn"', "người đàn ông nói rằng", "Cảm ơn", "người đàn ông nói rằng", (0.4, 0.3, 0.3)),
        ('"SALE 50%"', "", "SALE 50%", "", (0.0, 1.0, 0.0)),
        ("nghe tiếng còi cảnh sát hú", "nghe tiếng còi cảnh sát hú", "", "nghe tiếng còi cảnh sát hú", (0.7, 0.0, 0.3)),
        ("một chiếc xe màu đỏ", "một chiếc xe màu đỏ", "", "", (1.0, 0.0, 0.0)),
        ('""', "", "", "", (0.0, 1.0, 0.0)),
        ('"x"\n', "", "x", "", (0.0, 1.0, 0.0)),
        ('\u3000a "\t b\u00a0"', "a", "b", "", (0.5, 0.5, 0.0)),
    ],
)
def test_routing(spark, query, visual, ocr, asr, weights):
    p = spark.createDataFrame([(query,)], "q string").select(C.query_plan(F.col("q")).alias("p")).first()["p"]
    assert (p["visual_query"], p["ocr_query"], p["asr_query"], tuple(p["weights"])) == (visual, ocr, asr, weights)


def test_scalar_functions(spark):
    one = spark.createDataFrame([(17, "videos-l21-a", "plain", "keyframe_L21_V001_000017.jpg", 'a "Man" riding', [3.0, 4.0], [0.0, 0.0])], "g long, s string, t string, n string, q string, v array<float>, z array<float>")
    got = one.select(
        C.frame_seconds(F.col("g")), C.folder_of_split(F.col("s")), C.folder_of_split(F.col("t")), C.frame_name_parts(F.col("n")), C.yes_no_question(F.col("q")),
        C.l2_normalized(F.col("v")), C.l2_normalized(F.col("z")), C.l2_normalized(F.col("z"), 1e-8), C.normal_key(F.col("n")), F.round(C.yes_probability(F.lit(5.0), F.lit(2.0)), 6), C.yes_probability(F.lit(None), F.lit(1.0)), F.size(C.vector_or_zero(F.col("v"), 768)),
    ).first()
    assert got[0] == 0.68 and got[1:3] == ("L21", "plain") and tuple(got[3]) == ("L21", "L21_V001", "000017")
    assert got[4] == "Is there a a man riding?" and got[5] == pytest.approx([0.6, 0.8]) and got[6] == [None, None] and got[7] == [0.0, 0.0]
    assert got[8] == "keyframel21v001000017jpg" and got[9] == 0.952574 and got[10] == 0.0 and got[11] == 768


def beam_candidates(spark, data):
    return spark.createDataFrame([(1, e, "v", g, g, t, s, "s", r) for e, g, t, s, r in data], "query_id long, event_idx int, video_id string, faiss_id long, global_frame_id long, timestamp double, score double, split string, cand_rank long")


def test_beam_keeps_its_width_in_order(spark):
    data = [(e, 200 * e + i, 0.0, 1.0, i + 1) for e in range(3) for i in range(100)]
    chains = temporal.beam_search(beam_candidates(spark, data), ["video_id"], 3, beam=5).orderBy("order").collect()
    assert [[f["faiss_id"] for f in c["frames"]] for c in chains] == [[0, 200, 400 + i] for i in range(5)]


def test_scores_decay_with_the_gap(spark):
    data = [(0, 1, 0.0, 1.0, 1), (1, 2, 10.0, 1.0, 1), (1, 3, 300.0, 1.0, 2), (1, 4, 0.0, 0.5, 3)]
    got = {c["frames"][1]["faiss_id"]: c["total_score"] for c in temporal.beam_search(beam_candidates(spark, data), ["video_id"], 2).collect()}
    assert got == pytest.approx({2: 2 * math.exp(-0.1), 3: 2 * math.exp(-3), 4: 1.5})


def test_wide_beam_is_exhaustive(spark):
    data = [(e, 10 * i + e, float(i), 1.0 + i % 3, i + 1) for e in range(3) for i in range(6)]
    chains = temporal.beam_search(beam_candidates(spark, data), ["video_id"], 3, beam=10_000)
    by = [[g for e2, g, *_ in data if e2 == e] for e in range(3)]
    assert chains.count() == sum(a < b < c for a in by[0] for b in by[1] for c in by[2])


def test_tied_chains_stay_with_their_video(spark):
    at = "query_id long, event_idx int, video_id string, faiss_id long, global_frame_id long, timestamp double, score double, split string, cand_rank long"
    ranks = [(0, "A", 1), (1, "A", 2), (0, "A", 3), (1, "A", 10), (0, "B", 2), (1, "B", 9)]
    found = spark.createDataFrame([(1, e, v, 100 * e + r, 100 * e + r, 0.0, 1.0, "s", r) for e, v, r in ranks], at)
    z = temporal.ranked_sequences(temporal.beam_search(found, ["video_id"], 2, beam=2), ["video_id"]).orderBy("seq").collect()
    assert [r["video_id"] for r in z] == ["A", "A", "B"]


def test_a_gate_keeps_queries_out_of_a_source(spark):
    q = spark.createDataFrame([(1, 'a car "STOP"'), (2, '""'), (3, "nghe gì"), (4, '"ONLY"')], "query_id long, query string")
    p = C.query_plan(F.col("query"))
    got = {r[0]: tuple(r[1:]) for r in q.select("query_id", *(C.runs(p, s) for s in fusion.SOURCES)).collect()}
    assert got == {1: (True, True, False), 2: (False, False, False), 3: (True, False, True), 4: (False, True, False)}


def test_fused_search_fills_frames_whichever_source_found_them(spark):
    q = spark.createDataFrame([(1, 'car "stop"', [1.0, 0.0]), (2, '"stop"', None), (3, "", None)], "query_id long, query string, qvec array<double>")
    rows_ = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "faiss_id long, embedding array<float>")
    ocr = spark.createDataFrame([(2, "stop sign"), (9, "stop")], "faiss_id long, ocr_text string")
    asr = spark.createDataFrame([(7, 1, "hello")], "asr_id long, nearest_faiss_id long, text string")
    frames_ = spark.createDataFrame([(1, "v1", "f1", 0.5), (2, "v2", "f2", 1.5)], "faiss_id long, video_id string, frame_name string, timestamp double")
    vqa = spark.createDataFrame([(2, 1.0)], "faiss_id long, vqa double")
    got = {(r["query_id"], r["faiss_id"]): r for r in search.fused_search(q, rows_, ocr, asr, frames_, vqa, k=10).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 9), (2, 2), (2, 9)}
    assert (got[1, 2]["video_id"], got[1, 2]["frame_name"], got[1, 2]["ocr_text"]) == ("v2", "f2", "stop sign")
    assert (got[2, 9]["video_id"], got[2, 9]["timestamp"], got[2, 9]["score_breakdown"]["ocr"]) == ("", 0.0, 1.0)
    assert got[2, 2]["rank"] == 2 and math.isclose(got[2, 2]["final_score"], 0.3) and got[2, 2]["score_breakdown"]["vqa"] == 1.0


def test_plans_of_searches(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    q = spark.createDataFrame([(1, "red car")], "query_id long, query string")
    docs = spark.createDataFrame([(1, "a red car"), (2, "a car")], "faiss_id long, ocr_text string")
    found = text.text_search(q, docs, 5)
    assert "WindowGroupLimit" in plan(found) and "CartesianProduct" not in plan(found)
    found.collect()
    final = plan(found).split("Initial Plan")[0]
    assert "NestedLoop" not in final
    data = spark.createDataFrame([(1, [1.0])], "faiss_id long, embedding array<float>")
    near = vectors.knn(data.selectExpr("faiss_id as query_id", "embedding as qvec"), data, 3)
    assert plan(near).count("Exchange") == 1 and "WindowGroupLimit" in plan(near)  # rows aren't shuffled, only each task's best


def test_many_queries_meet_rows_in_blocks(spark):
    data = spark.createDataFrame([(i, [float((7 * i) % 13), float(i % 5), 1.0]) for i in range(90)], "faiss_id long, embedding array<float>")
    asked = data.where("faiss_id % 3 = 0").selectExpr("faiss_id as query_id", "embedding as qvec")
    one, other = (sorted(rows(vectors.knn(asked, data, 4, sent=n, block=16, query_block=8))) for n in (1000, 3))
    assert one == other and len(one) == 30 * 4
    assert vectors.knn(asked.limit(0), data, 4).count() == 0


def test_models_see_only_their_columns(spark):
    def model(frames_):
        seen = 0  # loaded once a task
        for f in frames_:
            assert list(f.columns) == ["q"]
            seen += len(f)
            yield f.assign(n=f["q"].str.len(), v=[[float(len(x))] * 2 for x in f["q"]])

    got = models.with_model(spark.createDataFrame([("a", 1), ("bcd", None)], "q string, other int"), model, ["q"], "n bigint, v array<double>").orderBy("n")
    assert rows(got) == [("a", 1, 1, [1.0, 1.0]), ("bcd", None, 3, [3.0, 3.0])]
    hits = search.text_vector_search(spark.createDataFrame([(1, " AB\n")], "query_id long, query string"), spark.createDataFrame([(5, [1.0, 0.0])], "faiss_id long, embedding array<float>"), spark.createDataFrame([(5, "v")], "faiss_id long, video_id string"), 3, lambda it: (f.assign(qvec=[[float(x == "ab"), 0.0] for x in f["query"]]) for f in it))
    assert rows(hits.select("faiss_id", "score", "video_id")) == [(5, 1.0, "v")]

    def short(frames_):
        return (f.iloc[:0].assign(n=0) for f in frames_)

    with pytest.raises(Exception, match="rows"):
        models.with_model(spark.range(3), short, ["id"], "n bigint").collect()


def test_validation_reorders_sequences(spark):
    frame = "array<struct<faiss_id:long>>"
    z = spark.createDataFrame([(1, 1, [(1,), (2,)], 10.0), (1, 2, [(3,), (4,)], 9.5)], f"query_id long, seq long, frames {frame}, total_score double")
    s = spark.createDataFrame([(1, e, f, v) for e, f, v in ((0, 1, 0.1), (1, 2, 0.1), (0, 3, 0.9), (1, 4, 0.9))], "query_id long, event_idx int, faiss_id long, vqa double")
    got = temporal.validated(z, s, 2).orderBy("new_seq").collect()
    assert [(r["seq"], round(r["total_score"], 6)) for r in got] == [(2, 7.19), (1, 7.06)]


def test_videos_without_every_event_drop_out(spark):
    found = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 0, "b"), (1, 0, "b")], "query_id long, event_idx int, video_id string")
    assert {r["video_id"] for r in temporal.with_all_events(found, ["video_id"], 2).collect()} == {"a"}


def test_a_pool_stays_above_the_rest(spark):
    ranked = spark.createDataFrame([(1, r, r, 1.0 - r / 10) for r in range(1, 5)], "query_id long, rank long, id long, final_score double")
    vqa = spark.createDataFrame([(1, 2, 1.0)], "query_id long, id long, vqa double")
    got = rows(fusion.rerank_pool(ranked, vqa, pool=2).orderBy("rank").select("id", "in_pool", F.round("final_score", 6)))
    assert got == [(2, True, 0.86), (1, True, 0.63), (3, False, 0.7), (4, False, 0.6)]


def test_knn_finds_itself_first_and_breaks_ties_by_id(spark):
    data = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)] + [(9, [1.0, 0.0, 0.0, 0.0]), (10, None)], "faiss_id long, embedding array<float>")
    asked = data.where("faiss_id in (0, 2)").selectExpr("faiss_id as query_id", "embedding as qvec")
    got = rows(vectors.knn(asked, data, 2, block=2, query_block=1).orderBy("query_id", "rank"))
    assert got == [(0, 1, 0, 1.0), (0, 2, 9, 1.0), (2, 1, 2, 1.0), (2, 2, 0, 0.0)]


def test_nearest_frame_prefers_the_earlier_then_the_smaller_id(spark):
    s = spark.createDataFrame([(1, "a", 5.0), (2, "a", 0.0), (3, "a", 99.0), (4, "b", 1.0)], "seg long, video_id string, mid double")
    f = spark.createDataFrame([(7, "a", 6.0), (8, "a", 4.0), (9, "a", 4.0), (6, "a", 99.0)], "faiss_id long, video_id string, timestamp double")
    got = align.nearest_in_time(s, f, ["video_id"], "mid", "timestamp", "seg", "faiss_id")
    assert {r["seg"]: r["nearest_faiss_id"] for r in got.collect()} == {1: 8, 2: 8, 3: 6}
    assert rows(align.unmatched(s, f, ["video_id"])) == [("b", 1)]


def test_dense_fill_and_text_assembly(spark):
    f = spark.createDataFrame([("v", 0, [1.0]), ("v", 2, [2.0])], "video_id string, frame_index int, embedding array<float>")
    assert rows(align.dense_fill(f, ["video_id"], 1).orderBy("frame_index")) == [("v", 0, [1.0]), ("v", 1, [0.0]), ("v", 2, [2.0])]
    b = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, " "), (2, 1, None)], "id long, pos int, txt string")
    assert rows(align.assemble_text(b, ["id"], "pos", "txt")) == [(1, "a b", 2, "vi")]


def test_phrases_count_double(spark):
    docs = spark.createDataFrame([(1, "red car red car"), (2, "car red"), (3, "nothing")], "faiss_id long, ocr_text string")
    q = spark.createDataFrame([(0, "Red car")], "query_id long, query string")
    terms = text.query_terms(q, "query_id", "query")
    got = text.phrase_scores(terms, text.text_index(docs, "faiss_id", "ocr_text", terms)).collect()
    assert [(r["doc"], r["phrase_tf"]) for r in got] == [(1, 2)]
    assert [r["doc"] for r in text.text_search(q, docs).orderBy("rank").collect()] == [1, 2]


def test_reading_and_writing(spark, tmp_path):
    p = tmp_path / "frames.json"
    p.write_text('{"2": {"split": "s", "video_id": "v", "frame_name": "n", "frame_index": 1, "global_frame_id": 50}, "1": {"split": "s", "video_id": "v", "frame_name": "m", "frame_index": 0, "global_frame_id": 25}}')
    found = tables.read_frames(spark, str(p)).orderBy("faiss_id").collect()
    assert [(r["faiss_id"], r["global_frame_id"]) for r in found] == [(1, 25), (2, 50)]
    p.write_text('{"2": {"split": "s"}}')
    with pytest.raises(Exception, match="required"):
        tables.read_frames(spark, str(p)).collect()
    assert tables.read_frames_or_none(spark, str(p)).count() == 1
    assert tables.read_frames_or_none(spark, str(tmp_path / "none.json")).count() == 0
    p.write_text('[{"faiss_id": 1, "ocr_text": "x"}, {"faiss_id": 2}]')
    assert tables.read_ocr(spark, str(p)).count() == 2
    lines = tmp_path / "lines.json"
    lines.write_text('{"faiss_id": 1, "ocr_text": "x"}\n{"faiss_id": "no number\n{"faiss_id": 3}\n')
    assert sorted(r["faiss_id"] for r in tables.read_ocr(spark, str(lines), lines=True).collect()) == [1, 3]
    p.write_text('[{"faiss_id": 1, "ocr_text": "x"}, {"faiss_id": 2}]')
    assert tables.read_asr(spark, str(tmp_path / "no")).count() == 0
    ddl = tables.mapping_schema({"faiss_id": {"type": "integer"}, "ocr_text": {"type": "text"}})
    out = str(tmp_path / "ocr")
    assert tables.create_if_absent(spark, {out: ddl}) == [out] and tables.create_if_absent(spark, {out: ddl}) == []
    docs = spark.createDataFrame([(1, "x"), (2, "y")], ddl)
    assert tables.append(docs, out) == 2 and tables.append(docs, out) == 2 and spark.read.parquet(out).count() == 4
    assert not tables.write_json(docs.limit(0), f"{out}.json") and tables.write_json(docs.limit(0), f"{out}.json", force=True)
    vecs = spark.createDataFrame([(1, "s", "v", 0, [1.0])], "faiss_id long, split string, video_id string, frame_index int, embedding array<double>")
    tables.write_vectors(vecs, f"{out}-v")
    tables.write_features(vecs, f"{out}-f")
    assert spark.read.parquet(f"{out}-v").first()["embedding"] == [1.0] and spark.read.parquet(f"{out}-f").first()["split"] == "s"
    tables.recreate_points(spark, f"{out}-p", {"a": 2})
    assert spark.read.parquet(f"{out}-p").columns == ["id", "a", "video_id", "frame_name", "timestamp", "split"]


def test_upsert_takes_the_new_side(spark):
    old = spark.createDataFrame([(1, "old", 5), (2, "old", 1)], "id long, t string, v int")
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "c", 1)], old.schema)
    assert sorted(rows(tables.upsert(old, new, ["id"], "v"))) == [(1, "b", 2), (2, "old", 1), (3, "c", 1)]
    assert sorted(rows(tables.upsert(old, new, ["id"]))) == sorted(rows(tables.upsert(old.repartition(3), new.orderBy("t", ascending=False), ["id"])))


def test_assets(spark):
    files = spark.createDataFrame([("/x/L21/V1.mp4",), ("/a/L22/V1.mp4",), ("/x/L21/V2.txt",), ("/x/L23/L23_V3.MKV",)], "path string")
    index = dict(rows(frames.asset_index(files)))
    assert index["v1"] == "/a/L22/V1.mp4" and index["l21v1"] == "/x/L21/V1.mp4" and "v2" not in index and "l23v3" in index
    f = spark.createDataFrame([(1, "videos-l21-a", "V9", "keyframe_L23_V3_1.jpg"), (2, "s", "nope", "n.jpg")], "faiss_id long, split string, video_id string, frame_name string")
    keys = frames.frame_keys(F.col("split"), F.col("video_id"), F.col("frame_name"))
    explicit = frames.explicit_assets(spark.createDataFrame([("NO-PE", "/first", 1), ("no/pe", "/last", 2)], "name string, path string, ord int"))
    got = dict(rows(frames.resolve_assets(f, keys, frames.asset_index(files), explicit)))
    assert got == {1: "/x/L23/L23_V3.MKV", 2: "/last"}


def test_checks(spark):
    f = spark.createDataFrame([("v", 0), ("v", 3), ("w", 0)], "video_id string, frame_index int")
    assert rows(frames.check_bounds(f, f, ["video_id"])) == [("v", 3, 2)]
    assert rows(frames.check_duplicates(f.union(f.limit(1)), ["video_id", "frame_index"]))[0][2] == 2
    ok, bad = frames.frame_numbers(spark.createDataFrame([(1,), (0,)], "global_frame_id long"), 1)
    assert ok.count() == 1 and bad.count() == 1
    with pytest.raises(ValueError, match="asset"):
        frames.with_assets(f, f.where("video_id = 'w'"), "video_id", strict=True)
    assert frames.with_assets(f, f.where("video_id = 'w'"), "video_id").count() == 1
    assert rows(frames.first_with_assets(f, f.where("video_id = 'v'"), 1, "video_id", "frame_index")) == [("v", 0)]


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(i, [float(i), 1.0]) for i in range(8)] + [(8, [nan, 1.0]), (9, [None, 9.0]), (10, [inf, 1.0]), (11, None), (12, [5.0]), (13, [9.0, 9.0, 9.0]), (14, []), (None, [99.0, 1.0])]
    df = spark.createDataFrame(data, "faiss_id long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.5]), ("n", [nan, 0.0]), ("z", None), ("one", [2.0]), ("h", [None, 1.0])], "query_id string, qvec array<double>")
    for sent in (100, 1):
        got = sorted(rows(vectors.knn(asked, df, 3, sent=sent, block=4, query_block=2).select("query_id", "rank", "faiss_id", "score")))
        assert got == [("a", 1, 7, 7.0), ("a", 2, 6, 6.0), ("a", 3, 5, 5.0), ("b", 1, 0, 0.5), ("b", 2, 1, -0.5), ("b", 3, 2, -1.5), ("one", 1, 12, 10.0)]


def test_queries_and_rows_have_ids_of_any_type(spark):
    data = spark.createDataFrame([(f"r{i:02}", [float(i % 3), 1.0]) for i in range(12)], "frame string, v array<float>")
    asked = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 0, [0.0, 1.0])], "query_id long, event_idx int, qvec array<double>")
    for sent in (100, 1):
        found = vectors.knn(asked, data, 2, ["query_id", "event_idx"], row_id="frame", row_vec="v", sent=sent, block=5, query_block=1)
        assert sorted(rows(found.select("query_id", "event_idx", "rank", "faiss_id"))) == [(1, 0, 1, "r02"), (1, 0, 2, "r05"), (1, 1, 1, "r00"), (1, 1, 2, "r03"), (2, 0, 1, "r00"), (2, 0, 2, "r01")]


def test_spaces_share_one_scan(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), 1.0], [float(-i)]) for i in range(20)], "faiss_id long, a array<float>, b array<float>").write.parquet(str(tmp_path / "points"))
    data = spark.read.parquet(str(tmp_path / "points"))
    asked = spark.createDataFrame([(1, [1.0, 0.0], [1.0]), (2, None, [-1.0])], "query_id long, x array<double>, y array<double>")
    found = vectors.knn_spaces(asked, data, {"one": ("x", "a"), "two": ("y", "b")}, 2)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    want = [(1, 0, "one", 1, 19), (1, 0, "one", 2, 18), (1, 1, "two", 1, 0), (1, 1, "two", 2, 1), (2, 1, "two", 1, 19), (2, 1, "two", 2, 18)]
    for sent in (100, 1):
        assert sorted(rows(vectors.knn_spaces(asked, data, {"one": ("x", "a"), "two": ("y", "b")}, 2, sent=sent, block=7, query_block=1).drop("score"))) == want


def test_workers_get_the_package_from_the_driver(tmp_path):
    """Another working folder, and a package that only the driver's path has."""
    import os
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from framelode.operators import models, text, vectors
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
data = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "faiss_id long, embedding array<float>")
hits = vectors.knn(data.selectExpr("faiss_id as query_id", "embedding as qvec"), data, 1).collect()
docs = spark.createDataFrame([(1, "a red car"), (2, "a car")], "faiss_id long, ocr_text string")
found = text.text_search(spark.createDataFrame([(5, "red car")], "query_id long, query string"), docs, 2).collect()
print("HITS", [r["faiss_id"] for r in hits], [r["doc"] for r in found])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "HITS [2, 2] [1, 2]" in said.stdout, said.stderr[-2000:]


@pytest.fixture
def diary(tmp_path):
    """A folder in which models note their loads and the frames they get, on this machine."""
    import os
    import uuid

    def note(kind, rows_):
        with open(os.path.join(str(tmp_path), f"{kind}-{uuid.uuid4().hex}"), "w") as f:
            f.write("\n".join(map(str, rows_)))

    def read(kind):
        return [(p.read_text().splitlines() if p.stat().st_size else []) for p in tmp_path.iterdir() if p.name.startswith(f"{kind}-")]

    return note, read


def test_models_get_frames_of_their_size_and_are_loaded_once_a_worker(spark, diary):
    note, read = diary

    def load():
        import os

        note("load", [os.getpid()])
        return lambda f: (note("call", f["id"].tolist()), (f["id"] * 2).to_frame("twice"))[1]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        table = spark.range(0, 100, 1, 6).withColumn("wanted", F.col("id") % 4 == 1)
        use = models.Use(models.Loaded(load), ["id"], 5)
        got = models.used(table, use, "twice bigint", "wanted").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["id"]: r["twice"] for r in got} == {i: 2 * i if i % 4 == 1 else None for i in range(100)} and len(got) == 100
    calls = read("call")
    assert sorted(int(i) for c in calls for i in c) == [i for i in range(100) if i % 4 == 1] and max(map(len, calls)) == 5
    assert len(calls) <= 6 * 2 and sum(len(c) < 5 for c in calls) <= 6  # a smaller one only at a task's end
    pids = [p for c in read("load") for p in c]
    assert len(pids) == len(set(pids)) and len(pids) <= 4


def test_a_frame_that_the_model_leaves_out_is_an_error(spark):
    with pytest.raises(Exception, match="fewer frames"):
        models.with_model(spark.range(5), lambda frames_: (f.assign(n=0) for f in list(frames_)[1:]), ["id"], "n bigint", batch=1).collect()
    with pytest.raises(Exception, match="fewer frames"):
        models.with_model(spark.range(0, 5, 1, 1), lambda frames_: iter([next(frames_).assign(n=0)]), ["id"], "n bigint", batch=1).collect()


def test_only_the_pool_reaches_the_model(spark, diary):
    note, read = diary
    ranked = spark.createDataFrame([(q, r, r, 1.0 - r / 10) for q in (1, 2) for r in range(1, 6)], "query_id long, rank long, id long, final_score double")
    use = models.Use(models.Loaded(lambda: lambda f: (note("call", f["id"].tolist()), (f["id"] == 2).astype(float).where(f["id"] != 1).to_frame("vqa"))[1]), ["id"], 64)
    got = rows(fusion.rerank_pool(ranked, use, pool=2).where("query_id = 1").orderBy("rank").select("id", "in_pool", F.round("final_score", 6)))
    assert got == [(2, True, 0.86), (1, True, 0.63), (3, False, 0.7), (4, False, 0.6), (5, False, 0.5)]
    assert sorted(i for c in read("call") for i in c) == ["1", "1", "2", "2"]


def test_answers_are_asked_of_frames_with_an_image(spark, diary):
    note, read = diary
    data = spark.createDataFrame([(i, [float(i)]) for i in range(1, 7)], "faiss_id long, embedding array<float>")
    q = spark.createDataFrame([("a", "what", [1.0]), ("b", "who", [-1.0])], "query_id string, query string, qvec array<double>")
    images = spark.createDataFrame([(i, f"/{i}.jpg") for i in (2, 3, 5, 6)], "faiss_id long, path string")
    use = models.Use(models.Loaded(lambda: lambda f: (note("call", f["path"].tolist()), (f["query"] + f["path"]).where(f["path"] != "/5.jpg", None).to_frame("answer"))[1]), ["query", "path"], 4)
    found = search.answered_search(q, data, data.select("faiss_id"), 4, use, images)
    assert sorted(rows(found.select("query_id", "n", "faiss_id", "answer"))) == [("a", 0, 6, "what/6.jpg"), ("a", 1, 3, "what/3.jpg"), ("b", 0, 2, "who/2.jpg"), ("b", 1, 3, "who/3.jpg")]
    assert sorted(p for c in read("call") for p in c) == ["/2.jpg", "/3.jpg", "/3.jpg", "/5.jpg", "/6.jpg"] and max(map(len, read("call"))) <= 4
    table = spark.createDataFrame([("a", 6, "x"), ("a", 1, "y")], "query_id string, faiss_id long, answer string")
    assert sorted(rows(search.answered_search(q, data, data.select("faiss_id"), 6, table, images).select("faiss_id", "answer"))) == [(6, "x")]


def test_temporal_search_from_vectors(spark, diary):
    note, read = diary
    data = [(v * 10 + i, [float(v == 1) * (3 - i) + 0.5, float(i)]) for v in (1, 2) for i in range(3)] + [(30, [9.0, 0.0])]
    vecs = spark.createDataFrame(data, "faiss_id long, embedding array<float>")
    of = spark.createDataFrame([(i, f"v{i // 10}", i, None, "s") for i, _ in data], "faiss_id long, video_id string, global_frame_id long, timestamp double, split string")
    events = spark.createDataFrame([("q", 0, "start", [1.0, 0.0]), ("q", 1, "END", [0.0, 1.0]), ("none", 0, "start", [1.0, 0.0])], "query_id string, event_idx int, query string, qvec array<double>")
    plain = search.temporal_search(events, vecs, of, ["video_id"], 2, per_event=7, top=3)
    got = [(r["query_id"], r["seq"], r["video_id"], [f["faiss_id"] for f in r["frames"]], r["total_score"], r["vqa_confidence"]) for r in plain.orderBy("seq").collect()]
    assert got == [("q", 1, "v1", [10, 12], 5.5, None), ("q", 2, "v1", [10, 11], 4.5, None), ("q", 3, "v1", [11, 12], 4.5, None)]
    images = spark.createDataFrame([(11, "/11"), (12, "/12"), (99, "/99")], "faiss_id long, path string")
    use = models.Use(models.Loaded(lambda: lambda f: (note("call", (f["question"] + f["path"]).tolist()), (f["path"] == "/11").astype(float).to_frame("vqa"))[1]), ["question", "path"], 2)
    found = search.temporal_search(events, vecs, of, ["video_id"], 2, per_event=7, top=3, vqa=use, assets=images).orderBy("seq").collect()
    assert [([f["faiss_id"] for f in r["frames"]], round(r["total_score"], 6), r["vqa_confidence"]) for r in found] == [([10, 12], 3.85, 0.0), ([10, 11], 3.45, 0.5), ([11, 12], 3.45, 0.5)]
    # each frame of an event once, and only those with an image
    assert sorted(x for c in read("call") for x in c) == ["Is there a end?/11", "Is there a end?/12", "Is there a start?/11"]


@pytest.mark.parametrize("seed", [1, 2])
def test_a_long_video_is_several_tasks(spark, seed):
    import random

    random.seed(seed)
    videos = ["long"] * 18 + ["a", None]
    segments = [(i, random.choice(videos), random.choice([None, random.randint(0, 400) / 4, 7.0])) for i in range(900)]
    of = [(i, random.choice([*videos, "only frames"]), random.choice([None, random.randint(100, 300) / 4, 50.0])) for i in range(300)] + [(1000, "far", 1.0)]
    s = spark.createDataFrame(segments + [(5000, "far", -3.0), (5001, "far", 9.0), (5002, "none", 1.0)], "seg long, video_id string, mid double").repartition(3)
    f = spark.createDataFrame(of, "faiss_id long, video_id string, timestamp double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r["seg"]: (r["nearest_faiss_id"], r["nearest_time"]) for r in align.nearest_in_time(s, f, ["video_id"], "mid", "timestamp", "seg", "faiss_id").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for i, v, t in segments + [(5000, "far", -3.0), (5001, "far", 9.0)]:
        near = min(((abs(t - u), u, j) for j, w, u in of if w == v and u is not None), default=None) if t is not None else None
        if near:
            want[i] = (near[2], near[1])
    assert got == want and len(want) > 500


def test_gaps_are_filled_however_large_the_index(spark):
    f = spark.createDataFrame([("v", 0, [1.0]), ("v", 100_000_000, [3.0]), ("v", 70_000, [2.0])], "video_id string, frame_index int, embedding array<float>")
    chunks = align.dense_fill(f, ["video_id"], 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" in chunks
    small = align.dense_fill(f.where("frame_index < 100000"), ["video_id"], 1)
    assert small.count() == 70_001 and rows(small.where("embedding[0] <> 0").orderBy("frame_index").select("frame_index")) == [(0,), (70_000,)]


def test_one_json_file_is_read_by_several_tasks(spark, tmp_path):
    import json

    frame = lambda i: {"split": f"s{i % 3}", "video_id": f"v}}{i} \\\" {{\"x\": 1}}, " if i % 50 == 7 else f"v{i}", "frame_name": "n" * (i % 40), "frame_index": i, "global_frame_id": 25 * i}
    data = {str(i): frame(i) for i in range(2000)}
    forms = {"line": json.dumps(data), "indented": json.dumps(data, indent=2), "dense": json.dumps(data, separators=(",", ":")), "lines": "\n".join(json.dumps({"faiss_id": int(k)} | v) for k, v in data.items())}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        for name, said in forms.items():
            (tmp_path / name).write_text(said)
            for read in (tables.read_frames, tables.read_frames_or_none):
                found = read(spark, str(tmp_path / name))
                assert {str(r["faiss_id"]): {k: r[k] for k in data["0"]} for r in found.collect()} == data, name
            pieces = spark.read.option("lineSep", "}").text(str(tmp_path / name))
            assert pieces.rdd.getNumPartitions() > 5
            assert tables.bad_frames(spark, str(tmp_path / name)).count() == 0
        broken = forms["line"].replace('"frame_index": 11,', '"frame_index": eleven,').replace('"frame_index": 12,', '"frame_index": ,')
        (tmp_path / "broken").write_text(broken)
        assert tables.read_frames_or_none(spark, str(tmp_path / "broken")).count() == 1998
        assert sorted(r["key"] for r in tables.bad_frames(spark, str(tmp_path / "broken")).collect()) == ["11", "12"]
        with pytest.raises(Exception, match="required"):
            tables.read_frames(spark, str(tmp_path / "broken")).collect()
        for said in ("", "{}", "[]", " {\n} "):
            (tmp_path / "none").write_text(said)
            assert tables.read_frames(spark, str(tmp_path / "none")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_stored_table_rewrites_what_it_touches(spark, tmp_path):
    path, files = str(tmp_path / "t"), lambda: {str(p) for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    stored.create(spark, path, "id long, t string, v int", ["id"], 8)
    assert stored.read(spark, path).count() == 0 and stored.versions(spark, path) == [0]
    first = spark.createDataFrame([(i, "old", 1) for i in range(100)], "id long, t string, v int")
    assert stored.write(first, path, "v") == 1
    before, named = files(), set(stored.read(spark, path).inputFiles())
    one = spark.createDataFrame([(3, "new", 2), (3, "newer", 3)], first.schema)
    assert stored.write(one, path, "v") == 2 and before <= files() and len(named - set(stored.read(spark, path).inputFiles())) == 1
    want = sorted((i, "newer", 3) if i == 3 else (i, "old", 1) for i in range(100))
    assert sorted(rows(stored.read(spark, path))) == want and stored.read(spark, path, 1).where("t = 'old'").count() == 100
    assert stored.write(one, path, "v") == 3 and sorted(rows(stored.read(spark, path))) == want
    assert stored.write(one.limit(0), path, "v") == 3
    # a write that fails, and one that meets another, leave the table as it is
    with pytest.raises(Exception, match="no more"):
        stored.write(first.withColumn("t", F.when(F.col("id") == 50, F.raise_error(F.lit("no more"))).otherwise("x")), path, "v")
    _, now = stored._version(spark, path, None)
    with pytest.raises(RuntimeError, match="another write"):
        stored._commit(spark, path, 3, now)
    assert sorted(rows(stored.read(spark, path))) == want and stored.versions(spark, path) == [0, 1, 2, 3]
    with pytest.raises(RuntimeError, match="another write"):
        stored.create(spark, path, "id long", ["id"])


def test_checks_scan_each_table_once(spark, tmp_path):
    v, f, r = (str(tmp_path / x) for x in "vfr")
    spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,), ([1.0, 2.0],)], "embedding array<double>").write.parquet(v)
    spark.createDataFrame([("a", 0), ("a", 0), ("a", 3), ("b", 0), ("c", 0)], "video_id string, frame_index int").write.parquet(f)
    spark.createDataFrame([("a",), ("a",), ("b",)], "video_id string").write.parquet(r)
    found = frames.checked(*(spark.read.parquet(x) for x in (v, f, r)), ["video_id"])
    assert {tuple(x) for x in found.collect()} == {("counts", False, 1), ("shape", False, 2), ("bounds", False, 2), ("duplicates", False, 1)}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan") == 3
    empty = frames.checked(*(spark.read.parquet(x).limit(0) for x in (v, f, r)), ["video_id"])
    assert all(x["ok"] for x in empty.collect()) and empty.count() == 4


@pytest.mark.parametrize("signs", [(1, 1), (-1, 1), (-1, -1)])
def test_hopeless_videos_never_enter_the_beam(spark, signs):
    import random

    random.seed(6)
    hits = [(q, e, f"v{v}", v * 100 + i, v * 100 + i, float(i * 20), random.choice(signs) * random.random() * (1 if v % 9 else 3), "s") for q in (1, 2) for e in range(3) for v in range(60) for i in random.sample(range(100), 4)]
    df = spark.createDataFrame(hits, "query_id long, event_idx int, video_id string, faiss_id long, global_frame_id long, timestamp double, score double, split string")
    shown = lambda z: [(r["query_id"], r["seq"], r["video_id"], [f["faiss_id"] for f in r["frames"]], r["total_score"]) for r in z.orderBy("query_id", "seq").collect()]
    whole = temporal.temporal_search(df, ["video_id"], 3, 1000, beam=10, top=5, alpha=0.001)
    found, entered = temporal.bounded_search(df, ["video_id"], 3, 1000, beam=10, top=5, first=4, alpha=0.001)
    assert shown(found) == shown(whole) and len(shown(whole)) == 10
    if signs == (1, 1):
        assert entered.count() < 60


def test_frame_files_are_as_many_as_tasks(spark):
    from framelode.plans import queries

    path = queries._frame_files(spark, "/root/testdata/sf0.01")
    assert len(spark.read.text(path).inputFiles()) <= 4


def test_many_queries_are_cells_for_all_cores_and_near_ties_are_told_apart(spark):
    """Vectors that differ by less than single precision; no cell has all queries."""
    data = spark.range(3000).selectExpr("id as faiss_id", "transform(sequence(1, 8), j -> sin(cast(id % 1000 as double) * j) * (1 + 1e-12 * (id div 1000))) as embedding")
    asked = data.where("faiss_id < 1500").selectExpr("faiss_id as query_id", "embedding as qvec")
    x = {r[0]: r[1] for r in data.collect()}
    got = {}
    for r in sorted(rows(vectors.knn(asked, data, 5, sent=3).select("query_id", "rank", "faiss_id", "score"))):
        got.setdefault(r[0], []).append((r[2], round(r[3], 9)))
    for q in range(0, 1500, 250):
        want = sorted(((-sum(a * b for a, b in zip(x[q], x[i], strict=True)), i) for i in x))[:5]
        assert [s for _, s in got[q]] == [round(-s, 9) for s, _ in want] and {i % 1000 for i, _ in got[q]} == {i % 1000 for _, i in want}
    cells = vectors._cells(asked.withColumnRenamed("qvec", "_q0"), data.toDF("_id", "_v0"), ["query_id"], 1, 5, 65_536, 4096)
    assert len({r[0] for r in cells.select(F.spark_partition_id()).distinct().collect()}) > 1
