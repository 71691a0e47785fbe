import re
from collections import Counter

import pytest

import corpus_pipeline
from framelode.llm import simhash
from framelode.llm.common import table

from .helpers import least_components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, SF, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{top}/{name}")
        docs = out[name] = spark.read.parquet(f"{top}/{name}")
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for name in ("quality", "toxicity", "near_duplicates", "personal_data"):
        assert stages[name].columns == stages["documents"].columns


def test_filters_keep_clean_documents(spark, stages):
    labels = table(spark, SF, "labels")
    before = stages["documents"].join(labels, "doc_id")
    kept = stages["quality"].join(labels, "doc_id")
    assert kept.where("quality = 1").count() >= 0.99 * before.where("quality = 1").count()
    assert kept.where("quality = 0").count() <= 0.3 * before.where("quality = 0").count()
    left = stages["toxicity"].join(labels, "doc_id")
    assert left.where("toxic = 0").count() >= 0.99 * kept.where("toxic = 0").count()
    assert left.where("toxic = 1").count() <= 0.3 * kept.where("toxic = 1").count()


def test_near_duplicates_against_brute_force(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["toxicity"].select("doc_id", "text").collect()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := simhash.words_of(t)) else set() for i, t in rows}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    near = Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    links = [(a, b) for (a, b), n in near.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    want = least_components(sets, links)
    kept = {r["doc_id"] for r in stages["near_duplicates"].select("doc_id").collect()}
    groups = {c for i, c in want.items() if i != c}
    assert groups <= kept  # one of each group stays, and every document that is alone
    assert {i for i, c in want.items() if i == c} <= kept
    assert not [i for i, c in want.items() if i != c and i in kept]


def test_no_base_span_is_left_and_every_id_is_packed_once(stages):
    out = {r["doc_id"]: r["text"] for r in stages["personal_data"].collect()}
    assert len(out) == stages["near_duplicates"].count()
    assert not any(re.search(r"[\w.+-]@[\w-]+\.[\w-]", t or "") for t in out.values())
    pieces = stages["packed" if "packed" in stages else "packing"].collect()
    total = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert set(total) == set(out)
    assert sum(r["length"] for r in pieces) == sum(total.values())


def test_run_equals_its_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).agg({"length": "sum"}).first() == stages["packing"].agg({"length": "sum"}).first()
