"""The corpus pipeline, stage by stage against brute-force versions of its decisions."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10_001, None, "en", "x", 0), (10_002, "", "en", "x", 0), (10_003, "1 2 3", "en", "x", 5)]
    out = [docs.unionByName(spark.createDataFrame(odd, docs.schema))]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_filters_keep_the_columns_of_documents(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])


def test_language_stage(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert set(before) - set(after) == {10_001, 10_002, 10_003}


def test_quality_stage(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept, before = texts(stages[2]), texts(stages[1])
    told = [(labels[d], d in kept) for d in before if d in labels]
    assert sum((q == 1) == k for q, k in told) / len(told) > 0.95


def test_exact_stage(stages):
    best = {}
    for d, t in texts(stages[2]).items():
        best[t] = max(d, best.get(t, d))
    assert texts(stages[3]) == {d: t for t, d in best.items()}


def test_near_stage(stages):
    before = texts(stages[3])
    sets = {}
    for d, t in before.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert set(texts(stages[4])) == {root(d) for d in sets}


def test_packing_stage(stages):
    found = defaultdict(int)
    for r in stages[5].collect():
        found[r["doc_id"]] += r["length"]
        assert r["length"] > 0
    assert set(found) == set(texts(stages[4]))
    assert {r["doc_id"]: r["doc_tokens"] for r in stages[5].collect()} == dict(found)


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0
