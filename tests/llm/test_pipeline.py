"""Each stage of the corpus pipeline against brute force on its own input."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and output of each stage, written and read again."""
    at = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES):
        new = stage(spark, docs, SF)
        new.write.parquet(f"{at}/{k}")
        new = spark.read.parquet(f"{at}/{k}")
        out.append((docs, new))
        docs = new
    return out


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_filters_keep_clean_documents(spark, stages):
    assert [n for n, _ in C.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "substring dedup", "packing"]
    (first, known), (_, good) = stages[:2]
    assert known.count() >= 0.98 * first.count()
    grade = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = set(texts(known)), set(texts(good))
    assert np.mean([i in after for i in before if grade.get(i) == 1]) > 0.95
    junk = [i for i in before if grade.get(i) == 0]
    assert np.mean([i not in after for i in junk]) > 0.7


def test_one_of_each_group(stages):
    before, after = map(texts, stages[2])
    sets = {}
    for i, t in before.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert set(after) == {root(i) for i in sets}
    assert all(after[i] == before[i] for i in after)


def test_repeated_passages(stages):
    before, after = map(texts, stages[3])
    own = {i: re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for i, t in before.items()}
    seen = Counter(tuple(w[k : k + 35]) for w in own.values() for k in range(len(w) - 34))
    for i, w in own.items():
        gone = [any(seen[tuple(w[k : k + 35])] > 1 for k in range(max(0, p - 34), min(p, len(w) - 35) + 1)) for p in range(len(w))]
        assert after[i] == (before[i] if not any(gone) else b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())


def test_packed(stages):
    before, after = stages[4]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == set(texts(before))
    for i in texts(before):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]


def test_run(spark, stages):
    assert sorted(C.run(spark, SF).select("doc_id", "length").collect()) == sorted(stages[4][1].select("doc_id", "length").collect())


def test_one_of_each_group_by_rows(spark):
    """Repeated and null ids, clashing columns: rows are told apart by id and text."""
    a = [f"w{k}" for k in range(60)]
    near = lambda k: " ".join([*a[:k], "new", *a[k + 1 :]])
    rows = [(1, " ".join(a), 0.5), (5, near(30), 0.1), (5, "another text of its own here", 0.2), (None, near(10), 0.3), (None, "lonely words without an id", 0.4), (None, None, 0.5), (7, "", 0.6), (7, "", 0.6)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), x) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, key double")
    out = C.one_of_each_group(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, ""), (0, "lonely words without an id"), (1, " ".join(a)), (5, "another text of its own here"), (7, "")]


def test_awkward_rows_through_all_stages(spark):
    """Null, empty, repeated and very long rows, and columns that clash with the operators' own."""
    long = " ".join(f"word{k}" for k in range(300_000))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    more = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", "s", 0), (900_002, long, "en", "s", len(long)), (None, "the same row twice here", "en", "s", 23), (None, "the same row twice here", "en", "s", 23)], docs.schema)
    docs = docs.unionByName(more)
    for name in ("score", "row", "held_out", "tail_prob"):
        docs = docs.withColumn(name, docs["doc_id"] * 2)
    for _, stage in C.STAGES[:-1]:
        docs = C.cut(stage(spark, docs, SF))
        assert {"score", "row", "held_out", "tail_prob"} <= set(docs.columns)
        assert docs.filter("score <> doc_id * 2").count() == 0
    rows = C.packed(spark, docs, SF).collect()
    assert rows and {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
