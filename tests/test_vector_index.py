"""The stored vector index against exact search and against hand-made embeddings."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieval, vector_index
from quillspark.operators.vector_index import VectorIndex, choose_index

SCHEMA = "id string, embedding array<double>"


def clustered(n, d, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(40, d))
    return [(f"case_{i:04}", (centers[i % 40] + 0.5 * rng.normal(size=d)).tolist()) for i in range(n)]


def exact(rows, queries, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    out = set()
    for q, v in queries:
        v = np.array(v) / np.linalg.norm(v)
        best = sorted((-round(min(1.0, max(0.0, float(v @ u))), 4), i) for i, u in unit.items())[:k]
        out |= {(q, i, -s, r) for r, (s, i) in enumerate(best, 1)}
    return out


def hits(df):
    return {(r.query, r["key"], r.score, r["rank"]) for r in df.collect()}


def test_recall_and_probed_lists(spark, tmp_path):
    rows = clustered(4000, 24)
    index = VectorIndex.create(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/i", lists=64)
    asked = [(f"q{i}", v) for i, (_, v) in enumerate(clustered(60, 24, 9))]
    queries = spark.createDataFrame(asked, "query string, embedding array<double>")
    want = {(q, i) for q, i, _, _ in exact(rows, asked, 10)}
    got = index.search_vectors(queries, 10)
    assert len({(q, i) for q, i, _, _ in hits(got)} & want) >= 0.95 * len(want)
    assert hits(index.search_vectors(queries, 10, probes=64)) == exact(rows, asked, 10)
    # one query reads its probed lists alone
    one = np.array(asked[0][1])[None] / np.linalg.norm(asked[0][1])
    lists = [int(x) for x in index.probed(one)[0]]
    assert len(lists) == 8
    entries = index._entries().where(F.col("list").isin(lists)).select("code")
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan and "vector" not in plan


def test_inserts_replace_keys_and_compact(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    rows = dict(clustered(300, 8))
    index = VectorIndex.create(spark.createDataFrame(list(rows.items()), SCHEMA), path)
    new = {f"case_{i:04}": v for i, (_, v) in enumerate(clustered(100, 8, 5), 250)}
    bad = [(None, [1.0] * 8), ("case_0001", [0.0] * 8), ("case_0002", None), ("short", [1.0]), ("nan", [math.nan] * 8), ("null", [None] * 8)]
    index.insert(spark.createDataFrame([*new.items(), *bad, ("case_0250", [-1e9] * 8)], SCHEMA))
    rows |= new
    again = VectorIndex(spark, path)
    asked = [("q", list(rows.values())[7]), ("r", new["case_0300"])]
    queries = spark.createDataFrame(asked, "query string, embedding array<double>")
    assert again.count() == len(rows)
    assert hits(again.search_vectors(queries, 20)) == exact(rows.items(), asked, 20)
    again.compact()
    assert again.count() == len(rows) and hits(VectorIndex(spark, path).search_vectors(queries, 20)) == exact(rows.items(), asked, 20)
    again.insert(spark.createDataFrame([("case_0007", [1.0] + [0.0] * 7)], SCHEMA))
    assert again.count() == len(rows)
    with pytest.raises(ValueError):
        VectorIndex.create(spark.createDataFrame(list(rows.items()), SCHEMA), path)


def test_copies_tie_by_key_without_a_cap(spark, tmp_path):
    rows = [(f"k{i:03}", [1.0, 2.0, 3.0]) for i in range(500)] + [("x", [3.0, 2.0, 1.0])]
    index = VectorIndex.create(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/i", lists=4)
    got = index.search_vectors(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [1.0])], "query long, embedding array<double>"), 3)
    assert sorted((r.query, r["key"], r["rank"]) for r in got.collect()) == [(1, "k000", 1), (1, "k001", 2), (1, "k002", 3)]


def test_empty_index(spark, tmp_path):
    index = VectorIndex.create(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/i")
    q = spark.createDataFrame([("q", [1.0] * index.dimension)], "query string, embedding array<double>")
    assert index.count() == 0 and index.search_vectors(q).count() == 0 and index.search_vectors(q.limit(0)).count() == 0


def by_hand(tokens, d=384):
    """The embedding written out with hashlib."""
    v = [0.0] * d
    for term, w in [(t, 1.0) for t in tokens] + [(f"{a}__{b}", 1.35) for a, b in zip(tokens, tokens[1:])]:
        digest = hashlib.blake2b(term.encode(), digest_size=8).digest()
        v[int.from_bytes(digest[:4], "little") % d] += w if digest[4] % 2 == 0 else -w
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


def test_embedding_by_hashlib(spark):
    lists = [["jahe", "mual", "jahe", "perut"], ["jahe"], [], ["a"] * 30, [f"t{i}" for i in range(400)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, t array<string>").coalesce(1)
    for row in df.select("i", retrieval.hash_embedding("t").alias("v")).collect():
        assert row.v == pytest.approx(by_hand(lists[row.i]), abs=1e-12)


TEXTS = [("case_001", "jahe hangat untuk mual dan muntah"), ("herb_7", "kunyit asam untuk nyeri perut"), ("case_002", "daun sirih untuk luka ringan"), ("f-1", ""), (None, "jahe jahe")]


def test_text_index_has_the_contract_of_tfidf(spark, tmp_path):
    chunks = spark.createDataFrame(TEXTS, "id string, text string")
    index = VectorIndex.of_texts(chunks, f"file://{tmp_path}/i")
    queries = spark.createDataFrame([(1, "mual perlu jahe"), (2, ""), (3, "nyeri perut")], "query int, text string")
    got = index.search(queries, 2)
    assert got.columns == retrieval.TfidfIndex(chunks).search(queries, 2).columns
    best = {r.query: (r.id, r.matched_terms) for r in got.where("rank = 1").collect()}
    assert best[1] == ("case_001", "jahe mual") and best[3][0] == "herb_7" and 2 not in best
    plain = retrieval.HashEmbeddingIndex(chunks).search(queries, 2).collect()
    assert {(r.query, r.id, r.score, r["rank"]) for r in plain} == {(r.query, r.id, r.score, r["rank"]) for r in got.collect()}
    index.insert_texts(spark.createDataFrame([("case_003", "jahe mual perlu")], "id string, text string"))
    assert index.search(queries, 1).where("query = 1").first().id == "case_003"


def test_choice_of_index(spark, tmp_path):
    chunks = spark.createDataFrame(TEXTS, "id string, text string")
    path = f"file://{tmp_path}/i"
    queries = spark.createDataFrame([(1, "mual perlu jahe")], "query int, text string")
    index, backend, reason = choose_index(chunks, path)
    assert backend == "tfidf" and "no index" in reason and index.search(queries, 1).first().id == "case_001"
    VectorIndex.of_texts(chunks, path)
    index, backend, reason = choose_index(chunks, path)
    assert (backend, reason) == ("vectors", None) and index.search(queries, 1).first().id == "case_001"
    assert choose_index(chunks)[1:] == ("tfidf", None)


def test_keys_without_value_take_no_rank(spark):
    docs = spark.createDataFrame([(None, "jahe mual"), (2, "jahe mual perut"), (3, "lain sekali")], "id int, text string")
    got = retrieval.TfidfIndex(docs).search(spark.createDataFrame([(1, "jahe mual")], "query int, text string"), 3).collect()
    assert [(r.id, r["rank"]) for r in got] == [(2, 1)]


def test_exact_search_takes_text_keys(spark):
    rows = clustered(200, 6)
    asked = [(f"q{i}", v) for i, (_, v) in enumerate(clustered(5, 6, 4))]
    got = retrieval.vector_topk(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(asked, "query string, embedding array<double>"), 7)
    assert hits(got) == exact(rows, asked, 7)


def test_centroids_are_units():
    x = vector_index._unit(np.random.default_rng(1).normal(size=(500, 5)))
    c = vector_index.centroids(x, 20)
    assert c.shape == (20, 5) and np.allclose(np.linalg.norm(c, axis=1), 1)
    assert len(vector_index.centroids(x[:3], 20)) == 3
    at, code, scale, error = vector_index.encode(x, c)
    assert (np.linalg.norm(c[at] + code * scale[:, None] - x, axis=1) <= error + 1e-8).all()
