"""Search, fusion, visibility and confidence on small corpora with known scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from guichet.operators import dense, lexical, retrieval
from guichet.params import Params

DOCS = [(0, ["chaudier", "pann", "pann"], None), (1, ["chaudier", "tarif"], None), (2, ["tarif", "astreint", "astreint", "astreint"], None)]


def corpus(spark, docs=DOCS):
    return spark.createDataFrame([(p, p, t, c) for p, t, c in docs], "chunk_id int, pos int, tokens array<string>, client_id string")


def ask(spark, *queries):
    return spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(queries)], "query_id int, tokens array<string>, client_id string")


def brute_bm25(docs, tokens, client=None, k1=1.5, b=0.75):
    n, avg = len(docs), sum(len(t) for _, t, _ in docs) / len(docs)
    out = []
    for pos, toks, owner in docs:
        score = 0.0
        for term in dict.fromkeys(tokens):
            df, tf = sum(term in t for _, t, _ in docs), toks.count(term)
            if tf:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(toks) / avg))
        if score and (owner is None or owner == client):
            out.append((-round(score, 9), pos))
    return sorted(out)


def same(got, want):
    assert [i for _, i in got] == [i for _, i in want]
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-8)


def test_bm25_values_and_repeated_terms(spark):
    got = lexical.bm25_topk(corpus(spark), ask(spark, (["chaudier", "pann", "pann"], None), (["absent"], None)), 4).collect()
    assert {(r["query_id"], r["chunk_id"]): r["score"] for r in got} == pytest.approx({(0, 0): 1.871189, (0, 1): 0.552945}, abs=2e-6)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_bm25_both_plans_against_brute_force(spark, limit):
    rng = np.random.default_rng(3)
    docs = [(i, [f"t{z}" for z in rng.zipf(1.6, rng.integers(0, 30)) if z < 40], [None, "A", "B"][i % 3]) for i in range(120)]
    queries = [([f"t{z}" for z in rng.integers(1, 20, 4)], c) for c in (None, "A", "B", "C") for _ in range(3)]
    params = Params(broadcast_rows=limit, hot_key_rows=20)
    got = lexical.bm25_topk(corpus(spark, docs), ask(spark, *queries), 7, params).collect()
    for i, (tokens, client) in enumerate(queries):
        mine = sorted((-r["score"], r["chunk_id"]) for r in got if r["query_id"] == i)
        same(mine, brute_bm25(docs, tokens, client)[:7])


def test_statistics_stay_global_under_visibility(spark):
    docs = [(0, ["a", "b"], None), (1, ["a"], "X"), (2, ["a"], "X")]
    public = [pair for pair in brute_bm25(docs, ["a"]) if pair[1] == 0]
    got = lexical.bm25_topk(corpus(spark, docs), ask(spark, (["a"], None)), 5).collect()
    same([(-r["score"], r["chunk_id"]) for r in got], public)


@pytest.mark.parametrize("block", [4096, 5])
def test_cosine_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(200, 8))
    vectors[50:60] = vectors[3]  # copies tie: corpus order decides
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    owners = [None if i % 4 else "A" for i in range(200)]
    corpus_df = spark.createDataFrame([(i, i, owners[i], vectors[i].tolist()) for i in range(200)], "chunk_id int, pos int, client_id string, embedding array<double>").repartition(7)
    queries = [(q, "A" if q % 2 else None, vectors[3 + q].tolist()) for q in range(12)]
    asked = spark.createDataFrame(queries, "query_id int, client_id string, embedding array<double>")
    got = dense.cosine_topk(corpus_df, asked, 6, Params(query_block=block)).collect()
    for q, client, vector in queries:
        scores = np.round(vectors @ np.array(vector), 9)
        want = sorted((-s, i) for i, s in enumerate(scores) if s > 0 and (owners[i] is None or owners[i] == client))[:6]
        mine = sorted((-r["score"], r["chunk_id"]) for r in got if r["query_id"] == q)
        assert [i for _, i in mine] == [i for _, i in want]


def test_vector_size_is_checked(spark):
    bad = spark.createDataFrame([(1, [1.0])], "chunk_id int, embedding array<double>")
    with pytest.raises(Exception, match="vector size"):
        dense.check_vectors(bad, 2).collect()


def hits(spark, listed):
    data = [(0, c, p, s, r) for r, (c, p, s) in enumerate(listed, start=1)]
    return spark.createDataFrame(data, "query_id int, chunk_id string, pos int, score double, rank int")


def test_fusion_ranks_and_ties(spark):
    lexical_list = hits(spark, [("a", 0, 3.0), ("b", 1, 2.0)])
    dense_list = hits(spark, [("c", 2, 0.9), ("b", 1, 0.8), ("a", 0, 0.7)])
    got = retrieval.fuse(lexical_list, dense_list, 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["bm25_rank"], r["dense_rank"]) for r in got] == [("a", 1, 3), ("b", 2, 2)]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 63)
    tie = retrieval.fuse(hits(spark, [("z", 9, 1.0)]), hits(spark, [("y", 4, 0.5)]), 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in tie] == ["y", "z"]


@pytest.mark.parametrize(("best", "expected"), [(None, 0.5), (0.10, 0.30), (0.25, 0.30), (0.475, 0.50), (0.70, 0.70), (0.95, 0.70)])
def test_confidence(spark, best, expected):
    asked = spark.createDataFrame([(0, ["pann", "tarif"]), (1, ["x"]), (2, [])], "query_id int, tokens array<string>")
    found = spark.createDataFrame([(0, best, "Pannes", "", "la panne"), (2, best, "a", "b", "c")], "query_id int, dense_score double, title string, section string, text string")
    got = {r["query_id"]: r["confidence"] for r in retrieval.confidence(asked, found).collect()}
    assert got[0] == pytest.approx(expected) and got[1] == 0 and got[2] == 0


def test_scope_and_compatibility(spark):
    df = spark.createDataFrame([(True, "champ"), (True, "texte"), (False, "champ")], "k boolean, o string")
    got = [r[0] for r in df.select(retrieval.scoped_client(F.col("k"), F.col("o"), F.lit("C-1"))).collect()]
    assert got == ["C-1", None, None]
    manifest = spark.createDataFrame([("hybrid", "hash", "hash-256")], "retrieval_mode string, embedding_backend string, embedding_model string")
    assert retrieval.compatible(manifest, {"embedding_backend": "hash", "embedding_model": "hash-256"})
    assert not retrieval.compatible(manifest, {"embedding_backend": "hash", "embedding_model": "other"})
    assert not retrieval.compatible(manifest.withColumn("retrieval_mode", F.lit("bm25")), {})


def test_owned_chunks_of_a_request(spark):
    chunks = spark.createDataFrame([("p", None), ("a", "A"), ("b", "B")], "chunk_id string, client_id string")
    asked = spark.createDataFrame([(1, "A"), (2, None)], "query_id int, client_id string")
    assert [(r["query_id"], r["chunk_id"]) for r in retrieval.visible(chunks, asked).collect()] == [(1, "a")]


@pytest.mark.parametrize("rows", [1, 10**6])
def test_vector_blocks_of_any_size_find_the_same(spark, rows):
    """Several blocks on either side, broadcast or dealt out: owners, ties, copies, other sizes, null and zero vectors."""
    import random
    from dataclasses import replace

    from guichet.operators import dense
    from guichet.params import DEFAULTS

    rng = random.Random(6)
    vector = lambda n=4: [float(rng.randrange(-2, 3)) for _ in range(n)]
    held = [(f"c{i}", i, rng.choice([None, None, "a"]), vector()) for i in range(300)] + [("short", 900, None, vector(3)), ("null", 901, None, None), ("hole", 902, None, [1.0, None, 1.0, 1.0]), ("zero", 903, None, [0.0] * 4), ("empty", 904, None, [])]
    asked = [(i, rng.choice([None, "a", "b"]), vector()) for i in range(40)] + [(50, None, vector(3)), (51, None, None), (52, None, vector(9))]
    vectors = spark.createDataFrame(held, "chunk_id string, pos long, client_id string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, client_id string, embedding array<float>").repartition(2)
    params = replace(DEFAULTS, corpus_block=7, query_block=5, broadcast_rows=rows)
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in dense.cosine_topk(vectors, queries, 6, params, normalize=True).collect())

    def unit(v):
        norm = sum(x * x for x in v) ** 0.5
        return [x / norm for x in v] if norm else v

    want = []
    for q, client, a in asked:
        near = [(-round(sum(x * y for x, y in zip(unit(a), unit(b))), 9), pos, c) for c, pos, owner, b in held if a and b and None not in b and len(a) == len(b) and (owner is None or owner == client)]
        want += [(q, n, c, -s) for n, (s, _, c) in enumerate(sorted(x for x in near if x[0] < 0)[:6], 1)]
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(x[3] - y[3]) < 2e-9 for x, y in zip(got, want))
