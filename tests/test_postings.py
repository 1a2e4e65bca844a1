"""The stored block index against the search that reads the corpus, and against plain counts."""

import random
import re
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from guichet.operators import lexical, postings
from guichet.params import Params

NARROW = Params(block_width=8, first_blocks=1, bounded_from=0)


def words(rng, n):
    return [f"w{min(int(rng.paretovariate(0.7)), 300)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Skewed words, owners, empty and null token lists, equal documents, positions with gaps and below zero."""
    rng = random.Random(7)
    rows = [(f"c{i}", 3 * i - 50, rng.choice([None, None, "a", "b"]), words(rng, rng.randrange(0, 60))) for i in range(300)]
    rows += [("null", 2000, None, None), *((f"same{i}", 3000 + i, None, ["w1", "w2", "w2"]) for i in range(20))]
    return spark.createDataFrame(rows, "chunk_id string, pos long, client_id string, tokens array<string>").repartition(4)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "a", "b"]), words(rng, rng.randrange(1, 12))) for i in range(40)] + [(90, None, []), (91, None, None), (92, None, ["unknown"])]
    return spark.createDataFrame(rows, "query_id long, client_id string, tokens array<string>")


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return postings.build(corpus, str(tmp_path_factory.mktemp("index") / "i"), {"mode": "bm25"}, NARROW)


def hits(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["pos"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("n", [1, 4, 50])
def test_index_finds_what_the_scan_finds(corpus, asked, index, n):
    assert hits(postings.bm25_index(index, asked, n, params=NARROW)) == hits(lexical.bm25_topk(corpus, asked, n))


def test_without_scope_owners_do_not_matter(corpus, asked, index):
    assert hits(postings.bm25_index(index, asked, 4, scoped=False, params=NARROW)) == hits(lexical.bm25_topk(corpus.drop("client_id"), asked.drop("client_id"), 4))


def test_question_sets_beyond_the_broadcast_bound(corpus, asked, index):
    assert hits(postings.bm25_index(index, asked, 4, params=replace(NARROW, broadcast_rows=3))) == hits(lexical.bm25_topk(corpus, asked, 4))


def test_other_settings_open_every_block(corpus, asked, index):
    other = replace(NARROW, bm25_k1=0.9, bm25_b=0.2)
    assert not index.bounded(other) and index.bounded(NARROW) and not index.bounded(replace(NARROW, bounded_from=1000))
    assert hits(postings.bm25_index(index, asked, 4, params=replace(NARROW, bounded_from=1000))) == hits(lexical.bm25_topk(corpus, asked, 4))
    assert hits(postings.bm25_index(index, asked, 4, params=other)) == hits(lexical.bm25_topk(corpus, asked, 4, other))


def test_bounds_hold_and_shut_blocks_out(corpus, asked, index):
    terms = lexical.query_terms(asked).join(index.terms.select("term", "idf"), "term")
    bounds = {(r["query_id"], r["block"]): r["bound"] for r in postings.block_bounds(index, terms).collect()}
    every = hits(postings.bm25_index(index, asked, 10**6, scoped=False, params=NARROW))
    assert all(score <= bounds[q, pos // 8] + 1e-6 for q, _, _, pos, score in every)
    floors = {q: score for q, rank, _, _, score in every if rank == 4}
    shut = [k for k, bound in bounds.items() if bound + 1e-6 < floors.get(k[0], 0)]
    assert len(shut) > len(bounds) / 4


def test_tables_of_the_index(corpus, index):
    rows = [(r["pos"], r["tokens"]) for r in corpus.collect()]
    df = Counter(t for _, tokens in rows for t in set(tokens or []))
    cf = Counter(t for _, tokens in rows for t in tokens or [])
    assert {r["term"]: (r["df"], r["cf"]) for r in index.terms.collect()} == {t: (df[t], cf[t]) for t in df}
    assert index.blocks.where((F.size("entries") != F.col("n")) | (F.size("entries") > 8)).isEmpty()
    assert index.manifest["n"] == len(rows) and index.manifest["mode"] == "bm25" and index.manifest["created"] is not None
    for r in index.forward.collect():
        assert {x["term"]: x["tf"] for x in r["runs"]} == Counter(dict((p, t) for p, t in rows)[r["pos"]] or [])


def test_positions_of_another_kind_are_numbered_in_order(corpus, asked, tmp_path):
    other = corpus.withColumn("pos", F.struct(F.lit("d").alias("doc"), F.col("pos").alias("page")))
    found = postings.bm25_index(postings.build(other, str(tmp_path / "i"), params=NARROW), asked, 4, params=NARROW)
    want = hits(lexical.bm25_topk(corpus, asked, 4))
    assert [(q, r, c, p["page"], s) for q, r, c, p, s in hits(found)] == want


def test_index_of_nothing_and_without_manifest(spark, corpus, asked, tmp_path):
    empty = postings.build(corpus.limit(0), str(tmp_path / "i"), params=NARROW)
    assert postings.bm25_index(empty, asked, 4, params=NARROW).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        postings.open_index(spark, str(tmp_path / "none"))


def test_blocks_are_whole_in_every_slice_and_batch(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "_SLICE", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index = postings.build(corpus, str(tmp_path / "i"), params=NARROW)
        got = {(r["term"], r["block"]): (r["n"], r["cf"], [tuple(e) for e in r["entries"]]) for r in index.blocks.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert index.blocks.count() == len(got)
    want = {}
    for r in corpus.collect():
        for term, tf in Counter(r["tokens"] or []).items():
            want.setdefault((term, r["pos"] // 8), []).append((r["pos"], tf, len(r["tokens"]), r["client_id"]))
    assert got == {k: (len(v), sum(e[1] for e in v), sorted(v)) for k, v in want.items()}


def test_search_tasks_follow_the_pairs_of_documents_and_questions(corpus, asked, index, monkeypatch):
    monkeypatch.setattr(postings, "_PAIRS", 1000)
    tasks = -(-index.manifest["n"] * asked.count() // 1000)
    for params in (NARROW, replace(NARROW, bounded_from=1000)):
        found = postings.bm25_index(index, asked, 4, params=params)
        moved = re.findall(r"RepartitionByExpression \[block#\d+L?\], (\d+)", found._jdf.queryExecution().optimizedPlan().toString())
        assert set(moved) == {str(tasks)}
        assert hits(found) == hits(lexical.bm25_topk(corpus, asked, 4))
