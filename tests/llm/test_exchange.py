"""What exchanges of the training-data operators leave on disk, and how they pack and place rows."""

import os
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from guichet.llm import decontaminate, lm
from guichet.llm import kernels as K
from guichet.llm.common import handed_back, staged
from guichet.llm.ngram_join import jaccard_classes
from guichet.session import checkpoint_root


def _exchanged(spark):
    """Files of exchanges that the disk still holds."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for name in files.split("\n") if "shuffle_" in name}


def test_a_stored_table_gives_the_disk_of_its_exchanges_back(spark):
    before = _exchanged(spark)
    rows = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    stored = staged(rows, "freed")
    until = time.time() + 10
    while _exchanged(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _exchanged(spark) - before
    assert stored.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def _folders(spark):
    root = checkpoint_root(spark).removeprefix("file:")
    return {f"{name}/{what}" for name in os.listdir(root) if name.startswith("language-") for what in os.listdir(f"{root}/{name}") if what.startswith("what=")}


def test_language_model_keeps_no_table_that_nothing_reads(spark):
    df = spark.createDataFrame([(i, f"un deux {i % 5} trois", i % 7 != 2) for i in range(40)], "doc_id long, text string, trains boolean")
    before = _folders(spark)
    assert lm.score(df).count() == 40
    assert _folders(spark) <= before


def test_ngram_join_keeps_its_lists_once(spark):
    df = spark.createDataFrame([(i, f"un deux trois quatre cinq six {i % 5} sept") for i in range(40)], "doc_id long, text string")
    root = checkpoint_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    assert jaccard_classes(df).select("component_id").distinct().count() == 5
    assert len([name for name in set(os.listdir(root)) - before if name.startswith("lists-") and os.listdir(f"{root}/{name}")]) == 1


def test_language_model_tasks_hold_one_bucket(spark):
    exchange = lm._Exchange(spark.range(1))
    exchange.buckets = 24
    rows = spark.range(240).selectExpr("0 as what", "int(id % 24) as bucket", "0 as origin", "array(cast('' as binary)) as blobs")
    held = exchange.met(rows).select("bucket", F.spark_partition_id().alias("task")).distinct().groupBy("task").count()
    assert held.count() == 24 and held.agg(F.max("count")).first()[0] == 1


def test_packed_columns_come_back():
    hashes = K.mix(np.arange(1000, dtype=np.uint64))
    for values in (hashes, np.sort(hashes), np.zeros(0, np.uint64), np.arange(9, dtype=np.int32)[::-1], np.array([True, False]), np.array([0.5, -np.inf]), np.array([-3, 2**62])):
        assert (lm._values(lm._blob(values), values.dtype.type) == values).all()
    assert len(lm._blob(np.sort(hashes))) < hashes.nbytes
    assert (np.diff(K.bucket_of(np.sort(hashes), 7).astype(int)) >= 0).all() and set(K.bucket_of(hashes, 7)) == set(range(7))


def test_language_model_asks_fewer_buckets_of_words_than_it_has_of_pairs(spark, monkeypatch):
    """Every bucket of pairs asks every bucket of words in every sweep: the rows must not grow with the square of the buckets."""
    sent, put = [], lm._Exchange.put

    def counted(exchange, rows, *whats, further=False):
        put(exchange, rows, *whats, further=further)
        sent.extend(exchange.stored[what][-1].count() for what in whats if what in (lm._ASKED, lm._SUMS, lm._ANSWERS))

    monkeypatch.setattr(lm._Exchange, "put", counted)
    df = spark.createDataFrame([(i, " ".join(f"mot{(i * j) % 211}" for j in range(1, 60)), i % 7 != 2) for i in range(200)], "doc_id long, text string, trains boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = lm.score(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 200 and all(r["n_tokens"] == 60 for r in found)
    assert 0 < max(sent) <= 16 * 8


def test_hashing_words_takes_little_beside_the_text():
    """The pipeline's tasks share an executor's memory: work arrays must not be thirty times the text."""
    data = np.frombuffer(b"mots de taille Egale " * 100_000, np.uint8)
    starts, ends, _ = K.words(data, np.array([0, len(data)]), K.SPACED)
    tracemalloc.start()
    try:
        found = K.word_hashes(data, starts, ends)
        assert tracemalloc.get_traced_memory()[1] < 8 * len(data)
    finally:
        tracemalloc.stop()
    assert len(found) == 400_000 and (found.reshape(-1, 4) == K.word_hashes(data, starts[:4], ends[:4])).all()


def test_rows_of_the_positional_index_are_opened_one_at_a_time():
    texts = ["", "un deux", None, "trois " * 50_000]
    batch = pa.record_batch({"doc_id": pa.array([1, 2, None, 4], pa.int64()), "text": pa.array(texts)})
    index = pa.Table.from_batches([b for _ in range(20) for b in decontaminate._indexer(None)([batch])] + list(decontaminate._indexer(None)([batch.slice(0, 1)]))).combine_chunks().to_batches()
    tracemalloc.start()
    try:
        for _, ids, first, words, terms, heads, places in decontaminate._opened(index):
            assert len(first) == len(ids) + 1 and first[-1] == words == len(places) == heads[-1] and len(terms) == len(heads) - 1
        assert tracemalloc.get_traced_memory()[1] < 1_000_000
    finally:
        tracemalloc.stop()
    assert ids == [1] and words == 0


def test_a_task_that_is_done_hands_its_rows_on():
    assert list(handed_back(lambda rows: (r + 1 for r in rows))([1, 2])) == [2, 3]
