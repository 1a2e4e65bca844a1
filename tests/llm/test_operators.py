"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and further columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from guichet.llm import ann, boosting, langid, lines, lm, mixing, repeats, surrogates, toxicity
from guichet.llm.components import components
from guichet.llm.decontaminate import build_index, contamination, proximity
from guichet.llm.ngram_join import Index, jaccard_classes
from tests.llm import brute


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies of several degrees, a common line, very short and very long texts, nulls and repeated rows."""
    rng = random.Random(5)
    line = words(rng, 12)
    base = words(rng, 120, 10**6).split()
    rows = [(i, " ".join(w if rng.random() > 0.04 * (i % 5) else f"x{rng.randrange(10**6)}" for w in base)) for i in range(30)]
    rows += [(40 + i, f"{words(rng, 60, 10**6)}\n{line}\n{words(rng, rng.randrange(3, 80), 10**6)}") for i in range(30)]
    rows += [(80, None), (81, ""), (82, "  \n\t"), (83, "One two"), (84, "ONE two"), (85, "é ü ñ " * 50), (86, words(rng, 5000, 10**6)), (87, "a" * 3000), (87, "a" * 3000)]
    return rows + [(None, "One two"), (88, rows[0][1].upper().replace("X", "x").replace("W", "w"))]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(d, t, "other", 1, 2.0, "z") for d, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n int, component double, bucket string").repartition(3)


def plain(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_jaccard_classes(docs, corpus):
    assert plain(jaccard_classes(docs), "doc_id", "n_shingles", "component_id") == brute.jaccard(corpus)


def test_jaccard_blocks_of_few_classes(docs, corpus, monkeypatch):
    monkeypatch.setattr("guichet.llm.ngram_join.BLOCK_CLASSES", 4)
    assert plain(jaccard_classes(docs), "doc_id", "n_shingles", "component_id") == brute.jaccard(corpus)


def test_jaccard_of_two_classes_whose_head_lies_elsewhere(spark):
    """Passages in a chain: D shares with C, C with h, h with x and y, so x and y are a cluster without its head C."""
    rng = random.Random(11)
    a, b, e, g = (words(rng, n, 10**9) for n in (700, 1000, 1500, 150))
    own = lambda n: words(rng, n, 10**9)
    rows = [(1, e), (2, f"{b} {e} {own(30)}"), (3, f"{a} {b} {own(50)}"), (4, f"{a} {g} {own(100)}"), (5, f"{a} {g} {own(100)}")]
    want = brute.jaccard(rows)
    assert (5, 946, 4) in want
    found = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert plain(found, "doc_id", "n_shingles", "component_id") == want


@pytest.mark.parametrize(("short", "block"), [(16, 512), (2, 8), (1, 3)])
def test_jaccard_of_many_unlinked_documents_with_one_passage(spark, monkeypatch, short, block):
    """A passage in documents that share nothing else, some of them in near copies made far from each other."""
    monkeypatch.setattr("guichet.llm.ngram_join.SHORT", short)
    monkeypatch.setattr("guichet.llm.ngram_join.LIST_BLOCK", block)
    rng = random.Random(12)
    passages = [words(rng, 30, 10**9) for _ in range(3)]
    rows = []
    for i in range(300):
        own = words(rng, rng.randrange(8, 60), 10**9)
        rows.append((3 * i, f"{own} {passages[i % 3]} {passages[(i * 7) % 3]}"))
        if i % 10 == 0:
            rows.append((3 * i + 1, f"{own} {passages[i % 3]} {passages[(i * 7) % 3]} {words(rng, rng.randrange(1, 30), 10**9)}"))
    want = brute.jaccard(rows)
    assert len({c for _, _, c in want}) < len(rows)
    assert plain(jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "doc_id", "n_shingles", "component_id") == want


def test_jaccard_of_nothing(docs):
    assert jaccard_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("many", [1, 10**9])
def test_divide_skip_finds_every_overlap(many, monkeypatch):
    monkeypatch.setattr("guichet.llm.ngram_join.MANY", many)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(60, rng.integers(1, 60))).astype(np.uint64) for _ in range(60)]
    index = Index(sets)
    for q in sets:
        want = [(i, len(np.intersect1d(q, s))) for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))]
        assert sorted(index.divide_skip(q, 75)) == want


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(20, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 20 for i in range(20, 61)} | {100 + i: 100 for i in range(30)}


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(9)
    shared = words(rng, 120, 10**6)
    rows = [(i, words(rng, rng.randrange(1, 60), 10**6) + shared[i : len(shared) - 2 * i] + words(rng, 40, 10**6)) for i in range(12)]
    rows += [(20, shared), (20, shared), (21, None), (22, ""), (23, "b" * 399), (24, "c" * 400), (25, "d" * 401), (26, "é" * 500), (None, shared[5:500]), (27, "e" * 900 + words(rng, 9, 99) + "e" * 400)]
    return rows


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats(spark, passages, hot):
    df = spark.createDataFrame([(d, t, 0) for d, t in passages], "doc_id long, text string, doc int").repartition(3)
    assert plain(repeats.remove_repeats(df, hot=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(passages)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_kept_bytes_match_their_hash(spark, passages):
    df = spark.createDataFrame(passages, "doc_id long, text string")
    changed = repeats.remove_repeats(df).where("kept is not null").collect()
    assert changed and all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in changed)


def test_multikey_sort_orders_and_measures():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 3, (200, 24)).astype(np.uint8)
    body[50:60] = body[40:50]
    group = rng.integers(0, 3, 200)
    order, shared = repeats.multikey_sort(group, body.view(">u8").astype(np.uint64))
    keyed = [(int(group[i]), body[i].tobytes()) for i in order]
    assert keyed == sorted(keyed)
    for k in range(1, 200):
        a, b = keyed[k - 1], keyed[k]
        same = next((i for i in range(24) if a[1][i] != b[1][i]), 24)
        assert shared[k] == (-1 if a[0] != b[0] else same)


@pytest.fixture(scope="module")
def benchmark_rows():
    rng = random.Random(2)
    items = [(i, words(rng, 30, 500)) for i in range(8)] + [(20, "Short item."), (21, None), (22, " ... "), (20, "Short item."), (None, words(rng, 20))]
    found = [(i, f"{words(rng, 50)}. {items[i][1].upper()}! {words(rng, 10)}") for i in range(4)]
    found += [(10, items[5][1][: len(items[5][1]) // 2]), (11, "it is a SHORT-item"), (12, None), (13, ""), (13, ""), (14, " ".join(t for _, t in items[:8])), (None, items[1][1]), (15, words(rng, 4000))]
    return found, items


@pytest.mark.parametrize("passes", [1 << 23, 200])
def test_contamination(spark, benchmark_rows, passes, monkeypatch):
    monkeypatch.setattr("guichet.llm.decontaminate.PASS_CHARS", passes)
    found, items = benchmark_rows
    df = spark.createDataFrame([(d, t, "x") for d, t in found], "doc_id long, text string, block string").repartition(2)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert plain(contamination(df, asked), "doc_id", "n_words", "n_hit", "items") == brute.contaminated(found, items)
    assert contamination(df.limit(0), asked).count() == 0
    assert contamination(df, asked.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    df = spark.createDataFrame([(1, "red x green y blue"), (2, "red a b c d e f g h i green blue"), (3, "blue. green? RED!"), (4, None)], "doc_id long, text string")
    near = proximity(build_index(df), spark.createDataFrame([(9, "red green blue")], "item_id long, text string"), 5)
    assert plain(near, "doc_id", "start", "stop") == [(1, 0, 5), (3, 0, 3)]


def test_nearest_is_exact_with_all_leaves_and_skips_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "TARGET", 2.0)
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=6).astype(np.float32).tolist() for i in range(600)}
    vectors |= {i: vectors[0] for i in range(600, 640)}
    bad = [(700, None), (800, [0.0] * 6), (900, [float("nan")] * 6), (1000, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1100, [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame([*vectors.items(), *bad, (0, vectors[0])], "vec_id long, embedding array<float>")
    found = ann.nearest(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect()
    got: dict = {}
    for r in found:
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute.nearest({k: np.array(v, float) for k, v in vectors.items()}, [q for q in vectors if q % 100 == 0], 10)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few, F.lit(True), 10).orderBy("query_id").collect()] == [(0, 1, 1, 0.5), (1, 1, 0, 0.5)]
    assert ann.nearest(few.limit(0), F.lit(True), 10).count() == 0


def test_language(spark):
    rng = random.Random(1)
    en, fr = "the of and that with this from which".split(), "le des une qui dans pour être avec".split()
    rows = [(i, " ".join(rng.choice(en if i % 2 else fr) for _ in range(40)), "en" if i % 2 else "fr") for i in range(60)] + [(90, "the", None), (91, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    asked = spark.createDataFrame([(1, "That THE with, which 12"), (2, "une être dans"), (3, None), (4, "12 .. !"), (5, ""), (5, ""), (None, "avec des")], "doc_id long, text string")
    found = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(asked, model).collect()}
    assert found == {(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (None, "fr")}
    assert {r["lang_pred"] for r in langid.identify(asked, langid.fit(df.limit(0))).collect()} == {"und"}


def test_kneser_ney_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    grams = np.unique(rng.integers(97, 101, (200, langid.ORDER)).astype(np.uint32), axis=0)
    model = langid.kneser_ney(["a"], np.zeros(len(grams), int), grams, rng.integers(1, 5, len(grams)).astype(float))
    hashes, logs = model.grams[0]
    alphabet = np.unique(grams)
    context = grams[0, :-1]
    total = 0.0
    for letter in [*alphabet, 7]:
        tail, p = np.append(context, letter).astype(np.uint32), 0.0
        for k, (table, values) in enumerate(model.grams):
            key = langid._hash_rows(tail[None, k:])[0]
            if key in table:
                p += values[np.searchsorted(table, key)][0]
                break
            if k < langid.ORDER - 1:
                contexts, weights = model.backs[k]
                key = langid._hash_rows(tail[None, k:-1])[0]
                p += weights[np.searchsorted(contexts, key)][0] if key in contexts else 0.0
        else:
            p += model.unseen[0]
        total += 2.0**p
    assert total == pytest.approx(1, abs=1e-4)


def test_toxicity(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 40) + (" you utter vilescum, " if i % 4 == 0 else " ") + words(rng, 40)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(500)] + [(1, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    scored = {r["doc_id"]: r["toxicity"] for r in toxicity.score(df, model, "doc_id").where("doc_id >= 500").collect()}
    assert all((s >= 0.3) == (i % 4 == 0) and 0 <= s <= 1 for i, s in scored.items())
    odd = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (None, "vilescum", "k"), (3, "v1l3scum", "k")], "doc_id long, text string, x string")
    assert toxicity.score(odd, model, "doc_id", "x").count() == 4
    empty = toxicity.fit(df, labels.limit(0))
    assert {r["toxicity"] for r in toxicity.score(odd, empty, "doc_id").collect()} == {0.0}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(2)
    margin = rng.normal(size=500)
    knots, values = boosting.fit_isotonic(margin, (rng.random(500) < 1 / (1 + np.exp(-margin))).astype(float))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all() and 0 <= values.min() and values.max() <= 1


def test_language_model(spark):
    rng = random.Random(6)
    chain = lambda: " ".join(f"w{(k + rng.randrange(60)) % 60 if rng.random() < 0.2 else k}" for k in [j % 60 for j in range(rng.randrange(60), 160)])
    rows = [(i, chain(), i % 7 != 2) for i in range(60)] + [(100, None, True), (101, "", False), (102, "Never Seen never", False), (None, "w1 w2", True), (3, words(random.Random(8), 9), True), (3, words(random.Random(8), 9), True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, trains boolean").repartition(3)
    key = lambda r: (str(r[0]), r[1])
    found = sorted((tuple(r) for r in lm.score(df).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score").collect()), key=key)
    for a, b in zip(found, sorted(brute.base_scores(rows), key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])
    held = lm.score(df).where("doc_id % 7 = 2 and doc_id < 60").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]
    assert lm.score(df.limit(0)).count() == 0
    assert lm.score(df.where("not trains")).where("train_tokens > 0").count() == 0


def test_language_model_keeps_every_context(spark):
    rng = random.Random(9)
    follow = list(range(3000))
    rng.shuffle(follow)

    def walk(n):
        k, out = rng.randrange(3000), []
        for _ in range(n):
            out.append(f"w{k}")
            k = follow[k]
        return " ".join(out)

    df = spark.createDataFrame([(i, walk(100), i < 200) for i in range(210)], "doc_id long, text string, trains boolean").repartition(3)
    held = lm.score(df).where("not trains").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert held > -1.2  # single words give -3.5


def test_language_model_counts_every_word_however_texts_are_split(spark):
    """Every word occurs twice in all, with more than a megabyte in one partition or far less in each of eight."""
    rows = [(i, " ".join(f"{(200 * i + j) % 6000:0100d}" for j in range(200)), True) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, trains boolean")
    one, many = ({r["doc_id"]: r["score"] for r in lm.score(df.repartition(n, "doc_id")).collect()} for n in (1, 8))
    assert len(one) == 60 and all(one[i] == pytest.approx(many[i]) for i in one)


def test_seating_keeps_between_one_table_and_one_for_each_customer():
    customers = np.array([0, 1, 2, 24, 25, 1000])
    tables = lm.seat(customers, np.full(6, 0.1), np.minimum(customers, 1), 1.0, 0.5, np.random.default_rng(0))
    assert (tables <= customers).all() and (tables[1:] >= 1).all() and tables[0] == 0
    assert np.exp(lm.stirling(0.0, 5)[5, 1:]).round().tolist() == [24, 50, 35, 10, 1]


def test_lines(spark):
    rows = [(i, "s", f"a {i}\n menu \nb\n\nmenu" if i < 4 else f"c {i}\nmenu2") for i in range(10)] + [(20, None, "menu\nx"), (21, "s", None), (22, "s", ""), (22, "s", "")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, source string, text string, marks int")
    out = lines.drop_boilerplate(df, per_mille=200, least=3)
    assert out.columns == ["doc_id", "source", "text", "marks", "_lines", "_dropped"]
    got = {(r["doc_id"], r["text"], r["_dropped"]) for r in out.collect()}
    assert got == {(i, f"a {i}\n", 3) for i in range(4)} | {(i, f"c {i}", 1) for i in range(4, 10)} | {(20, "menu\nx", 0), (21, None, 0), (22, "", 0)}
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    rows = [(i, "big", "a b c d e f g h i j") for i in range(300)] + [(1000 + i, "small", "a b c") for i in range(40)] + [(2000 + i, None, "a b") for i in range(30)] + [(3000, "small", None), (None, "big", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, block int")
    out = mixing.mix(df, entropy=0.9, repeats=3.0).cache()
    spent = {r["source"]: r["t"] for r in out.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = 300 * 10 + 40 * 3 + 30 * 2
    assert sum(spent.values()) <= total and sum(spent.values()) > 0.97 * total
    assert spent["small"] <= 3 * 120 and spent[None] <= 3 * 60
    assert spent["big"] < 3000 and max(spent["small"] / 120, spent[None] / 60) > 2.8
    assert out.groupBy("doc_id", "source", "epoch").count().where("count > 1").count() == 0
    assert out.groupBy("source", "epoch").agg(F.countDistinct("place").alias("n"), F.max("place").alias("m")).where("n <> m").count() == 0
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df.where("doc_id = 3000")).count() == 0


def test_mixing_as_found_with_exponent_one(spark):
    sources = spark.createDataFrame([(1000,), (10,)], "tokens long")
    assert mixing.exponent(sources, 1010.0, entropy=0.0, repeats=99.0) == pytest.approx(1, abs=1e-6)
    assert mixing.exponent(sources, 1010.0, entropy=1.0, repeats=99.0) == pytest.approx(0, abs=1e-4)
    assert mixing.exponent(sources, 1010.0, entropy=1.0, repeats=2.0) == pytest.approx(0.845, abs=0.02)


def test_surrogates(spark):
    text = "Mr. Smith met Mrs Jones Anne; Mr Smith, +1 (663) 555-6869 or +16635556869; 4111 1111 1111 1111 / 4111111111111111, 10.0.0.7, A@B.COM a@b.com " + "0123456789abcdef" * 2 + "01234567"
    df = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5), (3, "", 5), (None, "госпожа Иванова", 5), (4, "x 10.0.0.7 y", 5)], "doc_id long, text string, kind int")
    got = {(r["doc_id"], r["_kinds"]): r["text"] for r in surrogates.replace(df).collect()}
    out = got[(1, "CARD,EMAIL,IP,PERSON,PHONE,SECRET")]
    for private in ("Smith", "Jones", "663", "6869", "4111 1111", "10.0.0.7", "A@B.COM", "a@b.com", "0123456789abcdef"):
        assert private not in out
    names = out.split(" ")
    assert names[0] == "Mr." and names[6:8] == ["Mr", names[1] + ","] and names[1].istitle()
    plain_phone = out.split(" or ")[1].split(";")[0]
    assert "".join(c for c in out.split(", ")[1].split(" or ")[0] if c.isdigit()) == plain_phone[1:] and plain_phone.startswith("+1")
    spaced, joined = out.split("; ")[2].split(", ")[0].split(" / ")
    assert spaced.replace(" ", "") == joined and joined[0] == "4"
    digits = [int(d) for d in joined]
    assert (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0
    address = got[(4, "IP")].split(" ")[1]
    assert address.startswith("10.") and f" {address}, " in out
    assert got[(None, "PERSON")].startswith("госпожа ") and got[(None, "PERSON")] != "госпожа Иванова"
    assert got[(2, "")] is None and got[(3, "")] == ""
    assert surrogates.replace(df.limit(0)).count() == 0


def test_surrogates_stay_distinct_in_a_crowded_space(spark):
    df = spark.createDataFrame([(i, f"{i % 9 + 1}.{i // 9 % 9 + 1}.{i // 81 % 9 + 1}.{i // 729 + 1}") for i in range(5000)], "doc_id long, text string")
    table = surrogates.assign(df.select(F.lit("IP").alias("kind"), F.col("text").alias("canonical")), "k")
    taken = {r["text"] for r in df.collect()}
    drawn = [r["surrogate"] for r in table.collect()]
    assert len(drawn) == len(set(drawn)) == 5000 and not taken & set(drawn)
