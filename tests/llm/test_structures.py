"""Spelling variants, the prefix trie of conversations and the URL filter against plain versions, on awkward small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from guichet.llm import prefix_trie, spelling, url_filter
from tests.llm.brute import spaced


def plain_variants(occurrences, shortest, least, ratio):
    counts = {w: n for w, n in Counter(w for w in occurrences if w is not None).items() if n >= least and len(w) >= shortest}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, number = {}, {}
    for w in counts:
        others = [v for v in counts if near(w, v)]
        number[w] = len(others)
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, number[w], counts[form[w]] if w in form else None))
    return sorted(out)


@pytest.fixture(scope="module")
def occurrences():
    """Words over few letters, so that neighbours abound: ties, chains of forms, runs of equal letters, accents, astral code points, long words, nulls."""
    rng = random.Random(1)
    rows = [None, None, "", "abc"]
    for _ in range(300):
        rows += ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 9)))] * rng.choice([1, 2, 3, 4, 6, 9, 20, 50])
    return rows + ["x" * 3000] * 3 + ["x" * 2999] * 9 + ["x" * 150 + "y" + "x" * 149] * 3 + ["a\U0001f600bcd"] * 3 + ["a\U0001f600bc"] * 7 + ["frequent"] * 2000


@pytest.mark.parametrize("shortest, ratio", [(1, 2), (5, 2), (5, 3)])
def test_variants(spark, occurrences, shortest, ratio):
    df = spark.createDataFrame([(w, 1, "z") for w in occurrences], "token string, n int, id string").repartition(5)
    found = spelling.variants(df, "token", shortest=shortest, ratio=ratio)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in found.collect()) == plain_variants(occurrences, shortest, 3, ratio)


def test_variants_of_nothing_and_of_one_partition(spark):
    df = spark.createDataFrame([("abcde",)] * 4 + [("abcd",)] * 9, "word string")
    assert spelling.variants(df.limit(0)).count() == 0
    assert sorted(tuple(r) for r in spelling.variants(df.coalesce(1), shortest=4).collect()) == [("abcd", None, "abcd", 9, 1, None), ("abcde", "abcd", "abcd", 4, 1, 9)]
    with pytest.raises(ValueError):
        spelling.variants(df, ratio=1)


def test_equal_prefixes_have_one_number_over_all_partitions(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(500)})
    paths = spelling.trie_paths(spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(7), F.col("word")).collect()
    number = defaultdict(set)
    for r in paths:
        for i, node in enumerate(r["nodes"]):
            number[r["word"][:i]].add(node)
    assert len(paths) == len(words) and all(len(v) == 1 for v in number.values())
    assert len({min(v) for v in number.values()}) == len(number)
    assert [r["word"] for r in sorted(paths, key=lambda r: r["nodes"][-1])] == words


def plain_trie(rows, rebuild):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(role, text) for _, _, role, _, text in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in sorted(built.items()):
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children, leaves, saved = Counter(n[:-1] for n in members if n), Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(m) - 1) * len(spaced(n[-1][1])) if n else 0
    ends = {n: ",".join(str(c) for c in m if len(built[c]) == len(n)) for n, m in members.items()}
    return sorted(((m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()), key=str)


@pytest.fixture(scope="module")
def conversations():
    """Few distinct turns, null and tied turns, repeated rows, absent bases, long chains that part late, a crowd of copies."""
    rng = random.Random(2)
    rows = []
    for c in [*range(90), -7, -20, 1000, 1013]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t if rng.random() > 0.1 or t else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d e f"])))
    rows += [(5000, t, "u", f"w {t} x") for t in range(150)] + [(5001, t, "u", f"w {t} x") for t in range(120)] + [(5002, t, "u", f"w {t} x" if t < 60 else "z") for t in range(100)]
    rows += [(6000 + i, t, "u", f"same {t}") for i in range(100) for t in range(3)] + [(7000, 0, "u", "long " * 100_000)]
    return rows + [(None, 1, "u", "x"), *rows[:3]]


@pytest.mark.parametrize("local, rebuild", [(prefix_trie.LOCAL, True), (40, True), (1, False)])
def test_prefix_trie(spark, conversations, local, rebuild):
    """`local` of 1 splits every component by joins, the usual one all of them within a task."""
    rows = [(*r, 1, b"x") for r in conversations]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, node binary").repartition(5)
    ids = df.where("conv_id is not null").select("conv_id").distinct()
    heads = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("shared"))
    found = prefix_trie.prefix_trie(df, heads if rebuild else None, local)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_trie(conversations, rebuild)


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_digest_of_many_ids_is_that_of_one_text(spark, monkeypatch):
    monkeypatch.setattr("guichet.llm.prefix_trie._PIECE", 50)
    ids = [i * 7 for i in range(2000)]
    last = spark.createDataFrame([(b"a" if i % 3 else b"b", i) for i in ids], "node binary, conv_id long").repartition(5)
    want = {n: hashlib.sha256(",".join(str(i) for i in ids if (i % 3 == 0) == (n == b"b")).encode()).hexdigest() for n in (b"a", b"b")}
    assert {bytes(r["node"]): r["ends_sha256"] for r in prefix_trie.ends_of(last).collect()} == want


ENTRIES = [
    ("org", "/", True, "allow"), ("example.org", "/es/", True, "block"), ("example.org", "/en/1", True, "block"), ("com", "/fr/", True, "allow"), ("com", "/de/", True, "block"),
    ("bad.net", "", False, "block"), ("q.net", "/one", False, "block"), ("ORG", "/", False, "block"), (None, "/", True, "block"), ("q.net", None, False, "allow"),
]
URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/x", "http://a.example.org/en/12?x=/en/1", "x://org/", "x://org", "http://a.b.org", "http://badorg/",
    "http://x.com/fr/", "http://x.com/de/1", "http://y.bad.net/p", "http://bad.net", "http://nobad.net/", "http://q.net/one/two", "http://q.net/on", "a://b://c/d",
    "http://u@h:80/é#?", "http://com/fr/#", "http://ü.com/de/", "\n://org/\n/x", "http://" + "a." * 5000 + "org/" + "b" * 200_000, "http://.org/", "http://org./",
]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h.lower(), p or "", rule, verdict) for h, p, rule, verdict in ENTRIES if h is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")]
    rules = sorted(((len(h + p), len(h), h + p, v) for h, p, rule, v in fits if rule), reverse=True)
    if rules:
        return host, path, rules[0][2], rules[0][3]
    return host, path, None, "block" if any(v == "block" and (h, p, True, "allow") not in fits for h, p, rule, v in fits) else "allow"


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "host string, path string, rule boolean, verdict string")


@pytest.mark.parametrize("limit", [url_filter.LIMIT, 0])
def test_url_filter_by_file_and_by_joins(spark, entries, limit):
    pages = spark.createDataFrame([(i % 23, u, "x") for i, u in enumerate(URLS * 3)], "page_id long, url string, entry string").repartition(3)
    found = url_filter.judge(pages, entries, keep=("page_id", "entry"), limit=limit)
    assert found.columns == ["page_id", "entry", "host", "path", "rule", "verdict"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(((i % 23, "x", *plain_verdict(u)) for i, u in enumerate(URLS * 3)), key=str)


def test_url_filter_of_nothing_and_without_entries(spark, entries):
    pages = spark.createDataFrame([(1, "http://bad.net/")], "page_id long, url string")
    assert url_filter.judge(pages.limit(0), entries).count() == 0
    for limit in (url_filter.LIMIT, -1):
        assert [tuple(r) for r in url_filter.judge(pages, entries.limit(0), limit=limit).collect()] == [(1, "bad.net", "/", None, "allow")]
    with pytest.raises(ValueError):
        url_filter.judge(pages.withColumn("host", F.lit(1)), entries, keep=("host",))


def test_equal_keys_are_told_apart_by_their_strings(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr("guichet.llm.url_filter.xxhash.xxh64_intdigest", lambda s: len(s))
    strings = ["aa", "bb", "cc", "dddd"]
    url_filter.DigestArray.write(str(tmp_path / "d"), pa.table({"key": [2, 2, 2, 4], "entry": strings, "flags": [0, 1, 2, 3]}))
    array = url_filter.DigestArray(str(tmp_path / "d"), 4)
    assert array.flags_of(["cc", "bb", "xx", "dddd", "e", "aa", "zzzzz"]) == [2, 1, None, 3, None, 0, None]
