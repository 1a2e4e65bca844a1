"""Chunking by expressions against the plain row-by-row packer, on random structured texts."""

import random

import pytest

from guichet.operators import chunking
from guichet.params import Params
from tests.plain_chunks import pack_page

SCHEMA = "doc string, title string, doc_type string, client_id string, pages array<struct<number:int,text:string>>"


def random_page(rng):
    word = lambda: rng.choice(["mot", "é", "délai.", "x" * rng.randrange(1, 30), "fin;", "a:b", "#", "##x", "y" * 130])
    line = lambda: " ".join(word() for _ in range(rng.choice([1, 3, 6, 12, 60]))) + rng.choice(["", "  ", "\t"])
    kinds = ["", "  ", "# Titre", "###### Sous  ", "####### sept", "# ", "#sans", "  # retrait"]
    return rng.choice(["\n", "\n", "\r\n", " "]).join(rng.choice(kinds) if rng.random() < 0.35 else line() for _ in range(rng.randrange(0, 25)))


def plain(doc, pages, size, overlap):
    out, section = [], ""
    for number, text in pages or []:
        packed, section = pack_page(text or "", section, size, overlap)
        out += [(f"{doc}#p{number}-{n}", number, n, s, t) for n, (s, t) in enumerate(packed, 1)]
    return out


@pytest.mark.parametrize(("size", "overlap"), [(40, 0), (60, 30), (100, 99), (160, 60), (900, 150)])
def test_chunks_equal_the_plain_packer(spark, size, overlap):
    rng = random.Random(size)
    rows = [(f"d{i}", "T", "note", None, [(n, random_page(rng)) for n in sorted(rng.sample(range(1, 9), rng.randrange(0, 4)))]) for i in range(400)]
    rows += [("null", None, None, "C", None), ("none", None, None, None, [(1, None), (2, ""), (4, "\n \n")]), ("long", "T", "note", None, [(1, "# S\n" + "mot phrase. " * 4000)])]
    got = chunking.chunk_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), Params(chunk_size=size, chunk_overlap=overlap))
    want = [c for doc, _, _, _, pages in rows for c in plain(doc, pages, size, overlap)]
    assert sorted(tuple(r) for r in got.select("chunk_id", "page", "number", "section", "text").collect()) == sorted(want)


def test_sizes_are_checked(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for size, overlap in [(0, 0), (10, 10), (10, -1)]:
        with pytest.raises(ValueError):
            chunking.chunk_documents(docs, Params(chunk_size=size, chunk_overlap=overlap))
    assert chunking.chunk_documents(docs).count() == 0
