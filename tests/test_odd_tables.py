"""Named queries on documents with blank, missing and unusual texts, next to their SQL counterpart."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.check_queries import TABLES, compare
from tests.test_queries import SF

TEXTS = [
    "", " ", "\n \n", None, ".", "###", "Avis reçu.", "# Titre\nTexte", "  \n début et fin \n\t", "\xa0fin\xa0", "a\r\nb\r\n", "a\x0cb", "a\u2028b", "---\nx: y\n---\nz",
    "e\u0301te\u0301 nai\u0308f", "Œuvre à l’ÉTÉ, STRASSE ß", "½ ² ™ №5", "ő", "\u0130stanbul", "日本",
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Folder whose documents hold every text in every language, half of them labelled; the other tables are the smallest ones."""
    folder = tmp_path_factory.mktemp("odd")
    for name in set(TABLES) - {"documents", "labels"}:
        os.symlink(f"{SF}/{name}.parquet", folder / f"{name}.parquet")
    rows = [(text, lang) for text in TEXTS for lang in ("en", "fr", "de", "es", None)]
    ids = range(1, len(rows) + 1)
    documents = {
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array([t for t, _ in rows], pa.string()), "lang": pa.array([lang for _, lang in rows], pa.string()),
        "source": pa.array([None if i % 11 == 0 else f"src{i % 20}" for i in ids], pa.string()), "n_chars": pa.array([len(t or "") for t, _ in rows], pa.int64()),
    }
    labelled = [i for i in ids if i % 2]
    labels = {
        "doc_id": pa.array(labelled, pa.int64()), "quality": pa.array([i // 2 % 2 for i in labelled], pa.int32()), "toxic": pa.array([int(i % 5 == 0) for i in labelled], pa.int32()),
    }
    pq.write_table(pa.table(documents), folder / "documents.parquet")
    pq.write_table(pa.table(labels), folder / "labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["front_matter", "manifest_orphans", "word_sequences"])
def test_query_matches_its_sql_on_odd_texts(spark, odd, name):
    verdict = compare(spark, odd, name)
    assert verdict.startswith("ok"), verdict
