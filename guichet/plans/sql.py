"""Pieces of SQL shared by the reference statements (DuckDB dialect)."""

from __future__ import annotations

from guichet.functions.text import STOPWORDS
from guichet.params import DEFAULTS as P

_STOP = "[" + ",".join(f"'{w}'" for w in STOPWORDS) + "]"
WORDS = "regexp_extract_all(lower({0}), '[0-9a-zà-öø-ÿœæ]+')"


def words(text: str) -> str:
    return WORDS.format(text)


def tokens(text: str) -> str:
    """Content tokens without stemming."""
    kept = f"list_filter({words(text)}, lambda w: NOT list_contains({_STOP}, w) AND (length(w) >= 2 OR regexp_matches(w, '[0-9]')))"
    return f"list_transform({kept}, lambda w: strip_accents(replace(replace(w, 'œ', 'oe'), 'æ', 'ae')))"


DOCS = f"docs AS (SELECT doc_id, lang, source, text, {tokens('text')} AS toks FROM documents)"
ASKED = f"asked AS (SELECT item_id, text AS question, {tokens('text')} AS qtoks FROM benchmark)"
POSTINGS = """
lens AS (SELECT doc_id, len(toks) AS dl FROM docs),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM docs) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qterms AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(qtoks) AS term FROM asked))"""


def scores(visible: str = "TRUE", extra: str = "") -> str:
    """CTE `ranked` (item_id, doc_id, score, rnk): every scored document with its rank."""
    return f"""{DOCS}, {ASKED}, {POSTINGS},
scored AS (
  SELECT q.item_id, p.doc_id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({P.bm25_k1} + 1)
                   / (tf + {P.bm25_k1} * (1 - {P.bm25_b} + {P.bm25_b} * dl / avgdl))), 9) AS score
  FROM qterms q JOIN post p USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id) CROSS JOIN stats {extra}
  WHERE {visible}
  GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rnk FROM scored)"""


def dense(visible: str = "TRUE", extra: str = "", known: str = "JOIN documents d ON d.doc_id = v.vec_id") -> str:
    """CTE `near` (item_id, doc_id, cos, rnk) over the embeddings, of known documents unless told otherwise."""
    return f"""cosines AS (
  SELECT b.item_id, v.vec_id AS doc_id,
         round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS cos
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings v
  {known} {extra}
  WHERE {visible}),
near AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cos DESC, doc_id) AS rnk FROM cosines WHERE cos > 0)"""


FUSED = f"""fused AS (
  SELECT item_id, doc_id, l.rnk AS bm25_rank, n.rnk AS dense_rank, n.cos AS dense_score,
         round(coalesce(1.0::DOUBLE / ({P.rrf_k} + l.rnk), 0) + coalesce(1.0::DOUBLE / ({P.rrf_k} + n.rnk), 0), 12) AS score
  FROM (SELECT * FROM ranked WHERE rnk <= {P.candidate_k}) l
  FULL JOIN (SELECT * FROM near WHERE rnk <= {P.candidate_k}) n USING (item_id, doc_id)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= {P.top_k})"""
