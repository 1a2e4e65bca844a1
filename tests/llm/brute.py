"""Plain counterparts of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


def alnum(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def remainder(doc_id, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def jaccard(rows: list[tuple], size: int = 5, percent: int = 75) -> list[tuple]:
    """(doc_id, n_shingles, component) of every row; a null id has no component."""
    sets = []
    for _, text in rows:
        w = spaced(text)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * common >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(s), None if d is None else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def repeats(rows: list[tuple], length: int = 400) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def contaminated(docs: list[tuple], items: list[tuple], size: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_hit, items)."""
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - size + 1) if w and item is not None else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = alnum(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (held := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= held
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def base_scores(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_tokens, n_known, train_tokens, base_score) for rows (doc_id, text, trains)."""
    tokens = [[*spaced(t), None] for _, t, _ in rows]
    counts = Counter(w for ws, (_, _, trains) in zip(tokens, rows) if trains for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(d, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for ws, (d, _, _) in zip(tokens, rows)]


def nearest(vectors: dict, queries: list, k: int) -> dict:
    return {q: [v for _, v in sorted((math.dist(vectors[q], x), v) for v, x in vectors.items() if v != q)[:k]] for q in queries}
