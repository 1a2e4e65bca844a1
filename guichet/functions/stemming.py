"""French stems (the published Snowball rules) in one Arrow pass.

Spark has no stemmer. Each *distinct* word of an Arrow batch is stemmed once and mapped back by
dictionary index, so there is no shuffle and no call per token.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

_V = "aeiouyâàëéêèïîôûù"

# Suffix classes of the published algorithm, longest first inside each class.
_R2_DELETE = ("ances", "iqUes", "ismes", "ables", "istes", "ance", "iqUe", "isme", "able", "iste", "eux")
_R2_IC = ("atrices", "ateurs", "ations", "atrice", "ateur", "ation")
_LOGIE = ("logies", "logie")
_USION = ("usions", "utions", "usion", "ution")
_ENCE = ("ences", "ence")
_EMENT = ("issements", "issement", "amment", "emment", "ements", "ement", "ments", "ment")
_ITE = ("ités", "ité")
_IVE = ("ives", "ifs", "ive", "if")
_STANDARD = sorted(
    (*_R2_DELETE, *_R2_IC, *_LOGIE, *_USION, *_ENCE, *_EMENT, *_ITE, *_IVE, "eaux", "aux", "euses", "euse"),
    key=len,
    reverse=True,
)
_VERB_I = sorted(
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent "
    "issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split(),
    key=len,
    reverse=True,
)
_VERB_E = (
    "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
)
_VERB_A = (
    "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
)
_VERB = sorted((*_VERB_E, *_VERB_A, "ions"), key=len, reverse=True)

_R_AFTER = re.compile(f"[{_V}][^{_V}]")


def _mark_glides(word: str) -> str:
    """Upper-case the vowels that act as consonants, and split ë/ï, as the algorithm starts by doing."""
    out = list(word)
    n = len(out)
    for i, ch in enumerate(word):
        before = out[i - 1] if i else ""
        after = word[i + 1] if i + 1 < n else ""
        if ch == "u" and before == "q":
            out[i] = "U"
        elif ch in "ui" and before and before in _V and after and after in _V:
            out[i] = ch.upper()
        elif ch == "y" and ((before and before in _V) or (after and after in _V)):
            out[i] = "Y"
    return "".join(out).replace("ë", "He").replace("ï", "Hi")


def _regions(word: str) -> tuple[int, int, int]:
    """Start positions of RV, R1 and R2."""
    n = len(word)
    if word[:3] in ("par", "col", "tap"):
        rv = 3
    elif n > 1 and word[0] in _V and word[1] in _V:
        rv = 3 if n > 2 else n
    else:
        rv = next((i + 1 for i in range(1, n) if word[i] in _V), n)
    first = _R_AFTER.search(word)
    r1 = first.end() if first else n
    second = _R_AFTER.search(word, r1)
    return min(rv, n), r1, second.end() if second else n


def _standard(word: str, rv: int, r1: int, r2: int) -> tuple[str, bool, bool]:
    """Step 1. Returns the word, whether a suffix was removed, and whether verb suffixes must still be tried."""
    found = next((s for s in _STANDARD if word.endswith(s)), None)
    if found is None:
        return word, False, True
    at = len(word) - len(found)
    body = word[:at]

    if found in _R2_DELETE:
        return (body, True, False) if at >= r2 else (word, False, True)
    if found in _R2_IC:
        if at < r2:
            return word, False, True
        if body.endswith("ic"):
            body = body[:-2] if len(body) - 2 >= r2 else body[:-2] + "iqU"
        return body, True, False
    if found in _LOGIE:
        return (body + "log", True, False) if at >= r2 else (word, False, True)
    if found in _USION:
        return (body + "u", True, False) if at >= r2 else (word, False, True)
    if found in _ENCE:
        return (body + "ent", True, False) if at >= r2 else (word, False, True)
    if found in ("issements", "issement"):
        ok = at >= r1 and body and body[-1] not in _V
        return (body, True, False) if ok else (word, False, True)
    if found in ("amment", "emment"):
        return (body + ("ant" if found == "amment" else "ent"), False, True) if at >= rv else (word, False, True)
    if found in ("ements", "ement"):
        if at < rv:
            return word, False, True
        if body.endswith("iv") and len(body) - 2 >= r2:
            body = body[:-2]
            if body.endswith("at") and len(body) - 2 >= r2:
                body = body[:-2]
        elif body.endswith("eus"):
            if len(body) - 3 >= r2:
                body = body[:-3]
            elif len(body) - 3 >= r1:
                body = body[:-3] + "eux"
        elif body.endswith(("abl", "iqU")):
            if len(body) - 3 >= r2:
                body = body[:-3]
        elif body.endswith(("ièr", "Ièr")):
            if len(body) - 3 >= rv:
                body = body[:-3] + "i"
        return body, True, False
    if found in ("ments", "ment"):
        ok = len(body) - 1 >= rv and body[-1:] in _V and body[-1:] != ""
        return (body, False, True) if ok else (word, False, True)
    if found in _ITE:
        if at < r2:
            return word, False, True
        if body.endswith("abil"):
            body = body[:-4] if len(body) - 4 >= r2 else body[:-4] + "abl"
        elif body.endswith("ic"):
            body = body[:-2] if len(body) - 2 >= r2 else body[:-2] + "iqU"
        elif body.endswith("iv") and len(body) - 2 >= r2:
            body = body[:-2]
        return body, True, False
    if found in _IVE:
        if at < r2:
            return word, False, True
        if body.endswith("at") and len(body) - 2 >= r2:
            body = body[:-2]
            if body.endswith("ic"):
                body = body[:-2] if len(body) - 2 >= r2 else body[:-2] + "iqU"
        return body, True, False
    if found == "eaux":
        return word[:-1], True, False
    if found == "aux":
        return (word[:-3] + "al", True, False) if at >= r1 else (word, False, True)
    if at >= r2:
        return body, True, False
    if at >= r1:
        return body + "eux", True, False
    return word, False, True


def _verb(word: str, rv: int, r2: int) -> tuple[str, bool]:
    """Step 2: verb endings, searched inside RV."""
    region = word[rv:]
    ending = next((s for s in _VERB_I if region.endswith(s)), None)
    if ending is not None:
        at = len(word) - len(ending)
        if at - 1 >= rv and word[at - 1] not in _V and word[at - 1] != "H":
            return word[:at], True
    ending = next((s for s in _VERB if region.endswith(s)), None)
    if ending is None:
        return word, False
    at = len(word) - len(ending)
    if ending == "ions":
        return (word[:at], True) if at >= r2 else (word, False)
    if ending in _VERB_E:
        return word[:at], True
    body = word[:at]
    if body.endswith("e") and at - 1 >= rv:
        body = body[:-1]
    return body, True


def _residual(word: str, rv: int, r2: int) -> str:
    """Step 4, for words left alone by the steps above."""
    if word.endswith("s") and len(word) > 1 and (word.endswith("His") or word[-2] not in "aiouès"):
        word = word[:-1]
    region = word[rv:]
    for ending in ("Ière", "ière", "Ier", "ier", "ion", "e"):
        if not region.endswith(ending):
            continue
        at = len(word) - len(ending)
        if ending == "ion":
            if at >= r2 and at - 1 >= rv and word[at - 1] in "st":
                word = word[:at]
        elif ending == "e":
            word = word[:at]
        else:
            word = word[:at] + "i"
        break
    return word


@lru_cache(maxsize=100_000)
def french_stem(word: str) -> str:
    """Stem of one lower-case word, accents kept."""
    marked = _mark_glides(word)
    rv, r1, r2 = _regions(marked)
    stem, touched, try_verbs = _standard(marked, rv, r1, r2)
    if try_verbs:
        stem, touched = _verb(stem, rv, r2)
    if touched:
        if stem.endswith("Y"):
            stem = stem[:-1] + "i"
        elif stem.endswith("ç"):
            stem = stem[:-1] + "c"
    else:
        stem = _residual(stem, rv, r2)
    for double in ("enn", "onn", "ett", "ell", "eill"):
        if stem.endswith(double):
            stem = stem[:-1]
            break
    stem = re.sub(f"[éè](?=[^{_V}]+$)", "e", stem)
    return stem.replace("He", "ë").replace("Hi", "ï").replace("H", "").lower()


def plain(word: str) -> str:
    """Accent-free form of a word."""
    opened = word.replace("œ", "oe").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFKD", opened) if not unicodedata.combining(c))


@lru_cache(maxsize=100_000)
def content_stem(word: str) -> str:
    """Token of a word: accent-free, stemmed unless it holds a digit."""
    if any(c.isdigit() for c in word):
        return plain(word)
    return plain(french_stem(word.replace("œ", "oe").replace("æ", "ae")))


@F.arrow_udf(T.StringType())
def stem_joined(texts: pa.Array) -> pa.Array:
    """Stem every word of space-joined words; one string per row is what Arrow moves fastest."""
    listed = pc.split_pattern(texts, " ")
    flat = listed.flatten().dictionary_encode()
    stems = pa.array([content_stem(w) for w in flat.dictionary.to_pylist()], pa.string())
    offsets = pa.array(listed.offsets.to_numpy() - listed.offsets[0].as_py())
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, stems.take(flat.indices)), " ")
    return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), joined)
