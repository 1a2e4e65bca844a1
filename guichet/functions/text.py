"""French text as column expressions: accents, words, content tokens, sentences, intake cleaning.

Everything stays in the JVM except what Spark cannot express: Unicode composition (only rows that
hold combining marks reach Python) and stemming (see `stemming`).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guichet.functions.stemming import stem_joined

# Words that carry no content, as listed by the rules.
STOPWORDS = (
    "a à ai as au aux avec avez avons c ce ces cet cette ceci cela d dans de des du donc elle "
    "elles en est et eu eux il ils j je l la le les leur leurs lui m ma mais me mes moi mon n "
    "ne ni nos notre nous on ont ou où par pas pour qu que quel quelle quelles quels qui quoi "
    "s sa sans se ses si son sont sur t ta te tes toi ton tu un une vos votre vous y été être "
    "avoir fait faire peut plus moins très bien aussi comme alors afin ainsi tout tous toute "
    "toutes cher chère bonjour bonsoir merci cordialement svp "
    "combien comment quand pourquoi lequel laquelle lesquels lesquelles dont "
    "suis es sommes êtes étais était serai sera serait avais avait aurai aura aurait "
    "dois doit devons devez doivent peux pouvez pouvons peuvent puis veux veut voulons voulez "
    "faut vais va allons allez vont chez encore rien déjà jamais toujours ici là ça"
).split()

_ACCENTED = "[à-öø-ÿœæ]"

# Fixed value: what counts as a word once the text is lower-cased.
WORD = "[0-9a-zà-öø-ÿœæ]+"


def _decompose(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


# Letters whose accent is removed by a plain one-to-one mapping, derived from the Unicode tables
# for the Latin and punctuation blocks. Any other non-ASCII character that decomposes sends its
# row through the exact Python path below.
_BLOCKS = [*range(0x80, 0x250), *range(0x2000, 0x20D0)]
_SINGLE = {chr(cp): _decompose(chr(cp)) for cp in _BLOCKS if len(_decompose(chr(cp))) == 1}
_MAPPED = {ch: plain for ch, plain in _SINGLE.items() if ch != plain}
_FROM, _TO = "".join(_MAPPED), "".join(_MAPPED.values())
_FROM_WORD = "".join(ch for ch in _MAPPED if "à" <= ch <= "ÿ")
_TO_WORD = "".join(_MAPPED[ch] for ch in _FROM_WORD)
_LIGATURE_CHARS = "œŒæÆ"


def _ranges(code_points: list[int]) -> str:
    """Character-class body for sorted code points, consecutive ones joined."""
    out: list[list[int]] = []
    for cp in code_points:
        if out and cp == out[-1][1] + 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in out)


_UNCOVERED = [cp for cp in _BLOCKS if chr(cp) not in _SINGLE and chr(cp) not in _LIGATURE_CHARS]
_NEEDS_EXACT = f"[\\x{{250}}-\\x{{1FFF}}\\x{{20D0}}-\\x{{10FFFF}}{_ranges(_UNCOVERED)}]"


@F.arrow_udf(T.StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _strip_exact(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _decompose(t) for t in texts.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """Composed form; rows without a combining mark are passed to Python as NULL and kept as they are."""
    return F.coalesce(_nfc(F.when(text.rlike(r"\p{M}"), text)), text)


def open_ligatures(text: Column) -> Column:
    for ligature, letters in (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE")):
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    return text


def strip_accents(text: Column) -> Column:
    """Accent-free text (ligatures opened, compatibility forms reduced)."""
    opened = open_ligatures(text)
    exact = _strip_exact(F.when(opened.rlike(_NEEDS_EXACT), opened))
    return F.coalesce(exact, F.translate(opened, _FROM, _TO))


def strip_latin(text: Column) -> Column:
    """`strip_accents` for lower-case text that holds only `WORD` characters and spaces (no Python path)."""
    opened = F.replace(F.replace(text, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.translate(opened, _FROM_WORD, _TO_WORD)


def squeeze(text: Column) -> Column:
    """Single-spaced, trimmed text (every Unicode space counts)."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Lower-case, accent-free, single-spaced text for phrase matching."""
    return squeeze(strip_accents(F.lower(nfc(text))))


def words(text: Column) -> Column:
    """Lower-case word tokens, accents kept."""
    return F.regexp_extract_all(F.lower(nfc(text)), F.lit(WORD), F.lit(0))


def plain_words(text: Column) -> Column:
    """`words` without the composition step, for text already in composed form."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_sequence(text: Column) -> Column:
    """Accent-free words separated by single spaces ("droit d acces")."""
    return F.array_join(plain_words(normalize(text)), " ")


def plain_sequence(text: Column) -> Column:
    """Like `word_sequence`, but words are taken before accents are removed: a letter or mark outside `WORD` parts them."""
    return strip_latin(F.array_join(plain_words(text), " "))


def padded_sequence(text: Column) -> Column:
    """`word_sequence` between two spaces, so that a phrase is searched on whole words."""
    return F.concat(F.lit(" "), word_sequence(text), F.lit(" "))


def content_words(text: Column, composed: bool = False) -> Column:
    """Words without stopwords; single letters are dropped, single digits are kept."""
    tokens = plain_words(text) if composed else words(text)
    return F.filter(tokens, lambda w: ~w.isin(STOPWORDS) & ((F.length(w) >= 2) | w.rlike("[0-9]")))


def tokenize(text: Column, stem: bool = True, composed: bool = False) -> Column:
    """Content tokens for indexing and matching, accent-free.

    With `stem`, words without a digit are reduced to their French stem in one Arrow pass (each
    distinct word of a batch is stemmed once). Without it the whole expression stays in the JVM.
    `composed` skips the composition step for text known to be in composed form.
    """
    joined = F.array_join(content_words(text, composed), " ")
    if stem:
        return split_joined(stem_joined(joined))
    return split_joined(once(joined, lambda j: F.when(j.rlike(_ACCENTED), strip_latin(j)).otherwise(j)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated a single time, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_joined(joined: Column) -> Column:
    """Array of space-joined tokens; an empty string gives an empty array."""
    return F.filter(F.split(joined, " "), lambda t: t != "")


def has_stem(tokens: Column, prefixes: list[str] | tuple[str, ...]) -> Column:
    """Whether a token starts with one of the prefixes."""
    return F.exists(tokens, lambda t: t.rlike("^(?:" + "|".join(prefixes) + ")"))


def split_sentences(text: Column) -> Column:
    """Sentences: cut at line breaks, and after `.!?` when an upper-case letter or a digit follows."""
    parts = F.split(text, r"(?:\n+|(?<=[.!?])(?U:\s+)(?=[A-ZÀ-Ü0-9]))")
    return F.filter(F.transform(parts, trim_all), lambda s: s != "")


def trim_all(text: Column) -> Column:
    """Trim every kind of white space, not only the ASCII space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rtrim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def split_lines(text: Column) -> Column:
    """Lines of a text, at every line boundary (form feed, NEL, U+2028 and the like included)."""
    return F.split(text, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]")


def search_text(title: Column, section: Column, text: Column) -> Column:
    """What is indexed for a chunk: its title and section give a short text its context."""
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(section, F.lit("")), text)


def canonical_text(text: Column) -> Column:
    """Intake form: composed, without invisible format or control characters (line feed and tab kept)."""
    return trim_all(F.regexp_replace(nfc(text), r"[\p{Cf}\p{Cc}&&[^\n\t]]", ""))


def canonical_client(client_id: Column) -> Column:
    return F.nullif(F.upper(trim_all(client_id)), F.lit(""))
