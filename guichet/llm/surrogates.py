"""Surrogates for personal data: every entity found gets a keyed replacement of its own kind and format.

Built-in functions only. Kinds: e-mail addresses, telephone numbers, IPv4 addresses, card numbers, 40-digit hexadecimal
secrets, and names after a title. A mention is reduced to a canonical form (case, spacing and signs taken off), and the
replacement is drawn from a keyed hash of kind and canonical form, so all mentions of one entity get the same one, in
the form of the mention: digits stay digits in the same places, the country code and the first digit of a card stay, a
card number keeps whether its check digit is right, a private address stays private, hexadecimal stays hexadecimal, an
address keeps the shape of its parts and its top domain, a name keeps its title, gender, script and number of words.

Distinct entities are collected once and checked: where two would get the same replacement, or one would get what is
itself an entity of the corpus, all but the first draw again until none is left; each round handles the rest only.

Texts without an entity pass through the scan untouched; only the others are stored, numbered and joined. A null text
stays null; repeated rows and null ids are rows like any other. A mention at the edge of another is read from the left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guichet.llm.common import spare, staged

#: Titles by gender and script, and parts of replacement names.
TITLES = {
    ("f", "latin"): ["Mrs", "Ms", "Miss", "Mme", "Madame", "Mlle", "Frau", "Señora", "Sra"],
    ("m", "latin"): ["Mr", "Monsieur", "Herr", "Señor", "Sr"],
    ("f", "cyrillic"): ["госпожа", "г-жа"],
    ("m", "cyrillic"): ["господин", "г-н"],
}
GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Elena", "Emma", "Ines", "Julia", "Lea", "Maria", "Nora", "Sara"],
    ("m", "latin"): ["Adam", "Bruno", "David", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Simon"],
    ("f", "cyrillic"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Иван", "Максим", "Николай", "Павел", "Сергей"],
}
SYLLABLES = {"latin": ["ba", "den", "fel", "gar", "hol", "kin", "lar", "mor", "nel", "per", "ros", "sal", "tan", "ver", "wil", "zor"], "cyrillic": ["ба", "вен", "гор", "дар", "жен", "кол", "лев", "мир", "нов", "пет", "рос", "сол", "тар", "фед", "хол", "чер"]}

_WORD = r"\p{Lu}[\p{L}'\-]+"
_TITLE = "|".join(sorted((t for group in TITLES.values() for t in group), key=lambda t: (-len(t), t)))
PATTERNS = {
    "SECRET": r"\b[0-9a-f]{40}\b",
    "EMAIL": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "PHONE": r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{3,4}\b",
    "IP": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "CARD": r"\b[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}\b",
    "PERSON": rf"(?:{_TITLE})\.? {_WORD}(?: {_WORD})?",
}
_ANY = "|".join(PATTERNS.values())
_MAYBE = rf"[@0-9]|(?:{_TITLE})\.? "
#: Draws that keep every length; later ones may lengthen, so that no space is ever exhausted.
STRICT = 8


def _kind(mention: Column) -> Column:
    out = F.when(mention.contains("@"), "EMAIL").when(mention.startswith("+"), "PHONE").when(mention.rlike("^[0-9a-f]{40}$"), "SECRET")
    return out.when(mention.rlike(r"^[0-9]{1,3}\."), "IP").when(mention.rlike("^[0-9]"), "CARD").otherwise("PERSON")


def _canonical(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, "[^0-9]", "")
    code = F.regexp_extract(mention, r"^\+([0-9]{1,3}?)(?:[ .\-(]|[0-9]{9,10}$)", 1)
    phone = F.concat(code, F.lit("|"), F.substring(digits, F.length(code) + 1, F.length(digits)))
    person = F.regexp_replace(F.regexp_replace(mention, r"^(" + _TITLE + r")\.", "$1"), " +", " ")
    return F.when(kind == "EMAIL", F.lower(mention)).when(kind == "PHONE", phone).when(kind == "CARD", digits).when(kind == "PERSON", person).otherwise(mention)


def _number(stream: Column, at: int, size: int = 6) -> Column:
    return F.conv(F.substring(stream, at, size), 16, 10).cast("long")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _shaped(text: Column, digits: Column, letters: Column, shift: int) -> Column:
    """Digits for digits and letters for letters, place by place."""
    at = lambda i: F.pmod(i + shift, F.lit(120)) + 1
    one = lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, at(i), F.lit(1))).when(c.rlike("[a-z]"), F.substring(letters, at(i), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _octets(canonical: Column, stream: Column, attempt: Column) -> Column:
    parts = F.split(canonical, r"\.")
    drawn = []
    for k in range(4):
        size, number = F.length(parts[k]), _number(stream, 6 * k + 1)
        kept = F.when(size == 1, 1 + F.pmod(number, F.lit(9))).when(size == 2, 10 + F.pmod(number, F.lit(90))).otherwise(100 + F.pmod(number, F.lit(155)))
        drawn.append(F.when(attempt < STRICT, kept).otherwise(1 + F.pmod(number, F.lit(254))).cast("string"))
    fixed = F.when(canonical.startswith("10."), 1).when(canonical.startswith("192.168."), 2).otherwise(0)
    return F.concat_ws(".", F.when(fixed >= 1, parts[0]).otherwise(drawn[0]), F.when(fixed >= 2, parts[1]).otherwise(drawn[1]), drawn[2], drawn[3])


def _card(canonical: Column, digits: Column) -> Column:
    head = F.concat(F.substring(canonical, 1, 1), F.substring(digits, 1, 14))
    right = F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.call_function("luhn_check", F.concat(head, d)))[0]
    return F.concat(head, F.when(F.call_function("luhn_check", canonical), right).otherwise(F.pmod(right.cast("int") + 1 + F.pmod(F.substring(digits, 20, 1).cast("int"), F.lit(9)), F.lit(10)).cast("string")))


def _name(canonical: Column, stream: Column, attempt: Column) -> Column:
    title, words = F.split(canonical, " ")[0], F.size(F.split(canonical, " ")) - 1
    out = F.lit(None).cast("string")
    for (gender, script), titles in TITLES.items():
        syllables = F.transform(F.sequence(F.lit(1), 3 + F.floor(attempt / 4).cast("int")), lambda i: _pick(SYLLABLES[script], F.conv(F.substring(stream, i * 4 + 8, F.lit(4)), 16, 10).cast("long")))  # noqa: B023
        family = F.initcap(F.array_join(syllables, ""))
        given = _pick(GIVEN[(gender, script)], _number(stream, 1))
        out = F.when(title.isin(titles) , F.concat_ws(" ", F.when(words > 1, given), family)).otherwise(out)
    return F.concat_ws(" ", title, out)


def _draw(key: str) -> Column:
    """Replacement of (kind, canonical) at an attempt."""
    kind, canonical, attempt = F.col("kind"), F.col("canonical"), F.col("attempt")
    hashed = lambda n: F.sha2(F.concat_ws(":", F.lit(key), kind, canonical, attempt.cast("string"), F.lit(n)).cast("binary"), 256)
    stream = F.concat(hashed("1"), hashed("2"))
    digits, letters = F.translate(stream, "abcdef", "246813"), F.translate(stream, "0123456789abcdef", "abcdefghijklmnop")
    longer = F.substring(letters, F.lit(100), F.greatest(F.lit(0), attempt - STRICT + 1))
    domain = F.substring_index(canonical, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    email = F.concat(_shaped(F.substring_index(canonical, "@", 1), digits, letters, 0), longer, F.lit("@"), _shaped(host, digits, letters, 50), F.lit("."), top)
    rest = F.length(F.substring_index(canonical, "|", -1))
    phone = F.concat(F.substring_index(canonical, "|", 1), F.lit("|"), (2 + F.pmod(_number(stream, 90), F.lit(8))).cast("string"), F.substring(digits, F.lit(1), rest - 1))
    out = F.when(kind == "EMAIL", email).when(kind == "PHONE", phone).when(kind == "IP", _octets(canonical, stream, attempt))
    return out.when(kind == "CARD", _card(canonical, digits)).when(kind == "SECRET", F.substring(stream, 1, 40)).otherwise(_name(canonical, stream, attempt))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) for distinct `entities(kind, canonical)`: one to one, and never an entity itself."""
    entities = staged(entities, "entities")
    taken = entities.select("kind", F.col("canonical").alias("surrogate"))
    table = staged(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", _draw(key)), "drawn")
    while True:
        order = Window.partitionBy("kind", "surrogate").orderBy("attempt", "canonical")
        ranked = table.withColumn("n", F.row_number().over(order))
        hits = taken.withColumn("hit", F.lit(True))
        checked = staged(ranked.join(hits, ["kind", "surrogate"], "left").select("kind", "canonical", "attempt", "surrogate", ((F.col("n") > 1) | F.coalesce("hit", F.lit(False))).alias("again")), "checked")
        if checked.where("again").isEmpty():
            return checked.select("kind", "canonical", "surrogate")
        redrawn = checked.where("again").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt")).withColumn("surrogate", _draw(key))
        table = staged(checked.where("not again").select("kind", "canonical", "attempt", "surrogate").unionByName(redrawn), "drawn")


def _formed(kind: Column, mention: Column, surrogate: Column) -> Column:
    """A surrogate in the form of a mention."""
    bare = F.regexp_replace(surrogate, "[^0-9]", "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.substring(bare, acc["next"], F.lit(1))).alias("out"), (acc["next"] + 1).alias("next"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["next"].alias("next")))
    digits = F.aggregate(F.split(mention, ""), start, step, lambda acc: acc["out"])
    dotted = F.when(mention.rlike(rf"^(?:{_TITLE})\."), F.regexp_replace(surrogate, "^([^ ]+) ", "$1. ")).otherwise(surrogate)
    out = F.when(kind.isin("PHONE", "CARD"), digits).when((kind == "EMAIL") & (mention == F.upper(mention)), F.upper(surrogate))
    return out.when(kind == "PERSON", dotted).otherwise(surrogate)


def replace(docs: DataFrame, key: str = "corpus", text: str = "text") -> DataFrame:
    """All columns of `docs` with the entities of `text` replaced, and `_entities` (their number) and `_kinds`.

    Columns of `docs` with these two names are replaced; any other name may occur.
    """
    docs = docs.drop("_entities", "_kinds")
    held, row, given = (spare(docs, name) for name in ("_found", "_row", "values"))
    maybe = F.coalesce(F.col(text).rlike(_MAYBE), F.lit(False))
    found = F.when(maybe, F.regexp_extract_all(F.col(text), F.lit(_ANY), F.lit(0)))
    marked = docs.withColumn(held, found)
    none = marked.where(F.coalesce(F.size(held), F.lit(0)) <= 0).drop(held)
    none = none.withColumn("_entities", F.lit(0).cast("long")).withColumn("_kinds", F.lit("").cast("string"))
    some = staged(marked.where(F.size(held) > 0).withColumn(row, F.monotonically_increasing_id()), "private")
    mentions = some.select(F.col(row).alias("_row"), F.posexplode(held).alias("at", "mention")).withColumn("kind", _kind(F.col("mention")))
    mentions = mentions.withColumn("canonical", _canonical(F.col("kind"), F.col("mention")))
    table = assign(mentions.select("kind", "canonical").distinct(), key)
    formed = mentions.join(table, ["kind", "canonical"]).select("_row", "at", "kind", _formed(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("value"))
    formed = formed.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias(given), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("_kinds"))
    between = F.split(F.col(text), _ANY, -1)
    rebuilt = F.array_join(F.flatten(F.zip_with(between, F.concat(F.col(f"{given}.value"), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    changed = some.join(formed.withColumnRenamed("_row", row), row).withColumn(text, rebuilt).withColumn("_entities", F.size(given).cast("long"))
    return none.unionByName(changed.select(none.columns))
