"""Replacement of personal data by keyed surrogates, in DataFrame functions only.

Mentions are found by patterns.  A mention consists of entities: a name of its given names and its family name,
any other mention of one entity.  Mentions of one entity (the same digits in another layout, an address in
another case, a family name with and without a given name) share a canonical form.  A keyed digest of type
and canonical form draws the entity's surrogate, of the same type: digits for digits with a valid check
digit where the original has one, hex for hex, an address for an address, a name of the same gender and
script for a name.  Surrogates are checked against each other and against all originals, and those that
clash are drawn again, names with a syllable more each time, so different entities stay different.  A
mention takes its entities' surrogates in its own layout, with its own form of address.

Names are found after a form of address only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import Scratch, eager, spread_join

# Forms of address by gender, and names by gender and script.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")}
NAMES = {
    "given_m:latin": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Noel", "Oscar", "Paul"),
    "given_f:latin": ("Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"),
    "family:latin": ("Archer", "Bell", "Costa", "Drake", "Ebner", "Frey", "Garner", "Holt", "Ibsen", "Jansen", "Keller", "Lund", "Moreau", "Nash", "Ortega", "Pryce"),
    "given_m:cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    "given_f:cyrillic": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Мария"),
    "family:cyrillic": ("Авен", "Белов", "Волк", "Гром", "Дубов", "Ежов", "Зимин", "Князь"),
}
#: Syllables of further names: every onset with every vowel; and the ending by gender.
SYLLABLES = {"latin": ("bcdfghklmnprstvw", "aeio"), "cyrillic": ("бвгджзклмнпрстхш", "аеио")}
ENDINGS = {"given_m:latin": "n", "given_f:latin": "na", "family:latin": "r", "given_m:cyrillic": "н", "given_f:cyrillic": "на", "family:cyrillic": "р"}
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_HEAD = rf"(?:{_TITLE})\.? "
_NAME = r"\p{Lu}(?:\p{L}|['’]\p{L})\p{L}*(?:[\-'’]\p{L}+)*"
#: Type and pattern, tried in this order at every place.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"),
    ("block", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]{0,30}PRIVATE KEY-----"),
    ("token", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|sk-[A-Za-z0-9]{20,255})\b"),
    ("secret", r"\b[0-9a-fA-F]{32,64}\b"),
    ("ipv6", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b"),
    ("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z]{4})?(?: ?\d{4}){2,6}(?: ?\d{1,4})?\b"),
    ("card", r"\b\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{4}\b"),
    ("phone", r"(?:\+\d{1,3}[ \-]?)?\(\d{3}\)[ \-]?\d{3}[ \-]?\d{4}\b|\+\d{1,3}(?:[ \-]?\d{2,4}){3,4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("person", rf"\b{_HEAD}{_NAME}(?: {_NAME}){{0,2}}"),
)
COMBINED = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: Types of digits alone; types whose characters are replaced one by one, each by one of its kind.
DIGITS, CHARACTERS = ("card", "phone", "ssn"), ("block", "token", "iban")
MAX_ROUNDS = 60
BROADCAST_ROWS = 100_000


def entity_type(mention: Column) -> Column:
    out = None
    for name, pattern in PATTERNS:
        hit = mention.rlike(f"^(?:{pattern})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def entities_of(kind: Column, mention: Column) -> Column:
    """array<struct<kind, name, piece>>: the entities of a mention, with the part of it that each covers. The
    name is the canonical form: digits of numbers, lower case for names, addresses and hex."""
    digits = F.regexp_replace(mention, r"\D", "")
    name = F.when(kind.isin(*DIGITS), digits).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind.isin("ip", "block", "token"), mention).otherwise(F.lower(mention))
    words = F.split(F.regexp_replace(mention, f"^{_HEAD}", ""), " ")
    given = F.when(mention.rlike(rf"^(?:{'|'.join(TITLES['f'])})\.? "), "given_f").otherwise("given_m")
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), ":cyrillic").otherwise(":latin")
    parts = F.transform(words, lambda w, i: F.struct(F.concat(F.when(i == F.size(words) - 1, "family").otherwise(given), script(w)).alias("kind"), F.lower(w).alias("name"), w.alias("piece")))
    return F.when(kind == "person", parts).otherwise(F.array(F.struct(kind.alias("kind"), name.alias("name"), mention.alias("piece"))))


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts).cast("binary"), 256)


def _number(digest: Column, at: Column | int, width: int) -> Column:
    return F.conv(F.substring(digest, F.lit(at) if isinstance(at, int) else at, F.lit(width)), 16, 10).cast("int")


def _pick(pool: tuple[str, ...] | list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in pool]), number % len(pool) + 1)


def _at(text: Column, i: Column) -> Column:
    return F.substring(text, i, F.lit(1))


def luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 in valid card numbers."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)

    def value(i: Column) -> Column:
        d = _at(digits, F.length(digits) - i).cast("int")
        return F.when(i % 2 == 1, doubled(d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i))


def iban_rest(iban: Column) -> Column:
    """An account number's rest modulo 97, 1 in valid ones."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        c = _at(turned, i)
        return F.when(c.rlike("[A-Z]"), (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def draw(key: str, kind: Column, name: Column, attempt: Column) -> Column:
    """Surrogate of a canonical form. Numbers keep their length, a phone its first digit, cards and
    accounts a valid check digit, addresses their top-level domain, keys their prefix."""
    d = _digest(key, kind, name, attempt.cast("string"))
    stream = F.array_join(F.transform(F.sequence(F.lit(0), (F.length(name) / 32).cast("int")), lambda j: _digest(key, kind, name, attempt.cast("string"), j.cast("string"))), "")
    chance = lambda i: _number(stream, 2 * i + 1, 2)
    places = F.sequence(F.lit(0), F.length(name) - 1)
    digits = F.array_join(F.transform(places, lambda i: F.when((kind == "phone") & (i == 0), F.substring(name, 1, 1)).otherwise((chance(i) % 10).cast("string"))), "")
    body = F.substring(digits, F.lit(1), F.length(name) - 1)
    checked = F.concat(body, ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    ip = F.concat_ws(".", (_number(d, 1, 2) % 223 + 1).cast("string"), *[_number(d, 3 + 2 * i, 2).cast("string") for i in range(3)])
    mail = F.concat(F.translate(F.substring(d, 1, 12), "0123456789", "ghijklmnop"), F.lit("@example."), F.regexp_extract(name, r"\.([a-z0-9\-]+)$", 1))
    hexed = F.array_join(F.transform(places, lambda i: F.when(_at(name, i + 1) == ":", ":").otherwise(_at(stream, 2 * i + 1))), "")
    fixed = F.length(F.regexp_extract(name, r"^(?:-----[^\-]*-----|AKIA|gh[pousr]_|sk-|[A-Z]{2}\d{2}(?=[A-Z0-9]))", 0))
    end = F.when(kind == "block", F.length(name) - F.length(F.regexp_extract(name, r"-----[^\-]*-----$", 0))).otherwise(F.length(name))

    def alike(i: Column) -> Column:
        c, n = _at(name, i + 1), chance(i)
        new = F.when(c.rlike("[0-9]"), F.char(n % 10 + 48)).when(c.rlike("[A-Z]"), F.char(n % 26 + 65)).when(c.rlike("[a-z]"), F.char(n % 26 + 97)).otherwise(c)
        return F.when((i >= fixed) & (i < end), new).otherwise(c)

    same = F.array_join(F.transform(places, alike), "")
    unchecked = F.concat(F.substring(same, 1, 2), F.lit("00"), F.substring(same, F.lit(5), F.length(same)))
    iban = F.concat(F.substring(same, 1, 2), F.lpad((98 - iban_rest(unchecked)).cast("string"), 2, "0"), F.substring(same, F.lit(5), F.length(same)))
    out = F.when(kind == "ip", ip).when((kind == "card") & (luhn(name) % 10 == 0), checked).when(kind.isin(*DIGITS), digits).when(kind == "email", mail)
    out = out.when(kind.isin("secret", "ipv6"), hexed).when((kind == "iban") & (iban_rest(name) == 1), iban).when(kind.isin(*CHARACTERS), same)
    for part, pool in NAMES.items():
        onsets, vowels = SYLLABLES[part.split(":")[1]]
        syllables = [o + v for o in onsets for v in vowels]
        made = F.transform(F.sequence(F.lit(1), F.least(attempt + 1, F.lit(30))), lambda i: _pick(syllables, _number(d, 2 * i - 1, 2)))  # noqa: B023
        out = out.when(kind == part, F.when(attempt == 0, _pick(pool, _number(d, 1, 4))).otherwise(F.initcap(F.concat(F.array_join(made, ""), F.lit(ENDINGS[part])))))
    return out


def surrogates(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """kind, name, surrogate: distinct within a kind and equal to no original of it.

    Every round draws again for all but one of the entities that share a surrogate and for all whose
    surrogate is an original; the others keep theirs."""
    current = scratch.write(entities.select("kind", "name", F.lit(0).alias("attempt")).withColumn("surrogate", draw(key, F.col("kind"), F.col("name"), F.col("attempt"))), "round-0")
    canon = F.when(F.col("kind").isin("ip", "block", "token", "iban"), F.col("surrogate")).otherwise(F.lower("surrogate"))
    for turn in range(1, MAX_ROUNDS + 1):
        originals = entities.select("kind", F.col("name").alias("canon"), F.lit(True).alias("original"))
        order = F.row_number().over(Window.partitionBy("kind", "canon").orderBy("attempt", "name"))
        judged = current.withColumn("canon", canon).join(originals, ["kind", "canon"], "left").withColumn("clash", F.coalesce("original", F.lit(False)) | (order > 1))
        judged = scratch.write(judged.drop("original", "canon"), f"judged-{turn}")
        if judged.where("clash").isEmpty():
            return judged.select("kind", "name", "surrogate")
        attempt = F.when(F.col("clash"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        current = scratch.write(judged.select("kind", "name", attempt.alias("attempt"), F.when(F.col("clash"), draw(key, F.col("kind"), F.col("name"), attempt)).otherwise(F.col("surrogate")).alias("surrogate")), f"round-{turn}")
    raise RuntimeError("surrogates still clash: a type of fixed length holds about as many entities as it has numbers")


def in_layout(kind: Column, piece: Column, surrogate: Column) -> Column:
    """The surrogate in the layout of what it replaces: digits take the places of digits, the characters
    of an account number theirs; case follows in hex, addresses and names."""

    def laid(taken: str) -> Column:
        before = lambda i: F.length(F.regexp_replace(F.substring(piece, F.lit(1), i), f"[^{taken}]", ""))
        put = F.transform(F.sequence(F.lit(0), F.length(piece) - 1), lambda i: F.when(_at(piece, i + 1).rlike(f"[{taken}]"), _at(surrogate, before(i) + 1)).otherwise(_at(piece, i + 1)))
        return F.array_join(put, "")

    cased = kind.isin("secret", "ipv6", "email") | kind.contains(":")
    upper = cased & (piece == F.upper(piece)) & (piece != F.lower(piece)) & (F.length(piece) > 1)
    return F.when(kind.isin(*DIGITS), laid("0-9")).when(kind == "iban", laid("A-Z0-9")).when(upper, F.upper(surrogate)).otherwise(surrogate)


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with all its columns, its text with surrogates drawn with the secret ``key``, and
    ``n_entities`` (mentions).

    Null texts stay null; empty texts stay empty; very long texts are searched whole; repeated rows are
    treated alike; of entities that tie for a surrogate the one of fewer draws, then of the smaller
    name, keeps it; null ids are ids like others; an empty table gives an empty result; a column
    already named ``n_entities`` is replaced.
    """
    with Scratch(docs.sparkSession, "pii") as scratch:
        mentions = docs.select(F.col(id_col).alias("__m_id"), eager(F.xxhash64(F.col(text_col))).alias("__m_hash"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(COMBINED), 0))).alias("mention"))
        mentions = scratch.write(mentions, "mentions")
        kinds = mentions.select("mention").distinct().withColumn("kind", entity_type(F.col("mention")))
        parts = kinds.select("mention", F.posexplode(entities_of(F.col("kind"), F.col("mention"))).alias("at", "e")).select("mention", "at", "e.kind", "e.name", "e.piece")
        parts = scratch.write(parts, "parts")
        drawn = surrogates(parts.select("kind", "name").distinct(), scratch, key)
        laid = parts.join(drawn, ["kind", "name"]).select("mention", "at", in_layout(F.col("kind"), F.col("piece"), F.col("surrogate")).alias("to"))
        # a mention has three parts at most
        replaced = laid.groupBy("mention").agg(F.sort_array(F.collect_list(F.struct("at", "to"))).alias("to"))
        replaced = scratch.write(replaced.select("mention", F.concat(F.regexp_extract("mention", f"^{_HEAD}", 0), F.array_join(F.transform("to", lambda x: x["to"]), " ")).alias("to")), "replaced")
        found = spread_join(mentions, replaced, ["mention"], ["__m_id", "__m_hash"], replaced.count(), BROADCAST_ROWS)
        maps = found.groupBy("__m_id", "__m_hash").agg(F.map_from_entries(F.collect_set(F.struct("mention", "to"))).alias("__m_map"))
        maps = scratch.keep(maps, "maps")
    n = maps.count()
    rest = docs.drop("n_entities")
    joined = rest.withColumn("__m_own", F.xxhash64(F.col(text_col))).join(F.broadcast(maps) if n <= BROADCAST_ROWS else maps, rest[id_col].eqNullSafe(F.col("__m_id")) & (F.col("__m_own") == F.col("__m_hash")), "left")
    found = F.regexp_extract_all(F.col(text_col), F.lit(COMBINED), 0)
    gaps = F.split(F.col(text_col), COMBINED)
    made = F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(F.try_element_at("__m_map", m), m, F.lit("")))), "")
    changed = F.col("__m_map").isNotNull()
    return joined.select(*[F.when(changed, made).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in rest.columns], F.when(changed, F.size(found)).otherwise(0).cast("long").alias("n_entities"))


def pii_query(docs: DataFrame) -> DataFrame:
    return replace_entities(docs, "key of the registered query").select("doc_id", "text", "n_entities")
