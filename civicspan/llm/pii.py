"""Keyed surrogates for personal data and secrets.

Entities are found by pattern and checked (cards by Luhn's sum). Each breaks into atoms: the local
part and the domain of an address, given and family names, the digits of a number. Every distinct
atom of the corpus gets one surrogate, drawn from a SHA-256 stream under the caller's key, so the
same person or number has the same surrogate in every document. Surrogates keep length, letter
case, script, separators and what the type requires (octet ranges, Luhn's sum, IBAN check digits,
gendered name endings). Atoms whose surrogates collide, with each other or with any atom that
really occurs, draw again until all are distinct. Cards, phone numbers and IBANs are the same with and
without separators. Names are found after a title; where they stand by themselves elsewhere in the same document, they are
replaced too (these are not counted as entities).

Defined cases: a null text stays null and has no entities; texts without entities are returned as
they are; equal texts get equal results; an empty table gives an empty result; other columns are
passed through, and a column that has the name of an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspan.llm.common import let, text_key, unused, written

MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|Господин|г-н|Κύριος"
FEMALE_TITLES = "Mrs|Miss|Ms|Frau|Madame|Mme|Señora|Sra|Госпожа|г-жа|Κυρία"
NAME = "\\p{Lu}[\\p{L}'’-]+"
SECRET_NAME = r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]"
GROUPS = "(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Patterns in the order in which they are tried at a place of the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": rf"(?<![\p{{L}}\p{{N}}]){SECRET_NAME}\s{{0,3}}[\"']?"
    r"(?=[+/_=-]*[A-Za-z0-9])[A-Za-z0-9+/_=-]{8,}+"
    r"|(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}"
    r"|(?=[0-9a-f]{0,40}[0-9])[0-9a-f]{32,})(?![\p{L}\p{N}])",
    "ipv4": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
    # Shortened: a digit or four letters in a row, and seven groups at most.
    r"|(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*(?:[0-9]|[A-Fa-f]{4}))(?=(?::{0,2}[0-9A-Fa-f]{1,4}){1,7}(?:::)?(?![0-9A-Fa-f:]*[0-9A-Fa-f]))"
    rf"{GROUPS}::{GROUPS}(?![\p{{L}}\p{{N}}]|:[0-9A-Fa-f:]|\.[0-9])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])",
    "person": rf"(?<!\p{{L}})(?:{MALE_TITLES}|{FEMALE_TITLES})\.? {NAME}(?: {NAME}){{0,2}}",
}
#: A text in which this isn't found has no entity.
HINT = rf"[0-9@]|::|(?:[A-Fa-f]{{1,4}}:){{7}}|{SECRET_NAME}|AKIA[A-Z]{{16}}|gh[pousr]_[A-Za-z]{{20}}|sk-[A-Za-z]{{20}}|(?:{MALE_TITLES}|{FEMALE_TITLES})\.? \p{{Lu}}"

#: Country codes, which end by themselves where a number is written without separators.
CODE = "(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Kinds of which letters and digits alone say what they are: separators differ from text to text.
BARE = ("card", "phone", "iban")

#: What of an entity is replaced; the rest is kept.
ATOMS = {
    "email": r"^[^@]+|(?<=@).+(?=\.[^.]+$)",
    "secret": r"(?<=[=:]\s{0,3}[\"']{0,1})[A-Za-z0-9+/_=-]{8,}$|^[A-Za-z0-9_-]+$",
    "phone": r"(?<=^\+[0-9]{1,3}(?![0-9]))[^0-9]+.*|^(?!\+).*|(?<=^\+" + CODE + ")[0-9]{5,}.*",
    "person": rf"(?<= ){NAME}",
}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
CONSONANTS = {"latin": "bcdfghjklmnprstvwz", "cyrillic": "бвгдзклмнпрстфхш", "greek": "βγδζθκλμνπρστφχ"}
GENDERED = {
    ("given_m", "latin"): "o",
    ("given_m", "cyrillic"): "н",
    ("given_m", "greek"): "ς",
    ("given_f", "latin"): "a",
    ("given_f", "cyrillic"): "а",
    ("given_f", "greek"): "α",
}
#: Draws after which a surrogate may be one character longer, or an octet of any width, so that small spaces can't run out.
DRAWS_A_LENGTH = 8
#: Draws after which a surrogate may be a value that occurs: only a space that is nearly full gets there.
LAST_DRAWS = 64


def _nth(letters: str, number: Column) -> Column:
    return F.substr(F.lit(letters), (number % len(letters)).cast("int") + 1, F.lit(1))


def _luhn_sum(digits: Column) -> Column:
    """Of a string of digits, as if one check digit still followed."""

    def add(total: Column, digit: Column) -> Column:
        return total + digit

    def weighed(digit: Column, at: Column) -> Column:
        twice = digit.cast("int") * 2
        return F.when(at % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit.cast("int"))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weighed), F.lit(0), add)


def _is_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    last = F.right(digits, F.lit(1)).cast("int")
    return (_luhn_sum(F.substring(digits, 1, 18).substr(F.lit(1), F.length(digits) - 1)) + last) % 10 == 0


def _mod_97(characters: Column) -> Column:
    """Of letters and digits read as IBANs are: A is 10, Z is 35."""

    def step(rest: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(characters, ""), F.lit(0), step)


def entity_type(value: Column) -> Column:
    """The first pattern that the value matches as a whole; null if its checks fail."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        matched = value.rlike(f"^(?:{pattern})$")
        kind = F.when(matched & _is_card(value) if name == "card" else matched, name).otherwise(kind)
    return kind


def find_entities(text: Column) -> Column:
    """All matches, in the order of the text."""
    return F.regexp_extract_all(text, F.lit("|".join(f"(?:{p})" for p in _numbered())), F.lit(0))


def _numbered() -> list[str]:
    """The patterns as parts of one: the only group among them, the separator of a phone number, is the first."""
    return list(PATTERNS.values())


WHOLE = "|".join(f"(?:{p})" for p in _numbered())


def _atom_pattern(kind: Column) -> Column:
    chosen = F.lit("^.+$")
    for name, pattern in ATOMS.items():
        chosen = F.when(kind == name, pattern).otherwise(chosen)
    return chosen


def _atom_kind() -> Column:
    """What an atom is, from its entity's type and its place there."""
    male = F.col("entity").rlike(f"^(?:{MALE_TITLES})\\.? ")
    given = F.when(male, "given_m").otherwise("given_f")
    return (
        F.when(F.col("type") == "email", F.when(F.col("part") == 0, "local").otherwise("domain"))
        .when(F.col("type") == "person", F.when(F.col("part") == F.col("parts") - 1, "family").otherwise(given))
        .otherwise(F.col("type"))
    )


def _surrogate(key: str) -> Column:
    """The draw number ``attempt`` for the atom ``norm`` of ``kind``; as long as the atom, and lower case."""
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt")
    name = kind.isin("given_m", "given_f", "family")
    longer = F.repeat(F.lit("a"), F.floor(attempt / DRAWS_A_LENGTH).cast("int"))
    script = (
        F.when(norm.rlike("\\p{IsCyrillic}"), "cyrillic").when(norm.rlike("\\p{IsGreek}"), "greek").otherwise("latin")
    )
    hexadecimal = (kind == "secret") & norm.rlike("^[0-9a-f]+$") & (F.length(norm) >= 16)

    def drawn(c: Column, at: Column) -> Column:
        stream = F.sha2(F.concat_ws("\u0000", F.lit(key), kind, norm, attempt.cast("string"), at.cast("string")), 256)
        number = F.conv(F.substring(stream, 1, 12), 16, 10).cast("long")
        letter = F.lit(None).cast("string")
        for s in VOWELS:
            syllable = F.when(at % 2 == 1, _nth(VOWELS[s], number)).otherwise(_nth(CONSONANTS[s], number))
            anything = _nth(VOWELS[s] + CONSONANTS[s], number)
            letter = F.when(script == s, F.when(name, syllable).otherwise(anything)).otherwise(letter)
        return (
            F.when(hexadecimal, _nth("0123456789abcdef", number))
            .when((kind == "ipv6") & c.rlike("[a-f]"), _nth("abcdef", number))
            .when(c.rlike("[0-9]"), _nth("0123456789", number))
            .when(c.rlike("\\p{L}"), letter)
            .otherwise(c)
        )

    source = F.when(name | kind.isin("local", "domain", "secret"), F.concat(norm, longer)).otherwise(norm)
    digits_more = F.repeat(F.lit("0"), F.floor(attempt / DRAWS_A_LENGTH).cast("int"))
    source = F.when(kind.isin("phone", "ssn"), F.concat(norm, digits_more)).otherwise(source)
    source = F.when((kind == "ipv6") & (attempt >= DRAWS_A_LENGTH), F.regexp_replace(norm, "[0-9a-f]+", "a000")).otherwise(source)
    plain = F.array_join(F.transform(F.split(source, ""), drawn), "")
    digits = F.regexp_replace(plain, "[^0-9]", "")

    gendered = plain
    for (of, s), ending in GENDERED.items():
        fits = (kind == of) & (script == s) & (F.length(plain) > 1)
        gendered = F.when(fits, F.concat(plain.substr(F.lit(1), F.length(plain) - 1), F.lit(ending))).otherwise(gendered)

    def octet(old: Column, at: Column) -> Column:
        stream = F.sha2(F.concat_ws("\u0000", F.lit(key), norm, attempt.cast("string"), F.lit("octet"), at), 256)
        number = F.conv(F.substring(stream, 1, 12), 16, 10).cast("long")
        size = F.length(old)
        return F.when(attempt >= DRAWS_A_LENGTH, 1 + number % 254).when(size == 3, 100 + number % 156).when(size == 2, 10 + number % 90).otherwise(1 + number % 9)

    def carded(fresh: Column) -> Column:
        """The first digit of the old number, drawn ones, and the digit that makes Luhn's sum right."""
        body = F.concat(F.substring(F.regexp_replace(norm, "[^0-9]", ""), 1, 1), fresh.substr(F.lit(2), F.length(fresh) - 2))
        check = F.pmod(-_luhn_sum(body), F.lit(10)).cast("string")
        return _onto(norm, F.concat(body, check))

    def banked(fresh: Column) -> Column:
        bare = F.upper(F.regexp_replace(fresh, " ", ""))
        country, account = F.upper(F.substring(norm, 1, 2)), bare.substr(F.lit(5), F.length(bare))
        check = F.lpad((98 - _mod_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        return _onto(norm, F.lower(F.concat(country, check, account)))

    return (
        F.when(kind == "ipv4", F.array_join(F.transform(F.split(norm, "\\."), octet).cast("array<string>"), "."))
        .when(kind == "card", let(digits, carded))
        .when(kind == "iban", let(plain, banked))
        .when(kind == "ssn", F.concat(F.lit("9"), plain.substr(F.lit(2), F.length(plain))))
        .when((kind == "secret") & norm.rlike("^akia"), F.concat(F.lit("akia"), plain.substr(F.lit(5), F.length(plain))))
        .otherwise(gendered)
    )


def _onto(shape: Column, characters: Column) -> Column:
    """The characters in place of the letters and digits of ``shape``, whose separators stay; what is left over follows."""

    def placed(before: Column, c: Column) -> Column:
        used, made = before.getField("used"), before.getField("made")
        taken = F.when(c.rlike("[\\p{L}0-9]"), 1).otherwise(0)
        put = F.when(taken == 1, F.substr(characters, used + 1, F.lit(1))).otherwise(c)
        return F.struct((used + taken).alias("used"), F.concat(made, put).alias("made"))

    start = F.struct(F.lit(0).alias("used"), F.lit("").alias("made"))
    return F.aggregate(F.split(shape, ""), start, placed, _with_rest(characters))


def _with_rest(characters: Column):
    return lambda end: F.concat(end.getField("made"), F.substr(characters, end.getField("used") + 1))


def _cased(value: Column, surrogate: Column) -> Column:
    """The surrogate with the letter case of the value, character by character; what is longer is lower case."""

    def cased(new: Column, at: Column) -> Column:
        old = F.substr(value, at + 1, F.lit(1))
        return F.when((old != F.lower(old)) & old.isNotNull(), F.upper(new)).otherwise(new)

    return F.array_join(F.transform(F.split(surrogate, ""), cased), "")


def assign_surrogates(atoms: DataFrame, key: str) -> DataFrame:
    """``kind, norm, surrogate`` for distinct atoms ``kind, norm``: different atoms get different surrogates,
    and none is an atom that occurs. Each round settles all but the few that collide, and writes only those it had.

    Kinds that may grow become longer after some draws, so that their space can't be full. Those that may not, such as cards, may
    at last take a value that occurs, so that every round finds free values until the space itself is used up."""
    real = atoms.select("kind", F.col("norm").alias("surrogate"))
    waiting = atoms.select("kind", "norm").withColumn("attempt", F.lit(0))
    settled = None
    while True:
        drawn = waiting.withColumn("surrogate", _surrogate(key))
        early = drawn.where(F.col("attempt") < LAST_DRAWS).join(real, ["kind", "surrogate"], "left_anti")
        free = early.unionByName(drawn.where(F.col("attempt") >= LAST_DRAWS))
        if settled is not None:
            free = free.join(settled, ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        chosen = written(first.select("kind", "norm", "surrogate"), "surrogates")
        settled = chosen if settled is None else settled.unionByName(chosen)
        left = waiting.join(chosen, ["kind", "norm"], "left_anti").withColumn("attempt", F.col("attempt") + 1)
        waiting = written(left, "waiting")
        if waiting.isEmpty():
            return settled


def _names_again(piece: Column, names: Column) -> Column:
    """Text between entities, with names that entities of the document have found replaced wherever they stand as words,
    as they were written there or in capitals, also with a genitive's ending."""
    words = F.regexp_extract_all(piece, F.lit("\\p{L}[\\p{L}'’-]*|[^\\p{L}]+"), F.lit(0))

    def replaced(word: Column) -> Column:
        stem = F.regexp_replace(word, "['’][sS]$", "")
        same = F.get(F.filter(names, lambda n: n["value"].isin(word, stem)), F.lit(0))["new"]
        capitals = F.get(F.filter(names, lambda n: F.upper(n["value"]).isin(word, stem)), F.lit(0))["new"]
        new = F.coalesce(same, F.upper(capitals))
        return F.coalesce(F.concat(new, F.substr(word, F.char_length(stem) + 1)), word)

    return F.array_join(F.transform(words, replaced), "")


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows with surrogates in ``text``; adds ``n_entities`` and ``entity_types`` (sorted, joined by commas).

    Only texts that may hold an entity are shuffled, by the hash of the text; a text that many rows
    share is worked out once.
    """
    docs = docs.drop("n_entities", "entity_types")
    of_key, of_made, of_n, of_types, of_names = unused(docs.columns, "_key", "_made", "_n", "_types", "_names")
    likely = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    some = docs.where(likely).withColumn(of_key, text_key(F.col(text)))
    found = some.select(F.col(of_key).alias("key"), find_entities(F.col(text)).alias("entities")).where(F.size("entities") > 0)
    entities = written(found.groupBy("key").agg(F.max("entities").alias("entities")), "entities")

    each = entities.select("key", F.posexplode("entities").alias("at", "entity"))
    typed = each.withColumn("type", entity_type(F.col("entity")))
    parts = F.regexp_extract_all("entity", _atom_pattern(F.col("type")), F.lit(0))
    split = typed.withColumn("values", F.when(F.col("type").isNotNull(), parts).otherwise(F.array().cast("array<string>")))
    occurring = (
        split.select("key", "at", "entity", "type", F.size("values").alias("parts"), F.posexplode_outer("values").alias("part", "value"))
        .withColumn("kind", F.when(F.col("value").isNotNull(), _atom_kind()))
        .withColumn("norm", F.when(F.col("kind").isin(*BARE), F.regexp_replace(F.lower("value"), "[^\\p{L}0-9]", "")).otherwise(F.lower("value")))
    )
    occurring = written(occurring, "atoms")
    distinct = occurring.where(F.col("norm").isNotNull()).select("kind", "norm").distinct()
    surrogates = assign_surrogates(distinct, key)

    known = occurring.join(surrogates, ["kind", "norm"], "left")
    fresh = F.when(F.col("kind").isin(*BARE), _onto(F.col("value"), F.col("surrogate"))).otherwise(F.col("surrogate"))
    known = known.withColumn("new", _cased(F.col("value"), fresh))
    is_name = F.col("kind").isin("given_m", "given_f", "family")
    whole = known.groupBy("key", "at", "entity", "type").agg(
        F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("part", "new")))).alias("news"),
        F.collect_list(F.when(is_name, F.struct("value", "new"))).alias("names"),
    )
    kept = F.split("entity", _atom_pattern(F.col("type")), -1)
    woven = F.flatten(
        F.zip_with(
            kept,
            F.col("news"),
            lambda old, new: F.array(F.coalesce(old, F.lit("")), F.coalesce(new.getField("new"), F.lit(""))),
        )
    )
    made = whole.select(
        "key", "at", "type", "names", F.when(F.size("news") > 0, F.array_join(woven, "")).otherwise(F.col("entity")).alias("made")
    )
    of_text = made.groupBy(F.col("key").alias(of_key)).agg(
        F.array_sort(F.collect_list(F.struct("at", "made"))).alias(of_made),
        F.count("type").alias(of_n),
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias(of_types),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias(of_names),
    )
    between = F.split(F.col(text), WHOLE, -1)
    between = F.when(F.size(of_names) > 0, F.transform(between, lambda piece: _names_again(piece, F.col(of_names)))).otherwise(between)
    rebuilt = F.array_join(
        F.flatten(
            F.zip_with(
                between,
                F.col(of_made),
                lambda old, new: F.array(F.coalesce(old, F.lit("")), F.coalesce(new.getField("made"), F.lit(""))),
            )
        ),
        "",
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    changed = some.join(of_text, of_key, "left").select(
        *[F.when(F.col(of_n).isNull(), c).otherwise(rebuilt).alias(text) if n == text else c for n, c in zip(docs.columns, columns, strict=True)],
        F.coalesce(of_n, F.lit(0)).cast("long").alias("n_entities"),
        F.coalesce(of_types, F.lit("")).alias("entity_types"),
    )
    rest = docs.where(~likely).select(
        *columns, F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_types")
    )
    return rest.unionByName(changed)
