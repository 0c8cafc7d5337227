"""PII surrogates, in DataFrame operations alone.

Detected entities (mail addresses, network addresses, phone, card, bank account and social-security numbers, secrets, names after a title) are replaced by surrogates
that keep type, format, case and script: digits become digits, letters letters of their script and case, separators stay.  An entity has parts: a
mail address its local part and its domain, a name each of its words, others themselves.  A part's surrogate is a keyed hash of its canonical value (digits, lower case), so
equal parts get equal surrogates in every document, also where they are written differently or stand in different entities.  Given names keep the gender of
their title; one after a neutral title takes the gender that the name, or its first word, has elsewhere.  Of numbers as long as a card's only those that pass the Luhn check are cards, and get one that does.

Collision checks keep distinct parts distinct: over all distinct parts of a kind, one whose surrogate another one has, or that is a real
value of the corpus, is drawn again until none is left.  A part counts its own draws, so that nothing else changes, and grows longer with them (addresses, names and domains from the second
draw on, numbers and secrets from the tenth), so that a draw never runs out of values.

Patterns are linear in a text's length: repeats are bounded or possessive, and begin only where no longer run can.  Names have any number of words, addresses parts of any length.  Names are found after a title
only; what is written without one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import dropped, row_key, stored

# Patterns of the kinds of entities, in order of precedence; titles by gender; first names, their endings and syllables by script and gender; alphabets.
MALE = ("Mr", "Herr", "Señor", "Monsieur", "Sir", "господин", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mademoiselle", "госпожа", "κυρία")
EITHER = ("Dr", "Prof")
_TITLE = "|".join((*MALE, *FEMALE, *EITHER))
PARTICLES = "de da di do du del della dos das la le van von der den ten ter zu bin al el".split()
_WORD = rf"(?:(?:{'|'.join(PARTICLES)})[  ]++){{0,3}}(?!(?:{_TITLE})\b)\p{{Lu}}[\p{{L}}'’-]++"
_LABEL = r"[\p{L}\p{N}]++(?:-++[\p{L}\p{N}]++)*+"
PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-])[._%+-]*+[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]*+@(?=[\p{{N}}.-]*+\p{{L}}){_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ipv6": r"(?<![\p{L}\p{N}:])(?=[A-Fa-f:]*+\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|(?:sk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:0\d{2,4}[ /-]\d{5,8}|[2-9]\d{9}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\d-])",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.?[  ]++{_WORD}(?:[  ]++{_WORD})*+",
}
FIRST = {
    "latin": {"m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nico Oscar Pablo Rolf Simon Theo Victor".split(), "f": "Anna Bella Clara Diana Elena Flora Greta Hanna Irene Julia Karla Laura Maria Nina Olga Paula Rosa Sofia Tina Vera".split()},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Павел".split(), "f": "Анна Вера Дарья Елена Ирина Ксения Мария Нина Ольга Софья".split()},
    "greek": {"m": "Αλέξης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(), "f": "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split()},
}
ENDINGS = {"latin": {"m": "rin", "f": "rina"}, "cyrillic": {"m": "рин", "f": "рина"}, "greek": {"m": "ρης", "f": "ρινα"}}
SYLLABLES = {"latin": "ba be da do fa fi ga go ka ke la li ma mo na ne pa ro sa ta to va ve wa".split(), "cyrillic": "ба ве га де жа ке ла ми но по ра се та".split(), "greek": "βα γε δα κο λα μι νο πα ρε σα τα".split()}
LATIN, CYRILLIC, GREEK, HEX, DIGITS = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω", "0123456789abcdef", "0123456789"
#: Inside a word only numbers after a letter are looked for, so that most places of a text cost one look back.
ANY = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(PATTERNS.values())})|(?<=\p{{L}})(?=\d)(?:{'|'.join(PATTERNS[k] for k in ('ip', 'ssn', 'card'))})"
#: What stands where the joint pattern found a number that is no entity.
NONE = "none"
_DIGEST = 128


def _chars(value: Column) -> Column:
    """The characters of a string, in time linear in its length (a split at nothing is not)."""
    return F.regexp_extract_all(value, F.lit("(?s)."), 0)


def _at(of: Column, i: Column, below: int) -> Column:
    """The i-th number under ``below`` of a string of hexadecimal digits, round and round."""
    return (F.conv(F.substr(of, (F.pmod(i * 4, F.lit(_DIGEST - 3)) + 1).cast("int"), F.lit(4)), 16, 10).cast("int") % below).cast("int")


def _let(value: Column, then) -> Column:
    """then(value) with the value made once, also where it is used within a function of every character."""
    return F.get(F.transform(F.array(value), then), 0)


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)


def _letters(value: Column, stream: Column, latin: str = LATIN) -> Column:
    """value with every digit and letter replaced by one of its kind, script and case; other characters stay.  Letters of other scripts become Latin ones."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda s: F.substr(F.lit(s), _at(stream, i, len(s)) + 1, F.lit(1))
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), pick(CYRILLIC)).when(c.rlike(r"\p{IsGreek}"), pick(GREEK)).otherwise(pick(latin))
        return F.when(c.rlike("[0-9]"), pick(DIGITS)).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(_chars(value), one), "")


def _more(stream: Column, n: Column, kinds: str) -> Column:
    """n further characters, of the 16 in ``kinds``."""
    return F.translate(F.substr(F.sha2(stream, 512), F.lit(1), F.least(n, F.lit(_DIGEST)).cast("int")), HEX, kinds)


def _spread(form: Column, digits: Column, slot: str = "[0-9]") -> Column:
    """form with its digits (or what ``slot`` matches) replaced, one after another, by those of ``digits``; those left over follow."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike(slot)
        return F.struct(F.concat(s["out"], F.when(digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    done = F.aggregate(_chars(form), state, step)
    return F.concat(done["out"], F.substr(digits, done["at"], F.lit(_DIGEST)))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, from its last one."""
    chars = F.reverse(_chars(digits))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 1, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def kind_of(value: Column) -> Column:
    """The kind of an entity that the joint pattern found; NONE for numbers as long as a card's that are none."""
    out = None
    for kind, pattern in PATTERNS.items():
        whole = value.rlike(rf"^(?:{pattern})$")
        named = F.when(_luhn(F.regexp_replace(value, "[^0-9]", "")) % 10 == 0, kind).otherwise(NONE) if kind == "card" else F.lit(kind)
        out = F.when(whole, named) if out is None else out.when(whole, named)
    return out.otherwise("name")


def canonical(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    name = F.lower(F.regexp_replace(F.regexp_replace(value, rf"^(?:{_TITLE})\.?[  ]+", ""), r"[  ]+", " "))
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "name", name).when(kind.isin("email", "ipv6"), F.lower(value)).when(kind == "iban", F.replace(value, F.lit(" "))).otherwise(value)


def gender_of(kind: Column, value: Column) -> Column:
    """m or f after such a title, else empty."""
    male, female = (value.rlike(rf"^(?:{'|'.join(x)})\.?[  ]") for x in (MALE, FEMALE))
    return F.when((kind == "name") & male, "m").when((kind == "name") & female, "f").otherwise("")


def parts_of(kind: Column, canon: Column, gender: Column) -> Column:
    """An entity's parts in order: array of (part_kind, part)."""
    part = lambda k, p: F.struct(k.alias("part_kind"), p.alias("part"))
    words = F.split(canon, " ")
    name = F.transform(words, lambda w, i: part(F.when(i == F.size(words) - 1, F.lit("last")).otherwise(F.concat(F.lit("given-"), gender)), w))
    mail = F.array(part(F.lit("local"), F.substring_index(canon, "@", 1)), part(F.lit("domain"), F.substring_index(canon, "@", -1)))
    return F.when(kind == "name", name).when(kind == "email", mail).otherwise(F.array(part(kind, canon)))


def draw(key: str, kind: Column, part: Column, form: Column, attempt: Column) -> Column:
    """A part's surrogate, itself canonical, of one draw; ``form`` is one of the entities that have the part, for a phone's country."""
    return _let(_hash(key, kind, part, attempt.cast("string")), lambda stream: _drawn(stream, kind, part, form, attempt))


def _drawn(stream: Column, kind: Column, part: Column, form: Column, attempt: Column) -> Column:
    soon = F.ceil(attempt / 2).cast("int")
    late = F.greatest(F.lit(0), F.ceil((attempt - 8) / 2)).cast("int")
    digits = F.concat(_letters(part, stream), _more(stream, late, "0123456789012345"))
    words = F.concat(_letters(part, stream), _more(stream, soon, LATIN[:16]))
    ends = F.substring_index(part, ".", -1)
    body = F.substr(part, F.lit(1), F.length(part) - F.length(ends) - 1)
    domain = F.concat(_letters(body, stream), _more(stream, soon, LATIN[:16]), F.lit("."), ends)
    ip = F.concat_ws(".", *[(_at(stream, F.lit(i), 254) + 1).cast("string") for i in range(4)])
    country = F.when(form.startswith("+"), 1).otherwise(0)
    phone = F.concat(F.substr(part, F.lit(1), country), F.substr(digits, country + 1, F.lit(_DIGEST)))
    body = F.concat(F.substr(part, F.lit(1), F.lit(1)), F.substr(_letters(part, stream), F.lit(2), F.length(part) - 2), _more(stream, late, "0123456789012345"))
    card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    hexadecimal = F.concat(_letters(part, stream, LATIN[:6]), _more(stream, late, HEX))
    script = F.when(part.rlike(r"\p{IsCyrillic}"), "cyrillic").when(part.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    pick = lambda names, j: F.get(F.array(*[F.lit(x) for x in names]), _at(stream, j, len(names)))
    last, given = None, {"m": None, "f": None}
    for s in SYLLABLES:
        own = script == s
        syllables = lambda n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda j: pick(SYLLABLES[s], j)), "")  # noqa: E731, B023
        surname = syllables(4 + soon)
        last = F.when(own, surname) if last is None else last.when(own, surname)
        for g in given:
            name = F.when(attempt == 0, F.lower(pick(FIRST[s][g], F.lit(0)))).otherwise(F.concat(syllables(1 + soon), F.lit(ENDINGS[s][g])))
            given[g] = F.when(own, name) if given[g] is None else given[g].when(own, name)
    of = F.when(kind == "local", words).when(kind == "domain", domain).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card)
    of = of.when(kind == "last", last).when(kind == "given-m", given["m"]).when(kind == "given-f", given["f"])
    of = of.when((kind == "secret") & part.rlike("^[0-9a-f]+$"), hexadecimal).when((kind == "secret") & part.rlike("^[0-9A-F]+$"), F.upper(hexadecimal))
    iban = F.concat(F.substr(part, F.lit(1), F.lit(2)), _letters(F.substr(part, F.lit(3), F.length(part)), stream), _more(stream, late, "0123456789012345"))
    of = of.when(kind == "ipv6", hexadecimal).when(kind == "iban", iban)
    return of.otherwise(digits)


def shown(kind: Column, value: Column, canon: Column) -> Column:
    """A surrogate in the form of the value that it replaces."""
    title = F.regexp_extract(value, rf"^((?:{_TITLE})\.?[  ]+)", 1)
    loud = lambda v, s, other: F.when(v.rlike(r"\p{Lu}") & ~v.rlike(r"\p{Ll}"), F.upper(s)).otherwise(other)
    name = F.concat(title, loud(F.substr(value, F.length(title) + 1, F.length(value)), canon, F.initcap(canon)))
    return F.when(kind == NONE, value).when(kind.isin("phone", "card", "ssn"), _spread(value, canon)).when(kind == "iban", _spread(value, canon, "[A-Z0-9]")).when(kind == "name", name).when(kind == "email", loud(value, canon, canon)).otherwise(canon)


def surrogates(parts: DataFrame, key: str) -> DataFrame:
    """parts (part_kind, part, form; each part once) with ``surrogate``: no two parts of a kind share one, and none is a part itself."""
    drawn = parts.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw(key, F.col("part_kind"), F.col("part"), F.col("form"), F.lit(0)))
    drawn = stored(drawn, "surrogates")
    while True:
        real = drawn.select("part_kind", F.col("part").alias("surrogate"))
        shared = drawn.groupBy("part_kind", "surrogate").agg(F.min(F.struct("attempt", "part")).alias("first"), F.count("*").alias("n")).where("n > 1")
        again = drawn.join(shared, ["part_kind", "surrogate"]).where("part <> first.part").select("part_kind", "part")
        again = again.union(drawn.join(real, ["part_kind", "surrogate"], "left_semi").select("part_kind", "part")).distinct().withColumn("again", F.lit(True))
        again = stored(again, "again")
        if again.isEmpty():
            dropped(again)
            return drawn
        turn = F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        new = F.when(F.col("again"), draw(key, F.col("part_kind"), F.col("part"), F.col("form"), F.col("turn"))).otherwise(F.col("surrogate"))
        before = drawn
        drawn = drawn.join(again, ["part_kind", "part"], "left").withColumn("turn", turn).select("part_kind", "part", "form", F.col("turn").alias("attempt"), new.alias("surrogate"))
        drawn = stored(drawn, "surrogates")
        dropped(before, again)


def replace_pii(docs: DataFrame, *, key: str) -> DataFrame:
    """docs with the entities of ``text`` replaced, and ``entities``: array of (kind, surrogate) in order.  A column of that name is replaced, others stay.

    A null text stays null, an empty one empty, both without entities.  Equal rows are treated alike; null and repeated doc_ids do not matter.  An
    empty table gives an empty result.
    """
    docs = docs.drop("entities")
    found = F.regexp_extract_all("text", F.lit(f"({ANY})"), 0)
    held = docs.select(row_key().alias("rkey"), F.posexplode(found).alias("pos", "value")).distinct().withColumn("kind", kind_of(F.col("value")))
    held = stored(held.withColumn("canon", canonical(F.col("kind"), F.col("value"))).withColumn("title", gender_of(F.col("kind"), F.col("value"))), "entities")

    #: Distinct entities, each with one of its forms.  A name of neutral title has the gender that it has elsewhere, or else its first word, or else one by that word's hash.
    every = held.where(F.col("kind") != NONE).groupBy("kind", "canon", "title").agg(F.min("value").alias("form")).withColumn("word", F.when(F.col("kind") == "name", F.substring_index("canon", " ", 1)))
    gendered = every.where("title <> ''")
    every = every.join(gendered.groupBy("kind", "canon").agg(F.min("title").alias("of_name")), ["kind", "canon"], "left").join(gendered.groupBy("word").agg(F.min("title").alias("of_word")), "word", "left")
    told = F.coalesce(F.nullif("title", F.lit("")), "of_name", "of_word", F.when(F.md5("word") < "8", "m").otherwise("f"))
    every = every.withColumn("parts", parts_of(F.col("kind"), F.col("canon"), told))
    split = stored(every.select("kind", "canon", "title", "form", F.posexplode("parts").alias("place", "p")).select("kind", "canon", "title", "form", "place", "p.*"), "parts")
    drawn = surrogates(split.groupBy("part_kind", "part").agg(F.min("form").alias("form")), key)
    whole = split.join(drawn.select("part_kind", "part", "surrogate"), ["part_kind", "part"]).groupBy("kind", "canon", "title").agg(F.array_sort(F.collect_list(F.struct("place", "surrogate")))["surrogate"].alias("drawn"))
    whole = whole.select("kind", "canon", "title", F.when(F.col("kind") == "email", F.array_join("drawn", "@")).otherwise(F.array_join("drawn", " ")).alias("drawn"))

    out = held.join(whole, ["kind", "canon", "title"], "left")
    one = F.struct("pos", "kind", shown(F.col("kind"), F.col("value"), F.col("drawn")).alias("surrogate"))
    per_row = out.groupBy("rkey").agg(F.array_sort(F.collect_list(one)).alias("_pii")).withColumnRenamed("rkey", "_pii_row")
    none = F.array().cast("array<struct<kind:string,surrogate:string>>")
    has = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    clean = docs.where(~has).withColumn("entities", none)
    marked = docs.where(has).withColumn("_pii_row", row_key()).join(per_row, "_pii_row").withColumn("_pii_parts", F.split("text", ANY, -1))
    text = F.zip_with("_pii_parts", F.col("_pii.surrogate"), lambda p, s: F.concat(F.coalesce(p, F.lit("")), F.coalesce(s, F.lit(""))))
    real = F.filter("_pii", lambda e: e["kind"] != NONE)
    marked = marked.withColumn("text", F.array_join(text, "")).withColumn("entities", F.transform(real, lambda e: F.struct(e["kind"].alias("kind"), e["surrogate"].alias("surrogate"))))
    return clean.unionByName(marked.drop("_pii", "_pii_row", "_pii_parts"))
