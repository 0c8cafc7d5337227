"""The canonical text of JSON documents: keys in order of their code points at every depth, no white space, one spelling of each string and number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r'"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*|[a-zA-Z]+|[\[\]{},:]'
_MARKED = r'"s[0-9A-F]*"|"n[^"]*"|[^"]+'


def _string(text: Column) -> Column:
    """A string as JSON spells it: only quotes, backslashes and control characters are escaped."""
    out = text
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    for code in (c for c in range(32) if c not in (8, 9, 10, 12, 13)):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), out).otherwise(text), F.lit('"'))


def _number(text: Column) -> Column:
    """A number as the shortest digits that read back as it: whole numbers as they are, others with a point, from 1e16 on and below 1e-4 with an exponent of two digits or more."""
    whole = F.when(text == "-0", "0").otherwise(text)
    value = text.cast("double")
    some = F.format_string("%.15e", F.abs(value))  # 16 digits if they read back as the number, else 17
    digits17 = F.when(some.cast("double") == F.abs(value), some).otherwise(F.format_string("%.16e", F.abs(value)))
    short = F.regexp_replace(F.regexp_extract(digits17, "^([0-9.]+)e", 1), r"\.?0*$", "")
    power = F.regexp_extract(digits17, r"e([+-][0-9]+)$", 1).try_cast("int")
    digits = F.replace(short, F.lit("."))
    after = F.substr(digits, power + 2, F.length(digits))
    large = F.concat(F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, "0"), F.lit("."), F.when(after == "", "0").otherwise(after))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    far = F.concat(short, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    spelled = F.concat(F.when(text.startswith("-"), "-").otherwise(""), F.when(F.abs(value) == float("inf"), "Infinity").when(value == 0, "0.0").when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(far))
    return F.when(text.rlike("^-?[0-9]+$"), whole).otherwise(spelled)


def canonical_text(document: Column) -> Column:
    """The canonical text of a JSON document's text; null for a text that is no JSON, or that names a key of an object twice.

    Every string becomes the hex digits of its UTF-8 bytes and every number a string, so that a variant, whose objects' keys are sorted, keeps the
    spelling of numbers and sorts keys by code point; then both are spelled out again.
    """
    def mark(t: Column) -> Column:
        value = F.get_json_object(F.concat(F.lit('{"a":'), t, F.lit("}")), "$.a")
        return F.when(t.startswith('"'), F.concat(F.lit('"s'), F.hex(F.encode(value, "UTF-8")), F.lit('"'))).when(t.rlike("^-?[0-9]"), F.concat(F.lit('"n'), t, F.lit('"'))).otherwise(t)

    def spell(t: Column) -> Column:
        inner = F.substr(t, F.lit(3), F.length(t) - 3)
        return F.when(t.startswith('"s'), _string(F.decode(F.unhex(inner), "UTF-8"))).when(t.startswith('"n'), _number(inner)).otherwise(t)

    valid = F.try_parse_json(document).isNotNull()
    marked = F.array_join(F.transform(F.regexp_extract_all(document, F.lit(_TOKEN), F.lit(0)), mark), "")
    sorted_ = F.to_json(F.try_parse_json(marked))
    return F.when(valid, F.array_join(F.transform(F.regexp_extract_all(sorted_, F.lit(_MARKED), F.lit(0)), spell), ""))
