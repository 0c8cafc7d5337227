import re
import time
from collections import defaultdict

import pytest
import regex

from motion_tables.llm import pii

TEXTS = [
    (1, "Mr. John Smith met Mrs Smith and Frau Müller at a.b@x.org, A.B@x.org, 10.1.2.3"),
    (2, "call +1 (017) 555-7713 or +1 017 555 7713, card 4111 1111 1111 1111 or 4111111111111111 or 1234567812345678"),
    (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ssn 123-45-6789, господин Иванов, κυρία Παπαδά'),
    (4, "nothing private: 3.14, version 1.2.3, 12 apples, the year 2026-10-11, x@y"),
    (5, "Mr Smith again, a.b@x.org and 10.1.2.3!!"),
    (6, None),
    (7, ""),
]


@pytest.fixture(scope="module")
def replaced(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return {r.doc_id: r for r in pii.replace_pii(df, key="k").collect()}


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def test_clean_texts_stay(replaced):
    assert replaced[4].text == TEXTS[3][1] and replaced[6].text is None and replaced[7].text == "" and not replaced[4].entities


def test_no_private_value_is_left(replaced):
    text = " ".join(r.text or "" for r in replaced.values())
    for secret in ("Smith", "Müller", "a.b@x.org", "10.1.2.3", "7713", "4111", "24be64", "123-45", "Иванов", "Παπαδά"):
        assert secret not in text


@pytest.mark.parametrize("text,left", [
    ("met Mr John Ronald Reuel Tolkien there", "Tolkien"), ("x@aa.bb.cc.dd.ee.ff.gg.hh.ii.kk.example.com", "example"), ("to " + "longname" * 20 + "@host.org now", "longname"), ("call 5551234567 now", "5551234567"), ("call 0171 2345678 now", "2345678"),
    ("pay DE44 5001 0517 5407 3249 31 or GB82WEST12345698765432", "5407"), ("from 2001:db8:85a3:0:0:8a2e:370:7334 and fe80::1ff:fe23:4567:890a", "8a2e"), ("asked Mr. de la Cruz and Frau von der Leyen", "Cruz"), ("saw Mr  Smith and Mr Jones Mrs Brown", "Smith"), ("-john.doe@mail.example.co.uk, a", "john"),
    ("x@foo-bar.com- and y@host.org.", "foo-bar"), ("mail j@b.com.", "b.com"),
])
def test_planted_entities_are_found(spark, text, left):
    r = pii.replace_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"), key="k").first()
    assert left not in r.text and r.entities


def test_what_is_no_entity_stays(spark):
    texts = ["at 12:30:45 on 2026-10-11, ratio 3:4:5, a::b", "3@4.5 and x@y", "order 123456789 or 12345678901", "de la casa, Drama Mrs", "version 10.20.30, ABCD 1234 EFGH"]
    got = pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").collect()
    assert {r.doc_id: r.text for r in got} == dict(enumerate(texts))


def test_type_format_gender_and_script(replaced):
    e = {i: [(x.kind, x.surrogate) for x in r.entities] for i, r in replaced.items()}
    names = [s for k, s in e[1] if k == "name"]
    assert names[0].split()[0] == "Mr." and names[0].split()[1] in pii.FIRST["latin"]["m"] and names[1].split()[0] == "Mrs" and names[2].startswith("Frau ")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", e[2][0][1]) and re.fullmatch(r"\+1 \d{3} \d{3} \d{4}", e[2][1][1])
    cards = [s for k, s in e[2] if k == "card"]
    assert len(cards) == 2 and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", cards[0]) and luhn(cards[0])
    assert not luhn(TEXTS[1][1][-16:]) and replaced[2].text.endswith(TEXTS[1][1][-16:])  # no card
    assert re.fullmatch(r"[0-9a-f]{40}", e[3][0][1]) and re.fullmatch(r"\d{3}-\d{2}-\d{4}", e[3][1][1])
    assert re.search(r"[А-я]", e[3][2][1].split()[-1]) and re.search(r"[Α-ω]", e[3][3][1].split()[-1])


def test_coreference(replaced):
    e = {i: [(x.kind, x.surrogate) for x in r.entities] for i, r in replaced.items()}
    name = lambda s: s.split()[-1]
    assert name(e[1][0][1]) == name(e[1][1][1]) == name(e[5][0][1])
    assert e[1][3] == e[1][4] == e[5][1] and e[1][5] == e[5][2]
    digits = [re.sub(r"\D", "", s) for _, s in e[2]]
    assert digits[0] == digits[1] and digits[2] == digits[3] and len(digits) == 4


def brute(spark, docs):
    """Each entity's canonical parts, by plain Python, against the surrogates' parts: pairs that must be a one-to-one map of each kind."""
    found = regex.compile(pii.ANY)
    before = {r.doc_id: r.text for r in docs.collect()}
    pairs = defaultdict(set)
    for r in pii.replace_pii(docs, key="z").collect():
        old = [m[0] for m in found.finditer(before[r.doc_id] or "")]
        new = [m for m in old if len(re.sub(r"\D", "", m)) >= 13 and re.fullmatch(r"[\d -]+", m) and not luhn(m)]
        old = [m for m in old if m not in new]
        assert len(old) == len(r.entities) and all(m in r.text for m in new)
        for o, e in zip(old, r.entities):
            o, s = o.lower(), e.surrogate.lower()
            if e.kind == "email":
                pairs["local"].add((o.split("@")[0], s.split("@")[0]))
                pairs["domain"].add((o.split("@")[1], s.split("@")[1]))
            elif e.kind == "name":
                pairs["last"].add((o.split()[-1], s.split()[-1]))
            else:
                digits = (lambda x: re.sub(r"\D", "", x)) if e.kind in ("phone", "card", "ssn") else str
                pairs[e.kind].add((digits(o), digits(s)))
    return pairs


def one_to_one(pairs):
    for found in pairs.values():
        assert len({a for a, _ in found}) == len({b for _, b in found}) == len(found)
        assert not {a for a, _ in found} & {b for _, b in found}


def test_crowded_entities_stay_distinct(spark):
    """26 addresses of one letter, and phone numbers that fill a third of the numbers of their length."""
    rows = [(i, f"{c}@mail.org and {c}1@mail.org") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    rows += [(100 + i, f"+1 {i:02} {j:02}") for i in range(60) for j in range(0, 100, 5)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    pairs = brute(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(pairs["local"]) == 52 and len(pairs["domain"]) == 1 and len(pairs["phone"]) == 1200
    one_to_one(pairs)


def test_coreference_after_redraws(spark):
    """More given names than the lists have: those drawn again change no surname, and each stays the same wherever it stands."""
    given = [f"{a}{b}" for a in ("Al", "Be", "Ce", "Do", "Ev", "Fa", "Gi", "Ho") for b in ("an", "ber", "din", "fon", "gar")]
    rows = [(i, f"Mr {g} Smith, Dr {g} Jones and Mr Smith") for i, g in enumerate(given)]
    out = {r.doc_id: [e.surrogate.split() for e in r.entities] for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    assert {x[0][2] for x in out.values()} == {x[2][1] for x in out.values()} and len({x[0][2] for x in out.values()}) == 1
    assert all(x[0][1] == x[1][1] for x in out.values()) and len({x[0][1] for x in out.values()}) == len(given)


def test_against_brute_force(spark):
    pairs = brute(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").dropDuplicates(["doc_id"]))
    assert {"local", "domain", "ip", "phone", "card", "secret"} <= {*pairs}
    one_to_one(pairs)


def test_very_long_words(spark):
    """A word of 100,000 characters takes no longer than another text of its length."""
    n = 10**5
    rows = [(0, "x" * n), (1, "a." * (n // 2)), (2, "a@" * (n // 2)), (3, "1" * n), (4, "0123456789abcdef" * (n // 16)), (5, "a@" + "b." * (n // 2)), (6, "sk-" * (n // 3)), (7, "+1" * (n // 2)), (8, "Mr A" + "b" * n), (9, "1.1." * (n // 4))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id")
    began = time.time()
    out = {r.doc_id: r for r in pii.replace_pii(df, key="k").collect()}
    assert time.time() - began < 60
    assert all(out[i].text == rows[i][1] for i in (0, 1, 2, 7, 9)) and out[8].text != rows[8][1]


def test_edges(edges, none):
    out = pii.replace_pii(edges, key="k")
    assert out.count() == edges.count() and {*out.columns} == {*edges.columns}
    before = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in edges.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect()) == before
    assert pii.replace_pii(none, key="k").count() == 0
