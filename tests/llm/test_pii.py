import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plotmark.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0123456789()é_%", max_size=60))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert [(s["kind"], s["start"], s["end"]) for s in pii.find_spans(text) if s["kind"] in pii.BASE] == brute(text)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("pay 4111 1111 1111 1111 now", ["card"]),
        ("pay 4111 1111 1111 1112 now", []),
        ("IBAN DE89 3704 0044 0532 0130 00.", ["iban"]),
        ("IBAN DE88 3704 0044 0532 0130 00.", []),
        ("DE89 3704 0044 0532 0130 00 IS OURS", ["iban"]),
        ("GB82WEST12345698765432", ["iban"]),
        ("NO93 8601 1117 947", ["iban"]),
        ("DE57 3704 0044 0532 0130", []),
        ("SSN 000-12-3456, 666-12-3456, 912-12-3456, 123-00-4567 and 123-45-0000", []),
        ("my SSN is 078-05-1120", ["ssn"]),
        ("part 078-05-1120", []),
        ("call +1 (555) 555-1234", ["phone"]),
        ("at 10.0.0.255 and 10.0.0.256", ["ip"]),
    ],
)
def test_validators_and_context(text, kinds):
    assert [s["kind"] for s in pii.find_spans(text)] == kinds


def test_an_iban_ends_where_its_country_says():
    text = "DE89 3704 0044 0532 0130 00 IS OURS"
    assert [s["text"] for s in pii.find_spans(text)] == [text[:27]]
    check = 98 - int("370400440532013" + "131400") % 97
    short = f"DE{check:02} 3704 0044 0532 013"
    assert pii.mod97(short) and not pii.find_spans(short) and pii.find_spans("IBAN " + short)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "-" * 200_000, "a@" * 100_000):
        pii.find_spans(text)


def test_tables(spark, odd_docs, no_docs):
    assert pii.pii_spans(odd_docs).count() == odd_docs.count()
    assert pii.pii_spans(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "x a@b.co y +1 (555) 555-1234", "spans"), (2, None, None)], "doc_id int, text string, spans string")
    assert [r.text for r in pii.redact_pii(docs).orderBy("doc_id").collect()] == ["x <EMAIL> y <PHONE>", None]
