"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmark.llm.common import docs_of

#: Kinds in the order in which ties of start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Words near a span that make it likelier; those of its own kind.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
#: How long the IBANs of each country of the published registry are.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_IBAN_LENGTH = {country: n for n, countries in IBAN_LENGTHS.items() for country in countries.split()}
NEAR = 40  # code points on either side in which context words are looked for
PROPOSED, CONFIRMED, IN_CONTEXT = 0.5, 0.3, 0.2
KEEP_EXTRA = 0.7  # an added span needs this score: its checksum, or else its context

SPANS = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"

_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match begins where its run of digits begins, so looking back one character keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_end(proposed: str) -> int:
    """How much of a proposed IBAN is one: as many letters and digits as its country's have, if a word ends there, and
    otherwise all of it; what follows may be a word in capitals."""
    left = _IBAN_LENGTH.get(proposed[:2], 0)
    for i, c in enumerate(proposed):
        left -= c != " "
        if left == 0:
            return i + 1 if proposed[i + 1 : i + 2] in ("", " ") else len(proposed)
    return len(proposed)


def ssn_valid(ssn: str) -> bool:
    """Whether area, group and serial number are such as are given out."""
    area, group, serial = ssn.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each "@" with the run of local characters before it and the domain after it; the runs of two "@" are
    apart, so long runs cost no more than their length."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = 0
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = done = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _proposed(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, confirmed by its checksum) of what passes its validator."""
    for a, b in _emails(text):
        yield "email", a, b, False
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            yield "ip", m.start(), m.end(), True
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield "card", m.start(), m.end(), True
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield "phone", m.start(), m.end(), False
    for m in _IBAN.finditer(text):
        end = _iban_end(m[0])
        if mod97(iban := m[0][:end]):
            yield "iban", m.start(), m.start() + end, _IBAN_LENGTH.get(iban[:2]) == len(iban.replace(" ", ""))
    for m in _SSN.finditer(text):
        if ssn_valid(m[0]):
            yield "ssn", m.start(), m.end(), False


def find_spans(text: str | None) -> list[dict]:
    """All spans of one text by start, then kind; starts and ends are code points, ends exclusive."""
    if not text or not _ANY.search(text):
        return []
    out = []
    for kind, a, b, confirmed in _proposed(text):
        near = {w.lower() for w in _WORD.findall(text[max(0, a - NEAR) : a] + " " + text[b : b + NEAR])}
        score = PROPOSED + CONFIRMED * confirmed + IN_CONTEXT * (not near.isdisjoint(CONTEXT[kind]))
        if kind in BASE or score >= KEEP_EXTRA:
            out.append({"kind": kind, "start": a, "end": b, "text": text[a:b], "score": round(score, 6)})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


def redact(text: str | None, spans: list[dict]) -> str | None:
    """``text`` with each span, or run of overlapping ones, replaced by its kind in angle brackets."""
    if not spans:
        return text
    parts, done = [], 0
    for s in spans:
        if s["start"] >= done:
            parts += [text[done : s["start"]], f"<{s['kind'].upper()}>"]
        done = max(done, s["end"])
    return "".join([*parts, text[done:]])


_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("score", pa.float64())]))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and ``spans``, an array of (kind, start, end, text, score).

    Base kinds (email, ip, card, phone) are kept whenever they pass their check; the added kinds when their score reaches
    ``KEEP_EXTRA``: an iban passes mod-97 and has its country's length or else a context word nearby, an ssn has parts
    that are given out and a context word. One pass over Arrow batches, no shuffle;
    patterns take time in proportion to the text. Null and empty texts have no spans; ids are passed on as
    they are, null or repeated.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [find_spans(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, type=_ARROW_SPANS)], ["doc_id", "spans"])

    rows = docs_of(docs, id_col, text_col)
    return rows.mapInArrow(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text_col`` replaced by their kind; all columns and rows stay, null text too."""
    at = docs.columns.index(text_col)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            new = pa.array([redact(t, find_spans(t)) for t in texts], type=b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    return docs.mapInArrow(replace, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = _of("spans", *BASE)
    counts = [F.size(_of("spans", k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
