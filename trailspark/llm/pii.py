"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Kinds of the base: email, ip, card (Luhn), phone. The method adds iban (mod-97)
and ssn (area, group and serial rules), the latter only with a context word
nearby. Spans are code-point offsets, end exclusive.

Every proposer is linear in the text's length: e-mail addresses are found from
their ``@`` outwards, and digit runs are entered at their first digit only.

Defined results: null and empty texts have no spans; each row is judged alone,
so ties, repeated rows and null ids need nothing; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Words that raise a kind's score when they stand within REACH code points before a span.
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|address)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login|client)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|debit|visa|mastercard|payment|cvv)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|contact)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|transfer|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security)\b", re.I),
}
AGAINST = re.compile(r"\b(?:version|order|invoice|sku|serial|isbn|page)\b", re.I)
REACH = 40
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)
    return out


def _digits(s: str) -> str:
    return s.replace(" ", "").replace("-", "")


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans by kind, then start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    for m in _IBAN.finditer(text):
        body = m[0].replace(" ", "")
        if 15 <= len(body) <= 34 and mod97(body):
            out.append(("iban", m.start(), m.end()))
    out += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text) if CONTEXT["ssn"].search(text, max(0, m.start() - REACH), m.start())]
    return out


def score(text: str, kind: str, start: int) -> float:
    """Confidence of a confirmed span from its kind and the words before it."""
    near = text[max(0, start - REACH) : start]
    s = PRIOR[kind] + 0.1 * bool(CONTEXT[kind].search(near)) - 0.2 * bool(AGAINST.search(near))
    return round(min(1.0, max(0.0, s)), 3)


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,stop:long,score:double>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its spans, by kind as listed in KINDS, then start."""

    def run(batches):
        for b in slices(batches, "text"):
            found = []
            for t in b.column("text"):
                body = t.as_py() or ""
                found.append([{"kind": k, "start": s, "stop": e, "score": score(body, k, s)} for k, s, e in find(body)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _written(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), F.round(F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)), 3).alias("top_score")
    )
