"""Operator 5: personal data by patterns, checksums and context.

Regular expressions propose spans. Validators confirm them: Luhn for cards,
mod-97 for bank accounts (IBAN), ranges for addresses, digit counts for phones.
Each confirmed span has a score, by how much its validator proves; words nearby
that name its kind raise it, words that speak against it lower it. Spans of the
four base kinds always stay, unless `base_threshold` is given; those of the
added kinds (iban; ssn, a number in the form 000-00-0000) stay from a score of
`threshold` on: an iban unless words speak against it only, an ssn only if words
speak for it. Added spans that overlap a base span go.

Null and empty texts have no spans. Texts are searched whole; every pattern
takes time in proportion to the text. Repeated rows are searched each on its
own; an empty table gives an empty result; other columns of the input are
ignored, but for redact(), which keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, numbered, slices, table

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS
THRESHOLD = 0.6
SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"

# A domain behind an @; the local part in front is found by going back from it, which keeps the search linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits: the run's first digit would have matched, too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Words within this many characters of a span adjust its score.
REACH = 40
_CONTEXT = {
    "email": (re.compile(r"(?i)\b(e-?mail|contact|write to|correo|courriel)\b"), re.compile(r"(?i)\b(noreply|example)\b")),
    "ip": (re.compile(r"(?i)\b(ip|address|host|server|login)\b"), re.compile(r"(?i)\b(version|release|section|v)\b")),
    "card": (re.compile(r"(?i)\b(card|visa|credit|debit|karte|carte|tarjeta)\b"), re.compile(r"(?i)\b(isbn|order|invoice|tracking|serial)\b")),
    "phone": (re.compile(r"(?i)\b(phone|call|tel|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\b"), re.compile(r"(?i)\b(score|order|serial)\b")),
    "iban": (re.compile(r"(?i)\b(iban|account|bank|konto|compte|cuenta)\b"), re.compile(r"(?i)\b(part|model|serial)\b")),
    "ssn": (re.compile(r"(?i)\b(ssn|social security)\b"), re.compile(r"(?i)\b(part|model|serial|order|isbn)\b")),
}
#: Score of a span that its validator has confirmed, by how much that proves.
_CONFIRMED = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.75, "ssn": 0.4}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Country and check digits go to the end, letters count from 10; the number must leave 1."""
    moved = iban[4:] + iban[:4]
    rest = 0
    for c in moved:
        rest = (rest * (100 if c > "9" else 10) + int(c, 36)) % 97
    return rest == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            end = m.end()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A match may run on over words that follow, or start too early: ends at its spaces are tried, the longest first, then later starts."""
    at = 0
    while m := _IBAN.search(text, at):
        at, start, end = m.start() + 1, m.start(), m.end()
        while end > start and len(plain := text[start:end].replace(" ", "")) >= 15:
            if len(plain) <= 34 and mod97(plain):
                yield start, end
                at = end
                break
            end = text.rfind(" ", start, end)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, by kind."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in _ibans(text):
        yield "iban", start, end
    if "-" in text:
        for m in _SSN.finditer(text):
            yield "ssn", m.start(), m.end()


def find(text: str, threshold: float = THRESHOLD, base_threshold: float = 0.0) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed; code points, end exclusive."""
    out, taken = [], []
    for kind, start, end in _proposed(text):
        near = text[max(0, start - REACH) : start] + " \n " + text[end : end + REACH]
        for_it, against = _CONTEXT[kind]
        score = min(1.0, max(0.0, _CONFIRMED[kind] + 0.3 * bool(for_it.search(near)) - 0.3 * bool(against.search(near))))
        if kind in BASE_KINDS:
            if score < base_threshold:
                continue
            taken.append((start, end))
        elif score < threshold or any(s < end and start < e for s, e in taken):
            continue
        out.append((kind, start, end, round(score, 2)))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def detect(docs: DataFrame, threshold: float = THRESHOLD, base_threshold: float = 0.0) -> DataFrame:
    """docs(doc_id, text) -> doc_id, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in slices(batches, "text"):
            found = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find(t, threshold, base_threshold)] for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return doc_text(docs).mapInArrow(run, f"doc_id long, spans {SPAN}")


def masked(text: str, threshold: float = THRESHOLD) -> str:
    out, end = [], 0
    for kind, start, stop, _ in find(text, threshold):
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns; in text, each span (or run of overlapping spans) gives way to the name of its first kind in brackets. Null texts stay null."""

    at = docs.columns.index("text")
    plain = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = pa.array([None if t is None else masked(t, threshold) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.record_batch([texts if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def joined(spans: F.Column) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scores(spans: F.Column) -> F.Column:
    """One for each of joined()."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.format_number(s["score"], 2)))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return detect(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"), scores(spans).alias("scores"))
