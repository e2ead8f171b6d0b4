"""Personal data: patterns propose spans, checksums confirm them, context words set the score.

Every text is read whole. The base kinds are ``email``, ``ip``, ``card`` and ``phone``; ``iban``
and ``ssn`` come on top. A card must pass Luhn, an account number mod 97, an address part is at
most 255 and a phone has 9 to 15 digits: what fails is dropped and not tried again in parts. Only
an account number may end before its run of capitals and digits does, at the end of any group. The
score is that of the kind, more when a word for it stands close before or after the span and less
when a word for something else does; base spans stay whatever their score, others need ``MIN_SCORE``.

The patterns below are cut so that each text is passed in linear time, whatever it holds: an
address is found from its ``@``, and digits that cannot start a span are never tried twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.arrow_text import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Score before context; words that raise it; words that lower it.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
NEAR = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse", "addr"),
    "card": ("card", "visa", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("version", "order", "invoice", "isbn", "serial", "build", "example", "ticket")
CONTEXT = 48
MIN_SCORE = 0.6

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}))")
_GROUP_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")
_NO_DIGITS = str.maketrans("", "", " ().+-")

#: Characters of an account number by country (ISO 13616); in other countries it has 15 to 34.
IBAN_LENGTH = {
    country: int(n)
    for n, countries in (
        part.split(":")
        for part in (
            "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV "
            "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
            "25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV "
            "29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for country in countries.split(",")
}

SCHEMA = (
    "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>"
)
_SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]
)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of international account numbers: letters count as 10 to 35."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for block in _DOTTED.finditer(text):
        if block[0].count(".") >= 3:
            for m in _IP.finditer(block[0]):
                # Long parts are not turned into numbers; leading zeros do not count.
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                    yield block.start() + m.start(), block.start() + m.end()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].translate(_NO_DIGITS)
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(m[0].translate(_NO_DIGITS)) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _IBAN.finditer(text):
        start, stop = m.start(), m.end(1)
        if start < last:
            continue
        # What follows may look like more groups: the country says where to end, else the longest
        # end that passes counts. A run of another length than the country's must pass as a whole.
        ends = {}
        for g in _GROUP_END.finditer(text, m.end()):
            if g.end() > stop:
                break
            account = text[start : g.end()].replace(" ", "")
            if len(account) >= 15:
                ends[len(account)] = (g.end(), account)
        lengths = sorted(ends, reverse=True)
        if own := IBAN_LENGTH.get(text[start : start + 2]):
            lengths = [n for n in dict.fromkeys((own, *lengths[:1])) if n in ends]
        for n in lengths:
            if mod97(ends[n][1]):
                last = ends[n][0]
                yield start, last
                break


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


#: What a text must hold for a kind to be looked for, and the finder.
_FINDERS = {
    "email": ("@", _emails),
    "ip": (".", _ips),
    "card": ("", _cards),
    "phone": ("+", _phones),
    "iban": ("", _ibans),
    "ssn": ("-", _ssns),
}


def _score(kind: str, text: str, start: int, end: int) -> float:
    sides = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    words = [w.lower() for side in sides for w in _WORD.findall(side)]
    score = SCORE[kind]
    if any(w.startswith(NEAR[kind]) for w in words):
        score += 0.3
    if any(w.startswith(AGAINST) for w in words):
        score -= 0.3
    return round(min(1.0, max(0.0, score)), 2)


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind in the order of ``KINDS``, then by start."""
    out = []
    for kind in KINDS:
        needed, finder = _FINDERS[kind]
        if needed not in text:
            continue
        for start, end in finder(text):
            score = _score(kind, text, start, end)
            if kind in BASE or score >= MIN_SCORE:
                out.append((kind, start, end, score))
    return out


def find(docs: DataFrame) -> DataFrame:
    """doc_id and all spans of ``docs(doc_id, text)``: one row per input row.

    Starts and ends count code points, the end is exclusive. A null or empty text has no
    spans; a null ``doc_id`` stays null; repeated rows stay repeated; other columns are
    ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            found = [
                [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(t)]
                for t in texts.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(found, pa.list_(_SPAN))], ["doc_id", "spans"]
            )

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return wanted.mapInArrow(run, SCHEMA)


def as_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
