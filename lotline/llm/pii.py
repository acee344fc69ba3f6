"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds, in this order: ``email ip card phone`` (always kept as found), then ``iban`` (mod-97),
``nat_phone`` (a number of 7 to 15 digits without ``+``) and ``us_ssn``. The last three are kept only
from a score of ``KEEP`` on, and only where they do not overlap a span that is kept already. All
patterns take time in proportion to the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm.common import ship, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "nat_phone", "us_ssn")
#: A scored span is kept from here on.
KEEP = 0.6
#: Code points before and after a span in which context words count.
NEARBY = 40

# Words that make a kind more likely, and what a hit adds to its score.
CONTEXT = {
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "nat_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "us_ssn": ("ssn", "social security"),
}
START = {"iban": 0.2, "nat_phone": 0.2, "us_ssn": 0.3}
CONTEXT_BONUS = 0.4
CHECK_BONUS = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is taken whole: where a match fails from its first digit, it fails from the others too.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NAT_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
#: Characters of an IBAN without spaces, by country; those of other countries may end after any word.
_IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an IBAN without spaces."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Where IBANs are, by mod-97. A proposal runs on into upper-case words and numbers that follow, so it
    is cut after a word: at its country's length if that fits, else at the last word that passes."""
    m = _IBAN.search(text)
    while m:
        start, found = m.span()[0], m.group()
        ends = [i for i in range(len(found), 14, -1) if i == len(found) or found[i] == " "]
        plain = {i: found[:i].replace(" ", "") for i in ends}
        known = _IBAN_LENGTHS.get(found[:2])
        ends.sort(key=lambda i: (len(plain[i]) != known, -i))
        end = next((i for i in ends if len(plain[i]) >= 15 and mod97(plain[i])), None)
        if end is not None:
            yield start, start + end
        # What did not pass may have one in its words.
        m = _IBAN.search(text, start + (4 if end is None else end))


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, from one ``@`` to the next."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end, "email"
        else:
            end = at + 1
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds by start, then kind."""
    found: list[Span] = list(emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # Longer than any number up to 255 with leading zeros would have to be; int() of it could take long.
            if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.groups()):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def scored(text: str) -> Iterator[tuple[Span, float]]:
    """Proposals of the further kinds with their scores; IBANs and the others need a digit."""
    for kind, pattern in (("iban", _IBAN), ("us_ssn", _SSN), ("nat_phone", _NAT_PHONE)):
        for start, end in ibans(text) if kind == "iban" else (m.span() for m in pattern.finditer(text)):
            score = START[kind] + (CHECK_BONUS if kind == "iban" else 0)
            near = text[max(0, start - NEARBY) : end + NEARBY].lower()
            if any(re.search(rf"(?<!\w){re.escape(w)}(?!\w)", near) for w in CONTEXT[kind]):
                score += CONTEXT_BONUS
            yield (start, end, kind), score


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """The base spans and all spans of a text; positions are code points, ends exclusive."""
    if not text:
        return [], []
    base = base_spans(text)
    kept = list(base)
    if _DIGIT.search(text):
        # Disjoint, by start: a proposal can only overlap the last one that starts before its end.
        starts: list[int] = []
        ends: list[int] = []
        for start, end, _ in base:
            if ends and start < ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)
        for (start, end, kind), score in scored(text):
            i = bisect_left(starts, end)
            if score >= KEEP and (i == 0 or ends[i - 1] <= start):
                kept.append((start, end, kind))
                starts.insert(i, start)
                ends.insert(i, end)
    return base, sorted(kept, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with ``<KIND>`` for each span; spans that overlap become one mask of the first kind."""
    out, end = [], 0
    for start, stop, kind in spans:
        if start >= end:
            out += [text[end:start], f"<{kind.upper()}>"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def mask(column: str) -> Column:
    """A text column with all spans masked; null stays null."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def without(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, find(t)[1]) if isinstance(t, str) else None)

    return without(column)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans, masked_text``, one row per row of ``docs``.

    The counts and ``base_spans`` are of the four base kinds; ``spans`` has all. Spans are written
    ``kind:start:end`` by start, then kind, joined by commas. A null text counts as empty and stays
    null in ``masked_text``; no spans give an empty string. Rows that repeat stay rows, a null id stays
    null, other columns are not read.
    """
    ship(docs.sparkSession)
    kinds = [f"n_{k}" for k in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            pairs = [find(t) for t in texts]
            counts = [pa.array([sum(s[2] == k for s in b) for b, _ in pairs], pa.int64()) for k in BASE]
            strings = [
                pa.array([joined(b) for b, _ in pairs]),
                pa.array([joined(a) for _, a in pairs]),
                pa.array([masked(t, a) if t else t for t, (_, a) in zip(texts, pairs, strict=True)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, *strings], ["doc_id", *kinds, "base_spans", "spans", "masked_text"]
            )

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, " + ", ".join(f"{k} bigint" for k in kinds)
    return chosen.mapInArrow(run, f"{schema}, base_spans string, spans string, masked_text string")
