import random
import re
import time

import pytest

from lotline.llm import pii, queries
from tests.llm.data import documents, with_odd_columns


def brute(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@pytest.mark.parametrize("letters,longest", [("aB1205..@@-_+ ()0é", 40), ("0123456789- ", 30), ("a.@-", 15), ("1.25", 14), ("+1 (5)-.", 24)])
def test_base_spans(letters, longest):
    rng = random.Random(letters)
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))
        assert pii.base_spans(text) == brute(text), text


def test_checks_and_context():
    text = "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 GB83WEST12345698765432 call 555-123-4567 or ssn 123-45-6789"
    assert pii.joined(pii.find(text)[1]) == "iban:5:32,iban:34:56,nat_phone:85:97,us_ssn:105:116"
    assert pii.find("the numbers 555-123-4567 and 123-45-6789 alone")[1] == []
    assert pii.masked("a x@y.z b", pii.find("a x@y.z b")[1]) == "a <EMAIL> b"
    # A card within what a phone pattern takes: one mask.
    both = "+4111 1111 1111 111 1"
    assert pii.masked(both, [(0, 17, "phone"), (1, 21, "card")]) == "<PHONE>"


@pytest.mark.parametrize("after", ["", " BIC COBADEFFXXX", " EUR 50", " I will", " 12 May", " A 1 B 2 C 3", ", then", " GB29NWBK60161331926819"])
@pytest.mark.parametrize("iban", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB29NWBK60161331926819", "NO9386011117947"])
@pytest.mark.parametrize("before", ["", "REF AB12 ", "pay "])
def test_ibans_end_where_they_end(before, iban, after):
    text = before + iban + after
    spans = list(pii.ibans(text))
    assert spans[0] == (len(before), len(before) + len(iban))
    assert len(spans) == (2 if after == " GB29NWBK60161331926819" else 1)
    base, found = pii.find(text)
    # With the day after it, the digits of one pass as a card, which goes before.
    if base:
        assert pii.joined(base).startswith("card:") and (iban, after) == ("GB29NWBK60161331926819", " 12 May")
    else:
        assert [s[:2] for s in found if s[2] == "iban"] == spans and pii.masked(text, found).startswith(f"{before}<IBAN>")


def test_long_texts_take_linear_time():
    start = time.process_time()
    for text in ("1" * 10**6, "a" * 10**6 + "@", "1." * 500_000, "+1" + " " * 10**6, "GB12" + "A1" * 500_000, "(1 " * 300_000, "a@" * 300_000):
        pii.find(text)
    assert time.process_time() - start < 60


def test_rows(spark):
    values = [None, "", "x@y.z", "plain é 10.0.0.1", "x@y.z x@y.z", "call 555-123-4567"]
    docs = documents(spark, values)
    docs = docs.union(docs.selectExpr("CAST(NULL AS bigint)", "text", "lang", "source", "n_chars"))
    got = pii.detect(with_odd_columns(docs)).collect()
    assert len(got) == 12
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by_id[i].n_email for i in range(6)] == [0, 0, 1, 0, 2, 0]
    assert by_id[0].masked_text is None and by_id[0].spans == "" and by_id[3].base_spans == "ip:8:16"
    assert by_id[5].base_spans == "" and by_id[5].spans == "nat_phone:5:17"
    masked = docs.select("doc_id", pii.mask("text").alias("m")).where("doc_id is not null").orderBy("doc_id").collect()
    assert [r.m for r in masked] == [by_id[i].masked_text for i in range(6)]
    assert pii.detect(docs.limit(0)).collect() == []


def test_query(spark):
    rows = queries.op9_pii(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert rows.where("n_email > 0").count() > 0
