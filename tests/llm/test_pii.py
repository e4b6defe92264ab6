"""Spans against a plain search with the contract's patterns, and the edge cases."""

import hashlib
import re

import pytest

from demur.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return [
        f"{k}:{m.start()}:{m.end()}"
        for k, p in PATTERNS.items()
        for m in re.finditer(p, text or "")
        if valid(k, m.group())
    ]


TEXTS = [
    None,
    "",
    "no data here",
    "a@b.c_d@e.f.g x..y%+-@host-1.example.com. foo@bar baz@.x @a.b",
    "日本 é user.name@exämple.com me@x.y 🙂 10.0.0.256 10.0.0.1.2.3.4.5 001.002.0255.4 0300.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4418452524842581  4195224655625070 5",
    "+1 (988) 555-2485 +49 30 1234567890123 +1 23 +12345678 9. +44 20 7946 0958",
    "card 4418452524842581+1 (988) 555-2485@x.y 1.1.1.1@a.b",
    "a" * 20000 + "@" + "b" * 20000 + " " + "1" * 30000 + " " + "1." * 5000 + " +" + "1" * 5000,
    " ".join(f"u{i}@h{i}.org" for i in range(700)),
    "0.0.0.0" * 30,
    "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and GB82WEST12345698765433",
    "my ssn is 123-45-6789; part 123-45-6789 of no list" + " x" * 60 + " part 123-45-6788 of",
    'token = "93f225f22ac4fd8e52991f66d5fe2fb5" password=c7ced47da88d44a3b8 token = short',
]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.createDataFrame(
        [(i, t, "x", "y", "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, t string, found string, f_ip string"
    )
    return {r["doc_id"]: r for r in pii.find_pii(docs).collect()}


def test_base_spans_equal_the_plain_search(rows):
    for i, text in enumerate(TEXTS):
        want = brute(text)
        got = [x for x in rows[i]["spans"].split(",") if x.partition(":")[0] in PATTERNS]
        assert got == want, i
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        for k in PATTERNS:
            assert rows[i][f"n_{k}"] == sum(x.startswith(k) for x in want)


def test_checksums_and_context_add_spans(rows):
    assert rows[11]["n_iban"] == 2
    assert rows[12]["n_ssn"] == 1  # context ends at the match before
    assert rows[13]["n_secret"] == 2
    assert all(0 < f["score"] <= 1.3 for r in rows.values() for f in r["found"])


DE, DE_TIGHT, GB = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
FOLLOWED = [
    (f"IBAN {DE} BIC COBADEFFXXX", [DE]),
    (f"{DE_TIGHT} EUR 50", [DE_TIGHT]),
    (f"IBAN {DE} IBAN {GB} EUR", [DE, GB]),
    (f"{DE_TIGHT} {DE_TIGHT} {GB}", [DE_TIGHT, DE_TIGHT, GB]),
    (f"REF AB12 IBAN {DE} A", [DE]),
    (f"NO9386011117947 SEK, BE68539007547034 BIC X, MT84MALT011000012345MTLCAST001S EUR", ["NO9386011117947", "BE68539007547034", "MT84MALT011000012345MTLCAST001S"]),
    ("DE89 3704 0044 0532 0130 01 BIC COBADEFFXXX", []),
    (f"{DE_TIGHT}X {DE_TIGHT}1", []),
]


def test_account_numbers_with_capitals_behind(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FOLLOWED)], "doc_id long, text string")
    found = {r["doc_id"]: r["found"] for r in pii.find_pii(docs).collect()}
    masked = {r["doc_id"]: r["text"] for r in pii.redact_pii(docs).collect()}
    for i, (text, want) in enumerate(FOLLOWED):
        assert [text[f["s"] : f["e"]] for f in found[i] if f["kind"] == "iban"] == want, i
        assert masked[i].count("[IBAN]") == len(want), i
    assert masked[1] == "[IBAN] EUR 50"


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "x me@x.y or 10.0.0.1, 10.0.0.256 +1 (988) 555-2485.", 9), (2, None, 0)], "doc_id long, text string, __g long")
    out = {r["doc_id"]: r for r in pii.redact_pii(docs).collect()}
    assert out[1]["text"] == "x [EMAIL] or [IP], 10.0.0.256 [PHONE]."
    assert out[2]["text"] is None and out[1]["__g"] == 9


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "me@x.y")] * 2, "doc_id long, text string")
    assert [r["spans"] for r in pii.find_pii(docs).collect()] == ["email:0:6"] * 2
    assert pii.find_pii(docs.where("doc_id < 0")).count() == 0
