import hashlib
import random
import re

from seqlab.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The base spans as the patterns themselves state them."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c.isdigit())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_same_as_plain_patterns():
    rng = random.Random(3)
    for letters in ("a@.-b1 é", "0123456789. -", "+1(2)3. 4-5@a", "1.2.30.255.256 "):
        for _ in range(4000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
            base = [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE]
            assert base == plain(text), text


def test_checks_and_context():
    text = "my IBAN is DE89 3704 0044 0532 0130 00, not DE88370400440532013000; ssn 123-45-6789"
    found = pii.spans_of(text)
    assert [s[0] for s in found] == ["iban", "ssn"]
    assert [s[3] for s in found] == [1.0, 0.7]
    assert pii.spans_of("number 123-45-6789") == []
    (card,) = pii.spans_of("order 4111 1111 1111 1111")
    assert card == ("card", 6, 25, 0.5)


def test_context_after_the_span():
    for text in ("123-45-6789 (SSN)", "123-45-6789 is my social security number", "ssn 123-45-6789"):
        ((kind, start, end, score),) = pii.spans_of(text)
        assert (kind, text[start:end], score) == ("ssn", "123-45-6789", 0.7)
    assert pii.spans_of("123-45-6789 (SSN), order 7") == []
    assert pii.spans_of("123-45-6789" + " -" * 24 + " ssn") == []
    assert pii.spans_of("10.0.0.1 is the version") == [("ip", 0, 8, 0.3)]


def test_account_number_before_more_groups():
    for account in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "XX57123456789012345"):
        assert pii.mod97(account.replace(" ", ""))
        for after in ("", " Please pay", " BIC COBADEFF", " 2024-01-01", " 1234", " EUR 500", " IBAN", ", x", " A é", " 7 " * 40):
            for before in ("", "IBAN ", "AB12 ", "Konto: "):
                spans = [s[:3] for s in pii.spans_of(before + account + after) if s[0] == "iban"]
                assert spans == [("iban", len(before), len(before + account))], before + account + after
    assert pii.spans_of("DE88370400440532013000 Please pay") == []
    two = "DE89370400440532013000 DE89370400440532013000"
    assert [s[1:3] for s in pii.spans_of(two) if s[0] == "iban"] == [(0, 22), (23, 45)]
    assert [s for s in pii.spans_of("AA11 " * 60_000 + "AA11" + "A" * 300_000) if s[0] != "iban"] == []


def test_linear_on_long_runs():
    assert pii.spans_of("a" * 300_000 + "@" * 1000 + "1" * 300_000 + "+1" + "(" * 300_000) == []


def test_rows(spark):
    rows = [(1, "é a@b.co 10.0.0.1", "x"), (1, "é a@b.co 10.0.0.1", "x"), (2, None, None), (None, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find(docs).select("doc_id", pii.as_text(pii.F.col("spans")).alias("t")).collect()
    assert sorted((r.doc_id or 0, r.t) for r in got) == [
        (0, ""), (1, "email:2:8,ip:9:17"), (1, "email:2:8,ip:9:17"), (2, ""),
    ]
    assert pii.find(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_query(spark):
    from seqlab.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op3_pii"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        spans = plain(docs[r.doc_id] or "")
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        counts = [sum(k == kind for k, _, _ in spans) for kind in pii.BASE]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
    assert sum(r.n_card for r in got) > 0
