import hashlib
import re

from hypothesis import given, settings, strategies as st

from dailybars.llm import personal_data as pd_

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, s):
    d = [int(c) for c in s if c.isdigit()]
    luhn = sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d[::-1])) % 10 == 0
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn, "phone": lambda: 9 <= len(d) <= 15}[kind]()


def plainly(text):
    return [(k, *m.span()) for k in PLAIN for m in re.finditer(PLAIN[k], text) if holds(k, m[0])]


@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "x-y", "é", " ", "+", "4111 1111-1111 1111", "4111111111111111", "127.0.0.1", "1.2.3", "300.1.1.1", "7", "-", "(", "0049 30", "55512345", "%", "_"]), max_size=25))
@settings(max_examples=500, deadline=None)
def test_base_spans(parts):
    text = "".join(parts)
    assert pd_.base_spans(text) == plainly(text)


def test_method_and_redaction():
    text = "iban DE89 3704 0044 0532 0130 00, my ssn is 123-45-6789; order 987-65-4321 mail bob@x.org"
    base, added = pd_.spans(text)
    assert [s[0] for s in base] == ["email"] and [s[0] for s in added] == ["iban", "national"]
    assert pd_.redact(text) == "iban [iban], my ssn is [national]; order 987-65-4321 mail [email]"
    assert pd_.spans("iban DE89 3704 0044 0532 0130 01")[1] == []
    assert pd_.spans("a" * 300_000 + "1" * 300_000 + "." * 1000)[0] == []


def test_rows(spark):
    rows = [(1, "x@y.zz and 10.0.0.1", "k"), (1, "x@y.zz and 10.0.0.1", "k"), (2, None, "k"), (None, "", "k"), (3, "tel +49 30 1234567", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_phone"], r["spans"], r["base_sha256"]) for r in pd_.report(docs).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    a = ("1", 1, 1, 0, "email:0:6,ip:11:19", sha("email:0:6,ip:11:19"))
    assert got == sorted([a, a, ("2", 0, 0, 0, "", sha("")), ("None", 0, 0, 0, "", sha("")), ("3", 0, 0, 1, "phone:4:18", sha("phone:4:18"))])
    assert pd_.report(docs.limit(0)).count() == 0
    assert {r["text"] for r in pd_.redacted(docs).collect()} == {"[email] and [ip]", None, "", "tel [phone]"}


def test_ibans_before_capitals_and_digits():
    for iban, after in (("DE89370400440532013000", " BIC COBADEFFXXX"), ("DE89 3704 0044 0532 0130 00", " PAYMENT DUE"), ("GB82WEST12345698765432", " 12 May"), ("GB82 WEST 1234 5698 7654 32", " A"),
                        ("NO9386011117947", " 2024 PAID IN FULL"), ("FR1420041010050500013M02606", ", 7"), ("MT84MALT011000012345MTLCAST001S", " Xy"), ("DE89370400440532013000", "")):
        assert pd_.spans(f"to {iban}{after}")[1] == [("iban", 3, 3 + len(iban))]
        assert pd_.redact(f"to {iban}{after}") == f"to [iban]{after}"
    assert pd_.spans("DE89370400440532013000BIC X")[1] == [] and pd_.spans("DE89370400440532013001 BIC")[1] == []
    two = "XX11 ABCD EFGH IJKL DE89370400440532013000 GB82WEST12345698765432 OK"
    assert [two[a:b] for _, a, b in pd_.spans(two)[1]] == ["DE89370400440532013000", "GB82WEST12345698765432"]
    assert pd_.spans("A1 " * 100_000 + "AB12" * 100_000)[1] == []
