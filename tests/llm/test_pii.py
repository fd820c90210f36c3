import hashlib
import random
import re

from quernstone.llm.pii import pii_digest

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "", re.ASCII) if passes(kind, m[0])]
    base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
    return [sum(s[2] == kind for s in spans) for kind in PLAIN], base, hashlib.sha256(base.encode()).hexdigest()


def texts():
    rng = random.Random(5)
    parts = ["a@b.c", "x_y@d-e.f.g", "@", ".", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "0255.1.2.3", "256.1.1.1", "1.2.3.4.5.6.7.8", "+49 (30) 123-456 78", "é", "𝄞", "\n", "12", "9" * 30, "a.b@c_d@e.f", "%%", "z"]
    yield from (None, "", "no digits", "mail me: joe@ex.org, call +1 (415) 555-0100.", "a@b.c.d" * 3, "1.1.1.1" * 4, "4" * 40, "x@y." * 200, "a" * 50_000 + "@", "1.1.1.1 " * 4000)
    for _ in range(400):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))


def test_base_spans_equal_plain_patterns(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        counts, base, digest = brute(text)
        r = got[i]
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (counts, digest), (text, base, r.spans)
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_added_kinds(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "IBAN DE88 3704 0044 0532 0130 00 no"), (3, "ssn: 123-45-6789"), (4, "code 123-45-6789"), (5, None)]
    got = {r.doc_id: r.spans for r in pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "iban:5:32" in got[1] and "iban" not in got[2] and "ssn:5:16" in got[3] and "ssn" not in got[4] and got[5] == ""


def test_empty_table(spark):
    assert pii_digest(spark.createDataFrame([], "doc_id long, text string, spans string")).collect() == []
