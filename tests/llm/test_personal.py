"""Personal data against the base patterns and by hand."""

import hashlib
import random
import re

from seriesloom.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(digits[::2]) % 10 + sum(sum(divmod(2 * v, 10)) for v in digits[1::2]) % 10 in (0, 10)


CHECKS = {
    "email": lambda m: True,
    "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
    "card": lambda m: 14 <= sum(c.isdigit() for c in m) <= 19 and luhn(m),
    "phone": lambda m: 10 <= sum(c.isdigit() for c in m) <= 15,
}


def base(text):
    found = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text, re.ASCII) if CHECKS[k](m.group())]
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_base_spans_are_those_of_the_patterns():
    rng, machine = random.Random(3), personal.anchors()
    parts = ["@", ".", "a", "b.c", "-", "_", "+", " ", "1", "23", "0", "255", "256", "(", ")", "\n", "é", "٣", "🙂", "%40", "x@y.z", "1.2.3.4",
             "4111 1111 1111 1111", "4111111111111111", "+1 (743) 555-3824", "378282246310005", "6011-1111-1111-1117", "[at]", "://", "://["]
    for size in (1, 3, 8, 20, 60):
        for _ in range(1500):
            text = "".join(rng.choice(parts) for _ in range(size))
            got = [s for s in personal.find(text, machine) if s[2] in personal.BASE]
            assert got == base(text), text
    digits = "4" * 300_000 + " x" + "1." * 50_000 + "1" + " " + "a" * 200_000 + "@b.cd" + "+" * 1000 + "(-" * 100_000
    assert [s for s in personal.find(digits, machine) if s[2] in personal.BASE] == [
        s for s in base("1." * 50_000 + "1") for s in [(s[0] + 300_002, s[1] + 300_002, s[2])]
    ] + [(400_004, 600_009, "email")]


def test_added_spans():
    machine = personal.anchors()

    def added(text):
        return [(text[a:b], k) for a, b, k in personal.find(text, machine) if k in personal.ADDED]

    assert added("write to jane.doe [at] example [dot] org now") == [("jane.doe [at] example [dot] org", "hidden_email")]
    assert added("jane(at)mail.example.org, x") == [("jane(at)mail.example.org", "hidden_email")]
    assert added("mailto:jane%40example.org?x") == [("jane%40example.org", "hidden_email")]
    assert added("f(at) x [at] y, 5%40 off") == []
    assert added("ftp://bob:secret@host.example/x http://host:80/@x") == [("bob:secret", "login")]
    assert added("http://[2001:db8::1]:80/ std::vector http://[x]") == [("2001:db8::1", "ip6")]
    assert added("IBAN: DE89 3704 0044 0532 0130 00.") == [("DE89 3704 0044 0532 0130 00", "iban")]
    assert added("IBAN DE89 3704 0044 0532 0130 01, DE89370400440532013000") == []
    assert added("account number: 12345678, accounts 12345678, account 12.345678, acct #123-456-789") == [("12345678", "account"), ("123-456-789", "account")]
    assert added("SSN 078-05-1120, ssn: 000-12-3456, 078-05-1120") == [("078-05-1120", "ssn")]


def test_scan(spark):
    rows = [(1, "a@b.c and +1 (743) 555-3824", "x"), (2, None, "y"), (3, "", None), (None, "9.9.9.9", "z"), (1, "a@b.c", "x"), (4, "clean text, 12 of 345", "q")]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumnRenamed("spans", "n_email")
    got = {(r["doc_id"], r["spans"]): r for r in personal.scan(table).collect()}
    assert len(got) == 6 and personal.scan(table.limit(0)).count() == 0
    assert set(got) == {(1, "email:0:5,phone:10:27"), (2, ""), (3, ""), (None, "ip:0:7"), (1, "email:0:5"), (4, "")}
    one = got[1, "email:0:5,phone:10:27"]
    assert (one["n_email"], one["n_ip"], one["n_card"], one["n_phone"], one["n_added"]) == (1, 0, 0, 1, 0)
    assert one["base_sha256"] == hashlib.sha256(b"email:0:5,phone:10:27").hexdigest()
    assert got[2, ""]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert {r["masked_text"] for r in personal.masked(table).collect()} >= {"<email> and <phone>", "", "<ip>"}


def test_query_on_whole_table(spark, data):
    import __spark_entry__ as entry

    machine = personal.anchors()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = entry.queries()["op11_personal_data"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[2] == k for s in spans) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
        assert set(spans) <= set(personal.find(texts[r["doc_id"]], machine))
