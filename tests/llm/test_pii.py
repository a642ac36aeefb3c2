import hashlib
import re

import pytest

from barquet.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "plain words only", "mail a.b@c.de, or x@y.z_p@q.rs and a@b..c a@b.c..d@e.f", "ip 1.2.3.4.5.6.7.8 999.1.1.1 00010.020.3.255 1.2.3",
    "card 4111 1111 1111 1111 then 4111-1111-1111-1112, 12  34 4111111111111111", "call +49 (30) 901820 or +1 2 or +1-202-555-0100 ext",
    "é😀 x@y.org 😀 +44 20 7946 0958 DE89370400440532013000 GB82 WEST 1234 5698 7654 32", "1" * 3_000, "a" * 3_000 + "@b.c", ("1 " * 20_000) + "@", "x@" + "a." * 20_000,
    " ".join(f"u{k}@h{k}.org" for k in range(1500)), "+" + "1" * 3_000, "1." * 30_000,
]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, TEXTS[4], "clash")]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string, pii string")).collect()
    assert len(got) == len(rows)
    for row in got:
        assert [(x.kind, x.start, x.end) for x in row.pii if x.kind in pii.BASE] == plain(row.text)
    ibans = [x for r in got if r.doc_id == 7 for x in r.pii if x.kind == "iban"]
    assert [TEXTS[7][x.start : x.end] for x in ibans] == ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]


@pytest.mark.parametrize("text, score", [("mail x@y.org", 1.0), ("zzzz x@y.org", 0.9), ("noreply x@y.org", 0.75)])
def test_context_adjusts_the_score(spark, text, score):
    assert [x.score for x in pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().pii] == [score]


def test_query(spark, sf_dir):
    got = pii.op4(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.BASE]


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_runs_take_linear_time(spark):
    rows = [(1, "1" * 2_000_000), (2, "a" * 2_000_000), (3, "1." * 500_000), (4, "a@b." * 100_000), (5, "x.y@z.org " * 20_000)]
    got = {r.doc_id: r.n for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("doc_id", "size(pii) n").collect()}
    assert got[1] == got[2] == 0 and got[5] == 20_000
