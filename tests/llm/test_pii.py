from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from modlark.llm import pii
from modlark.llm.pii_examples import parsed

#: Lines of other wording than those that the trees learn from, labelled by hand.
HELD_OUT = """
For questions write to «email|sophie.braun (at) firma dot de»
his mailbox is «email|k.miller at university dot edu» since May
«email|support[at]widget-shop.com» answers within a day
please mail «email|ole(at)fjord.no» about the boat
address: «email|t.rex [at] museum [dot] org»
send your CV to «email|jobs at startup dot io» today
write «email|info (at) verein.ch»
Call me at «phone|212-555-0187» tomorrow
Telefon «phone|089 1234567» ab neun Uhr
my phone is «phone|(415) 555-0132»
fax: «phone|0049 89 7654321»
you can text «phone|07911 123456»
mobile: «phone|0176-55501234»
tel «phone|555.867.5309» ask for Jenny
Tél: «phone|01 42 68 53 00»
ring «phone|0161 496 0000» before five
hotline: «phone|0800 555 111»
WhatsApp: «phone|01701234567»
paid by card «card|4111.1111.1111.1111» in May
Visa: «card|4012/8888/8888/1881»
american express «card|3782-822463-10005» please
my credit card «card|5500 0000  0000 0004» was stolen
Kreditkarte «card|4111_1111_1111_1111»
login from «ip|2001:db8:85a3::8a2e:370:7334» failed
the host «ip|fe80::1ff:fe23:4567:890a» is up
traffic to «ip|203[.]0[.]113[.]77» was blocked
bad actor at «ip|198(.)51(.)100(.)23»
ping «ip|10 . 0 . 0 . 138»
we shall meet at the corner dot by dot
have a look at wikipedia.org for it
3 @ 4.99 is a fair price
the score was 3-2 after 90 minutes
invoice 20240117-3345 is due
between 1914 and 1918 and 1939-1945
ISBN 978-3-16-148410-0 costs 12.50
version 10.15.7.2 of the system
it started at 12:45:30 and ended at 13:00:00
the mac is 00:1b:44:11:3a:b7
std::vector and std::map
the ratio is 16:9:1
order 302-1234567-7654321 was returned
pages 123-145 and 200-210
in total 12 500 000 people
on 24.12.2023 and 2023-12-24
row 12 34 56 78 90 11
serial 1234-5678-9012 in stock
GPS 48.858222 2.294500
timestamp 1700000000
ticket 88123-4
10 000 km in 12.5 hours
room 12-104 and room 12-105
chapter 2.4.1.7 (8)
""".strip().split("\n")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    """The contract read literally."""
    t, digits = text or "", lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def written(spans):
    return ",".join(":".join(map(str, s)) for s in spans)


def digest(row, text):
    spans = base(text)
    assert row.base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest(), text[:200]
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
    told = [tuple(s.split(":")) for s in row.spans.split(",") if s]
    assert {tuple(map(str, s)) for s in spans} <= set(told) and len(told) == len(spans) + row.n_added
    order = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in told]
    assert order == sorted(order)
    return told


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(pii.labelled_lines(spark))


def made_texts():
    r, out = random.Random(3), []
    bits = ["a.b", "@", "x.org", "1.2.3.4", "255", "256", ".", "-", " ", "+1 (555) 123-4567", "4111 1111 1111 1111", "0", "12", "+", "\n", "é", "😀", "::", "at", " dot ", "[.]", "4111111111111111", "5555-5555-5555-4444", "007", "_", "%"]
    for n in range(1500):
        out.append("".join(r.choice(bits) for _ in range(r.randint(1, 14))))
    return out


def test_base_spans_equal_brute_force(spark, model):
    texts = made_texts() + ["a@b.c_d@e.f", "a@b.c@d.e.f", "x 1.2.3.4.5.6.7.8 y", "00255.1.1.0 1.1.1.00256", "4111 1111 1111 1111 " * 3, "+1234567 +12345678 +1 2 3", "++49 30 1234567)", "😀 mail é@x.y a@b.cd 😀 1.1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.personal_data(df, model).collect():
        digest(row, texts[row.doc_id])


def test_documents(spark, documents, model):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    found = pii.personal_data(documents, model).collect()
    assert len(found) == documents.count()
    for row in found:
        digest(row, texts[row.doc_id])
    assert sum(r.n_added for r in found) <= 0.01 * len(found)  # these hold well-formed data only


def test_odd_rows(spark, odd, empty, model):
    found = pii.personal_data(odd, model).collect()
    assert sorted((r.doc_id or 0, r.spans) for r in found) == sorted((r.doc_id or 0, "") for r in odd.collect())
    assert pii.personal_data(empty, model).count() == 0 and pii.redact(empty, model).count() == 0
    back = pii.redact(odd, model)
    assert back.columns == odd.columns and sorted(back.collect(), key=repr) == sorted(odd.collect(), key=repr)


def test_held_out_lines(spark, model):
    rows = []
    for i, line in enumerate(HELD_OUT):
        before, value, after, kind = parsed(line)
        rows.append((i, before + value + after, kind, len(before), len(before + value)))
    told = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()}
    hits = sum(f"{kind}:{a}:{b}" in told[i].split(",") for i, _, kind, a, b in rows if kind)
    wrong = sum(s != f"{kind}:{a}:{b}" for i, _, kind, a, b in rows for s in told[i].split(",") if s)
    there = sum(bool(r[2]) for r in rows)
    assert hits >= 0.85 * there, (hits, there, [(r[1], told[r[0]]) for r in rows if r[2] and told[r[0]] != f"{r[2]}:{r[3]}:{r[4]}"])
    assert hits >= 0.9 * (hits + wrong), [(r[1], told[r[0]]) for r in rows if told[r[0]] and told[r[0]] != f"{r[2]}:{r[3]}:{r[4]}"]


@pytest.mark.parametrize("piece", ["1", "a", "1 ", "1.1.", "a@", "+1(", ":1", "a.b@c.de ", "4111111111111111 ", "a at b dot ", "(1) ", "+1 234 567 89, "])
def test_long_texts_take_linear_time(spark, model, piece):
    """The literal patterns take quadratic time, so they are held against short texts alone."""
    short, long = piece * 300, piece * (400_000 // len(piece))
    df = spark.createDataFrame([(0, short), (1, long)], "doc_id long, text string")
    began = time.time()
    few, many = sorted(pii.personal_data(df, model).collect(), key=lambda r: r.doc_id)
    assert time.time() - began < 40
    digest(few, short)
    for k in pii.KINDS:
        assert abs(many[f"n_{k}"] * len(short) - few[f"n_{k}"] * len(long)) <= len(long) * 2


def test_redaction(spark, model):
    rows = [(1, "é a@b.cd, +1 (555) 123-4567😀 and u@1.2.3.4 end", "k"), (2, None, None), (3, "nothing", "k"), (4, "mail bob.may (at) acme dot com now", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    found = {r.doc_id: (r.text, r.row) for r in pii.redact(df, model).collect()}
    assert found == {1: ("é [EMAIL], [PHONE]😀 and [EMAIL] end", "k"), 2: (None, None), 3: ("nothing", "k"), 4: ("mail [EMAIL] now", "k")}


def settled(spans):
    held, base, out = None, 0, []
    for x in sorted(spans):
        if x[2] > 1:
            if held and held[1] <= x[0]:
                out.append(held)
            held, base = None, max(base, x[1])
        elif x[0] >= base:
            if held and held[1] > x[0]:
                held = x if (x[2], x[1] - x[0]) > (held[2], held[1] - held[0]) else held
            else:
                out, held = out + [held] * bool(held), x
    return out + [held] * bool(held)


def test_overlaps_are_settled(spark, monkeypatch):
    monkeypatch.setattr(pii, "STEP", 3)
    r = random.Random(8)
    cases = []
    for _ in range(300):
        spans = []
        for _ in range(r.randint(0, 14)):
            a = r.randint(0, 60)
            spans.append((a, a + r.randint(1, 12), r.choice((2.0, 0.5, 0.7, 0.9)), r.choice(pii.KINDS)))
        cases.append((spans,))
    df = spark.createDataFrame(cases, f"s array<{pii.SPAN}>")
    out = df.select("s", pii._fold(F.array_sort("s"), pii._settled).alias("t")).collect()
    for row in out:
        assert [tuple(x) for x in row.t] == settled([tuple(x) for x in row.s])
        assert all(a[1] <= b[0] for a, b in zip(row.t, row.t[1:]))


def test_plan_has_no_python(spark, documents, model):
    plan = pii.personal_data(documents, model)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|ExistingRDD", plan)


def test_features_and_thresholds_decide(spark, model):
    """Words around a number decide, and so does a threshold."""
    df = spark.createDataFrame([(1, "phone 0176 5550123"), (2, "order 0176 5550123")], "doc_id long, text string")
    assert [r.n_added for r in pii.personal_data(df, model).orderBy("doc_id").collect()] == [1, 0]
    none = pii.Model(model.boosted, dict.fromkeys(model.thresholds, 1.5))
    assert {r.n_added for r in pii.personal_data(df, none).collect()} == {0}


def test_fit_without_personal_data(spark):
    lines = pii.labelled_lines(spark, 2).withColumn("kind", F.lit(None).cast("string"))
    assert pii.fit(lines).thresholds == {}
