"""Text functions on hand-written strings, against a plain-Python reading of their rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from modlark.functions import text as T

CASES = [
    ("см. https://a.example/x и www.b.example", "см. <URL> и <URL>"),
    ("t.me/abc_1 и @abc, но @ab", "<TG> и <TG>, но @ab"),
    ("user@gmail.com", "user<TG>.com"),
    ("a@ya.ru", "<EMAIL>"),
    ("+7(912)345-67-89", "<PHONE>"),
    ("+123456789012345", "<PHONE>45"),
    ("5 коробок", "<MONEY>оробок"),
    ("20 процентов", "<MONEY>ов"),
    ("method ETHEREUM", "m<MONEY>od <MONEY>EREUM"),
    ("18+ и от 21 лет, от 18", "<AGE> и <AGE>, от 18"),
    ("  a   b\n\tc ", "a b c"),
    ("ﬁ ５", "fi 5"),
    ("", ""),
]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, expected", CASES)
def test_normalize(spark, raw, expected):
    assert one(spark, raw, T.normalize(F.col("t"))) == expected


def test_encoder_text_has_other_amounts(spark):
    assert one(spark, "20 процентов eth 5 %", T.encoder_text(F.col("t"))) == "passage: 20 процентов eth <MONEY>"


def test_null_stays_null(spark):
    assert one(spark, None, T.normalize(F.col("t"))) is None


@pytest.mark.parametrize("text, caption, expected", [("a", "b", "a"), ("", "b ", "b"), (None, " b", "b"), (None, None, ""), ("   ", "b", "")])
def test_effective_text(spark, text, caption, expected):
    df = spark.createDataFrame([(text, caption)], "text string, caption string")
    assert df.select(T.effective_text(F.col("text"), F.col("caption")).alias("x")).first()["x"] == expected


def test_patterns(spark):
    p = T.patterns(F.col("t"))
    row = lambda t: spark.createDataFrame([(t,)], "t string").select(*(c.alias(k) for k, c in p.items())).first()
    a = row("Доставка: 500 руб, 10%. Пиши в ЛС или личку")
    assert a.has_casino and a.has_money and a.money_count == 2 and a.has_dm and a.has_cta_plus and not a.has_phone
    assert not row("лсд").has_dm
    assert row("зaрабoтoк 3aмена а1б").obfuscation_ratio == 1.0 or row("зaрабoтoк 3aмена а1б").obfuscation_ratio > 0.6
    empty = row(None)
    assert empty.obfuscation_ratio == 0 and not empty.has_url and empty.money_count == 0
    assert row("магазин ACMESHOP меню").whitelist_hits_brand == 1


def test_links(spark):
    df = spark.createDataFrame([(None, -100, 5), ("name", 1, 6)], "u string, c long, m long")
    assert [r.x for r in df.select(T.message_link(F.col("u"), F.col("c"), F.col("m")).alias("x")).collect()] == ["https://t.me/c/100/5", "https://t.me/name/6"]


def test_what_is_not_sent_is_not_composed():
    """No text without a composable character changes: each character alone and after each other."""
    import re
    import unicodedata

    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U" + m[1].zfill(8), T.composable()))
    kept = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not pattern.search(chr(c))]
    assert len(kept) > 900 and set("абвгдёжйяЯЁ«»—“”₽…é".replace("…", "")) <= set(kept) and "…" not in kept
    assert all(unicodedata.normalize("NFKC", a + "".join(kept)) == a + "".join(kept) for a in kept)
    assert all(unicodedata.normalize("NFKC", "".join(b + a for b in kept)) == "".join(b + a for b in kept) for a in kept)


def test_pattern_features_lower_a_text_once_and_are_the_same(spark):
    """Gated features equal the plain ones, and no text is lowered once for each term."""
    texts = ["", "a1б слово Word", "cа1t мир", "x1y 22 z3", "e\u0301a\u0301 \u0301b a\u200db", "İ1b ٣a٤b a٣b", "me@site.org +7(912)345-67-89 магазин меню acmeshop", "нет_1да ёЁ", "日本 1a2b", "+79123456789", "a@b", "٠٩١٢٣٤٥٦٧٨٩", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    words = F.regexp_extract_all("t", F.lit(r"(?U)\b\w+\b"), F.lit(0))
    odd = F.filter(words, lambda w: (w.rlike("[а-яА-ЯёЁ]") & w.rlike("[a-zA-Z]")) | w.rlike(r"(?U)[а-яА-ЯёЁa-zA-Z]+\d+[а-яА-ЯёЁa-zA-Z]+"))
    full = F.coalesce("t", F.lit(""))
    plain = (F.size(odd) / F.greatest(F.size(words), F.lit(1)), full.rlike(f"(?U){T.PHONE}|{T.LONG_PHONE}"), full.rlike("(?i)" + T.EMAIL))
    found = T.patterns(F.col("t"))
    rows = df.select(T.obfuscation_ratio(F.col("t")), *plain, *(found[c] for c in ("has_phone", "has_email"))).collect()
    assert all(r[0] == r[1] and r[2] == r[4] and r[3] == r[5] for r in rows) and sum(bool(r[0]) for r in rows) >= 4
    hits = df.select(T.term_hits(F.lower("t"), ("магазин", "меню", "acme", "меню")).alias("n"))
    assert hits.collect()[6].n == 3 and "aggregate(" not in hits._jdf.queryExecution().executedPlan().toString()
