"""Text normalisation and text patterns as column functions.

Patterns carry ``(?U)`` so that digits, spaces and word signs are Unicode
ones.  Their order in `normalize` matters: an e-mail address is met only after
handles have been replaced, and amounts before ages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from modlark.config import BRAND_TERMS, ORDER_TERMS, STORE_TERMS

# Patterns of entities.
PHONE = r"(?:\+\d{1,3})?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{2}[-.\s]?\d{2}"
LONG_PHONE = r"\+\d{10,15}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
AGE = r"(?:от\s+)?\d{2}\+|(?:от\s+)?\d{2}\s*(?:лет|года?)"
HANDLE = r"@[a-zA-Z0-9_]{3,}"
URL = r"https?://[^\s]+|www\.[^\s]+"
CHANNEL = r"t\.me/[a-zA-Z0-9_]+"
_AMOUNTS = (r"\d+\s*(?:руб(?:л(?:ей|я|ь)?)?|р\.?|₽)", r"(?:\$|USD|usd)\s*\d+", r"\d+\s*(?:\$|USD|usd)", r"\d+\s*(?:к|тыс\.?|тысяч)")
# Those of amounts have a digit, the last one in either list names currencies.
MONEY = (*_AMOUNTS, r"\d+\s*(?:%|процент)", r"(?:доллар|евро|usdt|btc|bitcoin|eth|ethereum)")
ENCODER_MONEY = (*_AMOUNTS, r"\d+\s*%", r"(?:доллар|евро|usdt|btc|bitcoin|ethereum)")
COUNTED_MONEY = r"\d+\s*(?:руб|р\.?|₽|\$|usd|к|тыс|евро|usdt|btc|%)"
# Patterns of wording, searched in lower-cased text.
CALL = (r"пиш[иу](?:те)?\s+[+«\"']?\+", r"жми\s+(?:на\s+)?[+«\"']", r"старт", r"пиш[иу](?:те)?\s+в\s+(?:лс|личку)")
DIRECT = r"\b(?:лс|личк[аеу]|в\s+личные)\b"
REMOTE = r"удал[её]нк|удал[её]нн|дистанц"
LEGAL = (r"легальн", r"честн", r"без\s+риск", r"без\s+вложен", r"не\s+нарко", r"не\s+мошен")
CASINO = (r"казино|казик", r"фриспин", r"ставк[аи]", r"rtp", r"букмекер", r"слот", r"выигр")
_MIXED = ("[а-яА-ЯёЁ]", "[a-zA-Z]", r"[а-яА-ЯёЁa-zA-Z]+\d+[а-яА-ЯёЁa-zA-Z]+")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@lru_cache(maxsize=1)
def composable() -> str:
    """A pattern of what composition may change: any character but those of the
    long runs, of Latin, Greek, Cyrillic and of signs, that stay as they are and
    compose with none before them, by the Unicode data."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    seconds = {int(p[1], 16) for p in parts if len(p) == 2 and not p[0].startswith("<")}
    stays = lambda c: unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and c not in seconds and unicodedata.category(chr(c)) != "Cn"
    ranges = []
    for low, high, least in ((0, 0xA0, 16), (0xA0, 0xC0, 1), (0xC0, 0x530, 16), (0x2010, 0x2040, 3), (0x20A9, 0x20C0, 16), (0x2600, 0x2700, 16), (0x1F300, 0x1F650, 16)):
        run = []
        for c in range(low, high + 1):
            if c < high and stays(c):
                run.append(c)
            else:
                ranges += [rf"\x{{{run[0]:x}}}-\x{{{run[-1]:x}}}"] if len(run) >= least else []
                run = []
    return "[^" + "".join(ranges) + "]"


def nfkc(text: Column) -> Column:
    """Compatibility composition.  All rows cross to a Python worker, but those
    without a `composable` character, as most Russian and English texts, as nulls."""
    return F.coalesce(_nfkc(F.when(text.rlike(composable()), text)), text)


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def effective_text(text: Column, caption: Column) -> Column:
    """The text, or else the caption, stripped; never null."""
    return strip(F.coalesce(F.nullif(text, F.lit("")), caption, F.lit("")))


def _tagged(text: Column, money: Sequence[str], compose: bool) -> Column:
    """Every entity but currencies' names has a digit, an ``@`` or an address in
    it; texts without any, told in one pass, skip the other patterns."""
    given = nfkc(text) if compose else text
    named = "(?iU)" + "|".join(m for m in money if "\\d" not in m)
    out = F.regexp_replace(given, "(?iU)" + URL, "<URL>")
    out = F.regexp_replace(out, "(?iU)" + CHANNEL, "<TG>")
    out = F.regexp_replace(out, HANDLE, "<TG>")
    out = F.regexp_replace(out, "(?U)" + PHONE, "<PHONE>")
    out = F.regexp_replace(out, "(?U)" + LONG_PHONE, "<PHONE>")
    out = F.regexp_replace(out, "(?iU)" + EMAIL, "<EMAIL>")
    for pattern in (m for m in money if "\\d" in m):
        out = F.regexp_replace(out, "(?iU)" + pattern, "<MONEY>")
    out = F.regexp_replace(F.regexp_replace(out, named, "<MONEY>"), "(?iU)" + AGE, "<AGE>")
    some = given.rlike(r"(?iU)[@\d]|://|www\.|t\.me/")
    return strip(F.regexp_replace(F.when(some, out).otherwise(F.regexp_replace(given, named, "<MONEY>")), r"(?U)\s+", " "))


def normalize(text: Column, compose: bool = True) -> Column:
    """Text with entities replaced by tags; ``compose=False`` leaves out the
    step in Python, for texts known to be composed."""
    return _tagged(text, MONEY, compose)


def message_capsule(text: Column, compose: bool = True) -> Column:
    return F.concat(F.lit("passage: "), normalize(text, compose))


def encoder_text(text: Column, compose: bool = True) -> Column:
    """What a text encoder is given; its list of amounts is another one."""
    return F.concat(F.lit("passage: "), _tagged(text, ENCODER_MONEY, compose))


def _any(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("(?U)" + "|".join(patterns))


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur in a lower-cased text."""
    held = [F.contains(text, F.lit(t.lower())).cast("int") for t in dict.fromkeys(terms)]
    return reduce(lambda n, x: n + x, held) if held else F.lit(0)  # no function over an array: that would lower the text once for each term


def obfuscation_ratio(text: Column) -> Column:
    """Share of words that mix scripts or hide digits between letters.

    Words are looked at one by one only in texts that hold as much as a whole."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), F.lit(0))
    mixed = lambda w: (w.rlike(_MIXED[0]) & w.rlike(_MIXED[1])) | w.rlike("(?U)" + _MIXED[2])
    odd = F.when(mixed(text), F.size(F.filter(words, mixed))).otherwise(0)
    return F.when(text.isNotNull(), odd / F.greatest(F.size(words), F.lit(1)))


def patterns(text: Column, store: Sequence[str] = STORE_TERMS, order: Sequence[str] = ORDER_TERMS, brand: Sequence[str] = BRAND_TERMS) -> dict[str, Column]:
    """The pattern features of a raw text, by name (null text: as if empty)."""
    text = F.coalesce(text, F.lit(""))
    lower = F.lower(text)
    phone, url = text.rlike(r"(?U)\d") & text.rlike(f"(?U){PHONE}|{LONG_PHONE}"), text.rlike(r"(?i)https?://|www\.")
    email = F.contains(text, F.lit("@")) & text.rlike("(?i)" + EMAIL)
    money = F.regexp_count(lower, F.lit("(?U)" + COUNTED_MONEY))
    return {
        "has_phone": phone, "has_url": url, "has_email": email, "has_money": money > 0, "money_count": money, "has_age": lower.rlike("(?U)" + AGE), "has_cta_plus": _any(lower, CALL),
        "has_dm": lower.rlike("(?U)" + DIRECT), "has_contact": url | phone | email | text.rlike(rf"t\.me/|{HANDLE}"), "has_remote": lower.rlike(REMOTE), "has_legal": _any(lower, LEGAL), "has_casino": _any(lower, CASINO),
        "obfuscation_ratio": obfuscation_ratio(text), "whitelist_hits_store": term_hits(lower, store), "whitelist_hits_order": term_hits(lower, order), "whitelist_hits_brand": term_hits(lower, brand),
    }


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def message_link(username: Column, chat_id: Column, message_id: Column) -> Column:
    """A link to a message, by the chat's name or else its number."""
    named = F.concat(F.lit("https://t.me/"), username, F.lit("/"), message_id.cast("string"))
    return F.when(username.isNotNull() & (username != ""), named).otherwise(F.concat(F.lit("https://t.me/c/"), F.abs(chat_id).cast("string"), F.lit("/"), message_id.cast("string")))
