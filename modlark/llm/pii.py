"""Personal data in texts: generators, boosted trees and calibrated thresholds.

Well-formed addresses and numbers are found by fixed patterns.  Wide patterns
propose what might be others, e.g. ``name (at) host dot com``, numbers without
``+`` and IPv6 addresses; these spans may overlap.  Gradient boosted trees
score each from its form and from the words around it, and it counts if its
score reaches the threshold of its generator.  The thresholds are calibrated
on labelled lines that the trees haven't seen.  The trees are constants of an
SQL expression: a scan is a projection of the documents, with no Python on
the executors and no shuffle.

The patterns can't backtrack far: runs are possessive and start where runs
start, so long texts of any kind take linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modlark.llm import trees
from modlark.llm.pii_examples import LINES, NAMES, parsed
from modlark.llm.scratch import Scratch
from modlark.llm.trees import once

KINDS = ("email", "ip", "card", "phone")
# Well-formed personal data.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text has that a pattern can match: cheap, and tried first.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "spelled": r"(?i)[@(\[{<\s]at[)\]}>\s]|@", "defanged": r"[0-9]\s?[\[({.]", "colons": ":[0-9A-Fa-f]{0,4}:", "loose_card": "[0-9]", "loose_phone": "[0-9]"}
_AT, _DOT = r"(?:\s{0,2}(?:\(at\)|\[at\]|\{at\}|<at>|\(@\)|\[@\])\s{0,2}|\s{1,2}(?:at|@)\s{1,2}|@)", r"(?:\s{0,2}(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\[\.\]|\(\.\))\s{0,2}|\s{1,2}(?:dot|punkt|punto|point)\s{1,2}|\.)"
#: Generators: the kind that each proposes, and its pattern.
GENERATORS = {
    "spelled": ("email", rf"(?i)(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]{{1,64}}+{_AT}[\p{{L}}\p{{N}}-]{{1,63}}+(?:{_DOT}[\p{{L}}\p{{N}}-]{{1,63}}+){{1,5}}+"),
    "defanged": ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)|\.)\s?[0-9]{1,3}){3}(?![0-9])"),
    "colons": ("ip", r"(?<![0-9A-Za-z:])(?=:{0,2}[0-9A-Fa-f])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])"),
    "loose_card": ("card", r"(?<![0-9])[0-9](?:[\s._/ ·‐-―-]{0,3}[0-9]){12,18}+(?![0-9])"),
    "loose_phone": ("phone", r"(?<![0-9A-Za-z.+-])(?:\(?[0-9]{1,5}\)?(?:[\x20 ./-]{1,3}\(?[0-9]{1,8}\)?){1,6}+|[0-9]{7,14}+)(?![0-9])"),
}
#: Four numbers up to 255, without leading zeros.
OCTETS = r"^[^0-9]*(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:[^0-9]+|$)){4}$"
PHONE_WORDS = "tel|phone|telephone|mobile|cell|call|fax|ring|dial|whatsapp|sms|text me|number|telefon|handy|mobil|rufen|rufnummer|tél|téléphone|portable|appel\\w*|teléfono|móvil|llam\\w+|contact|hotline|reach"
CARD_WORDS = "card|visa|mastercard|amex|american express|credit|debit|cc|karte|kreditkarte|carte|tarjeta|diners|pay|paid"
IP_WORDS = "ip|ipv4|ipv6|host|server|address|addr|gateway|ping|dns|node|router|route|client|login|from|adresse|serveur|ssh|subnet|proxy|blocked|traffic"
MAIL_WORDS = "mail|email|mailbox|contact|write|reach|address|send|correo|courriel|schreib\\w*|kontakt|adresse|mailto|ask|inbox"
PLAIN_WORDS = (
    "order|isbn|issn|ean|invoice|version|build|pages?|figure|id|uuid|serial|tracking|sku|part|section|chapter|ref|date|time|ratio|population|scores?|sets|room|model|lot|batch|ticket|case|item|parcel|psalm|verse|account|iban|ssn|mac|fingerprint"
    "|timestamp|since|years?|between|bestell\\w*|rechnung|seiten?|commande|facture|pedido|factura|table|values|points|range|sum|article|distance|look\\w*|codes?|licen[cs]e|record|log|sample|gps|numbers"
)
TLDS = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu|ch|at|us|ca|biz|dev|app|me|pl|se|no|dk|be|pt|br|mx|jp|in|au"
UNITS = "%|km|m|kg|g|eur|euros?|usd|dollars?|€|years?|pages?|people|percent|hours?|seconds|cups|a piece"
FEATURES = (
    *GENERATORS, "length", "digits", "letters", "signs", "groups", "longest", "first", "last", "bracketed", "dot_word", "tld", "luhn", "octets", "hex_letters", "double_colon", "wide_groups", "leading_zero", "paren", "date", "thousands", "kinds_of_signs",
    "phone_words", "card_words", "ip_words", "mail_words", "plain_words", "colon_before", "glued_before", "glued_after", "unit_after",
)
ROUNDS, DEPTH = 30, 4
#: Share of personal data among the held-out candidates above a threshold.
PRECISION = 0.9
#: Copies of each labelled line with other digits and names.
COPIES = 20
STEP = 128
SPAN = "struct<start:bigint,end:bigint,score:double,kind:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def located(text: Column, pattern: str, hint: str) -> Column:
    """The matches of a pattern: ``value``, ``start`` and ``end`` (code points,
    end exclusive), and the text before and after, as far as the next match but one."""
    total = lambda sizes: F.aggregate(sizes, F.lit(0).cast("long"), lambda n, x: n + x)

    def place(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        rows = F.arrays_zip(found.alias("v"), F.slice(gaps, 1, F.size(found)).alias("b"), F.slice(gaps, 2, F.size(found)).alias("a"))
        sizes = F.transform(rows, lambda x: (F.length(x["b"]) + F.length(x["v"])).cast("long"))
        return once(rows, lambda rows: once(sizes, lambda sizes: once(_sums(sizes), lambda sums: F.transform(rows, lambda x, i: struct(rows, x, i, end(sizes, sums, i))))))

    def _sums(sizes: Column) -> Column:  # of blocks: running sums stay short where a text has very many matches
        return F.transform(F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(STEP)), lambda at: total(F.slice(sizes, at + 1, F.lit(STEP))))

    def end(sizes: Column, sums: Column, i: Column) -> Column:
        return total(F.slice(sums, F.lit(1), F.floor(i / STEP).cast("int"))) + total(F.slice(sizes, i - i % STEP + 1, i % STEP + 1))

    def struct(rows: Column, x: Column, i: Column, end: Column) -> Column:
        lead = F.concat(F.when(i > 0, rows[F.greatest(i - 1, F.lit(0))]["v"]).otherwise(F.lit("")), x["b"])
        return F.struct(x["v"].alias("value"), (end - F.length(x["v"])).alias("start"), end.alias("end"), F.right(lead, F.lit(40)).alias("before"), F.left(x["a"], F.lit(20)).alias("after"))

    found = F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return once(found, lambda found: F.when(F.size(found) > 0, place(found)))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])?){3}$")
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Well-formed data of a kind, as `located` has them; null where there are none."""
    return F.filter(located(text, BASE[kind], HINTS[kind]), lambda x: _valid(kind, x["value"]))


def proposals(text: Column) -> Column:
    """What all generators propose, with the generator's name as ``by``."""
    none = F.array().cast("array<struct<value:string,start:bigint,end:bigint,before:string,after:string>>")

    def named(by: str) -> Column:
        found = F.coalesce(located(text, GENERATORS[by][1], HINTS[by]), none)
        if by == "loose_card":
            found = F.filter(found, lambda x: _luhn(_digits(x["value"])))
        if by == "defanged":
            found = F.filter(found, lambda x: x["value"].rlike(OCTETS) & x["value"].rlike(r"[^0-9.]"))
        return F.transform(found, lambda x: x.withField("by", F.lit(by)))

    return F.concat(*map(named, GENERATORS))


def features(c: Column) -> Column:
    """`FEATURES` of a proposal, as a struct of doubles."""
    value, before, after = c["value"], F.lower(c["before"]), F.lower(c["after"])
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    flag = lambda where, pattern: where.rlike(pattern).cast("double")
    size = lambda pattern, group=0: F.length(F.regexp_extract(value, pattern, group)).cast("double")
    words = lambda some: flag(before, rf"(?<![\p{{L}}\p{{N}}])(?:{some})(?![\p{{L}}\p{{N}}])")
    digits = _digits(value)
    parts = {
        **{by: (c["by"] == by).cast("double") for by in GENERATORS},
        "length": F.length(value).cast("double"), "digits": F.length(digits).cast("double"), "letters": count(r"\p{L}"), "signs": count(r"[^\p{L}\p{N}]"), "groups": count("[0-9]++"),
        "longest": F.array_max(F.transform(F.split(value, "[^0-9]+"), F.length)).cast("double"), "first": size("^[^0-9]*([0-9]+)", 1), "last": size("[0-9]+$"),
        "bracketed": count(r"(?i)[\[({<](?:at|dot|@|\.)[\])}>]"), "dot_word": count(r"(?i)\s(?:dot|punkt|punto|point)\s"), "tld": flag(F.lower(value), rf"[^\p{{L}}](?:{TLDS})$"),
        "luhn": F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False)).cast("double"), "octets": flag(value, OCTETS),
        "hex_letters": count("[A-Fa-f]"), "double_colon": flag(value, "::"), "wide_groups": count("[0-9A-Fa-f]{3,4}"), "leading_zero": flag(value, r"^\(?0"), "paren": flag(value, r"^\("),
        "date": flag(value, r"^(?:1[5-9]|20)[0-9]{2}\s?[-./]\s?(?:[01]?[0-9]|[12][0-9]{3})|[0-3]?[0-9][-./][01]?[0-9][-./](?:19|20)?[0-9]{2}$"), "thousands": flag(value, r"^[0-9]{1,3}(?:[\x20. ][0-9]{3})+$"),
        "kinds_of_signs": F.size(F.array_distinct(F.split(F.regexp_replace(value, r"[\p{L}\p{N}]", ""), ""))).cast("double"),
        "phone_words": words(PHONE_WORDS), "card_words": words(CARD_WORDS), "ip_words": words(IP_WORDS), "mail_words": words(MAIL_WORDS), "plain_words": words(PLAIN_WORDS),
        "colon_before": flag(before, r"[:=]\s*$"), "glued_before": flag(before, r"[^\s(:=,;\"'>\[]$"), "glued_after": flag(after, r"^[\p{L}\p{N}@/_+-]|^[.,:][\p{N}]"), "unit_after": flag(after, rf"^\s?(?:{UNITS})(?![\p{{L}}\p{{N}}])"),
    }
    return F.struct(*(F.coalesce(parts[name], F.lit(0.0)).alias(name) for name in FEATURES))


@dataclass(frozen=True)
class Model:
    """Boosted trees, and the least score with which a generator's proposal counts."""

    boosted: object
    thresholds: dict[str, float]

    def score(self, f: Column) -> Column:
        """0 to 1, from a struct of `FEATURES`."""
        margin = trees.total(self.boosted.trees, self.boosted.treeWeights, FEATURES, DEPTH, f)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * -2.0))

    def counts(self, by: Column, score: Column) -> Column:
        least = F.lit(2.0)
        for name, threshold in self.thresholds.items():
            least = F.when(by == name, F.lit(threshold)).otherwise(least)
        return score >= least


def labelled_lines(spark: SparkSession, copies: int = COPIES) -> DataFrame:
    """``line, text, kind, start, end``: the labelled lines with digits and names
    filled in, chosen by hashes; ``kind`` is null where a line has no personal data."""
    lines = [parsed(x) for x in LINES]
    given = F.array(*(F.struct(F.lit(i).alias("line"), F.lit(b).alias("b"), F.lit(v).alias("v"), F.lit(a).alias("a"), F.lit(k).cast("string").alias("kind")) for i, (b, v, a, k) in enumerate(lines)))
    rows = spark.range(copies).select("id", F.explode(given).alias("x")).select("id", "x.*")

    def fill(c: Column, sign: str, of: Column, salt: str) -> Column:
        parts = F.split(c, sign, -1)
        one = lambda i: F.element_at(of, 1 + F.pmod(F.xxhash64("id", "line", F.lit(salt), i), F.size(of)).cast("int"))
        return F.array_join(F.transform(parts, lambda p, i: F.when(i > 0, F.concat(one(i), p)).otherwise(p)), "")

    some = lambda c, salt: fill(fill(c, "#", F.lit(list("0123456789")), salt), r"\{w\}", F.lit(NAMES), salt)
    value = some(F.col("v"), "v")
    checked = F.filter(F.transform(F.lit(list("0123456789")), lambda d: F.regexp_replace(F.col("filled"), "L$", d)), lambda x: _luhn(_digits(x)))[0]
    rows = rows.select("line", "kind", some(F.col("b"), "b").alias("b"), value.alias("filled"), some(F.col("a"), "a").alias("a"))
    rows = rows.withColumn("value", F.when((F.col("kind") == "card") & F.col("filled").endswith("L"), checked).otherwise(F.col("filled")))
    start = F.length("b").cast("long")
    return rows.select("line", F.concat("b", "value", "a").alias("text"), "kind", start.alias("start"), (start + F.length("value")).alias("end"))


def described(labelled: DataFrame) -> DataFrame:
    """The proposals of labelled texts with their features; ``label`` is 1 where one is exactly the personal data."""
    kind = F.element_at(F.create_map(*(F.lit(x) for by, (kind, _) in GENERATORS.items() for x in (by, kind))), F.col("c.by"))
    each = labelled.withColumn("c", F.explode(proposals(F.col("text"))))
    hit = (kind == F.col("kind")) & (F.col("c.start") == F.col("start")) & (F.col("c.end") == F.col("end"))
    return each.select("line", F.col("c.by").alias("by"), F.transform(F.array("c"), features)[0].alias("f"), F.coalesce(hit, F.lit(False)).cast("double").alias("label"))


def fit(labelled: DataFrame, precision: float = PRECISION, max_rows: int = 50_000) -> Model:
    """Trees and thresholds from labelled texts (``line, text, kind, start,
    end``), of which ``max_rows`` at most are used.

    Every third line is kept from the trees.  A generator's threshold is the
    lowest score from which on the share of personal data among these lines'
    proposals is ``precision`` or more; without any, nothing of it counts."""
    scratch = Scratch(labelled.sparkSession, "pii")
    given = scratch.keep(labelled.limit(max_rows), "lines")
    rows = scratch.keep(described(given).select("line", "by", "label", "f.*").orderBy("line", "by", "label", *FEATURES).coalesce(1), "features")  # the same trees on any cluster
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.where("line % 3 != 2"))
    boosted = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=COPIES, seed=13).fit(vectors.select("features", "label"))
    model = Model(boosted, {})
    held_out = rows.where("line % 3 = 2").select("by", "label", model.score(F.struct(*FEATURES)).alias("score"))
    down = Window.partitionBy("by").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    told = held_out.withColumn("right", F.avg("label").over(down)).where((F.col("right") >= precision) & (F.col("label") == 1)).groupBy("by").agg(F.min("score").alias("score")).collect()
    return Model(boosted, {r["by"]: r["score"] for r in told})


def _fold(spans: Column, step) -> Column:
    """Spans that a pass over sorted ``spans`` keeps.  ``step(held, base, x)``
    returns the span held back next, the new border ``base``, and whether the held
    one is kept.  Kept spans are gathered in blocks, so that no long array is
    copied for each of them."""
    none, empty = F.lit(None).cast(SPAN), F.array().cast(f"array<{SPAN}>")

    def one(state: Column, x: Column) -> Column:
        held, base, kept = step(state["held"], state["base"], x)
        return F.struct(held.alias("held"), F.when(kept, F.concat(state["out"], F.array(state["held"]))).otherwise(state["out"]).alias("out"), base.alias("base"))

    def block(state: Column, some: Column) -> Column:
        start = F.struct(state["held"].alias("held"), empty.alias("out"), state["base"].alias("base"))
        return once(F.aggregate(some, start, one), lambda after: F.struct(after["held"].alias("held"), F.concat(state["out"], F.array(after["out"])).alias("out"), after["base"].alias("base")))

    zero = F.struct(none.alias("held"), F.array().cast(f"array<array<{SPAN}>>").alias("out"), F.lit(0).cast("long").alias("base"))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1)), F.lit(STEP)), lambda at: F.slice(spans, at, F.lit(STEP)))
    return once(F.aggregate(blocks, zero, block), lambda s: F.concat(F.flatten(s["out"]), F.when(s["held"].isNull(), empty).otherwise(F.array(s["held"]))))


def _settled(held: Column, base: Column, x: Column) -> tuple[Column, Column, Column]:
    """Of two added spans that overlap the one with the higher score stays (then the
    longer, then the earlier one), and none that overlaps a base span (``score`` 2)."""
    is_base, longer = x["score"] > 1, x["end"] - x["start"] > held["end"] - held["start"]
    apart = held.isNull() | (held["end"] <= x["start"])
    better = (x["score"] > held["score"]) | ((x["score"] == held["score"]) & longer)
    next_held = F.when(is_base, F.lit(None).cast(SPAN)).when(x["start"] < base, held).when(apart | better, x).otherwise(held)
    return next_held, F.when(is_base, F.greatest(base, x["end"])).otherwise(base), held.isNotNull() & apart & (is_base | (x["start"] >= base))


def _united(held: Column, base: Column, x: Column) -> tuple[Column, Column, Column]:
    """Spans that overlap become one."""
    apart = held.isNull() | (held["end"] <= x["start"])
    return F.when(apart, x).otherwise(held.withField("end", F.greatest(held["end"], x["end"]))), base, held.isNotNull() & apart


def _spans(rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` with ``base_<kind>`` and ``added`` spans of their ``text``."""
    model = model or fit(labelled_lines(rows.sparkSession))
    empty, keep = F.array().cast(f"array<{SPAN}>"), rows.columns
    span = lambda x, score, name: F.struct(x["start"].alias("start"), x["end"].alias("end"), score.alias("score"), name.alias("kind"))
    base = lambda k: F.transform(base_spans(F.col("text"), k), lambda x: span(x, F.lit(2.0), F.lit(k)))
    based = [F.coalesce(base(k), empty).alias(f"base_{k}") for k in KINDS]
    names = [f"base_{k}" for k in KINDS]
    rows = rows.select(*keep, proposals(F.col("text")).alias("c"), *based)
    scored = F.transform("c", lambda x: F.struct(x.alias("x"), model.score(features(x)).alias("score")))
    rows = rows.select(*keep, *names, F.when(F.size("c") > 0, F.filter(scored, lambda s: model.counts(s["x"]["by"], s["score"]))).alias("met"))
    kind_of = F.create_map(*(F.lit(x) for by, (k, _) in GENERATORS.items() for x in (by, k)))
    added = F.transform("met", lambda s: span(s["x"], s["score"], F.element_at(kind_of, s["x"]["by"])))
    together = F.array_sort(F.concat(added, *names))
    settled = F.filter(once(together, lambda x: _fold(x, _settled)), lambda x: x["score"] <= 1)
    return rows.select(*keep, *names, F.when(F.size("met") > 0, settled).otherwise(empty).alias("added"))


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's personal data: ``doc_id, text``, ``base_email`` and so on, the
    well-formed spans of each kind, and ``added``, the spans that the trees add;
    a span has ``start, end`` (code points, end exclusive), ``score`` (2: well-formed)
    and ``kind``.

    * Null text: as an empty one, without spans.  Null ids and repeated rows
      come through, each with its spans.  An empty table gives no rows.
    * Other columns are not read.
    """
    return _spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), model)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`find` as one row of counts and digests a text: ``doc_id, n_email, n_ip,
    n_card, n_phone`` (well-formed ones), ``base_sha256`` of these spans, ``spans``
    (all of them, written as kind:start:end) and ``n_added``.

    Nulls, repeated rows and empty tables: as in `find`."""
    found = find(docs, model, id_col, text_col)
    both = lambda k: F.array_sort(F.concat(f"base_{k}", F.filter("added", lambda x: x["kind"] == k)))
    every = F.concat(*map(both, KINDS))
    counts = (F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS)
    return found.select("doc_id", *counts, F.sha2(_written(F.concat(*(f"base_{k}" for k in KINDS))), 256).alias("base_sha256"), _written(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by its kind in brackets, e.g. ``[EMAIL]``.

    Spans that overlap become one mask, of the first one's kind.  All rows,
    columns and other text stay as they are; null texts stay null.
    """
    text = F.col(f"row.{text_col}")
    rows = _spans(docs.select(F.struct("*").alias("row")).select("row", F.coalesce(text.cast("string"), F.lit("")).alias("text")), model)
    sorted_spans = F.array_sort(F.concat(*(f"base_{k}" for k in KINDS), "added"))
    rows = rows.select("row", "text", once(sorted_spans, lambda x: _fold(x, _united)).alias("spans"))

    def masked(chars: Column) -> Column:  # slices of an array of characters: no pass over the text for each span
        cut = lambda start, end: F.array_join(F.slice(chars, (start + 1).cast("int"), (end - start).cast("int")), "")
        before = lambda i: F.when(i > 0, F.col("spans")[F.greatest(i - 1, F.lit(0))]["end"]).otherwise(F.lit(0).cast("long"))
        parts = F.transform("spans", lambda x, i: F.concat(cut(before(i), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), cut(F.element_at("spans", -1)["end"], F.size(chars).cast("long")))

    new = F.when(text.isNull() | (F.size("spans") == 0), text).otherwise(once(F.split("text", ""), masked))
    return rows.select(*(new.alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns))
