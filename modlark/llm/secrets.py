"""Secret scans with a random forest against false findings.

Candidates are found by a pattern: values assigned to names such as
``password`` or ``token``, passwords in URLs, whole private key blocks,
well-known kinds by their heads, and long runs of token signs with a digit.
Values may follow their names by a sign, as in ``password is``, ``--password``,
``<password>`` or ``Bearer``.  Each is
described by its length, the changes between kinds of characters, the part of
it that dictionary words cover, whether it looks like a path, and the words
around it.  A forest fitted to labelled findings tells secrets from the
hashes, numbers, names and placeholders that look like them.  The fitted trees
are constants of one SQL expression, so that a scan is a projection of the
documents: no Python runs on the executors, and nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlark.llm import trees
from modlark.llm.scratch import Scratch

# Names that secrets are assigned to, and heads of well-known kinds.
PASSWORD_NAMES = "password|passwd|passphrase|pwd"
SECRET_NAMES = PASSWORD_NAMES + "|secret(?:[_-]?access)?[_-]?key|secret|token|api[_-]?key|access[_-]?key|account[_-]?key|private[_-]?key|auth[_-]?key|credential|bearer"
#: What may be assigned to; the words around a candidate are held against the longer names alone.
NAMES = SECRET_NAMES.replace("api[_-]?key", r"api[\s_-]?key") + "|passwort|kennwort|pass"
_IS = r"(?:[\"']?\s{0,3}(?:=>|[:=])\s{0,3}|\s{1,3}(?:is|ist|est|es)\s{1,3})"
HEADS = "AKIA|ASIA|gh[opsur]_|github_pat_|glpat-|xox[abpors]-|sk[-_]|pk[-_]live|AIza|eyJ|ya29|SG[.]|-----BEGIN"
#: Words near look-alikes: ids, hashes and numbers that are no secrets.
PLAIN_NAMES = "commit|revision|sha1|sha256|md5|checksum|digest|etag|hash|uuid|guid|id|order|invoice|card|phone|tel|isbn|version|build|page|figure|date|serial|model|ref"
FILLERS = "example|sample|changeme|your|dummy|placeholder|insert|redacted|xxxx|test|todo|none|null|undefined|default|foobar|0000|1234|password|passwd|required|^[<{$(%]|[*]{3}"
#: Dictionary words of which names and slugs are made.
DICTIONARY = (
    "about after again article author before below blog book build category chapter city class code color computer content count country data date default design document email example family "
    "figure file first food from game guide health history home house image index info item language library line link list local long main market media member model money month music name nature "
    "network news number office online order other page paper part people person photo place point post power press price product project public question read recipe report research review sample "
    "school science search section service show size social source state story street student study style system table team test text this time title topic tour town travel type update user value "
    "version video view water week with woman word work world year your"
).split()
# Well-known kinds by their heads, each with its own signs: no digit is needed.
HEADED = (
    "(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[opsur]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_.-]{16,}|xox[abpors]-[A-Za-z0-9-]{10,}|(?:sk[-_]|pk[-_]live)[A-Za-z0-9_-]{16,}"
    "|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_=-]{8,}(?:[.][A-Za-z0-9_=+/-]*){1,4}|ya29[.][A-Za-z0-9_.-]{16,}|SG[.][A-Za-z0-9_-]{16,}[.][A-Za-z0-9_-]{16,}|[MN][A-Za-z0-9_-]{22,27}[.][A-Za-z0-9_-]{6}[.][A-Za-z0-9_-]{26,}"
)
CANDIDATE = (
    r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----"  # up to the next mark: linear without an end
    rf"|(?<![A-Za-z0-9])(?i:{NAMES}){_IS}[\"']?(?!-----BEGIN )(?=[^\s\"']{{6}})[^\s\"';]*+(?:;(?![A-Za-z]+=)[^\s\"';]*+)*+"
    rf"|(?<![A-Za-z0-9])(?i:{PASSWORD_NAMES}){_IS}(?:\"[^\"\n]{{6,80}}(?=\")|'[^'\n]{{6,80}}(?='))"
    rf"|(?<![A-Za-z0-9])(?:(?<=--)(?i:{NAMES})|(?i:bearer))\s{{1,3}}[\"']?(?=[^\s\"']{{6}})[^\s\"';,]*+"
    rf"|(?<=<)(?i:{NAMES})>[^\s\"'<>;]{{6,}}+(?=</)"
    r"|(?<=://)[^\s/:@\"'<>]*+:[^\s/@\"'<>]{5,}+(?=@)"
    rf"|(?<![A-Za-z0-9+/_-])(?:{HEADED})"
    r"|(?<![A-Za-z0-9+/_-])(?!(?<=:)//)(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{12,}={0,2}"
)
_ASSIGNED = rf"^(?:(?i:{NAMES})(?:{_IS}|>|\s+)[\"']?|[^\s/:@\"'<>]*+:)"
FEATURES = ("length", "changes", "digits", "capitals", "distinct", "dictionary", "letters", "named", "password", "plain", "filler", "path", "head")
TREES, DEPTH = 15, 6
#: A candidate is a secret if this share of the trees says so.
VOTES = 0.5


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def _flag(value: Column, pattern: str) -> Column:
    return value.rlike(pattern).cast("double")


def describe(candidate: Column, before: Column, after: Column) -> Column:
    """A candidate's value, its name if it is assigned to one, and the words around it."""
    value = F.regexp_replace(F.regexp_replace(candidate, _ASSIGNED, ""), "[.,;:!?)]+$", "")
    return F.struct(
        candidate.alias("candidate"),
        value.alias("value"),
        F.regexp_extract(candidate, _ASSIGNED, 0).alias("name"),
        F.regexp_extract(F.right(before, F.lit(60)), r"(\S+\s+)?\S*\s*$", 0).alias("before"),
        F.regexp_extract(F.left(after, F.lit(40)), r"^\S*\s*\S*", 0).alias("after"),
    )


def features(c: Column) -> Column:
    """`FEATURES` of a described candidate, as a struct of doubles."""
    value, n = c["value"], F.greatest(F.length(c["value"]), F.lit(1)).cast("double")
    led = F.lower(F.concat(c["before"], F.lit(" "), c["name"]))
    in_url = (c["name"] != "") & c["before"].endswith("://")
    around = F.concat(led, F.lit(" "), F.lower(c["after"]))
    parts = (
        F.length(value).cast("double"),
        _count(value, "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])") / n,
        _count(value, "[0-9]") / n,
        _count(value, "[A-Z]") / n,
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(40.0)),
        F.lit(1.0) - F.length(F.regexp_replace(F.lower(value), "|".join(DICTIONARY), "")) / n,
        F.length(F.regexp_extract(value, "[A-Za-z]{4,}", 0)) / n,
        F.greatest(_flag(led, SECRET_NAMES), (~in_url & (c["name"] != "")).cast("double"), in_url.cast("double")),
        F.greatest(_flag(F.lower(c["name"]), f"^({PASSWORD_NAMES}|passwort|kennwort|pass)"), in_url.cast("double")),
        _flag(around, rf"(^|[^a-z])({PLAIN_NAMES})s?([^a-z]|$)"),
        _flag(F.lower(value), FILLERS + r"|(.)\1\1\1"),
        F.greatest(_flag(value, "/.*/|[a-z]-[a-z]"), F.when(c["name"] == "", _flag(c["before"], "[/?&.#]$"))),
        _flag(value, f"^({HEADS})"),
    )
    return F.struct(*(F.coalesce(p, F.lit(0.0)).alias(f) for f, p in zip(FEATURES, parts)))


def example_findings(spark: SparkSession, n: int = 120) -> DataFrame:
    """Labelled findings ``(candidate, before, after, label)`` made by rule:
    ``n`` of each kind of secret (1) and of look-alike (0), with hashes as the
    source of their signs."""
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    g = F.sha2(F.concat(h, F.lit("more")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "=+$", "")
    url = F.translate(b64, "+/", "-_")
    more = F.translate(F.regexp_replace(F.base64(F.unhex(g)), "=+$", ""), "+/", "_-")
    caps = F.upper(F.translate(F.regexp_replace(F.base64(F.unhex(g)), "[^A-Za-z0-9]", ""), "018", "ABC"))
    letters = F.regexp_replace(F.translate(F.concat(b64, F.base64(F.unhex(g))), "0123456789+/=", "QxZvKjWyGh"), "[^A-Za-z]", "")
    prose = lambda k: F.element_at(F.array(*map(F.lit, "the of and it on by set with for to is into then was our as".split())), 1 + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(16)).cast("int"))
    word = lambda k: F.element_at(F.array(*map(F.lit, DICTIONARY)), 1 + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(DICTIONARY))).cast("int"))
    joined = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    cut = lambda c, i, k: F.substring(c, i, k)
    digits = F.lpad(F.pmod(F.xxhash64("id", F.lit("digits")), F.lit(10**16)).cast("string"), 16, "7")
    lead = joined(prose("a"), " ", prose("b"), " ")
    title = lambda k: F.initcap(word(k))
    secret = (
        (joined("AKIA", cut(caps, 1, 16)), lead), (joined("password=", cut(h, 1, 18)), lead), (joined('token = "', cut(h, 1, 40)), lead), (joined("secret: ", cut(b64, 1, 32)), lead),
        (joined("ghp_", cut(F.regexp_replace(b64, "[+/]", "x"), 1, 36)), lead), (joined("sk-", cut(F.regexp_replace(b64, "[+/]", "Q"), 1, 40)), lead), (joined("api_key=", cut(g, 1, 32)), lead),
        (joined("xoxb-", cut(digits, 1, 12), "-", cut(b64, 1, 24)), lead), (joined("passwd: ", cut(b64, 1, 12), "!"), lead), (cut(b64, 1, 40), joined("aws secret ", prose("c"), " ")),
        (joined("eyJ", cut(b64, 1, 30), "eyJ", cut(b64, 5, 30)), joined("bearer ")),
        (joined("AKIA", cut(F.translate(caps, "0123456789", "ABCDEFGHIJ"), 1, 16)), lead), (joined("eyJ", cut(url, 1, 30), ".eyJ", cut(url, 5, 36), ".", cut(more, 1, 43)), lead), (joined("SG.", cut(url, 1, 22), ".", cut(more, 1, 43)), lead),
        (joined("-----BEGIN RSA PRIVATE KEY-----\n", b64, "\n", cut(h, 1, 60), b64, "\n", b64, "\n-----END RSA PRIVATE KEY-----"), lead),
        (joined("-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: 1\n\n", b64, "\n", b64, "\n=", cut(b64, 3, 4), "\n-----END PGP PRIVATE KEY BLOCK-----"), lead),
        (joined("-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,", F.upper(cut(g, 1, 32)), "\n\n", b64, "\n", b64, "\n-----END RSA PRIVATE KEY-----"), lead),
        (joined("password=", word("a"), word("b"), word("c")), lead), (joined("passphrase: ", word("a"), "-", word("b"), "-", word("c"), "-", word("d")), lead), (joined("password: ", title("a"), cut(digits, 1, 4), "!"), lead),
        (joined(word("a"), ":", cut(url, 1, 12)), joined(prose("b"), " postgres://")), (joined(word("a"), ":", title("b"), cut(digits, 1, 3)), joined(prose("b"), " https://")), (joined("pwd=", cut(url, 1, 9), ";"), lead),
        (joined("M", cut(url, 1, 24), ".", cut(more, 1, 6), ".", cut(more, 7, 30)), lead),
        (joined("password is ", word("a"), cut(digits, 1, 3)), joined(prose("b"), " my ")), (joined("PASS=", title("a"), cut(digits, 1, 3), cut(url, 1, 3)), joined(prose("b"), " DB_")), (joined("Bearer ", cut(letters, 1, 32)), joined("Authorization: ")), (joined("password>", title("a"), cut(url, 1, 6)), joined(prose("b"), " <")),
        (joined("AKIA", cut(caps, 1, 9), "DDDD", cut(caps, 10, 3)), lead), (joined("password is ", F.reverse(word("a")), cut(digits, 1, 2)), joined(prose("b"), " my ")), (joined("password ", title("a"), cut(url, 1, 5)), joined(prose("b"), " --")), (joined("password = '", word("a"), " ", title("b"), " ", cut(digits, 1, 3)), lead), (joined("API key is ", cut(letters, 1, 24)), joined(prose("b"), " our ")), (joined("passwort: ", title("a"), cut(digits, 1, 4)), lead),
    )
    plain = (
        (cut(h, 1, 40), joined("commit ")), (cut(h, 1, 64), joined("sha256 ")), (cut(h, 1, 32), joined(prose("c"), " md5 ")), (digits, joined("card number ")), (digits, lead),
        (joined(cut(h, 1, 8), "-", cut(h, 9, 4), "-4", cut(h, 14, 3), "-a", cut(h, 18, 3), "-", cut(h, 22, 12)), joined("uuid ")), (joined(word("a"), "-", word("b"), "-", word("c"), "-2", cut(digits, 1, 3)), lead),
        (joined("/", word("a"), "/", word("b"), "/", cut(digits, 1, 6)), joined("https://example.org")), (joined("password=", word("a"), "example"), lead), (joined("token = \"your_", word("b"), "_here"), lead),
        (joined("api_key=xxxxxxxxxxxx", cut(digits, 1, 2)), lead), (joined("password: changeme", cut(digits, 1, 3)), lead), (joined(word("a"), word("b"), word("c"), cut(digits, 1, 2)), lead),
        (joined("20", cut(digits, 1, 2), "-0", cut(digits, 3, 1), "-1", cut(digits, 4, 1), "-", cut(digits, 5, 6)), joined("build ")), (joined("token: ", word("a"), word("b")), lead), (joined("secret = ", word("d")), lead),
        (joined("password is ", word("a")), lead), (joined("token is ", word("a"), "ed"), lead), (joined("secret is ", word("a"), prose("b")), lead), (joined("bearer ", word("a"), "s"), joined(prose("b"), " the ")), (joined("pass: ", word("a"), "s"), lead), (joined("password ", word("a"), "s"), joined(prose("b"), " --")),
        (joined("password>", word("a"), "ed"), joined(prose("b"), " <")), (joined("password = 'the ", word("a"), " of ", word("b")), lead), (joined("api key is ", word("a"), "ed"), lead),
        (joined("AKIA", "EXAMPLE", cut(caps, 1, 9)), lead), (cut(g, 1, 40), joined("revision ")), (cut(g, 1, 32), joined("checksum ")), (joined(cut(digits, 1, 6), "-", cut(digits, 7, 8)), joined("order ")),
        (joined("password: ", word("a")), lead), (joined("passphrase = ", word("a")), lead), (joined("password=<", word("a"), "-", word("b"), ">"), lead), (joined("secret_key=${", F.upper(word("a")), "_", F.upper(word("b")), "}"), lead),
        (joined(word("a"), ":password"), joined(prose("b"), " mysql://")), (joined("user:", word("b"), "example"), joined(prose("b"), " http://")), (joined("token: ", word("a"), "_", word("b"), "_", word("c")), lead), (joined(F.upper(cut(h, 1, 8)), "-", F.upper(cut(h, 9, 8)), "-", cut(digits, 1, 4)), joined("serial ")),
    )
    rows = [F.struct(c.alias("candidate"), b.alias("before"), F.lit(y).alias("label")) for y, kinds in ((1, secret), (0, plain)) for c, b in kinds]
    some = lambda few: spark.range(n).select(F.explode(F.array(*few)).alias("r"), prose("z").alias("w")).select("r.candidate", "r.before", F.concat(F.lit(" "), "w").alias("after"), "r.label")
    return reduce(DataFrame.unionByName, (some(rows[i : i + 6]) for i in range(0, len(rows), 6)))  # more at once are too long to compile


def fit(labelled: DataFrame, max_rows: int = 50_000) -> RandomForestClassificationModel:
    """A forest from labelled findings, of which ``max_rows`` at most are used.

    Findings and features are written in between: one generated function for
    both would be too long to compile, and the forest reads them several times."""
    scratch = Scratch(labelled.sparkSession, "secrets")
    given = scratch.keep(labelled.limit(max_rows), "findings")
    described = given.select(describe(F.col("candidate"), F.col("before"), F.col("after")).alias("c"), F.col("label").cast("double").alias("label"))
    rows = scratch.keep(described.select(F.transform(F.array("c"), features)[0].alias("f"), "label").select("f.*", "label").orderBy("label", *FEATURES).coalesce(1), "features")  # the same forest on any cluster
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.5", seed=11).fit(rows.select("features", "label"))


def votes(model: RandomForestClassificationModel, f: Column) -> Column:
    """The share of trees that take a struct of features for a secret, in SQL."""
    return trees.total(model.trees, [1.0] * len(model.trees), FEATURES, DEPTH, f) / len(model.trees)


def _judged(text: Column, model: RandomForestClassificationModel) -> Column:
    """An array of a text's candidates with their ``votes`` and the ``gap`` before each."""
    found, gaps = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)
    met = F.transform(F.arrays_zip(found.alias("c"), F.slice(gaps, 1, F.size(found)).alias("b"), F.slice(gaps, 2, F.size(found)).alias("a")), lambda x: F.struct(x["b"].alias("gap"), describe(x["c"], x["b"], x["a"]).alias("d")))
    told = F.transform(met, lambda x: F.struct(x["gap"].alias("gap"), x["d"].alias("d"), features(x["d"]).alias("f")))
    return F.transform(told, lambda x: F.struct(x["gap"].alias("gap"), x["d"].alias("d"), votes(model, x["f"]).alias("votes")))


def _placed(found: Column) -> Column:
    """`_judged` candidates with the ``end`` of each: running sums by blocks, as
    a text may have very many.  Arrays of one entry name values used often."""
    step, once = 256, lambda value, use: F.transform(F.array(value), use)[0]
    total = lambda sizes: F.aggregate(sizes, F.lit(0).cast("long"), lambda n, x: n + x)

    def sums(sizes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(sizes).cast("int") - 1, F.lit(step)), lambda at: total(F.slice(sizes, at + 1, F.lit(step))))

    def ends(f: Column, sizes: Column, blocks: Column) -> Column:
        end = lambda i: total(F.slice(blocks, F.lit(1), F.floor(i / step).cast("int"))) + total(F.slice(sizes, i - i % step + 1, i % step + 1))
        return F.transform(f, lambda x, i: F.struct(x["d"].alias("d"), x["votes"].alias("votes"), end(i).alias("end")))

    sized = lambda f: F.transform(f, lambda x: (F.length(x["gap"]) + F.length(x["d"]["candidate"])).cast("long"))
    return once(found, lambda f: once(sized(f), lambda sizes: once(sums(sizes), lambda blocks: ends(f, sizes, blocks))))


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All candidates of all texts, one row each, with the forest's verdict.

    Returns ``doc_id, finding`` (from 0, in text order), ``start`` and
    ``length`` (characters), ``kind`` (the name that a value is assigned to,
    ``url``, or its head), ``votes, is_secret`` and ``sha256``; never the value
    itself.

    * Null, empty or clean text: no rows.  Null ids and repeated rows: their
      findings come through for each row.  An empty table gives no rows.
    * Other columns are not read.
    """
    model = model or fit(example_findings(docs.sparkSession))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(CANDIDATE))
    each = given.select("doc_id", F.posexplode(_placed(_judged(F.col("text"), model))).alias("finding", "x"))
    size = F.length("x.d.candidate")
    named = F.lower(F.regexp_extract("x.d.name", f"^(?i:{NAMES})", 0))
    head = F.coalesce(F.nullif(F.regexp_extract("x.d.value", f"^({HEADS})", 0), F.lit("")), F.lit("token"))
    kind = F.when(named != "", named).when(F.col("x.d.name") != "", "url").otherwise(head)
    return each.select(
        "doc_id", "finding", (F.col("x.end") - size).cast("long").alias("start"), size.cast("long").alias("length"), kind.alias("kind"),
        F.round("x.votes", 6).alias("votes"), (F.col("x.votes") >= VOTES).alias("is_secret"), F.sha2(F.col("x.d.value"), 256).alias("sha256"),
    )


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with the values of secrets replaced by ``mask`` in their texts.

    All rows, columns and other text stay as they are; null texts stay null.
    """
    model = model or fit(example_findings(docs.sparkSession))
    text = F.col(f"row.{text_col}")
    judged = F.when(text.rlike(CANDIDATE), _judged(text.cast("string"), model))
    parts = F.transform(F.col("found"), lambda x: F.concat(x["gap"], F.when(x["votes"] >= VOTES, F.concat(x["d"]["name"], F.lit(mask), F.substr(x["d"]["candidate"], F.length(x["d"]["name"]) + F.length(x["d"]["value"]) + 1))).otherwise(x["d"]["candidate"])))
    rest = F.substr(text, F.aggregate(F.col("found"), F.lit(1), lambda n, x: n + F.length(x["gap"]) + F.length(x["d"]["candidate"])))
    new = F.when(F.col("found").isNull(), text).otherwise(F.concat(F.array_join(parts, ""), rest))
    rows = docs.select(F.struct("*").alias("row")).withColumn("found", judged)
    return rows.select(*(new.alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns))
