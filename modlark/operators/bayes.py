"""TF-IDF and multinomial naive Bayes as aggregations over (document, term) rows.

Terms are counted before any shuffle of theirs, the vocabulary is never
collected, and a fitted model is two tables: weights per term and label, and
priors per label.  Documents meet the vocabulary in `lookup`, which broadcasts
the few terms that are frequent, so that none of them is a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modlark.sources.shared import written

#: Vocabularies of so many terms are broadcast (some 100 bytes each).
MAX_TERMS = 200_000
#: Of larger ones, terms in more than this share of all (document, term) rows are; there are 1 / SHARE of them at most, so as many.
SHARE = 1 / MAX_TERMS
#: Documents whose terms one task counts, about.
DEALT = 1_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word signs."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def char_tokens(text: Column, longest: int = 3) -> Column:
    """Runs of 1 to ``longest`` characters within words, a blank at both ends of each word."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def runs(w: Column, n: int) -> Column:
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.concat(*(runs(w, n) for n in range(1, longest + 1)))))


def term_counts(docs: DataFrame, id_col: str = "id", text_col: str = "text", split=tokens) -> DataFrame:
    """``(id, term, tf)``: how often each term occurs in each document.

    Texts are dealt by id before they are cut, so that a document's terms are
    counted where they are and lie together in what is written of them.  A task
    gets some `DEALT` of them, so its counts in memory don't grow with their number."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    dealt = given.repartition(given.select("id").count() // DEALT + 1, "id")
    return dealt.select("id", F.explode(split(F.col("_text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, n_docs: int | Column) -> DataFrame:
    """``(term, df, idf)`` with idf = ln((1 + n) / (1 + df)) + 1."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def lookup(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """``counts`` joined with a table of one row per term that has ``df``.

    Up to ``MAX_TERMS`` terms are broadcast.  Of more, those whose ``df`` is
    over ``SHARE`` of the sum are broadcast, 1 / SHARE rows at most; all others
    meet in a shuffle, where none of them has more rows than that share."""
    cols = [*counts.columns, *(c for c in terms.columns if c != "term")]
    if terms.count() <= MAX_TERMS:
        return counts.join(F.broadcast(terms), "term").select(*cols)
    total = terms.agg(F.sum("df").alias("_total"))
    marked = terms.crossJoin(F.broadcast(total)).withColumn("_often", F.col("df") > F.col("_total") * SHARE).drop("_total")  # one row
    often = F.broadcast(marked.where("_often").drop("_often"))
    rare = counts.join(F.broadcast(marked.where("_often").select("term")), "term", "left_anti")
    return counts.join(often, "term").select(*cols).unionByName(rare.join(marked.where(~F.col("_often")).drop("_often"), "term").select(*cols))


def tfidf(counts: DataFrame, weights: DataFrame, sublinear: bool = False) -> DataFrame:
    """``(id, term, w)``: tf x idf, of length 1 for each document;
    ``sublinear``: 1 + ln(tf) in place of tf.

    Terms without a weight are left out, as those of new documents are.
    """
    tf = 1.0 + F.log("tf") if sublinear else F.col("tf")
    raw = lookup(counts, weights.select("term", "df", "idf")).select("id", "term", (tf * F.col("idf")).alias("w"))
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))


def fit_terms(weighted: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label, term, theta)``: log shares of a label's weight, smoothed by 1.

    Every term of the vocabulary has a row for every label.
    """
    sums = weighted.join(labels, "id", "left").groupBy("term", "label").agg(F.sum("w").alias("n"))
    told = sums.groupBy("term").agg(F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n")))).alias("_of"))  # an entry per class
    each = labels.select("label").distinct()
    full = told.crossJoin(F.broadcast(each)).select("term", "label", F.coalesce(F.col("_of")[F.col("label")], F.lit(0.0)).alias("n"))  # a row per class
    total = full.groupBy("label").agg(F.sum("n").alias("total"), F.count("*").alias("v"))
    return full.join(F.broadcast(total), "label").select("label", "term", (F.log(F.col("n") + 1.0) - F.log(F.col("total") + F.col("v"))).alias("theta"))


def fit_priors(labels: DataFrame) -> DataFrame:
    """``(label, prior)``: log shares of the labels, not smoothed."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", F.log(F.col("n") / F.col("total")).alias("prior"))


def model_terms(weights: DataFrame, theta: DataFrame) -> DataFrame:
    """``(term, df, idf, thetas)``: all that scoring needs of a term, in one row."""
    told = theta.groupBy("term").agg(F.collect_list(F.struct("label", "theta")).alias("thetas"))  # a struct per class
    return weights.select("term", "df", "idf").join(told, "term")


def score(ids: DataFrame, counts: DataFrame, terms: DataFrame, priors: DataFrame) -> DataFrame:
    """``(id, p_spam, confidence)`` for every id, from its term counts and the
    rows of `model_terms`.

    Unknown terms count nothing; without a model the score is 0.5 with
    confidence 0, with one class it is that class.
    """
    met = lookup(counts, terms).select("id", (F.col("tf") * F.col("idf")).alias("w"), F.explode("thetas").alias("t"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")))  # every label has all of a document's terms
    sums = met.groupBy("id", F.col("t.label").alias("label")).agg((F.sum(F.col("w") * F.col("t.theta")) / length).alias("s"))
    each = ids.select("id").distinct().crossJoin(F.broadcast(priors)).join(sums, ["id", "label"], "left")
    joint = each.select("id", "label", (F.coalesce("s", F.lit(0.0)) + F.col("prior")).alias("s"))
    top = joint.groupBy("id").agg(F.max("s").alias("top"), F.max(F.when(F.col("label") == 1, F.col("s"))).alias("spam"), F.collect_list("s").alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda x, s: x + F.exp(s - F.col("top")))
    scored = top.select("id", F.coalesce(F.exp(F.col("spam") - F.col("top")) / total, F.lit(0.0)).alias("p_spam"), (1.0 / total).alias("confidence"))
    return ids.select("id").distinct().join(scored, "id", "left").select("id", F.coalesce("p_spam", F.lit(0.5)).alias("p_spam"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def fit(docs: DataFrame, counts: DataFrame, n_docs: int | Column, label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """`model_terms` and priors of labelled documents with an ``id``."""
    labels = docs.select("id", F.col(label_col).alias("label"))
    weights = written(idf(counts, n_docs), "idf")
    return model_terms(weights, fit_terms(tfidf(counts, weights), labels)), fit_priors(labels)


def evaluate(docs: DataFrame, counts: DataFrame, part_col: str = "part", least: int = 10, leaked: bool = False) -> DataFrame | None:
    """``(id, label, predicted)`` of the test rows of ``docs`` (id, label, part)
    under a model of the training rows; ``leaked`` fits on all rows, test rows
    included.  None with fewer than ``least`` rows."""
    n = {bool(r[0]): r[1] for r in docs.groupBy(F.col(part_col) == "train").count().collect()}  # two rows
    if sum(n.values()) < least:
        return None
    train = docs if leaked else docs.where(F.col(part_col) == "train")
    test = docs.where(F.col(part_col) != "train")
    fitted = fit(train, counts if leaked else counts.join(train.select("id"), "id", "left_semi"), sum(n.values()) if leaked else n.get(True, 0))
    scored = score(test, counts.join(test.select("id"), "id", "left_semi"), *fitted)
    return test.select("id", "label").join(scored.select("id", (F.col("p_spam") >= 0.5).cast("int").alias("predicted")), "id")


def needs_training(samples: DataFrame, fitted_at: int, threshold: int = 100, version_col: str = "version") -> DataFrame:
    """One row: how many samples are newer than the model, and whether to fit again."""
    new = samples.agg(F.count(F.when(F.col(version_col) > fitted_at, 1)).alias("new_samples"))
    return new.withColumn("retrain", F.col("new_samples") >= threshold)
