"""Quality rules: counted rules, and a hashed n-gram log-likelihood ratio against trusted texts, in DataFrame operations only.

Words, pairs of neighbouring words and the words' last three characters are hashed into features, of which there are more for larger corpora. Two multinomials over
the features are counted, with add-one smoothing: over the raw corpus, every document included, and over trusted texts (labelled good
and not toxic), TRUSTED of them at most, those whose doc_ids have the smallest hashes. A document's score is the sum of log(trusted / raw) over its features, divided by their number. Documents that score below the
threshold are rejected. The threshold is a parameter: the same document and the same counts always give the same verdict.

A few toxic words among hundreds don't move that mean, so a second part of the verdict does not average. A word is a mark of toxic
texts if MARK_SHARE of the texts labelled toxic have it, MARK_TEXTS at least, and the share of them that have it is MARK_RATIO times that of
trusted texts (each count plus one); TRUSTED texts of either kind at most are counted. Documents with MARKS different marks are rejected, however long they are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, filtered, forgotten, saved, spaced, without, words_of

#: Features' buckets at least; see buckets_for().
BUCKETS = 8192
#: Mean log ratio under which a document is unlike the trusted texts. At sf0.1, of labelled documents that pass the base rules, good ones
#: score -0.015 or more (median 0.038), and bad ones -0.84 or less.
THRESHOLD = -0.4
#: Trusted documents at most, and toxic ones: so few that their ids can be sent to every executor.
TRUSTED = 20_000
#: Share and number of toxic texts that have a mark, at least; how much more frequent it is in them than in good ones.
MARK_SHARE = 0.01
MARK_TEXTS = 3
MARK_RATIO = 32.0
#: So many different marks in a document reject it.
MARKS = 2
#: Punctuation that may stand around a word.
AROUND = ".,;:!?()[]{}<>\"'`*_~-"
#: Different repeated windows that are looked for one by one.
FEW = 64
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"


def _feature(n_buckets: int, hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(n_buckets - 1)).cast("int")


def _end(word: Column) -> Column:
    return F.xxhash64(F.right(word, F.lit(3)), F.lit(3))


def buckets_for(docs: DataFrame) -> int:
    """A power of two, at least BUCKETS and at least the square root of the corpus' characters, as different words grow about as that."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(BUCKETS, 1 << math.isqrt(chars).bit_length())


def ratios(docs: DataFrame, labels: DataFrame, n_buckets: int) -> list[float]:
    """log(trusted / raw) of each feature, from all documents. The result's size is n_buckets.

    labels: doc_id, quality, toxic. A document is trusted if a label says quality 1 and none says toxic 1. Without trusted
    documents all ratios are 0, so that no document is rejected for its score.
    """
    trusted = labels.groupBy("doc_id").agg((F.max(F.coalesce("quality", F.lit(0))) * (1 - F.max(F.coalesce("toxic", F.lit(0))))).alias("_trusted")).filter("_trusted = 1")
    trusted = F.broadcast(trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED))
    counts = docs.select("doc_id", words_of(F.col("text")).alias("_w")).join(trusted, "doc_id", "left")
    # the same features as score()'s, of one word after the other, in generated code
    counts = counts.select("_trusted", "_w", F.posexplode("_w").alias("_i", "_word")).withColumn("_next", F.get("_w", F.col("_i") + 1))
    counts = counts.select("_trusted", F.xxhash64("_word").alias("_one"), _end(F.col("_word")).alias("_end"), F.when(F.col("_next").isNotNull(), F.xxhash64("_next")).alias("_after"))
    of = F.array(_feature(n_buckets, F.col("_one")), _feature(n_buckets, F.col("_end")), F.when(F.col("_after").isNotNull(), _feature(n_buckets, F.xxhash64("_one", "_after"))))
    counts = counts.select("_trusted", F.explode(of).alias("_f")).filter("_f is not null")
    counts = counts.groupBy("_f").agg(F.count("*").alias("raw"), F.count("_trusted").alias("good")).toPandas()  # at most n_buckets rows
    raw, good = (np.zeros(n_buckets) for _ in range(2))
    for name, array in (("raw", raw), ("good", good)):
        array[counts["_f"].to_numpy(np.int64)] = counts[name].to_numpy(np.int64)
    if not good.sum():
        return [0.0] * n_buckets
    return np.log((good + 1) / (good.sum() + n_buckets) / ((raw + 1) / (raw.sum() + n_buckets))).tolist()


def _bare(words: Column) -> Column:
    """The different words of an array, in lower case and without punctuation around them; some may be equal then."""
    return F.transform(F.array_distinct(words), lambda w: F.lower(F.btrim(w, F.lit(AROUND))))


def toxic_marks(docs: DataFrame, labels: DataFrame) -> list[str]:
    """The marks of toxic texts, sorted. Each is in MARK_SHARE of the toxic texts, so their number is bounded by the length of texts, whatever the input's size. Without toxic or good texts there are none."""
    most = lambda c: F.max(F.coalesce(c, F.lit(0)))
    kinds = labels.groupBy("doc_id").agg(most("quality").alias("_good"), most("toxic").alias("_toxic"))
    ids = lambda which: kinds.filter(which).select("doc_id", "_toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)
    sent = F.broadcast(ids("_toxic = 1").union(ids("_toxic = 0 AND _good = 1")))
    texts = saved(docs.join(sent, "doc_id").select("_toxic", "text"), "quality-labelled")
    n = {r["_toxic"]: r["count"] for r in texts.groupBy("_toxic").count().collect()}
    toxic, good = n.get(1, 0), n.get(0, 0)
    if not toxic or not good:
        return []
    words = lambda kind: texts.filter(F.col("_toxic") == kind).select(F.explode(F.array_distinct(_bare(words_of(F.col("text"))))).alias("word"))
    often = words(1).filter("word <> ''").groupBy("word").agg(F.count("*").alias("toxic")).filter(F.col("toxic") >= max(MARK_TEXTS, MARK_SHARE * toxic))
    often = saved(often, "quality-often")
    other = words(0).join(F.broadcast(often.select("word")), "word").groupBy("word").agg(F.count("*").alias("good"))
    counts = often.join(other, "word", "left").withColumn("good", F.coalesce("good", F.lit(0)))
    ratio = (F.col("toxic") + 1) / (toxic + 2) / ((F.col("good") + 1) / (good + 2))
    marks = sorted(r["word"] for r in counts.filter(ratio >= MARK_RATIO).select("word").collect())
    forgotten(texts, often)
    return marks


def with_rules(docs: DataFrame) -> DataFrame:
    """docs with _w, _h, _b (words, their hashes and their pairs') and the counted rules n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_w", words_of(F.col("text"))).withColumn("_lines", lines)
    df = df.withColumn("n_words", F.size("_w").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    df = df.withColumn("word_chars", F.length(without(spaced(text), " ")).cast("long")).withColumn("n_symbols", F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"))
    # words, pairs of neighbours and windows of three words as hashes; of the windows, sorted, equal ones are neighbours
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    most = lambda less: F.greatest(F.size("_w") - less, F.lit(0))
    df = df.withColumn("_b", F.zip_with(F.slice("_h", 1, most(1)), F.slice("_h", 2, F.size("_h")), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_t", F.zip_with(F.slice("_b", 1, most(2)), F.slice("_h", 3, F.size("_h")), lambda a, b: F.xxhash64(a, b)))
    # places of the windows that are there more than once. Sorted hashes show which those are; few are looked for one by one, and where
    # there are many, windows are sorted with their places: n log n, not a search of one list for each item of another
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_s", F.when(F.size("_t") > F.size(F.array_distinct("_t")), F.sort_array("_t")).otherwise(none))
    df = df.withColumn("_d", F.array_distinct(F.filter("_s", lambda h, i: (i > 0) & (F.get("_s", i - 1) == h)))).drop("_s")
    few = F.size("_d") <= FEW
    placed = F.when(~few, F.sort_array(F.transform("_t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.withColumn("_p", placed)
    same = lambda i, j: F.coalesce(F.get("_p", i)["h"] == F.get("_p", j)["h"], F.lit(False))
    many = F.sort_array(F.transform(F.filter(F.transform("_p", lambda p, j: F.struct(p["i"].alias("i"), (same(j, j - 1) | same(j, j + 1)).alias("r"))), lambda x: x["r"]), lambda x: x["i"]))
    found = F.array_compact(F.transform("_t", lambda h, i: F.when(F.array_contains("_d", h), i)))
    df = df.withColumn("_q", F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(few, found).otherwise(many)).drop("_p", "_d", "_t")
    covered = F.zip_with("_q", F.slice("_q", 2, F.size("_q")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda s, x: s + x).cast("long")).drop("_q")


def score(words: str, hashes: str, pairs: str, table: list[float]) -> Column:
    """Mean log ratio of the features of a word array, given with its words' and pairs' hashes; 0 without words."""
    known = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # folded to a constant
    at = lambda h: F.get(known, _feature(len(table), h))
    total = F.aggregate(hashes, F.lit(0.0), lambda s, h: s + at(h))
    total = F.aggregate(pairs, total, lambda s, h: s + at(h))
    total = F.aggregate(words, total, lambda s, w: s + at(_end(w)))
    return F.when(F.size(words) == 0, 0.0).otherwise(total / (3 * F.size(words) - 1))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, n_buckets: int | None = None) -> DataFrame:
    """docs with the rules' counts, base_failed, score and kept; one row per row of docs, in the same columns and these.

    Null and blank texts have no words, so they fail the base rules and are not kept. Null doc_ids have no label. An empty table
    gives no rows. Columns of docs that clash with those added are replaced; none of them is read but doc_id and text.
    """
    table = ratios(docs.select("doc_id", "text"), labels, n_buckets or buckets_for(docs))
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    marks = toxic_marks(docs.select("doc_id", "text"), labels)
    df = with_rules(docs.drop(*added)).withColumn("score", score("_w", "_h", "_b", table))
    found = F.size(F.array_intersect(_bare(F.col("_w")), F.array(*map(F.lit, marks)))) if marks else F.lit(0)
    df = df.withColumn("_marks", found).drop("_w", "_h", "_b")
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold) & (F.col("_marks") < MARKS)).drop("_marks")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = judged(docs, documents(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules, the score or marks of toxic texts reject go, null and blank texts among them; null ids and repeated rows are judged like any other."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_doc"))  # other columns' names may clash
    return filtered(judged(rows, documents(spark, sf_dir, "labels")), F.col("kept")).select("_doc.*")
