"""Mixing sources by temperature; DataFrame operations only.

Tokens are words here. A source's weight is its share of the tokens to the power of an exponent from 0 (all alike) to 1 (as they are), normalised.
The exponent is bisected: the largest at which the weights' entropy reaches a target, or, if that would repeat a source more often
than allowed, the smallest that keeps to the limit of repetitions. Each step asks for sums over the sources, so the driver sees a
row for each step, however many sources there are; a step tries GRID exponents, which is several bisections at once.

Each source gets its weight's share of a token budget, and takes it from passes over its documents. A pass is a block permutation:
documents are dealt to blocks by a hash, the blocks come in hashed order, and so do the documents in each; every pass has orders of its
own. All passes but the last are whole; the last ends where the budget does. That place is two numbers for a source, the last
block's key and the last document's in it, found from sums over blocks and from the documents of one block. It takes no document beyond
the budget, but where a source would be left with none at all, its first one is taken, however long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, saved, words_of

BLOCKS = 4096
BLOCK_DOCS = 64
GRID = 32
ROUNDS = 5
#: Entropy to reach, as a share of that of equal weights; passes over a source at most; budget as a share of all tokens.
ENTROPY = 0.9999
REPEATS = 2.0
BUDGET = 1.5
SEED = 17
#: So few sources are sent to every executor.
SENT = 100_000


def source_key(source: Column) -> Column:
    """A string that is never null; a null source is one of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def row_key() -> Column:
    """What a row's places in the passes come from. Rows with one doc_id and text are taken together; null doc_ids don't bring others together."""
    return F.xxhash64("doc_id", "text").alias("row")


def sized(docs: DataFrame) -> DataFrame:
    """(key, row, doc_id, n_tokens) of each row of docs (doc_id, text, source), saved. A null text has no tokens, a null doc_id or source is one of its own."""
    return saved(docs.select(source_key(F.col("source")).alias("key"), row_key(), "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_tokens")), "mixing-sizes")


def exponent(sources: DataFrame, entropy: float, repeats: float, budget: float) -> float:
    """The exponent for sources (n_tokens over 0) as the module's text says."""
    n, total, least = sources.agg(F.count("*"), F.sum("n_tokens"), F.min("n_tokens")).first()
    if not n:
        return 1.0
    share = F.col("n_tokens") / F.lit(float(total))
    goal = entropy * math.log(n)

    def searched(fits) -> tuple[float, float]:
        """Neighbouring exponents, of which fits(exponent, sum of powers, sum of powers times logarithms) holds for the first and not for the second."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            tried = [low + (high - low) * i / GRID for i in range(GRID + 1)]
            sums = sources.agg(*[s for a in tried for s in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.ln(share)))]).first()
            good = [fits(a, sums[2 * i], sums[2 * i + 1]) for i, a in enumerate(tried)]
            if all(good) or not good[0]:
                return (high, high) if all(good) else (low, low)
            i = good.index(False)
            low, high = tried[i - 1], tried[i]
        return low, high

    flat = searched(lambda a, z, s: math.log(z) - a * s / z >= goal - 1e-12)[0]
    above = lambda a, z: (least / total) ** (a - 1) / z * budget > repeats  # noqa: E731  the smallest source is repeated most
    steep = searched(lambda a, z, s: above(a, z))[1]
    return max(flat, steep)


def weights(sizes: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET) -> DataFrame:
    """(key, n_docs, n_tokens, weight, budget, passes, rest) of each source, saved: whole passes, and tokens of the last one.

    A source without tokens has weight 0 and one pass, as it costs nothing. Repeated rows count as often as they are there; without any
    tokens the exponent is 1, and an empty table gives no sources.
    """
    sources = saved(sizes.groupBy("key").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "mixing-sources")
    some = sources.filter("n_tokens > 0")
    a = exponent(some, entropy, repeats, budget)
    total = some.agg(F.sum("n_tokens")).first()[0] or 0
    z = some.agg(F.sum(F.pow(F.col("n_tokens") / F.lit(float(total or 1)), F.lit(a)))).first()[0] or 1.0
    weight = F.when(F.col("n_tokens") > 0, F.round(F.pow(F.col("n_tokens") / F.lit(float(total or 1)), F.lit(a)) / F.lit(z), 15)).otherwise(0.0)
    rows = sources.withColumn("weight", weight).withColumn("budget", F.round(F.col("weight") * F.lit(float(total) * budget)).cast("long"))
    rows = rows.withColumn("passes", F.when(F.col("n_tokens") > 0, F.floor(F.col("budget") / F.greatest("n_tokens", F.lit(1)))).otherwise(1).cast("int"))
    return saved(rows.withColumn("rest", F.when(F.col("n_tokens") > 0, F.col("budget") - F.col("passes") * F.col("n_tokens")).otherwise(0)), "mixing-weights")


def _sent(sources: DataFrame) -> DataFrame:
    """sources, broadcast if they are few: a source may hold most of the rows it is joined with."""
    return F.broadcast(sources) if sources.count() <= SENT else sources


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64("row", F.lit(seed)), F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.floor(F.col("n_docs") / BLOCK_DOCS))))


def _block_key(seed: int, step: Column) -> Column:
    return F.xxhash64(F.lit(seed), step, F.col("block"))


def _doc_key(seed: int, step: Column) -> Column:
    return F.xxhash64(F.lit(seed), step, F.col("row"), F.lit(1))


def ends(sizes: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """sources with last_block and last_doc: the keys up to which the last pass goes; both null if it takes nothing."""
    rows = sizes.join(_sent(sources.select("key", "n_docs", "passes", "rest").filter("rest > 0")), "key").withColumn("block", _block(seed))
    rows = rows.withColumn("block_key", _block_key(seed, F.col("passes")))
    blocks = rows.groupBy("key", "block_key", "rest").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("block_key")) - F.col("n")  # of at most BLOCKS rows
    last = saved(blocks.withColumn("before", before).filter("before <= rest").groupBy("key").agg(F.max(F.struct("block_key", "before")).alias("last")).select("key", F.col("last.block_key").alias("last_block"), F.col("last.before").alias("before")), "mixing-blocks")
    inside = rows.join(last.withColumnRenamed("last_block", "block_key"), ["key", "block_key"]).withColumn("doc_key", _doc_key(seed, F.col("passes")))
    running = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("key", "block_key").orderBy("doc_key"))  # of one block; equal keys together
    first = F.when((F.first("passes") == 0) & (F.first("before") == 0), F.min("doc_key"))
    cut = inside.withColumn("running", running).groupBy("key").agg(F.coalesce(F.max(F.when(F.col("running") <= F.col("rest"), F.col("doc_key"))), first).alias("last_doc"))
    return saved(sources.join(last.select("key", "last_block"), "key", "left").join(cut, "key", "left"), "mixing-ends")


def mixed(docs: DataFrame, marks: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (key, row and any others) once for each pass that takes them, with epoch, block, block_order and doc_order.

    By source, the passes' order is that of epoch, block_order and doc_order. Rows with one source and row are taken together.
    """
    rows = docs.join(_sent(marks.select("key", "n_docs", "passes", "last_block", "last_doc")), "key").withColumn("block", _block(seed))
    key, doc = _block_key(seed, F.col("passes")), _doc_key(seed, F.col("passes"))
    more = F.coalesce((key < F.col("last_block")) | ((key == F.col("last_block")) & (doc <= F.col("last_doc"))), F.lit(False))
    times = F.col("passes") + more.cast("int")
    rows = rows.filter(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    return rows.select(*docs.columns, "epoch", "block", _block_key(seed, F.col("epoch")).alias("block_order"), _doc_key(seed, F.col("epoch")).alias("doc_order"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sized(documents(spark, sf_dir))
    rows = mixed(sizes, ends(sizes, weights(sizes)))
    return rows.select("doc_id", F.expr("nullif(substring(key, 2), '')").alias("source"), F.col("n_tokens").alias("n_words"), "epoch", "block", "block_order", "doc_order")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as their source's budget takes them. Null sources are one source, null texts cost nothing and are taken once; an empty table gives none."""
    sizes = sized(docs)
    marks = ends(sizes, weights(sizes))
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), source_key(F.col("source")).alias("key"), row_key())  # other columns' names may clash
    return mixed(rows, marks).select("_doc.*")
