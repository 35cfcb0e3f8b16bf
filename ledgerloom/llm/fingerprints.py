"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text's terms are its five-word shingles (its whole word sequence if it has fewer words), weighted by how often they occur.
For every term and each of n_samples components, hash bits give r and c from Gamma(2, 1) and beta from U(0, 1); with weight S,
t = floor(ln S / r + beta) and ln a = ln c - r (t - beta + 1). The component's sample is the (term, t) with the smallest a, so
two texts agree in a component with a probability that is the generalised Jaccard similarity sum(min) / sum(max) of their weights.

a >= (1 - u3 u4) u1 u2 / S, where r = -ln(u1 u2) and c = -ln(u3 u4): logarithms are taken only for terms where this bound is
at most BOUND / (sum of weights). The smallest a is Exp(sum of weights), so in exp(-BOUND) of the components, six in a
million, it is over that, and a term that was passed over could have a smaller one. Texts with such a component are sampled again,
all of their terms without a bound, so that every fingerprint is that of the definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULLS, documents, forgotten, next_buckets, saved, with_ranges, words_of

SAMPLES = 32
SHINGLE = 5
BOUND = 12.0
#: So few keys are sent to every executor.
SENT = 65_536


def with_term_runs(df: DataFrame, text: str, shingle: int = SHINGLE) -> DataFrame:
    """Adds _s (sorted hashes of the text's shingles), _n (how many) and _starts (1-based places in _s where a new one begins)."""
    df = df.withColumn("_wh", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    df = df.withColumn("_n", F.greatest(F.size("_wh") - (shingle - 1), F.least(F.size("_wh"), F.lit(1))))
    # the hash of each run of words is made of the hashes of two shorter runs; at the end of the text, they are too short and cut off
    runs, length = {1: "_wh"}, 1
    while length < shingle:
        step = min(length, shingle - length)
        later = F.slice(runs[step], length + 1, F.size(runs[step]))
        df = df.withColumn(f"_w{length + step}", F.zip_with(runs[length], later, lambda a, b: F.xxhash64(a, b)))
        runs[length + step] = f"_w{length + step}"
        length += step
    df = df.withColumn("_s", F.sort_array(F.slice(runs[shingle], 1, F.col("_n"))))
    at = lambda i: F.get(F.col("_s"), i)
    starts = F.filter(F.sequence(F.lit(1), F.col("_n")), lambda j: (j == 1) | (at(j - 1) != at(j - 2)))
    return df.withColumn("_starts", F.when(F.col("_n") > 0, starts).otherwise(F.array().cast("array<int>")))


def _sample(k: int, bounded: bool = True) -> str:
    """SQL for component k of a row with term (long), log_weight and, if bounded, limit (doubles): ln a in the high bits, a hash of (term, t) in the low 32; null if passed over."""
    h = f"xxhash64(term, {k})"
    u = [f"((({h} >>> {b}) & 65535L) + 0.5D)" for b in (0, 16, 32, 48)]
    u12, u34 = f"({u[0]} * {u[1]})", f"({u[2]} * {u[3]})"
    beta = f"((xxhash64({k}, term) & 4294967295L) / 4294967296D)"
    minus_r = f"ln({u12} / 4294967296D)"
    t = f"CAST({beta} - log_weight / {minus_r} AS BIGINT)"
    log_a = f"ln(-ln({u34} / 4294967296D)) + {minus_r} * ({t} - {beta} + 1D)"
    sample = f"shiftleft(CAST(({log_a} + 128D) * 8388608D AS BIGINT), 32) | (xxhash64({t}, term) & 4294967295L)"
    return f"CASE WHEN {u12} * (4294967296D - {u34}) <= limit THEN {sample} END" if bounded else sample


def weighted_samples(df: DataFrame, keys: list[str], text: str, n_samples: int = SAMPLES, shingle: int = SHINGLE, bound: float | None = BOUND) -> DataFrame:
    """keys + fingerprint (8 hex digits for each component) + open for every distinct combination of keys; open: a term passed over could change it.

    Each combination stands for one text. Null, empty and blank texts have no terms: their fingerprint is all zeros, alike to each
    other. Texts are never moved: where df is already dealt by some of the keys, this adds no shuffle. Without a bound, none is open.
    """
    runs = with_term_runs(df.select(*keys, text), text, shingle).drop(text)
    terms = runs.select(*keys, "_s", "_n", "_starts", F.posexplode_outer("_starts").alias("_i", "_p"))
    terms = terms.select(
        *keys,
        F.get("_s", F.col("_p") - 1).alias("term"),
        (F.coalesce(F.get("_starts", F.col("_i") + 1), F.col("_n") + 1) - F.col("_p")).alias("weight"),
        "_n",
    )
    # u12 and u34 are whole numbers below 2**32 here, so the bound's limit is scaled by 2**64
    terms = terms.select(*keys, "term", F.ln("weight").alias("log_weight"), (F.lit((bound or 0) * 2.0**64) * F.col("weight") / F.col("_n")).alias("limit"), "_n")
    names = [f"_m{k}" for k in range(n_samples)]
    samples = terms.groupBy(*keys).agg(*[F.min(F.expr(_sample(k, bound is not None))).alias(m) for k, m in enumerate(names)], F.max("_n").alias("_n"))
    opened = F.lit(False)
    if bound is not None:
        # the largest of the components' ln a, rounded up; a component of which all terms were passed over counts as larger
        most = F.greatest(*[F.coalesce(F.col(m), F.lit(2**62)) for m in names]) if n_samples > 1 else F.coalesce(F.col(names[0]), F.lit(2**62))
        opened = (F.col("_n") > 0) & ((F.shiftright(most, 32) + 1) / F.lit(8388608.0) - 128 > F.ln(F.lit(bound) / F.greatest("_n", F.lit(1))))
    parts = [F.lpad(F.lower(F.hex(F.coalesce(F.col(m), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0") for m in names]
    return samples.select(*keys, F.concat(*parts).alias("fingerprint"), opened.alias("open"))


def likeness(a: str, b: str, n_samples: int = SAMPLES) -> F.Column:
    """Share of equal components of two fingerprints: the estimate of the generalised Jaccard similarity."""
    same = [F.when(F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8), 1).otherwise(0) for k in range(n_samples)]
    return sum(same[1:], same[0]) / F.lit(float(n_samples))


def in_ranges(df: DataFrame, per_bucket: int = 64) -> DataFrame:
    """(doc_id, text, bucket) of df; null texts are empty. Order: descending doc_id; then rows without one, dealt by a hash of their text."""
    rows = with_ranges(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", F.lit(1), per_bucket)
    spread = F.lit(NULLS - 2**23) + F.expr("xxhash64(text) div 2199023255552L")
    return rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), spread).otherwise(F.col("bucket")))


def with_edited(rows: DataFrame, after: DataFrame) -> DataFrame:
    """(bucket, rn, doc_id, n_chars, text, edited) of rows (doc_id, text, bucket); after: (bucket, next_bucket).

    The next document comes from a window over ranges of doc_id; only the last row of each range looks it up in another range.
    """
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).desc(), "text")
    rows = rows.select("*", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("following"))
    # the ranges' first rows come from the same shuffle
    heads = rows.filter("rn = 1").select(F.col("bucket").alias("next_bucket"), F.col("text").alias("head"))
    rows = rows.join(after.join(heads, "next_bucket").select("bucket", "head"), "bucket", "left")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    following = F.coalesce("following", F.col("head"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.substring(following, 1, half))
    return rows.select("bucket", "rn", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))


KEYS = ["bucket", "rn", "doc_id", "n_chars", "edited_sha256"]


def _few(keys: DataFrame) -> DataFrame:
    """Saved keys, sent to every executor if they are few."""
    return F.broadcast(keys) if keys.count() <= SENT else keys


def _prints(rows: DataFrame, after: DataFrame, n_samples: int, bound: float | None, only: DataFrame | None = None) -> DataFrame:
    """KEYS, fingerprint, edited_fingerprint and open of each of rows, or of those in only (bucket, rn)."""
    both = with_edited(rows, after)
    if only is not None:
        both = both.join(_few(only), ["bucket", "rn"], "left_semi")
    both = both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = both.select(*KEYS, F.posexplode(F.array("text", "edited")).alias("which", "body"))
    prints = weighted_samples(both, [*KEYS, "which"], "body", n_samples, bound=bound)
    own = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    return prints.groupBy(*KEYS).agg(own(0, "fingerprint").alias("fingerprint"), own(1, "fingerprint").alias("edited_fingerprint"), F.max("open").alias("open"))


def fingerprint_report(df: DataFrame, n_samples: int = SAMPLES, bound: float | None = BOUND) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next document's.

    df: doc_id, text; other columns are ignored. One row per row of df, repeated rows included. Null doc_ids come after all
    others, by a hash of their texts; null texts count as empty. Rows with the same doc_id follow each other by text. An empty table
    gives no rows. The standard error of a likeness is sqrt(j (1 - j) / n_samples), 0.088 at most with 32 samples.
    """
    rows = in_ranges(df)
    after = next_buckets(rows)
    prints = saved(_prints(rows, after, n_samples, bound), "fingerprints")
    again = saved(prints.filter("open").select("bucket", "rn"), "fingerprints-open")
    if not again.isEmpty():
        # their ranges, and those that hold the last rows' next documents
        own = again.select("bucket").distinct()
        needed = saved(own.union(own.join(after, "bucket").select(F.col("next_bucket").alias("bucket"))).distinct(), "fingerprints-ranges")
        settled = _prints(rows.join(_few(needed), "bucket", "left_semi"), after, n_samples, None, again)
        first, prints = prints, saved(prints.join(_few(again), ["bucket", "rn"], "left_anti").unionByName(settled), "fingerprints")
        forgotten(first)
    following = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("rn"))
    heads = prints.filter("rn = 1").select(F.col("bucket").alias("next_bucket"), F.col("fingerprint").alias("head"))
    heads = after.join(heads, "next_bucket").select("bucket", "head")
    out = prints.withColumn("following", following).join(heads, "bucket", "left").withColumn("following", F.coalesce("following", "head"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint", n_samples).alias("near_edited"), likeness("fingerprint", "following", n_samples).alias("near_next"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(documents(spark, sf_dir))
