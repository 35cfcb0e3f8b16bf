"""Helpers shared by the corpus operators: shared-folder tables, words, and ordered neighbours without a global sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is named and all runs on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages don't recompute it, and a lost executor loses none of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forgotten(*tables: DataFrame) -> None:
    """Remove saved tables that nothing will read again: all that came of them has been saved in turn."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: Column) -> Column:
    """array<string> of the words of a text; null and blank texts have none. Replacing five characters and splitting at one is several times as fast as a regular expression."""
    return F.array_remove(F.split(spaced(text), " "), "")


def spaced(text: Column) -> Column:
    """The text with each of the white-space characters as a space; null as empty."""
    text = F.coalesce(text, F.lit(""))
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def without(text: Column, characters: str) -> Column:
    """The text without each of the characters; several times as fast as translate()."""
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


#: Ranges that are cut again at a time, and so rows sent to every executor, at most.
CUT = 65_536
#: The range of null keys, below all others.
NULLS = -(2**62)


def _div(a: int, b: int) -> int:
    """As SQL's div: towards zero."""
    return a // b if a >= 0 else -(-a // b)


def with_ranges(df: DataFrame, key: str, size: Column, per_range: int) -> DataFrame:
    """df with `bucket`: the number of its row's range of an integer key. Rows' order by key is their ranges' order.

    size is summed over rows. Ranges are of equal width first, so that they would hold per_range each if keys were evenly spread. Ranges
    whose measured sum is over twice that are cut again, by the spread of the keys in them, until none is left that holds two keys; so
    far-off keys, or keys close together, don't fill one range. One key is never cut. Null keys have a range of their own.
    """
    measured = df.select(F.col(key).cast("long").alias("_k"), size.cast("long").alias("_n"))
    low, high, total = measured.agg(F.min("_k"), F.max("_k"), F.sum(F.when(F.col("_k").isNotNull(), F.col("_n")))).first()
    if low is None:
        return df.withColumn("bucket", F.lit(NULLS))
    # half of 64 bits' range at most, so that no number overflows
    width = min(max(1, -(-(high - low + 1) * per_range // max(total, 1))), 2**62)
    steps: list[tuple[DataFrame, int]] = []

    def numbered(rows: DataFrame, key: str) -> DataFrame:
        rows = rows.withColumn("bucket", F.expr(f"`{key}` div {width}L") - F.lit(_div(low, width)))
        for table, fan in steps:
            part = F.coalesce(F.expr(f"`{key}` div _width") - F.col("_first"), F.lit(0))
            rows = rows.join(F.broadcast(table), F.col("bucket") == F.col("_of"), "left").withColumn("bucket", F.col("bucket") * fan + part).drop("_of", "_width", "_first")
        return rows

    most = _div(high, width) - _div(low, width) + 1  # numbers start at 0
    while True:
        sums = numbered(measured.filter("_k is not null"), "_k").groupBy("bucket").agg(F.sum("_n").alias("n"), F.min("_k").alias("low"), F.max("_k").alias("high"))
        full = sums.filter((F.col("n") > 2 * per_range) & (F.col("low") < F.col("high"))).orderBy(F.desc("n"), "bucket").limit(CUT).collect()
        cuts, fan = [], 1
        for r in full:
            own = -(-(r["high"] - r["low"] + 1) // -(-r["n"] // per_range))
            first = _div(r["low"], own)
            cuts.append((r["bucket"], own, first))
            fan = max(fan, _div(r["high"], own) - first + 1)
        if not cuts or (most + 1) * fan >= 2**62:  # beyond that, ranges could not be numbered
            break
        most = (most + 1) * fan
        steps.append((df.sparkSession.createDataFrame(cuts, "_of long, _width long, _first long"), fan))
    return numbered(df, key).withColumn("bucket", F.coalesce("bucket", F.lit(NULLS)))


def next_buckets(buckets: DataFrame) -> DataFrame:
    """(bucket) -> (bucket, next_bucket), saved: the next lower range that holds rows, the highest after the lowest. Numbers are dealt by ranges that Spark samples, so one task sees only a row for each of those."""
    dealt = saved(buckets.select("bucket").distinct().repartitionByRange("bucket").withColumn("up", F.spark_partition_id()), "ranges")
    inner = dealt.withColumn("next_bucket", F.lead("bucket").over(Window.partitionBy("up").orderBy(F.desc("bucket"))))
    tops = dealt.groupBy("up").agg(F.max("bucket").alias("top"))
    order = Window.orderBy(F.desc("up"))
    tops = tops.select("up", F.coalesce(F.lead("top").over(order), F.max("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    out = saved(inner.join(tops, "up").select("bucket", F.coalesce("next_bucket", "after").alias("next_bucket")), "next-ranges")
    forgotten(dealt)
    return out


def filtered(df: DataFrame, condition: Column) -> DataFrame:
    """df.filter(condition) for a condition on long chains of computed columns.

    A filter is pushed below the columns it reads, where each of their expressions stands in it as often as it is referred to; over a
    chain, that grows exponentially. A row number that the filter reads too is not deterministic, so the filter stays above.
    """
    return df.withColumn("_row", F.monotonically_increasing_id()).filter(condition & (F.col("_row") >= 0)).drop("_row")
