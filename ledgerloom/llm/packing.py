"""Best-two-fit packing of documents into sequences.

Only lengths matter to a packing, and there are at most as many lengths as a sequence has places. So the driver gets a histogram of
lengths (at most `capacity` numbers, whatever the input's size), packs the histogram, and the executors look up where the n-th piece
of a length goes. The packing is that of one global run over all pieces, not of runs within partitions.

A bin opens with the longest piece left and is filled greedily with the longest that fit. Then its smallest piece is taken out if
two unpacked pieces together fill the gap, with that piece's place, more tightly; the one taken out is unpacked again. A filled bin
is repeated while the pieces last: with the same lengths at hand, the same choices would be made again.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, saved
from .tokens import Encoder, encoder, few_rows

CAPACITY = 1024
END = 2
#: Rows of a length that one task may number.
RANKED = 500_000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, longest first; number of such bins), for counts of pieces by length (1 to capacity)."""
    left = {k: n for k, n in counts.items() if n > 0}
    order = sorted(left)
    bins = []

    def largest(most: int, used: dict[int, int], but: int = 0) -> int:
        """The longest length of at most most of which some are left besides those used; 0 if none."""
        i = bisect_right(order, most) - 1
        while i >= 0 and (order[i] == but or left[order[i]] <= used.get(order[i], 0)):
            i -= 1
        return order[i] if i >= 0 else 0

    while order:
        used: dict[int, int] = {}
        gap = capacity
        while gap and (k := largest(gap, used)):
            used[k] = used.get(k, 0) + 1
            gap -= k
        if gap and sum(used.values()) > 1:
            small = min(used)
            used[small] -= 1
            room, best = gap + small, (small, 0, 0)
            for a in reversed(order[: bisect_right(order, room - 1)]):
                if 2 * a <= best[0]:
                    break
                if left[a] <= used.get(a, 0):
                    continue
                used[a] = used.get(a, 0) + 1
                b = largest(min(a, room - a), used)
                used[a] -= 1
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
            for k in best[1:] if best[1] else (small,):
                used[k] = used.get(k, 0) + 1
            used = {k: n for k, n in used.items() if n}
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                order.remove(k)
        bins.append((tuple(k for k in sorted(used, reverse=True) for _ in range(used[k])), times))
    return bins


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length of each kind of bin: the rank of its first piece, the first bin's number, how many a bin holds, and their offset; sorted by length and rank."""
    rows, ranks, first = [], {}, 0
    for lengths, times in bins:
        at = 0
        for k in dict.fromkeys(lengths):
            n = lengths.count(k)
            rows.append((k, ranks.get(k, 0), first, n, at))
            ranks[k] = ranks.get(k, 0) + n * times
            at += n * k
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T, strict=True))


def located(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of the rank-th piece (from 0) of each length."""
    key = lambda k, r: (k << np.int64(48)) | r
    at = np.searchsorted(key(table["length"], table["rank"]), key(length, rank), "right") - 1
    n = rank - table["rank"][at]
    return table["sequence"][at] + n // table["each"][at], table["offset"][at] + n % table["each"][at] * length


def pieces(docs: DataFrame, make: Callable[[], Encoder], capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of docs' (doc_id, text), each text's ids followed by end.

    Only a document of more than capacity ids is cut, into pieces of capacity; the first piece may be shorter. A null text counts as
    empty and so has just the end id. make: called in each task, gives what encodes texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for batch in few_rows(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode.batch(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                start = 0
                stop = len(ids) % capacity or capacity
                n = 0
                while start < len(ids):
                    own = ids[start:stop].tobytes()
                    rows.append((doc, n, start, stop - start, zlib.crc32(own), own if with_ids else b""))
                    n, start, stop = n + 1, stop, stop + capacity
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, length and any others) with sequence_id and offset; each sequence is gapless from 0 and at most capacity long.

    One row per row of parts; repeated rows are pieces of their own. An empty table gives no rows. Pieces of one length are numbered
    in ranges of bounded size, so that a length with most of the rows doesn't meet in one task. parts is read three times: pass a saved table.
    """
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    table = places(plan(counts, capacity))
    share = max(1, -(-max(counts.values(), default=1) // RANKED)) * 8
    # pieces that agree in all of these are alike, so it doesn't matter which of them is which
    known = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in parts.columns]
    dealt = parts.withColumn("_part", F.pmod(F.xxhash64(*known), F.lit(share)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "_part").agg(F.count("*").alias("n"))
    firsts = firsts.select(F.col("length").alias("_length"), F.col("_part").alias("_of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_part").orderBy(*known)
    ranked = dealt.withColumn("_nth", F.row_number().over(within) - 1)
    ranked = ranked.join(firsts, (F.col("length") == F.col("_length")) & (F.col("_part") == F.col("_of")))
    ranked = ranked.select(*parts.columns, (F.col("_first") + F.col("_nth")).alias("_rank"))
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            sequence, offset = located(table, length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = parts.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, ids array<long>, doc_ids) of packed pieces with their ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in sorted(x, key=lambda p: p["offset"])), "<u4").astype(np.int64) for x in batch.column(1).to_pylist()]
            docs = [[p["doc_id"] for p in sorted(x, key=lambda p: p["offset"])] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(docs, pa.list_(pa.int64()))], ["sequence_id", "ids", "doc_ids"])

    grouped = rows.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "doc_id", "ids")).alias("_p"))
    return grouped.mapInArrow(run, "sequence_id long, ids array<long>, doc_ids array<long>")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """docs' (doc_id, text) as packed pieces; see pieces() and packed()."""
    return packed(saved(pieces(docs, lambda: encoder(tokenizer), capacity, end, with_ids), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_tokenizer())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the sequences' pieces. Null texts are empty documents, null ids and repeated rows documents of their own; an empty table gives no pieces."""
    return pack_documents(docs, default_tokenizer())
