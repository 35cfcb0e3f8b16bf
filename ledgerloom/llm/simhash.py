"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints link at two or fewer differing bits. A 64-bit fingerprint is cut into two segments of 32 bits: of two linked ones, some
segment differs in at most one bit. Each segment is indexed under its 32 variants with one bit deleted (a wildcard), so linked
fingerprints always meet under an equal (segment, deleted bit, rest) key. Rows are dealt by that key and met by equality; those that
meet are verified by their differing bits.

Only distinct fingerprints are indexed: copies of a text are one row, however many there are. Within a key, no list of pairs is
made: a few fingerprints are compared directly, and many by sorting them under each way to delete up to two bits, where neighbours
that are equal are linked. Each key gives at most (fingerprints - 1) links, which join the same groups as all its pairs would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forgotten, saved

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Up to so many fingerprints of a key are compared with each other; more are sorted.
DIRECT = 48


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles; a text with fewer words has its whole sequence as one, one without words gets 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n < 2:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp) for each row, fp as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, fp long")


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints: each of the two 32-bit segments, with each of its bits deleted. A key holds the segment's number, the deleted bit and the other 31 bits."""
    keys = []
    for segment in range(2):
        part = (fps >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
        for bit in range(32):
            keys.append((part & ~np.uint64(1 << bit)) | np.uint64((32 * segment + bit) << 32))
    return np.concatenate(keys), np.tile(fps, 64)


class _Forest:
    """Union of n numbered items; links() joins each to the first of its group."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            while True:
                roots = self.up[self.up]
                if np.array_equal(roots, self.up):
                    break
                self.up = roots
            a, b = self.up[a], self.up[b]
            a, b = np.minimum(a, b), np.maximum(a, b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, b, a)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        while True:
            roots = self.up[self.up]
            if np.array_equal(roots, self.up):
                break
            self.up = roots
        away = np.flatnonzero(self.up != np.arange(len(self.up)))
        return self.up[away], away


def links_within(fps: np.ndarray, deleted: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what differs in at most two bits among sorted distinct fingerprints of one key; deleted: the key's bit, 0 to 63."""
    n = len(fps)
    if n <= DIRECT:
        a, b = np.triu_indices(n, 1)
        near = _differing(fps[a], fps[b]) <= DISTANCE
        a, b = a[near], b[near]
        if len(a) < 2:
            return fps[a], fps[b]
        forest = _Forest(n)
        forest.join(a, b)
    else:
        # they agree in the rest of the key's segment: the deleted bit and those of the other segment may differ
        free = [deleted] + [b for b in range(64) if b // 32 != deleted // 32]
        forest = _Forest(n)
        for i, x in enumerate(free):
            for y in free[i + 1 :]:
                masked = fps & ~np.uint64((1 << x) | (1 << y))
                order = np.argsort(masked, kind="stable")
                same = masked[order[1:]] == masked[order[:-1]]
                forest.join(order[:-1][same], order[1:][same])
    a, b = forest.links()
    return fps[a], fps[b]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by both -> links. A key may span batches: its last rows wait for the next."""
    keys, fps = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def found(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(keys)]))
        size = ends - starts
        pairs = starts[size == 2]  # nearly all that meet are two
        near = _differing(fps[pairs], fps[pairs + 1]) <= DISTANCE
        a, b = [fps[pairs[near]]], [fps[pairs[near] + 1]]
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            x, y = links_within(np.sort(fps[s:e]), int(keys[s]) >> 32)
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k, f = (np.asarray(batch.column(i)).view(np.uint64) for i in range(2))
        if k[-1] == (waiting[0][0][0] if waiting else k[0]):  # one key so far
            waiting.append((k, f))
            continue
        cut = int(np.searchsorted(k.view(np.int64), k.view(np.int64)[-1]))
        keys, fps = (np.concatenate([w[i] for w in waiting] + [x[:cut]]) for i, x in enumerate((k, f)))
        waiting = [(k[cut:], f[cut:])]
        if len(keys):
            yield found(keys, fps)
    if waiting:
        yield found(*(np.concatenate([w[i] for w in waiting]) for i in range(2)))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints, column fp, that connect all that differ in at most two bits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(fps), 2048):
                keys, own = variants(fps[at : at + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (keys, own)], ["key", "fp"])

    # each becomes 64 rows: dealt out before, as a few small partitions would become a few large ones
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.select("fp").repartition(n, "fp").mapInArrow(spread, "key long, fp long")
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_meet, "a long, b long")


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): every node of edges (a, b) with the smallest node it is connected to.

    Large-star and small-star rounds: each round links nodes to the least of their neighbours, so that chains shorten
    geometrically. Each round's links are written to the shared folder, and the last round changes nothing. The least neighbours are
    written too: the links of a node with very many are then all that a join deals by it, and can be split.
    """
    edges = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = saved(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        smallest = saved(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(smallest, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        old, edges = edges, saved(small.filter("u <> v").distinct(), name)
        forgotten(old, least, large, smallest)
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            break
        before = (n, total)
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs, repeated rows included.

    component_id: the smallest doc_id reachable over links of at most two differing bits. Null, empty and blank texts have
    fingerprint zero and link like any other. Null doc_ids count as greater than all others: a group of only such rows has a null
    component_id. An empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    rows = saved(with_fingerprints(docs.select("doc_id", F.col(text).alias("text"))), "simhash")
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = saved(components(links(firsts), "simhash-links"), "simhash-roots")
    grouped = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = grouped.join(least, "root").select("fp", "component_id")
    out = rows.join(ids, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
