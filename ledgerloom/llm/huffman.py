"""Token ids as binary files: canonical length-limited Huffman codes from global counts, decoded by tables in independent blocks.

A file holds consecutive documents, by ascending doc_id. Each document's ids are one block: its bits start at a whole byte, and every
STRIDE ids the block's bit offset is kept, so decoding can start at any of those checkpoints. Codes are canonical, so the code
lengths alone, one byte for each id, give the code; they are the same for all files and stand in each of them.

Layout of a file, little-endian: b"LLH1", u32 code lengths, u32 documents, u64 ids, u32 stride, u8 longest code; the code lengths
(u8 each); for each document: i64 doc_id, u8 whether doc_id is null, u32 ids, u64 first byte of its bits; for each checkpoint, in
order, u32 its bit offset from its document's first byte; then the bits, of which the highest of a byte comes first.

Files travel as rows (file, content) so that Spark alone writes and reads them, in any store that Spark knows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, forgotten, saved
from .tokens import Encoder, encoder, few_rows

STRIDE = 256
LONGEST = 20
END = 2
#: Documents of a file at most.
FILE_DOCS = 512
_HEAD = "<4sIIQIB"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of the best prefix code of at most longest bits for symbols by their counts (package-merge); 0 for those that never occur."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(symbols) == 1:
        lengths[symbols] = 1
    if len(symbols) < 2:
        return lengths
    if len(symbols) > 1 << longest:
        raise ValueError("too many symbols for codes of this length")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    weights = counts[order].astype(np.int64)
    # rows: in each round, how the merged list is made up (True: a symbol, False: a package of two of the round before)
    rounds, packages = [], np.empty(0, np.int64)
    for _ in range(longest):
        merged = np.concatenate((weights, packages))
        own = np.concatenate((np.ones(len(weights), bool), np.zeros(len(packages), bool)))
        place = np.argsort(merged, kind="stable")
        merged, own = merged[place], own[place]
        rounds.append(own)
        even = len(merged) // 2 * 2
        packages = merged[:even].reshape(-1, 2).sum(1)
    take = 2 * (len(symbols) - 1)
    used = np.zeros(len(symbols), np.int64)
    for own in reversed(rounds):
        n = int(np.count_nonzero(own[:take]))  # the n lightest symbols get one bit more
        used[:n] += 1
        take = 2 * (take - n)
    lengths[order] = used
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by symbol, and the symbols in the order of their codes: by length, then by symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        longest = int(lengths[order[-1]])
        steps = np.uint64(1) << (longest - lengths[order].astype(np.int64)).astype(np.uint64)
        starts = np.cumsum(steps) - steps
        codes[order] = starts >> (longest - lengths[order].astype(np.int64)).astype(np.uint64)
    return codes, order


def table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each string of `longest` bits: the symbol it begins with and that one's length."""
    _, order = canonical(lengths)
    longest = int(lengths.max(initial=0))
    each = 1 << (longest - lengths[order].astype(np.int64))
    symbols, sizes = np.repeat(order, each).astype(np.uint32), np.repeat(lengths[order], each)
    spare = (1 << longest) - len(symbols)
    return np.append(symbols, np.zeros(spare, np.uint32)), np.append(sizes, np.ones(spare, np.uint8)), longest


def encoded(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """The bits of one block, and the bit offset of every stride-th id."""
    size = lengths[ids].astype(np.int64)
    if len(size) and not size.all():
        raise ValueError("an id without a code")
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ends) else 0
    # each code falls into one 32-bit word, or into two
    word, low = at >> 5, at & 31
    shifted = codes[ids] << (64 - low - size).astype(np.uint64)
    words = np.zeros((total >> 5) + 2, np.uint64)
    firsts = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1)) if len(ids) else np.empty(0, np.int64)
    if len(ids):
        words[word[firsts]] = np.bitwise_or.reduceat(shifted >> np.uint64(32), firsts)
        # only the last code of a word can reach into the next
        lasts = np.append(firsts[1:] - 1, len(ids) - 1)
        words[word[lasts] + 1] |= shifted[lasts] & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: (total + 7) >> 3], at[::stride].astype(np.uint32)


def decoded(bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, steps: np.ndarray, longest: int) -> np.ndarray:
    """Ids of all segments, one after the other: all segments' n-th ids are looked up together. starts: bit offsets; sizes: ids of each."""
    padded = np.concatenate((bits, np.zeros(8, np.uint8)))
    out = np.empty(int(sizes.sum()), np.uint32)
    base = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")  # those that go on are a head of the list
    at, base, left = starts[order].astype(np.int64), base[order], sizes[order]
    active = len(order)
    mask, top = np.int64((1 << longest) - 1), 40 - longest
    for n in range(int(left[0]) if active else 0):
        active = int(np.searchsorted(-left, -n, "left"))
        now = at[:active]
        byte = now >> 3
        window = np.zeros(active, np.int64)
        for k in range(5):
            window = window << 8 | padded[byte + k]
        code = window >> (top - (now & 7)) & mask
        out[base[:active] + n] = symbols[code]
        at[:active] += steps[code]
    return out


def file_bytes(docs: list[tuple[int | None, np.ndarray]], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """One file of (doc_id, ids) in order."""
    rows, points, bits, at = [], [], [], 0
    for doc, ids in docs:
        own, offsets = encoded(ids, lengths, codes)
        rows.append(struct.pack("<qBIQ", doc or 0, doc is None, len(ids), at))
        points.append(offsets.astype("<u4").tobytes())
        bits.append(own)
        at += len(own)
    head = struct.pack(_HEAD, b"LLH1", len(lengths), len(docs), sum(len(ids) for _, ids in docs), STRIDE, int(lengths.max(initial=0)))
    return b"".join((head, lengths.tobytes(), *rows, *points, *bits))


def read_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, number of ids of each, and all ids."""
    magic, n_codes, n_docs, n_ids, stride, _ = struct.unpack_from(_HEAD, content)
    if magic != b"LLH1":
        raise ValueError("not a file of this format")
    at = struct.calcsize(_HEAD)
    lengths = np.frombuffer(content, np.uint8, n_codes, at)
    rows = np.frombuffer(content, np.dtype([("doc", "<i8"), ("null", "u1"), ("n", "<u4"), ("byte", "<u8")]), n_docs, at + n_codes)
    at += n_codes + rows.nbytes
    segments = (rows["n"].astype(np.int64) + stride - 1) // stride
    points = np.frombuffer(content, "<u4", int(segments.sum()), at)
    bits = np.frombuffer(content, np.uint8, offset=at + points.nbytes)
    starts = points.astype(np.int64) + np.repeat(rows["byte"].astype(np.int64) * 8, segments)
    sizes = np.full(len(points), stride, np.int64)
    lasts = np.cumsum(segments) - 1
    sizes[lasts[segments > 0]] = (rows["n"].astype(np.int64) - (segments - 1) * stride)[segments > 0]
    ids = decoded(bits, starts, sizes, *table(lengths)) if n_ids else np.empty(0, np.uint32)
    return [None if x else int(d) for d, x in zip(rows["doc"], rows["null"], strict=True)], rows["n"].astype(np.int64), ids


def encoded_once(docs: DataFrame, make: Callable[[], Encoder], end: int = END) -> DataFrame:
    """(doc_id, wide, ids) of docs' (doc_id, text), saved: little-endian ids with the end id, of two bytes each, or of four where wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for batch in few_rows(batches):
            own = [np.append(ids, np.uint32(end)) for ids in encode.batch(batch.column(1))]
            wide = [int(x.max()) > 0xFFFF for x in own]
            ids = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(own, wide, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wide, pa.bool_()), pa.array(ids, pa.binary())], ["doc_id", "wide", "ids"])

    return saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, wide boolean, ids binary"), "token-ids")


def _ids(wide: pa.Scalar, ids: pa.Scalar) -> np.ndarray:
    return np.frombuffer(ids.as_buffer(), "<u4" if wide.as_py() else "<u2")


def id_counts(rows: DataFrame, end: int = END) -> np.ndarray:
    """How often each id occurs in all rows (wide, ids); its size is that of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            for own in map(np.bincount, map(_ids, batch.column(0), batch.column(1))):
                if len(own) > len(counts):
                    counts = np.append(counts, np.zeros(len(own) - len(counts), np.int64))
                counts[: len(own)] += own
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    counted = rows.select("wide", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row for each id of the vocabulary at most
    counts = np.zeros(max(counted["id"].max() + 1 if len(counted) else 0, end + 1), np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return counts


def write_files(docs: DataFrame, make: Callable[[], Encoder], end: int = END, longest: int = LONGEST) -> DataFrame:
    """(file, content): files in ascending doc_id order, saved. docs: doc_id, text; null texts count as empty, null doc_ids come last.

    Each text is encoded once; its ids are counted and coded from where they are saved. Documents are dealt by ranges of doc_id that
    Spark samples, so ids may be spread as they like. Rows with one doc_id are in the order of their ids. An empty table gives no file.
    """
    rows = encoded_once(docs, make, end)
    lengths = code_lengths(id_counts(rows, end), longest)
    codes, _ = canonical(lengths)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = []
            for ids in map(_ids, batch.column(1), batch.column(2)):
                bits, points = encoded(ids, lengths, codes)
                coded.append(struct.pack("<I", len(ids)) + points.tobytes() + bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.binary())], ["doc_id", "coded"])

    coded = saved(rows.mapInArrow(code, "doc_id long, coded binary"), "token-codes")
    forgotten(rows)

    def joined(docs: list[tuple[int | None, bytes]]) -> bytes:
        heads, points, bits, at, total = [], [], [], 0, 0
        for doc, own in docs:
            (n,) = struct.unpack_from("<I", own)
            cut = 4 + 4 * -(-n // STRIDE)
            heads.append(struct.pack("<qBIQ", doc or 0, doc is None, n, at))
            points.append(own[4:cut])
            bits.append(own[cut:])
            at += len(own) - cut
            total += n
        head = struct.pack(_HEAD, b"LLH1", len(lengths), len(docs), total, STRIDE, int(lengths.max(initial=0)))
        return b"".join((head, lengths.tobytes(), *heads, *points, *bits))

    size = FILE_DOCS

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # ranges are numbered in their order
        waiting: list[tuple[int | None, bytes]] = []

        def file(own: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([joined(own)], pa.binary())], ["file", "content"])

        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                waiting.append((doc, own.as_py()))
                if len(waiting) == size:
                    yield file(waiting)
                    waiting = []
        if waiting:
            yield file(waiting)

    order = (F.col("doc_id").isNull(), F.col("doc_id"))
    files = saved(coded.repartitionByRange(*order).sortWithinPartitions(*order, "coded").mapInArrow(join, "file long, content binary"), "token-files")
    forgotten(coded)
    return files


def read_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the files' contents; start: ids of all documents before it."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [struct.unpack_from(_HEAD, memoryview(x.as_buffer()))[3] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["file", "n"])

    sizes = files.mapInArrow(size, "file long, n long").withColumn("up", F.expr("file div 4294967296L"))
    # running sums within the files of a range, and over the ranges
    groups = sizes.groupBy("up").agg(F.sum("n").alias("n"))
    groups = groups.select("up", (F.sum("n").over(Window.orderBy("up")) - F.col("n")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("up").orderBy("file")) - F.col("n")
    starts = sizes.select("up", F.col("file").alias("of"), within.alias("within")).join(groups, "up").select("of", (F.col("before") + F.col("within")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, counts, ids = read_file(content.as_py())
                ends = np.cumsum(counts)
                own = [ids[e - n : e].astype("<u4").tobytes() for n, e in zip(counts, ends, strict=True)]
                arrays = [pa.array(docs, pa.int64()), pa.array(base + ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays[: 4 + with_ids], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return files.join(starts, files["file"] == starts["of"]).select("base", "content").mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_tokenizer()
    return read_files(write_files(documents(spark, sf_dir), lambda: encoder(path)))
