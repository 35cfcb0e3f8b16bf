"""Long repeats: bytes covered by a 50-byte string that also starts in an earlier document are removed.

The index is a logarithmic family of suffix arrays. Its entries are suffixes, of which the first `span` bytes count, in the order of
their bytes. Documents come in batches, by ascending doc_id. A batch's suffixes are sorted; the sorted batch is merge-scanned against
each level of the index, where a suffix that meets its equal is one that an earlier batch has; then it becomes the first level, and levels
merge while the next is not larger, so sizes grow geometrically. Equality is that of the bytes themselves.

The index is dealt over tasks so that equal suffixes always meet, and each task has a family of its own. Only suffixes that may have an
equal are sent. A window of `span` bytes is assigned to its minimizer (the place with the smallest hash of `gram` bytes in it), so equal
windows choose the same place in them. The run of windows with one minimizer is a stretch. First, hashes of the stretches' grams
are counted; a stretch whose gram no other document has cannot share a window. The bytes of the others go to the task of their gram, each
different stretch once for a chunk of documents, and one bit for each window comes back. A gram with very many different stretches
would fill its task, so those windows are sent one by one, to tasks by their own hashes.

Hashes only choose places and tasks; two strings with one hash cost time, and don't count as equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULLS, documents, with_ranges

SPAN = 50
GRAM = 20
#: Bytes of text of a chunk, about (a longer document is a chunk of its own), and of those whose windows one task may get.
CHUNK_BYTES = 4_000_000
TASK_BYTES = 4_000_000
#: Windows of a batch, at least, and the part of a task's windows that makes one.
BATCH_WINDOWS = 50_000
BATCHES = 8
#: Different stretches, summed over chunks, from which a gram's windows are dealt one by one.
HOT = 4096

_rng = np.random.default_rng(20240607)
_VALUES = _rng.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(0, 2**64, dtype=np.uint64)) // 8 * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:  # doubling
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 2**64))
        have += take
    return out


_kept: dict[str, np.ndarray] = {"up": _powers(1024, _BASE), "down": _powers(1024, _INVERSE)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


class Text:
    """Hashes of the windows of one text's bytes."""

    def __init__(self, data: bytes):
        n = self.n = len(data)
        if len(_kept["up"]) < n + 1:
            _kept["up"], _kept["down"] = _powers(2 * n, _BASE), _powers(2 * n, _INVERSE)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[np.frombuffer(data, np.uint8)] * _kept["up"][:n], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Hash of each window of length bytes."""
        count = self.n - length + 1
        return (self.sums[length:] - self.sums[:count]) * _kept["down"][:count]


def stretches(text: Text, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first and last window and the gram's hash, of each run of windows with one minimizer. Empty for texts shorter than a span."""
    if text.n < span:
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64)
    grams = text.every(gram)
    order = _mixed(grams)
    width = span - gram + 1
    best, at, have = order, np.arange(len(order), dtype=np.int32), 1
    while have < width:  # leftmost smallest of twice as many, and at last of overlapping halves
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        at = np.where(right < left, at[step:], at[: len(at) - step])
        best = np.minimum(left, right)
        have += step
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    return first, last, _mixed(order[at[first]])  # mixed again: the smallest hashes are not evenly spread


def _tasks(keys: np.ndarray, n: int) -> np.ndarray:
    """Task numbers of keys: ranges of the key."""
    return (keys >> np.uint64(32)).astype(np.int64) * n >> 32


class Chunk:
    """A chunk's documents (sorted by id) and what to ask about."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids, self.data = ids, texts
        parts = [stretches(Text(t)) for t in texts]
        self.doc = np.repeat(np.arange(len(ids)), [len(p[0]) for p in parts])
        self.first, self.last, self.gram = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(3))
        # of documents with one id, none is earlier than another
        same = [i > 0 and ids[i] == ids[i - 1] for i in range(len(ids))]
        self.rank = np.cumsum(~np.array(same, bool)) - 1 if ids else np.empty(0, np.int64)
        self.grams, self.own = np.unique(self.gram, return_inverse=True) if len(self.gram) else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def gram_counts(self) -> np.ndarray:
        """Of each different gram, twice the number of its stretches, and 1 more if two documents here have it."""
        n = np.bincount(self.own, minlength=len(self.grams))
        ranks = self.rank[self.doc] if len(self.doc) else self.doc
        low, high = np.full(len(self.grams), 2**62), np.full(len(self.grams), -1)
        np.minimum.at(low, self.own, ranks)
        np.maximum.at(high, self.own, ranks)
        return (2 * np.minimum(n, 2**30) + (low < high)).astype(np.uint32)

    def asked(self, shared: np.ndarray, hot: np.ndarray, n: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different pieces of text to ask about, in the order they come in: their bytes, tasks and first documents' ranks; of each place of each: which, document, first window."""
        known: dict[bytes, int] = {}
        pieces: list[bytes] = []
        tasks: list[int] = []
        ranks: list[int] = []
        which, docs, firsts = [], [], []
        gram_tasks = _tasks(self.grams, n).tolist()
        chosen = np.flatnonzero((shared | hot)[self.own]) if len(self.own) else np.empty(0, np.int64)
        split = hot[self.own[chosen]]
        rank = self.rank.tolist()
        for d, f, e, g, each in zip(self.doc[chosen].tolist(), self.first[chosen].tolist(), (self.last[chosen] + SPAN).tolist(), self.own[chosen].tolist(), split.tolist(), strict=True):
            data = self.data[d]
            for start, end in ((i, i + SPAN) for i in range(f, e - SPAN + 1)) if each else ((f, e),):
                piece = data[start:end]
                at = known.get(piece)
                if at is None:
                    at = known[piece] = len(pieces)
                    pieces.append(piece)
                    tasks.append(-1 if each else gram_tasks[g])
                    ranks.append(rank[d])
                which.append(at)
                docs.append(d)
                firsts.append(start)
        dealt = np.array(tasks, np.int64)
        alone = np.flatnonzero(dealt < 0)
        if len(alone):
            windows = np.frombuffer(b"".join([pieces[i] for i in alone.tolist()]), np.uint8).reshape(-1, SPAN)
            dealt[alone] = _tasks(_mixed((_VALUES[windows] * _kept["up"][:SPAN]).sum(1, dtype=np.uint64)), n)
        return pieces, dealt, np.array(ranks, np.int64), np.array(which, np.int64), np.array(docs, np.int64), np.array(firsts, np.int64)


class Family:
    """Levels of sorted different suffixes, each of `span` bytes; a level merges with the next while that is not larger."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def holds(self, batch: np.ndarray) -> np.ndarray:
        """Merge scan of a sorted batch of different suffixes against each level."""
        found = np.zeros(len(batch), bool)
        for level in self.levels:
            both = np.concatenate((level, batch))
            order = np.argsort(both, kind="stable")  # two sorted runs are merged; of equal ones, the level's comes first
            merged = both[order]
            found[order[1:][merged[1:] == merged[:-1]] - len(level)] = True
        return found

    def add(self, batch: np.ndarray) -> None:
        """A sorted batch of different suffixes, none of which is held."""
        if not len(batch):
            return
        while self.levels and len(self.levels[-1]) <= len(batch):
            batch = np.sort(np.concatenate((self.levels.pop(), batch)), kind="stable")  # two sorted runs: one merge
        self.levels.append(batch)


def suffixes(pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first SPAN bytes of each suffix that has as many, of pieces one after the other (uint8), and the piece of each."""
    windows = sizes - SPAN + 1
    of = np.repeat(np.arange(len(sizes)), windows)
    starts = np.cumsum(sizes) - sizes
    place = starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    return np.ascontiguousarray(sliding_window_view(pieces, SPAN)[place]).view(f"S{SPAN}").ravel(), of


def batch_array(strings: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of a batch: the different suffixes in order, which of them each string is, and whether a smaller doc has it too."""
    by_doc = np.argsort(docs, kind="stable")
    order = by_doc[np.argsort(strings[by_doc], kind="stable")]
    ordered = strings[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], which, docs > docs[order[new]][which]


COUNTED = "task long, chunk long, grams binary"
ASKED = "task long, chunk long, sizes binary, ranks binary, bytes binary"
ANSWER = "chunk long, task long, bits binary"


def _gram_answers(counted: DataFrame) -> DataFrame:
    """For each gram of each chunk, in their order, two bits: another document has it; it has too many stretches for one task."""
    most = HOT

    def run(table: pa.Table) -> pa.Table:
        keys, counts, ends = [], [], []
        for blob in table["grams"]:
            data = np.frombuffer(blob.as_py(), np.uint8)
            n = len(data) // 8
            keys.append(data[: 4 * n].view(np.uint32))
            counts.append(data[4 * n :].view(np.uint32))
            ends.append(n)
        own, which = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.concatenate(counts)
        several = np.bincount(which, 1 + (count & 1), len(own)) > 1
        hot = (several & (np.bincount(which, count >> 1, len(own)) > most))[which]
        several = several[which]
        edges = np.cumsum([0, *ends])
        bits = [np.packbits(np.concatenate((several[a:b], hot[a:b]))).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"chunk": table["chunk"], "task": table["task"], "bits": pa.array(bits, pa.binary())})

    return counted.groupBy("task").applyInArrow(run, ANSWER)


def _family_answers(asked: DataFrame) -> DataFrame:
    """Each task's chunks in order through its family. For each piece's windows in their order a bit: an earlier document has it."""
    least, parts = BATCH_WINDOWS, BATCHES

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        # a piece that an earlier chunk has as a whole is repeated throughout; suffixes of the others only go through the family
        known: set[bytes] = set()
        sizes, whole, pieces, ranks = [], [], [], []
        for i, (size, rank, text) in enumerate(zip(table["sizes"], table["ranks"], table["bytes"], strict=True)):
            own, data = np.frombuffer(size.as_py(), np.uint8).astype(np.int64), text.as_py()
            ends = np.cumsum(own).tolist()
            cut = [data[a:b] for a, b in zip([0, *ends], ends)]
            seen = np.fromiter(map(known.__contains__, cut), bool, len(cut))
            new = [p for p, s in zip(cut, seen.tolist(), strict=True) if not s]
            known.update(new)
            sizes.append(own)
            whole.append(seen)
            pieces.append(b"".join(new))
            ranks.append(np.frombuffer(rank.as_py(), np.uint32)[~seen].astype(np.int64) + (i << 32))
        del known
        windows = [int((n[~w] - SPAN + 1).sum()) for n, w in zip(sizes, whole, strict=True)]
        batch = max(least, sum(windows) // parts)
        family, bits, at = Family(), [], 0
        while at < len(sizes):
            end, n = at, 0
            while end < len(sizes) and (end == at or n < batch):
                n += windows[end]
                end += 1
            found = np.empty(0, bool)
            if n:
                strings, of = suffixes(np.frombuffer(b"".join(pieces[at:end]), np.uint8), np.concatenate([m[~w] for m, w in zip(sizes[at:end], whole[at:end], strict=True)]))
                different, which, found = batch_array(strings, np.concatenate(ranks[at:end])[of])
                held = family.holds(different)
                family.add(different[~held])
                found |= held[which]
            edges = np.cumsum([0, *windows[at:end]])
            for row, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True), at):
                repeated = np.repeat(whole[row], sizes[row] - SPAN + 1)
                repeated[~repeated] = found[a:b]
                bits.append(np.packbits(repeated).tobytes())
            at = end
        return pa.table({"chunk": table["chunk"], "task": table["task"], "bits": pa.array(bits, pa.binary())})

    return asked.groupBy("task").applyInArrow(run, ANSWER)


def _chunk(table: pa.Table) -> Chunk:
    rows = sorted(zip(table["doc_id"].to_pylist(), table["text"], strict=True), key=lambda r: (r[0] is None, r[0] or 0))
    return Chunk([r[0] for r in rows], [(r[1].as_py() or "").encode("utf-8", "surrogatepass") for r in rows])


def _by_task(answers: pa.Table) -> list[tuple[int, np.ndarray]]:
    return [(t, np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool)) for t, b in zip(answers["task"].to_pylist(), answers["bits"].to_pylist(), strict=True)]


def _dealt(tasks: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each task with the places of what goes to it, in order."""
    order = np.argsort(tasks, kind="stable")
    edges = np.flatnonzero(np.diff(tasks[order], prepend=-1, append=-1)) if len(order) else np.empty(0, np.int64)
    return [(int(tasks[order[a]]), order[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def removed_bytes(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row of docs (doc_id, text); kept: what is left, as bytes.

    A null text counts as empty. Null doc_ids come after all others. Rows with one doc_id are one document for each other: none is
    earlier. Texts shorter than 50 bytes lose nothing. An empty table gives no rows; columns besides doc_id and text are ignored.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    rows = with_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", size, CHUNK_BYTES)
    rows = rows.select(F.when(F.col("bucket") == NULLS, -NULLS).otherwise(F.col("bucket")).alias("chunk"), "doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(64, -(-total // TASK_BYTES))

    def count(table: pa.Table) -> pa.Table:
        chunk = _chunk(table)
        counts = chunk.gram_counts()
        # the upper half chose the task; among its grams the lower half is enough, as grams taken for one are only asked about
        parts = [(t, chunk.grams[at].astype(np.uint32).tobytes() + counts[at].tobytes()) for t, at in _dealt(_tasks(chunk.grams, n))]
        return pa.table({"task": pa.array([p[0] for p in parts], pa.int64()), "chunk": pa.array([table["chunk"][0].as_py()] * len(parts), pa.int64()), "grams": pa.array([p[1] for p in parts], pa.binary())})

    # nothing is saved in between: all is one query, in which Spark deals the texts by chunk, and the grams by task, once for all steps
    grams = _gram_answers(rows.groupBy("chunk").applyInArrow(count, COUNTED))

    def to_ask(chunk: Chunk, answers: pa.Table) -> tuple:
        shared, hot = (np.zeros(len(chunk.grams), bool) for _ in range(2))
        places = dict(_dealt(_tasks(chunk.grams, n)))
        for task, bits in _by_task(answers):
            at = places[task]
            shared[at], hot[at] = bits[: len(at)], bits[len(at) : 2 * len(at)]
        return chunk.asked(shared, hot, n)

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(5)]
        if table.num_rows:
            pieces, tasks, ranks, *_ = to_ask(_chunk(table), answers)
            for task, at in _dealt(tasks):
                own = [pieces[i] for i in at.tolist()]
                for column, value in zip(out, (task, table["chunk"][0].as_py(), bytes(map(len, own)), ranks[at].astype(np.uint32).tobytes(), b"".join(own)), strict=True):
                    column.append(value)
        types = [pa.int64()] * 2 + [pa.binary()] * 3
        return pa.table([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["task", "chunk", "sizes", "ranks", "bytes"])

    asked = rows.groupBy("chunk").cogroup(grams.groupBy("chunk")).applyInArrow(ask, ASKED)
    second = _family_answers(asked)
    both = grams.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if table.num_rows:
            chunk = _chunk(table)
            of = answers["round"].to_numpy() if answers.num_rows else np.empty(0)
            pieces, tasks, ranks, which, docs, firsts = to_ask(chunk, answers.filter(pa.array(of == 1)))
            windows = np.array([len(p) - SPAN + 1 for p in pieces], np.int64)
            starts = np.cumsum(windows) - windows
            flags = np.zeros(int(windows.sum()), bool)
            places = dict(_dealt(tasks))
            for task, bits in _by_task(answers.filter(pa.array(of == 2))):
                at = places[task]
                spread = np.repeat(starts[at], windows[at]) + np.arange(windows[at].sum()) - np.repeat(np.cumsum(windows[at]) - windows[at], windows[at])
                flags[spread] = bits[: len(spread)]
            # documents after the first that has a piece here repeat all of it
            edges = np.searchsorted(docs, np.arange(len(chunk.ids) + 1))
            for d, (doc_id, data) in enumerate(zip(chunk.ids, chunk.data, strict=True)):
                part = slice(edges[d], edges[d + 1])
                own, n_own = which[part], windows[which[part]]
                of_piece = np.arange(n_own.sum()) - np.repeat(np.cumsum(n_own) - n_own, n_own)
                gone = flags[np.repeat(starts[own], n_own) + of_piece] | np.repeat(ranks[own] < chunk.rank[d], n_own)
                at = (np.repeat(firsts[part], n_own) + of_piece)[gone]
                depth = np.zeros(len(data) + 1, np.int32)
                depth[at] += 1  # each window of a document is in one place only
                depth[at + SPAN] -= 1
                covered = np.cumsum(depth)[:-1] > 0
                kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
                spans = int(np.count_nonzero(covered[1:] & ~covered[:-1]) + (len(covered) > 0 and covered[0]))
                for column, value in zip(out, (doc_id, len(data), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    column.append(value)
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, out, types, strict=False)})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return rows.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cut, schema)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_bytes(documents(spark, sf_dir))
