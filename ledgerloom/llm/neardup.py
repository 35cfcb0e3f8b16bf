"""Near-duplicates by the similarity of their shingle sets: SimHash deletion variants find candidates, the sets themselves decide.

Texts are alike if the Jaccard similarity of their sets of five-word shingles is LEAST or more. This is operator 4's method with a
fingerprint long enough for that: of two sets at 0.8, 15 % of the bits of a SimHash differ, so two segments of 64 bits would hardly ever agree.
The fingerprint has SEGMENTS segments of 24 bits. Two sets meet if some segment differs in at most one bit: they are equal under a variant
with that bit deleted. At 0.8 a segment does so with a probability of 0.103, so a pair is missed with one of 0.897 ** 64 = 0.001, a more
alike one with less (1 in 100,000 at 0.85). The deleted bit is in one half of the segment, so the other half is equal: rows are dealt by the
halves, and within a half the variants are formed and met by sorting. Of those that meet, CHECK more bits of the fingerprint must be near
(at 0.8, 19 of 128 differ, more than FAR never; of unlike sets 64), and then the sets are compared.

Of the sets that meet, each is compared with its smallest partner first: what a task meets at a time gives one row for each set with a
partner, the smallest and whether there are more, and those rows are brought to one for each set. What that links becomes groups. Sets that met
more partners are marked. They meet again, and what comes of it is no list of pairs, but links that connect all groups with members
whose whole fingerprints are near (at 0.8, 252 of 1664 bits differ, more than MOST in one pair of 300, at 0.82 in one of 10,000; at 0.7, 325):
a row for each group and task at most. The sets so connected are a clump. In a clump, any two sets of different groups with near fingerprints are
compared, in memory: it is cut into parts, each two parts go to one task with their sets, and each task gives links that connect what it
found alike, fewer than it has sets. So of a clump of C sets, C rows for each of its other parts are sent (PARTS at most, unless it has over PARTS * LARGEST
sets), and no pair is a row. What grows with the square of C is the time to compare fingerprints. Equal sets are one, however many texts have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forgotten, saved
from .simhash import _Forest, components

SHINGLE = 5
#: Similarity from which texts are linked, as a fraction.
LEAST = (4, 5)
SEGMENTS = 64
HALF = 12
CHECK = 128
FAR = 40
MOST = 292
RUN = 32
#: Parts of a clump: PARTS of SMALLEST sets or more; more parts if those had over LARGEST sets or SHINGLES shingles.
PARTS = 16
SMALLEST = 128
LARGEST = 4096
SHINGLES = 1 << 21
#: Index rows that a task meets at a time, at least; all of one half's value come together.
TOGETHER = 200_000
SEED = 42

def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a text with fewer words has its whole sequence as one, one without words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - SHINGLE + 1
    if n < 2:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)), np.uint64, n))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    words = (SEGMENTS * 2 * HALF + CHECK) // 64
    a, b = (rng.integers(0, 2**64, words, np.uint64) for _ in range(2))
    return a | np.uint64(1), b


def fingerprint(hashes: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> bytes:
    """SimHash of a set that is not empty: a bit is 1 if over half of the shingles' hashes have it."""
    ones = np.zeros(len(factors[0]) * 64, np.int64)
    for at in range(0, len(hashes), 255):  # sums of bytes that don't overflow, and bounded memory
        x = (hashes[at : at + 255, None] ^ factors[1]) * factors[0]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def _row(docs: DataFrame) -> Column:
    """A hash of all columns. It passes nulls over, so that their places are hashed too."""
    return F.xxhash64(F.struct(*docs.columns), *[F.col(c).isNull() for c in docs.columns])


def _identified(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text) of docs; row: a hash of all columns. Rows with equal hashes are taken as equal rows."""
    return docs.select(_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def with_fingerprints(rows: DataFrame) -> DataFrame:
    """(row, doc_id, id, n, print) for each of rows: number of the shingle set, its size and its fingerprint, null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        factors = _factors()
        for batch in batches:
            sets = [shingles(x.as_py()) for x in batch.column(2)]
            ids = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            prints = [fingerprint(s, factors) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids), sizes, pa.array(prints, pa.binary())], ["row", "doc_id", "id", "n", "print"])

    return rows.mapInArrow(run, "row long, doc_id long, id long, n long, print binary")


INDEX = "key long, rest int, id long, root long"
BITS = "c0 long, c1 long", "print binary"


def _spread(batches: Iterator[pa.RecordBatch], whole_print: bool) -> Iterator[pa.RecordBatch]:
    """(id, root, print) -> a row for each half of each segment: the half's value as the key, the other half, and bits to check, or every bit."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            n = part.num_rows
            prints = np.frombuffer(b"".join(x.as_py() for x in part.column(2)), np.uint8).reshape(n, -1)
            bits = prints[:, : SEGMENTS * 2 * HALF // 8].reshape(n, SEGMENTS, 3).astype(np.int64)
            whole = bits[:, :, 0] << 16 | bits[:, :, 1] << 8 | bits[:, :, 2]
            high, low = whole >> HALF, whole & ((1 << HALF) - 1)
            number = np.arange(SEGMENTS)[None, :] * 2
            keys = np.concatenate((number << HALF | high, (number + 1) << HALF | low), axis=1).ravel()
            rest = np.concatenate((low, high), axis=1).astype(np.int32).ravel()
            own = [pa.array(np.repeat(np.asarray(part.column(i)), 2 * SEGMENTS)) for i in range(2)]
            if whole_print:
                own.append(part.column(2).take(pa.array(np.repeat(np.arange(n), 2 * SEGMENTS))))
            else:
                check = np.ascontiguousarray(prints[:, -CHECK // 8 :]).view(np.int64)
                own += [pa.array(np.repeat(check[:, i], 2 * SEGMENTS)) for i in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rest), *own], [c.split()[0] for c in f"{INDEX}, {BITS[whole_print]}".split(", ")])


def _distances(check: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows a and b of check, some or all of the fingerprints' bits; a few rows at a time."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.bitwise_count(check[a[part]] ^ check[b[part]]).sum(1, dtype=np.int64)
    return out


def _variants(keys: np.ndarray, rest: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each deleted bit: the bit, the rows by variant and then id, and where each variant of two or more rows begins and how many it has."""
    of_id = np.argsort(ids, kind="stable")
    for bit in range(HALF):
        masked = (keys << HALF | (rest & ~(1 << bit)))[of_id]
        order = of_id[np.argsort(masked, kind="stable")]
        masked = np.sort(masked, kind="stable")
        edges = np.flatnonzero(np.diff(masked, prepend=-1)) if len(masked) else np.empty(0, np.int64)
        sizes = np.diff(edges, append=len(masked))
        yield bit, order, edges[sizes > 1], sizes[sizes > 1]


def _pairs(order: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each variant, by their distance in it."""
    for gap in range(1, int(size.max(initial=0))):
        some = size > gap
        n = size[some] - gap
        at = np.repeat(first[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield order[at], order[at + gap]


def met(keys: np.ndarray, rest: np.ndarray, ids: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ma.MaskedArray, np.ndarray]:
    """Of each id that others may be alike to, one row: the id, the smallest of these partners, and whether there may be more. Of variants with
    more than RUN sets only pairs with the first are looked at, so that all their ids may have more, or have no partner that is known."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep_near(a: np.ndarray, b: np.ndarray) -> None:
        near = _distances(check, a, b) <= FAR
        found.append((ids[a[near]], ids[b[near]]))

    marks = []
    for bit, order, first, size in _variants(keys, rest, ids):
        large = size > RUN
        for a, b in _pairs(order, first[~large], size[~large]):
            # equal segments meet under each of their variants: here only under the first half's first
            some = (rest[a] != rest[b]) | ((bit == 0) & (keys[a] >> HALF & 1 == 0))
            keep_near(a[some], b[some])
        if large.any():
            n = size[large] - 1
            at = np.repeat(first[large], n) + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keep_near(order[np.repeat(first[large], n)], order[at])
            marks += [ids[order[first[large]]], ids[order[at]]]
    a, b = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    x, y = np.append(a, b), np.append(b, a)
    order = np.lexsort((y, x))  # by id its smallest partner
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    other = ~new
    other[1:] &= y[1:] != y[:-1]
    several = np.unique(np.concatenate([*marks, x[other]]))
    alone = np.setdiff1d(several, x[new], assume_unique=True)
    one = np.ma.array(np.append(y[new], alone), mask=np.arange(new.sum() + len(alone)) >= new.sum())
    out = np.append(x[new], alone)
    return out, one, np.isin(out, several)


def connected(keys: np.ndarray, rest: np.ndarray, ids: np.ndarray, roots: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of roots, fewer than there are roots: any two with sets that meet in a variant, and differ in at most MOST bits, are connected.

    Of a variant with more than RUN sets, its first is linked to all that differ from it in at most 2 MOST bits, and those that differ
    in at most MOST bits are done with; so on with the rest. Of two near sets, when one is done with, the other is linked to the same.
    """
    names, own = np.unique(roots, return_inverse=True)
    forest = _Forest(len(names))
    for _, order, first, size in _variants(keys, rest, ids):
        if not len(first):
            continue
        large = size > RUN
        for a, b in _pairs(order, first[~large], size[~large]):
            some = own[a] != own[b]
            a, b = a[some], b[some]
            near = _distances(prints, a, b) <= MOST
            forest.join(own[a[near]], own[b[near]])
        for start, n in zip(first[large].tolist(), size[large].tolist(), strict=True):
            left = order[start : start + n]
            while len(left) > 1 and (own[left] != own[left[0]]).any():
                d = _distances(prints, left, np.full(len(left), left[0]))
                linked = own[left[d <= 2 * MOST]]
                forest.join(np.full(len(linked), own[left[0]]), linked)
                left = left[d > MOST]
    a, b = forest.links()
    return names[a], names[b]


def candidates(sets: DataFrame, apart: bool) -> DataFrame:
    """What each task gives of those of its own sets (id, root, print) that meet in a variant: (id, one, more), see met(); or if apart, (a, b), links of roots, see connected()."""
    columns = ["a", "b"] if apart else ["id", "one", "more"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        size = 0

        def pairs(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            keys, rest, ids, roots, *bits = (np.concatenate(x) for x in zip(*parts, strict=True))
            rest = rest.astype(np.int64)
            if apart:
                found = connected(keys, rest, ids, roots, np.frombuffer(b"".join(bits[0]), np.uint64).reshape(len(keys), -1))
            else:
                found = met(keys, rest, ids, np.stack([c.view(np.uint64) for c in bits], axis=1))
            return pa.RecordBatch.from_arrays(list(map(pa.array, found)), columns)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(np.array(x.to_pylist(), object) if apart and i == 4 else np.asarray(x) for i, x in enumerate(batch.columns))
            if size >= TOGETHER and new[0][0] != waiting[-1][0][-1]:
                cut = 0
            elif size >= TOGETHER and new[0][0] != new[0][-1]:
                cut = int(np.searchsorted(new[0], new[0][0], "right"))
            else:
                waiting.append(new)
                size += batch.num_rows
                continue
            yield pairs([*waiting, tuple(x[:cut] for x in new)])
            waiting, size = [tuple(x[cut:] for x in new)], batch.num_rows - cut
        if waiting:
            yield pairs(waiting)

    index = sets.select("id", "root", "print").mapInArrow(lambda batches: _spread(batches, apart), f"{INDEX}, {BITS[apart]}")
    types = ", ".join(f"{c} {'boolean' if c == 'more' else 'long'}" for c in columns)
    return index.repartition("key").sortWithinPartitions("key").mapInArrow(meet, types)


def partners(found: DataFrame) -> DataFrame:
    """(id, one, more), one row for each id of found (id, one, more), what tasks gave of it: its smallest partner of all, null if none is known, and whether there may be more."""
    least = F.min("one")
    return found.groupBy("id").agg(least.alias("one"), (F.max("more") | (least != F.max("one"))).alias("more"))


def marked_ids(first: DataFrame) -> DataFrame:
    """(id) of both sets of each pair that met, but not as a set and its smallest partner; first: partners().

    The larger set of such a pair has a smaller partner too, so it has more than one. So has the other, or the larger one is its only
    partner: then it is looked up there.
    """
    only = first.filter("not more and one > id").select(F.col("id").alias("x"), F.col("one").alias("id"))
    missed = only.join(first.select("id", "one"), "id").filter("one <> x").select(F.col("x").alias("id"))
    return first.filter("more").select("id").union(missed)


def _alike(both: Column, n: Column) -> Column:
    """Whether sets with n shingles in all and so many in both have the least similarity: both / (n - both) >= LEAST, in whole numbers."""
    over, under = LEAST
    return both * (over + under) >= n * over


def _with_shingles(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, shingles), saved, of each of members (row, id), of rows (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py()).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])

    texts = rows.join(members, "row").select("id", "text").mapInArrow(run, "id long, shingles array<long>")
    return saved(texts.groupBy("id").agg(F.first("shingles").alias("shingles")), "neardup-texts")


def links(pairs: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets are alike, saved. sets: (id, n, row), of rows (row, doc_id, text)."""
    size = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    pairs = saved(pairs.join(size("a"), "a").join(size("b"), "b").filter(_alike(F.least(n_a, n_b), n_a + n_b)), "neardup-pairs")
    members = pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct().join(sets, "id").select("row", "id")
    texts = _with_shingles(members, rows)
    own = lambda c: texts.select(F.col("id").alias(c), F.col("shingles").alias(f"s_{c}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    found = saved(pairs.join(own("a"), "a").join(own("b"), "b").filter(_alike(both, n_a + n_b)).select("a", "b"), "neardup-links")
    forgotten(pairs, texts)
    return found


def links_of_clump(ids: np.ndarray, roots: np.ndarray, prints: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links, fewer than there are roots, that connect any two sets of different roots that differ in at most MOST bits and are alike."""
    group = np.unique(roots, return_inverse=True)[1]
    a, b = [], []
    for x in range(1, len(ids)):
        other = np.flatnonzero(group[:x] != group[x])
        d = _distances(prints, other, np.full(len(other), x))
        near = other[d <= MOST][np.argsort(d[d <= MOST], kind="stable")]
        while len(near):
            y, near = near[0], near[1:]
            n = len(sets[x]) + len(sets[y])
            if _alike(min(len(sets[x]), len(sets[y])), n) and _alike(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), n):
                group[group == group[y]] = group[x]
                near = near[group[near] != group[x]]
                a.append(int(ids[y]))
                b.append(int(ids[x]))
    return a, b


def clump_links(marked: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b), saved: links that connect all sets of marked (id, root, n, row, print), of different roots, that are alike and near; see the module's text."""
    ends = saved(components(candidates(marked, True), "neardup-clumps"), "neardup-clumps")
    clumps = ends.select(F.col("node").alias("root"), F.col("root").alias("clump"))
    clumps = clumps.union(clumps.select("clump", "clump")).distinct()  # the smallest of a clump is not among its nodes
    members = saved(marked.join(clumps, "root"), "neardup-members")
    texts = _with_shingles(members.select("row", "id"), rows)
    count, total = F.count("*"), F.sum("n")
    parts = F.greatest(F.least(F.lit(PARTS), F.ceil(count / SMALLEST)), F.ceil(count / LARGEST), F.ceil(total / SHINGLES)).cast("int")
    dealt = members.join(members.groupBy("clump").agg(parts.alias("parts")), "clump").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    # with each other part; a clump of one part with that
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: (p != F.col("part")) | (F.col("parts") == 1))
    dealt = dealt.join(texts, "id").select("clump", "id", "root", "print", "shingles", "part", F.explode(others).alias("other"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        prints = np.frombuffer(b"".join(table["print"].to_pylist()), np.uint64).reshape(table.num_rows, -1)
        sets = [np.asarray(x.values) for x in table["shingles"]]
        a, b = links_of_clump(table["id"].to_numpy(), table["root"].to_numpy(), prints, sets)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = dealt.groupBy("clump", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    found = saved(blocks.applyInArrow(compare, "a long, b long"), "neardup-links")
    forgotten(ends, members, texts)
    return found


def similar_groups(docs: DataFrame) -> DataFrame:
    """(row, doc_id, group) for every row of docs (doc_id, text and any others), saved; row: a hash of all its columns.

    Rows are in one group if links connect their texts. Null, empty and blank texts have the empty set, and are one group. An empty table
    gives no rows; rows that are equal in all columns are alike.
    """
    rows = _identified(docs)
    prints = saved(with_fingerprints(rows), "neardup-prints")
    sets = saved(prints.groupBy("id").agg(F.min("n").alias("n"), F.min("row").alias("row"), F.first("print").alias("print")).filter("n > 0"), "neardup-sets")
    first = saved(partners(candidates(sets.withColumn("root", F.col("id")), False)), "neardup-first")
    found = links(first.filter("one < id").select(F.col("one").alias("a"), F.col("id").alias("b")), sets, rows)
    roots = saved(components(found, "neardup-links"), "neardup-roots")
    marks = saved(marked_ids(first), "neardup-marks")
    if not marks.isEmpty():
        marked = saved(sets.join(marks, "id").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"), "n", "row", "print"), "neardup-marked")
        found = found.union(clump_links(marked, rows))
        forgotten(marked, roots)
        roots = saved(components(found, "neardup-links"), "neardup-roots")
    groups = saved(prints.join(roots, prints["id"] == roots["node"], "left").select("row", "doc_id", F.coalesce("root", "id").alias("group")), "neardup-groups")
    forgotten(prints, sets, first, marks, roots)
    return groups


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (null, empty and blank texts are one) one document stays, that with the smallest doc_id, or with the smallest row hash where doc_ids are equal or all null."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    stay = similar_groups(docs).groupBy("group").agg(first).select(F.col("first.row").alias("_row"))
    one = Window.partitionBy("_row").orderBy(F.xxhash64("_doc"))
    rows = docs.select(_row(docs).alias("_row"), F.struct(*docs.columns).alias("_doc"))  # other columns' names may clash
    kept = rows.join(stay, "_row", "left_semi").withColumn("_nth", F.row_number().over(one))  # of equal rows, one
    return kept.filter("_nth = 1").select("_doc.*")
