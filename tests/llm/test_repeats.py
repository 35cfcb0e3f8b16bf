import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from ledgerloom.llm import common, repeats


def corpus(seed: int) -> list[tuple]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "in", "er", "an", "é", "on"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(r.randint(5, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(r.randint(0, 40)) for _ in range(3)]
        for s in r.sample(shared, 2):
            cut = r.randint(0, len(s) // 3)
            parts.insert(r.randint(0, 2), s[cut:])
        rows.append((i * 7 % 61, r.choice([" ", "", "\n"]).join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "a" * 700), (103, "a" * 60), (104, "ab" * 300), (105, None), (106, ""), (107, "x" * 49), (108, "x" * 50), (109, "x" * 51), (110, rows[5][1] + rows[5][1])]
    return rows


@pytest.mark.parametrize("chunk,hot,batch", [(1500, 4096, 1), (4_000_000, 4096, 50_000), (6000, 3, 40)])
def test_against_brute_force(spark, chunk, hot, batch, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BATCH_WINDOWS", batch)
    rows = corpus(1)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, chunk string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.removed_bytes(df).collect())
    assert got == brute.repeats(rows)


def test_repeated_ids_and_empty_tables(spark):
    t = "one long sentence that is much longer than fifty bytes, and has no other meaning"
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (None, t), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 99, r["n_removed"]) for r in repeats.removed_bytes(df).collect())
    n = len(t)
    assert got == [(1, 0), (1, 0), (2, n), (99, 0), (99, n), (99, n)]
    assert repeats.removed_bytes(df.limit(0)).count() == 0


@pytest.mark.parametrize("ids", ["hashes", "outlier", "clusters", "top", "bottom"])
def test_ids_spread_in_any_way(spark, ids, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 2000)
    r = random.Random(2)
    rows = corpus(4)
    new = {"hashes": [r.randrange(-(2**63), 2**63) for _ in rows], "outlier": [*range(len(rows) - 2), 10**12, -(2**63)], "clusters": [i % 3 * 10**15 + i // 3 for i in range(len(rows))], "top": [2**63 - 1 - i for i in range(len(rows))], "bottom": [i - 2**63 for i in range(len(rows))]}[ids]
    rows = [(i, t) for i, (_, t) in zip(new, rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.removed_bytes(df).collect())
    assert got == brute.repeats(rows)
    sized = common.with_ranges(df, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)), 2000).groupBy("bucket").agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).collect()
    assert all(x["n"] <= 4000 or x["rows"] == 1 for x in sized if x["n"])


def test_levels_double():
    family, rng = repeats.Family(), np.random.default_rng(1)
    seen: set = set()
    for _ in range(40):
        text = rng.integers(0, 2, 90, np.uint8)
        strings, of = repeats.suffixes(text, np.array([len(text)]))
        assert strings.tolist() == [bytes(text[i : i + 50]).rstrip(b"\0") for i in range(41)] and not of.any()
        different, which, repeated = repeats.batch_array(np.concatenate((strings, strings)), np.repeat([3, 5], 41))
        assert (different[which] == np.concatenate((strings, strings))).all() and repeated.tolist() == [False] * 41 + [True] * 41
        found = family.holds(different)
        assert found.tolist() == [bytes(x) in seen for x in different]
        family.add(different[~found])
        seen |= {bytes(x) for x in different}
        sizes = [len(x) for x in family.levels]
        assert all(a > b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)
        assert all((np.sort(x) == x).all() for x in family.levels)


def test_texts_are_dealt_once_for_all_steps(spark):
    rows = corpus(3)
    out = repeats.removed_bytes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(tuple(r) for r in out.collect())
    assert got == brute.repeats(rows)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") >= 3  # texts twice, grams once


def test_grams_are_counted_by_four_bytes(spark):
    blob = lambda *keys: np.array([*keys, *[2] * len(keys)], np.uint32).tobytes()
    counted = spark.createDataFrame([(0, 1, blob(7, 9)), (0, 2, blob(7))], repeats.COUNTED)
    bits = {r["chunk"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8)).tolist() for r in repeats._gram_answers(counted).collect()}
    assert bits[1][:4] == [1, 0, 0, 0] and bits[2][:2] == [1, 0]
