"""Each stage's rows on a small corpus with copies, near copies, junk, toxic texts, personal data, null and repeated ids, against plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm import brute
from tests.llm.test_stages import groups_of

import corpus_pipeline
from ledgerloom.llm import mixing, packing, pii, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(12)
    vocabulary = ["".join(r.choice(["ba", "do", "ki", "lu", "me", "ro", "sa", "ti"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, labels = [], []
    for i in range(240):
        words = prose(r.randint(55, 240))
        if i % 9 == 0:  # junk
            words = [w + r.choice(["###", "$$$", "%%%"]) for w in words]
        if i % 11 == 1:
            words[3:3] = r.sample(["Oaf,", "lout", "(swine)", "churl."], 3)
        if i % 13 == 2:
            words[20:20] = [f"{r.choice('abc')}.{i % 3}@host.org", "10.0.0." + str(i % 4), "+49 30 1234567"]
        if i % 17 == 3:
            words = words[:20]
        rows.append((i if i % 40 != 39 else None, " ".join(words), "en", f"src{i % 3}" if i % 29 else None, None))
        labels += [(i, int(i % 9 != 0), int(i % 11 == 1))] * (i < 200)
    for i in range(30):  # copies and near copies
        words = rows[50 + i][1].split(" ")
        for _ in range(i % 6):
            words[r.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words), "en", "src0", None))
    rows += [(2000 + i, "copied " + rows[2][1], "en", "many", None) for i in range(6)] + [rows[60], rows[61], (60, rows[70][1] + " tail end", "xx", "src1", None), (3000, None, None, None, None), (3001, "", "en", "src1", 0)]
    rows = [(i, t, a, s, None if t is None else len(t)) for i, t, a, s, _ in rows]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, labels


def written(spark, df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def listed(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_stages_one_after_the_other(spark, corpus):
    folder, rows, labels = corpus
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    docs = written(spark, stages["quality rules"](spark, docs, folder), folder, "1")
    verdicts = brute.verdicts([r[:2] for r in rows], labels, quality.BUCKETS, quality.THRESHOLD, quality.MARKS, quality.MARK_SHARE, quality.MARK_TEXTS, quality.MARK_RATIO)
    rows = [r for r, (_, kept) in zip(rows, verdicts, strict=True) if kept]
    assert listed(docs) == sorted(rows, key=str) and 150 < len(rows) < 260

    docs = written(spark, stages["SimHash near-dedup"](spark, docs, folder), folder, "2")
    groups = groups_of([r[1] for r in rows])
    by_group: dict = {}
    for r, g in zip(rows, groups, strict=True):
        by_group.setdefault(g, []).append(r)
    kept = listed(docs)
    assert len(kept) == len(by_group)
    for own in by_group.values():
        least = min((r[0] for r in own if r[0] is not None), default=None)
        assert sum(k in own and k[0] == least for k in kept) == 1
    rows = kept

    docs = written(spark, stages["personal data"](spark, docs, folder), folder, "3")
    terms = brute.revealing_terms([r[1] for r in rows], pii.DISCLOSURE, pii.SUPPORT, pii.PRIOR)
    rows = [(i, t, a, s, len(t)) for i, t, a, s in ((r[0], brute.sanitised(r[1], terms), r[2], r[3]) for r in rows)]
    assert listed(docs) == sorted(rows, key=str) and any("[EMAIL]" in r[1] for r in rows)

    docs = written(spark, stages["mixing"](spark, docs, folder), folder, "4")
    tokens = Counter()
    for r in rows:
        tokens["" if r[3] is None else "=" + r[3]] += len(r[1].split())
    want = brute.mixing(tokens, mixing.ENTROPY, mixing.REPEATS, mixing.BUDGET)
    times = Counter(tuple(r) for r in docs.select(*COLUMNS).collect())
    assert set(times) <= set(rows)
    taken = Counter()
    for r in rows:
        key = "" if r[3] is None else "=" + r[3]
        assert times[r] - want[key][2] in (0, 1)
        taken[key] += times[r] * len(r[1].split())
    for key, (_, budget, passes, _) in want.items():
        assert taken[key] <= budget or not passes
        longest = max(len(r[1].split()) for r in rows if ("" if r[3] is None else "=" + r[3]) == key)
        assert taken[key] > budget - longest
    rows = sorted(times.elements(), key=str)

    pieces = written(spark, stages["packing"](spark, docs, folder), folder, "5").collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = [np.array([*tokenizer.encode(r[1], add_special_tokens=False).ids, packing.END], "<u4") for r in rows]
    lengths = [n for x in ids for n in ([len(x) % packing.CAPACITY] * bool(len(x) % packing.CAPACITY) + [packing.CAPACITY] * (len(x) // packing.CAPACITY))]
    assert sorted(p["length"] for p in pieces) == sorted(lengths)
    assert Counter((p["doc_id"], p["ids_crc32"]) for p in pieces if p["piece"] == 0 and p["length"] < packing.CAPACITY) == Counter((r[0], zlib.crc32(x.tobytes())) for r, x in zip(rows, ids, strict=True) if len(x) < packing.CAPACITY)
    sequences: dict = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(sequences) == len(brute.best_two_fit(lengths, packing.CAPACITY))
