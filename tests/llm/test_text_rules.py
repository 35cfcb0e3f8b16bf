import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from ledgerloom.llm import fingerprints, pii, quality, simhash

ODD = [
    None,
    "",
    "   \n\t ",
    "word",
    "a b c d a b c d a b c " * 20,
    "one two\none two\n\none two\n three  ",
    "mail a.b@c.d, x@y.z_w@v.u a@b@c.d a..b@c.d q@-.x@y z@a..b " + "k" * 3000,
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1..2.3.4.5 9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 or 4111  1111 1111 1111 5500000000000004 -4 - 5500 0000 0000 0004- 1 2",
    "+49 (30) 123-456 78 +1 234 +123456789 ++49 30 1234567, +4930123456789012345",
    "1 2 " * 20000,
    "a@b" + ".c" * 20000,
    "é🙂 +49 30 1234567 é🙂 é@a.b x@é.a x@a.bé #*$%&|<>#",
    "\x1cword\x85other third " * 30,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD + ODD[:5])] + [(None, "null id"), (3, "word")]
    rows += [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id") + 100, "text").collect()]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))


def labels(spark, docs):
    return docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).filter("doc_id % 2 = 0")


def test_revealing_terms_are_those_of_plain_counts(spark):
    import random

    r = random.Random(5)
    names = ["O'Brien", "Jean-Luc", "agent007", "Ünïcödé", "x" * 90, "Ann", "B2B"]
    mails = [f"{n}@{d}.org" for n in ("a", "b", "c") for d in ("one", "two")] + ["10.1.2.3", "10.1.2.9", "+49 30 1234567"]
    texts = []
    for i in range(260):
        lines = [" ".join(r.choices("the of and to it in on by as".split(), k=9)) for _ in range(r.randint(1, 4))]
        if i % 4 == 0:
            k = r.randrange(len(mails))
            lines.insert(0, f"{r.choice(['say', 'ask'])} {names[k % len(names)]}, at {mails[k]} {r.choice('pqrs')}{r.randrange(9)} or")
        if i % 50 == 7:
            lines.append(f"talk of {r.choice(names)}.")
        texts.append("\n".join(lines))
    texts += [None, "", texts[0], texts[0]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, term string")
    for disclosure, support in ((0.5, 2), (0.7, 2), (0.6, 3)):
        want = brute.revealing_terms(texts, disclosure, support, pii.PRIOR)
        terms = pii.revealing_terms(df, pii.with_base_spans(df.select("text")), disclosure, support)
        assert {x["term"] for x in terms.collect()} == want and want
    assert {"o'brien", "jean-luc", "agent007"} & brute.revealing_terms(texts, 0.5, 2, pii.PRIOR)


def test_terms_are_found_in_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [x["text"] for x in docs.collect()]
    want = brute.revealing_terms(texts, pii.DISCLOSURE, pii.SUPPORT, pii.PRIOR)
    assert want
    found = pii.with_spans(docs).select(F.explode("term").alias("t")).select(F.lower("t.value").alias("v")).distinct().collect()
    assert {x["v"] for x in found} == want


def test_quality_counts(spark, docs):
    rows = quality.judged(docs, labels(spark, docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = brute.quality(r["text"])
        assert {k: r[k] for k in want} == want, r["text"]
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def test_quality_score_and_verdict(spark):
    import random

    r = random.Random(11)
    words = [["good", "fine", "plain", "text", "Word,", "more"], ["junk", "###", "buy", "now!", "x"], ["the", "of", "and", "to", "in", "it"]]
    rows, labels = [], []
    for i in range(120):
        kind = i % 3 == 0
        text = [r.choice(words[2] + words[kind] * 2) + r.choice(["", "", str(r.randrange(300))]) for _ in range(r.randint(20, 160))]
        toxic = i % 7 == 0
        if toxic:
            text[5:5] = r.sample(["Oaf,", "lout", "(swine)", "churl."], r.randint(0, 3))
        rows.append((i if i % 40 else None, " ".join(text)))
        if i % 2 or toxic:
            labels += [(i, int(not kind), int(toxic)), (i, None, 0)]
    rows += [(500, None), (501, ""), (502, rows[1][1]), (502, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    n, threshold = 512, -0.05
    want = brute.verdicts(rows, labels, n, threshold, quality.MARKS, quality.MARK_SHARE, quality.MARK_TEXTS, 3.0)
    old, quality.MARK_RATIO = quality.MARK_RATIO, 3.0
    try:
        got = quality.judged(df, given, threshold, n).collect()
    finally:
        quality.MARK_RATIO = old
    key = lambda x: (str(x[0]), x[1] or "")
    got = sorted(((r["doc_id"], r["text"], r["score"], r["kept"]) for r in got), key=key)
    want = sorted(((i, t, *w) for (i, t), w in zip(rows, want, strict=True)), key=key)
    assert [r[3] for r in got] == [r[3] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-9)
    assert len({r[3] for r in got}) == 2
    assert quality.buckets_for(df) == quality.BUCKETS


def test_quality_empty(spark, docs):
    assert quality.judged(docs.limit(0), labels(spark, docs)).count() == 0
    assert quality.judged(docs.limit(3), labels(spark, docs).limit(0)).count() == 3


def test_base_spans(spark, docs):
    for r in pii.with_base_spans(docs).select("text", pii._joined(pii.KINDS[:4]).alias("spans")).collect():
        assert r["spans"] == brute.spans_text(brute.base_spans(r["text"])), r["text"]


def test_revealing_terms(spark):
    lines = [f"Zorblatt wrote {w} from zed@mail.example here" for w in ("alpha", "beta", "gamma", "delta")]
    rows = [(i, t) for i, t in enumerate(lines)] + [(9, "here ZORBLATT. walked from afar"), (10, "wrote here")] + [(20 + i, f"here from wrote {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    out = {r["doc_id"]: r for r in pii.sanitised(df, disclosure=0.8).collect()}
    assert out[0]["text"] == "[TERM] wrote alpha from [EMAIL] here"
    assert out[9]["text"] == "here [TERM]. walked from afar" and out[10]["text"] == "wrote here"
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())


def test_sanitised_overlap(spark):
    df = spark.createDataFrame([(1, "call +4111111111111111 or +4111 1111 1111 now"), (2, None), (3, "")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert out[2] is None and out[3] == ""
    assert not any(c.isdigit() for c in out[1]) and out[1].startswith("call ") and out[1].endswith(" now")


def test_simhash(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert int(r["fingerprint"], 16) == brute.simhash(texts[r["doc_id"]])
    known = [r for r in rows if r["doc_id"] is not None]
    want = brute.groups([r["doc_id"] for r in known], [int(r["fingerprint"], 16) for r in known])
    for r in known:
        assert r["component_id"] == want[int(r["fingerprint"], 16)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS fp", "2 AS key", "3 AS component_id", "'x' AS fingerprint", "4 AS node", "5 AS root")
    assert sorted(map(str, simhash.near_duplicates(clash).collect())) == sorted(map(str, rows))


def test_simhash_crowded_key(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (3, 40, 300):
        base = int(rng.integers(0, 2**63))
        prints = {base}
        while len(prints) < n:
            x = rng.choice(sorted(prints)) if len(prints) > 1 else base
            prints.add(int(x) ^ (1 << int(rng.integers(32, 64))) ^ (1 << int(rng.integers(30, 64))))
        fps = np.array(sorted(prints), np.uint64)
        df = spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(fps.view(np.int64))], "doc_id long, fp long")
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
        want = brute.groups(list(range(len(fps))), [int(f) for f in fps])
        got: dict = {}
        for f, w in want.items():
            got.setdefault(w, set()).add(roots.get(int(np.uint64(f).view(np.int64)), int(np.uint64(f).view(np.int64))))
        assert all(len(v) == 1 for v in got.values()) and len(set.union(*got.values())) == len(got)


def test_fingerprints(spark, docs):
    rows = fingerprints.fingerprint_report(docs).collect()
    data = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert len(rows) == len(data)
    prints = {}
    by = {}
    for (i, t), (_, after) in zip(data, data[1:] + data[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        by.setdefault(i, []).append((len(t), brute.sha(edited), t, edited))
    for r in rows:
        n, s, t, edited = next(x for x in by[r["doc_id"]] if x[:2] == (r["n_chars"], r["edited_sha256"]))
        for text, print_ in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(text, print_) == print_
            words = brute.WORD.findall(text)
            assert (print_ == "0" * 8 * fingerprints.SAMPLES) == (not words)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprints.fingerprint_report(docs.limit(0)).count() == 0
    assert fingerprints.fingerprint_report(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).count() == 1


def test_fingerprints_are_those_of_all_terms(spark, docs):
    few = docs.filter("doc_id between 100 and 130 or doc_id in (0, 4)")
    want = {r["doc_id"]: brute.weighted_samples(r["text"], 6) for r in few.collect()}
    for bound in (1.0, fingerprints.BOUND, None):  # with a bound of 1, a third of the components are open at first
        rows = fingerprints.fingerprint_report(few, 6, bound).collect()
        assert len(rows) == len(want)
        assert sum(r["fingerprint"] == want[r["doc_id"]] for r in rows if want[r["doc_id"]]) == sum(map(bool, want.values()))


def test_production_fingerprints_are_as_exact_as_their_samples(spark):
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [r["text"] or "" for r in docs.orderBy(F.desc("doc_id")).collect()]
    ids = [r["doc_id"] for r in docs.orderBy(F.desc("doc_id")).select("doc_id").collect()]
    sets = lambda t: Counter(zip(*(w[i:] for i in range(5)))) if len(w := brute.WORD.findall(t)) > 4 else Counter([tuple(w)] * bool(w))
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(docs).collect()}
    errors = []
    for i, t, after in zip(ids, texts, texts[1:] + texts[:1], strict=True):
        a, b = sets(t), sets(t[: len(t) - len(t) // 2] + after[: len(t) // 2])
        if a and b:
            errors.append(got[i]["near_edited"] - sum((a & b).values()) / sum((a | b).values()))
    assert len(errors) > 150 and max(map(abs, errors)) < 0.35 and abs(sum(errors) / len(errors)) < 0.02
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.1


@pytest.mark.parametrize("ids", ["hashes", "outlier", "nulls"])
def test_fingerprints_of_ids_spread_in_any_way(spark, ids):
    import random

    r = random.Random(3)
    n = 700
    new = {"hashes": [r.randrange(-(2**63), 2**63) for _ in range(n)], "outlier": [*range(n - 2), 10**12, -(2**63)], "nulls": [i if i % 3 else None for i in range(n)]}[ids]
    rows = [(i, " ".join(r.choices("abcdefgh", k=12))) for i in new]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = [t for i, t in sorted(((i, t) for i, t in rows if i is not None), reverse=True)]
    ordered += [t for _, t in sorted(((brute.spark_hash(t), t) for i, t in rows if i is None), key=lambda x: (-x[0], x[1]))]
    edited = sorted(brute.sha(t[: len(t) - len(t) // 2] + after[: len(t) // 2]) for t, after in zip(ordered, ordered[1:] + ordered[:1]))
    assert sorted(x["edited_sha256"] for x in fingerprints.fingerprint_report(df, 2).collect()) == edited
    sizes = fingerprints.in_ranges(df).groupBy("bucket").count().collect()
    assert max(x["count"] for x in sizes) <= 128


def test_fingerprints_estimate_generalised_jaccard(spark):
    from collections import Counter

    import numpy as np

    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(vocabulary[:k], 160)) for k in (3, 4, 5, 6, 8, 12) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    prints = {r["i"]: r["fingerprint"] for r in fingerprints.weighted_samples(df, ["i"], "text", n_samples=64, shingle=2).collect()}
    counts = [Counter(zip(w, w[1:])) for w in (t.split() for t in texts)]
    errors = []
    for i in range(len(texts)):
        for j in range(i):
            true = sum((counts[i] & counts[j]).values()) / sum((counts[i] | counts[j]).values())
            got = np.mean([prints[i][8 * k : 8 * k + 8] == prints[j][8 * k : 8 * k + 8] for k in range(64)])
            errors.append(got - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.07
