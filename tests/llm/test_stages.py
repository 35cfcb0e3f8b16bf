import random
import re

from tests.llm import brute

from ledgerloom.llm import neardup, quality


def shingle_set(text):
    words = brute.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def groups_of(texts):
    """The number of each text's group, all pairs compared."""
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                old, new = up[i], up[j]
                up = [new if x == old else x for x in up]
    return up


def near_copies(seed=3):
    """Texts with copies in which some words are others, more and more of them, and chains of such copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = [None, "", " \n ", "one two", "One  two"]
    for _ in range(12):
        base = [word() for _ in range(200)]
        texts += [" ".join(base), " ".join(base).upper()]
        for changed in (1, 3, 4, 5, 9):
            copy = list(base)
            for at in r.sample(range(200), changed):
                copy[at] = word()
            texts.append(" ".join(copy))
        for _ in range(3):
            base[r.randrange(200)] = word()
            base[r.randrange(200)] = word()
            texts.append(" ".join(base))
    return texts


def test_near_duplicates_are_those_of_all_pairs(spark):
    texts = near_copies()
    want = groups_of(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group"] for r in neardup.similar_groups(df).collect()}
    assert len({*zip(want, (got[i] for i in range(len(texts))), strict=True)}) == len(set(want)) == len(set(got.values()))
    kept = sorted(r["doc_id"] for r in neardup.near_duplicate_stage(spark, df, "").collect())
    assert kept == sorted({w: i for i, w in reversed(list(enumerate(want)))}.values())
    assert neardup.near_duplicate_stage(spark, df.limit(0), "").count() == 0


def test_a_few_toxic_words_in_a_long_text_reject_it(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(600)]
        if i % 8 == 0:
            for at, bad in zip(r.sample(range(600), 3), r.sample(["Rotter,", "swine", "(oaf)", "lout!"], 3), strict=True):
                words[at] = bad
        rows.append((i, " ".join(words)))
        labels += [(i, 1, int(i % 8 == 0))] * (i < 300)
    df = spark.createDataFrame([*rows, (None, rows[1][1])], "doc_id long, text string")
    out = quality.judged(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == 401 and not any(r["base_failed"] for r in out)
    assert all(r["score"] >= quality.THRESHOLD for r in out)
    for r in out:
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] % 8 != 0), r["doc_id"]


def test_null_and_repeated_ids_lose_no_group(spark):
    word = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(None, word(i), "a", None) for i in range(6)] + [(None, word(1), None, "a"), (7, word(2), "a", None), (7, word(8), "a", None), (7, word(9), "b", None), (3, word(9), "c", None)]
    rows += [(None, None, "x", None), (None, "x", None, None), rows[0], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = [tuple(r) for r in neardup.near_duplicate_stage(spark, df, "").collect()]
    assert sorted(r[1] or "" for r in kept) == sorted({r[1] or "" for r in rows})
    assert set(kept) <= set(rows)
    assert {r[0] for r in kept if r[1] == word(9)} == {3} and {r[0] for r in kept if r[1] == word(2)} == {7}


def test_many_near_texts_make_no_list_of_pairs(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(1000)], []
    for _ in range(200):  # nearly all pairs are at 0.78, and a few texts have a close copy
        copy = list(base)
        for at in r.sample(range(1000), 13):
            copy[at] = word()
        texts.append(" ".join(copy))
    texts += [x.rsplit(" ", 3)[0] for x in texts[:9]]
    rows, saved = {}, neardup.saved

    def counted(df, name):
        out = saved(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(neardup, "saved", counted)
    want = groups_of(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["group"] for x in neardup.similar_groups(df).collect()}
    assert len({*zip(want, (got[i] for i in range(len(texts))), strict=True)}) == len(set(want)) == len(set(got.values()))
    assert max(rows.values()) < 20 * len(texts), rows


def test_many_alike_texts_meet_in_one_row_each(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(300)], []
    for _ in range(150):  # nearly all pairs are alike
        copy = list(base)
        for at in r.sample(range(300), 3):
            copy[at] = word()
        texts.append(" ".join(copy))
    rows, saved = {}, neardup.saved

    def counted(df, name):
        out = saved(df, name)
        rows.setdefault(name, out.count())
        return out

    monkeypatch.setattr(neardup, "saved", counted)
    want = groups_of(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["group"] for x in neardup.similar_groups(df).collect()}
    assert len({*zip(want, (got[i] for i in range(len(texts))), strict=True)}) == len(set(want)) == len(set(got.values()))
    assert rows["neardup-first"] <= len(texts), rows


def test_each_pair_that_met_is_seen_or_marked(spark):
    r = random.Random(10)
    pairs = {(3, 9), (5, 9), (20, 21), (20, 22), (30, 31)}  # 5 has one partner, which has a smaller one
    pairs |= {tuple(sorted(r.sample(range(100, 160), 2))) for _ in range(70)}
    rows = [(50, None, True), (51, None, True), (51, 52, False), (52, 51, False)]
    for task in range(6):  # a pair meets in some of the tasks
        some = [p for p in pairs if p[1] % 6 == task or r.random() < 0.2]
        known = {}
        for a, b in some:
            known.setdefault(a, set()).add(b)
            known.setdefault(b, set()).add(a)
        rows += [(x, min(y), len(y) > 1) for x, y in known.items()]
    first = neardup.partners(spark.createDataFrame(rows, "id long, one long, more boolean"))
    found = {x["id"]: (x["one"], x["more"]) for x in first.collect()}
    marked = [x["id"] for x in neardup.marked_ids(first).collect()]
    assert len(marked) == len(set(marked)) and {5, 9, 50, 51} <= set(marked) and not {3, 21, 22, 30, 31, 52} & set(marked)
    for a, b in pairs:
        assert found[b][0] == a or {a, b} <= set(marked), (a, b)
    assert found[50] == (None, True) and found[51] == (52, True) and found[52] == (51, False)
