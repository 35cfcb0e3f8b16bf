import json
import random
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest
from tests.llm import brute

from ledgerloom.llm import counts, huffman, mixing, packing, tokens, urls

SF = "/root/testdata/sf0.001"


def rows_of(spark, n=60):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").limit(n).collect()]
    return rows + [(900, None, "a"), (901, "", None), (901, "", None), (None, "null id", "a"), rows[0], (-5, "below zero", "src0")]


def greedy(word, begin, go_on):
    n, at = 0, 0
    while at < len(word):
        pieces = go_on if at else begin
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return counts.UNKNOWN
        n, at = n + 1, end
    return n


def test_automaton_is_greedy_longest_match():
    r = random.Random(4)
    for _ in range(60):
        piece = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 5)))
        begin, go_on = {piece() for _ in range(r.randint(1, 12))}, {piece() for _ in range(r.randint(0, 12))}
        automaton = counts.Automaton(begin, go_on)
        for _ in range(200):
            word = "".join(r.choice("abc") for _ in range(r.randint(0, 12)))
            assert automaton.token_count(word) == greedy(word, begin, go_on), (word, begin, go_on)


def test_token_counts(spark):
    rows = rows_of(spark)
    begin, go_on = (set(x) for x in counts.default_vocabulary())
    out = counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_words string"), counts.default_vocabulary).collect()
    want = []
    for i, t, _ in rows:
        each = [greedy(w, begin, go_on) for w in brute.WORD.findall(t or "")]
        want.append((i, len(each), sum(1 if n < 0 else n for n in each), sum(n < 0 for n in each)))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("longest", [6, 9, 20])
def test_code_lengths_are_best(longest):
    import heapq

    r = np.random.default_rng(longest)
    for n in (2, 3, 17, 60):
        freq = (r.pareto(0.7, n) * 10 + 1).astype(np.int64)
        lengths = huffman.code_lengths(freq, longest)
        assert lengths.max() <= longest and sum(2.0 ** -lengths.astype(float)) == pytest.approx(1)
        heap = [(int(f), 0) for f in freq]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], 0))
        assert (lengths * freq).sum() >= cost
        if longest == 20 and n < 20:
            assert (lengths * freq).sum() == cost


def test_file_round_trip():
    r = np.random.default_rng(1)
    docs = [(i if i != 3 else None, r.zipf(1.3, n).clip(0, 5000).astype(np.uint32)) for i, n in enumerate((0, 1, 255, 256, 257, 4000, 0))]
    freq = np.bincount(np.concatenate([x for _, x in docs]), minlength=6000)
    lengths = huffman.code_lengths(freq)
    ids, sizes, all_ids = huffman.read_file(huffman.file_bytes(docs, lengths, huffman.canonical(lengths)[0]))
    assert ids == [i for i, _ in docs] and sizes.tolist() == [len(x) for _, x in docs]
    assert (all_ids == np.concatenate([x for _, x in docs])).all()
    one = huffman.code_lengths(np.array([0, 0, 7]))
    assert huffman.read_file(huffman.file_bytes([(1, np.array([2, 2, 2], np.uint32))], one, huffman.canonical(one)[0]))[2].tolist() == [2, 2, 2]


@pytest.mark.parametrize("docs_of_file", [3, 512])
def test_token_files(spark, docs_of_file, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(huffman, "FILE_DOCS", docs_of_file)
    rows = rows_of(spark) + [(2**63 - 1, "far above", None), (-(2**63), "far below", None), (10**12, "İ. far, क़. off", None)]
    path = huffman.default_tokenizer()
    t = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    out = sorted(map(tuple, huffman.read_files(huffman.write_files(df, lambda: tokens.encoder(path))).collect()), key=lambda r: (r[1], r[2]))
    at, want = 0, []
    for i, x, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert out == want
    assert huffman.read_files(huffman.write_files(df.limit(0), lambda: tokens.encoder(path))).count() == 0


def tokenizers_ids(path, texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [huffman.default_tokenizer(), packing.default_tokenizer()])
def test_every_letter_before_the_end_of_a_sentence(path):
    encode = tokens.encoder(path)
    letters = [chr(i) for i in range(0x2FFFF) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i))[0] in "LNM"]
    texts = [" ".join(f"w{c}. {c}, {c}{c}. x" for c in letters[at : at + 16]) for at in range(0, len(letters), 16)]
    for text, want in zip(texts, tokenizers_ids(path, texts), strict=True):
        assert encode(text).tolist() == want, text


@pytest.mark.parametrize("path", [huffman.default_tokenizer(), packing.default_tokenizer()])
def test_ids_of_odd_texts_and_of_the_whole_vocabulary(path):
    r = random.Random(8)
    own = [t.replace("</w>", "") for t in json.load(open(path))["model"]["vocab"]]
    alphabet = [*"abcdefgilmnostuvz  ..,,'’-@0159àéèñÇÉİßſ\n\t\u0301\u093c\u00a0\x85~#", "'s", "'re ", "क़", "한", "<|endoftext|>"]
    texts = [" ".join(own[at : at + 40]) for at in range(0, len(own), 40)]
    texts += ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(4000)]
    texts += [" ".join("".join(r.choices(own, k=r.randint(1, 4))) for _ in range(20)) for _ in range(1500)]
    encode = tokens.encoder(path)
    for text, want in zip(texts, tokenizers_ids(path, texts), strict=True):
        assert encode(text).tolist() == want, text


def test_url_filter(spark):
    odd = [None, "", "no scheme", "http://", "http://COM/", "http://com", "ftp://a.com/x?y#z", "http://wwwexample.com/en/", "http://Www.Example.Com/en/x/", "http://net/es/", "http://a.net/es", "x://y://net/fr/?a/b", "http://a.net?x/es/", "http://a.net#/fr/", "http://example.com/en/ \n/x", "http://[::1]/", "http://.com/", "http://a..com//"]
    rows = [(i, u) for i, u in enumerate(odd + odd[:9])] + [(None, "http://b.com/")]
    rows += [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    got = sorted(map(tuple, urls.verdicts(df, rules).collect()), key=str)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    assert got == sorted(con.execute(urls.OP7_SQL).fetchall(), key=str)
    assert urls.verdicts(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.verdicts(df, rules.limit(0), "block").collect()} == {"block"}


def test_url_filter_with_many_rules(spark):
    """As many lengths and labels as may be: 5,000 paths of one host, deep hosts, a very long URL."""
    r = random.Random(6)
    label = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 3)))
    rules = {(r.choice(["allow", "block"]), ".".join(label() for _ in range(r.randint(1, 9))), "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 4)))) for _ in range(600)}
    rules |= {("block", "host.org", "/" + "x" * n) for n in range(5000)} | {("allow", None, "/"), ("block", "a", None)}
    urls_ = ["http://" + ".".join(label() for _ in range(r.randint(1, 12))) + "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 6))) for _ in range(500)]
    urls_ += ["http://host.org/" + "x" * n + "y" for n in (0, 1, 70, 4998, 4999, 60000)] + [None] * 3 + ["http://" + "a." * 3000 + "b/x"]
    df = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in urls.verdicts(df, spark.createDataFrame(list(rules), "verdict string, host string, path string")).collect()}
    assert len(got) == len(urls_)
    for i, u in enumerate(urls_):
        host, path = (u or "http:///").split("://")[1].split("/", 1)
        fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if h and p and (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)] if u else []
        assert got[i] == (max(fits)[2:] if fits else (None, "allow")), u


KINDS = [{"entropy": 0.999, "repeats": 50.0}, {"entropy": 1.0, "repeats": 2.0}, {"entropy": 0.5, "repeats": 1.5, "budget": 0.7}, {"entropy": mixing.ENTROPY, "repeats": mixing.REPEATS, "budget": mixing.BUDGET}]


@pytest.mark.parametrize("kind", KINDS)
def test_mixing(spark, kind):
    """Weights by plain bisection; each pass has all documents, the last a head of its order that the budget ends."""
    rows = rows_of(spark, 150) + [(i, "one two three " * (i % 5), "many") for i in range(1000, 1400)] + [(None, f"null {i}", "null ids") for i in range(30)] + [(7, "", "empty"), (8, "long " * 900, "one long")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, key string")
    sizes = mixing.sized(df)
    sources = mixing.weights(sizes, **kind)
    table = {r["key"]: r for r in sources.collect()}
    tokens: dict = {}
    for _, t, s in rows:
        key = "" if s is None else "=" + s
        tokens[key] = tokens.get(key, 0) + len(brute.WORD.findall(t or ""))
    want = brute.mixing(tokens, kind["entropy"], kind["repeats"], kind.get("budget", mixing.BUDGET))
    assert {k: r["n_tokens"] for k, r in table.items()} == tokens
    for k, r in table.items():
        assert r["weight"] == pytest.approx(want[k][0], rel=1e-5) and r["budget"] == pytest.approx(want[k][1], rel=1e-4, abs=2)
        assert not tokens[k] or r["budget"] == r["passes"] * tokens[k] + r["rest"] and 0 <= r["rest"] < tokens[k]
    marks = mixing.ends(sizes, sources)
    out = mixing.mixed(sizes, marks).collect()
    more = mixing.mixed(sizes, marks.selectExpr("key", "n_docs", "passes + 1 AS passes", "cast(null as long) AS last_block", "cast(null as long) AS last_doc")).collect()
    for k, r in table.items():
        order = lambda x: (x["block_order"], x["doc_order"])
        for e in range(r["passes"]):
            assert sum(x["epoch"] == e and x["key"] == k for x in out) == r["n_docs"]
        last = sorted((x for x in more if x["key"] == k and x["epoch"] == r["passes"]), key=order)
        taken = sorted((x for x in out if x["key"] == k and x["epoch"] == r["passes"]), key=order)
        assert [order(x) for x in taken] == [order(x) for x in last[: len(taken)]]
        n = sum(x["n_tokens"] for x in taken)
        same = [x["n_tokens"] for x in last[len(taken) :] if order(x) == order(last[len(taken)])] if len(taken) < len(last) else []
        assert n <= r["rest"] or (not r["passes"] and len({order(x) for x in taken}) == 1)
        assert not same or not r["rest"] or n + sum(same) > r["rest"]
        assert not tokens[k] or taken or r["passes"]


def test_mixing_of_the_tables(spark):
    """The query's target and budget bind: neither are the weights the shares, nor is every source one whole pass."""
    sizes = mixing.sized(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    sources = mixing.weights(sizes).collect()
    total = sum(r["n_tokens"] for r in sources)
    assert any(abs(r["weight"] - r["n_tokens"] / total) > 1e-3 for r in sources)
    assert any(r["rest"] for r in sources)
    assert mixing.op8_mixing(spark, SF).count() > 0
    assert mixing.mixed(sizes.limit(0), mixing.ends(sizes.limit(0), mixing.weights(sizes.limit(0)))).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = mixing.saved(stage(spark, docs, SF), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.count() > 50
    out = corpus_pipeline.run(spark, SF)
    assert out.count() >= docs.count()


def test_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    own = ["email", "score", "kept", "key", "n_docs", "block", "_key", "n_words", "term"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = mixing.saved(docs.selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in own]), "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in own), name
