"""Personal data: patterns, and information-theoretic sanitisation of terms that reveal what the patterns protect; DataFrame operations only.

Base spans are emails, IP addresses, card and phone numbers. Protected entities are each distinct value of those, and two classes that
stand for more than one value: an email's domain and an IP address's network (its first three parts). A term is a word with a letter in
it, without the punctuation around it: letters, marks, digits, and apostrophes, hyphens and full stops inside.

Counted over all words of the corpus, n_both is how often a term stands in lines with the entity and n_term how often it occurs at all.
n_both / (n_term + PRIOR) estimates how probable the entity's line is where the term is seen, as if the term had been seen PRIOR more
times elsewhere, so that a few coincidences don't count as knowledge. The information that the term gives, log2 of that over the share of
lines that have the entity, divided by -log2 of that share, is the part of the entity's information that the term discloses: near 1 if
the term never occurs but in lines with the entity. Terms that stand in lines with an entity SUPPORT times at least (copies of a line
count each) and disclose DISCLOSURE of it are spans too, wherever they occur, and are generalised like the others.

All patterns are runs of single character classes, so that no text, however long, makes matching recurse or backtrack far. Where
the definition has a repeated group, the text is rewritten first, character for character, so that a run does the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forgotten, saved, words_of

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE = 0.9
SUPPORT = 3
PRIOR = 2.0
#: A term as a whole word in lower case, and its shortest length.
TERM = r"^[\p{L}\p{M}\p{N}'’.-]++$"
MIN_CHARS = 3
#: Copies of one text are dealt over so many keys.
SPREAD = 64
#: Punctuation that may stand around a term.
AROUND = ".,;:!?()[]{}<>\"'`*_~-"
#: So few candidates are sent to every executor.
SENT = 100_000

_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
#: Dots that cannot be inside a host name become a character that is fine before the @ but ends what is after it.
EMAIL_DOTS = r"\.(?![A-Za-z0-9-])|(?<![A-Za-z0-9-])\."
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
CARD = r"[0-9][0-9\x20-]*+"
#: Separators that don't stand alone between two digits.
CARD_GAPS = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def scanned(values: Column, zero: Column, op: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """Exclusive running op over an array column, in blocks, so that the work doesn't grow with the square of its length."""
    fold = lambda a: F.aggregate(a, zero, op)
    sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / block).cast("int")), lambda b: fold(F.slice(values, b * block + 1, F.lit(block))))
    return F.transform(values, lambda _, i: op(fold(F.slice(sums, F.lit(1), F.floor(i / block).cast("int"))), fold(F.slice(values, F.floor(i / block).cast("int") * block + 1, i % block))))


def _found(df: DataFrame, name: str, text: Column, pattern: str | Column, maybe: Column) -> DataFrame:
    """Adds array name of (start, end, value): leftmost non-overlapping matches; code points, end exclusive. maybe: false only where there is none."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    nothing = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(maybe, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(nothing))
    df = df.withColumn("_gaps", F.when(F.size("_m") > 0, F.split(text, pattern, -1)).otherwise(nothing))
    df = df.withColumn("_len", F.zip_with("_gaps", "_m", lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))))
    df = df.withColumn("_at", F.when(F.size("_len") > 0, scanned(F.col("_len"), F.lit(0), lambda a, b: a + b)).otherwise(F.array().cast("array<int>")))

    def span(m: Column, i: Column) -> Column:
        start = F.get("_at", i) + F.length(F.get("_gaps", i))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"))

    return df.withColumn(name, F.transform("_m", span)).drop("_m", "_gaps", "_len", "_at")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.get(F.split(F.reverse(digits), ""), i - 1).cast("int")
        twice = 2 * d
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def with_base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with arrays email, ip, card and phone of (start, end, value) in each text; a null text counts as empty."""
    df = df.withColumn("_x", F.coalesce(F.col(text), F.lit("")))
    x = F.col("_x")
    df = df.withColumn("_y", F.when(x.contains("@"), F.regexp_replace(x, EMAIL_DOTS, "%")).otherwise(""))
    df = _found(df, "email", F.col("_y"), EMAIL, F.col("_y") != "")
    df = df.withColumn("email", F.transform("email", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(x, s["start"] + 1, s["end"] - s["start"]).alias("value"))))
    df = _found(df, "ip", x, IP, x.rlike(r"[0-9]\.[0-9]"))
    df = df.withColumn("ip", F.filter("ip", lambda s: s["value"].rlike(IP_PARTS)))
    df = df.withColumn("_y", F.when(x.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), F.regexp_replace(x, CARD_GAPS, "\n")).otherwise(""))
    df = _found(df, "card", F.col("_y"), CARD, F.col("_y") != "")
    df = df.withColumn("card", F.filter("card", lambda s: F.length(_digits(s["value"])).between(12, 19) & F.when(F.length(_digits(s["value"])).between(12, 19), _luhn(_digits(s["value"]))).otherwise(False)))
    df = _found(df, "phone", x, PHONE, x.contains("+"))
    df = df.withColumn("phone", F.filter("phone", lambda s: F.length(_digits(s["value"])).between(9, 15)))
    return df.drop("_x", "_y")


def bare(word: Column) -> Column:
    """A word as a term: lower case, without punctuation around it."""
    return F.lower(F.btrim(word, F.lit(AROUND)))


def _terms(text: Column) -> Column:
    """array of the words of a text as terms; other words are empty."""
    return F.transform(words_of(text), bare)


def _counting(n: int, terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if n <= SENT else terms


def _rows(docs: DataFrame) -> DataFrame:
    """docs with _sha and _salt: a row's text, and a hash of its other columns, so that copies of one text don't meet in one task."""
    rest = [F.struct(*[c for c in docs.columns if c != "text"])] if len(docs.columns) > 1 else [F.lit(0)]
    return docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(SPREAD)))


def _entities(kind: str, value: Column) -> Column:
    """array of the hashes of what a value stands for: itself, and its class if it has one."""
    own = F.xxhash64(F.lit(kind), F.lower(value))
    if kind == "email":
        return F.array(own, F.xxhash64(F.lit("domain"), F.lower(F.substring_index(value, "@", -1))))
    if kind == "ip":
        return F.array(own, F.xxhash64(F.lit("network"), F.substring_index(value, ".", 3)))
    return F.array(own)


def disclosed(n_both: Column, n_term: Column, n_entity: Column, n_lines: float, prior: float = PRIOR) -> Column:
    """Part of an entity's information that a term discloses."""
    own = -F.log2(n_entity / F.lit(n_lines))
    return (F.log2(n_both / (n_term + F.lit(prior))) + own) / F.greatest(own, F.lit(1e-9))


def revealing_terms(docs: DataFrame, spans: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame | None:
    """(term): terms of the corpus docs(text) that disclose an entity of spans(text, email, ip, card, phone), saved; None if there is none."""
    def lines(kind: str) -> Column:
        """(entity, line) of each span; spans never reach over a line's end."""
        before = lambda s: F.substring_index(F.substring(F.col("text"), F.lit(1), s["start"]), "\n", -1)
        after = lambda s: F.substring_index(F.substring(F.col("text"), s["start"] + 1, F.length("text")), "\n", 1)
        pairs = lambda s, line: F.transform(_entities(kind, s["value"]), lambda e: F.struct(e.alias("entity"), line.alias("line")))
        return F.flatten(F.transform(kind, lambda s: pairs(s, F.concat(before(s), after(s)))))

    # saved before any filter: a filter on the spans would be pushed below them, and find them again for each of its terms.
    # An entity's line counts once in a text, so that no count is over that of the corpus
    contexts = saved(spans.select(F.array_distinct(F.concat(*[lines(k) for k in KINDS[:4]])).alias("_e")), "pii-contexts")
    each = contexts.select(F.explode("_e").alias("_e")).select("_e.entity", "_e.line")
    rows = saved(each.groupBy("entity", "line").agg(F.count("*").alias("copies")).withColumn("of", F.xxhash64("line")), "pii-lines")
    forgotten(contexts)
    if rows.isEmpty():
        return None
    n_lines = float(docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0])
    # saved, so that what they are joined with, which may have one key in most rows, is all that is dealt by it
    totals = saved(rows.groupBy("entity").agg(F.sum("copies").alias("n_entity")), "pii-entities")
    texts = rows.groupBy("of").agg(F.first("line").alias("line"), F.max("copies").alias("copies"))
    words = texts.select("of", "copies", F.explode(_terms(F.col("line"))).alias("term")).filter((F.length("term") >= MIN_CHARS) & F.col("term").rlike(TERM) & F.col("term").rlike(r"\p{L}"))
    words = saved(words.groupBy("of", "term").agg(F.count("*").alias("times"), F.first("copies").alias("copies")), "pii-words")
    near = saved(words.groupBy("term").agg(F.sum(F.col("times") * F.col("copies")).alias("n_near")).filter(F.col("n_near") >= support), "pii-near")
    pairs = rows.select("entity", "of", F.col("copies").alias("own")).join(words.select("of", "term", "times"), "of")
    pairs = saved(pairs.groupBy("entity", "term").agg(F.sum(F.col("own") * F.col("times")).alias("n_both")).filter(F.col("n_both") >= support), "pii-met")
    met, pairs = pairs, pairs.join(totals, "entity").join(near, "term")
    # a term occurs at least as often as in the lines with entities: what can't disclose enough even then is not looked for in the corpus
    pairs = saved(pairs.filter(disclosed(F.col("n_both"), F.greatest("n_near", "n_both"), F.col("n_entity"), n_lines) >= disclosure), "pii-pairs")
    candidates = saved(pairs.select("term").distinct(), "pii-candidates")
    n = candidates.count()
    if not n:
        return None
    found = docs.select(F.explode(_terms(F.col("text"))).alias("term")).join(_counting(n, candidates), "term").groupBy("term").agg(F.count("*").alias("n_term"))
    share = disclosed(F.col("n_both"), F.greatest("n_term", "n_both"), F.col("n_entity"), n_lines)
    terms = saved(pairs.join(found, "term").filter(share >= disclosure).select("term").distinct(), "pii-terms")
    forgotten(rows, words, totals, near, met, pairs, candidates)
    return None if terms.isEmpty() else terms


def with_spans(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """docs with arrays email, ip, card, phone and term of (start, end, value); docs has a text, and is read several times.

    One row per row of docs. Null and empty texts have no spans; an empty table gives no rows. Term spans never overlap others.
    """
    terms = revealing_terms(docs, with_base_spans(docs.select("text").filter(F.col("text").rlike("[@+0-9]"))), disclosure, support)
    if terms is None:
        return with_base_spans(docs).withColumn("term", F.slice("email", 1, 0))
    words = _rows(docs).select("_sha", "_salt", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    hits = words.join(_counting(terms.count(), terms), "term").groupBy("_sha", "_salt").agg(F.collect_set("term").alias("_terms"))
    df = _rows(docs).select("_sha", "_salt", F.struct(*docs.columns).alias("_doc")).join(hits, ["_sha", "_salt"], "left").select("_doc.*", "_terms")
    df = with_base_spans(df)
    words = F.array_join(F.transform(F.array_sort("_terms"), lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    df = df.withColumn("_pattern", F.coalesce(F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), words, F.lit(r")(?![\p{L}\p{N}])")), F.lit("")))
    df = _found(df, "term", F.coalesce("text", F.lit("")), F.col("_pattern"), F.col("_pattern") != "")
    base = F.concat("email", "ip", "card", "phone")
    return df.withColumn("term", F.filter("term", lambda t: ~F.exists(base, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))).drop("_terms", "_pattern")


def _joined(kinds: tuple[str, ...]) -> Column:
    def numbered(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    spans = F.concat(*[numbered(i, kind) for i, kind in enumerate(kinds)])
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return df.select("doc_id", *counts, F.sha2(_joined(KINDS[:4]).cast("binary"), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))


def sanitised(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """docs with each span of text replaced by its kind, as in [EMAIL]; spans that overlap become one. Null texts stay null. n_chars, if there, is counted again."""
    df = with_spans(docs.select("text", F.struct(*docs.columns).alias("_doc")), disclosure, support)  # other columns' names may clash

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("tag")))

    spans = F.concat(*[tagged(kind) for kind in KINDS])
    df = df.withColumn("_s", F.array_sort(spans)).drop(*KINDS)
    df = df.withColumn("_ends", F.transform("_s", lambda s: s["end"]))
    df = df.withColumn("_before", F.when(F.size("_ends") > 0, scanned(F.col("_ends"), F.lit(0), lambda a, b: F.greatest(a, b))).otherwise(F.array().cast("array<int>")))
    parts = F.transform("_s", lambda s, i: F.when(s["start"] >= F.get("_before", i), F.concat(F.substring(F.col("text"), F.get("_before", i) + 1, s["start"] - F.get("_before", i)), s["tag"])).otherwise(""))
    text = F.concat(F.array_join(parts, ""), F.expr("substring(text, array_max(_ends) + 1)"))
    df = df.withColumn("text", F.when(F.size("_s") > 0, text).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return df.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data in texts is replaced; all documents stay, null texts as they are."""
    return sanitised(docs)
