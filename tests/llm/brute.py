"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in spans)


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def quality(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    at: dict = {}
    for i, w in enumerate(windows):
        at.setdefault(w, []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "base_failed": n < 50 or 100 * len(covered) > 50 * n}


def verdicts(rows: list[tuple], labels: list[tuple], n_buckets: int, threshold: float, marks_needed: int, share: float, texts: int, ratio: float) -> list[tuple[float, bool]]:
    """(score, kept) of each row (doc_id, text); labels: doc_id, quality, toxic."""
    import math
    from collections import Counter

    import numpy as np

    around = ".,;:!?()[]{}<>\"'`*_~-"
    best: dict = {}
    for i, q, t in labels:
        old = best.get(i, (0, 0))
        best[i] = (max(old[0], q or 0), max(old[1], t or 0))

    def features(text: str | None) -> list[int]:
        words = WORD.findall(text or "")
        one = [spark_hash(w) for w in words]
        hashed = one + [spark_hash(a, b) for a, b in zip(one, one[1:])] + [spark_hash(w[-3:], np.int32(3)) for w in words]
        return [h & (n_buckets - 1) for h in hashed]

    raw, good = Counter(), Counter()
    for i, text in rows:
        own = features(text)
        raw.update(own)
        if i is not None and best.get(i) == (1, 0):
            good.update(own)
    n_raw, n_good = sum(raw.values()), sum(good.values())
    log = lambda f: math.log((good[f] + 1) / (n_good + n_buckets) / ((raw[f] + 1) / (n_raw + n_buckets))) if n_good else 0.0
    bare = lambda text: {w.strip(around).lower() for w in WORD.findall(text or "")} - {""}
    kinds = {k: [bare(t) for i, t in rows if i is not None and (best.get(i, (0, 0)) if k else best.get(i, (0, 0))) in ({(0, 1), (1, 1)} if k else {(1, 0)})] for k in (0, 1)}
    marks = set()
    if kinds[0] and kinds[1]:
        for w, n in Counter(w for own in kinds[1] for w in own).items():
            other = sum(w in own for own in kinds[0])
            if n >= max(texts, share * len(kinds[1])) and (n + 1) / (len(kinds[1]) + 2) >= ratio * (other + 1) / (len(kinds[0]) + 2):
                marks.add(w)
    out = []
    for _, text in rows:
        own = features(text)
        score = sum(map(log, own)) / len(own) if own else 0.0
        out.append((score, not quality(text)["base_failed"] and score >= threshold and len(bare(text) & marks) < marks_needed))
    return out


def simhash(text: str | None) -> int:
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids: list, prints: list[int], distance: int = 2) -> dict:
    up = {p: p for p in prints}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    different = sorted(up)
    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                up[root(a)] = root(b)
    least: dict = {}
    for i, p in zip(ids, prints, strict=True):
        least[root(p)] = min(least.get(root(p), i), i)
    return {p: least[root(p)] for p in different}


def spark_hash(*values) -> int:
    """Spark's xxhash64 of strings, Python ints (as longs) and numpy int32."""
    import struct

    import numpy as np
    import xxhash

    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, np.int32) else "<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def weighted_samples(text: str | None, n_samples: int) -> str:
    """Consistent weighted sampling of a text's five-word shingles, every term looked at for every component."""
    import math
    from collections import Counter

    import numpy as np

    one = [spark_hash(w) for w in WORD.findall(text or "")]
    two = [spark_hash(a, b) for a, b in zip(one, one[1:])]
    four = [spark_hash(a, b) for a, b in zip(two, two[2:])]
    five = [spark_hash(a, b) for a, b in zip(four, one[4:])]
    if one and not five:  # the hash of the whole sequence, as of runs that end with the text
        return ""
    out = ""
    for k in range(n_samples):
        best = None
        for term, weight in Counter(five).items():
            bits = spark_hash(term, np.int32(k)) & (2**64 - 1)
            u = [((bits >> b & 0xFFFF) + 0.5) / 65536 for b in (0, 16, 32, 48)]
            r, c = -math.log(u[0] * u[1]), -math.log(u[2] * u[3])
            beta = (spark_hash(np.int32(k), term) & 0xFFFFFFFF) / 2**32
            t = math.floor(math.log(weight) / r + beta)
            log_a = math.log(c) - r * (t - beta + 1)
            key = (int((log_a + 128) * 8388608), spark_hash(t, term) & 0xFFFFFFFF)
            best = min(best or key, key)
        out += f"{best[1] if best else 0:08x}"
    return out


def repeats(texts: list[tuple[int, str | None]], n: int = 50) -> list[tuple]:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    first: dict = {}
    data = [(i, (t or "").encode()) for i, t in sorted(texts)]
    for i, b in data:
        for p in range(len(b) - n + 1):
            first.setdefault(b[p : p + n], i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        spans = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def revealing_terms(texts: list[str | None], disclosure: float, support: int, prior: float) -> set[str]:
    """Terms that disclose a protected entity, counted one by one."""
    import math
    from collections import Counter

    import regex

    term = regex.compile(r"[\p{L}\p{M}\p{N}'’.-]{3,}")

    def terms(text: str) -> list[str]:
        bare = (w.strip(".,;:!?()[]{}<>\"'`*_~-").lower() for w in WORD.findall(text))
        return [b for b in bare if term.fullmatch(b) and regex.search(r"\p{L}", b)]

    contexts: Counter = Counter()
    for text in texts:
        own = set()
        for start, kind, end in base_spans(text):
            value = text[start:end].lower()
            line = text[:start].rpartition("\n")[2] + text[start:].partition("\n")[0]
            own.add(((kind, value), line))
            if kind == 0:
                own.add((("domain", value.rpartition("@")[2]), line))
            if kind == 1:
                own.add((("network", ".".join(value.split(".")[:3])), line))
        contexts.update(own)
    n_lines = sum((t or "").count("\n") + 1 for t in texts if t is not None)
    n_term = Counter(w for t in texts for w in terms(t or ""))
    found = set()
    for entity in {e for e, _ in contexts}:
        own = {line: n for (e, line), n in contexts.items() if e == entity}
        n_entity = sum(own.values())
        both = Counter()
        for line, n in own.items():
            for w, times in Counter(terms(line)).items():
                both[w] += n * times
        bits = -math.log2(n_entity / n_lines)
        for w, n in both.items():
            if n >= support and (math.log2(n / (max(n_term[w], n) + prior)) + bits) / max(bits, 1e-9) >= disclosure:
                found.add(w)
    return found


def sanitised(text: str | None, terms: set[str]) -> str | None:
    """The text with personal data and terms replaced by their kinds; of overlapping spans the first counts."""
    import regex

    if text is None:
        return None
    spans = [(s, e, ("EMAIL", "IP", "CARD", "PHONE")[k]) for s, k, e in base_spans(text)]
    base = [(s, e) for s, e, _ in spans]
    own = sorted({w.strip(".,;:!?()[]{}<>\"'`*_~-").lower() for w in WORD.findall(text)} & terms)
    if own:
        pattern = regex.compile(r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(map(regex.escape, own)) + r")(?![\p{L}\p{N}])")
        spans += [(*m.span(), "TERM") for m in pattern.finditer(text) if not any(s < m.end() and m.start() < e for s, e in base)]
    out, at = "", 0
    for s, e, kind in sorted(spans, key=lambda x: (x[0], x[1], f"[{x[2]}]")):
        if s >= at:
            out += text[at:s] + f"[{kind}]"
        at = max(at, e)
    return out + text[at:]


def mixing(tokens: dict[str, int], entropy: float, repeats: float, budget: float) -> dict[str, tuple[float, int, int, int]]:
    """weight, budget, whole passes and the rest of each source, by plain bisection."""
    import math

    some = {k: n for k, n in tokens.items() if n}
    total = sum(some.values())

    def at(a: float) -> dict[str, float]:
        powers = {k: (n / total) ** a for k, n in some.items()}
        return {k: p / sum(powers.values()) for k, p in powers.items()}

    def bisect(good) -> tuple[float, float]:
        if good(1.0):
            return 1.0, 1.0
        low, high = 0.0, 1.0
        for _ in range(60):
            low, high = ((low + high) / 2, high) if good((low + high) / 2) else (low, (low + high) / 2)
        return low, high

    goal = entropy * math.log(len(some)) if some else 0
    a = bisect(lambda a: -sum(w * math.log(w) for w in at(a).values()) >= goal)[0]
    small = min(some, key=some.get, default=None)
    if some and at(a)[small] * budget * total > repeats * some[small]:
        a = max(a, bisect(lambda a: at(a)[small] * budget * total > repeats * some[small])[1])
    out = {k: (0.0, 0, 1, 0) for k in tokens}
    for k, w in at(a).items() if some else ():
        own = round(w * total * budget)
        out[k] = (w, own, own // some[k], own % some[k])
    return out


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """One bin after the other, one piece after the other."""
    left = sorted(lengths, reverse=True)
    bins = []
    while left:
        own, gap = [], capacity
        for x in list(left):
            if x <= gap:
                own.append(x)
                left.remove(x)
                gap -= x
        if gap and len(own) > 1:
            small = own[-1]
            best = (small, None, None)
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if best[0] < a + b <= gap + small:
                        best = (a + b, a, b)
                        break
            if best[1]:
                own.remove(small)
                left = sorted(left + [small], reverse=True)
                for x in best[1:]:
                    left.remove(x)
                    own.append(x)
        bins.append(sorted(own, reverse=True))
    return bins
