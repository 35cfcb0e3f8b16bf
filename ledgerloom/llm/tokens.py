"""Token ids by public tokenizers, each different piece of text encoded seldom."""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept by each worker in either of two memories. When the newer is full, it becomes the older, and what the older held is gone
#: unless it has been used meanwhile.
KEPT_PIECES = 100_000
#: White space to Python but not to the tokenizers' patterns, or the other way round: such texts are encoded whole.
UNSURE = "[\\x1c-\\x1f\\x{85}]"
DOUBLE = "[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]{2}|\\x00"
PIECE = re.compile(r"\s*\S+|\s+")
#: A full stop or comma that ends a word, only after characters that normalise to a single one of their kind.
SENTENCE_END, APART = r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([.,]\s)", r"\1 \2"
#: Pieces whose characters normalise each by itself, without the apostrophe, with which contractions begin.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
#: Where a match ends before what follows, if white space stands alone: texts are cut there.
CUTS = [(r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,])", "\\1\0\\2"), ("\n", "\0\n\0"), (" ", "\0 ")]
#: Parts of a plain piece in lower case.
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: No UTF-8 text has this byte: it stands for the end of a word.
WORD_END = b"\xff"
#: Bytes of text whose words are looked up together.
BATCH_BYTES = 6_000_000
#: Rows of a batch that are encoded and given back at a time.
ROWS = 2000


class _Kept(dict):
    """piece -> its ids' bytes; encode: from a list of pieces to theirs."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        super().__init__()
        self.encode, self.older = encode, {}

    def each(self, pieces: list[str]) -> list[bytes]:
        try:
            return [self[p] for p in pieces]
        except KeyError:
            pass
        if len(self) > KEPT_PIECES:
            self.older = dict(self)
            self.clear()
        new = []
        for p in {p for p in pieces if p not in self}:
            ids = self.older.get(p)
            if ids is None:
                new.append(p)
            else:
                self[p] = ids
        if new:
            self.update(zip(new, self.encode(new), strict=True))
        return [self[p] for p in pieces]


def _letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


def _pairs(model: dict) -> list[tuple[str, str]]:
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]


def _byte_ranks(file: dict) -> dict[bytes, int] | None:
    """Merge ranks of a plain byte-level BPE whose ids are in the order of its merges; None for any other."""
    model, letters = file["model"], _letters()
    if file["normalizer"] or (file["pre_tokenizer"] or {}).get("type") != "ByteLevel" or model["type"] != "BPE":
        return None
    vocabulary, pairs = model["vocab"], _pairs(model)
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or len(vocabulary) != 256 + len(pairs):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}


#: How a lower-case BPE with word ends prepares texts; ranks are used for this form alone.
_WORDS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _word_ranks(file: dict) -> dict[bytes, int] | None:
    """Merge ranks of a lower-case byte-level BPE with word ends, WORD_END for the end; None for any other."""
    model, letters = file["model"], _letters()
    end = model.get("end_of_word_suffix")
    if not end or (file["normalizer"] or {}).get("normalizers") != _WORDS or _WORD_SPLIT not in json.dumps(file["pre_tokenizer"]).replace("\\\\", "\\"):
        return None
    vocabulary, pairs = model["vocab"], _pairs(model)
    joined = [a + b for a, b in pairs]
    if any(vocabulary.get(t) != 512 + i for i, t in enumerate(joined)) or len(vocabulary) != 512 + len(pairs):
        return None
    spelt = lambda t: bytes(letters[c] for c in t.removesuffix(end)) + WORD_END * t.endswith(end)
    ranks = {spelt(t): i for t, i in vocabulary.items()}
    return ranks if len(ranks) == len(vocabulary) else None


class Encoder:
    """Texts to ids (uint32): those of the tokenizers library with add_special_tokens=False for the whole text.

    Neither of the patterns that split a text before its merges matches over the end of a word and what follows: a white-space
    character after a character that is none always begins a new match. Texts are cut there, and different pieces are encoded once.
    Where white space is dropped anyway, a full stop or comma that ends a word may be cut off too, after letters that normalise to one.
    Pieces of a plain byte-level BPE, and plain pieces of a lower-case one with word ends, go through its merge ranks, which give the same
    ids in a fraction of the time; special tokens' strings, all other pieces and any other tokenizer go through the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte_ranks, word_ranks = _byte_ranks(file), _word_ranks(file)
        self.spaces_count = "Removed" not in json.dumps(file["pre_tokenizer"])
        pieces_ids, self.single = self.whole, None
        if byte_ranks:
            import public_tokenizers
            import tiktoken

            plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks, special_tokens={})
            self.single, self.word, self.end = plain._core_bpe.encode_single_piece, "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$", b""

            def pieces_ids(texts: list[str]) -> list[bytes]:
                return [array("I", plain.encode_ordinary(x)).tobytes() for x in texts]
        elif word_ranks:
            import tiktoken

            self.word, self.end = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", WORD_END
            single = self.single = tiktoken.Encoding("words", pat_str="(?s).+", mergeable_ranks=word_ranks, special_tokens={})._core_bpe.encode_single_piece

            def pieces_ids(texts: list[str]) -> list[bytes]:
                out = [array("I", [i for p in PARTS.findall(x.lower()) for i in single(p.encode() + WORD_END)]).tobytes() if PLAIN.fullmatch(x) else None for x in texts]
                rest = iter(self.whole([x for x, ids in zip(texts, out, strict=True) if ids is None]))
                return [next(rest) if ids is None else ids for ids in out]

        self.kept = _Kept(pieces_ids)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        texts = pc.coalesce(texts, "")
        odd = pc.match_substring_regex(texts, UNSURE)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        if pc.any(odd).as_py():
            alone = iter(self.whole(texts.filter(odd).to_pylist()))
            rest = iter(self._batch(texts.filter(pc.invert(odd))))
            return [np.frombuffer(next(alone), np.uint32) if x else next(rest) for x in odd.to_pylist()]
        return self._batch(texts)

    def _batch(self, texts: pa.Array) -> list[np.ndarray]:
        if self.spaces_count:
            slow = pc.match_substring_regex(texts, DOUBLE) if self.single else pa.array(np.ones(len(texts), bool))
            if pc.any(slow).as_py():
                alone = (np.frombuffer(b"".join(self.kept.each(PIECE.findall(x))), np.uint32) for x in texts.filter(slow).to_pylist())
                rest = iter(self._batch(texts.filter(pc.invert(slow)))) if self.single else iter(())
                return [next(alone) if x else next(rest) for x in slow.to_pylist()]
        out: list[np.ndarray] = []
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        cuts = np.searchsorted(ends, np.arange(BATCH_BYTES, ends[-1] if len(ends) else 0, BATCH_BYTES))
        for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
            out += self._words(texts.slice(a, b - a))
        return out

    def _cut(self, texts: pa.Array) -> pa.Array:
        """Lists of pieces that can be encoded each by itself."""
        if self.spaces_count:
            for what, by in CUTS:
                texts = (pc.replace_substring_regex if "(" in what else pc.replace_substring)(texts, what, by)
            return pc.split_pattern(texts, "\0")
        texts = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
        return pc.utf8_split_whitespace(pc.replace_substring_regex(texts, SENTENCE_END, APART))

    def _words(self, texts: pa.Array) -> list[np.ndarray]:
        """Different words of all texts are found and encoded first; then their ids are put in the words' places."""
        words = self._cut(texts)
        coded = words.flatten().dictionary_encode()
        sizes, starts, ids = self._different(coded.dictionary)
        which = coded.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n)
        ids = ids[np.repeat(starts[which] - (ends - n), n) + np.arange(len(n) and ends[-1])]
        edges = np.append(0, ends)[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def _different(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word how many ids it has and where they start, and all ids."""
        plain = pc.match_substring_regex(words, self.word) if self.single else pa.array(np.zeros(len(words), bool))
        other = self.kept.each(words.filter(pc.invert(plain)).to_pylist())
        # words of letters are so quickly encoded that keeping them costs more
        simple = words.filter(plain) if self.spaces_count else pc.utf8_lower(words.filter(plain))
        lists = [self.single(w.encode() + self.end) for w in simple.to_pylist()]
        own = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.concatenate((np.fromiter(chain.from_iterable(lists), np.uint32, int(own.sum())), np.frombuffer(b"".join(other), np.uint32)))
        sizes = np.empty(len(words), np.int64)
        sizes[(mask := plain.to_numpy(zero_copy_only=False))] = own
        sizes[~mask] = np.fromiter(map(len, other), np.int64, len(other)) >> 2
        order = np.concatenate((np.flatnonzero(mask), np.flatnonzero(~mask)))
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return sizes, starts, ids


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches; memory that one leaves unused is given back before the next."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
            pa.default_memory_pool().release_unused()


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """Made once in a worker process, so that what it has encoded serves its later tasks too."""
    return Encoder(path)
