"""Token counts by a linear longest-match automaton.

A vocabulary has pieces that begin a word and pieces that continue one. Greedy splitting takes the longest piece that fits, again
and again; a word that it cannot split to the end counts as one unknown token. The automaton is a trie of all pieces with a failure
link at every node: where to go on when no longer piece fits, after popping the pieces that are settled by then. Only their number
is kept, so a word's token count is known after one pass over its characters, without building any piece.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Words kept by each worker; beyond them, the memory is emptied and fills anew.
KEPT_WORDS = 400_000
UNKNOWN = -1


class Automaton:
    """token_count(word) is the number of pieces of greedy splitting, or UNKNOWN."""

    def __init__(self, begin: Iterable[str], go_on: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # 0: a word's start, 1: after a piece
        final = [False, False]
        for root, pieces in ((0, begin), (1, go_on)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    node = self.next[node][c]
                final[node] = final[node] or node > 1
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        level = [0, 1]
        while level:
            below = []
            for parent in level:
                for c, node in self.next[parent].items():
                    below.append(node)
                    if final[node]:
                        self.fail[node], self.pops[node] = 1, 1
                        continue
                    back, popped = self.fail[parent], self.pops[parent]
                    while back >= 0 and c not in self.next[back]:
                        popped += self.pops[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[node], self.pops[node] = self.next[back][c], popped
            level = below

    def token_count(self, word: str) -> int:
        following, fail, pops = self.next, self.fail, self.pops
        node = count = 0
        for c in word:
            to = following[node].get(c)
            while to is None:
                count += pops[node]
                node = fail[node]
                if node < 0:
                    return UNKNOWN
                to = following[node].get(c)
            node = to
        while node > 1:  # the rest of the last piece
            count += pops[node]
            node = fail[node]
            if node < 0:
                return UNKNOWN
        return count


@functools.lru_cache(maxsize=2)
def _automaton(vocabulary: Callable[[], tuple[list[str], list[str]]]) -> tuple[Automaton, dict[bytes, int]]:
    """The automaton and the counts of words seen, kept by a worker process for its later tasks."""
    return Automaton(*vocabulary()), {}


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces that go on) of a sentencepiece model; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in plain if p.startswith("▁") and len(p) > 1], [p for p in plain if "▁" not in p]


def token_counts(docs: DataFrame, vocabulary: Callable[[], tuple[list[str], list[str]]]) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for each row of docs (doc_id, text).

    Words stand between white space (space and \\t to \\r). An unknown word counts as one token. Null, empty and blank texts have
    none; an empty table gives no rows; other columns are ignored. vocabulary: called once in a worker process.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, kept = _automaton(vocabulary)
        for batch in batches:
            rows = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(kept) > KEPT_WORDS:
                    kept.clear()
                for w in set(words):
                    if w not in kept:
                        kept[w] = automaton.token_count(w.decode("utf-8", "surrogatepass"))
                counts = [kept[w] for w in words]
                unknown = counts.count(UNKNOWN)
                rows[:, i] = len(words), sum(counts) + 2 * unknown, unknown
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def default_vocabulary() -> tuple[list[str], list[str]]:
    import public_tokenizers

    return sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), default_vocabulary)
