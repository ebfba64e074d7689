"""Token counts by greedy longest match in linear time.

Each word, with a space before it, is matched against a vocabulary of byte strings in which pieces
that begin words carry the space. A trie of the vocabulary gets failure links: from a node that has
no way on, the link leads to the node of what is left once the pieces that greedy matching would take
are popped, and the node keeps how many pieces that are. So one walk over a word's bytes counts its
pieces, and no piece is ever built.

Defined results: a null or empty text has no words and no tokens; rows are independent, so repeated
rows and ties repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_batches

#: Cached words in each Python worker; the cache is emptied when full.
CACHE = 100_000
_automata: dict[str, Automaton] = {}


class Automaton:
    """vocabulary: byte strings, all single bytes among them."""

    def __init__(self, vocabulary: Iterable[bytes]):
        #: node * 256 + byte -> node; the root is 0.
        self.step: dict[int, int] = {}
        self.link, self.popped, self.cache = [-1], [0], {}
        ends, n = set(), 1
        for piece in vocabulary:
            at = 0
            for b in piece:
                at, n = (known, n) if (known := self.step.get(at << 8 | b)) else (self.step.setdefault(at << 8 | b, n), n + 1)
            ends.add(at)
        children: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, node in self.step.items():
            children[key >> 8].append((key & 255, node))
        self.link, self.popped = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for b, node in children[parent]:
                queue.append(node)
                if node in ends:  # what is read so far is a piece: pop it, nothing is left
                    self.link[node], self.popped[node] = 0, 1
                    continue
                at, popped = self.link[parent], self.popped[parent]
                while at >= 0 and (at << 8 | b) not in self.step:
                    popped += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.step[at << 8 | b], popped

    def count(self, data: bytes) -> int:
        """Pieces of greedy longest match; single bytes are pieces, so there is always a match."""
        step, link, popped = self.step, self.link, self.popped
        at = n = 0
        for b in data:
            while (to := step.get(at << 8 | b)) is None:
                n += popped[at]
                at = link[at]
            at = to
        while at > 0:
            n += popped[at]
            at = link[at]
        return n

    def words(self, words: list[str]) -> int:
        cache = self.cache
        found = list(map(cache.get, words))
        if None in found:
            if len(cache) > CACHE:
                cache.clear()
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    found[i] = cache[w] = cache.get(w) or self.count(b" " + w.encode())
        return sum(found)


def automaton(vocabulary: str) -> Automaton:
    if vocabulary not in _automata:
        import base64

        import public_tokenizers

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            _automata[vocabulary] = Automaton(base64.b64decode(line.split()[0]) for line in f)
    return _automata[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, n_words, n_tokens of each document's whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, word = automaton(vocabulary), re.compile(WORD)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                words = word.findall(text or "")
                n_words.append(len(words))
                n_tokens.append(pieces.words(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_words long, n_tokens long")
