"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Each node knows where matching goes on when no edge fits (failure link) and how many
tokens are finished by going there (popped count), both precomputed, so a word's length in tokens comes out of one pass over its
bytes, without building or rescanning pieces (Song et al., 2021). Words are runs of bytes between ASCII white space and begin with the
vocabulary's space; each distinct word in a task's cache is matched once.

The vocabulary must hold every single byte. Null texts count as empty and have no words or tokens. Rows that repeat give equal
results; an empty table gives no rows.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CACHE = 500_000
COUNTS = "doc_id long, n_bytes long, n_words long, n_tokens long"


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with: themselves where visible, else 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_tokens(vocabulary: str) -> list[bytes]:
    """The tokens of a byte-level tokenizer file that can occur in a word: no white space but a first space."""
    of = byte_alphabet()
    tokens = [bytes(of[c] for c in t) for t in json.loads(vocabulary)["model"]["vocab"] if all(c in of for c in t)]
    return [t for t in tokens if t and t[1:].split() == ([t[1:]] if t[1:] else [])]


class Automaton:
    def __init__(self, tokens: list[bytes]):
        step: dict[int, int] = {}
        order, ends = [(0, 0, 0)], [False]
        for t in set(tokens):
            v = 0
            for b in t:
                u = step.get(v << 8 | b)
                if u is None:
                    u = step[v << 8 | b] = len(ends)
                    ends.append(False)
                    order.append((u, v, b))
                v = u
            ends[v] = True
        missing = [b for b in range(256) if not ends[step.get(b, 0)]]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        depth = [0] * len(ends)
        for u, v, _ in order[1:]:
            depth[u] = depth[v] + 1
        link, popped = [0] * len(ends), [0] * len(ends)
        for u, v, b in sorted(order[1:], key=lambda x: depth[x[0]]):
            if ends[u]:
                popped[u] = 1  # the whole string is a token: on from the root
                continue
            z, n = link[v], popped[v]
            while z << 8 | b not in step:
                n += popped[z]
                z = link[z]
            link[u], popped[u] = step[z << 8 | b], n
        self.step, self.link, self.popped = step, link, popped

    def count(self, word: bytes) -> int:
        step, link, popped, v, n = self.step, self.link, self.popped, 0, 0
        for b in word:
            u = step.get(v << 8 | b)
            while u is None:
                n += popped[v]
                v = link[v]
                u = step.get(v << 8 | b)
            v = u
        while v:
            n += popped[v]
            v = link[v]
        return n


class _Counts(dict):
    def __init__(self, vocabulary: str):
        self.automaton = Automaton(byte_tokens(vocabulary))

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(self) >= _CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


@lru_cache(2)
def _counts(vocabulary: str) -> _Counts:
    return _Counts(vocabulary)


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows of ``COUNTS``, one for each row of ``docs`` (doc_id, text); ``vocabulary`` is the content of a byte-level tokenizer file."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        of = _counts(sent.value).__getitem__
        for b in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(1)]
            words = [t.split() for t in texts]
            cols = [[len(t) for t in texts], [len(w) for w in words], [sum(map(of, w)) for w in words]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_bytes", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTS)
