"""Token counts by a linear longest-match automaton.

The vocabulary's trie gets, for every node, a failure link and the number of
tokens popped when it is followed, so the greedy longest-match length of a word
is found in one pass over its bytes without building a single piece.

Words are [^\\x20\\x09-\\x0D]+, each read after one space byte, which is how
byte-level vocabularies mark the start of a word."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import MEMO_WORDS

#: Byte-level vocabularies write each byte as a printable character: itself, or 256 and up in turn.
_SELF = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
_BYTE_OF = {chr(b): b for b in _SELF} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in _SELF)}


def vocabulary(path: str) -> list[bytes]:
    """Tokens of a byte-level vocabulary file; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    special = {t["content"] for t in found.get("added_tokens", [])}
    return [bytes(_BYTE_OF[c] for c in t) for t in found["model"]["vocab"] if t not in special]


class Automaton:
    """count(word) is the number of tokens that repeated longest match takes off
    the word, or 1 where it gets stuck (the word is then one unknown token)."""

    def __init__(self, tokens: list[bytes]):
        self.go: list[dict[int, int]] = [{}]
        ends = set()
        for t in tokens:
            at = 0
            for b in t:
                step = self.go[at].get(b)
                if step is None:
                    step = self.go[at][b] = len(self.go)
                    self.go.append({})
                at = step
            if at:
                ends.add(at)
        self.fail = [-1] * len(self.go)
        self.pops = [0] * len(self.go)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in self.go[u].items():
                queue.append(v)
                if v in ends:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and b not in self.go[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.go[z][b], popped

    def count(self, word: bytes) -> int:
        go, fail, pops = self.go, self.fail, self.pops
        at = n = 0
        for b in word:
            step = go[at].get(b)
            while step is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 1
                step = go[at].get(b)
            at = step
        while at > 0:
            n += pops[at]
            at = fail[at]
        return n if at == 0 else 1


class _Counts(dict):
    def __init__(self, path: str):
        self.path, self.automaton = path, Automaton(vocabulary(path))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self.automaton.count(b" " + word)
        if len(word) < 64:
            self[word] = value
        return value


_counts: _Counts | None = None


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _counts
        if _counts is None or _counts.path != path:
            _counts = _Counts(path)
        for b in batches:
            words, tokens = [], []
            for text in b.column("text").to_pylist():
                w = (text or "").encode("utf-8", "surrogatepass").split()
                words.append(len(w))
                tokens.append(sum(map(_counts.__getitem__, w)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_tokens, one row per row.
    Null and empty texts have no words and no tokens."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_count(vocabulary_path), "doc_id long, n_words long, n_tokens long")
