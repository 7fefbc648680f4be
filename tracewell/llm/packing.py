"""Packing by the online sum-of-squares rule.

Documents become token ids plus an end id. Whole windows are cut off long
documents; what is left goes to the fill level whose use makes the sum of the
squared counts of partially filled windows least, kept in an array of counts by
level. Each task packs its own scan partition as it reads it, so nothing is
shuffled; at its end the windows still open are cut and joined, and the last is
laid out in power-of-two sequences, which need no padding.

Memory of a task: the open windows and the word memo. Several windows may stand open at
one level; the rule keeps their squared counts low, but sets no bound of one. Sequence ids are made of the partition and a running number; the
same input split gives the same rows when a task is run again."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Remembered pieces of text per worker.
MEMO_PIECES = 300_000
WINDOW = 2048
END = 1
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_STOPPED = re.compile("(.*[A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?])", re.S)
#: The printable stand-in of each byte in byte-level vocabularies.
_PRINTED = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
_PRINTABLE = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tokens(dict):
    """Piece of text between spaces or line ends -> its ids as little-endian
    32-bit bytes. The tokenizer folds case and splits at white space, and between
    letters and punctuation, before anything else; so the ids of a text are those
    of its pieces in turn, a piece of letters has the ids of its lower case, and
    one that ends in a stop has those of the two parts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.word = self.tokenizer.model.tokenize
        self.folds = self._of("Ab") == self._of("ab") and self._of("ab.,") == self._of("ab") + self._of(".,") and self._of("ab cd") == self._of("ab") + self._of("cd")

    def _of(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_PIECES:
            self.clear()
        if self.folds and _LETTERS.fullmatch(piece):
            low = piece.lower()
            if low != piece:
                found = self[low]
            else:
                found = np.asarray([t.id for t in self.word(low.encode().decode("latin-1").translate(_PRINTABLE))], dtype="<u4").tobytes()
        elif self.folds and (parts := _STOPPED.fullmatch(piece)):
            found = self[parts[1]] + self[parts[2]]
        else:
            found = np.asarray(self._of(piece), dtype="<u4").tobytes()
        if len(piece) < 64:
            self[piece] = found
        return found

    def ids(self, text: str) -> bytes:
        if not self.folds:
            return np.asarray(self._of(text), dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_tokens: Tokens | None = None


def tokens(path: str) -> Tokens:
    """The worker's tokenizer and memo, kept between tasks."""
    global _tokens
    if _tokens is None or _tokens.path != path:
        _tokens = Tokens(path)
    return _tokens


class Packer:
    """Windows by fill level; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.level: list[list[list]] = [[] for _ in range(size + 1)]

    def place(self, piece: tuple, n: int) -> list | None:
        """Put a piece of n tokens in its window; the window, if that fills it."""
        if n == self.size:
            return [piece]
        rise = 2 * (self.count[n:] - self.count[: self.size + 1 - n])
        rise[0] -= 1
        rise[-1] -= 1  # a full window no longer counts
        usable = self.count[: self.size + 1 - n] > 0
        usable[0] = True
        rise[~usable] = np.iinfo(np.int64).max
        at = len(rise) - 1 - int(np.argmin(rise[::-1]))  # of equal levels the fullest
        window = self.level[at].pop() if at else []
        self.count[at] -= at > 0
        window.append(piece)
        if at + n == self.size:
            return window
        self.level[at + n].append(window)
        self.count[at + n] += 1
        return None

    def rest(self) -> Iterator[list]:
        """Open windows, fullest first, cut and joined into full ones; the last
        into powers of two."""
        fill, now = 0, []
        for windows in reversed(self.level):
            for window in windows:
                for doc, start, ids, total in window:
                    while ids:
                        cut = ids[: 4 * (self.size - fill)]
                        now.append((doc, start, cut, total))
                        fill, start, ids = fill + len(cut) // 4, start + len(cut) // 4, ids[len(cut) :]
                        if fill == self.size:
                            yield now
                            fill, now = 0, []
        while fill:
            part = 1 << (fill.bit_length() - 1)
            room, head, tail = part, [], []
            for doc, start, ids, total in now:
                cut, after = ids[: 4 * room], ids[4 * room :]
                if cut:
                    head.append((doc, start, cut, total))
                if after:
                    tail.append((doc, start + len(cut) // 4, after, total))
                room -= len(cut) // 4
            yield head
            fill, now = fill - part, tail


def _pack(path: str, size: int):
    end = np.asarray([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, sequence = tokens(path).ids, Packer(size), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def emit(window: list) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset))
                offset += n
            sequence += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = (encode(text) if text else b"") + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    if done := packer.place((doc, start, piece, total), len(piece) // 4):
                        emit(done)
            yield flushed()
        for window in packer.rest():
            emit(window)
        yield flushed()

    return run


def packed(docs: DataFrame, tokenizer: str, size: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per piece (SCHEMA). A null or empty text
    is its end id alone. doc_id may be null or repeat: rows are packed one by one."""
    if size & (size - 1):
        raise ValueError("the window must be a power of two")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_pack(tokenizer, size), SCHEMA)
