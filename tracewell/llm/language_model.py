"""Language-model scoring with a trigram trie in Elias-Fano levels.

A text's words w1 .. wn and an end are each predicted from the two before (starts pad the
first). Probabilities are smoothed by hierarchical Dirichlet priors:

    p(w | u v) = (c(u v w) + MU3 p(w | v)) / (c(u v) + MU3)
    p(w | v)   = (c(v w) + MU2 p(w)) / (c(v) + MU2)

p(w) is that of the word itself for words of at least 1 / FREQUENT of all tokens (so
there are at most FREQUENT of them); others share BUCKETS classes by hash, in each of
which every learnt word, and all unknown words together, have one equal share. Sums over
words are one, and the table has a bounded size.

Tokens are dealt by the middle word v to cells of some CELL tokens: all counts that a
token needs, but p(w), meet there. A word with more tokens than CELL is spread over a
grid of cells, by u one way and by w the other; the counts of its pairs are then summed
first and sent to the grid's rows and columns. A cell turns its learnt counts into a
trie (v, then u, then w) in one flat buffer: rising pointers and successors as
Elias-Fano sequences, successors of u v as ranks among the successors of v, and log
probabilities and back-off weights in steps of 1 / STEPS. Held-out tokens are searched
there, each within its context's range; learnt tokens know their place already.

Words are told apart by 64 bits as middle words, so that counts are exact, and by 48
bits as neighbours. Tokens travel once, some nine bytes each."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import mixed, staged, word_hashes
from tracewell.llm.eliasfano import EliasFano

MU2, MU3 = 50.0, 5.0
FREQUENT, BUCKETS = 1 << 16, 1 << 18
CELL, CHUNK = 1 << 21, 1 << 20
STEPS = 2048
#: No word holds a space, so these are no word's hashes.
START, END = (xxhash.xxh64_intdigest(b) for b in (b" start", b" end"))
SHORT = np.uint64((1 << 48) - 1)
FOLDS, HELD_OUT = 5, 1


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def hashed(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words."""
    return word_hashes((text or "").encode("utf-8", "surrogatepass").lower())


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
        yield doc_id, hashed(text)


def quantised(p: np.ndarray) -> np.ndarray:
    """-log10 p in whole steps."""
    return np.rint(-np.log10(p) * STEPS).clip(0, 65535).astype(np.uint16)


# Counting


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Learnt words and ends, counted in chunks."""

    def counted() -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"word": words.view(np.int64), "n": n})

    held, size = [], 0
    for b in batches:
        for doc_id, h in _rows(b):
            if not held_out(doc_id):
                held += [h, np.array([END], dtype=np.uint64)]
                size += len(h) + 1
                if size >= 4 * CHUNK:
                    yield counted()
                    held, size = [], 0
    if held:
        yield counted()


class Model:
    """What all cells share: totals, p(w) and the words that are spread over grids."""

    def __init__(self, words: DataFrame, cell: int):
        size = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("word") == np.uint64(END).view(np.int64).item(), F.col("n"))).alias("docs")).first()
        self.tokens, self.types, self.docs = size["n"] or 0, size["v"], size["docs"] or 0
        self.cells = max(1, math.ceil(1.25 * self.tokens / cell))
        often = words.where(F.col("n") * FREQUENT >= self.tokens).collect()
        short = np.fromiter((r["word"] for r in often), np.int64, len(often)).view(np.uint64) & SHORT
        counts = np.fromiter((r["n"] for r in often), np.float64, len(often))
        z = self.tokens + 0.5 * (self.types + BUCKETS)
        order = np.argsort(short)
        self.often, self.often_p = short[order], ((counts + 0.5) / z)[order]
        rare = words.where(F.col("n") * FREQUENT < self.tokens).groupBy(F.col("word").bitwiseAND(BUCKETS - 1).cast("int").alias("at")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
        mass, types = np.zeros(BUCKETS), np.zeros(BUCKETS)
        mass[rare["at"]], types[rare["at"]] = rare["n"], rare["v"]
        self.rare_p = ((mass + 0.5 * types + 0.5) / (types + 1) / z).astype(np.float32)
        # A starting pad stands before every document.
        grid = {r["word"]: r["n"] for r in often if r["n"] > cell} | ({np.uint64(START).view(np.int64).item(): self.docs} if self.docs > cell else {})
        grid.pop(np.uint64(END).view(np.int64).item(), None)
        self.hot = np.array(sorted(grid), dtype=np.int64).view(np.uint64)
        at = np.argsort(self.hot)
        self.hot = self.hot[at]
        own = np.array([grid[w] for w in self.hot.view(np.int64).tolist()], dtype=np.int64)
        self.hot_n, self.hot_side = own, np.ceil(np.sqrt(np.ceil(own / cell))).astype(np.uint64)

    def p1(self, w: np.ndarray) -> np.ndarray:
        """p(w) by 48-bit hash."""
        out = self.rare_p[(w & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.float64)
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, w), len(self.often) - 1)
            same = self.often[at] == w
            out[same] = self.often_p[at[same]]
        return out

    def hot_at(self, v: np.ndarray) -> np.ndarray:
        """Place among the spread words, or -1."""
        if not len(self.hot):
            return np.full(len(v), -1)
        at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
        return np.where(self.hot[at] == v, at, -1)

    def cell_of(self, v: np.ndarray, row: np.ndarray | int, column: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            spread = mixed(v ^ (np.uint64(row) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(column) * np.uint64(0xC2B2AE3D27D4EB4F)))
        return (spread % np.uint64(self.cells)).astype(np.int32)

    def dealt(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The cell of each token."""
        at = self.hot_at(v)
        side = np.where(at >= 0, self.hot_side[at] if len(self.hot) else np.uint64(1), np.uint64(1)).astype(np.uint64)
        return self.cell_of(v, mixed(u & SHORT) % side, mixed(w & SHORT) % side)


def _trigrams(h: np.ndarray) -> np.ndarray:
    return np.concatenate((np.array([START, START], dtype=np.uint64), h, np.array([END], dtype=np.uint64)))


def _hot_pairs(sent):
    """Learnt pairs of spread words: (v, side, other, n), counted in chunks; side 0 is w, 1 is u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value

        def counted() -> pa.RecordBatch:
            t = np.concatenate(held)
            at = model.hot_at(t)
            # Pads at either end of a document have no pair there.
            v = np.flatnonzero((at >= 0) & (t != END))
            v = v[(v > 0) & (v < len(t) - 1)]
            v = v[~((t[v] == START) & (t[v - 1] != START))]
            kind = np.concatenate((at[v] * 2, at[v] * 2 + 1)).astype(np.int64)
            other = np.concatenate((t[v + 1], t[v - 1])) & SHORT
            order = np.lexsort((other, kind))
            kind, other = kind[order], other[order]
            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(kind)), dtype=bool), (kind[1:] != kind[:-1]) | (other[1:] != other[:-1]))))
            n = np.diff(np.append(new, len(kind)))
            return pa.RecordBatch.from_pydict({"v": model.hot[kind[new] >> 1].view(np.int64), "side": (kind[new] & 1).astype(np.int32), "other": other[new].astype(np.int64), "n": n})

        held, size = [], 0
        for b in batches:
            for doc_id, h in _rows(b):
                if not held_out(doc_id):
                    held.append(_trigrams(h))
                    size += len(h) + 3
                    if size >= CHUNK:
                        yield counted()
                        held, size = [], 0
        if size:
            yield counted()

    return run


def _to_grid(sent):
    """Summed pairs -> a row for each cell of the word's grid that needs it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for b in batches:
            v, other = (b.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("v", "other"))
            side_of = b.column("side").to_numpy()
            grid = model.hot_side[model.hot_at(v)]
            line = mixed(other) % grid
            copies = np.repeat(np.arange(len(v)), grid.astype(np.int64))
            across = (np.arange(len(copies)) - np.repeat(np.cumsum(grid.astype(np.int64)) - grid.astype(np.int64), grid.astype(np.int64))).astype(np.uint64)
            row, column = np.where(side_of[copies] == 1, line[copies], across), np.where(side_of[copies] == 1, across, line[copies])
            out = b.take(pa.array(copies))
            yield pa.RecordBatch.from_arrays([pa.array(model.cell_of(v[copies], row, column)), *out.columns], names=["cell", *out.schema.names])

    return run


# Dealing tokens


def _sorted_unique(values: np.ndarray) -> bytes:
    return b"".join(EliasFano.of(values).written())


def _packed(*parts: np.ndarray | bytes) -> bytes:
    """Arrays one after the other, each with its width and length, compressed."""
    out = []
    for p in parts:
        if isinstance(p, bytes):
            width, data = 0, p
        else:
            width = 2 if not len(p) or p.max() < 1 << 16 else 4
            data = p.astype(f"<u{width}").tobytes()
        out += [np.array([width, len(data)], dtype="<i8").tobytes(), data]
    raw = b"".join(out)
    return np.array([len(raw)], dtype="<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> list:
    raw = pa.decompress(data[8:], decompressed_size=int(np.frombuffer(data, "<i8", 1)[0]), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        width, size = np.frombuffer(raw, "<i8", 2, at).tolist()
        at += 16
        out.append(raw[at : at + size] if width == 0 else np.frombuffer(raw, f"<u{width}", size // width, at))
        at += size
    return out


_DEALT = "cell int, chunk long, docs binary, tokens binary"


def _dealt(sent):
    """Documents -> for each chunk of them and each cell, the tokens sorted by v, u, w.
    docs: ids, whether there is one, and whether the document is held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        part, number = TaskContext.get().partitionId(), 0

        def made(held: list) -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(t) - 2 for _, t in held])
            # The chunk's words once: what follows works on their numbers.
            words, number_of = np.unique(np.concatenate([t for _, t in held]), return_inverse=True)
            shorts, short_of = np.unique(words & SHORT, return_inverse=True)
            number_of, short_of = number_of.astype(np.int32), short_of.astype(np.int32)
            doc = np.repeat(np.arange(len(held), dtype=np.int32), lengths)
            # Two places at the end of each document begin no token.
            begins = np.ones(len(number_of), dtype=bool)
            begins[np.cumsum(lengths + 2) - 1] = begins[np.cumsum(lengths + 2) - 2] = False
            at = np.flatnonzero(begins).astype(np.int32)
            v, u, w = number_of[at + 1], short_of[number_of[at]], short_of[number_of[at + 2]]
            del begins, at, number_of
            cell = model.cell_of(words, 0, 0)[v]
            hot = np.flatnonzero((model.hot_at(words) >= 0)[v])
            cell[hot] = model.dealt(shorts[u[hot]], words[v[hot]], shorts[w[hot]])
            order = np.argsort(cell, kind="stable")
            cells, starts = np.unique(cell[order], return_index=True)
            ids = np.array([i or 0 for i, _ in held], dtype=np.int64)
            flags = np.array([(i is not None) | held_out(i) << 1 for i, _ in held], dtype=np.uint8)
            docs = pa.compress(np.array([len(held)], dtype=np.int64).tobytes() + ids.tobytes() + flags.tobytes(), codec="zstd", asbytes=True)
            head = np.array([8 + 9 * len(held)], dtype=np.int64).tobytes() + docs
            place = np.zeros(len(words), dtype=np.int32)

            def renumbered(*parts: np.ndarray) -> tuple[np.ndarray, ...]:
                """The numbers that occur, sorted, and each part by their places."""
                mark = np.zeros(len(words), dtype=bool)
                for p in parts:
                    mark[p] = True
                used = np.flatnonzero(mark)
                place[used] = np.arange(len(used), dtype=np.int32)
                return used, *(place[p] for p in parts)

            for c, own in zip(cells.tolist(), np.split(order, starts[1:])):
                vs, vi = renumbered(v[own])
                near, ui, wi = renumbered(u[own], w[own])
                by = np.argsort(vi.astype(np.int64) * len(near) + ui, kind="stable")
                tokens = _packed(words[vs].tobytes(), _sorted_unique(shorts[near]), np.bincount(vi, minlength=len(vs)), ui[by], wi[by], doc[own][by])
                yield pa.RecordBatch.from_pydict({"cell": pa.array([c], pa.int32()), "chunk": [(part << 32) + number], "docs": [head], "tokens": [tokens]})

        held, size = [], 0
        for b in batches:
            for doc_id, h in _rows(b):
                held.append((doc_id, _trigrams(h)))
                size += len(h) + 1
                if size >= CHUNK:
                    yield from made(held)
                    held, size, number = [], 0, number + 1
        if held:
            yield from made(held)

    return run


def _docs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int(np.frombuffer(data, np.int64, 1)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint8, n, 8 + 8 * n)


# The trie of a cell


class Trie:
    """Levels of one cell in one buffer, read in place.

    v: sorted middle words (vocabulary) with their counts and back-off weights. Pointers
    from v to its successors w, and the successors as v * words + w; contexts (v, u) as
    v * words + u, with back-off weights; pointers from a context to where its ranks
    begin, and trigrams as pointer + rank of w among the successors of v."""

    def __init__(self, buffer: bytes):
        view, at = memoryview(buffer), 0
        nv, nw, n_pairs, n_contexts, n_trigrams = np.frombuffer(view, np.int64, 5, 0).tolist()
        at, plain = 40, []
        for kind, n in ((np.uint64, nv), (np.int64, nv), (np.uint64, nw), (np.uint16, nv), (np.uint16, n_pairs), (np.uint16, n_contexts), (np.uint16, n_trigrams)):
            plain.append(np.frombuffer(view, kind, n, at))
            at += (n * np.dtype(kind).itemsize + 7) // 8 * 8
        self.vs, self.v_count, self.words, self.v_weight, self.pair_p, self.context_weight, self.trigram_p = plain
        self.levels = []
        for _ in range(5):
            level, at = EliasFano.read(view, at)
            self.levels.append(level)
        self.pair_from, self.pairs, self.contexts, self.trigram_from, self.trigrams = self.levels

    @staticmethod
    def built(vs: np.ndarray, v_count: np.ndarray, words: np.ndarray, pairs: np.ndarray, pair_n: np.ndarray, contexts: np.ndarray, context_n: np.ndarray, trigrams: np.ndarray, trigram_n: np.ndarray, p1: np.ndarray) -> bytes:
        """pairs: v * words + w; contexts: v * words + u; trigrams: place of the context * words + w; all sorted."""
        nw = max(1, len(words))
        pair_v = pairs // nw
        p2 = (pair_n + MU2 * p1[pairs % nw]) / (v_count[pair_v] + MU2)
        context = trigrams // nw
        context_v = contexts // nw
        pair = np.searchsorted(pairs, context_v[context] * nw + trigrams % nw)
        p3 = (trigram_n + MU3 * p2[pair]) / (context_n[context] + MU3)
        pair_from = np.searchsorted(pair_v, np.arange(len(vs) + 1))
        room = np.diff(pair_from)[context_v]
        trigram_from = np.concatenate(([0], np.cumsum(room)))[: len(contexts)]
        ranked = trigram_from[context] + pair - pair_from[context_v[context]]
        out = [np.array([len(vs), len(words), len(pairs), len(contexts), len(trigrams)], dtype=np.int64).tobytes()]
        for a in (vs.astype(np.uint64), v_count.astype(np.int64), words.astype(np.uint64), quantised(MU2 / (v_count + MU2)), quantised(p2), quantised(MU3 / (context_n + MU3)), quantised(p3)):
            data = a.tobytes()
            out += [data, bytes(-len(data) % 8)]
        for level in (pair_from, pairs, contexts, trigram_from, ranked):
            out += EliasFano.of(level).written()
        return b"".join(out)

    def steps(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """-log10 p(w | u v) in steps, for indexes into vs and words, -1 where not learnt."""
        nw = max(1, len(self.words))
        known = v >= 0
        pair = np.where(known & (w >= 0), self.pairs.find(np.where(known & (w >= 0), v * nw + w, -1)), -1)
        context = np.where(known & (u >= 0), self.contexts.find(np.where(known & (u >= 0), v * nw + u, -1)), -1)
        out = np.zeros(len(v), dtype=np.int64)
        seen = pair >= 0
        out[seen] = self.pair_p[pair[seen]]
        out[~seen] = quantised(p1[~seen])
        weighed = ~seen & known
        out[weighed] += self.v_weight[v[weighed]]
        in_context = context >= 0
        out[in_context] += self.context_weight[context[in_context]]
        both = np.flatnonzero(in_context & seen)
        if len(both):
            rank = pair[both] - self.pair_from[v[both]]
            trigram = self.trigrams.find(self.trigram_from[context[both]] + rank)
            found = trigram >= 0
            out[both[found]] = self.trigram_p[trigram[found]]
        return out


class Cell:
    """The tokens of one cell, from all chunks, as indexes into vs (middle words) and near."""

    def __init__(self, rows: list[dict], hot: pa.Table, model: Model):
        parts = [_unpacked(r["tokens"]) for r in rows]
        each_v = [np.frombuffer(p[0], np.uint64) for p in parts]
        each_near = [EliasFano.read(memoryview(p[1]), 0)[0].values() for p in parts]
        pick = lambda c: hot[c].to_numpy().astype(np.int64) if hot.num_rows else np.empty(0, np.int64)
        hot_v, hot_other, hot_side, hot_n = pick("v").view(np.uint64), pick("other"), pick("side"), pick("n")
        self.vs, self.near = np.unique(np.concatenate([*each_v, hot_v])), np.unique(np.concatenate([*each_near, hot_other]))
        nw = max(1, len(self.near))
        self.docs = [_docs(r["docs"]) for r in rows]
        v, u, w, doc, learnt = [], [], [], [], []
        for k, p in enumerate(parts):
            # Whole arrays of a cell in 32 bits, until they are multiplied.
            v.append(np.repeat(np.searchsorted(self.vs, each_v[k]).astype(np.int32), p[2]))
            at = np.searchsorted(self.near, each_near[k]).astype(np.int32)
            u.append(at[p[3]])
            w.append(at[p[4]])
            doc.append(p[5].astype(np.int32))
            learnt.append(self.docs[k][1][p[5]] < 2)
        self.sizes = [len(x) for x in doc]
        self.v, self.u, self.w, self.doc, self.learnt = (np.concatenate(x) for x in (v, u, w, doc, learnt))
        del parts, v, u, w, doc, learnt
        # One array of 64 bits at a time, besides those that sorting takes.
        lv, lu, lw = (x[self.learnt] for x in (self.v, self.u, self.w))
        key = lambda a, b: a.astype(np.int64) * nw + b
        # A spread word's pairs are counted over its whole grid, those of others here.
        spread = model.hot_at(self.vs)
        here = spread[lv] < 0
        hot_at = np.searchsorted(self.vs, hot_v) * nw + np.searchsorted(self.near, hot_other)
        self.pairs, self.pair_n = self._counted(key(lv[here], lw[here]), hot_at[hot_side == 0], hot_n[hot_side == 0])
        self.contexts, self.context_n = self._counted(key(lv[here], lu[here]), hot_at[hot_side == 1], hot_n[hot_side == 1])
        self.v_count = np.bincount(lv, minlength=len(self.vs))
        self.v_count[spread >= 0] = model.hot_n[spread[spread >= 0]] if len(model.hot) else 0
        context = np.searchsorted(self.contexts, key(lv, lu)).astype(np.int32)
        del lv, lu, here
        self.trigrams, place, self.trigram_n = np.unique(key(context, lw), return_inverse=True, return_counts=True)
        self.place = place.astype(np.int32)
        del context, lw, place
        self.p1 = model.p1(self.near.astype(np.uint64))

    @staticmethod
    def _counted(keys: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, counts = np.unique(keys, return_counts=True)
        both = np.concatenate((own, more))
        order = np.argsort(both, kind="stable")
        return both[order], np.concatenate((counts, n))[order]

    def trie(self) -> bytes:
        return Trie.built(self.vs, self.v_count, self.near, self.pairs, self.pair_n, self.contexts, self.context_n, self.trigrams, self.trigram_n, self.p1)

    def steps(self, trie: Trie) -> np.ndarray:
        """-log10 p of every token, in steps."""
        out = np.zeros(len(self.v), dtype=np.int32)
        out[self.learnt] = trie.trigram_p[self.place]
        ask = np.flatnonzero(~self.learnt)
        out[ask] = trie.steps(*(x[ask].astype(np.int64) for x in (self.v, self.u, self.w)), self.p1[self.w[ask]])
        return out


_SUMS = "chunk long, docs binary, sums binary"


def _scored(sent):
    """One cell -> for each chunk, the sums of its documents here."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model: Model = sent.value
        rows = left.to_pylist()
        out = {"chunk": [], "docs": [], "sums": []}
        if rows:
            cell = Cell(rows, right, model)
            steps = cell.steps(Trie(cell.trie()))
            real = cell.vs[cell.v] != np.uint64(START)
            count = cell.v_count[cell.v]
            base = np.where(real, np.log10(count + 0.5), 0.0)
            known = real & (count > 0)
            end = np.cumsum(cell.sizes)
            for r, (ids, _), n, stop in zip(rows, cell.docs, cell.sizes, end.tolist()):
                at = slice(stop - n, stop)
                doc = cell.doc[at]
                has = np.flatnonzero(np.bincount(doc, minlength=len(ids)))
                total = lambda x: np.bincount(doc, weights=x[at], minlength=len(ids))[has]  # noqa: E731, B023
                sums = _packed(has, np.bincount(doc, minlength=len(ids))[has], total(known).astype(np.int64), total(steps).astype(np.int64), total(base).tobytes())
                out["chunk"].append(r["chunk"])
                out["docs"].append(r["docs"])
                out["sums"].append(sums)
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "docs": pa.array(out["docs"], pa.binary()), "sums": pa.array(out["sums"], pa.binary())})

    return run


def _tries(sent):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        return pa.table({"cell": pa.array([r["cell"] for r in rows[:1]], pa.int32()), "trie": pa.array([Cell(rows, right, sent.value).trie()] if rows else [], pa.binary())})

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _added_up(sent):
    """One chunk -> its documents with the sums over all cells."""

    def run(rows: pa.Table) -> pa.Table:
        model: Model = sent.value
        ids, flags = _docs(rows["docs"][0].as_py())
        n, known, steps, base = (np.zeros(len(ids)) for _ in range(4))
        for s in rows["sums"].to_pylist():
            has, count, k, p, b = _unpacked(s)
            n[has] += count
            known[has] += k
            steps[has] += p
            base[has] += np.frombuffer(b, np.float64)
        # The end is a token of every document; it is learnt where any document is.
        known += model.docs > 0
        base += math.log10(model.docs + 0.5)
        base -= n * math.log10(model.tokens + 0.5 * (model.types + 1))
        as_long = lambda x: pa.array(x.astype(np.int64))
        return pa.table({"doc_id": pa.array(ids, mask=flags % 2 == 0), "held_out": pa.array(flags >= 2), "n_tokens": as_long(n), "n_known": as_long(known), "train_tokens": pa.array(np.full(len(ids), model.tokens)), "base_score": pa.array(base), "score": pa.array(-steps / STEPS)})

    return run


def _met(docs: DataFrame, cell: int, work, schema: str):
    """work over every cell, and the model's shared part as sent to executors."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = staged(plain.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    model = Model(counted, cell)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    pairs = "v long, side int, other long, n long"
    if len(model.hot):
        summed = plain.mapInArrow(_hot_pairs(sent), pairs).groupBy("v", "side", "other").agg(F.sum("n").alias("n"))
        hot = summed.mapInArrow(_to_grid(sent), f"cell int, {pairs}")
    else:
        hot = docs.sparkSession.createDataFrame([], f"cell int, {pairs}")
    dealt = plain.mapInArrow(_dealt(sent), _DEALT)
    return dealt.groupBy("cell").cogroup(hot.groupBy("cell")).applyInArrow(work(sent), schema), sent


def tries(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """docs(doc_id, text, ...) -> cell, trie: the model learnt, one buffer per cell."""
    return _met(docs, cell, _tries, "cell int, trie binary")[0]


def scored(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score: one row per row of docs.

    A document is held out when crc32 of its id, as text, is 1 modulo 5; the model learns
    from all others, those without an id included. A null or empty text is an end alone.
    Rows that repeat an id or a text are documents of their own. score is the log10
    probability of the words and the end, each rounded to 1 / STEPS."""
    found, sent = _met(docs, cell, _scored, _SUMS)
    return found.groupBy("chunk").applyInArrow(_added_up(sent), _RESULT)
