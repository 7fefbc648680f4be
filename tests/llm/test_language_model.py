"""Language-model scores against a dictionary of counts, and the sequences they rest on."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tracewell.llm import language_model as lm
from tracewell.llm.eliasfano import EliasFano

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_sequences_find_what_they_hold():
    rng = np.random.default_rng(0)
    for n, most in ((0, 1), (1, 1), (1, 5), (10, 11), (1000, 2**40), (5000, 9000), (3000, 2**60)):
        v = np.unique(rng.integers(0, most, n))
        e, at = EliasFano.read(memoryview(b"".join(EliasFano.of(v).written())), 0)
        assert e.values().tolist() == v.tolist()
        ask = np.concatenate((v, v + 1, rng.integers(0, most + 9, 500), [-1]))
        where = {x: i for i, x in enumerate(v.tolist())}
        assert e.find(ask).tolist() == [where.get(x, -1) for x in ask.tolist()]
    clustered = np.concatenate((np.arange(4000), [2**50]))
    assert EliasFano.of(clustered).find(clustered).tolist() == list(range(4001))
    pointers = np.cumsum(rng.integers(0, 3, 500))
    assert EliasFano.of(pointers).values().tolist() == pointers.tolist()
    packed = EliasFano.of(np.unique(rng.integers(0, 2**48, 10_000)))
    assert sum(map(len, packed.written())) < 10_000 * 6


def words(text):
    return WORD.findall((text or "").translate(LOWER))


class Brute:
    def __init__(self, docs):
        self.c = [Counter(), Counter(), Counter()]
        self.after1, self.after2 = Counter(), Counter()
        for i, text in docs:
            if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
                t = ["<", "<", *words(text), ">"]
                for u, v, w in zip(t, t[1:], t[2:]):
                    self.c[0][w] += 1
                    self.c[1][v, w] += 1
                    self.c[2][u, v, w] += 1
                    self.after1[v] += 1
                    self.after2[u, v] += 1
        self.n, self.v = sum(self.c[0].values()), len(self.c[0])
        self.z = self.n + 0.5 * (self.v + lm.BUCKETS)
        self.mass, self.types = defaultdict(int), defaultdict(int)
        for w, n in self.c[0].items():
            if n * lm.FREQUENT < self.n:
                self.mass[self.bucket(w)] += n
                self.types[self.bucket(w)] += 1

    @staticmethod
    def bucket(w):
        return xxhash.xxh64_intdigest(b" end" if w == ">" else w.encode()) % lm.BUCKETS

    def p1(self, w):
        n, b = self.c[0][w], self.bucket(w)
        if n and n * lm.FREQUENT >= self.n:
            return (n + 0.5) / self.z
        return (self.mass[b] + 0.5 * self.types[b] + 0.5) / (self.types[b] + 1) / self.z

    def p(self, u, v, w):
        p2 = (self.c[1][v, w] + lm.MU2 * self.p1(w)) / (self.after1[v] + lm.MU2)
        return (self.c[2][u, v, w] + lm.MU3 * p2) / (self.after2[u, v] + lm.MU3)

    def row(self, i, text):
        t = ["<", "<", *words(text), ">"]
        out = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        base = sum(math.log10((self.c[0][w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in t[2:])
        score = sum(math.log10(self.p(u, v, w)) for u, v, w in zip(t, t[1:], t[2:]))
        return (i, out, len(t) - 2, sum(self.c[0][w] > 0 for w in t[2:]), self.n), base, score


def corpus(n=120):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(n):
        line = ["The" if rng.random() < 0.3 else vocabulary[int(rng.paretovariate(0.7)) % 300] for _ in range(rng.randrange(60))]
        docs.append((i, " ".join(line)))
    # Passages that many documents share, one text that is long, odd spaces and nothing.
    docs += [(1000 + i, docs[3][1]) for i in range(40)]
    docs += [(2000, " ".join(rng.choices(vocabulary, k=20_000))), (2001, None), (2002, ""), (2003, " \x0b a\tA\r\n\x1f É é"), (None, "the w1 w2"), (3, "repeated id"), (2004, "never seen words")]
    return docs


@pytest.mark.parametrize("cell", [100, 1 << 21])
def test_scores_equal_brute_force(spark, cell):
    docs = corpus()
    df = spark.createDataFrame([(*d, 1.0, "x") for d in docs], "doc_id long, text string, score double, cell string").repartition(3)
    got = defaultdict(list)
    for r in lm.scored(df, cell=cell).collect():
        got[r.doc_id].append(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens), r.base_score, r.score))
    brute = Brute(docs)
    assert sum(map(len, got.values())) == len(docs)
    for i, text in docs:
        want = brute.row(i, text)
        near = [g for g in got[i] if g[0] == want[0] and g[1] == pytest.approx(want[1], rel=1e-9) and abs(g[2] - want[2]) <= want[0][2] * 1.1 / lm.STEPS]
        assert near, (i, got[i], want)


def test_probabilities_sum_to_one():
    docs = corpus(40)
    brute = Brute(docs)
    known = [w for w in brute.c[0]]
    unknown = lm.BUCKETS * 0.5 / brute.z + sum((brute.mass[b] + 0.5 * brute.types[b] + 0.5) / (brute.types[b] + 1) / brute.z - 0.5 / brute.z for b in brute.types)
    assert sum(map(brute.p1, known)) + unknown == pytest.approx(1, abs=1e-9)
    for u, v in (("the", "the"), ("<", "<"), ("w1", "nothing")):
        rest = lm.MU3 / (brute.after2[u, v] + lm.MU3) * lm.MU2 / (brute.after1[v] + lm.MU2) * unknown
        assert sum(brute.p(u, v, w) for w in known) + rest == pytest.approx(1, abs=1e-9)


def test_the_model_is_compact_and_knows_contexts(spark):
    docs = corpus()
    tries = [lm.Trie(r.trie) for r in lm.tries(spark.createDataFrame(docs, "doc_id long, text string"), cell=3000).collect()]
    assert len(tries) > 3
    learnt = {(u, v, w) for i, text in docs if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for t in [["<", "<", *words(text), ">"]] for u, v, w in zip(t, t[1:], t[2:])}
    assert sum(len(t.trigram_p) for t in tries) == len(learnt)
    assert lm.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = lm.scored(spark.createDataFrame([(5, "a b")], "doc_id long, text string")).first()
    assert (only.n_tokens, only.train_tokens) == (3, 0 if only.held_out else 3)
