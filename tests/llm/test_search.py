"""Hard negatives and vector codes against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import codes, negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, d=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d))
    rows = []
    for i in range(n):
        label = int(rng.integers(4))
        x = centres[label] + 0.7 * rng.normal(size=d)
        rows.append((i, (x / np.linalg.norm(x)).astype(np.float32).tolist(), label))
    return rows + [(n + i, v, c) for i, (_, v, c) in enumerate(rows[: n // 10])]


ODD = [(9000, None, 1), (9001, [], 1), (9002, [1.0, None] * 8, 1), (9003, [float("nan")] * 16, 2), (9004, [float("inf")] * 16, 2)]


def brute_negatives(rows, positives=5, k=10):
    rows = [(i, np.floor(np.asarray(v, dtype=np.float64) * 256).astype(np.int64), c) for i, v, c in rows]
    out = []
    for a, v, c in rows:
        if a is None or a % 10:
            continue
        ranked = sorted((-int(v @ x), i, d) for i, x, d in rows if i != a)
        for s, p, _ in [r for r in ranked if r[2] == c][:positives]:
            window = [(n, i) for n, i, d in ranked if d != c and 30 * -s <= 100 * -n <= 90 * -s][:k]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(window)]
    return sorted(out)


def mined(df, **small):
    return sorted(tuple(r) for r in negatives.mined(df, F.col("vec_id") % 10 == 0, **small).collect())


def test_negatives_equal_brute_force_over_many_small_segments(spark):
    rows = vectors(300)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + ODD + [(None, rows[0][1], 0), (9010, rows[0][1], None)]], SCHEMA + ", rank int, score string").repartition(5)
    got = mined(df, cells=4, segment=40, anchors=7, run=2, sample=50)
    assert got == brute_negatives(rows) and len(got) > 500
    assert got == mined(df)


def test_negatives_of_ties_and_of_huge_components(spark):
    same = [(i, [1.0, 0.0], i % 2) for i in range(60)] + [(100 + i, [0.5, 0.5], i % 2) for i in range(40)]
    assert mined(spark.createDataFrame(same, SCHEMA), segment=16) == brute_negatives(same)
    huge = [(i, [1e38 * (1 + i), -1e38], i % 3) for i in range(20)]
    assert all(r[4] <= 2**55 for r in mined(spark.createDataFrame(huge, SCHEMA)))
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    far = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [-0.5, 0.0], 1)]
    assert mined(spark.createDataFrame(far, SCHEMA)) == []


def test_negatives_of_far_components_keep_their_exact_scores(spark):
    rng = np.random.default_rng(8)
    far = [(i, [x * s for x in rng.normal(size=8).tolist()], i % 3) for i, s in enumerate([1.0, 3e4, 1e6, 2e6] * 40)]
    # Parts that cancel out, and a component past every long beside zeros.
    far += [(200 + i, [3e6, 3e6, 1.0 + i, 0.0, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(20)] + [(220 + i, [3e6, -3e6, 9.0 + i, 0.0, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(20)]
    double = SCHEMA.replace("float", "double")
    assert mined(spark.createDataFrame(far, double), segment=30, cells=4, anchors=7) == brute_negatives(far)
    past = [(i, [float(1 + i), 0.0 if i != 3 else 1e30], i % 2) for i in range(40)]
    plain = [(i, [v[0], 0.0], c) for i, v, c in past]
    assert mined(spark.createDataFrame(past, double), segment=16) == brute_negatives(plain)
    assert negatives.dots(np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 5.0], [2.0**20, 3.0], [-(2.0**60), 2.0]])).tolist() == [[negatives.LONG, 2**60 + 3, -negatives.LONG]]


def test_cells_come_by_falling_bound_and_hold_every_row():
    rng = np.random.default_rng(1)
    v = rng.integers(-200, 200, size=(500, 8))
    books = tuple(negatives.fitted(h, 6) for h in negatives.halves(v))
    c = [negatives.nearest(h.astype(float), b) for h, b in zip(negatives.halves(v), books)]
    cells = (c[0] << 32) | c[1]
    at = np.argsort(cells)
    flat = {k: x.astype(np.int64).tobytes() for k, x in {"rids": at, "ids": at, "labels": at, "cells": cells[at], "v": v[at]}.items()}
    s = negatives.Segment({"n": 500, **flat}, books)
    first, second = s.half_bounds(v[:3])
    for i in range(3):
        seen, last = [], np.inf
        for bound, cell in s.visited(first[i], second[i]):
            rows = np.arange(s.starts[cell], s.ends[cell])
            assert bound <= last and (s.v[rows] @ v[i]).max() <= bound
            seen, last = [*seen, *rows], bound
        assert sorted(seen) == list(range(500))


def brute_codes(rows, parts=8, entries=16, rounds=6):
    x = {i: np.floor(np.asarray(v, dtype=np.float64) * 4096).astype(np.int64).reshape(parts, -1) for i, v, _ in rows}
    ids = sorted(x)
    book, every = np.stack([x[i] for i in ids[:entries]], 1), np.stack([x[i] for i in ids], 1)
    for r in range(rounds + 1):
        d = ((every[:, :, None] - book[:, None]) ** 2).sum(-1)
        near = d.argmin(-1)
        for p in range(parts if r < rounds else 0):
            for e in np.unique(near[p]):
                at = near[p] == e
                book[p, e] = every[p][at].sum(0) // at.sum()
    error = dict(zip(ids, d.min(-1).sum(0).tolist()))
    by_label = defaultdict(int)
    for i, _, c in rows:
        by_label[c] += error[i]
    sha = hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()
    return {i: (bytes(near[:, k].tolist()).hex(), error[i], by_label[c], sha) for k, (i, c) in enumerate((i, dict((r[0], r[2]) for r in rows)[i]) for i in ids)}


def test_codes_equal_brute_force(spark):
    rows = [(i, v, None if i % 5 == 0 else c) for i, v, c in vectors(400, d=32)]
    random.Random(2).shuffle(rows)
    odd = [(i, v and v * 2, c) for i, v, c in ODD if v != []]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows + odd], SCHEMA + ", code string, part int")
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compressed(df, block=32).collect()}
    assert got == brute_codes(rows)
    few = rows[:5]
    assert {r[0]: tuple(r[1:]) for r in codes.compressed(spark.createDataFrame(few, SCHEMA)).collect()} == brute_codes(few)


def test_codes_of_odd_vectors(spark):
    assert codes.compressed(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, [], 1), (1, [], 1), (None, [0.5] * 11, 1), (2, [0.25] * 11, None), (3, [3e38] * 11, 1), (4, [-3e38] * 11, 1), (5, [0.1], 2)]
    got = codes.compressed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(len(r.code) == 16 and r.error >= 0 and r.label_error >= r.error for r in got)
    assert {r.code for r in got if r.vec_id == 1} == {"00" * 8}


def test_hilbert_neighbours_touch_and_shortlists_keep_the_nearest():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = codes.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert set(np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1).tolist()) == {1}
    rng = np.random.default_rng(5)
    for _ in range(50):
        points, entries = rng.integers(-20, 20, size=(30, 4)) + rng.integers(-40, 40, size=4), rng.integers(-60, 60, size=(16, 4))
        short = codes.shortlist(points.min(axis=0), points.max(axis=0), entries)
        for mine, full in zip(codes.nearest(points, entries, short), codes.nearest(points, entries, np.arange(16))):
            assert mine.tolist() == full.tolist()
