"""MinHash, line and vector dedup against brute force."""

import random
import re

import numpy as np
import pytest

from tracewell.llm import buckets, components, lines, minhash, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, doc string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = WORD.findall(lowered(text))
    if 0 < len(w) < k:
        return {tuple(w)}
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def groups(ids, links):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((top(a), top(b)))
        root[q] = p
    return {i: top(i) for i in ids}


def corpus(seed=3, n=120):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(n):
        kind = rnd.random()
        if texts and kind < 0.3:
            words = rnd.choice(texts).split(" ")
            for _ in range(rnd.randint(0, max(1, len(words) // 8))):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            texts.append(" ".join(words))
        elif texts and kind < 0.4:
            texts.append(rnd.choice(texts).upper())
        else:
            texts.append(" ".join(rnd.choices(vocab, k=rnd.randint(1, 60))))
    return [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "x" * 50_000 + " y z"), (n + 4, "one"), (n + 5, "ONE")]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = corpus()
    sets = {i: shingles(t, k) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS), k=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    same = [(7, "a b c d e f", ""), (7, "a b c d e f", ""), (None, "a b c d e f", ""), (3, "a b c d e f", "")]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(same, DOCS)).collect()), key=str)
    assert got == sorted([(7, 2, 3, False), (7, 2, 3, False), (None, 2, None, True), (3, 2, 3, True)], key=str)
    kept = minhash.keep_one_of_each_group(spark.createDataFrame(same, DOCS))
    assert kept.columns == ["doc_id", "text", "doc"] and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3]


def test_large_group_of_near_copies(spark):
    rnd = random.Random(5)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(3):
            w[rnd.randrange(120)] = f"u{rnd.random()}"
        rows.append((i, " ".join(w), ""))
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), k=2).collect()
    sets = {i: shingles(t, 2) for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_in_a_family_of_dissimilar_copies(spark):
    rnd = random.Random(8)
    base = [f"v{i}" for i in range(61)]
    rows = []
    for i in range(1000):
        w = list(base)
        for at in rnd.sample(range(61), 3):
            w[at] = f"u{rnd.randrange(3)}"
        rows.append((i, " ".join(w), ""))
    sets = {i: shingles(t, 2) for i, t, _ in rows}
    pairs = [(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b]
    assert 0.65 < sum(i / u for _, _, i, u in pairs) / len(pairs) < 0.8
    want = groups(sets, [(a, b) for a, b, i, u in pairs if 100 * i >= 80 * u])
    assert len(set(want.values())) > 1
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), k=2).collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 501), (501, 502), (9, 9), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 500: 500, 501: 500, 502: 500}


@pytest.mark.parametrize("chunk", (7, 1 << 18))
def test_components_in_chunks_of_any_size(spark, chunk):
    rnd = random.Random(4)
    edges = [(rnd.randrange(900), rnd.randrange(900)) for _ in range(500)] + [(1000, 2000 + i) for i in range(300)] + [(1000, 2000)] * 5
    for i in range(0, len(edges), chunk):
        part = np.array(edges[i : i + chunk])
        ends = components.stars(part[:, 0], part[:, 1])
        assert dict(zip(*(x.tolist() for x in ends))) == {n: c for n, c in groups({n: 0 for n in part.ravel().tolist()}, part.tolist()).items() if n != c}
    rows = components.components(spark.createDataFrame(edges, "a long, b long").repartition(9), chunk).collect()
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert len(rows) == len(linked) and {r.node: r.component for r in rows} == groups(dict.fromkeys(linked), [e for e in edges if e[0] != e[1]])


def norm(line):
    folded = "".join("0" if c.isascii() and c.isdigit() else c if c.isalpha() or not c.isascii() else " " for c in line.lower())
    return folded.split()


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (x != y)))
        prev = now
    return prev[-1]


def alike(a, b):
    a, b = " ".join(norm(a)), " ".join(norm(b))
    return lines.within(a, b, max(len(a), len(b)) * 20 // 100)  # held to edits() below


def line_groups(rows):
    """Brute force by plain edit similarity, no sketch: the lines that go."""
    places = sorted((d, n, line) for d, t in rows if t and d is not None for n, line in enumerate(t.split("\n")) if norm(line))
    links = [(j, i) for i in range(len(places)) for j in range(i) if alike(places[i][2], places[j][2])]
    root = groups(range(len(places)), links)
    return {places[i][:2] for i in root if root[i] != i}


def made_up(rnd, n):
    return ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzé", k=rnd.randint(3, 9))) for _ in range(n)]


def edited(rnd, words, most):
    """words with one change for every few words: replaced, left out or put in."""
    w = list(words)
    for _ in range(rnd.randint(1, max(1, int(len(w) * most)))):
        at = rnd.randrange(len(w))
        w[at : at + rnd.choice((0, 1, 1, 1))] = made_up(rnd, rnd.choice((0, 1, 1, 1)) if len(w) > 6 else 1)
    return w


def test_lines_equal_brute_force(spark):
    rnd = random.Random(11)
    pool = [" ".join(made_up(rnd, rnd.randint(1, 40))) for _ in range(40)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(rnd.randint(1, 6)):
            line = rnd.choice(pool)
            if rnd.random() < 0.3:
                line = line.upper() + "!!"
            elif rnd.random() < 0.3 and line.count(" ") > 24:
                line = " ".join(edited(rnd, line.split(" "), 0.02)) + " 12"
            own.append(line)
        rows.append((d, "\n".join(own)))
    rows += [(90, None), (91, ""), (92, " - \n\n..."), (None, pool[0]), (93, "y" * 5000 + " z\n" + " ".join(["q"] * 3000)), (94, " ".join(["q"] * 2999) + "\n" + "y" * 5000 + " z")]
    want = line_groups([r for r in rows if r[0] not in (93, 94)]) | {(94, 0), (94, 1)}
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, dropped string")
    assert {(r.doc_id, r.line_no) for r in lines.repeated_lines(df).collect()} == want
    out = {r.doc_id: r for r in lines.deduped(df).collect()}
    assert len(out) == len(rows) and out[90].n_lines == 0 and all(out[d].n_dropped == sum(p[0] == d for p in want) for d, _ in rows)
    left = lines.drop_repeated_lines(df)
    assert left.columns == df.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    for d, t in rows:
        kept = [x for n, x in enumerate((t or "").split("\n")) if (d, n) not in want]
        assert texts.get(d) == (t if t is None else "\n".join(kept)) if kept else d not in texts
    assert lines.repeated_lines(df.limit(0)).count() == 0


def test_lines_recall_against_plain_edit_similarity(spark):
    rnd = random.Random(12)
    rows, true = [], 0
    for i in range(400):
        base = made_up(rnd, int(8 * 1.01 ** rnd.randrange(250)))
        other = edited(rnd, base, 0.2)
        if alike(" ".join(base), " ".join(other)):
            rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
            true += 1
        else:
            rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(made_up(rnd, 9)))]
    gone = {r.doc_id for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert true > 150 and all(d % 2 and alike(texts[d], texts[d - 1]) for d in gone)
    assert len(gone) >= 0.9 * true


def test_lines_recall_in_every_class_of_short_lines(spark):
    rnd = random.Random(21)
    rows, classes = [], {}

    def typo(w: str) -> str:
        at = rnd.randrange(len(w))
        return w[:at] + rnd.choice("abcdefgh") * rnd.randint(0, 2) + w[at + rnd.randint(0, 1) :] or "a"

    for n in range(1, 12):
        for kind in (1, 2, 3, "word"):
            met = 0
            for _ in range(400):
                base = made_up(rnd, n)
                other = edited(rnd, base, 0.2) if kind == "word" else list(base)
                for at in rnd.sample(range(n), min(n, kind)) if kind != "word" else ():
                    other[at] = typo(other[at])
                if base != other and alike(" ".join(base), " ".join(other)) and met < 25:
                    met += 1
                    classes.setdefault((n, kind), []).append(len(rows) + 1)
                    rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    gone = {r.doc_id for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert all(alike(texts[d], texts[d - 1]) for d in gone if d % 2)
    recall = {c: sum(d in gone for d in ids) / len(ids) for c, ids in classes.items() if len(ids) >= 10}
    assert {n for n, _ in recall} == set(range(1, 12)) and min(recall.values()) >= 0.9, recall


def test_lines_of_repeated_doc_ids(spark):
    line = "one two three four five six seven eight nine ten eleven twelve"
    swapped = "seven eight nine ten eleven twelve one two three four five six"
    rows = [(1, "x"), (1, f"a b c d e f g\nsome other line\n{line}"), (2, swapped), (1, None), (3, f"new\n{line}"), (3, f"new\n{line}"), (None, "x"), (None, "x")]
    got = lines.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_lines, list(r.dropped)) for r in got) == sorted([(1, 1, []), (1, 3, []), (2, 1, []), (1, 0, []), (3, 2, [1]), (3, 2, [1]), (0, 1, []), (0, 1, [])])


def test_lines_that_a_star_leaves_apart(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        half, other = made_up(rnd, 12), made_up(rnd, 12)
        a, b = half + other, half[:4] + other + half[4:]
        rows += [(3 * i, " ".join(a)), (3 * i + 1, " ".join(b)), (3 * i + 2, " ".join(b) + "x")]
    gone = {r.doc_id for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone == {d for d, _ in line_groups(rows)} and len(gone) >= 60


def test_edit_bound():
    rnd = random.Random(7)
    for _ in range(500):
        a = "".join(rnd.choices("abc", k=rnd.randint(0, 30)))
        b = "".join(rnd.choices("abc", k=rnd.randint(0, 30))) if rnd.random() < 0.5 else "".join(c for c in a if rnd.random() < 0.9)
        w = rnd.choices([a, b, "é", "xyz"], k=rnd.randint(1, 12))
        if rnd.random() < 0.5:
            a, b = " ".join(w), " ".join(edited(rnd, w, 0.3))
        for most in (0, 2, 7, 40):
            assert lines.within(a, b, most) == (edits(a, b) <= most)


@pytest.mark.parametrize("by_family", [True, False])
def test_large_buckets_are_parted(spark, monkeypatch, by_family):
    monkeypatch.setattr(buckets, "PART", 16)
    monkeypatch.setattr(buckets, "CELLS", 16)
    monkeypatch.setattr(buckets, "SMALL", 8)
    rows = [(1, i) for i in range(200)] + [(2, i) for i in range(300, 303)] + [(b, 400 + b) for b in range(10, 14)]
    df = spark.createDataFrame(rows, "bucket long, node long")
    assert buckets.light_and_parted(df).groupBy("bucket").count().where("count > 64").count() == 0
    traits = df.selectExpr("node", "100L as size", "if(node < 300, node % 7, 0L) as s")
    alike = lambda a, b: a % 14 == b % 14 or min(a, b) >= 300
    close = lambda x, i, j: x["s"][i] == x["s"][j]
    exact = lambda payloads: lambda i, js: np.asarray([alike(int(payloads[i]), int(payloads[j])) for j in js.tolist()], dtype=bool)
    got = buckets.linked(df, traits, close, lambda pairs: pairs.where("a % 14 = b % 14 or a >= 300"), lambda ids: ids.selectExpr("node", "cast(cast(node as string) as binary) as payload"), exact, by_family)
    assert {r.node: r.component for r in got.collect()} == {**{i: i % 14 for i in range(200)}, **dict.fromkeys((300, 301, 302), 300)}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(200):
        v = base[i % 30] + rng.normal(size=16) * 0.05 * (i % 4)
        rows.append((i, [float(x) for x in v], i % 3))
    rows += [(200, rows[0][1], 0), (201, [2 * x for x in rows[0][1]], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, [1.0, None], 0), (206, rows[0][1], None), (207, [], 0), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0)]
    good = {i: np.asarray(v, dtype=float) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: lab for i, _, lab in rows}

    def linked(a, b):
        x, y = good[a], good[b]
        return label[a] == label[b] and len(x) == len(y) and float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) >= 0.98

    links = [(a, b) for a in good for b in good if a < b and linked(a, b)]
    root = groups([r[0] for r in rows], links)
    n = {i: sum(i in p for p in links) for i in root}
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, block string")
    for block in (8, 1024):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.linked(df, 0.98, block).collect()}
        assert got == {i: (n[i], root[i], root[i] == i) for i in root}
    assert vectors.linked(df.limit(0)).count() == 0


def test_rows_of_small_buckets_are_not_opened(spark, monkeypatch):
    rows = spark.createDataFrame([(b, n) for b in range(3) for n in range(4)], "bucket long, node long")
    assert buckets.parted(rows, "bucket") is rows
    monkeypatch.setattr(buckets, "PART", 5)
    mixed = rows.unionByName(spark.createDataFrame([(9, n) for n in range(12)], "bucket long, node long"))
    got = [tuple(r) for r in buckets.parted(mixed, "bucket").collect()]
    assert sum(0 <= b < 9 for b, _ in got) == 12 and all(b & buckets.OWN for b, _ in got if not 0 <= b < 9)
    held = {}
    for b, n in got:
        held.setdefault(b, set()).add(n)
    assert all(any({i, j} <= h for b, h in held.items() if b & buckets.OWN) for i in range(12) for j in range(12))


def test_pairs_of_a_bucket_are_compared_once():
    seen = []

    def exact(payloads):
        return lambda i, js: seen.extend(frozenset((i, int(j))) for j in js) or np.zeros(len(js), dtype=bool)

    x = {"component": np.arange(5)}
    assert buckets.joining_edges(x, [b""] * 5, lambda x, i, j: np.ones(len(j), dtype=bool), exact) == []
    assert len(seen) == len(set(seen)) == 10


def test_pairs_of_lines_are_compared_in_the_bucket_of_their_first_block():
    x = {"size": np.array([9, 9, 9]), "s1": np.zeros(3, np.uint64), "s2": np.zeros(3, np.uint64)}
    x |= {"x0": np.array([5 << 32 | 7, 5 << 32 | 7, 6 << 32 | 7], np.uint64), "x1": np.zeros(3, np.uint64), "x2": np.zeros(3, np.uint64)}
    others = np.array([1, 2])
    at = lambda bucket: lines._close_here(x | {"bucket": np.full(3, bucket)}, 0, others).tolist()
    assert at(5) == [True, True] and at(1 << 32 | 7) == [False, True] and at(buckets.OWN | 1 << 32 | 7) == [True, True]
