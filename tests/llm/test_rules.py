"""WARC, mixing, quality, packing, token counts, licences and URL rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from tracewell.llm import licences, mixing, packing, quality, tokencount, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "", None), (None, "u", big), (7, "u", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    assert warc.read_archive(spark, warc.write_archive(df, "2024-01-31T00:00:00Z")).where("not contains(decode(record, 'UTF-8'), 'WARC-Date: 2024-01-31T00:00:00Z')").count() == 0
    got = {r.page_id: r for r in warc.read_archive(spark, warc.write_archive(df)).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        body = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, bytes(r.payload)) == (len(body), hashlib.sha1(body).hexdigest(), body)
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        n = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n:] == b"\r\n\r\n" and b"X: y" not in head.split(b"\r\n")
        assert r.url == url and len(re.findall(rb"\r\nWARC-(?:Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ|Record-ID: <[^>]+>)(?=\r)", head)) == 2
        if r.record_type == "response":
            assert rest[:n].endswith(body)
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), None: ("revisit", 3), **{i: ("response", None) for i in (4, 5, 6, 7)}}
    assert warc.read_archive(spark, warc.write_archive(df.limit(0))).count() == 0


def test_warc_stores_each_payload_once_and_finds_damage(spark):
    df = spark.createDataFrame([(i, "u", "p" * 2000) for i in range(50)], "page_id long, url string, html string")
    made = warc.write_archive(df)
    stored = spark.read.parquet(made.payloads)
    assert stored.count() == 1
    bad = stored.selectExpr("sha256", "cast('other' as binary) as payload")
    bad.write.parquet(made.payloads + "-bad")
    with pytest.raises(Exception, match="payload damaged"):
        warc.read_archive(spark, made._replace(payloads=made.payloads + "-bad")).collect()


def mixed_rows(spark, sizes, weights, block):
    docs = [(i, s, "x") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    random.Random(1).shuffle(docs)
    out = mixing.mixed(spark.createDataFrame(docs, "doc_id long, source string, position string"), weights, block).collect()
    assert sorted(r.doc_id for r in out) == sorted(d[0] for d in docs)
    assert sorted(r.position for r in out) == list(range(len(docs)))
    return sorted(out, key=lambda r: r.position)


def test_mixing_stays_within_a_block(spark):
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    rows = mixed_rows(spark, {"a": 600, "b": 500, "c": 300, "d": 200}, weights, 4)
    slots = {}
    for r in rows:
        slots.setdefault(r.slot, r.source)
    order = [slots[s] for s in sorted(slots)]
    done = Counter()
    for t, s in enumerate(order, 1):
        done[s] += 1
        if done[s] * 4 >= {"a": 600, "b": 500, "c": 300, "d": 200}[s]:
            break
        for name, w in weights.items():
            assert abs(done[name] - t * w) < 1 + t / 1024
    assert t > 100


def test_mixing_of_odd_tables(spark):
    rows = mixed_rows(spark, {"a": 1, None: 5, "": 2}, None, 16)
    assert {r.source for r in rows} == {"a", ""}
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mixed(empty).count() == 0 and mixing.in_mixed_order(empty).count() == 0
    twice = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, "a", None)], "doc_id long, source string, text string")
    assert mixing.in_mixed_order(twice).count() == 3


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["doc_id", "source", "share", "t", "before", "n_of", "nth", "row", "n", "__position", "a.b"]
    rows = [(i if i % 3 else None, "ab"[i % 2], *[f"{c}{i}" for c in names[2:]]) for i in range(50)]
    docs = spark.createDataFrame(rows, names)
    out = mixing.in_mixed_order(docs)
    assert out.columns == names and sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, rows))
    assert mixing.mixed(docs).count() == 50


def test_mixing_keeps_columns_of_any_type(spark):
    rows = [(1, "a", {"k": 1}, bytearray(b"x")), (None, "a", {"k": 2}, None), (None, "b", None, bytearray(b"y"))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tags map<string, int>, raw binary")
    got = mixing.in_mixed_order(docs).collect()
    plain = lambda r: repr((r[0], r[1], r[2], r[3] and bytes(r[3])))
    assert sorted(map(plain, got)) == sorted(map(plain, rows)) and mixing.mixed(docs).count() == 3


def base(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def quality_tables(spark):
    rnd = random.Random(4)
    good = [f"g{i}" for i in range(60)]
    bad = [f"B{i}!!" for i in range(60)]
    rows, labels = [], []
    for i in range(120):
        words = rnd.choices(good if i % 3 else bad, k=rnd.randint(5, 80))
        rows.append((i, " ".join(words) + ("\nsame line\nsame line" if i % 7 == 0 else "")))
        if i % 2:
            labels.append((i, int(bool(i % 3)), 0))
    rows += [(200, None), (201, ""), (202, "a b c d e " * 30), (203, "é# \x0b\x0c é\n\n\n \n é"), (None, " ".join(good))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    return docs, spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int"), rows


def test_quality_counts_and_verdicts(spark):
    docs, labels, rows = quality_tables(spark)
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r, want = got[i], base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        if i is not None and i < 120:
            assert r.kept == (not r.base_failed and i % 3 != 0)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.values())


def test_quality_scores_equal_brute_force(spark):
    docs, labels, rows = quality_tables(spark)
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    slots = {i: quality.ngram_slots(quality.word_hashes((t or "").encode())) for i, t in rows}
    raw, good = Counter(), Counter()
    for i, s in slots.items():
        raw.update(s.tolist())
        if i in trusted:
            good.update(s.tolist())
    n, m = sum(raw.values()) + quality.SLOTS, sum(good.values()) + quality.SLOTS
    for r in quality.quality(docs, labels).collect():
        s = slots[r.doc_id].tolist()
        want = sum(math.log((good[x] + 1) / m) - math.log((raw[x] + 1) / n) for x in s) / len(s) if s else 0.0
        assert math.isclose(r.score, want, abs_tol=1e-9)


def test_quality_drops_toxic_documents_of_quality_1(spark):
    rnd = random.Random(6)
    kinds = ([f"g{i}" for i in range(60)], [f"t{i}" for i in range(60)], [f"B{i}!!" for i in range(60)])
    rows = [(i, " ".join(rnd.choices(kinds[i % 3], k=40))) for i in range(180)]
    labels = [(i, (1, 1, 0)[i % 3], (0, 1, 0)[i % 3]) for i in range(90)]
    labels += [(200, 1, None), (201, 0, None), (202, None, 1), (203, None, None), (204, 0, 1), (205, 1, 0), (205, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = {r.doc_id: r.trusted for r in quality.labelled_sample(labels).collect()}
    assert sample == {**{i: i % 3 == 0 for i in range(90)}, 201: False, 202: False, 204: False}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert all(got[i].kept == (i % 3 == 0 and not got[i].base_failed) for i, _ in rows)
    assert sum(r.kept for r in got.values()) > 50


def test_quality_without_labels_keeps_what_the_base_rules_keep(spark):
    docs, labels, _ = quality_tables(spark)
    assert all(r.kept != r.base_failed for r in quality.quality(docs, labels.limit(0)).collect())
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_quality_is_fitted_on_all_labels(spark):
    labels = spark.range(30_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    assert quality.labelled_sample(labels).count() == 30_000


def test_quality_threshold_equals_brute_force(spark):
    rnd = random.Random(3)
    for rows in ([(round(rnd.gauss(0.5 if t else 0, 1), 1 + 2 * (n % 2)), t) for _ in range(n) for t in (rnd.random() < 0.3,)] for n in (60, 401)):
        tries = []
        scores = sorted({s for s, _ in rows})
        for i, cut in enumerate(scores):
            error = sum(20 for s, t in rows if t and s < cut) + sum(1 for s, t in rows if not t and s >= cut)
            tries.append((error, cut, -math.inf if i == 0 else (cut + scores[i - 1]) / 2))
        got = quality.fitted_threshold(spark.createDataFrame(rows, "score double, trusted boolean"))
        assert got == min(tries)[2]
    for rows in ([], [(1.0, True)], [(1.0, False), (2.0, False)], [(1.0, True), (1.0, False)]):
        assert quality.fitted_threshold(spark.createDataFrame(rows, "score double, trusted boolean")) == -math.inf


def test_packing_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rnd = random.Random(9)
    vocab = ["the", "Éclair.", "don't", "x9,", "tion", "日本", "Σας", "a.b", "!!", "İx"]
    rows = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 900)))) for i in range(40)] + [(100, None), (101, ""), (102, "word " * 9000), (None, "a\tb\n\nc"), (5, "again")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, offset string").coalesce(2)
    out = packing.packed(df, path).collect()
    t = Tokenizer.from_file(path)
    want = Counter((i, np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for i, x in rows)
    by_doc = {}
    for r in out:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (i, ids), c in want.items():
        pieces = sorted(by_doc[i, len(ids) // 4], key=lambda r: r.start)
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
        assert c == 1 and at == len(ids) // 4
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert at <= 2048
    assert padding == 0
    assert packing.packed(df.limit(0), path).count() == 0


def test_packer_minimises_the_sum_of_squares():
    rnd = random.Random(2)
    p = packing.Packer(16)
    for i in range(500):
        n = rnd.randint(1, 16)
        before = p.count.copy()

        def after(level):
            c = before.copy()
            c[level] -= level > 0
            c[level + n] += level + n < 16
            return int((c * c).sum())

        choices = [lv for lv in range(17 - n) if lv == 0 or before[lv]]
        p.place((i, 0, b"\0\0\0\0" * n, n), n)
        assert int((p.count * p.count).sum()) == min(map(after, choices))


def greedy(vocab, word):
    n = 0
    while word:
        size = max((k for k in range(1, len(word) + 1) if word[:k] in vocab), default=0)
        if not size:
            return 1
        word, n = word[size:], n + 1
    return n


def test_automaton_equals_greedy_search():
    rnd = random.Random(3)
    for _ in range(60):
        vocab = {bytes(rnd.choices(b"abc", k=rnd.randint(1, 5))) for _ in range(rnd.randint(1, 12))}
        a = tokencount.Automaton(sorted(vocab))
        for _ in range(60):
            word = bytes(rnd.choices(b"abcd" if rnd.random() < 0.2 else b"abc", k=rnd.randint(1, 14)))
            assert a.count(word) == greedy(vocab, word)


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    vocab = set(tokencount.vocabulary(path))
    rows = [(1, "The quick brown fox, don't!"), (2, None), (3, ""), (4, "é日本\nx\ty"), (None, "a" * 3000), (1, "again")]
    got = tokencount.token_counts(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int"), path).collect()
    want = [(i, len(WORD.findall(t or "")), sum(greedy(vocab, b" " + w.encode()) for w in WORD.findall(t or ""))) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_licences_on_held_out_notices(spark):
    plain = [(i, f"Plain sentence number {i}. Another calm sentence about rivers and stones. It goes on for a while.", "x") for i in range(200)]
    marked = {
        300: ("Text here.\nThis file is licensed under the MIT License.\nMore text.", ["mit"]),
        301: ("Licensed under the Apache License, Version 2.0. All of it.", ["apache"]),
        302: ("All rights reserved.", ["reserved"]),
        303: ("They took out a license to fish in the river.", []),
        304: (None, []),
        305: ("", []),
        306: ("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", ["cc-by-nc", "mit"]),
        307: ("Some code.\nGNU GPL v3 or later.\n" + "A calm sentence about stones. " * 20_000, ["gpl"]),
        308: ("CC0 1.0 Universal", ["public-domain"]),
        None: ("Released under the MIT License.", ["mit"]),
    }
    df = spark.createDataFrame(plain + [(i, t, "x") for i, (t, _) in marked.items()], "doc_id long, text string, family string")
    got = {r.doc_id: r.families for r in licences.scanned(df).collect()}
    assert len(got) == 210 and {i: got[i] for i in marked} == {i: f for i, (_, f) in marked.items()}
    assert not any(got[i] for i in range(200))


def test_licences_equal_scoring_by_hand(spark):
    plain = [(i, f"Plain sentence number {i}. Another calm sentence about rivers and stones.\n  \nUnder the terms of trade {i} all went well!") for i in range(120)]
    notices = [f"{t} It is {i} years old." for i, ts in enumerate(licences.TEMPLATES.values()) for t in ts]
    rows = plain + [(1000 + i, t) for i, t in enumerate(notices)] + [(1000, notices[1]), (1001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = licences.Classifier(df)
    tf, lr = model.model.stages
    weights, start = lr.coefficientMatrix.toArray(), np.array(lr.interceptVector)
    held = licences.template_grams()
    every = {g for grams in held.values() for g in grams}
    want = []
    for i, text in rows:
        for part in (x for line in (text or "").split("\n") for x in regex.split(r"(?<=[.!?])\s+(?=\p{Lu})", line) if x.strip(" ")):
            w = [x for x in regex.split(r"[^\p{L}\p{N}]+", part.lower()) if x]
            v = np.zeros(licences.FEATURES)
            for g in w + [f"{a} {b}" for a, b in zip(w, w[1:])] + ([f"^ {w[0]}"] if w else []):
                v[tf.indexOf(g)] += 1
            z = weights @ v + start
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            guess = model.names[int(p.argmax())]
            grams = {" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))}
            if guess != licences.ORDINARY and grams & every:
                sure = p.max() >= model.threshold and 2 * len(grams & set(held[guess])) >= len(grams)
                want.append((i, part, guess if sure else licences.UNKNOWN))
    got = [(r.doc_id, r.paragraph, r.family) for r in licences.found(df, model).collect()]
    assert sorted(got) == sorted(want) and {f for _, _, f in got} >= set(licences.TEMPLATES)


def test_licence_scan_scores_paragraphs_without_a_template_trigram(spark, monkeypatch):
    scored, own = [], licences.paragraphs
    monkeypatch.setattr(licences, "paragraphs", lambda *args: scored.append(own(*args)) or scored[-1])
    licences.scanned(spark.createDataFrame([(1, "Licensed under MIT. A calm sentence.\n \nOf stones."), (2, None)], "doc_id long, text string"))
    assert sorted(r.paragraph for r in scored[0].collect()) == ["A calm sentence.", "Licensed under MIT.", "Of stones."]


def test_licences_of_an_empty_table(spark):
    assert licences.scanned(spark.createDataFrame([], "doc_id long, text string, g string")).count() == 0


def url_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(lower) :])[0]
    best = max(((len(h + p), v, h + p) for v, h, p in urls.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    if best:
        return host, path, best[2], best[1]
    hits = [p for p in urls.PATTERNS if url and re.search(p.regex, url.lower())]
    return host, path, None, "block" if any(p.verdict == "block" for p in hits) else "allow"


def test_urls_equal_running_every_rule(spark):
    rnd = random.Random(8)
    hosts = ["example.com", "www.example.com", "a.example.net", "EXAMPLE.COM", "cheap-pills.org", "xcasino.org", "com", "net", "", "a.b.org:80", "notcom"]
    paths = ["", "/", "/en/1", "/es/x", "/fr/", "/login", "/a.zip", "/login.php"]
    tails = ["", "?utm_source=feed", "?page=2&ref=x", "#top", "?sessionid=ab12", "?a=://b/", "?utm_source=feeds"]
    rows = [f"{rnd.choice(['http', 'https', 'HTTPS'])}://{h}{p}{t}" for h in hosts for p in paths for t in tails] + [None, "", "no scheme", "://", "x://y"]
    got = urls.judged(spark.createDataFrame([(i, u, "x") for i, u in enumerate(rows)], "page_id long, url string, host string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: url_verdict(u) for i, u in enumerate(rows)}
    assert urls.judged(spark.createDataFrame([], "page_id long, url string, host string")).count() == 0
