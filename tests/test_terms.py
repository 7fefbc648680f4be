"""Glossary terms in texts, and comments of sources."""

import os
import random
import re

import duckdb
import pytest

from tracewell.functions.comments import comments
from tracewell.operators import terms as ops

TERMS = [("Sponsor Portal", True), ("Sponsor", True), ("Diary", True), ("hidden", False), ("a+b", True)]


def kinds(text):
    return [(t, start, kind, mark, surface) for t, start, kind, mark, surface, _ in sorted(ops.scanned(text, TERMS), key=lambda r: r[1])]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The *Diary* and **diary** and __DIARY__ and _Diary_.", [("Diary", 4, "marked", "*", "Diary"), ("Diary", 16, "marked", "**", "diary"), ("Diary", 30, "wrong", "__", "DIARY"), ("Diary", 44, "wrong", "_", "Diary")]),
        ("Sponsor Portal of the Sponsor", [("Sponsor Portal", 0, "plain", "", "Sponsor Portal"), ("Sponsor", 22, "plain", "", "Sponsor")]),
        ("***Diary*** *Diary**", [("Diary", 1, "marked", "**", "Diary"), ("Diary", 13, "plain", "", "Diary")]),
        ("*Diary*Diary*", [("Diary", 0, "marked", "*", "Diary"), ("Diary", 7, "plain", "", "Diary")]),
        ("Diaryx xDiary Diary_x", []),
        ("hidden *hidden*", [("hidden", 7, "marked", "*", "hidden")]),
        ("a+b, xa+b", [("a+b", 0, "plain", "", "a+b")]),
        ("", []),
    ],
)
def test_occurrences_are_classed(text, want):
    assert kinds(text) == want


def test_parts_of_identifiers_are_told():
    found = {r[1]: r[5] for r in ops.scanned("X-Diary-1 (Diary). a/Diary Diary", TERMS)}
    assert found == {2: True, 11: False, 21: True, 27: False}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A diary, a **diary** and __Diary__.", "A *Diary*, a **Diary** and *Diary*."),
        ("`Diary` stays, **Diary Start Day** too", "`Diary` stays, **Diary Start Day** too"),
        ("sponsor portal and sponsor", "*Sponsor Portal* and *Sponsor*"),
        ("X-Diary-1 *Diary* (Diary)", "X-Diary-1 *Diary* (*Diary*)"),
        ("hidden _hidden_", "hidden _hidden_"),
        ("`x *diary* y` *diary*", "`x *diary* y` *Diary*"),
    ],
)
def test_canonical_forms(text, want):
    got, replaced = ops.canonical(text, TERMS)
    assert got == want and (got == text) == (not replaced)
    assert ops.canonical(got, TERMS) == (got, [])


def test_claims_never_overlap_and_longer_terms_win():
    rng = random.Random(1)
    terms = [("ab", True), ("ab cd", True), ("cd", True), ("cd ab ab", True)]
    for _ in range(300):
        text = "".join(rng.choice(["ab", "cd", " ", " ", "*", "**", "_", "`", "AB", "-"]) for _ in range(14))
        spans = sorted((s, s + len(surface) + 2 * len(mark)) for _, s, _, mark, surface, _ in ops.scanned(text, terms))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        for m in re.finditer(r"(?<!\w)(?<![*_])cd ab ab(?!\w)(?![*_])", text, re.IGNORECASE):
            assert (m.start(), m.end()) in spans
        got, replaced = ops.canonical(text, terms)
        back = got
        for old, new in replaced:
            assert new in got
        assert re.sub(r"[*_]", "", back).lower() == re.sub(r"[*_]", "", text).lower()


def test_terms_by_themselves_may_overlap(spark):
    terms = [("The the", True), ("The at", True), ("a of", True)]
    text = "the the at. *a of the the*, bathe atlas; The\nat"
    got = {(t, start, kind) for t, start, kind, *_ in ops.scanned(text, terms, apart=True)}
    assert got == {("The the", 0, "plain"), ("The at", 4, "plain"), ("The the", 18, "plain"), ("a of", 13, "plain")}
    assert ("The the", 0) in {r[:2] for r in ops.scanned(text, terms)} and ("The at", 4) not in {r[:2] for r in ops.scanned(text, terms)}
    assert ops.kept("the the at", terms) == [("the at", "*The at*")] and ops.kept("the the. the at *The at*", terms) == []
    assert ops.kept("`a of`, x-a of **one a of**", terms) == [("a of", "*a of*")] * 3
    # Candidates by two words running: no occurrence is lost to them.
    texts = spark.createDataFrame([("t1", text), ("t2", "x_the the_"), ("t3", "_the at_ THE  at")], "id string, text string")
    known = spark.createDataFrame([*terms, ("of", True)], "term string, indexed boolean")
    found = {(r.id, r.term, r.start) for r in ops.occurrences(texts, known, "id", "text", apart=True).collect()}
    want = {(k, r[0], r[1]) for k, x in (("t1", text), ("t2", "x_the the_"), ("t3", "_the at_ THE  at")) for r in ops.scanned(x, [*terms, ("of", True)], apart=True)}
    assert found == want and ("t1", "of", 15) in found
    new = {r.id: ([x.new for x in r.replaced], [x.new for x in r.kept]) for r in ops.canonicalized(spark.createDataFrame([("t", "the the at")], "id string, text string"), known, "id", "text").collect()}
    assert new == {"t": (["*The the*"], ["*The at*"])}


def test_tables_of_texts_and_terms(spark):
    texts = spark.createDataFrame([("t1", "One Diary.\nTwo *diary*."), ("t2", None), ("t3", ""), (None, "Diary"), ("t4", "no such"), ("t1b", "SPONSOR PORTAL " * 300)], "id string, text string")
    terms = spark.createDataFrame([*TERMS, ("--", True)], "term string, indexed boolean")
    got = {(r.id, r.term, r.line, r.start, r.kind) for r in ops.occurrences(texts, terms, "id", "text").where("id <> 't1b'").collect()}
    assert got == {("t1", "Diary", 1, 4, "plain"), ("t1", "Diary", 2, 15, "marked")}
    assert ops.occurrences(texts, terms, "id", "text").where("id = 't1b'").count() == 300
    new = {r.id: (r.text, [(x.old, x.new) for x in r.replaced]) for r in ops.canonicalized(texts, terms, "id", "text").where("id = 't1'").collect()}
    assert new == {"t1": ("One *Diary*.\nTwo *Diary*.", [("Diary", "*Diary*"), ("*diary*", "*Diary*")])}
    assert ops.occurrences(texts, terms.limit(0), "id", "text").count() == 0


def test_texts_without_a_key_or_with_a_shared_one(spark):
    big = (1 << 60) + 1
    texts = spark.createDataFrame([(None, "en", "Diary"), (None, "de", "a log *Diary*"), (big, "en", "diary"), (big, "fr", "Sponsor Portal")], "id long, lang string, text string")
    terms = spark.createDataFrame([("Diary", True), ("Sponsor Portal", True)], "term string, indexed boolean")
    got = sorted(tuple(map(repr, (r.lang, r.id, r.term, r.kind))) for r in ops.occurrences(texts, terms, "id", "text", apart=True, carried=["lang"]).collect())
    assert got == [("'de'", "None", "'Diary'", "'marked'"), ("'en'", str(big), "'Diary'", "'plain'"), ("'en'", "None", "'Diary'", "'plain'"), ("'fr'", str(big), "'Sponsor Portal'", "'plain'")]
    new = sorted(((r.id, r.text) for r in ops.canonicalized(texts, terms, "id", "text").collect()), key=repr)
    assert new == sorted([(None, "*Diary*"), (big, "*Diary*"), (big, "*Sponsor Portal*")], key=repr)


def test_term_queries_equal_sql_without_ids(spark, tmp_path):
    import duckdb

    from tracewell.plans import registry

    docs = [(None, "Red book is. A red book, and more.\nRed Book", "en"), (7, "red book, red book", "en"), (7, "Green tea, red book. x", "de"), (8, None, "en"), (None, "no term", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Red book of colours and more"), (2, "Green tea is a drink"), (3, "Not found here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for f in os.listdir("/root/testdata/sf0.001"):
        if f.removesuffix(".parquet") not in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '/root/testdata/sf0.001/{f}'")
    for name in ("scan_terms", "term_detail", "term_index", "terms_canonical_form", "terms_unmarked", "canonicalize_terms", "collection_manifest"):
        df = registry.queries()[name](spark, str(tmp_path))
        found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(found, key=repr), name


@pytest.fixture
def glossed(spark, tmp_path):
    from tracewell.plans import registry

    docs = [(1, "A *red book*, and.\nRed book here; re-red book, *red book*, red book-red book red-book", "en"), (2, "a __Red book__ b *Red book* c **Red book** d Red book e", "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Red book " + "of colours " * 20), (2, "Not found")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for f in os.listdir("/root/testdata/sf0.001"):
        if f.removesuffix(".parquet") not in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '/root/testdata/sf0.001/{f}'")

    def run(name: str) -> list[tuple]:
        df = registry.queries()[name](spark, str(tmp_path))
        got = sorted(map(tuple, df.collect()), key=repr)
        assert got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall(), key=repr)
        return got

    return run


def test_term_detail_lists_every_reference(glossed):
    got = glossed("term_detail")
    own = [r for r in got if r[2] is not None]
    refs = [r[4:] for r in got if r[2] is None]
    assert sorted((r[0], r[2], r[3]) for r in own) == [(1, "Red book " + "of colours " * 20, 10), (2, "Not found", 0)]
    assert len(refs) == 10 and {r for r in refs if r[0] == 2} == {(2, "de", 1, False, "__"), (2, "de", 1, True, ""), (2, "de", 1, False, "")}


def test_terms_canonical_form_tells_markup_and_skips_longer_tokens(glossed):
    got = glossed("terms_canonical_form")
    assert [r[1:2] + r[3:] for r in got if r[0] == 1] == [(1, "Red book", "red book", True, "", False), (2, "Red book", "Red book", False, "", True), (2, "Red book", "red book", True, "", False), (2, "Red book", "red book", True, "", False)]
    assert [r[4:] for r in got if r[0] == 2] == [("Red book", False, "__", False), ("Red book", False, "", True)]


def test_emphasis_without_a_term(spark):
    texts = spark.createDataFrame([(1, "*Diary* **other**\n*log book* *new one* `*code*` * x * ** **"), (2, None)], "id int, text string")
    terms = spark.createDataFrame([("Diary", ["Log Book"]), ("x", None)], "term string, synonyms array<string>")
    got = {(r.token, r.line, r.delimiter) for r in ops.unmatched_emphasis(texts, terms, "id", "text").collect()}
    assert got == {("other", 1, "**"), ("new one", 2, "*")}


@pytest.mark.parametrize(
    ("source", "ending", "want"),
    [
        ("x = '# no' # yes\n'''\n# no\n'''\n#\n## two", ".py", [(1, "yes"), (6, "two")]),
        ('s = "a\\"# no" # it\'s', ".py", [(1, "it's")]),
        ("a // one\n/* two\nthree */ b", ".ts", [(1, "one"), (2, "two\nthree")]),
        ("a: 1 # one\n#\n", ".yml", [(1, "one")]),
        ("SELECT 1 -- one", ".SQL", [(1, "one")]),
        ("<p><!-- one\ntwo -->\n<!-- -->", ".html", [(1, "one\ntwo")]),
        ("# what", ".txt", []),
        (None, ".py", []),
    ],
)
def test_comments_by_language(source, ending, want):
    assert comments(source, ending) == want
