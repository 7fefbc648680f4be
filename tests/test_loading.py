"""Texts read into nodes, parts and pending references."""

import pytest

from tracewell.sources import loading as ld

SPEC = """# Spec
### REQ-d1: Login: flow

**Level**: DEV | **Implements**: REQ-p1-A+B, REQ-o1,, not a ref | **Status**: Active
Refines: REQ-p2

Preamble, Level of care.

## Assertions

A. It SHALL log in
   twice.
B. It SHALL last.

B is not a label here.

## Rationale

C. No assertion.
Implements: REQ-x9

*End* *Login* | **Hash**: 0a1b2c3d
---
### REQ-d2: Bare
### JNY-7: Walk
### REQ-d3: Open end

## Assertions

A. Last."""


def test_requirements_of_a_text():
    nodes, parts, pending = ld.requirement_rows("spec/a.md", SPEC)
    assert [(n[1], n[3], n[4], n[5], n[6], n[8]) for n in nodes] == [("REQ-d1", "Login: flow", "DEV", "Active", "0a1b2c3d", 2), ("REQ-d2", "Bare", None, None, None, 24), ("REQ-d3", "Open end", None, None, None, 26)]
    assert [(p[1], p[2], p[3], p[4]) for p in parts] == [("REQ-d1", "A", "It SHALL log in twice.", 11), ("REQ-d1", "B", "It SHALL last.", 13), ("REQ-d3", "A", "Last.", 30)]
    assert [p[1:6] for p in pending] == [("REQ-d1", "implements", 0, "REQ-p1", ["A", "B"]), ("REQ-d1", "implements", 1, "REQ-o1", []), ("REQ-d1", "implements", 3, "not a ref", []), ("REQ-d1", "refines", 0, "REQ-p2", [])]
    assert ld.requirement_rows("e", "") == ([], [], [])


def test_journeys_of_a_text():
    text = "### JNY-1: Login\n\n**Actor**: User\nValidates: REQ-1-A, REQ-2\n\n## Context\n\nValidates: REQ-3\n\n## Steps\n\n1. Enter\n   mail\n2. Go\n\n*End* *Login*\n### REQ-4: Other\n"
    nodes, _, pending = ld.journey_rows("j.md", text)
    assert [(n[1], n[2], n[3], n[7], n[8]) for n in nodes] == [("JNY-1", "journey", "Login", None, 1), ("JNY-1/1", "step", "Enter mail", "JNY-1", 12), ("JNY-1/2", "step", "Go", "JNY-1", 14)]
    assert [(p[2], p[4], p[5]) for p in pending] == [("validates", "REQ-1", ["A"]), ("validates", "REQ-2", []), ("misplaced", "REQ-3", [])]


CODE = '''# Implements: REQ-1
class Box:
    # Verifies: REQ-2-A
    def one(self):
        # IMPLEMENTS: REQ-3
        def inner():
            pass
        # Refines: REQ-4
        text = "# Implements: REQ-5"

def two():
    """Verifies: REQ-6"""
'''


def test_code_and_test_comments_know_where_they_stand():
    nodes, _, pending = ld.code_rows("src/a.py", CODE)
    assert [n[1] for n in nodes] == [f"code:src/a.py:{n}" for n in (1, 3, 5, 8, 12)]
    assert [n[3] for n in nodes][2:] == ["Code: Box.one at src/a.py:5", "Code: Box.one at src/a.py:8", "Code: two at src/a.py:12"]
    assert [(p[1][-2:], p[2], p[4]) for p in pending] == [(":1", "implements", "REQ-1"), (":3", "verifies", "REQ-2"), (":5", "implements", "REQ-3"), (":8", "forbidden refines", "REQ-4"), ("12", "verifies", "REQ-6")]
    nodes, _, pending = ld.test_rows("t.py", CODE)
    assert [n[1] for n in nodes] == ["test:t.py:1", "test:t.py:2", "test:t.py::Box::one", "test:t.py::two"]
    assert [(p[1], p[2]) for p in pending if "forbidden" not in p[2]] == [("test:t.py:2", "verifies"), ("test:t.py::two", "verifies")]


def test_definitions_of_a_text():
    nodes, parts, _ = ld.definition_rows("g.md", "# Glossary\n\nSession\n: A stay,\n: bounded.\n: Collection: true\n: Indexed: False\n\nNo term\n\nTerm\n: One: two\n")
    assert [(n[1], n[3], n[4], n[5]) for n in nodes] == [("def:g.md:3", "Session", "true", "false"), ("def:g.md:11", "Term", None, None)]
    assert [p[3] for p in parts] == ["A stay, bounded.", "One: two"]


def test_ids_that_repeat_are_kept_apart(spark):
    block = "## X1: {0}\n\n**Refines**: Y{1}\n\n## Assertions\n\nA. {0}\n\n*End*\n"
    texts = [("b/two.md", block.format("second", 2) + block.format("third", 3)), ("a/one.md", block.format("first", 1)), ("c/two.md", block.format("fourth", 4)), ("n.md", None), ("e.md", "")]
    read = ld.kept_apart(ld.loaded(spark.createDataFrame(texts, "path string, text string"), ld.requirement_rows))
    assert {(r.id, r.label, r.original_id) for r in read.nodes.collect()} == {("X1", "first", None), ("X1#two", "second", "X1"), ("X1#two__2", "third", "X1"), ("X1#two__3", "fourth", "X1")}
    assert {(r.owner, r.text) for r in read.parts.collect()} == {("X1", "first"), ("X1#two", "second"), ("X1#two__2", "third"), ("X1#two__3", "fourth")}
    assert {(r.source_id, r.target) for r in read.pending.collect()} == {("X1", "Y1"), ("X1#two", "Y2"), ("X1#two__2", "Y3"), ("X1#two__3", "Y4")}


def test_texts_are_written_as_rows_and_taken_apart_once(spark):
    import glob

    from pyspark.sql import functions as F

    from tracewell.functions.storage import shared_dir
    from tracewell.plans.estate import Estate
    from tracewell.plans.loads import written

    files = lambda: len(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/**/*.*", recursive=True))
    before = files()
    rows = spark.range(2000).select(F.concat(F.lit("d"), F.floor(F.col("id") / 2), F.lit(".md")).alias("path"), F.col("id").alias("at"), F.concat(F.lit("## D"), "id", F.lit(": One\n**Refines**: P1-A+B")).alias("block"))
    texts = written(Estate(spark, ""), rows, "\n\n")
    assert texts.count() == 1000 and texts.where("path = 'd3.md'").first()["text"] == "## D6: One\n**Refines**: P1-A+B\n\n## D7: One\n**Refines**: P1-A+B"
    read = ld.loaded(texts, ld.requirement_rows)
    assert read.nodes.count() == 2000 and {tuple(r["labels"]) for r in read.pending.collect()} == {("A", "B")} and read.parts.count() == 0
    assert files() - before < 50


def _resident(path: str, text: str) -> tuple[list, list, list]:
    with open("/proc/self/statm") as f:
        held = int(f.read().split()[1]) * 4096 // 1_000_000
    return [(path, f"{path}/{i}", "requirement", f"{path} {i}", None, None, None, None, held, i) for i in range(200)], [], []


def test_a_task_does_not_hold_what_many_texts_gave(spark):
    from pyspark.sql import functions as F

    def peak(n: int) -> int:
        texts = spark.range(0, n, 1, 1).select(F.col("id").cast("string").alias("path"), F.lit("word").alias("text"))
        found = ld.loaded(texts, _resident).nodes.agg(F.count("*"), F.max("line"), F.count_distinct("id")).first()
        assert found[0] == found[2] == 200 * n
        return found[1]

    base = peak(1)
    assert peak(4000) < base + 100


def test_pieces_become_the_texts_they_were(spark):
    texts = [("a", "x" * ld.PIECE), ("b", ""), ("b", "\r\n" * ld.PIECE), ("c", None), (None, "é\U0001f600" * ld.PIECE + "\n")]
    read = ld.loaded(spark.createDataFrame(texts, "path string, text string"), lambda path, text: ([], [(path, None, None, text, 0)], []))
    assert sorted((r["path"] or "", r["text"]) for r in read.parts.collect()) == sorted((p or "", t) for p, t in texts if t is not None)
    assert read.nodes.count() == read.pending.count() == 0


@pytest.mark.parametrize("name", ["load_requirements", "load_code_refs"])
def test_what_is_loaded_is_never_broadcast(spark, name):
    from tracewell.plans import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
