"""Operators on hand-built tables."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as fn
from tracewell.operators import changes, closure, conduction, coverage, matching, references, strong, suggest, windows
from tracewell.operators import federation as fed
from tracewell.sources import results as src
from tracewell.streaming import logs

EDGES = "src string, dst string"


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), EDGES)


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node string")


def test_closure_takes_the_least_depth_and_ends_on_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), (None, "x"))
    got = {tuple(r) for r in closure.closure(e, nodes(spark, "a")).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 1)}
    assert {r.node for r in closure.closure(e, nodes(spark, "a"), max_depth=0).collect()} == {"a"}


def test_paths_repeat_a_node_per_path(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"))
    got = sorted("/".join(r.path) for r in closure.paths(e, nodes(spark, "a")).collect())
    assert got == ["a", "a/b", "a/b/d", "a/c", "a/c/d"]


def test_page_rank(spark):
    e = edges(spark, ("hub", "x"), ("hub", "y"), ("hub", "z"))
    got = {r.node: r.score for r in closure.page_rank(nodes(spark, "hub", "x", "y", "z"), e).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and got["hub"] > got["x"]
    assert closure.page_rank(nodes(spark, "one"), e.limit(0)).first().score == pytest.approx(1.0)


@pytest.mark.parametrize(
    ("chosen", "want"),
    [
        (["a", "c"], {"a": ["c"], "c": []}),
        (["a", "b", "c"], {"a": ["b", "c"], "b": ["c"], "c": []}),
        (["b"], {"b": []}),
    ],
)
def test_minimized_chain(spark, chosen, want):
    got = closure.minimized(edges(spark, ("a", "b"), ("b", "c")), nodes(spark, *chosen))
    assert {r.node: r.superseded_by for r in got.collect()} == want


def test_minimized_diamond_keeps_the_leaf(spark):
    e = edges(spark, ("top", "l"), ("top", "r"), ("l", "leaf"), ("r", "leaf"))
    got = closure.minimized(e, nodes(spark, "top", "l", "r", "leaf")).collect()
    assert [r.node for r in got if not r.superseded_by] == ["leaf"]


def test_cycles(spark):
    e = edges(spark, ("b", "c"), ("c", "d"), ("d", "b"), ("a", "b"), ("x", "y"), ("s", "s"))
    assert {tuple(r) for r in strong.strongly_connected(e).collect()} == {("b", "b"), ("c", "b"), ("d", "b"), ("s", "s")}


def test_cycles_send_no_table_of_nodes_to_the_driver(spark):
    n = 40
    e = edges(spark, *[(f"{i:02}", f"{(i + 1) % n:02}") for i in range(n)], ("00", "x"))
    got = strong.strongly_connected(e)
    assert {tuple(r) for r in got.collect()} == {(f"{i:02}", "00") for i in range(n)}
    assert "Broadcast" not in got._jdf.queryExecution().toString()


def conduct(spark, labels, edges, values=("v",)):
    df = spark.createDataFrame(labels, "node string, label string, " + ", ".join(f"{v} double" for v in values))
    out = conduction.conducted(df, spark.createDataFrame(edges, "src string, dst string, label string"), values)
    return {(r.node, r.label): tuple(r[v] for v in values) for r in out.collect()}


def walked(labels, edges, values):
    """The rule as it is told: recursion with the nodes of the path at hand."""
    of, kids = {}, {}
    for n, label, *v in labels:
        of.setdefault(n, {})[label] = v
    for s, d, named in set(edges):
        kids.setdefault(s, []).append((d, named))
    none = [0.0] * len(values)

    def rolled(n, label, path):
        got = [worth(d, path) for d, named in kids.get(n, []) if named in (None, label)]
        return [sum(x) / len(got) for x in zip(*got)] if got else None

    def worth(n, path):
        if n in path or n not in of:
            return none
        best = [[max(a, b) for a, b in zip(v, rolled(n, label, path | {n}) or none)] for label, v in of[n].items()]
        return [sum(x) / len(best) for x in zip(*best)]

    return {(n, label): r for n, ls in of.items() for label in ls if (r := rolled(n, label, frozenset())) is not None}


def test_conduction_reads_labels_of_leaves_once(spark, monkeypatch):
    held, to_labels = [], conduction._to_labels
    monkeypatch.setattr(conduction, "_to_labels", lambda given, labels, *rest: held.append({r.node for r in labels.collect()}) or to_labels(given, labels, *rest))
    labels = [(n, "A", 0.5) for n in ("p", "q", "x", "y", "z")]
    assert conduct(spark, labels, [("p", "q", None), ("q", "x", "A"), ("q", "y", None)]) == {("p", "A"): (0.5,), ("q", "A"): (0.5,)}
    assert held and all(nodes == {"p", "q"} for nodes in held)


def test_conduction_means_over_refining_nodes(spark):
    labels = [("p", "A", 0.0, 0.0), ("p", "B", 0.0, 1.0), ("x", "A", 1.0, 0.0), ("y", "A", 0.0, 1.0), ("y", "B", 1.0, 1.0)]
    got = conduct(spark, labels, [("p", "x", "A"), ("p", "y", None), ("p", "bare", "B")], ("direct", "indirect"))
    assert got == {("p", "A"): (0.75, 0.5), ("p", "B"): (0.25, 0.5)}


@pytest.mark.parametrize("seed", [0, 1])
def test_conduction_equals_the_rule_on_random_graphs_with_cycles(spark, seed):
    rng, n, values = random.Random(seed), 16, ("direct", "indirect")
    labels = [(f"n{i}", x, rng.choice([0.0, 0.5, 1.0]), rng.choice([0.0, 1.0])) for i in range(n) for x in "ABC"[: rng.randrange(4)]]
    edges = [(f"n{i}", f"n{rng.randrange(i + 1, n + 1)}", rng.choice([None, "A", "B"])) for i in range(n) for _ in range(rng.randrange(3))]
    # A ring with a chord, below other nodes and above others, and a loop.
    edges += [("n3", "n5", None), ("n5", "n7", "A"), ("n7", "n3", None), ("n5", "n3", "B"), ("n9", "n9", None)]
    got, want = conduct(spark, labels, edges, values), walked(labels, edges, values)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_conduction_without_edges(spark):
    assert conduct(spark, [("a", "A", 1.0)], []) == {}


def test_components_of_many_kinds(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(75)} | {(50, 50), (60, 61), (61, 60), (61, 62)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    near = {}
    for s, d in pairs:
        near.setdefault(s, set()).add(d)

    def reach(s):
        seen, left = set(), [s]
        while left:
            for d in near.get(left.pop(), ()):
                if d not in seen:
                    seen.add(d)
                    left.append(d)
        return seen

    r = {s: reach(s) for s in {x for p in pairs for x in p}}
    want = {(s, min(x for x in r if x in r[s] and s in r[x])) for s in r if s in r[s]}
    assert {tuple(x) for x in strong.strongly_connected(e).collect()} == want and len(want) > 5
    assert strong.strongly_connected(e.where("src = 60 and dst = 61")).count() == 0


def test_measures_keep_named_and_blanket_apart(spark):
    a = spark.createDataFrame([("r", "A"), ("r", "B")], "req_id string, label string")
    edge = "req_id string, source_id string, label string"
    code = spark.createDataFrame([("r", "c1", "A"), ("r", "c2", "A"), ("r", "c3", None)], edge)
    verifies = spark.createDataFrame([("r", "t1", "B"), ("r", "t2", None)], edge)
    res = spark.createDataFrame([("t1", "passed", False), ("t1", "failed", False), ("t2", "skipped", True)], "test_id string, status string, carried boolean")
    steps = spark.createDataFrame([("j", "s1", "passed"), ("j", "s2", "skipped")], "journey_id string, step_id string, status string")
    validates = spark.createDataFrame([("r", "j", "A")], edge)
    wide = coverage.immediate(a, coverage.evidence(code, verifies, validates, res, steps))
    m = {(r.label, r.dim): (r.immediate_direct, r.immediate_indirect, r.failing) for r in coverage.by_dimension(wide).collect()}
    assert len(m) == 10
    assert (m["A", "implemented"], m["B", "implemented"]) == ((1, 1, False), (0, 1, False))
    assert (m["A", "tested"], m["B", "tested"]) == ((0, 1, False), (1, 1, False))
    assert (m["A", "verified"], m["B", "verified"]) == ((0, 0, False), (1, 0, True))
    assert (m["A", "uat_coverage"], m["A", "uat_verified"], m["B", "uat_verified"]) == ((1, 0, False), (0.5, 0, False), (0, 0, False))
    rolled = spark.createDataFrame([("r", "B", 0.25, 0.5)], "node string, label string, implemented_direct double, implemented_indirect double")
    four = {r.label: r for r in coverage.with_total(coverage.by_dimension(coverage.with_rolled(wide, rolled, "implemented"), "implemented", rolled=True)).collect()}
    assert (four["B"].rolled_direct, four["B"].rolled_indirect, four["B"].total, four["A"].rolled_direct) == (0.25, 0.5, 1, 0)


def test_journeys(spark):
    rows = [("full", "s1", "passed"), ("full", "s2", "passed"), ("fail", "s1", "passed"), ("fail", "s2", "failed"), ("part", "s1", "passed"), ("part", "s2", "skipped")]
    got = coverage.journey_verdicts(spark.createDataFrame(rows, "journey_id string, step_id string, status string")).collect()
    assert {r.journey_id: (r.steps, r.verified, r.failing) for r in got} == {"full": (2, 2, False), "fail": (2, 1, True), "part": (2, 1, False)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("X1,,X2", [(None, None), ("malformed", "empty_item"), (None, None)]),
        (",X1", [("malformed", "empty_item"), (None, None)]),
        ("X1,", [(None, None), ("malformed", "trailing_separator")]),
        ("X1, X1", [("forbidden", "duplicate"), ("forbidden", "duplicate")]),
        ("not a reference", [("malformed", "not_an_identifier")]),
        ("WIDGET-42", [("unknown_namespace", None)]),
        ("X1-a", [("malformed", "label_form")]),
    ],
)
def test_reference_lists(spark, text, want):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    got = sorted(references.items(df, "t", ["X"], "k").collect(), key=lambda r: r.item_index)
    assert [(r["class"], r.code) for r in got] == want


def test_compact_labels(spark):
    df = spark.createDataFrame([("r", c) for c in "ABCFHI"], "k string, l string")
    assert windows.compacted(df, "k", "l").first().labels == "A-C,F,H,I"


def test_blocks_of_markers(spark):
    m = spark.createDataFrame([("f", 1), ("f", 2), ("f", 10)], "file string, line int")
    ln = spark.createDataFrame([("f", 3), ("f", 4), ("f", 11)], "file string, line int")
    got = {r.line: r.block for r in windows.block_owner(m, ln, ["file"], "line").collect()}
    assert got == {3: 1, 4: 1, 11: 2}


def test_junit_precedence_and_bad_numbers(spark):
    xml = '<testsuite><testcase name="a" time="x" line="z"><error message="e"/><failure message="f"/></testcase><testcase name="b" time="1.5"><skipped/></testcase><testcase name="c"/></testsuite>'
    got = {r.name: r for r in src.read_junit(spark.createDataFrame([("p", xml)], "path string, text string")).collect()}
    assert (got["a"].status, got["a"].duration, got["a"].line, got["a"].message) == ("failed", 0.0, None, "f")
    assert (got["b"].status, got["b"].duration) == ("skipped", 1.5) and got["c"].status == "passed"


def test_lcov_belongs_to_the_source_before(spark):
    text = "SF:a.py\nDA:1,5\nDA:2,0\nend_of_record\nSF:b.py\nDA:1,1\nend_of_record\n"
    rows = src.read_lcov(spark.createDataFrame([("p", text)], "path string, text string"))
    assert {(r.file, r.line, r.hits) for r in rows.collect()} == {("a.py", 1, 5), ("a.py", 2, 0), ("b.py", 1, 1)}
    assert {(r.file, r.found, r.hit) for r in src.lcov_totals(rows).collect()} == {("a.py", 2, 1), ("b.py", 1, 1)}


def test_threads(spark):
    rows = [(1, 1, "comment"), (1, 2, "resolve"), (2, 1, "comment"), (2, 2, "resolve"), (2, 3, "comment"), (3, 1, "reply")]
    got = {r.key: r.open for r in changes.threads(spark.createDataFrame(rows, "key int, seq int, event string")).collect()}
    assert got == {1: False, 2: True}


def test_latest_by_key_over_batches(spark, tmp_path):
    for i, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]]):
        spark.createDataFrame(rows, "k int, seq int, v string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("k int, seq int, v string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    base = logs.latest_by_key(spark, stream, "k", ["seq"])
    n = 0
    while True:
        try:
            got = spark.read.parquet(f"{base}/{n + 1}")
            n += 1
        except Exception:
            got = spark.read.parquet(f"{base}/{n}")
            break
    assert {(r.k, r.v) for r in got.collect()} == {(1, "c"), (2, "b")}


def test_text_functions(spark):
    df = spark.createDataFrame([("The Data-Base and-- HTTPServer, data-base x",)], "t string")
    row = df.select(fn.keywords(F.col("t")).alias("k"), fn.camel_to_snake(F.lit("HTTPServerError")).alias("s"), fn.candidate_functions(F.lit("test_a_b_c")).alias("c")).first()
    assert row.k == ["data-base", "httpserver"] and row.s == "http_server_error" and row.c == ["a_b_c", "a_b", "a"]


def test_results_bind_to_the_closest_scope(spark):
    tests = spark.createDataFrame([("t1", "a.py", 1, "J1/2"), ("t2", "a.py", 5, None), ("t3", "b.py", 7, "J1/2"), ("t4", None, 1, "J1/2")], "test_id string, file string, line int, step string")
    rows = [
        ("step", "walk J1/2 and J1/2", "a.py", 5, None, None),
        ("several", "J1/2 J1/3", "a.py", 5, "b.py", 7),
        ("root", "x", "a.py", 9, "b.py", 7),
        ("file", "x", "a.py", None, "b.py", 8),
        ("none", None, "c.py", 1, None, None),
        ("nowhere", "J1/2", None, 1, None, 1),
    ]
    results = spark.createDataFrame(rows + rows[:1], "result_id string, name string, file string, line int, root_file string, root_line int")
    got = sorted(tuple(r) for r in matching.source_matches(results, tests).collect())
    assert got == [("file", "t1", "file"), ("file", "t2", "file"), ("root", "t3", "root_line"), ("several", "t2", "line"), ("step", "t1", "step")]
    assert [tuple(r) for r in matching.step_matches(results, tests).collect()] == [("step", "t1")]
    assert matching.source_matches(results.limit(0), tests).count() == matching.source_matches(results, tests.limit(0)).count() == 0


def test_unread_items_and_file_names(spark):
    want = {"P 1": ("malformed", "not_an_identifier"), "PP1_A": ("malformed", "separator"), "P1-a": ("malformed", "label_form"), "P1234": ("malformed", "component_out_of_range"), "P1x": ("malformed", "identifier_with_trailing_text"), "Q1": ("unknown_namespace", None)}
    df = spark.createDataFrame([(i,) for i in want], "item string").select("item", matching.unmatched(F.col("item"), ["P", "PP"], 3).alias("f")).select("item", "f.*")
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == want
    paths = spark.createDataFrame([("a/Roadmap/x.y.md", "CAL"), (None, None), (".md", "")], "path string, prefix string")
    got = [tuple(r.d) for r in paths.select(matching.display_info(F.col("path"), F.col("prefix")).alias("d")).collect()]
    assert got == [(True, "x.y.md", "x.y", "CAL"), (False, "", "", "CORE"), (False, ".md", ".md", "CORE")]


def test_searches_as_users_write_them():
    t = fn.Terms.of('A OR b c -d "E f" OR g AND h')
    assert (t.groups, t.excluded, t.phrases) == ([["a", "b"], ["c"], ["g"], ["h"]], ["d"], ["e f"])
    assert fn.Terms.of("OR a").groups == [["a"]] and not fn.Terms.of("  ").groups
    t = fn.Terms.of('(a OR b (c -x "y")) d) OR e =F OR g ( ) (h "open end')
    assert (t.groups, t.excluded, t.phrases) == ([["a", "b", "c"], ["d", "e"], ["=f", "g"], ["h"]], [], [])
    assert fn.Terms.of('"open end').phrases == ["open end"]


def test_searches_score_fields_and_keywords(spark):
    row = spark.createDataFrame([("R1", "Login page", "A body text", ["Auth", None, "login flow"])], "id string, title string, body string, words array<string>")

    def score(raw):
        return row.select(fn.Terms.of(raw).score(F.col("id"), F.col("title"), F.col("body"), F.col("words")).alias("s")).first().s

    assert [score(x) for x in ("r1", "login", "=auth", "aut", "=aut", "text", "(nope OR text) auth", "text -auth", '"auth login"', "text nope", "", "-nope")] == [100, 50, 40, 25, 0, 10, 35, 0, 1, 0, 0, 0]


def test_expanded_names_what_an_owner_lacks(spark):
    refs = spark.createDataFrame([("s", "x", "R-1-A+B"), ("s", "x", "R-1-A+B"), ("s", "x", "R-1-A"), ("s", "x", "R-1-A+A"), ("s", "x", "R-9-A+B"), ("t", "y", "R-1-A+B"), ("u", "x", None)], "source_id string, repo string, target string")
    holders = spark.createDataFrame([("y", "R-1", "A"), ("z", "R-1", "B")], "repo string, req_id string, label string")
    got = sorted(map(tuple, fed.expanded(refs, holders).collect()), key=repr)
    assert got == [("s", "R-1-A+B", "y", "R-1", "A", None), ("s", "R-1-A+B", "y", "R-1", "B", "unknown_assertion"), ("t", "R-1-A+B", "z", "R-1", "A", "unknown_assertion"), ("t", "R-1-A+B", "z", "R-1", "B", None)]


def test_expanded_shuffles_each_table_once(spark):
    refs = spark.createDataFrame([("s", "x", "R-1-A+B"), ("s", None, "R-1-A+B"), ("t", "y", "R-1-A+C")], "source_id string, repo string, target string")
    holders = spark.createDataFrame([("y", "R-1", "A"), ("y", "R-1", "A"), ("y", "R-1", None), ("x", "R-1", "B"), (None, "R-1", "B"), ("z", "R-2", "A")], "repo string, req_id string, label string")
    out = fed.expanded(refs, holders)
    assert sorted(map(tuple, out.collect()), key=repr) == [("s", "R-1-A+B", "y", "R-1", "A", None), ("s", "R-1-A+B", "y", "R-1", "B", "unknown_assertion")]
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 2


def test_templates_to_review(spark):
    clones = spark.createDataFrame([("c::t", "t", "c"), ("d::t", "t", "d"), ("c::u", "u", "c"), ("c::v", "v", "c")], "id string, template string, declaring string")
    hashes = spark.createDataFrame([("t", "aa", "bb"), ("u", "CC", "cc"), ("v", None, "dd")], "id string, stored string, current string")
    assert sorted(map(tuple, fed.templates_to_review(clones, hashes).collect())) == [("c", "t", "aa"), ("d", "t", "aa")]


def test_templates_are_cloned_over_a_chain_of_repositories(spark):
    reqs = spark.createDataFrame([("a", "A1", True), ("b", "B1", True), ("b", "B2", False), ("c", "C1", True)], "repo string, id string, template boolean")
    said = spark.createDataFrame([("A1", "A"), ("A1", "B"), ("B1", "A")], "req_id string, label string")
    links = [("B1", "b", "A1"), ("C1", "c", "b1"), ("C1", "c", "B2"), ("C1", "c", "C1"), ("C1", "c", "A9"), ("C1", "c", "Z1"), ("C1", "c", "Z1")]
    out = fed.instantiated_across(spark.createDataFrame(links, "declaring string, repo string, target string"), reqs, said, ["A", "B", "C"])
    got = sorted((r.target, r["class"] or "", r.clone or "", r.label or "", r.template_repo or "") for r in out.collect())
    assert got == [
        ("A1", "", "B1::A1", "", "a"),
        ("A1", "", "B1::A1-A", "A", "a"),
        ("A1", "", "B1::A1-B", "B", "a"),
        ("A9", "unknown_requirement", "", "", ""),
        ("B2", "not_template", "", "", "b"),
        ("C1", "local", "", "", "c"),
        ("Z1", "unknown_namespace", "", "", ""),
        ("b1", "", "C1::B1", "", "b"),
        ("b1", "", "C1::B1-A", "A", "b"),
    ]


def test_suggestions_rank_hits_of_the_search_that_is_given(spark):
    words = lambda c: F.split(F.lower(c), " ")
    said = spark.createDataFrame([("R1", "A", "user logs in", "login flow"), ("R1", "B", "session ends", "login flow"), ("R2", "A", "data is kept", "storage")], "req_id string, label string, text string, title string")
    asked = spark.createDataFrame([("t1", "login"), ("t1", "user"), ("t1", "logs"), ("t2", "storage"), ("t3", "nothing")], "test_id string, word string")
    got = {(r.test_id, r.req_id, r.label): (r.confidence, r["rank"], r.reason.split()[0]) for r in suggest.suggested(asked, suggest.by_words(said, words)).collect()}
    assert got == {("t1", "R1", "A"): (0.75, 1, "direct"), ("t1", "R1", "B"): (0.05, 2, "requirement"), ("t2", "R2", "A"): (0.05, 1, "requirement")}
    fixed = lambda df: df.select("test_id", F.lit("R").alias("req_id"), F.lit("A").alias("label"), F.when(df.word == "user", 500.0).otherwise(0.0).alias("score"), F.lit(True).alias("direct"))
    assert [(r.test_id, r.confidence) for r in suggest.suggested(asked, fixed).collect()] == [("t1", 1.0)]


def test_snapshots_are_matched_by_id_then_by_content(spark):
    old = [("a", "f1", "1"), ("b", "f1", "2"), ("c", "f1", "3"), ("d", "f1", "4"), ("e", "f1", "5"), ("f", "f1", None), ("g", "f1", "9"), ("h", "f1", "9")]
    new = [("a", "f1", "1"), ("b", "f2", "2"), ("c", "f1", "0"), ("d", "f2", "0"), ("x", "f2", "5"), ("y", "f1", None), ("z", "f1", "9")]
    schema = "id string, path string, hash string"
    got = {(r.id, r.new_id): r.change for r in changes.between(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    assert got == {("b", "b"): "moved", ("c", "c"): "edited", ("d", "d"): "moved and edited", ("e", "x"): "renamed and moved", ("f", None): "removed", (None, "y"): "added", ("g", "z"): "renamed", ("h", None): "removed"}


def test_the_nearest_wanted_ancestor(spark):
    e = edges(spark, ("F", "r"), ("r", "a"), ("G", "m"), ("m", "a2"), ("r", "a2"), ("x", "y"), ("y", "x"), ("y", "z"), ("B", "F"))
    got = {tuple(r) for r in closure.nearest(e, nodes(spark, "r", "a", "a2", "z", "F"), nodes(spark, "F", "G", "B")).collect()}
    assert got == {("r", "F", 1), ("a", "F", 2), ("a2", "F", 2), ("F", "B", 1)}
    assert closure.nearest(e, nodes(spark, "z"), nodes(spark, "F")).count() == 0


def test_tables_of_other_columns_are_united_with_owners(spark):
    a = spark.createDataFrame([("one", "X", "t"), ("one", "Y", "t")], "repo string, id string, title string")
    b = spark.createDataFrame([("two", "X", 1.0)], "repo string, id string, size double")
    got = {(r.repo, r.id): (r.title, r.size, r.owner, r.contested) for r in fed.united([a, b]).collect()}
    assert got == {("one", "X"): ("t", None, "one", True), ("one", "Y"): ("t", None, "one", False), ("two", "X"): (None, 1.0, "one", True)}


def test_long_sequences_are_scanned_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(windows, "SPAN", 7)
    rng = random.Random(5)
    rows = [("big", n, rng.choice([None, None, None, n])) for n in sorted(rng.sample(range(300), 120))] + [("one", 5, None), ("two", 900, 1)]
    df = spark.createDataFrame(rows, "file string, line long, v long")
    order = [F.col("line")]
    df = windows.known(df, ["file"], "line", order, F.col("v"), "held")
    df = windows.known(df, ["file"], "line", order, F.col("v"), "ahead", own=False, ahead=True)
    df = windows.summed(df, ["file"], "line", order, F.lit(2), "total")
    got = {(r.file, r.line): (r.held, r.ahead, r.total) for r in df.collect()}
    for file in ("big", "one", "two"):
        own = [(n, v) for f, n, v in rows if f == file]
        for i, (n, _) in enumerate(own):
            held = [v for _, v in own[: i + 1] if v is not None]
            ahead = [v for _, v in own[i + 1 :] if v is not None]
            assert got[file, n] == (held[-1] if held else None, ahead[0] if ahead else None, 2 * (i + 1))
    markers = [n for n in range(300) if rng.random() < 0.2]
    lines = [n for n in range(300) if rng.random() < 0.3]
    frames = [spark.createDataFrame([("f", n) for n in x], "file string, line long") for x in (markers, lines)]
    got = {r.line: r.block for r in windows.block_owner(*frames, ["file"], "line").collect()}
    block, prior, want = 0, 0, {}
    for n, m in sorted([(n, 0) for n in markers] + [(n, 1) for n in lines]):
        block += m == 0 and prior == 0
        prior = 1 if m == 0 else 0
        if m:
            want[n] = block
    assert got == want


def test_snapshot_hashes_round_halves_as_sql_does(spark, tmp_path):
    import duckdb

    from tracewell.plans import registry

    rows = [(1000 + i, i % 7, "O" if i % 2 else "F", float(i // 2) + 0.5, "1-URGENT" if i % 5 == 0 else "2-HIGH") for i in range(400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    for name in ("customer", "nation", "region", "lineitem", "conversations", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{name}.parquet')")
    got = registry.queries()["detect_moved"](spark, str(tmp_path)).collect()
    want = con.execute(registry.oracle_sql()["detect_moved"]).fetchall()
    key = lambda r: tuple(str(c) for c in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["line_range_join", "lcov_tested", "aggregate_line_coverage"])
def test_opened_ranges_are_never_broadcast(spark, name):
    from tracewell.plans import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_lcov_counts_lines_once_and_takes_the_strictest_fraction(spark, tmp_path):
    import os

    import duckdb

    from tracewell.plans import registry

    sf = "/root/testdata/sf0.001"
    # Parts of one file overlap (1 and 3); the file of part 20 asks for half of its lines, that of part 40 for none.
    parts = spark.read.parquet(f"{sf}/part.parquet").drop("p_partkey", "p_brand", "p_size").limit(1)
    at = spark.createDataFrame([(1, "Brand#13", 5), (3, "Brand#13", 5), (20, "Brand#12", 4), (40, "Brand#10", 9)], "p_partkey long, p_brand string, p_size long")
    parts.crossJoin(at).write.parquet(f"{tmp_path}/part.parquet")
    base = spark.read.parquet(f"{sf}/lineitem.parquet")
    line = base.limit(1).drop("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax", "l_linestatus")
    rows = [(1, 1, 1, 30.0, 0.0, "F"), (1, 3, 2, 30.0, 0.0, "F"), (1, 3, 3, 1.0, 0.01, "F"), (2, 20, 1, 30.0, 0.01, "F"), (2, 40, 2, 30.0, 0.01, "F"), (2, 40, 3, 1.0, 0.0, "F"), (2, 20, 4, 30.0, 0.01, "O")]
    kinds = {f: base.schema[f].dataType for f in ("l_quantity", "l_tax")}
    cited = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_tax double, l_linestatus string")
    cited = cited.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()}).withColumn("l_linenumber", F.col("l_linenumber").cast(base.schema["l_linenumber"].dataType))
    line.crossJoin(cited).select(base.columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for f in os.listdir(sf):
        if f not in ("part.parquet", "lineitem.parquet"):
            os.symlink(f"{sf}/{f}", tmp_path / f)
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    df = registry.queries()["lcov_tested"](spark, str(tmp_path))
    got = {(r.req_id, r.label): (r.immediate_direct, r.immediate_indirect) for r in df.collect()}
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()['lcov_tested']})").fetchall()
    assert got == {(r[0], r[1]): tuple(map(float, r[2:])) for r in want}
    # Lines 1 to 8 stand for order 1, of which 2 and 5 ran; label C has its own share of 3 to 8.
    assert {k: v for k, v in got.items() if k[0] == "O1"} == {("O1", "A"): (0.0, 0.25), ("O1", "B"): (0.0, 0.25), ("O1", "C"): (round(1 / 6, 6), 0.0)}
    assert ("O2", "B") in got and got["O2", "A"] == (0.0, got["O2", "B"][0]) and got["O2", "B"] == (0.1, 0.0)


def test_conduction_broadcasts_no_table_of_nodes(spark):
    labels = spark.createDataFrame([("a", "A", 0.0), ("b", "A", 1.0), ("c", "A", 0.5)], "node string, label string, x double")
    edges = spark.createDataFrame([("a", "b", None), ("a", "c", "A")], "src string, dst string, label string")
    out = conduction.conducted(labels, edges, ["x"])
    assert [tuple(r) for r in out.collect()] == [("a", "A", 0.75)]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_source_matches_are_distinct_without_a_last_shuffle(spark):
    results = spark.createDataFrame([("r", "J1/1", "f", 1, None, None)] * 2, "result_id string, name string, file string, line int, root_file string, root_line int")
    tests = spark.createDataFrame([("t", "f", 1, "J1/1")] * 2 + [("u", "f", 1, None)], "test_id string, file string, line int, step string")
    got = matching.source_matches(results, tests)
    assert [tuple(r) for r in got.collect()] == [("r", "t", "step")]
    assert not got._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_immediate_measures_join_nothing_and_take_repeated_rows(spark):
    a = spark.createDataFrame([("r", "A"), ("r", "A"), ("r", "B"), ("bare", "A"), (None, "A")], "req_id string, label string")
    edge = "req_id string, source_id string, label string"
    code = spark.createDataFrame([("r", "c1", "A"), ("r", "c1", "A"), ("r", "c3", None), ("r", "c4", "Z"), ("gone", "c5", "A"), (None, "c6", "A"), (None, "c7", None)], edge)
    wide = coverage.immediate(a, coverage.evidence(code), "implemented")
    got = {(r.req_id, r.label, r.implemented_direct, r.implemented_indirect) for r in wide.collect()}
    assert got == {("r", "A", 1, 1), ("r", "B", 0, 1), ("bare", "A", 0, 0), (None, "A", 0, 0)} and wide.count() == 4
    assert "Join" not in wide._jdf.queryExecution().optimizedPlan().toString()


def test_leaves_are_joined_with_nothing_conducted(spark):
    from tracewell.plans import coverage as plans
    from tracewell.plans.estate import Estate

    e = Estate(spark, "/root/testdata/sf0.001")
    upper, leaves = plans.refined_immediates(e, "implemented")
    parents = {r.src for r in plans.refining_of(e).select("src").distinct().collect()}
    assert {r.req_id for r in upper.collect()} <= parents and not {r.req_id for r in leaves.collect()} & parents
    plan = plans.measures_of(e, "implemented")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and upper.count() + leaves.count() == plans.measures_of(e, "implemented").count()


def test_dimension_check_lists_what_nothing_covers(spark):
    from tracewell.plans import coverage as plans
    from tracewell.plans.estate import Estate

    e = Estate(spark, "/root/testdata/sf0.001")
    rows = plans.dimension_coverage_check(e).collect()
    summary = {r.dim: r for r in rows if r.req_id is None}
    assert sorted(summary) == sorted(coverage.DIMENSIONS)
    none = {}
    for r in rows:
        if r.req_id is not None:
            none.setdefault(r.dim, []).append((r.req_id, r.label))
    for d, r in summary.items():
        assert r.assertions == r.covered + len(none[d]) and len(set(none[d])) == len(none[d])
        assert r.req_with_direct <= r.req_with_any <= r.requirements and r.immediate_direct <= r.total_covered <= r.assertions
    t = summary["tested"]
    assert t.tested_passed > 0 and abs(t.tested_passed + t.tested_failed + t.tested_awaiting - t.total_covered) < 1e-4
    # The states of wide rows are those of rows by dimension.
    key = lambda df: sorted((r.req_id, r.label, r.state, round(r.credit, 9)) for r in df.collect())
    assert key(coverage.states(plans.measures_wide(e))) == key(coverage.partition(plans.measures_of(e)))
