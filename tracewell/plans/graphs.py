"""Graph queries over the refinement hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import closure as graph
from tracewell.operators import coverage as cov
from tracewell.operators.strong import strongly_connected
from tracewell.plans.coverage import conducted_of, immediate_of, r6
from tracewell.plans.estate import Estate
from tracewell.plans.registry import query

_UP = """links AS (SELECT DISTINCT src, dst FROM refines),
up_all(seed, node, depth) AS (SELECT id, id, 0 FROM requirements UNION SELECT seed, src, depth + 1 FROM up_all JOIN links ON dst = node),
up AS (SELECT seed, node, min(depth) AS depth FROM up_all GROUP BY ALL)"""


def links(e: Estate) -> DataFrame:
    return e.refines.select("src", "dst").distinct()


def upward(e: Estate) -> DataFrame:
    back = links(e).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.closure(back, e.requirements.select(F.col("id").alias("node")))


@query("SELECT seed AS id, node AS ancestor, depth FROM up WHERE depth > 0", tables=_UP, recursive=True)
def ancestors(e: Estate) -> DataFrame:
    return upward(e).where("depth > 0").select(F.col("seed").alias("id"), F.col("node").alias("ancestor"), "depth")


@query("SELECT node AS id, count(*) AS descendants FROM up WHERE depth > 0 GROUP BY node", tables=_UP, recursive=True)
def descendant_count(e: Estate) -> DataFrame:
    return upward(e).where("depth > 0").groupBy(F.col("node").alias("id")).agg(F.count("*").alias("descendants"))


@query("SELECT seed AS id, min(depth) AS depth FROM up JOIN requirements ON node = id WHERE level = 'PRD' GROUP BY seed", tables=_UP, recursive=True)
def depth(e: Estate) -> DataFrame:
    roots = e.requirements.where("level = 'PRD'").select(F.col("id").alias("node"))
    down = graph.closure(links(e), roots)
    return down.groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth"))


@query("SELECT seed AS id FROM up WHERE node = 'N3'", tables=_UP, recursive=True)
def scope_ids(e: Estate) -> DataFrame:
    start = e.requirements.where("id = 'N3'").select(F.col("id").alias("node"))
    return graph.closure(links(e), start).select(F.col("node").alias("id"))


@query("SELECT seed AS id, depth FROM up WHERE node = 'R1' AND depth <= 2", tables=_UP, recursive=True)
def subtree(e: Estate) -> DataFrame:
    start = e.requirements.where("id = 'R1'").select(F.col("id").alias("node"))
    return graph.closure(links(e), start, max_depth=2).select(F.col("node").alias("id"), "depth")


@query("SELECT DISTINCT seed AS id FROM up JOIN requirements ON node = id WHERE level = 'PRD'", tables=_UP, recursive=True)
def connected_nodes(e: Estate) -> DataFrame:
    roots = e.requirements.where("level = 'PRD'").select(F.col("id").alias("node"))
    return graph.closure(links(e), roots).select(F.col("node").alias("id")).distinct()


_WALK = """links AS (SELECT DISTINCT src, dst FROM refines),
walked(node, depth, path) AS (SELECT id, 0, [id] FROM requirements WHERE level = 'PRD' UNION ALL SELECT dst, depth + 1, list_append(path, dst) FROM walked JOIN links ON src = node WHERE NOT list_contains(path, dst))"""


@query("SELECT node, depth, array_to_string(path, '/') AS path FROM walked", tables=_WALK, recursive=True)
def walk(e: Estate) -> DataFrame:
    roots = e.requirements.where("level = 'PRD'").select(F.col("id").alias("node"))
    return graph.paths(links(e), roots).select("node", "depth", F.array_join("path", "/").alias("path"))


@query("SELECT node AS id, depth, path[-2] AS parent, count(*) AS shown FROM walked GROUP BY ALL", tables=_WALK, recursive=True)
def tree_rows(e: Estate) -> DataFrame:
    roots = e.requirements.where("level = 'PRD'").select(F.col("id").alias("node"))
    rows = graph.paths(links(e), roots).withColumn("parent", F.try_element_at("path", F.lit(-2)))
    return rows.groupBy(F.col("node").alias("id"), "depth", "parent").agg(F.count("*").alias("shown"))


@query("SELECT id, coalesce(n, 1) AS fan_in FROM requirements LEFT JOIN (SELECT dst, count(*) AS n FROM (SELECT DISTINCT src, dst FROM refines) GROUP BY dst) ON dst = id")
def fan_in(e: Estate) -> DataFrame:
    n = links(e).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return e.requirements.select("id").join(n, "id", "left").select("id", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).alias("fan_in"))


_NEAR = _UP + ", kids AS (SELECT src, count(*) AS kids FROM links GROUP BY src)"


@query("SELECT id, coalesce(round(s + 1e-9, 6), 0.0) AS neighborhood FROM requirements LEFT JOIN (SELECT seed, sum(pow(0.5, depth - 1) * (kids - CASE WHEN l.src IS NULL THEN 0 ELSE 1 END)) AS s FROM up JOIN kids k ON k.src = node LEFT JOIN links l ON l.src = node AND l.dst = seed WHERE depth > 0 GROUP BY seed) ON seed = id", tables=_NEAR, recursive=True)
def neighborhood(e: Estate) -> DataFrame:
    own = links(e)
    kids = own.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("kids"))
    direct = own.select(F.col("src").alias("node"), F.col("dst").alias("seed"), F.lit(1).alias("own"))
    up = upward(e).where("depth > 0").join(kids, "node").join(direct, ["node", "seed"], "left")
    score = up.groupBy(F.col("seed").alias("id")).agg(F.sum(F.pow(F.lit(0.5), F.col("depth") - 1) * (F.col("kids") - F.coalesce("own", F.lit(0)))).alias("s"))
    return e.requirements.select("id").join(score, "id", "left").select("id", F.coalesce(r6("s"), F.lit(0.0)).alias("neighborhood"))


_UNCOVERED = _UP + ", bare AS (SELECT id FROM requirements WHERE id NOT IN (SELECT src FROM links) AND id NOT IN (SELECT req_id FROM measures WHERE dim = 'implemented' AND immediate_direct > 0))"


@query("SELECT node AS id, count(*) AS uncovered FROM up JOIN bare ON seed = id WHERE depth > 0 GROUP BY node", tables=_UNCOVERED, recursive=True)
def uncovered_dependents(e: Estate) -> DataFrame:
    covered = immediate_of(e, "implemented").where("immediate_direct > 0").select(F.col("req_id").alias("node")).distinct()
    ids = e.requirements.select(F.col("id").alias("node"))
    bare = ids.join(links(e).select(F.col("src").alias("node")), "node", "left_anti").join(covered, "node", "left_anti")
    back = links(e).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.closure(back, bare).where("depth > 0").groupBy(F.col("node").alias("id")).agg(F.count("*").alias("uncovered"))


ROUNDS = 6
_RANK = "links AS (SELECT DISTINCT src, dst FROM refines), outs AS (SELECT id, count(src) AS o, (SELECT count(*) FROM requirements) AS n FROM requirements LEFT JOIN links ON dst = id GROUP BY id), p0 AS (SELECT id, o, n, 1.0::DOUBLE / n AS s FROM outs), " + ", ".join(
    f"p{i} AS (SELECT p.id, o, n, 0.15 / n + 0.85 * (coalesce(got, 0.0) + (SELECT coalesce(sum(s), 0.0) FROM p{i - 1} WHERE o = 0) / n) AS s FROM p{i - 1} p LEFT JOIN (SELECT src, sum(s / o) AS got FROM links JOIN p{i - 1} ON dst = id GROUP BY src) g ON g.src = p.id)" for i in range(1, ROUNDS + 1)
)


@query(f"SELECT id, round(s, 9) AS score FROM p{ROUNDS}", tables=_RANK)
def centrality(e: Estate) -> DataFrame:
    ranks = graph.page_rank(e.requirements.select(F.col("id").alias("node")), e.refines, rounds=ROUNDS, tolerance=0.0)
    return ranks.select(F.col("node").alias("id"), F.round("score", 9).alias("score"))


@query("SELECT req_id, label, dim, round(rolled_direct + 1e-9, 6) AS rolled_direct, round(rolled_indirect + 1e-9, 6) AS rolled_indirect FROM measures WHERE rolled_direct > 1e-9 OR rolled_indirect > 1e-9")
def conduct_refines(e: Estate) -> DataFrame:
    """What each label gets from the requirements that refine it, in two measures and every dimension."""
    got = conducted_of(e)
    rows = F.array(*[F.struct(F.lit(d).alias("dim"), r6(f"{d}_direct").alias("rolled_direct"), r6(f"{d}_indirect").alias("rolled_indirect")) for d in cov.DIMENSIONS])
    return got.select(F.col("node").alias("req_id"), "label", F.inline(rows)).where("rolled_direct > 0 or rolled_indirect > 0")


_CHOSEN = _UP + ", chosen AS (SELECT id FROM requirements WHERE status IN ('Draft', 'Roadmap'))"


@query("SELECT c.id, coalesce(list_sort(list(seed) FILTER (WHERE seed IS NOT NULL)), []) AS superseded_by FROM chosen c LEFT JOIN (SELECT node, seed FROM up JOIN chosen ON seed = id WHERE depth > 0) ON node = c.id GROUP BY c.id", tables=_CHOSEN, recursive=True)
def minimize_set(e: Estate) -> DataFrame:
    """Of all drafts and plans, those that a finer one stands for."""
    chosen = e.requirements.where(F.col("status").isin("Draft", "Roadmap")).select(F.col("id").alias("node"))
    return graph.minimized(links(e), chosen).withColumnRenamed("node", "id")


def follows(e: Estate, step: int, priority: str) -> DataFrame:
    """Customers that an order of a priority ties to the customer of a later order."""
    o = e.table("orders")
    later = o.select((F.col("o_orderkey") - step).alias("o_orderkey"), F.col("o_custkey").alias("dst"))
    tied = o.where((F.col("o_orderpriority") == priority) & F.col("o_orderstatus").isin("F", "O"))
    return tied.select("o_orderkey", F.col("o_custkey").alias("src")).join(later.hint("merge"), "o_orderkey").select("src", "dst")


def follows_sql(step: int, priority: str) -> str:
    return f"""tied AS (SELECT DISTINCT a.o_custkey AS src, b.o_custkey AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + {step} WHERE a.o_orderpriority = '{priority}' AND a.o_orderstatus IN ('F', 'O')),
reach(src, dst) AS (SELECT src, dst FROM tied UNION SELECT reach.src, tied.dst FROM reach JOIN tied ON reach.dst = tied.src)"""


_CYCLES = "SELECT a.src AS node, least(min(a.dst), a.src) AS cycle FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src"


@query(_CYCLES, tables=follows_sql(1, "1-URGENT"), recursive=True)
def requirement_cycles(e: Estate) -> DataFrame:
    return strongly_connected(follows(e, 1, "1-URGENT")).withColumnRenamed("component", "cycle")


@query(_CYCLES, tables=follows_sql(3, "2-HIGH"), recursive=True)
def satisfies_cycles(e: Estate) -> DataFrame:
    return strongly_connected(follows(e, 3, "2-HIGH")).withColumnRenamed("component", "cycle")


@query("SELECT r.id, list_sort(list(DISTINCT a.node)) AS ancestors, coalesce(k.kids, []) AS children FROM requirements r JOIN up a ON a.seed = r.id AND a.depth > 0 LEFT JOIN (SELECT src, list_sort(list(dst)) AS kids FROM links GROUP BY src) k ON k.src = r.id GROUP BY r.id, k.kids", tables=_UP, recursive=True)
def hierarchy(e: Estate) -> DataFrame:
    up = upward(e).where("depth > 0").groupBy(F.col("seed").alias("id")).agg(F.sort_array(F.collect_set("node")).alias("ancestors"))
    kids = links(e).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("children"))
    return up.join(kids, "id", "left").select("id", "ancestors", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


@query("SELECT id, kind FROM (SELECT id, 'requirement' AS kind FROM requirements) WHERE id NOT IN (SELECT dst FROM refines)")
def iter_roots(e: Estate) -> DataFrame:
    return e.requirements.join(links(e).select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit("requirement").alias("kind"))
