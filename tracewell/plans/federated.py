"""Template, integration and summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import closure as graph
from tracewell.operators import coverage as cov
from tracewell.operators import federation as fed
from tracewell.plans.coverage import contributions_of, measures_of, population_of, r6
from tracewell.plans.estate import Estate
from tracewell.plans.graphs import _UP, links, upward
from tracewell.plans.registry import query

_SATISFIES = """satisfies AS (SELECT 'C' || c_custkey AS declaring, 'N' || (c_custkey % 30) AS template FROM customer WHERE c_custkey % 10 = 0),
clones AS (SELECT declaring || '::' || template AS id, template, declaring FROM satisfies WHERE template IN (SELECT id FROM requirements))"""
_INTEGRATES = """wanted AS (SELECT 'S' || s_suppkey AS consumer, r_name AS repo, CASE s_suppkey % 4 WHEN 0 THEN 'X' || s_suppkey ELSE 'C' || (s_suppkey * 17 % 2000) || CASE WHEN s_suppkey % 3 = 0 THEN '-A' ELSE '' END END AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
bound AS (SELECT w.*, coalesce(a.id, b.id) AS bound, coalesce(a.repo, b.repo) AS owner FROM wanted w LEFT JOIN requirements a ON a.id = target LEFT JOIN requirements b ON b.id = regexp_replace(target, '-[^-]*$', '')),
integrated AS (SELECT consumer, repo, target, bound, CASE WHEN owner = repo THEN 'forbidden' WHEN owner IS NULL AND target[1] IN ('R', 'N', 'C', 'O') THEN 'unknown_requirement' WHEN owner IS NULL THEN 'unknown_namespace' END AS class FROM bound)"""


def satisfies(e: Estate) -> DataFrame:
    k = F.col("c_custkey")
    return e.table("customer").where(k % 10 == 0).select(F.concat(F.lit("C"), k).alias("declaring"), F.concat(F.lit("N"), k % 30).alias("template"))


def integrated(e: Estate) -> DataFrame:
    k = F.col("s_suppkey")
    where = e.table("nation").join(e.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    target = F.when(k % 4 == 0, F.concat(F.lit("X"), k)).otherwise(F.concat(F.lit("C"), k * 17 % 2000, F.when(k % 3 == 0, "-A").otherwise("")))
    wanted = e.table("supplier").join(where, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S"), k).alias("consumer"), F.col("r_name").alias("repo"), target.alias("target"))
    return fed.integrated(wanted, e.requirements, ["R", "N", "C", "O"])


@query("SELECT c.id, c.template, c.declaring, a.label FROM clones c JOIN assertions a ON a.req_id = template", tables=_SATISFIES)
def instantiate_templates(e: Estate) -> DataFrame:
    clones, labels = fed.instantiated(satisfies(e), e.requirements, e.assertions)
    return clones.join(labels, "id").select("id", "template", "declaring", "label")


_ACROSS = """wants AS (
  SELECT 'C' || c_custkey AS declaring, r_name AS repo, CASE c_custkey % 5 WHEN 0 THEN 'Z' || c_custkey WHEN 1 THEN 'n' || c_custkey % 25 ELSE 'N' || c_custkey % 28 END AS target FROM placed WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'N' || n_nationkey, r_name, 'R' || (n_regionkey + 1) % 5 FROM nation JOIN region ON n_regionkey = r_regionkey),
owned AS (SELECT repo, id, id LIKE 'R%' OR substr(id, 2)::BIGINT % 4 <> 0 AS template FROM requirements WHERE id LIKE 'R%' OR id LIKE 'N%'),
resolved AS (SELECT w.*, coalesce(a.id, b.id) AS template, coalesce(a.repo, b.repo) AS template_repo, coalesce(a.template, b.template) AS is_template FROM wants w LEFT JOIN owned a ON a.id = target LEFT JOIN owned b ON b.id = upper(target)),
judged AS (SELECT declaring, repo, target, template, template_repo, CASE WHEN template IS NULL THEN CASE WHEN target[1] IN ('R', 'N', 'C', 'O') THEN 'unknown_requirement' ELSE 'unknown_namespace' END WHEN template_repo = repo THEN 'local' WHEN NOT is_template THEN 'not_template' END AS class FROM resolved)"""


@query(
    """SELECT declaring, repo, target, template, template_repo, class, CASE WHEN class IS NULL THEN declaring || '::' || template END AS clone, NULL::VARCHAR AS label FROM judged
UNION ALL SELECT declaring, repo, target, template, template_repo, class, declaring || '::' || template || '-' || label, label FROM judged JOIN assertions ON req_id = template WHERE class IS NULL""",
    tables=_ACROSS,
)
def instantiate_cross_repo(e: Estate) -> DataFrame:
    """Customers satisfy nations of other regions, and nations satisfy regions: clones with
    their assertions, and what isn't cloned with the reason."""
    k = F.col("c_custkey")
    target = F.when(k % 5 == 0, F.concat(F.lit("Z"), k)).when(k % 5 == 1, F.concat(F.lit("n"), k % 25)).otherwise(F.concat(F.lit("N"), k % 28))
    wants = e.placed.where(k % 3 == 0).select(F.concat(F.lit("C"), k).alias("declaring"), F.col("r_name").alias("repo"), target.alias("target"))
    nations = e.table("nation").join(e.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    wants = wants.unionByName(nations.select(F.concat(F.lit("N"), "n_nationkey").alias("declaring"), F.col("r_name").alias("repo"), F.concat(F.lit("R"), (F.col("n_regionkey") + 1) % 5).alias("target")))
    upper = e.requirements.where(F.left("id", F.lit(1)).isin("R", "N"))
    owned = upper.select("repo", "id", (F.col("id").startswith("R") | (F.substring("id", 2, 20).cast("long") % 4 != 0)).alias("template"))
    return fed.instantiated_across(wants, owned, e.assertions, ["R", "N", "C", "O"])


@query("SELECT DISTINCT declaring, template FROM satisfies WHERE template NOT IN (SELECT id FROM requirements)", tables=_SATISFIES)
def refs_resolve_satisfies(e: Estate) -> DataFrame:
    return satisfies(e).join(e.requirements.select(F.col("id").alias("template")), "template", "left_anti").select("declaring", "template").distinct()


@query("SELECT DISTINCT template FROM clones JOIN refines ON dst = template", tables=_SATISFIES)
def template_marker_faults(e: Estate) -> DataFrame:
    """Templates that refine something themselves."""
    clones, _ = fed.instantiated(satisfies(e), e.requirements, e.assertions)
    return clones.select("template").distinct().join(e.refines.select(F.col("dst").alias("template")), "template", "left_semi")


@query("SELECT c.id, coalesce(n, 0) AS covers FROM clones c LEFT JOIN (SELECT src, count(*) AS n FROM refines GROUP BY src) ON src = template", tables=_SATISFIES)
def inherited_coverage_for(e: Estate) -> DataFrame:
    clones, _ = fed.instantiated(satisfies(e), e.requirements, e.assertions)
    n = e.refines.groupBy(F.col("src").alias("template")).agg(F.count("*").alias("n"))
    return clones.join(n, "template", "left").select("id", F.coalesce("n", F.lit(0)).alias("covers"))


@query("SELECT declaring, count(*) AS total FROM (SELECT declaring, label FROM clones JOIN assertions ON req_id = template UNION ALL SELECT req_id, label FROM assertions WHERE req_id IN (SELECT declaring FROM clones)) GROUP BY declaring", tables=_SATISFIES)
def satisfier_rollup(e: Estate) -> DataFrame:
    """Own assertions and those of the template together."""
    clones, labels = fed.instantiated(satisfies(e), e.requirements, e.assertions)
    theirs = clones.join(labels, "id").select("declaring", "label")
    own = e.assertions.select(F.col("req_id").alias("declaring"), "label").join(clones.select("declaring"), "declaring", "left_semi")
    return theirs.unionByName(own).groupBy("declaring").agg(F.count("*").alias("total"))


@query("SELECT consumer, repo, target, bound, class FROM integrated", tables=_INTEGRATES)
def wire_integrates(e: Estate) -> DataFrame:
    return integrated(e)


@query("SELECT consumer, bound, round(sum(total) FILTER (WHERE dim = 'implemented') + 1e-9, 6) AS implemented, bool_or(failing) AS failing FROM integrated JOIN totals ON req_id = bound WHERE class IS NULL GROUP BY ALL", tables=_INTEGRATES)
def integrates_rollup(e: Estate) -> DataFrame:
    m = cov.with_total(measures_of(e)).groupBy(F.col("req_id").alias("bound")).agg(F.sum(F.when(F.col("dim") == "implemented", F.col("total"))).alias("implemented"), F.bool_or("failing").alias("failing"))
    return integrated(e).where("class is null").join(m, "bound").select("consumer", "bound", r6("implemented").alias("implemented"), "failing")


@query("SELECT repo, count(DISTINCT consumer) AS consumers FROM integrated WHERE class IS NULL GROUP BY repo", tables=_INTEGRATES)
def integrates_by_associate(e: Estate) -> DataFrame:
    return integrated(e).where("class is null").groupBy("repo").agg(F.countDistinct("consumer").alias("consumers"))


@query("SELECT sum(n)::BIGINT AS consumers FROM (SELECT repo, count(DISTINCT consumer) AS n FROM integrated WHERE class IS NULL GROUP BY repo)", tables=_INTEGRATES)
def integrates_total(e: Estate) -> DataFrame:
    return integrates_by_associate(e).agg(F.sum("consumers").alias("consumers"))


_BRANDS = "paths AS (SELECT p_partkey, 'src/k' || lower(p_type) || '/' || replace(p_name, ' ', '/') || '/f' || p_size AS path FROM part), dirs AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS dir FROM part UNION SELECT DISTINCT 'k' || lower(p_type) || '/' || split_part(p_name, ' ', 1) FROM part WHERE p_size % 2 = 0)"


@query("SELECT DISTINCT path, first_value(dir) OVER (PARTITION BY path ORDER BY strpos('/' || path || '/', '/' || dir || '/') DESC, length(dir) DESC) AS dir FROM paths JOIN dirs ON contains('/' || path || '/', '/' || dir || '/')", tables=_BRANDS)
def app_dir_match(e: Estate) -> DataFrame:
    part = e.table("part")
    name, kind = F.split("p_name", " ")[0], F.concat(F.lit("k"), F.lower("p_type"))
    paths = part.select(F.concat_ws("/", F.lit("src"), kind, F.translate("p_name", " ", "/"), F.concat(F.lit("f"), "p_size")).alias("path"))
    dirs = part.select(name.alias("dir")).unionByName(part.where("p_size % 2 = 0").select(F.concat_ws("/", kind, name).alias("dir")))
    return fed.deepest_dir(paths, dirs)


@query("SELECT CASE WHEN level IN ('PRD', 'OPS') THEN level ELSE 'other' END AS level_group, count(*) AS n FROM requirements GROUP BY 1")
def group_by_level(e: Estate) -> DataFrame:
    return e.requirements.groupBy(F.when(F.col("level").isin("PRD", "OPS"), F.col("level")).otherwise("other").alias("level_group")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS refs, count(DISTINCT source_id) AS files FROM implements")
def count_implementation_files(e: Estate) -> DataFrame:
    return e.implements.agg(F.count("*").alias("refs"), F.countDistinct("source_id").alias("files"))


@query("SELECT DISTINCT regexp_extract(title, '#(.*)$', 1) AS topic FROM requirements WHERE title LIKE '%#%'")
def collect_topics(e: Estate) -> DataFrame:
    return e.requirements.where(F.contains("title", F.lit("#"))).select(F.regexp_extract("title", "#(.*)$", 1).alias("topic")).distinct()


@query("SELECT count(*) FILTER (WHERE tier = 'passed') AS passed, count(*) FILTER (WHERE tier = 'failed') AS failed, count(*) FILTER (WHERE tier = 'skipped') AS skipped FROM (SELECT CASE WHEN failing THEN 'failed' WHEN verified = steps THEN 'passed' ELSE 'skipped' END AS tier FROM journey_verdicts)")
def uat_results(e: Estate) -> DataFrame:
    j = cov.journey_verdicts(e.steps)
    tier = F.when(F.col("failing"), "failed").when(F.col("verified") == F.col("steps"), "passed").otherwise("skipped")
    return j.select(tier.alias("t")).agg(*[F.count_if(F.col("t") == s).alias(s) for s in ("passed", "failed", "skipped")])


@query("SELECT (SELECT count(*) FROM requirements) AS nodes, (SELECT count(*) FROM requirements WHERE id NOT IN (SELECT dst FROM refines)) AS roots, (SELECT count(*) > 0 FROM requirements WHERE id NOT IN (SELECT req_id FROM assertions)) AS has_gaps")
def graph_status(e: Estate) -> DataFrame:
    one = lambda df, c: F.broadcast(df.agg(c))
    roots = e.requirements.select("id").join(links(e).select(F.col("dst").alias("id")), "id", "left_anti")
    bare = e.requirements.select("id").join(e.assertions.select(F.col("req_id").alias("id")), "id", "left_anti")
    out = one(e.requirements, F.count("*").alias("nodes")).crossJoin(one(roots, F.count("*").alias("roots")))
    return out.crossJoin(one(bare, (F.count("*") > 0).alias("has_gaps")))


@query("SELECT p_brand AS file, min(l.rank) AS rank FROM part JOIN implements ON source_id = 'P' || p_partkey JOIN requirements r ON r.id = req_id JOIN levels l ON l.level = r.level GROUP BY p_brand")
def files_by_level(e: Estate) -> DataFrame:
    code = e.table("part").select(F.concat(F.lit("P"), "p_partkey").alias("source_id"), F.col("p_brand").alias("file"))
    ranked = e.requirements.join(F.broadcast(e.levels.select("level", "rank")), "level").select(F.col("id").alias("req_id"), "rank")
    return e.implements.join(ranked, "req_id").join(code, "source_id").groupBy("file").agg(F.min("rank").alias("rank"))


@query("SELECT DISTINCT seed AS id FROM up JOIN requirements r ON r.id = node WHERE r.level = 'PRD' AND depth > 0", tables=_UP, recursive=True)
def reachable_to_requirement(e: Estate) -> DataFrame:
    roots = e.requirements.where("level = 'PRD'").select(F.col("id").alias("node"))
    return graph.closure(links(e), roots).where("depth > 0").select(F.col("node").alias("id")).distinct()


_FOUND = _UP + """, kids AS (SELECT src, count(*) AS kids FROM links GROUP BY src), bare AS (SELECT id FROM requirements WHERE id NOT IN (SELECT src FROM links) AND id NOT IN (SELECT req_id FROM measures WHERE dim = 'implemented' AND immediate_direct > 0)),
fan AS (SELECT id, greatest(count(src), 1)::DOUBLE AS f FROM requirements LEFT JOIN links ON dst = id GROUP BY id), unc AS (SELECT node AS id, count(*)::DOUBLE AS u FROM up JOIN bare ON seed = id WHERE depth > 0 GROUP BY node),
comp AS (SELECT r.id, 0.5 * f / max(f) OVER () + 0.5 * coalesce(u, 0) / max(coalesce(u, 0)) OVER () AS composite FROM requirements r JOIN fan USING (id) LEFT JOIN unc USING (id) WHERE r.status IN ('Active', 'Draft'))"""


@query("SELECT id, round(composite + 1e-9, 6) AS composite FROM comp WHERE id IN (SELECT src FROM links) ORDER BY round(composite + 1e-9, 6) DESC, id LIMIT 10", tables=_FOUND, recursive=True)
def top_foundations(e: Estate) -> DataFrame:
    """Non-leaves by weighted fan-in and uncovered dependents, each over its greatest."""
    from tracewell.plans.graphs import fan_in, uncovered_dependents

    keep = e.requirements.where(F.col("status").isin("Active", "Draft")).select("id")
    df = keep.join(fan_in(e), "id").join(uncovered_dependents(e), "id", "left").withColumn("uncovered", F.coalesce("uncovered", F.lit(0)))
    top = F.broadcast(df.agg(F.max("fan_in").alias("mf"), F.max("uncovered").alias("mu")))
    score = 0.5 * F.col("fan_in") / F.col("mf") + 0.5 * F.coalesce(F.try_divide("uncovered", "mu"), F.lit(0.0))
    inner = df.crossJoin(top).join(links(e).select(F.col("src").alias("id")), "id", "left_semi")
    return inner.select("id", r6(score).alias("composite")).orderBy(F.desc("composite"), "id").limit(10)


@query("SELECT CASE WHEN seed IN (SELECT id FROM requirements WHERE title LIKE '%1%') THEN 'hit' ELSE 'miss' END AS found, count(*) AS n FROM up WHERE node = 'R2' GROUP BY 1", tables=_UP, recursive=True)
def scoped_search(e: Estate) -> DataFrame:
    scope = graph.closure(links(e), e.requirements.where("id = 'R2'").select(F.col("id").alias("node"))).select(F.col("node").alias("id"))
    hits = e.requirements.join(scope, "id", "left_semi")
    return hits.groupBy(F.when(F.contains("title", F.lit("1")), "hit").otherwise("miss").alias("found")).agg(F.count("*").alias("n"))


@query("SELECT req_id, source_id AS test_id, max(conf) AS confidence, list_sort(list(DISTINCT source_type)) AS reasons FROM (SELECT *, CASE source_type WHEN 'test_direct' THEN 0.9 ELSE 0.6 END::DOUBLE AS conf FROM contributions WHERE source_type LIKE 'test%') GROUP BY ALL")
def dedupe_suggestions(e: Estate) -> DataFrame:
    found = contributions_of(e).where(F.col("source_type").startswith("test"))
    conf = F.when(F.col("source_type") == "test_direct", 0.9).otherwise(0.6)
    return found.groupBy("req_id", F.col("source_id").alias("test_id")).agg(F.max(conf).alias("confidence"), F.sort_array(F.collect_set("source_type")).alias("reasons"))


@query("SELECT o.repo, s.key, s.value FROM (SELECT DISTINCT r_name AS repo, 'r' || r_regionkey % 2 AS value, 'style' AS key FROM region) o JOIN (SELECT 'style' AS key, 'r0' AS value) s ON o.key = s.key AND o.value IS DISTINCT FROM s.value")
def config_divergence(e: Estate) -> DataFrame:
    """Settings of repositories that differ from the invoking one's (region 0)."""
    rows = e.table("region").select(F.col("r_name").alias("repo"), F.lit("style").alias("key"), F.concat(F.lit("r"), F.col("r_regionkey") % 2).alias("own"), "r_regionkey")
    base = rows.where("r_regionkey = 0").select("key", F.col("own").alias("value"))
    return rows.join(F.broadcast(base), "key").where(~F.col("own").eqNullSafe(F.col("value"))).select("repo", "key", "value")


@query("SELECT id, stat FROM (SELECT id, CASE WHEN id IN (SELECT 'C' || o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') THEN 'branch' WHEN id IN (SELECT 'C' || o_custkey FROM orders WHERE o_orderpriority LIKE '1%') THEN 'modified' END AS stat FROM requirements WHERE id LIKE 'C%') WHERE stat IS NOT NULL")
def git_state_join(e: Estate) -> DataFrame:
    o = e.table("orders").select(F.concat(F.lit("C"), "o_custkey").alias("id"), (F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).alias("b"), F.col("o_orderpriority").startswith("1").alias("m"))
    flags = o.groupBy("id").agg(F.bool_or("b").alias("b"), F.bool_or("m").alias("m"))
    stat = F.when(F.col("b"), "branch").when(F.col("m"), "modified")
    return e.requirements.where(F.col("id").startswith("C")).join(flags, "id").select("id", stat.alias("stat")).where("stat is not null")


@query("SELECT stat, count(*) AS n FROM (SELECT id, CASE WHEN id IN (SELECT 'C' || o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') THEN 'branch' WHEN id IN (SELECT 'C' || o_custkey FROM orders WHERE o_orderpriority LIKE '1%') THEN 'modified' END AS stat FROM requirements WHERE id LIKE 'C%') WHERE stat IS NOT NULL GROUP BY stat")
def count_by_git_status(e: Estate) -> DataFrame:
    return git_state_join(e).groupBy("stat").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM requirements) AS requirements, (SELECT count(*) FROM population) AS counted, (SELECT count(*) FROM refines) AS edges, (SELECT count(*) FROM test_verdicts WHERE failed) AS failing_tests")
def project_summary(e: Estate) -> DataFrame:
    one = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
    out = one(e.requirements, "requirements").crossJoin(one(population_of(e), "counted"))
    return out.crossJoin(one(e.refines, "edges")).crossJoin(one(cov.verdicts(e.results).where("failed"), "failing_tests"))


@query("SELECT r.id, r.level, r.status, (SELECT count(*) FROM assertions a WHERE a.req_id = r.id) AS assertions, coalesce(list_sort(list(DISTINCT p.src) FILTER (WHERE p.src IS NOT NULL)), []) AS parents FROM requirements r LEFT JOIN refines p ON p.dst = r.id GROUP BY r.id, r.level, r.status")
def get_requirement(e: Estate) -> DataFrame:
    n = e.assertions.groupBy(F.col("req_id").alias("id")).agg(F.count("*").alias("assertions"))
    up = e.refines.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("parents"))
    df = e.requirements.join(n, "id", "left").join(up, "id", "left")
    return df.select("id", "level", "status", F.coalesce("assertions", F.lit(0)).alias("assertions"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))


@query("SELECT seed AS id, min_by(node, (depth, node)) AS nearest FROM up JOIN requirements r ON r.id = node WHERE depth > 0 AND r.status = 'Active' GROUP BY seed", tables=_UP, recursive=True)
def promote_orphans(e: Estate) -> DataFrame:
    """The nearest living ancestor of each node."""
    alive = e.requirements.where("status = 'Active'").select(F.col("id").alias("node"))
    up = upward(e).where("depth > 0").join(alive, "node", "left_semi")
    return up.groupBy(F.col("seed").alias("id")).agg(F.min_by("node", F.struct("depth", "node")).alias("nearest"))


_MULTI = """multi AS (SELECT DISTINCT 'S' || l_suppkey AS source_id, r_name AS repo, 'O' || (l_orderkey + l_suppkey % 2) || '-' || chr(64 + l_linenumber) || '+' || chr((65 + l_partkey % 7)::INT) AS target FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
named AS (SELECT *, split_part(target, '-', 1) AS req_id, unnest(list_distinct(string_split(split_part(target, '-', 2), '+'))) AS label FROM multi),
several AS (SELECT * FROM named WHERE (source_id, repo, target) IN (SELECT (source_id, repo, target) FROM named GROUP BY source_id, repo, target HAVING count(*) > 1)),
owned AS (SELECT s.source_id, s.target, s.req_id, s.label, r.repo AS owner, a.label IS NOT NULL AS held FROM several s JOIN requirements r ON r.id = s.req_id AND r.repo <> s.repo LEFT JOIN assertions a ON a.req_id = s.req_id AND a.label = s.label)"""


@query("SELECT source_id, target, owner, req_id, label, CASE WHEN NOT held THEN 'unknown_assertion' END AS class FROM (SELECT *, bool_or(held) OVER (PARTITION BY source_id, target) AS any_held FROM owned) WHERE any_held", tables=_MULTI)
def expand_foreign_multi(e: Estate) -> DataFrame:
    """Suppliers name two lines of an order of another region's repository."""
    where = e.table("nation").join(e.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("repo"))
    target = F.concat(F.lit("O"), F.col("l_orderkey") + F.col("l_suppkey") % 2, F.lit("-"), F.char(F.col("l_linenumber") + 64), F.lit("+"), F.char(F.col("l_partkey") % 7 + 65))
    # Nations are a fixed table. Joined last, they leave suppliers to Spark's size check: joined with them before, their size would be unknown.
    placed = e.table("lineitem").join(e.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(where), F.col("s_nationkey") == F.col("n_nationkey"))
    refs = placed.select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("source_id"), "repo", target.alias("target"))
    return fed.expanded(refs, e.requirements.select("repo", F.col("id").alias("req_id")).join(e.assertions_all.hint("merge"), "req_id"))


@query("SELECT DISTINCT declaring, template, stored FROM clones JOIN (SELECT id, substr(sha256(title || ' ' || count(c_custkey) FILTER (WHERE c_acctbal >= 0)), 1, 8) AS stored, substr(sha256(title || ' ' || count(c_custkey)), 1, 8) AS current FROM requirements JOIN customer ON id = 'N' || c_nationkey GROUP BY id, title) h ON h.id = template WHERE stored <> current", tables=_SATISFIES)
def stale_template_review(e: Estate) -> DataFrame:
    """A nation's text names its number of customers; the stored hash is from before
    those that owe money came."""
    customers = e.table("customer").groupBy(F.concat(F.lit("N"), F.col("c_nationkey")).alias("id")).agg(F.count("*").alias("now"), F.count_if(F.col("c_acctbal") >= 0).alias("then"))
    text = lambda n: F.substring(F.sha2(F.concat_ws(" ", "title", F.col(n).cast("string")), 256), 1, 8)
    hashes = e.requirements.join(customers, "id").select("id", text("then").alias("stored"), text("now").alias("current"))
    clones, _ = fed.instantiated(satisfies(e), e.requirements, e.assertions)
    return fed.templates_to_review(clones, hashes)
