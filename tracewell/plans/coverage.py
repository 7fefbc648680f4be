"""Coverage queries over the estate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.storage import staged
from tracewell.operators import coverage as cov
from tracewell.operators.conduction import conducted_along, refining
from tracewell.plans.estate import Estate
from tracewell.plans.registry import query


def contributions_of(e: Estate) -> DataFrame:
    return cov.contributions(e.implements, e.verifies, e.validates, e.assertions)


#: What a dimension's evidence is read from.
_READ = {"implemented": ("implements",), "tested": ("verifies",), "verified": ("verifies", "results"), "uat_coverage": ("validates",), "uat_verified": ("validates", "steps")}


def attached(e: Estate, *dims: str) -> DataFrame:
    read = sorted({t for d in dims for t in _READ[d]})
    # Repeated citations change no maximum: they needn't be made distinct first.
    whole = {"implements": "implements_all", "verifies": "verifies_all"}
    return cov.immediate(e.assertions_all, cov.evidence(**{t: getattr(e, whole.get(t, t)) for t in read}), *dims)


def immediates(e: Estate, *dims: str) -> DataFrame:
    """Immediate measures of the wanted dimensions, one row per assertion, written once for each estate."""
    name = "immediate " + " ".join(sorted(dims))
    if name not in e.written:
        e.written[name] = staged(attached(e, *dims), "immediate")
    return e.written[name]


def refining_of(e: Estate) -> DataFrame:
    """Edges between requirements, written once for each estate."""
    if "refining" not in e.written:
        known = e.requirements.select(F.col("id").alias("dst"))
        e.written["refining"] = refining(e.refines.join(known.hint("merge"), "dst", "left_semi"))
    return e.written["refining"]


def refined_immediates(e: Estate, *dims: str) -> tuple[DataFrame, DataFrame]:
    """Immediate measures of requirements that others refine, and those of the others: most
    are leaves, to which nothing is conducted and which are joined with nothing later."""
    name = "immediate " + " ".join(sorted(dims))
    if f"marked {name}" not in e.written:
        parents = refining_of(e).select(F.col("src").alias("req_id"), F.lit(True).alias("refined")).distinct()
        marked = staged(attached(e, *dims).join(parents.hint("merge"), "req_id", "left"), "immediate")
        e.written[f"marked {name}"] = marked
        e.written[name] = marked.drop("refined")
    marked = e.written[f"marked {name}"]
    return marked.where("refined").drop("refined"), marked.where("refined is null").drop("refined")


def immediate_of(e: Estate, *dims: str) -> DataFrame:
    """What is attached: one row per (requirement, label, dimension)."""
    dims = dims or cov.DIMENSIONS
    return cov.by_dimension(immediates(e, *dims), *dims)


def conducted_of(e: Estate, *dims: str) -> DataFrame:
    """What refining requirements conduct to each label: node, label and a column pair
    <dimension>_direct, <dimension>_indirect, for labels that get anything from one."""
    dims = dims or cov.DIMENSIONS
    values = [f"{d}_{c}" for d in dims for c in ("direct", "indirect")]
    upper, leaves = (m.select(F.col("req_id").alias("node"), "label", *values) for m in refined_immediates(e, *dims))
    return conducted_along(refining_of(e), leaves, upper, values)


def measures_wide(e: Estate, *dims: str) -> DataFrame:
    """All four measures of the wanted dimensions (all by default), one row per assertion, written once for each estate."""
    dims = dims or cov.DIMENSIONS
    name = "measures " + " ".join(sorted(dims))
    if name not in e.written:
        upper, leaves = refined_immediates(e, *dims)
        rolled = staged(cov.with_rolled(upper, conducted_of(e, *dims), *dims), "measures")
        none = {f"{d}_rolled_{c}": F.lit(0.0) for d in dims for c in ("direct", "indirect")}
        e.written[name] = rolled.unionByName(leaves.withColumns(none))
    return e.written[name]


def measures_of(e: Estate, *dims: str) -> DataFrame:
    """measures_wide, one row per assertion and dimension."""
    return cov.by_dimension(measures_wide(e, *dims), *(dims or cov.DIMENSIONS), rolled=True)


def population_of(e: Estate) -> DataFrame:
    return cov.population(e.requirements, e.statuses)


def counted(e: Estate) -> DataFrame:
    """req_id of the requirements that count: as many as grow with the orders, so never broadcast."""
    return population_of(e).select(F.col("id").alias("req_id")).hint("merge")


def r6(c):
    # A hair up, so that a tie falls the same way whatever the order of the sum.
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


@query("SELECT req_id, label, source_type, count(*) AS sources FROM contributions GROUP BY ALL")
def coverage_contributions(e: Estate) -> DataFrame:
    return contributions_of(e).groupBy("req_id", "label", "source_type").agg(F.count("*").alias("sources"))


@query("SELECT DISTINCT req_id, label, source_id, source_type FROM contributions WHERE source_type IN ('direct', 'code_indirect')")
def coverage_sources(e: Estate) -> DataFrame:
    return cov.credited(e.implements, e.assertions, "direct", "code_indirect")


@query("SELECT req_id, label, source_id, 'implements' AS edge_kind FROM contributions WHERE source_type = 'direct' UNION SELECT req_id, label, source_id, 'verifies' FROM contributions WHERE source_type = 'test_direct'")
def assertion_coverage_pairs(e: Estate) -> DataFrame:
    named = contributions_of(e).where("source_type in ('direct', 'test_direct')")
    return named.select("req_id", "label", "source_id", F.when(F.col("source_type") == "direct", "implements").otherwise("verifies").alias("edge_kind")).distinct()


@query("SELECT req_id, label, dim, immediate_direct, immediate_indirect FROM measures WHERE dim IN ('implemented', 'uat_coverage')")
def implemented_uat_dims(e: Estate) -> DataFrame:
    return immediate_of(e, "implemented", "uat_coverage").select("req_id", "label", "dim", "immediate_direct", "immediate_indirect")


@query("SELECT req_id, label, dim, round(immediate_direct + 1e-9, 6) AS immediate_direct, round(immediate_indirect + 1e-9, 6) AS immediate_indirect, failing FROM measures WHERE dim NOT IN ('implemented', 'uat_coverage')")
def test_dims(e: Estate) -> DataFrame:
    return immediate_of(e, "tested", "verified", "uat_verified").select("req_id", "label", "dim", r6("immediate_direct").alias("immediate_direct"), r6("immediate_indirect").alias("immediate_indirect"), "failing")


@query("SELECT req_id, label FROM measures WHERE dim = 'verified' AND failing")
def failing_labels(e: Estate) -> DataFrame:
    return immediate_of(e, "verified").where("failing").select("req_id", "label")


@query("SELECT journey_id, steps, verified, CASE WHEN failing THEN 'failing' WHEN verified = steps THEN 'full' WHEN verified > 0 THEN 'partial' ELSE 'missing' END AS tier FROM journey_verdicts")
def journey_verification(e: Estate) -> DataFrame:
    j = cov.journey_verdicts(e.steps)
    return j.select("journey_id", "steps", "verified", cov.tier(F.col("verified").cast("double"), F.col("steps"), F.col("failing")).alias("tier"))


@query("SELECT test_id, passed, failed FROM test_verdicts")
def node_verifying_status(e: Estate) -> DataFrame:
    return cov.verdicts(e.results).select("test_id", "passed", "failed")


@query("SELECT test_id, carried FROM test_verdicts")
def carried_results(e: Estate) -> DataFrame:
    return cov.verdicts(e.results).select("test_id", "carried")


@query("SELECT req_id, label, dim, round(total + 1e-9, 6) AS total FROM totals")
def total_by_label(e: Estate) -> DataFrame:
    return cov.with_total(measures_of(e)).select("req_id", "label", "dim", r6("total").alias("total"))


@query("SELECT req_id, dim, round(100 * sum(total) / count(*) + 1e-9, 6) AS covered_pct FROM totals GROUP BY ALL")
def covered_pct(e: Estate) -> DataFrame:
    return cov.with_total(measures_of(e)).groupBy("req_id", "dim").agg(r6(100 * F.sum("total") / F.count("*")).alias("covered_pct"))


@query("SELECT req_id, dim, " + ", ".join(f"round(sum({c}) + 1e-9, 6) AS {c}" for c in cov.MEASURES) + " FROM measures GROUP BY ALL")
def dimension_measures(e: Estate) -> DataFrame:
    return measures_of(e).groupBy("req_id", "dim").agg(*[r6(F.sum(c)).alias(c) for c in cov.MEASURES])


@query("SELECT level, dim, count(DISTINCT req_id) AS requirements, count(*) AS assertions, round(sum(total) + 1e-9, 6) AS covered, " + ", ".join(f"round(sum({c}) + 1e-9, 6) AS {c}" for c in cov.MEASURES) + " FROM totals JOIN population ON req_id = id GROUP BY ALL")
def aggregate_by_level(e: Estate) -> DataFrame:
    m = cov.with_total(measures_of(e))
    sums = {"covered": "total"} | {c: c for c in cov.MEASURES}
    # Sums per requirement first: counting requirements then needs no distinct, and the join no labels.
    by_req = m.groupBy("req_id", "dim").agg(F.count("*").alias("assertions"), *[F.sum(c).alias(n) for n, c in sums.items()])
    placed = by_req.join(population_of(e).select(F.col("id").alias("req_id"), "level").hint("merge"), "req_id")
    return placed.groupBy("level", "dim").agg(F.count("*").alias("requirements"), F.sum("assertions").alias("assertions"), *[r6(F.sum(n)).alias(n) for n in sums])


@query("""SELECT dim, sum(n)::BIGINT AS assertions, round(sum(t) + 1e-9, 6) AS covered, count(*) FILTER (WHERE t > 0) AS req_with_any, count(*) FILTER (WHERE d > 0) AS req_with_direct, bool_or(f) AS has_failures
FROM (SELECT req_id, dim, count(*) AS n, sum(total) AS t, sum(immediate_direct) AS d, bool_or(failing) AS f FROM totals JOIN population ON req_id = id GROUP BY ALL) GROUP BY dim""")
def aggregate_dimension(e: Estate) -> DataFrame:
    # One shuffle by requirement serves the five dimensions' sums and the join: rows meet the population summed.
    m = cov.with_total(measures_of(e))
    by_req = m.groupBy("req_id", "dim").agg(F.count("*").alias("n"), F.sum("total").alias("t"), F.sum("immediate_direct").alias("d"), F.bool_or("failing").alias("f"))
    by_req = by_req.join(counted(e), "req_id", "left_semi")
    return by_req.groupBy("dim").agg(F.sum("n").alias("assertions"), r6(F.sum("t")).alias("covered"), F.count_if(F.col("t") > 0).alias("req_with_any"), F.count_if(F.col("d") > 0).alias("req_with_direct"), F.bool_or("f").alias("has_failures"))


@query("""SELECT dim, count(*) AS requirements FROM (SELECT req_id, dim, sum(total) AS t FROM totals JOIN population ON req_id = id WHERE level = 'DEV' GROUP BY ALL) WHERE t > 0 GROUP BY dim""")
def level_filter(e: Estate) -> DataFrame:
    """Aggregates restricted by a predicate on the level."""
    wanted = population_of(e).where(F.col("level") == "DEV").select(F.col("id").alias("req_id")).hint("merge")
    m = cov.with_total(measures_of(e)).join(wanted, "req_id", "left_semi")
    return m.groupBy("req_id", "dim").agg(F.sum("total").alias("t")).where("t > 0").groupBy("dim").agg(F.count("*").alias("requirements"))


_TIERS = "req_tiers AS (SELECT req_id, dim, CASE WHEN bool_or(failing) THEN 'failing' WHEN sum(least(total, 1.0)) >= count(*) - 1e-9 THEN 'full' WHEN sum(least(total, 1.0)) > 1e-9 THEN 'partial' ELSE 'missing' END AS tier FROM totals GROUP BY req_id, dim)"


@query("SELECT dim, tier, count(*) AS requirements FROM req_tiers JOIN population ON req_id = id GROUP BY ALL", tables=_TIERS)
def tier_buckets(e: Estate) -> DataFrame:
    t = cov.absolute_tiers(cov.with_total(measures_of(e)), "total")
    return t.join(counted(e), "req_id", "left_semi").groupBy("dim", "tier").agg(F.count("*").alias("requirements"))


@query("SELECT req_id, dim, tier FROM req_tiers", tables=_TIERS)
def absolute_tier(e: Estate) -> DataFrame:
    return cov.absolute_tiers(cov.with_total(measures_of(e)), "total")


@query("""SELECT req_id, max(tier) FILTER (WHERE dim = 'implemented') AS implemented, max(tier) FILTER (WHERE dim = 'tested') AS tested, max(tier) FILTER (WHERE dim = 'verified') AS verified, max(tier) FILTER (WHERE dim = 'uat_coverage') AS uat_coverage, max(tier) FILTER (WHERE dim = 'uat_verified') AS uat_verified,
 CASE max(CASE tier WHEN 'failing' THEN 3 WHEN 'missing' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) WHEN 3 THEN 'failing' WHEN 2 THEN 'missing' WHEN 1 THEN 'partial' ELSE 'full' END AS worst FROM req_tiers GROUP BY req_id""", tables=_TIERS)
def requirement_tiers(e: Estate) -> DataFrame:
    t = cov.absolute_tiers(cov.with_total(measures_of(e)), "total")
    severity = F.when(F.col("tier") == "failing", 3).when(F.col("tier") == "missing", 2).when(F.col("tier") == "partial", 1).otherwise(0)
    worst = F.element_at(F.array(*map(F.lit, ("full", "partial", "missing", "failing"))), F.max(severity) + 1)
    return t.groupBy("req_id").agg(*[F.max(F.when(F.col("dim") == d, F.col("tier"))).alias(d) for d in cov.DIMENSIONS], worst.alias("worst"))


@query("SELECT req_id, label, dim, CASE WHEN failing THEN 'failing' WHEN total >= 1 - 1e-9 THEN 'full' WHEN total > 1e-9 THEN 'partial' ELSE 'missing' END AS standing FROM totals")
def assertion_standing(e: Estate) -> DataFrame:
    return cov.with_total(measures_of(e)).select("req_id", "label", "dim", cov.tier(F.col("total"), F.lit(1), F.col("failing")).alias("standing"))


_DENOM = "denominators AS (SELECT req_id, label, CASE dim WHEN 'implemented' THEN 'tested' WHEN 'tested' THEN 'verified' ELSE 'uat_verified' END AS dim FROM measures WHERE immediate_direct > 0 AND dim IN ('implemented', 'tested', 'uat_coverage'))"


@query("SELECT req_id, label, dim FROM denominators", tables=_DENOM)
def denominator_labels(e: Estate) -> DataFrame:
    return cov.denominators(immediate_of(e), "immediate_direct")


@query("""SELECT req_id, dim, CASE WHEN bool_or(failing) THEN 'failing' WHEN sum(least(immediate_direct, 1.0)) >= count(*) - 1e-9 THEN 'full' WHEN sum(least(immediate_direct, 1.0)) > 1e-9 THEN 'partial' ELSE 'missing' END AS tier
FROM measures JOIN denominators USING (req_id, label, dim) GROUP BY ALL""", tables=_DENOM)
def relative_tier(e: Estate) -> DataFrame:
    m = immediate_of(e)
    kept = m.join(cov.denominators(m, "immediate_direct"), ["req_id", "label", "dim"], "left_semi")
    return cov.absolute_tiers(kept, "immediate_direct")


@query("SELECT req_id, label, " + ", ".join(f"CASE WHEN failing THEN 0.0 ELSE round({c} + 1e-9, 6) END AS {c}" for c in cov.MEASURES) + " FROM measures WHERE dim = 'verified'")
def tested_and_passing(e: Estate) -> DataFrame:
    return cov.passing(measures_of(e, "verified")).select("req_id", "label", *[r6(c).alias(c) for c in cov.MEASURES])


_PARTS = """parts AS (SELECT t.req_id, t.label, CASE WHEN v.failing THEN 'failed' WHEN v.total > 0 THEN 'passed' ELSE 'awaiting' END AS state, t.total AS credit FROM totals t JOIN totals v ON t.req_id = v.req_id AND t.label = v.label AND v.dim = 'verified' WHERE t.dim = 'tested' AND t.total > 0)"""


@query("SELECT req_id, state, round(sum(credit) + 1e-9, 6) AS credit FROM parts GROUP BY ALL", tables=_PARTS)
def tested_partition(e: Estate) -> DataFrame:
    return cov.partition(measures_of(e, "tested", "verified")).groupBy("req_id", "state").agg(r6(F.sum("credit")).alias("credit"))


@query("SELECT req_id, count(*) AS covers FROM contributions WHERE source_type IN ('direct', 'code_indirect', 'test_direct', 'test_indirect') GROUP BY req_id")
def direct_coverage_for(e: Estate) -> DataFrame:
    return contributions_of(e).where(~F.col("source_type").startswith("uat")).groupBy("req_id").agg(F.count("*").alias("covers"))


@query("SELECT req_id, count(*) AS labels FROM measures WHERE dim = 'implemented' AND immediate_indirect > immediate_direct GROUP BY req_id")
def whole_req_only(e: Estate) -> DataFrame:
    return immediate_of(e, "implemented").where("immediate_indirect > immediate_direct").groupBy("req_id").agg(F.count("*").alias("labels"))


_CHECKED = (
    _PARTS
    + ", checked AS (SELECT req_id, dim, count(*) AS n, count(*) FILTER (WHERE total > 0) AS held, sum(total) AS t, " + ", ".join(f"sum({c}) AS {c}" for c in cov.MEASURES) + ", bool_or(failing) AS f FROM totals JOIN population ON req_id = id GROUP BY ALL), "
    + "states AS (SELECT 'tested' AS dim, " + ", ".join(f"sum(credit) FILTER (WHERE state = '{s}') AS {s}" for s in cov.STATES) + " FROM parts JOIN population ON req_id = id)"
)


@query(
    """SELECT dim, NULL::VARCHAR AS req_id, NULL::VARCHAR AS label, count(*) AS requirements, count(*) FILTER (WHERE t > 0) AS req_with_any, count(*) FILTER (WHERE immediate_direct > 0) AS req_with_direct, round(100.0 * count(*) FILTER (WHERE t > 0) / count(*), 1) AS req_pct, sum(n)::BIGINT AS assertions, sum(held)::BIGINT AS covered, round(100.0 * sum(held) / sum(n), 1) AS pct, round(sum(t) + 1e-9, 6) AS total_covered, round(100 * sum(t) / sum(n) + 1e-9, 6) AS total_pct, """
    + ", ".join(f"round(sum({c}) + 1e-9, 6) AS {c}" for c in cov.MEASURES)
    + ", round(100 * sum(immediate_direct) / sum(n) + 1e-9, 6) AS cited_pct, "
    + ", ".join(f"round(coalesce(max({s}), 0) + 1e-9, 6) AS tested_{s}" for s in cov.STATES)
    + """, bool_or(f) AS has_failures FROM checked LEFT JOIN states USING (dim) GROUP BY dim
UNION ALL BY NAME SELECT dim, req_id, label FROM totals JOIN population ON req_id = id WHERE total <= 0""",
    tables=_CHECKED,
)
def dimension_coverage_check(e: Estate) -> DataFrame:
    """One row for each dimension, with requirements, assertions, all measures and the standing
    of what is tested, and below it a row for each assertion that nothing covers."""
    m = cov.with_total(measures_of(e))
    n = F.count("*")
    by_req = m.groupBy("req_id", "dim").agg(n.alias("n"), F.count_if(F.col("total") > 0).alias("held"), F.sum("total").alias("t"), *[F.sum(c).alias(c) for c in cov.MEASURES], F.bool_or("failing").alias("f"))
    requirements, any_ = n, F.count_if(F.col("t") > 0)
    assertions, covered = F.sum("n"), F.sum("held")
    share = lambda c: r6(100 * F.sum(c) / assertions)
    figures = {"requirements": requirements, "req_with_any": any_, "req_with_direct": F.count_if(F.col("immediate_direct") > 0), "req_pct": F.round(100.0 * any_ / requirements, 1), "assertions": assertions, "covered": covered, "pct": F.round(100.0 * covered / assertions, 1), "total_covered": r6(F.sum("t")), "total_pct": share("t"), **{c: r6(F.sum(c)) for c in cov.MEASURES}, "cited_pct": share("immediate_direct"), "has_failures": F.bool_or("f")}
    g = by_req.join(counted(e), "req_id", "left_semi").groupBy("dim").agg(*[c.alias(name) for name, c in figures.items()])
    by_state = cov.states(measures_wide(e)).join(counted(e), "req_id", "left_semi")
    # One row, broadcast.
    states = by_state.agg(*[r6(F.coalesce(F.sum(F.when(F.col("state") == s, F.col("credit"))), F.lit(0.0))).alias(f"tested_{s}") for s in cov.STATES])
    tested = [F.when(F.col("dim") == "tested", F.col(f"tested_{s}")).otherwise(0.0).alias(f"tested_{s}") for s in cov.STATES]
    g = g.crossJoin(F.broadcast(states)).select("dim", *figures, *tested)
    none = m.where("total <= 0").select("dim", "req_id", "label").join(counted(e), "req_id", "left_semi")
    return g.unionByName(none, allowMissingColumns=True)


@query("""SELECT level, count(*) AS assertions, count(*) FILTER (WHERE total > 0) AS covered FROM totals JOIN population p ON req_id = id JOIN levels USING (level) WHERE dim = 'uat_coverage' AND expects_validation GROUP BY level""")
def uat_coverage_check(e: Estate) -> DataFrame:
    wanted = population_of(e).join(F.broadcast(e.levels.where("expects_validation").select("level")), "level").select(F.col("id").alias("req_id"), "level")
    m = cov.with_total(measures_of(e, "uat_coverage")).join(wanted, "req_id")
    return m.groupBy("level").agg(F.count("*").alias("assertions"), F.count_if(F.col("total") > 0).alias("covered"))


@query("""SELECT req_id, max(s) FILTER (WHERE dim = 'implemented') AS implemented, max(s) FILTER (WHERE dim = 'tested') AS tested, max(s) FILTER (WHERE dim = 'verified') AS verified, max(s) FILTER (WHERE dim = 'uat_coverage') AS uat_coverage, max(s) FILTER (WHERE dim = 'uat_verified') AS uat_verified
FROM (SELECT req_id, dim, round(sum(total) + 1e-9, 6) AS s FROM totals GROUP BY ALL) GROUP BY req_id""")
def coverage_summary_node(e: Estate) -> DataFrame:
    g = cov.with_total(measures_of(e)).groupBy("req_id").pivot("dim", list(cov.DIMENSIONS)).agg(r6(F.sum("total")))
    return g


@query("""SELECT level, status, count(*) AS requirements, false AS excluded FROM population GROUP BY ALL
UNION ALL SELECT 'total', NULL, count(*), false FROM population
UNION ALL SELECT NULL, status, count(*), true FROM requirements WHERE id NOT IN (SELECT id FROM population) GROUP BY status""")
def collect_coverage(e: Estate) -> DataFrame:
    ruled = cov.role("status", e.statuses, e.requirements)
    kept = ruled.where("expects_implementation")
    count = F.count("*").alias("requirements")
    out = kept.groupBy("level", "status").agg(count).withColumn("excluded", F.lit(False))
    out = out.unionByName(kept.agg(count).select(F.lit("total").alias("level"), F.lit(None).cast("string").alias("status"), "requirements", F.lit(False).alias("excluded")))
    gone = ruled.where("not expects_implementation").groupBy("status").agg(count)
    return out.unionByName(gone.select(F.lit(None).cast("string").alias("level"), "status", "requirements", F.lit(True).alias("excluded")))


@query("SELECT level, count(*) FILTER (WHERE coalesce(expects_implementation, true)) AS active, count(*) AS every FROM requirements LEFT JOIN statuses ON lower(status) = status_key GROUP BY level")
def count_by_level(e: Estate) -> DataFrame:
    return cov.role("status", e.statuses, e.requirements).groupBy("level").agg(F.count_if("expects_implementation").alias("active"), F.count("*").alias("every"))


@query("SELECT repo, count(*) FILTER (WHERE coalesce(role, 'active') = 'active') AS active, count(*) AS every FROM requirements LEFT JOIN statuses ON lower(status) = status_key GROUP BY repo")
def count_by_repo(e: Estate) -> DataFrame:
    return cov.role("status", e.statuses, e.requirements).groupBy(F.coalesce("repo", F.lit("CORE")).alias("repo")).agg(F.count_if(F.col("role") == "active").alias("active"), F.count("*").alias("every"))


@query("SELECT count(*) FILTER (WHERE t >= n - 1e-9) AS full, count(*) FILTER (WHERE t < n - 1e-9 AND t > 1e-9) AS partial, count(*) FILTER (WHERE t <= 1e-9) AS none FROM (SELECT req_id, sum(total) AS t, count(*) AS n FROM totals WHERE dim = 'implemented' GROUP BY req_id)")
def count_by_coverage(e: Estate) -> DataFrame:
    g = cov.with_total(measures_of(e, "implemented")).groupBy("req_id").agg(F.sum("total").alias("t"), F.count("*").alias("n"))
    full, none = F.col("t") >= F.col("n") - cov.EPS, F.col("t") <= cov.EPS
    return g.agg(F.count_if(full).alias("full"), F.count_if(~full & ~none).alias("partial"), F.count_if(none).alias("none"))


@query("SELECT count(*) AS total, count(s.req_id) AS with_code, round(100.0 * count(s.req_id) / count(*), 1) AS pct FROM population LEFT JOIN (SELECT DISTINCT req_id FROM implements) s ON id = s.req_id")
def count_with_code_refs(e: Estate) -> DataFrame:
    coded = e.implements.select(F.col("req_id").alias("id"), F.lit(1).alias("coded")).distinct()
    df = population_of(e).join(coded, "id", "left")
    return df.agg(F.count("*").alias("total"), F.count("coded").alias("with_code"), F.round(100.0 * F.count("coded") / F.count("*"), 1).alias("pct"))


@query("SELECT count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, round(100.0 * count(*) FILTER (WHERE status = 'passed') / count(*), 1) AS pass_rate FROM results")
def test_results_summary(e: Estate) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return e.results.agg(n("passed").alias("passed"), n("failed").alias("failed"), n("skipped").alias("skipped"), F.round(100.0 * F.try_divide(n("passed"), F.count("*")), 1).alias("pass_rate"))


@query("SELECT test_id, CASE WHEN failed THEN 'failed' WHEN passed THEN 'passed' END AS verdict FROM test_verdicts")
def evidence_result(e: Estate) -> DataFrame:
    return cov.verdicts(e.results).select("test_id", F.when(F.col("failed"), "failed").when(F.col("passed"), "passed").alias("verdict"))


@query("SELECT r.repo, coalesce(bool_or(t.failed), false) AS red FROM verifies v JOIN test_verdicts t ON source_id = test_id JOIN requirements r ON v.req_id = r.id GROUP BY r.repo")
def app_status(e: Estate) -> DataFrame:
    ran = e.verifies.select("req_id", F.col("source_id").alias("test_id")).join(cov.verdicts(e.results), "test_id")
    return ran.join(e.requirements.select(F.col("id").alias("req_id"), "repo"), "req_id").groupBy("repo").agg(F.coalesce(F.bool_or("failed"), F.lit(False)).alias("red"))
