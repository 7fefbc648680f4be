"""Integrity checks: semi and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import coverage as cov
from tracewell.plans.estate import Estate, line_label
from tracewell.plans.registry import query


@query("SELECT id FROM requirements WHERE id NOT IN (SELECT req_id FROM assertions)")
def no_assertions_check(e: Estate) -> DataFrame:
    return e.requirements.select("id").join(e.assertions.select(F.col("req_id").alias("id")), "id", "left_anti")


@query("SELECT 'P' || p_partkey AS id FROM part WHERE 'P' || p_partkey NOT IN (SELECT source_id FROM implements)")
def orphaned_nodes(e: Estate) -> DataFrame:
    code = e.table("part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("id"))
    return code.join(e.implements.select(F.col("source_id").alias("id")), "id", "left_anti")


@query("SELECT p_brand AS file, count(*) AS unlinked FROM part WHERE 'P' || p_partkey NOT IN (SELECT source_id FROM implements) GROUP BY p_brand")
def unlinked_by_file(e: Estate) -> DataFrame:
    code = e.table("part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("id"), F.col("p_brand").alias("file"))
    return code.join(e.implements.select(F.col("source_id").alias("id")), "id", "left_anti").groupBy("file").agg(F.count("*").alias("unlinked"))


@query("SELECT DISTINCT p_brand AS file FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part JOIN implements ON source_id = 'P' || p_partkey WHERE label IS NOT NULL AND p_size > 45)")
def unmarked_files(e: Estate) -> DataFrame:
    code = e.table("part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("source_id"), F.col("p_brand").alias("file"), "p_size")
    marked = code.where("p_size > 45").join(e.implements.where("label is not null"), "source_id", "left_semi").select("file")
    return code.select("file").distinct().join(marked, "file", "left_anti")


@query("SELECT DISTINCT test_id FROM tests WHERE test_id NOT IN (SELECT source_id FROM verifies JOIN requirements ON req_id = id JOIN statuses ON lower(status) = status_key WHERE role = 'active')")
def unlinked_tests(e: Estate) -> DataFrame:
    active = cov.role("status", e.statuses, e.requirements).where("role = 'active'").select(F.col("id").alias("req_id"))
    linked = e.verifies.join(active, "req_id", "left_semi").select(F.col("source_id").alias("test_id"))
    return e.tests.select("test_id").distinct().join(linked, "test_id", "left_anti")


@query("SELECT CASE WHEN failed THEN 'failed' WHEN passed THEN 'passed' ELSE 'awaiting' END AS verdict, count(*) AS tests FROM test_verdicts WHERE test_id NOT IN (SELECT source_id FROM verifies JOIN requirements ON req_id = id JOIN statuses ON lower(status) = status_key WHERE role = 'active') GROUP BY 1")
def external_tests(e: Estate) -> DataFrame:
    loose = unlinked_tests(e).join(cov.verdicts(e.results), "test_id")
    verdict = F.when(F.col("failed"), "failed").when(F.col("passed"), "passed").otherwise("awaiting")
    return loose.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("tests"))


@query("SELECT id, list_sort(list(part)) AS places FROM (SELECT 'O' || l_orderkey || '-' || chr(64 + l_linenumber) AS id, l_partkey AS part FROM lineitem) GROUP BY id HAVING count(*) > 1")
def duplicate_ids(e: Estate) -> DataFrame:
    rows = e.table("lineitem").select(F.concat(F.lit("O"), F.col("l_orderkey"), F.lit("-"), line_label()).alias("id"), F.col("l_partkey").alias("part"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_list("part")).alias("places")).where("size(places) > 1")


@query("SELECT id, repo <> 'AFRICA' AS associate FROM requirements")
def associate_owned(e: Estate) -> DataFrame:
    return e.requirements.select("id", (F.col("repo") != "AFRICA").alias("associate"))


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' ELSE 'extra' END AS state FROM (SELECT id FROM requirements WHERE id LIKE 'C%') a FULL JOIN (SELECT 'C' || (c_custkey + 5) AS id FROM customer) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def index_current(e: Estate) -> DataFrame:
    live = e.requirements.where(F.col("id").startswith("C")).select("id", F.lit(True).alias("live"))
    listed = e.table("customer").select(F.concat(F.lit("C"), (F.col("c_custkey") + 5).cast("string")).alias("id"), F.lit(True).alias("listed"))
    both = live.join(listed, "id", "full").where("live is null or listed is null")
    return both.select("id", F.when(F.col("listed").isNull(), "missing").otherwise("extra").alias("state"))


@query("""SELECT id, rule FROM (SELECT id, 'no_assertions' AS rule FROM requirements WHERE id NOT IN (SELECT req_id FROM assertions)
UNION ALL SELECT id, 'status_not_allowed' FROM requirements WHERE status NOT IN ('Active', 'Draft', 'Roadmap')
UNION ALL SELECT id, 'labels_unique' FROM (SELECT 'O' || l_orderkey AS id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) GROUP BY id
UNION ALL SELECT req_id, 'labels_sequential' FROM (SELECT req_id, ascii(label) - 64 AS n, row_number() OVER (PARTITION BY req_id ORDER BY label) AS rn FROM assertions) WHERE n <> rn GROUP BY req_id)""")
def format_rules(e: Estate) -> DataFrame:
    """Facts per requirement in one row, the rules as an array over them."""
    lines = e.table("lineitem").groupBy(F.concat(F.lit("O"), F.col("l_orderkey")).alias("id"), F.col("l_linenumber").alias("n")).agg(F.count("*").alias("c"))
    upper = e.assertions.where(~F.col("req_id").startswith("O")).select(F.col("req_id").alias("id"), (F.ascii("label") - 64).alias("n"), F.lit(1).cast("long").alias("c"))
    facts = lines.unionByName(upper).groupBy("id").agg(F.count("*").alias("labels"), F.max("n").alias("top"), F.max("c").alias("most"))
    df = e.requirements.select("id", "status").join(facts, "id", "full")
    known = F.col("status").isNotNull()
    rules = {"no_assertions": F.col("labels").isNull(), "status_not_allowed": known & ~F.col("status").isin("Active", "Draft", "Roadmap"), "labels_unique": F.col("most") > 1, "labels_sequential": F.col("labels") != F.col("top")}
    hit = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]), lambda r: r.isNotNull())
    return df.select("id", F.explode(hit).alias("rule"))


@query("SELECT count(*) AS errors FROM requirements WHERE status NOT IN ('Active', 'Draft', 'Roadmap') OR id NOT IN (SELECT req_id FROM assertions)")
def format_errors(e: Estate) -> DataFrame:
    bad = e.requirements.where(~F.col("status").isin("Active", "Draft", "Roadmap")).select("id").unionByName(no_assertions_check(e)).distinct()
    return bad.agg(F.count("*").alias("errors"))


@query("""SELECT name, passed, findings FROM (SELECT 'no_assertions' AS name, count(*) = 0 AS passed, count(*) AS findings FROM requirements WHERE id NOT IN (SELECT req_id FROM assertions)
UNION ALL SELECT 'duplicate_ids', count(*) = 0, count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'failing_tests', count(*) = 0, count(*) FROM test_verdicts WHERE failed)""")
def health_report(e: Estate) -> DataFrame:
    def check(name: str, df: DataFrame) -> DataFrame:
        n = F.count("*")
        return df.agg(n.alias("findings")).select(F.lit(name).alias("name"), (F.col("findings") == 0).alias("passed"), "findings")

    out = check("no_assertions", no_assertions_check(e)).unionByName(check("duplicate_ids", e.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c")).where("c > 1")))
    return out.unionByName(check("failing_tests", cov.verdicts(e.results).where("failed")))


@query("SELECT id FROM requirements WHERE id IN (SELECT req_id FROM validates)")
def associate_integrations_skip(e: Estate) -> DataFrame:
    return e.requirements.select("id").join(e.validates.select(F.col("req_id").alias("id")), "id", "left_semi")


@query("SELECT min(l_shipdate) < max(o_orderdate) AS stale FROM lineitem, (SELECT max(o_orderdate) AS o_orderdate FROM orders)")
def results_stale(e: Estate) -> DataFrame:
    a = e.table("lineitem").agg(F.min("l_shipdate").alias("a"))
    b = e.table("orders").agg(F.max("o_orderdate").alias("b"))
    return a.crossJoin(F.broadcast(b)).select((F.col("a") < F.col("b")).alias("stale"))
