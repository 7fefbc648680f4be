"""Queries that bind results to tests, take in results, and classify unread items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import matching as m
from tracewell.plans.estate import Estate
from tracewell.plans.registry import query
from tracewell.sources.results import normalized_results

_PLACED = """placed_tests AS (SELECT DISTINCT 'T' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS test_id, 'tests/p' || l_partkey || '.py' AS file, l_linenumber AS line, CASE WHEN l_orderkey % 2 = 0 THEN 'J' || (l_suppkey % 50) || '/' || l_linenumber END AS step FROM lineitem WHERE l_returnflag = 'A'),
placed_results AS (SELECT DISTINCT 'R' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS result_id, 'walks J' || (l_suppkey % 50) || '/' || l_linenumber || CASE WHEN l_orderkey % 3 = 0 THEN ' then J1/1' ELSE '' END AS name, 'tests/p' || l_partkey || '.py' AS file, CASE WHEN l_suppkey % 5 <> 0 THEN l_linenumber + l_suppkey % 3 END AS line, 'tests/p' || (l_partkey + 1) || '.py' AS root_file, CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey % 10 END AS root_line FROM lineitem WHERE l_returnflag <> 'A'),
step_named AS (SELECT *, list_distinct(regexp_extract_all(name, 'J[0-9]+/[0-9]+')) AS found FROM placed_results),
by_step AS (SELECT DISTINCT result_id, test_id FROM step_named r JOIN placed_tests t ON t.file = r.file AND t.step = found[1] WHERE len(found) = 1)"""


# Rows may repeat: the matching operators count them once.
def _tests(e: Estate) -> DataFrame:
    step = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("J"), F.col("l_suppkey") % 50, F.lit("/"), "l_linenumber"))
    return e.table("lineitem").where("l_returnflag = 'A'").select(F.concat(F.lit("T"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")).alias("test_id"), F.format_string("tests/p%d.py", "l_partkey").alias("file"), F.col("l_linenumber").alias("line"), step.alias("step"))


def _results(e: Estate) -> DataFrame:
    name = F.concat(F.lit("walks J"), F.col("l_suppkey") % 50, F.lit("/"), "l_linenumber", F.when(F.col("l_orderkey") % 3 == 0, " then J1/1").otherwise(""))
    line = F.when(F.col("l_suppkey") % 5 != 0, F.col("l_linenumber") + F.col("l_suppkey") % 3)
    root = F.when(F.col("l_orderkey") % 2 == 0, F.col("l_suppkey") % 10)
    return e.table("lineitem").where("l_returnflag <> 'A'").select(F.concat(F.lit("R"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")).alias("result_id"), name.alias("name"), F.format_string("tests/p%d.py", "l_partkey").alias("file"), line.alias("line"), F.format_string("tests/p%d.py", F.col("l_partkey") + 1).alias("root_file"), root.alias("root_line"))


@query("SELECT result_id, test_id FROM by_step", tables=_PLACED)
def result_step_match(e: Estate) -> DataFrame:
    return m.step_matches(_results(e), _tests(e))


@query("""SELECT result_id, test_id, 'step' AS match_scope FROM by_step UNION ALL SELECT result_id, test_id, 'line' FROM by_line UNION ALL SELECT result_id, test_id, 'root_line' FROM by_root
UNION ALL SELECT DISTINCT r.result_id, test_id, 'file' FROM placed_results r JOIN placed_tests t ON t.file = r.file WHERE r.result_id NOT IN (SELECT result_id FROM by_step UNION SELECT result_id FROM by_line UNION SELECT result_id FROM by_root)""", tables=_PLACED + """,
by_line AS (SELECT DISTINCT r.result_id, test_id FROM placed_results r JOIN placed_tests t ON t.file = r.file AND t.line = r.line WHERE r.result_id NOT IN (SELECT result_id FROM by_step)),
by_root AS (SELECT DISTINCT r.result_id, test_id FROM placed_results r JOIN placed_tests t ON t.file = r.root_file AND t.line = r.root_line WHERE r.result_id NOT IN (SELECT result_id FROM by_step UNION SELECT result_id FROM by_line))""")
def result_source_match(e: Estate) -> DataFrame:
    return m.source_matches(_results(e), _tests(e))


@query("SELECT result_id, file, line + 1 AS line, 'unit' AS target, 'source' AS match, true AS carried FROM placed_results", tables=_PLACED)
def ingest_target_results(e: Estate) -> DataFrame:
    """Results under an absolute root with lines from 0, taken in as results of one target."""
    raw = _results(e).distinct().select("result_id", F.concat(F.lit("/srv/a.b/"), "file").alias("file"), "line")
    return normalized_results(raw, "unit", "source", "/srv/a.b/", line_base=0, carried=True)


@query("SELECT id, status = 'Roadmap' AS is_roadmap, replace(lower(title), '.', '') || '.md' AS file_name, replace(lower(title), '.', '') AS stem, CASE WHEN repo = 'ASIA' THEN 'CORE' ELSE repo END AS repo_prefix FROM requirements")
def roadmap_display(e: Estate) -> DataFrame:
    path = F.concat_ws("/", F.lit("spec"), "status", F.concat(F.replace(F.lower("title"), F.lit("."), F.lit("")), F.lit(".md")))
    return e.requirements.select("id", m.display_info(path, F.when(F.col("repo") != "ASIA", F.col("repo"))).alias("d")).select("id", "d.*")


@query("""SELECT DISTINCT item, CASE WHEN item LIKE '%#%' OR item LIKE '% %' THEN 'malformed' WHEN left(item, 1) = 'P' THEN 'malformed' ELSE 'unknown_namespace' END AS class,
CASE WHEN item LIKE '%#%' OR item LIKE '% %' THEN 'not_an_identifier' WHEN left(item, 1) = 'P' AND instr(item, '_') = 0 THEN 'component_out_of_range' WHEN left(item, 1) = 'P' THEN 'separator' END AS code
FROM (SELECT c_name AS item FROM customer UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT 'P' || lpad(p_partkey::VARCHAR, 9, '0') FROM part UNION ALL SELECT 'PP' || p_partkey || '_A' FROM part)""")
def classify_unmatched(e: Estate) -> DataFrame:
    items = e.table("customer").select(F.col("c_name").alias("item")).unionByName(e.table("orders").select(F.col("o_orderpriority").alias("item")))
    part = e.table("part").select(F.explode(F.array(F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")), F.concat(F.lit("PP"), "p_partkey", F.lit("_A")))).alias("item"))
    items = items.unionByName(part).distinct()
    return items.select("item", m.unmatched(F.col("item"), ["P", "PP"], 6).alias("f")).select("item", "f.class", "f.code")
