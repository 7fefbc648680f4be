"""Set operations, selections and point queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import windows as win
from tracewell.plans.estate import Estate
from tracewell.plans.registry import query

_TERMS = """all_terms AS (SELECT item_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS term, text AS definition FROM benchmark),
old_terms AS (SELECT lower(term) AS k, min_by(term, item_id) AS term, sha256(min_by(definition, item_id)) AS h FROM all_terms WHERE item_id % 3 <> 0 GROUP BY 1),
new_terms AS (SELECT lower(term) AS k, min_by(term, item_id) AS term, sha256(min_by(definition || CASE WHEN item_id % 5 = 0 THEN '!' ELSE '' END, item_id)) AS h FROM all_terms WHERE item_id % 4 <> 0 GROUP BY 1)"""


def terms(e: Estate) -> DataFrame:
    w = F.split("text", " ", 3)
    return e.table("benchmark").select("item_id", F.concat_ws(" ", w[0], F.coalesce(F.get(w, 1), F.lit(""))).alias("term"), F.col("text").alias("definition"))


def first_definitions(df: DataFrame) -> DataFrame:
    return win.latest(df.withColumn("k", F.lower("term")), ["k"], F.col("item_id"))


@query("SELECT coalesce(o.k, n.k) AS term_key, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old_terms o FULL JOIN new_terms n ON o.k = n.k WHERE o.h IS DISTINCT FROM n.h", tables=_TERMS)
def diff_terms(e: Estate) -> DataFrame:
    old = first_definitions(terms(e).where("item_id % 3 <> 0")).select("k", F.sha2("definition", 256).alias("old"))
    edited = F.when(F.col("item_id") % 5 == 0, F.concat("definition", F.lit("!"))).otherwise(F.col("definition"))
    new = first_definitions(terms(e).where("item_id % 4 <> 0")).select("k", F.sha2(edited, 256).alias("new"))
    both = old.join(new, "k", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(F.col("k").alias("term_key"), F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


@query("SELECT lower(term) AS term_key, min(item_id) AS item_id, count(*) - 1 AS duplicates FROM all_terms GROUP BY 1", tables=_TERMS)
def merge_terms(e: Estate) -> DataFrame:
    return terms(e).groupBy(F.lower("term").alias("term_key")).agg(F.min("item_id").alias("item_id"), (F.count("*") - 1).alias("duplicates"))


@query("SELECT lower(term) AS term_key, item_id FROM all_terms QUALIFY row_number() OVER (PARTITION BY lower(term) ORDER BY item_id) > 1", tables=_TERMS)
def terms_duplicates(e: Estate) -> DataFrame:
    from pyspark.sql.window import Window

    k = F.lower("term")
    return terms(e).withColumn("rn", F.row_number().over(Window.partitionBy(k).orderBy("item_id"))).where("rn > 1").select(k.alias("term_key"), "item_id")


@query("SELECT item_id, term FROM all_terms WHERE length(trim(definition)) < 60", tables=_TERMS)
def terms_bad_definition(e: Estate) -> DataFrame:
    return terms(e).where(F.length(F.trim("definition")) < 60).select("item_id", "term")


@query("SELECT lower(left(term, 1)) AS letter, count(*) AS terms, min(lower(term)) AS first_term FROM all_terms GROUP BY 1", tables=_TERMS)
def glossary(e: Estate) -> DataFrame:
    return terms(e).groupBy(F.lower(F.left("term", F.lit(1))).alias("letter")).agg(F.count("*").alias("terms"), F.min(F.lower("term")).alias("first_term"))


@query("SELECT item_id, term, left(definition, 120) AS preview FROM all_terms", tables=_TERMS)
def term_list(e: Estate) -> DataFrame:
    return terms(e).select("item_id", "term", F.left("definition", F.lit(120)).alias("preview"))


@query("SELECT kind, count(*) AS nodes FROM (SELECT 'requirement' AS kind, id FROM requirements UNION ALL SELECT 'assertion', req_id || '-' || label FROM assertions UNION ALL SELECT 'test', test_id FROM (SELECT DISTINCT test_id FROM tests) UNION ALL SELECT 'code', 'P' || p_partkey FROM part UNION ALL SELECT 'journey', 'J' || conv_id FROM (SELECT DISTINCT conv_id FROM conversations)) GROUP BY kind")
def nodes_by_kind(e: Estate) -> DataFrame:
    of = lambda kind, df: df.agg(F.count("*").alias("nodes")).select(F.lit(kind).alias("kind"), "nodes")
    out = of("requirement", e.requirements).unionByName(of("assertion", e.assertions)).unionByName(of("test", e.tests.select("test_id").distinct()))
    return out.unionByName(of("code", e.table("part"))).unionByName(of("journey", e.table("conversations").select("conv_id").distinct()))


@query("SELECT id, level, status, title FROM requirements WHERE id = 'C7'")
def find_by_id(e: Estate) -> DataFrame:
    return e.requirements.where("id = 'C7'").select("id", "level", "status", "title")


@query("SELECT src AS id, dst AS child FROM refines")
def iter_children(e: Estate) -> DataFrame:
    return e.refines.select(F.col("src").alias("id"), F.col("dst").alias("child"))


@query("SELECT DISTINCT dst AS id, src AS parent FROM refines")
def iter_parents(e: Estate) -> DataFrame:
    return e.refines.select(F.col("dst").alias("id"), F.col("src").alias("parent")).distinct()


_EDGES = "edges AS (SELECT src, dst, 'refines' AS kind FROM refines UNION ALL SELECT req_id, source_id, 'implements' FROM implements UNION ALL SELECT req_id, source_id, 'verifies' FROM verifies UNION ALL SELECT req_id, source_id, 'validates' FROM validates)"


def edges(e: Estate) -> DataFrame:
    own = lambda df, kind: df.select(F.col("req_id").alias("src"), F.col("source_id").alias("dst"), F.lit(kind).alias("kind"))
    out = e.refines.select("src", "dst", F.lit("refines").alias("kind"))
    return out.unionByName(own(e.implements, "implements")).unionByName(own(e.verifies, "verifies")).unionByName(own(e.validates, "validates"))


@query("SELECT kind, count(*) AS edges FROM edges GROUP BY kind", tables=_EDGES)
def edges_by_kind(e: Estate) -> DataFrame:
    return edges(e).groupBy("kind").agg(F.count("*").alias("edges"))


@query("SELECT src, count(*) AS evidence FROM edges WHERE kind IN ('implements', 'verifies', 'validates') GROUP BY src", tables=_EDGES)
def evidence_edges(e: Estate) -> DataFrame:
    return edges(e).where(F.col("kind").isin("implements", "verifies", "validates", "integrates")).groupBy("src").agg(F.count("*").alias("evidence"))


@query("SELECT src, dst FROM edges WHERE kind = 'refines'", tables=_EDGES)
def conducting_edges(e: Estate) -> DataFrame:
    return edges(e).where("kind = 'refines'").select("src", "dst")


@query("SELECT id, level, status FROM requirements WHERE level = 'DEV' AND upper(status) = 'ACTIVE' AND id LIKE 'C%'")
def query_nodes(e: Estate) -> DataFrame:
    return e.requirements.where((F.col("level") == "DEV") & (F.upper("status") == "ACTIVE") & F.col("id").startswith("C")).select("id", "level", "status")


@query("SELECT id, title FROM requirements WHERE regexp_matches(title, '(?i)nation_1')")
def regex_search(e: Estate) -> DataFrame:
    return e.requirements.where(F.col("title").rlike("(?i)nation_1")).select("id", "title")


@query("SELECT DISTINCT status FROM requirements")
def distinct_values(e: Estate) -> DataFrame:
    return e.requirements.select("status").distinct()


@query("SELECT level, coalesce(max(try_cast(substr(id, 2) AS BIGINT)), 0) + 1 AS next_number, lpad(((max(try_cast(substr(id, 2) AS BIGINT)) + 1))::VARCHAR, 6, '0') AS next_id FROM requirements GROUP BY level")
def next_requirement_id(e: Estate) -> DataFrame:
    n = F.max(F.substring("id", 2, 20).try_cast("long")) + 1
    return e.requirements.groupBy("level").agg(F.coalesce(n, F.lit(1).cast("long")).alias("next_number"), F.lpad(n.cast("string"), 6, "0").alias("next_id"))


@query("SELECT repo, level, count(*) AS requirements, min(id) AS first_id, max(id) AS last_id FROM requirements GROUP BY ALL")
def requirement_index(e: Estate) -> DataFrame:
    return e.requirements.groupBy("repo", "level").agg(F.count("*").alias("requirements"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SELECT (SELECT count(*) FROM requirements) AS requirements, (SELECT count(*) FROM assertions) AS assertions, (SELECT count(DISTINCT test_id) FROM results) AS tests, (SELECT count(*) FROM results WHERE status = 'passed') AS passed, (SELECT count(*) FROM results WHERE status = 'failed') AS failed")
def view_stats(e: Estate) -> DataFrame:
    one = lambda df, *a: F.broadcast(df.agg(*a))
    n = F.count("*")
    out = one(e.requirements, n.alias("requirements")).crossJoin(one(e.assertions, n.alias("assertions")))
    return out.crossJoin(one(e.results, F.countDistinct("test_id").alias("tests"), F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed")))
