"""References that documents make, resolved against the estate, and other joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import references as ref
from tracewell.plans.estate import Estate
from tracewell.plans.registry import query
from tracewell.plans.windowed import _LINES, code_lines

NAMESPACES = ["R", "N", "C", "O"]

REFS = """doc_refs AS (SELECT doc_id, array_to_string(list_filter(['O' || (doc_id % 20000) || '-A+C', ' O' || (doc_id * 7 % 20000), CASE WHEN doc_id % 5 = 0 THEN 'not a reference' END, CASE WHEN doc_id % 7 = 0 THEN '' END, CASE WHEN doc_id % 11 = 0 THEN 'O' || (doc_id * 7 % 20000) END, CASE WHEN doc_id % 13 = 0 THEN 'WIDGET-42' END, CASE WHEN doc_id % 3 = 0 THEN 'C' || (doc_id % 2000) || '-B' END], lambda x: x IS NOT NULL), ',') AS refs FROM documents),
cut AS (SELECT doc_id, unnest(string_split(refs, ',')) AS part, generate_subscripts(string_split(refs, ','), 1) - 1 AS item_index, len(string_split(refs, ',')) AS n FROM doc_refs),
judged AS (SELECT doc_id, item_index, trim(part) AS raw, n, CASE WHEN trim(part) = '' THEN 'malformed' WHEN regexp_matches(trim(part), '\\s') THEN 'malformed' WHEN NOT regexp_matches(trim(part), '^[A-Z][0-9]+(-[A-Z](\\+[A-Z])*)?$') AND trim(part)[1] IN ('R', 'N', 'C', 'O') THEN 'malformed' WHEN trim(part)[1] NOT IN ('R', 'N', 'C', 'O') OR NOT regexp_matches(trim(part), '^[A-Z][0-9]+(-[A-Z](\\+[A-Z])*)?$') THEN 'unknown_namespace' END AS fault FROM cut),
items AS (SELECT doc_id, item_index, raw, CASE WHEN fault IS NULL AND count(*) OVER (PARTITION BY doc_id, raw) > 1 THEN 'forbidden' ELSE fault END AS class,
  CASE WHEN fault IS NULL AND count(*) OVER (PARTITION BY doc_id, raw) > 1 THEN 'duplicate' WHEN raw = '' AND item_index = n - 1 AND n > 1 THEN 'trailing_separator' WHEN raw = '' THEN 'empty_item' WHEN regexp_matches(raw, '\\s') THEN 'not_an_identifier' WHEN fault = 'malformed' THEN 'label_form' END AS code FROM judged),
bases AS (SELECT *, regexp_extract(raw, '^([A-Z][0-9]+)', 1) AS base, string_split(nullif(regexp_extract(raw, '-([A-Z+]+)$', 1), ''), '+') AS ls FROM items),
expanded AS (SELECT doc_id, item_index, raw, class, code, base, unnest(CASE WHEN ls IS NULL THEN [NULL] ELSE ls END) AS label FROM bases),
resolved AS (SELECT e.doc_id, e.item_index, e.raw, e.base, e.label, e.code, coalesce(e.class, CASE WHEN r.id IS NULL THEN 'unknown_requirement' WHEN e.label IS NOT NULL AND a.label IS NULL THEN 'unknown_assertion' END) AS class FROM expanded e LEFT JOIN requirements r ON r.id = e.base LEFT JOIN (SELECT DISTINCT req_id, label FROM assertions) a ON a.req_id = e.base AND a.label = e.label)"""


def doc_refs(e: Estate) -> DataFrame:
    d = F.col("doc_id")
    o = lambda k: F.concat(F.lit("O"), (k % 20000).cast("string"))
    made = F.array(F.concat(o(d), F.lit("-A+C")), F.concat(F.lit(" "), o(d * 7)), F.when(d % 5 == 0, "not a reference"), F.when(d % 7 == 0, ""), F.when(d % 11 == 0, o(d * 7)), F.when(d % 13 == 0, "WIDGET-42"), F.when(d % 3 == 0, F.concat(F.lit("C"), (d % 2000).cast("string"), F.lit("-B"))))
    return e.table("documents").select("doc_id", F.array_join(F.filter(made, lambda x: x.isNotNull()), ",").alias("refs"))


def items_of(e: Estate) -> DataFrame:
    return ref.items(doc_refs(e), "refs", NAMESPACES, "doc_id")


def resolved_of(e: Estate) -> DataFrame:
    return ref.resolved(ref.expanded(items_of(e)), e.requirements, e.assertions)


@query("SELECT doc_id, item_index, raw, class, code FROM items", tables=REFS)
def parse_ref_list(e: Estate) -> DataFrame:
    return items_of(e)


@query("SELECT doc_id, item_index, base, label FROM expanded WHERE class IS NULL", tables=REFS)
def expand_multi_assertion(e: Estate) -> DataFrame:
    return ref.expanded(items_of(e).where("class is null")).select("doc_id", "item_index", "base", "label")


@query("SELECT base AS src, 'D' || doc_id AS dst, label FROM resolved WHERE class IS NULL", tables=REFS)
def resolve_references(e: Estate) -> DataFrame:
    ok = resolved_of(e).where("class is null")
    return ok.select(F.col("base").alias("src"), F.concat(F.lit("D"), F.col("doc_id")).alias("dst"), "label")


@query("SELECT doc_id, item_index, label, class FROM resolved WHERE class IN ('unknown_requirement', 'unknown_assertion')", tables=REFS)
def classify_unresolved(e: Estate) -> DataFrame:
    return resolved_of(e).where(F.col("class").isin("unknown_requirement", "unknown_assertion")).select("doc_id", "item_index", "label", "class")


@query("SELECT doc_id, item_index, raw, label, class, code FROM resolved WHERE class IS NOT NULL", tables=REFS)
def fault_verdict(e: Estate) -> DataFrame:
    return resolved_of(e).where("class is not null").select("doc_id", "item_index", "raw", "label", "class", "code")


@query("SELECT doc_id, count(*) AS faults FROM resolved WHERE class IS NOT NULL GROUP BY doc_id", tables=REFS)
def broken_references(e: Estate) -> DataFrame:
    return resolved_of(e).where("class is not null").groupBy("doc_id").agg(F.count("*").alias("faults"))


@query("SELECT class, CASE class WHEN 'malformed' THEN 0 WHEN 'unknown_namespace' THEN 1 WHEN 'unknown_requirement' THEN 2 WHEN 'unknown_assertion' THEN 3 ELSE 4 END AS stage, count(*) AS faults FROM resolved WHERE class IS NOT NULL GROUP BY class", tables=REFS)
def reference_class_check(e: Estate) -> DataFrame:
    stage = F.array_position(F.array(*map(F.lit, ref.CLASSES)), F.col("class")) - 1
    return resolved_of(e).where("class is not null").groupBy("class", stage.cast("int").alias("stage")).agg(F.count("*").alias("faults"))


@query("SELECT raw, regexp_extract(raw, '^([A-Z][0-9]+)', 1) AS base, nullif(regexp_extract(raw, '-([A-Z+]+)$', 1), '') AS label FROM (SELECT DISTINCT raw FROM items WHERE class IS NULL)", tables=REFS)
def split_assertion_ref(e: Estate) -> DataFrame:
    raw = items_of(e).where("class is null").select("raw").distinct()
    return raw.select("raw", ref.split_ref(F.col("raw")).alias("s")).select("raw", "s.base", "s.label")


@query("SELECT DISTINCT doc_id, base FROM resolved WHERE class IS NOT DISTINCT FROM 'unknown_requirement'", tables=REFS)
def refs_resolve_implements(e: Estate) -> DataFrame:
    """Targets whose requirement does not exist, whatever the label."""
    read = ref.expanded(items_of(e).where("class is null")).select("doc_id", F.col("base"))
    return read.join(e.requirements.select(F.col("id").alias("base")), "base", "left_anti").distinct().select("doc_id", "base")


@query("SELECT doc_id, node, type, value, CASE WHEN r.id IS NULL THEN false WHEN type = 'assertion' THEN a.label IS NOT NULL ELSE true END AS valid FROM (SELECT doc_id, 'O' || (doc_id % 20000) AS node, CASE doc_id % 3 WHEN 0 THEN 'bare' WHEN 1 THEN 'assertion' ELSE 'section' END AS type, CASE doc_id % 3 WHEN 1 THEN 'B' WHEN 2 THEN 'Rationale' END AS value FROM documents) LEFT JOIN requirements r ON r.id = node LEFT JOIN (SELECT DISTINCT req_id, label FROM assertions) a ON a.req_id = node AND a.label = value")
def validate_anchor(e: Estate) -> DataFrame:
    anchor = F.concat(F.lit("O"), (F.col("doc_id") % 20000).cast("string"), F.when(F.col("doc_id") % 3 == 1, "#B").when(F.col("doc_id") % 3 == 2, "#section:Rationale").otherwise(""))
    parts = e.table("documents").select("doc_id", ref.anchor_parts(anchor).alias("p")).select("doc_id", "p.node", "p.type", "p.value")
    req = e.requirements.select(F.col("id").alias("node"), F.lit(True).alias("r"))
    lab = e.assertions.select(F.col("req_id").alias("node"), F.col("label").alias("value"), F.lit(True).alias("a")).distinct()
    df = parts.join(req, "node", "left").join(lab, ["node", "value"], "left")
    return df.select("doc_id", "node", "type", "value", F.when(F.col("r").isNull(), False).when(F.col("type") == "assertion", F.col("a").isNotNull()).otherwise(True).alias("valid"))


@query("SELECT v.req_id, v.source_id AS test_id, min(p.source_id) AS code_id FROM verifies v JOIN implements p ON p.req_id = v.req_id AND p.label IS NOT DISTINCT FROM v.label GROUP BY ALL")
def link_tests_to_code(e: Estate) -> DataFrame:
    code = e.implements.select("req_id", "label", F.col("source_id").alias("code_id"))
    same = e.verifies.withColumn("l", F.coalesce("label", F.lit(""))).join(code.withColumn("l", F.coalesce("label", F.lit(""))).drop("label"), ["req_id", "l"])
    return same.groupBy("req_id", F.col("source_id").alias("test_id")).agg(F.min("code_id").alias("code_id"))


@query("SELECT child.id AS child, child.repo AS repo, parent.id AS parent, parent.repo AS other FROM refines JOIN requirements child ON child.id = dst JOIN requirements parent ON parent.id = src WHERE child.repo <> parent.repo")
def wire_cross_repo(e: Estate) -> DataFrame:
    child = e.requirements.select(F.col("id").alias("dst"), "repo")
    parent = e.requirements.select(F.col("id").alias("src"), F.col("repo").alias("other"))
    both = e.refines.join(child, "dst").join(parent, "src").where("repo <> other")
    return both.select(F.col("dst").alias("child"), "repo", F.col("src").alias("parent"), "other")


@query("SELECT c.id AS child, c.level AS child_level, p.level AS parent_level FROM refines JOIN requirements c ON c.id = dst JOIN requirements p ON p.id = src WHERE NOT ((c.level = 'PRD' AND p.level = 'PRD') OR (c.level = 'OPS' AND p.level IN ('OPS', 'PRD')) OR (c.level = 'DEV' AND p.level IN ('DEV', 'OPS')))")
def hierarchy_levels(e: Estate) -> DataFrame:
    child = e.requirements.select(F.col("id").alias("dst"), F.col("level").alias("child_level"))
    parent = e.requirements.select(F.col("id").alias("src"), F.col("level").alias("parent_level"))
    allowed = F.broadcast(e.levels.select(F.col("level").alias("child_level"), "allowed_parents"))
    both = e.refines.join(child, "dst").join(parent, "src").join(allowed, "child_level")
    return both.where(~F.array_contains("allowed_parents", F.col("parent_level"))).select(F.col("dst").alias("child"), "child_level", "parent_level")


@query("SELECT s.role, count(*) AS edges FROM implements JOIN requirements ON id = req_id LEFT JOIN statuses s ON lower(status) = status_key WHERE s.role IN ('retired', 'provisional') GROUP BY s.role")
def status_reference_check(e: Estate) -> DataFrame:
    from tracewell.operators.coverage import role

    req = role("status", e.statuses, e.requirements).where(F.col("role").isin("retired", "provisional")).select(F.col("id").alias("req_id"), "role")
    return e.implements.join(req, "req_id").groupBy("role").agg(F.count("*").alias("edges"))


@query("SELECT status, coalesce(s.role, 'active') AS role, count(*) AS n FROM requirements LEFT JOIN statuses s ON lower(status) = status_key GROUP BY ALL")
def status_role(e: Estate) -> DataFrame:
    from tracewell.operators.coverage import role

    return role("status", e.statuses, e.requirements).groupBy("status", "role").agg(F.count("*").alias("n"))


@query("SELECT id, level FROM population")
def coverage_population(e: Estate) -> DataFrame:
    from tracewell.plans.coverage import population_of

    return population_of(e).select("id", "level")


@query("SELECT id FROM requirements LEFT JOIN statuses s ON lower(status) = status_key WHERE coalesce(s.role, 'active') NOT IN ('aspirational', 'retired')")
def analysis_population(e: Estate) -> DataFrame:
    from tracewell.operators.coverage import role

    return role("status", e.statuses, e.requirements).where(~F.col("role").isin("aspirational", "retired")).select("id")


@query("SELECT p_partkey, count(DISTINCT line) AS run_lines FROM part JOIN code_lines ON file = p_brand AND line BETWEEN p_partkey AND p_partkey + p_size AND hits > 40 GROUP BY p_partkey", tables=_LINES)
def line_context_join(e: Estate) -> DataFrame:
    ranges = e.table("part").select("p_partkey", F.col("p_brand").alias("file"), F.explode(F.sequence(F.col("p_partkey"), F.col("p_partkey") + F.col("p_size"))).alias("line"))
    return ranges.join(code_lines(e).where("hits > 40"), ["file", "line"], "left_semi").groupBy("p_partkey").agg(F.count("*").alias("run_lines"))
