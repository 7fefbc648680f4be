"""Further integrity checks, term checks, searches and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as fn
from tracewell.functions.storage import shared_dir
from tracewell.operators import closure as graph
from tracewell.operators import coverage as cov
from tracewell.plans.estate import Estate
from tracewell.plans.graphs import _UP, depth, fan_in, links, uncovered_dependents
from tracewell.plans.federated import _FOUND, git_state_join
from tracewell.plans.coverage import r6
from tracewell.plans.integrity import unmarked_files
from tracewell.plans.joins import REFS, items_of
from tracewell.plans.registry import query
from tracewell.plans.sets import terms
from tracewell.plans.windowed import _LINES, line_range_join

#: Keywords that each kind of file may use.
ALLOWED = {"code": ("Implements", "Verifies"), "test": ("Verifies",), "spec": ("Implements", "Refines"), "journey": ("Validates",)}


def _pick(key, *words):
    return F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int"))


@query("SELECT src, dst FROM refines WHERE src NOT IN (SELECT id FROM requirements) OR dst NOT IN (SELECT id FROM requirements)")
def refs_resolve_refines(e: Estate) -> DataFrame:
    ids = e.requirements.select("id")
    no_parent = e.refines.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst")
    no_child = e.refines.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
    return no_parent.unionByName(no_child.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst"))


@query("SELECT doc_id, kind, keyword FROM (SELECT doc_id, ['code', 'test', 'spec', 'journey'][doc_id % 4 + 1] AS kind, ['Implements', 'Verifies', 'Validates'][doc_id % 3 + 1] AS keyword FROM documents) WHERE (kind, keyword) NOT IN (('code', 'Implements'), ('code', 'Verifies'), ('test', 'Verifies'), ('spec', 'Implements'), ('spec', 'Refines'), ('journey', 'Validates'))")
def forbidden_keyword(e: Estate) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(w).alias("keyword")) for k, ws in ALLOWED.items() for w in ws])
    allowed = F.broadcast(e.spark.range(1).select(F.inline(rows)))
    d = F.col("doc_id")
    used = e.table("documents").select("doc_id", _pick(d, *ALLOWED).alias("kind"), _pick(d, "Implements", "Verifies", "Validates").alias("keyword"))
    return used.join(allowed, ["kind", "keyword"], "left_anti").select("doc_id", "kind", "keyword")


@query("SELECT doc_id, doc_id % 4 AS form FROM documents WHERE doc_id % 4 <> 0")
def keyword_form_check(e: Estate) -> DataFrame:
    """Keywords in other case, with space before the colon, or emphasised."""
    line = F.concat(_pick(F.col("doc_id"), "Implements:", "implements:", "Implements :", "**Implements:**"), F.lit(" O1"))
    return e.table("documents").where(line.rlike(r"(?i)implements\s*:") & ~line.rlike(r"^Implements: ")).select("doc_id", (F.col("doc_id") % 4).alias("form"))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 = 2")
def undeclared_check(e: Estate) -> DataFrame:
    line = F.concat(_pick(F.col("doc_id"), "Implements: O1", "see O1", "O1 works here", "", "note"), F.lit(" "))
    return e.table("documents").where(line.rlike(r"^[A-Z][0-9]+\b") & ~line.rlike(r"^(Implements|Verifies|Refines|Validates):")).select("doc_id")


@query("SELECT doc_id, 'o0' || doc_id AS raw FROM documents WHERE doc_id % 2 = 1")
def identifier_form_check(e: Estate) -> DataFrame:
    d = F.col("doc_id")
    raw = F.when(d % 2 == 1, F.concat(F.lit("o0"), d)).otherwise(F.concat(F.lit("O"), d))
    canonical = F.upper(F.regexp_replace(raw, r"^([A-Za-z])0+([0-9])", "$1$2"))
    return e.table("documents").select("doc_id", raw.alias("raw"), canonical.alias("c")).where("raw <> c").select("doc_id", "raw")


@query("SELECT doc_id, list_sort(list(DISTINCT code)) AS reasons FROM items WHERE code IN ('duplicate', 'trailing_separator', 'empty_item') GROUP BY doc_id", tables=REFS)
def needs_rewrite(e: Estate) -> DataFrame:
    dirty = items_of(e).where(F.col("code").isin("duplicate", "trailing_separator", "empty_item"))
    return dirty.groupBy("doc_id").agg(F.sort_array(F.collect_set("code")).alias("reasons"))


@query("SELECT DISTINCT p_brand AS file FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part JOIN implements ON source_id = 'P' || p_partkey WHERE label IS NOT NULL AND p_size > 45) AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1)")
def no_traceability(e: Estate) -> DataFrame:
    faulted = e.table("part").where("p_size = 1").select(F.col("p_brand").alias("file"))
    return unmarked_files(e).join(faulted, "file", "left_anti")


@query("SELECT 'P' || p_partkey AS id FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50)")
def structural_orphans(e: Estate) -> DataFrame:
    known = e.table("part").where("p_size = 50").select(F.col("p_brand").alias("file"))
    code = e.table("part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_brand").alias("file"))
    return code.join(known, "file", "left_anti").select("id")


@query("SELECT 'P' || p_partkey AS id FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) AND 'P' || p_partkey NOT IN (SELECT source_id FROM implements WHERE label IS NULL)")
def unlinked_nodes(e: Estate) -> DataFrame:
    known = e.table("part").where("p_size = 50").select(F.col("p_brand").alias("file"))
    code = e.table("part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_brand").alias("file"))
    linked = e.implements.where("label is null").select(F.col("source_id").alias("id"))
    return code.join(known, "file", "left_semi").join(linked, "id", "left_anti").select("id")


@query("SELECT sum(lines)::BIGINT AS lines, sum(covered)::BIGINT AS covered, count(*) AS nodes FROM (SELECT p_partkey, count(*) AS lines, count(*) FILTER (WHERE hits > 0) AS covered FROM part JOIN code_lines ON file = p_brand AND line BETWEEN p_partkey AND p_partkey + p_size GROUP BY p_partkey)", tables=_LINES)
def aggregate_line_coverage(e: Estate) -> DataFrame:
    return line_range_join(e).agg(F.sum("lines").alias("lines"), F.sum("covered").alias("covered"), F.count("*").alias("nodes"))


@query("SELECT title AS name, CASE WHEN bool_and(coalesce(role, 'active') = 'retired') THEN 'info' ELSE 'warning' END AS severity FROM requirements LEFT JOIN statuses ON lower(status) = status_key GROUP BY title")
def retired_downgrade(e: Estate) -> DataFrame:
    ruled = cov.role("status", e.statuses, e.requirements)
    return ruled.groupBy(F.col("title").alias("name")).agg(F.when(F.bool_and(F.col("role") == "retired"), "info").otherwise("warning").alias("severity"))


@query("SELECT topic, list_sort(list(DISTINCT p_partkey)) AS nodes FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS topic FROM part UNION ALL SELECT p_partkey, lower(p_type) FROM part) GROUP BY topic")
def topic_index(e: Estate) -> DataFrame:
    part = e.table("part")
    rows = part.select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("topic")).unionByName(part.select("p_partkey", F.lower("p_type").alias("topic")))
    return rows.groupBy("topic").agg(F.sort_array(F.collect_set("p_partkey")).alias("nodes"))


@query("SELECT p_brand AS file, min(d.depth) AS depth FROM part JOIN implements ON source_id = 'P' || p_partkey JOIN (SELECT seed, min(depth) AS depth FROM up JOIN requirements ON node = id WHERE level = 'PRD' GROUP BY seed) d ON d.seed = req_id GROUP BY p_brand", tables=_UP, recursive=True)
def files_by_depth(e: Estate) -> DataFrame:
    code = e.table("part").select(F.concat(F.lit("P"), "p_partkey").alias("source_id"), F.col("p_brand").alias("file"))
    at = depth(e).withColumnRenamed("id", "req_id")
    return e.implements.join(at, "req_id").join(code, "source_id").groupBy("file").agg(F.min("depth").alias("depth"))


@query("SELECT id FROM requirements WHERE id LIKE 'C%' AND id IN (SELECT 'C' || o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')")
def changed_requirements(e: Estate) -> DataFrame:
    return git_state_join(e).where("stat = 'branch'").select("id")


@query("SELECT id FROM requirements WHERE id LIKE 'C%' AND status = 'Active' AND id NOT IN (SELECT 'C' || o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def changelog_present(e: Estate) -> DataFrame:
    entries = e.table("orders").where(F.col("o_orderpriority").startswith("1")).select(F.concat(F.lit("C"), "o_custkey").alias("id"))
    return e.requirements.where(F.col("id").startswith("C") & (F.col("status") == "Active")).select("id").join(entries, "id", "left_anti")


@query("SELECT 'C' || o_custkey AS id, o_orderkey AS entry, 'author' AS field FROM orders WHERE o_totalprice < 50000")
def changelog_format(e: Estate) -> DataFrame:
    author = F.when(F.col("o_totalprice") < 50000, "-").otherwise("someone")
    fields = {"author": author, "reason": F.col("o_orderpriority")}
    gone = F.filter(F.array(*[F.when(F.coalesce(c, F.lit("-")) == "-", F.lit(n)) for n, c in fields.items()]), lambda x: x.isNotNull())
    return e.table("orders").select(F.concat(F.lit("C"), "o_custkey").alias("id"), F.col("o_orderkey").alias("entry"), F.explode(gone).alias("field"))


@query("SELECT r.id, coalesce(list_sort(list(a.label) FILTER (WHERE a.label IS NOT NULL)), []) AS labels FROM requirements r LEFT JOIN assertions a ON a.req_id = r.id GROUP BY r.id")
def granularity_shape(e: Estate) -> DataFrame:
    g = e.assertions.groupBy(F.col("req_id").alias("id")).agg(F.sort_array(F.collect_list("label")).alias("labels"))
    return e.requirements.select("id").join(g, "id", "left").select("id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


_HITS = _UP + ", hits AS (SELECT id FROM requirements WHERE contains(title, '1') AND id IN (SELECT seed FROM up WHERE node = 'R1'))"


def _hits(e: Estate) -> DataFrame:
    scope = graph.closure(links(e), e.requirements.where("id = 'R1'").select(F.col("id").alias("node"))).select(F.col("node").alias("id"))
    return e.requirements.where(F.contains("title", F.lit("1"))).join(scope, "id", "left_semi").select("id")


@query("SELECT id FROM hits WHERE id NOT IN (SELECT node FROM up JOIN hits ON seed = hits.id WHERE depth > 0)", tables=_HITS, recursive=True)
def discover_requirements(e: Estate) -> DataFrame:
    """Scoped search, then only the members that no other member descends from."""
    kept = graph.minimized(links(e), _hits(e).select(F.col("id").alias("node")))
    return kept.where("size(superseded_by) = 0").select(F.col("node").alias("id"))


@query("SELECT req_id, label, 50 + CASE WHEN label = 'A' THEN 10 ELSE 0 END AS score FROM assertions JOIN hits ON id = req_id", tables=_HITS, recursive=True)
def discover_assertions(e: Estate) -> DataFrame:
    own = F.when(F.col("label") == "A", 10).otherwise(0)
    return e.assertions.join(_hits(e).withColumnRenamed("id", "req_id"), "req_id").select("req_id", "label", (F.lit(50) + own).alias("score"))


@query("SELECT id, round(composite, 6) AS composite FROM comp", tables=_FOUND, recursive=True)
def foundations(e: Estate) -> DataFrame:
    keep = e.requirements.where(F.col("status").isin("Active", "Draft")).select("id")
    df = keep.join(fan_in(e), "id").join(uncovered_dependents(e), "id", "left").withColumn("uncovered", F.coalesce("uncovered", F.lit(0)))
    top = F.broadcast(df.agg(F.max("fan_in").alias("mf"), F.max("uncovered").alias("mu")))
    score = 0.5 * F.col("fan_in") / F.col("mf") + 0.5 * F.coalesce(F.try_divide("uncovered", "mu"), F.lit(0.0))
    return df.crossJoin(top).select("id", r6(score).alias("composite"))


@query("SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '([a-z]+)\\*\\*\\*', 1))) AS word FROM documents WHERE contains(text, '***')")
def terms_undefined(e: Estate) -> DataFrame:
    words = e.table("documents").where(F.contains("text", F.lit("***"))).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([a-z]+)\*\*\*"), F.lit(1))).alias("w"))
    return words.select("doc_id", F.lower("w").alias("word")).join(terms(e).select(F.lower("term").alias("word")), "word", "left_anti").distinct()


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'src/f' || p_partkey ELSE 'pkg/src/f' || p_partkey END AS resolved FROM part")
def coverage_path_resolve(e: Estate) -> DataFrame:
    """A coverage path as written if such a file is known, else below the package."""
    k = F.col("p_partkey")
    written = e.table("part").select("p_partkey", F.concat(F.lit("src/f"), k).alias("path"))
    known = e.table("part").select(F.concat(F.when(k % 3 == 0, "").otherwise("pkg/"), F.lit("src/f"), k).alias("file"))
    exact = known.select(F.col("file").alias("path"), F.col("file").alias("a"))
    below = known.select(F.regexp_replace("file", "^pkg/", "").alias("path"), F.col("file").alias("b"))
    return written.join(exact, "path", "left").join(below, "path", "left").select("p_partkey", F.coalesce("a", "b").alias("resolved"))


@query("SELECT level, status, count(*) AS n FROM requirements GROUP BY ALL")
def write_graph_json(e: Estate) -> DataFrame:
    """All nodes written as JSON by level, and counted from the files."""
    path = f"{shared_dir(e.spark)}/graph-{uuid.uuid4().hex}"
    e.requirements.write.partitionBy("level").json(path)
    return e.spark.read.schema(e.requirements.schema).json(path).groupBy("level", "status").agg(F.count("*").alias("n"))


@query("SELECT 'no_assertions' AS rule, 'error' AS level, id AS location FROM requirements WHERE id NOT IN (SELECT req_id FROM assertions)")
def write_findings(e: Estate) -> DataFrame:
    from tracewell.plans.integrity import no_assertions_check

    path = f"{shared_dir(e.spark)}/findings-{uuid.uuid4().hex}"
    rows = no_assertions_check(e).select(F.lit("no_assertions").alias("rule"), F.lit("error").alias("level"), F.col("id").alias("location"))
    rows.write.json(path)
    return e.spark.read.schema(rows.schema).json(path)


@query("SELECT conv_id, turn, len(list_filter(list_distinct(regexp_split_to_array(regexp_replace(lower(role || ' ' || text), '[^\\p{L}\\p{N}\\-]+', ' ', 'g'), ' ')), lambda w: w IN ('user', 'assistant'))) > 0 AS tagged FROM conversations")
def annotate_keywords(e: Estate) -> DataFrame:
    words = fn.keywords(F.concat_ws(" ", "role", "text"))
    return e.table("conversations").select("conv_id", "turn", F.arrays_overlap(words, F.array(F.lit("user"), F.lit("assistant"))).alias("tagged"))
