"""Queries of scalar functions, terms and comments over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import identity as ident
from tracewell.functions import text as fn
from tracewell.operators import changes
from tracewell.operators import references as ref
from tracewell.operators import windows as win
from tracewell.plans.estate import Estate
from tracewell.plans.events import _LOG, log
from tracewell.plans.registry import query
from tracewell.plans.windowed import _LINES, code_lines


def _tests(e: Estate) -> DataFrame:
    k = F.col("p_partkey")
    return e.table("part").select("p_partkey", F.concat_ws(".", F.lit("tests"), F.regexp_replace("p_name", " ", "_"), F.concat(F.lit("Test"), F.initcap("p_type"))).alias("classname"), F.concat(F.lit("test_o"), k, F.when(k % 2 == 0, "_b").otherwise(""), F.lit("_works"), F.when(k % 3 == 0, "[case]").otherwise("")).alias("name"))


_TESTS = "named_tests AS (SELECT p_partkey, 'tests.' || replace(p_name, ' ', '_') || '.Test' || upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS classname, 'test_o' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '_b' ELSE '' END || '_works' || CASE WHEN p_partkey % 3 = 0 THEN '[case]' ELSE '' END AS name, p_name, p_type FROM part)"


@query("SELECT p_partkey, 'tests/' || replace(p_name, ' ', '_') || '.py::' || split_part(classname, '.', 3) || '::' || regexp_replace(name, '\\[.*$', '') AS test_id FROM named_tests", tables=_TESTS)
def test_id(e: Estate) -> DataFrame:
    return _tests(e).select("p_partkey", ident.test_id(F.col("classname"), F.col("name")).alias("test_id"))


@query("SELECT p_partkey, classname || '::' || regexp_replace(name, '\\[.*$', '') AS test_id FROM named_tests", tables=_TESTS)
def test_id_from_nodeid(e: Estate) -> DataFrame:
    return _tests(e).select("p_partkey", ident.test_id_from_nodeid(F.concat_ws("::", "classname", "name")).alias("test_id"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN name END AS test FROM named_tests", tables=_TESTS)
def run_context(e: Estate) -> DataFrame:
    context = F.concat_ws("|", "name", F.when(F.col("p_partkey") % 4 == 0, "setup").otherwise("run"))
    return _tests(e).select("p_partkey", ident.run_context(context).alias("test"))


@query("SELECT p_partkey, 'O' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '-B' ELSE '' END AS reference FROM named_tests", tables=_TESTS)
def underscored_ref(e: Estate) -> DataFrame:
    return _tests(e).select("p_partkey", ident.underscored(F.col("name")).alias("reference"))


@query("SELECT p_partkey, p_partkey >= 1000 AS out_of_range FROM part")
def component_out_of_range(e: Estate) -> DataFrame:
    return e.table("part").select("p_partkey", ident.out_of_range(F.concat(F.lit("P"), "p_partkey"), 3).alias("out_of_range"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['WRONG_PADDING'] WHEN 1 THEN ['WRONG_CASE'] WHEN 2 THEN ['WRONG_PADDING', 'WRONG_CASE'] ELSE [] END AS defects FROM part WHERE p_partkey > 0")
def identifier_form_defects(e: Estate) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("P00"), k)).when(k % 4 == 1, F.concat(F.lit("p"), k)).when(k % 4 == 2, F.concat(F.lit("p0"), k)).otherwise(F.concat(F.lit("P"), k))
    return e.table("part").where("p_partkey > 0").select("p_partkey", ident.form_defects(raw, F.concat(F.lit("P"), k)).alias("defects"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'underscore' WHEN 1 THEN 'space' WHEN 2 THEN 'doubled' END AS repair FROM part")
def diagnose_item(e: Estate) -> DataFrame:
    k = F.col("p_partkey")
    sep = F.when(k % 4 == 0, "_").when(k % 4 == 1, " ").when(k % 4 == 2, "--").otherwise("-")
    return e.table("part").select("p_partkey", ident.repaired(F.concat(F.lit("P"), k, sep, F.lit("A")), ref.ITEM).alias("repair"))


@query("SELECT conv_id, turn, 'J' || conv_id AS node, CASE turn % 3 WHEN 0 THEN 'bare' WHEN 1 THEN 'section' ELSE 'assertion' END AS type, CASE turn % 3 WHEN 1 THEN 'Goal' WHEN 2 THEN 'A' END AS value FROM conversations")
def parse_anchor(e: Estate) -> DataFrame:
    anchor = F.concat(F.lit("J"), "conv_id", F.when(F.col("turn") % 3 == 1, "#section:Goal").when(F.col("turn") % 3 == 2, "#A").otherwise(""))
    return e.table("conversations").select("conv_id", "turn", ref.anchor_parts(anchor).alias("p")).select("conv_id", "turn", "p.node", "p.type", "p.value")


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))) AS clean FROM documents")
def clean_body(e: Estate) -> DataFrame:
    text = F.concat("text", F.lit("\n## Changelog\n- old"))
    return e.table("documents").select("doc_id", F.sha2(fn.clean_body(text, collapse=True), 256).alias("clean"))


@query("SELECT conv_id, turn FROM conversations WHERE len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\-]+', ' ', 'g'), ' '), lambda w: w IN ('that', 'thonly', 'eren'))) > 0")
def assertions_by_keywords(e: Estate) -> DataFrame:
    wanted = F.array(*map(F.lit, ("thonly", "eren", "that")))
    return e.table("conversations").where(F.arrays_overlap(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\-]+", " "), " "), wanted)).select("conv_id", "turn")


@query("SELECT p_partkey, [lower(split_part(p_name, ' ', 1)), lower(split_part(p_name, ' ', 2))] AS words FROM part WHERE lower(split_part(p_name, ' ', 1)) <> lower(split_part(p_name, ' ', 2))")
def search_terms_from_name(e: Estate) -> DataFrame:
    name = F.concat(F.lit("test_"), F.regexp_replace(F.initcap("p_name"), " ", ""))
    words = F.split(fn.camel_to_snake(F.regexp_replace(name, "^test_", "")), "_")
    kept = F.array_distinct(F.filter(words, lambda w: ~w.isin(fn.STOPWORDS)))
    return e.table("part").select("p_partkey", kept.alias("words")).where("size(words) = 2")


@query("SELECT split_part(anchor, '#', 1) AS card, count(*) AS open_threads FROM (SELECT 'U' || key % 40 || CASE WHEN key % 2 = 0 THEN '#A' ELSE '' END AS anchor FROM threads WHERE open) GROUP BY 1", tables=_LOG)
def card_threads(e: Estate) -> DataFrame:
    anchor = F.concat(F.lit("U"), F.col("key") % 40, F.when(F.col("key") % 2 == 0, "#A").otherwise(""))
    return changes.threads(log(e)).where("open").groupBy(F.split_part(anchor, F.lit("#"), F.lit(1)).alias("card")).agg(F.count("*").alias("open_threads"))


@query("SELECT seq, CASE WHEN key = 7 THEN 'N700' ELSE 'N' || key END || CASE WHEN seq % 2 = 0 THEN '#A' ELSE '' END AS anchor FROM kinds WHERE event = 'comment'", tables=_LOG)
def anchor_rename(e: Estate) -> DataFrame:
    rows = log(e).where("event = 'comment'").select("seq", F.concat(F.lit("N"), "key", F.when(F.col("seq") % 2 == 0, "#A").otherwise("")).alias("anchor"))
    return rows.select("seq", F.regexp_replace("anchor", r"^N7(#|$)", r"N700$1").alias("anchor"))


@query("SELECT file, name, line, coalesce(lead(line) OVER (PARTITION BY file ORDER BY line) - 1, line + 50) AS end_line FROM (SELECT p_brand AS file, 'f' || p_partkey AS name, p_partkey AS line FROM part)")
def external_prescan(e: Estate) -> DataFrame:
    """A user's structure table; a missing end is the line before the next start."""
    t = e.table("part").select(F.col("p_brand").alias("file"), F.concat(F.lit("f"), "p_partkey").alias("name"), F.col("p_partkey").alias("line"))
    told = win.known(t, ["file"], "line", [F.col("line")], F.col("line"), "next", own=False, ahead=True)
    return told.select("file", "name", "line", F.coalesce(F.col("next") - 1, F.col("line") + 50).alias("end_line"))


@query("SELECT count(*) AS lines, count(DISTINCT file) AS files, count(*) FILTER (WHERE hits > 0) > 0 AS has_measurement FROM code_lines", tables=_LINES)
def line_coverage_check(e: Estate) -> DataFrame:
    per = code_lines(e).groupBy("file").agg(F.count("*").alias("n"), F.bool_or(F.col("hits") > 0).alias("m"))
    return per.agg(F.sum("n").alias("lines"), F.count("*").alias("files"), F.bool_or("m").alias("has_measurement"))


@query("SELECT id FROM requirements WHERE length(title) = 9 AND level = 'DEV'")
def find_predicate(e: Estate) -> DataFrame:
    """Nodes that any predicate, given as a Column, lets through."""
    return e.requirements.where((F.length("title") == 9) & (F.col("level") == "DEV")).select("id")


@query("SELECT source AS path FROM documents WHERE doc_id % 2 = 0 UNION SELECT source FROM documents WHERE doc_id % 3 = 0 UNION SELECT lang FROM documents")
def changed_files_union(e: Estate) -> DataFrame:
    d = e.table("documents")
    return d.where("doc_id % 2 = 0").select(F.col("source").alias("path")).union(d.where("doc_id % 3 = 0").select("source")).union(d.select("lang")).distinct()


@query("SELECT page_id FROM pages WHERE starts_with(url, 'https://') AND ends_with(url, '.html')")
def spec_file_filter(e: Estate) -> DataFrame:
    return e.table("pages").where(F.col("url").startswith("https://") & F.col("url").endswith(".html")).select("page_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Verifies' ELSE 'Implements' END AS keyword FROM part")
def keyword_for_path(e: Estate) -> DataFrame:
    path = F.concat(F.when(F.col("p_partkey") % 5 == 0, "tests/").otherwise("src/"), F.col("p_name"))
    return e.table("part").select("p_partkey", F.when(path.rlike(r"(^|/)tests?/"), "Verifies").otherwise("Implements").alias("keyword"))


@query("SELECT t.test_id, s.status FROM (SELECT DISTINCT test_id FROM tests) t JOIN (SELECT test_id, max(status) AS status FROM results GROUP BY test_id HAVING count(DISTINCT status) = 1) s USING (test_id)")
def load_results(e: Estate) -> DataFrame:
    """Result rows by test id; tests whose results disagree are left to the verdict."""
    r = e.results.groupBy("test_id").agg(F.max("status").alias("status"), F.min("status").alias("low")).where("status = low").drop("low")
    return e.tests.select("test_id").distinct().join(r, "test_id")
