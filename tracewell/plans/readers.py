"""Reader and sink queries: Spark writes the estate's records in each format and
the readers get them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from tracewell.functions.storage import shared_dir
from tracewell.operators import coverage as cov
from tracewell.plans.estate import Estate
from tracewell.plans.registry import query
from tracewell.plans.windowed import _LINES, code_lines
from tracewell.sources import results as src

_RUNS = "runs AS (SELECT l_orderkey AS k, test_id, l_suppkey AS line, l_quantity / 10 AS duration, CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'R' THEN 'failed' ELSE 'skipped' END AS status FROM tests)"


def runs(e: Estate) -> DataFrame:
    flag = F.col("l_returnflag")
    return e.tests.select(F.col("l_orderkey").alias("k"), "test_id", F.col("l_suppkey").alias("line"), (F.col("l_quantity") / 10).alias("duration"), F.when(flag == "A", "passed").when(flag == "R", "failed").otherwise("skipped").alias("status"))


def as_files(rows: DataFrame, key: str, item: Column, head: str, sep: str, tail: str) -> DataFrame:
    """One text per key. Keys are orders or files: groups of tens of rows."""
    g = rows.groupBy(F.col(key).cast("string").alias("path")).agg(F.array_join(F.sort_array(F.collect_list(item)), sep).alias("t"))
    return g.select("path", F.concat(F.lit(head), "t", F.lit(tail)).alias("text"))


@query("SELECT k::VARCHAR AS path, test_id AS name, line::INT AS line, status, round(duration + 1e-9, 6) AS duration, CASE status WHEN 'failed' THEN repeat('x', 200) WHEN 'skipped' THEN 'later' END AS message FROM runs", tables=_RUNS)
def read_junit(e: Estate) -> DataFrame:
    note = F.when(F.col("status") == "failed", F.concat(F.lit('<failure message="'), F.repeat(F.lit("x"), 250), F.lit('"/>'))).when(F.col("status") == "skipped", '<skipped message="later"/>').otherwise("")
    case = F.format_string('<testcase name="%s" classname="a.B" line="%d" time="%s">%s</testcase>', "test_id", "line", F.col("duration").cast("string"), note)
    df = as_files(runs(e), "k", case, '<testsuite name="s">', "", "</testsuite>")
    return src.read_junit(df).select("path", "name", "line", "status", F.round(F.col("duration") + 1e-9, 6).alias("duration"), "message")


@query("SELECT k::VARCHAR AS path, test_id AS nodeid, status, round(duration + 1e-9, 6) AS duration FROM runs", tables=_RUNS)
def read_pytest_json(e: Estate) -> DataFrame:
    outcome = F.when(F.col("status") == "skipped", "xfailed").when(F.col("line") % 2 == 0, F.col("status")).otherwise(F.when(F.col("status") == "passed", "xpassed").otherwise(F.col("status")))
    case = F.to_json(F.struct(F.col("test_id").alias("nodeid"), outcome.alias("outcome"), F.struct("duration").alias("call")))
    df = as_files(runs(e), "k", case, '{"tests":[', ",", "]}")
    return src.read_pytest_json(df).select("path", "nodeid", "status", F.round(F.col("duration") + 1e-9, 6).alias("duration"))


@query("SELECT k::VARCHAR AS path, 's' || k AS suite, test_id AS name, line::INT AS line, status FROM runs", tables=_RUNS)
def read_machine_events(e: Estate) -> DataFrame:
    r = runs(e).select("k", "test_id", "line", "status")
    path = F.col("k").cast("string").alias("path")
    # Every test has a number of its own; a hidden end beside it must be dropped.
    start = F.to_json(F.struct(F.lit("testStart").alias("type"), F.struct(F.col("n").alias("id"), F.col("test_id").alias("name"), F.col("k").alias("suiteID"), F.col("line").cast("int").alias("line")).alias("test")))
    done = F.to_json(F.struct(F.lit("testDone").alias("type"), F.col("n").alias("testID"), F.when(F.col("status") == "failed", "failure").otherwise("success").alias("result"), (F.col("status") == "skipped").alias("skipped"), F.lit(False).alias("hidden")))
    hidden = F.to_json(F.struct(F.lit("testDone").alias("type"), F.col("n").alias("testID"), F.lit("error").alias("result"), F.lit(True).alias("hidden")))
    numbered = r.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("test_id", "status")))
    lines = numbered.select(path, F.explode(F.array(start, done, hidden)).alias("text"))
    suites = r.select("k").distinct().select(path, F.to_json(F.struct(F.lit("suite").alias("type"), F.struct(F.col("k").alias("id"), F.concat(F.lit("s"), "k").alias("path")).alias("suite"))).alias("text"))
    return src.read_machine_events(lines.unionByName(suites))


@query("SELECT file, line::INT AS line, hits::INT AS hits FROM code_lines", tables=_LINES)
def read_lcov(e: Estate) -> DataFrame:
    lines = code_lines(e)
    df = as_files(lines, "file", F.format_string("DA:%d,%d", "line", "hits"), "TN:\n", "\n", "\nend_of_record")
    df = df.select("path", F.regexp_replace("text", "^TN:\n", F.concat(F.lit("TN:\nSF:"), "path", F.lit("\n"))).alias("text"))
    return src.read_lcov(df).select("file", "line", "hits")


@query("SELECT file, line::INT AS line, CASE WHEN hits > 0 THEN 1 ELSE 0 END::INT AS hits FROM code_lines", tables=_LINES)
def read_coverage_json(e: Estate) -> DataFrame:
    line = F.col("line").cast("int")
    g = code_lines(e).groupBy("file").agg(F.collect_list(F.when(F.col("hits") > 0, line)).alias("executed_lines"), F.collect_list(F.when(F.col("hits") <= 0, line)).alias("missing_lines"))
    text = F.to_json(F.struct(F.create_map("file", F.struct("executed_lines", "missing_lines")).alias("files")))
    return src.read_coverage_json(g.select(F.col("file").alias("path"), text.alias("text"))).select("file", "line", "hits")


@query("SELECT 'comment' AS event, event_id::VARCHAR AS id, 'R' || user_id AS anchor, '' AS parent FROM events")
def load_comment_events(e: Estate) -> DataFrame:
    row = F.to_json(F.struct(F.lit("comment").alias("event"), F.col("event_id").cast("string").alias("id"), F.concat(F.lit("R"), "user_id").alias("anchor")))
    lines = e.table("events").select(row.alias("text"))
    return src.read_comment_events(lines).select("event", "id", "anchor", "parent")


def spec_files(e: Estate) -> DataFrame:
    """Customers as requirement texts, one file per nation."""
    c = e.requirements.where(F.col("id").startswith("C")).join(e.table("customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), "c_nationkey"), "id")
    block = F.concat(F.lit("# "), "id", F.lit(": "), "title", F.lit("\n\n**Level**: "), "level", F.lit(" | **Status**: "), "status", F.lit("\n\n## Assertions\n\nA. The part "), "id", F.lit(" SHALL work\n   well.\n\nB. It SHALL last.\n\n*End* *x* | **Hash**: "), F.substring(F.sha2("id", 256), 1, 8))
    return as_files(c.withColumn("path", F.concat(F.lit("spec/n"), "c_nationkey", F.lit(".md"))), "path", block, "Preface\n", "\n\n---\n", "\n")


@query("SELECT 'spec/n' || c_nationkey || '.md' AS path, id, title, level, status, substr(sha256(id), 1, 8) AS hash FROM requirements JOIN customer ON id = 'C' || c_custkey")
def extract_requirements(e: Estate) -> DataFrame:
    return src.read_requirements(spec_files(e)).select("path", "id", "title", "level", "status", "hash")


@query("SELECT id, label, text FROM (SELECT id, 'A' AS label, 'The part ' || id || ' SHALL work well.' AS text FROM requirements WHERE id LIKE 'C%' UNION ALL SELECT id, 'B', 'It SHALL last.' FROM requirements WHERE id LIKE 'C%')")
def extract_assertions(e: Estate) -> DataFrame:
    return src.read_assertions(src.read_requirements(spec_files(e)))


@query("SELECT r.id, r.level, r.title AS label, r.status, coalesce(string_agg(src, ';' ORDER BY src), '') AS parents FROM requirements r LEFT JOIN (SELECT DISTINCT src, dst FROM refines) ON dst = r.id GROUP BY ALL")
def write_csv(e: Estate) -> DataFrame:
    """Written as CSV with a header, and read back."""
    parents = e.refines.groupBy(F.col("dst").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("src")), ";").alias("parents"))
    df = e.requirements.join(parents, "id", "left").select("id", "level", F.col("title").alias("label"), "status", F.coalesce("parents", F.lit("")).alias("parents"))
    path = f"{shared_dir(e.spark)}/trace-{uuid.uuid4().hex}"
    df.write.option("header", True).option("emptyValue", "").option("nullValue", "\\N").csv(path)
    return e.spark.read.schema(df.schema).option("header", True).option("emptyValue", "").option("nullValue", "\\N").csv(path).na.fill("", ["parents"])


@query("SELECT req_id AS id, round(sum(total) FILTER (WHERE dim = 'implemented') + 1e-9, 6) AS implemented, round(sum(total) FILTER (WHERE dim = 'tested') + 1e-9, 6) AS tested FROM totals GROUP BY req_id")
def write_trace_json(e: Estate) -> DataFrame:
    """The matrix with nested figures, written as JSON and read back."""
    from tracewell.plans.coverage import measures_of

    m = cov.with_total(measures_of(e, "implemented", "tested")).groupBy(F.col("req_id").alias("id")).pivot("dim", ["implemented", "tested"]).agg(F.round(F.sum("total") + 1e-9, 6))
    df = m.select("id", F.struct("implemented", "tested").alias("coverage"))
    path = f"{shared_dir(e.spark)}/trace-{uuid.uuid4().hex}"
    df.write.json(path)
    return e.spark.read.schema(df.schema).json(path).select("id", "coverage.implemented", "coverage.tested")


@query("""SELECT f AS file, count(*) AS lines, sum(length(line) + 1)::BIGINT AS n_chars, md5(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS digest
FROM (SELECT c_custkey // 500 AS f, c_name || ': ' || c_mktsegment AS line FROM customer WHERE c_custkey // 500 % 7 <> 6) GROUP BY f""")
def scan_corpus(e: Estate) -> DataFrame:
    """Texts of 500 customers each, written as files, and read as one row per file;
    files of the folders 6, 13, 20 and so on are skipped, and those of another name."""
    lines = e.table("customer").select(F.floor(F.col("c_custkey") / 500).alias("f"), F.concat("c_name", F.lit(": "), "c_mktsegment").alias("line"))
    base = f"{shared_dir(e.spark)}/corpus-{uuid.uuid4().hex}"
    lines.repartition("f").sortWithinPartitions("f", "line").withColumn("group", F.col("f") % 7).write.partitionBy("group", "f").text(base)
    found = src.files(e.spark, base, "*.txt", "/group=6/")
    text = F.col("text")
    return found.select(F.regexp_extract("path", r"/f=(\d+)/", 1).cast("long").alias("file"), F.regexp_count(text, F.lit("\n")).cast("long").alias("lines"), F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest"))
