"""Readers of test results, coverage records, comment logs and requirement texts.

Each takes files as rows (path, text), as `files` reads them, or lines of text,
and gives typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_NOTE = "struct<_message:string,_VALUE:string>"
JUNIT = f"testcase array<struct<_name:string,_classname:string,_file:string,_line:string,_time:string,failure:{_NOTE},error:{_NOTE},skipped:{_NOTE}>>"
PYTEST = "tests array<struct<nodeid:string,outcome:string,duration:double,setup:struct<longrepr:string>,call:struct<duration:double,longrepr:string>,teardown:struct<longrepr:string>>>"
COVERAGE = "files map<string,struct<executed_lines:array<int>,missing_lines:array<int>>>"
MACHINE = "type string, suite struct<id:long,path:string>, test struct<id:long,name:string,suiteID:long,line:int>, testID long, result string, skipped boolean, hidden boolean"
COMMENT = "event string, id string, anchor string, author string, author_id string, date string, text string, parent string, target string"
#: Reporter name -> (kind, first line number).
REPORTERS = {"junit": ("results", 1), "pytest-json": ("results", 1), "machine": ("results", 1), "lcov": ("coverage", 1), "coverage-json": ("coverage", 1)}
MESSAGE = 200


def files(spark: SparkSession, folder: str, pattern: str = "*", skip: str | None = None) -> DataFrame:
    """path, text of every file below a folder whose name fits; skip is an
    expression on the path. A file is one row: keep single files within memory."""
    df = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    df = df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.where(~F.col("path").rlike(skip)) if skip else df


def read_junit(df: DataFrame) -> DataFrame:
    """path, name, classname, file, line, status, duration, message. Precedence
    failure, error, skipped, passed; a bad duration is 0."""
    rows = df.select("path", F.explode(F.from_xml("text", JUNIT)["testcase"]).alias("t"))
    note = lambda k: F.coalesce(F.col(f"t.{k}._message"), F.col(f"t.{k}._VALUE"), F.lit(""))
    has = lambda k: F.col(f"t.{k}").isNotNull()
    status = F.when(has("failure"), "failed").when(has("error"), "error").when(has("skipped"), "skipped").otherwise("passed")
    message = F.when(has("failure"), note("failure")).when(has("error"), note("error")).when(has("skipped"), note("skipped"))
    return rows.select("path", F.col("t._name").alias("name"), F.col("t._classname").alias("classname"), F.col("t._file").alias("file"), F.col("t._line").try_cast("int").alias("line"), status.alias("status"), F.coalesce(F.col("t._time").try_cast("double"), F.lit(0.0)).alias("duration"), F.left(message, F.lit(MESSAGE)).alias("message"))


def read_pytest_json(df: DataFrame) -> DataFrame:
    """path, nodeid, status, duration, message."""
    t = df.select("path", F.explode(F.from_json("text", PYTEST)["tests"]).alias("t"))
    words = F.create_map(*[F.lit(x) for kv in {"xfailed": "skipped", "xpassed": "passed"}.items() for x in kv])
    status = F.coalesce(F.try_element_at(words, F.col("t.outcome")), F.col("t.outcome"))
    message = F.coalesce("t.call.longrepr", "t.setup.longrepr", "t.teardown.longrepr")
    return t.select("path", F.col("t.nodeid").alias("nodeid"), status.alias("status"), F.coalesce("t.duration", "t.call.duration", F.lit(0.0)).alias("duration"), F.left(message, F.lit(MESSAGE)).alias("message"))


def read_machine_events(lines: DataFrame) -> DataFrame:
    """lines(path, text): one JSON event a line -> path, suite, name, line, status.
    Ends of tests meet their starts and suites by id; hidden ones are dropped."""
    e = lines.select("path", F.from_json("text", MACHINE).alias("e"))
    start = e.where("e.type = 'testStart'").select("path", F.col("e.test.id").alias("test"), F.col("e.test.name").alias("name"), F.col("e.test.suiteID").alias("suite_id"), F.col("e.test.line").alias("line"))
    suite = e.where("e.type = 'suite'").select("path", F.col("e.suite.id").alias("suite_id"), F.col("e.suite.path").alias("suite"))
    done = e.where("e.type = 'testDone' and not coalesce(e.hidden, false)").select("path", F.col("e.testID").alias("test"), F.when(F.col("e.skipped"), "skipped").when(F.col("e.result") == "success", "passed").otherwise("failed").alias("status"))
    return done.join(start, ["path", "test"]).join(suite, ["path", "suite_id"], "left").select("path", "suite", "name", "line", "status")


def read_lcov(df: DataFrame) -> DataFrame:
    """path, file, line, hits: data lines belong to the source line before them."""
    lines = df.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "row"))
    own = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    source = F.last(F.when(F.col("row").startswith("SF:"), F.substring("row", 4, 10_000)), ignorenulls=True).over(own)
    data = F.split(F.substring("row", 4, 10_000), ",")
    return lines.withColumn("file", source).where(F.col("row").startswith("DA:")).select("path", "file", F.get(data, 0).try_cast("int").alias("line"), F.get(data, 1).try_cast("int").alias("hits"))


def lcov_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path", "file").agg(F.count("*").alias("found"), F.count_if(F.col("hits") > 0).alias("hit"))


def read_coverage_json(df: DataFrame) -> DataFrame:
    """path, file, line, hits: 1 for executed lines, 0 for missing ones."""
    f = df.select("path", F.explode(F.from_json("text", COVERAGE)["files"]).alias("file", "c"))
    both = F.concat(F.transform("c.executed_lines", lambda x: F.struct(x.alias("line"), F.lit(1).alias("hits"))), F.transform("c.missing_lines", lambda x: F.struct(x.alias("line"), F.lit(0).alias("hits"))))
    return f.select("path", "file", F.inline(both))


def read_comment_events(lines: DataFrame) -> DataFrame:
    """JSON lines -> comment events; absent keys are empty."""
    return lines.select(F.from_json("text", COMMENT).alias("e")).select("e.*").na.fill("")


def read_requirements(df: DataFrame) -> DataFrame:
    """path, id, title, level, status, hash, body, line: blocks from a header line
    `# ID: title` to the next, with a line of level and status and a closing hash."""
    lines = df.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "row"))
    head = F.col("row").rlike(r"^#+ [A-Za-z][\w-]*\d+: ")
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("block", F.sum(head.cast("int")).over(w)).where("block > 0")
    pick = lambda pattern, n: F.max(F.nullif(F.regexp_extract("row", pattern, n), F.lit("")))
    g = rows.groupBy("path", "block").agg(
        pick(r"^#+ ([A-Za-z][\w-]*\d+): ", 1).alias("id"),
        pick(r"^#+ [A-Za-z][\w-]*\d+: (.*)$", 1).alias("title"),
        pick(r"\*\*Level\*\*: (\w+)", 1).alias("level"),
        pick(r"\*\*Status\*\*: (\w+)", 1).alias("status"),
        pick(r"\*\*Hash\*\*: (\w+)", 1).alias("hash"),
        F.sort_array(F.collect_list(F.struct("pos", "row"))).alias("rows"),
    )
    return g.select("path", "id", "title", "level", "status", "hash", F.array_join(F.transform("rows", lambda r: r["row"]), "\n").alias("body"), (F.col("rows")[0]["pos"] + 1).alias("line"))


def read_assertions(requirements: DataFrame) -> DataFrame:
    """id, label, text of the labelled lines in the Assertions section, with lines
    that go on joined."""
    section = F.regexp_extract("body", r"(?s)## Assertions\n(.*?)(?:\n#|\n\*End\*|$)", 1)
    rows = requirements.select("path", "id", F.posexplode(F.split(section, "\n")).alias("pos", "row"))
    w = Window.partitionBy("path", "id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    label = F.nullif(F.regexp_extract("row", r"^([A-Z])\. ", 1), F.lit(""))
    rows = rows.withColumn("n", F.count(label).over(w)).where("n > 0")
    g = rows.groupBy("path", "id", "n").agg(F.max(label).alias("label"), F.sort_array(F.collect_list(F.struct("pos", F.trim(F.regexp_replace("row", r"^[A-Z]\. ", "")).alias("t")))).alias("ts"))
    return g.select("id", "label", F.trim(F.array_join(F.filter(F.transform("ts", lambda t: t["t"]), lambda t: t != ""), " ")).alias("text"))


def normalized_results(df: DataFrame, target: str, match: str, root: str, line_base: int = 1, carried: bool = False) -> DataFrame:
    """Results of one target: lines from 1, paths below the root, and what they match."""
    file = F.regexp_replace("file", "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return df.withColumn("file", file).withColumn("line", F.col("line") + (1 - line_base)).withColumns({"target": F.lit(target), "match": F.lit(match), "carried": F.lit(carried)})
