"""Binding results to tests, and what kind of thing an unread reference is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = r"[A-Z][0-9]+/[0-9]+"
#: How closely a result names its tests, closest first.
SCOPES = ("step", "line", "root_line", "file")
#: Characters that no identifier holds, beside blanks.
RESERVED = r"[\s,;:#]"


def step_of(name: Column, pattern: str = STEP) -> Column:
    """The one step id in a result's name; null for none or several."""
    found = F.array_distinct(F.regexp_extract_all(name, F.lit(f"({pattern})"), 1))
    return F.when(F.size(found) == 1, found[0])


def _place(scope: str, file: Column, at: Column) -> Column:
    return F.when(file.isNotNull() & at.isNotNull(), F.struct(F.lit(SCOPES.index(scope)).alias("rank"), file.alias("at_file"), F.concat(F.lit("s " if scope == "step" else "l "), at.cast("string")).alias("at")))


def step_matches(results: DataFrame, tests: DataFrame) -> DataFrame:
    """results(result_id, name, file), tests(test_id, file, step) -> result_id, test_id:
    the tests of the one step that the result's name holds, in the result's file."""
    own = results.select("result_id", "file", step_of(F.col("name")).alias("step")).where("step is not null")
    return own.join(tests.select("test_id", "file", "step"), ["file", "step"]).select("result_id", "test_id").distinct()


def source_matches(results: DataFrame, tests: DataFrame) -> DataFrame:
    """results(result_id, name, file, line, root_file, root_line), tests(test_id, file,
    line, step) -> result_id, test_id, match_scope: the tests of the closest scope that
    has any; a result without a place, or in a file without tests, has none. Results
    are told by their ids; repeated rows count once.

    Scopes are settled against the distinct places of the tests, so that a result meets
    the tests of one scope only. A result has one best place and a test stands there
    once, so what comes out is distinct as it is."""
    no_place = F.when(F.col("file").isNotNull(), F.struct(F.lit(len(SCOPES) - 1).alias("rank"), F.col("file").alias("at_file"), F.lit("").alias("at")))
    wanted = F.array_compact(F.array(_place("step", F.col("file"), step_of(F.col("name"))), _place("line", F.col("file"), F.col("line")), _place("root_line", F.col("root_file"), F.col("root_line")), no_place))
    held = F.array_compact(F.array(_place("step", F.col("file"), F.col("step")), _place("line", F.col("file"), F.col("line")), no_place))
    places = tests.select("test_id", F.inline(held)).drop("rank").distinct()
    asked = results.select("result_id", F.inline(wanted)).join(places.select("at_file", "at").distinct(), ["at_file", "at"], "left_semi")
    best = asked.groupBy("result_id").agg(F.min(F.struct("rank", "at_file", "at")).alias("b")).select("result_id", "b.*")
    scope = F.element_at(F.array(*map(F.lit, SCOPES)), F.col("rank") + 1)
    return best.join(places, ["at_file", "at"]).select("result_id", "test_id", scope.alias("match_scope"))


def unmatched(item: Column, namespaces: Sequence[str], digits: int) -> Column:
    """struct(class, code) of an item that reads as no reference: a character that no
    identifier holds; else, under the longest namespace that it opens with, what is wrong
    with the rest; else a name from outside."""
    fault = lambda kind, code=None: F.struct(F.lit(kind).alias("class"), F.lit(code).cast("string").alias("code"))
    out = F.when(item.rlike(RESERVED), fault("malformed", "not_an_identifier"))
    for ns in sorted(namespaces, key=lambda n: (-len(n), n)):
        rest = F.substring(item, len(ns) + 1, 1 << 20)
        inside = F.when(rest.rlike(f"^[0-9]{{{digits + 1},}}$"), fault("malformed", "component_out_of_range"))
        inside = inside.when(rest.rlike(r"^[0-9]+(_|--)[A-Z]$"), fault("malformed", "separator"))
        inside = inside.when(rest.rlike(r"^[0-9]+-[^A-Z]"), fault("malformed", "label_form"))
        inside = inside.when(rest.rlike(r"^[0-9]+."), fault("malformed", "identifier_with_trailing_text")).otherwise(fault("malformed", "not_read"))
        out = out.when(item.startswith(ns) & rest.rlike("^[0-9]"), inside)
    return out.otherwise(fault("unknown_namespace"))


def display_info(path: Column, prefix: Column) -> Column:
    """struct(is_roadmap, file_name, stem, repo_prefix) of a requirement's file; no path: empty names."""
    name = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    return F.struct(F.contains(F.lower(F.coalesce(path, F.lit(""))), F.lit("roadmap")).alias("is_roadmap"), name.alias("file_name"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"), F.coalesce(F.nullif(prefix, F.lit("")), F.lit("CORE")).alias("repo_prefix"))
