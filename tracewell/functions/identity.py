"""Identities of tests, references and comments as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def test_id(classname: Column, name: Column) -> Column:
    """a.b.TestC + test_d[p] -> a/b.py::TestC::test_d. Parts that start with a
    capital are classes, the others the path."""
    parts = F.split(classname, r"\.")
    path = F.array_join(F.filter(parts, lambda p: ~p.rlike("^[A-Z]")), "/")
    classes = F.filter(parts, lambda p: p.rlike("^[A-Z]"))
    bare = F.regexp_replace(name, r"\[.*$", "")
    return F.array_join(F.concat(F.array(F.concat(path, F.lit(".py"))), classes, F.array(bare)), "::")


def test_id_from_nodeid(nodeid: Column) -> Column:
    return F.regexp_replace(nodeid, r"\[.*$", "")


def run_context(context: Column) -> Column:
    """The test of a `nodeid|run` context; null for others."""
    return F.nullif(F.regexp_extract(context, r"^(.*)\|run$", 1), F.lit(""))


def form_defects(raw: Column, resolved: Column) -> Column:
    """WRONG_PADDING where only leading zeros differ, WRONG_CASE where only case does."""
    bare = lambda c: F.regexp_replace(c, r"(^|[^0-9])0+([0-9])", "$1$2")
    padding = F.when((raw != resolved) & (F.lower(bare(raw)) == F.lower(bare(resolved))) & (F.lower(raw) != F.lower(resolved)), "WRONG_PADDING")
    case = F.when((bare(raw) != bare(resolved)) & (F.lower(bare(raw)) == F.lower(bare(resolved))), "WRONG_CASE")
    return F.filter(F.array(padding, case), lambda x: x.isNotNull())


def out_of_range(item: Column, digits: int) -> Column:
    return F.coalesce(F.regexp_extract(item, r"([0-9]+)$", 1).try_cast("long") >= 10**digits, F.lit(False))


def underscored(name: Column, pattern: str = r"(?i)(?:^|_)([a-z][0-9]+(?:_[a-z])?)(?:_|$)") -> Column:
    """The identifier inside a test's name, in capitals with a hyphen: test_o12_a_works -> O12-A."""
    return F.nullif(F.upper(F.replace(F.regexp_extract(name, pattern, 1), F.lit("_"), F.lit("-"))), F.lit(""))


def repaired(item: Column, valid: str) -> Column:
    """The one repair of separators that makes an item valid; null where none or
    several do."""
    tries = F.array(
        F.struct(F.lit("underscore").alias("code"), F.replace(item, F.lit("_"), F.lit("-")).alias("text")),
        F.struct(F.lit("space").alias("code"), F.replace(item, F.lit(" "), F.lit("-")).alias("text")),
        F.struct(F.lit("doubled").alias("code"), F.regexp_replace(item, "-+", "-").alias("text")),
    )
    good = F.filter(tries, lambda t: (t["text"] != item) & t["text"].rlike(valid))
    return F.when(~item.rlike(valid) & (F.size(good) == 1), good[0]["code"])
