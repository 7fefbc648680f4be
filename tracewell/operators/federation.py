"""Templates and integrations: nodes that stand for others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def instantiated(satisfies: DataFrame, requirements: DataFrame, assertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """satisfies(declaring, template) -> clones (id, template, declaring) and their
    assertions (id, label), named declaring::template."""
    there = satisfies.distinct().join(requirements.select(F.col("id").alias("template")), "template", "left_semi")
    clones = there.select(F.concat_ws("::", "declaring", "template").alias("id"), "template", "declaring")
    labels = clones.join(assertions.select(F.col("req_id").alias("template"), "label"), "template").select("id", "label")
    return clones, labels


def instantiated_across(links: DataFrame, requirements: DataFrame, assertions: DataFrame, claimed: list[str]) -> DataFrame:
    """links(declaring, repo, target), requirements(repo, id, template boolean),
    assertions(req_id, label), first letters that some repository claims -> declaring,
    repo, target, template, template_repo, class, clone, label.

    A target that another repository owns, as written or in capitals, is cloned into the
    declaring repository when it is a template: one row for the clone, declaring::template,
    and one for each of its assertions, declaring::template-label. Others keep one row and
    a class: local (the own repository's, cloned there), not_template, unknown_requirement
    (claimed, but no repository has it), unknown_namespace (claimed by none, so presumed
    foreign). Of several owners the first other repository by name counts."""
    tries = F.array_distinct(F.array("target", F.upper("target")))
    wanted = links.select("declaring", "repo", "target").distinct()
    c = wanted.select("*", F.posexplode(tries).alias("at", "id"))
    r = requirements.select("id", F.col("repo").alias("template_repo"), "template")
    found = c.join(r, "id").groupBy("declaring", "repo", "target").agg(F.min(F.struct(F.col("at"), (F.col("template_repo") == F.col("repo")).alias("own"), "template_repo", "id", "template")).alias("f"))
    met = wanted.join(found, ["declaring", "repo", "target"], "left")
    missing = F.when(F.left("target", F.lit(1)).isin(*claimed), "unknown_requirement").otherwise("unknown_namespace")
    fault = F.when(F.col("f").isNull(), missing).when(F.col("f.own"), "local").when(~F.coalesce("f.template", F.lit(False)), "not_template")
    met = met.select("declaring", "repo", "target", F.col("f.id").alias("template"), "f.template_repo", fault.alias("class"))
    clone = F.concat_ws("::", "declaring", "template")
    roots = met.withColumns({"clone": F.when(F.col("class").isNull(), clone), "label": F.lit(None).cast("string")})
    own = met.where("class is null").join(assertions.select(F.col("req_id").alias("template"), "label"), "template")
    return roots.unionByName(own.withColumn("clone", F.concat_ws("-", clone, "label")).select(*roots.columns))


def integrated(links: DataFrame, requirements: DataFrame, claimed: list[str]) -> DataFrame:
    """links(consumer, repo, target) -> adds bound (the id tried first that exists)
    and class: forbidden within one repo, unknown_requirement in a claimed
    namespace, unknown_namespace elsewhere. Candidates are the target, then the
    target without its last -segment."""
    tries = F.array_distinct(F.array("target", F.regexp_replace("target", r"-[^-]*$", "")))
    c = links.select("consumer", "repo", "target", F.posexplode(tries).alias("at", "candidate"))
    r = requirements.select(F.col("id").alias("candidate"), F.col("repo").alias("owner"))
    hit = c.join(r, "candidate", "left")
    best = hit.groupBy("consumer", "repo", "target").agg(F.min_by(F.struct("candidate", "owner"), F.when(F.col("owner").isNotNull(), F.col("at"))).alias("b"))
    fault = F.when(F.col("b.owner") == F.col("repo"), "forbidden").when(F.col("b.owner").isNull(), F.when(F.substring("target", 1, 1).isin(*claimed), "unknown_requirement").otherwise("unknown_namespace"))
    return best.select("consumer", "repo", "target", F.when(F.col("b.owner").isNotNull(), F.col("b.candidate")).alias("bound"), fault.alias("class"))


def deepest_dir(paths: DataFrame, dirs: DataFrame) -> DataFrame:
    """paths(path), dirs(dir) -> path, dir: the directory found deepest as whole
    segments of the path; of equally deep ones the longer name. Every run of
    segments of a path is a key of an equi join, so no nested loop is needed."""
    seg = F.split("path", "/")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(seg)), lambda i: F.transform(F.sequence(i, F.size(seg)), lambda j: F.struct(i.alias("at"), F.array_join(F.slice(seg, i, j - i + 1), "/").alias("dir")))))
    keys = paths.distinct().select("path", F.inline(runs))
    hit = keys.join(dirs.distinct(), "dir")
    return hit.groupBy("path").agg(F.max_by("dir", F.struct("at", F.length("dir"))).alias("dir"))


def expanded(refs: DataFrame, holders: DataFrame) -> DataFrame:
    """refs(source_id, repo, target such as ID-A+B), holders(repo, req_id, label) ->
    source_id, target, owner, req_id, label, class: references of two or more labels,
    one row for each. The owner is the first other repository by name that holds one of
    them; a label that it lacks is an unknown_assertion. References of fewer labels, or of
    which no repository holds any, give no rows: they keep the class they have."""
    cut = F.regexp_extract("target", r"^(.*)-([^-]*)$", 1)
    labels = F.array_distinct(F.split(F.regexp_extract("target", r"^(.*)-([^-]*)$", 2), r"\+"))
    # What is dealt by requirement is made distinct, grouped and joined where it lies: equal references name equal requirements.
    dealt = refs.select("source_id", "repo", "target", cut.alias("req_id")).where(F.size(labels) > 1).repartition("req_id")
    wanted = dealt.distinct().withColumn("labels", labels)
    held = holders.groupBy("req_id").agg(F.collect_set(F.struct(F.col("repo").alias("holder"), "label")).alias("held"))
    met = wanted.join(held.hint("merge"), "req_id")
    named = F.filter("held", lambda h: (h["holder"] != F.col("repo")) & F.array_contains("labels", h["label"]))
    owned = met.withColumn("owner", F.array_min(F.transform(named, lambda h: h["holder"]))).where("owner is not null")
    own = F.transform(F.filter("held", lambda h: h["holder"] == F.col("owner")), lambda h: h["label"])
    by_label = owned.select("source_id", "target", "owner", "req_id", own.alias("own"), F.explode("labels").alias("label"))
    # A label of null is held by nobody.
    fault = F.when(~F.coalesce(F.array_contains("own", F.col("label")), F.lit(False)), "unknown_assertion")
    return by_label.select("source_id", "target", "owner", "req_id", "label", fault.alias("class"))


def templates_to_review(clones: DataFrame, hashes: DataFrame) -> DataFrame:
    """clones(id, template, declaring), hashes(id, stored, current) -> declaring, template,
    stored: who satisfies a template whose text isn't that of its stored hash. Hashes are
    compared without case; a template without a stored hash isn't stale."""
    stale = hashes.where(F.lower("stored") != F.lower("current")).select(F.col("id").alias("template"), "stored")
    return clones.select("template", "declaring").distinct().join(stale, "template").select("declaring", "template", "stored")


def united(tables: list[DataFrame]) -> DataFrame:
    """Node tables of federated repositories, each with repo, id and columns of its own ->
    one table of all columns, null where a table lacks one, with owner (the first
    repository by name that has the id; that of a null repo comes last) and contested (other
    repositories have it too). Columns of one name must be of one type."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    own = every.groupBy("id").agg(F.min("repo").alias("owner"), (F.count_distinct("repo") > 1).alias("contested"))
    return every.join(own, "id")
