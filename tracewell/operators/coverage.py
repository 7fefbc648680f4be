"""Evidence, credit and coverage measures.

Long tables throughout: one row per (requirement, label, dimension). Labels of
a requirement are known only to `assertions`; evidence that names no label
counts for every one of them, and indirectly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = ("implemented", "tested", "verified", "uat_coverage", "uat_verified")
#: A chained dimension is measured over the labels covered in the one before it.
DENOMINATOR = {"tested": "implemented", "verified": "tested", "uat_verified": "uat_coverage"}
EPS = 1e-9
FLAGS = ("verified_failing", "uat_failing")


def covered_enough(fraction: Column) -> Column:
    return fraction >= 1.0 - EPS


def credited(edges: DataFrame, assertions: DataFrame, named: str, blanket: str) -> DataFrame:
    """edges(req_id, source_id, label or null) -> req_id, label, source_id, source_type.

    Both cases meet the assertions in one equi join on the requirement."""
    a = assertions.select("req_id", F.col("label").alias("own"))
    hit = edges.join(a, "req_id").where(F.col("label").isNull() | (F.col("label") == F.col("own")))
    return hit.select("req_id", F.col("own").alias("label"), "source_id", F.when(F.col("label").isNull(), blanket).otherwise(named).alias("source_type")).distinct()


def contributions(implements: DataFrame, verifies: DataFrame, validates: DataFrame, assertions: DataFrame) -> DataFrame:
    out = credited(implements, assertions, "direct", "code_indirect")
    out = out.unionByName(credited(verifies, assertions, "test_direct", "test_indirect"))
    return out.unionByName(credited(validates, assertions, "uat_explicit", "uat_inferred"))


def verdicts(results: DataFrame) -> DataFrame:
    """test_id, passed, failed, carried (every signal carried)."""
    return results.groupBy("test_id").agg(F.bool_or(F.col("status") == "passed").alias("passed"), F.bool_or(F.col("status") == "failed").alias("failed"), F.bool_and("carried").alias("carried"))


def journey_verdicts(steps: DataFrame) -> DataFrame:
    """journey_id, steps, verified, failing: a step is verified with a pass and no fail."""
    by_step = steps.groupBy("journey_id", "step_id").agg(F.bool_or(F.col("status") == "passed").alias("p"), F.bool_or(F.col("status") == "failed").alias("f"))
    return by_step.groupBy("journey_id").agg(F.count("*").alias("steps"), F.count_if(F.col("p") & ~F.col("f")).alias("verified"), F.bool_or("f").alias("failing"))


def evidence(implements: DataFrame | None = None, verifies: DataFrame | None = None, validates: DataFrame | None = None, results: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """req_id, label or null, a credit for each dimension (null without evidence), and
    verified_failing, uat_failing, one row per source: the best of all counts. Tests never
    feed `implemented`; a journey gives its verified share. What isn't given isn't read."""
    one, none, no = F.lit(1.0), F.lit(None).cast("double"), F.lit(False)

    def rows(df: DataFrame, failing: dict | None = None, **credit) -> DataFrame:
        return df.select("req_id", "label", *[credit.get(d, none).cast("double").alias(d) for d in DIMENSIONS], *[(failing or {}).get(c, no).alias(c) for c in FLAGS])

    parts = []
    if implements is not None:
        parts.append(rows(implements, implemented=one))
    if verifies is not None:
        ran = verifies if results is None else verifies.join(verdicts(results).withColumnRenamed("test_id", "source_id").hint("merge"), "source_id", "left")
        verified = {} if results is None else {"verified": F.when(F.col("passed"), 1.0).when(F.col("passed").isNotNull(), 0.0), "failing": {"verified_failing": F.coalesce("failed", no)}}
        parts.append(rows(ran, tested=one, **verified))
    if validates is not None:
        walked = validates if steps is None else validates.join(journey_verdicts(steps).withColumnRenamed("journey_id", "source_id").hint("merge"), "source_id", "left")
        verified = {} if steps is None else {"uat_verified": F.col("verified") / F.col("steps"), "failing": {"uat_failing": F.coalesce(F.col("failing"), no)}}
        parts.append(rows(walked, uat_coverage=one, **verified))
    return reduce(DataFrame.unionByName, parts)


def immediate(assertions: DataFrame, found: DataFrame, *dims: str) -> DataFrame:
    """assertions(req_id, label), evidence -> one row per assertion with a column pair
    <dimension>_direct, <dimension>_indirect for each dimension, and the failing flags.
    Assertions and evidence are summed up by label together; what names no label is then
    read beside the requirement's labels, so nothing is joined. Repeated rows change nothing."""
    dims = dims or DIMENSIONS
    held = assertions.select("req_id", "label", F.lit(True).alias("held"))
    cited = found.where("req_id is not null").select("req_id", "label", F.lit(False).alias("held"), *dims, *FLAGS)
    every = held.unionByName(cited, allowMissingColumns=True)
    by_label = every.groupBy("req_id", "label").agg(F.max("held").alias("held"), *[F.max(c).alias(c) for c in (*dims, *FLAGS)])
    requirement, blanket = Window.partitionBy("req_id"), F.col("label").isNull()

    def named(c: str, default) -> Column:
        return F.coalesce(F.when(~blanket, F.col(c)), F.lit(default))

    def whole(c: str, default) -> Column:
        return F.coalesce(F.max(F.when(blanket, F.col(c))).over(requirement), F.lit(default))

    credit = [f(d, 0.0).alias(f"{d}_{c}") for d in dims for c, f in (("direct", named), ("indirect", whole))]
    return by_label.select("req_id", "label", "held", *credit, *[(named(c, False) | whole(c, False)).alias(c) for c in FLAGS]).where("held").drop("held")


def by_dimension(m: DataFrame, *dims: str, rolled: bool = False) -> DataFrame:
    """Rows of immediate() -> one row per (requirement, label, dimension). Each dimension
    is a branch of its own, so that a filter on `dim` leaves one scan of its columns."""
    failing = {"verified": F.col("verified_failing"), "uat_verified": F.col("uat_failing")}

    def one(d: str) -> DataFrame:
        more = [F.col(f"{d}_rolled_{c}").alias(f"rolled_{c}") for c in ("direct", "indirect")] if rolled else []
        return m.select("req_id", "label", F.lit(d).alias("dim"), F.col(f"{d}_direct").alias("immediate_direct"), F.col(f"{d}_indirect").alias("immediate_indirect"), *more, failing.get(d, F.lit(False)).alias("failing"))

    return reduce(DataFrame.unionByName, map(one, dims or DIMENSIONS))


def with_rolled(m: DataFrame, conducted: DataFrame, *dims: str) -> DataFrame:
    """Rows of immediate() with <dimension>_rolled_direct and _indirect, 0 where nothing
    is conducted. conducted: node, label and <dimension>_direct, <dimension>_indirect."""
    names = [(f"{d}_{c}", f"{d}_rolled_{c}") for d in dims or DIMENSIONS for c in ("direct", "indirect")]
    rolled = conducted.select(F.col("node").alias("req_id"), "label", *[F.col(c).alias(n) for c, n in names])
    return m.join(rolled.hint("merge"), ["req_id", "label"], "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for _, n in names})


MEASURES = ("immediate_direct", "immediate_indirect", "rolled_direct", "rolled_indirect")


def with_total(m: DataFrame) -> DataFrame:
    """The greatest of the four measures per label."""
    return m.withColumn("total", F.greatest(*MEASURES))


def role(status: str, statuses: DataFrame, df: DataFrame) -> DataFrame:
    """df with role and expects_implementation; unknown and null statuses are active.
    `statuses` is a fixed configuration table."""
    key = statuses.withColumnRenamed("status_key", "__key")
    out = df.join(F.broadcast(key), F.lower(F.col(status)) == F.col("__key"), "left").drop("__key")
    return out.withColumn("role", F.coalesce("role", F.lit("active"))).withColumn("expects_implementation", F.coalesce("expects_implementation", F.lit(True)))


def population(requirements: DataFrame, statuses: DataFrame) -> DataFrame:
    """Requirements that count for coverage."""
    return role("status", statuses, requirements).where("expects_implementation").drop("role", "expects_implementation")


def tier(covered: Column, n: Column, failing: Column) -> Column:
    return F.when(failing, "failing").when((n > 0) & (covered >= n - EPS), "full").when(covered > EPS, "partial").otherwise("missing")


def absolute_tiers(m: DataFrame, measure: str) -> DataFrame:
    """req_id, dim, tier over all labels."""
    g = m.groupBy("req_id", "dim").agg(F.sum(F.least(F.col(measure), F.lit(1.0))).alias("covered"), F.count("*").alias("n"), F.bool_or("failing").alias("failing"))
    return g.select("req_id", "dim", tier(F.col("covered"), F.col("n"), F.col("failing")).alias("tier"))


def denominators(m: DataFrame, measure: str) -> DataFrame:
    """req_id, label, dim for chained dimensions: labels covered in the prior one."""
    following = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d")) for d, p in DENOMINATOR.items()]))
    return m.where(F.col(measure) > 0).select("req_id", "label", "dim", following.alias("x")).where("dim = x.p").select("req_id", "label", F.col("x.d").alias("dim"))


def passing(m: DataFrame) -> DataFrame:
    """`verified` with no credit on failing labels."""
    v = m.where("dim = 'verified'")
    return v.withColumns({c: F.when(F.col("failing"), 0.0).otherwise(F.col(c)) for c in MEASURES}).withColumn("dim", F.lit("passing"))


def partition(m: DataFrame) -> DataFrame:
    """Tested credit by state of the label: req_id, label, state, credit."""
    wide = with_total(m).where("dim in ('tested', 'verified')").groupBy("req_id", "label").agg(F.max(F.when(F.col("dim") == "tested", F.col("total"))).alias("credit"), F.max(F.when(F.col("dim") == "verified", F.col("total"))).alias("ok"), F.bool_or("failing").alias("failing"))
    state = F.when(F.col("failing"), "failed").when(F.col("ok") > 0, "passed").otherwise("awaiting")
    return wide.where("credit > 0").select("req_id", "label", state.alias("state"), "credit")


#: Standing of tested credit.
STATES = ("passed", "failed", "awaiting")


def states(wide: DataFrame) -> DataFrame:
    """partition() from one row per assertion (see immediate() and with_rolled()): nothing is joined or summed."""
    total = lambda d: F.greatest(*[f"{d}{r}_{c}" for r in ("", "_rolled") for c in ("direct", "indirect")])
    state = F.when(F.col("verified_failing"), "failed").when(total("verified") > 0, "passed").otherwise("awaiting")
    return wide.select("req_id", "label", state.alias("state"), total("tested").alias("credit")).where("credit > 0")


def work(m: DataFrame, dim: str, prior: str | None = None) -> DataFrame:
    """req_id, label, fraction, attached: labels that no citation names in full,
    of those that the prior dimension covers by name; attached tells whether any
    evidence sits at the requirement."""
    own = m.where(F.col("dim") == dim)
    attached = own.groupBy("req_id").agg(F.bool_or((F.col("immediate_direct") > 0) | (F.col("immediate_indirect") > 0)).alias("attached"))
    left = own.where(~covered_enough(F.col("immediate_direct")))
    if prior is not None:
        left = left.join(m.where((F.col("dim") == prior) & (F.col("immediate_direct") > 0)).select("req_id", "label"), ["req_id", "label"], "left_semi")
    return left.join(attached, "req_id").select("req_id", "label", F.col("immediate_direct").alias("fraction"), "attached")
