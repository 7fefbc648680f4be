"""The estate: node, edge and evidence tables that Spark derives from the given
tables, and the same tables in SQL for the oracle.

Regions, nations, customers and orders are requirements of three levels; a
child refines its parent. Line items are code, tests and results of orders;
conversations are user journeys over them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (name, rank, letter, allowed parents, expects validation)
LEVELS = (("PRD", 1, "p", ("PRD",), True), ("OPS", 2, "o", ("OPS", "PRD"), True), ("DEV", 3, "d", ("DEV", "OPS"), False))
#: (name, role, expects implementation)
STATUSES = (("active", "active", True), ("draft", "provisional", False), ("proposed", "provisional", False), ("roadmap", "aspirational", False), ("future", "aspirational", False), ("idea", "aspirational", False), ("deprecated", "retired", False), ("superseded", "retired", False), ("rejected", "retired", False))

ESTATE_SQL = """
levels AS (SELECT * FROM (VALUES ('PRD', 1, true), ('OPS', 2, true), ('DEV', 3, false)) t(level, rank, expects_validation)),
statuses AS (SELECT * FROM (VALUES ('active', 'active', true), ('draft', 'provisional', false), ('proposed', 'provisional', false), ('roadmap', 'aspirational', false), ('future', 'aspirational', false), ('idea', 'aspirational', false), ('deprecated', 'retired', false), ('superseded', 'retired', false), ('rejected', 'retired', false)) t(status_key, role, expects_implementation)),
placed AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
requirements AS (
  SELECT r_name AS repo, 'R' || r_regionkey AS id, 'PRD' AS level, 'Active' AS status, r_name AS title FROM region
  UNION ALL SELECT r_name, 'N' || n_nationkey, 'OPS', 'Active', n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, 'C' || c_custkey, 'DEV', CASE c_mktsegment WHEN 'MACHINERY' THEN 'Draft' WHEN 'HOUSEHOLD' THEN 'Roadmap' WHEN 'FURNITURE' THEN 'Deprecated' ELSE 'Active' END, c_name FROM placed
  UNION ALL SELECT r_name, 'O' || o_orderkey, 'DEV', CASE o_orderstatus WHEN 'F' THEN 'Active' WHEN 'O' THEN 'Draft' ELSE 'Deprecated' END, o_orderpriority FROM orders JOIN placed ON o_custkey = c_custkey),
assertions AS MATERIALIZED (
  SELECT id AS req_id, label FROM requirements, (VALUES ('A'), ('B')) t(label) WHERE id NOT LIKE 'O%'
  UNION ALL SELECT DISTINCT 'O' || l_orderkey, chr(64 + l_linenumber) FROM lineitem),
refines AS (
  SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, CASE n_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS label FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END FROM customer
  UNION ALL SELECT 'N' || (c_custkey % 25), 'C' || c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END FROM customer WHERE c_custkey % 25 <> c_nationkey
  UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END FROM orders),
implements AS (SELECT DISTINCT 'O' || l_orderkey AS req_id, 'P' || l_partkey AS source_id, CASE WHEN l_tax <> 0 THEN chr(64 + l_linenumber) END AS label FROM lineitem WHERE l_linestatus = 'F'),
tests AS (SELECT *, 'T' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS test_id FROM lineitem WHERE l_discount > 0.03),
verifies AS (SELECT DISTINCT 'O' || l_orderkey AS req_id, test_id AS source_id, CASE WHEN l_tax <> 0.01 THEN chr(64 + l_linenumber) END AS label FROM tests),
results AS (SELECT test_id, CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'R' THEN 'failed' ELSE 'skipped' END AS status, l_shipdate < TIMESTAMP '1997-01-01' AS carried FROM tests),
steps AS (SELECT 'J' || conv_id AS journey_id, 'J' || conv_id || '/' || (turn + 1) AS step_id, CASE length(text) % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'skipped' END AS status FROM conversations WHERE role = 'user'),
validates AS (SELECT DISTINCT 'O' || conv_id AS req_id, 'J' || conv_id AS source_id, CASE WHEN conv_id % 2 = 0 THEN 'A' END AS label FROM conversations),
contributions AS MATERIALIZED (
  SELECT DISTINCT e.req_id, a.label, e.source_id, CASE WHEN e.label IS NULL THEN blanket ELSE named END AS source_type FROM (
    SELECT *, 'direct' AS named, 'code_indirect' AS blanket FROM implements
    UNION ALL SELECT *, 'test_direct', 'test_indirect' FROM verifies
    UNION ALL SELECT *, 'uat_explicit', 'uat_inferred' FROM validates) e
  JOIN assertions a ON a.req_id = e.req_id AND (e.label IS NULL OR e.label = a.label)),
test_verdicts AS (SELECT test_id, bool_or(status = 'passed') AS passed, bool_or(status = 'failed') AS failed, bool_and(carried) AS carried FROM results GROUP BY test_id),
journey_verdicts AS (SELECT journey_id, count(*) AS steps, count(*) FILTER (WHERE p AND NOT f) AS verified, bool_or(f) AS failing FROM (SELECT journey_id, step_id, bool_or(status = 'passed') AS p, bool_or(status = 'failed') AS f FROM steps GROUP BY ALL) GROUP BY journey_id),
credits AS (
  SELECT c.req_id, c.label, 'implemented' AS dim, source_type = 'direct' AS named, 1.0::DOUBLE AS credit, false AS failing FROM contributions c WHERE source_type IN ('direct', 'code_indirect')
  UNION ALL SELECT req_id, label, 'tested', source_type = 'test_direct', 1.0, false FROM contributions WHERE source_type LIKE 'test%'
  UNION ALL SELECT req_id, label, 'verified', source_type = 'test_direct', CASE WHEN passed THEN 1.0 ELSE 0.0 END, failed FROM contributions JOIN test_verdicts ON source_id = test_id WHERE source_type LIKE 'test%'
  UNION ALL SELECT req_id, label, 'uat_coverage', source_type = 'uat_explicit', 1.0, false FROM contributions WHERE source_type LIKE 'uat%'
  UNION ALL SELECT req_id, label, 'uat_verified', source_type = 'uat_explicit', verified::DOUBLE / steps, failing FROM contributions JOIN journey_verdicts ON source_id = journey_id WHERE source_type LIKE 'uat%'),
dims AS (SELECT * FROM (VALUES ('implemented'), ('tested'), ('verified'), ('uat_coverage'), ('uat_verified')) t(dim)),
immediates AS MATERIALIZED (
  SELECT a.req_id, a.label, d.dim, coalesce(max(credit) FILTER (WHERE named), 0.0) AS immediate_direct, coalesce(max(credit) FILTER (WHERE NOT named), 0.0) AS immediate_indirect, coalesce(bool_or(failing), false) AS failing
  FROM assertions a CROSS JOIN dims d LEFT JOIN credits c ON c.req_id = a.req_id AND c.label = a.label AND c.dim = d.dim GROUP BY a.req_id, a.label, d.dim),
linked AS MATERIALIZED (SELECT DISTINCT src, dst, label AS named FROM refines WHERE dst IN (SELECT id FROM requirements)),
w0 AS MATERIALIZED (SELECT r.id AS node, d.dim, coalesce(avg(immediate_direct), 0.0) AS d, coalesce(avg(immediate_indirect), 0.0) AS i FROM requirements r CROSS JOIN dims d LEFT JOIN immediates m ON m.req_id = r.id AND m.dim = d.dim WHERE r.id LIKE 'O%' GROUP BY ALL),
g1 AS MATERIALIZED (SELECT f.src, f.named, v.dim, sum(v.d) AS d, sum(v.i) AS i, count(*) AS n FROM linked f JOIN w0 v ON v.node = f.dst WHERE f.src LIKE 'C%' GROUP BY ALL),
k1 AS MATERIALIZED (SELECT req_id, label, dim, sum(d) / sum(n) AS d, sum(i) / sum(n) AS i FROM (
  SELECT o.req_id, o.label, o.dim, g.d, g.i, g.n FROM immediates o JOIN g1 g ON g.src = o.req_id AND g.named = o.label AND g.dim = o.dim
  UNION ALL SELECT o.req_id, o.label, o.dim, g.d, g.i, g.n FROM immediates o JOIN g1 g ON g.src = o.req_id AND g.dim = o.dim WHERE g.named IS NULL) GROUP BY ALL),
w1 AS MATERIALIZED (SELECT req_id AS node, dim, avg(greatest(immediate_direct, coalesce(d, 0.0))) AS d, avg(greatest(immediate_indirect, coalesce(i, 0.0))) AS i FROM immediates LEFT JOIN k1 USING (req_id, label, dim) WHERE req_id LIKE 'C%' GROUP BY ALL),
g2 AS MATERIALIZED (SELECT f.src, f.named, v.dim, sum(v.d) AS d, sum(v.i) AS i, count(*) AS n FROM linked f JOIN w1 v ON v.node = f.dst WHERE f.src LIKE 'N%' GROUP BY ALL),
k2 AS MATERIALIZED (SELECT req_id, label, dim, sum(d) / sum(n) AS d, sum(i) / sum(n) AS i FROM (
  SELECT o.req_id, o.label, o.dim, g.d, g.i, g.n FROM immediates o JOIN g2 g ON g.src = o.req_id AND g.named = o.label AND g.dim = o.dim
  UNION ALL SELECT o.req_id, o.label, o.dim, g.d, g.i, g.n FROM immediates o JOIN g2 g ON g.src = o.req_id AND g.dim = o.dim WHERE g.named IS NULL) GROUP BY ALL),
w2 AS MATERIALIZED (SELECT req_id AS node, dim, avg(greatest(immediate_direct, coalesce(d, 0.0))) AS d, avg(greatest(immediate_indirect, coalesce(i, 0.0))) AS i FROM immediates LEFT JOIN k2 USING (req_id, label, dim) WHERE req_id LIKE 'N%' GROUP BY ALL),
g3 AS MATERIALIZED (SELECT f.src, f.named, v.dim, sum(v.d) AS d, sum(v.i) AS i, count(*) AS n FROM linked f JOIN w2 v ON v.node = f.dst WHERE f.src LIKE 'R%' GROUP BY ALL),
k3 AS MATERIALIZED (SELECT req_id, label, dim, sum(d) / sum(n) AS d, sum(i) / sum(n) AS i FROM (
  SELECT o.req_id, o.label, o.dim, g.d, g.i, g.n FROM immediates o JOIN g3 g ON g.src = o.req_id AND g.named = o.label AND g.dim = o.dim
  UNION ALL SELECT o.req_id, o.label, o.dim, g.d, g.i, g.n FROM immediates o JOIN g3 g ON g.src = o.req_id AND g.dim = o.dim WHERE g.named IS NULL) GROUP BY ALL),
w3 AS MATERIALIZED (SELECT req_id AS node, dim, avg(greatest(immediate_direct, coalesce(d, 0.0))) AS d, avg(greatest(immediate_indirect, coalesce(i, 0.0))) AS i FROM immediates LEFT JOIN k3 USING (req_id, label, dim) WHERE req_id LIKE 'R%' GROUP BY ALL),
measures AS MATERIALIZED (
  SELECT m.req_id, m.label, m.dim, immediate_direct, immediate_indirect, coalesce(k.d, 0.0) AS rolled_direct, coalesce(k.i, 0.0) AS rolled_indirect, failing
  FROM immediates m LEFT JOIN (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3) k USING (req_id, label, dim)),
totals AS (SELECT *, greatest(immediate_direct, immediate_indirect, rolled_direct, rolled_indirect) AS total FROM measures),
population AS (SELECT r.* FROM requirements r LEFT JOIN statuses ON lower(status) = status_key WHERE coalesce(expects_implementation, true))
"""


def labelled(key: Column) -> Column:
    return F.when(key % 3 == 0, "A").when(key % 3 == 1, "B")


def line_label() -> Column:
    return F.char(F.col("l_linenumber") + 64)


class Estate:
    """Tables of one folder, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        #: Tables that a query of this estate has written, by name.
        self.written: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def levels(self) -> DataFrame:
        rows = [F.struct(F.lit(n).alias("level"), F.lit(r).alias("rank"), F.lit(c).alias("letter"), F.array(*map(F.lit, p)).alias("allowed_parents"), F.lit(v).alias("expects_validation")) for n, r, c, p, v in LEVELS]
        return self.spark.range(1).select(F.inline(F.array(*rows)))

    @cached_property
    def statuses(self) -> DataFrame:
        rows = [F.struct(F.lit(n).alias("status_key"), F.lit(r).alias("role"), F.lit(x).alias("expects_implementation")) for n, r, x in STATUSES]
        return self.spark.range(1).select(F.inline(F.array(*rows)))

    @cached_property
    def placed(self) -> DataFrame:
        """Customers with the region they belong to; nations and regions are fixed tables."""
        where = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("customer").join(where, F.col("c_nationkey") == F.col("n_nationkey"))

    @cached_property
    def requirements(self) -> DataFrame:
        def req(df: DataFrame, letter: str, key: str, level: str, status: Column, title: str) -> DataFrame:
            return df.select(F.col("r_name").alias("repo"), F.concat(F.lit(letter), F.col(key)).alias("id"), F.lit(level).alias("level"), status.alias("status"), F.col(title).alias("title"))

        segment = F.col("c_mktsegment")
        customer = F.when(segment == "MACHINERY", "Draft").when(segment == "HOUSEHOLD", "Roadmap").when(segment == "FURNITURE", "Deprecated").otherwise("Active")
        order = F.when(F.col("o_orderstatus") == "F", "Active").when(F.col("o_orderstatus") == "O", "Draft").otherwise("Deprecated")
        region = self.table("region")
        nation = self.table("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        orders = self.table("orders").join(self.placed, F.col("o_custkey") == F.col("c_custkey"))
        out = req(region, "R", "r_regionkey", "PRD", F.lit("Active"), "r_name")
        out = out.unionByName(req(nation, "N", "n_nationkey", "OPS", F.lit("Active"), "n_name"))
        out = out.unionByName(req(self.placed, "C", "c_custkey", "DEV", customer, "c_name"))
        return out.unionByName(req(orders, "O", "o_orderkey", "DEV", order, "o_orderpriority"))

    @cached_property
    def assertions_all(self) -> DataFrame:
        """Assertions as lines name them, repeated ones included."""
        ids = self.table("region").select(F.concat(F.lit("R"), "r_regionkey").alias("req_id"))
        ids = ids.unionByName(self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("N"), "n_nationkey").alias("req_id")))
        ids = ids.unionByName(self.placed.select(F.concat(F.lit("C"), "c_custkey").alias("req_id")))
        upper = ids.select("req_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("label"))
        lines = self.table("lineitem").select(F.concat(F.lit("O"), F.col("l_orderkey")).alias("req_id"), line_label().alias("label"))
        return upper.unionByName(lines)

    @cached_property
    def assertions(self) -> DataFrame:
        return self.assertions_all.distinct()

    @cached_property
    def refines(self) -> DataFrame:
        def edge(df: DataFrame, up: str, parent: Column, down: str, key: str) -> DataFrame:
            return df.select(F.concat(F.lit(up), parent).alias("src"), F.concat(F.lit(down), F.col(key)).alias("dst"), labelled(F.col(key)).alias("label"))

        customer = self.table("customer")
        second = customer.where(F.col("c_custkey") % 25 != F.col("c_nationkey"))
        out = edge(self.table("nation"), "R", F.col("n_regionkey"), "N", "n_nationkey")
        out = out.unionByName(edge(customer, "N", F.col("c_nationkey"), "C", "c_custkey"))
        out = out.unionByName(edge(second, "N", F.col("c_custkey") % 25, "C", "c_custkey"))
        return out.unionByName(edge(self.table("orders"), "C", F.col("o_custkey"), "O", "o_orderkey"))

    @cached_property
    def implements_all(self) -> DataFrame:
        """Citations as they stand, repeated ones included."""
        lines = self.table("lineitem").where("l_linestatus = 'F'")
        return lines.select(F.concat(F.lit("O"), F.col("l_orderkey")).alias("req_id"), F.concat(F.lit("P"), F.col("l_partkey")).alias("source_id"), F.when(F.col("l_tax") != 0, line_label()).alias("label"))

    @cached_property
    def implements(self) -> DataFrame:
        return self.implements_all.distinct()

    @cached_property
    def tests(self) -> DataFrame:
        return self.table("lineitem").where("l_discount > 0.03D").withColumn("test_id", F.concat(F.lit("T"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))

    @cached_property
    def verifies_all(self) -> DataFrame:
        return self.tests.select(F.concat(F.lit("O"), F.col("l_orderkey")).alias("req_id"), F.col("test_id").alias("source_id"), F.when(F.col("l_tax") != 0.01, line_label()).alias("label"))

    @cached_property
    def verifies(self) -> DataFrame:
        return self.verifies_all.distinct()

    @cached_property
    def results(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self.tests.select("test_id", F.when(flag == "A", "passed").when(flag == "R", "failed").otherwise("skipped").alias("status"), (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")).alias("carried"))

    @cached_property
    def steps(self) -> DataFrame:
        journey = F.concat(F.lit("J"), F.col("conv_id"))
        part = F.length("text") % 3
        return self.table("conversations").where("role = 'user'").select(journey.alias("journey_id"), F.concat_ws("/", journey, (F.col("turn") + 1).cast("string")).alias("step_id"), F.when(part == 0, "passed").when(part == 1, "failed").otherwise("skipped").alias("status"))

    @cached_property
    def validates(self) -> DataFrame:
        return self.table("conversations").select(F.concat(F.lit("O"), F.col("conv_id")).alias("req_id"), F.concat(F.lit("J"), F.col("conv_id")).alias("source_id"), F.when(F.col("conv_id") % 2 == 0, "A").alias("label")).distinct()
