"""Snapshots, files and federated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import changes
from tracewell.operators import closure as graph
from tracewell.operators import federation as fed
from tracewell.plans.estate import Estate
from tracewell.plans.registry import query

_SNAPSHOTS = """old_s AS (SELECT 'O' || o_orderkey AS id, 'f' || o_custkey // 10 AS path, sha256(o_orderpriority || o_totalprice::BIGINT) AS hash FROM orders WHERE o_orderkey % 11 <> 0),
new_s AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'Q' ELSE 'O' END || o_orderkey AS id, 'f' || (o_custkey // 10 + CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END) AS path, sha256(o_orderpriority || o_totalprice::BIGINT || CASE WHEN o_orderpriority = '1-URGENT' THEN '!' ELSE '' END) AS hash FROM orders WHERE o_orderkey % 17 <> 0),
gone AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS nth FROM old_s WHERE id NOT IN (SELECT id FROM new_s)),
come AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS nth FROM new_s WHERE id NOT IN (SELECT id FROM old_s))"""


@query(
    """SELECT id, id AS new_id, o.path AS old_path, n.path AS new_path, CASE WHEN o.path <> n.path AND o.hash <> n.hash THEN 'moved and edited' WHEN o.path <> n.path THEN 'moved' ELSE 'edited' END AS change FROM old_s o JOIN new_s n USING (id) WHERE o.path <> n.path OR o.hash <> n.hash
UNION ALL SELECT g.id, c.id, g.path, c.path, CASE WHEN c.id IS NULL THEN 'removed' WHEN g.id IS NULL THEN 'added' WHEN g.path <> c.path THEN 'renamed and moved' ELSE 'renamed' END FROM gone g FULL JOIN come c ON g.hash = c.hash AND g.nth = c.nth""",
    tables=_SNAPSHOTS,
)
def detect_moved(e: Estate) -> DataFrame:
    """Two snapshots of the orders: what moved between files, was edited, renamed, added or removed."""
    o = e.table("orders")
    # Halves go to the even neighbour, as where a double becomes an integer.
    text = F.concat("o_orderpriority", F.rint("o_totalprice").try_cast("long").cast("string"))
    place = F.floor(F.col("o_custkey") / 10)
    old = o.where("o_orderkey % 11 <> 0").select(F.concat(F.lit("O"), "o_orderkey").alias("id"), F.concat(F.lit("f"), place).alias("path"), F.sha2(text, 256).alias("hash"))
    moved = place + F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    edited = F.concat(text, F.when(F.col("o_orderpriority") == "1-URGENT", "!").otherwise(""))
    new = o.where("o_orderkey % 17 <> 0").select(F.concat(F.when(F.col("o_orderkey") % 13 == 0, "Q").otherwise("O"), "o_orderkey").alias("id"), F.concat(F.lit("f"), moved).alias("path"), F.sha2(edited, 256).alias("hash"))
    return changes.between(old, new)


@query(
    """SELECT id AS node, 'c' || c_custkey // 200 AS found, depth FROM (
  SELECT 'C' || c_custkey AS id, c_custkey, 1 AS depth FROM customer UNION ALL SELECT 'O' || o_orderkey, o_custkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT req_id || '-' || label, o_custkey, 3 FROM assertions JOIN orders ON req_id = 'O' || o_orderkey JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT req_id || '-' || label, c_custkey, 2 FROM assertions JOIN customer ON req_id = 'C' || c_custkey)"""
)
def file_of_node(e: Estate) -> DataFrame:
    """The file of customers, of orders inside them and of assertions, up the edges that
    contain them; regions and nations stand in no file."""
    c, o = e.table("customer"), e.table("orders")
    file = F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 200))
    edges = c.select(file.alias("src"), F.concat(F.lit("C"), "c_custkey").alias("dst"))
    edges = edges.unionByName(o.select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("O"), "o_orderkey").alias("dst")))
    part = F.concat_ws("-", "req_id", "label")
    edges = edges.unionByName(e.assertions.select(F.col("req_id").alias("src"), part.alias("dst")))
    nodes = e.requirements.select(F.col("id").alias("node")).unionByName(e.assertions.select(part.alias("node")))
    return graph.nearest(edges, nodes, c.select(file.alias("node")).distinct())


@query(
    """SELECT id, t.repo, segment, balance, o.owner, o.contested FROM (SELECT 'X' || c_custkey AS id, r_name AS repo, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM placed UNION ALL SELECT 'X' || s_suppkey, r_name, NULL, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) t
JOIN (SELECT id, min(repo) AS owner, count(DISTINCT repo) > 1 AS contested FROM (SELECT 'X' || c_custkey AS id, r_name AS repo FROM placed UNION ALL SELECT 'X' || s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY id) o USING (id)"""
)
def federated_union(e: Estate) -> DataFrame:
    """Customers and suppliers as nodes of their regions, in one table, with the owner of each id."""
    where = e.table("nation").join(e.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a = e.placed.select(F.concat(F.lit("X"), "c_custkey").alias("id"), F.col("r_name").alias("repo"), F.col("c_mktsegment").alias("segment"))
    b = e.table("supplier").join(where, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("X"), "s_suppkey").alias("id"), F.col("r_name").alias("repo"), F.col("s_acctbal").alias("balance"))
    return fed.united([a, b])
