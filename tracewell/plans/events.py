"""Event and change log queries: the events table read as a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import changes
from tracewell.plans.estate import Estate
from tracewell.plans.registry import query
from tracewell.streaming import logs

_LOG = """kinds AS (SELECT user_id AS key, event_id AS seq, ts, value, CASE event_type WHEN 'signup' THEN 'comment' WHEN 'click' THEN 'reply' WHEN 'purchase' THEN 'resolve' WHEN 'view' THEN 'promote' ELSE 'other' END AS event FROM events),
per_key AS (SELECT key, min(seq) FILTER (WHERE event = 'comment') AS opened, count(*) FILTER (WHERE event = 'comment') AS comments, count(*) FILTER (WHERE event = 'reply') AS replies, max(seq) FILTER (WHERE event = 'promote') AS anchor_seq, max(seq) FILTER (WHERE event = 'comment') AS said, max(seq) FILTER (WHERE event = 'resolve') AS resolved FROM kinds GROUP BY key),
threads AS (SELECT key, opened, comments, replies, anchor_seq, resolved IS NULL OR resolved < said AS open FROM per_key WHERE opened IS NOT NULL)"""


def log(e: Estate) -> DataFrame:
    kind = F.col("event_type")
    event = F.when(kind == "signup", "comment").when(kind == "click", "reply").when(kind == "purchase", "resolve").when(kind == "view", "promote").otherwise("other")
    return e.table("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts", "value", event.alias("event"))


@query("SELECT key, opened, comments, replies, anchor_seq, open FROM threads", tables=_LOG)
def thread_assembly(e: Estate) -> DataFrame:
    return changes.threads(log(e))


@query("SELECT key % 10 AS node, count(*) AS open_threads FROM threads WHERE open GROUP BY 1", tables=_LOG)
def thread_count(e: Estate) -> DataFrame:
    return changes.threads(log(e)).where("open").groupBy((F.col("key") % 10).alias("node")).agg(F.count("*").alias("open_threads"))


@query("SELECT seq, key, event FROM kinds WHERE seq >= 500", tables=_LOG)
def change_log(e: Estate) -> DataFrame:
    return log(e).where("seq >= 500").select("seq", "key", "event")


@query("SELECT key, max_by(value, seq) AS value FROM kinds WHERE seq < 800 GROUP BY key", tables=_LOG)
def undo_to(e: Estate) -> DataFrame:
    return changes.latest_values(changes.undone(log(e), 800), "key", F.col("value"), "seq")


@query("SELECT key, max_by(event, (ts, seq)) AS value FROM kinds GROUP BY key", tables=_LOG)
def apply_status_change(e: Estate) -> DataFrame:
    return changes.latest_values(log(e), "key", F.col("event"), "ts", "seq")


@query("SELECT key, max_by('title ' || seq, (ts, seq)) AS value FROM kinds WHERE event = 'comment' GROUP BY key", tables=_LOG)
def apply_title_change(e: Estate) -> DataFrame:
    return changes.latest_values(log(e).where("event = 'comment'"), "key", F.concat(F.lit("title "), F.col("seq")), "ts", "seq")


@query("SELECT src, dst, n FROM (SELECT CASE WHEN src = 'N3' THEN 'N99' ELSE src END AS src, CASE WHEN dst = 'N3' THEN 'N99' ELSE dst END AS dst, count(*) AS n FROM refines GROUP BY ALL)")
def apply_rename(e: Estate) -> DataFrame:
    names = e.table("nation").where("n_nationkey = 3").select(F.lit("N3").alias("old"), F.lit("N99").alias("new"))
    return changes.renamed(e.refines.select("src", "dst"), F.broadcast(names), "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT key AS src, key % 7 AS dst, max_by(event, seq) AS kind FROM kinds WHERE event IN ('comment', 'reply', 'resolve') GROUP BY ALL HAVING max_by(event, seq) <> 'resolve'", tables=_LOG)
def apply_edge_change(e: Estate) -> DataFrame:
    """The last change per edge; edges whose last change deletes them go."""
    rows = log(e).where(F.col("event").isin("comment", "reply", "resolve"))
    last = rows.groupBy(F.col("key").alias("src"), (F.col("key") % 7).alias("dst")).agg(F.max_by("event", "seq").alias("kind"))
    return last.where("kind <> 'resolve'")


@query("SELECT w.id, w.token, CASE WHEN c.version IS NULL THEN 'node_not_found' ELSE 'conflict' END AS state FROM (SELECT seq % 200 AS id, seq % 3 AS token FROM kinds) w LEFT JOIN (SELECT key AS id, max(seq) % 3 AS version FROM kinds GROUP BY key) c USING (id) WHERE c.version IS NULL OR w.token <> c.version", tables=_LOG)
def version_conflicts(e: Estate) -> DataFrame:
    writes = log(e).select((F.col("seq") % 200).alias("id"), (F.col("seq") % 3).alias("token"))
    current = log(e).groupBy(F.col("key").alias("id")).agg((F.max("seq") % 3).alias("version"))
    return changes.conflicts(writes, current)


@query("SELECT s.event_id, min(d.event_id) AS done_id FROM events s JOIN events d ON d.user_id = s.user_id AND d.event_type = 'purchase' AND s.event_type = 'click' AND d.ts >= s.ts AND d.ts <= s.ts + INTERVAL 1 HOUR GROUP BY s.event_id")
def start_done_join(e: Estate) -> DataFrame:
    """Pairs of start and end within an hour, joined as two streams."""
    pairs = logs.run_to_table(e.spark, logs.start_done(logs.stream(e.spark, e.sf_dir, "events")), "pairs")
    return pairs.groupBy("event_id").agg(F.min("done_id").alias("done_id"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def event_append(e: Estate) -> DataFrame:
    """Events appended to a JSON log by a stream, and read back."""
    back = logs.append_and_read(e.spark, logs.stream(e.spark, e.sf_dir, "events"))
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
