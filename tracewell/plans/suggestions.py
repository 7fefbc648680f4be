"""Suggested links: user turns as tests without links, sentences of the benchmark as assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import suggest
from tracewell.plans.estate import Estate
from tracewell.plans.registry import query

_SUGGEST = """said AS (SELECT item_id, i, s[i] AS text, s[1] AS title FROM (SELECT item_id, string_split(text, '. ') AS s FROM benchmark), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
asked AS (SELECT DISTINCT 'T' || conv_id || '/' || turn AS test_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM conversations WHERE role = 'user'),
own AS (SELECT DISTINCT item_id, i, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM said),
held AS (SELECT *, true AS direct FROM own UNION ALL SELECT *, false FROM (SELECT DISTINCT item_id, i, unnest(regexp_extract_all(lower(title), '[a-z]{5,}')) AS word FROM said EXCEPT SELECT * FROM own)),
hits AS (SELECT test_id, item_id, i, count(*) FILTER (WHERE direct) AS a, count(*) FILTER (WHERE NOT direct) AS b FROM asked JOIN held USING (word) GROUP BY ALL),
suggested AS (SELECT test_id, 'B' || item_id AS req_id, i::VARCHAR AS label, least((CASE WHEN a > 0 THEN 40 ELSE 0 END + 15 * a + 5 * b) / 100.0, 1.0)::DOUBLE AS confidence, CASE WHEN a > 0 THEN 40 ELSE 0 END + 15 * a + 5 * b AS score, a > 0 AS direct FROM hits),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY test_id ORDER BY score DESC, req_id, label))::INTEGER AS rank FROM suggested QUALIFY rank <= 10)"""


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]{5,})"), F.lit(1))


def sentences(e: Estate) -> DataFrame:
    cut = F.split("text", r"\. ")
    return e.table("benchmark").select(F.concat(F.lit("B"), "item_id").alias("req_id"), cut[0].alias("title"), F.posexplode(cut).alias("at", "text")).select("req_id", (F.col("at") + 1).cast("string").alias("label"), "text", "title")


def asked(e: Estate) -> DataFrame:
    turns = e.table("conversations").where("role = 'user'")
    return turns.select(F.concat(F.lit("T"), "conv_id", F.lit("/"), "turn").alias("test_id"), F.explode(_words(F.col("text"))).alias("word")).distinct()


@query("SELECT test_id, req_id, label, confidence, rank, CASE WHEN direct THEN 'direct assertion match' ELSE 'requirement context match' END AS reason FROM ranked", tables=_SUGGEST)
def suggest_links(e: Estate) -> DataFrame:
    """The first ten assertions for each test, by the words they share."""
    return suggest.suggested(asked(e), suggest.by_words(sentences(e), _words))


@query("SELECT test_id, item AS req_id, '1' AS label, 0.2::DOUBLE AS confidence, (row_number() OVER (PARTITION BY test_id ORDER BY item))::INTEGER AS rank, 'requirement context match' AS reason FROM (SELECT DISTINCT test_id, 'B' || item_id AS item FROM asked JOIN own USING (word) WHERE i = 1) QUALIFY rank <= 10", tables=_SUGGEST)
def discover_fn(e: Estate) -> DataFrame:
    """The same suggestions by another search that is handed in: any word of the title, all of one score."""
    titles = sentences(e).where("label = '1'").select("req_id", "label", F.explode(_words(F.col("title"))).alias("word"))

    def search(df: DataFrame) -> DataFrame:
        return df.join(titles, "word").select("test_id", "req_id", "label", F.lit(20.0).alias("score"), F.lit(False).alias("direct"))

    return suggest.suggested(asked(e), search)
