"""Links suggested for tests that have none, by a search that is handed in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A score that counts as certain.
CERTAIN = 100.0
PER_TEST = 10
#: Fixed values of by_words: for any word in an assertion's text, for each, and for each in its title.
DIRECT, PER_WORD, PER_TITLE_WORD = 40, 15, 5

#: asked(test_id, word) -> test_id, req_id, label, score, direct.
Search = Callable[[DataFrame], DataFrame]


def by_words(assertions: DataFrame, words: Callable) -> Search:
    """A search over assertions(req_id, label, text, title) by whole words; `words` turns a
    text column into an array of words. Words meet by equi join and are counted before
    anything is listed by pair of test and assertion; a word in a title and not in the
    text is context only."""
    own = assertions.select("req_id", "label", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).withColumn("direct", F.lit(True))
    title = assertions.select("req_id", "label", F.explode(F.array_except(words(F.col("title")), words(F.col("text")))).alias("word")).withColumn("direct", F.lit(False))
    held = own.unionByName(title)

    def search(asked: DataFrame) -> DataFrame:
        hits = asked.distinct().join(held, "word").groupBy("test_id", "req_id", "label").agg(F.count_if("direct").alias("in_text"), F.count_if(~F.col("direct")).alias("in_title"))
        score = F.when(F.col("in_text") > 0, DIRECT).otherwise(0) + F.lit(PER_WORD) * F.col("in_text") + F.lit(PER_TITLE_WORD) * F.col("in_title")
        return hits.select("test_id", "req_id", "label", score.cast("double").alias("score"), (F.col("in_text") > 0).alias("direct"))

    return search


def suggested(asked: DataFrame, search: Search, per_test: int = PER_TEST) -> DataFrame:
    """asked(test_id, word) of tests without links, and a search -> test_id, req_id, label,
    confidence, rank, reason: the first hits of each test by score (ties by id and label),
    scores over CERTAIN count as one. Hits without a score are none; of hits that repeat a
    pair the best counts."""
    hits = search(asked).where("score > 0").groupBy("test_id", "req_id", "label").agg(F.max("score").alias("score"), F.max("direct").alias("direct"))
    order = Window.partitionBy("test_id").orderBy(F.desc("score"), "req_id", "label")
    top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_test)
    reason = F.when(F.col("direct"), "direct assertion match").otherwise("requirement context match")
    return top.select("test_id", "req_id", "label", F.least(F.col("score") / CERTAIN, F.lit(1.0)).alias("confidence"), "rank", reason.alias("reason"))
