"""Text, search and hash queries over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as fn
from tracewell.plans.estate import Estate
from tracewell.plans.registry import query
from tracewell.plans.sets import _TERMS, terms

_STOP = ", ".join(f"'{w}'" for w in fn.STOPWORDS)
_WORDS = f"""words AS (SELECT doc_id, i, regexp_replace(w, '^-+|-+$', '', 'g') AS word FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\-]+', ' ', 'g'), ' ') AS ws FROM documents))),
keyed AS (SELECT doc_id, word, min(i) AS i FROM words WHERE length(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY ALL)"""


@query("SELECT doc_id, list(word ORDER BY i) AS keywords FROM keyed GROUP BY doc_id", tables=_WORDS)
def extract_keywords(e: Estate) -> DataFrame:
    return e.table("documents").select("doc_id", fn.keywords(F.col("text")).alias("keywords")).where("size(keywords) > 0")


@query("SELECT DISTINCT word AS keyword FROM keyed", tables=_WORDS)
def all_keywords(e: Estate) -> DataFrame:
    return e.table("documents").select(F.explode(fn.keywords(F.col("text"))).alias("keyword")).distinct()


@query("SELECT doc_id FROM keyed WHERE word IN ('that', 'thonly', 'theing', 'eren') GROUP BY doc_id", tables=_WORDS)
def find_by_keywords(e: Estate) -> DataFrame:
    wanted = F.array(*map(F.lit, ("that", "thonly", "theing", "eren")))
    return e.table("documents").where(F.arrays_overlap(fn.keywords(F.col("text")), wanted)).select("doc_id")


@query("SELECT doc_id, substr(sha256(text), 1, 8) AS hash, substr(md5(text), 1, 8) AS md5_hash FROM documents")
def content_hash(e: Estate) -> DataFrame:
    return e.table("documents").select("doc_id", fn.content_hash(F.col("text")).alias("hash"), fn.content_hash(F.col("text"), algorithm="md5").alias("md5_hash"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS version FROM documents")
def version_hash(e: Estate) -> DataFrame:
    return e.table("documents").select("doc_id", fn.content_hash(F.col("text"), 16).alias("version"))


@query("SELECT conv_id, substr(sha256(string_agg(h, chr(10) ORDER BY h)), 1, 8) AS hash FROM (SELECT conv_id, sha256(text) AS h FROM conversations) GROUP BY conv_id")
def normalized_hash(e: Estate) -> DataFrame:
    """Hash of a conversation's turns in any order."""
    digests = F.array_sort(F.collect_list(F.sha2("text", 256)))
    return e.table("conversations").groupBy("conv_id").agg(F.substring(F.sha2(F.array_join(digests, "\n"), 256), 1, 8).alias("hash"))


@query("SELECT doc_id, lower(substr(sha256(text), 1, 8)) = lower(upper(substr(sha256(text || CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE '' END), 1, 8))) AS intact FROM documents")
def verify_hash(e: Estate) -> DataFrame:
    stored = F.upper(fn.content_hash(F.concat("text", F.when(F.col("doc_id") % 9 == 0, " ").otherwise(""))))
    return e.table("documents").select("doc_id", (F.lower(fn.content_hash(F.col("text"))) == F.lower(stored)).alias("intact"))


@query("SELECT item_id, substr(sha256(definition || chr(10) || 'source=' || term), 1, 8) AS hash FROM all_terms", tables=_TERMS)
def definition_hash(e: Estate) -> DataFrame:
    return terms(e).select("item_id", fn.content_hash(F.concat("definition", F.lit("\nsource="), "term")).alias("hash"))


@query("SELECT doc_id, 'A. ' || trim(regexp_replace(regexp_replace(text, chr(10), ' ', 'g'), ' +', ' ', 'g')) AS assertion FROM documents")
def normalize_assertion(e: Estate) -> DataFrame:
    return e.table("documents").select("doc_id", fn.normalized_assertion(F.lit("A"), F.col("text")).alias("assertion"))


_SCORE = """scored AS (SELECT id, CASE WHEN a > 0 AND b > 0 AND NOT (contains(lower(id), '13') OR contains(lower(title), '13') OR contains(lower(body), '13')) THEN a + b ELSE 0 END AS score FROM (
SELECT id, title, body, greatest(CASE WHEN contains(lower(id), 'c1') THEN 100 ELSE 0 END, CASE WHEN contains(lower(title), 'c1') THEN 50 ELSE 0 END, CASE WHEN contains(lower(body), 'c1') THEN 10 ELSE 0 END, CASE WHEN contains(lower(id), 'high') THEN 100 ELSE 0 END, CASE WHEN contains(lower(title), 'high') THEN 50 ELSE 0 END, CASE WHEN contains(lower(body), 'high') THEN 10 ELSE 0 END) AS a,
 greatest(CASE WHEN contains(lower(id), 'active') THEN 100 ELSE 0 END, CASE WHEN contains(lower(title), 'active') THEN 50 ELSE 0 END, CASE WHEN contains(lower(body), 'active') THEN 10 ELSE 0 END) AS b
FROM (SELECT id, title, level || ' ' || status AS body FROM requirements)))"""


def scored(e: Estate) -> DataFrame:
    terms_ = fn.Terms([["c1", "high"], ["active"]], excluded=["13"])
    body = F.concat_ws(" ", "level", "status")
    score = terms_.score(F.col("id"), F.col("title"), body, F.array().cast("array<string>"))
    return e.requirements.select("id", score.cast("int").alias("score"))


@query("SELECT id, score FROM scored WHERE score > 0", tables=_SCORE)
def score_node(e: Estate) -> DataFrame:
    return scored(e).where("score > 0")


@query("SELECT id, score FROM scored WHERE score > 0 ORDER BY score DESC, id LIMIT 50", tables=_SCORE)
def search(e: Estate) -> DataFrame:
    return scored(e).where("score > 0").orderBy(F.desc("score"), "id").limit(50)


@query("SELECT doc_id, score FROM (SELECT doc_id, CASE WHEN contains(lower(text), 'thonly') THEN 10 ELSE 0 END + CASE WHEN contains(lower(text), 'eren') THEN 10 ELSE 0 END AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 100")
def keyword_search(e: Estate) -> DataFrame:
    low = F.lower("text")
    hit = lambda t: F.when(F.contains(low, F.lit(t)), 10).otherwise(0)
    return e.table("documents").select("doc_id", (hit("thonly") + hit("eren")).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(100)


@query("SELECT item_id, score FROM (SELECT item_id, CASE WHEN contains(lower(term), 'th') THEN 100 ELSE 0 END + CASE WHEN contains(lower(definition), 'th') THEN 10 ELSE 0 END AS score, term FROM all_terms) WHERE score > 0 ORDER BY score DESC, lower(term), item_id LIMIT 50", tables=_TERMS)
def term_search(e: Estate) -> DataFrame:
    score = F.when(F.contains(F.lower("term"), F.lit("th")), 100).otherwise(0) + F.when(F.contains(F.lower("definition"), F.lit("th")), 10).otherwise(0)
    return terms(e).withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.lower("term"), "item_id").limit(50).select("item_id", "score")


@query("SELECT name, lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM (SELECT DISTINCT replace(initcap_name, ' ', '') AS name FROM (SELECT upper(left(p_name, 1)) || substr(p_name, 2, strpos(p_name, ' ') - 1) || upper(substr(p_name, strpos(p_name, ' ') + 1, 1)) || substr(p_name, strpos(p_name, ' ') + 2) || 'HTTPCode' || p_size AS initcap_name FROM part))")
def camel_to_snake(e: Estate) -> DataFrame:
    name = F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), F.lit("HTTPCode"), F.col("p_size"))
    names = e.table("part").select(name.alias("name")).distinct()
    return names.select("name", fn.camel_to_snake(F.col("name")).alias("snake"))


@query("SELECT p_partkey, [a || '_' || b || '_x', a || '_' || b, a] AS candidates FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)")
def candidate_functions(e: Estate) -> DataFrame:
    test = F.concat(F.lit("test_"), F.regexp_replace("p_name", " ", "_"), F.lit("_x"))
    return e.table("part").select("p_partkey", fn.candidate_functions(test).alias("candidates"))


@query("SELECT doc_id, least(n_chars / 100.0, 1.0)::DOUBLE AS value, CASE WHEN n_chars >= 80 THEN 'high' WHEN n_chars >= 50 THEN 'medium' ELSE 'low' END AS band FROM documents")
def confidence(e: Estate) -> DataFrame:
    return e.table("documents").select("doc_id", fn.confidence(F.col("n_chars").cast("double")).alias("c")).select("doc_id", "c.value", "c.band")


@query("SELECT conv_id, turn, 'c-20240101-' || substr(sha256(conv_id || '#' || turn || text), 1, 6) AS comment_id FROM conversations")
def comment_id(e: Estate) -> DataFrame:
    day = F.date_format(F.lit("2024-01-01").cast("date"), "yyyyMMdd")
    seed = F.concat(F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "text")
    return e.table("conversations").select("conv_id", "turn", F.concat(F.lit("c-"), day, F.lit("-"), F.substring(F.sha2(seed, 256), 1, 6)).alias("comment_id"))


def _one(term: str) -> str:
    t = term.removeprefix("=")
    keyword = f"lang = '{t}' OR source = '{t}'" if term.startswith("=") else f"contains(lang, '{t}') OR contains(source, '{t}')"
    return f"CASE WHEN {keyword} THEN {40 if term.startswith('=') else 25} WHEN contains(text, '{t}') THEN 10 ELSE 0 END"


_ASKED = '(the OR qzq) er -und "of the" =en OR =de AND (of (OR =fr))'
_GROUPS = (("the", "qzq"), ("er",), ("=en", "=de"), ("of", "=fr"))


@query(
    f"""SELECT doc_id, a + b + c + d AS score FROM (SELECT doc_id, text, lang, source, {", ".join(f"greatest({', '.join(map(_one, g))}, 0) AS {n}" for n, g in zip("abcd", _GROUPS))}
FROM (SELECT doc_id, lower(text) AS text, coalesce(lower(lang), '') AS lang, coalesce(lower(source), '') AS source FROM documents)) WHERE a > 0 AND b > 0 AND c > 0 AND d > 0 AND (contains(text, 'of the') OR contains(lang || ' ' || source, 'of the')) AND NOT (contains(text, 'und') OR contains(lang, 'und') OR contains(source, 'und'))"""
)
def parse_query_terms(e: Estate) -> DataFrame:
    """A search as users write it, with brackets and whole keywords, over the whole texts of
    all documents; their language and source are the keywords."""
    none = F.lit("")
    score = fn.Terms.of(_ASKED).score(none, none, F.col("text"), F.array("lang", "source"))
    return e.table("documents").select("doc_id", score.alias("score")).where("score > 0")
