"""URL filters: host and path rules, then pattern rules found by their rarest
literal token.

A pattern rule is (id, verdict, tokens, regex), for lower-case URLs; its expression
must match only URLs that hold every token as a whole run of letters and digits. Rules are filed under the token that the URLs of the table use
least (counted over all of them, for the rules' tokens only), a URL's tokens
fetch the candidates and only these run their expressions."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Pattern(NamedTuple):
    id: str
    verdict: str
    tokens: tuple[str, ...]
    regex: str


#: (verdict, host, path prefix); the longest that fits decides.
HOST_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Judged for URLs that no host rule fits; block wins over allow, default is allow.
PATTERNS = (
    Pattern("pills", "block", ("cheap", "pills"), r"://([^/?#]*\.)?cheap-pills\."),
    Pattern("casino", "block", ("casino",), r"://([^/?#]*[^a-z0-9/?#])?casino([^a-z0-9]|$)"),
    Pattern("tracker", "block", ("utm", "source", "feed"), r"[?&]utm_source=feed(&|#|$)"),
    Pattern("session", "block", ("sessionid",), r"[?&]sessionid=[0-9a-f]+"),
    Pattern("login", "block", ("login",), r"/login([/?#.]|$)"),
    Pattern("ref", "block", ("page", "ref"), r"[?&]page=[0-9]+&ref="),
    Pattern("archive", "block", ("zip",), r"\.zip([?#]|$)"),
    Pattern("top", "allow", ("top",), r"#top$"),
)
_TOKEN = re.compile(r"[a-z0-9]+")


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path. No '://' or a null url: both empty."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    df = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("rest", r"^([^/?#]*)", 1)
    path = F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)
    return df.select("page_id", "url", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))


def host_rule(rules=HOST_RULES):
    """(verdict, rule) struct of the longest rule that fits host and path, or null.
    Length is that of the rule as written, host and path together."""
    best = None
    for verdict, host, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(prefix)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(host + prefix).alias("rule"))
        best = F.when(fits, value) if best is None else best.when(fits, value)
    return best


def token_counts(urls: DataFrame, patterns=PATTERNS) -> dict[str, int]:
    """How many URLs hold each token of the rules; as many rows as the rules have tokens."""
    wanted = sorted({t for p in patterns for t in p.tokens})
    seen = urls.select(F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("token")).where(F.col("token").isin(wanted))
    return {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}


def filed(patterns, counts: dict[str, int]) -> dict[str, list[Pattern]]:
    """Rules under their rarest token; of equally rare ones the longest, then the first by name."""
    out: dict[str, list[Pattern]] = {}
    for p in patterns:
        out.setdefault(min(p.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(p)
    return out


def judged(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (the pattern rule that decided,
    if one did). Null urls are allowed; rows are judged one by one, so repeated
    ids and urls are fine."""
    df = parsed(pages)
    index = filed(patterns, token_counts(df, patterns))

    @F.pandas_udf("string")
    def pattern_of(url: pd.Series) -> pd.Series:
        compiled = {t: [(p, re.compile(p.regex, re.ASCII)) for p in ps] for t, ps in index.items()}

        def first(u: str | None) -> str | None:
            if not u:
                return None
            u = u.lower()
            hits = [p for t in set(_TOKEN.findall(u)) for p, r in compiled.get(t, ()) if r.search(u)]
            return min(hits, key=lambda p: (p.verdict != "block", p.id)).id if hits else None

        return url.map(first, na_action=None).astype(object).where(lambda s: s.notna(), None)

    ruled = df.withColumn("r", host_rule(host_rules))
    found = ruled.withColumn("pattern", F.when(F.col("r").isNull(), pattern_of("url")))
    blocked = [p.id for p in patterns if p.verdict == "block"]
    own = F.when(F.col("pattern").isin(blocked), "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "pattern")
