"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords (normative ones such as shall and must are).
STOPWORDS = (
    "a an the this that these those "
    "i you he she it we they me him her us them "
    "in on at to for of with by from up about into through during before after above below between "
    "and or but nor so yet both either neither "
    "is am are was were be been being have has had having do does did doing will would could might can "
    "get got make made let "
    "not if when where how what which who whom whose all each every any some no none other such only own same than too very"
).split()


def clean_body(text: Column, collapse: bool = False) -> Column:
    """Text up to its changelog section, without trailing blank lines."""
    body = F.regexp_replace(text, r"(?s)\n## Changelog.*$", "")
    body = F.regexp_replace(body, r"[\s]+$", "")
    return F.trim(F.regexp_replace(body, r"\s+", " ")) if collapse else body


def content_hash(text: Column, length: int = 8, algorithm: str = "sha256") -> Column:
    digest = {"sha256": lambda c: F.sha2(c, 256), "sha1": F.sha1, "md5": F.md5}[algorithm]
    return F.substring(digest(text), 1, length)


def normalized_assertion(label: Column, text: Column) -> Column:
    return F.concat(label, F.lit(". "), F.trim(F.regexp_replace(F.regexp_replace(text, r"\n", " "), " +", " ")))


def keywords(text: Column, least: int = 3) -> Column:
    """Distinct words in order of first sight: lower case, punctuation but hyphens
    removed, of at least some letters, without stopwords."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\-]+", " "), " ")
    words = F.transform(words, lambda w: F.regexp_replace(w, "^-+|-+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(STOPWORDS)))


def camel_to_snake(name: Column) -> Column:
    split = F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(split, r"([a-z0-9])([A-Z])", "$1_$2"))


def candidate_functions(test_name: Column) -> Column:
    """test_a_b_c -> [a_b_c, a_b, a], most specific first."""
    parts = F.split(F.regexp_replace(test_name, "^test_", ""), "_")
    return F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "_"))


def confidence(score: Column) -> Column:
    value = F.least(score / 100, F.lit(1.0))
    return F.struct(value.alias("value"), F.when(value >= 0.8, "high").when(value >= 0.5, "medium").otherwise("low").alias("band"))


class Terms:
    """A search: every group of alternatives must hit, no excluded term may, and every
    phrase must occur. A term that begins with = fits keywords as a whole only. Built on
    the driver, compiled to one Column."""

    def __init__(self, groups: list[list[str]], excluded: list[str] = (), phrases: list[str] = ()):
        self.groups = [[t.lower() for t in g] for g in groups]
        self.excluded, self.phrases = [t.lower() for t in excluded], [p.lower() for p in phrases]

    @classmethod
    def of(cls, raw: str) -> Terms:
        """Terms of a search as users write it: words must all hit, `a OR b` is one group,
        `-a` excludes, `=a` is a whole keyword, `"a b"` is a phrase (to the end of the search
        where no mark closes it), and all words inside brackets, nested ones included, are
        one group; what is excluded or quoted there is dropped. A blank search has no groups."""
        groups, excluded, phrases = [], [], []
        either, after_word, depth, inside = False, False, 0, []
        for phrase, bracket, word in re.findall(r'"([^"]*)(?:"|$)|([()])|([^\s()"]+)', raw):
            if bracket == "(":
                depth += 1
            elif bracket == ")" and not depth:
                continue
            elif bracket == ")":
                depth -= 1
            elif depth and word not in ("", "OR", "AND") and not (word.startswith("-") and len(word) > 1):
                inside.append(word)
            if depth:
                continue
            if bracket:
                groups += [inside] if inside else []
                inside, either, after_word = [], False, False
            elif word == "OR":
                either = after_word
            elif phrase or word in ("", "AND"):
                phrases += [phrase] if phrase else []
                either, after_word = False, False
            elif word.startswith("-") and len(word) > 1:
                excluded.append(word[1:])
            else:
                groups[-1].append(word) if either else groups.append([word])
                either, after_word = False, True
        return cls([*groups, inside] if inside else groups, excluded, phrases)

    def score(self, node_id: Column, title: Column, body: Column, words: Column) -> Column:
        """id 100, title 50, whole keyword asked for by = 40, part of a keyword 25, body 10:
        the most per alternative and per group, summed over groups. Null fields hold nothing."""
        lower = [F.coalesce(F.lower(c), F.lit("")) for c in (node_id, title, body)]
        keywords = F.transform(F.array_compact(words), F.lower)

        def split(term: str) -> tuple[str, bool]:
            return (term[1:], True) if term.startswith("=") and len(term) > 1 else (term, False)

        def keyword(term: str) -> Column:
            text, whole = split(term)
            return F.exists(keywords, lambda w: w == text if whole else F.contains(w, F.lit(text)))

        def one(term: str) -> Column:
            t = F.lit(split(term)[0])
            parts = [F.when(F.contains(c, t), n).otherwise(0) for c, n in zip(lower, (100, 50, 10))]
            return F.greatest(*parts, F.when(keyword(term), 40 if split(term)[1] else 25).otherwise(0))

        best = [reduce(F.greatest, [one(t) for t in g]) if len(g) > 1 else one(g[0]) for g in self.groups]
        total = reduce(lambda a, b: a + b, best) if best else F.lit(1 if self.phrases else 0)
        fits = reduce(lambda a, b: a & b, [b > 0 for b in best], F.lit(True))
        for p in self.phrases:
            fits &= reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for c in (*lower, F.array_join(keywords, " "))])
        for t in self.excluded:
            fits &= ~reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for c in lower], keyword(t))
        return F.when(fits, total).otherwise(0)
