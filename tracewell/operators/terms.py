"""Glossary terms in texts: where they occur, how they are marked, and texts rewritten
to the canonical form.

Which terms may occur in a text is an equi join: a term occurs only where its first two
words (or its only one) follow each other, and both sides are cut to letters and digits
alike. The exact search then runs on each text with its few candidate terms, in tasks."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STYLES = ("*", "**")
#: The four emphasis delimiters, in the order in which they claim text.
DELIMITERS = ("**", "__", "*", "_")
_EDITS = pa.list_(pa.struct([("old", pa.string()), ("new", pa.string())]))
_FOUND = {"term": pa.string(), "line": pa.int32(), "start": pa.int32(), "kind": pa.string(), "delimiter": pa.string(), "surface": pa.string(), "embedded": pa.bool_()}
_CODE = re.compile(r"`[^`]+`")
_STRONG = (re.compile(r"\*\*[^\n]+?\*\*"), re.compile(r"__[^\n]+?__"))
_LIGHT = (re.compile(r"(?<!\*)\*(?!\*)[^\n*]+?(?<!\*)\*(?!\*)"), re.compile(r"(?<!_)_(?!_)[^\n_]+?(?<!_)_(?!_)"))


def words(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def first_words(term: Column | str) -> Column:
    return F.concat_ws(" ", F.slice(words(term), 1, 2))


def runs_of_words(text: Column | str) -> Column:
    """Each word of a text, and each with the word that follows it, once."""
    of = lambda w: F.array_distinct(F.concat(w, F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))))
    # Words are bound once; the last one has none after it, which leaves a null.
    return F.array_compact(F.element_at(F.transform(F.array(words(text)), of), 1))


def candidates(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """texts with an array column `__terms` of the terms whose first two words they hold;
    texts without any are left out. Terms without a letter or digit occur nowhere."""
    known = terms.select(first_words("term").alias("__word"), F.struct("term", "indexed").alias("__term")).where("__word <> ''").distinct()
    # Keys may be null or repeat: a hash of the text tells such rows apart. Where it doesn't, they share candidates.
    rows = texts.withColumn("__hash", F.xxhash64(text))
    held = rows.select(F.col(key).alias("__key"), F.col("__hash").alias("__of"), F.explode(runs_of_words(text)).alias("__word")).join(known, "__word")
    held = held.groupBy("__key", "__of").agg(F.collect_set("__term").alias("__terms"))
    return rows.join(held, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__of"))).drop("__key", "__of", "__hash")


@functools.lru_cache(maxsize=20_000)
def _anywhere(term: str) -> re.Pattern[str]:
    return re.compile(re.escape(term), re.IGNORECASE)


def _run(text: str, at: int, step: int, mark: str) -> int:
    """How many marks stand side by side, from `at` on in the direction of step."""
    n = 0
    while 0 <= at + n * step < len(text) and text[at + n * step] == mark:
        n += 1
    return n


def _delimiter(text: str, start: int, end: int) -> str:
    """The emphasis that encloses text[start:end] tightly: two marks or more on both
    sides are strong, exactly one on both sides is light."""
    for mark in "*_":
        left, right = _run(text, start - 1, -1, mark), _run(text, end, 1, mark)
        if min(left, right) >= 2:
            return mark * 2
        if left == right == 1:
            return mark
    return ""


def _is_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def _free(text: str, start: int, end: int) -> bool:
    """Begins and ends at word boundaries."""
    return _is_word(text, start) != _is_word(text, start - 1) and _is_word(text, end - 1) != _is_word(text, end)


def _embedded(text: str, start: int, end: int) -> bool:
    """Part of a longer token, such as an identifier joined by hyphens."""
    left, right = start, end
    while left > 0 and not text[left - 1].isspace():
        left -= 1
    while right < len(text) and not text[right].isspace():
        right += 1
    return any(c.isalnum() for c in text[left:start] + text[end:right])


class _Claims:
    """Spans that are taken; later ones must not overlap them."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []

    def take(self, start: int, end: int) -> bool:
        if any(start < e and s < end for s, e in self.spans):
            return False
        self.spans.append((start, end))
        return True


def _longest_first(terms: Sequence[tuple[str, bool]]) -> list[tuple[str, bool]]:
    return sorted(set(terms), key=lambda t: (-len(t[0]), t[0]))


def _found(text: str, term: str) -> list[tuple[int, int, str]]:
    """start, end, delimiter of a term's occurrences: emphasised ones first, as delimiters rank, then in order."""
    every = [(m.start(), m.end(), _delimiter(text, m.start(), m.end())) for m in _anywhere(term).finditer(text)]
    return sorted(every, key=lambda x: (DELIMITERS.index(x[2]) if x[2] else len(DELIMITERS), x[0]))


def scanned(text: str, terms: Sequence[tuple[str, bool]], styles: Sequence[str] = STYLES, apart: bool = False) -> list[tuple]:
    """term, start, kind, delimiter, surface, embedded of the terms' occurrences.

    The longest term claims its spans first, and of one term those in emphasis before
    plain ones; with `apart`, each term is looked for by itself, so that occurrences of
    different terms may overlap. Plain occurrences count for indexed terms, at word
    boundaries."""
    claims, out = _Claims(), []
    for term, indexed in _longest_first(terms):
        plain, claims = [], _Claims() if apart else claims
        for start, end, mark in _found(text, term):
            if mark and claims.take(start - len(mark), end + len(mark)):
                out.append((term, start - len(mark), "marked" if mark in styles else "wrong", mark, text[start:end], False))
            else:
                plain.append((start, end))
        for start, end in sorted(plain):
            if indexed and _free(text, start, end) and claims.take(start, end):
                out.append((term, start, "plain", "", text[start:end], _embedded(text, start, end)))
    return out


def _edits(text: str, terms: Sequence[tuple[str, bool]], styles: Sequence[str]) -> dict[tuple[str, int], tuple[int, int, str]]:
    """Term and where it stands -> start, end and new form of what changes."""
    code = [m.span() for m in _CODE.finditer(text)]
    phrases = [m.span() for p in (*_STRONG, *_LIGHT) for m in p.finditer(text)]
    in_code = lambda s, e: any(a <= s and e <= b for a, b in code)
    claims, edits = _Claims(), {}
    for term, indexed in _longest_first(terms):
        if not indexed:
            continue
        plain = []
        for start, end, mark in _found(text, term):
            n = len(mark)
            if not (mark and claims.take(start - n, end + n)):
                plain.append((start, end))
            elif not in_code(start - n, end + n):
                own = mark if mark in styles else styles[0]
                edits[term, start] = (start - n, end + n, f"{own}{term}{own}")
        for start, end in sorted(plain):
            inside = any(s < start and end < e for s, e in phrases)
            if _free(text, start, end) and not in_code(start, end) and not inside and not _embedded(text, start, end) and claims.take(start, end):
                edits[term, start] = (start, end, f"{styles[0]}{term}{styles[0]}")
    return {k: e for k, e in edits.items() if text[e[0] : e[1]] != e[2]}


def canonical(text: str, terms: Sequence[tuple[str, bool]], styles: Sequence[str] = STYLES) -> tuple[str, list[tuple[str, str]]]:
    """The text with every free occurrence of an indexed term in canonical form, and what
    was replaced by what, in order.

    Emphasis in a valid style keeps it and takes the term's own letters; another
    delimiter, or none, becomes the first style. Code spans stay, and so do plain
    occurrences inside a longer emphasised phrase or token. Spans are claimed on the text
    as given, the longest term first, and rewritten from right to left."""
    edits = sorted(_edits(text, terms, styles).values())
    replaced = [(text[s:e], new) for s, e, new in edits]
    for start, end, new in reversed(edits):
        text = text[:start] + new + text[end:]
    return text, replaced


def kept(text: str, terms: Sequence[tuple[str, bool]], styles: Sequence[str] = STYLES) -> list[tuple[str, str]]:
    """Occurrences of indexed terms that aren't in canonical form, with the form that they
    lack, and that canonical() leaves: another term has a part of them, or they stand in
    code or in a longer phrase or token."""
    made, out = _edits(text, terms, styles), []
    for term, start, kind, mark, surface, _ in scanned(text, [t for t in terms if t[1]], styles, apart=True):
        own = mark if kind == "marked" else styles[0]
        if (kind != "marked" or surface != term) and (term, start + len(mark)) not in made:
            out.append((start, f"{mark}{surface}{mark}", f"{own}{term}{own}"))
    return [x[1:] for x in sorted(out)]


def emphasised(text: str, styles: Sequence[str] = STYLES) -> list[tuple[str, int, str]]:
    """token, start, delimiter of emphasised phrases on one line, outside code spans."""
    claims, out = _Claims(), []
    code = [m.span() for m in _CODE.finditer(text)]
    for style in styles:
        mark = re.escape(style[0])
        one = rf"(?<!{mark}){mark}(?!{mark})([^\n{mark}]+?)(?<!{mark}){mark}(?!{mark})"
        for m in re.finditer(one if len(style) == 1 else rf"{mark}{mark}([^\n{mark}]+?){mark}{mark}", text):
            if claims.take(*m.span()) and m[1].strip() and not any(a <= m.start() and m.end() <= b for a, b in code):
                out.append((m[1].strip(), m.start(), style))
    return out


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _rows(b: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(range(b.num_rows), *[b[c].to_pylist() for c in columns])


def _batch(b: pa.RecordBatch, own: Sequence[str], found: Sequence[tuple[int, tuple]], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    """found(row of b, values) -> the row's own columns, nulls kept, and the values."""
    at = pa.array([i for i, _ in found], type=pa.int32())
    values = zip(*[v for _, v in found]) if found else [()] * len(fields)
    return pa.RecordBatch.from_arrays([*[b[c].take(at) for c in own], *[pa.array(v, type=kind) for v, kind in zip(values, fields.values())]], names=[*own, *fields])


def occurrences(texts: DataFrame, terms: DataFrame, key: str, text: str, styles: Sequence[str] = STYLES, apart: bool = False, carried: Sequence[str] = ()) -> DataFrame:
    """texts(key, text, ...), terms(term, indexed) -> key, the carried columns, term, line,
    start, kind (marked, wrong or plain), delimiter, surface, embedded. Null texts have none."""
    own = [key, *carried]
    pairs = candidates(texts.where(F.col(text).isNotNull()).select(*own, text), terms, key, text)
    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, (t[0], _line(x, t[1]), *t[1:])) for i, x, terms in _rows(b, text, "__terms") for t in scanned(x, [(o["term"], o["indexed"]) for o in terms], styles, apart)]
            yield _batch(b, own, found, _FOUND)

    return pairs.mapInArrow(run, f"{fields}, term string, line int, start int, kind string, delimiter string, surface string, embedded boolean")


def canonicalized(texts: DataFrame, terms: DataFrame, key: str, text: str, styles: Sequence[str] = STYLES) -> DataFrame:
    """texts(key, text), terms(term, indexed) -> key, text, replaced and kept, both
    array<struct<old, new>>, of the texts with an occurrence that isn't in canonical form."""
    pairs = candidates(texts.where(F.col(text).isNotNull()).select(key, text), terms, key, text)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, x, own in _rows(b, text, "__terms"):
                of = [(o["term"], o["indexed"]) for o in own]
                new, replaced = canonical(x, of, styles)
                left = kept(x, of, styles)
                if replaced or left:
                    rows.append((i, (new, *[[{"old": o, "new": n} for o, n in edits] for edits in (replaced, left)])))
            yield _batch(b, [key], rows, {text: pa.string(), "replaced": _EDITS, "kept": _EDITS})

    edits = "array<struct<old: string, new: string>>"
    return pairs.mapInArrow(run, f"`{key}` {kind}, `{text}` string, replaced {edits}, kept {edits}")


def unmatched_emphasis(texts: DataFrame, terms: DataFrame, key: str, text: str, styles: Sequence[str] = STYLES) -> DataFrame:
    """texts(key, text), terms(term, synonyms array or null) -> key, token, line,
    delimiter of emphasised phrases that are neither a term nor a synonym."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, (t, _line(x, at), d)) for i, x in _rows(b, text) for t, at, d in emphasised(x, styles)]
            yield _batch(b, [key], rows, {"token": pa.string(), "line": pa.int32(), "delimiter": pa.string()})

    marked = F.rlike(text, F.lit(r"[*_]"))
    found = texts.where(marked).select(key, text).mapInArrow(run, f"`{key}` {kind}, token string, line int, delimiter string")
    names = terms.select(F.explode(F.array_union(F.array("term"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"))
    known = names.select(F.lower("name").alias("__known")).distinct()
    return found.join(known, F.lower("token") == F.col("__known"), "left_anti")
