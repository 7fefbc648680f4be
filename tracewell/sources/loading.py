"""Texts of requirements, journeys, code, tests and definitions, read into node,
assertion and pending-reference tables.

Texts are rows (path, text), one per file. A file is taken apart in its task, by small
functions of one text; ids that several files define are kept apart by a window over
the ids that repeat. A pending reference is one item of a list as it was written:
source_id, keyword, item_index, target, labels (empty: the whole target), path, line."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.storage import staged

NODES = "path string, id string, kind string, label string, level string, status string, hash string, parent string, line int, end_line int"
PENDING = "path string, source_id string, keyword string, item_index int, target string, labels array<string>, line int"
PARTS = "path string, owner string, label string, text string, line int"
#: Characters of a text in one row on its way into a task, and rows of a batch on its way out.
PIECE = 1024
BATCH = 2000
#: Words that open a list of references, and those allowed in a code and in a test comment.
KEYWORDS = ("implements", "refines", "satisfies", "integrates", "verifies", "validates")
ALLOWED = {"code": ("implements", "verifies"), "test": ("verifies",)}

_HEAD = re.compile(r"^(#+) ([A-Z][A-Za-z]*-?[A-Za-z]*\d+): (.*)$")
_FIELD = re.compile(r"\*{0,2}(\w+)\*{0,2}\s*:\s*([^|\n]*)")
_LABEL = re.compile(r"^([A-Z]+|\d+)\. (.*)$")
_STEP = re.compile(r"^(\d+)\. (.*)$")
_ITEM = re.compile(r"^([A-Za-z][\w-]*?\d+)(?:-([A-Z]+(?:\+[A-Z]+)*))?$")
_NOTE = re.compile(r"^\s*(?:#|//|--|\*|\"\"\"|''')?\s*(" + "|".join(KEYWORDS) + r")\s*:\s*(.*?)\s*(?:\"\"\"|''')?$", re.IGNORECASE)
_DEF = re.compile(r"^(\s*)(class|def|async def)\s+(\w+)")


class Loaded(NamedTuple):
    nodes: DataFrame
    parts: DataFrame
    pending: DataFrame


def items(written: str) -> list[tuple[int, str, list[str]]]:
    """index, target, labels of a list; an item of another form keeps its text and has no labels."""
    out = []
    for i, item in enumerate(written.split(",")):
        item = item.strip()
        m = _ITEM.match(item)
        if item:
            out.append((i, m[1], m[2].split("+") if m[2] else []) if m else (i, item, []))
    return out


def _blocks(text: str) -> Iterator[tuple[re.Match, int, list[str]]]:
    """Header, its line, and the lines below it up to the end mark or the next header."""
    head, start, body = None, 0, []
    for n, line in enumerate(text.splitlines(), 1):
        m = _HEAD.match(line)
        if m:
            if head:
                yield head, start, body
            head, start, body = m, n, []
        elif head:
            body.append(line)
            if line.startswith("*End*"):
                yield head, start, body
                head = None
    if head:
        yield head, start, body


def _sections(body: list[str]) -> Iterator[tuple[str, int, list[str]]]:
    """Name ('' before the first), place in the body, lines."""
    name, start, lines = "", 0, []
    for i, line in enumerate(body):
        if line.startswith("#"):
            yield name, start, lines
            name, start, lines = line.lstrip("# ").strip().lower(), i + 1, []
        else:
            lines.append(line)
    yield name, start, lines


def _labelled(pattern: re.Pattern, lines: list[str]) -> Iterator[tuple[str, str, int]]:
    """label, text, place of labelled lines; a line that goes on is joined, a blank one ends it."""
    label, text, at = None, [], 0
    for i, line in enumerate([*lines, ""]):
        m = pattern.match(line)
        if label is not None and (m or not line.strip() or line.startswith("*End*")):
            yield label, " ".join(text), at
            label = None
        if m:
            label, text, at = m[1], [m[2].strip()], i
        elif label is not None:
            text.append(line.strip())


def _hash(body: list[str]) -> str | None:
    for line in reversed(body):
        m = re.search(r"\*\*Hash\*\*: (\w+)", line)
        if m:
            return m[1]
    return None


def requirement_rows(path: str, text: str) -> tuple[list, list, list]:
    """Requirements, their assertions, and the references of their metadata lines."""
    nodes, parts, pending = [], [], []
    for head, line, body in _blocks(text):
        if head[2].startswith("JNY"):
            continue
        own, fields = head[2], {}
        for name, start, lines in _sections(body):
            if name == "":
                for i, row in enumerate(lines):
                    for key, value in _FIELD.findall(row):
                        key = key.lower()
                        fields.setdefault(key, value.strip())
                        if key in KEYWORDS:
                            pending += [(path, own, key, n, t, labels, line + 1 + i) for n, t, labels in items(value)]
            elif name == "assertions":
                parts += [(path, own, label, t, line + 1 + start + at) for label, t, at in _labelled(_LABEL, lines)]
        nodes.append((path, own, "requirement", head[3].strip(), fields.get("level"), fields.get("status"), _hash(body), None, line, line + len(body)))
    return nodes, parts, pending


def journey_rows(path: str, text: str) -> tuple[list, list, list]:
    """Journeys, their steps as nodes, and what their metadata says they validate; a
    declaration inside a section is misplaced and validates nothing."""
    nodes, parts, pending = [], [], []
    for head, line, body in _blocks(text):
        if not head[2].startswith("JNY"):
            continue
        own = head[2]
        nodes.append((path, own, "journey", head[3].strip(), None, None, None, None, line, line + len(body)))
        for name, start, lines in _sections(body):
            for i, row in enumerate(lines):
                for key, value in _FIELD.findall(row):
                    if key.lower() == "validates":
                        word = "validates" if name == "" else "misplaced"
                        pending += [(path, own, word, n, t, labels, line + 1 + start + i) for n, t, labels in items(value)]
            if name == "steps":
                nodes += [(path, f"{own}/{n}", "step", t, None, None, None, own, line + 1 + start + at, line + 1 + start + at) for n, t, at in _labelled(_STEP, lines)]
    return nodes, parts, pending


def _annotated(kind: str, path: str, text: str) -> tuple[list, list, list]:
    """Reference comments of a source text, with the function and class that they stand in."""
    nodes, pending, known = [], [], set()
    open_blocks: list[tuple[int, str, str, int]] = []
    for n, line in enumerate(text.splitlines(), 1):
        d = _DEF.match(line)
        if line.strip():
            # A line that stands no deeper than a definition closes it, comments included.
            depth = len(line) - len(line.lstrip())
            open_blocks = [b for b in open_blocks if b[0] < depth]
        if d:
            open_blocks.append((len(d[1]), "class" if d[2] == "class" else "def", d[3], n))
        m = _NOTE.match(line)
        if not m:
            continue
        names = {b[1]: b for b in open_blocks}
        function, owner = names.get("def"), names.get("class")
        if kind == "code" or not function:
            anchor = n if kind == "code" or not owner else owner[3]
            own, label = f"{kind}:{path}:{anchor}", f"{kind.capitalize()} at {path}:{anchor}"
            if kind == "code" and function:
                label = f"Code: {owner[2] + '.' if owner else ''}{function[2]} at {path}:{n}"
        else:
            anchor = function[3]
            label = "::".join(x[2] for x in (owner, function) if x)
            own = f"test:{path}::{label}"
        if own not in known:
            known.add(own)
            nodes.append((path, own, kind, label, None, None, None, None, anchor, n))
        word = m[1].lower()
        pending += [(path, own, word if word in ALLOWED[kind] else f"forbidden {word}", i, t, labels, n) for i, t, labels in items(m[2])]
    return nodes, [], pending


def code_rows(path: str, text: str) -> tuple[list, list, list]:
    """One node for each comment that implements or verifies something; other keywords are forbidden."""
    return _annotated("code", path, text)


def test_rows(path: str, text: str) -> tuple[list, list, list]:
    """One node for each test function that verifies something, or for the line where a
    comment outside functions stands."""
    return _annotated("test", path, text)


def definition_rows(path: str, text: str) -> tuple[list, list, list]:
    """Terms with their definitions: a line, and below it lines that begin with a colon;
    lines `Collection: true` and `Indexed: false` among them are settings."""
    nodes, parts = [], []
    lines = text.splitlines()
    for n, line in enumerate(lines):
        if line.startswith(": ") or not line.strip() or line.startswith("#") or n + 1 >= len(lines) or not lines[n + 1].startswith(": "):
            continue
        rest = []
        for row in lines[n + 1 :]:
            if not row.startswith(": "):
                break
            rest.append(row[2:].strip())
        settings = {k.lower(): v.strip().lower() for r in rest if (kv := r.partition(":"))[1] and kv[0].lower() in ("collection", "indexed") for k, v in [(kv[0], kv[2])]}
        own = f"def:{path}:{n + 1}"
        nodes.append((path, own, "definition", line.strip(), settings.get("collection"), settings.get("indexed"), None, None, n + 1, n + 1 + len(rest)))
        said = [r for r in rest if r.partition(":")[0].lower() not in ("collection", "indexed")]
        parts.append((path, own, line.strip(), " ".join(said), n + 1))
    return nodes, parts, []


def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    """path, text of texts that come in pieces(path, at, piece), in order: piece 0 begins one, or
    none (at is null: an empty text)."""
    path, pieces = None, None
    for b in batches:
        for p, at, piece in zip(*[b[c].to_pylist() for c in ("path", "at", "piece")]):
            if not at:
                if pieces is not None:
                    yield path, "".join(pieces)
                path, pieces = p, []
            pieces.append(piece or "")
    if pieces is not None:
        yield path, "".join(pieces)


def loaded(texts: DataFrame, rows: Callable) -> Loaded:
    """texts(path, text) and one of the functions above -> nodes, parts, pending. A null
    text holds nothing. Each text is taken apart once, and what is found written as rows of
    one kind each. A task holds one text, some pieces and a batch of rows, however many texts
    it reads and whatever they give."""
    kinds = {"nodes": NODES, "parts": PARTS, "pending": PENDING}
    arrow = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    types = {k: pa.struct([(n, arrow[t]) for n, t in (c.split() for c in schema.split(", "))]) for k, schema in kinds.items()}

    def batch(kind: str, found: list) -> pa.RecordBatch:
        own = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), types[kind])], fields=list(types[kind]))
        return pa.RecordBatch.from_arrays([own if k == kind else pa.nulls(len(found), t) for k, t in types.items()], names=list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {k: [] for k in types}
        for path, text in whole_texts(batches):
            for k, found in zip(types, rows(path, text)):
                held[k] += found
                if len(held[k]) >= BATCH:
                    yield from (batch(k, held[k][i : i + BATCH]) for i in range(0, len(held[k]), BATCH))
                    held[k] = []
        yield from (batch(k, found) for k, found in held.items() if found)

    schema = ", ".join(f"{k} struct<{', '.join(c.replace(' ', ': ', 1) for c in s.split(', '))}>" for k, s in kinds.items())
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    cut = texts.where("text is not null").select("path", F.posexplode_outer(pieces).alias("at", "piece"))
    read = staged(cut.mapInArrow(run, schema), "loaded")
    return Loaded(*[read.where(F.col(k).isNotNull()).select(f"{k}.*") for k in kinds])


def kept_apart(read: Loaded) -> Loaded:
    """Ids that are defined more than once: the first by path and line keeps the id; others
    become id#stem of their file, and id#stem__2 and so on where that repeats. Nodes get
    `original_id`; their parts and references follow them."""
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    order = Window.partitionBy("id").orderBy("path", "line")
    same = Window.partitionBy("id", "stem", "later").orderBy("path", "line")
    placed = read.nodes.withColumn("stem", stem).withColumn("later", F.row_number().over(order) > 1).withColumn("again", F.row_number().over(same))
    new = F.when(F.col("later"), F.concat("id", F.lit("#"), "stem", F.when(F.col("again") > 1, F.concat(F.lit("__"), "again")).otherwise("")))
    nodes = placed.withColumn("new", new).withColumns({"original_id": F.when(F.col("new").isNotNull(), F.col("id")), "id": F.coalesce("new", "id")}).drop("new", "stem", "later", "again")
    renamed = placed.where("later").select("path", "id", "line", "end_line", new.alias("new"))

    def follow(df: DataFrame, owner: str) -> DataFrame:
        r = renamed.select(F.col("path").alias("__path"), F.col("id").alias("__id"), F.col("line").alias("__from"), F.col("end_line").alias("__to"), "new")
        on = (F.col("path") == F.col("__path")) & (F.col(owner) == F.col("__id")) & F.col("line").between(F.col("__from"), F.col("__to"))
        # Files are small beside their rows: unhinted, Spark would broadcast what grows with the texts.
        return df.join(r.hint("merge"), on, "left").withColumn(owner, F.coalesce("new", owner)).select(*df.columns)

    return Loaded(nodes, follow(read.parts, "owner"), follow(read.pending, "source_id"))
