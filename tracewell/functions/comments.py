"""Comments of source texts, by language."""

from __future__ import annotations

import re

#: File name endings by how their comments begin.
HASH = {".rb", ".sh", ".bash", ".yaml", ".yml", ".tf", ".tfvars", ".hcl"}
SLASH = {".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".h", ".cpp", ".go", ".rs", ".dart"}
DASH = {".sql", ".lua"}
HTML = {".html", ".xml", ".svg"}
#: A string, or a comment: a hash sign inside a string opens none.
_PYTHON = re.compile(r"('''|\"\"\")(?:\\.|(?!\1).)*(?:\1|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|(?P<comment>#[^\n]*)", re.S)
_BLOCK = {"slash": re.compile(r"/\*(.+?)\*/", re.S), "html": re.compile(r"<!--(.+?)-->", re.S)}


def comments(source: str | None, ending: str) -> list[tuple[int, str]]:
    """line, text of the comments, blank ones dropped; none for unknown endings.

    One comment a line for line comments, from the first mark on; Python's strings are
    passed over. Blocks stand at the line where they begin."""
    if not source:
        return []
    ending = ending.lower()
    if ending == ".py":
        found = [(source.count("\n", 0, m.start()) + 1, m["comment"].lstrip("#")) for m in _PYTHON.finditer(source) if m["comment"]]
    else:
        mark = "//" if ending in SLASH else "#" if ending in HASH else "--" if ending in DASH else None
        found = [(n, line.partition(mark)[2]) for n, line in enumerate(source.splitlines(), 1) if mark and mark in line]
        block = _BLOCK["slash"] if ending in SLASH else _BLOCK["html"] if ending in HTML else None
        found += [(source.count("\n", 0, m.start()) + 1, m[1]) for m in (block.finditer(source) if block else ())]
    return sorted(((n, t.strip()) for n, t in found if t.strip()), key=lambda x: x[0])
