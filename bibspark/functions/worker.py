"""Plain Python that runs inside Arrow batches.

The module is pickled by value, so executors do not need this package installed.
"""
from __future__ import annotations

import ctypes
import gc
import html
import re
import unicodedata

import pandas as pd
import pyarrow as pa

HEADER = re.compile(r"@([A-Za-z0-9_:-]+)\s*\{\s*([^,]+)\s*,")
ANY_HEADER = re.compile(r"@[A-Za-z0-9_:-]+\s*\{")
#: between two values: the end of the entry, or a field's name and its equals sign
FIELD = re.compile(r"[ \t\r\n,]*(?:(?P<end>\}|\Z)|(?P<name>[A-Za-z0-9_:-]*)\s*(?P<equals>=?)\s*)")
BRACE = re.compile(r"[{}]")
QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"?', re.S)
BARE = re.compile(r"[^,}]*")
#: fixed values: fields that are kept of a damaged entry
RECOVERED = ["title", "author", "year", "journal", "booktitle", "publisher", "school", "institution", "doi", "url", "abstract"]
LINE_START = re.compile(rf"^\s*({'|'.join(RECOVERED)})\s*=\s*(?=[{{\"])", re.I | re.M)
LINE_END = {"{": re.compile(r"\}\s*,?\s*$", re.M), '"': re.compile(r'"\s*,?\s*$', re.M)}


#: the types of ``schemas.PARSED_BIB`` and how many entries are Python objects at a time
PARSED = pa.struct([("entry_type", pa.string()), ("bibtex_key", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
ENTRIES = 256


class Damage(ValueError):
    """The text of an entry that cannot be read any further."""


def unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii"),
                      na_action="ignore")


def balanced_end(text: str, start: int) -> tuple[int, bool]:
    """Index behind the brace that closes the one at ``start``, and whether there is one."""
    depth = 0
    for m in BRACE.finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end(), True
    return len(text), False


def field_value(raw: str) -> str:
    value = raw.strip().rstrip(",").strip()
    if value[:1] + value[-1:] in ("{}", '""'):
        value = value[1:-1]
    return " ".join(value.split())


def value_end(text: str, at: int) -> int:
    if text[at] == "{":
        return balanced_end(text, at)[0]
    return (QUOTED if text[at] == '"' else BARE).match(text, at).end()


def tokens(text: str, at: int):
    """``(name, value)`` of the fields from ``at`` on; a name without a value is damage."""
    while (m := FIELD.match(text, at))["end"] is None:
        if not m["equals"]:
            raise Damage(f"field {m['name'] or '?'} at {m.start('name')} has no value")
        if (at := m.end()) == len(text):
            return
        end = value_end(text, at)
        yield m["name"].lower(), field_value(text[at:end])
        at = end


def recovered(text: str) -> dict[str, str]:
    """Fields of a damaged entry: known names at the start of a line, up to the first line that closes the value."""
    found: dict[str, str] = {}
    for start in LINE_START.finditer(text):
        name, at = start[1].lower(), start.end()
        end = LINE_END[text[at]].search(text, at + 1)
        if name not in found and end:
            found[name] = field_value(text[at:end.start() + 1])
    return {name: value for name, value in found.items() if value}


def parse_entry(raw: str | None, recover: bool = False) -> tuple[str, str, dict[str, str], str]:
    """``(entry_type, key, fields, error)`` of one entry; ``recover`` keeps what can be read of a damaged one, without an error."""
    text = (raw or "").strip()
    head = HEADER.match(text)
    if not head:
        return "", "", {}, "no header of an entry" if text.startswith("@") else "does not start with @"
    try:
        fields = dict(tokens(text, head.end()))
    except Damage as damage:
        if not recover:
            return "", "", {}, str(damage)
        fields = recovered(text)
    return head[1].lower(), head[2].strip(), fields, ""


def give_back() -> None:
    """Return free memory of this Python process to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def parsed_piece(raw: pa.Array, recover: bool) -> pa.Array:
    rows = [parse_entry(r, recover) for r in raw.to_pylist()]
    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
               pa.array([list(r[2].items()) for r in rows], PARSED.field(2).type), pa.array([r[3] for r in rows], pa.string())]
    return pa.StructArray.from_arrays(columns, fields=list(PARSED))


def parse_entries(raw: pa.Array, recover: bool = False) -> pa.Array:
    """A batch of entries, ``ENTRIES`` at a time: only the result is held whole, and that as Arrow arrays."""
    pieces = [parsed_piece(raw.slice(i, ENTRIES), recover) for i in range(0, len(raw), ENTRIES)]
    out = pa.concat_arrays(pieces) if pieces else pa.array([], PARSED)
    pieces.clear()
    give_back()
    return out


def closed_entries(text: str) -> list[str]:
    """Entries that end where their braces close."""
    out, at = [], 0
    while m := ANY_HEADER.search(text, at):
        end, closed = balanced_end(text, m.end() - 1)
        if closed:
            out.append(text[m.start():end].strip())
        at = end if closed else m.end()
    return out


def split_closed(texts: pd.Series) -> pd.Series:
    return texts.map(closed_entries, na_action="ignore")
