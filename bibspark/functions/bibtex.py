"""Entry parsing (Arrow batches) and entry rendering (Column expressions)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from . import nested as V
from . import text as T
from .arrow import parse_bib, split_balanced  # noqa: F401


def split_entries(text: Column, mode: str = "line") -> Column:
    """Entries inside a text value.

    ``line``      a new entry starts at ``@`` in the first column
    ``header``    a new entry starts at every ``@type{``
    ``balanced``  an entry ends where its braces close; unclosed ones are left out
    """
    if mode == "balanced":
        return split_balanced(text)
    at = "\\n(?=@)" if mode == "line" else r"(?=@[A-Za-z0-9_:-]+\s*\{)"
    pieces = F.filter(F.transform(F.split(text, at), T.strip), lambda b: b != "")
    return pieces if mode == "line" else F.filter(pieces, lambda b: F.startswith(b, F.lit("@")))


# --- fields ---------------------------------------------------------------------------

def _type_map(of: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in of.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])


def field_order(entry_type: T.ColumnLike) -> Column:
    """Allowed fields of an entry type in output order; unknown types count as ``misc``."""
    m = _type_map(K.BIB_FIELD_ORDER)
    return F.coalesce(F.try_element_at(m, bib_type(entry_type)), F.element_at(m, "misc"))


def bib_type(entry_type: T.ColumnLike) -> Column:
    return T.first_filled(F.lower(T.strip(T.blank(entry_type))), F.lit("misc"))


def clean_fields(entry_type: T.ColumnLike, fields: Column) -> Column:
    """Allowed, non-empty fields with trimmed values."""
    allowed = field_order(entry_type)
    kept = F.map_filter(fields, lambda k, v: (T.strip(T.blank(v)) != "") & F.array_contains(allowed, k))
    return F.transform_values(kept, lambda _, v: T.strip(v))


def ignored_fields(entry_type: T.ColumnLike, fields: Column) -> Column:
    """Sorted names of filled fields that the entry type does not allow."""
    filled = F.map_keys(F.map_filter(fields, lambda _, v: T.strip(T.blank(v)) != ""))
    return F.array_sort(F.array_except(filled, field_order(entry_type)))


def overlay(base: Column, extra: Column) -> Column:
    """Fields of ``base`` replaced or extended by the filled fields of ``extra``."""
    empty = lambda m: F.coalesce(m, F.create_map().cast("map<string,string>"))
    return F.map_zip_with(empty(base), empty(extra), lambda _, a, b: F.coalesce(F.nullif(b, F.lit("")), a))


def metadata_map(entry_type: T.ColumnLike, meta: dict[str, Column], more: dict[str, Column] | None = None) -> Column:
    """Normalised metadata under bibliography names; the venue goes to the field its type uses."""
    from ..operators.quality import venue_field
    pairs = [F.lit("title"), meta["title"], F.lit("author"), meta["authors"], F.lit("year"), meta["year"],
             F.lit("doi"), meta["doi"], F.lit("url"), meta["url"], F.lit("abstract"), meta["abstract"]]
    named = F.create_map(*pairs, *[x for k, v in (more or {}).items() for x in (F.lit(k), v)])
    return overlay(named, F.create_map(venue_field(entry_type), meta["venue"]))


def preserved_fields(entry_type: T.ColumnLike, original: Column, meta: dict[str, Column],
                     more: dict[str, Column] | None = None) -> Column:
    """Original fields kept where allowed, overwritten by filled normalised metadata."""
    return clean_fields(entry_type, overlay(clean_fields(entry_type, original), metadata_map(entry_type, meta, more)))


def render_entry(entry_type: T.ColumnLike, key: T.ColumnLike, fields: Column) -> Column:
    """Entry text with fields in canonical order."""
    value = lambda v: F.replace(F.replace(v, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    line = lambda n: F.concat(F.lit("  "), n, F.lit(" = {"), value(F.try_element_at(fields, n)), F.lit("}"))
    present = F.filter(field_order(entry_type), lambda n: T.blank(F.try_element_at(fields, n)) != "")
    body = F.array_join(F.transform(present, line), ",\n")
    return F.concat(F.lit("@"), bib_type(entry_type), F.lit("{"), T.blank(key), F.lit(",\n"), body, F.lit("\n}\n"))


def normalized_metadata(fields: Column) -> dict[str, Column]:
    """Common metadata of parsed fields."""
    f = lambda n: T.blank(F.try_element_at(fields, F.lit(n)))
    return V.metadata_fields(f("title"), f("author"), f("year"),
                             T.first_filled(f("journal"), f("booktitle"), f("publisher")), f("doi"), f("url"), f("abstract"))
