"""Text chunks and metadata stubs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import nested as V
from ..functions import parsing as P
from ..functions import text as T


def chunk_texts(texts: DataFrame, target: int = K.CHUNK_CHARS, overlap: int = K.CHUNK_OVERLAP,
                paragraph_break: str | None = None) -> DataFrame:
    """``texts(paper_id, text)`` to one row per chunk.  No shuffle: a map over the texts."""
    return (
        texts.select("paper_id", F.sha2("text", 256).alias("text_sha256"),
                     F.posexplode(P.chunk_array("text", target, overlap, paragraph_break)).alias("i", "c"))
        .select("paper_id", F.format_string("%s:chunk-%04d", F.col("paper_id"), F.col("i") + 1).alias("chunk_id"),
                "c.char_start", "c.char_end", "text_sha256", F.col("c.text").alias("text"))
    )


def stub_text(title: T.ColumnLike, authors: T.ColumnLike, year: T.ColumnLike, venue: T.ColumnLike,
              doi: T.ColumnLike, url: T.ColumnLike, abstract: T.ColumnLike, key: T.ColumnLike) -> Column:
    """Stand-in document for a record without text."""
    m = V.metadata_fields(title, authors, year, venue, doi, url, abstract)
    labelled = [F.concat(F.lit(f"{label}: "), m[name]) for label, name in (
        ("Authors", "authors"), ("Year", "year"), ("Venue", "venue"), ("DOI", "doi"), ("URL", "url"),
        ("Abstract", "abstract"))]
    lines = F.concat_ws("\n", F.lit(K.STUB_HEADER), m["title"], *labelled,
                        F.concat(F.lit("BibTeX key: "), T.blank(key)))
    return F.concat(F.regexp_replace(lines, f"[{K.SPACE}]+$", ""), F.lit("\n"))
