"""File names and document text to hints, titles and DOI candidates.

The DOI and chunk functions work inside the row, so a whole text is never copied
through a shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import names as N
from . import text as T

ColumnLike = T.ColumnLike

def item_type(path: ColumnLike) -> Column:
    parts = F.split(F.lower(T.blank(path)), "/")
    return (F.when(F.array_contains(parts, "articles"), "article")
            .when(F.array_contains(parts, "books"), "book").otherwise("unknown"))


def _dash_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, " - "), T.strip), lambda p: p != "")


def with_title_query(df: DataFrame, filename: str = "filename", out: str = "title_query") -> DataFrame:
    """Title query from a file name such as ``Author 2010 Journal - Title.pdf``."""
    stem = F.replace(N.file_stem(filename), F.lit("_"), F.lit(" "))
    stem = F.regexp_replace(stem, r"(?iU)\bSI\b", " ")
    stem = F.regexp_replace(stem, r"(?iU)\bSupp(?:lement|lementary)?\b", " ")
    year_rx = "^(.*?)" + K.YEAR_PATTERN
    d = df.withColumn("_stem", stem).withColumn("_parts", _dash_parts(F.col("_stem")))
    n = F.size("_parts")
    # text after the first year, without a known journal alias of one or two words in front
    after = T.strip_chars(F.regexp_replace(F.col("_stem"), year_rx, ""), " \\-_")
    d = d.withColumn("_tail", F.when(F.col("_stem").rlike(K.YEAR_PATTERN), T.words(after))
                     .otherwise(F.array().cast("array<string>")))
    one = F.coalesce(F.try_element_at("_tail", F.lit(1)), F.lit(""))
    two = F.when(F.size("_tail") >= 2, F.concat(one, F.element_at("_tail", 2))).otherwise("")
    skip = F.when(T.venue_alias(one) != "", 1).when(T.venue_alias(two) != "", 2).otherwise(0)
    tail = F.array_join(F.slice("_tail", skip + 1, F.greatest(F.size("_tail"), F.lit(1))), " ")
    noise_free = T.titleish(T.squeeze(F.regexp_replace(
        T.first_filled(tail, F.col("_stem")), K.FILENAME_NOISE_PATTERN, " ")))
    right = T.titleish(F.try_element_at("_parts", F.lit(2)))
    title = (
        F.when(n >= 3, T.titleish(F.try_element_at("_parts", F.lit(-1))))
        .when((n == 2) & (T.word_count(right) >= 4), right)
        .when(n == 2, T.titleish(F.array_join("_parts", " ")))
        .otherwise(noise_free))
    return d.withColumn(out, title).drop("_stem", "_parts", "_tail")


def with_filename_hints(df: DataFrame, filename: str = "filename") -> DataFrame:
    """Add ``year_hint`` (int or null) and ``venue_hint`` from the first part of the file name."""
    stem = F.replace(N.file_stem(filename), F.lit("_"), F.lit(" "))
    parts = _dash_parts(stem)
    d = df.withColumn("_prefix", F.coalesce(F.try_element_at(parts, F.lit(1)), stem))
    d = d.withColumn("year_hint", N.year_in("_prefix"))
    at = F.call_function("locate", F.col("year_hint").cast("string"), F.col("_prefix"))
    suffix = F.when(F.col("year_hint").isNotNull(),
                    T.strip(F.substring(F.col("_prefix"), at + 4, F.length("_prefix")))).otherwise("")
    d = d.withColumn("_suffix", suffix).withColumn("_w", T.words("_suffix"))
    one = F.coalesce(F.try_element_at("_w", F.lit(1)), F.lit(""))
    two = F.when(F.size("_w") >= 2, F.concat(one, F.element_at("_w", 2))).otherwise("")
    return d.withColumn("venue_hint", T.first_filled(
        T.venue_alias("_suffix"), T.venue_alias(one), T.venue_alias(two))).drop("_prefix", "_suffix", "_w")


# --- text windows and lines ---------------------------------------------------------

def first_page(text: ColumnLike) -> Column:
    t = T.blank(text)
    return F.when(F.contains(t, F.lit("\n[Page 2]")), F.substring_index(t, "\n[Page 2]", 1)).otherwise(
        F.substring(t, 1, 6000))


def text_lines(text: ColumnLike, max_chars: int | None = None) -> Column:
    """Lines that can carry a title; of the whole text, or of its first ``max_chars`` characters."""
    whole = T.blank(text)
    raw = F.split(whole if max_chars is None else F.substring(whole, 1, max_chars),
                  r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    lines = F.filter(F.transform(raw, T.strip), lambda x: x != "")
    shouting = rf"^[A-Z{K.SPACE}&,:;.\-]{{3,}}$"
    keep = lambda x: ~(
        x.rlike(r"(?U)^\[Page \d+\]$")
        | x.rlike(r"(?iU)\b(?:doi|received|accepted|published online|open access|check for updates)\b")
        | (x.rlike(shouting) & (T.word_count(x) <= 8))
        | x.rlike(r"(?iU)@|\bAffiliations?\b|\bCorrespondence\b"))
    return F.transform(F.filter(lines, keep), T.titleish)


def _prefix_before(text: Column, pattern: str) -> Column:
    """Text before the first match when it has at least five words, else null."""
    cut = T.let(F.regexp_instr(text, F.lit(pattern)), lambda at: F.when(
        at > 0, T.strip_chars(F.substring(text, F.lit(1), at - 1), " ,;:\\-")))
    return T.let(cut, lambda prefix: F.when(T.word_count(prefix) >= 5, prefix))


def title_prefix(line: ColumnLike) -> Column:
    """Cut section labels in front of, and authors or a second sentence behind, a title line."""
    text = T.titleish(line)
    text = F.regexp_replace(text, r"^(?:[A-Z]\s+){2,}[A-Z]?\s*", "")
    text = F.regexp_replace(text, r"(?i)^(?:research|report|article|review|perspective|resource)\s+", "")
    text = T.strip(F.regexp_replace(
        text, r"(?i)^(?:molecular biology|dynamic genome|genome biology|biophysics|cell biology)\s+", ""))
    authors = r"(?U)\s(?=[A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+){0,3}(?:\d|\*|†|‡))"
    return T.let(text, lambda t: F.coalesce(
        _prefix_before(t, authors), _prefix_before(t, r"(?U)[.?!:]\s+[A-Z]"), t))


def title_candidates(text: ColumnLike, limit: int = 4, max_chars: int | None = None) -> Column:
    """The ``limit`` best title guesses: front lines, stitched front lines, then all further lines, in order of appearance.

    ``max_chars`` restricts the search to the front matter.
    """
    return titles_from_lines(text_lines(text, max_chars), limit)


def titles_from_lines(lines: Column, limit: int = 4, front: int = 25, stitched_lines: int = 8) -> Column:
    """``front`` and ``stitched_lines`` tell how many lines rank as front matter; the others rank behind."""
    no_et_al = lambda x: ~F.contains(F.lower(x), F.lit("et al"))
    n_words = T.word_count
    sections = (r"(?iU)\b(?:abstract|summary|introduction|significance|results|supporting information|"
                r"supplementary)\b")
    places = r"(?iU)\b(?:university|department|institute|laboratory|school|center|centre)\b"

    def from_line(x: Column) -> Column:
        as_line = F.when(n_words(x).between(5, 25) & (F.length(x) >= 25) & ~x.rlike(sections) & ~x.rlike(places)
                         & no_et_al(x), x)
        return T.let(title_prefix(x), lambda prefix: F.array_compact(F.array(
            F.when((prefix != x) & n_words(prefix).between(5, 25) & no_et_al(prefix), prefix), as_line)))

    def extend(found: Column, ls: Column) -> Column:
        """Distinct guesses of the lines behind those found; lines behind the last guess that counts are not looked at."""
        return F.aggregate(ls, found, lambda acc, x: F.when(F.size(acc) >= limit, acc).otherwise(F.array_distinct(F.concat(acc, from_line(x)))))

    def collect(ls: Column) -> Column:
        top = F.filter(F.slice(ls, 1, stitched_lines), lambda x: n_words(x) >= 2)
        pairs = T.let(top, lambda t: F.zip_with(t, F.slice(t, 2, stitched_lines), lambda a, b: T.titleish(F.concat(a, F.lit(" "), b))))
        stitched = F.filter(pairs, lambda x: x.isNotNull() & n_words(x).between(6, 20) & no_et_al(x))
        rest = F.slice(ls, front + 1, F.greatest(F.size(ls), F.lit(1)))
        full = lambda found, more: F.when(F.size(found) >= limit, found).otherwise(more(found))
        single = extend(F.array().cast("array<string>"), F.slice(ls, 1, front))
        both = T.let(single, lambda s: full(s, lambda s: F.array_distinct(F.concat(s, stitched))))
        return F.slice(T.let(both, lambda b: full(b, lambda b: extend(b, rest))), 1, limit)

    return T.let(lines, collect)


# --- DOIs ------------------------------------------------------------------------------

def dois_in(text: ColumnLike) -> Column:
    """DOIs in order of appearance; fragments with a short or digit-free suffix are left out."""
    found = F.transform(F.regexp_extract_all(T.blank(text), F.lit(K.DOI_PATTERN), F.lit(0)),
                        lambda d: F.regexp_replace(d, r"[.,);\]]+$", ""))
    suffix = lambda d: F.regexp_replace(d, "^[^/]*/", "")
    return F.array_distinct(F.filter(found, lambda d: (F.length(suffix(d)) >= 8) & suffix(d).rlike(r"(?U)\d")))


def _doi_details(region: str, base: float, order: int, text: Column) -> Column:
    def detail(d: Column) -> Column:
        def place(pos: Column) -> Column:
            start = F.greatest(F.lit(0), pos - 90)
            context = T.squeeze(F.substring(text, start + 1, pos + F.length(d) + 90 - start))
            return F.struct(pos.alias("pos"), context.alias("context"), F.lower(context).alias("low"))

        def finish(x: Column) -> Column:
            pos, low = x["pos"], x["low"]
            near = F.when(pos < 300, 0.2).when(pos < 1200, 0.12).when(pos < 4000, 0.05).otherwise(0.0)
            cue = F.when(F.contains(low, F.lit("doi:")) | F.contains(low, F.lit("doi.org/")), 0.18).otherwise(0.0)
            cited = F.when(low.rlike(r"references|bibliography|cited by|et al\."), 0.2).otherwise(0.0)
            return F.struct(
                F.round(F.lit(base) + near + cue - cited, 4).alias("priority_score"),
                (-pos).alias("neg_position"), F.lit(-order).alias("neg_window"),
                T.normalize_doi_candidate(d).alias("doi"), F.lit(region).alias("source_region"),
                pos.alias("position"), x["context"].alias("context"))

        return T.let(T.let(F.call_function("locate", F.lower(d), F.lower(text)) - 1, place), finish)
    return F.transform(dois_in(text), detail)


def doi_candidates(text: ColumnLike, filename: ColumnLike) -> Column:
    """DOI candidates of a document, best first.

    Four windows and the whole text are searched; per DOI the region with the highest priority and the earliest
    position stays.  Ties between DOIs go to the larger string.
    """
    t = T.blank(text)
    every = F.concat(
        _doi_details("filename", 0.2, 0, T.blank(filename)),
        _doi_details("first_page", 0.45, 1, first_page(t)),
        _doi_details("front_window", 0.35, 2, F.substring(t, 1, 6000)),
        _doi_details("broad_window", 0.15, 3, F.substring(t, 1, 20000)),
        _doi_details("body", 0.05, 4, t))
    best_of = lambda all_: F.transform(
        F.array_distinct(F.transform(all_, lambda x: x["doi"])),
        lambda d: F.array_max(F.filter(all_, lambda x: x["doi"] == d)))
    # bind the details once, keep one per DOI, then order
    ordered = F.transform(F.array(every), lambda all_: F.sort_array(F.transform(
        F.filter(best_of(all_), lambda x: x["doi"] != ""),
        lambda x: F.struct(x["priority_score"], (-x["position"]).alias("neg_position"), x["doi"],
                           x["source_region"], x["position"], x["context"])), asc=False))
    return F.element_at(ordered, 1)


# --- chunks -----------------------------------------------------------------------------

def chunk_array(text: ColumnLike, target: int = K.CHUNK_CHARS, overlap: int = K.CHUNK_OVERLAP,
                paragraph_break: str | None = None) -> Column:
    """Paragraphs packed into chunks of about ``target`` characters, with offsets in the text.

    A fold over the paragraphs inside the row: paragraphs are never split, ``overlap`` only moves
    the place where the search for the next offset starts.
    """
    t = T.blank(text)
    sep = paragraph_break or f"\n[{K.SPACE}]*\n"
    paragraphs = F.filter(F.transform(F.split(t, sep), T.strip), lambda p: p != "")
    chunk = "struct<text:string,char_start:bigint,char_end:bigint>"
    start = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.lit("").alias("open"),
                     F.lit(0).cast("bigint").alias("from"))

    def close(s: Column, then: Column) -> Column:
        at = F.call_function("locate", s["open"], t, (s["from"] + 1).cast("int")).cast("bigint")
        begin = F.when(at > 0, at - 1).otherwise(s["from"])
        end = begin + F.length(s["open"])
        return F.struct(
            F.concat(s["done"], F.array(F.struct(s["open"].alias("text"), begin.alias("char_start"),
                                                 end.alias("char_end")))).alias("done"),
            then.alias("open"), F.greatest(F.lit(0).cast("bigint"), end - overlap).alias("from"))

    def step(s: Column, p: Column) -> Column:
        fits = (s["open"] == "") | (F.length(s["open"]) + F.length(p) + 2 <= target)
        grown = F.struct(s["done"].alias("done"),
                         F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n\n"), p)).alias("open"),
                         s["from"].alias("from"))
        return F.when(fits, grown).otherwise(close(s, p))

    finish = lambda s: F.when(s["open"] == "", s["done"]).otherwise(close(s, F.lit(""))["done"])
    return F.aggregate(paragraphs, start, step, finish)
