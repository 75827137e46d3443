"""Personal data and secrets: detection, and surrogates that keep type, format, script and gender.

A surrogate is derived from a secret key and the entity's canonical form, so an entity has one surrogate everywhere.
Distinctness is checked over the whole corpus: the distinct entities are gathered in Spark; where two share a surrogate,
or a surrogate is itself an entity of the corpus, all but the first are derived again with the next attempt number, until
none is left.  Attempts above zero are the exceptions; only documents that hold one are joined to their numbers.
"""
from __future__ import annotations

import hashlib
import hmac
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import arrow_map, materialize, maybe_member, private

# fixed values: titles by the gender they tell, and given names
TITLES = {"m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Don", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Mme", "Madame", "Doña", "Госпожа"],
          "": ["Dr", "Prof"]}
GIVEN = {"m": ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Karl", "Jean", "Pierre", "Luis", "Carlos", "Juan", "José",
               "Иван", "Пётр", "Сергей"],
         "f": ["Mary", "Anna", "Elizabeth", "Susan", "Linda", "Sarah", "Julia", "Petra", "Ursula", "Marie", "Claire", "Sophie", "Carmen", "María", "Lucía",
               "Ольга", "Мария", "Елена"]}
GENDER = {n: g for g, names in GIVEN.items() for n in names}
TITLE_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
# fixed values: syllables of surrogate names by script, and endings by gender
SYLLABLES = {"latin": ["ba", "do", "fe", "gi", "ha", "jo", "ka", "le", "mi", "no", "pa", "ri", "sa", "te", "vo", "wi"],
             "cyrillic": ["ба", "до", "ве", "ги", "жо", "ка", "ле", "ми", "но", "па", "ри", "са", "те", "во", "зи", "лу"]}
ENDINGS = {"latin": {"m": ["n", "r", "s", "k"], "f": ["na", "la", "ria", "sa"], "": ["l", "t", "m", "d"]},
           "cyrillic": {"m": ["н", "р", "в", "к"], "f": ["на", "ла", "рия", "ва"], "": ["л", "т", "м", "д"]}}

_octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_word = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+"
#: kinds in order of precedence
PATTERNS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("aws_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("token", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,})"),
    ("secret", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?token)\b\"?\s?[=:]\s?\"?)(?P<value>[A-Za-z0-9_+/.-]*\d[A-Za-z0-9_+/.-]*)"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"\b\d(?:[ -]?\d){12,18}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("ip", rf"(?<![\d.]){_octet}(?:\.{_octet}){{3}}(?![\d]|\.\d)"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?|\d{1,4}[ .-])\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\+\d{9,14})(?!\w)"),
    ("name", rf"\b(?P<title>{'|'.join(t for ts in TITLES.values() for t in ts)})\.? (?P<who>{_word}(?:[ -]{_word}){{0,2}})"),
    ("name2", rf"\b(?P<full>(?:{'|'.join(GENDER)}) {_word})\b"),
]
FIND = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS))


#: every find holds a digit, an ``@`` or one of these; texts without are not looked at
STARTS = [*TITLE_GENDER, *GENDER, "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox"]
TRIGGER = re.compile("|".join(sorted(map(re.escape, STARTS), key=len, reverse=True)).encode())
PAIRS = np.zeros(1 << 16, bool)
PAIRS[[w.encode()[0] * 256 + w.encode()[1] for w in STARTS]] = True
SIGNS = np.zeros(256, bool)
SIGNS[[*range(48, 58), 64]] = True


# --- detection -----------------------------------------------------------------------------

def suspects(column: pa.Array) -> np.ndarray:
    """Places of the texts that may hold a find."""
    offsets, raw = kernel.utf8(column)
    flags = np.zeros(len(offsets), bool)
    for i, j in kernel.slices(offsets):
        part = raw[offsets[i]:offsets[j]]
        pairs = np.flatnonzero(PAIRS[part[:-1].astype(np.uint16) * np.uint16(256) + part[1:]]).tolist() if len(part) > 1 else []
        text = part.tobytes()
        at = [np.flatnonzero(SIGNS[part]), np.array([p for p in pairs if TRIGGER.match(text, p)], np.int64)]
        flags[np.searchsorted(offsets[i:j + 1] - offsets[i], np.concatenate(at), "right") - 1 + i] = True
    return np.flatnonzero(flags[:-1])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def script_of(text: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in text) else "latin"


def entities(text: str):
    """``(kind, start, end, canonical)`` of the finds of a text, in order, not overlapping."""
    at = 0
    while m := FIND.search(text, at):
        start, end = m.span()
        kind = next(k for k, _ in PATTERNS if m.group(k) is not None)
        at = end
        if kind == "secret":
            start, end = m.span("value")
        elif kind == "name":
            start, end = m.span("who")
            title = TITLE_GENDER[m.group("title")]
        elif kind == "name2":
            kind, title = "name", ""
        value = text[start:end]
        if kind == "card":
            digits = re.sub(r"\D", "", value)
            if not luhn(digits) or len(set(digits)) < 2:
                continue
            canonical = digits
        elif kind in ("phone", "ssn"):
            canonical = re.sub(r"\D", "", value)
        elif kind == "email":
            canonical = value.lower()
        elif kind == "iban":
            canonical = value.replace(" ", "")
        elif kind == "name":
            # each part is an entity of its own, so that short and full forms agree
            parts = list(re.finditer(_word, value))
            for n, part in enumerate(parts):
                own = GENDER.get(part.group()) or (title if n < len(parts) - 1 else "")
                yield ("given:" + own if own else "family", start + part.start(), start + part.end(), part.group())
            continue
        else:
            canonical = value
        yield kind, start, end, canonical


# --- surrogates ----------------------------------------------------------------------------

class Stream:
    """Keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{canonical}\0{attempt}".encode(), hashlib.sha256).digest()
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            self.block += 1
            self.left = hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
        value, self.left = int.from_bytes(self.left[:8], "big"), self.left[8:]
        return value % n


def like(text: str, rnd: Stream, hexa: bool = False) -> str:
    """A text of the same length with letters for letters and digits for digits."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(rnd.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + rnd.below(6 if hexa else 26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + rnd.below(6 if hexa else 26)))
        elif "а" <= c <= "я":
            out.append(chr(ord("а") + rnd.below(32)))
        elif "А" <= c <= "Я":
            out.append(chr(ord("А") + rnd.below(32)))
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form that stands for ``canonical``.

    From the second repetition on, every attempt draws from a larger space than the one before (names, secrets and addresses grow,
    local network addresses leave their network), so entities of a kind always find distinct surrogates in the end.
    """
    rnd = Stream(key, kind, canonical, attempt)
    more = max(0, attempt - 1)
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        labels = domain.split(".")
        place = Stream(key, "domain", domain, 0)  # one domain, one surrogate
        return like(local + "x" * more, rnd) + "@" + ".".join([*(like(x, place) for x in labels[:-1]), labels[-1]])
    if kind == "aws_key":
        return canonical[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[rnd.below(32)] for _ in canonical[4:])
    if kind == "token":
        head = re.match(r"(?:gh[pousr]_|sk-|xox[abprs]-)", canonical).group()
        return head + like(canonical[len(head):] + "x" * more, rnd)
    if kind == "secret":
        return like(canonical + canonical[-1:] * more, rnd, bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canonical)))
    if kind == "iban":
        account = like(canonical[4:], rnd)
        digits = "".join(str(int(c, 36)) for c in account + canonical[:2] + "00")
        return f"{canonical[:2]}{98 - int(digits) % 97:02d}{account}"
    if kind == "card":
        body = canonical[0] + like(canonical[1:-1], rnd)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "ip":
        parts = canonical.split(".")
        kept = 0 if more else 1 if parts[0] in ("10", "127") else 2 if parts[:2] == ["192", "168"] else 0
        fresh = [str(1 + rnd.below(222))] + [str(rnd.below(256)) for _ in range(2)] + [str(1 + rnd.below(254))]
        return ".".join(parts[:kept] + fresh[kept:])
    if kind == "phone":
        keep = len(canonical) - min(10, max(7, len(canonical) - 2)) if len(canonical) > 10 else 0
        rest = like(canonical[keep:], rnd)
        return canonical[:keep] + (str(2 + rnd.below(8)) + rest[1:] if rest else "")
    if kind.startswith("given:") or kind == "family":
        script = script_of(canonical)
        gender = kind[6:] if kind.startswith("given:") else ""
        parts = [SYLLABLES[script][rnd.below(16)] for _ in range((2 if gender else 4) + more)]
        ends = ENDINGS[script][gender]
        return ("".join(parts) + ends[rnd.below(len(ends))]).capitalize()
    return like(canonical, rnd)


def dressed(kind: str, original: str, new: str) -> str:
    """The surrogate in the separators and letter case of the original."""
    if kind in ("card", "phone", "ssn", "iban"):
        it = iter(new)
        return "".join(next(it, "") if c.isalnum() else c for c in original)
    if kind == "email" and original != original.lower():
        return new.upper() if original == original.upper() else "".join(b.upper() if a.isupper() else b for a, b in zip(original, new))
    return new


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    """Text with surrogates, and the kinds of what was replaced."""
    out, at, kinds = [], 0, []
    for kind, start, end, canonical in entities(text):
        out += [text[at:start], dressed(kind, text[start:end], surrogate(key, kind, canonical, attempts.get((kind, canonical), 0)))]
        at = end
        kinds.append(kind.split(":")[0])
    return ("".join([*out, text[at:]]) if kinds else text), kinds


# --- Arrow functions -----------------------------------------------------------------------

def found_in(batches):
    """``(x, kind, canonical)`` of the finds of ``(x, text)``, once for each text of a batch."""
    for b in batches:
        some = b.take(pa.array(suspects(b.column(1))))
        rows = {(x, kind, canonical) for x, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist())
                for kind, _, _, canonical in entities(text)}
        if rows:
            x, kind, canonical = zip(*sorted(rows))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(kind), pa.array(canonical)], ["x", "kind", "canonical"])


def derived(key: bytes):
    def run(batches):
        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in range(3))))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([surrogate(key, *r) for r in rows], pa.string())],
                                             ["kind", "canonical", "attempt", "surrogate"])
    return run


def replaced(key: bytes, names: list[str], text_at: int, found: str, with_attempts: bool):
    def run(batches):
        for b in batches:
            column = b.column(text_at)
            kinds: list[list[str]] = [[]] * b.num_rows
            places, new = [], []
            for i in suspects(column).tolist():
                tries = b.column(len(names))[i].as_py() if with_attempts else None
                text, found_kinds = replace(column[i].as_py(), key, {(e["kind"], e["canonical"]): e["attempt"] for e in tries or []})
                if found_kinds:
                    kinds[i] = found_kinds
                    places.append(i)
                    new.append(text)
            columns = list(b.columns[:len(names)])
            if places:  # changed texts take their places among the others
                order = np.arange(b.num_rows)
                order[places] = b.num_rows + np.arange(len(places))
                columns[text_at] = pa.concat_arrays([column.cast(pa.large_string()), pa.array(new, pa.large_string())]).take(pa.array(order)).cast(column.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kinds, pa.list_(pa.string()))], [*names, found])
    return run


# --- DataFrame side ------------------------------------------------------------------------

def settle(found: DataFrame, key: bytes) -> DataFrame:
    """``(kind, canonical, attempt)`` of the entities whose first surrogate is taken."""
    schema = "kind string, canonical string, attempt int, surrogate string"
    real = materialize(found.select("kind", "canonical").distinct(), "entities")
    state = materialize(arrow_map(real.withColumn("attempt", F.lit(0)), derived(key), schema), "surrogates")
    while True:
        least = state.groupBy("surrogate").agg(F.min(F.struct("attempt", "kind", "canonical")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        taken = state.join(least.select("surrogate", "first"), "surrogate").filter(F.struct("attempt", "kind", "canonical") != F.col("first")).select("kind", "canonical")
        known = real.select(F.col("canonical").alias("surrogate")).distinct()
        real_ones = state.join(known, "surrogate", "left_semi").select("kind", "canonical")
        bad = materialize(taken.unionByName(real_ones).distinct(), "taken")
        if bad.isEmpty():
            return state.filter("attempt > 0").select("kind", "canonical", "attempt")
        again = state.join(bad, ["kind", "canonical"], "left_semi").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        state = materialize(state.join(bad, ["kind", "canonical"], "left_anti").unionByName(arrow_map(again, derived(key), schema)), "surrogates")


def with_surrogates(docs: DataFrame, key: bytes, text_col: str = "text", found: str = "pii_kinds") -> DataFrame:
    """All rows and columns of ``docs`` with surrogates in ``text_col``, and the kinds of the replaced entities in order.

    Null and empty texts stay as they are.  Repeated rows are replaced alike.  An entity has the same surrogate in every
    text; two entities never share one, and none is an entity of the corpus.  An empty table gives an empty result.
    """
    x, wanted, tries = private("x"), private("wanted"), private("tries")
    names = docs.columns
    keyed = docs.withColumn(x, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    finds = arrow_map(keyed.select(x, text_col), found_in, "x long, kind string, canonical string")
    finds = materialize(finds, "finds")
    special = settle(finds, key)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = f"{kept}, `{found}` array<string>"
    plain = lambda df: arrow_map(df.select(*[F.col(f"`{n}`") for n in names]), replaced(key, names, names.index(text_col), found, False), schema)
    if special.isEmpty():
        return plain(docs)
    exceptions = (finds.join(special, ["kind", "canonical"]).groupBy("x").agg(F.collect_set(F.struct("kind", "canonical", "attempt")).alias(tries))
                  .withColumnRenamed("x", wanted))
    exceptions = materialize(exceptions, "exceptions")
    likely = maybe_member(keyed, F.col(x), exceptions, F.col(wanted)).join(exceptions, F.col(x) == F.col(wanted), "left")
    hard = arrow_map(likely.select(*[F.col(f"`{n}`") for n in names], tries), replaced(key, names, names.index(text_col), found, True), schema)
    return plain(keyed.transform(lambda d: not_member(d, x, exceptions, wanted))).unionByName(hard)


def not_member(df: DataFrame, key: str, keys: DataFrame, other: str) -> DataFrame:
    """The rows that ``maybe_member`` leaves out."""
    return maybe_member(df, F.col(key), keys, F.col(other), negate=True)
