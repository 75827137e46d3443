"""Periodic runs against a plain search, and on awkward rows."""
from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from bibspark.llm import queries, runs


def brute(words, least=runs.LEAST, exponent=runs.EXPONENT):
    """All runs by comparing the words with themselves at every distance."""
    n, out = len(words), []
    for p in range(1, n // exponent + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            start, length = i, j - i + p
            if j > i and length >= max(least, exponent * p):
                smallest = next(q for q in range(1, p + 1) if all(words[x] == words[x + q] for x in range(start, start + length - q)))
                if smallest == p:
                    out.append((start, length, p))
            i = j + 1
    return sorted(out)


def kept(words, found):
    drop = {i for s, length, p in found for i in range(s + p, s + length)}
    return [w for i, w in enumerate(words) if i not in drop]


def random_words(rng):
    n, k = rng.randrange(70), rng.choice([1, 2, 2, 3, 5])
    words = [bytes([97 + rng.randrange(k)]) for _ in range(n)]
    if n and rng.random() < .7:
        a, p = rng.randrange(n), rng.randrange(1, 1 + max(1, n // 3))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if rng.random() < .5:
            words[rng.randrange(n)] = b"z"
    return words


@pytest.mark.parametrize("least,exponent", [(6, 4), (1, 2), (2, 2), (4, 3), (9, 5)])
def test_runs_against_brute_force(least, exponent):
    rng = random.Random(least * 100 + exponent)
    for _ in range(400):
        words = random_words(rng)
        expected = brute(words, least, exponent)
        assert runs.runs_of(words, least, exponent) == expected
        # the same in stretches, between other texts
        first, mine, last = runs._search([b"x y", b" \t".join(words), b" ".join(words)], least, exponent)
        assert mine[1] == last[1] == expected and not first[1]
        assert mine[2] == b" ".join(kept(words, expected)) and mine[0] == len(words)


def test_no_run_is_lost_between_stretches():
    rng = random.Random(9)
    for _ in range(30):
        words = [b"w%d" % rng.randrange(400) for _ in range(600)]
        for _ in range(4):
            a, p, n = rng.randrange(600), rng.randrange(1, 40), rng.randrange(200)
            words[a:a + n] = [words[a + i % p] for i in range(min(n, 600 - a)) if a + i % p < 600]
        expected = brute(words)
        assert next(runs._search([b" ".join(words)], 6, 4))[1] == expected
        hashes = np.array([hash(w) for w in words], np.int64).view(np.uint64)
        places = runs.stretches(hashes, np.array([len(words)]), 6, 4)
        assert all(any(a <= s and s + n <= b for a, b in places) for s, n, _ in expected)


def test_gram_fits_every_run():
    for least in range(1, 12):
        for exponent in range(2, 7):
            k = runs.gram(least, exponent)
            assert k >= 1
            assert all(k <= max(least, exponent * q) - 2 * q + 1 for q in range(1, 50))


def test_query_against_brute_force(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        words = [x for x in re.split("[\x20\x09-\x0d]+", r.text or "") if x]
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 2500:
            continue
        found = brute(words)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got[r.doc_id] == (len(found), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4),
                                 sha("".join("%d,%d,%d\n" % x for x in found)), sha(" ".join(kept(words, found))))


def test_awkward_rows(spark):
    line = "a b c   d "
    rows = [(1, "a a a a a a"), (1, "a a a a a a"), (2, None), (3, ""), (4, " \t\n"), (None, "x\x0by\x0cx y x\ry x y"), (5, line * 30_000), (6, "a A a A a A a A"),
            (7, "y " * 4 + "z " * 7 + "y z y z y z y z")]
    df = spark.createDataFrame([(*r, 1, "x", [1], "y", 2) for r in rows],
                               "doc_id long, text string, n_words int, best string, runs array<int>, collapsed string, id long")
    got = sorted(((r.doc_id or -1, r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in runs.find_runs(df).collect()),
                 key=lambda x: x[:2])
    words = line.split(" ")[:-1]
    assert got == [
        (-1, 8, [(0, 8, 2)], (0, 8, 2), "x y"), (1, 6, [(0, 6, 1)], (0, 6, 1), "a"), (1, 6, [(0, 6, 1)], (0, 6, 1), "a"), (2, 0, [], None, ""),
        (3, 0, [], None, ""), (4, 0, [], None, ""), (5, 120_000, [(0, 120_000, 4)], (0, 120_000, 4), " ".join(words)),
        (6, 8, [(0, 8, 2)], (0, 8, 2), "a A"), (7, 19, [(4, 7, 1), (10, 9, 2)], (4, 7, 1), "y y y y z y")]
    assert runs.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(df, exponent=1)
