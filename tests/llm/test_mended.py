"""Cases that once failed: surrogate spaces that run out, check digits, sequence numbers of large tables."""
import numpy as np

from bibspark.llm import common, packing, pii


def test_surrogates_end_when_a_space_is_full(spark):
    rows = [("secret", str(d)) for d in range(10)] + [("given:f", f"name{i}") for i in range(5000)] + [("ip", f"192.168.{a}.{b}") for a in range(2) for b in range(20)]
    found = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "x long, kind string, canonical string")
    attempts = {(r.kind, r.canonical): r.attempt for r in pii.settle(found, b"k").collect()}
    new = [pii.surrogate(b"k", kind, canonical, attempts.get((kind, canonical), 0)) for kind, canonical in rows]
    assert len(set(new)) == len(rows) and not {c for _, c in rows} & set(new)
    assert max(attempts.values()) < 12


def test_iban_surrogates_have_valid_check_digits():
    for iban in ("DE89370400440532013000", "GB29NWBK60161331926819"):
        for attempt in range(5):
            new = pii.surrogate(b"k", "iban", iban, attempt)
            assert new[:2] == iban[:2] and len(new) == len(iban)
            assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1


def test_sequence_numbers_of_many_partitions(spark):
    rows = [(p << 33 | n, piece, length) for p in (0, 1, 1024, 2049) for n in (0, 5) for piece, length in ((0, 2048), (1, 2048), (2, 700))]
    parts = common.materialize(spark.createDataFrame(rows, "row long, piece int, length int"), "t")
    placed, _ = packing.pack(parts)
    fill: dict = {}
    lengths = {r[:2]: r[2] for r in rows}
    got = placed.collect()
    assert len(got) == len(rows)
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, lengths[r.row, r.piece]))
    for places in fill.values():
        places.sort()
        assert [o for o, _ in places] == np.concatenate([[0], np.cumsum([n for _, n in places])[:-1]]).tolist() and sum(n for _, n in places) <= 2048
    assert len(fill) == 16 + 4
