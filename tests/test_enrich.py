"""Lookup in ranges against a plain search."""

import random

import pytest

from tidewatch.operators import enrich


@pytest.mark.parametrize("part_rows", [500_000, 40])
def test_overlapping_ranges(spark, monkeypatch, part_rows):
    """Nested, overlapping, equal and reversed ranges; a value that a third of the rows has; ranges over all parts."""
    monkeypatch.setattr(enrich, "PART_ROWS", part_rows)
    rnd = random.Random(6)
    ranges = [(a, a + rnd.choice([0, 3, 40, 900]), f"r{i}", i % 5) for i, a in enumerate(rnd.randrange(5000) for _ in range(150))]
    ranges += [(-10, 2**40, "all", 0), (700, 650, "reversed", 1), (None, 5, "open", 2), (100, 200, "twin", 9), (100, 200, "twin", 3), (100, 200, "double", 4)]
    values = [rnd.randrange(-50, 6500) for _ in range(400)] + [4242] * 200 + [None, None, 2**45]
    df = spark.createDataFrame(list(enumerate(values)), "id long, number long")
    blocks = spark.createDataFrame(ranges, "lo long, hi long, name string, tag int")
    got = {r.id: (r.name, r.tag) for r in enrich.range_lookup(df, blocks, "number", "lo", "hi", ["name", "tag"]).collect()}

    def plain(v):
        holding = [(hi - lo, lo, name, tag) for lo, hi, name, tag in ranges if v is not None and lo is not None and lo <= v <= hi]
        return min(holding)[2:] if holding else (None, None)
    assert got == {i: plain(v) for i, v in enumerate(values)} and len(got) == len(values)


def test_nothing_to_look_up(spark):
    df = spark.createDataFrame([(1, 5)], "id long, number long")
    none = spark.createDataFrame([], "lo long, hi long, name string")
    assert [tuple(r) for r in enrich.range_lookup(df, none, "number", "lo", "hi", ["name"]).collect()] == [(1, 5, None)]
    assert enrich.range_lookup(df.limit(0), none, "number", "lo", "hi", ["name"]).count() == 0
