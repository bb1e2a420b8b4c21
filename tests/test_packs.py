"""Packing by composed transitions against one fold."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeweave.operators import packs


def fold(lengths, cap, full):
    """(packs begun, how full the last is) from an open pack that holds ``full``; cap + 1: none is open."""
    begun = 0
    for n in lengths:
        if full + n > cap:
            begun, full = begun + 1, 0
        full += n
    return begun, full


ROWS = st.lists(st.integers(0, 12), min_size=1, max_size=30)


@settings(max_examples=200, deadline=None)
@given(ROWS, ROWS, ROWS, st.integers(12, 40))
def test_transitions_are_the_fold_and_compose(a, b, c, cap):
    f, g, h = (packs.transition(np.array(x), cap) for x in (a, b, c))
    all_ = packs.compose(packs.compose(f, g, cap), h, cap)
    for full in range(1, cap + 2):
        assert f(full) == fold(a, cap, full)
        assert all_(full) == fold(a + b + c, cap, full)
    assert all_ == packs.compose(f, packs.compose(g, h, cap), cap) and len(all_.least) <= cap + 2
    assert all_.least == sorted(set(all_.least)) and all_.least[0] == 0


@pytest.mark.parametrize("length", [300, 1, 3072])
def test_constant_lengths_take_two_passes_over_many_ranges(spark, length):
    rows = spark.range(8000).selectExpr("id as example_id", f"{length} as length")
    sc = spark.sparkContext
    sc.setJobGroup(f"packs-{length}", "packs")
    made = packs.pack_assignment(rows, 3072, chunks=40)
    jobs = sc.statusTracker().getJobIdsForGroup(f"packs-{length}")
    sc.setJobGroup("rest", "rest")
    assert len(jobs) <= 5  # keys kept, sampled, ranged, reduced; none follows the ranges
    per = 3072 // length
    assert all(r.pack_id == r.example_id // per for r in made.collect())
