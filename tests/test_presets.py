"""Presets follow the numbers of their sizes, not which object holds them."""

from dataclasses import replace

import pytest

from cellgrove.plans import presets as P


@pytest.mark.parametrize("make", [P.boost_dark, P.soft_response, P.rim_mask, P.fine_branch, P.assemble_responses, *[lambda z, n=n: P.seed_mask(n, z) for n in P.SEED_MASKS]])
def test_an_equal_copy_gives_the_same_steps(make):
    copy = replace(P.FULL)
    assert copy is not P.FULL and repr(make(copy)) == repr(make(P.FULL))


def test_full_sizes_are_the_usual_ones():
    levels, clean = P.seed_mask("plain", P.FULL)
    assert levels.params["area"] == 16 and clean.params["large"] == 35 and clean.params["like"] == (12, 5, 1.9)
