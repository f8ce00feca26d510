"""Residual contrast where deviations are nothing but the last bits of a mean."""

import numpy as np

from cellgrove.operators.contrast import residual_contrast


def test_last_bits_of_a_background_move_no_level(grid, back):
    ground = np.full((3, 3), 0.3)
    ground[0, 0] += 2e-14
    df = grid({1: {"v": np.full((3, 3), 100.0), "bg": ground, "fov": np.ones((3, 3), bool)}})
    out = back(residual_contrast(df, "v", "bg", "fov", "fov", "bent"), "bent")
    assert set(out.reshape(-1)) == {142.0}
