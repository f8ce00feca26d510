"""Runs of steps on small rasters in one call give what the operators give one by one, with one shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.functions import kernels as K
from cellgrove.operators import filters as T
from cellgrove.operators import stacks
from cellgrove.operators.cells import bound
from cellgrove.plans import presets
from cellgrove.plans.recipe import OPS, run_recipe, step


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, not-a-numbers, infinities, missing cells, an empty mask, a null mask, constants, a single cell."""
    rng, rows = np.random.default_rng(3), []
    for image in range(12):
        h, w = (1, 1) if image == 9 else (5, 6) if image == 8 else (7, 9)
        for y in range(h):
            for x in range(w):
                v, u, fov = float(np.round(rng.random(), 2)), float(rng.integers(256)), (y + x) % 7 != 0
                if image == 1 and rng.random() < 0.3:
                    v = None
                if image == 2 and rng.random() < 0.1:
                    v = float("nan")
                if image == 3 and rng.random() < 0.1:
                    v = float("inf") if rng.random() < 0.5 else float("-inf")
                if image == 4 and rng.random() < 0.2:
                    continue
                fov = False if image == 5 else None if image == 6 and y == 2 else fov
                rows.append((image, h, w, y, x, 0.25 if image == 7 else None if image == 10 else v, u, fov))
    df = spark.createDataFrame(rows, "image_id long, h int, w int, y int, x int, n double, u double, fov boolean")
    return df.withColumn("h", F.col("h").alias("h", metadata=bound(7, 9))).cache()


STEPS = {
    "minus": step("sql", "o", text="255D - n"),
    "where": step("sql", "o", text="if(fov, n, 0D) * 0.5"),
    "least": step("sql", "o", text="greatest(least(n, u * 0.01D), 0.1D) + 1"),
    "normalise": step("normalise", "o", value="n", mask="fov"),
    "floor": step("normalise", "o", value="n", mask="fov", variant="floor", lo=0.2, hi=0.77),
    "no_mask": step("normalise", "o", value="n", mask=None),
    "fuse": step("fuse", "o", weights={"n": 0.3, "u": 0.7}, mask="fov"),
    "mix": step("fuse", "o", weights={"n": 0.3, "u": 0.7}, mask="fov", scale=False),
    "gaussian": step("gaussian", "o", value="n", sigma=0.8, border="reflect101"),
    "box": step("box", "o", value="n", k=4, border="constant"),
    "tophat": step("tophat", "o", value="n", elements=[K.ellipse(3), K.ellipse(5)]),
    "tophat_mean": step("tophat", "o", value="u", elements=[K.ellipse(3), K.ellipse(5)], combine="mean"),
    "blackhat": step("blackhat", "o", value="n", elements=[K.ellipse(3)]),
    "bank": step("bank", "o", value="n", bank=T.matched_bank(((5, 0.8),), 45), border="reflect"),
    "frangi": step("hessian", "o", value="n", sigmas=(0.7, 1.0), method="frangi", mask="fov", radius=2),
    "jerman": step("hessian", "o", value="n", sigmas=(0.7, 1.0), method="jerman", mask="fov", radius=2),
}


def values(df, col):
    rows = df.select("image_id", "y", "x", col).orderBy("image_id", "y", "x").collect()
    return [r[:3] for r in rows], [r[3] is None for r in rows], np.array([0.0 if r[3] is None else r[3] for r in rows])


@pytest.mark.parametrize("name", sorted(STEPS))
def test_twins_give_what_the_operators_give(odd, name):
    s = STEPS[name]
    kinds = {f.name: f.dataType.simpleString() for f in odd.schema.fields}
    assert stacks.has_twin(s.op, s.params, kinds)
    made = values(stacks.run_steps(odd, [s], {"n", "u", "fov"}, {"o"}), "o")
    want = values(OPS[s.op][0](odd, "o", **s.params), "o")
    assert made[:2] == want[:2] and len(made[0]) > 600
    np.testing.assert_allclose(made[2], want[2], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("text", ["a / b", "floor(n)", "lit and hot", "n > 1D", "1D", "if(n > 0, n, 0D)", "if(fov, fov, n)", "n.n"])
def test_other_expressions_have_no_twin(text):
    kinds = {"n": "double", "a": "double", "b": "double", "fov": "boolean", "lit": "boolean", "hot": "boolean"}
    assert not stacks.has_twin("sql", {"text": text}, kinds)


def test_a_filter_stack_shuffles_once(odd):
    df = odd.select("image_id", "h", "w", "y", "x", "fov", F.coalesce("u", F.lit(0.0)).alias("source"))
    made = run_recipe(df, presets.filter_stack(presets.SMALL), ["source", "combined"])
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    one_by_one = run_recipe(df.withColumn("h", F.col("h") + 0), presets.filter_stack(presets.SMALL), ["combined"])  # the bound is lost
    got, want = values(made, "combined"), values(one_by_one, "combined")
    assert got[:2] == want[:2]
    np.testing.assert_allclose(got[2], want[2], rtol=1e-9, atol=1e-9)
