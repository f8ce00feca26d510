"""Links of embeddings where a hot group, or hardly any pair, would set the reach."""

import numpy as np
import pytest

from cellgrove.llm import multiindex as M


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def beside(rng, base):
    """A partner of each vector at a cosine of 0.935 to 0.97."""
    c = rng.uniform(0.935, 0.97, len(base))[:, None]
    off = rng.normal(size=base.shape)
    off = unit(off - (off * base).sum(1, keepdims=True) * base)
    return c * base + np.sqrt(1 - c * c) * off


@pytest.mark.parametrize("hot, rare", [(2500, 500), (0, 60)])
def test_recall_on_skewed_and_sparse_data(spark, hot, rare):
    rng = np.random.default_rng(11)
    base = unit(rng.normal(size=(5000, 64)))
    crowd = unit(base[-1] + 0.01 * rng.normal(size=(hot, 64)))
    v = np.concatenate([base, beside(rng, base[:rare]), crowd]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = M.near_duplicates(df.repartition(8)).toPandas().set_index("vec_id").sort_index()
    u = unit(v.astype(float))
    near = u @ u.T >= M.COSINE
    np.fill_diagonal(near, False)
    want = near.sum(1)
    other = slice(0, 5000 + rare) if not hot else np.r_[0:4999, 5000 : 5000 + rare]
    assert (got["n_links"].to_numpy() <= want).all()
    assert got["n_links"].to_numpy()[other].sum() >= 0.99 * want[other].sum()
    if hot:
        assert got["n_links"].to_numpy()[5000 + rare :].sum() >= 0.99 * want[5000 + rare :].sum()
    i = np.arange(rare)
    assert (got["component_id"].to_numpy()[i] == got["component_id"].to_numpy()[5000 + i]).mean() >= 0.99
