"""Whole-number keys beyond 2**53 beside null ones stay as they are."""

import pytest

from cellgrove.llm import multiindex, simhash, toxicity, viterbi
from cellgrove.llm.catalog import UNIGRAM, tokenizer_file

BIG = [2**53 + 1, 2**53 + 3, None, 7]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, f"some words of text {i}" if i else None) for i, k in enumerate(BIG)], "doc_id long, text string").coalesce(1)


@pytest.mark.parametrize(
    "run",
    [
        simhash.near_duplicates,
        simhash.fingerprints,
        lambda d: toxicity.score(d, toxicity.Model({}, {}, (-3.0, 1.0, 0.0, 0.0))),
        lambda d: viterbi.token_counts(d, viterbi.Unigram.read(tokenizer_file(UNIGRAM))),
    ],
    ids=["near_duplicates", "fingerprints", "toxicity", "token_counts"],
)
def test_keys_stay(docs, run):
    assert sorted((r.doc_id for r in run(docs).collect()), key=str) == sorted(BIG, key=str)
    assert run(docs.limit(0)).count() == 0


def test_one_dimensional_vectors_link(spark):
    rows = [(1, [1.0], 0), (2, [2.0], 0), (3, [-1.0], 0), (4, [5.0], 1), (5, [0.0], 0)]
    got = multiindex.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}
