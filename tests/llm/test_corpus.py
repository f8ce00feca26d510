"""SQL twins on the smallest tables, and tokenizers against the public library."""

import random

import duckdb
import numpy as np
import pytest

from cellgrove.llm import bpe, viterbi
from cellgrove.llm.catalog import ORACLE_SQL, QUERIES, UNIGRAM, WORD_BPE, tokenizer_file
from tools.check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"
HARD = ["", " ", "a" * 300, "don't I'LL", "<|endoftext|> x <|startoftext|>", "ΑΣ Σ", "é ẞ", "\x1c\x85a\xa0b", "▁ a  b", "<s></s><unk>", "<0x41>"]


def texts():
    rng = random.Random(1)
    letters = "abcDEé ßΣσİ'中文🎉#$<|>½٣\n"
    real = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' limit 60").fetchall()]
    return real + HARD + ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(400)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    verdict = compare(QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name]))
    assert verdict.startswith("ok"), verdict


def test_bpe_like_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_file(WORD_BPE)
    lib, coder = Tokenizer.from_file(path), bpe.Encoder(bpe.Vocabulary(path))
    lib.no_truncation()
    lib.no_padding()
    for text, got in zip(texts(), coder.encode(texts())):
        ids = np.frombuffer(got, "<i4")
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert coder.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_counts_like_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = viterbi.Unigram.read(tokenizer_file(UNIGRAM))
    lib = Tokenizer(models.Unigram(list(model.entries), unk_id=model.unknown, byte_fallback=True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    counter = viterbi.Counter(model)
    rng = random.Random(2)
    spaced = ["a  b    c        d", "  a", "a   ", " " * 40, "é  中   x"] + ["".join(rng.choice(["ab", "c", " ", "  ", "中"]) for _ in range(30)) for _ in range(200)]
    for text in texts() + spaced:
        assert counter.count(text)[0] == len(lib.encode(text, add_special_tokens=False).ids), text


def test_counts_where_entries_cross_words_and_blocks(monkeypatch):
    monkeypatch.setattr(viterbi, "BLOCK_CHARS", 3)
    entries = (("<unk>", -20.0), *((e, -5.0) for e in ("a", "b", "▁", "▁a")), ("▁▁", -6.0))
    text = "a  b   a ab    a"
    counter = viterbi.Counter(viterbi.Unigram(entries, byte_fallback=False))
    # ▁a, ▁▁ b, ▁▁ ▁a, ▁a b, ▁▁ ▁ ▁a, as over the whole text at once
    assert counter.count(text) == counter.best("▁" + text.replace(" ", "▁")) == (10, -5 - 11 - 11 - 10 - 16)
    crossing = viterbi.Counter(viterbi.Unigram((*entries, ("a▁▁b", -1.0)), byte_fallback=False))
    assert not crossing.cut and crossing.count("a  b") == (2, -6.0)


def test_nulls_and_clashing_columns(spark):
    rows = [(1, None, None, None, None, "x"), (None, "", "en", "src1", 0, "y"), (2, "one two", "en", None, 7, "z"), (2, "one two", "en", None, 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    from cellgrove.llm import mixing, pii, quality, toxicity

    assert quality.quality(df).count() == pii.report(df).count() == mixing.report(df).count() == 4
    assert pii.redact(df).columns == quality.keep_good(df).columns == mixing.select_mix(df).columns == df.columns
    assert toxicity.score(df, toxicity.Model({}, {}, (-3.0, 1.0, 0.0, 0.0))).filter("predicted = 0").count() == 4


def test_stop_words_count_only_where_expected(spark):
    from cellgrove.llm import quality

    long = " ".join(f"worda{i}" for i in range(60))
    rows = [(1, long, "en"), (2, long, "pl"), (3, long, None), (4, " ".join(long.split()[:40]), "en"), (5, long + " the", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.kept for r in quality.quality(df).collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}
    assert quality.quality(df.drop("lang"), lang=None).filter("kept").count() == 2
    assert sorted(r.doc_id for r in quality.keep_good(df).collect()) == [2, 3, 4, 5]
