"""Words, n-grams and cached token ids against plain Python and the library."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from wavetally.llm import bloom, tokens
from wavetally.llm.tokens import WordEncoder
from wavetally.llm.words import Words, ngrams, shingle_sets

TEXTS = [None, "", " ", "a", "One two\tthree\nFOUR", "x\x0by\x0cz\r\n", "é É ß", "a\xa0b c", "w " * 40]


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_are_runs_of_non_blanks():
    w = Words(pa.array(TEXTS))
    raw = w.data.tobytes()
    got = [[raw[w.start[i] : w.end[i]].decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [plain(t) for t in TEXTS]


def test_hashes_agree_exactly_where_words_do():
    w = Words(pa.array(["ab AB aB b", "ab c", "abc"]))
    lower, exact = w.hashes(lower=True), w.hashes(lower=False)
    assert len(set(lower[:3].tolist())) == 1 and lower[0] == lower[4] and len(set(lower.tolist())) == 4
    assert len(set(exact[:3].tolist())) == 3 and exact[0] == exact[4]


def test_sliced_columns_and_empty_columns():
    assert Words(pa.array(TEXTS)[4:6]).counts.tolist() == [4, 3]
    assert len(Words(pa.array([], pa.string()))) == 0
    assert len(ngrams(np.zeros(3, np.uint64), 5)) == 0


def test_shingles_of_short_and_long_texts():
    sets = shingle_sets(Words(pa.array([None, "a b", "A B", "a b c d e", "a b c d e a b c d e", "b a"])), 5)
    assert [len(s) for s in sets] == [0, 1, 1, 1, 5, 1]
    assert sets[1][0] == sets[2][0] != sets[5][0] and sets[3][0] in sets[4]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_are_the_librarys(name):
    encoder = WordEncoder(public_tokenizers.path(name), cached=50)
    letters = ["a", "B", "'s", " ", " ", "\n", "é", "é", "1", "!", "#", "ß", "Σ", "<|endoftext|>", "\t", "\x1d", "　", "\x00", "漢", "İ"]
    rnd = random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 15))) for _ in range(3000)]
    for t in texts:
        want = np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(t) == want, repr(t)


def test_bloom_filter_finds_all_and_little_else(spark):
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    df = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "k long").repartition(7)
    bits = 1 << 19
    made = bloom.of_column(df, "k", bits)
    assert bloom.contains(made, keys.view(np.uint64)).all()
    assert bloom.contains(made, (keys + 1).view(np.uint64)).mean() < 0.01
    assert not bloom.of_column(df.limit(0), "k", bits).any()


def test_words_in_use_outlast_a_full_cache_and_a_task():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = tokens.WordEncoder(path, cached=40)
    asked = []
    word = encoder.words.encode
    encoder.words.encode = lambda w: asked.append(w) or word(w)
    for i in range(200):
        text = f"often Often OFTEN rare{i} é{i}"
        assert encoder.encode(text) == encoder.library(text)
        assert len(encoder.words) + len(encoder.words.older) <= 48
    assert asked.count("often") == 1
    assert tokens.word_encoder(path) is tokens.word_encoder(path)
