"""Packing by least squares: the fit against a dense solver, the pieces against the tokenizers library."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavetally.llm import nnls_packing as m

WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("depth", [1, 2, 3])
@pytest.mark.parametrize("window", [1, 2, 8, 16])
def test_combinations_are_all_that_fill_a_window(window, depth):
    columns, filled = m.combinations(window, depth)
    got = sorted((w, tuple(filter(None, c))) for c, w in zip(columns.tolist(), filled.tolist()))
    want = []
    for w in (2**k for k in range(window.bit_length())):
        for d in range(1, depth + 1):
            want += [(w, c) for c in itertools.combinations_with_replacement(range(1, w + 1), d) if sum(c) == w]
    assert got == sorted(want)


def dense_error(a, b):
    """Least squared error over x >= 0, by projected gradients with momentum on the whole matrix."""
    x = y = np.zeros(a.shape[1])
    rate, t = 1 / np.linalg.norm(a, 2) ** 2, 1.0
    for _ in range(20_000):
        new = np.maximum(0, y - rate * (a.T @ (a @ y - b)))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return ((a @ x - b) ** 2).sum()


@pytest.mark.parametrize("seed", range(6))
def test_fit_reaches_the_least_error(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 100, 17) * (rng.random(17) < 0.7)
    columns, _ = m.combinations(16)
    a = np.zeros((17, len(columns)))
    np.add.at(a, (columns, np.arange(len(columns))[:, None]), 1)
    a[0], counts[0] = 0, 0
    x = m.nnls(columns, counts, least_gain=0)
    assert (x >= 0).all()
    least = dense_error(a, counts.astype(float))
    assert ((a @ x - counts) ** 2).sum() <= least + 2e-3 * max(1.0, least) + 1e-6 * (counts**2).sum()


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_document_once(seed):
    rng = np.random.default_rng(seed)
    size = int(2 ** rng.integers(0, 8))
    counts = rng.integers(0, [2, 9, 400][seed % 3], size + 1) * (rng.random(size + 1) < rng.random())
    counts[0] = 0
    plan = m.solve(counts, size)
    held = defaultdict(list)
    keys = list(zip(plan.length.tolist(), plan.number.tolist()))
    for length in range(1, size + 1):
        for n in range(counts[length]):
            if n < plan.taken[length]:
                k = max(i for i, (g, f) in enumerate(keys) if g == length and f <= n)
                w, at = int(plan.filled[k]), int(plan.window[k] + n - plan.number[k])
                per = size // w
                held[plan.first_sequence[w] + at // per].append((at % per * w + int(plan.inside[k]), length))
            else:
                at = int(plan.behind[length] + (n - plan.taken[length]) * length)
                pieces = m.cuts(plan, at, at + length)
                assert sum(b - a for a, b, _, _ in pieces) == length
                for a, b, s, o in pieces:
                    held[s].append((o, b - a))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == size or at & (at - 1) == 0
    assert sum(n for pieces in held.values() for _, n in pieces) == int((counts * np.arange(size + 1)).sum())
    assert sum(sum(n for _, n in pieces) < size for pieces in held.values()) <= size.bit_length()


def test_counts_of_any_size_fit_whole():
    counts = np.zeros(65, np.int64)
    counts[1:] = 10**12 // np.arange(1, 65)
    plan = m.solve(counts, 64)
    assert plan.taken.sum() >= 0.999 * counts.sum()


def test_lengths_and_depths_are_checked():
    with pytest.raises(ValueError, match="power of two"):
        m.combinations(12)
    with pytest.raises(ValueError, match="one to three"):
        m.combinations(8, 4)


@pytest.mark.parametrize("size", [8, 64, 2048])
def test_pieces_hold_every_id_once_without_padding(spark, size):
    texts = [None, "", "a", "same text", "same text", "x " * 1000, "Long " * 5001, *[f"w{i} " * (i % 37) for i in range(300)]]
    texts.append("block " * 400_000)  # above one block of text
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, "seven"), (7, "seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("row", F.lit("clash")).withColumn("length", F.lit(0)).withColumn("task", F.lit(None).cast("int")).repartition(5)
    got = m.pack_by_histogram(docs, WORD, size, end_id=1).collect()
    tokenizer = Tokenizer.from_file(WORD)
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    assert sum(r["length"] for r in got) == sum(len(i) for ids in want.values() for i in ids)
    for d, same in want.items():
        mine = [r for r in got if r["doc_id"] == d]
        if len(same) == 1:
            ids, at = same[0], 0
            for r in sorted(mine, key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"]) == (at, len(ids))
                assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids)
        else:
            by_length = {len(i): i for i in same}
            assert all(zlib.crc32(by_length[r["doc_tokens"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in mine)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == size or at & (at - 1) == 0
    assert m.pack_by_histogram(docs.limit(0), WORD, size).count() == 0
