"""The n-gram join against all pairs, on small tables with groups of copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetally.llm import ngram_join
from wavetally.llm.components import star_components


def brute(rows, n=5, percent=75):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(5)
    return sorted((tuple(r) for r in ngram_join.components(df, **kw).collect()), key=repr)


def corpus(seed, groups=12, size=14, words=60, vocabulary=400):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    passage = [rnd.choice(vocab) for _ in range(30)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(8, words))]
        if rnd.random() < 0.4:
            base = passage + base[: rnd.randint(2, 20)]
        for _ in range(rnd.randint(1, size)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            if rnd.random() < 0.2:
                w = w[rnd.randint(0, 3) :] + [rnd.choice(vocab) for _ in range(rnd.randint(0, 4))]
            rows.append(" ".join(w))
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_other_thresholds_and_frequent_ngrams_as_rows(spark, monkeypatch):
    rows = corpus(3, groups=5)
    assert run(spark, rows, percent=60) == brute(rows, percent=60)
    monkeypatch.setattr(ngram_join, "HOT_BUCKET", 8)  # every n-gram seen twice goes the way of hot ones
    assert run(spark, rows) == brute(rows)


def test_hot_ngrams_are_spread_over_all_pieces(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_BUCKET", 0)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 50)
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{rnd.randrange(999)}" for _ in range(20))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    blocks = ngram_join.posting_blocks(df, 5, 75, spark.sparkContext.broadcast(np.zeros(1 << 16, np.uint8)), 16)
    held = {r["piece"]: r["b"] for r in blocks.groupBy("piece").agg(F.sum(F.length("grams")).alias("b")).collect()}
    assert set(held) == set(range(16, 32))
    assert max(held.values()) < 2 * sum(held.values()) / 16


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a b c"), (5, "A  b\tc"), (6, "a b"), (6, "a b"), (None, "a b"), (8, "x " * 3000), (9, "x " * 2000)]
    rows += [(10, "p q r s t u v w x"), (10, "other words that are here alone")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_star_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, 100 + i) for i in range(1, 60)]
    edges = spark.createDataFrame(chain + hub + [(7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in star_components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}}
    assert star_components(edges.limit(0), "a", "b").count() == 0


def test_a_hot_group_does_not_become_all_pairs(spark, monkeypatch):
    tried = []
    linked = ngram_join.linked
    monkeypatch.setattr(ngram_join, "linked", lambda p, f, t: tried.append(p.count()) or linked(p, f, t))
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"e{rnd.random()}"
        rows.append((i, " ".join(w)))
    got = run(spark, rows)
    assert {c for _, _, c in got} == {0}
    assert sum(tried) < 300 * 40


def test_marks_never_part_linked_sets_and_hold_off_long_ones(spark):
    rnd = np.random.default_rng(7)
    fresh = lambda n: rnd.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
    rows = []
    for n in (3, 40, 511, 512, 513, 1000, 1024, 1025, 5000):
        a = fresh(n)
        for keep, more in ((n, 0), (n, n // 3), (-(-3 * n // 4), 0), (n - n // 7, n // 7), (n // 2, n // 2)):
            b = np.concatenate([a[:keep], fresh(more)])
            rows.append((n, len(b), keep, ngram_join.mark_of(a), ngram_join.mark_of(b)))
        b = fresh(n + n // 4)
        rows.append((n, len(b), 0, ngram_join.mark_of(a), ngram_join.mark_of(b)))
    df = spark.createDataFrame(rows, "na long, nb long, common long, a array<long>, b array<long>")
    there = df.select("na", "nb", "common", ngram_join._may_reach("a", "na", "b", "nb", 75).alias("x"), ngram_join._may_reach("b", "nb", "a", "na", 75).alias("y"), ngram_join._may_reach("a", "na", "b", "nb", 20).alias("z"))
    for r in there.collect():
        assert r["x"] == r["y"]
        union = r["na"] + r["nb"] - r["common"]
        if 100 * r["common"] >= 75 * union:
            assert r["x"]
        if 100 * r["common"] >= 20 * union:
            assert r["z"]
        if r["common"] == 0 and r["na"] > 3:
            assert not r["x"]


def test_long_texts_against_all_pairs(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(12):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([400, 515, 900, 1500]))]
        for k in range(3):
            w = list(base)
            for _ in range(k * len(w) // 45):
                w[rnd.randrange(len(w))] = f"e{rnd.random()}"
            rows.append((len(rows), " ".join(w[: len(w) - k * len(w) // 20])))
    assert run(spark, rows) == brute(rows)


def test_a_pair_of_many_lists_is_offered_about_once(spark, monkeypatch):
    """Variants of one text share many long lists; a join by lists alone offers a pair once for each of them."""
    made = []
    crossing = ngram_join.crossing_pairs

    def counted(*args):
        pairs = crossing(*args)
        made.append((pairs.count(), pairs.distinct().count()))
        return pairs

    monkeypatch.setattr(ngram_join, "crossing_pairs", counted)
    monkeypatch.setattr(ngram_join, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "MOST_ROUNDS", 0)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(1 + i % 3):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows) == brute(rows)
    ((offered, different),) = made
    assert different > 500
    assert offered < 2 * different


def test_pairs_left_to_an_earlier_list_are_never_lost(spark, monkeypatch):
    for name, value in (("LEADER_ROUNDS", 0), ("MOST_ROUNDS", 0), ("SMALL_LIST", 1), ("FIRST_LISTS", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(11)
    assert run(spark, rows) == brute(rows)
