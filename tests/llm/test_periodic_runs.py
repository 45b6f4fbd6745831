"""Periodic runs against the plain diagonal table, one word at a time, over every earlier occurrence."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavetally.llm import periodic_runs as pr
from wavetally.llm import periodic_runs_query as prq
from wavetally.llm.words import Words


def plain(words, least=pr.LEAST, repeats=pr.REPEATS):
    """Match lengths of all lags, fed by every earlier occurrence; a run is reported when its lag is not fed."""
    places, active, out = defaultdict(list), {}, []
    for i, w in enumerate([*words, None]):
        fed = {i - j: active.get(i - j, 0) + 1 for j in places[w]} if i < len(words) else {}
        for p, n in active.items():
            if p not in fed and n + p >= max(least, repeats * p):
                out.append((i - n - p, n + p, p))
        places[w].append(i)
        active = fed
    smallest = lambda s, n, p: not any(all(words[k] == words[k + q] for k in range(s, s + n - q)) for q in range(1, p))
    return sorted((r for r in out if smallest(*r)), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(texts, least=pr.LEAST, repeats=pr.REPEATS):
    words = Words(pa.array(texts, pa.string()))
    owner, start, length, period = pr.find_runs(words.hashes(False), words.first, least, repeats)
    kept = pr.joined(words, pr.kept_words(words.first, owner, start, length, period)).to_pylist()
    for i, text in enumerate(texts):
        split = (text or "").split()
        want = plain(split, least, repeats)
        assert [(s, n, p) for o, s, n, p in zip(owner, start, length, period) if o == i] == want
        assert kept[i] == collapsed(split, want)


periodic = st.lists(
    st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 7)).map(lambda t: " ".join(t[0] * t[1])), max_size=6
).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), periodic, st.lists(st.sampled_from("ab"), max_size=60).map(" ".join)), max_size=5))
def test_runs_equal_the_plain_table(texts):
    check(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(periodic, max_size=3), st.integers(1, 12), st.integers(3, 6))
def test_other_bounds(texts, least, repeats):
    check(texts, least, repeats)


def test_long_periods_and_borders():
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(50)}" for _ in range(n)]
    texts = []
    for p in (1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31, 33):
        unit = some(p)
        for n in (4 * p - 1, 4 * p, 4 * p + 1, 5 * p):
            texts.append(" ".join([*some(5), *(unit * 6)[:n], *some(5)]))
            texts.append(" ".join((unit * 6)[:n]))
    check([*texts, "a a a a a", "a a a a a a", *["a a a"] * 3, "a b " * 7])


def test_two_repeats_are_refused():
    with pytest.raises(ValueError, match="three times"):
        pr.find_runs(np.zeros(0, np.uint64), np.zeros(1, np.int64), repeats=2)


def test_every_kind_of_row(spark):
    long = " ".join(f"w{i}" for i in range(200_000)) + " x y z" * 300_000  # above one block of text
    rows = [(1, "a b a b a b a b\tc", "p"), (1, "a b a b a b a b\tc", "p"), (None, "q " * 6, None), (2, None, "p"), (3, "", "p"), (4, " \n ", "p"),
            (5, long, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("_text", F.lit(7)).repartition(2)
    out = pr.collapse_runs(docs)
    assert out.columns == ["doc_id", "text", "_text", "runs", "collapsed"]
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert out.count() == len(rows)
    runs = lambda r: [tuple(x) for x in r["runs"]]
    assert (runs(got[1, rows[0][1]]), got[1, rows[0][1]]["collapsed"]) == ([(0, 8, 2)], "a b c")
    assert (runs(got[None, "q " * 6]), got[None, "q " * 6]["collapsed"]) == ([(0, 6, 1)], "q")
    for text in (None, "", " \n "):
        row = next(r for (_, t), r in got.items() if t == text)
        assert (row["runs"], row["collapsed"]) == ([], "")
    assert runs(got[5, long]) == [(200_000, 900_000, 3)]
    assert got[5, long]["collapsed"].endswith(" w199999 x y z")
    assert pr.collapse_runs(docs.limit(0)).count() == 0


def test_query_on_rows_of_every_kind(spark, tmp_path):
    rows = [(i, " ".join(f"v{(i * k) % 11}" for k in range(i % 90))) for i in range(300)] + [(None, "a " * 9), (7, None), (-5, "b c " * 5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {(r["doc_id"], r["text"]) for r in prq.with_repeats(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert (None, "a " * 9) in texts and (7, None) in texts
    out = prq.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    top = next(r for r in out if r["doc_id"] is None)
    assert (top["n_runs"], top["start"], top["length"], top["period"], top["exponent_milli"]) == (1, 0, 9, 1, 9000)
    assert next(r for r in out if r["doc_id"] == 7 and r["n_runs"] == 0)["start"] is None
