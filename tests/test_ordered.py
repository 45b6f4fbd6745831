"""Order statistics, with the paths for groups beyond one task forced."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetally.operators import ordered


@pytest.fixture
def forced(monkeypatch):
    def force(sorted_rows=0, broadcast_rows=100_000):
        monkeypatch.setattr(ordered, "MAX_SORTED_ROWS", sorted_rows)
        monkeypatch.setattr(ordered, "MAX_BROADCAST_ROWS", broadcast_rows)

    return force


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    one = np.concatenate([rng.lognormal(3, 2, 3000), np.full(2000, 7.25), -rng.lognormal(1, 1, 500), [0.0, 1e300, -1e-300]])
    tight = 1000.0 + rng.random(2500) * 1e-6
    return {"one": one, "tight": tight, "lone": np.array([4.5])}


@pytest.fixture(scope="module")
def rows(spark, values):
    data = [(g, float(v)) for g, vs in values.items() for v in vs] + [("one", float("nan")), ("one", None)]
    return spark.createDataFrame(data, "g string, v double").repartition(7).cache()


PROBS = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("limit", [0, 50, 10**6])
@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_linear_percentiles(rows, values, forced, limit, broadcast):
    forced(limit, broadcast)
    got = {r["g"]: r for r in ordered.exact_percentiles(rows, ["g"], "v", PROBS).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        for alias, p in PROBS.items():
            assert got[g][alias] == pytest.approx(np.percentile(vs, p * 100), rel=1e-12, abs=1e-12)


def test_paths_agree_to_the_last_bit(spark, forced, values):
    rng = np.random.default_rng(9)
    data = {**values, "many": rng.lognormal(1, 1, 5000), "inf": np.append(rng.random(9), np.inf), "infs": np.array([-np.inf, 1.0, np.inf, np.inf])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double").repartition(5)
    probs = {f"p{i}": i / 20 for i in range(21)}
    found = []
    for limit in (0, 10**6):
        forced(limit)
        found.append({r["g"]: [np.float64(r[a]).tobytes() for a in probs] for r in ordered.exact_percentiles(df, ["g"], "v", probs).collect()})
    assert found[0] == found[1]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_index_percentiles(rows, values, forced, limit):
    forced(limit)
    got = {r["g"]: r for r in ordered.exact_percentiles(rows, ["g"], "v", PROBS, rule="index").collect()}
    for g, vs in values.items():
        for alias, p in PROBS.items():
            assert got[g][alias] == np.sort(vs)[min(int(p * len(vs)), len(vs) - 1)]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_percentiles_of_everything_with_aggregates(rows, values, forced, limit):
    forced(limit)
    n = F.count(F.when(~F.isnan("v"), F.col("v"))).alias("n")
    got = ordered.exact_percentiles(rows, [], "v", {"p50": 0.5}, aggs=[n]).collect()
    every = np.concatenate(list(values.values()))
    assert len(got) == 1 and got[0]["n"] == len(every)
    assert got[0]["p50"] == pytest.approx(np.median(every), rel=1e-12)


def test_golden_percentiles(spark, forced):
    df = spark.range(1, 101).select(F.lit("k").alias("g"), F.col("id").alias("v"))
    for limit in (0, 10**6):
        forced(limit)
        r = ordered.exact_percentiles(df, ["g"], "v", {"p95": 0.95, "p99": 0.99}).first()
        assert (round(r["p95"], 6), round(r["p99"], 6)) == (95.05, 99.01)


@pytest.mark.parametrize("largest", [0, 10**9])
def test_running_counts(rows, values, forced, largest):
    forced(5)
    clean = rows.where("v is not null and not isnan(v)")
    counts = clean.groupBy("g", "v").agg(F.count("*").alias("n"))
    sizes = ordered.GroupSizes(3, largest)
    got = ordered.running_counts(counts, ["g"], "v", ["n"], sizes).collect()
    for g, vs in values.items():
        mine = [r for r in got if r["g"] == g]
        assert sum(r["n"] for r in mine) == len(vs)
        ordered_values = np.sort(vs)
        for r in mine[::37]:
            assert r["n_before"] == np.searchsorted(ordered_values, r["v"], "left")
            assert r["n_total"] == len(vs)


def test_number_rows_and_previous_values(spark, forced):
    rng = np.random.default_rng(1)
    data = [(g, int(o), float(i)) for g in "ab" for i, o in enumerate(rng.choice(10_000, 400, replace=False))]
    df = spark.createDataFrame(data, "g string, o long, v double")
    numbered = ordered.number_rows(df, ["g"], "o", "k", span=64).collect()
    forced(0)
    previous = {(r["g"], r["o"]): r["pv"] for r in ordered.previous_values(df, ["g"], "o", {"v": "pv"}, span=64).collect()}
    for g in "ab":
        mine = sorted((o, v) for gg, o, v in data if gg == g)
        assert {r["o"]: r["k"] for r in numbered if r["g"] == g} == {o: k for k, (o, _) in enumerate(mine)}
        assert previous[(g, mine[0][0])] is None
        assert all(previous[(g, mine[i][0])] == mine[i - 1][1] for i in range(1, len(mine)))


def test_repeat_rows_in_blocks(spark):
    df = spark.createDataFrame([("a", 25), ("b", 1), ("c", 10)], "g string, n long")
    got = ordered.repeat_rows(df, "n", "i", ["g"], block=10).groupBy("g").agg(F.sort_array(F.collect_list("i")).alias("s"))
    assert {r["g"]: r["s"] for r in got.collect()} == {"a": list(range(1, 26)), "b": [1], "c": list(range(1, 11))}


def test_broadcast_only_when_small(spark, forced):
    df = spark.range(50)
    forced(0, 10)
    assert ordered.small_table(df, 10) is None
    assert ordered.broadcast_if_small(df) is df
    assert ordered.small_table(df, 50).count() == 50
