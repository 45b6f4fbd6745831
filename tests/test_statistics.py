"""Small literal frames with known results."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetally.functions import special
from wavetally.functions.params import param_bool, param_float, param_int, param_string
from wavetally.operators import attribution as att
from wavetally.operators import compare, ordered, series, stats
from wavetally.operators import telemetry as tel
from wavetally.plans.reports import format_mean_ci
from wavetally.schemas import NOT_CHAINED


def frame(spark, values, plugin="k", warmup=0, start=0):
    rows = [(plugin, start + i, float(v), warmup) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "plugin string, window_index long, latency_us double, warmup int")


def test_latency_stats_excludes_warmup(spark):
    df = frame(spark, [10, 20, 30]).unionByName(frame(spark, [999], warmup=1))
    r = stats.latency_stats(df, "latency_us").first()
    assert (r["latency_us_mean"], r["latency_us_std"], r["sample_count"]) == (20.0, 10.0, 3)
    assert (r["latency_us_min"], r["latency_us_max"]) == (10.0, 30.0)


def test_nan_is_skipped(spark):
    r = stats.latency_stats(frame(spark, [1, float("nan"), 3]), "latency_us").first()
    assert (r["latency_us_mean"], r["latency_us_median"], r["sample_count"]) == (2.0, 2.0, 2)


def test_mean_ci(spark):
    df = frame(spark, [100, 200], "two").unionByName(frame(spark, [5], "one"))
    got = {r["plugin"]: r for r in stats.mean_ci(stats.latency_stats(df, "latency_us")).collect()}
    half = 12.706204736 * np.std([100, 200], ddof=1) / math.sqrt(2)
    assert got["two"]["latency_us_mean_ci_half"] == pytest.approx(half, rel=1e-8)
    assert got["one"]["latency_us_mean_ci_half"] is None


def test_unknown_deadline_counts_as_missed(spark):
    df = spark.createDataFrame([("k", 0, 0), ("k", 0, 1), ("k", 0, None), ("k", 1, 1)], "plugin string, warmup int, deadline_missed int")
    r = stats.deadline_miss_rate(df).first()
    assert (r["total_samples"], r["deadline_misses"]) == (3, 2)
    assert {x["overall"] for x in stats.check_deadline(df, 50.0).collect()} == {"FAIL"}


def chain(spark, stages=((0, "a", 100.0), (1, "b", 200.0)), windows=20):
    rows = [("r", p, w, s, lat, 0) for w in range(windows) for s, p, lat in stages]
    return spark.createDataFrame(rows, "run_id string, plugin string, window_index long, stage_index long, latency_us double, warmup int")


def test_chain(spark):
    df = chain(spark)
    got = {r["stage_index"]: r for r in stats.chain_stats(df).collect()}
    assert [round(got[s]["pct_contribution"], 1) for s in (0, 1)] == [33.3, 66.7]
    assert stats.chain_e2e(df).first()["e2e_mean"] == 300.0


def test_chain_skips_incomplete_windows(spark):
    df = chain(spark).where("not (window_index = 3 and stage_index = 1)")
    assert stats.chain_e2e(df).first()["complete_windows"] == 19


def test_chain_without_complete_windows(spark):
    df = chain(spark).where("stage_index = window_index % 2")
    assert tuple(stats.chain_e2e(df).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    unchained = chain(spark).withColumn("stage_index", F.lit(NOT_CHAINED).cast("long"))
    assert stats.chain_stats(unchained).count() == 0


def test_histogram_edges(spark):
    rows = [("flat", 0, 0, 1000)] * 5 + [("mostly", 0, 0, 1000)] * 199 + [("mostly", 0, 0, 9000)]
    df = spark.createDataFrame(rows, "plugin string, warmup int, start_ts_ns long, end_ts_ns long")
    got = {(r["plugin"], r["bin"]): r["n"] for r in stats.latency_histogram(df).collect()}
    assert {p for p, _ in got} == {"mostly"}
    assert len(got) == 20 and got[("mostly", 0)] == 199 and got[("mostly", 19)] == 1


def test_transitions_over_warmup_and_gaps(spark, monkeypatch):
    rows = [("r", "k", i, float(f), 10.0 * i, w) for i, (f, w) in enumerate([(1000, 0), (0, 0), (2000, 1), (1000, 0), (1500, 0)])]
    df = spark.createDataFrame(rows, "run_id string, plugin string, window_index long, freq_mhz double, latency_us double, warmup int")
    for limit in (0, 10**6):
        monkeypatch.setattr(ordered, "MAX_SORTED_ROWS", limit)
        got = series.freq_transitions(df).collect()
        assert [(r["window_index"], r["freq_before_mhz"], r["freq_after_mhz"], r["latency_delta_us"]) for r in got] == [(4, 1000, 1500, 10.0)]


# ------------------------------------------------------------------ comparison


def runs(spark, a, b):
    return frame(spark, a), frame(spark, b)


def verdict(spark, a, b):
    return compare.compare_runs(*runs(spark, a, b), value="latency_us").first()


def test_verdicts(spark):
    rng = np.random.default_rng(42)
    base = rng.normal(100, 5, 50)
    assert verdict(spark, base, base + 20)["verdict"] == "REGRESSED"
    assert verdict(spark, base, base - 20)["verdict"] == "IMPROVED"
    assert verdict(spark, base, base)["verdict"] == "NOISE"
    assert verdict(spark, base[:10], base[:10] + 50)["verdict"] == "LOW_N"


def test_welch_without_variance(spark):
    r = verdict(spark, [5.0] * 40, [7.0] * 40)
    assert (r["p_value"], r["cohens_d"], r["verdict"]) == (0.0, math.inf, "REGRESSED")
    r = verdict(spark, [5.0] * 40, [5.0] * 40)
    assert r["p_value"] is None and not r["significant"] and r["cohens_d"] is None


def test_disjoint_kernels(spark):
    assert compare.compare_runs(frame(spark, [1, 2], "a"), frame(spark, [1, 2], "b"), value="latency_us").count() == 0


def test_special_functions():
    # table values
    assert special.t_quantile(0.975, 1) == pytest.approx(12.7062047364, rel=1e-9)
    assert special.t_quantile(0.975, 30) == pytest.approx(2.0422724563, rel=1e-9)
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.0733880347, rel=1e-8)
    assert special.t_two_sided(1.5, 2e6) == pytest.approx(special.normal_two_sided(1.5), rel=1e-5)
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-12)
    assert special.kolmogorov_tail(1.3580986393) == pytest.approx(0.05, rel=1e-6)
    assert special.beta_inc(2.0, 3.0, 0.4) == pytest.approx(0.5248, rel=1e-12)


# ----------------------------------------------------------------- attribution


def tel_frame(spark, plugin, lat, freq=None, noise=None, cycles=None, stalls=None):
    n = len(lat)
    rows = [
        (plugin, i, 0, float(lat[i]), float(lat[i]), float(freq[i]) if freq is not None else 0.0,
         int(noise[i]) if noise is not None else 0, int(cycles[i]) if cycles is not None else 0,
         int(stalls[i]) if stalls is not None else 0, 0)
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "plugin string, window_index long, warmup int, latency_us double, kernel_latency_us double, freq_mhz double, "
        "osnoise_total_ns long, pmu_cycle_count long, pmu_backend_stall_cycles long, pmu_instruction_count long"
    )


def test_tail_verdicts(spark):
    flat, heavy = np.full(300, 100.0), np.concatenate([np.full(290, 100.0), np.full(10, 1000.0)])
    both = tel_frame(spark, "noop", flat).unionByName(tel_frame(spark, "k", heavy))
    r = att.tail_ratio(both).first()
    assert r["verdict"] == "algorithmic" and r["normalized_ratio"] == pytest.approx(10.0)
    r = att.tail_ratio(tel_frame(spark, "k", flat)).first()
    assert r["noop_tail_ratio"] is None and r["verdict"] == "platform-dominated"


def test_cohort_direction(spark):
    rng = np.random.default_rng(3)
    lat = rng.normal(100, 2, 400)
    lat[:30] += 200
    freq = np.where(lat > 200, 1000.0, 2000.0) + rng.integers(0, 5, 400)
    rows = att.stall_covariate(tel_frame(spark, "k", lat, freq=freq))
    r = att.cohort_compare(att.tail_cohorts(rows)).first()
    assert (r["covariate"], r["direction"]) == ("freq_mhz", "lower_in_tail")
    assert att.attribution_tier(rows).first()["tier"] == 2
    assert att.tail_cohorts(att.stall_covariate(tel_frame(spark, "k", lat[:150], freq=freq[:150]))).count() == 0


def test_shapley_adds_up_and_matches_least_squares(spark):
    rng = np.random.default_rng(11)
    n = 600
    freq, noise = rng.uniform(1000, 3000, n), rng.integers(0, 5000, n)
    cycles = rng.integers(1000, 2000, n)
    stalls = (cycles * rng.uniform(0, 0.5, n)).astype(int)
    lat = 1e5 / freq + np.log1p(noise) * 2 + 30 * stalls / cycles + rng.normal(0, 1, n)
    rows = att.stall_covariate(tel_frame(spark, "k", lat, freq, noise, cycles, stalls))
    x = np.column_stack([stalls / cycles, 1 / freq, np.log1p(noise)])

    def r2(cols):
        a = np.column_stack([np.ones(n), x[:, cols]])
        fit = a @ np.linalg.lstsq(a, lat, rcond=None)[0]
        return 1 - ((lat - fit) ** 2).sum() / ((lat - lat.mean()) ** 2).sum()

    got = att.ols_r2_subsets(rows).first()
    for name, cols in {"r2_1": [0], "r2_23": [1, 2], "r2_123": [0, 1, 2]}.items():
        assert got[name] == pytest.approx(r2(cols), rel=1e-6)
    s = att.shapley_r2(rows).first()
    total = sum(s[f"{c}_share"] for c in att.COVARIATES) + s["algorithmic_residual_pct"]
    assert total == pytest.approx(100.0, abs=1e-6)


def test_dependent_covariates(spark):
    n = 600
    rng = np.random.default_rng(2)
    cycles = np.full(n, 1000)
    stalls = rng.integers(0, 900, n)
    lat = 50 + stalls / 10 + rng.normal(0, 1, n)
    rows = att.stall_covariate(tel_frame(spark, "k", lat, np.full(n, 2000.0), np.zeros(n), cycles, stalls))
    r = att.ols_r2_subsets(rows).first()
    assert r["r2_2"] == 0.0 and r["r2_123"] == pytest.approx(r["r2_1"])
    s = att.shapley_r2(rows).first()
    assert s["osnoise_total_ns_share"] is None and s["freq_mhz_share"] == pytest.approx(0.0, abs=1e-9)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_rank_and_distribution_tests_on_ties(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "MAX_SORTED_ROWS", limit)
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 20, 300).astype(float), rng.integers(3, 25, 200).astype(float)
    rows = spark.createDataFrame([("k", float(v), True) for v in a] + [("k", float(v), False) for v in b], "g string, v double, f boolean")
    u = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
    assert att.mann_whitney_u(rows, ["g"], "v", F.col("f")).first()["u"] == u
    grid = np.unique(np.concatenate([a, b]))
    d = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert att.ks_two_sample(rows, ["g"], "v", F.col("f")).first()["d"] == pytest.approx(d)


# -------------------------------------------------------------- small helpers


def test_label_patterns(spark):
    def expand(text):
        df = spark.createDataFrame([(1, text)], "id int, p string")
        rows = tel.labels_from_pattern(df, "p", ["id"]).collect()
        return [r["label"] for r in sorted(rows, key=lambda r: r["window_index"])]

    assert expand("2x0, 3x1") == [0, 0, 1, 1, 1]
    assert expand("0x5,1x7") == [7]
    for bad in ("10", "ax0", "-1x0", "3x-1", "2x0,", "1x2x3"):
        with pytest.raises(Exception, match="bad label pattern"):
            expand(bad)
    labels = tel.labels_from_pattern(spark.createDataFrame([(1, "4x0")], "id int, p string"), "p", ["id"])
    tel.check_label_count(labels, 4)
    with pytest.raises(ValueError):
        tel.check_label_count(labels, 3)


def test_kernel_filter(spark):
    df = frame(spark, [1, 2], "car").unionByName(frame(spark, [3], "fft"))
    got = {r["plugin"]: r["list_position"] for r in tel.filter_kernels(df, " fft ,car,none").collect()}
    assert got == {"fft": 1, "car": 2}
    assert [r["plugin"] for r in tel.unknown_kernels(df, "fft,none").collect()] == ["none"]
    with pytest.raises(ValueError):
        tel.filter_kernels(df, " , ")


def test_kernel_params(spark):
    text = "f0_hz: 50.5\nQ = 30\nname: 'a b'\non=Yes&bad=1x, inf=inf"
    p = F.lit(text)
    r = spark.range(1).select(
        param_float(p, "f0_hz", 1.0), param_int(p, "Q", 1), param_string(p, "name", "x"), param_bool(p, "on", False),
        param_int(p, "bad", 7), param_float(p, "inf", 2.0), param_float(p, "missing", 3.0), param_bool(p, "name", True),
    ).first()
    assert tuple(r) == (50.5, 30, "a b", True, 7, 2.0, 3.0, True)


def test_mean_ci_text(spark):
    df = spark.createDataFrame([(100.0, 95.0, 105.0, 5.0), (7.25, None, None, None)], "m double, l double, u double, p double")
    got = [r[0] for r in df.select(format_mean_ci(F.col("m"), F.col("l"), F.col("u"), 1, F.col("p"))).collect()]
    assert got == ["100.0 ± 5.0 (5.0%)", "7.3"]


def test_choose_latency_column(spark):
    df = frame(spark, [1.0])
    assert tel.choose_latency_column(df) == "latency_us"
    assert tel.choose_latency_column(df.withColumn("kernel_latency_us", F.lit(None).cast("double"))) == "latency_us"
    assert tel.choose_latency_column(df.withColumn("kernel_latency_us", F.lit(2.0))) == "kernel_latency_us"


def test_failed_windows(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "warmup int, window_failed int")
    assert tel.filter_warmup(df).count() == 2
    assert tel.filter_warmup(df, exclude_failed=True).count() == 1


def test_scaling(spark):
    df = spark.createDataFrame([(256, 10.0, True), (1024, 40.0, True), (2048, 80.0, False)], "channels long, file_size_mb double, success boolean")
    r = stats.scaling_linearity(df).first()
    assert (r["channel_factor"], r["size_factor"], r["linearity_pct"], r["is_linear"]) == (8.0, 8.0, 100.0, True)
    assert stats.scaling_linearity(df.limit(1)).first()["linearity_pct"] is None


def test_kernel_names_survive_files(spark, tmp_path):
    from wavetally.sources import telemetry_files as files

    names = ["a+b", "100%", "x y", "p=q", "50%2B", "ä"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "plugin string, window_index long")
    files.write_telemetry_ndjson(df, str(tmp_path / "t"))
    got = {r["window_index"]: r["plugin"] for r in files.read_telemetry_ndjson(spark, str(tmp_path / "t")).collect()}
    assert got == dict(enumerate(names))


def test_filter_of_unknown_kernels_and_absent_baseline(spark):
    df = spark.createDataFrame([("r", "fft", 0, 5.0)], "run_id string, plugin string, warmup int, latency_us double")
    with pytest.raises(ValueError, match="no kernel matches"):
        tel.filter_kernels(df, "none,other")
    got = stats.condition_ratio(df, "base").collect()
    assert [(r["run_id"], r["ratio"]) for r in got] == [("r", None)]


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from wavetally.session import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, applicationId="x")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf={}, sparkContext=context))


def subsets_at_least(u, n1, n2):
    """Two-sided probability of a rank sum by going through all choices of ranks."""
    sums = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    far = max(u, n1 * n2 - u)
    return min(1.0, 2 * sum(s >= far for s in sums) / len(sums))


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (1, 7), (2, 5), (3, 3), (5, 6), (8, 8), (7, 4)])
def test_exact_rank_test_counts_all_choices(n1, n2):
    for u in range(0, n1 * n2 + 1, max(1, n1 * n2 // 9)):
        assert special.rank_test_exact(u, n1, n2) == pytest.approx(subsets_at_least(u, n1, n2), abs=1e-14)


def test_exact_rank_test_on_tabulated_values():
    # two-sided 5 % points of the table of critical values: the largest U with p <= 0.05
    for n1, n2, critical in [(5, 5, 2), (6, 6, 5), (7, 7, 8), (8, 8, 13), (5, 8, 6), (6, 8, 8), (7, 8, 10)]:
        assert special.rank_test_exact(critical, n1, n2) <= 0.05 < special.rank_test_exact(critical + 1, n1, n2)


def test_exact_rank_test_of_a_few_against_many():
    n = 10**9
    assert special.rank_test_exact(0, 1, n) == pytest.approx(2 / (n + 1))
    assert special.rank_test_exact(0, 8, n) == pytest.approx(2 / math.comb(n + 8, 8))
    # for so many the normal limit of eight uniform places is near in the middle
    u = int(8 * n / 2 + 1.0 * math.sqrt(8 * n * (n + 9) / 12))
    assert special.rank_test_exact(u, 8, n) == pytest.approx(special.normal_two_sided(1.0), abs=1e-2)


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (2, 3), (4, 4), (5, 3), (6, 5)])
def test_exact_distance_counts_all_ways(n1, n2):
    gaps = []
    for chosen in itertools.combinations(range(n1 + n2), n1):
        a, b, far = 0, 0, 0
        for k in range(n1 + n2):
            a, b = (a + 1, b) if k in chosen else (a, b + 1)
            far = max(far, abs(a * n2 - b * n1))
        gaps.append(far)
    for h in sorted(set(gaps)):
        assert special.distance_exact(h / (n1 * n2), n1, n2) == pytest.approx(sum(g >= h for g in gaps) / len(gaps), abs=1e-13)


def test_exact_distance_nears_its_limit():
    for d in (0.01, 0.02, 0.03):
        lam = math.sqrt(9000 * 10000 / 19000) * d
        assert special.distance_exact(d, 9000, 10000) == pytest.approx(special.kolmogorov_tail(lam), abs=0.02)
    assert special.distance_exact(1.0, 200, 200) == pytest.approx(2 / math.comb(400, 200), rel=1e-9)


def test_small_cohorts_take_exact_tests(spark):
    few, many = [1.0, 2.0, 3.5, 9.0], [2.5, 4.0, 5.0, 6.0, 7.0, 8.0]
    rows = [("a", v, True) for v in few] + [("a", v, False) for v in many] + [("t", v, True) for v in [*few, 9.0]] + [("t", v, False) for v in many]
    frame = spark.createDataFrame(rows, "g string, v double, f boolean")
    got = {r["g"]: r for r in att.mann_whitney_u(frame, ["g"], "v", F.col("f")).collect()}
    assert got["a"]["p_value"] == pytest.approx(subsets_at_least(got["a"]["u"], 4, 6))
    assert got["t"]["p_value"] == pytest.approx(special.normal_two_sided(got["t"]["z"]))
