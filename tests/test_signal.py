"""Signal operators against direct numpy computations, with small slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetally.operators import q15_notch
from wavetally.operators import blocks, filters, generators, q15, spatial, spectral, tolerance, training, windows
from wavetally.plans import chain
from wavetally.sources import recording
from wavetally.streaming import signal as st


def make(spark, x, name="r"):
    rows = [(name, t, [float(v) for v in row]) for t, row in enumerate(x)]
    return spark.createDataFrame(rows, "recording_id string, t long, x array<double>").repartition(5)


def back(df, key="t"):
    rows = sorted(df.collect(), key=lambda r: r[key])
    return np.array([r["x"] for r in rows])


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((700, 3))
    x[rng.integers(0, 700, 20), rng.integers(0, 3, 20)] = np.nan
    return x


@pytest.fixture(scope="module")
def sig(spark, x):
    return make(spark, x).cache()


def naive_notch(x, f0=60.0, q=30.0, fs=160.0):
    b, a = filters.notch_coefficients(f0, q, fs)
    x = np.nan_to_num(x)
    y = np.zeros_like(x)
    for t in range(len(x)):
        y[t] = b[0] * x[t]
        for k in (1, 2):
            if t >= k:
                y[t] += b[k] * x[t - k] - a[k - 1] * y[t - k]
    return y


def test_fir_taps_design():
    taps = filters.fir_taps()
    assert len(taps) == 129 and np.allclose(taps, taps[::-1])
    assert abs(np.sum(taps * np.exp(-2j * np.pi * 19 / 160 * np.arange(129)))) == pytest.approx(1.0)


@pytest.mark.parametrize("length", [64, 200, 8192])
def test_fir_slices_agree(sig, x, length):
    want = np.stack([np.convolve(np.nan_to_num(x[:, c]), filters.fir_taps())[: len(x)] for c in range(3)], axis=1)
    assert np.allclose(back(blocks.apply_stages(sig, [filters.fir_stage()], length)), want, atol=1e-12)


def test_notch_constants():
    b, a = filters.notch_coefficients()
    assert b == pytest.approx((0.9621952458291035, 1.3607495663024323, 0.9621952458291035), abs=1e-14)
    assert a == pytest.approx((1.3607495663024323, 0.9243904916582071), abs=1e-14)
    for bad in ((0, 30, 160), (80, 30, 160), (60, 0, 160)):
        with pytest.raises(ValueError):
            filters.notch_coefficients(*bad)
    b, a = filters.notch_coefficients(50, 20, 160, "compat")
    assert b[0] == 1.0 and a[1] == pytest.approx(np.exp(-2 * np.pi * 50 / 20 / 160))


@pytest.mark.parametrize("length", [100, 8192])
def test_notch(sig, x, length):
    assert np.allclose(back(filters.notch_iir(sig, length=length)), naive_notch(x), atol=1e-12)


def test_notch_state_that_outlasts_slices(sig, x):
    got = back(filters.notch_iir(sig, q=5000.0, length=50))
    assert np.allclose(got, naive_notch(x, q=5000.0), atol=1e-10)


def test_many_recordings_one_long(spark, x):
    both = make(spark, x, "long").unionByName(make(spark, x[:90], "short"))
    got = filters.notch_iir(both, length=100)
    assert np.allclose(back(got.where("recording_id = 'short'")), naive_notch(x[:90]), atol=1e-12)
    assert np.allclose(back(got.where("recording_id = 'long'")), naive_notch(x), atol=1e-12)


def test_car_policies(spark):
    nan = float("nan")
    got = back(filters.car(make(spark, [[1.0, 3.0, nan], [nan, nan, nan]])))
    assert got.tolist() == [[-1.0, 1.0, 0.0], [0.0, 0.0, 0.0]]


def test_window_counts(spark):
    sig = make(spark, np.arange(24.0)[:, None])
    cut = windows.sliding_windows(sig, 16, 8)
    assert sorted({r["window_index"] for r in cut.collect()}) == [0, 1]
    assert cut.count() == 32
    assert windows.non_overlapping_windows(sig, 10).count() == 20
    assert windows.sliding_windows(sig, 30, 8).count() == 0
    for bad in ((0, 1), (4, 0), (4, 5)):
        with pytest.raises(ValueError):
            windows.sliding_windows(sig, *bad)


def test_replay_drops_partial_hop(spark):
    got = windows.cyclic_replay(make(spark, np.arange(10.0)[:, None]), 4, 2)
    assert back(got)[:, 0].tolist() == [0, 1, 2, 3, 4, 5, 6, 7] * 2


@pytest.mark.parametrize("length", [80, 8192])
def test_spectra(sig, x, length, monkeypatch):
    clean = np.nan_to_num(x)
    starts = range(0, 700 - 160 + 1, 80)
    z = np.stack([np.fft.rfft(clean[s : s + 160], axis=0) for s in starts])
    stage = spectral.fft_stage(160, 160.0, nan_to_zero=True)
    got = blocks.apply_windows(sig, stage, 160, 80, [], length).collect()
    power = {(r["window_index"], r["i"]): r["x"] for r in got}
    assert len(power) == len(starts) * 81
    assert np.allclose(power[(3, 17)], np.abs(z[3, 17]) ** 2)
    bands = blocks.apply_windows(sig, spectral.bandpower_stage(160, 160.0), 160, 80, [], length).collect()
    beta = {r["window_index"]: r["x"] for r in bands if r["band"] == "beta"}
    assert np.allclose(beta[2], (np.abs(z[2, 13:31]) ** 2).sum(axis=0))


def test_welch_of_a_sine(spark):
    t = np.arange(1024)
    sig = make(spark, (10 * np.sin(2 * np.pi * 20 * t / 160))[:, None])
    psd = spectral.welch_psd(sig, 1024, 1024, 160.0).collect()
    best = max(psd, key=lambda r: r["x"][0])
    assert best["freq_hz"] == 20.0
    assert sum(r["x"][0] for r in psd) * 160 / 256 == pytest.approx(50.0, rel=1e-6)
    for bad in ((100, 10), (256, 256), (0, 0)):
        with pytest.raises(ValueError):
            spectral.welch_stage(160, 160.0, *bad)


def test_bands_are_validated():
    for bad in ({"a": (13, 8)}, {"a": (8, 90)}, {"a": (8.0, 8.2)}):
        with pytest.raises(ValueError):
            spectral.band_bins(bad, 160, 160.0)
    with pytest.raises(ValueError):
        spectral.fft_stage(154, 160.0)


# ----------------------------------------------------------------- fixed point


def notch_q15_coefficients():
    b, a = filters.notch_coefficients(60, 30, 160, "compat")
    return [q15.as_q14(v) for v in (*b, *a)]


def naive_notch_q15(x, state=None):
    """One step at a time; x1, x2, y1, y2 before the first."""
    b0, b1, b2, a1, a2 = notch_q15_coefficients()
    x1, x2, y1, y2 = np.zeros((4, x.shape[1]), dtype=np.int64) if state is None else state
    out = np.empty_like(x)
    for n in range(len(x)):
        acc = b0 * x[n] + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
        x2, x1, y2, y1 = x1, x[n], y1, np.clip((acc + 8192) >> 14, -32768, 32767)
        out[n] = y1
    return (out, np.stack([x1, x2, y1, y2])) if state is not None else out


@pytest.mark.parametrize("warm", [0, 40, 1024])
def test_integer_notch_never_depends_on_the_guess(spark, warm):
    rng = np.random.default_rng(4)
    x = rng.integers(-20000, 20000, (700, 2))
    sig = make(spark, x).withColumn("x", F.col("x").cast("array<smallint>"))
    got = back(q15.notch_iir_q15(sig, length=90, warm=warm))
    assert (got == naive_notch_q15(x)).all()


@pytest.mark.parametrize("seed", range(8))
def test_integer_recursion_in_blocks_and_through_constant_input(seed):
    c, rng = notch_q15_coefficients(), np.random.default_rng(seed)
    n, k = int(rng.integers(1, 9000)), int(rng.integers(1, 5))
    x = rng.integers(-32768, 32768, (n, k))
    if seed % 2:
        x[n // 8 :] = rng.integers(-3, 4) * 1000
    state, other = rng.integers(-32768, 32768, (2, 4, k))
    y, end = naive_notch_q15(x, state)
    tried = [q15_notch.steps(x, state, c), q15_notch.side_by_side(x, state, c), q15_notch.side_by_side(x, state, c, 300, 100)]
    tried.append(q15_notch.mended(x, state, *naive_notch_q15(x, other), c))
    for got_y, got_end in tried:
        assert (got_y == y).all() and (got_end == end).all()
    for gap in (1, 5, 2047, 2049, 30011):
        assert (q15_notch.silence(state, gap, c) == naive_notch_q15(np.zeros((gap, k), dtype=np.int64), state)[1]).all()
    q15_notch.silence(state, 10**15, c)  # does not take longer


def test_integer_notch_rings_on_through_silent_slices(spark):
    """An impulse ends in a limit cycle; 64 silent slices behind it are mended in a few passes, whatever the slices guessed."""
    x = np.zeros((64 * 128, 3), dtype=np.int64)
    x[5] = [30000, -20000, 777]
    want = naive_notch_q15(x)
    assert (want[-1000:] != 0).any()
    sig = make(spark, x)
    out, passes = q15_notch.run_notch(sig, notch_q15_coefficients(), 128, 64)
    assert (back(out) == want).all() and passes <= 4


def test_integer_notch_runs_on_through_gaps(spark):
    """Missing samples and whole missing slices are silence without output rows."""
    rng = np.random.default_rng(1)
    x = rng.integers(-30000, 30000, (3000, 2))
    gone = np.zeros(3000, dtype=bool)
    gone[[7, 99, 100]] = gone[250:420] = gone[900:1900] = True
    x[gone] = 0
    rows = [("a", int(t), [float(v) for v in x[t]]) for t in np.flatnonzero(~gone)] + [("b", 5000, [1e4]), ("b", 5001, None)]
    sig = spark.createDataFrame(rows, "recording_id string, t long, x array<double>").withColumn("slice", F.lit("clash"))
    out = q15.notch_iir_q15(sig, length=100, warm=50)
    got = {r["t"]: r["x"] for r in out.where("recording_id = 'a'").collect()}
    want = naive_notch_q15(x)
    assert sorted(got) == np.flatnonzero(~gone).tolist()
    assert all(got[t] == want[t].tolist() for t in got)
    assert [(r["t"], r["x"]) for r in out.where("recording_id = 'b'").collect()] == [(5000, naive_notch_q15(np.array([[10000]]))[0].tolist())]
    assert q15.notch_iir_q15(sig.limit(0)).count() == 0


def test_q15_rounding(spark):
    vals = [0.5 / 32768, -0.5 / 32768, 1.0, -1.0, 2.0, -2.0, float("nan"), 0.49 / 32768]
    got = q15.quantize_signal(make(spark, [vals])).first()["x"]
    assert got == [1, -1, 32767, -32768, 32767, -32768, 0, 0]


# -------------------------------------------------------------------- training


def test_csp_separates_classes(spark):
    rng = np.random.default_rng(6)
    mix = rng.standard_normal((4, 4))
    scale = {0: [3, 1, 1, 0.3], 1: [0.3, 1, 1, 3]}
    x = np.concatenate([(rng.standard_normal((50, 4)) * scale[w % 2]) @ mix.T for w in range(20)])
    labels = spark.createDataFrame([(w, w % 2) for w in range(20)], "window_index long, label int")
    model = training.csp_calibrate(make(spark, x), labels, 50, 2)
    y = back(spatial.csp_apply(make(spark, x), model))
    var = [np.mean([y[w * 50 : w * 50 + 50].var(axis=0) for w in range(20) if w % 2 == c], axis=0) for c in (0, 1)]
    assert var[1][0] / var[0][0] > 20 and var[0][1] / var[1][1] > 20
    with pytest.raises(ValueError):
        training.csp_calibrate(make(spark, x), labels.withColumn("label", F.lit(1)), 50, 2)
    with pytest.raises(ValueError):
        training.csp_filters(np.eye(4), np.eye(4), 3)


def test_fastica_recovers_sources(spark):
    rng = np.random.default_rng(9)
    n = 4000
    t = np.arange(n)
    s = np.stack([np.sign(np.sin(t / 7.0)), rng.laplace(size=n), rng.uniform(-1, 1, n)], axis=1)
    s = (s - s.mean(0)) / s.std(0)
    x = s @ rng.standard_normal((3, 3)).T + [5, -3, 1]
    sig = make(spark, x)
    y = back(spatial.ica_apply(sig, training.fastica_calibrate(sig)))
    c = np.abs(np.corrcoef(y.T, s.T)[:3, 3:])
    assert (c.max(axis=1) > 0.98).all() and sorted(c.argmax(axis=1)) == [0, 1, 2]


def test_covariance_with_missing_samples(sig, x):
    centred = np.nan_to_num(x - np.nanmean(x, axis=0), nan=0.0)
    want = centred.T @ centred / len(x)
    for r in training.covariance(sig).collect():
        assert r["cov"] == pytest.approx(want[r["i"], r["j"]], rel=1e-10)


# ---------------------------------------------------------------------- chains


def test_chain_commutes_with_windowing(spark, sig, x):
    kernels = [chain.kernel("notch_iir"), chain.kernel("bandpass_fir"), chain.kernel("car"), chain.kernel("goertzel")]
    got = chain.kernel_chain(sig, kernels, 160, 80, channels=3, length=240)
    step = filters.car(filters.fir_bandpass(filters.notch_iir(sig)))
    want = spectral.goertzel_bandpower(step)
    key = ["window_index", "i"]
    a = {tuple(r[k] for k in key): r["x"] for r in got.collect()}
    b = {tuple(r[k] for k in key): r["x"] for r in want.collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-9, atol=1e-12) for k in a)


def test_chain_shapes(spark):
    model = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "component int, x array<double>")
    csp = chain.csp_kernel(model)
    assert chain.chain_shape_check([chain.kernel("fft"), chain.kernel("car")], 160, 3) == (81, 3)
    with pytest.raises(ValueError, match="does not fit csp"):
        chain.chain_shape_check([chain.kernel("car"), csp], 160, 3)
    with pytest.raises(ValueError):
        chain.chain_shape_check([], 160, 3)
    with pytest.raises(ValueError):
        chain.kernel("nothing")


def test_chain_status(spark, sig):
    whole, status = chain.kernel_chain_multi(
        sig, [("a b", [chain.kernel("car")]), ("a b", [chain.kernel("noop")]), ("none", []),
              ("bad", [chain.kernel("fft"), chain.kernel("bandpass_fir")])], channels=3)
    got = {r["chain"]: r["status"] for r in status.collect()}
    assert got["a_b"] == got["a_b-2"] == "ok" and got["none"].startswith("skipped") and got["bad"].startswith("failed")
    assert {r["chain"] for r in whole.select("chain").distinct().collect()} == {"a_b", "a_b-2"}


def test_chains_share_one_pass_and_fail_alone(spark, sig, x):
    def picky(w):
        if w[0, 0] > 0:
            raise ValueError("starts above zero")
        return w

    def broken(_):
        raise RuntimeError("broken")

    k = chain.kernel
    odd = blocks.Stage("odd", 0, broken)
    chains = [("power", [k("car"), k("goertzel")]), ("picky", [chain.register_kernel("test_picky", picky)]), ("spectrum", [k("fft")]),
              ("odd", [chain.Kernel("odd", odd), k("car")]), ("none", [])]
    whole, status = chain.kernel_chains(sig, chains, channels=3)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(recording_id") == 1
    rows = whole.collect()
    assert [r["status"] for r in status.collect()] == ["ok"] * 4 + ["skipped: no kernels"]
    got = {}
    for r in rows:
        got.setdefault(r["chain"], {})[r["window_index"], r["i"]] = r
    for name, kernels in (chains[0], chains[2]):
        want = {(r["window_index"], r["i"]): r for r in chain.kernel_chain(sig, kernels, channels=3).collect()}
        assert got[name].keys() == want.keys()
        assert all(np.allclose(got[name][key]["x"], want[key]["x"], equal_nan=True) and not got[name][key]["window_failed"] for key in want)
        assert all(got[name][key][c] == want[key][c] for key in want for c in ("band", "freq_hz") if c in want[key])
    index = sorted({key[0] for key in got["power"]})
    bad = [w for w in index if x[w * 80, 0] > 0]
    assert {key for key, r in got["picky"].items() if r["window_failed"]} == {(w, 0) for w in bad} and 0 < len(bad) < len(index)
    assert {r["failed_kernel"] for key, r in got["picky"].items() if r["window_failed"]} == {"test_picky"}
    assert len(got["picky"]) == len(bad) + 160 * (len(index) - len(bad))
    assert sorted(got["odd"]) == [(w, 0) for w in index] and {r["error"] for r in got["odd"].values()} == {"broken"}


def test_tolerance_treats_nan_as_mismatch(spark):
    nan, inf = float("nan"), float("inf")
    ddl = "plugin string, window_index long, i int, ch int, v double"
    a = spark.createDataFrame([("car", 0, 0, 0, nan), ("car", 0, 0, 1, inf), ("car", 0, 0, 2, 1.0)], ddl)
    r = tolerance.kernel_tolerance_check(a, a, tolerance.tolerance_table(spark)).first()
    assert (r["compared"], r["mismatches"], r["passed"]) == (3, 1, False)


# ----------------------------------------------------------- files, generators


def test_recording_file_with_partial_sample(spark, tmp_path):
    data = np.arange(33, dtype="<f4")
    (tmp_path / "rec.float32").write_bytes(data.tobytes())
    got = recording.read_float32(spark, str(tmp_path / "rec.float32"), 4, split_bytes=48)
    assert got.rdd.getNumPartitions() == 3
    assert back(got).ravel().tolist() == data[:32].tolist()
    assert {r["recording_id"] for r in got.collect()} == {"rec"}


def test_recording_round_trip(spark, tmp_path, x):
    clean = np.nan_to_num(x).astype("f4")
    both = make(spark, clean, "a").unionByName(make(spark, clean[:50], "b"))
    recording.write_float32(both, str(tmp_path / "out"))
    got = recording.read_float32(spark, str(tmp_path / "out"), 3, split_bytes=1000)
    assert np.array_equal(back(got.where("recording_id = 'a'")).astype("f4"), clean)
    assert got.where("recording_id = 'b'").count() == 50


def test_recording_files_need_no_shuffle(spark, tmp_path, x):
    clean = np.nan_to_num(x).astype("f4").astype(float)
    recording.write_float32(make(spark, clean, "a"), str(tmp_path / "out"))
    (tmp_path / "out" / "b.float32").write_bytes(clean[:300].astype("<f4").tobytes())
    files = recording.RecordingFiles(spark, str(tmp_path / "out"), 3, split_bytes=1200)
    out = blocks.apply_stages(files, [filters.fir_stage()], 100)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = back(filters.fir_bandpass(make(spark, clean)))
    assert np.allclose(back(out.where("recording_id = 'a'")), want, atol=1e-12)
    assert np.allclose(back(out.where("recording_id = 'b'")), want[:300], atol=1e-12)
    power = blocks.apply_windows(files, spectral.fft_stage(160, 160.0), 160, 80, [filters.car_stage()], 240)
    again = blocks.apply_windows(make(spark, clean, "a"), spectral.fft_stage(160, 160.0), 160, 80, [filters.car_stage()], 240)
    key = lambda df: {(r["window_index"], r["i"]): r["x"] for r in df.where("recording_id = 'a'").collect()}
    a, b = key(power), key(again)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_pink_noise(spark):
    ddl = "recording_id string, duration_s double, fs int, channels int, amplitude_uv_rms double, seed long"
    specs = spark.createDataFrame([("n", 51.2, 160, 2, 25.0, 42)], ddl)
    noise = generators.generate_pink_noise(specs)
    y = back(generators.widen(noise))
    assert y.shape == (8192, 2)
    assert np.allclose(np.sqrt((y**2).mean(axis=0)), 25.0) and np.allclose(y.mean(axis=0), 0, atol=1e-9)
    assert np.array_equal(y, back(generators.widen(generators.generate_pink_noise(specs))))
    power = np.abs(np.fft.rfft(y[:, 0])) ** 2
    f = np.arange(1, 4097)
    slope = np.polyfit(np.log(f[:4000]), np.log(power[1:4001]), 1)[0]
    assert slope == pytest.approx(-1.0, abs=0.1)
    with pytest.raises(Exception, match="samples"):
        generators.generate_pink_noise(specs.withColumn("duration_s", F.lit(0.05))).count()


# --------------------------------------------------------------------- streams


def shuffled_stream(spark, tmp_path, x, files=9, per_trigger=2):
    """Files in random order, samples of neighbours mixed."""
    rng = np.random.default_rng(1)
    part = rng.permutation(len(x)) % files
    for i in range(files):
        rows = [("r", int(t), [float(v) for v in x[t]]) for t in np.flatnonzero(part == i)]
        spark.createDataFrame(rows, "recording_id string, t long, x array<double>").coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
    return st.samples_from(spark, str(tmp_path), per_trigger)


def test_streams_equal_batch_in_any_order(spark, tmp_path, sig, x):
    stream = shuffled_stream(spark, tmp_path, x)
    assert np.allclose(back(st.drain(st.stream_fir(stream, length=150), "f")), back(filters.fir_bandpass(sig)), atol=1e-12)
    assert np.allclose(back(st.drain(st.stream_notch(stream, length=300), "n")), naive_notch(x), atol=1e-12)
    cut = st.drain(st.stream_sliding_windows(stream, 160, 80, length=240), "w")
    want = {(r["window_index"], r["i"]): r["x"] for r in windows.sliding_windows(sig, 160, 80).collect()}
    got = {(r["window_index"], r["i"]): r["x"] for r in cut.collect()}
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k], equal_nan=True) for k in got)


def test_recordings_of_different_channel_counts_do_not_mix(spark, tmp_path):
    from wavetally.sources.recording import write_float32

    rng = np.random.default_rng(5)
    data = {f"r{c}": rng.standard_normal((40, c)) for c in (1, 2, 3)}
    rows = [(n, t, x.tolist()) for t in range(40) for n, v in data.items() for x in [v[t]]]
    signal = spark.createDataFrame([*rows, ("r2", 40, None)], blocks.SIGNAL_DDL).coalesce(1)
    for op, want in (
        (filters.car, lambda x: x - x.mean(axis=1, keepdims=True)),
        (filters.fir_bandpass, lambda x: filters.causal_fir(x, filters.fir_taps())),
    ):
        got = {}
        for r in op(signal).collect():
            got.setdefault(r["recording_id"], {})[r["t"]] = r["x"]
        for name, x in data.items():
            assert np.allclose([got[name][t] for t in range(40)], want(x)), (op, name)
    write_float32(signal, str(tmp_path / "mixed"))
    for name, x in data.items():
        raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "mixed" / name).iterdir()))
        assert np.array_equal(np.frombuffer(raw, "<f4").reshape(-1, x.shape[1]), x.astype("f4"))
    changing = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [1.0, 2.0])], blocks.SIGNAL_DDL).coalesce(1)
    with pytest.raises(Exception, match="channel count changes"):
        filters.fir_bandpass(changing).count()


def test_infinite_samples_reach_their_outputs_only():
    x = np.zeros((400, 1))
    x[200] = np.inf
    y = filters.causal_fir(x, filters.fir_taps())
    assert np.isfinite(y[:200]).all() and np.isinf(y[201]).all() and np.isfinite(y[329:]).all()
    assert np.isfinite(filters.recursion(x, *filters.notch_coefficients())[:200]).all()


def test_windows_with_a_gap_are_left_out(spark):
    rows = [("r", t, [float(t)]) for t in range(64) if t != 10]
    signal = spark.createDataFrame(rows, blocks.SIGNAL_DDL)
    got = {r[0]: r[1] for r in windows.sliding_windows(signal, 16, 8).groupBy("window_index").count().collect()}
    assert got == {k: 16 for k in range(2, 7)}


def test_streams_pass_gaps_as_batch_does(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((900, 2))
    there = [t for t in range(900) if t != 100 and not 395 <= t < 420 and t != 899 - 300]
    rows = [("r", t, x[t].tolist()) for t in there]
    signal = spark.createDataFrame(rows, blocks.SIGNAL_DDL)
    order = sorted(rows, key=lambda r: r[1] // 90 + rng.random() * 0.3)
    for i in range(0, len(order), 110):  # files in time order, mixed a little; the last repeats samples long done
        late = order[:40] if i + 110 >= len(order) else []
        spark.createDataFrame(order[i : i + 110] + late, blocks.SIGNAL_DDL).coalesce(1).write.parquet(str(tmp_path / f"f{i:04d}"))
    stream = st.samples_from(spark, str(tmp_path), 2)
    key = lambda df: {r["t"]: r["x"] for r in df.collect()}
    want = key(filters.fir_bandpass(signal))
    kept = st.drain(st.stream_fir(stream, length=150, slack=250), "gap-fir")
    got = key(kept)
    assert kept.count() == len(got) == len(want) and all(np.allclose(got[t], want[t], atol=1e-12) for t in want)
    cut = st.drain(st.stream_sliding_windows(stream, 64, 32, length=128, slack=250), "gap-windows")
    index = lambda df: sorted(set(df.select("window_index", "i").collect()))
    assert index(cut) == index(windows.sliding_windows(signal, 64, 32)) and cut.count() == len(index(cut))
