"""Signals: windows, filters, spectra, spatial filters, fixed point, training."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wavetally.functions.fixedpoint import dequantize_q15, q15_mul, q15_sat_add, q15_sat_sub
from wavetally.operators import filters, generators, q15, spatial, spectral, tolerance, training, windows
from wavetally.plans.estimators import Ica
from wavetally.testbed import tables
from wavetally.testbed.registry import query, r, rounded
from wavetally.testbed.tables import F3, F3_NAN

W, H = tables.LENGTH, tables.HOP
LAST = "(SELECT max(t) + 1 FROM sig)"


def sig(spark, d, nan=False):
    return tables.signal(spark, d, nan)


def flat(df):
    """Long rows without the recording name, for comparison."""
    return rounded(windows.long_form(df.drop("recording_id")))


def win_sql(source: str = "sig", W: int = W, H: int = H, name: str = "win") -> str:
    return f"""{name} AS (SELECT k AS window_index, CAST(t - k * {H} AS INTEGER) AS i, CAST(ch AS INTEGER) AS ch, v
      FROM {source}, (SELECT unnest(range(0, ({LAST} - {W}) // {H} + 1)) AS k) WHERE t >= k * {H} AND t < k * {H} + {W})"""


SIG_OUT = f"SELECT t, CAST(ch AS INTEGER) AS ch, {r('v', 'v')}"

# -------------------------------------------------------------------- windows


@query("sliding_windows", f"WITH {F3}, {win_sql()} SELECT window_index, i, ch, {r('v', 'v')} FROM win")
def _(spark, d):
    return flat(windows.sliding_windows(sig(spark, d), W, H))


@query("flush_windows", f"WITH {F3}, {win_sql()} SELECT window_index, i, ch, {r('v', 'v')} FROM win WHERE window_index >= 2")
def _(spark, d):
    return flat(windows.flush_windows(sig(spark, d), W, H, 250))


@query("non_overlapping_windows", f"WITH {F3}, {win_sql(H=W)} SELECT window_index, i, ch, {r('v', 'v')} FROM win")
def _(spark, d):
    return flat(windows.non_overlapping_windows(sig(spark, d), W))


@query(
    "cyclic_replay",
    f"""WITH {F3}, n AS (SELECT {LAST} // 80 * 80 AS n) SELECT c * n + t AS t, CAST(ch AS INTEGER) AS ch, {r('v', 'v')}
    FROM sig, n, (SELECT unnest(range(3)) AS c) WHERE t < n""",
)
def _(spark, d):
    return flat(windows.cyclic_replay(sig(spark, d), H, 3))


# -------------------------------------------------------------------- filters


@query("noop", f"WITH {F3} {SIG_OUT} FROM sig")
def _(spark, d):
    return flat(filters.noop(sig(spark, d)))


CAR_SQL = f"""WITH {F3_NAN}, m AS (SELECT t, avg(v) FILTER (NOT isnan(v)) AS m FROM sig GROUP BY t),
    car AS (SELECT t, ch, CASE WHEN isnan(v) THEN 0 ELSE v - coalesce(m, 0) END AS v FROM sig JOIN m USING (t))"""


@query("car", f"{CAR_SQL} {SIG_OUT} FROM car")
def _(spark, d):
    return flat(filters.car(sig(spark, d, nan=True)))


# Windowed-sinc band-pass, 8-30 Hz at 160 Hz, 129 taps, Hamming, unit gain at 19 Hz.
TAPS = """ideal AS (SELECT k, k - 64 AS m, CASE WHEN k = 64 THEN 0.375::DOUBLE - 0.1::DOUBLE ELSE
      (sin(pi() * 0.375::DOUBLE * (k - 64)) - sin(pi() * 0.1::DOUBLE * (k - 64))) / (pi() * (k - 64)) END
      * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * k / 128)) AS h FROM (SELECT unnest(range(129)) AS k)),
    taps AS (SELECT k, h / (SELECT sum(h * cos(pi() * m * 0.2375::DOUBLE)) FROM ideal) AS b FROM ideal)"""
CLEAN = "clean AS (SELECT t, ch, CASE WHEN isnan(v) THEN 0 ELSE v END AS v FROM sig)"
FIR = f"""fir AS (SELECT s.t + k AS t, s.ch, sum(b * v) AS v FROM clean s, taps WHERE s.t + k < {LAST} GROUP BY ALL)"""


@query("fir_bandpass", f"WITH {F3_NAN}, {CLEAN}, {TAPS}, {FIR} {SIG_OUT} FROM fir")
def _(spark, d):
    return flat(filters.fir_bandpass(sig(spark, d, nan=True)))


def notch_sql(source: str, name: str = "notch") -> str:
    return f"""co AS (SELECT g AS b0, -2 * g * c AS b1, -2 * g * c AS a1, 2 * g - 1 AS a2 FROM (
        SELECT 1 / (1 + tan(2 * pi() * 60 / 160 / 30 / 2)) AS g, cos(2 * pi() * 60 / 160) AS c)),
    rec AS (SELECT t, ch, b0 * v AS y0, 0.0::DOUBLE AS y1, v AS x0, 0.0::DOUBLE AS x1 FROM {source}, co WHERE t = 0
      UNION ALL SELECT s.t, s.ch, b0 * s.v + b1 * p.x0 + b0 * p.x1 - a1 * p.y0 - a2 * p.y1, p.y0, s.v, p.x0
      FROM rec p JOIN {source} s ON s.t = p.t + 1 AND s.ch = p.ch, co),
    {name} AS (SELECT t, ch, y0 AS v FROM rec)"""


@query("notch_iir", f"WITH RECURSIVE {F3_NAN}, {CLEAN}, {notch_sql('clean')} {SIG_OUT} FROM notch")
def _(spark, d):
    return flat(filters.notch_iir(sig(spark, d, nan=True)))


@query(
    "notch_iir_window_replay",
    f"""WITH RECURSIVE {F3}, {win_sql()}, laid AS (SELECT window_index * {W} + i AS t, ch, v FROM win), {notch_sql('laid')}
    SELECT t // {W} AS window_index, CAST(t % {W} AS INTEGER) AS i, ch, {r('v', 'v')} FROM notch""",
)
def _(spark, d):
    cut = windows.sliding_windows(sig(spark, d), W, H)
    return flat(filters.notch_iir(cut, mode="window_replay", W=W))


# -------------------------------------------------------------------- spectra

DFT = """SELECT window_index, ch, k, sum(v * cos(2 * pi() * k * i / {n})) AS re, sum(v * sin(2 * pi() * k * i / {n})) AS im
    FROM {src}, (SELECT unnest(range({lo}, {hi})) AS k) GROUP BY ALL"""


def bandpower_sql(src: str) -> str:
    return f"""dft AS ({DFT.format(n=W, src=src, lo=8, hi=31)}),
    bands AS (SELECT unnest(['alpha', 'beta']) AS band, unnest([0, 1]) AS i, unnest([8, 13]) AS lo, unnest([13, 30]) AS hi)
    SELECT window_index, CAST(b.i AS INTEGER) AS i, band, ch, {r('sum(re * re + im * im)', 'v')}
    FROM dft, bands b WHERE k BETWEEN lo AND hi GROUP BY ALL"""


@query("goertzel_bandpower", f"WITH {F3}, {win_sql()}, {bandpower_sql('win')}")
def _(spark, d):
    return flat(spectral.goertzel_bandpower(sig(spark, d)))


@query(
    "fft_magsq",
    f"""WITH {F3}, {win_sql()}, dft AS ({DFT.format(n=W, src='win', lo=0, hi=81)})
    SELECT window_index, CAST(k AS INTEGER) AS i, k::DOUBLE AS freq_hz, ch, {r('re * re + im * im', 'v')} FROM dft""",
)
def _(spark, d):
    return flat(spectral.fft_magsq(sig(spark, d)))


def welch_sql(src: str, seg: int, n_fft: int, step: int) -> str:
    return f"""hann AS (SELECT j, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / {seg}) AS h FROM (SELECT unnest(range({seg})) AS j)),
    seg AS (SELECT window_index, s, j, ch, v * h AS v FROM {src}, hann, (SELECT unnest(range(0, {W - seg + 1}, {step})) AS s) WHERE i = s + j),
    dft AS (SELECT window_index, s, ch, k, sum(v * cos(2 * pi() * k * j / {n_fft})) AS re, sum(v * sin(2 * pi() * k * j / {n_fft})) AS im
      FROM seg, (SELECT unnest(range(0, {n_fft // 2 + 1})) AS k) GROUP BY ALL)
    SELECT window_index, CAST(k AS INTEGER) AS i, k * {160 / n_fft}::DOUBLE AS freq_hz, ch,
      {r(f"avg((re * re + im * im) * CASE WHEN k IN (0, {n_fft // 2}) THEN 1 ELSE 2 END) / (160 * (SELECT sum(h * h) FROM hann))", "v", 8)}
    FROM dft GROUP BY window_index, k, ch"""


def _flat8(df):
    return rounded(windows.long_form(df.drop("recording_id")), 8)


@query("welch_psd", f"WITH {F3}, {win_sql()}, {welch_sql('win', 160, 256, 32)}")
def _(spark, d):
    return _flat8(spectral.welch_psd(sig(spark, d)))


@query("welch_psd_segments", f"WITH {F3}, {win_sql()}, {welch_sql('win', 64, 64, 32)}")
def _(spark, d):
    return _flat8(spectral.welch_psd(sig(spark, d), n_fft=64, n_overlap=32))


# ------------------------------------------------------------- spatial filters


def csp_model(spark):
    rows = [(c, [math.cos((c + 1) * (ch + 1) * 0.1) / 8 for ch in range(64)]) for c in range(4)]
    return spark.createDataFrame(rows, "component int, x array<double>")


def ica_model(spark):
    mean = [0.01 * math.sin(ch + 1) for ch in range(64)]
    rows = [(i, [math.cos((i + 1) * (ch + 1) * 0.1) / 8 for ch in range(64)], mean) for i in range(64)]
    return spark.createDataFrame(rows, "row int, weights array<double>, mean array<double>")


COMP = "(SELECT unnest(range({n})) AS c)"


@query(
    "csp_apply",
    f"""WITH {F3_NAN}, {CLEAN} SELECT t, CAST(c AS INTEGER) AS ch, {r('sum(v * cos((c + 1) * (ch + 1) * 0.1::DOUBLE) / 8)', 'v')}
    FROM clean, {COMP.format(n=4)} GROUP BY t, c""",
)
def _(spark, d):
    return flat(spatial.csp_apply(sig(spark, d, nan=True), csp_model(spark)))


@query(
    "ica_apply",
    f"""WITH {F3_NAN}, {CLEAN} SELECT t, CAST(c AS INTEGER) AS ch,
      {r('sum((v - 0.01::DOUBLE * sin(ch + 1)) * cos((c + 1) * (ch + 1) * 0.1::DOUBLE) / 8)', 'v')}
    FROM clean, {COMP.format(n=64)} GROUP BY t, c""",
)
def _(spark, d):
    return flat(spatial.ica_apply(sig(spark, d, nan=True), ica_model(spark)))


# ---------------------------------------------------------------- fixed point


def q15_sql(expr: str) -> str:
    b = f"greatest(least(({expr}) * 32768, 32767), -32768)"
    return f"CAST(CASE WHEN isnan({expr}) THEN 0 WHEN {b} >= 0 THEN floor({b} + 0.5) ELSE ceil({b} - 0.5) END AS BIGINT)"


SAT = "greatest(least({0}, 32767), -32768)"
QSIG = f"qsig AS (SELECT t, ch, {q15_sql('v * 4')} AS v FROM sig)"
Q_OUT = "SELECT t, CAST(ch AS INTEGER) AS ch, CAST(v AS BIGINT) AS v"


def qsig(spark, d, nan=False):
    return q15.quantize_signal(sig(spark, d, nan), 4.0)


def qflat(df):
    return windows.long_form(df.drop("recording_id")).withColumn("v", F.col("v").cast("long"))


@query("quantize_q15", f"WITH {F3_NAN}, {QSIG} {Q_OUT} FROM qsig")
def _(spark, d):
    return qflat(qsig(spark, d, nan=True))


@query("dequantize_q15", f"WITH {F3_NAN}, {QSIG} SELECT t, CAST(ch AS INTEGER) AS ch, {r('v / 32768', 'v', 9)} FROM qsig")
def _(spark, d):
    long = qflat(qsig(spark, d, nan=True))
    return rounded(long.withColumn("v", dequantize_q15(F.col("v"))), 9)


def _pairs_sql(expr: str) -> str:
    return f"""WITH {F3}, {QSIG}, p AS (SELECT t, ch, v AS a, lead(v) OVER (PARTITION BY t ORDER BY ch) AS b FROM qsig)
    SELECT t, CAST(ch AS INTEGER) AS ch, {SAT.format(expr)} AS v FROM p WHERE b IS NOT NULL"""


def _pairs(spark, d, op):
    """A Q15 operation on every pair of neighbouring channels."""
    x = F.col("x")
    out = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), op)
    return qflat(qsig(spark, d).withColumn("x", out))


@query("q15_sat_add", _pairs_sql("a + b"))
def _(spark, d):
    return _pairs(spark, d, q15_sat_add)


@query("q15_sat_sub", _pairs_sql("a - b"))
def _(spark, d):
    return _pairs(spark, d, q15_sat_sub)


@query("q15_mul", _pairs_sql("(a * b + 16384) >> 15"))
def _(spark, d):
    return _pairs(spark, d, q15_mul)


@query("noop_q15", f"WITH {F3}, {QSIG} {Q_OUT} FROM qsig")
def _(spark, d):
    return qflat(q15.noop_q15(qsig(spark, d)))


@query(
    "car_q15",
    f"""WITH {F3}, {QSIG}, m AS (SELECT t, CAST(trunc(sum(v)::DOUBLE / count(*)) AS BIGINT) AS m FROM qsig GROUP BY t)
    SELECT t, CAST(ch AS INTEGER) AS ch, {SAT.format('v - m')} AS v FROM qsig JOIN m USING (t)""",
)
def _(spark, d):
    return qflat(q15.car_q15(qsig(spark, d)))


ROUND30 = SAT.format("(CAST({0} AS BIGINT) + 16384) >> 15")


@query(
    "fir_bandpass_q15",
    f"""WITH {F3}, {QSIG}, {TAPS}, qt AS (SELECT k, {q15_sql('b')} AS b FROM taps)
    SELECT s.t + k AS t, CAST(s.ch AS INTEGER) AS ch, {ROUND30.format('sum(b * v)')} AS v FROM qsig s, qt WHERE s.t + k < {LAST} GROUP BY ALL""",
)
def _(spark, d):
    return qflat(q15.fir_bandpass_q15(qsig(spark, d)))


NOTCH_Q15 = f"""rec AS (
      SELECT t, ch, {SAT.format('(15765 * v + 8192) >> 14')} AS y0, 0::BIGINT AS y1, v AS x0, 0::BIGINT AS x1 FROM qsig WHERE t = 0
      UNION ALL SELECT s.t, s.ch, {SAT.format('(15765 * s.v + 22295 * p.x0 + 15765 * p.x1 - 22295 * p.y0 - 15145 * p.y1 + 8192) >> 14')},
        p.y0, s.v, p.x0 FROM rec p JOIN qsig s ON s.t = p.t + 1 AND s.ch = p.ch)
    SELECT t, CAST(ch AS INTEGER) AS ch, y0 AS v FROM rec"""


@query("notch_iir_q15", f"WITH RECURSIVE {F3}, {QSIG}, {NOTCH_Q15}")
def _(spark, d):
    return qflat(q15.notch_iir_q15(qsig(spark, d), length=256, warm=128))


# The same recording silent from its tenth sample on: the filter rings on in limit cycles through slices that guess silence.
@query("notch_iir_q15_silence", f"WITH RECURSIVE {F3}, {QSIG.replace('AS v FROM', '* CAST(t < 10 AS BIGINT) AS v FROM')}, {NOTCH_Q15}")
def _(spark, d):
    rows = qsig(spark, d)
    silent = rows.withColumn("x", F.transform("x", lambda v: F.when(F.col("t") < 10, v).otherwise(F.lit(0).cast("smallint"))))
    return qflat(q15.notch_iir_q15(silent, length=8, warm=4))


@query(
    "goertzel_q15",
    f"""WITH RECURSIVE {F3}, {QSIG}, {win_sql('qsig')},
    co AS (SELECT k, CAST(greatest(least(round(2 * cos(2 * pi() * k / 160) * 16384), 32767), -32768) AS BIGINT) AS c
      FROM (SELECT unnest(range(8, 31)) AS k)),
    rec AS (SELECT window_index, ch, k, c, 0 AS i, CAST(v AS BIGINT) AS s1, 0::BIGINT AS s2 FROM win, co WHERE i = 0
      UNION ALL SELECT p.window_index, p.ch, p.k, p.c, p.i + 1, {SAT.format('w.v + ((p.c * p.s1 + 8192) >> 14) - p.s2')}, p.s1
      FROM rec p JOIN win w ON w.window_index = p.window_index AND w.ch = p.ch AND w.i = p.i + 1),
    pw AS (SELECT window_index, ch, k, s1 * s1 + s2 * s2 - ((c * s1 * s2 + 8192) >> 14) AS p FROM rec WHERE i = 159),
    bands AS (SELECT unnest(['alpha', 'beta']) AS band, unnest([0, 1]) AS i, unnest([8, 13]) AS lo, unnest([13, 30]) AS hi),
    sm AS (SELECT window_index, b.i, band, ch, CAST(sum(p) AS BIGINT) AS p FROM pw, bands b WHERE k BETWEEN lo AND hi GROUP BY ALL)
    SELECT window_index, CAST(i AS INTEGER) AS i, band, ch, {SAT.format('(sign(p) * (abs(p) // 160) + 16384) >> 15')} AS v FROM sm""",
)
def _(spark, d):
    return qflat(q15.goertzel_q15(qsig(spark, d)))


@query(
    "fft_magsq_q15",
    f"""WITH {F3}, {QSIG}, {win_sql('qsig')}, dq AS (SELECT window_index, i, ch, v / 32768.0::DOUBLE AS v FROM win),
    dft AS ({DFT.format(n=W, src='dq', lo=0, hi=81)})
    SELECT window_index, CAST(k AS INTEGER) AS i, k::DOUBLE AS freq_hz, ch,
      CAST(least(floor((re * re + im * im) / 25600 * 32768 + 0.5), 32767) AS BIGINT) AS v FROM dft""",
)
def _(spark, d):
    return qflat(q15.fft_magsq_q15(qsig(spark, d)))


@query(
    "csp_apply_q15",
    f"""WITH {F3}, {QSIG}, m AS (SELECT c, ch, cos((c + 1) * (ch + 1) * 0.1::DOUBLE) / 8 AS w FROM {COMP.format(n=4)}, (SELECT unnest(range(64)) AS ch)),
    q AS (SELECT c, ch, {q15_sql('w')} AS w FROM m)
    SELECT t, CAST(c AS INTEGER) AS ch, {ROUND30.format('sum(v * w)')} AS v FROM qsig JOIN q USING (ch) GROUP BY t, c""",
)
def _(spark, d):
    return qflat(q15.csp_apply_q15(qsig(spark, d), csp_model(spark)))


@query(
    "ica_apply_q15",
    f"""WITH {F3}, {QSIG}, m AS (SELECT c, ch, cos((c + 1) * (ch + 1) * 0.1::DOUBLE) / 8 AS w, 0.01::DOUBLE * sin(ch + 1) AS mu
      FROM {COMP.format(n=64)}, (SELECT unnest(range(64)) AS ch)),
    q AS (SELECT c, ch, {q15_sql('w')} AS w, {q15_sql('mu')} AS mu FROM m)
    SELECT t, CAST(c AS INTEGER) AS ch, {ROUND30.format('sum(greatest(least(v - mu, 32767), -32768) * w)')} AS v
    FROM qsig JOIN q USING (ch) GROUP BY t, c""",
)
def _(spark, d):
    return qflat(q15.ica_apply_q15(qsig(spark, d), ica_model(spark)))


# ------------------------------------------------------------------- training


@query("channel_means", f"WITH {F3_NAN} SELECT CAST(ch AS INTEGER) AS ch, {r('avg(v) FILTER (NOT isnan(v))', 'mean', 9)} FROM sig GROUP BY ch")
def _(spark, d):
    return rounded(training.channel_means(sig(spark, d, nan=True)), 9)


COV = """c AS (SELECT t, ch, CASE WHEN isnan(v) THEN 0 ELSE v - m END AS v FROM sig JOIN
      (SELECT ch, avg(v) FILTER (NOT isnan(v)) AS m FROM sig GROUP BY ch) USING (ch))"""


@query(
    "covariance",
    f"""WITH {F3_NAN}, {COV} SELECT CAST(a.ch AS INTEGER) AS i, CAST(b.ch AS INTEGER) AS j, {r('avg(a.v * b.v)', 'cov', 8)}
    FROM c a JOIN c b ON a.t = b.t AND a.ch <= b.ch GROUP BY a.ch, b.ch""",
)
def _(spark, d):
    return rounded(training.covariance(sig(spark, d, nan=True)).drop("label"), 8)


@query(
    "class_covariance",
    f"""WITH {F3}, l AS (SELECT t, ch, v, CAST(t % 2 AS INTEGER) AS label FROM sig)
    SELECT a.label, CAST(a.ch AS INTEGER) AS i, CAST(b.ch AS INTEGER) AS j, {r('avg(a.v * b.v)', 'cov', 8)}
    FROM l a JOIN l b ON a.t = b.t AND a.ch <= b.ch GROUP BY a.label, a.ch, b.ch""",
)
def _(spark, d):
    marked = sig(spark, d).withColumn("label", F.col("t") % 2)
    return rounded(training.covariance(marked, centred=False, label="label"), 8)


def product_sql(name: str, a: str, b: str, scale: str = "1.0") -> str:
    """A table (i, j, v) with the product of two matrices kept as such tables."""
    return f"""{name} AS MATERIALIZED (SELECT a.i, b.j, {scale} * sum(a.v * b.v) AS v FROM {a} a JOIN {b} b ON a.j = b.i GROUP BY a.i, b.j)"""


def inverse_root_sql(name: str, source: str, steps: int = 22) -> str:
    """The inverse square root of a symmetric matrix by coupled Newton-Schulz steps."""
    p, out = f"{name}_", [f"{name}_s AS MATERIALIZED (SELECT sqrt(sum(v * v)) AS s FROM {source})"]
    out.append(f"{p}y0 AS MATERIALIZED (SELECT i, j, v / s AS v FROM {source}, {name}_s)")
    out.append(f"{p}z0 AS MATERIALIZED (SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM {source})")
    for k in range(steps):
        out.append(product_sql(f"{p}p{k}", f"{p}z{k}", f"{p}y{k}"))
        out.append(f"{p}t{k} AS MATERIALIZED (SELECT i, j, CASE WHEN i = j THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END - v / 2 AS v FROM {p}p{k})")
        out.append(product_sql(f"{p}y{k + 1}", f"{p}y{k}", f"{p}t{k}"))
        out.append(product_sql(f"{p}z{k + 1}", f"{p}t{k}", f"{p}z{k}"))
    out.append(f"{name} AS MATERIALIZED (SELECT i, j, v / sqrt(s) AS v FROM {p}z{steps}, {name}_s)")
    return ",\n    ".join(out)


WHITEN_SQL = f"""c AS MATERIALIZED (SELECT t, ch, v - avg(v) OVER (PARTITION BY ch) AS v FROM sig),
    cov AS MATERIALIZED (SELECT a.ch AS i, b.ch AS j, avg(a.v * b.v) AS v FROM c a JOIN c b ON a.t = b.t GROUP BY a.ch, b.ch),
    {inverse_root_sql('k', 'cov')}"""


@query(
    "whiten",
    f"""WITH {F3}, {WHITEN_SQL}
    SELECT t, CAST(k.j AS INTEGER) AS ch, {r('sum(c.v * k.v)', 'v')} FROM c JOIN k ON c.ch = k.i GROUP BY t, k.j""",
)
def _(spark, d):
    return flat(training.whiten(sig(spark, d)))


IDENTITY = """SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cov
    FROM (SELECT unnest(range({n})) AS i), (SELECT unnest(range({n})) AS j) WHERE i <= j"""


@query("whitened_covariance", IDENTITY.format(n=64))
def _(spark, d):
    return rounded(training.covariance(training.whiten(sig(spark, d)), centred=False).drop("label"))


def block_labels(spark, d, span=50):
    return sig(spark, d).select(F.floor(F.col("t") / span).alias("window_index")).distinct().withColumn(
        "label", (F.col("window_index") % 2).cast("int")
    )


def extreme_sql(name: str, source: str, squarings: int = 16) -> str:
    """The eigenvector of the largest eigenvalue of a positive matrix: a column of the matrix squared again and again."""
    out, last = [], source
    for k in range(squarings):
        out.append(product_sql(f"{name}_r{k}", last, last))
        out.append(f"{name}_q{k} AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM {name}_r{k}) AS v FROM {name}_r{k})")
        last = f"{name}_q{k}"
    top = f"(SELECT j FROM {last} WHERE i = j ORDER BY v DESC, j LIMIT 1)"
    out.append(f"{name}_u AS MATERIALIZED (SELECT i, v FROM {last} WHERE j = {top})")
    out.append(f"{name} AS MATERIALIZED (SELECT i, v / sqrt((SELECT sum(v * v) FROM {name}_u)) AS v FROM {name}_u)")
    return ",\n    ".join(out)


def without_sql(name: str, source: str, vector: str) -> str:
    """A matrix without one eigenvector."""
    value = f"(SELECT sum(a.v * m.v * b.v) FROM {source} m JOIN {vector} a ON a.i = m.i JOIN {vector} b ON b.i = m.j)"
    return f"""{name} AS MATERIALIZED (SELECT m.i, m.j, m.v - {value} * a.v * b.v AS v FROM {source} m JOIN {vector} a ON a.i = m.i
      JOIN {vector} b ON b.i = m.j)"""


CSP_SQL = f"""n AS (SELECT {LAST} // 50 * 50 AS n), l AS MATERIALIZED (SELECT t, ch, v, CAST(t // 50 % 2 AS INTEGER) AS label FROM sig, n WHERE t < n),
    cc AS MATERIALIZED (SELECT a.label, a.ch AS i, b.ch AS j, avg(a.v * b.v) + CASE WHEN a.ch = b.ch THEN 1e-6::DOUBLE ELSE 0.0::DOUBLE END AS v
      FROM l a JOIN l b ON a.t = b.t GROUP BY a.label, a.ch, b.ch),
    total AS MATERIALIZED (SELECT i, j, sum(v) + CASE WHEN i = j THEN 1e-8::DOUBLE ELSE 0.0::DOUBLE END AS v FROM cc GROUP BY i, j),
    one AS MATERIALIZED (SELECT i, j, v FROM cc WHERE label = 1), {inverse_root_sql('k', 'total')},
    {product_sql('kc', 'k', 'one')}, {product_sql('b', 'kc', 'k')},
    rest AS MATERIALIZED (SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - v AS v FROM b),
    {extreme_sql('u1', 'b')}, {without_sql('b2', 'b', 'u1')}, {extreme_sql('u2', 'b2')},
    {extreme_sql('d1', 'rest')}, {without_sql('r2', 'rest', 'd1')}, {extreme_sql('d2', 'r2')},
    u AS (SELECT 0 AS component, * FROM u1 UNION ALL SELECT 1, * FROM u2 UNION ALL SELECT 2, * FROM d2 UNION ALL SELECT 3, * FROM d1),
    f AS (SELECT component, k.j AS ch, sum(u.v * k.v) AS v FROM u JOIN k ON u.i = k.i GROUP BY component, k.j),
    g AS (SELECT component, sign(arg_max(v, abs(v))) AS s FROM f GROUP BY component)"""


@query("csp_calibrate", f"WITH {F3}, {CSP_SQL} SELECT component, CAST(ch AS INTEGER) AS ch, {r('v * s', 'v', 5)} FROM f JOIN g USING (component)")
def _(spark, d):
    trained = training.csp_calibrate(sig(spark, d), block_labels(spark, d), 50)
    return rounded(trained.select("component", F.posexplode("x").alias("ch", "v")), 5)


# Filtered classes together have unit variance and no correlation (up to the ridge).
@query("csp_class_sum", IDENTITY.format(n=4))
def _(spark, d):
    labels = block_labels(spark, d)
    trained = training.csp_calibrate(sig(spark, d), labels, 50)
    out = spatial.csp_apply(sig(spark, d), trained).withColumn("label", F.floor(F.col("t") / 50) % 2)
    per_class = training.covariance(out, centred=False, label="label")
    return rounded(per_class.groupBy("i", "j").agg(F.sum("cov").alias("cov")), 3)


@query("fit_transform", IDENTITY.format(n=64))
def _(spark, d):
    rows = sig(spark, d)
    return rounded(training.covariance(Ica().fit(rows).transform(rows), centred=False).drop("label"))


# The fixed-point rule at the trained model, worked out by Spark's own functions: it turns no component by more than the tolerance, and
# what comes out is uncorrelated with unit variance.
@query(
    "fastica_calibrate",
    f"""WITH {F3} SELECT CAST(ch AS INTEGER) AS component, true AS still, true AS white, {r('avg(v)', 'mean')} FROM sig GROUP BY ch""",
)
def _(spark, d):
    model = training.fastica_calibrate(sig(spark, d))
    y = windows.long_form(spatial.ica_apply(sig(spark, d), model)).select("t", "ch", "v")
    pairs = y.alias("a").join(y.alias("b"), "t").groupBy(F.col("a.ch").alias("i"), F.col("b.ch").alias("j")).agg(
        F.avg(F.tanh("a.v") * F.col("b.v")).alias("cross"), F.avg(F.col("a.v") * F.col("b.v")).alias("cov"),
        F.avg(1 - F.tanh("a.v") * F.tanh("a.v")).alias("slope"),
    )
    excess = pairs.where("i = j").select("i", (F.col("cross") - F.col("slope")).alias("excess"))
    signed = pairs.join(excess, "i").withColumn("g", F.signum("excess") * F.col("cross"))
    both = signed.alias("p").join(signed.alias("q"), F.expr("p.i = q.j AND p.j = q.i AND p.i <> p.j"))
    # the rule turns i towards j by about this angle; 1 - cosine is half the sum of squares
    angle = (F.col("p.g") - F.col("q.g")) / (F.abs("p.excess") + F.abs("q.excess"))
    turned = both.groupBy(F.col("p.i").alias("component")).agg((F.sum(angle * angle) / 2 <= 2e-4).alias("still"))
    off = F.abs(F.col("cov") - F.when(F.col("i") == F.col("j"), 1).otherwise(0))
    white = pairs.groupBy(F.col("i").alias("component")).agg((F.max(off) < 1e-8).alias("white"))
    mean = model.select("row", F.posexplode("mean").alias("component", "mean")).where("row = 0").drop("row")
    return turned.join(white, "component").join(mean, "component").withColumn("mean", F.round("mean", 6))


# Two independent columns, mixed: the rotation that separates them is the zero of the slope of the contrast, found here by cutting the
# quarter turn into ever finer angles.
def angles_sql(name: str, low: str, width: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT a, avg(tanh(cos(a) * z0 + sin(a) * z1) * (cos(a) * z1 - sin(a) * z0)
        - tanh(cos(a) * z1 - sin(a) * z0) * (cos(a) * z0 + sin(a) * z1)) AS g
      FROM (SELECT {low} + unnest(range(-1, 66)) * {width} AS a), z GROUP BY a),
    {name}_up AS MATERIALIZED (SELECT a, g, lead(a) OVER (ORDER BY a) AS a1, lead(g) OVER (ORDER BY a) AS g1 FROM {name}),
    {name}_at AS MATERIALIZED (SELECT a, g, a1, g1 FROM {name}_up WHERE g > 0 AND g1 <= 0 ORDER BY a LIMIT 1)"""


MIXED = ["l_quantity + 240 * l_discount", "400 * l_discount - 0.4D * l_quantity"]
_MIX_SQL = [m.replace("0.4D", "0.4::DOUBLE") for m in MIXED]
TWO_SQL = f"""x AS MATERIALIZED (SELECT CAST({_MIX_SQL[0]} AS DOUBLE) AS x0, CAST({_MIX_SQL[1]} AS DOUBLE) AS x1 FROM lineitem),
    m AS MATERIALIZED (SELECT avg(x0) AS m0, avg(x1) AS m1 FROM x), c AS MATERIALIZED (SELECT x0 - m0 AS x0, x1 - m1 AS x1 FROM x, m),
    v AS MATERIALIZED (SELECT avg(x0 * x0) AS a, avg(x0 * x1) AS b, avg(x1 * x1) AS d FROM c), s AS (SELECT *, sqrt(a * d - b * b) AS s FROM v),
    k AS MATERIALIZED (SELECT (d + s) / s / t AS k00, -b / s / t AS k01, (a + s) / s / t AS k11 FROM (SELECT *, sqrt(a + d + 2 * s) AS t FROM s)),
    z AS MATERIALIZED (SELECT x0 * k00 + x1 * k01 AS z0, x0 * k01 + x1 * k11 AS z1 FROM c, k),
    {angles_sql('g1', '0', 'pi() / 128')}, {angles_sql('g2', '(SELECT a FROM g1_at)', '(SELECT (a1 - a) / 64 FROM g1_at)')},
    {angles_sql('g3', '(SELECT a FROM g2_at)', '(SELECT (a1 - a) / 64 FROM g2_at)')},
    o AS (SELECT a + (a1 - a) * g / (g - g1) AS o FROM g3_at),
    w AS (SELECT cos(o) * k00 + sin(o) * k01 AS w0, cos(o) * k01 + sin(o) * k11 AS w1 FROM o, k
      UNION ALL SELECT cos(o) * k01 - sin(o) * k00, cos(o) * k11 - sin(o) * k01 FROM o, k),
    f AS (SELECT CASE WHEN abs(w0) >= abs(w1) THEN sign(w0) ELSE sign(w1) END AS s, w0, w1 FROM w)"""


@query("fastica_two_channels", f"WITH {TWO_SQL} SELECT {r('s * w0', 'w0')}, {r('s * w1', 'w1')}, {r('m0', 'm0')}, {r('m1', 'm1')} FROM f, m")
def _(spark, d):
    rows = tables.read(spark, d, "lineitem").selectExpr(
        "'r' AS recording_id", "l_orderkey * 8 + l_linenumber AS t", f"array(CAST({MIXED[0]} AS DOUBLE), CAST({MIXED[1]} AS DOUBLE)) AS x"
    )
    model = training.fastica_calibrate(rows, tol=1e-13)
    w0, w1 = F.col("weights")[0], F.col("weights")[1]
    s = F.when(F.abs(w0) >= F.abs(w1), F.signum(w0)).otherwise(F.signum(w1))
    return rounded(model.select((s * w0).alias("w0"), (s * w1).alias("w1"), F.col("mean")[0].alias("m0"), F.col("mean")[1].alias("m1")))


# Unmixed training data is white whatever the rotation found.
@query("fastica_unit_variance", IDENTITY.format(n=64))
def _(spark, d):
    model = training.fastica_calibrate(sig(spark, d))
    out = spatial.ica_apply(sig(spark, d), model)
    return rounded(training.covariance(out, centred=False).drop("label"))


# ------------------------------------------------------------------ tolerance


@query(
    "kernel_tolerance_check",
    f"""WITH {F3}, m AS (SELECT t, avg(v) AS m FROM sig GROUP BY t), car AS (SELECT t, ch, v - m AS v FROM sig JOIN m USING (t)),
    {win_sql('car')}, p AS (SELECT window_index, v AS e,
      CAST(CASE WHEN (window_index * {H} + i + ch) % 500 = 0 THEN v * 1.001 + 0.001 ELSE v END AS FLOAT)::DOUBLE AS a FROM win),
    q AS (SELECT *, abs(a - e) AS err, abs(a - e) / (abs(e) + 1e-12::DOUBLE) AS rel FROM p)
    SELECT 'car' AS plugin, window_index, count(*) AS compared, count(*) FILTER (err > 1e-6::DOUBLE AND rel > 1e-5::DOUBLE) AS mismatches,
      {r('max(err)', 'max_abs_error')}, {r('max(rel)', 'max_rel_error', 4)}, NOT bool_or(err > 1e-6::DOUBLE AND rel > 1e-5::DOUBLE) AS passed
    FROM q GROUP BY window_index""",
)
def _(spark, d):
    cut = windows.long_form(windows.sliding_windows(filters.car(sig(spark, d)), W, H)).withColumn("plugin", F.lit("car"))
    v = F.col("v")
    off = F.when((F.col("window_index") * H + F.col("i") + F.col("ch")) % 500 == 0, v * 1.001 + 0.001).otherwise(v)
    checked = tolerance.kernel_tolerance_check(cut.withColumn("v", off.cast("float")), cut, tolerance.tolerance_table(spark))
    return rounded(checked.withColumn("max_rel_error", F.round("max_rel_error", 4)))


# ----------------------------------------------------------------- generators


def _specs(spark, d):
    return tables.read(spark, d, "supplier").selectExpr(
        "cast(s_suppkey as string) AS recording_id", "(s_suppkey % 4 + 1) * 0.5D AS duration_s", "160 AS fs", "s_suppkey % 3 + 1 AS channels",
        "s_suppkey % 70 + 1D AS frequency_hz", "abs(s_acctbal) + 1 AS amplitude_uv_peak", "abs(s_acctbal) + 1 AS amplitude_uv_rms",
        "s_suppkey AS seed",
    )


@query(
    "generate_sine",
    f"""WITH s AS (SELECT s_suppkey, CAST((s_suppkey % 4 + 1) * 80 AS BIGINT) AS n, s_suppkey % 3 + 1 AS c, s_suppkey % 70 + 1 AS f, abs(s_acctbal) + 1 AS a FROM supplier),
    r AS (SELECT *, unnest(range(n)) AS t FROM s), q AS (SELECT *, unnest(range(c)) AS ch FROM r)
    SELECT CAST(s_suppkey AS VARCHAR) AS recording_id, t, CAST(ch AS INTEGER) AS ch, {r('a * sin(2 * pi() * f * (t / 160.0::DOUBLE))', 'v')} FROM q""",
)
def _(spark, d):
    return rounded(windows.long_form(generators.generate_sine(_specs(spark, d))))


@query(
    "generate_pink_noise",
    f"""WITH s AS (SELECT s_suppkey, CAST((s_suppkey % 4 + 1) * 80 AS BIGINT) AS n, abs(s_acctbal) + 1 AS a, unnest(range(s_suppkey % 3 + 1)) AS ch FROM supplier)
    SELECT CAST(s_suppkey AS VARCHAR) AS recording_id, CAST(ch AS INTEGER) AS ch, n, {r('a', 'rms', 4)}, 0.0::DOUBLE AS mean FROM s""",
)
def _(spark, d):
    noise = generators.generate_pink_noise(_specs(spark, d))
    out = noise.groupBy("recording_id", "ch").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.avg("v").alias("mean")
    )
    return rounded(out, 4)
