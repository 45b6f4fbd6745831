"""Streams over recordings that grow."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st_

from wavetally.streaming import recording_source as rs
from wavetally.streaming import signal as st

some = st_.lists(st_.tuples(st_.integers(0, 40), st_.integers(0, 8)).map(lambda r: (r[0], r[0] + r[1])), max_size=6)
cover = lambda ranges: {t for a, b in ranges for t in range(a, b)}


@given(some, some)
def test_ranges(a, b):
    a, b = rs.merged(a), rs.merged(b)
    assert all(x[1] < y[0] for x, y in zip(a, a[1:]))
    assert cover(rs.without(a, b)) == cover(a) - cover(b)
    assert rs.read_back(rs.written(a)) == a


def write(path, x):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "ab") as f:
        f.write(x.astype("<f4").tobytes())


def test_goes_on_in_the_middle_of_a_file(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((1000, 3)).astype("f4"), rng.standard_normal((300, 3)).astype("f4")
    root, out = tmp_path / "in", str(tmp_path / "out")
    stream = rs.recording_stream(spark, str(root), 3, split_bytes=1200)
    write(root / "a.float32", a[:400])
    with open(root / "a.float32", "ab") as f:
        f.write(a[400:401].tobytes()[:5])  # a sample half written
    assert st.drain(stream, "x", out).count() == 400
    assert st.drain(stream, "x", out).count() == 400  # nothing new
    with open(root / "a.float32", "ab") as f:
        f.write(a[400:].tobytes()[5:])
    write(root / "b" / "t000000000200.float32", b[200:])  # a later part first
    assert st.drain(stream, "x", out).count() == 1100
    write(root / "b" / "t000000000000.float32", b[:200])
    write(root / "b" / "t000000000150.float32", b[150:250])  # samples that are there already
    rows = st.drain(stream, "x", out).collect()
    assert len(rows) == 1300
    got = {(r["recording_id"], r["t"]): r["x"] for r in rows}
    assert all(got["a", t] == a[t].tolist() for t in range(1000)) and all(got["b", t] == b[t].tolist() for t in range(300))
    reader = rs.RecordingStreamReader({"path": str(root), "channels": "3", "splitbytes": "1200"})
    assert reader.latestOffset() == {"a": "0-1000", "b": "0-300"}
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []
    assert max(p.rows for p in reader.partitions({}, reader.latestOffset())) == 100
    with pytest.raises(FileNotFoundError, match="gone"):
        reader.partitions({}, {"c": "0-5"})


def test_windows_from_growing_files(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((500, 2)).astype("f4")
    root, out = tmp_path / "in", str(tmp_path / "out")
    stream = st.stream_sliding_windows(rs.recording_stream(spark, str(root), 2), 64, 32, length=128)
    for at in range(0, 500, 170):
        write(root / "r.float32", x[at : at + 170])
        cut = st.drain(stream, "w", out)
    got = {(r["window_index"], r["i"]): r["x"] for r in cut.collect()}
    assert cut.count() == len(got) == 14 * 64
    assert all(got[k, i] == x[k * 32 + i].tolist() for k in range(14) for i in range(64))
