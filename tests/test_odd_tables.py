"""Queries and their SQL on tables with odd values."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare, connect
from wavetally.operators import attribution as att
from wavetally.operators import ordered
from wavetally.testbed.telemetry_queries import derived

SMALL = "/root/testdata/sf0.001"


def with_events(tmp_path, sql: str) -> str:
    """The smallest tables with other events, made from ``events`` by ``sql``."""
    for t in set(TABLES) - {"events"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
    duckdb.sql(f"COPY (WITH events AS (SELECT * FROM '{SMALL}/events.parquet') {sql}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    return str(tmp_path)


def agrees(spark, name: str, folder: str):
    assert compare(connect(folder), entry.queries()[name](spark, folder), entry.oracle_sql()[name]) is None
    return entry.queries()[name](spark, folder).collect()


def test_report_of_runs_that_hardly_differ(spark, tmp_path):
    """Every event in both runs, the candidate's a nanosecond shorter: differences round to zero and have no sign."""
    both = """SELECT 2 * event_id + c AS event_id, * EXCLUDE (event_id, c, value), value - c * 0.001::DOUBLE AS value
      FROM events, (SELECT unnest([0, 1]) AS c) WHERE value > 2"""
    rows = agrees(spark, "comparison_report", with_events(tmp_path, both))
    assert {r.cohens_d for r in rows} == {"0.000"} and "+0.00" in {r.relative_change_pct for r in rows}


def test_noise_kernel_without_latency(spark, tmp_path):
    """A noise latency of 0 leaves no ratio, and the limits are not reached."""
    still = "SELECT * REPLACE (CASE WHEN event_type = 'view' AND user_id % 10 > 0 THEN 0 ELSE value END AS value) FROM events"
    rows = agrees(spark, "snr_table", with_events(tmp_path, still))
    assert {(r.overhead_us, r.snr_worst, r.snr_best, r.status) for r in rows} == {(0.0, None, None, "below")}


@pytest.mark.parametrize("step", [att.freq_stratification, att.decompose_run])
def test_attribution_reads_its_input_twice(spark, monkeypatch, step):
    """Groups beyond one task take many passes; they go over rows written once, not over what made them."""
    monkeypatch.setattr(ordered, "MAX_SORTED_ROWS", 100)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = derived(spark, SMALL)
    rows = att.stall_covariate(rows.mapInArrow(counted, rows.schema))
    n = derived(spark, SMALL).count()
    step(rows).collect()
    assert n <= seen.value <= 2 * n
