"""Exact order statistics, ranks and neighbours for groups of any size.

A telemetry table has few groups and very many rows, so a window or a
``percentile`` aggregate over a whole group would put it into one task. The
operators here cut every group into ordered cells first:

1. equal values are counted where they lie (map-side combine), so a value that
   holds a third of the rows becomes one row;
2. a logarithmic cell number splits a group into some ten thousand cells;
3. a cell that is too full for one task is split into 65,536 linear parts
   between its own extremes.

Groups are counted first: where even the largest fits into one task, the plain
aggregate or window is used and the cells are left out.

Running totals are taken over cells, then over the parts of a cell, then over
the distinct values of a part, so no task ever holds more than one such list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetally.schemas import finite_or_null

CELLS_PER_E_FOLD = 2048
PARTS_PER_CELL = 65536

# Largest table sent to every task, and longest list sorted inside one task.
MAX_BROADCAST_ROWS = 100_000
MAX_SORTED_ROWS = 1_000_000


def _cell(v: Column) -> Column:
    # log1p is monotone, so cells keep the order of the values
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * CELLS_PER_E_FOLD)


def _part(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, F.floor((v - lo) / (hi - lo) * (PARTS_PER_CELL - 1))).otherwise(F.lit(0).cast("long"))


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.lit(1)), ["_all"]


def _wanted(n: Column, probs: Sequence[float], rule: str) -> Column:
    """Ranks (from 1) a percentile needs: two neighbours, or one index."""
    ranks = []
    for i, p in enumerate(probs):
        if rule == "linear":
            pos = (n - 1) * F.lit(float(p))
            pair = (F.floor(pos) + 1, F.ceil(pos) + 1)
        else:
            at = F.least(F.floor(n * F.lit(float(p))) + 1, n)
            pair = (at, at)
        for side, r in enumerate(pair):
            ranks.append(F.struct(F.lit(2 * i + side).alias("slot"), r.cast("long").alias("r")))
    return F.array(*ranks)


def _between(lo: Column, hi: Column, pos: Column) -> Column:
    """Weighted neighbours, term by term as the ``percentile`` aggregate has it, so that both ways agree to the last bit."""
    below, above = F.floor(pos), F.ceil(pos)
    return F.when((below == above) | (lo == hi), lo).otherwise((above - pos) * lo + (pos - below) * hi)


def _inside(wanted: Column, before: Column, n: Column) -> Column:
    """Those wanted ranks that fall into this row's rank range, made local."""
    kept = F.filter(wanted, lambda h: (h["r"] > before) & (h["r"] <= before + n))
    return F.transform(kept, lambda h: F.struct(h["slot"].alias("slot"), (h["r"] - before).alias("r")))


def small_table(df: DataFrame, max_rows: int) -> DataFrame | None:
    """The rows as a driver-side table if there are at most ``max_rows``."""
    rows = df.limit(max_rows + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= max_rows else None


@dataclass(frozen=True)
class GroupSizes:
    """How many groups a table has and how many rows the largest of them."""

    groups: int
    largest: int

    @property
    def sortable(self) -> bool:
        """Every group fits into one task."""
        return self.largest <= MAX_SORTED_ROWS

    def small(self, per_group: DataFrame) -> DataFrame:
        """Broadcast a table with one row per group if the groups are few."""
        return F.broadcast(per_group) if self.groups <= MAX_BROADCAST_ROWS else per_group


def group_sizes(df: DataFrame, keys: Sequence[str]) -> GroupSizes:
    """Counted from the key columns alone."""
    if not keys:
        return GroupSizes(1, df.count())
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*"), F.max("n")).first()
    return GroupSizes(n[0], n[1] or 0)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast a table counted to be small; a larger one is joined by shuffle."""
    few = small_table(df, MAX_BROADCAST_ROWS)
    return df if few is None else F.broadcast(few)


def _plain_percentiles(probs: dict[str, float], rule: str, exact: bool) -> tuple[list[Column], list[Column]]:
    """Aggregates over ``_v`` and the columns to take from them."""
    ps = [float(p) for p in probs.values()]
    if not exact:
        found = F.percentile_approx("_v", ps, 100000)
    elif rule == "linear":
        found = F.percentile("_v", F.array(*[F.lit(p) for p in ps]))
    else:
        found = F.sort_array(F.collect_list("_v"))
        n = F.size("_q")
        at = [F.least(F.floor(n * F.lit(p)), n - 1).cast("int") for p in ps]
        return [found.alias("_q")], [F.get("_q", i).alias(a) for a, i in zip(probs, at)]
    return [found.alias("_q")], [F.col("_q")[i].alias(a) for i, a in enumerate(probs)]


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    rule: str = "linear",
    exact: bool = True,
    sizes: GroupSizes | None = None,
    aggs: Sequence[Column] = (),
) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (alias -> p).

    ``linear`` interpolates between neighbours, ``index`` takes the value at
    ``floor(p * n)``. Nulls and NaN are left out. ``exact=False`` uses Spark's
    mergeable sketch instead. ``aggs`` are further aggregates of the groups.
    ``sizes`` saves the counting of groups where a bound is known.

    Groups that fit into one task use the plain aggregate. For larger ones a
    first pass counts cells (few thousand per group, combined map-side) and
    finds those that hold a wanted rank; it runs when the frame is built, as
    the sampling behind a range partitioning does. A second pass reads only the
    rows of these cells, so nearly nothing is shuffled. The wanted cells are
    broadcast when they are counted to be few; with very many groups they are
    joined by shuffle instead.
    """
    if rule not in ("linear", "index"):
        raise ValueError(f"unknown percentile rule: {rule}")
    keyed, gk = _keyed(df, keys)
    names = [c for c in keyed.columns if c not in gk] if aggs else []
    src = keyed.select(*gk, *names, finite_or_null(F.col(value)).alias("_v"))
    src = src if aggs else src.where(F.col("_v").isNotNull())
    ps = list(probs.values())
    if not exact or (sizes or group_sizes(df, keys)).sortable:
        found, taken = _plain_percentiles(probs, rule, exact)
        out = src.groupBy(*gk).agg(*aggs, *found)
        return out.select(*keys, *[c for c in out.columns if c not in (*gk, "_q")], *taken)
    if aggs:
        marks = exact_percentiles(df, keys, value, probs, rule, exact, sizes)
        basic = keyed.groupBy(*gk).agg(*aggs)
        return basic.join(marks, list(keys), "left") if keys else basic.drop(*gk).join(marks, F.lit(True), "left")

    src = src.withColumn("_c1", _cell(F.col("_v")))
    by_cell = Window.partitionBy(*gk).orderBy("_c1").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = (
        src.groupBy(*gk, "_c1")
        .agg(F.count("*").alias("_cn"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_before", F.sum("_cn").over(by_cell) - F.col("_cn"))
        .withColumn("_total", F.sum("_cn").over(Window.partitionBy(*gk)))
        .withColumn("_hits", _inside(_wanted(F.col("_total"), ps, rule), F.col("_before"), F.col("_cn")))
        .where(F.size("_hits") > 0)
        .select(*gk, "_c1", "_cn", "_lo", "_hi", "_total", "_hits")
    )
    few = small_table(cells, MAX_BROADCAST_ROWS)
    if few is not None:
        cells = F.broadcast(few)
        largest = few.agg(F.max("_cn")).first()[0] or 0
        inside = src.join(cells.select(*gk, "_c1"), [*gk, "_c1"], "left_semi").groupBy(*gk, "_c1", "_v")
        counts = inside.agg(F.count("*").alias("_n")).join(cells, [*gk, "_c1"])
    else:
        largest = None
        counts = src.groupBy(*gk, "_c1", "_v").agg(F.count("*").alias("_n")).join(cells, [*gk, "_c1"])

    place = [*gk, "_c1"]
    if largest is None or largest > MAX_SORTED_ROWS:
        # a cell too full for one task is numbered in parts first
        counts = counts.withColumn("_c2", _part(F.col("_v"), F.col("_lo"), F.col("_hi")))
        by_part = Window.partitionBy(*place).orderBy("_c2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts = (
            counts.groupBy(*place, "_c2")
            .agg(F.sum("_n").alias("_pn"), F.first("_hits").alias("_h"))
            .withColumn("_before", F.sum("_pn").over(by_part) - F.col("_pn"))
            .withColumn("_part_hits", _inside(F.col("_h"), F.col("_before"), F.col("_pn")))
            .where(F.size("_part_hits") > 0)
            .select(*place, "_c2", F.col("_part_hits").alias("_hits"))
        )
        place = [*place, "_c2"]
        counts = counts.drop("_hits").join(parts, place)
    by_value = Window.partitionBy(*place).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = counts.withColumn("_before", F.sum("_n").over(by_value) - F.col("_n")).withColumn(
        "_hit", F.explode(_inside(F.col("_hits"), F.col("_before"), F.col("_n")))
    )
    slots = found.groupBy(*gk).agg(
        F.max("_total").alias("_total"),
        *[F.max(F.when(F.col("_hit.slot") == s, F.col("_v"))).alias(f"_s{s}") for s in range(2 * len(ps))],
    )
    cols = []
    for i, (alias, p) in enumerate(probs.items()):
        lo, hi = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        cols.append((_between(lo, hi, (F.col("_total") - 1) * F.lit(float(p))) if rule == "linear" else lo).alias(alias))
    return slots.select(*keys, *cols)


def running_counts(
    counts: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], sizes: GroupSizes
) -> DataFrame:
    """Add ``<m>_before`` (sum over smaller values) and ``<m>_total`` per group.

    ``counts`` holds one row per (group, value); ``measures`` are its numeric
    count columns; ``sizes`` bounds the groups that were counted.
    """
    src, gk = _keyed(counts, keys)
    v = F.col(value)
    if sizes.sortable:
        whole = Window.partitionBy(*gk)
        upto = whole.orderBy(v).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = [(F.sum(m).over(upto) - F.col(m)).alias(f"{m}_before") for m in measures]
        total = [F.sum(m).over(whole).alias(f"{m}_total") for m in measures]
        return src.select(*counts.columns, *before, *total)

    src = src.withColumn("_c1", _cell(v))
    by_cell = Window.partitionBy(*gk).orderBy("_c1").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = src.groupBy(*gk, "_c1").agg(
        F.min(v).alias("_lo"), F.max(v).alias("_hi"), *[F.sum(m).alias(f"_c_{m}") for m in measures]
    )
    cells = cells.select(
        *gk,
        "_c1",
        "_lo",
        "_hi",
        *[(F.sum(f"_c_{m}").over(by_cell) - F.col(f"_c_{m}")).alias(f"_b1_{m}") for m in measures],
        *[F.sum(f"_c_{m}").over(Window.partitionBy(*gk)).alias(f"{m}_total") for m in measures],
    )
    # counted cells and parts are broadcast: values that crowd into one cell stay where they are
    src = src.join(broadcast_if_small(cells), [*gk, "_c1"]).withColumn("_c2", _part(v, F.col("_lo"), F.col("_hi")))
    by_part = Window.partitionBy(*gk, "_c1").orderBy("_c2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = src.groupBy(*gk, "_c1", "_c2").agg(*[F.sum(m).alias(f"_p_{m}") for m in measures])
    parts = parts.select(
        *gk, "_c1", "_c2", *[(F.sum(f"_p_{m}").over(by_part) - F.col(f"_p_{m}")).alias(f"_b2_{m}") for m in measures]
    )
    by_value = (
        Window.partitionBy(*gk, "_c1", "_c2").orderBy(v).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = src.join(broadcast_if_small(parts), [*gk, "_c1", "_c2"])
    return out.select(
        *counts.columns,
        *[
            (F.col(f"_b1_{m}") + F.col(f"_b2_{m}") + F.sum(m).over(by_value) - F.col(m)).alias(f"{m}_before")
            for m in measures
        ],
        *[f"{m}_total" for m in measures],
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: str, alias: str, span: int = 1 << 20, start: int = 0
) -> DataFrame:
    """Consecutive numbers per group in the order of an integer column.

    The column is cut into ranges of ``span``; rows are numbered inside their
    range and shifted by the count of the ranges before it.
    """
    src, gk = _keyed(df, keys)
    src = src.withColumn("_range", F.floor(F.col(order) / span))
    before = Window.partitionBy(*gk).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shift = (
        src.groupBy(*gk, "_range")
        .agg(F.count("*").alias("_rn"))
        .select(*gk, "_range", (F.sum("_rn").over(before) - F.col("_rn")).alias("_shift"))
    )
    local = F.row_number().over(Window.partitionBy(*gk, "_range").orderBy(order))
    return (
        src.withColumn("_local", local)
        .join(shift, [*gk, "_range"])
        .select(*df.columns, (F.col("_shift") + F.col("_local") - 1 + start).cast("long").alias(alias))
    )


def previous_values(
    df: DataFrame, keys: Sequence[str], order: str, cols: dict[str, str], span: int = 1 << 20
) -> DataFrame:
    """Values of the preceding row of the group (``cols``: source -> alias).

    Like ``lag``, but over groups too large for one task only the first row of
    each range looks beyond its range, at the last row of the range before.
    """
    src, gk = _keyed(df, keys)
    if group_sizes(df, keys).sortable:
        whole = Window.partitionBy(*gk).orderBy(order)
        return src.select(*df.columns, *[F.lag(c).over(whole).alias(a) for c, a in cols.items()])
    src = src.withColumn("_range", F.floor(F.col(order) / span))
    packed = F.struct(*[F.col(c) for c in cols])
    last = (
        src.groupBy(*gk, "_range")
        .agg(F.max_by(packed, F.col(order)).alias("_last"))
        .select(*gk, "_range", F.lag("_last").over(Window.partitionBy(*gk).orderBy("_range")).alias("_carried"))
    )
    inside = F.lag(packed).over(Window.partitionBy(*gk, "_range").orderBy(order))
    out = src.withColumn("_prev", inside).join(last, [*gk, "_range"])
    prev = F.coalesce(F.col("_prev"), F.col("_carried"))
    return out.select(*df.columns, *[prev[c].alias(a) for c, a in cols.items()])


def repeat_rows(df: DataFrame, times: str, index: str, keys: Sequence[str], block: int = 1_000_000) -> DataFrame:
    """One row per unit of a count column, with ``index`` running 1..count.

    Counts are laid out in blocks that are spread over tasks before they are
    expanded, so one very frequent value does not expand inside one task.
    """
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / block).cast("long"))))
    blocks = blocks.repartition(*keys, "_block")
    first = F.col("_block") * block + 1
    last = F.least(F.col(times), first + block - 1)
    return blocks.withColumn(index, F.explode(F.sequence(first, last))).drop("_block")
