"""Exact Jaccard join of documents on word n-grams by vertical partitioning.

A document is the set of its distinct word n-grams. All n-grams have one global
order, rare before frequent; the order is cut into fragments, so that a set
becomes one row per fragment. Overlaps are counted fragment by fragment and
summed per pair.

Which pairs are counted: two sets that reach the threshold share an n-gram among
the first few of the order (prefix filter). n-grams that one set alone has there
are dropped fragment by fragment before anything is joined. The frequency behind
the order comes from a table of counters over all documents that never
undercounts; it steers the work, not the result.

Before fragments of a pair meet, parity bits of both sets bound their overlap from above: sets that differ in more bits
than the threshold allows differ in more n-grams (an exact filter, never a guess). A set has 512 bits and, if it is larger
than that, as many again as it has n-grams (the next power of two), so that the bound holds off long texts too.

Identical sets are one node. Among nodes, lists of an n-gram first offer pairs of
a leader with every other member, leaders changing from round to round; members
of one component are never paired again. Rounds go on while they link sets and
long lists are still mixed. Only what is left then, pairs of different components
that share a prefix n-gram, is enumerated, and of all lists a pair shares, only
the first offers it. So a group of near copies costs its size and not its square,
and no link between components is lost.

Hashes have 64 bits: results are exact but for collisions.

Defined results: words are runs of non-blanks with A-Z lower-cased; with fewer
words than ``n`` the whole sequence is the only n-gram; a text that is null or
without words has an empty set, no link, and is its own component; repeated rows
are linked; a component's id is its least doc_id, null only if all are null; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.llm.bloom import MAX_BITS, contains, of_column
from wavetally.llm.common import as_long, mix64, power_of_two, slices
from wavetally.llm.components import star_components
from wavetally.llm.words import Words, shingle_sets
from wavetally.session import materialize

SIZE = 5
PERCENT = 75
COUNTERS = 1 << 23
COUNTER_SEGMENT = 1 << 16
BUFFERED = 2_000_000
FRAGMENTS = 4
FRAGMENT_POSTINGS = 2_000_000
BLOCK_SETS = 4_000
LEADER_ROUNDS = 2
MOST_ROUNDS = 3
PAIRS_PER_POSTING = 8  # mixed lists that offer more than this get another round of leaders first
FIRST_LISTS = 8
BROADCAST_SETS = 200_000
MARK_BITS = 512
SMALL_LIST = 16
HOT_BUCKET = 124  # of counts from 46,000: lists that long are handled as rows, never as one task's array
_SHIFT = np.uint64(56)


def mark_of(s: np.ndarray) -> list[int]:
    """``MARK_BITS`` bits, each the parity of the n-grams that fall on it; for more n-grams a second, wider run of bits follows."""
    bits = max(MARK_BITS, 1 << (len(s) - 1).bit_length())
    parity = (np.bincount((s >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)
    narrow = np.bitwise_xor.reduce(parity.reshape(-1, MARK_BITS), axis=0)
    both = narrow if bits == MARK_BITS else np.concatenate([narrow, parity])
    return np.packbits(both).view(np.int64).tolist()


def required(size: int, percent: int) -> int:
    """Least overlap of a set of ``size`` with any partner."""
    return -(-percent * size // 100)


def required_of_larger(size: int, percent: int) -> int:
    """Least overlap of a set of ``size`` with any partner that is not smaller."""
    return -(-2 * percent * size // (100 + percent))


def set_id(s: np.ndarray) -> int:
    """A 64-bit id of a set, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0


def _bucket(counts: np.ndarray) -> np.ndarray:
    """Eight steps per doubling."""
    return np.floor(8 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def _order(s: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Place of each n-gram in the global order: its frequency bucket, then its hash."""
    bucket = buckets[s & np.uint64(len(buckets) - 1)].astype(np.uint64)
    return (bucket << _SHIFT) | (s >> np.uint64(8))


def row_key():
    """Column: the same for rows of the same doc_id and text, nulls included."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def sets(docs: DataFrame, n: int, counters: int) -> DataFrame:
    """A row per document (doc_id, row_key, n, s, mark), and rows with a segment that carry counts of n-grams by hash."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row_key", "n", "s", "mark", "segment", "counts"]
        marks = pa.list_(pa.int64())
        counts = np.zeros(counters, dtype=np.uint16)
        held, size, seen, kind = [], 0, set(), None

        def add():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            counts[at] = np.minimum(counts[at].astype(np.int64) + n, 65535)

        for part in slices(batches):
            kind = part.column("doc_id").type
            found = shingle_sets(Words(part.column("text")), n)
            ids = [set_id(s) for s in found]
            for i, s in zip(ids, found):
                if i not in seen:
                    seen.add(i)
                    held.append((s & np.uint64(counters - 1)).astype(np.uint32))
                    size += len(s)
            if size > BUFFERED:
                add()
                held, size = [], 0
            lengths = [len(s) for s in found]
            none = len(found)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row_key"), pa.array(lengths, pa.int64()), pa.array([i if m else None for i, m in zip(ids, lengths)], pa.int64()), pa.array([mark_of(x) if len(x) > 2 else None for x in found], marks), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary())],
                names,
            )
        if held:
            add()
        if kind is None:
            return
        for k in range(0, counters, COUNTER_SEGMENT):
            raw = counts[k : k + COUNTER_SEGMENT].astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, marks), pa.array([k // COUNTER_SEGMENT]), pa.array([zlib.compress(raw, 1)], pa.binary())],
                names,
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_key().alias("row_key")).mapInArrow(sketch, f"doc_id {kind}, row_key long, n long, s long, mark array<long>, segment long, counts binary")


def frequency_buckets(found: DataFrame, counters: int) -> np.ndarray:
    """One byte per counter, from all tasks' counts: ``counters`` bytes on the driver."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([current]), pa.array([zlib.compress(_bucket(total).tobytes(), 1)], pa.binary())], ["segment", "buckets"])
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(zlib.decompress(raw), "<u2").astype(np.int64)
                if s != current and current is not None:
                    yield done()
                total = new if s != current else total + new
                current = s
        if current is not None:
            yield done()

    parts = found.where("segment IS NOT NULL").select("segment", "counts").repartition("segment").sortWithinPartitions("segment")
    out = np.zeros(counters, dtype=np.uint8)
    for row in parts.mapInArrow(merge, "segment long, buckets binary").toLocalIterator():
        raw = np.frombuffer(zlib.decompress(row["buckets"]), np.uint8)
        out[row["segment"] * COUNTER_SEGMENT :][: len(raw)] = raw
    return out


def cuts(buckets: np.ndarray, fragments: int) -> np.ndarray:
    """Where to cut the global order, so that fragments hold about as many n-grams of all sets."""
    mass = np.bincount(buckets, minlength=256) * 2.0 ** (np.arange(256) / 8)
    upto = np.cumsum(mass)
    wanted = upto[-1] * np.arange(1, fragments) / fragments
    bucket = np.searchsorted(upto, wanted)
    share = 1 - (upto[bucket] - wanted) / mass[bucket]
    return np.array([(int(b) << 56) + int(x * (1 << 56)) for b, x in zip(bucket, share)], dtype=np.uint64)


def posting_blocks(docs: DataFrame, n: int, percent: int, buckets, pieces: int) -> DataFrame:
    """(piece, grams, owners, sets, sizes): prefix n-grams of sets, packed by piece; hot ones lie in as many pieces more, by set."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        ids, sizes, grams, owners = [], [], [], []

        def flush():
            h, o = np.concatenate(grams), np.concatenate(owners)  # an owner's lowest bit says near
            hot = buckets.value[h & np.uint64(len(buckets.value) - 1)] >= HOT_BUCKET
            spread = (mix64(np.array(ids, np.int64).view(np.uint64)) % np.uint64(pieces)).astype(np.int64)
            place = np.where(hot, pieces + spread[o >> 1], (h >> np.uint64(32)).astype(np.int64) % pieces)
            order = np.argsort(place, kind="stable")
            edges = np.flatnonzero(np.append(True, np.diff(place[order]) != 0))
            for a, b in zip(edges, np.append(edges[1:], len(order))):
                at = order[a:b]
                own, local = np.unique(o[at] >> 1, return_inverse=True)
                local = (local << 1) | (o[at] & 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(place[at[0]])]),
                        *[pa.array([x.tobytes()], pa.binary()) for x in (h[at], local.astype("<u2"), np.array(ids, np.int64)[own], np.array(sizes, np.int32)[own])],
                    ],
                    ["piece", "grams", "owners", "sets", "sizes"],
                )

        for part in slices(batches):
            for s in shingle_sets(Words(part.column("text")), n):
                i = set_id(s)
                if len(s) < 3 or i in seen:  # smaller sets link to equal ones only
                    continue
                seen.add(i)
                first = np.argsort(_order(s, buckets.value), kind="stable")[: len(s) - required(len(s), percent) + 1]
                grams.append(s[first])
                owners.append(2 * len(ids) + (np.arange(len(first)) <= len(s) - required_of_larger(len(s), percent)))
                ids.append(i)
                sizes.append(len(s))
                if len(ids) == BLOCK_SETS:
                    yield from flush()
                    ids, sizes, grams, owners = [], [], [], []
        if ids:
            yield from flush()

    return docs.select("text").mapInArrow(blocks, "piece long, grams binary, owners binary, sets binary, sizes binary")


def shared_postings(docs: DataFrame, n: int, percent: int, buckets, pieces: int) -> DataFrame:
    """(h, s, n, near, size): lists ``h`` of sets that share a prefix n-gram with which they may reach one another.

    Of two sets that reach the threshold, the larger has a common n-gram in its prefix that lies even in the shorter
    prefix of the smaller (``near``), for the smaller's partner cannot be smaller. Equal sizes rank by s."""

    def shared(table: pa.Table) -> pa.Table:
        """Of one piece, what has a partner of fitting size in its n-gram's list."""
        read = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        owners, set_ids, sizes = read("owners", "<u2"), read("sets", np.int64), read("sizes", np.int32)
        h = np.concatenate(read("grams", np.uint64))
        s = np.concatenate([a[o >> 1] for a, o in zip(set_ids, owners)])
        m = np.concatenate([a[o >> 1] for a, o in zip(sizes, owners)]).astype(np.int64)
        near = np.concatenate([(o & 1).astype(bool) for o in owners])
        order = np.lexsort((s, m, h))
        h, s, m, near = h[order], s[order], m[order], near[order]
        keep = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))  # copies in different tasks
        h, s, m, near = h[keep], s[keep], m[keep], near[keep]
        if table.column("piece")[0].as_py() < pieces:
            at = np.arange(len(h))
            below = np.maximum.accumulate(np.where(near, at, -1))
            below = np.append(-1, below[:-1])  # the last near one before
            keep = (below >= 0) & (h[below] == h) & (100 * m[below] >= percent * m)
            keep[:-1] |= near[:-1] & (h[1:] == h[:-1]) & (100 * m[:-1] >= percent * m[1:])
            h, s, m, near = h[keep], s[keep], m[keep], near[keep]
            size = np.zeros(len(h), dtype=np.int64)
            if len(h):
                # near copies share many n-grams: lists of the same members are one list, named by its members
                starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                lengths = np.diff(np.append(starts, len(h)))
                h = np.repeat(np.add.reduceat(mix64(s.view(np.uint64)), starts), lengths)
                size = np.repeat(lengths, lengths)
        else:
            size = np.full(len(h), SMALL_LIST + 1)  # the rest of a hot list is elsewhere
        return pa.table([pa.array(as_long(h)), pa.array(s), pa.array(m), pa.array(near), pa.array(size)], names=["h", "s", "n", "near", "size"])

    lists = posting_blocks(docs, n, percent, buckets, pieces).groupBy("piece").applyInArrow(shared, "h long, s long, n long, near boolean, size long")
    return lists.groupBy("h", "s").agg(*[F.max(c).alias(c) for c in ("n", "near", "size")])


def useful_postings(postings: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Without members of small lists that no other member can reach by size and mark."""
    small = postings.where(F.col("size") <= SMALL_LIST).join(marks, "s")
    lists = small.groupBy("h").agg(F.collect_list(F.struct("s", "n", "near", "mark")).alias("m"))

    def has_partner(x):
        return F.exists("m", lambda y: (x["s"] != y["s"]) & _fits(x["n"], y["n"], percent) & _may_reach(x["mark"], x["n"], y["mark"], y["n"], percent))

    kept = lists.select("h", F.explode(F.filter("m", has_partner)).alias("x")).select("h", "x.s", "x.n", "x.near")
    return kept.unionByName(postings.where(F.col("size") > SMALL_LIST).select("h", "s", "n", "near"))


def fragments(docs: DataFrame, n: int, buckets, wanted, edges: np.ndarray) -> DataFrame:
    """(s, f, task, grams): the sets in the filter ``wanted``, a row per fragment of the global order.

    Every task gives a set once; copies in other tasks are told apart by the task's number."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        task = TaskContext.get().partitionId()
        for part in slices(batches):
            found = shingle_sets(Words(part.column("text")), n)
            ids = np.array([set_id(s) for s in found], dtype=np.int64)
            keep = contains(wanted.value, ids.view(np.uint64)) if len(ids) else np.zeros(0, bool)
            rows_s, rows_f, lists = [], [], []
            for i, s, k in zip(ids.tolist(), found, keep):
                if not k or i in seen or not len(s):
                    continue
                seen.add(i)
                place = np.searchsorted(edges, _order(s, buckets.value), side="right")
                for f in np.unique(place):
                    rows_s.append(i)
                    rows_f.append(int(f))
                    lists.append(as_long(s[place == f]))
            if lists:
                at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows_s, pa.int64()), pa.array(rows_f, pa.int32()), pa.array([task] * len(rows_s), pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(lists)))],
                    ["s", "f", "task", "grams"],
                )

    return docs.select("text").mapInArrow(cut, "s long, f int, task int, grams array<long>")


def _fits(a, b, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that reach the threshold: partial overlaps per fragment, summed per pair."""
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "s")
    small = wanted.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS
    # the copy to take of every set in the pairs; sets in no pair stay where they are
    copy = parts.select("s", "task").join(F.broadcast(wanted) if small else wanted, "s", "left_semi").groupBy("s").agg(F.min("task").alias("task"))
    some = parts.join(F.broadcast(copy) if small else copy, ["s", "task"])
    right = some.select(F.col("s").alias("b"), "f", F.col("grams").alias("gb"))
    left = some.select(F.col("s").alias("a"), "f", F.col("grams").alias("ga"))
    partial = pairs.join(right, "b").join(left, ["a", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("o"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where((100 + percent) * F.col("o") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _may_reach(a, na, b, nb, percent: int):
    """The marks of two sets differ in no more bits than sets that reach the threshold differ in n-grams."""
    a, na, b, nb = (F.col(x) if isinstance(x, str) else x for x in (a, na, b, nb))
    both = na + nb
    allowed = both - 2 * F.ceil(percent * both / (100 + percent))
    words = MARK_BITS // 64
    differ = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, words)), F.bit_count(a[0].bitwiseXOR(b[0])))
    wide = (F.size(a) > words) & (F.size(b) > words)
    return (differ <= allowed) & F.when(wide, _wide_difference(a, b, words) <= allowed).otherwise(F.lit(True))


def _wide_difference(a, b, words: int):
    """Bits in which the wide runs of two marks differ, the longer one folded to the length of the shorter."""
    first = F.size(a) <= F.size(b)
    short, long = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    width = F.size(short) - words
    folds = F.sequence(F.lit(0), ((F.size(long) - words) / width).cast("int") - 1)
    start = F.slice(short, words + 1, width)
    folded = F.aggregate(folds, start, lambda acc, k: F.zip_with(acc, F.slice(long, words + 1 + k * width, width), lambda x, y: x.bitwiseXOR(y)))
    return F.aggregate(folded, F.lit(0).cast("long"), lambda acc, x: acc + F.bit_count(x))


def _as_pair(s: str, n: str, t: str, m: str) -> list:
    first = F.col(s) < F.col(t)
    return [
        F.least(s, t).alias("a"),
        F.greatest(s, t).alias("b"),
        F.when(first, F.col(n)).otherwise(F.col(m)).alias("na"),
        F.when(first, F.col(m)).otherwise(F.col(n)).alias("nb"),
    ]


def crossing_pairs(lists: DataFrame, lead: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): pairs of different components that share a list and may reach the threshold.

    In a long list a pair is left to an earlier long list that offers it as well. What is known of a set's lists are its
    ``FIRST_LISTS`` least: the least that a pair shares never leaves it to another, so no pair is lost, and near copies,
    which share most of their lists, are offered about once."""
    mixed = lists.join(lead.select("h", "lc", "size"), "h")
    firsts = lambda x: F.slice(F.sort_array(F.collect_list(x)), 1, FIRST_LISTS)
    known = mixed.where(F.col("size") > SMALL_LIST).groupBy("s").agg(firsts("h").alias("held"), firsts(F.when(F.col("near"), F.col("h"))).alias("near_in"))
    mixed = mixed.join(marks, "s").join(known, "s", "left").withColumn("alone", F.col("c") != F.col("lc"))
    names = ("s", "n", "c", "near", "mark", "held", "near_in", "alone")
    other = mixed.select(F.col("h").alias("h_t"), *[F.col(x).alias(f"{x}_t") for x in names])
    alone = mixed.where("alone").select("h", "size", *names)
    smaller = (F.col("n") < F.col("n_t")) | ((F.col("n") == F.col("n_t")) & (F.col("s") < F.col("s_t")))
    reach = F.when(smaller, F.col("near")).otherwise(F.col("near_t"))
    once = ~F.col("alone_t") | (F.col("s") < F.col("s_t"))
    shared = F.when(smaller, F.array_intersect("near_in", "held_t")).otherwise(F.array_intersect("near_in_t", "held"))
    earlier = (F.col("size") > SMALL_LIST) & F.coalesce(F.array_min(shared) < F.col("h"), F.lit(False))
    fitting = (F.col("c") != F.col("c_t")) & once & _fits("n", "n_t", percent) & reach & _may_reach("mark", "n", "mark_t", "n_t", percent)
    return alone.join(other, (F.col("h") == F.col("h_t")) & fitting & ~earlier).select(*_as_pair("s", "n", "s_t", "n_t"))


def set_components(postings: DataFrame, parts: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(s, c): the component of every set of the postings that links to another."""
    rank = postings.groupBy("s").agg((-F.count("*")).alias("rank"))  # sets with most shared n-grams are most central
    state = materialize(rank.withColumn("c", F.col("s")), "components")
    tried = None
    room = PAIRS_PER_POSTING * postings.count()
    k, more, last = 0, True, False
    while not last:
        lists = postings.join(state, "s")

        def leaders(order):
            lead = lists.groupBy("h").agg(
                F.min(F.struct(order.alias("o"), F.col("s").alias("ls"), F.col("n").alias("ln"), F.col("c").alias("lc"))).alias("l"),
                *[F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")],
            )
            return lead.where("lo <> hi").select("h", "l.ls", "l.ln", "l.lc", "size")

        lead = leaders(F.col("rank"))
        if k >= LEADER_ROUNDS:
            # all that is left: sets outside the leader's component with every member of another component
            last = not more or k >= MOST_ROUNDS or (lists.join(lead, "h").where("c <> lc").agg(F.sum("size")).first()[0] or 0) <= room
        if last:
            pairs = crossing_pairs(lists, lead, marks, percent)
        else:
            lead = leaders(F.xxhash64("s", "h", F.lit(k))) if k else lead
            outside = lists.join(lead, "h").where("c <> lc")
            pairs = outside.where(_fits("n", "ln", percent)).select(*_as_pair("s", "n", "ls", "ln"))
        k += 1
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = pairs.join(marks.toDF("a", "mark_a"), "a").join(marks.toDF("b", "mark_b"), "b")
        pairs = pairs.where(_may_reach("mark_a", "na", "mark_b", "nb", percent)).select("a", "b", "na", "nb")
        pairs = materialize(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        more = not pairs.isEmpty()
        if not more:
            continue
        links = linked(pairs, parts, percent)
        ends = state.select("s", "c")
        joined = links.join(ends.toDF("a", "ca"), "a").join(ends.toDF("b", "cb"), "b").select("ca", "cb").distinct()
        roots = materialize(star_components(joined, "ca", "cb"), "roots")
        more = not roots.isEmpty()
        state = materialize(
            state.join(roots.toDF("c", "root"), "c", "left").select("s", "rank", F.coalesce("root", "c").alias("c")), "components"
        )
    return state.select("s", "c")


def _sets_and_components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, row_key, n and s of every row, and of every set s its least doc_id d and its component c."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    counters = power_of_two(chars / 16, 1 << 16, COUNTERS)
    found = materialize(sets(docs, n, counters), "sets")
    buckets = frequency_buckets(found, counters)
    shared = spark.sparkContext.broadcast(buckets)
    rows = found.where("segment IS NULL").select("doc_id", "row_key", "n", "s")
    total = rows.agg(F.sum("n")).first()[0] or 0
    pieces = max(1, -(-total * (100 - percent) // (100 * FRAGMENT_POSTINGS)))
    candidates = materialize(shared_postings(docs, n, percent, shared, pieces), "candidates")
    marks = found.where("mark IS NOT NULL").select("s", "mark").join(candidates.select("s").distinct(), "s", "left_semi")
    marks = materialize(marks.groupBy("s").agg(F.first("mark").alias("mark")), "marks")
    postings = materialize(useful_postings(candidates, marks, percent), "postings")
    members = postings.select("s").distinct()
    bits = power_of_two(12 * members.count(), 1 << 10, MAX_BITS)
    wanted = spark.sparkContext.broadcast(of_column(members, "s", bits))
    parts = materialize(fragments(docs, n, shared, wanted, cuts(buckets, FRAGMENTS)), "fragments")
    roots = set_components(postings, parts, marks, percent)
    per_set = rows.where("s IS NOT NULL").groupBy("s").agg(F.min("doc_id").alias("d")).join(roots, "s", "left").select("s", "d", F.coalesce("c", "s").alias("c"))
    return rows, materialize(per_set, "sets")


def components(docs: DataFrame, n: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, per_set = _sets_and_components(docs, n, percent)
    # from sets to documents: a component's id is its least doc_id
    least = per_set.groupBy("c").agg(F.min("d").alias("component_id"))
    named = per_set.join(least, "c").select("s", "component_id")
    return rows.join(named, "s", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, n: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of every component: that of least doc_id (null last), of equal ones the one of least ``row_key``.

    Rows of the same doc_id and text are one document; of them the least row stays. Texts without words are components
    of their own."""
    rows, per_set = _sets_and_components(docs, n, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("m")
    chosen = rows.join(per_set.select("s", "c"), "s").groupBy("c").agg(first).select("m.row_key")
    chosen = chosen.union(rows.where("s IS NULL").select("row_key")).distinct()
    one = docs.groupBy(row_key().alias("_row_key")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return one.join(chosen.toDF("_row_key"), "_row_key", "left_semi").select("_row.*")
