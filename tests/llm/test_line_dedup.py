"""Line dedup against a plain count of keys."""

import random

import pytest
from pyspark.sql import functions as F

from wavetally.llm import line_dedup


def brute(rows, min_chars=20, min_docs=3):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, (_, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(i)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for x in lines:
            held = holders.get(key(x), [])
            best = max((rows[i][0] for i in held if rows[i][0] is not None), default=None)
            if len(held) < min_docs or d == best:
                kept.append(x)
        out.append((d, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(7)).withColumn("n_lines", F.lit("clash")).repartition(4)
    found = line_dedup.drop_repeated_lines(df, **kw)
    assert found.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    return sorted((tuple(r) for r in found.drop("key").collect()), key=repr)


def test_random_lines(spark):
    rnd = random.Random(2)
    pool = [f"this is a shared line number {i}" for i in range(30)] + ["short", "", "   ", "ä" * 19, "ä" * 20, "Ä" * 20]
    rows = []
    for d in range(150):
        lines = [rnd.choice(pool) if rnd.random() < 0.5 else f"own line of document {d} {rnd.random()}" for _ in range(rnd.randint(0, 8))]
        rows.append((d, "\n".join(x.upper() if rnd.random() < 0.2 else f"\t{x} " if rnd.random() < 0.2 else x for x in lines)))
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    line = "a line that many documents have"
    rows = [(1, None), (2, ""), (3, line), (3, line), (4, f"{line}\n{line}\nown"), (None, line), (None, f"x\n{line}"), (5, "y\n" * 3000 + line)]
    assert run(spark, rows) == brute(rows)
    only_unnamed = [(None, line)] * 3
    assert run(spark, only_unnamed) == brute(only_unnamed)
    assert run(spark, []) == []
    with pytest.raises(ValueError, match="min_docs"):
        run(spark, rows, min_docs=1)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_BITS", 1 << 10)
    rows = [(i, f"line of its own with number {i}\nthe line that everyone shares\npair of lines here {i // 2}") for i in range(400)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, min_docs=2) == brute(rows, min_docs=2)
