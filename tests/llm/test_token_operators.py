"""Token files, packing and attribution against the tokenizers library used text by text."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavetally.llm import packing, token_counts, token_files
from wavetally.session import materialize, scratch_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["a b c", None, "", "word " * 9000, "Éa ß\n\nx", "same", "same", "漢字 <|endoftext|> x"]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("piece", F.lit("clash")).withColumn("start", F.lit(None).cast("string")).repartition(3)


def ids_of(path, text):
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


@pytest.mark.parametrize(("n", "top"), [(0, 0), (1, 0), (1, 9), (700, 2**40), (700, 50), (5000, 10**7)])
def test_elias_fano_round_trip_and_space(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    code = token_files.EliasFano.frombytes(memoryview(token_files.EliasFano.encode(values, top).tobytes()))
    assert (code.values() == values).all()
    assert all(code.select(i) == values[i] for i in range(0, n, 7))
    with pytest.raises(IndexError):
        code.select(n)
    if n >= 700 and top > n:
        assert 8 * len(code.tobytes()) <= n * (3 + np.log2(top / n)) + 400


@pytest.mark.parametrize("shard_chars", [10, 1 << 20])
def test_files_hold_all_ids_in_order(spark, shard_chars):
    rows = [(10 - i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (-7, "below zero")]
    path = scratch_path(spark, "files")
    manifest = materialize(token_files.write(frame(spark, rows), path, BYTE, shard_chars=shard_chars), "manifest")
    got = sorted((tuple(r) for r in token_files.read(spark, path, manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    want = sorted((d is not None, d or 0, len(i), zlib.crc32(i.tobytes())) for d, t in rows for i in [ids_of(BYTE, t)])
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == want
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()


def test_no_documents_make_no_file(spark):
    path = scratch_path(spark, "files")
    manifest = materialize(token_files.write(frame(spark, []), path, BYTE), "manifest")
    assert token_files.read(spark, path, manifest).count() == 0


def test_documents_of_a_shard_by_number(spark):
    rows = [(5, "five"), (9, "nine and more"), (7, None)]
    path = scratch_path(spark, "files")
    found = token_files.write(frame(spark, rows), path, BYTE).collect()
    shard = token_files.Shard(open(found[0]["path"], "rb").read())
    assert [shard.doc_id(i) for i in range(3)] == [5, 7, 9]
    assert shard.document(2).tolist() == ids_of(BYTE, "nine and more").tolist()


def check_packing(rows, pieces, capacity):
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, t in rows:
        ids = ids_of(WORD, t)
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), capacity.tokens))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    bins = {}
    for r in pieces:
        bins.setdefault(r["sequence_id"], []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == np.concatenate([[0], np.cumsum([r["length"] for r in held])[:-1]]).tolist()
        assert (np.array([sum(r["length"] for r in held), len(held), sum(r["length"] ** 2 for r in held)]) <= capacity.vector).all()
    return len(bins)


def test_packing_keeps_every_token_once(spark):
    rnd = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "w " * rnd.randint(0, 90)) for i in range(200)]
    capacity = packing.Capacity(tokens=64)
    found = packing.pack(packing.cut(frame(spark, rows), WORD, 64), capacity).collect()
    total = sum(len(ids_of(WORD, t)) for _, t in rows)
    assert check_packing(rows, found, capacity) <= -(-total // 64) * 1.03 + 1
    assert packing.pack(packing.cut(frame(spark, []), WORD), capacity).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(2).integers(1, 100, 800)
    capacity = packing.Capacity(tokens=100, pieces=3, attention=4000 + 100 * 100 // 2 + 1000)
    sequence, offset = packing.fill(lengths, capacity, rule=rule)
    for s in np.unique(sequence):
        own = lengths[sequence == s]
        assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= capacity.attention
        assert sorted(offset[sequence == s].tolist())[0] == 0
    with pytest.raises(ValueError, match="capacity"):
        packing.fill(np.array([101]), capacity, rule=rule)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_by_the_librarys_offsets(spark, rule):
    rows = [(i, "ab", t) for i, t in enumerate([*TEXTS[:3], "title\nbody text\nmore", "x\n\n\ny", "def ghi", "\n", "same", "same"])] + [(50, None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.count_tokens(df, ["source", "text"], BYTE, rule, title="text").collect()}
    tk = Tokenizer.from_file(BYTE)
    for d, s, t in rows:
        s, t = s or "", t or ""
        cut = t.find("\n") + 1 or len(t)
        parts = [s, t[:cut], t[cut:]]
        enc = tk.encode("".join(parts), add_special_tokens=False)
        edges = np.cumsum([0, *map(len, parts)])
        counts, crossing = [0, 0, 0], 0
        for a, b in enc.offsets:
            within = [max(0, min(b, edges[k + 1]) - max(a, edges[k])) for k in range(3)]
            touched = [k for k in range(3) if within[k]]
            crossing += len(touched) > 1
            counts[{"first": touched[0], "last": touched[-1], "largest": int(np.argmax(within))}[rule]] += 1
        assert got[d] == (len(enc.ids), crossing, *counts), (d, rule)
        assert sum(got[d][2:]) == got[d][0]


def test_a_vocabulary_without_bytes_has_no_offsets(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="byte-level"):
        token_counts.count_tokens(df, ["text"], WORD).count()
    with pytest.raises(ValueError, match="rule"):
        token_counts.count_tokens(df, ["text"], BYTE, "none")
