"""The pipeline's stages, each held against brute force on its own input."""

import duckdb
import public_tokenizers
import pytest
from test_line_dedup import brute as plain_lines
from test_ngram_join import brute as plain_components
from tokenizers import Tokenizer

import corpus_pipeline
from wavetally.session import materialize

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage, by name."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    docs = docs.unionByName(spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "s", 0), (90003, "12 34", "en", "s", 5)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        out[name] = (before, docs)
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_all_but_the_last_stage_return_documents(stages):
    assert list(stages) == ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "best_fit_packing"]
    assert all(after.columns == COLUMNS for name, (_, after) in stages.items() if name != "best_fit_packing")


def test_language_id_keeps_texts_in_a_language(stages):
    before, after = stages["language_id"]
    assert {d for d, _ in rows(before)} - {d for d, _ in rows(after)} >= {90001, 90002, 90003}
    assert before.count() - after.count() <= 5


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    want = [(d, t) for d, t, *_ in plain_lines(rows(before)) if t.strip(" ")]
    assert sorted(rows(after)) == sorted(want)
    assert after.where("n_chars <> length(text)").count() == 0


def test_one_document_of_each_group_stays(stages):
    before, after = stages["ngram_jaccard_join"]
    assert sorted(d for d, _ in rows(after)) == sorted({c for _, _, c in plain_components(rows(before))})


def test_null_and_repeated_ids_in_the_join_stage(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    near = text(1) + " end"
    data = [(None, text(0)), (None, text(9)), (3, text(1)), (2, near), (None, near), (5, text(2)), (5, text(2)), (5, text(2)), (2, text(4)), (1, text(4)), (7, text(5)), (7, text(6))]
    data += [(None, text(7)), (None, text(7)), (8, "\n"), (9, "\n"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.ngram_jaccard_join(spark, docs.repartition(3), SF)
    want = [(None, text(0)), (None, text(9)), (2, near), (5, text(2)), (1, text(4)), (7, text(5)), (7, text(6)), (None, text(7)), (8, "\n"), (9, "\n"), (None, None)]
    assert got.columns == COLUMNS
    assert sorted(rows(got), key=repr) == sorted(want, key=repr)


def test_leaks_go(stages):
    before, after = stages["decontamination"]
    items = [t for (t,) in duckdb.connect().execute(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    leaked = {d for d, t in rows(before) if any(x in t for x in items)}
    assert not leaked & {d for d, _ in rows(after)}
    assert before.count() - after.count() <= len(leaked) + 2


def test_every_token_is_packed(stages):
    before, after = stages["best_fit_packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows(before))
    assert after.agg({"length": "sum"}).first()[0] == total
    assert after.select("sequence_id").distinct().count() <= -(-total // 2048) + 2
    assert after.select("doc_id").distinct().count() == before.count()
