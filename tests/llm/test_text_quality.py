"""Quality rules, quality classifier, language identification, decontamination and page text."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavetally.llm import decontamination, html_text, language_id, quality_classifier, quality_rules

EDGES = [None, "", "  \n ", "word", "A-B! c\nc\nc", "the same eight words come again and again here " * 30, "é" * 5000, "###  %% $$ &&& |" * 20]


def docs(spark, texts, start=0):
    df = spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)] + [(None, "no id at all")], "doc_id long, text string")
    return df.withColumn("lang", F.lit("en")).withColumn("score", F.lit("clash")).withColumn("kept", F.lit(1)).repartition(3)


# ------------------------------------------------------------------ rules


def test_measurements_by_plain_counting():
    rnd = random.Random(0)
    texts = EDGES + [" ".join(rnd.choice("abc") for _ in range(60)) + "\n" + rnd.choice(["x", "x y", ""]) for _ in range(40)]
    got = quality_rules.measurements(pa.array(texts))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if x.strip()]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t[:40]


def test_policies_and_ablation_work_on_bits(spark):
    entries = quality_rules.ledger(docs(spark, EDGES))
    assert entries.count() == len(EDGES) + 1
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_policy(entries).collect()}
    assert not any(kept[i] for i in range(5))
    loose = quality_rules.Policy("loose", hard=quality_rules.mask("symbols"))
    held = quality_rules.apply_policy(entries, loose)
    n = held.where("kept").count()
    table = {r["rule"]: r for r in quality_rules.ablation(entries, loose).collect()}
    assert table["symbols"]["kept"] == n and table["symbols"]["kept_without"] == len(EDGES) + 1
    assert table["few_words"]["kept_without"] == n and table["few_words"]["fails"] == 7
    assert quality_rules.ledger(docs(spark, EDGES).limit(0)).count() == 0


# ------------------------------------------------------------------ classifier


def test_ordinal_model_orders_grades_and_catches_marks(spark):
    rnd = random.Random(5)
    common = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [rnd.choice(common) for _ in range(rnd.randint(20, 200))]
        kind = i % 3
        if kind == 0:
            w = [f"{x}###" for x in w]
        if kind == 1:
            w[rnd.randrange(len(w))] = rnd.choice(["moron", "idiot"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind > 0), int(kind == 1)))
    d = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string").withColumn("kept", F.lit("x"))
    l = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(d.where("doc_id % 5 <> 0"), l)
    assert model.thresholds[0] < model.thresholds[1]
    found = {r["doc_id"]: r for r in quality_classifier.score(d, model).collect()}
    out = [(i % 3, found[i]) for i in range(0, 900, 5)]
    assert np.mean([abs(r["expected_grade"] - k) < 0.5 for k, r in out]) > 0.97
    assert np.mean([r["kept"] == (k == 2) for k, r in out]) > 0.97
    assert found[5000]["p_good"] == found[5001]["p_good"]


def test_classifier_without_two_grades(spark):
    d = docs(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.score(d, quality_classifier.train(d, none)).where("kept").count() == len(EDGES) + 1
    bad = spark.createDataFrame([(3, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.score(d, quality_classifier.train(d, bad)).where("kept").count() == 0


# ------------------------------------------------------------------ language


def test_grams_do_not_cross_blanks_or_texts():
    grams, owner = language_id.text_grams(pa.array(["Ab1cde", None, "é f"]))
    unpack = lambda g: (int(g).to_bytes(8, "big").lstrip(b"\0"))
    got = sorted((int(o), unpack(g)[1:]) for g, o in zip(grams, owner))
    want = []
    for i, t in enumerate([b" ab cde ", b" ", "\xe9".encode().join([b" ", b" f "])]):
        for n in language_id.SIZES:
            for k in range(len(t) - n + 1):
                g = t[k : k + n]
                if b" " not in g[1:-1] and not (g[:1] == b" " == g[-1:]):
                    want.append((i, g))
    assert got == sorted(want)


def test_filters_agree_with_exact_sets(spark):
    rnd = random.Random(7)
    parts = {"en": ["th", "er", "ing", "ou"], "de": ["sch", "ei", "ung", "ü"], "fr": ["é", "eau", "oi", "le"]}
    make = lambda lang: " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(3, 60)))
    rows = [(i, make(lang), lang) for i in range(400) for lang in [rnd.choice(list(parts))]]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "ths", None)], "doc_id long, text string, lang string")
    model = language_id.train(df.where(~language_id.held_out()))
    assert model.languages == ["de", "en", "fr"]
    counts = {x: collections.Counter() for x in parts}
    learnt = {r["doc_id"] for r in df.where(~language_id.held_out()).collect()}
    for i, t, lang in rows:
        if i in learnt:
            counts[lang].update(language_id.text_grams(pa.array([t]))[0].tolist())
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    for g in set().union(*share.values()):
        most = max(s.get(g, 0) for s in share.values())
        bits = int(model.masks(np.array([g], np.uint64))[0])
        for k, x in enumerate(model.languages):
            if share[x].get(g, 0) >= max(language_id.MIN_SHARE, language_id.MIN_RELATIVE * most):
                assert bits >> k & 1
    found = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert np.mean([found[i]["lang_pred"] == lang for i, _, lang in rows if i not in learnt]) > 0.95
    assert found[900]["lang_pred"] == "und" and found[900]["score"] == 0.0


def test_more_languages_than_bits_in_a_byte():
    rnd = np.random.default_rng(8)
    masks = rnd.integers(0, 1 << 20, 5000).astype(np.uint32)
    owner = np.concatenate([np.sort(rnd.integers(0, 7, 2500)), np.sort(rnd.integers(0, 7, 2500))])  # text 7 has no n-gram
    want = [[np.count_nonzero((owner == i) & (masks >> k & 1 > 0)) for k in range(19)] for i in range(8)]
    assert language_id._hits(masks, owner, 8, 19).tolist() == want
    assert language_id._hits(masks[:0], owner[:0], 2, 19).tolist() == [[0] * 19] * 2


def test_language_counts_shuffle_once_and_texts_stay_in_python(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the other", "en"), ("the", "de"), (None, "en"), ("und", None), ("the", "en")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = language_id.gram_counts(df)
    plan = counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    n = {(r.gram.to_bytes(8, "big").lstrip(b"\0")[1:].decode(), k): v for r in counts.collect() for k, v in r.n.items()}
    assert n["the", "en"] == 3 and n["the", "de"] == 1 and n[" the", "en"] == 2 and n[" othe", "en"] == 1 and ("und", "en") not in n
    model = language_id.train(df)
    whole = language_id.identify(df, model)
    part = language_id.identify(df, model, ["doc_id"])
    assert part.columns == ["doc_id", "lang_pred", "score"]
    assert sorted(part.collect()) == sorted(whole.select(*part.columns).collect())


def test_language_edges(spark):
    d = docs(spark, [*EDGES, "12 34 !!", "漢字"])
    empty = language_id.train(d.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(d, empty).collect()} == {"und"}
    found = {r["doc_id"]: r for r in language_id.identify(d, language_id.train(d)).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (0, 1, 2, 7, 8))
    assert found[5]["lang_pred"] == "en" and 0 < found[5]["score"] <= 1


# ------------------------------------------------------------------ decontamination


def plain_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(0, 25))
        score, a0, a1, b0, b1 = decontamination.align(a, b)
        assert score == plain_score(a, b)
        assert plain_score(a[a0:a1], b[b0:b1]) == score


def test_copies_and_edited_copies_are_found_and_nothing_else(spark):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(500)] + ["the", "of", "and", "to"] * 60
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [text(rnd.randint(15, 60)) for _ in range(30)]
    rows, want = [], set()
    for i in range(200):
        w = text(rnd.randint(0, 300))
        if i % 3 == 0:
            k = 0 if i % 2 else rnd.randrange(30)  # one item leaks very often
            copy = [x if rnd.random() > 0.1 else rnd.choice(vocab) for x in items[k]]
            del copy[rnd.randrange(len(copy))]
            w[rnd.randint(0, len(w)) :] = copy + text(5)
            want.add((i, k))
        rows.append((i, ", ".join(w).upper() if i % 2 else " ".join(w)))
    bench = spark.createDataFrame([*[(k, " ".join(x)) for k, x in enumerate(items)], (98, None), (99, "the of")], "item_id long, text string")
    df = spark.createDataFrame([*rows, (500, None), (None, "")], "doc_id long, text string").withColumn("leaks", F.lit("clash"))
    found = decontamination.with_leaks(df, bench)
    got = {(r["doc_id"], x["item_id"]) for r in found.collect() for x in r["leaks"]}
    assert got == want
    assert decontamination.decontaminated(df, bench).count() == 202 - len({i for i, _ in want})
    assert decontamination.with_leaks(df, bench.limit(0)).where(F.size("leaks") > 0).count() == 0
    with pytest.raises(ValueError, match="exceed"):
        decontamination.load_items(bench, max_words=10)


def test_leaks_are_those_of_plain_alignment_of_all_pairs(spark):
    rnd = random.Random(5)
    text = lambda n: [f"w{int(400 * rnd.random() ** 3)}" for _ in range(n)]
    items = [text(rnd.randint(3, 40)) for _ in range(60)]
    docs = []
    for k in range(240):
        copy, step = list(items[k % 60]), 2 + k % 5
        if k < 120:  # every step-th word is another one
            copy[step - 1 :: step] = [f"x{k}"] * len(copy[step - 1 :: step])
        elif k < 180:  # a word behind every word, or behind all but a few
            copy = [x for j, w in enumerate(copy) for x in ([w, f"x{k}"] if j % (4 * step) or k % 2 else [w])]
        else:
            copy = [w for w in copy if rnd.random() > step / 16]
        docs.append(text(rnd.randint(0, 60)) + copy + text(rnd.randint(0, 60)))
    number = {}
    ids = lambda t: np.array([number.setdefault(w, len(number)) for w in t])
    want = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            score = decontamination.align(ids(item), ids(doc))[0]
            if score >= len(item):
                want[d, i] = score / (2 * len(item))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string")
    found = decontamination.with_leaks(df, bench).collect()
    assert {(r["doc_id"], x["item_id"]): x["similarity"] for r in found for x in r["leaks"]} == want
    with pytest.raises(ValueError, match="too low"):
        decontamination.with_leaks(df, bench, 0.3)


# ------------------------------------------------------------------ pages


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("<p>a<p>b", "a\nb"),
        ("<article><h1>T</h1><p>x <b>y</b>&amp; z</article><footer>f</footer>", "T\nx y& z"),
        ("<nav>n</nav><p>a<script>if(a<b){'</p>'}</script>b", "ab"),
        ("<ul><li>1<li>2</ul><aside>s</aside>", "1\n2"),
        ("<div class='post comments'>no</div><p>a\n\t b&nbsp;c", "a b c"),
        ("<article>in<aside>no</aside>in2<form>q</form></article>out", "in\nin2"),
        ("x < y <span class=ad>zz</span>k", "x < y k"),
        ("<!-- <p>c</p> --><title>t</title>u<style>v", "u"),
        ("<p title='>'>q</p></div></p>r", "q\nr"),
        ("a<br>b<hr>c", "a b\nc"),
    ],
)
def test_blocks_of_a_page(source, text):
    assert html_text.Page(source).text == text


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(i=0;i<n;i++){f(i)}</script>",
        "<SCRIPT>s='<!--'</Script\n>",
        "<script>if(a<b)f()</script>",
        "<title>a <b & c</title>",
        "<style>a<b{}</style><script>x='</scripts>'; y<z</script>",
        "<textarea><p title=\"</textarea>",
    ],
)
def test_text_behind_raw_elements_stays(raw):
    assert html_text.Page(f"<p>a{raw}b<p>c").text == "ab\nc"
    assert html_text.Page(f"<head>{raw}</head><article>b<p>c</article><script>1</script>").text == "b\nc"
    assert html_text.Page("<p>a<script>i<n").text == "a"


def test_recurring_subtrees_of_a_host_go(spark):
    page = lambda i: f"<body><div><p>Site name</p><p>Offer {i % 2}</p></div><div><p>Own text {i}</p><p>Site name</p></div></body>"
    rows = [(i, f"https://www.a.b:80/{i}?x", page(i)) for i in range(12)] + [(20, "http://c.d/", page(1)), (21, None, None), (22, "nonsense", ""), (0, "https://a.b/0", page(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("recurring", F.lit(1))
    got = sorted((r["page_id"], r["text"]) for r in html_text.main_text(df).collect())
    want = [(i, f"Own text {i}") for i in range(12)] + [(0, "Own text 0"), (20, "Site name\nOffer 1\nOwn text 1\nSite name"), (21, ""), (22, "")]
    assert got == sorted(want)
    assert html_text.main_text(df.limit(0)).count() == 0


def extracted(spark, sources):
    rows = [(i, "https://a.b/", source) for i, source in enumerate(sources)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return [r["text"] for r in sorted(html_text.main_text(df).collect(), key=lambda r: r["page_id"])]


def test_recurring_blocks_inside_articles_go(spark):
    page = lambda i: f"<article><h1>Title {i}</h1><div><p>Join our list</p></div><p>Own text of page {i}</p></article>"
    assert extracted(spark, [page(i) for i in range(8)]) == [f"Title {i}\nOwn text of page {i}" for i in range(8)]


def test_copied_articles_stay(spark):
    page = lambda i, k=0: f"<nav>{k}</nav><article><h1>Title {i}</h1><p>Own text of page {i}</p></article>"
    got = extracted(spark, [page(0, k) for k in range(20)] + [page(i) for i in range(1, 7)])
    assert got == [f"Title {i}\nOwn text of page {i}" for i in [0] * 20 + [*range(1, 7)]]


def test_main_content_has_most_of_the_text_that_is_left(spark):
    page = lambda i: f"<article>Our paper, now in print every day and on every table</article><div>Real text of page {i}</div><article>Tip {i}</article>"
    assert extracted(spark, [page(i) for i in range(8)]) == [f"Real text of page {i}\nTip {i}" for i in range(8)]


@pytest.mark.parametrize("mark", ["class=comment", "class='odd comment'", "id='comment-12'", "class=comment-body"])
def test_reader_comments_marked_as_articles_go(mark):
    assert html_text.Page(f"<article class='post category-social'>Own text</article><article {mark}>I am first</article>").text == "Own text"
