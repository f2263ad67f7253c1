"""Odd inputs that once broke an operator: long runs of digits, repeated limits, empty lists, tiny sources, short items."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panemill.llm import blocks, decon, langid, lengths, licenses, mix, pii, search, tokens, urls
from tests.llm.test_operators import documents, plain_spans, words_of


@pytest.mark.parametrize("text", ["0" * 5000 + "1.2.3.4", "1." * 30_000, "9" * 100_000, "0.0.0." + "0" * 70_000, ("1" * 4400 + ".") * 4, "+" + "0" * 90_000, "-".join(["4111"] * 20_000), "@" * 50_000, "a@" + "b." * 40_000])
def test_long_runs_of_digits_and_dots(text):
    some = text[:1500] + text[-1500:]  # the plain patterns take the square of a text's length
    assert [(s, pii.KINDS.index(k), e) for s, k, e in pii.base_spans(some)] == plain_spans(some)
    pii.nodes_of(text, pii.base_spans(text))
    urls.term_hits("http://" + text, urls.STRICT_TERMS, urls.SOFT_TERMS)
    assert licenses.scan(text.encode().lower(), licenses.rare_index(licenses.templates(), 1, {})).found == []
    assert search.term_counts(text.encode().lower()) == Counter(search.TERM.findall(text.encode().lower()))


def test_random_digits_zeros_and_dots_through_the_operators(spark):
    rng = random.Random(17)
    texts = ["".join(rng.choice("0019.+- (@x") for _ in range(rng.choice((3, 40, 3000)))) for _ in range(60)] + ["0" * 5000 + "1.2.3.4", "0" * 100_000]
    docs = documents(spark, texts)
    assert {r.doc_id for r in pii.personal_data(docs).collect()} == set(range(len(texts)))
    assert lengths.encoded_lengths(docs).count() == len(texts)
    assert blocks.read_token_files(blocks.write_token_files(docs)).count() == len(texts)
    assert langid.identify(docs, langid.learn(documents(spark, ["some words here", "ein paar andere"], ["en", "de"]))).count() == len(texts)
    assert decon.contained_items(docs, spark.createDataFrame([(1, texts[5])], "item_id long, text string")).count() >= 0


def test_a_column_that_holds_no_languages(spark):
    docs = documents(spark, [f"text {i}" for i in range(langid.LANGUAGES + 1)], [f"l{i}" for i in range(langid.LANGUAGES + 1)])
    with pytest.raises(ValueError, match="languages"):
        langid.learn(docs)


def test_a_limit_that_is_named_twice(spark):
    histogram = lengths.length_histogram(spark.createDataFrame([(3,), (9,)], "n_tokens long"))
    rows = [tuple(r) for r in lengths.context_totals(histogram, [7, 7, 7]).collect()]
    assert rows == [tuple(r) for r in lengths.context_totals(histogram, [7]).collect()] and len(rows) == 1
    assert lengths.context_totals(histogram, [7, 7]).first().docs == 2
    assert lengths.context_totals(histogram, []).count() == 0
    assert lengths.length_quantiles(histogram, [0.5, 0.5]).collect() == lengths.length_quantiles(histogram, [0.5]).collect()


def test_urls_without_rules_or_terms(spark):
    pages = spark.createDataFrame([(1, "http://porn.net/x"), (2, None), (3, "http://a.org/fr/porn"), (4, "http://" + "a/" * 50_000 + "porn")], "page_id long, url string")
    verdicts = lambda **options: [r.verdict for r in urls.filter_urls(pages, **options).orderBy("page_id").collect()]
    assert verdicts() == ["block", "allow", "allow", "block"]
    assert verdicts(strict=(), soft=()) == ["block", "allow", "allow", "allow"]
    assert verdicts(rules=()) == ["block", "allow", "block", "block"]
    assert verdicts(rules=(), strict=(), soft=()) == ["allow"] * 4


def test_a_tiny_source_beside_a_large_one(spark):
    rates = spark.createDataFrame([("tiny", 3e9), ("large", 2_515_844.0), ("some", 40.5), ("none", 0.0)], "group string, rate double")
    steps = {r["group"]: (r["first"], np.array(r.steps)) for r in mix.poisson_steps(rates).collect()}
    assert set(steps) == {"tiny", "large", "some"} and len(steps["large"][1]) < 40_000 and len(steps["tiny"][1]) < 1_200_000
    for name, rate in (("tiny", 3e9), ("large", 2_515_844.0), ("some", 40.5)):
        first, below = steps[name]
        p = np.diff(below, prepend=0.0)
        places = first + np.arange(len(p), dtype=float)
        assert abs(below[-1] - 1) < 1e-12 and abs((places * p).sum() - rate) < 1e-9 * rate
        assert abs(((places - rate) ** 2 * p).sum() / rate - 1) < 1e-6
    docs = documents(spark, ["x"] + ["y" * 3999] * 5, sources=["tiny"] + ["big"] * 5)
    n = Counter(r.doc_id for r in mix.poisson_mix(docs, {"tiny": 1.0, "big": 1.0}, epochs=1.0).select("doc_id").collect())
    assert abs(n[0] - 5000) < 500


def test_short_items_inside_long_documents(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.choice((1, 2, 4, 5, 60)))) for _ in range(60)] + [None, "", "W1 w2"]
    items = [(1, "w1"), (2, "w1 W2"), (3, "w3 w4 w5"), (4, "w1 w2 w3 w4"), (5, "w1 w2 w3 w4 w5"), (6, None), (7, ""), (2, "w9 w9 w9 w9 w9 w9"), (8, " ".join(texts[4].split()[:40]) or "w0")]

    def shingles(text, n):
        w = words_of(text)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else set()

    want = set()
    for d, text in enumerate(texts):
        for item, wanted in items:
            w = words_of(wanted)
            own = shingles(wanted, 5) if len(w) >= 5 else {tuple(w)} if w else set()
            held = own & (shingles(text, 5) if len(w) >= 5 else shingles(text, len(w)) if w else set())
            if own and 100 * len(held) >= 80 * len(own):
                want.add((d, item))
    rows = decon.contained_items(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string").withColumn("hashes", F.lit(1))).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) and {i for _, i in want} >= {1, 2, 3}
    assert all(re.fullmatch(r"\d+", str(r.n_shared)) for r in rows)


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_the_field_predicts_labels_of_texts_that_it_has_not_seen(spark):
    """Held-out pseudo-likelihood: better than the labels' shares, and better than without the skip chains."""
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").select("text").collect()]
    halves = [Counter(r for t in texts[k::2] for r in pii.observed(t)) for k in (0, 1)]
    keys = sorted(halves[0])
    field = pii.trained(np.array(keys), np.array([halves[0][k] for k in keys], float))
    rows = np.array(sorted(halves[1]))
    times = np.array([halves[1][tuple(r)] for r in rows.tolist()], float)

    def likelihood(scores):
        top = scores.max(axis=1, keepdims=True)
        return ((scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True)))[np.arange(len(rows)), rows[:, 1]] * times).sum() / times.sum()

    size = len(pii.LABELS)
    around = np.eye(size + 1)[rows[:, 2]][:, :size] @ field.chain + np.eye(size + 1)[rows[:, 3]][:, :size] @ field.chain.T
    whole = likelihood(field.own(rows[:, 0]) + around + rows[:, 4:] @ field.skip)
    seen = np.array(keys)
    shares = np.log(np.bincount(seen[:, 1], [halves[0][k] for k in keys], size) + 1e-3)
    assert whole > likelihood(np.tile(shares, (len(rows), 1))) + 0.2
    assert whole >= likelihood(field.own(rows[:, 0]) + around) - 1e-3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    judged = langid.op10_language_spans(spark, DATA).join(docs, "doc_id").where("held_out AND lang_pred <> 'und' AND lang IS NOT NULL")
    right, n = judged.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right >= 0.99 * n
