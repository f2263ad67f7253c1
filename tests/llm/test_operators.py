"""The corpus operators against plain Python, on small tables with every odd case: nulls, empty and long texts, ties,
repeated rows, empty tables, and extra columns with clashing names."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panemill.llm import blocks, components, decon, langid, lengths, lm, mix, neardup, pii, shingles, stream, tokens, urls
from panemill.llm.common import slices, utf8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "One two", "a b c d e f g", "x" * 5000, "é ñ ü ß", "\x00\x1c\x85  y", "same words here again and again", "same words here again and again", "😀 emoji text"]


def documents(spark, texts, langs=None, sources=None, first=0):
    rows = [(first + i, t, (langs or ["en"] * len(texts))[i], (sources or ["src0"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def words_of(text):
    return (text or "").encode().lower().split()


def shingle_set(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


# mixing


def test_mix_repeats_by_the_inverted_distribution(spark):
    docs = documents(spark, ["a" * 9, None, "b" * 19, "c"] * 50, sources=(["src0", None, "rare", "off"] * 50)).withColumn("copy", F.lit("old")).withColumn("Shuffle_Key", F.lit(1))
    weights = {"src0": 2.0, "rare": 1.0, "off": 0.0}
    got = mix.poisson_mix(docs, weights, other_weight=1.0, epochs=2.0, seed="s")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"]
    rows = got.collect()
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    sizes = {"src0": 10 * 50, "*": 1 * 50, "rare": 20 * 50, "off": 2 * 50}
    share = {"src0": 2.0, "rare": 1.0, "*": 1.0, "off": 0.0}
    want = Counter()
    for i in range(200):
        group = ["src0", "*", "rare", "off"][i % 4]
        rate = share[group] / 4 * 2.0 * sum(sizes.values()) / sizes[group]
        u = int(hashlib.md5(f"s:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        p = below = np.exp(-rate)
        n = 0
        while rate > 0 and below <= u:
            n += 1
            p *= rate / n
            below += p
        want[i] = n
    assert Counter(r.doc_id for r in rows) == +want
    assert all(sorted(r.copy for r in rows if r.doc_id == i) == list(range(1, n + 1)) for i, n in list(want.items())[:20])
    assert mix.poisson_mix(docs.limit(0), weights).count() == 0
    assert mix.poisson_mix(docs, {"src0": 0.0}, other_weight=0.0).count() == 0
    with pytest.raises(ValueError):
        mix.poisson_mix(docs, {"src0": -1.0})


def test_rates_need_no_python_workers(spark):
    asked = mix.source_rates(spark.range(2).selectExpr("'x' AS text", "'a' AS source"), F.col("source"), {"a": 1.0, "b": 2.0}, epochs=3.0)
    assert [tuple(r) for r in asked.collect()] == [("a", 3.0)]
    assert "ExistingRDD" not in asked._jdf.queryExecution().toString()


def test_mix_meets_its_targets(spark):
    docs = documents(spark, ["x" * 99] * 4000, sources=["big"] * 3000 + ["small"] * 1000)
    n = dict(mix.poisson_mix(docs, {"big": 1.0, "small": 1.0}, epochs=1.0).groupBy("source").count().collect())
    assert abs(n["big"] - 2000) < 200 and abs(n["small"] - 2000) < 200


# URLs


def test_url_parts_rules_and_terms(spark):
    rows = [
        ("https://A.Example.COM/de/1?q", "a.example.com", "/de/1", "example.com/de/", "block"),
        ("http://example.com/fr/", "example.com", "/fr/", None, "allow"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://x.net/", "x.net", "/", "net/", "block"),
        ("http://a.example.net/en/porn", "a.example.net", "/en/porn", "example.net/en/", "allow"),
        ("http://a.org/fr/x#f", "a.org", "/fr/x", "org/fr/", "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("no-scheme/porn", "", "", None, "block"),
        ("http://a.com/pornography", "a.com", "/pornography", None, "allow"),
        ("http://a.com/PORN", "a.com", "/PORN", None, "block"),
        ("http://a.com/free-free", "a.com", "/free-free", None, "allow"),
        ("http://a.com/free-casino", "a.com", "/free-casino", None, "block"),
        ("a\nb://h\n?x/y", "h\n", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0], "old") for i, r in enumerate(rows)], "page_id long, url string, host string")
    got = urls.filter_urls(pages).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [r[1:] for r in rows]
    assert urls.filter_urls(pages.limit(0)).count() == 0
    assert urls.term_hits("xxx.xxx/porn,free/free.casino", urls.STRICT_TERMS, urls.SOFT_TERMS) == (3, 2)


# near duplicates


def brute_components(texts, n):
    sets = [shingle_set(t, n) for t in texts]
    label = list(range(len(texts)))
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label, [len(s) for s in sets]


def near_copies(rng, base, count, most):
    out = []
    for _ in range(count):
        w = base.split()
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_against_all_pairs(spark, words):
    rng = random.Random(words)
    texts = list(ODD)
    for size, most in ((6, 2), (12, 3), (40, 8), (150, 25), (700, 60)):
        texts += near_copies(rng, prose(rng, size, 2000), 25, most)
    passage = prose(rng, 60, 2000)
    texts += [passage + " " + prose(rng, 40, 2000) for _ in range(70)]  # share a passage, but are not linked
    texts += [prose(rng, rng.randrange(3, 9), 3) for _ in range(40)]
    texts += texts[20:40]
    rng.shuffle(texts)
    label, sizes = brute_components(texts, words)
    docs = documents(spark, texts).withColumn("n", F.lit(1)).withColumn("component_id", F.lit(2))
    got = neardup.near_duplicates(docs, words=words).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == label
    assert [r.n_shingles for r in got] == sizes
    assert [r.kept for r in got] == [i == x for i, x in enumerate(label)]


def test_near_duplicates_of_nothing_and_without_ids(spark):
    docs = documents(spark, ["a b c d e", "a b c d e"])
    assert neardup.near_duplicates(docs.limit(0), words=2).count() == 0
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r.component_id, r.kept) for r in neardup.near_duplicates(nameless.union(docs), words=2).orderBy("doc_id").collect()] == [(None, True)] * 2 + [(0, True), (0, False)]


def test_copies_around_the_threshold_and_a_common_passage(spark):
    rng = random.Random(31)
    base = prose(rng, 150, 3000).split()
    texts = []
    for i in range(150):  # some copies are linked to one other at most, many to none
        w = list(base)
        for _ in range(rng.randrange(15)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(30)}"
        texts.append(" ".join(w))
    long = [f"l{i}" for i in range(500)]
    texts += [" ".join(long[: 500 - 13 * i] + prose(rng, 13 * i, 3000).split()) for i in range(14)]
    passage = prose(rng, 60, 3000)
    texts += [prose(rng, 13 + i % 5, 3000) + " " + passage for i in range(60)]
    rng.shuffle(texts)
    for words in (2, 5):
        label, _ = brute_components(texts, words)
        got = neardup.near_duplicates(documents(spark, texts), words=words).orderBy("doc_id").collect()
        assert [r.component_id for r in got] == label and 30 < len(set(label)) < len(texts) - 30


@pytest.mark.parametrize("words", [2, 5])
def test_the_exact_setting_agrees_with_sketches_and_all_pairs(spark, words):
    rng = random.Random(40 + words)
    base = prose(rng, 150, 3000).split()
    texts = [*ODD, *near_copies(rng, prose(rng, 300, 2000), 30, 40), *near_copies(rng, prose(rng, 7, 2000), 20, 3)]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(15)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(30)}"
        texts.append(" ".join(w))
    template = prose(rng, 80, 3000)
    texts += [template + " " + prose(rng, rng.randrange(5, 25), 3000) for _ in range(60)]
    label, _ = brute_components(texts, words)
    docs = documents(spark, texts)
    for exact in (True, False):
        got = neardup.near_duplicates(docs, words=words, exact=exact).orderBy("doc_id").collect()
        assert [r.component_id for r in got] == label


def test_pages_of_one_template_do_not_meet(spark):
    """Pairs that are looked at grow with the pages, not with their square."""
    rng = random.Random(41)
    template = prose(rng, 300, 100_000)
    entries = []
    for count in (100, 200, 400):
        docs = documents(spark, [template + " " + prose(rng, 100, 100_000) for _ in range(count)])
        fine = neardup.sketches(docs, words=2, size=neardup.FINE).select("id", F.col("id").alias("c"), "n", "sketch")
        scratch = neardup.Scratch(spark)
        assert neardup.prefix_pairs(fine, neardup.FINE, scratch).count() == 0
        entries.append(spark.read.parquet(scratch.folder + "/entries").count())
    assert entries == [0, 0, 0] or entries[2] <= 5 * entries[0]


def test_long_sets_meet_by_their_sketches(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FINE", 400)
    rng = random.Random(42)
    texts = []
    for _ in range(30):
        words = [f"{rng.getrandbits(64):x}" for _ in range(901)]
        texts += [" ".join(words), " ".join(words[: 741 + rng.randrange(60)])]
    docs = documents(spark, texts)
    fine = neardup.sketches(docs, words=2, size=400).select("id", F.col("id").alias("c"), "n", "sketch")
    ids = {bytes(r.id): r.doc_id for r in neardup.sketches(docs, words=2).select("id", "doc_id").collect()}
    met = {tuple(sorted((ids[bytes(r.a)], ids[bytes(r.b)]))) for r in neardup.prefix_pairs(fine, 400, neardup.Scratch(spark)).collect()}
    assert met == {(i, i + 1) for i in range(0, 60, 2)}


def test_lists_leave_only_what_can_be_linked(spark):
    scratch = neardup.Scratch(spark)
    rng = random.Random(32)
    passage = prose(rng, 30, 3000)
    texts = [prose(rng, 60, 3000) + " " + passage for _ in range(40)] + [prose(rng, 60, 3000)] * 2
    each = neardup.sketches(documents(spark, [*texts, texts[-1] + " more"]), words=2).dropDuplicates(["id"])
    found = neardup.blocks(neardup.run_keys(each), scratch)
    assert found.select("id").distinct().count() == 2 and found.select("center").distinct().count() == 1
    assert os.listdir(scratch.folder.removeprefix("file:")) == ["blocks"]


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(33)
    one, two, three = (prose(rng, 40, 3000) for _ in range(3))
    rows = [(7, one), (7, one), (3, two), (5, two + " more"), (5, three), (None, two), (None, None), (8, None), (8, None), (8, ""), (9, "short"), (4, "short")]
    docs = spark.createDataFrame([(i, t, "en", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, component string, n int")
    got = neardup.without_near_duplicates(docs, words=5)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id is not None and r.text)
    assert kept == sorted([(7, one), (3, two), (5, three), (4, "short")])
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect() if r.doc_id is None or not r.text) == [("8", ""), ("8", "None"), ("8", "None"), ("None", "None"), ("None", two)]
    assert neardup.without_near_duplicates(docs.limit(0), words=5).count() == 0


def test_cut_copies_just_above_the_threshold_are_linked(spark):
    rng = random.Random(12)
    texts = []
    for i in range(1500):
        words = [f"{rng.getrandbits(64):x}" for _ in range(401)]
        texts += [" ".join(words), " ".join(words[: 321 + 4 * (i % 3)])]  # similarity 0.80, 0.81, 0.82
    got = neardup.near_duplicates(documents(spark, texts), words=2).collect()
    assert [r.doc_id for r in got if r.component_id != r.doc_id // 2 * 2] == []


def test_components(spark):
    links = [(i, i + 1) for i in range(20, 50)] + [(3, 1), (1, 2), (7, 7), (9, None), (60, 61), (61, 60)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(20, 51), 20), 1: 1, 2: 1, 3: 1, 60: 60, 61: 60}


def test_shingle_hashes_tell_sets_apart():
    import pyarrow as pa

    texts = [t or "" for t in ODD] + ["A b C", "a B c", "ab c", "a bc"]
    for n in (1, 2, 5):
        found = shingles.shingle_sets(*utf8(pa.array(texts)), n)
        assert [len(s) for s in found] == [len(shingle_set(t, n)) for t in texts]
        assert all((found[i].tolist() == found[j].tolist()) == (shingle_set(texts[i], n) == shingle_set(texts[j], n)) for i in range(len(texts)) for j in range(i))


def test_slices_hold_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 900, 3, 3, 3)])], names=["t"])
    assert [len(s) for s in slices(batch, 0, 8)] == [2, 1, 2, 1]


# language models


def plain_contexts(text):
    """(predictor, context, byte) of each byte of a text as it is spelled out."""
    body = b"".join(w + b" " for w in text.lower().split()) + b"\xff"
    padded, word = bytes(8) + body, b""
    for i, byte in enumerate(body):
        yield from ((k, padded[8 + i - back : 8 + i], byte) for k, back in enumerate(lm.CONTEXTS) if back)
        yield len(lm.CONTEXTS) - 1, word, byte
        word = b"" if byte == 32 else word + bytes([byte])


def plain_score(text, of_context):
    """The mixed model one bit after the other: log10 of the text's probability."""
    k = len(lm.CONTEXTS)
    weights = {(g, b): list(lm.START[g]) for g in range(2) for b in range(8)}
    scale, shift, total = [1.0] * 8, [0.0] * 8, 0.0
    steps = list(plain_contexts(text))
    for at in range(0, len(steps), k * lm.STEP):
        moves = []
        for i in range(at, min(len(steps), at + k * lm.STEP), k):
            byte, odds = steps[i][2], np.zeros((8, k))
            for j, context, _ in steps[i : i + k]:
                for bit in range(8):
                    held = [0, 0]
                    for other, times in of_context.get((j, context), {}).items():
                        if other >> (8 - bit) == byte >> (8 - bit):
                            held[other >> (7 - bit) & 1] += times
                    odds[bit, j] = np.clip(np.rint(np.log((held[1] + lm.PRIOR) / (held[0] + lm.PRIOR)) * 16), -127, 127) / 16
            g = int(odds[0, lm.LONGEST] != 0)
            for bit in range(8):
                sign = 1 if byte >> (7 - bit) & 1 else -1
                mixed = float(np.clip(np.dot(weights[g, bit], odds[bit]), -lm.LIMIT, lm.LIMIT))
                final = float(np.clip(scale[bit] * mixed + shift[bit], -lm.LIMIT, lm.LIMIT))
                total -= np.log10(1 + np.exp(-sign * final))
                moves.append((g, bit, sign * (1 - 1 / (1 + np.exp(-sign * mixed))) * odds[bit], sign * (1 - 1 / (1 + np.exp(-sign * final))), mixed))
        for g, bit, move, off, mixed in moves:
            weights[g, bit] = weights[g, bit] + lm.RATE * move
            shift[bit] += lm.REFINE * off
            scale[bit] += lm.REFINE * off * mixed
    return total


def test_scores_against_a_plain_model(spark, monkeypatch):
    rng = random.Random(3)
    texts = [*ODD, "a\0b \0 a\0", *[prose(rng, rng.randrange(1, 200), 60) for _ in range(40)], prose(rng, 1500, 60)]
    docs = documents(spark, texts).withColumn("score", F.lit("old")).withColumn("slice", F.lit("old")).select("doc_id", "text", "score", "slice")
    docs = docs.union(docs.where("doc_id = 9"))  # a repeated row
    training = [t for i, t in enumerate(texts) if i % 3] + [texts[9]] * (9 % 3 > 0)
    counts = Counter(t for x in training for t in [*words_of(x), b""])
    of_context = {}
    for x in training:
        for k, context, byte in plain_contexts((x or "").encode()):
            held = of_context.setdefault((k, context), Counter())
            held[byte] += 1
    total, kinds = sum(counts.values()), len(counts)
    rows = {}
    for size in (1 << 23, 1500):  # one slice, and many
        monkeypatch.setattr(lm, "SLICE", size)
        got = lm.score(docs, F.col("doc_id") % 3 != 0).collect()
        assert sorted(r.doc_id for r in got) == sorted([*range(len(texts)), 9])
        for r in got:
            rows.setdefault(r.doc_id, []).append(r)
    for i, same in rows.items():
        r, text = same[0], texts[i] or ""
        seq = [*words_of(text), b""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(seq), sum(counts[t] > 0 for t in seq), total)
        assert r.base_score == pytest.approx(sum(np.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in seq))
        assert r.n_bytes == sum(len(t) + 1 for t in seq) and r.bits_per_byte == pytest.approx(-r.score * np.log2(10) / r.n_bytes)
        assert {x.score for x in same} == {r.score}  # whatever it is scored beside
        if len(text) < 1000 or i == len(texts) - 1:
            assert r.score == pytest.approx(plain_score(text.encode(), of_context), rel=1e-5)
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0
    assert {(r.n_known, r.train_tokens) for r in lm.score(docs, F.lit(None)).collect()} == {(0, 0)}


def test_texts_of_the_corpus_are_told_from_others():
    rng = random.Random(4)
    texts = [prose(rng, 80, 40).encode() for _ in range(60)]
    keys, n = lm.count_keys(texts[:50])
    more, _ = lm.count_keys(texts[50:])
    keys, n = lm.different(np.concatenate([keys, more]), np.concatenate([n, np.zeros(len(more), np.int64)]))
    numbers = lm.Numbers(keys)
    assert (numbers.keys() == keys).all() and (numbers.of(keys[::-1]) == np.arange(len(keys))[::-1]).all()
    tokens = np.where(lm.is_token(keys), n, 0)
    scores = [lm.judge(lm.odds_of(keys, x), tokens, lm.spell(texts, numbers))[3] for x in (n, n * 0)]
    assert (scores[0] > scores[1]).all() and (scores[1] >= [np.log10(0.5) * 8 * (len(t) + 2) for t in texts]).all()
    # all continuations by one byte share the probability of what comes before
    every = np.arange(256, dtype=np.uint64) | keys[0] & ~np.uint64(255)
    p = 1 / (1 + np.exp(-lm.odds_of(every, np.arange(256)) / 16.0))
    bits = (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1
    assert np.where(bits, p, 1 - p).prod(axis=1).sum() == pytest.approx(1)


def test_counts_do_not_wrap_at_32_bits():
    keys, n = lm.count_keys([b"some words and some more words"])
    assert (lm.odds_of(keys, n << 20) == lm.odds_of(keys, n << 40)).all()
    keys, n = lm.different(np.concatenate([keys, keys]), np.concatenate([n, n << 33]))
    assert n.min() == 1 + (1 << 33)
    assert (lm._numbers(lm._planes(n, lm._width(n)), lm._width(n)) == n).all()


def test_a_slices_keys_are_sorted_once(monkeypatch):
    rng = random.Random(12)
    texts = [prose(rng, rng.randrange(60)).encode() for _ in range(40)]
    calls = []
    merge = lm.different
    monkeypatch.setattr(lm, "different", lambda *x: calls.append(x) or merge(*x))
    monkeypatch.setattr(lm, "LOT", 2000)
    group = lm.pa.table({"text": lm.pa.chunked_array([[t.decode() for t in texts]]), "learn": lm.pa.chunked_array([[i % 3 > 0 for i in range(40)]])})
    keys, n = lm._slice_keys(group)
    assert len(calls) == 1
    monkeypatch.undo()
    every, train = lm.count_keys(texts)[0], dict(zip(*(x.tolist() for x in lm.count_keys([t for i, t in enumerate(texts) if i % 3]))))
    assert (keys == every).all() and n.tolist() == [train.get(k, 0) for k in keys.tolist()]


def test_mixing_copies_a_places_eight_weights_at_once(monkeypatch):
    rng = random.Random(13)
    texts = [prose(rng, rng.randrange(90), 60).encode() for _ in range(30)]
    keys, n = lm.count_keys(texts[:20])
    more, _ = lm.count_keys(texts[20:])
    keys, n = lm.different(np.concatenate([keys, more]), np.concatenate([n, np.zeros(len(more), np.int64)]))
    spelled, tokens = lm.spell(texts, lm.Numbers(keys)), np.where(lm.is_token(keys), n, 0)
    pieces, take = [], np.take

    def counting(a, indices, axis=None, **options):
        found = take(a, indices, axis=axis, **options)
        pieces.append(found.size // (1 if axis is None else int(np.prod(np.shape(a)[axis + 1 :]))))
        return found

    monkeypatch.setattr(lm.np, "take", counting)
    scores = lm.judge(lm.odds_of(keys, n), tokens, spelled)[3]
    monkeypatch.undo()
    places = sum(-(-max(len(t) + 2 for t in texts) // lm.STEP) * lm.STEP for _ in range(len(texts) + 1))  # no more than these
    assert sum(pieces) <= (2 * len(lm.CONTEXTS) + 3) * places  # numbers and weights; the gate, the bytes and their signs
    # the same by the odds of the bits as they are, alone or side by side
    own = lm.odds_of(keys, n) * (np.unpackbits(keys.astype(np.uint8)[:, None], axis=1).view(np.int8) * 2 - 1)
    assert (lm.judge_own(own, tokens, spelled)[3] == scores).all()
    assert [lm.judge(lm.odds_of(keys, n), tokens, lm.spell([t], lm.Numbers(keys)))[3][0] for t in texts] == scores.tolist()
    of_context = {}
    for t in texts[:20]:
        for k, context, byte in plain_contexts(t):
            of_context.setdefault((k, context), Counter())[byte] += 1
    assert scores == pytest.approx([plain_score(t, of_context) for t in texts], rel=1e-5)


def test_numbers_of_many_keys():
    rng = np.random.default_rng(1)
    numbers, seen = lm.Numbers(), {}
    for size in (0, 10, 70_000, 5, 200_000):
        keys = rng.integers(0, 90_000, size, dtype=np.uint64) << np.uint64(40)
        for key, number in zip(keys.tolist(), numbers.of(keys).tolist()):
            assert seen.setdefault(key, number) == number
    assert sorted(seen.values()) == list(range(numbers.size)) and numbers.keys()[list(seen.values())].tolist() == list(seen)


def test_the_first_of_keys_that_clash_keeps_its_slot():
    rng = np.random.default_rng(2)
    numbers = lm.Numbers()
    for size in (20_000, 60_000, 3_000):
        numbers.of(rng.integers(0, 1 << 62, size, dtype=np.uint64))
    home = numbers.slots[numbers._slots(numbers.keys())]
    assert (home >= 0).all() and (home <= np.arange(numbers.size)).all() and (home < np.arange(numbers.size)).any()


# media


def test_streams_round_trip(spark):
    long = "payload with é " * 3000
    docs = documents(spark, [*ODD, long]).withColumn("media", F.lit(1))
    got = {r.doc_id: r for r in stream.media_features(stream.media_column(docs)).collect()}
    for i, text in enumerate([*ODD, long]):
        raw = (text or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = stream.write_stream(padded)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(padded), len(media)) and len(media) % 188 == 0
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_sha256 == hashlib.sha256(media).hexdigest() and "gaps=0;repeats=0;bad_tables=0" in r.feature
        assert r.stamps == [n * 16384 * 90000 // 8000 for n in range(-(-len(padded) // 16384))] and len(r.random_access) == len(r.stamps)
    assert got[9].feature == got[10].feature
    assert stream.media_features(stream.media_column(docs.limit(0))).count() == 0


def test_streams_show_what_is_broken():
    whole = stream.write_stream(bytes(range(256)) * 100)
    found = stream.read_stream(whole)
    assert (found.programs, found.streams, found.gaps) == ({1: 0x1000}, {0x100: 6}, 0) and found.payload == bytes(range(256)) * 100
    assert stream.read_stream(whole[: 188 * 20] + whole[188 * 21 :]).gaps == 1
    broken = bytearray(whole)
    broken[15] ^= 1
    assert stream.read_stream(bytes(broken)).bad_tables == 1
    assert found.clocks == found.stamps == [0, 16384 * 90000 // 8000]
    twice = stream.read_stream(whole[: 188 * 21] + whole[188 * 20 :])
    assert (twice.gaps, twice.repeats, twice.payload) == (0, 1, found.payload)
    with pytest.raises(ValueError):
        stream.read_stream(whole[:-1])
    with pytest.raises(ValueError):
        stream.read_stream(b"\0" + whole[1:])


def packet(pid, counter, payload, starts):
    return (bytes([0x47]) + ((0x4000 if starts else 0) | pid).to_bytes(2, "big") + bytes([0x10 | counter]) + payload).ljust(188, b"\xff")


def test_tables_over_several_packets():
    body = b"".join(n.to_bytes(2, "big") + (0xE000 | 0x100 + n).to_bytes(2, "big") for n in range(1, 101))
    section = bytes([0]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00" + body
    section += stream.section_crc(section).to_bytes(4, "big")
    data = packet(0, 0, b"\x00" + section[:183], True) + packet(0, 1, section[183:367], False) + packet(0, 2, section[367:], False)
    found = stream.read_stream(data)
    assert found.programs == {n: 0x100 + n for n in range(1, 101)} and found.bad_tables == found.gaps == 0
    assert stream.read_stream(data[:376]).programs == {}


def test_malformed_streams_raise_value_errors():
    rng = random.Random(6)
    whole = stream.write_stream(bytes(range(256)) * 80)
    for at, value in ((4, 200), (188 + 4, 255), (2 * 188 + 4, 250), (2 * 188 + 12, 9), (2 * 188 + 18, 0), (2 * 188 + 20, 4)):
        broken = bytearray(whole)
        broken[at] = value
        with pytest.raises(ValueError):
            stream.read_stream(bytes(broken))
    for _ in range(400):  # anything else is read, with whatever is left
        broken = bytearray(whole)
        for _ in range(rng.randrange(1, 5)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        try:
            stream.read_stream(bytes(broken))
        except ValueError:
            pass


# tokens


def test_lengths_and_their_sums(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.tokenizer_path())
    rng = random.Random(1)
    texts = [*ODD, "a<|endoftext|>b", "<|STARTOFTEXT|> Don't WE'LL ΑΣ ﬁ K İ", prose(rng, 3000)]
    n = sorted(len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts)
    rows = {r.n_tokens: r for r in lengths.length_histogram(lengths.encoded_lengths(documents(spark, texts))).collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(n)
    for k, r in rows.items():
        assert (r.docs_at_least, r.tokens_at_least) == (sum(x >= k for x in n), sum(x for x in n if x >= k))
        assert (r.total_docs, r.total_tokens, r.truncated_tokens) == (len(n), sum(n), sum(min(x, k) for x in n))
        assert r.quantile == sum(x <= k for x in n) / len(n)
    histogram = lengths.length_histogram(lengths.encoded_lengths(documents(spark, texts)))
    for r in lengths.context_totals(histogram, [0, 2, 7, 10**6]).collect():
        c = r.context_limit
        assert (r.docs_over, r.truncated_tokens, r.tokens_fitting, r.tokens_lost) == (sum(x > c for x in n), sum(min(x, c) for x in n), sum(x for x in n if x <= c), sum(max(0, x - c) for x in n))
    got = {r.share: r.n_tokens for r in lengths.length_quantiles(histogram, [0.1, 0.5, 1.0]).collect()}
    assert got == {s: n[int(np.ceil(s * len(n))) - 1] for s in (0.1, 0.5, 1.0)}
    assert lengths.length_histogram(lengths.encoded_lengths(documents(spark, texts).limit(0))).count() == 0


@pytest.mark.parametrize("size", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("below", [1, 2, 50_000, 1 << 32])
def test_blocks_round_trip(size, below):
    ids = np.random.default_rng(size).integers(0, below, size, dtype=np.uint64).astype("<u4")
    ids[::37] = 2**32 - 1
    starts, body = blocks.pack_blocks(ids)
    assert (blocks.unpack_blocks(starts, np.frombuffer(body, np.uint8), size) == ids).all()
    if size > 200:  # any block alone
        assert (blocks.unpack_blocks(starts[1:2], np.frombuffer(body, np.uint8), 128) == ids[128:256]).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.tokenizer_path())
    rng = random.Random(2)
    texts = [*ODD, *[prose(rng, rng.randrange(4000)) for _ in range(40)]]
    docs = documents(spark, texts, first=-5).orderBy(F.rand(1)).withColumn("start", F.lit(1))
    docs = docs.union(docs.where("doc_id = 3")).union(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted(blocks.read_token_files(blocks.write_token_files(docs)).collect(), key=lambda r: r.start)
    start = 0
    order = [(None, texts[6])] + sorted([*enumerate(texts, -5), (3, texts[8])], key=lambda x: x[0])
    for r, (doc_id, text) in zip(got, order, strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert blocks.read_token_files(blocks.write_token_files(docs.limit(0))).count() == 0


def test_other_tokenizers_take_no_short_way(spark):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("byte_bpe_50k.json")
    assert tokens.by_words(tokens.tokenizer_path()) and not tokens.by_words(path)
    whole = Tokenizer.from_file(path)
    texts = [*ODD, "Two  Words, And CAPITALS<|endoftext|>"]
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 50256] for t in texts]
    docs = documents(spark, texts)
    backwards = docs.coalesce(1).sortWithinPartitions(F.desc("doc_id"))
    files = blocks.write_token_files(backwards, tokenizer=path, end_id=50256, as_they_come=True)
    got = blocks.read_token_files(files).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in reversed(list(enumerate(want)))]
    assert sorted(r.n_tokens for r in lengths.encoded_lengths(docs, tokenizer=path).collect()) == sorted(len(x) - 1 for x in want)


def test_an_encoder_may_forget(monkeypatch):
    rng = random.Random(5)
    texts = [prose(rng, 300, 5000).encode() for _ in range(30)]
    want = tokens.WordEncoder(tokens.tokenizer_path()).ids(texts)
    monkeypatch.setattr(tokens, "REMEMBERED", 100)
    assert tokens.WordEncoder(tokens.tokenizer_path()).ids(texts) == want


def test_a_word_is_remembered_once_whatever_signs_follow():
    encoder = tokens.WordEncoder(tokens.tokenizer_path())
    encoder.of(b"Word word, word. (word) word!? 9, word's, \xe2\x80\x9dx word")
    assert {b"word", b",", b".", b"(word", b")", b"!?", b"9", b"word's", b"\xe2\x80\x9dx"} == set(encoder.known)
    assert encoder.packed[7] is encoder.packed[7]
    rng = random.Random(6)
    parts = ["a", "B", "é", "e\u0301", "'s", "'", "'re", ",", ".", "$", "\u201d", "1", " ", "\n", "\x1c", "\x85", "\xa0", "_", "\u0301", "½", "中", "("]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert encoder.of(text.encode()) == encoder.whole(text), text


# decontamination


def test_contained_items_against_all_pairs(spark):
    rng = random.Random(8)
    items = [prose(rng, n, 3000) for n in (5, 7, 20, 40, 60, 200)] + ["two words", None, "", "Same " * 12]
    texts = [*ODD, "two words", "TWO  words", "has two words inside"]
    for item in items[:6]:
        for _ in range(6):
            w = item.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "other"
            cut = w[rng.randrange(2) :]
            texts.append(f"{prose(rng, rng.randrange(300), 3000)} {' '.join(cut)} {prose(rng, 50, 3000)}")
    texts += ["x same same same same same y", items[3]]
    want = {}
    for i, text in enumerate(texts):
        for j, item in enumerate(items):
            asked, held = shingle_set(item, 5), shingle_set(text, 5)
            if asked and 100 * len(asked & held) >= 80 * len(asked):
                want[i, j] = (len(asked), len(asked & held))
    docs = documents(spark, texts).withColumn("item_id", F.lit(1))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = docs.union(docs.where("doc_id = 5"))
    got = decon.contained_items(docs, table).collect()
    assert {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in got} == want and len(got) == len(want) > 10
    kept = decon.decontaminated(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert decon.contained_items(docs.limit(0), table).count() == decon.contained_items(docs, table.limit(0)).count() == 0


# personal data


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


PERSONAL = ["mail a.b@c.de, x@y x@y.z@q.r", "@a.b +@a.b é+a@b.c", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 01.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000", "+1 (743) 555-3824 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 +1 2 3 4 5 6 7 8 9", "1.2.3.4444", "+49 4111 1111 1111 1111"]


def test_base_spans_against_the_patterns():
    rng = random.Random(9)
    for text in [*PERSONAL, *["".join(rng.choice("a1 .-+@(4)") for _ in range(60)) for _ in range(3000)]]:
        assert [(s, pii.KINDS.index(k), e) for s, k, e in pii.base_spans(text)] == plain_spans(text), text


REPEATED = [f"Call +1 (743) 555-{n} now, +1 743-555-{n} later. Mail a{n}@x.org, a{n}@x.org. Order {n}-{n}77 and {n}-{n}77. Host 10.0.0.{n % 250}, 10.0.0.{n % 250}." for n in range(1000, 1100)]


def test_personal_data(spark):
    again = "Call +1 (743) 555-3824 now, or (743) 555-3824, 743-555-3824. Mail a.b@x.org or a.b (at) x (dot) org. Order 123-4567. From 10.2.0.1, that is 10[.]2[.]0[.]1."
    texts = [*ODD, *PERSONAL, again, "Order 123-4567 and 555-3824 only", *REPEATED]
    docs = documents(spark, texts).withColumn("spans", F.lit(1)).withColumn("id", F.lit(1))
    got = pii.personal_data(docs).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        base = plain_spans(text or "")
        written = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, i, _ in base) for k in range(4)]
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))

    def added(r):
        return [texts[r.doc_id][int(a) : int(b)] for _, a, b in (s.split(":") for s in r.spans.split(",") if s)]

    first = len(ODD) + len(PERSONAL)
    assert added(got[first]) == ["+1 (743) 555-3824", "(743) 555-3824", "743-555-3824", "a.b@x.org", "a.b (at) x (dot) org", "10.2.0.1", "10[.]2[.]0[.]1"]
    assert got[first + 1].spans == ""  # what nothing repeats stays
    assert pii.personal_data(docs.limit(0), pii.learn(docs.limit(0))).count() == 0


def test_learned_potentials_carry_labels():
    texts = [*REPEATED, "Number 743-555-3824 alone", "Numbers 12-34567 and 12-34567, 1234-567"] * 2
    rows = Counter(r for t in texts for r in pii.observed(t))
    keys = sorted(rows)
    field = pii.trained(np.array(keys), np.array([rows[k] for k in keys], float))
    text = "Call +1 (743) 555-3824, again 743-555-3824"
    base = pii.base_spans(text)
    nodes = pii.nodes_of(text, base)
    assert [x.label for x in nodes] == [4, 0]
    without = pii.Field(field.unary, field.chain, field.skip * 0)
    assert pii.marginals(field, nodes)[1, 4] > pii.marginals(without, nodes)[1, 4]
    # what was learned predicts labels better than their shares do
    every = np.array(keys)
    shares = np.bincount(every[:, 1], [rows[k] for k in keys], 5) / sum(rows.values())
    chance = np.log(shares[every[:, 1]] + 1e-9)
    scores = field.own(every[:, 0]) + every[:, 4:] @ field.skip
    own = scores[np.arange(len(every)), every[:, 1]] - np.log(np.exp(scores).sum(axis=1))
    assert (own * [rows[k] for k in keys]).sum() > (chance * [rows[k] for k in keys]).sum()


def test_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(5)
    field = pii.Field(rng.normal(0, 1, (len(pii.FEATURES), 5)), rng.normal(0, 0.5, (5, 5)), rng.normal(0, 0.3, (5, 5)))
    field.skip += field.skip.T
    for keys, labels in (("abc", [0, 0, 0]), ("abcd", [0, 3, 0, 0]), ("aba", [0, 0, 0]), ("abca", [4, 0, 0, 0])):
        nodes = [pii.Node(i, i + 1, label, key, int(rng.integers(0, 512))) for i, (key, label) in enumerate(zip(keys, labels))]
        chain, skip = pii.edges_of(nodes)
        own = field.own(np.array([x.bits for x in nodes]))
        want = np.zeros((len(nodes), 5))
        for y in itertools.product(range(5), repeat=len(nodes)):
            if all(not x.label or x.label == k for x, k in zip(nodes, y)):
                weight = np.exp(sum(own[i, k] for i, k in enumerate(y) if not nodes[i].label) + sum(field.chain[y[a], y[b]] for a, b in chain) + sum(field.skip[y[a], y[b]] for a, b in skip))
                want[np.arange(len(nodes)), y] += weight
        want /= want.sum(axis=1, keepdims=True)
        got = pii.marginals(field, nodes)
        # exact without a circle, near it with one
        assert np.allclose(got, want, atol=1e-3 if len(set(keys)) == len(keys) else 0.08), (keys, abs(got - want).max())


def test_a_text_of_many_numbers_takes_linear_time():
    import time

    def seconds(n):
        text = "+1 743 555 3824 " + " ".join(f"{i:07d}x 12-345-{i:05d}," for i in range(n))
        began = time.perf_counter()
        pii.nodes_of(text, pii.base_spans(text))
        return time.perf_counter() - began

    assert seconds(40_000) < 20 * max(seconds(4_000), 0.01)


# languages


def made_up(rng, syllables, words):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(words)).capitalize() + "."


def test_languages(spark):
    rng = random.Random(11)
    kinds = {"aa": ["the", "ing", "er", "on"], "bb": ["sch", "ung", "ei", "für"], "gr": ["αλ", "ος", "και"]}
    texts, langs = [], []
    for lang, syllables in kinds.items():
        texts += [made_up(rng, syllables, 60) for _ in range(40)]
        langs += [lang] * 40
    learned = documents(spark, [*texts, None, "text"], [*langs, "aa", None])
    model = langid.learn(learned)
    assert model.languages == sorted(kinds)
    asked = [*ODD, "1234 ...", *[made_up(rng, s, 30) for s in kinds.values()], made_up(rng, kinds["aa"], 40) + " " + made_up(rng, kinds["bb"], 30), "слово и дело"]
    docs = documents(spark, asked).withColumn("score", F.lit("old")).withColumn("Spans", F.lit(1))
    got = langid.identify(docs, model).orderBy("doc_id").collect()
    assert langid.identify(docs, model).columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score", "spans", "known_share"]
    assert got[-1].known_share == 0 and {r.known_share for r in got[-5:-1]} == {1.0}
    for r in got:
        letters = bool(r.text and any(c.isalpha() for c in r.text))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (r.score > 0) == letters
    assert [r.lang_pred for r in got[-5:-2]] == list(kinds)
    first, second = got[-2].spans.split(",")
    assert first.startswith("aa:0:") and second.startswith("bb:") and got[-2].text[int(second.split(":")[1]) :] in got[-2].text
    assert langid.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(learned.limit(0))).collect()} == {"und"}


def test_labelling_is_the_best_of_all():
    import itertools

    rng = np.random.default_rng(3)
    for n in (1, 2, 6):
        score = rng.normal(0, 6, (n, 2)).astype(np.float32)
        none = np.zeros(0, np.int64)
        w = langid.Words(np.arange(n), np.ones(n, int), np.zeros(n, int), np.array([n]), none, none)
        best = max(itertools.product(range(2), repeat=n), key=lambda p: sum(score[i, x] for i, x in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(langid.label_words(w, score)) == best


def test_more_languages_than_a_byte_numbers():
    score = np.full((3, 300), -9, np.float32)
    score[:, 280] = 0
    none = np.zeros(0, np.int64)
    w = langid.Words(np.arange(3), np.ones(3, int), np.zeros(3, int), np.array([3]), none, none)
    assert langid.label_words(w, score).tolist() == [280] * 3


def test_a_very_long_text(spark):
    rng = random.Random(41)
    text = prose(rng, 100_000, 50_000) + " +1 (743) 555-3824 or 743-555-3824"
    docs = documents(spark, [text, "w1 w2 w3 w4 w5 w6", text + " more"]).select("doc_id", "text", F.lit("src0").alias("source"))
    assert [r.component_id for r in neardup.near_duplicates(docs, words=5).orderBy("doc_id").collect()] == [0, 1, 0]
    r = blocks.read_token_files(blocks.write_token_files(docs)).where("doc_id = 0").first()
    ids = tokens.WordEncoder(tokens.tokenizer_path()).of(text.encode())
    assert (r.n_tokens, r.ids_crc32) == (len(ids) // 4 + 1, zlib.crc32(ids + b"\x02\0\0\0"))
    r = stream.media_features(stream.media_column(docs)).where("doc_id = 0").first()
    assert r.n_bytes == len(text) and "gaps=0" in r.feature
    words = text.split()
    items = spark.createDataFrame([(1, " ".join(words[70_000:70_040])), (2, "not there at all in it")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decon.contained_items(docs, items).collect()) == [(0, 1), (2, 1)]
    assert [r.n_phone for r in pii.personal_data(docs).orderBy("doc_id").collect()] == [1, 0, 1]
    model = langid.learn(spark.createDataFrame([(text, "w"), ("for all in one", "e")], "text string, lang string"))
    got = langid.identify(docs, model).where("doc_id = 0").first()
    assert got.lang_pred == "w" and got.score > 0.9
    assert mix.poisson_mix(docs, {"src0": 1.0}, epochs=3.0).count() > 0
