"""Ranked search, filter interactions and licence scans against plain Python, with every odd case."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panemill.llm import audit, licenses, search
from tests.llm.test_operators import ODD, documents, prose

# ranked search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_ranking(docs, items, top):
    own = [(i, Counter(TERMS.findall(lower(t)))) for i, t in docs if i is not None]
    n_docs, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    terms = {}
    for item, text in items:
        if item is not None:
            terms.setdefault(item, set()).update(TERMS.findall(lower(text)))
    found = set()
    for item, wanted in terms.items():
        scores = []
        for doc, counts in own:
            m = 10 + 90 * sum(counts.values()) * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t in wanted if counts[t])
            if score > 0:
                scores.append((-score, doc))
        found |= {(item, r, doc, -score) for r, (score, doc) in enumerate(sorted(scores)[:top], 1)}
    return found


def ranking(docs, items, **options):
    rows = search.ranked(docs, items, **options).collect()
    assert len(rows) == len({(r.item_id, r["rank"]) for r in rows})
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in rows}


@pytest.mark.parametrize("shard_bytes", [300, 4000, 1 << 24])
def test_ranking_against_all_documents(spark, shard_bytes):
    rng = random.Random(shard_bytes)

    def zipf(words):
        return " ".join(f"w{min(int(rng.paretovariate(0.5)), 900)}" for _ in range(words))

    texts = [zipf(rng.choice((1, 5, 30, 200))) for _ in range(400)] + ["common"] * 30 + [*ODD, "Common WORDS, common"] * 2
    docs = documents(spark, texts).unionByName(documents(spark, ["w1 nameless"]).withColumn("doc_id", F.lit(None).cast("long")))
    items = [(0, zipf(40)), (1, "w1 w2 w3"), (2, None), (3, ""), (4, "nowhere at-all"), (5, "common"), (5, "words W7"), (None, "w1"), (6, "é ñ w9 😀"), (7, "common common common")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x"))
    got = ranking(docs.repartition(3).withColumn("shard", F.lit("x")).withColumn("items", F.lit(1)), asked, shard_bytes=shard_bytes)
    assert got == plain_ranking([*enumerate(texts), (None, "w1 nameless")], items, 10)
    assert {r[2] for r in got if r[0] == 7} == {442, 455, *range(400, 408)}  # of thirty equal ones those with the smallest ids
    three = ranking(docs, asked, shard_bytes=shard_bytes, top=3)
    assert three == {r for r in got if r[1] <= 3}


def test_ranking_of_nothing_and_of_repeated_rows(spark):
    docs, items = documents(spark, ["a b", "c"]), spark.createDataFrame([(1, "a c")], "item_id long, text string")
    assert ranking(docs.limit(0), items) == ranking(docs, items.limit(0)) == ranking(documents(spark, [None, " "]), items) == set()
    twice = search.ranked(docs.union(docs), items).collect()
    assert sorted((r["rank"], r.doc_id) for r in twice) == [(1, 1), (2, 1), (3, 0), (4, 0)]


def test_many_items_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEMS", 3)
    rng = random.Random(3)
    texts = [prose(rng, 20, 60) for _ in range(80)]
    items = [(i, prose(rng, 4, 60)) for i in range(20)]
    assert ranking(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"), top=2) == plain_ranking(list(enumerate(texts)), items, 2)


def test_numbers_round_trip_and_pieces_cut_no_term(monkeypatch):
    rng = np.random.default_rng(4)
    for top in (1, 127, 128, 1 << 14, 1 << 34):
        values = rng.integers(0, top, 500)
        payload, sizes = search.varints(values)
        assert sizes.sum() == len(payload) and (search.numbers(payload) == values).all()
    assert len(search.numbers(search.varints(np.zeros(0, np.int64))[0])) == 0
    monkeypatch.setattr(search, "PIECE", 7)
    text = " ".join(str(i) * (i % 9) for i in range(300)).encode() + "ñandú".encode() * 3
    assert search.term_counts(text) == Counter(search.TERM.findall(text))


def shard_of(texts):
    shard = search.Shard()
    for i, text in enumerate(texts):
        shard.add(i, text.encode())
    rows = shard.rows(0).to_pandas()
    rows["weight"] = 1
    documents = rows[rows["term"] == ""]
    found = search.ShardSearch(documents["payload"].iloc[0], int(documents["n"].iloc[0]), int(documents["total"].iloc[0]))
    return found, {t: found.lists(r) for t, r in rows[rows["term"] != ""].groupby("term")}


def test_blocks_below_the_bound_stay_compressed():
    """A rare term settles the result: of the frequent one's blocks only those are read that can still matter."""
    texts = ["often " + "pad " * (5 + i % 7) for i in range(64 * 40)]
    for i in range(0, 64 * 3, 16):
        texts[i] = "rare often rare often rare"
    shard, lists = shard_of(texts)
    lists["rare"].weight, lists["rare"].tops, lists["rare"].top = 50, lists["rare"].tops * 50, lists["rare"].top * 50
    best = shard.best([lists["often"], lists["rare"]], 10)
    assert [d for _, d in best] == list(range(0, 160, 16))
    assert shard.decoded <= 1 + 3 and len(lists["often"].n) == 40
    assert all((np.diff(x.first) > 0).all() and x.tops.max() >= max(int(shard.postings(x, np.array([b]))[1].max()) for b in range(len(x.n))) for x in lists.values())


def test_impacts_bound_each_block_exactly():
    rng = random.Random(9)
    shard, lists = shard_of([" ".join(["t"] * rng.randrange(1, 9) + ["u"] * rng.randrange(60)) for _ in range(300)])
    for each in lists.values():
        for b in range(len(each.n)):
            assert each.tops[b] == shard.postings(each, np.array([b]))[1].max()


# filter interactions


def plain_audit(rows, labels):
    """Each order run over the documents of each part."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for d, text, source in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        known = set()
        known |= {"A"} if len(words) < 50 else set()
        known |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        known |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
        known |= {"D"} if set("#$%&*|") & set(text) else set()
        known |= {"E"} if d is not None and any(o is not None and o < d and (t or "") == text for o, t, _ in rows) else set()
        fails.append((source or "", d, known))
    want, sums = {}, Counter()
    for part in {p for p, _, _ in fails}:
        own = [(d, f) for p, d, f in fails if p == part]
        for order in permutations("ABCDE"):
            kept = list(own)
            for step, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in kept if letter in f]
                kept = [(d, f) for d, f in kept if letter not in f]
                sums[part, letter] += len(gone)
                want[part, "".join(order), step] = [len(kept), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == {letter} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    return {(*k, *v, sums[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def audited(docs, labels):
    found = audit.interactions(docs, labels, audit.text_filters(F.col("text")), "E", F.coalesce(F.col("source"), F.lit("")))
    return {tuple(r) for r in found.collect()}


def test_interactions_against_every_order(spark):
    rng = random.Random(7)
    kinds = [lambda: prose(rng, 60), lambda: "w " * 80, lambda: prose(rng, 55) + " #", lambda: prose(rng, 10).upper(), lambda: "ALL CAPS " * 30, lambda: prose(rng, 3), lambda: None, lambda: ""]
    texts = [rng.choice(kinds)() for _ in range(120)] + ODD
    texts += [rng.choice(texts) for _ in range(60)] + ["copy " * 3] * 70
    rows = [(i, t, rng.choice(("a", "b", None, ""))) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[50], rows[-1], (None, texts[0], "a"), (None, "copy " * 3, "n"), (None, None, "n"), (7, "another text", "a")]
    rng.shuffle(rows)
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 250, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (99999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("good", "mask", "digest", "n", "part")})
    got = audited(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("salt", F.lit(5)))
    assert got == plain_audit(rows, labels)
    assert len(got) == 600 * 4 and {r[0] for r in got} == {"a", "b", "", "n"}


def test_interactions_of_nothing_and_of_wrong_filters(spark):
    docs, labels = documents(spark, ["a", "A b"]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(docs.limit(0), labels) == set()
    assert len(audited(docs, labels)) == 600
    with pytest.raises(ValueError, match="single letters"):
        audit.interactions(docs, labels, {"A": F.lit(True)}, "A", F.lit(""))
    two = audit.interactions(docs, labels, {"L": F.col("text") == "a"}, "E", F.lit("all")).collect()
    assert {(r.filter_order, r.step, r.removed, r.shapley) for r in two} == {("LE", 1, 1, 2), ("LE", 2, 0, 0), ("EL", 1, 0, 0), ("EL", 2, 1, 2)}


def test_a_text_of_many_copies_is_few_rows(spark):
    docs = documents(spark, ["the same"] * 3000 + [f"own {i}" for i in range(50)], sources=["s"] * 3050)
    marks = audit.marked(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), audit.text_filters(F.col("text")), F.col("source"))
    assert {(r.mask, r.n) for r in marks.collect()} == {(1, 51), (17, 2999)}


def test_potentials_are_those_of_the_definition(spark):
    """P(S) by its definition over marginal contributions, for games of one to five players."""
    rng = random.Random(1)
    for n in range(1, 6):
        game = [0] + [rng.randrange(100) for _ in range((1 << n) - 1)]
        scale = math.lcm(*range(1, n + 1))
        want = []
        for s in range(1 << n):  # the expected value of a coalition by its dividends
            dividends = {t: sum((-1) ** (bin(t).count("1") - bin(u).count("1")) * game[u] for u in range(t + 1) if u & t == u) for t in range(1, s + 1) if t & s == t}
            want.append(sum(scale * d // bin(t).count("1") for t, d in dividends.items()))
        got = spark.range(1).select(audit.potentials(F.array(*[F.lit(x).cast("long") for x in game]), n).alias("p")).first().p
        assert got == want


# licences

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction"


def plain_licenses(text, known):
    """Every passage at every place."""
    words = [w.encode() for w in WORDS.findall(lower(text))]
    base, labels, share = [], set(), 0.0
    for each in known:
        for start in range(-len(each.words), len(words)):
            same = [0 <= start + q < len(words) and words[start + q] == w for q, w in enumerate(each.words)]
            if all(same[q] for q in each.must) and len(same) - sum(same) <= each.spare:
                labels.add(each.label)
                share = max(share, sum(same) / len(same))
                if each.base:
                    base.append((each.label, start))
    starts = [s for _, s in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted(labels)), share)


def scanned(docs, known=None):
    found = licenses.licenses(docs, known)
    return {r.doc_id: tuple(r[c] for c in licenses.ADDED) for r in found.collect()}


def test_licenses_against_every_place(spark):
    rng = random.Random(11)
    known = licenses.templates()
    bag = sorted({w.decode() for t in known for w in t.words}) + ["other", "words", "LICENSE,", "(mit)"]
    texts = list(ODD)
    for _ in range(120):
        words = [rng.choice(bag) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            passage = [w.decode() for w in rng.choice(known).words]
            for _ in range(rng.randrange(5)):  # changed, left out, or put in between
                at = rng.randrange(len(passage))
                passage[at : at + rng.randrange(2)] = [rng.choice(bag)] * rng.randrange(1, 2)
            cut = rng.choice((0, 0, 1, 3))
            at = rng.choice((0, rng.randrange(len(words) + 1)))
            words[at:at] = passage[cut:]
        texts.append(rng.choice((" ", "-", " \n")).join(words))
    texts += [NOTICE, NOTICE.lower()[3:], "MIT License", "mit-LICENSE / mit license", "the gnu general public license", "general public licenses", "Licensed under CC BY-NC 4.0.", "licensed under cc by 4.0", "MIT Licenseé", NOTICE, NOTICE]
    texts += [text for _, text in licenses.PASSAGES]
    docs = documents(spark, texts).withColumn("score", F.lit("old")).withColumn("row", F.lit(1)).repartition(3)
    got = scanned(docs)
    assert got == {i: plain_licenses(t, known) for i, t in enumerate(texts)}
    assert {x for r in got.values() for x in r[5].split(",")} == {t.label for t in known} | {""}
    by_text = {t: got[i] for i, t in enumerate(texts)}
    assert by_text[NOTICE][5] == "mit" and by_text[NOTICE][1] == 0 and by_text["Licensed under CC BY-NC 4.0."][5] == "cc-by-nc"
    assert by_text["mit-LICENSE / mit license"][:6] == (4, 2, 0, 2, "mit", "mit")


def test_licenses_of_nothing_and_without_templates(spark):
    docs = documents(spark, ["mit license", None])
    assert scanned(docs.limit(0)) == {}
    assert scanned(docs, []) == {0: (2, 0, None, None, "", "", 0.0), 1: (0, 0, None, None, "", "", 0.0)}
    assert licenses.licenses(docs.select("text")).columns == ["text", *licenses.ADDED]
    with pytest.raises(ValueError, match="without words"):
        licenses.template("x", "[ - ]")


def test_the_index_holds_the_rarest_words_and_as_many_as_the_votes_need():
    known = [licenses.template("x", "a b c d e f g h i j"), licenses.template("y", "p q", base=True)]
    index = licenses.rare_index(known, 100, {b"a": 90, b"b": 1, b"j": 2, b"p": 5})
    held = {w for w, places in index.postings.items() for t, _ in places if t == 0}
    assert len(held) == known[0].spare + known[0].votes == 4 and b"a" not in held and b"j" not in held
    assert {w for w, places in index.postings.items() for t, _ in places if t == 1} == {b"p", b"q"}
    # whichever words are rare, the same is found
    rng = random.Random(2)
    every = licenses.templates()
    for _ in range(40):
        df = {w: rng.randrange(100) for t in every for w in t.words}
        words = [w.decode() for w in rng.choice(every).words]
        words[rng.randrange(len(words))] = "changed"
        text = " ".join(words)
        assert licenses._columns(licenses.scan(text.encode(), licenses.rare_index(every, 100, df))) == plain_licenses(text, every)


def test_very_long_texts(spark):
    rng = random.Random(13)
    text = prose(rng, 60_000) + " " + NOTICE + " mit license " * 500
    docs = documents(spark, [text, "w1 rare mit license"])
    assert scanned(docs) == {i: plain_licenses(t, licenses.templates()) for i, t in enumerate((text, "w1 rare mit license"))}
    items = [(1, "w1 mit person restriction")]
    assert ranking(docs, spark.createDataFrame(items, "item_id long, text string")) == plain_ranking(list(enumerate((text, "w1 rare mit license"))), items, 10)
    assert audited(docs, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")) == plain_audit([(0, text, "src0"), (1, "w1 rare mit license", "src0")], [(0, 1, 0)])
