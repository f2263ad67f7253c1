"""Language spans of mixed-language text: script ranges, per-word scores and Viterbi with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.llm.common import bounded_batches, fold, give_back, slices, table

UNKNOWN = "und"
FOLDS = 5
#: Buckets of hashed letter n-grams and words for each language; the model's size is this times the languages.
BUCKETS = 1 << 15
#: Languages that a model may have: 64 MB of scores.
LANGUAGES = 512
#: Taken off a labelling for each change of language between two words, in nats.
SWITCH = 9.0
#: A word tells two languages apart by so many nats at most.
CLIP = 8.0
#: A script is a language's own if so much of its learned letters are of it.
OWN_SHARE = 0.002
#: Bytes of text whose features are worked out at once.
PORTION = 1 << 17
#: First and last code points of the scripts' letters (Unicode blocks).
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF),
    ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Thai", 0x0E00, 0x0E7F),
    ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(name for name, _, _ in SCRIPTS))


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and the number of its script."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return letter, script


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Words:
    """The words (runs of letters) of many texts: where they stand and the buckets of their features."""

    start: np.ndarray  # code points from the text's beginning
    length: np.ndarray
    script: np.ndarray
    count: np.ndarray  # words of each text
    buckets: np.ndarray  # of all features, word by word
    first: np.ndarray  # a word's first feature


def read_words(texts: list[str]) -> Words:
    """Features of a word: its letters in twos and threes, with its edges, and the word itself."""
    letter, script = _letters()
    low = [_lower(t) for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])]).astype(np.int64)
    code = np.frombuffer(" ".join([*low, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    inside = letter[code]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(texts), np.int64), none, none)
    c = np.where(inside, code, 0).astype(np.uint64)
    one = np.concatenate([[0], c[:-1]]).astype(np.uint64)
    two = np.where(one > 0, np.concatenate([[0, 0], c[:-2]]).astype(np.uint64)[: len(c)], 0).astype(np.uint64)
    at_end = np.zeros(len(c), bool)
    at_end[ends] = True
    here = np.flatnonzero(inside | at_end)
    a, b, z = two[here], one[here], c[here]
    three = (a * np.uint64(0x9E3779B1) ^ b * np.uint64(0x85EBCA77)) * np.uint64(31) + z * np.uint64(0xC2B2AE3D)
    pair = b * np.uint64(0x27D4EB2F) ^ z * np.uint64(0x165667B1) ^ np.uint64(0x5BD1E995)
    lengths = ends - starts
    place = here - np.repeat(starts, lengths + 1)
    power = np.cumprod(np.full(int(lengths.max()) + 1, 0x100000001B3, np.uint64))
    first_here = np.searchsorted(here, starts)
    words = np.add.reduceat((z + np.uint64(77)) * power[place] * (z > 0), first_here)
    feats = np.empty((len(here), 2), np.uint64)
    feats[:, 0], feats[:, 1] = three, pair
    # the word's own feature takes the place of its last pair, which the last three holds too
    feats[first_here + lengths, 1] = words ^ np.uint64(0xABCDEF)
    feats = feats.reshape(-1)
    feats ^= feats >> np.uint64(29)
    feats *= np.uint64(0xBF58476D1CE4E5B9)
    buckets = (feats >> np.uint64(64 - 15)).astype(np.int64) % BUCKETS
    of = np.searchsorted(begin, starts, "right") - 1
    return Words(starts - begin[of], lengths, script[code[starts]].astype(np.int64), np.bincount(of, minlength=len(texts))[: len(texts)], buckets, 2 * first_here)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # log probability of a bucket, (buckets, languages)
    own: np.ndarray  # whether a script is a language's own, (scripts, languages)


def learn(docs: DataFrame) -> LanguageModel:
    """Count the features of all ``docs`` (text, lang) for each language.

    Null languages and texts are left out. Tasks count before the shuffle; the driver gets one row for each language
    and bucket: 32,768 for each. More than ``LANGUAGES`` different values of lang raise ValueError before anything is
    counted, for such a column holds something else.
    """
    known = docs.where("lang is not null").select("lang").distinct().limit(LANGUAGES + 1).count()
    if known > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for some in slices(batch, 0, PORTION):
                langs = np.array(some.column(1).to_pylist(), object)
                texts = np.array(some.column(0).to_pylist(), object)
                for lang in set(langs.tolist()):
                    w = read_words(texts[langs == lang].tolist())
                    held = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                    held[:BUCKETS] += np.bincount(w.buckets, minlength=BUCKETS)
                    held[BUCKETS:] += np.bincount(w.script, w.length, len(SCRIPT_NAMES)).astype(np.int64)
        give_back()
        for lang, held in sums.items():
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(held[some])], names=["lang", "bucket", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    held = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES)))
    where = {lang: i for i, lang in enumerate(languages)}
    held[[where[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    features, scripts = held[:, :BUCKETS] + 0.3, held[:, BUCKETS:]
    scores = np.log(features / features.sum(axis=1, keepdims=True)).T.astype(np.float32) if languages else np.zeros((BUCKETS, 0), np.float32)
    own = (scripts >= OWN_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)) & (scripts > 0)
    return LanguageModel(languages, np.ascontiguousarray(scores), own.T)


def word_scores(model: LanguageModel, w: Words) -> np.ndarray:
    """What each word adds to a labelling with each language: (words, languages)."""
    if not len(w.start):
        return np.zeros((0, len(model.languages)), np.float32)
    score = np.add.reduceat(model.scores[w.buckets], w.first, axis=0)
    own = model.own[w.script]
    some = own.any(axis=1)
    # where no language owns the script, all stay candidates but the word tells nothing
    score = np.where(own, score, -np.inf)
    score = np.where(some[:, None], np.maximum(score - score.max(axis=1, keepdims=True, initial=-np.inf), -CLIP), 0)
    return np.where(own | ~some[:, None], score, -4 * CLIP).astype(np.float32)


def label_words(w: Words, score: np.ndarray) -> np.ndarray:
    """The language of each word, by the best labelling of each text; all texts step forward together."""
    n, size = score.shape
    order = np.argsort(-w.count, kind="stable")
    count = w.count[order]
    base = (np.cumsum(w.count) - w.count)[order]
    kind = np.min_scalar_type(max(size, 1))  # a byte for up to 255 languages
    came = np.empty((n, size), kind)
    best = np.zeros((len(order), size), np.float32)
    steps = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(steps), "left") if steps else []
    stay = np.arange(size, dtype=kind)
    for t in range(steps):
        k = active[t]
        at, now = base[:k] + t, best[:k]
        if t:
            top = now.argmax(axis=1)
            switch = now[np.arange(k), top] - SWITCH
            better = switch[:, None] > now
            came[at] = np.where(better, top[:, None].astype(kind), stay)
            now = np.where(better, switch[:, None], now)
        best[:k] = now + score[at]
    label = np.empty(n, kind)
    state = best.argmax(axis=1).astype(kind)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = base[:k] + t
        label[at] = state[:k]
        if t:
            state[:k] = came[at, state[:k]]
    return label


def predict(model: LanguageModel, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]], float]]:
    """For each text its language, the share of its letters in words of that language, its spans, and the share of its
    letters in words of a script that any learned language has.

    A span (language, start, end in code points) runs from the first to the last word of one label.
    """
    parts, scores, some, held = [], [], [], 0
    none = np.zeros(0, np.int64)
    for i, text in enumerate(texts):
        some.append(text or "")
        held += len(some[-1])
        if held >= PORTION or i == len(texts) - 1:
            w = read_words(some)
            scores.append(word_scores(model, w))
            parts.append(replace(w, buckets=none, first=none))  # the features are the largest part by far
            some, held = [], 0
    start, length, script, count = (np.concatenate([getattr(p, x) for p in parts] or [none]) for x in ("start", "length", "script", "count"))
    w = Words(start, length, script, count, none, none)
    label = label_words(w, np.concatenate(scores)) if model.languages and len(start) else np.zeros(len(start), np.int64)
    size = max(1, len(model.languages))
    doc = np.repeat(np.arange(len(texts)), w.count)
    label = label.astype(np.int64)
    letters = np.bincount(doc * size + label, w.length, len(texts) * size).reshape(len(texts), size)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
    firsts = np.flatnonzero(new)
    lasts = np.concatenate([firsts[1:] - 1, [len(doc) - 1]]) if len(firsts) else firsts
    spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if model.languages:
        for d, lang, a, b in zip(doc[firsts].tolist(), label[firsts].tolist(), w.start[firsts].tolist(), (w.start + w.length)[lasts].tolist(), strict=True):
            spans[d].append((model.languages[lang], a, b))
    top, total = letters.argmax(axis=1), letters.sum(axis=1)
    known = np.bincount(doc, w.length * model.own[w.script].any(axis=1), len(texts))
    out = []
    for d in range(len(texts)):
        if total[d] and model.languages:
            out.append((model.languages[top[d]], float(letters[d, top[d]] / total[d]), spans[d], float(known[d] / total[d])))
        else:
            out.append((UNKNOWN, 0.0, [], 0.0))
    return out


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` (text, ...) with lang_pred, score, spans (``lang:start:end``, comma-joined) and known_share.

    lang_pred is a learned language, or ``und`` (score and known_share 0, no spans) if the text is null or holds no letter
    or nothing was learned. known_share tells how much of the letters is in scripts of learned languages. Columns of these names in the input give way. The model goes to each task once; rows are judged one by
    one, without a shuffle. Whole texts are read; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = ("lang_pred", "score", "spans", "known_share")
    kept = [c for c in docs.columns if c.lower() not in added]
    text = kept.index("text")
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, text, 8 * PORTION):
                rows = predict(held.value, some.column(text).to_pylist())
                columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([",".join(f"{s}:{a}:{b}" for s, a, b in r[2]) for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.float64())]
                yield pa.RecordBatch.from_arrays([*some.columns, *columns], names=[*kept, *added])
        give_back()

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "lang_pred string", "score double", "spans string", "known_share double"])
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(judge, schema)


def op10_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold(F.col("doc_id"), FOLDS) != 0))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "lang_pred", "score", "spans")
