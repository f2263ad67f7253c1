"""Personal data: patterns, and a skip-chain conditional random field that carries labels to what repeats them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.llm.common import table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents on which the field's potentials are learned: those with the least hashes of their ids.
SAMPLE_DOCS = 5_000
#: Steps and rate of the training, and what holds its weights near 0 (a share of each).
STEPS, RATE, DECAY = 400, 0.5, 1e-3
ROUNDS, DAMPING, ACCEPT = 30, 0.3, 0.8
#: Digits of a number that may be personal data, in the forms that the patterns leave out.
LEAST_DIGITS, MOST_DIGITS = 7, 19

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits does
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9](?:[\x20().-]{0,2}[0-9])+(?![0-9A-Za-z])")
_PIECE = re.compile(r"[^\x20]+")
_BROKEN_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}(?![0-9])")
_SPELLED = re.compile(r"\x20?(?:\(at\)|\[at\])\x20?([A-Za-z0-9-]+(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]+)+)")
_DOT = re.compile(r"\x20?(?:\(dot\)|\[dot\])\x20?")
_CUE = re.compile(r"(call|phone|tel|fax|mobile|cell|contact|reach|mail|card|host|server|address)[^A-Za-z]{0,3}$", re.IGNORECASE)

Span = tuple[int, str, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The patterns' spans in order of start and kind; each kind is matched leftmost without overlaps."""
    found: list[Span] = []
    done = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, "email", m.end()))
                done = m.end()
    for m in _IP.finditer(text):
        if all(len(d := p.lstrip("0")) < 4 and int(d or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


@dataclass
class Node:
    start: int
    end: int
    label: int  # of a base span; 0 if it is only a candidate
    key: str  # equal for tokens that repeat each other
    bits: int


#: What a token's features tell, one bit each. None of them follows from a pattern: a sign that only base spans have
#: would tell nothing about the other forms.
FEATURES = ("email", "ip", "short", "middle", "long", "cue", "broken", "first", "always")


def _node(text: str, start: int, end: int, label: int, key: str) -> Node:
    token = text[start:end]
    n = len(_digits(token))
    number = key[0] == "n"
    told = (key[0] == "m", key[0] == "i", number and n < 10, number and 10 <= n < 12, number and n >= 12, bool(_CUE.search(text[max(0, start - 24) : start])), " " in token or "-" in token, start == 0 or text[start - 1] == "\n", True)
    return Node(start, end, label, key, sum(x << i for i, x in enumerate(told)))


def _number_key(token: str) -> str:
    return "n" + _digits(token)[-7:]


def _loose(text: str) -> list[tuple[int, int, str]]:
    """What may be personal data in a form that the patterns leave out, with its key."""
    found = []
    for m in _NUMBER.finditer(text):
        digits = len(_digits(m[0]))
        if digits > MOST_DIGITS:  # several numbers in a row
            found += [(m.start() + x.start(), m.start() + x.end(), _number_key(x[0])) for x in _PIECE.finditer(m[0]) if LEAST_DIGITS <= len(_digits(x[0])) <= MOST_DIGITS]
        elif digits >= LEAST_DIGITS:
            found.append((m.start(), m.end(), _number_key(m[0])))
    if "[" in text or "(" in text:
        found += [(m.start(), m.end(), "i" + ".".join(re.findall("[0-9]+", m[0]))) for m in _BROKEN_IP.finditer(text)]
        done = 0
        for m in _SPELLED.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, m.end(), "m" + (text[start : m.start()] + "@" + _DOT.sub(".", m[1])).lower()))
            done = m.end()
    return sorted(found)


def nodes_of(text: str, base: list[Span]) -> list[Node]:
    """The field's nodes in order: base spans and, apart from them, what may be personal data in another form."""
    nodes = []
    for start, kind, end in base:
        token = text[start:end]
        nodes.append(_node(text, start, end, LABELS.index(kind), "m" + token.lower() if kind == "email" else "i" + token if kind == "ip" else _number_key(token)))
    taken: list[list[int]] = []  # the base spans of all kinds, those that overlap as one
    for start, _, end in base:
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(end, taken[-1][1])
        else:
            taken.append([start, end])
    last, i = -1, 0
    for start, end, key in _loose(text):
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if start >= last and (i == len(taken) or taken[i][0] >= end):
            nodes.append(_node(text, start, end, 0, key))
            last = end
    return sorted(nodes, key=lambda x: (x.start, x.end))


def edges_of(nodes: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours, and skip edges: each token with the last and the first that it repeats."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1)]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    skip = []
    for i, x in enumerate(nodes):
        if x.key in last:
            skip.append((last[x.key], i))
            if first[x.key] != last[x.key]:
                skip.append((first[x.key], i))
        first.setdefault(x.key, i)
        last[x.key] = i
    return chain, skip


@dataclass
class Field:
    """Log potentials: of a label by each feature, (features, labels), and of the labels of two tokens."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def own(self, bits: np.ndarray) -> np.ndarray:
        return (bits[:, None] >> np.arange(len(FEATURES)) & 1) @ self.unary


def observed(text: str) -> list[tuple[int, ...]]:
    """What a text teaches: of each token whose label is known its features, its label, its neighbours' labels (-1 if
    unknown or none), and how many of the tokens that it is linked to by repetition have each label.

    A base span has its kind and a candidate none; but the label of a candidate that repeats a base span is unknown.
    """
    nodes = nodes_of(text, base_spans(text))
    held = {x.key for x in nodes if x.label}
    labels = [x.label if x.label or x.key not in held else -1 for x in nodes]
    repeated = [[0] * len(LABELS) for _ in nodes]
    for a, b in edges_of(nodes)[1]:
        for x, y in ((a, b), (b, a)):
            if labels[y] >= 0:
                repeated[x][labels[y]] += 1
    return [(x.bits, labels[i], labels[i - 1] if i else -1, labels[i + 1] if i + 1 < len(nodes) else -1, *repeated[i]) for i, x in enumerate(nodes) if labels[i] >= 0]


def trained(rows: np.ndarray, times: np.ndarray) -> Field:
    """Potentials that maximize the pseudo-likelihood of ``rows`` as ``observed`` gives them, each so many times: of
    each label given its features and the labels around it."""
    size = len(LABELS)
    field = Field(np.zeros((len(FEATURES), size)), np.zeros((size, size)), np.zeros((size, size)))
    if not len(rows):
        return field
    bits, label, left, right, repeated = rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4:].astype(float)
    features = (bits[:, None] >> np.arange(len(FEATURES)) & 1).astype(float)
    before, after = np.eye(size + 1)[left][:, :size], np.eye(size + 1)[right][:, :size]
    target, weight = np.eye(size)[label], (times / times.sum())[:, None]
    for _ in range(STEPS):
        scores = features @ field.unary + before @ field.chain + after @ field.chain.T + repeated @ field.skip
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        wrong = (target - p / p.sum(axis=1, keepdims=True)) * weight
        field.unary += RATE * (features.T @ wrong - DECAY * field.unary)
        field.chain += RATE * (before.T @ wrong + wrong.T @ after - DECAY * field.chain)
        both = repeated.T @ wrong
        field.skip += RATE * (both + both.T - DECAY * field.skip)
    return field


def learn(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Field:
    """Potentials from at most ``sample`` documents, those whose ids have the least hashes; ids are dealt before texts.

    The driver gets counts of what tokens have around them, not texts.
    """
    docs = docs.select("doc_id", "text")
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct().orderBy(F.xxhash64(F.col("id").cast("string"), F.lit("field")), "id").limit(sample)
    rows = docs.where("text IS NOT NULL").join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(row for text in batch.column(0).to_pylist() for row in observed(text))
            yield pa.RecordBatch.from_arrays([pa.array([list(r) for r in found], pa.list_(pa.int64())), pa.array(list(found.values()), pa.int64())], names=["row", "n"])

    got = rows.mapInArrow(count, "row array<long>, n long").groupBy("row").agg(F.sum("n").alias("n")).orderBy("row").collect()
    return trained(np.array([r.row for r in got], np.int64).reshape(len(got), 4 + len(LABELS)), np.array([r.n for r in got], float))


def marginals(field: Field, nodes: list[Node]) -> np.ndarray:
    """Label probabilities of each node by loopy belief propagation; base spans are held at their kind."""
    size = len(LABELS)
    own = field.own(np.array([x.bits for x in nodes], np.int64))
    for i, x in enumerate(nodes):
        if x.label:
            own[i] = -50.0
            own[i, x.label] = 0
    chain, skip = edges_of(nodes)
    if not chain:
        own = np.exp(own - own.max(axis=1, keepdims=True))
        return own / own.sum(axis=1, keepdims=True)
    ends = np.array([*chain, *skip, *[(b, a) for a, b in (*chain, *skip)]])
    m = len(chain) + len(skip)
    reverse = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    table_of = np.where(np.tile(np.arange(m) < len(chain), 2)[:, None, None], field.chain, field.skip)
    table_of[m:] = np.swapaxes(table_of[m:], 1, 2)
    messages = np.zeros((2 * m, size))
    for _ in range(ROUNDS):
        belief = own.copy()
        np.add.at(belief, ends[:, 1], messages)
        sent = belief[ends[:, 0]] - messages[reverse]
        new = sent[:, :, None] + table_of
        top = new.max(axis=1, keepdims=True)
        new = np.log(np.exp(new - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        change = np.abs(new - messages).max()
        messages = DAMPING * messages + (1 - DAMPING) * new
        if change < 1e-3:
            break
    belief = own.copy()
    np.add.at(belief, ends[:, 1], messages)
    chance = np.exp(belief - belief.max(axis=1, keepdims=True))
    return chance / chance.sum(axis=1, keepdims=True)


def find(field: Field, text: str) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and all spans with those that the field adds; added ones overlap no base span."""
    base = base_spans(text)
    nodes = nodes_of(text, base)
    spans = list(base)
    if any(not x.label for x in nodes):
        chance = marginals(field, nodes)
        for x, p in zip(nodes, chance, strict=True):
            best = int(p.argmax())
            if x.label or not best or p[best] < ACCEPT:
                continue
            kind = LABELS[best]
            n = len(_digits(text[x.start : x.end]))
            # a kind keeps its own rules: an address has an at sign in some spelling, a card its check digit
            if kind == "phone" and x.key[0] == "n" and n <= 15 or kind == "email" and x.key[0] == "m" or kind == "ip" and x.key[0] == "i" or kind == "card" and 12 <= n <= 19 and luhn(_digits(text[x.start : x.end])):
                spans.append((x.start, kind, x.end))
    return base, sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Personal data in whole ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the hash are of the patterns' spans; ``spans`` lists all, with those that repeat them in another
    form, as kind:start:end in code points. Null text counts as empty; very long texts are read whole. Rows are judged
    one by one: repeated rows give equal results, extra columns are left out, an empty table gives an empty result.
    Where no ``field`` is given, one is learned from ``docs``.
    """
    field = learn(docs) if field is None else field
    held = docs.sparkSession.sparkContext.broadcast(field)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = find(held.value, text or "")
                kinds = [kind for _, kind, _ in base]
                rows.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, schema)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
