"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Each predictor counts which byte followed which context in the training texts; a context's counts give the bit
predictors on a byte's way from the root of a binary tree. At scoring the predictors' log odds are mixed with
weights that two gates pick: the place of the bit in its byte, and whether the longest context is known. A scale and a
shift for each place, which follow what the mixed odds turned out to mean, refine them. All of these begin with fixed
values for each text and move along the whole text, after each step of 32 bytes; a text's score hence depends on
itself and the counts alone.

Counts are exact and grow with the corpus: texts are dealt to slices; a slice sends the contexts of its texts, with
what its training texts count, to parts of the contexts' hashes; each part adds up and sends each slice the log odds
that it asked for. No task holds more than a slice or a part, and a context costs each slice that has it one entry.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.llm.common import fold, give_back, table, written

FOLDS = 10
#: Base-10 smoothing of the base score: added to each token's count.
ADDED = 0.1
#: Bytes of context of each predictor; 0: the word so far, whose contexts also count the tokens.
CONTEXTS, LONGEST = (3, 5, 0), 1
#: Pseudo-count of each bit; log odds are held in sixteenths.
PRIOR, GRAIN = 0.02, 16.0
PAD, SPACE, END = 8, 32, 0xFF
#: Bytes that share weights before these move.
STEP = 32
#: Weights at a text's beginning, by whether the longest context is known, and how fast they move.
START = ((0.5, 0.3, 0.4), (0.2, 0.5, 0.4))
RATE = 0.01
#: How fast the scale and the shift move that refine the mixed log odds; these are bounded, in nats.
REFINE, LIMIT = 0.002, 11.0
#: Bytes of texts that meet their counts together, bytes whose keys are worked out at once, texts that are mixed at once.
SLICE, LOT, SIDE = 10 << 20, 1 << 19, 512
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_TOKEN = np.uint64(1 << 8)
#: For eight bits: by the gate 0 or 1; by the byte 1 for each that is set, else -1, and 0 for none, byte 256.
_GATES = np.repeat(np.array([[0], [1]], np.float32), 8, axis=1)
_SIGNS = np.vstack([np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * np.float32(2) - 1, np.zeros((1, 8), np.float32)])


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, with A-Z as a-z: ``bytes`` split at just the characters 32 and 9 to 13."""
    return text.lower().split()


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, each with a space after every token, an end byte, and zeros before it; their starts."""
    parts = [b"\0" * PAD + b" ".join([*tokens_of(t), b"\xff"]) for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def _zeros(starts: np.ndarray) -> np.ndarray:
    """The places of the zeros before each of some laid-out texts."""
    return (starts[:-1, None] + np.arange(PAD)).reshape(-1)


def context_keys(body: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """For each predictor the key of each byte of laid-out texts; the zeros before a text have its first byte's.

    A key has 55 bits of the context's hash, a bit that tells the word's contexts, and the byte.
    """
    wide = body.astype(np.uint64)
    before = np.ndarray((len(body),), "<u8", bytes(8) + body.tobytes(), strides=(1,))
    zeros = _zeros(starts)
    for k, back in enumerate(CONTEXTS):
        h = before >> np.uint64(64 - 8 * back) if back else _words_so_far(body, wide, zeros)
        h += np.uint64((k + 1) * 0xC2B2AE3D27D4EB4F % 2**64)
        h *= _ODD[0]
        h ^= h >> np.uint64(32)
        h *= _ODD[1]
        h ^= h >> np.uint64(32)
        h &= ~np.uint64(511)
        h |= wide
        if not back:
            h |= _TOKEN
        h[zeros] = np.repeat(h[starts[:-1] + PAD], PAD)
        yield h


def _words_so_far(body: np.ndarray, wide: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """For each byte a hash of what stands before it in its word: a polynomial, 0 for nothing."""
    first = np.empty(len(body) + 1, bool)
    first[0] = True
    np.equal(body, SPACE, out=first[1:])
    first[zeros + 1] = True
    begin = np.flatnonzero(first[:-1])
    lengths = np.diff(np.append(begin, len(body)))
    place = np.arange(len(body), dtype=np.int32)
    place -= np.repeat(begin.astype(np.int32), lengths)
    powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, _ODD[0]))
    terms = np.take(powers, place)
    terms *= wide + np.uint64(1)
    upto = np.cumsum(terms)
    upto -= terms
    upto -= np.repeat(upto[begin], lengths)
    return upto


def different(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the sums of their numbers (64 bits)."""
    order = np.argsort(keys, kind="stable")
    keys, n = np.take(keys, order), np.take(n, order)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def counted(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each predictor the different keys of these texts, sorted, and how often each occurs."""
    body, starts = laid_out(texts)
    real = np.ones(len(body), bool)
    real[_zeros(starts)] = False
    return [_runs(keys[real]) for keys in context_keys(body, starts)]


def count_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of these texts, sorted, and how often each occurs."""
    found = counted(texts)
    return different(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))


class Numbers:
    """Numbers different keys from 0 as they come: a table of numbers by a hash, with the next free slot on a clash.

    Of keys that clash the first one to come, most often the most frequent one, keeps the slot.
    """

    def __init__(self, keys: np.ndarray | None = None) -> None:
        self.size, self.held = 0, np.zeros(1 << 15, np.uint64)
        self._table()
        if keys is not None:
            self.of(keys)

    def _table(self) -> None:
        bits = (4 * len(self.held)).bit_length() - 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self._put(np.arange(self.size, dtype=np.int32))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots = keys * _ODD[0]
        slots >>= self.shift
        return slots.view(np.int64)

    def _put(self, left: np.ndarray) -> None:
        slot = self._slots(self.held[left])
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free][::-1]] = left[free][::-1]  # the last one written stays
            lost = self.slots[slot] != left
            left, slot = left[lost], slot[lost] + 1 & self.mask

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        out = np.take(self.slots, slot)
        # -1, none, reads the first key instead
        left = np.flatnonzero((np.take(self.held, out, mode="clip") != keys) & (out >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            out[left] = self.slots[slot[left]]
            left = left[(self.held[out[left]] != keys[left]) & (out[left] >= 0)]
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; new keys get the next ones, in their order."""
        out = self._find(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            some = np.sort(keys[new])
            some = some[np.append(True, some[1:] != some[:-1])]
            before, self.size = self.size, self.size + len(some)
            if self.size > len(self.held):
                self.held = np.concatenate([self.held, np.zeros(max(len(self.held), self.size - len(self.held)), np.uint64)])
                self.held = np.concatenate([self.held, np.zeros((1 << (len(self.held) - 1).bit_length()) - len(self.held), np.uint64)])
                self.held[before : self.size] = some
                self._table()
            else:
                self.held[before : self.size] = some
                self._put(np.arange(before, self.size, dtype=np.int32))
            out[new] = self._find(keys[new])
        return out

    def keys(self) -> np.ndarray:
        return self.held[: self.size]


def odds_of(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of the counts of all keys of some contexts, sorted, each key's log odds of its byte's bits: (keys, 8), int8."""
    odds = np.zeros((len(keys), 8), np.int8)
    for bit in range(8 if len(keys) else 0):
        node = keys >> np.uint64(8 - bit)
        new = np.append(True, node[1:] != node[:-1])
        begin = np.flatnonzero(new)
        ones = np.add.reduceat(n * (keys >> np.uint64(7 - bit) & np.uint64(1)).astype(np.int64), begin)
        zeros = np.add.reduceat(n, begin) - ones
        of_node = np.clip(np.rint(np.log((ones + PRIOR) / (zeros + PRIOR)) * GRAIN), -127, 127).astype(np.int8)
        odds[:, bit] = of_node[np.cumsum(new) - 1]
    return odds


def is_token(keys: np.ndarray) -> np.ndarray:
    """Which keys stand for a whole token: a word's context with the space after it, or the end."""
    byte = keys & np.uint64(255)
    return (keys & _TOKEN > 0) & ((byte == SPACE) | (byte == END))


@dataclass
class Spelled:
    """Some laid-out texts with the numbers of their keys, (predictors, bytes), the places of their tokens' ends, and the
    byte of each number.

    Bytes and numbers have one more place at the end, which stands for none.
    """

    body: np.ndarray
    starts: np.ndarray
    numbers: np.ndarray
    tokens: np.ndarray
    bytes_of: np.ndarray


def spell(texts: list[bytes], numbers: Numbers) -> Spelled:
    body, starts = laid_out(texts)
    found = np.full((len(CONTEXTS), len(body) + 1), -1, np.int32)
    token = np.zeros(len(body), bool)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + LOT)) - 1)
        some = slice(starts[first], starts[last])
        for k, keys in enumerate(context_keys(body[some], starts[first : last + 1] - starts[first])):
            found[k, some] = numbers.of(keys)
            if not CONTEXTS[k]:
                token[some] = is_token(keys)
        first = last
    token[_zeros(starts)] = False
    return Spelled(np.append(body, np.uint8(0)), starts, found, np.flatnonzero(token), numbers.keys().astype(np.uint8))


def judge(odds: np.ndarray, n: np.ndarray, spelled: Spelled) -> list[np.ndarray]:
    """Of each text: n_tokens, n_known, the sum of log10(c + 0.1) over its tokens, the mixed log10 probability, and the
    bytes that it is spelled with. ``odds`` (numbers, 8) and ``n``, the counts of tokens, are by the keys' numbers."""
    return judge_own(odds * _sides(spelled.bytes_of), n, spelled)


def judge_own(odds: np.ndarray, n: np.ndarray, spelled: Spelled) -> list[np.ndarray]:
    """As ``judge``, by the log odds of the bits as they are."""
    starts = spelled.starts
    size, first = np.diff(starts) - PAD, starts[:-1] + PAD
    c = n[spelled.numbers[CONTEXTS.index(0), spelled.tokens]]
    of = np.searchsorted(starts, spelled.tokens, "right") - 1
    sums = [np.bincount(of, x, len(size)) for x in (np.ones(len(c)), c > 0, np.log10(c + ADDED))]
    packed = np.append(odds.view(np.uint64).reshape(-1), np.uint64(0))  # the last one, number -1, is none
    total = np.zeros(len(size))
    order = np.argsort(-size, kind="stable")
    for lot in range(0, len(order), SIDE):
        some = order[lot : lot + SIDE]
        total[some] = mix(packed, spelled, first[some], size[some])
    return [*sums, total / np.log(10), size]


def mix(packed: np.ndarray, spelled: Spelled, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log probabilities of texts, longest first, that go forward side by side; ``packed``: each number's eight log odds
    of the bits as they are, so that a bit's sign matters to the shift alone."""
    # an empty text at the end: a sum over one column would add in another order
    first, size = np.append(first, 0), np.append(size, 0)
    k, n, end = len(CONTEXTS), len(first), len(spelled.body) - 1
    # bits stand innermost: a place's eight weights are copied at once, and no odds are put in another order
    weights = np.empty((k, 2, n, 8), np.float32)
    weights[:] = (np.array(START, np.float32).T / np.float32(GRAIN))[:, :, None, None]
    scale, shift, total = np.ones(n * 8, np.float32), np.zeros(n * 8, np.float32), np.zeros(n * 8)
    moved, rate = weights.reshape(k, 2, n * 8), np.float32(RATE / GRAIN / GRAIN)
    for at in range(0, int(size[0]), STEP):
        m = max(2, int(np.searchsorted(-size, -at, "left")))
        inside = np.arange(at, at + STEP)[:, None] < size[:m]
        place = np.where(inside, first[:m] + np.arange(at, at + STEP)[:, None], end).reshape(-1)
        odds = packed[np.take(spelled.numbers, place, axis=1)].view(np.int8)
        gate = (odds[LONGEST, ::8] != 0).astype(np.intp)  # whether the longest context has been seen: what its first bit's odds tell
        x = odds.astype(np.float32)
        own = np.take(weights.reshape(k, 2 * n, 8), (gate.reshape(STEP, m) * n + np.arange(m)).reshape(-1), axis=1, mode="clip").reshape(k, -1)
        own *= x
        mixed = own[0]
        for other in own[1:]:
            mixed += other
        np.clip(mixed, -LIMIT, LIMIT, out=mixed)
        # the mixed odds as they are teach the weights; places beyond a text's end have no odds
        wrong = np.negative(mixed)
        np.exp(wrong, out=wrong)
        wrong /= wrong + 1
        x *= wrong
        every = x.reshape(k, STEP, -1).sum(axis=1)
        x *= np.take(_GATES, gate, axis=0, mode="clip").reshape(-1)
        longest = x.reshape(k, STEP, -1).sum(axis=1)
        moved[:, 1, : m * 8] += rate * longest
        every -= longest
        moved[:, 0, : m * 8] += rate * every
        # refined by a scale and a shift of their own, which follow what the mixed odds have meant so far
        sign = np.take(_SIGNS, np.where(inside.reshape(-1), np.take(spelled.body, place), np.int16(256)), axis=0, mode="clip").reshape(STEP, -1)
        mixed = mixed.reshape(STEP, -1)
        missed = scale[: m * 8] * mixed
        missed += sign * shift[: m * 8]
        np.clip(missed, -LIMIT, LIMIT, out=missed)
        np.negative(missed, out=missed)
        np.exp(missed, out=missed)
        missed += np.abs(sign)  # beyond a text's end: 1 and 0
        # eight factors of 60,000 at most are within the range of a float32
        total[: m * 8] -= np.log(missed.reshape(-1, 8, m * 8).prod(axis=1)).sum(axis=0, dtype=np.float64)
        np.reciprocal(missed, out=missed)
        np.subtract(1, missed, out=missed)
        sign *= missed
        shift[: m * 8] += np.float32(REFINE) * sign.sum(axis=0)
        missed *= mixed
        scale[: m * 8] += np.float32(REFINE) * missed.sum(axis=0)
    return total.reshape(n, 8).sum(axis=1)[:-1]


def _portions(column: pa.ChunkedArray) -> Iterator[list[bytes]]:
    """The texts of a column as UTF-8, nulls as empty ones, some 512 KB at a time."""
    some: list[bytes] = []
    held = 0
    for text in column:
        some.append((text.as_py() or "").encode())
        held += len(some[-1])
        if held >= LOT:
            yield some
            some, held = [], 0
    if some:
        yield some


def _slice_keys(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a slice's texts, sorted, and how often its training texts hold them."""
    found = []
    for learn in (True, False):
        for texts in _portions(group.filter(pa.compute.equal(group.column("learn"), learn)).column("text")):
            # sorted runs, which one sort merges
            found += [(keys, n if learn else np.zeros(len(n), np.int64)) for keys, n in counted(texts)]
    return different(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))


def _planes(values: np.ndarray, wide: int) -> bytes:
    """The low bytes of numbers, byte by byte: the shuffle packs them better than one number after the other."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def _numbers(planes: bytes, wide: int) -> np.ndarray:
    found = np.zeros((len(planes) // wide, 8), np.uint8)
    found[:, :wide] = np.frombuffer(planes, np.uint8).reshape(wide, -1).T
    return found.view("<u8").reshape(-1)


def _sides(keys: np.ndarray) -> np.ndarray:
    """1 for each bit of the keys' bytes that is set, else -1: (keys, 8), int8."""
    return np.unpackbits(keys.astype(np.uint8)[:, None], axis=1).view(np.int8) * np.int8(2) - np.int8(1)


def _odds_planes(odds: np.ndarray, keys: np.ndarray) -> bytes:
    """Log odds of the bits as they are, each as what it differs by from the one before: mostly zeros, plane by plane."""
    own = (odds * _sides(keys)).T
    own[1:] -= own[:-1].copy()
    return own.tobytes()


def _planes_odds(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.cumsum(planes.reshape(8, -1), axis=0, dtype=np.int8).T)


def _width(values: np.ndarray) -> int:
    return max(1, -(-int(values.max(initial=0)).bit_length() // 8))


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the sorted keys of each part begin, and their end: parts are ranges of the contexts' hashes."""
    edges = np.array([p * (1 << 55) // parts for p in range(1, parts)], np.uint64) << np.uint64(9)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _asked(parts: int) -> Callable[[pa.Table], pa.Table]:
    def ask(group: pa.Table) -> pa.Table:
        keys, n = _slice_keys(group)
        cuts = _cuts(keys, parts)
        own = group.column("slice")[0].as_py()
        rows = []
        for part, (a, b) in enumerate(itertools.pairwise(cuts.tolist())):
            if a < b:
                some, context = keys[a:b], keys[a:b] >> np.uint64(8)
                new = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                bytes_of = np.diff(np.append(new, b - a)) - 1
                rows.append((part, own, _planes(context[new], 7), bytes_of.astype(np.uint8).tobytes(), some.astype(np.uint8).tobytes(), (width := _width(n[a:b])), _planes(n[a:b], width)))
        give_back()
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
        return pa.table({name.split()[0]: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(zip(ASKED.split(", "), types, strict=True))})

    return ask


ASKED = "part long, slice long, contexts binary, times binary, bytes binary, width int, counts binary"
ANSWERED = "slice long, part long, odds binary, width int, tokens binary, n long, different long"


def _answer(group: pa.Table) -> pa.Table:
    """What all slices' training texts hold about a part's contexts, to each slice that has asked, and the part's sums."""
    asked = []
    for i in range(len(group)):
        contexts, times, byte = (group.column(c)[i].as_py() for c in ("contexts", "times", "bytes"))
        context = np.repeat(_numbers(contexts, 7), np.frombuffer(times, np.uint8).astype(np.int64) + 1)
        asked.append(context << np.uint64(8) | np.frombuffer(byte, np.uint8))
    counts = [_numbers(c, w).astype(np.int64) for c, w in zip(group.column("counts").to_pylist(), group.column("width").to_pylist(), strict=True)]
    keys, n = different(np.concatenate(asked), np.concatenate(counts))
    odds, sums = odds_of(keys, n), np.where(is_token(keys), n, 0)
    del counts
    rows = []
    for own, some in zip(group.column("slice").to_pylist(), asked, strict=True):
        at = np.searchsorted(keys, some)
        tokens = sums[at[is_token(some)]]
        rows.append((own, group.column("part")[0].as_py(), _odds_planes(odds[at], some), (width := _width(tokens)), _planes(tokens, width), 0, 0))
    # sums go to slices of their own
    rows.append((-1 - rows[0][1] % 64, rows[0][1], b"", 1, b"", int(sums.sum()), int((sums > 0).sum())))
    give_back()
    types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table({name.split()[0]: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(zip(ANSWERED.split(", "), types, strict=True))})


JUDGED = "doc_id long, n_tokens long, n_known long, base double, score double, n_bytes long, n long, different long"


def _judged(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Scores of a slice's texts, or of a slice without texts the parts' sums."""
    names = [c.split()[0] for c in JUDGED.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
    if not len(texts):
        sums = [pa.compute.sum(answers.column(c)).as_py() for c in ("n", "different")]
        return pa.table({name: pa.array([x], t) for name, x, t in zip(names, [None] * 6 + sums, types, strict=True)})
    answers = answers.sort_by("part")
    numbers = Numbers()
    spelled = spell([(t.as_py() or "").encode() for t in texts.column("text")], numbers)
    order = np.argsort(numbers.keys())
    odds, n = np.empty((numbers.size, 8), np.int8), np.zeros(numbers.size, np.int64)
    done = 0
    for planes in answers.column("odds"):
        some = order[done : done + len(planes.as_buffer()) // 8]
        odds[some] = _planes_odds(np.frombuffer(planes.as_buffer(), np.int8))
        done += len(some)
    n[order[is_token(numbers.keys()[order])]] = np.concatenate([_numbers(x, w) for x, w in zip(answers.column("tokens").to_pylist(), answers.column("width").to_pylist(), strict=True)]).astype(np.int64)
    columns = judge_own(odds, n, spelled)
    give_back()
    none = [pa.nulls(len(texts), pa.int64())] * 2
    return pa.table(dict(zip(names, [texts.column("doc_id").combine_chunks(), *[pa.array(c).cast(t) for c, t in zip(columns, types[1:6], strict=True)], *none], strict=True)))


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """Score whole ``docs`` (doc_id, text) by those of them that ``learn``, a condition, picks as training texts.

    Columns: doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte. The base score adds
    log10((c + 0.1) / (N + 0.1 * (V + 1))) over a text's tokens and its end; score is log10 of the mixed model's
    probability of the same tokens, spelled out with a space after each and an end byte; n_bytes counts these bytes.
    Null text counts as empty and has one token, its end. A condition that is null does not hold. Repeated rows are
    scored each, equally; very long texts are read whole, by one task each. Extra columns are left out, also where
    ``learn`` reads them; an empty table gives an empty result, and without training rows no token is known.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = -(-size // SLICE) or 1
    # equal rows of different partitions go to different slices
    own = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(slices))
    rows = docs.select(own.alias("slice"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    answers = rows.groupBy("slice").applyInArrow(_asked(slices), ASKED).groupBy("part").applyInArrow(_answer, ANSWERED)
    judged = written(rows.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_judged, JUDGED), "judged")
    sums = judged.where("n_tokens IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum("different"), F.lit(0)).alias("kinds"))
    whole = F.log10(F.col("all") + ADDED * (F.col("kinds") + 1))
    found = judged.where("n_tokens IS NOT NULL").join(F.broadcast(sums))  # one row
    return found.select("doc_id", "n_tokens", "n_known", F.col("all").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * whole).alias("base_score"), "score", "n_bytes", (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fold(F.col("doc_id"), FOLDS) != 0)
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
