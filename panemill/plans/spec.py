"""Query specifications and their text form.

Windows: ``TUMBLING,size[,id[,TIME|COUNT]]``, ``SLIDING,size,slide[,id[,TIME|COUNT]]``, ``SESSION,gap[,id]``, joined by
``;``; or, alone, ``CONCURRENT,k,TUMBLING,base``. Functions: names joined by ``;``. Times are milliseconds.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd
from typing import Literal

from panemill.functions.aggregates import Aggregate, aggregate

Kind = Literal["TUMBLING", "SLIDING", "SESSION"]
Measure = Literal["TIME", "COUNT"]
#: Concurrent windows have lengths in multiples of this.
STEP_MS = 100
#: How late an event may be.
LATENESS_MS = 100


@dataclass(frozen=True)
class WindowSpec:
    kind: Kind
    size: int  # the gap of a session
    slide: int
    window_id: int = -1
    measure: Measure = "TIME"

    def __post_init__(self) -> None:
        if self.size <= 0 or self.slide <= 0:
            raise ValueError("a window's size, slide and gap are positive")
        if self.kind == "SESSION" and self.measure == "COUNT":
            raise ValueError("a session has no count")


def tumbling(size: int, window_id: int = -1, measure: Measure = "TIME") -> WindowSpec:
    return WindowSpec("TUMBLING", size, size, window_id, measure)


def sliding(size: int, slide: int, window_id: int = -1, measure: Measure = "TIME") -> WindowSpec:
    return WindowSpec("SLIDING", size, slide, window_id, measure)


def session(gap: int, window_id: int = -1) -> WindowSpec:
    return WindowSpec("SESSION", gap, gap, window_id)


class JavaRandom:
    """The linear congruential generator that java.util.Random's documentation specifies."""

    def __init__(self, seed: int) -> None:
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - n)

    def below(self, bound: int) -> int:
        if bound & (bound - 1) == 0:
            return bound * self.bits(31) >> 31
        while True:
            x = self.bits(31)
            if x - x % bound + bound - 1 < 1 << 31:
                return x % bound


def java_hash(text: str) -> int:
    """A string's hash as the Java language specifies it: base 31 over UTF-16 units, as a signed 32-bit number."""
    units = text.encode("utf-16-be")
    h = 0
    for i in range(0, len(units), 2):
        h = (31 * h + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def concurrent(text: str) -> list[WindowSpec]:
    """k tumbling windows, ids 1 to k, of random lengths up to the base; the text itself is the seed."""
    parts = text.split(",")
    if len(parts) < 4 or parts[0] != "CONCURRENT" or parts[2] != "TUMBLING" or int(parts[3]) < STEP_MS:
        raise ValueError(f"not a set of concurrent windows: {text}")
    random = JavaRandom(java_hash(text))
    return [tumbling((random.below(int(parts[3]) // STEP_MS) + 1) * STEP_MS, i) for i in range(1, int(parts[1]) + 1)]


def parse_window(text: str) -> WindowSpec:
    kind, *rest = text.strip().split(",")
    sizes = {"TUMBLING": 1, "SLIDING": 2, "SESSION": 1}.get(kind)
    if sizes is None or not sizes <= len(rest) <= sizes + 2:
        raise ValueError(f"not a window: {text}")
    numbers = [int(x) for x in rest[: sizes + 1]]
    measure = rest[sizes + 1] if len(rest) > sizes + 1 else "TIME"
    if measure not in ("TIME", "COUNT"):
        raise ValueError(f"not a measure: {measure}")
    return WindowSpec(kind, numbers[0], numbers[sizes - 1], numbers[sizes] if len(numbers) > sizes else -1, measure)


def parse_windows(text: str) -> list[WindowSpec]:
    return concurrent(text) if text.startswith("CONCURRENT") else [parse_window(x) for x in text.split(";") if x.strip()]


@dataclass(frozen=True)
class QuerySpec:
    """Windows and functions; a function's id is its place, so that one may stand twice."""

    windows: tuple[WindowSpec, ...]
    functions: tuple[Aggregate, ...]
    #: Whether count windows count all events (``global``) or those of each key (``key``).
    count_scope: Literal["global", "key"] = "global"
    #: Whether events are told apart by key; else all have the key of events without one.
    keyed: bool = True

    @classmethod
    def parse(cls, windows: str, functions: str, count_scope: Literal["global", "key"] = "global", *, keyed: bool = True) -> QuerySpec:
        found = cls(tuple(parse_windows(windows)), tuple(aggregate(x) for x in functions.split(";") if x.strip()), count_scope, keyed)
        if not found.windows or not found.functions:
            raise ValueError("a query has a window and a function at least")
        return found

    def fixed(self) -> list[WindowSpec]:
        return [w for w in self.windows if w.measure == "TIME" and w.kind != "SESSION"]

    def sessions(self) -> list[WindowSpec]:
        return [w for w in self.windows if w.kind == "SESSION"]

    def counts(self) -> list[WindowSpec]:
        return [w for w in self.windows if w.measure == "COUNT"]

    def pane_ms(self) -> int:
        """The longest pane that every fixed time window is made of."""
        return gcd(*[x for w in self.fixed() for x in (w.size, w.slide)])
