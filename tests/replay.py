"""Plain-Python replays of the telemetry state machine, used as brute force in tests."""

from __future__ import annotations

import math
from bisect import bisect_left

BOUNDS = [1]
while len(BOUNDS) < 90:
    BOUNDS.append(max(math.floor(BOUNDS[-1] * 1.2 + 0.5), BOUNDS[-1] + 1))


def trunc_div(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


class Histogram:
    def __init__(self):
        self.counts = [0] * 91

    def add(self, value: int) -> None:
        self.counts[bisect_left(BOUNDS, value)] += 1

    @property
    def overflowed(self) -> bool:
        return self.counts[90] > 0

    def percentile(self, p: float) -> int | None:
        if self.overflowed:
            return None
        k = math.floor(sum(self.counts) * p)
        if k == 0:
            return 0
        seen = 0
        for i in range(90):
            seen += self.counts[i]
            if seen >= k:
                return BOUNDS[i]
        return 0

    def mean(self) -> int | None:
        if self.overflowed:
            return None
        total = sum(c * b for c, b in zip(self.counts, BOUNDS, strict=False))
        return math.ceil(total / sum(self.counts))

    def min(self) -> int:
        i = next(i for i, c in enumerate(self.counts) if c)
        return 0 if i == 0 else 1 + BOUNDS[i - 1]

    def max(self) -> int:
        if self.overflowed:
            return 2**63 - 1
        return BOUNDS[max(i for i, c in enumerate(self.counts) if c)]


def replay(rows):
    """rows of (node, ts, seq, total, time), any order -> {(node, seq): (delta, time_delta, us, p95, p99)}"""
    state, out = {}, {}
    for node, _, seq, total, time in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        peak, before, hist = state.get(node, (0, 0, None))
        hist = hist or Histogram()
        delta = max(total - peak, 0)
        time_delta = time - before
        us, p95, p99 = None, 0, 0
        if delta:
            us = trunc_div(time_delta, delta) * 1000
            hist.add(us)
            p95, p99 = hist.percentile(0.95), hist.percentile(0.99)
        state[node] = (peak + delta, time, hist)
        out[(node, seq)] = (delta, time_delta, us, p95, p99)
    return out
