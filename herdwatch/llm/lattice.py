"""The lattice of all segmentations of text chunks into SentencePiece pieces, in numpy.

A chunk is a stretch of text no piece can cross the ends of, so that a text's segmentations are
the combinations of its chunks' segmentations.  Nodes are numbered by position first: chunks are
sorted by falling length, node (p, u) is ``offset[p] + u``, and all nodes of a position are one
slice.  Edges are sorted by the node they end in.
"""

from __future__ import annotations

import numpy as np

from herdwatch.llm.store import Sendable
from herdwatch.llm.words import keys, mix

MARK = "▁"


class Vocabulary(Sendable):
    """Pieces and log weights of a model; small enough to be sent to every task."""

    def __init__(self, model: str):
        import sentencepiece

        spm = sentencepiece.SentencePieceProcessor(model_file=model)
        size = range(spm.get_piece_size())
        skip = [spm.is_control(i) or spm.is_unknown(i) or spm.is_byte(i) or spm.is_unused(i) for i in size]
        self.bytes = np.full(256, spm.unk_id(), np.int32)
        for i in size:
            if spm.is_byte(i):
                self.bytes[int(spm.id_to_piece(i)[1:-1], 16)] = i
        self.pieces = [None if s else spm.id_to_piece(i) for i, s in zip(size, skip, strict=True)]
        score = np.array([spm.get_score(i) for i in size])
        if score.min() < -1000:
            # A model of merges has ranks, not probabilities: Zipf's law makes them log probabilities.
            rank = np.clip(-score, 0, len(score))
            score = -np.log(rank + 1) - np.log(np.sum(1 / (np.arange(len(score)) + 1)))
        self.weight = np.append(score, score.min() - 10)  # the last is a character as bytes

    def open(self) -> Vocabulary:
        """Build the tables for walking texts, once in a worker (not sent along, they are large)."""
        if hasattr(self, "inner"):
            return self
        chars = sorted({c for p in self.pieces if p for c in p})
        self.char = np.zeros(0x110000, np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        states, step, ends = {"": 0}, {}, {}
        for i, piece in enumerate(self.pieces):
            for n in range(1, len(piece or "") + 1):
                if piece[:n] not in states:
                    states[piece[:n]] = len(states)
                    step[states[piece[: n - 1]] * self.width + int(self.char[ord(piece[n - 1])])] = states[piece[:n]]
            if piece:
                ends[states[piece]] = i
        size = np.int32 if len(states) * self.width < 2**31 else np.int64
        self.step = np.array(sorted(step), size)
        self.next = np.array([step[k] for k in sorted(step)], size)
        self.ends = np.full(len(states), -1)
        self.ends[list(ends)] = list(ends.values())
        self.longest = max(len(p or "") for p in self.pieces)
        # States after one character: the first steps of most walks, in a table of their own.
        self.start = np.zeros(self.width, size)
        first = self.step < self.width
        self.start[self.step[first]] = self.next[first]
        self.inner = np.zeros((self.width, self.width), bool)
        for p in self.pieces:
            if p and len(p) > 1:
                ids = self.char[[ord(c) for c in p]]
                self.inner[ids[:-1], ids[1:]] = True
        return self


def chunks(vocabulary: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all marked texts, where each chunk begins, and each text's first chunk (one more each)."""
    marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.cumsum([0] + [len(t) for t in marked])
    ids = vocabulary.char[points]
    cut = np.ones(len(points) + 1, bool)
    cut[1:-1] = ~vocabulary.inner[ids[:-1], ids[1:]]
    cut[edges] = True
    begins = np.flatnonzero(cut)
    return points, begins, np.searchsorted(begins, edges)


class Lattice:
    """The lattice of the distinct chunks among ``points[begins[i]:begins[i + 1]]``."""

    def __init__(self, vocabulary: Vocabulary, points: np.ndarray, begins: np.ndarray, theta: float = 1.0):
        sizes = np.diff(begins)
        # Distinct chunks by a hash of their code points; the longest first.
        place = np.arange(len(points)) - np.repeat(begins[:-1], sizes)
        base = int(keys(1, 31)[0]) | 1
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, int(sizes.max(initial=1)) - 1), base, np.uint64)]))
        total = np.append(np.uint64(0), np.cumsum(mix(points.astype(np.uint64)) * power[place], dtype=np.uint64))
        _, first, self.chunk = np.unique(total[begins[1:]] - total[begins[:-1]] + sizes.astype(np.uint64), return_index=True, return_inverse=True)
        by_size = np.argsort(-sizes[first], kind="stable")
        rank = np.empty_like(by_size)
        rank[by_size] = np.arange(len(by_size))
        self.chunk, first = rank[self.chunk], first[by_size]
        self.size, start = sizes[first], begins[first]
        self.count = len(first)
        longest = int(self.size[0]) if self.count else 0
        # offset[p]: nodes of earlier positions; chunks of at least p characters have a node at p.
        per = np.searchsorted(-self.size, -np.arange(longest + 1), "right")
        self.offset = np.append(0, np.cumsum(per))
        self._edges(vocabulary, points, start, theta)
        self._masses(longest)

    def _edges(self, vocabulary: Vocabulary, points: np.ndarray, start: np.ndarray, theta: float) -> None:
        n = int(self.size.sum())
        owner = np.repeat(np.arange(self.count), self.size)
        at = np.arange(n) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.letter = points[np.repeat(start, self.size) + at]
        ids = vocabulary.char[self.letter]
        left = self.size[owner] - at
        live, state, found = np.arange(n), vocabulary.start[ids], []
        width = vocabulary.step.dtype.type(vocabulary.width)
        missing = np.flatnonzero(vocabulary.ends[state] < 0)
        found.append((missing, np.ones(len(missing), np.int64), np.full(len(missing), len(vocabulary.pieces))))
        live, state = live[state > 0], state[state > 0]
        for length in range(1, vocabulary.longest + 1):
            if length > 1:
                key = state * width + ids[live + (length - 1)]
                where = np.minimum(np.searchsorted(vocabulary.step, key), len(vocabulary.step) - 1)
                ok = vocabulary.step[where] == key
                live, state = live[ok], vocabulary.next[where[ok]]
            piece = vocabulary.ends[state]
            has = piece >= 0
            found.append((live[has], np.full(int(has.sum()), length), piece[has]))
            more = left[live] > length
            live, state = live[more], state[more]
            if not len(live):
                break
        begin, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        self.to = self.offset[at[begin] + length] + owner[begin]
        order = np.argsort(self.to * (vocabulary.longest + 1) + length)  # all keys differ
        begin = begin[order]
        self.to, self.piece = self.to[order], piece[order]
        self.source = self.offset[at[begin]] + owner[begin]
        self.spelled = self.letter[begin]
        self.weight = theta * vocabulary.weight[self.piece]

    def _masses(self, longest: int) -> None:
        """Forward filtering: log mass of every node, and what each edge has of its end's mass."""
        nodes = int(self.offset[-1])
        self.first = np.searchsorted(self.to, np.arange(nodes + 1))
        mass, value = np.zeros(nodes), np.zeros(len(self.to))
        for p in range(1, longest + 1):
            a, b = self.offset[p], self.offset[p + 1]
            x, y = self.first[a], self.first[b]
            value[x:y] = mass[self.source[x:y]] + self.weight[x:y]
            heads = self.first[a:b] - x
            top = np.maximum.reduceat(value[x:y], heads)
            mass[a:b] = top + np.log(np.add.reduceat(np.exp(value[x:y] - np.repeat(top, np.diff(np.append(heads, y - x)))), heads))
        self.share = value - mass[self.to]
        self.part = np.exp(self.share)
        only = self.first[self.to + 1] - self.first[self.to] == 1
        self.rest = np.where(only, -np.inf, np.log(np.maximum(1 - self.part, 1e-17)))
        # The likeliest edge into each node is tried first when drawing.
        self.best = np.zeros(nodes, np.int64)
        if len(self.to):
            heads = self.first[self.count : -1]
            top = self.part == np.repeat(np.maximum.reduceat(self.part, heads), np.diff(self.first[self.count :]))
            at = np.flatnonzero(top)
            self.best[self.to[at[::-1]]] = at[::-1]

    def ends_of(self, chunk: np.ndarray) -> np.ndarray:
        """The last node of each chunk."""
        return self.offset[self.size[chunk]] + chunk

    def draw(self, node: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        """An incoming edge of each node, by its share."""
        edge = self.best[node]
        left = uniform - self.part[edge]
        open_ = np.flatnonzero(left >= 0)
        if len(open_):
            # The others in order, each taking its share of what is left.
            best, left, at, end = edge[open_], left[open_], self.first[node[open_]], self.first[node[open_] + 1]
            while len(open_):
                left = left - np.where(at == best, 0.0, self.part[at])
                done = (left < 0) & (at != best)
                edge[open_[done]] = at[done]
                at = at + 1
                go = ~done & (at < end)
                open_, best, left, at, end = open_[go], best[go], left[go], at[go], end[go]
        return edge


def uniforms(key: np.ndarray, a: int, b: np.ndarray | int, c: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the arguments only."""
    x = key + np.uint64(a * 0x9E3779B97F4A7C15 % 2**64)
    x = x + np.asarray(b).astype(np.uint64) * np.array([0xD1B54A32D192ED03], np.uint64)
    x = mix(mix(x) + np.asarray(c).astype(np.uint64) * np.array([0x8CB92BA72F3D8DD7], np.uint64))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def walk(lattice: Lattice, node: np.ndarray, key: np.ndarray, round_: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draw each path from a node back to its chunk's start: all edges, path after path, and their numbers."""
    active, steps, step = np.arange(len(node)), [], 0
    at = node.copy()
    active = active[at >= lattice.count]
    while len(active):
        edge = lattice.draw(at[active], uniforms(key[active], round_, place[active], step))
        steps.append((active, edge))
        at[active] = lattice.source[edge]
        active = active[at[active] >= lattice.count]
        step += 1
    counts = np.zeros(len(node), np.int64)
    for who, _ in steps:
        counts[who] += 1
    base = np.cumsum(counts) - counts
    edges = np.zeros(int(counts.sum()), np.int64)
    for step, (who, edge) in enumerate(steps):
        edges[base[who] + step] = edge
    return edges, counts
