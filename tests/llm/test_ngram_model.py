"""Elias-Fano sequences and tries against plain arrays, scores against a model in dictionaries."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdwatch.llm import ngram_model
from herdwatch.llm.ngram_trie import Sequence, Trie, coded
from tests.llm.data import frame, plain, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize(("n", "most"), [(0, 1), (1, 0), (1, 5), (70, 3), (1000, 10), (1000, 10**6), (30_000, 1 << 44), (64, 1 << 60)])
def test_sequences(n, most):
    r = np.random.default_rng(n + most % 97)
    values = np.sort(r.integers(0, most + 1, n)).astype(np.uint64)
    data = Sequence.pack(values)
    packed = Sequence(np.frombuffer(data, np.uint64))
    assert (packed[np.arange(n)] == values).all()
    wanted = np.concatenate([r.integers(0, most + 3, 3000).astype(np.uint64), values, values + np.uint64(1)])
    assert (packed.successor(wanted) == np.searchsorted(values, wanted)).all()
    if n == 30_000:
        assert len(data) * 8 / n < math.log2(most / n) + 4


def test_trie_finds_what_it_holds(tmp_path):
    rng = random.Random(3)
    grams = sorted({(rng.randint(0, 40), rng.choice([0, 1, 5, 4_000_000_000, rng.randint(0, 300)]), rng.randint(0, 90)) for _ in range(5000)})
    pairs = sorted({g[:2] for g in grams})
    first = sorted({g[0] for g in grams})
    starts = np.searchsorted([p[0] for p in pairs], [*first, 10**9])
    below = np.array([next(i for i, g in enumerate(grams) if g[:2] == p) for p in pairs] + [len(grams)])
    codes = [np.arange(n) % 251 + 1 for n in (len(first), len(pairs), len(pairs), len(grams))]
    data = Trie.pack(*(np.array(x, np.uint64) for x in (first,)), starts, np.array([p[1] for p in pairs], np.uint64), below, np.array([g[2] for g in grams], np.uint64), codes)
    (tmp_path / "trie").write_bytes(data)
    for trie in (Trie(data), Trie.map(str(tmp_path / "trie"))):
        asked = [*grams, *((rng.randint(0, 60), rng.randint(0, 320), rng.randint(0, 100)) for _ in range(5000))]
        a, b, c = (np.array(x, np.uint64) for x in zip(*asked, strict=True))
        root = trie.roots(a)
        second = trie.seconds(root, b)
        third = trie.thirds(second, c)
        place = {g: i for i, g in enumerate(grams)}
        assert third.tolist() == [place.get(g, -1) for g in asked]
        assert second.tolist() == [pairs.index(g[:2]) if g[:2] in set(pairs) else -1 for g in asked]
        assert coded(trie.third_code, third)[: len(grams)].tolist() == codes[3].tolist()
    assert Trie(b"").thirds(np.array([-1]), np.array([4], np.uint64)).tolist() == [-1]


def tokens(text: str | None) -> list:
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + [None]


class Plain:
    """The model as its definition has it; ``q`` rounds a probability as the tries do."""

    def __init__(self, texts: list[list], q=lambda p: p):
        self.q, self.d = q, ngram_model.DISCOUNTS
        self.c1 = Counter(t for text in texts for t in text)
        self.n, self.v = self.c1.total(), len(self.c1)
        self.c2, self.c3 = defaultdict(Counter), defaultdict(Counter)
        for text in texts:
            s = ["<1>", "<2>", *text]
            for a, b, c in zip(s, s[1:], s[2:], strict=False):
                self.c2[b][c] += 1
                self.c3[a, b][c] += 1

    def p(self, a, b, c) -> float:
        q, (d1, d2, d3) = self.q, self.d
        out = (d1 * self.v / self.n if self.n else 1.0) / (self.v + 1) + ((self.c1[c] - d1) / self.n if self.c1[c] else 0.0)
        for known, d in ((self.c2.get(b), d2), (self.c3.get((a, b)), d3)):
            if known:
                out = (q((known[c] - d) / known.total()) if known[c] else 0.0) + q(d * len(known) / known.total()) * out
        return out

    def row(self, doc_id, text: list) -> tuple:
        s = ["<1>", "<2>", *text]
        base = sum(math.log10((self.c1[t] + 0.5) / (self.n + 0.5 * (self.v + 1))) for t in text)
        score = sum(math.log10(self.p(*w)) for w in zip(s, s[1:], s[2:], strict=False))
        return doc_id, len(text), sum(self.c1[t] > 0 for t in text), self.n, round(base, 6), round(score, 6)


def quantised(p: float) -> float:
    return 10 ** (-min(254, max(0, round(float(-np.log10(p)) * 20))) / 20)


def learned(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 != 1


def found(docs, **more) -> Counter:
    scored = ngram_model.score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, **more)
    columns = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return Counter((*r[:4], round(r[4], 6), round(r[5], 6)) for r in scored.select(*columns).collect())


@pytest.mark.parametrize("more", [{}, {"shard": 300, "frequent": 20}, {"shard": 2000, "frequent": 3}], ids=["one shard", "many shards", "nearly all words frequent"])
def test_scores_equal_a_plain_model(spark, more):
    """Null and repeated ids, empty and long texts, clashing columns, frequent words and pairs split."""
    data = rows(60) + [(3000 + i, "the of the and the of a the", "en", "s", None) for i in range(30)] + [(4000, "never seen before", "en", "s", None)]
    texts = [(r[0], tokens(r[1])) for r in data]
    model = Plain([t for d, t in texts if learned(d)], quantised)
    assert found(frame(spark, data), **more) == Counter(model.row(d, t) for d, t in texts)


def test_plain_model_is_a_distribution():
    model = Plain([tokens(r[1]) for r in rows(30)])
    for a, b in random.Random(1).sample(sorted(model.c3, key=str), 20) + [("never", "seen")]:
        assert abs(sum(model.p(a, b, c) for c in [*model.c1, "unknown word"]) - 1) < 1e-9


def test_nothing_to_score_or_to_learn(spark):
    docs = plain(spark, ["some text", None, ""])
    assert found(docs.limit(0)) == Counter()
    scored = ngram_model.score_documents(docs, F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scored) == [(0, 3, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)]


def test_learned_texts_are_likelier_than_by_single_words(spark):
    data = [r for r in rows(60) if r[0] is not None and r[0] < 60]
    scored = ngram_model.score_documents(frame(spark, data), F.crc32(F.col("doc_id").cast("string")) % 5 != 1).collect()
    assert sum(r.score for r in scored if learned(r.doc_id)) > sum(r.base_score for r in scored if learned(r.doc_id))
