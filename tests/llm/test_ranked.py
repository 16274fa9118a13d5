"""Ranked search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdwatch.llm import ranked
from tests.llm.data import CLASHING, frame, plain, prose, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def expected(docs: list[tuple], texts: list, k: int = 20) -> list[list[tuple]]:
    counts = [Counter(words(t)) for _, t in docs]
    n, total = sum(map(bool, counts)), sum(c.total() for c in counts)
    holders = Counter(t for c in counts for t in c)
    out = []
    for text in texts:
        scored = []
        for (doc_id, _), c in zip(docs, counts, strict=True):
            m = 75 + (25 * c.total() * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holders[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0))
        out.append([(i + 1, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(scored)[:k])])
    return out


def found(spark, docs, texts: list, **more) -> list[list[tuple]]:
    items = spark.createDataFrame([(i, t, *CLASHING) for i, t in enumerate(texts)], "item_id int, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    out: list[list] = [[] for _ in texts]
    for r in ranked.rank(docs, items, **more).select("_row.item_id", "rank", "doc_id", "score").orderBy("item_id", "rank").collect():
        out[r[0]].append(tuple(r[1:]))
    return out


TEXTS = ["the and ing the", "unging schver", None, "", "!!", "no such termsanywhere", "word two words MORE words", prose(random.Random(4), "en", 60), "ééé é\u0000que eau THE 1"]


def test_ranks_equal_scoring_all(spark):
    """Null and repeated ids, ties of copies, empty items, clashing columns, a block of items at a time."""
    data = rows(120) + [(5000 + i, "the very same and the", "en", "s", None) for i in range(60)]
    want = expected([r[:2] for r in data], TEXTS)
    assert any(len(w) == 20 for w in want)
    assert found(spark, frame(spark, data), TEXTS) == want
    assert found(spark, frame(spark, data), TEXTS, block=5) == want


def test_nothing_to_rank(spark):
    docs = plain(spark, ["some text"])
    assert found(spark, docs.limit(0), ["some text"]) == [[]]
    assert found(spark, docs, [None, "!"]) == [[], []]
    assert ranked.rank(docs, docs.limit(0).select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert found(spark, plain(spark, [None, "", "..."]), ["some text"]) == [[]]


@pytest.mark.parametrize("seed", range(4))
def test_best_first_over_many_segments(seed):
    """Any cut into segments, any k and step, ids in no order: the same documents, and not all of them scored."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(rng.randint(-500, 500), " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40)))) for _ in range(900)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 9))) for _ in range(25)]
    hashed = {w: i + 1 for i, w in enumerate(vocabulary)}
    counts = [Counter(words(t)) for _, t in docs]
    n, total = sum(map(bool, counts)), sum(c.total() for c in counts)
    wanted = np.arange(1, 61, dtype=np.uint64)
    holders = Counter(t for c in counts for t in c)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * holders[v] + 1))) for v in vocabulary])
    bags = [Counter(words(t)) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    items = ranked.Items(starts, np.array([hashed[t] - 1 for b in bags for t in b]), np.array([c for b in bags for c in b.values()]))
    k = rng.choice([1, 3, 20])
    best, scored, at = [ranked.Best(k) for _ in texts], 0, 0
    while at < len(docs):
        part = docs[at : at + rng.randint(1, 400)]
        sizes = np.array([len(words(t)) for _, t in part])
        terms = np.array([hashed[w] for _, t in part for w in words(t)], np.uint64)
        row = ranked._segment(str(at), np.array([i for i, _ in part]), sizes, terms, np.repeat(np.arange(len(part)), sizes))
        lists = ranked.Lists(dict(zip(["segment", "doc_ids", "sizes", "terms", "ends", "docs", "counts"], row, strict=False)), wanted, weight, n, total)
        scored += ranked.best_first(lists, items, best, str(at), step=rng.choice([1, 8]))
        at += len(part)
    got = [sorted(((-s, -d) for s, d, _ in b.heap)) for b in best]
    assert got == [[(-s, d) for _, d, s in w] for w in expected(docs, texts, k)]
    assert scored < 0.8 * len(docs) * len(texts)
