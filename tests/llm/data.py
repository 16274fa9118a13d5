"""Small documents with awkward rows, for all operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use inside.
CLASHING = ("n", "c", "key", "label", "_id", "row", "segment", "bands", "token", "samples", "_rid", "_base", "_draw", "instance", "w", "_block", "kept")

SYLLABLES = {"en": "the and ing ed on er th at re".split(), "de": "ung ich sch ein ver keit zu".split(), "fr": "eau oi é è que tion la".split()}


def prose(rng: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    """Prose in three languages with copies, and rows that are null, empty, odd, repeated and long."""
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, prose(rng, lang, rng.randint(20, 120)), lang))
    out += [(n + i, out[i][1] + " more words", out[i][2]) for i in range(10)]
    out += [(n + 10 + i, out[3][1], out[3][2]) for i in range(5)]
    odd = [None, "", "   \n\t ", "word", "two words", "...!!!", "\u0001\u0002\x00 ok", "é😀 " * 50, "Orre " * 3000, "x" * 30000, "1 " * 4000]
    out += [(n + 20 + i, t, None) for i, t in enumerate(odd)]
    out += [(None, "a text without an id at all", "en"), (None, None, None), (5, out[5][1], out[5][2]), (5, "another text of the same id", "en")]
    return [(d, t, g, f"src{i % 3}", len(t) if t else None) for i, (d, t, g) in enumerate(out)]


def frame(spark, data=None):
    """The documents with clashing extra columns."""
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    return df.selectExpr("*", *(f"'{c}' as `{c}`" for c in CLASHING))


def plain(spark, texts: list, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in zip(ids, texts, strict=True)], SCHEMA)
