"""Language-model scores from a trigram model kept as Elias-Fano tries, one per shard of the n-grams.

The model interpolates three orders with absolute discounting:

    P(c | a b) = max(n(a b c) - D3, 0) / n(a b) + l(a b) P(c | b),   l(a b) = D3 * kinds(a b) / n(a b)

and likewise with one order less, down to single words and an even share for each known word and one
unknown one; a context that was never seen has l = 1.  Every text begins with two marks of its own and
ends with an end token, which is predicted like a word.  What the tries hold are the smoothed
probabilities and the weights l of the upper two orders, quantised to a byte in steps of a twentieth
of a decade; counts of single words stay exact.

How it runs:
- Documents become segments, written once: the distinct words as 64-bit hashes, the texts as numbers
  of these.
- Each segment asks the shards of words for the numbers and counts of its words.
- Each segment sends its distinct trigrams, with their counts in the texts to learn from, to the shards
  of n-grams: packed, a row for a segment and shard.  A shard adds up, builds its trie, looks all asked
  trigrams up in it and answers in the same order.
- The segment puts the answers together to scores of documents.
All n-grams of a first word go to one shard, unless the word makes up more than a quarter of a shard:
then they are dealt by second words, too, and those of equally frequent word pairs by third words.
How often such words and pairs are followed is counted before, and what their contexts have over all
shards is added up after; they are at most ``HOT``, as only those count as frequent that make up that
share of the corpus.  Everything else about the model grows with the corpus and stays in its shards.

Defined results: a null or empty text is its end token alone; texts of null ids are scored, but not
learned from, and their ``held_out`` is null; repeated rows count as often as they stand; an empty
table gives an empty result, and without texts to learn from every token has probability one, there
being one unknown word and nothing else.  Long texts are taken whole; a segment is at least one.
Extra columns are ignored.  Document ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.llm import store
from herdwatch.llm.ngram_trie import Trie, coded
from herdwatch.llm.words import SPACED, keys, mix, parts, words

#: Discounts of one, two and three words.
DISCOUNTS = (0.5, 0.75, 0.85)
#: Tokens of a segment; a longer document is a segment of its own.
SEGMENT = 700_000
#: Words, and trigrams, of a shard, if all were distinct.
SHARD = 1_000_000
#: The most words, and word pairs, that are treated as frequent.
HOT = 100_000
#: Marks before a text and behind it, what is unknown, and the first word's number.
BEGIN, SECOND, BEHIND, FIRST = 0, 1, 2, 3
UNKNOWN = 0xFFFFFFFF
END_HASH = keys(1, 7)[0]
STEP = 20
NO_ID = -(1 << 63)

SEGMENTS = "segment bigint, doc_ids binary, learn binary, sizes binary, words binary, counts binary, tokens binary, n_words bigint, n_tokens bigint, n_learned bigint, n_docs bigint"
ANSWERS = "segment bigint, shard int, ids binary, counts binary, n_known bigint"


def packed(values: np.ndarray, width: int = 4) -> bytes:
    """Numbers of at most ``width`` bytes, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes, width: int = 4) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.Codec("zstd").decompress(data[8:], decompressed_size=n * width, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel()


def code(p: np.ndarray) -> np.ndarray:
    """A probability above 0 as a byte from 1 on."""
    return np.clip(np.rint(-np.log10(p) * STEP) + 1, 1, 255).astype(np.uint8)


#: What a code stands for; 0 is nothing found: probability 0, and the whole weight to the lower order.
PROBABILITY = np.append(0.0, 10.0 ** (-np.arange(255) / STEP))
WEIGHT = np.append(1.0, 10.0 ** (-np.arange(255) / STEP))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, number, held = TaskContext.get().partitionId(), 0, []

    def flush() -> pa.RecordBatch:
        ids, learn, sizes, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        known, local = np.unique(tokens, return_inverse=True)
        counts = np.bincount(local, np.repeat(learn, sizes), len(known)).astype(np.int64)
        row = [(task << 33) + number, ids.tobytes(), learn.astype(np.uint8).tobytes(), sizes.astype(np.int32).tobytes(), known.tobytes(), packed(counts), packed(local)]
        row += [len(known), len(tokens), int(counts.sum()), int(learn.sum())]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=[c.split()[0] for c in SEGMENTS.split(", ")])

    for batch in batches:
        for part in parts(batch, "text"):
            found, first, _, _ = words(part["text"], SPACED)
            sizes = np.diff(first) + 1
            tokens = np.full(len(found) + len(sizes), END_HASH, np.uint64)
            tokens[np.arange(len(found)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = found
            if held and sum(len(h[3]) for h in held) + len(tokens) > SEGMENT:
                yield flush()
                number += 1
            ids = np.array([NO_ID if i is None else i for i in part["doc_id"].to_pylist()], np.int64)
            held.append((ids, np.array(part["learn"].to_pylist(), np.int64), sizes, tokens))
    if held:
        yield flush()


def _ask_words(shards: int) -> Callable:
    """A segment's words, dealt to the shards of words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                known, counts = np.frombuffer(batch["words"][row].as_py(), np.uint64), unpacked(batch["counts"][row].as_py())
                for shard, at in _dealt((known % np.uint64(shards)).astype(np.int64)):
                    yield pa.RecordBatch.from_pylist([{"shard": shard, "segment": batch["segment"][row].as_py(), "words": known[at].tobytes(), "counts": packed(counts[at])}], WORDS)

    return ask


WORDS = pa.schema([("shard", pa.int32()), ("segment", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
GRAMS = pa.schema([("shard", pa.int32()), ("segment", pa.int64()), ("grams", pa.binary())])


def _dealt(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of every shard that occurs; places stay in order."""
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(shard[order[a]]), order[a:b]


def _answer_words(shards: int, frequent: int) -> Callable:
    """Number and count of every word asked for; and a row (segment -1) with the shard's frequent words."""

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        asked = [np.frombuffer(x.as_py(), np.uint64) for x in table["words"]]
        counts = np.concatenate([unpacked(x.as_py()) for x in table["counts"]]).astype(np.float64)
        known, which = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(which, counts, len(known)).astype(np.int64)
        order = np.argsort(-total, kind="stable")
        number = np.empty(len(known), np.int64)
        number[order] = FIRST + np.arange(len(known)) * shards + shard
        number[total == 0] = UNKNOWN
        hot = np.flatnonzero(total > frequent)
        out = [(-1, shard, packed(number[hot]) + known[hot].tobytes(), packed(total[hot], 8), int((total > 0).sum()))]
        ends = np.cumsum([len(a) for a in asked])
        for segment, a, b in zip(table["segment"].to_pylist(), [0, *ends[:-1]], ends, strict=True):
            out.append((segment, shard, packed(number[which[a:b]]), packed(total[which[a:b]], 8), 0))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.Table.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["segment", "shard", "ids", "counts", "n_known"])

    return answer


class Frequent:
    """Frequent words and word pairs, with how often each is followed: arrays that are sent to all tasks."""

    def __init__(self, words: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, size: int):
        self.words, self.word_counts, self.pairs, self.pair_counts, self.size = words, word_counts, pairs, pair_counts, size

    @staticmethod
    def _at(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[at] == wanted, at, -1)

    def word(self, wanted: np.ndarray) -> np.ndarray:
        return self._at(self.words, wanted)

    def pair(self, wanted: np.ndarray) -> np.ndarray:
        return self._at(self.pairs, wanted)

    def shard(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, shards: int) -> np.ndarray:
        """Where each trigram belongs: by its first word, or as many pieces as a frequent one needs."""
        key = mix(a)
        word, pair = self.word(a), self.pair(a << np.uint64(32) | b)
        for at, counts, other in ((word, self.word_counts, b), (pair, self.pair_counts, c)):
            hot = np.flatnonzero(at >= 0)
            pieces = (counts[at[hot]] // self.size + 1).astype(np.uint64)
            key[hot] = mix(key[hot] + np.uint64(1) + mix(other[hot]) % pieces)
        return (key % np.uint64(shards)).astype(np.int64)


def _numbers(row: dict, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and count of each of a segment's words, from the answers."""
    known = np.frombuffer(row["words"], np.uint64)
    order = np.argsort((known % np.uint64(shards)).astype(np.int64), kind="stable")
    answers = sorted(row["answers"], key=lambda r: r["shard"])
    numbers, counts = np.empty(len(known), np.uint64), np.empty(len(known), np.int64)
    numbers[order] = np.concatenate([unpacked(a["ids"]) for a in answers])
    counts[order] = np.concatenate([unpacked(a["counts"], 8) for a in answers]).astype(np.int64)
    return numbers, counts


def _windows(numbers: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams (a, b, c) of a segment that a shard can know something about, and for every
    window its place among them, or -1.  A document of n tokens has n + 1 windows."""
    # Local numbers: marks, then the segment's words; unknown words are one.
    table = np.concatenate([np.array([BEGIN, SECOND, BEHIND, UNKNOWN], np.uint64), numbers])
    local = np.where(numbers == UNKNOWN, 3, np.arange(len(numbers)) + 4)[tokens]
    row = np.repeat(np.arange(len(sizes)), sizes)
    text = np.full(len(tokens) + 3 * len(sizes), BEHIND, np.int64)
    text[np.arange(len(tokens)) + 3 * row + 2] = local
    begin = np.cumsum(sizes + 3) - sizes - 3
    text[begin], text[begin + 1] = BEGIN, SECOND
    window = np.ones(len(text), bool)
    window[begin + sizes + 1] = window[begin + sizes + 2] = False
    at = np.flatnonzero(window)
    a, b, c = text[at], text[at + 1], text[at + 2]
    c = np.where(b == 3, 3, c)
    bits = max(1, int(len(table) - 1).bit_length())
    if 3 * bits > 63:
        raise ValueError("a segment has too many distinct words")
    key = (a << 2 * bits) | (b << bits) | c
    key[a == 3] = -1
    distinct, place = np.unique(key, return_inverse=True)
    if len(distinct) and distinct[0] < 0:
        distinct, place = distinct[1:], place - 1
    mask = (1 << bits) - 1
    return table[distinct >> 2 * bits], table[(distinct >> bits) & mask], table[distinct & mask], place


def _ask_grams(word_shards: int, shards: int, sent) -> Callable:
    """A segment's distinct trigrams with their counts in texts to learn from, dealt to the shards of n-grams."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(*sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                numbers, _ = _numbers(row, word_shards)
                sizes, learn = np.frombuffer(row["sizes"], np.int32).astype(np.int64), np.frombuffer(row["learn"], np.uint8)
                a, b, c, place = _windows(numbers, unpacked(row["tokens"]).astype(np.int64), sizes)
                learned = np.repeat(learn, sizes + 1).astype(np.float64)
                counts = np.bincount(place[place >= 0], learned[place >= 0], len(a))
                for shard, at in _dealt(frequent.shard(a, b, c, shards)):
                    grams = packed(np.concatenate([a[at], b[at], c[at], counts[at].astype(np.uint64)]))
                    yield pa.RecordBatch.from_pylist([{"shard": shard, "segment": row["segment"], "grams": grams}], GRAMS)

    return ask


def _trie(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, frequent: Frequent, discounts: tuple) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The trie of the given distinct trigrams, in order, and how many kinds of followers frequent words
    and pairs have among them."""
    pair = (a << np.uint64(32)) | b
    at = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
    below = np.append(at, len(pair))
    kinds, total, pair = np.diff(below), np.add.reduceat(n, at).astype(np.float64), pair[at]
    hot_pair = frequent.pair(pair)
    total = np.where(hot_pair >= 0, frequent.pair_counts[hot_pair] if len(frequent.pairs) else 0, total)
    word = pair >> np.uint64(32)
    begin = np.flatnonzero(np.diff(word, prepend=~word[:1]))
    starts = np.append(begin, len(word))
    word = word[begin]
    hot_word = frequent.word(word)
    followed = np.where(hot_word >= 0, frequent.word_counts[hot_word] if len(frequent.words) else 0, np.add.reduceat(total, begin))
    pair_kinds = np.bincount(frequent.pair(pair)[hot_pair >= 0], kinds[hot_pair >= 0], len(frequent.pairs))
    # A frequent pair is in several shards: it is counted with the pairs themselves.
    seconds = np.add.reduceat(hot_pair < 0, begin)
    word_kinds = np.bincount(hot_word[hot_word >= 0], seconds[hot_word >= 0], len(frequent.words))
    _, two, three = discounts
    with np.errstate(divide="ignore"):
        codes = [
            np.where(hot_word >= 0, 0, code(two * np.diff(starts) / followed)),
            code((total - two) / np.repeat(followed, np.diff(starts))),
            np.where(hot_pair >= 0, 0, code(three * kinds / total)),
            code((n - three) / np.repeat(total, kinds)),
        ]
    second = pair & np.uint64(0xFFFFFFFF)
    return Trie.pack(word, starts, second, below, c, codes), word_kinds, pair_kinds


def _answer_grams(discounts: tuple, sent) -> Callable:
    """Per segment, for each trigram asked for, in order: the codes of P(c | a b), P(b | a), l(a b), l(a).

    A row (segment -1) has what the shard's share of frequent words and pairs is followed by.
    """

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        frequent = Frequent(*sent.value)
        asked = [unpacked(x.as_py()).reshape(4, -1).astype(np.uint64) for x in table["grams"]]
        a, b, c, n = np.concatenate(asked, axis=1)
        pairs, which = np.unique((a << np.uint64(32)) | b, return_inverse=True)
        grams, place = np.unique((which.astype(np.uint64) << np.uint64(32)) | c, return_inverse=True)
        total = np.bincount(place, n.astype(np.float64), len(grams)).astype(np.int64)
        context, c = (grams >> np.uint64(32)).astype(np.int64), grams & np.uint64(0xFFFFFFFF)
        a, b = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        seen = total > 0
        data, word_kinds, pair_kinds = b"", np.zeros(len(frequent.words)), np.zeros(len(frequent.pairs))
        if seen.any():
            data, word_kinds, pair_kinds = _trie(a[context[seen]], b[context[seen]], c[seen], total[seen], frequent, discounts)
        trie = Trie(data)
        first = np.flatnonzero(np.diff(a, prepend=~a[:1]))
        root = np.repeat(trie.roots(a[first]), np.diff(np.append(first, len(a))))
        second = trie.seconds(root, b)
        third = trie.thirds(second[context], c)
        if trie.empty:
            codes = np.zeros((4, len(grams)), np.uint8)
        else:
            above = coded(trie.second_codes[0], second), coded(trie.second_codes[1], second), coded(trie.first_code, root)
            codes = np.stack([coded(trie.third_code, third), *(x[context] for x in above)])
        out = [(-1, packed(np.concatenate([word_kinds, pair_kinds]).astype(np.uint64)))] if len(frequent.words) else []
        ends = np.cumsum([x.shape[1] for x in asked])
        for segment, x, y in zip(table["segment"].to_pylist(), [0, *ends[:-1]], ends, strict=True):
            out.append((segment, packed(codes[:, place[x:y]].ravel(), 1)))
        return pa.Table.from_arrays(
            [pa.array([r[0] for r in out], pa.int64()), pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array([r[1] for r in out], pa.binary())], names=["segment", "shard", "codes"]
        )

    return answer


def _score(word_shards: int, shards: int, n: int, kinds: int, discounts: tuple, sent) -> Callable:
    """Per document: tokens, known tokens, the sums of the base model and of this one."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *known, word_code, pair_weight, pair_code = sent.value
        frequent = Frequent(*known)
        for batch in batches:
            for row in batch.to_pylist():
                numbers, counts = _numbers(row, word_shards)
                sizes, tokens = np.frombuffer(row["sizes"], np.int32).astype(np.int64), unpacked(row["tokens"]).astype(np.int64)
                a, b, c, place = _windows(numbers, tokens, sizes)
                codes = np.zeros((4, len(a) + 1), np.uint8)
                answers = {r["shard"]: r["codes"] for r in row["codes"] or ()}
                for shard, at in _dealt(frequent.shard(a, b, c, shards)):
                    codes[:, at] = unpacked(answers[shard], 1).reshape(4, -1)
                # What is known of frequent words and pairs over all shards.
                word, pair = frequent.word(a), frequent.pair((a << np.uint64(32)) | b)
                hot = np.flatnonzero(pair >= 0)
                codes[1, hot], codes[2, hot] = pair_code[pair[hot]], pair_weight[pair[hot]]
                hot = np.flatnonzero(word >= 0)
                codes[3, hot] = word_code[word[hot]]
                codes = codes[:, place]
                # Windows that predict a token, and behind each the one whose pair ends with that token.
                at = np.arange(len(tokens)) + np.repeat(np.arange(len(sizes)), sizes)
                c1 = counts[tokens]
                spread = discounts[0] * kinds / n if n else 1.0
                single = (np.where(c1 > 0, (c1 - discounts[0]) / n, 0.0) if n else 0.0) + spread / (kinds + 1)
                double = PROBABILITY[codes[1, at + 1]] + WEIGHT[codes[3, at + 1]] * single
                triple = PROBABILITY[codes[0, at]] + WEIGHT[codes[2, at]] * double
                first = np.cumsum(sizes) - sizes
                base = np.log10((c1 + 0.5) / (n + 0.5 * (kinds + 1)))
                ids = np.frombuffer(row["doc_ids"], np.int64)
                sums = [np.add.reduceat(x, first) for x in ((c1 > 0).astype(np.int64), base, np.log10(triple))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(sizes), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return score


def _frequent_pairs(segments: DataFrame, hashes: np.ndarray, numbers: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of frequent words that stand together more than ``least`` times in texts to learn from.

    ``hashes`` are the frequent words', ascending.  Only pairs of two frequent words can be frequent,
    so that no more than these are counted.
    """
    sent = segments.sparkSession.sparkContext.broadcast((hashes, numbers))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, numbers = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                known, sizes = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                at = np.minimum(np.searchsorted(hashes, known), len(hashes) - 1)
                number = np.where(hashes[at] == known, numbers[at], UNKNOWN).astype(np.uint64)[unpacked(row["tokens"]).astype(np.int64)]
                learn = np.repeat(np.frombuffer(row["learn"], np.uint8), sizes) > 0
                first = np.cumsum(sizes) - sizes
                before = np.append(np.uint64(SECOND), number[:-1])
                before[first] = SECOND
                both = learn & (number != UNKNOWN) & (before != UNKNOWN)
                pairs, n = np.unique((before[both] << np.uint64(32)) | number[both], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    counted = segments.select("sizes", "learn", "words", "tokens").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = sorted((r.pair, r.n) for r in counted.filter(F.col("n") > least).collect())
    sent.destroy()
    return np.array([p for p, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)


def score_documents(
    docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", discounts: tuple = DISCOUNTS, shard: int = SHARD, frequent: int | None = None
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document, learning from those that
    ``learn`` holds for.  ``frequent``: from how many occurrences on a word's n-grams may be split."""
    spark = docs.sparkSession
    context = spark.sparkContext
    store.bounded_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"), F.coalesce(learn, F.lit(False)).cast("int").alias("learn"))
    segments = store.bucketed(plain.mapInArrow(_segments, SEGMENTS), "segment", buckets, "segments")
    n_words, n_tokens, n, n_docs = segments.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_tokens", "n_learned", "n_docs"))).first()
    word_shards, shards = -(-n_words // shard) or 1, -(-n_tokens // shard) or 1
    least = max(shard // 4 if frequent is None else frequent, n // HOT)

    asked = segments.select("segment", "words", "counts").mapInArrow(_ask_words(word_shards), "shard int, segment bigint, words binary, counts binary")
    answers = store.keep(asked.groupBy("shard").applyInArrow(_answer_words(word_shards, least), ANSWERS), "words")
    totals = answers.filter("segment = -1")
    kinds = totals.agg(F.coalesce(F.sum("n_known"), F.lit(0))).first()[0]
    hot = [(r.ids, r.counts) for r in totals.filter("length(counts) > 8").select("ids", "counts").collect()]
    numbers, hashes, followed = [BEGIN, SECOND] * (n_docs > least), [], [n_docs] * 2 * (n_docs > least)
    for ids, counts in hot:
        counts = unpacked(counts, 8)
        hashes += np.frombuffer(ids[len(ids) - 8 * len(counts) :], np.uint64).tolist()
        numbers += unpacked(ids[: len(ids) - 8 * len(counts)]).tolist()
        followed += counts.tolist()
    order = np.argsort(np.array(numbers, np.uint64))
    hot_words, hot_counts = np.array(numbers, np.uint64)[order], np.array(followed, np.int64)[order]
    marks = len(numbers) - len(hashes)
    hot_pairs, pair_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if hashes:
        by_hash = np.argsort(np.array(hashes, np.uint64))
        hot_pairs, pair_counts = _frequent_pairs(segments, np.array(hashes, np.uint64)[by_hash], np.array(numbers[marks:], np.uint64)[by_hash], least)
    if marks:
        # Every text begins with the two marks.
        hot_pairs, pair_counts = np.append(np.uint64(SECOND), hot_pairs), np.append(n_docs, pair_counts)
    known = (hot_words, hot_counts, hot_pairs, pair_counts, max(1, least))
    sent = context.broadcast(known)

    per_segment = answers.filter("segment >= 0").groupBy("segment").agg(F.collect_list(F.struct("shard", "ids", "counts")).alias("answers"))
    joined = segments.select("segment", "doc_ids", "learn", "sizes", "words", "tokens").join(per_segment, "segment")
    grams = joined.drop("doc_ids").mapInArrow(_ask_grams(word_shards, shards, sent), "shard int, segment bigint, grams binary")
    codes = store.keep(grams.groupBy("shard").applyInArrow(_answer_grams(discounts, sent), "segment bigint, shard int, codes binary"), "codes")

    word_kinds, pair_kinds = np.zeros(len(hot_words)), np.zeros(len(hot_pairs))
    if len(hot_words):
        rows = codes.filter("segment = -1").select("codes").mapInArrow(_kinds, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
        every = np.zeros(len(hot_words) + len(hot_pairs))
        for r in rows:
            every[r.at] = r.n
        word_kinds, pair_kinds = every[: len(hot_words)], every[len(hot_words) :]
        # Frequent pairs count for their first words, too.
        first = np.searchsorted(hot_words, hot_pairs >> np.uint64(32))
        word_kinds += np.bincount(first, minlength=len(hot_words))
    _, two, three = discounts
    with np.errstate(divide="ignore"):
        word_code = code(two * word_kinds / hot_counts)
        pair_weight = code(three * pair_kinds / pair_counts)
        above = hot_counts[np.searchsorted(hot_words, hot_pairs >> np.uint64(32))] if len(hot_pairs) else pair_counts
        pair_code = code((pair_counts - two) / above)
    sent_all = context.broadcast((*known, word_code, pair_weight, pair_code))

    replies = codes.filter("segment >= 0").groupBy("segment").agg(F.collect_list(F.struct("shard", "codes")).alias("codes"))
    out = joined.drop("learn").join(replies, "segment", "left").mapInArrow(
        _score(word_shards, shards, n, kinds, discounts, sent_all), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return out.withColumn("train_tokens", F.lit(n).cast("bigint"))


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kinds of followers that one task's shards have, added up."""
    total = None
    for batch in batches:
        for row in range(batch.num_rows):
            one = unpacked(batch["codes"][row].as_py()).astype(np.int64)
            total = one if total is None else total + one
    if total is not None:
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["at", "n"])


def op12_ngram_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    scored = score_documents(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
