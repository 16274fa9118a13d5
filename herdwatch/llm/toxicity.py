"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learned: words of any length that stand in toxic documents so much more often than in
others that chance would not bring one such word into it.  Its trie is intersected with the Levenshtein
automata of its terms and made deterministic, so that one table look-up per byte decides whether a
word is a term, or one with a bounded number of edits; a large lexicon is several such tables.  All
words of all texts are run through them side by side.

A find counts by its context window: between an opening and a closing quotation mark that stand near
it, it is a quotation, next to words of address it is abuse.  The logarithms of the counts per document,
and of its length, are the features of a logistic regression.  Words a few edits from a term that stand in one half of the good sample are
harmless ones; the other half shows what is still found by chance.  Everything is learned from at
most ``sample`` labelled rows of each kind whose crc32 of the id, modulo 4, is not 2; scores use the
text only.

Defined results: null and empty texts have no finds and the score that belongs to none; without
labelled rows of both kinds every score is 0; edits are counted in UTF-8 bytes; long texts are taken
whole; null and repeated ids are rows of their own, and ``held_out`` is null for a null id; ties between
terms do not matter, as all that pass are taken; an empty table gives an empty result; extra columns
are passed through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.llm import store
from herdwatch.llm.store import Sendable
from herdwatch.llm.words import ALNUM, hashes, mix, parts, rows_of, spans, text_bytes

#: Labelled rows of each kind that are learned from.
SAMPLE = 10_000
#: Words below so many toxic documents can't be told from chance; a term is so much likelier in toxic ones.
LEAST_SEEN, LEAST_RATIO = 5, 20.0
#: Terms of one automaton.
GROUP = 40
#: Words on either side that make up a find's context; bytes on either side that have its quotation marks.
WINDOW, QUOTE = 4, 300
THRESHOLD = 0.3

# Words of address in the languages at hand.
ADDRESS = ("you", "your", "you're", "u", "du", "dein", "ihr", "tu", "toi", "vous", "usted", "tú")


def edits_allowed(term: bytes) -> int:
    """Short terms must be exact: too many other words are one edit away."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class Automaton(Sendable):
    """The deterministic product of a lexicon's trie and its terms' Levenshtein automata."""

    def __init__(self, terms: list[str]):
        words = sorted({t.encode() for t in terms})
        self.letters = np.zeros(256, np.int64)
        for i, b in enumerate(sorted(set(b"".join(words))), 1):
            self.letters[b] = i
        width = int(self.letters.max(initial=0)) + 1
        children: list[dict[int, int]] = [{}]
        allowed, ends = [0], [False]
        for word in words:
            at = 0
            allowed[0] = max(allowed[0], edits_allowed(word))
            for b in word:
                if int(self.letters[b]) not in children[at]:
                    children[at][int(self.letters[b])] = len(children)
                    children.append({})
                    allowed.append(0)
                    ends.append(False)
                at = children[at][int(self.letters[b])]
                allowed[at] = max(allowed[at], edits_allowed(word))
            ends[at] = True
        limit = [0] * len(children)
        for word in words:
            at = 0
            for b in word:
                at = children[at][int(self.letters[b])]
            limit[at] = edits_allowed(word)

        def closed(state: dict[int, int]) -> frozenset:
            """Add what leaving out letters of the terms reaches; fewest edits per trie node."""
            todo = list(state)
            while todo:
                node = todo.pop()
                for child in children[node].values():
                    edits = state[node] + 1
                    if edits <= allowed[child] and edits < state.get(child, 99):
                        state[child] = edits
                        todo.append(child)
            return frozenset(state.items())

        start = closed({0: 0})
        number, todo, table, accept = {start: 0}, [start], [], []
        while todo:
            state = todo.pop(0)
            row = []
            for letter in range(width):
                after: dict[int, int] = {}
                for node, edits in state:
                    for target, cost in [(node, 1)] + [(c, 0 if k == letter else 1) for k, c in children[node].items()]:
                        if edits + cost <= allowed[target] and edits + cost < after.get(target, 99):
                            after[target] = edits + cost
                step = closed(after)
                if step not in number:
                    number[step] = len(number)
                    todo.append(step)
                row.append(number[step])
            table.append(row)
            accept.append(min((e for n, e in state if ends[n] and e <= limit[n]), default=-1))
        self.step, self.accept = np.array(table, np.int32), np.array(accept, np.int8)
        self.longest = max((len(w) for w in words), default=0) + 2

    def edits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Edits from each word to the nearest term that it may stand for, or -1."""
        found = np.full(len(starts), -1, np.int8)
        live = np.flatnonzero(ends - starts <= self.longest)
        state = np.zeros(len(live), np.int32)
        letters = self.letters[data]
        for place in range(self.longest + 1):
            over = ends[live] - starts[live] == place
            found[live[over]] = self.accept[state[over]]
            live, state = live[~over], state[~over]
            if not len(live):
                break
            state = self.step[state, letters[starts[live] + place]]
        return found


class Lexicon(Sendable):
    """All terms, in alphabetical groups with an automaton each."""

    def __init__(self, terms: list[str], group: int = GROUP):
        words = sorted(set(terms))
        self.automata = [Automaton(words[i : i + group]) for i in range(0, len(words), group)]

    def edits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Edits from each word to the nearest term that it may stand for, or -1."""
        found = np.full(len(starts), -1, np.int8)
        for automaton in self.automata:
            got = automaton.edits(data, starts, ends)
            found = np.where((got >= 0) & ((found < 0) | (got < found)), got, found)
        return found


_ADDRESS = np.sort(hashes(np.frombuffer(" ".join(ADDRESS).encode(), np.uint8), *spans(ALNUM[np.frombuffer(" ".join(ADDRESS).encode(), np.uint8)], np.array([0, len(" ".join(ADDRESS).encode())]))[:2]))
#: Features of a text.
N_FEATURES = 6
#: Weights before anything is learned, and how strongly they hold.  Labelled samples hardly have misspellings,
#: so a find with edits counts as a find, less a little unless good documents show more of them.
PRIOR, HOLD = (4.0, -0.5, -1.5, 0.0, 0.5, 0.0), 1.0


#: Bytes of letters and digits, and ASCII marks after which none opens.
ALNUM_BYTE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_CLOSERS = np.frombuffer(b")]}.,;:!?%", np.uint8)


def _separated(raw: np.ndarray) -> np.ndarray:
    """The bytes with separators as spaces, punctuation outside ASCII (U+2000 to U+206F, guillemets and
    inverted marks) among them."""
    data = ALNUM[raw]
    if len(raw) > 1:
        three = np.flatnonzero((raw[:-1] == 0xE2) & ((raw[1:] == 0x80) | (raw[1:] == 0x81)))
        two = np.flatnonzero((raw[:-1] == 0xC2) & np.isin(raw[1:], (0xA0, 0xA1, 0xAB, 0xBB, 0xBF)))
        for places, size in ((three, 3), (two, 2)):
            for shift in range(size):
                data[places + shift] = 32
    return data


def _quoted(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, reach: int = QUOTE) -> np.ndarray:
    """Whether the nearest mark before each place opens a quotation and the nearest one after it closes one,
    both in the same text and at most ``reach`` bytes away.

    Marks that may do both open after a space or a bracket and close before white space or punctuation; the
    sign of inches in ``3.5" disk`` thus opens nothing.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    previous, following = np.append(np.uint8(32), data[:-1]), np.append(data[1:], np.uint8(32))
    previous[edge[:-1]] = 32

    def sign(*code: int) -> np.ndarray:
        """The first bytes of a character."""
        here = np.ones(len(data), bool)
        for shift, byte in enumerate(code):
            here[max(0, len(data) - shift) :] = False
            here[: max(0, len(data) - shift)] &= data[shift:] == byte
        return np.flatnonzero(here)

    either = [(m, 1) for m in (sign(0x22),)] + [(sign(0xE2, 0x80, 0x9C), 3)]
    after_space, before_space = ~ALNUM_BYTE[previous] & ~np.isin(previous, _CLOSERS), ~ALNUM_BYTE
    opens, closes = [sign(0xE2, 0x80, 0x9E), sign(0xC2, 0xAB)], [sign(0xE2, 0x80, 0x9D), sign(0xC2, 0xBB)]
    for marks, size in either:
        last = marks + size - 1
        end = edge[last + 1] | before_space[following[last]]
        opening = after_space[marks] & ~(edge[last + 1] | (following[last] == 32))
        opens.append(marks[opening])
        closes.append(marks[~opening & end])
    marks = np.concatenate(opens + closes)
    order = np.argsort(marks)
    opening = np.append(np.repeat([True, False], [sum(map(len, opens)), sum(map(len, closes))])[order], False)
    marks = marks[order]
    after = np.searchsorted(marks, at)
    left = np.append(marks, -1)[after - 1]
    right = np.append(marks, len(data))[after]
    row = np.searchsorted(offsets, at, "right") - 1
    near = (left >= offsets[row]) & (at - left <= reach) & (right < offsets[row + 1]) & (right - at <= reach)
    return near & (after > 0) & opening[after - 1] & ~opening[after]


def features(automaton: Lexicon, harmless: np.ndarray, column: pa.Array) -> np.ndarray:
    """Per text: all finds, those with one and with two edits, quoted finds, addressed finds (by number of
    binary digits), and the size of the text.  Quoted finds are only counted as such."""
    raw, offsets = text_bytes(column)
    data = _separated(raw)
    starts, ends, first = spans(data, offsets)
    edits = automaton.edits(data, starts, ends)
    hit = np.flatnonzero(edits >= 0)
    hit = hit[(edits[hit] == 0) | ~np.isin(_hash_at(data, starts[hit], ends[hit]), harmless)]
    row = rows_of(first)
    out = np.zeros((len(offsets) - 1, N_FEATURES), np.int64)
    if len(hit):
        quoted = _quoted(raw, offsets, starts[hit])
        near = np.zeros(len(hit), bool)
        for shift in range(-WINDOW, WINDOW + 1):
            other = hit + shift
            inside = (other >= 0) & (other < len(starts))
            inside[inside] = row[other[inside]] == row[hit[inside]]
            at = other[inside]
            address = np.isin(_hash_at(data, starts[at], ends[at]), _ADDRESS)
            near[np.flatnonzero(inside)[address]] = True
        said = edits[hit].astype(np.int64)
        for column_, chosen in enumerate([~quoted, (said == 1) & ~quoted, (said == 2) & ~quoted, quoted, near & ~quoted]):
            out[:, column_] = np.bincount(row[hit[chosen]], minlength=len(out))
    out[:, :5] = np.frexp(out[:, :5])[1]
    out[:, 5] = np.log10(np.maximum(np.diff(first), 1)).astype(np.int64)
    return out


def _hash_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of a few words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    at = np.append(0, np.cumsum(sizes + 1))
    flat = np.full(at[-1], 32, np.uint8)
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat[np.repeat(at[:-1], sizes) + inner] = data[np.repeat(starts, sizes) + inner]
    return hashes(flat, at[:-1], at[:-1] + sizes)


@dataclass(frozen=True)
class Model(Sendable):
    automaton: Lexicon | None
    #: Hashes of words that are a few edits from a term but known to be harmless.
    harmless: np.ndarray
    weights: np.ndarray
    terms: list[str]


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, int, int]:
    """(text, toxic, half) of the labelled sample, and how many of it are good and bad.

    ``half`` parts the good ones in two by a hash of the id.
    """
    known = labels.select(labels["doc_id"].cast("bigint").alias("_id"), labels["toxic"].cast("int").alias("toxic"))
    known = known.filter("_id is not null and toxic in (0, 1) and crc32(cast(_id as string)) % 4 <> 2").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    rows = [r for t in (0, 1) for r in known.filter(F.col("toxic") == t).orderBy(F.xxhash64("_id"), "_id").limit(sample).collect()]
    drawn = docs.sparkSession.createDataFrame(rows, "_id bigint, toxic int")
    plain = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    chosen = plain.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    bad = sum(r.toxic for r in rows)
    return chosen.select("text", F.col("toxic").cast("bigint").alias("toxic"), (F.xxhash64(F.lit("half"), "doc_id") % 2 == 0).alias("half")), len(rows) - bad, bad


def lexicon(chosen: DataFrame, n_good: int, n_bad: int) -> list[str]:
    """Words of the toxic sample that are much likelier there, by a test on counts.

    A word's count is that of its documents or, if these are fewer, of its contexts (the words on both
    sides): neither copies of one document nor one that repeats a word make a term.  The likelihood-ratio
    test's level is one over the number of words tested, so that chance brings in about one at most.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                raw, offsets = text_bytes(part["text"])
                data = _separated(raw)
                starts, ends, first = spans(data, offsets)
                hashed, row = hashes(data, starts, ends), rows_of(first)
                left, right = np.append(np.uint64(0), hashed[:-1])[: len(hashed)], np.append(hashed[1:], np.uint64(0))[: len(hashed)]
                context = mix(mix(left) + right).view(np.int64)
                toxic = part["toxic"].to_numpy()[row]
                # Of the good ones only whether a word stands in a document matters.
                _, once = np.unique(hashed ^ mix(row.astype(np.uint64)), return_index=True)
                use = np.union1d(once[toxic[once] == 0], np.flatnonzero(toxic == 1))
                begins = np.zeros(len(hashed), np.int64)
                begins[once] = 1
                text = data.tobytes()
                words = [text[a:b].decode("utf-8", "replace") for a, b in zip(starts[use], ends[use], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic[use]), pa.array(context[use]), pa.array(begins[use])], names=["word", "toxic", "context", "docs"])

    rows = chosen.mapInArrow(seen, "word string, toxic bigint, context bigint, docs bigint")
    bad = rows.filter("toxic = 1").groupBy("word", "context").agg(F.sum("docs").alias("docs"))
    bad = bad.groupBy("word").agg(F.least(F.sum("docs"), F.count(F.lit(1))).alias("bad")).filter(F.col("bad") >= LEAST_SEEN)
    good = rows.filter("toxic = 0").groupBy("word").agg(F.count(F.lit(1)).alias("good"))
    both = store.keep(bad.join(good, "word", "left").fillna(0, ["good"]), "words")
    ratio = ((F.col("bad") + 0.5) / float(n_bad + 1)) / ((F.col("good") + 0.5) / float(n_good + 1))
    every, share = F.col("bad") + F.col("good"), n_bad / float(n_bad + n_good)
    by_good = F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (every * (1 - share)))).otherwise(0.0)
    # Half the test's statistic: minus the logarithm of a chance, about.
    evidence = F.col("bad") * F.log(F.col("bad") / (every * share)) + by_good
    found = both.filter((ratio >= LEAST_RATIO) & (evidence >= float(np.log(max(both.count(), 1)))))
    return sorted(r.word for r in found.select("word").collect())


def _harmless(chosen: DataFrame, automaton: Lexicon) -> np.ndarray:
    """Words of one half of the good sample that are a few edits from a term."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                raw, offsets = text_bytes(part["text"])
                data = _separated(raw)
                starts, ends, _ = spans(data, offsets)
                edited = np.flatnonzero(automaton.edits(data, starts, ends) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_hash_at(data, starts[edited], ends[edited])).view(np.int64))], names=["word"])

    rows = chosen.filter("toxic = 0 and half").select("text").mapInArrow(near, "word bigint").distinct().collect()
    return np.sort(np.array([r.word for r in rows], np.int64).view(np.uint64))


def _fit(counts: dict[tuple[int, ...], list[int]], rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps over distinct feature rows, drawn to the prior weights."""
    x = np.array([(1, *k) for k in counts], float)
    n, y = np.array([sum(v) for v in counts.values()], float), np.array([v[1] for v in counts.values()], float)
    prior, hold = np.array([0.0, *PRIOR]), np.array([0.01, *[HOLD] * len(PRIOR)])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(hessian, x.T @ (y - n * p) - hold * (w - prior))
        w += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon, automaton, exceptions and regression from the labelled sample."""
    store.bounded_batches(docs.sparkSession)
    chosen, n_good, n_bad = _sample(docs, labels, sample)
    if not n_good or not n_bad:
        return Model(None, np.zeros(0, np.uint64), np.zeros(N_FEATURES + 1), [])
    terms = lexicon(chosen, n_good, n_bad)
    automaton = Lexicon(terms)
    harmless = _harmless(chosen, automaton)
    sent = docs.sparkSession.sparkContext.broadcast((automaton, harmless))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                rows, counts = np.unique(np.column_stack([features(*sent.value, part["text"]), part["toxic"].to_numpy()]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(rows.tolist(), pa.list_(pa.int64())), pa.array(counts)], names=["f", "n"])

    # As many rows come back as there are different feature rows, which are logarithms.
    rows = chosen.filter("toxic = 1 or not half").mapInArrow(count, "f array<bigint>, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect()
    counts: dict[tuple[int, ...], list[int]] = defaultdict(lambda: [0, 0])
    for r in sorted(rows):
        counts[tuple(r.f[:-1])][r.f[-1]] += r.n * (1 if r.f[-1] else 2)  # the other half of the good ones counts for both
    return Model(automaton, harmless, _fit(counts), terms)


def scorer(spark: SparkSession, model: Model):
    """A column function text -> score."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        model, out = sent.value, [np.zeros(0)]
        for part in parts(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
            if model.automaton is None:
                out.append(np.zeros(part.num_rows))
                continue
            x = features(model.automaton, model.harmless, part["text"])
            out.append(1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30))))
        return pa.array(np.concatenate(out))

    return score


def with_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``toxicity``, a score from 0 to 1."""
    store.bounded_batches(docs.sparkSession)
    return docs.withColumn("toxicity", scorer(docs.sparkSession, model)(docs[text].cast("string")))


def op6_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = with_toxicity(docs.select("doc_id", "text"), learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
