"""Ranked lexical search: best-first over document intervals, bounded by range maxima of posting lists.

The index is a table of segments.  A segment holds some megabytes of whole documents, ordered by id:
the terms (64-bit word hashes, sorted) with their postings, that is in which documents each stands
and how often, and the lengths of the documents.  Segments are written by the tasks that read the
documents, so no term, however frequent, meets in one task.

A search first counts in how many documents each wanted term stands.  Then every segment is opened
with the lists of the wanted terms only: a posting's impact is its share of a score, and a sparse
table over the lists answers which posting of a list has the greatest impact in an interval of
documents.  The sum of these maxima bounds the score of every document in the interval.  Intervals
wait in one heap per item, the highest bound first; the next one is split at the document that has
its greatest impact: that document is scored in full, the two remaining intervals get bounds of their
own.  An item is done when no bound can bring a better document than its k best so far, which a task
carries from segment to segment.  Many items take a step at once, in numpy.

Defined results: a null or empty text has no terms, neither as document nor as item, and gives no
rows; equal scores go by ascending document id, null ids first; rows of one id are documents of
their own, and items of one id are ranked on their own; an empty table gives an empty result.  Long
texts are taken whole.  Extra columns are ignored.  Document ids are whole numbers.  Ranks are
unique: beyond equal scores and ids, the order of the index decides.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from herdwatch.llm import store
from herdwatch.llm.words import ALNUM, parts, words

#: Words of a segment; a longer document is a segment of its own.
SEGMENT = 400_000
#: Terms of the items that are searched at once: what is sent for them stays below about 10 MB.
BLOCK = 300_000
#: Intervals of one item that are split in one step.
STEP = 8
#: An item's candidates are ranked in so many groups before they meet.
GROUPS = 32
NO_ID = -(1 << 63)

INDEX = "segment string, doc_ids binary, sizes binary, terms binary, ends binary, docs binary, counts binary, n_docs bigint, n_words bigint"
ITEMS = "_item bigint, terms binary, times binary"
BEST = "_item bigint, doc_id bigint, score bigint, at string"


def _segment(name: str, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, doc: np.ndarray) -> list:
    """Postings of the given documents; ``doc`` has the row of every word."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    known, which = np.unique(terms, return_inverse=True)
    pairs, counts = np.unique(which * len(ids) + place[doc], return_counts=True)
    ends = np.searchsorted(pairs, np.arange(1, len(known) + 1) * len(ids))
    values = (ids[order], sizes[order].astype(np.int64), known, ends.astype(np.int32), (pairs % max(1, len(ids))).astype(np.int32), counts.astype(np.int32))
    return [name, *(v.tobytes() for v in values), int((sizes > 0).sum()), int(sizes.sum())]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    held: list = []

    def flush() -> pa.RecordBatch:
        sizes = np.concatenate([h[1] for h in held])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        row = _segment(f"{task}-{number}", np.concatenate([h[0] for h in held]), sizes, np.concatenate([h[2] for h in held]), doc)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["segment", "doc_ids", "sizes", "terms", "ends", "docs", "counts", "n_docs", "n_words"])

    for batch in batches:
        for part in parts(batch, "text"):
            terms, first, _, _ = words(part["text"], ALNUM)
            if held and sum(len(h[2]) for h in held) + len(terms) > SEGMENT:
                yield flush()
                number += 1
            ids = np.array([NO_ID if i is None else i for i in part["doc_id"].to_pylist()], np.int64)
            held.append((ids, np.diff(first), terms))
    if held:
        yield flush()


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the index of all documents and return it as a table."""
    store.bounded_batches(docs.sparkSession)
    plain = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    return store.keep(plain.mapInArrow(_segments, INDEX), "ranked-index")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each item and how often each stands in it."""
    for batch in batches:
        for part in parts(batch, "text"):
            hashed, first, _, _ = words(part["text"], ALNUM)
            found = [np.unique(hashed[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part["_item"], pa.array([t.tobytes() for t, _ in found], pa.binary()), pa.array([n.astype(np.int64).tobytes() for _, n in found], pa.binary())],
                names=["_item", "terms", "times"],
            )


def _blocks(items: DataFrame, size: int) -> Iterator[list]:
    """The items in blocks of about ``size`` terms; one block at a time is on the driver."""
    block, held = [], 0
    for row in items.toLocalIterator():
        if block and held + len(row.terms) // 8 > size:
            yield block
            block, held = [], 0
        block.append((row._item, row.terms, row.times))
        held += len(row.terms) // 8
    if block:
        yield block


def _holders(index: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """In how many documents each wanted term stands."""
    sent = index.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                terms, ends = np.frombuffer(batch["terms"][row].as_py(), np.uint64), np.frombuffer(batch["ends"][row].as_py(), np.int32)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, sent.value), len(terms) - 1)
                    total += np.where(terms[at] == sent.value, np.diff(ends, prepend=np.int32(0))[at], 0)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["term", "n"])

    out = np.zeros(len(wanted), np.int64)
    for row in index.select("terms", "ends").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    sent.destroy()
    return out


class Lists:
    """The posting lists of the wanted terms in one segment, with impacts and a sparse table of their maxima."""

    def __init__(self, row: dict, wanted: np.ndarray, weight: np.ndarray, n: int, total: int):
        def read(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(row[name], kind)

        self.ids, sizes = read("doc_ids", np.int64), read("sizes", np.int64)
        terms, ends, docs, counts = read("terms", np.uint64), read("ends", np.int32).astype(np.int64), read("docs", np.int32), read("counts", np.int32)
        self.size = len(self.ids)
        begin, end = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        if len(terms):
            at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
            here = terms[at] == wanted
            begin[here], end[here] = np.append(0, ends)[at[here]], ends[at[here]]
        length = end - begin
        self.end = np.cumsum(length)
        self.begin = self.end - length
        term = np.repeat(np.arange(len(wanted)), length)
        at = np.arange(len(term)) - self.begin[term] + begin[term]
        self.docs = docs[at].astype(np.int64)
        #: (list, document) as one ascending number.
        self.keys = term * self.size + self.docs
        tf, m = counts[at].astype(np.int64), 75 + (25 * sizes[self.docs] * n) // max(1, total)
        self.impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        #: Row j has the place of the greatest impact of the 2**j postings from each place on.
        self.greatest = [np.arange(len(term), dtype=np.int32)]
        for j in range(int(length.max(initial=0)).bit_length() - 1):
            a, b = self.greatest[j][: -(1 << j)], self.greatest[j][1 << j :]
            self.greatest.append(np.where(self.impact[b] > self.impact[a], b, a))

    def places(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where each list reaches the document."""
        return np.searchsorted(self.keys, term * self.size + doc)

    def top(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of the greatest impact in [left, right); -1 for an empty range."""
        out = np.full(len(left), -1, np.int64)
        some = np.flatnonzero(right > left)
        level = np.frexp((right - left)[some].astype(np.float64))[1] - 1
        for j in np.unique(level):
            at = some[level == j]
            a, b = self.greatest[j][left[at]], self.greatest[j][right[at] - (1 << int(j))]
            out[at] = np.where(self.impact[b] > self.impact[a], b, a)
        return out

    def has(self, term: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The impact of the document in each list, given where the list reaches it."""
        if not len(self.keys):
            return np.zeros(len(term), np.int64)
        at = np.minimum(place, len(self.keys) - 1)
        return np.where(self.keys[at] == term * self.size + doc, self.impact[at], 0)


class Items:
    """A block of items: their terms, in one array, as numbers of wanted terms, with multiplicities."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, times: np.ndarray):
        self.starts, self.terms, self.times = starts, terms, times

    def spread(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all terms of the given items: which of the given it is of, the term, its times, and where each begins."""
        size = self.starts[item + 1] - self.starts[item]
        first = np.cumsum(size) - size
        which = np.repeat(np.arange(len(item)), size)
        at = np.arange(len(which)) - first[which] + self.starts[item][which]
        return which, self.terms[at], self.times[at], first


class Best:
    """The k best documents of one item so far, the worst first."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def add(self, score: int, doc_id: int, at: str) -> None:
        entry = (score, -doc_id, at)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry[:2] > self.heap[0][:2]:
            heapq.heapreplace(self.heap, entry)

    def wants(self, bound: int, least_id: int) -> bool:
        """Whether documents with at most that score and at least that id can still be among the best."""
        if bound <= 0 or len(self.heap) < self.k:
            return bound > 0
        score, other, _ = self.heap[0]
        return bound > score or (bound == score and -least_id > other)


def best_first(lists: Lists, items: Items, best: list[Best], segment: str, step: int = STEP) -> int:
    """Bring every item's best documents up to date with a segment; how many documents were scored."""
    if not lists.size or not len(lists.keys):
        return 0
    scored, heaps = 0, [[] for _ in best]

    def bounds(item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bound of each interval and the document at which it is to be split."""
        which, term, times, first = items.spread(item)
        top = lists.top(lists.places(term, low[which]), lists.places(term, high[which]))
        most = np.where(top >= 0, lists.impact[top] * times, 0)
        total = np.add.reduceat(most, first)
        greatest = np.maximum.reduceat(most, first)
        at = np.full(len(item), lists.size, np.int64)
        is_it = (most == greatest[which]) & (top >= 0)
        np.minimum.at(at, which[is_it], lists.docs[top[is_it]])
        return total, at

    def push(item: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        some = high > low
        item, low, high = item[some], low[some], high[some]
        if not len(item):
            return
        bound, at = bounds(item, low, high)
        for i, b, x, y, d in zip(item.tolist(), bound.tolist(), low.tolist(), high.tolist(), at.tolist(), strict=True):
            if best[i].wants(b, ids[x]):
                heapq.heappush(heaps[i], (-b, x, y, d))

    ids = lists.ids.tolist()
    every = np.flatnonzero(np.diff(items.starts) > 0)
    push(every, np.zeros(len(every), np.int64), np.full(len(every), lists.size, np.int64))
    active = every.tolist()
    while active:
        taken, still = [], []
        for i in active:
            # Of equal bounds the one with the lower ids comes first: if it isn't wanted, none is.
            heap, n = heaps[i], 0
            while heap and n < step and best[i].wants(-heap[0][0], ids[heap[0][1]]):
                taken.append((i, *heapq.heappop(heap)[1:]))
                n += 1
            if n:
                still.append(i)
        active = still
        if not taken:
            break
        item, low, high, doc = np.array(taken, np.int64).T
        which, term, times, first = items.spread(item)
        doc_of = doc[which]
        score = np.add.reduceat(lists.has(term, doc_of, lists.places(term, doc_of)) * times, first)
        scored += len(item)
        for i, d, s in zip(item.tolist(), doc.tolist(), score.tolist(), strict=True):
            best[i].add(s, ids[d], f"{segment}-{d}")
        push(np.concatenate([item, item]), np.concatenate([low, doc + 1]), np.concatenate([doc, high]))
    return scored


def _search(index: DataFrame, block: list, n: int, total: int, k: int) -> DataFrame:
    """The k best documents of each task for a block of items, written out."""
    spark = index.sparkSession
    terms = [np.frombuffer(t, np.uint64) for _, t, _ in block]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
    wanted, number = np.unique(np.concatenate(terms), return_inverse=True)
    holders = _holders(index, wanted)
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * holders + 1))).astype(np.int64)
    times = np.concatenate([np.frombuffer(m, np.int64) for _, _, m in block])
    # Terms that no document has are left out of the items.
    alive = holders[number] > 0
    starts = np.concatenate([[0], np.cumsum(alive)])[starts]
    sent = spark.sparkContext.broadcast((wanted, weight, starts, number[alive], times[alive], [i for i, _, _ in block]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight, starts, number, times, names = sent.value
        items, best = Items(starts, number, times), [Best(k) for _ in names]
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch[c][row].as_py() for c in batch.schema.names}
                best_first(Lists(one, wanted, weight, n, total), items, best, one["segment"])
        rows = [(names[i], None if -d == NO_ID else -d, s, at) for i, b in enumerate(best) for s, d, at in b.heap]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["_item", "doc_id", "score", "at"])

    out = store.keep(index.select("segment", "doc_ids", "sizes", "terms", "ends", "docs", "counts").mapInArrow(search, BEST), "ranked-best")
    sent.destroy()
    return out


def rank(docs: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(_item, item columns as ``_row``, rank, doc_id, score): the k best documents of each item."""
    index = build_index(docs)
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    whole = F.struct(*(items[c] for c in items.columns)).alias("_row")
    rows = store.keep(items.select(F.monotonically_increasing_id().alias("_item"), whole), "items")
    store.bounded_batches(docs.sparkSession)
    terms = rows.select("_item", F.col("_row.text").cast("string").alias("text")).mapInArrow(_terms, ITEMS)
    found = None
    for part in _blocks(store.keep(terms.filter("length(terms) > 0"), "item-terms"), block):
        best = _search(index, part, n, total, k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return rows.limit(0).select("_item", "_row", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"))
    order = (F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("at"))
    grouped = found.withColumn("_part", F.pmod(F.xxhash64("at"), F.lit(GROUPS)))
    few = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("_item", "_part").orderBy(*order))).filter(F.col("rank") <= k)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order))).filter(F.col("rank") <= k)
    return last.join(rows, "_item").select("_item", "_row", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("_row.item_id").alias("item_id"), "rank", "doc_id", "score")
