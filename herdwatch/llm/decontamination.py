"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments.  A segment holds some megabytes of whole documents as
postings: its terms (64-bit word hashes, sorted), and for each term the places where it stands,
counted over the segment.  Segments are written by the tasks that read the documents; nothing
of a document leaves its segment, so no term, however frequent, meets in one task.

A search counts the terms of the test phrases over all segments, orders each phrase's terms from
the rarest, and intersects the postings in that order, each moved back by the term's offset in
the phrase.  Phrases are searched in blocks of a stated size, each of which is sent to all tasks; a
block's matches are written before the next one is sent.  Which items a phrase is of is joined to
the matches afterwards.

Defined results: a null or empty text has no words and no matches; null and repeated document
ids stay rows of their own; phrases without words match nothing; the words of an item with a null
id are hit like others, such items count as one item and have no id to list; items of one id count
once; an empty table gives an empty result.  Long texts are taken whole.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.llm import store
from herdwatch.llm.words import ALNUM, lean, parts, words

WINDOW = 13
#: Words of a segment; a longer document is a segment of its own.
SEGMENT = 150_000
#: Phrases that are searched at once: what is sent for them stays below about 25 MB.
BLOCK = 200_000

INDEX = "segment string, doc_ids array<bigint>, doc_starts binary, terms binary, ends binary, places binary"
MATCHES = "segment string, doc int, doc_id bigint, n_words bigint, phrases array<binary>, hits array<struct<a:bigint,b:bigint>>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of each part of the documents."""
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    held: list[tuple[list, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        ids, sizes, terms = [i for h in held for i in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        held.clear()
        order = np.argsort(terms, kind="stable")
        ordered = terms[order]
        begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        starts = np.append(0, np.cumsum(sizes)).astype(np.int32)
        ends = np.append(begins[1:], len(terms)).astype(np.int32) if len(terms) else np.zeros(0, np.int32)
        columns = [a.tobytes() for a in (starts, ordered[begins], ends, order.astype(np.int32))]
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{task}-{number}"]), pa.array([ids], pa.list_(pa.int64())), *(pa.array([c]) for c in columns)],
            names=["segment", "doc_ids", "doc_starts", "terms", "ends", "places"],
        )

    for batch in batches:
        for part in parts(batch, "text"):
            terms, first, _, _ = words(part["text"], ALNUM)
            if held and sum(len(h[2]) for h in held) + len(terms) > SEGMENT:
                yield flush()
                number += 1
            held.append((part["doc_id"].to_pylist(), np.diff(first), terms))
    if held:
        yield flush()


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the positional inverted index of all documents and return it as a table."""
    store.bounded_batches(docs.sparkSession)
    plain = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    return store.keep(plain.mapInArrow(lean(_segments), INDEX), "postings")


def phrases_of(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(phrase, item): every run of ``window`` words of each item, or the whole of a shorter one, as term hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                terms, first, _, _ = words(part["text"], ALNUM)
                ids, item, phrase = part["item_id"].to_pylist(), [], []
                for row, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    for start in range(a, max(a, b - window) + 1 if b > a else a):
                        item.append(ids[row])
                        phrase.append(terms[start : min(b, start + window)].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(phrase, pa.binary())], names=["item", "phrase"])

    store.bounded_batches(items.sparkSession)
    plain = items.select(items[item_id].cast("string").alias("item_id"), items[text].cast("string").alias("text"))
    return plain.mapInArrow(cut, "item string, phrase binary").select("phrase", "item").distinct()


class Segment:
    """One segment's postings, opened for searching."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        def read(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(batch[name][row].as_py(), kind)

        self.terms, ends, self.doc_starts = read("terms", np.uint64), read("ends", np.int32), read("doc_starts", np.int32)
        self.ends = ends.astype(np.int64)
        self.begins = np.append(0, self.ends)[:-1]
        self.size = int(self.doc_starts[-1])
        self.places = read("places", np.int32)

    @cached_property
    def keys(self) -> np.ndarray:
        """(term, place) as one ascending number: membership in any term's list is one search."""
        return np.repeat(np.arange(len(self.terms)), self.ends - self.begins) * self.size + self.places

    def term(self, hashed: np.ndarray) -> np.ndarray:
        """The number of each term here, or -1."""
        if not len(self.terms):
            return np.full(len(hashed), -1)
        at = np.minimum(np.searchsorted(self.terms, hashed), len(self.terms) - 1)
        return np.where(self.terms[at] == hashed, at, -1)

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of the given terms, and which of the given terms each is of."""
        counts = self.ends[terms] - self.begins[terms]
        which = np.repeat(np.arange(len(terms)), counts)
        at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + self.begins[terms][which]
        return self.keys[at] - terms[which] * self.size, which

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = terms * self.size + places
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted

    def gap(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Distance from each place to the nearest place of the term."""
        at = np.searchsorted(self.keys, terms * self.size + places)
        after, before = np.minimum(at, len(self.keys) - 1), np.maximum(at - 1, 0)
        far = np.iinfo(np.int64).max
        right = np.where((at < self.ends[terms]), self.keys[after] - terms * self.size - places, far)
        left = np.where((at > self.begins[terms]), places - (self.keys[before] - terms * self.size), far)
        return np.minimum(left, right)

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, places, "right") - 1


def _in_order(phrases: list[np.ndarray], terms: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases whose terms all occur: a row of terms each, their number, and the offsets from the rarest
    term on.  ``terms`` are the known ones, ascending, and ``often`` how often each stands in the documents."""
    length = np.array([len(p) for p in phrases])
    table = np.zeros((len(phrases), int(length.max())), np.uint64)
    inside = np.arange(table.shape[1]) < length[:, None]
    table[inside] = np.concatenate(phrases)
    rank = np.zeros(table.shape, np.int64)
    if len(terms):
        at = np.minimum(np.searchsorted(terms, table), len(terms) - 1)
        rank = np.where(terms[at] == table, often[at], 0)
    alive = inside.any(axis=1) & (np.where(inside, rank, 1) > 0).all(axis=1)
    rank[~inside] = np.iinfo(np.int64).max
    order = np.argsort(rank[alive], axis=1, kind="stable")
    return table[alive], length[alive], order.astype(np.uint8 if table.shape[1] <= 256 else np.int32)


class Phrases:
    """A block of phrases, as ``_in_order`` gives them."""

    def __init__(self, table: np.ndarray, length: np.ndarray, order: np.ndarray):
        self.table, self.length, self.order, self.wide = table, length, order, table.shape[1]

    def phrase(self, at: int) -> bytes:
        return self.table[at, : self.length[at]].tobytes()

    def starts(self, segment: Segment, reach: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place) of every match: where a phrase starts, or with ``reach`` where its rarest
        term stands with all others at most ``reach`` words away."""
        local = segment.term(self.table.ravel()).reshape(self.table.shape)
        inside = np.arange(self.wide) < self.length[:, None]
        live = np.flatnonzero(((local >= 0) | ~inside).all(axis=1))
        if not len(live):
            return live, live
        anchor = self.order[live, 0].astype(np.int64)
        place, which = segment.postings(local[live, anchor])
        phrase, place = live[which], place - (anchor[which] if reach is None else 0)
        if reach is None:
            fits = (place >= 0) & (place + self.length[phrase] <= segment.size)
            phrase, place = phrase[fits], place[fits]
        for step in range(1, self.wide):
            more = self.length[phrase] > step
            offset = self.order[phrase[more], step].astype(np.int64)
            terms = local[phrase[more], offset]
            ok = np.ones(len(phrase), bool)
            ok[more] = segment.has(terms, place[more] + offset) if reach is None else segment.gap(terms, place[more]) <= reach
            phrase, place = phrase[ok], place[ok]
        return phrase, place


def _blocks(phrases: DataFrame, size: int) -> Iterator[list]:
    """The phrases in blocks of at most ``size`` rows; one block at a time is on the driver."""
    block: list = phrases.limit(size + 1).collect()
    if len(block) <= size:
        if block:
            yield block
        return
    block = []
    for row in store.keep(phrases, "phrases").toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _term_counts(index: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the wanted terms (ascending) that occur, and how often; as many rows as terms come back."""
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

    rows = index.select("terms", "ends").mapInArrow(lean(count), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sent.destroy()
    rows = sorted((r.term, r.n) for r in rows)
    return wanted[[t for t, _ in rows]], np.array([n for _, n in rows], np.int64)


def search(index: DataFrame, phrases: DataFrame, reach: int | None = None, block: int = BLOCK) -> DataFrame:
    """Matches per document and block, for documents that have any: the phrases found and the words inside matches.

    Without ``reach`` a phrase matches where its terms stand one after the other inside a document;
    with it, where all its terms stand at most ``reach`` words from its rarest one (proximity).
    ``segment`` and ``doc`` name the document in the index.
    """
    spark, found = index.sparkSession, []
    for rows in _blocks(phrases.select("phrase").distinct(), block):
        listed = [np.frombuffer(bytes(r.phrase), np.uint64) for r in rows]
        query = _in_order(listed, *_term_counts(index, np.unique(np.concatenate(listed))))
        if not len(query[0]):
            continue
        sent = spark.sparkContext.broadcast(query)
        found.append(store.keep(index.mapInArrow(lean(_matcher(sent, reach)), MATCHES), "matches"))
        sent.destroy()
    if not found:
        return spark.createDataFrame([], MATCHES)
    return reduce(DataFrame.unionAll, found)


def _matcher(sent, reach: int | None):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = Phrases(*sent.value)
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch, row)
                phrase, place = query.starts(segment, reach)
                doc = segment.doc(place)
                length = query.length[phrase] if reach is None else np.ones(len(phrase), np.int64)
                whole = place + length <= segment.doc_starts[doc + 1]
                phrase, place, doc, length = phrase[whole], place[whole], doc[whole], length[whole]
                ids = batch["doc_ids"][row].as_py()
                change = np.zeros(segment.size + 1, np.int64)
                np.add.at(change, place, 1)
                np.add.at(change, place + length, -1)
                hit = np.cumsum(change[:-1]) > 0
                out: dict[str, list] = {n: [] for n in ("doc", "doc_id", "n_words", "phrases", "hits")}
                for d in np.unique(doc):
                    a, b = segment.doc_starts[d], segment.doc_starts[d + 1]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]])))
                    out["doc"].append(int(d))
                    out["doc_id"].append(ids[d])
                    out["n_words"].append(int(b - a))
                    out["phrases"].append([query.phrase(p) for p in np.unique(phrase[doc == d])])
                    out["hits"].append([{"a": int(x), "b": int(y)} for x, y in edges.reshape(-1, 2)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch["segment"][row].as_py()] * len(out["doc"]), pa.string()),
                        pa.array(out["doc"], pa.int32()),
                        pa.array(out["doc_id"], pa.int64()),
                        pa.array(out["n_words"], pa.int64()),
                        pa.array(out["phrases"], pa.list_(pa.binary())),
                        pa.array(out["hits"], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                    ],
                    names=["segment", "doc", "doc_id", "n_words", "phrases", "hits"],
                )

    return match


def documents_of(index: DataFrame) -> DataFrame:
    """Every document of the index with its number of words."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, n = batch["doc_ids"][row].as_py(), np.diff(np.frombuffer(batch["doc_starts"][row].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch["segment"][row].as_py()] * len(ids)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids, pa.int64()), pa.array(n.astype(np.int64))],
                    names=["segment", "doc", "doc_id", "n_words"],
                )

    return index.select("segment", "doc_ids", "doc_starts").mapInArrow(lean(listed), "segment string, doc int, doc_id bigint, n_words bigint")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per document: words, words inside any benchmark window, the items found, and the verdict.

    A document is contaminated when at least a twentieth of its words, and one at least, are hit.
    """
    index = build_index(docs)
    phrases = store.keep(phrases_of(benchmark, window), "phrases")
    found = search(index, phrases, block=block)
    # A document has one row per block of phrases that met it: the hit stretches are merged here.
    ordered = F.array_sort(F.flatten(F.collect_list("hits")))
    hits = found.groupBy("segment", "doc").agg(
        F.aggregate(
            ordered,
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
            lambda acc, h: F.struct(
                (acc["n"] + F.greatest(F.lit(0), h["b"] - F.greatest(acc["to"], h["a"]))).cast("bigint").alias("n"),
                F.greatest(acc["to"], h["b"]).alias("to"),
            ),
            lambda acc: acc["n"],
        ).alias("n_hit"),
    )
    met = found.select("segment", "doc", F.explode("phrases").alias("phrase")).join(phrases, "phrase").select("segment", "doc", "item").distinct()
    items = met.groupBy("segment", "doc").agg(F.array_sort(F.collect_list("item")).alias("items"), F.count(F.lit(1)).alias("n_items"))
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    n_hit = F.coalesce("n_hit", zero)
    return (
        documents_of(index)
        .join(hits, ["segment", "doc"], "left")
        .join(items, ["segment", "doc"], "left")
        .select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items", none).alias("items"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    rows = store.numbered(docs, "rows")
    found = contamination(rows.select(F.col("_rid").alias("doc_id"), F.col("_doc.text").alias("text")), benchmark)
    bad = found.filter("contaminated").select(F.col("doc_id").alias("_rid"))
    return store.without(rows, bad, "_rid").select("_doc.*")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )
