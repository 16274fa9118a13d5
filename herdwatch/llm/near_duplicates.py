"""Near-duplicate documents by min-max hashing.

A document's set is its distinct shingles of k words.  Under each of 64 permutations both the
smallest and the largest value of the set are kept (Ji et al., 2013), so that 64 evaluations
give 128 unbiased samples of the Jaccard similarity.  A band is the minima and maxima of two
permutations, 16 bits of each, as one 64-bit number; the 32 bands are the signature.  Two sets
of similarity 0.8 miss each other in all bands with a chance of (1 - 0.8**4)**32 = 5e-8.

Documents with equal sets form a class, and classes are compared instead of documents.  Every
bucket (equal band) first proposes the link of each member to the bucket's first member.  Links
are confirmed on full shingle sets.  What the confirmed links join is one component; buckets
that still hold several components compare the members outside their largest one with all others,
or if these are many, find links among their members by prefix filtering on the full sets, which
is exact.  A large group of near copies is one component after the first round, so its pairs are
never listed; no bucket is dropped or capped.

Defined results: null, empty and white-space texts have an empty set, link with nothing and are
kept; fewer than k words are one shingle; rows with a null id link like others, and their
component is the smallest id in it, or null; repeated ids are rows of their own; ids that are no
whole numbers count as null.  Of equal sets and of equal sizes the smallest class leads (ties).  Very
long texts are cut into batches, not shortened.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.llm import store
from herdwatch.llm.components import components
from herdwatch.llm.words import SPACED, keys, lean, mix, parts, words

PERMUTATIONS, BANDS = 64, 32
#: Buckets with at most so many classes outside their largest component compare those with all members.
SMALL = 24
#: Equal values, of 128, below which a pair can't have a similarity of 0.8 (five standard deviations).
LEAST_EQUAL = 80
#: Each set has a bitmap of so many bits, turned over by each of its shingles.
PARITY_BITS = 2048
#: Shingle frequencies, which only order shingles, are counted in so many hash buckets; CHUNK of them are one row.
FREQUENCIES, CHUNK = 1 << 17, 1 << 10
COUNTS = "chunk int, counts binary"
#: Bands whose buckets propose links to their first member.
STAR_BANDS = 6
#: Pairs that one task confirms at least.
PAIRS_A_TASK = 4_000
#: At most so many classes (40 bytes each) are sent to all tasks to find their texts; more are joined.
FEW_CLASSES = 400_000

SIGNATURES = "doc_id bigint, h bigint, n int, set_a bigint, set_b bigint, bands array<bigint>, parity array<bigint>"
SETS = "c bigint, s binary"


def _document_sets(part: pa.RecordBatch, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per row the sorted distinct shingle hashes; and all shingles in text order with each row's first."""
    hashed, first, _, _ = words(part["text"], SPACED)
    counts = np.diff(first)
    shingles = np.zeros(len(hashed), np.uint64)
    for i, key in enumerate(keys(k, 4)):
        shingles[: max(0, len(hashed) - i)] += mix(hashed[i:] ^ key)
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        a, b = first[row], first[row + 1]
        shingles[a] = sum(int(mix(hashed[a + i : a + i + 1] ^ key)[0]) for i, key in enumerate(keys(b - a, 5))) % 2**64
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    kept = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    shingles, begins = mix(shingles[kept]), np.append(0, np.cumsum(n))
    sets = []
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        ordered = np.sort(shingles[a:b])
        sets.append(ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered)
    return sets, shingles, begins


def _identity(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Size and two independent 64-bit sums over each set."""
    sums = [[int(mix(s ^ key).sum(dtype=np.uint64)) if len(s) else 0 for s in sets] for key in keys(2, 6)]
    return (pa.array(np.array([len(s) for s in sets], np.int32)), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in sums))


def _parity(shingles: np.ndarray) -> np.ndarray:
    """The set's bitmap: bit i is the parity of the number of shingles that hash to it."""
    bits = np.bincount((shingles % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _signatures(k: int):
    factors = keys(PERMUTATIONS, 7) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                sets, shingles, begins = _document_sets(part, k)
                some = np.flatnonzero(np.diff(begins))
                lanes = np.zeros((len(sets), 2 * PERMUTATIONS), np.uint64)
                for p, factor in enumerate(factors):
                    if len(some):
                        values = shingles * factor
                        lanes[some, 2 * p] = np.minimum.reduceat(values, begins[:-1][some])
                        lanes[some, 2 * p + 1] = np.maximum.reduceat(values, begins[:-1][some])
                lanes = (mix(lanes) & np.uint64(0xFFFF)).reshape(len(sets), BANDS, 4)
                bands = lanes[..., 0] | lanes[..., 1] << np.uint64(16) | lanes[..., 2] << np.uint64(32) | lanes[..., 3] << np.uint64(48)
                ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
                parity = np.concatenate([_parity(x) for x in sets])
                parity = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (PARITY_BITS // 64)), pa.array(parity))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["h"], *_identity(sets), pa.ListArray.from_arrays(ends, pa.array(bands.view(np.int64).ravel())), parity],
                    names=["doc_id", "h", "n", "set_a", "set_b", "bands", "parity"],
                )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                sets, _, _ = _document_sets(part, k)
                same = [np.asarray(mine) == np.asarray(part[name]) for mine, name in zip(_identity(sets), ("n", "set_a", "set_b"), strict=True)]
                found = pa.RecordBatch.from_arrays([part["c"], pa.array([s.tobytes() for s in sets], pa.binary())], names=["c", "s"])
                yield found.filter(pa.array(np.all(same, axis=0)))

    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often shingles of each hash bucket stand in the sets, in chunks of buckets."""
    total = np.zeros(FREQUENCIES, np.int64)
    for batch in batches:
        for s in batch["s"]:
            total += np.bincount(_bucket(np.frombuffer(s.as_py(), np.uint64)), minlength=FREQUENCIES)
    if total.any():
        yield _chunks({i: total[i * CHUNK : (i + 1) * CHUNK] for i in range(FREQUENCIES // CHUNK)})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            total[chunk] = total.get(chunk, 0) + np.frombuffer(counts, np.int64)
    yield _chunks(total)


def _chunks(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["chunk", "counts"])


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(FREQUENCIES)).astype(np.int64)


def _prefixes(sent, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first shingles of each set in the common order: by their bucket's frequency, then by hash."""
        for batch in batches:
            for c, s in zip(batch["c"].to_pylist(), batch["s"], strict=True):
                shingles = np.frombuffer(s.as_py(), np.uint64)
                size = len(shingles)
                first = size - -(-size * percent // 100) + 1
                token = shingles[np.argsort(sent.value[_bucket(shingles)], kind="stable")[:first]].view(np.int64)
                whole = [np.full(first, c), np.full(first, size, np.int32), np.arange(first, dtype=np.int32)]
                bitmap = pa.ListArray.from_arrays(pa.array(np.arange(first + 1, dtype=np.int32) * (PARITY_BITS // 64)), pa.array(np.tile(_parity(shingles), first)))
                yield pa.RecordBatch.from_arrays([pa.array(token), *map(pa.array, whole), bitmap], names=["token", "c", "n", "i", "parity"])

    return run


def _equal_values(a: Column, b: Column) -> Column:
    """How many of the 16-bit values of two signatures are equal."""
    def lanes(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        return sum((F.shiftrightunsigned(z, s).bitwiseAND(F.lit(0xFFFF)) == 0).cast("int") for s in (0, 16, 32, 48))

    return F.aggregate(F.zip_with(a, b, lanes), F.lit(0), lambda s, x: s + x)


def _any_rows(df: DataFrame) -> bool:
    return bool(df.head(1))


class _Search:
    """The candidate search over classes: ``nodes`` has c, n, bands."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, k: int, percent: int):
        self.docs, self.nodes, self.k, self.percent = docs, nodes, k, percent

    def sets_of(self, classes: DataFrame, few: bool) -> DataFrame:
        """(c, s): the full shingle sets of the given classes (c), sorted; ``few`` of them are sent to all tasks."""
        used = self.nodes.join(classes, "c").select("c", "n", "set_a", "set_b", F.col("min_id").alias("_id"), F.col("h").alias("_h"))
        used = F.broadcast(used) if few else used
        # One text per class is read again.  Null or repeated ids have many texts: their hashes tell them apart.
        same = self.docs["doc_id"].eqNullSafe(used["_id"]) & (self.docs["h"] == used["_h"])
        texts = self.docs.join(used, same).select("c", "n", "set_a", "set_b", "text")
        return store.keep(texts.mapInArrow(lean(_full_sets(self.k)), SETS).groupBy("c").agg(F.first("s").alias("s")), "sets")

    def confirmed(self, likely: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) of classes whose full sets are similar enough."""
        pairs = likely.count()
        if not pairs:
            return likely
        if sets is None:
            classes = likely.select(F.explode(F.array("a", "b")).alias("c")).distinct()
            sets = self.sets_of(classes, 2 * pairs <= FEW_CLASSES)
        both = likely.join(sets.select(F.col("c").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("y")), "b")
        # A task is worth its start from some thousand pairs on.
        both = both.select("a", "b", "x", "y").coalesce(max(1, pairs // PAIRS_A_TASK))
        return store.keep(both.mapInArrow(lean(_similar(self.percent)), "a bigint, b bigint"), "confirmed")

    def _prefix_labels(self, classes: DataFrame, links: DataFrame) -> DataFrame:
        """(node, label) after adding to ``links`` all that could still join components of the given classes (c).

        Prefix filtering (Xiao et al., 2008): with shingles in one order, rare ones first, two sets
        that are similar enough have a common shingle among the first few of both, and there as many
        shingles follow as they must share.  Classes first meet the first and the last class of each of
        their shingles; what this does not join meets across components.
        """
        sets = self.sets_of(classes, classes.count() <= FEW_CLASSES)
        often = sets.select("s").mapInArrow(lean(_counted), COUNTS).repartition("chunk").mapInArrow(lean(_summed), COUNTS).collect()
        counts = np.zeros(FREQUENCIES, np.int64)
        for row in often:
            counts[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] += np.frombuffer(bytes(row.counts), np.int64)
        sent = self.docs.sparkSession.sparkContext.broadcast(counts)
        prefix = store.keep(sets.mapInArrow(lean(_prefixes(sent, self.percent)), "token bigint, c bigint, n int, i int, parity array<bigint>"), "prefix")
        follow = 1 + F.least(F.col("n_a") - F.col("i_a") - 1, F.col("n_b") - F.col("i_b") - 1)
        able = (follow * (100 + self.percent) >= (F.col("n_a") + F.col("n_b")) * self.percent) & self._able()

        def side(rows: DataFrame, name: str) -> DataFrame:
            return rows.select("token", *(F.col(x).alias(f"{x}_{name}") for x in rows.columns if x != "token"))

        ends = prefix.groupBy("token").agg(F.min(F.struct("c", "n", "i", "parity")).alias("x"), F.max(F.struct("c", "n", "i", "parity")).alias("y"))
        lead = ends.select("token", F.explode(F.array("x", "y")).alias("x")).select("token", "x.*")
        met = side(lead, "a").join(side(prefix, "b"), "token").filter(able & (F.col("c_a") != F.col("c_b")))
        pairs = met.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct()
        links = links.unionAll(self.confirmed(store.keep(pairs, "likely"), sets))
        names = components(links)
        named = prefix.join(names.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
        met = side(named, "a").join(side(named, "b"), "token").filter((F.col("label_a") < F.col("label_b")) & able)
        pairs = met.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct()
        more = self.confirmed(store.keep(pairs, "likely"), sets)
        return components(links.unionAll(more)) if _any_rows(more) else names

    def _side(self, name: str) -> DataFrame:
        return self.nodes.select(F.col("c").alias(name), *(F.col(x).alias(f"{x}_{name}") for x in ("n", "bands", "parity")))

    def _able(self) -> Column:
        """Whether sizes and bitmaps of sides a and b allow the similarity asked for; exact, as bits that
        differ are no more than shingles that differ (Sandes et al., 2020)."""
        sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent
        differ = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return sizes & (differ * (100 + self.percent) <= (F.col("n_a") + F.col("n_b")) * (100 - self.percent))

    def _likely(self) -> Column:
        """``_able``, and the signatures are like enough too."""
        return self._able() & (_equal_values(F.col("bands_a"), F.col("bands_b")) >= int(LEAST_EQUAL * self.percent / 80))

    def labels(self) -> DataFrame:
        """(node, label): classes that are linked, and the first class of their component."""
        bands = F.arrays_zip(F.sequence(F.lit(0), F.lit(BANDS - 1)).alias("j"), F.col("bands").alias("v"))
        rows = self.nodes.select("c", F.explode(bands).alias("e")).select("c", F.col("e.j").alias("j"), F.xxhash64("e.j", "e.v").alias("key"))
        shared = rows.groupBy("key").agg(F.min("c").alias("lead"), F.max("c").alias("last")).filter("lead < last").select("key", "lead")
        # From here on only buckets of two classes or more.
        rows = store.keep(rows.join(shared, "key"), "buckets")
        stars = rows.filter((F.col("j") < STAR_BANDS) & (F.col("c") > F.col("lead"))).select(F.col("lead").alias("a"), F.col("c").alias("b")).distinct()
        links = self.confirmed(store.keep(stars.join(self._side("a"), "a").join(self._side("b"), "b").filter(self._likely()).select("a", "b"), "likely"))
        rows = rows.select("c", "key")
        labelled = rows.join(self._near_labels(links), "c", "left").withColumn("label", F.coalesce("label", "c"))
        mixed = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(
            F.sum("m").alias("size"), F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("labels")
        ).filter("labels > 1").select("key", F.col("top.label").alias("top"), (F.col("size") - F.col("top.m")).alias("others"))
        open_rows = store.keep(labelled.join(mixed, "key"), "open")
        # Members outside a small bucket's largest component meet all others.
        listed = open_rows.filter(F.col("others") <= SMALL).join(self.nodes.select("c", "n", "bands", "parity"), "c")
        sides = {s: listed.select("key", "top", F.col("c").alias(s), F.col("label").alias(f"l_{s}"), *(F.col(x).alias(f"{x}_{s}") for x in ("n", "bands", "parity"))) for s in "ab"}
        one, two = sides["a"].filter("l_a <> top").drop("top"), sides["b"]
        apart = (F.col("l_a") < F.col("l_b")) | ((F.col("l_b") == F.col("top")) & (F.col("l_a") != F.col("l_b")))
        met = one.join(two, (one["key"] == two["key"]) & apart & self._likely())
        pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = links.unionAll(self.confirmed(store.keep(pairs, "likely")))
        large = store.keep(open_rows.filter(F.col("others") > SMALL).select("c").distinct(), "large")
        return self._prefix_labels(large, links) if _any_rows(large) else components(links)

    @staticmethod
    def _near_labels(links: DataFrame) -> DataFrame:
        """(c, label): a class of the same component, nearly always the same one for all of it.

        The first linked class, or the first one linked to that.
        """
        names = links.groupBy(F.col("b").alias("c")).agg(F.min("a").alias("label"))
        onward = names.select(F.col("c").alias("label"), F.col("label").alias("further"))
        return names.join(onward, "label", "left").select("c", F.coalesce("further", "label").alias("label"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: size of its shingle set, smallest id of its component, and whether it is that one."""
    if percent < 80:
        raise ValueError("bands and bounds are made for similarities of 80 percent or more")
    store.bounded_batches(docs.sparkSession, 1)
    plain = docs.select(docs[doc_id].try_cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    plain = plain.withColumn("h", F.xxhash64("text"))
    rows = store.keep(plain.mapInArrow(lean(_signatures(k)), SIGNATURES), "signatures")
    identity = ["n", "set_a", "set_b"]
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h")).alias("one")
    nodes = rows.filter("n > 0").groupBy(*identity).agg(one, F.first("bands").alias("bands"), F.first("parity").alias("parity"))
    nodes = nodes.withColumns({"c": F.monotonically_increasing_id(), "min_id": F.col("one.doc_id"), "h": F.col("one.h")}).drop("one")
    nodes = store.keep(nodes, "classes")
    names = store.keep(_Search(plain, nodes, k, percent).labels().withColumnRenamed("node", "c"), "labels")
    # Written out, so that the join below has plain exchanges on both sides: Spark splits a label that many classes have.
    component = names.join(nodes.select("c", "min_id"), "c").groupBy("label").agg(F.min("min_id").alias("component_id"))
    component = store.keep(component, "component")
    placed = nodes.select(*identity, "c", "min_id").join(names, "c", "left").withColumn("label", F.coalesce("label", "c"))
    placed = placed.join(component, "label", "left").select(*identity, F.coalesce("component_id", "min_id").alias("component_id"))
    out = rows.select("doc_id", *identity).join(placed, identity, "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), alone.alias("component_id"), F.col("doc_id").eqNullSafe(alone).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, null ids being last.

    Of rows that share that id one stays; documents without words all stay.
    """
    rows = store.numbered(docs, "rows")
    found = near_duplicates(rows.select("_rid", F.col("_doc.text").alias("text")), k, percent, "_rid")
    ids = rows.select("_rid", F.col("_doc.doc_id").cast("bigint").alias("_id"))
    placed = found.select(F.col("doc_id").alias("_rid"), "component_id").join(ids, "_rid")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("unknown"), "_id", "_rid")).alias("f"))
    others = placed.select("_rid").join(first.select(F.col("f._rid").alias("_rid")), "_rid", "left_anti")
    return store.without(rows, others, "_rid").select("_doc.*")


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=80)
