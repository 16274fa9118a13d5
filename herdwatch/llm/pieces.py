"""SentencePiece encoding and decoding, with sampled segmentations by Gumbel top-k.

k distinct segmentations of a whole text are drawn without replacement by a perturbed A* search
over the lattice (Kool et al., 2019).  A search node is the set of all segmentations that share
a beginning and do not go on in stated ways; its priority is the largest Gumbel-perturbed log
probability in it, drawn top-down under the bound of the set it was split from.  Popping the best
node fixes one segmentation, drawn from the lattice by its forward masses, and splits off, step by
step, the sets that leave it there.  The first k segmentations popped are the k largest of all
perturbed ones, hence a sample without replacement.  The next priority is the threshold: a
segmentation of log probability s was included with probability 1 - exp(-exp(s - threshold)).
All noise is a hash of the seed and the row's key.  Inclusions below the smallest number are 0.

Log probabilities are the model's scores, or Zipf log probabilities of merge ranks, times
``theta``, normalised over the lattice.  The steps of a text are its chunks from left to right,
and within a chunk pieces from right to left.

Defined results: null and empty texts give one empty segmentation of score 0 and inclusion 1; a
text with fewer than k segmentations gives all it has, the last ones with inclusion 1; equal keys
and texts give equal samples; a null key counts as 0.  Decoding gives the text back, but for
U+2581 in it, which becomes a space.  Extra columns are passed through.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.llm import store
from herdwatch.llm.lattice import Lattice, Vocabulary, chunks, uniforms, walk
from herdwatch.llm.words import give_back, keys, mix, parts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, THETA, SEED = 2, 1.0, 29
#: Bytes of text whose lattice is built at once; it takes some 160 times as much memory.
PART_BYTES = 1 << 18

SAMPLE = "array<struct<pieces:array<int>,score:double,inclusion:double>>"


class _Search:
    """The searches of a part's texts side by side: paths of all texts lie end to end."""

    def __init__(self, lattice: Lattice, key: np.ndarray, k: int):
        self.lattice, self.key, self.k = lattice, key, k
        self.heaps: list[list] = [[] for _ in key]  # (-priority, number, step, edges left out)
        self.found: list[list[np.ndarray]] = [[] for _ in key]
        self.score: list[list[float]] = [[] for _ in key]

    def add(self, texts: np.ndarray, edges: np.ndarray, cuts: np.ndarray, start: np.ndarray, out: list[tuple[int, ...]], bound: np.ndarray) -> None:
        """Add a segmentation to each of ``texts`` and split off the sets that leave it at ``start`` or later.

        ``out`` are the edges not to be taken at ``start`` and ``bound`` is the segmentation's own
        priority.  As many sets are kept as can still be popped, and one more.
        """
        lattice, sizes = self.lattice, np.diff(cuts)
        row = np.repeat(np.arange(len(texts)), sizes)
        step = np.arange(len(edges)) - np.repeat(cuts[:-1], sizes)
        # Sums are taken text by text, so that they do not depend on the texts around.
        share, before, scores = lattice.share[edges], np.zeros(len(edges)), []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            total = np.cumsum(share[a:b])
            before[a + 1 : b] = total[:-1]
            scores.append(float(total[-1]))
        mass = np.where(step >= start[row], before + lattice.rest[edges], -np.inf)
        for i, edges_out in enumerate(out):
            if len(edges_out) > 1:
                at = cuts[i] + start[i]
                node = lattice.to[edges[at]]
                left = [e for e in range(lattice.first[node], lattice.first[node + 1]) if e not in edges_out]
                mass[at] = before[at] + np.log(lattice.part[left].sum()) if left else -np.inf
        number = len(self.found[texts[0]])
        exponential = -np.log(uniforms(self.key[texts][row], number + 1000, step, 7))
        priority = mass - np.log(np.exp(mass - bound[row]) + exponential)
        most = self.k - number
        for i, t in enumerate(texts):
            a, b = cuts[i], cuts[i + 1]
            self.found[t].append(edges[a:b])
            self.score[t].append(scores[i])
            here = priority[a:b]
            steps = np.argpartition(-here, most - 1)[:most] if b - a > most else np.arange(b - a)
            for s in steps[here[steps] > -np.inf]:
                heapq.heappush(self.heaps[t], (-float(here[s]), number, int(s), out[i] if s == start[i] and number else (int(edges[a + s]),)))


def sample_texts(vocabulary: Vocabulary, texts: list[str | None], key: np.ndarray, k: int, theta: float) -> tuple[list[int], np.ndarray, np.ndarray, list[float], list[float]]:
    """Sampled segmentations of all texts, in order: how many each text has; all piece ids, and where
    each segmentation's begin (one more); log probabilities; inclusion probabilities."""
    points, begins, first = chunks(vocabulary, texts)
    sizes = np.diff(first)
    filled = np.flatnonzero(sizes > 0)
    counts = np.ones(len(texts), np.int64)
    if not len(filled):
        return counts.tolist(), np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), [0.0] * len(texts), [1.0] * len(texts)
    lattice = Lattice(vocabulary, points, begins, theta)
    last = lattice.ends_of(lattice.chunk)
    search = _Search(lattice, key, k)
    edges, steps = walk(lattice, last, np.repeat(key, sizes), 0, np.arange(len(last)) - np.repeat(first[:-1], sizes))
    cuts = np.append(0, np.cumsum(steps))[np.append(first[:-1][filled], first[-1])]
    root = -np.log(-np.log(uniforms(key[filled], 999, 0, 0)))
    search.add(filled, edges, cuts, np.zeros(len(filled), np.int64), [()] * len(filled), root)
    for round_ in range(1, k):
        who, nodes, heads, out, starts, bound = [], [], [], [], [], []
        lengths, rest = [], []
        for t in filled:
            if not search.heaps[t]:
                continue
            value, number, step, left_out = heapq.heappop(search.heaps[t])
            path = search.found[t][number]
            node = lattice.to[path[step]]
            left = np.array([e for e in range(lattice.first[node], lattice.first[node + 1]) if e not in left_out])
            share = np.cumsum(lattice.part[left])
            noise = float(uniforms(key[t : t + 1], round_, step, 3)[0])
            turn = left[min(int(np.searchsorted(share, share[-1] * noise, "right")), len(left) - 1)]
            # Chunks whose edges all come before this step are done; the present one goes on.
            done = int(first[t] + (lattice.source[path[:step]] < lattice.count).sum())
            who.append(t)
            nodes.append(lattice.source[turn])
            rest.append(done)
            lengths.append(int(first[t + 1] - done))
            heads.append(np.append(path[:step], turn))
            out.append((*left_out, int(turn)))
            starts.append(step)
            bound.append(-value)
        if not who:
            break
        lengths, begun = np.array(lengths), np.append(0, np.cumsum(lengths))
        occurrence = np.arange(begun[-1]) - np.repeat(begun[:-1], lengths) + np.repeat(rest, lengths)
        node = last[occurrence]
        node[begun[:-1]] = nodes
        text = np.repeat(who, lengths)
        edges, steps = walk(lattice, node, key[text], round_, occurrence - first[text])
        inner = np.append(0, np.cumsum(steps))[begun]
        paths = [np.concatenate([heads[i], edges[inner[i] : inner[i + 1]]]) for i in range(len(who))]
        cuts = np.append(0, np.cumsum([len(p) for p in paths]))
        search.add(np.array(who), np.concatenate(paths), cuts, np.array(starts), out, np.array(bound))
    paths, score, inclusion = [], [], []
    for t in range(len(texts)):
        if not sizes[t]:
            paths.append(np.zeros(0, np.int64))
            score.append(0.0)
            inclusion.append(1.0)
            continue
        threshold = -search.heaps[t][0][0] if search.heaps[t] else -np.inf
        counts[t] = len(search.found[t])
        paths += search.found[t]
        score += search.score[t]
        inclusion += [float(-np.expm1(-np.exp(min(s - threshold, 700.0)))) for s in search.score[t]]
    ids, begins = _ids(vocabulary, lattice, np.concatenate(paths), np.append(0, np.cumsum([len(p) for p in paths])))
    return counts.tolist(), ids, begins, score, inclusion


def _ids(vocabulary: Vocabulary, lattice: Lattice, path: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids in reading order: each chunk's edges are turned round, bytes are spelled out."""
    ends = lattice.source[path] < lattice.count
    group = np.append(0, np.cumsum(ends)[:-1])
    last = np.flatnonzero(ends)
    first = np.append(0, last[:-1] + 1)
    path = path[first[group] + last[group] - np.arange(len(path))]
    ids = lattice.piece[path]
    missing = np.flatnonzero(ids == len(vocabulary.pieces))
    points, which = np.unique(lattice.spelled[path[missing]], return_inverse=True)
    spelled = [vocabulary.bytes[list(chr(p).encode("utf-8", "surrogatepass"))] for p in points]
    width = np.ones(len(ids), np.int64)
    width[missing] = np.array([len(x) for x in spelled], np.int64)[which]
    place = np.append(0, np.cumsum(width))
    flat = np.repeat(ids, width)
    for j in range(4):
        byte = np.array([x[j] if j < len(x) else -1 for x in spelled], np.int64)[which]
        flat[place[missing[byte >= 0]] + j] = byte[byte >= 0]
    return flat.astype(np.int32), place[begins]


def sampler(spark: SparkSession, model: str = MODEL, k: int = SAMPLES, theta: float = THETA, seed: int = SEED):
    """A column function (text, key) -> array of (pieces, score, inclusion)."""
    sent = spark.sparkContext.broadcast(Vocabulary(model))
    salt = keys(1, seed)[0]

    @F.arrow_udf(SAMPLE)
    def sample(text: pa.Array, key: pa.Array) -> pa.Array:
        give_back()
        vocabulary = sent.value.open()
        samples, ids, sizes, score, inclusion = [], [], [], [], []
        for part in parts(pa.RecordBatch.from_arrays([text, key], names=["text", "key"]), "text", PART_BYTES):
            row_key = mix(pa.compute.fill_null(part["key"], 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ salt)
            n, pieces, begins, s, i = sample_texts(vocabulary, part["text"].to_pylist(), row_key, k, theta)
            samples += n
            ids.append(pieces)
            sizes.append(np.diff(begins))
            score += s
            inclusion += i
        give_back()
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
        ends = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
        rows = pa.StructArray.from_arrays([lists, pa.array(score, pa.float64()), pa.array(inclusion, pa.float64())], names=["pieces", "score", "inclusion"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(samples)).astype(np.int32)), rows)

    return sample


def decoder(spark: SparkSession, model: str = MODEL):
    """A column function from piece ids to the text; null ids give null."""
    sent = spark.sparkContext.broadcast(Vocabulary(model))

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        vocabulary = sent.value
        as_byte = {int(i): b for b, i in enumerate(vocabulary.bytes)}

        def text(row: list[int] | None) -> str | None:
            if row is None:
                return None
            raw = b"".join(bytes([as_byte[i]]) if i in as_byte else (vocabulary.pieces[i] or "").encode() for i in row)
            return raw.decode("utf-8", "replace").replace("▁", " ")[1:]

        return pa.array([text(row) for row in ids.to_pylist()], pa.string())

    return decode


def encoder(model: str = MODEL):
    """A column function from text to the model's own single encoding."""

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        spm = sentencepiece.SentencePieceProcessor(model_file=model)
        for text in texts:
            yield pa.array(spm.encode(pa.compute.fill_null(text, "").to_pylist(), num_threads=1), pa.list_(pa.int32()))

    return encode


def with_samples(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL, k: int = SAMPLES, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """Add ``samples``: up to k distinct segmentations of the text with scores and inclusion."""
    store.bounded_batches(docs.sparkSession, 1, 1_000)
    row_key: Column = F.coalesce(docs[key].cast("bigint"), F.xxhash64(docs[text]))
    return docs.withColumn("samples", sampler(docs.sparkSession, model, k, theta, seed)(docs[text].cast("string"), row_key))


def op1_sentencepiece_gumbel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_samples(docs).select("doc_id", "samples")
