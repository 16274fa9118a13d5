"""Quality classifier by importance resampling (Xie et al., 2023).

Two generative models over hashed n-grams are counted: one of the target text (labelled good),
one of the raw text (all documents).  A document's importance weight is the ratio of its
likelihoods.  Documents are resampled without replacement by Gumbel top-k: the k largest of log
weight plus Gumbel noise, the noise being a hash of the document's id and a seed.

N-grams are of tokens (runs of letters and digits, runs of other signs): single tokens, pairs,
and pairs of shapes (capitals, digits, signs), and whether a token repeats the one before.

k is the number of documents whose weight is above the weight that best parts the labelled
sample into good and bad, so that the sample is as large as the part of the raw text that
resembles the target.  The target model and that weight are learned from at most ``sample``
labelled rows; raw counts and k are over all documents.

Defined results: a null or empty text has no n-grams, a log weight of 0 and is judged by it like
any other; a null id draws its noise from the text; repeated ids draw the same noise; rows that
tie with the k-th are kept; without labelled rows of both kinds every document is kept; an empty
table gives an empty result.  Extra columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.llm import store
from herdwatch.llm.store import Sendable
from herdwatch.llm.words import give_back, hashes, keys, lean, mix, parts, text_bytes

BUCKETS = 1 << 14
#: Labelled rows of each kind that the target model and the dividing weight are learned from.
SAMPLE = 10_000
SEED = 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.array([0 if b in (32, 9, 10, 11, 12, 13) else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
_IS_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_IS_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_TYPE = keys(4, 11)


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram of every text, and its row."""
    data, offsets = text_bytes(column)
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change |= edge
    starts = np.flatnonzero(change[:-1] & (kind > 0))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(change)
    ends = cuts[np.searchsorted(cuts, starts, "right")]
    token = hashes(_LOWER[data], starts, ends)
    upper = np.append(0, np.cumsum(_IS_UPPER[data]))
    digit = np.append(0, np.cumsum(_IS_DIGIT[data]))
    uppers, size = upper[ends] - upper[starts], ends - starts
    shape = np.where(uppers == 0, 0, np.where((uppers == 1) & (size > 1), 1, np.where(uppers == size, 2, 3)))
    shape = np.where(digit[ends] > digit[starts], 4, shape)
    shape = np.where(kind[starts] == 2, 5 + data[starts].astype(np.int64), shape).astype(np.uint64)
    row = np.searchsorted(offsets, starts, "right") - 1
    same = row[1:] == row[:-1]
    pairs = mix(token[:-1] + _TYPE[0]) ^ token[1:]
    shapes = shape[:-1] * np.uint64(512) + shape[1:] + _TYPE[1]
    repeats = (token[1:] == token[:-1]).astype(np.uint64) + _TYPE[2]
    grams = np.concatenate([token, mix(pairs)[same], mix(shapes)[same], mix(repeats)[same]])
    later = row[1:][same]
    return (grams % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, later, later, later])


@dataclass(frozen=True)
class Model(Sendable):
    """Log ratio per bucket; the weight that parts good from bad (None: nothing to learn from)."""

    ratio: np.ndarray
    divide: float | None


def _counts(docs: DataFrame, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of all documents, and of those with the ids in ``good``."""
    sent = docs.sparkSession.sparkContext.broadcast(good)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in parts(batch, "text"):
                grams, row = ngrams(part["text"])
                ids = pa.compute.fill_null(part["doc_id"], -1).to_numpy(zero_copy_only=False)
                chosen = np.isin(ids, sent.value) & ~np.asarray(pa.compute.is_null(part["doc_id"]))
                raw += np.bincount(grams, minlength=BUCKETS)
                target += np.bincount(grams[chosen[row]], minlength=BUCKETS)
        has = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(raw[has]), pa.array(target[has])], names=["bucket", "raw", "target"])

    rows = docs.mapInArrow(lean(count), "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in rows:
        raw[bucket], target[bucket] = r, t
    return raw, target


def scorer(ratio: np.ndarray):
    """A column function text -> (log weight, number of n-grams)."""

    @F.arrow_udf("struct<log_weight:double,n:bigint>")
    def score(column: pa.Array) -> pa.Array:
        weight, number = [np.zeros(0)], [np.zeros(0, np.int64)]
        for part in parts(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
            grams, row = ngrams(part["text"])
            weight.append(np.bincount(row, ratio[grams], part.num_rows))
            number.append(np.bincount(row, minlength=part.num_rows))
        give_back()
        return pa.StructArray.from_arrays([pa.array(np.concatenate(weight)), pa.array(np.concatenate(number).astype(np.int64))], names=["log_weight", "n"])

    return score


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Count both models and find the dividing weight on the labelled sample.

    Rows whose crc32 of the id, modulo 4, is 2 are held out and never learned from.
    """
    store.bounded_batches(docs.sparkSession, 1)
    plain = _plain(docs)
    known = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    drawn = {q: known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect() for q in (0, 1)}
    good = np.array([r.doc_id for r in drawn[1]], np.int64)
    raw, target = _counts(plain, good)
    smooth = lambda c: np.log((c + 1) / (c.sum() + BUCKETS))
    ratio = smooth(target) - smooth(raw)
    if not drawn[0] or not drawn[1] or not target.sum():
        return Model(ratio, None)
    quality = docs.sparkSession.createDataFrame(drawn[0] + drawn[1], "doc_id bigint, quality int").dropDuplicates(["doc_id"])
    scored = plain.join(F.broadcast(quality), "doc_id").select("quality", scorer(ratio)("text")["log_weight"].alias("w")).limit(4 * sample)
    seen = sorted((r.w, r.quality) for r in scored.collect())
    return Model(ratio, _divide(np.array([w for w, _ in seen]), np.array([q for _, q in seen])))


def _divide(weight: np.ndarray, quality: np.ndarray) -> float | None:
    """The weight with the fewest balanced errors; half way through the widest gap that has them."""
    if len(set(quality.tolist())) < 2:
        return None
    missed = np.append(0, np.cumsum(quality)) / quality.sum()  # good ones below a cut
    passed = 1 - np.append(0, np.cumsum(1 - quality)) / (1 - quality).sum()  # bad ones above it
    error = missed + passed
    best = np.flatnonzero(error <= error.min() + 1e-12)
    low = np.append(weight[0] - 1, weight)[best]
    high = np.append(weight, weight[-1] + 1)[best]
    widest = int(np.argmax(high - low))
    return float((low[widest] + high[widest]) / 2)


def gumbel(seed: int, *key: str) -> Column:
    """Gumbel noise that depends on the seed and the key columns only."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, few: int = 5_000, bins: int = 1_000) -> float:
    """The exact k-th largest value: bins of the range are counted and the one that holds it is cut again."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while True:
        inside = df.filter(F.col(column).between(low, high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return high
        counts = inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")
        )
        for row in sorted(counts.collect(), key=lambda r: -r.bin):
            if k <= row.n:
                break
            k -= row.n
        if row.lo == row.hi:
            return row.lo
        low, high = row.lo, row.hi
        if row.n <= few:
            return sorted((r[0] for r in df.filter(F.col(column).between(low, high)).select(column).collect()), reverse=True)[k - 1]


def scored(docs: DataFrame, model: Model, seed: int = SEED) -> DataFrame:
    """The documents with ``_log_weight``, ``_n_grams`` and ``_draw`` (log weight plus noise)."""
    key = F.coalesce(F.xxhash64(docs["doc_id"].cast("bigint")), F.xxhash64(docs["text"]))
    out = docs.withColumn("_score", scorer(model.ratio)(docs["text"].cast("string")))
    out = out.withColumns({"_log_weight": F.col("_score.log_weight"), "_n_grams": F.col("_score.n"), "_key": F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"])).otherwise(key)})
    return out.withColumn("_draw", F.col("_log_weight") + gumbel(seed, "_key")).drop("_score", "_key")


def threshold(draws: DataFrame, model: Model, k: int | None = None) -> float | None:
    """The smallest draw that is sampled; None keeps all.  ``draws`` has _log_weight and _draw."""
    if model.divide is None and k is None:
        return None
    if k is None:
        k = draws.filter(F.col("_log_weight") >= model.divide).count()
    n = draws.count()
    return None if k >= n else float("inf") if not k else kth_largest(draws, "_draw", k)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED, sample: int = SAMPLE) -> DataFrame:
    """The documents that are sampled, with all their columns; ``k`` states the size, else it is found."""
    model = learn(docs, labels, sample)
    least = threshold(store.keep(scored(_plain(docs), model, seed).select("_log_weight", "_draw"), "draws"), model, k)
    if least is None:
        return docs
    whole = docs.select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns)).alias("_doc"))
    return scored(whole, model, seed).filter(F.col("_draw") >= least).select("_doc.*")


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels)
    draws = store.keep(scored(_plain(docs), model).select("doc_id", "_log_weight", "_n_grams", "_draw"), "draws")
    least = threshold(draws, model)
    return draws.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"),
        F.col("_n_grams").alias("n_grams"),
        F.col("_log_weight").alias("log_weight"),
        F.col("_draw").alias("draw"),
        (F.lit(True) if least is None else F.col("_draw") >= least).alias("selected"),
    )
