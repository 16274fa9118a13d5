"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters counts as one space, and n-grams of 1 to 3 characters
are hashed into buckets.  A feature is the n-gram's share of the text times its inverse document
frequency; document frequencies are counted over all learnable documents.  The model is trained
with follow-the-regularised-leader and elastic-net penalties on at most ``per_language`` documents
of each language, chosen by a hash of the id, and its scores are calibrated by a temperature fitted
on a fifth of them that was not trained on.

Learnable are rows with a language whose crc32 of the id, modulo 4, is not 2.  Predictions use the
text only.  Defined results: a null text or one without a letter is ``und`` with score 0; without
learnable rows every text is ``und``; ties go to the first language in order; null and repeated ids
are rows of their own; an empty table gives an empty result; extra columns are passed through.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from herdwatch.llm import store
from herdwatch.llm.store import Sendable
from herdwatch.llm.words import keys, mix, parts

BUCKETS, LONGEST = 1 << 15, 3
#: Learned from at most so many documents of each language.
PER_LANGUAGE = 800
#: A language's rows are ranked in so many groups before the groups' first ones meet.
GROUPS = 32
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-3, 1e-3
#: Features are shares of a text; this brings their vectors to a length near one.
SCALE = 10.0


def _letters(kept: list = []) -> np.ndarray:  # noqa: B006 - made once in each process
    if not kept:
        kept.append(np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)]))
    return kept[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, their rows, and which rows have a letter."""
    lowered = [(t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _letters()[points]
    has = np.bincount(row[letter], minlength=len(texts)) > 0
    keep = letter | np.append(True, letter[:-1])
    points, row = np.where(letter, points, 32)[keep].astype(np.uint64), row[keep]
    grams, rows, value = [], [], np.zeros(len(points), np.uint64)
    for n, key in enumerate(keys(LONGEST, 51), 1):
        if len(points) < n:
            break
        value = value[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(1)
        same = row[n - 1 :] == row[: len(points) - n + 1]
        grams.append((mix(value[same] + key) >> np.uint64(32)).astype(np.int64) & (BUCKETS - 1))
        rows.append(row[: len(points) - n + 1][same])
    return np.concatenate(grams or [np.zeros(0, np.int64)]), np.concatenate(rows or [np.zeros(0, np.int64)]), has


@dataclass(frozen=True)
class Model(Sendable):
    languages: list[str]
    #: Per bucket and language: weight times inverse document frequency, over the temperature.
    weights: np.ndarray


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bucket stands, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in parts(batch, "text"):
                grams, row, _ = ngrams(part["text"].to_pylist())
                seen = np.zeros((part.num_rows, BUCKETS), bool)
                seen[row, grams] = True
                total += seen.sum(axis=0)
                n += part.num_rows
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(has, -1)), pa.array(np.append(total[has], n))], names=["bucket", "n"])

    total, n = np.zeros(BUCKETS), 0
    for bucket, found in docs.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        if bucket >= 0:
            total[bucket] = found
        else:
            n = found
    return total, n


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lang, buckets, shares) of each text, with each bucket once."""
    for batch in batches:
        for part in parts(batch, "text"):
            grams, row, _ = ngrams(part["text"].to_pylist())
            both, counts = np.unique(row * BUCKETS + grams, return_counts=True)
            row, bucket = both // BUCKETS, both % BUCKETS
            share = counts / np.bincount(row, counts, part.num_rows)[row]
            ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part["key"], part["lang"], pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(share))],
                names=["key", "lang", "buckets", "shares"],
            )


def _fit(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> np.ndarray:
    """Follow the regularised leader, document by document; weights with exact zeros."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for epoch in range(EPOCHS):
        for i in np.argsort(mix(np.arange(len(rows), dtype=np.uint64) + keys(EPOCHS, 52)[epoch]), kind="stable"):
            label, at, x = rows[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[label] -= 1
            gradient = x[:, None] * p
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - sigma * w
            n[at] += gradient**2
    return weights(slice(None))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which the labels are likeliest.

    Labels are smoothed by one unseen error, as in Platt scaling, so that a sample without errors
    does not make the model certain.
    """
    grid, doubt = np.exp(np.linspace(np.log(0.02), np.log(20), 200)), 1 / (len(labels) + 2)
    log_p = [np.log(np.maximum(_softmax(logits / t), 1e-12)) for t in grid]
    loss = [-((1 - doubt) * p[np.arange(len(labels)), labels] + doubt * p.mean(axis=1)).mean() for p in log_p]
    return float(grid[int(np.argmin(loss))])


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Count document frequencies over all learnable rows and fit the model on the stated sample."""
    store.bounded_batches(docs.sparkSession)
    plain = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    known = plain.filter("lang is not null and text is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    total, n = _frequencies(known)
    if not n:
        return None
    order = [F.xxhash64("doc_id"), "doc_id"]
    # Each language's first rows are found task by task and group by group: no language meets in one task.
    drawn = known.select("doc_id", "lang", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(GROUPS)).alias("group"))
    for group in (["lang", "group"], ["lang"]):
        drawn = drawn.withColumn("at", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("at") <= per_language)
    chosen = known.join(drawn.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id") == F.col("_id")).select(F.xxhash64("doc_id").alias("key"), "lang", "text")
    inverse = np.log((1 + n) / (1 + total)) + 1
    sent = docs.sparkSession.sparkContext.broadcast(inverse)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            for key, lang, at, x in zip(batch["key"].to_pylist(), batch["lang"].to_pylist(), batch["buckets"], batch["shares"], strict=True):
                at = at.values.to_numpy()
                seen.append((key, lang, at, x.values.to_numpy() * sent.value[at] * SCALE))
        seen.sort(key=lambda r: r[:2])
        names = sorted({r[1] for r in seen})
        rows = [(names.index(lang), at, x) for _, lang, at, x in seen]
        late = [r for i, r in enumerate(rows) if i % 5 == 4]
        weights = _fit([r for i, r in enumerate(rows) if i % 5 != 4], len(names))
        logits = np.array([x @ weights[at] for _, at, x in late]).reshape(-1, len(names))
        heat = _temperature(logits, np.array([r[0] for r in late])) if late and len(names) > 1 else 1.0
        final = weights * sent.value[:, None] * SCALE / heat
        has = np.flatnonzero(np.abs(final).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, has)), pa.array([[0.0] * len(names), *final[has].tolist()], pa.list_(pa.float64())), pa.array([json.dumps(names)] * (len(has) + 1))], names=["bucket", "w", "names"])

    # The sample is bounded by its parameter: one task fits the model.
    fitted = chosen.mapInArrow(_featured, "key bigint, lang string, buckets array<int>, shares array<double>").repartition(1)
    found = fitted.mapInArrow(fit, "bucket bigint, w array<double>, names string").collect()
    names = json.loads(found[0].names)
    weights = np.zeros((BUCKETS, len(names)), np.float32)
    for r in found:
        if r.bucket >= 0:
            weights[r.bucket] = r.w
    return Model(names, weights)


def predictor(spark: SparkSession, model: Model | None):
    """A column function text -> (lang, score)."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(column: pa.Array) -> pa.Array:
        names, scores = [], []
        for part in parts(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
            model = sent.value
            if model is None:
                names += ["und"] * part.num_rows
                scores.append(np.zeros(part.num_rows))
                continue
            grams, row, has = ngrams(part["text"].to_pylist())
            total = np.maximum(np.bincount(row, minlength=part.num_rows), 1)
            logits = np.stack([np.bincount(row, model.weights[:, c][grams], part.num_rows) / total for c in range(len(model.languages))], axis=1)
            p = _softmax(logits)
            best = p.argmax(axis=1)
            names += [model.languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
            scores.append(np.where(has, p[np.arange(len(p)), best], 0.0))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]))], names=["lang", "score"])

    return predict


def with_language(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``language``: a struct of lang and score."""
    store.bounded_batches(docs.sparkSession)
    return docs.withColumn("language", predictor(docs.sparkSession, model)(docs[text].cast("string")))


def op5_language_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = with_language(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
