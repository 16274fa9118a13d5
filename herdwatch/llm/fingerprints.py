"""Document fingerprints from closed syncmers, in DataFrame expressions only.

A text is a row of units: runs of letters and digits, lower-cased.  Characters of scripts that are
written without spaces are units of their own, and a run of more than LONG others is cut where the hash of
four successive characters says so, wherever these stand.  A k-mer of units is a closed syncmer if its smallest inner s-mer (by hash) stands at
its beginning or its end (Edgar, 2021).  That depends on the k-mer alone, not on what stands around
it, so equal passages give equal anchors wherever they stand.  The likeness of two texts is the share
of all their distinct anchors that both have; their likeness in order is that of their links, a link
being two successive anchors and the distance of their places.  ``matched_runs`` finds the passages
that texts of an anchor table have in common, by anchors and places.  A fingerprint is all anchors in
order: of each the upper half of its hash, in eight hexadecimal digits, and its distance from the one before
it (from the text's beginning for the first), which is less than ten for k up to 11.  Likenesses are of these
hashes.  A sketch is the ``size`` smallest distinct anchor hashes.

Defined results: a null text counts as empty; an empty text has an empty fingerprint, and two of
these have likeness 1; a text with one anchor has that as its link; a text too short for a syncmer has its units as anchors, one without letters
and digits has the text itself; equal texts have equal fingerprints.  The next document is the one
with the next id; repeated ids follow each other by a hash of the text, null ids come first, and
after the last comes the first.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from herdwatch.llm import store

K, S, SIZE = 4, 2, 64
RUN = r"[\p{L}\p{N}]+"
#: Thai, Lao, Burmese, Khmer, kana and ideographs.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"
#: Longer runs are cut, after one of CUT groups of four characters.
LONG, CUT = 16, 8
#: Documents are put in order in blocks of about so many rows, and in at most so many blocks.
BLOCK_ROWS, MOST_BLOCKS = 256, 10_000


def _cut(run: Column) -> Column:
    """A long run in pieces that depend on the characters around each cut only."""

    def pieces(letters: Column) -> Column:
        n = F.size(letters)
        pairs = F.zip_with(F.slice(letters, 1, n - 1), F.slice(letters, 2, n - 1), lambda x, y: F.xxhash64(x, y))
        fours = F.zip_with(F.slice(pairs, 1, n - 3), F.slice(pairs, 3, n - 3), lambda x, y: F.xxhash64(x, y))
        marked = F.zip_with(letters, fours, lambda c, h: F.when(h % CUT == 0, F.concat(c, F.lit(" "))).otherwise(c))
        return F.split(F.array_join(marked, ""), " ")

    return F.get(F.transform(F.array(F.split(run, "")), pieces), 0)


def with_units(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the units of ``text``."""
    low, runs = f"_t_{out}", f"_r_{out}"
    df = df.withColumn(low, F.lower(text))
    apart = F.when(F.col(low).rlike(UNSPACED), F.regexp_replace(low, UNSPACED, " $0 ")).otherwise(F.col(low))
    found = F.regexp_extract_all(apart, F.lit(RUN), F.lit(0))
    df = df.withColumn(runs, F.coalesce(found, F.array().cast("array<string>")))
    cut = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > LONG, _cut(r)).otherwise(F.array(r))))
    return df.withColumn(out, F.when(F.exists(runs, lambda r: F.length(r) > LONG), cut).otherwise(F.col(runs))).drop(low, runs)


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """Add ``out``: the anchors of ``text`` as (h, at), ``at`` being the unit where each begins."""
    u, w, m = f"_u_{out}", k - s + 1, f"_m_{out}"
    n = F.size(u)
    df = with_units(df, text, u)
    df = df.withColumn(u, F.transform(u, lambda x: F.xxhash64(x)))
    smers = F.col(u)
    for shift in range(1, s):
        smers = F.zip_with(F.slice(smers, 1, n - shift), F.slice(u, 1 + shift, n - shift), lambda x, y: F.xxhash64(x, y))
    df = df.withColumn(m, F.when(n >= k, smers))
    least, size = F.col(m), F.size(m)
    for shift in range(1, w):
        least = F.zip_with(F.slice(least, 1, size - shift), F.slice(m, 1 + shift, size - shift), lambda x, y: F.least(x, y))
    df = df.withColumn(f"_l_{out}", least)
    chosen = F.transform(f"_l_{out}", lambda x, i: F.when((F.get(m, i) == x) | (F.get(m, i + (w - 1)) == x), i))
    starts = F.filter(chosen, lambda i: i.isNotNull())
    syncmers = F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(u, i + 1, k)).alias("h"), i.alias("at")))
    df = df.withColumn(out, F.when(n >= k, syncmers))
    single = F.transform(u, lambda x, i: F.struct(x.alias("h"), i.alias("at")))
    whole = F.when(F.length(text) > 0, F.array(F.struct(F.xxhash64(F.lit("text"), text).alias("h"), F.lit(0).alias("at"))))
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    short = F.when(n > 0, single).otherwise(F.coalesce(whole, none))
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(short)).drop(u, m, f"_l_{out}")


def distinct_hashes(anchors: str) -> Column:
    """What fingerprints hold of the hashes, each once."""
    return F.array_distinct(F.transform(anchors, lambda a: F.shiftrightunsigned(a["h"], 32)))


def as_text(anchors: str) -> Column:
    """The fingerprint: all anchors with their places, nine digits each."""

    def digits(a: Column, i: Column) -> Column:
        before = F.coalesce(F.get(F.col(anchors), i - 1)["at"], F.lit(0))
        return F.concat(F.lpad(F.hex(F.shiftrightunsigned(a["h"], 32)), 8, "0"), (a["at"] - before).cast("string"))

    return F.array_join(F.transform(anchors, digits), "")


def links(anchors: str) -> Column:
    """Distinct hashes of every two successive anchors with the distance between them."""
    a, n = F.col(anchors), F.size(anchors)
    both = F.zip_with(F.slice(a, 1, n - 1), F.slice(a, 2, n - 1), lambda x, y: F.xxhash64(x["h"], y["h"], y["at"] - x["at"]))
    return F.when(n > 1, F.array_distinct(both)).otherwise(distinct_hashes(anchors))


def sketch(hashes: str | Column, size: int = SIZE) -> Column:
    """The smallest of distinct hashes."""
    return F.slice(F.array_sort(hashes), 1, size)


def likeness(a: str, b: str) -> Column:
    """Share of the hashes of two arrays, each distinct, that both have."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every).cast("double")


def anchor_table(docs: DataFrame, key: str = "doc_id", anchors: str = "anchors") -> DataFrame:
    """(key, i, h, at): one row per anchor, ``i`` being its number in the text; anchors are made once."""
    return store.keep(docs.select(key, anchors), "anchors").select(key, F.posexplode(anchors).alias("i", "a")).select(key, "i", "a.h", "a.at")


def matched_runs(left: DataFrame, right: DataFrame, key: str = "doc_id", least: int = 1) -> DataFrame:
    """(left, right, offset, first, last, n): runs of at least ``least`` successive anchors of one text
    that stand in another one too, all moved by ``offset`` units; ``first`` and ``last`` are the places
    in the left text where the run's anchors begin.

    ``left`` and ``right`` are anchor tables; all occurrences meet, those of a text with itself too.
    """
    one, two = left.select(F.col(key).alias("left"), "i", "h", F.col("at").alias("first")), right.select(F.col(key).alias("right"), "h", "at")
    met = one.join(two, "h").select("left", "right", (F.col("at") - F.col("first")).alias("offset"), "i", "first")
    inside = Window.partitionBy("left", "right", "offset").orderBy("i")
    runs = met.withColumn("_run", F.col("i") - F.row_number().over(inside)).groupBy("left", "right", "offset", "_run")
    found = runs.agg(F.min("first").alias("first"), F.max("first").alias("last"), F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") >= least).drop("_run")


def in_blocks(docs: DataFrame) -> DataFrame:
    """Add ``_block``: documents in order of ``doc_id`` are in blocks of ascending number.

    Bounds are quantiles of the ids, of which at most MOST_BLOCKS reach the driver; a row finds its
    block among the bounds in two steps.
    """
    rows = docs.count()
    blocks = min(MOST_BLOCKS, max(1, rows // BLOCK_ROWS))
    shares = [i / blocks for i in range(1, blocks)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * blocks)).first()[0] if shares else None
    bounds = sorted(set(found or []))
    if not bounds:
        return docs.withColumn("_block", F.lit(0))
    step = isqrt(len(bounds)) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*(F.lit(g[0]).cast("bigint") for g in groups))
    table = F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    coarse = F.greatest(F.size(F.filter(heads, lambda x: x <= F.col("doc_id"))), F.lit(1))
    docs = docs.withColumn("_coarse", F.when(F.col("doc_id").isNotNull(), coarse).otherwise(1))
    fine = F.size(F.filter(F.element_at(table, F.col("_coarse")), lambda x: x <= F.col("doc_id")))
    return docs.withColumn("_block", (F.col("_coarse") - 1) * step + F.when(F.col("doc_id").isNull(), 0).otherwise(fine)).drop("_coarse")


def with_next(docs: DataFrame, columns: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add ``next_<column>`` of the following document; ``docs`` has doc_id and text.

    ``prepare`` adds columns to rows that are already dealt to their blocks, so that these are not shuffled.

    Each block's first document is copied to the end of the block before, so that no block needs
    another one.
    """
    blocked = in_blocks(docs).withColumn("_hash", F.xxhash64("text"))
    first = blocked.groupBy("_block").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_hash")).alias("f"))
    around = Window.orderBy("_block")
    # At most MOST_BLOCKS rows: the block before each, and for the first one the last.
    first = first.select("_block", F.col("f.doc_id").alias("_id"), F.col("f._hash").alias("_h"), F.lag("_block").over(around).alias("_before"), F.max("_block").over(Window.partitionBy()).alias("_last"))
    first = first.select(F.coalesce("_before", "_last").alias("_to"), "_id", "_h")
    copies = blocked.join(F.broadcast(first), blocked["doc_id"].eqNullSafe(first["_id"]) & (blocked["_hash"] == first["_h"]))
    copies = copies.withColumn("_block", F.col("_to")).select(*blocked.columns).dropDuplicates(["_block"])
    every = blocked.withColumn("_copy", F.lit(0)).unionByName(copies.withColumn("_copy", F.lit(1)))
    more: list[str] = []
    if prepare is not None:
        dealt = every.repartition("_block").sortWithinPartitions("_block", "_copy", "doc_id", "_hash")
        every = prepare(dealt)
        more = [c for c in every.columns if c not in dealt.columns]
    order = Window.partitionBy("_block").orderBy("_copy", "doc_id", "_hash")
    out = every.withColumn("_next", F.lead(F.struct(*columns)).over(order)).filter("_copy = 0")
    return out.select(*docs.columns, *more, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """(doc_id, text, anchors, fingerprint, hashes): the anchors, the fingerprint and the sketch of every text."""
    found = with_anchors(_plain(docs), "text", "anchors", k, s).withColumn("hashes", distinct_hashes("anchors"))
    return found.withColumns({"fingerprint": as_text("anchors"), "hashes": sketch("hashes", size)})


def _compared(rows: DataFrame) -> DataFrame:
    """Add the text's ``fingerprint``, and ``all`` and ``links``, which likenesses are computed from."""
    found = with_anchors(rows, "text", "anchors")
    return found.withColumns({"fingerprint": as_text("anchors"), "all": distinct_hashes("anchors"), "links": links("anchors")}).drop("anchors")


def op7_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _plain(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = with_next(docs, ["text", "all", "links"], _compared)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - quarter), F.left("next_text", quarter))
    rows = with_anchors(rows.withColumn("edited", edited), "edited", "edited_anchors")
    rows = rows.withColumns({"edited_all": distinct_hashes("edited_anchors"), "edited_links": links("edited_anchors")})
    return rows.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        as_text("edited_anchors").alias("edited_fingerprint"),
        likeness("all", "edited_all").alias("near_edited"),
        likeness("all", "next_all").alias("near_next"),
        likeness("links", "edited_links").alias("in_order_edited"),
        likeness("links", "next_links").alias("in_order_next"),
    )
