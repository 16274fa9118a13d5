"""Merkle dataset manifest: a content-addressed graph of digests, and proofs found by descending it.

Every row is a leaf, the digest of its encoded columns.  Per group (a language) leaves are numbered by
their id; each run of eight neighbours becomes one node, until one is left; the groups' last nodes
become the root.  What is stored are records from a node's digest to its children, 32 bytes each,
one after the other, a table for each level.

A proof request names a leaf by group and rank.  Requests go down together: the root's record gives
the groups' nodes, a node's record gives its children, the rank's digits in base eight choose among
them, and what is not chosen is collected on the way.  Requests with the same digits so far are one
row, so the top levels have few rows and the last one has one for eight leaves.  The collected
segments, reversed, are the proof.

Defined results: a null column is told from an empty one; leaves of one id are ordered by their
digest, and rows that are equal in all columns take any of their neighbouring places; null ids come
first, a null group is a group of its own and comes first; an empty table has no root and gives no
proofs.  Ids may be of any type that has an order.  Extra columns are ignored, whatever their names.
The root's record has a digest for every group, and so has the last segment of each proof: groups are
meant to be as few as languages.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from herdwatch.llm import store

#: Children of a node: 8, three binary digits of a rank.
BITS = 3
WIDTH = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """A value with its length in bytes, so that neighbours can't run into one another; ``-`` if null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, values)), 256))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def node_digest(children: Column) -> Column:
    """Digest of a node from its children's bytes; digests are hashed as hexadecimal text."""
    return F.unhex(F.sha2(hexed(children), 256))


def _joined(pairs: Column, field: str = "digest") -> Column:
    """The digests of sorted pairs, one after the other."""
    return F.aggregate(pairs, F.lit(b""), lambda acc, p: F.concat(acc, p[field]))


def _child(children: Column, digit: Column) -> Column:
    return F.substr(children, digit * WIDTH + 1, F.lit(WIDTH))


def _others(children: Column, digit: Column) -> Column:
    return F.concat(F.substr(children, F.lit(1), digit * WIDTH), F.substr(children, (digit + 1) * WIDTH + 1, F.octet_length(children)))


def _up(column: str, levels: int = 1) -> Column:
    return F.shiftright(column, BITS * levels)


@dataclass
class Manifest:
    """``leaves`` (_g, rank, n, digest and what was carried), ``records`` (digest, children) by level from
    the lowest, and ``tops`` (_g, place, digest, depth, root, children): the groups as the root's record has them."""

    leaves: DataFrame
    records: list[DataFrame]
    tops: DataFrame


def _ranked(rows: DataFrame) -> DataFrame:
    """Number the rows of each group by key and digest, without a group meeting in one task.

    Rows are dealt by range and written in order; what a row's part of a group has before it is a sum
    over parts, of which there are as many as tasks and groups.
    """
    order = ["_g", "_key", "digest", "_rid"]
    placed = store.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "leaves")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("_g", "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy("_g")
    before = F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_g", "_part", "_from", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(group).alias("n"))
    rank = (F.col("_at") - F.col("_from") + F.col("_before")).alias("rank")
    return placed.join(parts, ["_g", "_part"]).select("_g", rank, "n", *(c for c in rows.columns if c not in ("_g", "_rid")))


def build(docs: DataFrame, group: str = "lang", key: str = "doc_id", columns: tuple[str, ...] = COLUMNS, carry: dict[str, Column] | None = None) -> Manifest:
    """Write the leaves and the records of all levels; ``carry`` adds columns of ``docs`` to the leaves."""
    name = F.concat(F.lit("="), docs[group].cast("string"))
    rows = docs.select(
        F.coalesce(name, F.lit("-")).alias("_g"),
        docs[key].alias("_key"),
        leaf_digest([docs[c] for c in columns]).alias("digest"),
        F.monotonically_increasing_id().alias("_rid"),
        *(c.alias(n) for n, c in (carry or {}).items()),
    )
    leaves = store.keep(_ranked(store.keep(rows, "rows")), "ranked")
    level, records, tops = leaves.select("_g", F.col("rank").alias("at"), "n", "digest"), [], []
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        tops.append(level.filter("n = 1").select("_g", "digest", F.lit(len(records)).alias("depth")))
        if most <= 1:
            break
        pairs = F.array_sort(F.collect_list(F.struct("at", "digest")))
        runs = level.filter("n > 1").groupBy("_g", "n", _up("at").alias("up")).agg(_joined(pairs).alias("children"))
        n = F.expr(f"(n + {(1 << BITS) - 1}) div {1 << BITS}").alias("n")
        level = store.keep(runs.select("_g", F.col("up").alias("at"), n, node_digest(F.col("children")).alias("digest"), "children"), f"level-{len(records) + 1}")
        # Runs of equal content have one record.
        records.append(level.groupBy("digest").agg(F.first("children").alias("children")))
        level, most = level.drop("children"), -(-most >> BITS)
    groups = F.array_sort(F.collect_list(F.struct("_g", "digest", "depth"))).alias("groups")
    top = reduce(DataFrame.unionByName, tops).agg(groups).select("groups", _joined(F.col("groups")).alias("children"))
    top = top.select("children", node_digest(F.col("children")).alias("root"), F.posexplode("groups").alias("place", "top"))
    return Manifest(leaves, records, store.keep(top.select("top.*", "place", "root", "children"), "tops"))


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (_g, rank and any other columns) with digest, path, place, subroot and root.

    ``path`` has a segment for each level from the leaf's run to the root: the digests of the other
    nodes there.  Ranks that no leaf has give no row.
    """
    # The runs of leaves that are asked for, then the nodes over them, level by level.
    wanted = [store.keep(requests.select("_g", _up("rank").alias("prefix")).distinct(), "wanted")]
    for _ in manifest.records[1:]:
        wanted.append(wanted[-1].select("_g", _up("prefix").alias("prefix")).distinct())
    top = manifest.tops.join(requests.select("_g").distinct(), "_g", "left_semi")
    fixed = ["_g", "place", "subroot", "root"]
    top = top.select(
        "_g", "place", F.col("digest").alias("subroot"), "root", "depth", "digest", F.lit(0).cast("bigint").alias("prefix"),
        F.array(_others(F.col("children"), F.col("place"))).alias("path"),
    )
    nodes = None
    for level in range(len(manifest.records), 0, -1):
        here = top.filter(F.col("depth") == level).select(*fixed, "prefix", "digest", "path")
        nodes = here if nodes is None else nodes.unionByName(here)
        opened = nodes.join(manifest.records[level - 1], "digest").drop("digest")
        if level == 1:
            nodes = opened
            break
        digit = F.col("digit")
        chosen = opened.withColumn("digit", F.explode(F.sequence(F.lit(0), (F.octet_length("children") / WIDTH).cast("int") - 1)))
        chosen = chosen.select(
            *fixed, (F.col("prefix") * (1 << BITS) + digit).alias("prefix"), _child(F.col("children"), digit).alias("digest"),
            F.concat(F.array(_others(F.col("children"), digit)), F.col("path")).alias("path"),
        )
        nodes = store.keep(chosen.join(wanted[level - 2], ["_g", "prefix"], "left_semi"), f"descent-{level - 1}")
    # A group of one leaf has no record: the leaf is the group's node.
    lone = top.filter("depth = 0").select(*fixed, "prefix", "path", F.lit(None).cast("binary").alias("children"))
    runs = (lone if nodes is None else lone.unionByName(nodes)).withColumnRenamed("prefix", "_run")
    digit = F.col("rank").bitwiseAND((1 << BITS) - 1).cast("int")
    found = requests.withColumn("_run", _up("rank")).join(runs, ["_g", "_run"])
    found = found.filter(F.coalesce(digit * WIDTH < F.octet_length("children"), F.col("rank") == 0))
    return found.select(
        *(found[c] for c in requests.columns),
        F.when(F.col("children").isNull(), F.col("subroot")).otherwise(_child(F.col("children"), digit)).alias("digest"),
        F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat(F.array(_others(F.col("children"), digit)), F.col("path"))).alias("path"),
        "place", "subroot", "root",
    )


def folded(leaf: Column, path: Column, rank: Column, place: Column) -> Column:
    """The root, as hexadecimal text, that a leaf (likewise) and its proof lead to."""

    def up(acc: Column, level: Column) -> Column:
        others = hexed(F.get(path, level))
        digit = F.call_function("shiftright", rank, level * BITS).bitwiseAND((1 << BITS) - 1).cast("int")
        at = F.when(level == F.size(path) - 1, place).otherwise(digit) * (2 * WIDTH)
        return F.sha2(F.concat(F.substr(others, F.lit(1), at), acc, F.substr(others, at + 1, F.length(others))), 256)

    return F.aggregate(F.sequence(F.lit(0), F.size(path) - 1), leaf, up)


def tampered_text(docs: DataFrame) -> Column:
    """The text with A-Z lower-cased where 3 divides the id's crc32, else as it is."""
    hit = F.crc32(docs["doc_id"].cast("string")) % 3 == 0
    return F.when(hit, F.translate(docs["text"], UPPER, LOWER)).otherwise(docs["text"])


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and whether its text as found now still leads to the root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(docs["doc_id"].cast("string")) % 3 == 0
    now = leaf_digest([tampered_text(docs) if c == "text" else docs[c] for c in COLUMNS])
    manifest = build(docs, carry={"doc_id": docs["doc_id"], "now": F.when(hit, now)})
    proofs = prove(manifest, manifest.leaves.select("_g", "rank", "doc_id", "now"))
    leaf = hexed(F.coalesce("now", "digest"))
    whole = F.array_join(F.transform("path", hexed), "")
    return proofs.select(
        "doc_id",
        hexed(F.col("digest")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        F.sha2(whole, 256).alias("proof_sha256"),
        folded(leaf, F.col("path"), F.col("rank"), F.col("place")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
