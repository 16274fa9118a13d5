"""Digests, proofs and tampering against a plain version."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from herdwatch.llm import manifest
from tests.llm.data import frame, plain, rows


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: tuple) -> str:
    doc_id, text, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def runs(nodes: list[str]) -> list[list[list[str]]]:
    """The runs of every level, from the leaves on."""
    out = []
    while len(nodes) > 1:
        out.append([nodes[i : i + 8] for i in range(0, len(nodes), 8)])
        nodes = [sha("".join(r)) for r in out[-1]]
    return out


def expected(data: list[tuple]) -> Counter:
    """(doc_id, leaf, subroot, root, proof, folded root) of every row."""
    groups: dict = {}
    for row in data:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: runs([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    subs = [sha("".join(trees[g][-1][0])) if trees[g] else groups[g][0][2] for g in names]
    out: Counter = Counter()
    for place, g in enumerate(names):
        for rank, (_, _, own, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            low = row[1] and "".join(c.lower() if c.isascii() else c for c in row[1])
            acc, proof, at = leaf((row[0], low, *row[2:])) if hit else own, "", rank
            for level in trees[g]:
                run = level[at // 8]
                before, after = run[: at % 8], run[at % 8 + 1 :]
                proof += "".join(before + after)
                acc, at = sha("".join([*before, acc, *after])), at // 8
            proof += "".join(subs[:place] + subs[place + 1 :])
            acc = sha("".join([*subs[:place], acc, *subs[place + 1 :]]))
            out[(row[0], own, subs[place], sha("".join(subs)), sha(proof), acc)] += 1
    return out


def found(spark, docs) -> Counter:
    now = manifest.leaf_digest([manifest.tampered_text(docs) if c == "text" else docs[c] for c in manifest.COLUMNS])
    made = manifest.build(docs, carry={"doc_id": docs["doc_id"], "now": now})
    proofs = manifest.prove(made, made.leaves.select("_g", "rank", "doc_id", "now"))
    out = proofs.select(
        "doc_id", *(manifest.hexed(F.col(c)) for c in ("digest", "subroot", "root")),
        F.sha2(F.array_join(F.transform("path", manifest.hexed), ""), 256),
        manifest.folded(manifest.hexed(F.col("now")), F.col("path"), F.col("rank"), F.col("place")),
    )
    return Counter(map(tuple, out.collect()))


def test_proofs_equal_a_plain_version(spark):
    """Null and repeated ids, null and lone groups, empty texts, clashing columns, equal rows on many places."""
    data = rows(150) + [(9000, "alone", "zz", "s", 5)] + [(7, "the same row", "en", "s", 1)] * 70
    assert found(spark, frame(spark, data)) == expected(data)


def test_one_document_and_none(spark):
    one = [(4, "Only One", "en", None, None)]
    assert found(spark, frame(spark, one)) == expected(one)
    docs = plain(spark, ["x"]).limit(0)
    assert found(spark, docs) == Counter()


def test_requests_for_some_leaves_and_for_none_that_exist(spark):
    data = [(i, f"text {i}", "en" if i % 3 else "de", "s", i) for i in range(100)]
    made = manifest.build(frame(spark, data))
    asked = spark.createDataFrame([("=en", 0, "a"), ("=en", 65, "b"), ("=de", 33, "c"), ("=en", 66, "none"), ("=en", 5000, "none"), ("=xx", 0, "none")], "_g string, rank bigint, tag string")
    proofs = manifest.prove(made, asked)
    good = manifest.folded(manifest.hexed(F.col("digest")), F.col("path"), F.col("rank"), F.col("place")) == manifest.hexed(F.col("root"))
    leaves = {(r._g, r["rank"]): r.digest for r in made.leaves.collect()}
    got = proofs.select("*", good.alias("good")).collect()
    assert sorted(r.tag for r in got) == ["a", "b", "c"]
    assert all(r.good and r.digest == leaves[r._g, r["rank"]] for r in got)


def test_a_field_cannot_pass_for_its_neighbour(spark):
    a, b = [(1, "t", "en", "ab", 1)], [(1, "t", "ben", "a", 1)]
    assert set(found(spark, frame(spark, a))) != set(found(spark, frame(spark, b)))
