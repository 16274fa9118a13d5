"""Segmentations, languages, toxicity, quality, fingerprints and revisits against plain versions."""

from __future__ import annotations

import gzip
import hashlib
import math
import os
import random
import struct
import subprocess
import sys
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from herdwatch.llm import fingerprints, language, lattice, pieces, quality, toxicity, warc
from tests.llm.data import frame, plain, prose, rows

needs_model = pytest.mark.skipif(not Path(pieces.MODEL).exists(), reason="the tokenizer is not here")

# Executors without the package

AWAY = """
import sys
sys.path.insert(0, {repo!r})
from herdwatch.session import build_session
spark = build_session(master="local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false", spark__checkpoint__dir={shared!r})
from herdwatch.llm import decontamination, language, ngram_model, pieces, quality, ranked, toxicity
try:
    spark.range(1).mapInArrow(lambda batches: __import__("herdwatch") and batches, "id bigint").count()
    print("the package is there")
except Exception:
    pass
docs = spark.read.parquet({docs!r})
labels = docs.selectExpr("doc_id", "doc_id % 2 as toxic", "doc_id % 2 as quality")
items = docs.limit(3).selectExpr("cast(doc_id as string) as item_id", "text")
print("language", language.with_language(docs, language.learn(docs)).select("language.lang").distinct().count())
print("toxicity", toxicity.with_toxicity(docs, toxicity.learn(docs, labels)).count())
print("quality", quality.resample(docs, labels).count() > 0)
print("decontamination", decontamination.contamination(docs, items).count())
print("ranked", ranked.rank(docs, items).count() > 0)
print("scores", ngram_model.score_documents(docs, docs["doc_id"] > 3).count())
if {model}:
    print("pieces", pieces.with_samples(docs.select("doc_id", "text")).count())
"""


def test_workers_need_no_package(spark, tmp_path):
    """A session started elsewhere, whose workers can't import the package, runs every operator that sends objects."""
    docs = plain(spark, [t for _, t, *_ in rows(30)[:30]]).selectExpr("doc_id", "text", "case when doc_id % 2 = 0 then 'a,b' else 'c' end as lang")
    docs.write.parquet(str(tmp_path / "docs"))
    n = docs.count()
    script = AWAY.format(repo=str(Path(__file__).parents[2]), shared=str(tmp_path / "shared"), docs=str(tmp_path / "docs"), model=Path(pieces.MODEL).exists())
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    said = dict(line.split() for line in out.stdout.splitlines() if len(line.split()) == 2)
    assert "the package is there" not in out.stdout
    expected = {"language": "2", "toxicity": str(n), "quality": "True", "decontamination": str(n), "ranked": "True", "scores": str(n)}
    assert said.items() >= expected.items(), out.stderr[-2000:]
    assert not Path(pieces.MODEL).exists() or said["pieces"] == str(n)


def test_a_language_with_a_comma(spark):
    docs = plain(spark, [prose(random.Random(i), "en" if i % 2 else "de", 40) for i in range(40)])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en,us").otherwise('d"e, 1'))
    model = language.learn(docs)
    assert sorted(model.languages) == ['d"e, 1', "en,us"]
    got = language.with_language(docs, model).select("lang", "language.lang").collect()
    assert sum(a == b for a, b in got) >= 38


# SentencePiece


@needs_model
def test_samples_decode_to_the_text(spark):
    texts = [t.replace("▁", "_") if t else t for _, t, *_ in rows(20)] + ["a\u0000b ñandú 日本 😀  two  spaces ", " ", "\n\n"]
    docs = pieces.with_samples(plain(spark, texts), k=3)
    decode = pieces.decoder(spark)
    back = docs.select("doc_id", F.posexplode("samples").alias("i", "s")).select("doc_id", "i", decode("s.pieces").alias("t"), "s.*").collect()
    seen = defaultdict(set)
    for r in back:
        assert r.t == (texts[r.doc_id] or "")
        assert 0 <= r.inclusion <= 1 and r.score <= 1e-9
        assert tuple(r.pieces) not in seen[r.doc_id]
        seen[r.doc_id].add(tuple(r.pieces))
    assert len(seen) == len(texts)
    single = pieces.encoder()
    assert all(decoded == (texts[i] or "") for i, decoded in docs.select("doc_id", decode(single("text"))).collect() if texts[i])


def segmentations(vocabulary, text):
    """All segmentations of a marked text into pieces, with their weights."""
    weight = {p: vocabulary.weight[i] for i, p in enumerate(vocabulary.pieces) if p}
    if not text:
        return [((), 0.0)]
    out = []
    for n in range(1, len(text) + 1):
        if text[:n] in weight:
            out += [((text[:n], *rest), weight[text[:n]] + w) for rest, w in segmentations(vocabulary, text[n:])]
    return out


@needs_model
def test_sampling_is_without_replacement_in_the_lattice_distribution():
    vocabulary = lattice.Vocabulary(pieces.MODEL).open()
    text, n = "the ab", 6000
    every = segmentations(vocabulary, "▁the▁ab")
    total = math.log(sum(math.exp(w * 0.3) for _, w in every))
    expected = {s: math.exp(w * 0.3 - total) for s, w in every}
    keys = lattice.mix(np.arange(n, dtype=np.uint64))
    counts, ids, begins, score, inclusion = pieces.sample_texts(vocabulary, [text] * n, keys, 2, 0.3)
    got = [tuple(vocabulary.pieces[i] for i in ids[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]
    assert counts == [2] * n
    first = Counter(got[::2])
    both = Counter(zip(got[::2], got[1::2], strict=True))
    for s, p in expected.items():
        assert abs(first[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2 / n
    for a, b in product(expected, repeat=2):
        p = 0 if a == b else expected[a] * expected[b] / (1 - expected[a])
        assert abs(both[a, b] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2 / n
    assert all(abs(math.exp(s) - expected[g]) < 1e-9 for s, g in zip(score[:50], got[:50], strict=True))
    # Weighted by inclusion the samples estimate the whole: probabilities sum to one.
    estimate = sum(math.exp(s) / i for s, i in zip(score, inclusion, strict=True)) / n
    assert abs(estimate - 1) < 0.1


@needs_model
def test_a_text_with_few_segmentations_gives_all_of_them():
    vocabulary = lattice.Vocabulary(pieces.MODEL).open()
    every = segmentations(vocabulary, "▁ab")
    counts, _, _, score, inclusion = pieces.sample_texts(vocabulary, ["ab", "", None], np.zeros(3, np.uint64), 50, 1.0)
    assert counts == [len(every), 1, 1] and inclusion[-1] == 1.0
    assert abs(sum(math.exp(s) for s in score[: len(every)]) - 1) < 1e-6


@needs_model
def test_samples_depend_on_key_and_text_only(spark):
    docs = plain(spark, [t for _, t, *_ in rows(12)])
    one = dict(pieces.with_samples(docs).select("doc_id", "samples").collect())
    two = dict(pieces.with_samples(docs.repartition(5)).select("doc_id", "samples").collect())
    assert one == two
    assert pieces.with_samples(frame(spark)).count() == len(rows())
    assert pieces.with_samples(frame(spark).limit(0)).count() == 0


# Language


def test_languages_are_learned_and_und_is_for_texts_without_letters(spark):
    data = [(i, t, g, s, n) for i, t, g, s, n in rows(150, seed=4)]
    docs = frame(spark, data)
    model = language.learn(docs, per_language=60)
    assert model.languages == ["de", "en", "fr"]
    assert 0 < np.mean(model.weights == 0) < 1
    out = language.with_language(docs, model).select("text", "lang", "language.*").collect()
    columns = [(t, g, p, s) for t, g, p, s in out]
    known = [(g, p) for t, g, p, _ in columns if g and t and len(t) > 60]
    assert np.mean([g == p for g, p in known]) > 0.95
    for text, _, predicted, score in columns:
        assert 0 <= score <= 1 and (predicted == "und") == (not any(c.isalpha() for c in text or ""))
    nothing = language.learn(docs.limit(0))
    assert nothing is None and {r[0] for r in language.with_language(docs, nothing).select("language.lang").collect()} == {"und"}


# Toxicity


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    terms = ["idiot", "scum", "worthless", "abc", "vejuté"]
    automaton = toxicity.Automaton(terms)
    words = set(terms)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "i", "z", "é", "t"])
            word = list("".join(word)) or ["q"]
        words.add("".join(word))
    words = sorted(words)
    raw, offsets = toxicity.text_bytes(pa.array([" ".join(words)]))
    starts, ends, _ = toxicity.spans(toxicity.ALNUM[raw], offsets)
    got = automaton.edits(toxicity.ALNUM[raw], starts, ends)
    for word, edits in zip(words, got, strict=True):
        near = [d for t in terms if (d := distance(word.encode(), t.encode())) <= toxicity.edits_allowed(t.encode())]
        assert edits == min(near, default=-1), word


def test_toxicity_is_learned_with_misspellings_and_quotations(spark):
    rng = random.Random(9)
    terms, data, labels = ["gribbelfant", "snorkwits", "plomdoof"], [], []
    for i in range(400):
        text, bad = prose(rng, "en", 40).split(), rng.random() < 0.3
        for _ in range(2 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(terms))
        data.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    docs = frame(spark, data)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(docs, known)
    assert set(terms) <= set(model.terms)
    assert [toxicity.edits_allowed(t.encode()) for t in terms] == [2, 2, 1]
    tests = ["you " + prose(rng, "en", 20) + " snorkwitz gribelfant " + prose(rng, "en", 5), f'the word "snorkwits" {prose(rng, "en", 20)}', prose(rng, "en", 30), None, ""]
    score = [r[0] for r in toxicity.with_toxicity(plain(spark, tests), model).orderBy("doc_id").select("toxicity").collect()]
    assert score[0] >= 0.3 > max(score[2:]) and score[1] < score[0]
    held = {r.doc_id: r.toxicity for r in toxicity.with_toxicity(docs, model).filter("crc32(cast(doc_id as string)) % 4 = 2").select("doc_id", "toxicity").collect()}
    assert all((held[i] >= 0.3) == bool(t) for i, _, t in labels if i in held)
    empty = toxicity.learn(docs, known.limit(0))
    assert {r[0] for r in toxicity.with_toxicity(frame(spark), empty).select("toxicity").collect()} == {0.0}


def test_large_lexicons_equal_edit_distance():
    rng = random.Random(8)
    terms = sorted({"".join(rng.choice("abcdeft") for _ in range(rng.randint(2, 7))) for _ in range(120)})
    words = sorted({"".join(rng.choice("abcdeft") for _ in range(rng.randint(1, 8))) for _ in range(300)} | set(terms))
    raw, offsets = toxicity.text_bytes(pa.array([" ".join(words)]))
    starts, ends, _ = toxicity.spans(raw, offsets)
    lexicon = toxicity.Lexicon(terms, 25)
    assert len(lexicon.automata) == -(-len(terms) // 25)
    for word, edits in zip(words, lexicon.edits(raw, starts, ends), strict=True):
        near = [d for t in terms if (d := distance(word.encode(), t.encode())) <= toxicity.edits_allowed(t.encode())]
        assert edits == min(near, default=-1), word


def test_lexicon_has_short_rare_and_many_terms(spark):
    rng = random.Random(10)
    many = [f"t{i:03d}x" for i in range(1000)]
    data = []
    for i in range(2000):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(30)]
        bad = i % 2
        if bad:
            words += rng.sample(many, 60) + [f"w{rng.randint(0, 3000)}", "zog"]
            rng.shuffle(words)
        # Few of the toxic ones, and one document that repeats a word.
        words += ["rarely"] * (bad and i % 80 == 1) + ["burst", f"w{i}"] * (40 if i == 1 else 0)
        data.append((" ".join(words), bad))
    data += [("here is copied text", 1)] * 300
    chosen = spark.createDataFrame(data, "text string, toxic bigint")
    found = toxicity.lexicon(chosen, 1000, 1300)
    assert {"zog", "rarely", *many} <= set(found) and not {"burst", "copied"} & set(found)
    assert len(found) <= len(many) + 4


def test_quotations_have_marks_near_the_find():
    cases = {
        'a 3.5" disk, you idiot': [False], 'a 3.5" disk and "idiot" then idiot': [True, False], '"idiot': [False], 'idiot"': [False],
        "\u201cidiot\u201d idiot \u201eidiot\u201c \u00abidiot\u00bb": [True, False, True, True], '("idiot.") idiot': [True, False],
        '"' + "a " * 200 + 'idiot"': [False], '"one" idiot "two"': [False], '"an idiot he said" idiot': [True, False],
    }
    raw, offsets = toxicity.text_bytes(pa.array([*cases, '"', 'idiot"']))
    data = toxicity._separated(raw)
    starts, ends, first = toxicity.spans(data, offsets)
    at = np.array([a for a, b in zip(starts, ends, strict=True) if data[a:b].tobytes() == b"idiot"])
    got = toxicity._quoted(raw, offsets, at)
    assert got.tolist() == [q for expected in cases.values() for q in expected] + [False]


def plain_features(terms, text):
    """Finds, with one edit, with two, quoted, addressed; words."""
    words = [w for w in regex.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower()) if w]
    out = [0] * 5
    for i, word in enumerate(words):
        edits = [d for t in terms if (d := distance(word.encode(), t.encode())) <= toxicity.edits_allowed(t.encode())]
        if not edits:
            continue
        if f'"{word}"' in text.lower():
            out[3] += 1
            continue
        out[0] += 1
        out[1] += min(edits) == 1
        out[2] += min(edits) == 2
        out[4] += any(w in toxicity.ADDRESS for w in words[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1])
    return [x.bit_length() for x in out] + [int(math.log10(max(len(words), 1)))]


def test_features_and_score_equal_a_plain_version(spark):
    rng = random.Random(13)
    terms = ["gribbelfant", "zog", "plomdoof"]
    forms = ["gribbelfant", "gribelfant", "gribblfnt", "zog", "zig", "plomdof", '"plomdoof"', "you", "Tú", "ZOG"]
    texts = [" ".join(rng.choice(forms) if rng.random() < 0.2 else f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 60))) for _ in range(200)]
    lexicon, harmless = toxicity.Lexicon(terms, 2), np.zeros(0, np.uint64)
    expected = [plain_features(terms, t) for t in texts]
    assert toxicity.features(lexicon, harmless, pa.array(texts)).tolist() == expected
    weights = np.array([-4.0, 4.0, -0.5, -1.5, 0.2, 0.5, 0.6])
    model = toxicity.Model(lexicon, harmless, weights, terms)
    got = [r[0] for r in toxicity.with_toxicity(plain(spark, texts), model).orderBy("doc_id").select("toxicity").collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-max(-30, min(30, weights[0] + np.dot(weights[1:], x))))) for x in expected])


# Quality


def plain_ngram_counts(texts):
    return sum((Counter(quality.ngrams(pa.array([t], pa.string()))[0].tolist()) for t in texts), Counter())


def test_log_weights_equal_counted_models_and_bad_ones_go(spark):
    rng = random.Random(12)
    data, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        text = prose(rng, "en", rng.randint(15, 60))
        data.append((i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text, "en", "s", 0))
        labels.append((i, int(not bad), 0))
    docs = frame(spark, data)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality.learn(docs, known)
    learned = {r[0] for r in docs.filter("crc32(cast(doc_id as string)) % 4 <> 2").select("doc_id").collect()}
    raw, target = plain_ngram_counts([t for _, t, *_ in data]), plain_ngram_counts([t for i, t, *_ in data if i in learned and i % 6])
    b = quality.BUCKETS
    one = data[7][1]
    expected = sum(
        c * (math.log((target[g] + 1) / (sum(target.values()) + b)) - math.log((raw[g] + 1) / (sum(raw.values()) + b))) for g, c in plain_ngram_counts([one]).items()
    )
    got = quality.scored(docs.select("doc_id", "text").filter("doc_id = 7"), model).first()
    assert abs(got["_log_weight"] - expected) < 1e-6
    kept = {r[0] for r in quality.resample(docs, known).select("doc_id").collect()}
    assert kept == {i for i in range(300) if i % 6}
    assert quality.resample(docs, known).columns == docs.columns
    assert quality.resample(docs, known, k=50).count() == 50


def test_kth_largest_is_exact(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(500)] + [3.0] * 200 + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 100, 201, 202, 300, 702):
        assert quality.kth_largest(df, "x", k, few=10, bins=7) == sorted(values, reverse=True)[k - 1]


def test_quality_of_awkward_tables(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.resample(docs, labels).count() == docs.count()
    assert quality.resample(docs.limit(0), labels.limit(0)).count() == 0
    assert quality.resample(docs, labels, k=0).count() == 0


# Fingerprints


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chain(*values):
    """Spark's xxhash64 of strings and long integers."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return signed(seed)


def plain_units(text):
    out = []
    unspaced = fingerprints.UNSPACED.replace(r"\x{20000}-\x{3FFFF}", "\U00020000-\U0003ffff")
    for run in regex.findall(r"[\p{L}\p{N}]+", regex.sub(f"({unspaced})", r" \1 ", text.lower())):
        if len(run) <= fingerprints.LONG:
            out.append(run)
            continue
        pairs = [chain(x, y) for x, y in zip(run, run[1:], strict=False)]
        piece = ""
        for i, letter in enumerate(run):
            piece += letter
            if i + 3 < len(run) and chain(pairs[i], pairs[i + 2]) % fingerprints.CUT == 0:
                out.append(piece)
                piece = ""
        out.append(piece)
    return out


def plain_anchors(text, k=fingerprints.K, s=fingerprints.S):
    units = [chain(u) for u in plain_units(text)]
    out = []
    for at in range(len(units) - k + 1):
        inner = [chain(*units[i : i + s]) for i in range(at, at + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((chain(*units[at : at + k]), at))
    return out or [(u, i) for i, u in enumerate(units)] or ([(chain("text", text), 0)] if text else [])


def as_fingerprint(anchors):
    return "".join(f"{(h % 2**64) >> 32:08X}{at - before}" for (h, at), before in zip(anchors, [0] + [at for _, at in anchors], strict=False))


def test_syncmers_equal_a_plain_version(spark):
    rng = random.Random(3)
    shared, dna = prose(rng, "en", 60), "".join(rng.choice("acgt") for _ in range(3000))
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300))
    texts = [shared, prose(rng, "de", 30) + " " + shared, "one two", "...", "", None, shared, dna, han + shared + "한국어 문장 ภาษาไทย", "a" * 500, "\U0001d4d0\U00020001x" * 30]
    got = {r.doc_id: r for r in fingerprints.fingerprints(plain(spark, texts)).collect()}
    for i, text in enumerate(texts):
        expected = plain_anchors(text or "")
        assert [tuple(a) for a in got[i].anchors] == expected, i
        assert got[i].fingerprint == as_fingerprint(expected)
        assert got[i].hashes == sorted({(h % 2**64) >> 32 for h, _ in expected})[: fingerprints.SIZE]
    inner, offset = set(plain_anchors(shared)), len(plain_units(texts[1])) - len(plain_units(shared))
    assert inner == {(h, at - offset) for h, at in plain_anchors(texts[1]) if at >= offset}


def test_anchors_do_not_depend_on_what_stands_before(spark):
    rng = random.Random(4)
    for letters, size in ((range(0x4E00, 0x9000), 2000), ([ord(c) for c in "abcdefgh0123"], 4000), ([ord(c) for c in "acgt"], 8000)):
        run = "".join(chr(rng.choice(letters)) for _ in range(size))
        texts = [run, "x" + run, run[: size // 2] + "y" + run[size // 2 :]]
        sets = {r.doc_id: {a.h for a in r.anchors} for r in fingerprints.fingerprints(plain(spark, texts)).collect()}
        for other in (1, 2):
            assert len(sets[0] & sets[other]) >= len(sets[0]) - 8 and len(sets[0]) > size // 40, (size, other)


def test_next_document_follows_by_id(spark):
    rng = random.Random(7)
    ids = rng.sample(range(10**9), 2000)
    docs = plain(spark, [f"text {i}" for i in ids], ids).select("doc_id", "text").repartition(7)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(docs, ["text"]).collect()}
    ordered = sorted(ids)
    assert got == {a: f"text {b}" for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True)}
    for data in ([], [(None, "x")], [(None, "x"), (None, None), (1, "y"), (1, "y"), (1, "z")]):
        small = spark.createDataFrame(data, "doc_id bigint, text string").fillna({"text": ""})
        out = fingerprints.with_next(small, ["text"]).collect()
        assert len(out) == len(data) and all(r.next_text is not None for r in out)


def test_fingerprint_query_columns(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.op7_closed_syncmers(spark, str(tmp_path)).collect()
    data = sorted(((d, t or "") for d, t, *_ in rows() if d is not None and d != 5), key=lambda r: r[0])
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 5}
    assert len(got) == len(rows())
    for (a, text), (b, after) in zip(data, data[1:], strict=False):
        if b == a + 1:
            q = len(text) // 4
            assert by_id[a].edited_sha256 == hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()
        assert 0 <= by_id[a].near_edited <= 1 and 0 <= by_id[a].near_next <= 1


def test_a_passage_of_long_texts_is_found_with_its_place(spark, tmp_path):
    rng = random.Random(12)

    def text(n):
        return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]

    shared, first, second = text(60), text(4000), text(4000)
    one, two = first[:1000] + shared + first[1000:], second[:3000] + shared + second[3000:]
    turned = first[2000:] + first[:2000]
    texts = [" ".join(t) for t in (one, two, first, turned)]
    docs = plain(spark, texts)
    anchors = fingerprints.anchor_table(fingerprints.fingerprints(docs))
    left, right = (anchors.filter(f"doc_id = {i}") for i in (0, 1))
    runs = fingerprints.matched_runs(left, right, least=5).collect()
    assert [(r.left, r.right, r.offset) for r in runs] == [(0, 1, 2000)]
    assert 1000 <= runs[0]["first"] < 1010 and 1045 < runs[0]["last"] <= 1056
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op7_closed_syncmers(spark, str(tmp_path)).collect()}
    # The likenesses are those of the returned fingerprints.
    sets = {i: {r.fingerprint[j : j + 8] for j in range(0, len(r.fingerprint), 9)} for i, r in got.items()}
    edited = {i: {r.edited_fingerprint[j : j + 8] for j in range(0, len(r.edited_fingerprint), 9)} for i, r in got.items()}
    assert all(got[i].near_edited == len(sets[i] & edited[i]) / len(sets[i] | edited[i]) for i in range(4))
    for i in range(3):
        assert got[i].near_next == len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1])
    assert got[0].near_next > 0 and 0.9 < got[2].in_order_next < 1


# WARC


def record(kind, rid, url, date, http="", payload="", profile=None):
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}"] + [f"WARC-Target-URI: {url}"] * bool(url) + [f"WARC-Date: {date}"] * bool(date)
    head += [f"WARC-Profile: {profile}"] * bool(profile)
    return "\r\n".join(head) + "\r\n\r\n" + http + "\r\n\r\n" + payload


def test_revisits(spark):
    full = 'HTTP/1.1 200 OK\r\nETag: "a"\r\nContent-Type: text/html\r\nVary: X\r\nVary: Y\r\nCache-Control: old'
    not_modified = 'HTTP/1.1 304 Not Modified\r\n{}\r\nCache-Control: new\r\nContent-Type: text/evil'
    again = warc.NOT_MODIFIED
    texts = [
        record("response", "r1", "http://www.Example.org:80/a/?b=2&utm_source=x&a=1#f", "2024-01-01T00:00:00Z", full, "one\r\n\r\ntwo"),
        record("response", "r2", "https://example.org/a?a=1&b=2", "2024-01-03T00:00:00Z", full.replace('"a"', '"b"'), "three"),
        record("revisit", "v1", "https://example.org/a?b=2&a=1", "2024-01-02T00:00:00Z", not_modified.format('ETag: W/"a"'), profile=again),
        record("revisit", "v2", "https://example.org/a?b=2&a=1", "2024-01-04T00:00:00Z", not_modified.format('ETag: "a"'), profile=again),
        record("revisit", "v3", "https://example.org/a?b=2&a=1", "2023-01-01T00:00:00Z", not_modified.format("X: y"), profile=again),
        record("revisit", "v4", "https://example.org/a?b=2&a=1", "2024-01-05T00:00:00Z", not_modified.format("X: y"), profile=again),
        record("revisit", "v5", None, "2024-01-05T00:00:00Z", not_modified.format("X: y"), profile=again),
        record("revisit", "v6", "https://example.org/a", "not a date", not_modified.format("X: y"), profile=again),
        record("revisit", "v7", "https://example.org/a", "2024-01-05T00:00:00Z", "HTTP/1.1 200 OK", profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        record("warcinfo", "w1", None, None),
        None,
        "",
    ]
    parsed = warc.parse(spark.createDataFrame([(t, "x") for t in texts], "record string, headers string"))
    assert parsed.filter("record_id = 'r1'").first().payload == "one\r\n\r\ntwo"
    got = {r.record_id: r for r in warc.resolve(parsed).collect()}
    assert {k: (r.status, r.refers_to) for k, r in got.items()} == {
        "r1": ("response", "r1"), "r2": ("response", "r2"), "v1": ("etag", "r1"), "v2": ("mismatch", None),
        "v3": ("no-response", None), "v4": ("unvalidated", "r2"), "v5": ("no-url", None), "v6": ("no-date", None),
    }
    assert got["v1"].headers == {"etag": 'W/"a"', "cache-control": "new", "content-type": "text/html", "vary": "X, Y"}
    assert got["v1"].payload_digest == hashlib.sha256(b"one\r\n\r\ntwo").hexdigest()
    assert warc.resolve(parsed.limit(0)).count() == 0
    assert warc.resolve(parsed.unionAll(parsed)).count() == 2 * len(got)


def test_records_without_a_length_are_errors(spark, tmp_path):
    one = record("response", "r1", "http://a.b/c", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nA: b", "text") + "\r\n\r\n"
    (tmp_path / "x.warc").write_bytes((one + one.replace("r1", "r2")).encode())
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert all(r.error for r in got) and "".join(sorted(r.raw for r in got if "r1" in r.raw)).startswith("WARC/1.1")


def sized(number, body, version="1.1", length=None):
    """A record as files have it, with the length of what follows its header."""
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
    stated = "" if length == "" else f"Content-Length: {len(block) if length is None else length}\r\n"
    head = f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: r{number}\r\n{stated}\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_files_of_both_versions_are_read_by_lengths(spark, tmp_path):
    inner = b"see WARC/1.1\r\nWARC-Type: response\r\n\r\nx" + sized(99, b"inside") + b"\r\n\r\n"
    bodies = [b"plain", b"", inner, b"WARC/1.0\r\n", "\u00fcber\u2028".encode(), b"WARC/1."]
    for version in ("1.0", "1.1"):
        file = b"".join(sized(i, b, version) for i, b in enumerate(bodies))
        (tmp_path / f"{version}.warc").write_bytes(file)
        (tmp_path / f"{version}.warc.gz").write_bytes(b"".join(gzip.compress(sized(i, b, version)) for i, b in enumerate(bodies)))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert not any(r.error for r in got) and len({r.file for r in got}) == 4
    expected = {(f"r{i}", b.decode()) for i, b in enumerate(bodies)}
    assert len(got) == 4 * len(bodies) and {(r.record_id, r.payload) for r in got} == expected


def test_splits_of_a_file_do_not_cut_records(spark, tmp_path):
    rng = random.Random(3)
    bodies = [b"WARC/1.1\r\n".join(rng.randbytes(rng.randrange(40)).hex().encode() for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    (tmp_path / "x.warc").write_bytes(b"".join(sized(i, b) for i, b in enumerate(bodies)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1000")
        got = warc.read_warc(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((int(r.record_id[1:]), r.payload) for r in got) == [(i, b.decode()) for i, b in enumerate(bodies)]


def test_broken_records_are_rows_with_an_error():
    whole = [sized(i, b"text %d" % i) for i in range(9)]
    cases = {
        "wrong length": sized(7, b"shorter than stated", length=70), "no length": sized(7, b"x", length=""),
        "no header end": b"WARC/1.1\r\nWARC-Type: response\r\n", "no version line": b"WARC/1.x\r\n\r\nrest\r\n",
        "too long": sized(7, b"x", length=10**12),
    }

    def pieces(data):
        return [warc.MARK + p for p in data.split(warc.MARK)[1:]]

    for error, broken in cases.items():
        got = list(warc.cut_records(iter(pieces(b"".join(whole[:3]) + broken + b"".join(whole[3:])))))
        assert [r for r, e in got if not e] == whole, error
        assert [(r, e) for r, e in got if e] == [(broken, error)], error
    got = list(warc.cut_records(iter(pieces(whole[0] + whole[1][:-9]))))
    assert got == [(whole[0], None), (whole[1][:-9], "truncated")]
    short = sized(7, b"longer than stated", length=30)
    assert list(warc.cut_records(iter(pieces(short + whole[0])))) == [(short, "wrong length"), (whole[0], None)]
    assert not list(warc.cut_records(iter([])))


def test_errors_of_files_come_with_their_text(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"junk" + sized(1, b"good") + sized(2, b"bad", length=""))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.error or "", r.raw or "", r.record_id or "") for r in got) == [
        ("", "", "r1"), ("no length", sized(2, b"bad", length="").decode(), ""), ("no version line", "junk", ""),
    ]
    assert [r.record_id for r in warc.resolve(warc.read_warc(spark, str(tmp_path))).collect()] == ["r1"]
