"""Decontamination, near-duplicates, personal data and licenses against plain versions."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest

from herdwatch.llm import decontamination, licenses, near_duplicates, private_data
from tests.llm.data import frame, plain, prose, rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))


# Benchmark decontamination


def benchmark_rows():
    rng = random.Random(3)
    items = [prose(rng, "en", 40), prose(rng, "de", 13), "short item", "", None, "word"]
    return items


def expected_hits(text, items, window=13):
    words, hit, found = alnum(text), set(), []
    for item, content in enumerate(items):
        terms = alnum(content)
        size = min(window, len(terms))
        starts = [i for j in range(max(len(terms) - size + 1, 0)) if size for i in range(len(words) - size + 1) if words[i : i + size] == terms[j : j + size]]
        if starts:
            found.append(str(item))
            hit |= {i + k for i in starts for k in range(size)}
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1000, 3])
def test_contamination_equals_a_plain_search(spark, block):
    items = benchmark_rows()
    texts = [t for _, t, *_ in rows()] + [items[0], "x " + items[1] + " y", items[0][:120] + " Short ITEM, " + items[0][60:]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r.doc_id: r for r in decontamination.contamination(plain(spark, texts), bench, block=block).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n, hit, found = expected_hits(text, items)
        assert (got[i].n_words, got[i].n_hit, got[i]["items"], got[i].contaminated) == (n, hit, found, hit > 0 and 20 * hit >= n)


def test_proximity_and_phrases(spark):
    index = decontamination.build_index(plain(spark, ["red green blue", "green then red and blue", "red x x x x x green blue", None]))
    wanted = decontamination.phrases_of(spark.createDataFrame([("q", "Red green BLUE")], "item_id string, text string"))
    exact = decontamination.search(index, wanted).collect()
    assert [r.doc_id for r in exact] == [0] and exact[0].hits == [(0, 3)]
    assert {r.doc_id for r in decontamination.search(index, wanted, reach=4).collect()} == {0, 1}


def test_decontamination_of_awkward_tables(spark):
    bench = spark.createDataFrame(list(enumerate(benchmark_rows())), "item_id bigint, text string")
    docs = frame(spark)
    kept = decontamination.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id is null").count() == 2
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_items_without_an_id_count_as_one(spark):
    bench = spark.createDataFrame([(None, "red green"), (None, "green blue"), (4, "red green"), (4, "blue")], "item_id bigint, text string")
    got = decontamination.contamination(plain(spark, ["red green blue", "a blue b", "none"]), bench).orderBy("doc_id").collect()
    assert [(r.n_hit, r.n_items, r["items"]) for r in got] == [(3, 2, ["4"]), (1, 1, ["4"]), (0, 0, [])]


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark):
    bad = prose(random.Random(4), "en", 20)
    bench = spark.createDataFrame([(0, bad)], "item_id bigint, text string")
    docs = plain(spark, [bad, "clean one", "clean one", None, bad, "clean two"], [None, None, None, None, 7, 7])
    kept = [(r.doc_id, r.text) for r in decontamination.remove_contaminated(docs, bench).collect()]
    assert sorted(kept, key=str) == sorted([(None, "clean one"), (None, "clean one"), (None, None), (7, "clean two")], key=str)


# Near-duplicates


def expected_components(texts, k, percent):
    sets = []
    for text in texts:
        w = spaced(text)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def drifting(rng, n=120):
    """A chain of small edits, copies of a base with many edits each, and texts with one long passage in common."""
    base = [f"w{rng.randint(0, 5000)}" for _ in range(100)]
    out, now = [], list(base)
    for _ in range(n // 4):
        now = list(now)
        now[rng.randrange(100)] = f"z{rng.randint(0, 9999)}"
        out.append(" ".join(now))
    for _ in range(n // 2):
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(100)] = f"y{rng.randint(0, 9999)}"
        out.append(" ".join(copy))
    passage = " ".join(base[:20])
    out += [f"{passage} " + " ".join(f"v{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 8))) for _ in range(n // 4)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "percent", "small"), [(4, 80, 24), (5, 80, 0)])
def test_components_equal_all_pairs(spark, monkeypatch, k, percent, small):
    """With ``small`` 0 every mixed bucket goes the way of the large ones."""
    monkeypatch.setattr(near_duplicates, "SMALL", small)
    texts = [t for _, t, *_ in rows()] + drifting(random.Random(k))
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(plain(spark, texts), k, percent).collect()}
    expected = expected_components(texts, k, percent)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_awkward_tables(spark):
    docs = frame(spark)
    one = near_duplicates.keep_one(docs)
    assert one.columns == docs.columns
    kept = [r.text for r in one.collect()]
    assert kept.count(rows()[3][1]) == 1
    assert near_duplicates.near_duplicates(docs).count() == docs.count()
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="reads Linux's own figures")
def test_workers_do_not_hold_what_earlier_tasks_have_freed(spark):
    """Tasks of near-dedup run in workers of earlier stages: what these have freed goes back to the system."""

    def used():
        with open("/proc/self/status") as f:
            return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) // 1024

    def leave(batches):
        list(batches)
        blocks = [np.ones(12_500) for _ in range(1_500)]
        sys.left = np.ones(12_500)  # above them, so that the allocator keeps all of them
        del blocks
        yield pa.RecordBatch.from_pydict({"id": pa.array([os.getpid() * 100_000 + used()], pa.int64())})

    def look(batches):
        list(batches)
        yield pa.RecordBatch.from_pydict({"id": pa.array([os.getpid() * 100_000 + used()], pa.int64())})

    def seen(task):
        found = [r.id for r in spark.range(8, numPartitions=8).mapInArrow(task, "id bigint").collect()]
        return {i // 100_000: i % 100_000 for i in found}

    before = seen(leave)
    docs = plain(spark, [prose(random.Random(i), "en", 30) for i in range(40)]).repartition(8)
    near_duplicates.near_duplicates(docs).collect()
    after = seen(look)
    assert any(before[p] - after[p] > 100 for p in before.keys() & after.keys())


def test_one_row_of_a_component_stays_whatever_its_id(spark):
    rng = random.Random(6)
    one, two, three = (prose(rng, "en", 60) for _ in range(3))
    texts = [one, one + " more", two, two, one, three, three + " more", "", "", None]
    docs = plain(spark, texts, [None, None, None, None, 9, 4, 4, None, None, None])
    kept = [(r.doc_id, r.text) for r in near_duplicates.keep_one(docs).collect()]
    assert sorted(i for i, t in kept if t and t.startswith(one)) == [9]
    assert [i for i, t in kept if t == two] == [None]
    assert [i for i, t in kept if t and t.startswith(three)] == [4]
    assert len(kept) == 6 and sum(not t for _, t in kept) == 3


def test_texts_of_null_ids_are_told_apart(spark, monkeypatch):
    """A text is compared once, not with all texts that have its id."""
    rng = random.Random(8)
    texts = [prose(rng, "en", 40) for _ in range(60)]
    texts = [t for x in texts for t in (x, x + " more", x + " more")]
    read = []
    sets_of = near_duplicates._Search.sets_of

    def counted(self, classes, few):
        used = self.nodes.join(classes, "c")
        same = self.docs["doc_id"].eqNullSafe(used["min_id"]) & (self.docs["h"] == used["h"])
        read.append((self.docs.join(used, same).count(), classes.count()))
        return sets_of(self, classes, few)

    monkeypatch.setattr(near_duplicates._Search, "sets_of", counted)
    got = near_duplicates.near_duplicates(plain(spark, texts, [None] * len(texts)), 5).collect()
    assert len(got) == len(texts) and all(r.component_id is None and r.kept for r in got)
    assert read and all(n <= 2 * classes for n, classes in read)


def test_ids_of_any_type_and_similarities_that_are_served(spark):
    docs = spark.createDataFrame([("a", "one two three"), ("7", "one two three"), ("8", "four")], "doc_id string, text string")
    got = {(r.doc_id, r.component_id) for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == {(None, 7), (7, 7), (8, 8)}
    with pytest.raises(ValueError, match="80"):
        near_duplicates.near_duplicates(docs, percent=50)


# Personal data

KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    return sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            valid = (True, all(int(x) <= 255 for x in m.group().split(".")[:4]) if k == 1 else False, 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)
            if valid[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(5)
    alphabet = "aA1.2-@+ 9()_%\u0001\u0002é😀\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "1 " * 9000, "a." * 9000 + "@x", "x@" + "a." * 9000 + "b", "1" * 20000, "a@b.c_d@e.f", "4111 1111 1111 1111", "+1 (523) 555-1055"]
    got = {r.doc_id: [tuple(s) for s in r["_base"]] for r in private_data.with_spans(plain(spark, texts), carry=False).collect()}
    assert all(got[i] == base_spans(t) for i, t in enumerate(texts))


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(8)
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "4222222222222220"]
    valid = [c for c in cards if luhn(c) and len(c) == 16] + ["4000056655665556", "4242424242424242", "5105105105105100"]
    texts = [f"{prose(rng, 'en', 8)} card number {c} paid {prose(rng, 'en', 8)}" for c in valid]
    texts += [f"hello card number 1234567812345678 paid now {i}" for i in range(2)] + ["the order 9876543210123456 came"]
    got = {r.doc_id: r for r in private_data.with_spans(plain(spark, texts), carry=False).collect()}
    for i in range(len(valid), len(valid) + 2):
        assert got[i]["_base"] == [] and [tuple(s) for s in got[i]["_spans"]] == [(18, 2, 34)]
    assert got[len(texts) - 1]["_spans"] == []


def test_contexts_discover_forms_that_no_base_pattern_has(spark):
    rng = random.Random(9)
    texts = [f"{prose(rng, 'en', 4)} phone +1 (523) 555-10{i} today {prose(rng, 'en', 4)}" for i in range(10, 22)]
    texts += [f"{prose(rng, 'en', 4)} mail u{i}@x{i}.org please {prose(rng, 'en', 4)}" for i in range(12)]
    found = [("go phone 523-555-1055 today now", 3, "523-555-1055"), ("go phone (523) 555 1056 today now", 3, "(523) 555 1056"), ("a mail john@localhost please", 0, "john@localhost")]
    texts += [t for t, _, _ in found] + ["an order 523-555-9999 came", "see 12 34 56 78 there", "at @home here"]
    # Contexts that only discovered instances have are admitted in a later round.
    texts += [f"phone 523 777 10{i} today or line 523 777 10{i} later" for i in range(10, 16)] + ["line 523 888 4444 later"]
    got = {r.doc_id: [tuple(s) for s in r["_spans"]] for r in private_data.with_spans(plain(spark, texts), carry=False).collect()}
    for i, (text, kind, value) in enumerate(found, 24):
        at = text.index(value)
        assert (at, kind, at + len(value)) in got[i], text
    assert got[27] == got[28] == got[29] == []
    assert got[len(texts) - 1] == [(5, 3, 17)]


def test_redaction(spark):
    texts = ["write to a.b@c.de or +1 (523) 555-1055!", None, "", "none"]
    got = {r.doc_id: r.text for r in private_data.redact(plain(spark, texts)).collect()}
    assert got == {0: "write to [EMAIL] or [PHONE]!", 1: None, 2: "", 3: "none"}
    docs = frame(spark)
    assert private_data.redact(docs).count() == docs.count()
    assert private_data.redact(docs.limit(0)).count() == 0


def test_digest_columns(spark):
    text = "a@b.co 1.2.3.4"
    plain(spark, [text])
    assert hashlib.sha256(b"email:0:6,ip:7:14").hexdigest() == hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base_spans(text)).encode()).hexdigest()


# Licenses


def test_base_phrases_equal_a_plain_scan(spark):
    parts = ["under the MIT License", "Apache License, Version 2.0", "CC BY-NC 4.0", "the mit", "license"]
    rng = random.Random(2)
    texts = [" ".join(rng.choice([*parts, prose(rng, "en", 3)]) for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None, "", "cc by nc"]
    got = {r.doc_id: r for r in licenses.scan(plain(spark, texts)).collect()}
    for i, text in enumerate(texts):
        w, places, labels = alnum(text), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [j for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        row = got[i]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels))
        assert set(row.base_labels) <= set(row["labels"]) and 0 <= row.score <= 1


def test_notices_are_found_with_words_put_in_and_left_out(spark):
    mit = licenses.NOTICES["mit"][0].split()
    texts = [" ".join(mit), " ".join(mit[:10] + ["really"] + mit[10:20] + mit[21:]), " ".join(mit[:8]), "GNU General Public License, version 3", "nothing"]
    got = {r.doc_id: r["labels"] for r in licenses.scan(plain(spark, texts)).collect()}
    assert got == {0: ["mit"], 1: ["mit"], 2: [], 3: ["gpl-3"], 4: []}


def test_license_scan_of_awkward_tables(spark):
    docs = frame(spark)
    assert licenses.scan(docs).count() == docs.count()
    assert licenses.scan(docs.limit(0)).count() == 0
