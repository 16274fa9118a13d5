"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Seeds are what the four base patterns find and validate: e-mail addresses, IPv4 addresses, card
numbers (Luhn) and phone numbers.  Candidates are identifier-like words (with a digit or @) and
groups of digits joined by spaces, brackets, hyphens and dots.  The words left and right of a seed
or candidate are its lexical patterns, each alone and together with its shape; a candidate takes
part for the kinds that its form could be of (``FORMS``), whatever forms the seeds have.
Patterns and instances form a graph, scored in rounds: a pattern is as good as the share of its
instances that are trusted and counts once enough of them are, seeds or found in earlier rounds;
an instance is trusted if its contexts are (noisy or, each by its better pattern).
Instances that reach the stated trust are personal data too, and their occurrences become further
spans of the kind of their seeds.

The graph is built of distinct edges, so copies of a document weigh nothing; every step is an
aggregate or a join that the session may split, no key's rows are gathered.

Regular expressions repeat single character classes only: a separator that may stand inside an
entity is first replaced by a mark of the same length, so that a match of any length needs no
recursion, and matching takes time in proportion to the text.

Defined results: a null or empty text has no spans; null and repeated ids are rows of their own;
positions are code points from 0, ends exclusive; an empty table gives an empty result.  Extra
columns are ignored (``redact`` passes them through).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.llm import store

KINDS = ("email", "ip", "card", "phone")
#: Marks that stand in for separators inside entities; in texts they are replaced by a third one.
DIGIT_GAP, DOMAIN_DOT, OTHER = "\u0001", "\u0002", "\u0003"
#: Code points of context that are looked at on each side.
CONTEXT = 48
ROUNDS = 3
#: A pattern counts if so many distinct trusted instances have it; its confidence is damped by DAMPING.
SUPPORT, DAMPING = 3, 1.0
#: Confidence of a pattern, and trust in an instance, from which they count.
PATTERN_CONFIDENCE, INSTANCE_TRUST = 0.5, 0.8

LOCAL = "A-Za-z0-9._%+" + DOMAIN_DOT + "-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++{DOMAIN_DOT}[A-Za-z0-9{DOMAIN_DOT}-]*"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = rf"[0-9][0-9{DIGIT_GAP}]*[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: A separator inside a group of digits, one character at a time.
GROUP_GAP = (
    r"(?<=[0-9)][\x20-]{0,2})[\x20-](?=[\x20-]{0,2}\(?[0-9])|(?<=[0-9)])\.(?=\(?[0-9])"
    r"|\((?=[0-9])|(?<=[0-9])\)(?=[\x20.-]?[\x20-]{0,2}\(?[0-9])"
)
GROUP = rf"(?<![0-9A-Za-z_@{DIGIT_GAP}])[+{DIGIT_GAP}]{{0,2}}+[0-9][0-9{DIGIT_GAP}]*+(?![A-Za-z_@])"
#: What a candidate must look like to be of a kind at all; loose, so that forms no seed has can be found.
FORMS = {"email": r"^[^@]+@[^@]+$", "ip": r"^[^g-zG-Z@.:]*[.:][^g-zG-Z@.:]*[.:][^g-zG-Z@]*$", "card": r"^[^\p{L}@]*$", "phone": r"^[^\p{L}@]*$"}
#: Fewest and most digits of a candidate of a kind.
FORM_DIGITS = {"card": (12, 19), "phone": (6, 15)}
BYTE = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.){3}0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

SPAN = "struct<s:int,k:int,e:int,m:string,l:string,r:string>"
EMPTY = f"cast(array() as array<{SPAN}>)"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right counts double."""
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid_card(m: Column) -> Column:
    digits = _digits(m)
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


#: Pattern, quick test of the text, and test of a match; in the order of KINDS.
RULES: dict[str, tuple[str, Callable[[Column], Column], Callable[[Column], Column]]] = {
    "email": (EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(BYTE)),
    "card": (CARD, lambda t: t.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"), _valid_card),
    "phone": (PHONE, lambda t: t.rlike(r"\+[0-9]"), lambda m: F.length(_digits(m)).between(10, 15)),
    "candidate": (CANDIDATE, lambda t: t.rlike("[0-9@]"), lambda m: F.length(m) >= 6),
    "group": (GROUP, lambda t: t.rlike("[0-9]"), lambda m: F.length(_digits(m)) >= 6),
}
CANDIDATES = ("candidate", "group")


def _marked(name: str, text: Column) -> Column:
    clean = F.translate(text, DIGIT_GAP + DOMAIN_DOT, OTHER + OTHER)
    if name == "email":
        return F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOMAIN_DOT)
    if name == "card":
        return F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", DIGIT_GAP)
    if name == "group":
        return F.regexp_replace(clean, GROUP_GAP, DIGIT_GAP)
    return clean


def _folded(pieces: Column, kind: int, valid: Callable[[Column], Column]) -> Column:
    """Spans of the valid matches among (match, text before, text after)."""
    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(
            start.alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["m"].alias("m"),
            F.right(x["g"], F.lit(CONTEXT)).alias("l"), F.left(x["h"], F.lit(CONTEXT)).alias("r"),
        ).cast(SPAN)
        spans = F.when(valid(x["m"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.cast("int").alias("pos"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("pos"), F.expr(EMPTY).alias("spans"))
    return F.aggregate(pieces, zero, step, lambda acc: acc["spans"])


def with_matches(docs: DataFrame, text: str = "_text") -> DataFrame:
    """Add ``_base`` (base spans by start and kind) and ``_candidates`` to rows that have ``_text``."""
    for name, (pattern, quick, _) in RULES.items():
        marked = F.when(quick(F.col(text)), _marked(name, F.col(text)))
        docs = docs.withColumn(f"_t_{name}", marked)
        docs = docs.withColumn(f"_m_{name}", F.regexp_extract_all(f"_t_{name}", F.lit(pattern), F.lit(0)))
        has = F.size(f"_m_{name}") > 0
        docs = docs.withColumn(f"_g_{name}", F.when(has, F.split(f"_t_{name}", pattern, -1)))
    docs = docs.drop(*(f"_t_{n}" for n in RULES))
    for kind, (name, (_, _, valid)) in enumerate(RULES.items()):
        m, g = F.col(f"_m_{name}"), F.col(f"_g_{name}")
        zipped = F.arrays_zip(m.alias("m"), F.slice(g, F.lit(1), F.size(m)).alias("g"), F.slice(g, F.lit(2), F.size(m)).alias("h"))
        docs = docs.withColumn(f"_s_{name}", F.when(g.isNotNull(), _folded(zipped, kind, valid)).otherwise(F.expr(EMPTY)))
    docs = docs.drop(*(f"_{x}_{n}" for n in RULES for x in "mg"))
    docs = docs.withColumn("_base", F.array_sort(F.concat(*(F.col(f"_s_{n}") for n in KINDS))))
    # A word that is just a group of digits is one candidate.
    words = F.filter("_s_candidate", lambda c: ~F.exists("_s_group", lambda g: (g["s"] == c["s"]) & (g["e"] == c["e"])))
    # A candidate that touches a base span is no new identifier.
    free = F.filter(F.concat(words, "_s_group"), lambda c: ~F.exists("_base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return docs.withColumn("_candidates", free).drop(*(f"_s_{n}" for n in RULES))


def _shape(m: Column) -> Column:
    """The kind of characters in order: letters as a, digits as 9 with the length of a long run."""
    m = F.regexp_replace(F.translate(m, DIGIT_GAP + DOMAIN_DOT, " ."), r"[^\x00-\x7F]", "a")
    long_run = F.regexp_replace(m, "[0-9]{6,}", "N")
    shape = F.regexp_replace(F.regexp_replace(long_run, "[0-9]+", "9"), "[A-Za-z]+(?=[^A-Za-z]|$)", "a")
    return F.concat(shape, F.length(_digits(m)).cast("string"))


def _could_be(m: Column) -> Column:
    """The kinds that a candidate's form allows."""
    digits = F.length(_digits(m))
    kinds = []
    for kind, name in enumerate(KINDS):
        able = m.rlike(FORMS[name])
        if name in FORM_DIGITS:
            able &= digits.between(*FORM_DIGITS[name])
        kinds.append(F.when(able, F.lit(kind)))
    return F.filter(F.array(*kinds), lambda k: k.isNotNull())


def _edges(rows: DataFrame) -> DataFrame:
    """Distinct (context, pattern, instance, kind, is it a seed) over all seeds and candidates."""
    both = F.concat("_base", "_candidates")
    found = rows.select(F.explode(both).alias("x")).select(
        # The same number may come with separators or marks in their place.
        F.lower(F.translate("x.m", DIGIT_GAP + DOMAIN_DOT, " .")).alias("instance"),
        F.when(F.col("x.k") < len(KINDS), F.col("x.k")).alias("seed"),
        _shape(F.col("x.m")).alias("shape"),
        _could_be(F.translate("x.m", DIGIT_GAP + DOMAIN_DOT, " .")).alias("kinds"),
        *(F.translate(f"x.{side}", DIGIT_GAP + DOMAIN_DOT, " .").alias(side) for side in "lr"),
    ).select(
        "instance", "seed", "shape", "kinds",
        F.lower(F.regexp_extract("l", r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)).alias("left"),
        F.lower(F.regexp_extract("r", r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)).alias("right"),
    )
    kinds = F.when(F.col("seed").isNotNull(), F.array("seed")).otherwise(F.col("kinds"))
    sides = F.array(*(F.struct(F.concat_ws(" ", F.lit(x), w).alias("context"), (F.col(w) != "").alias("word")) for x, w in (("l", "left"), ("r", "right"))))
    found = found.select("instance", F.col("seed").isNotNull().alias("seed"), "shape", kinds.alias("kinds"), F.explode(sides).alias("c"))
    found = found.select("instance", "seed", "shape", "c.context", "c.word", F.explode("kinds").alias("kind"))
    # No word at all, as at the start of a text, says nothing without the shape.
    exact = F.concat_ws(" ", "context", F.lit("as"), "shape")
    patterns = F.when(F.col("word"), F.array(exact, F.concat_ws(" ", "context", F.lit("alone")))).otherwise(F.array(exact))
    found = found.select("context", F.explode(patterns).alias("pattern"), "instance", "kind", "seed")
    return found.groupBy("pattern", "instance", "kind").agg(F.first("context").alias("context"), F.max("seed").alias("seed"))


def discover(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, trust) of identifiers that no base pattern finds; ``rows`` from ``with_matches``."""
    edges = store.keep(_edges(rows), "edges")
    seeds = edges.filter("seed").groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("trust", F.lit(1.0))
    seeds = store.keep(seeds, "seeds")
    # A pattern of fewer instances can't have enough trusted ones, in any round.
    sizes = edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= SUPPORT)
    graph = store.keep(edges.join(sizes, ["pattern", "kind"]), "graph")
    trusted = seeds
    for _ in range(rounds):
        enough = F.sum((F.col("trust") >= INSTANCE_TRUST).cast("int"))
        weights = graph.join(trusted, ["instance", "kind"]).groupBy("pattern", "kind").agg(
            (F.sum("trust") / (F.first("size") + DAMPING)).alias("confidence"), enough.alias("support")
        )
        weights = weights.filter((F.col("confidence") >= PATTERN_CONFIDENCE) & (F.col("support") >= SUPPORT)).drop("support")
        # Of a context alone and with the shape, the better one counts: they are no two witnesses.
        better = graph.filter("not seed").join(weights, ["pattern", "kind"]).groupBy("instance", "kind", "context").agg(F.max("confidence").alias("confidence"))
        doubt = F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999))))
        fresh = better.groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("trust"))
        fresh = store.keep(fresh.join(seeds.select("instance"), "instance", "left_anti"), "trusted")
        trusted = seeds.select("instance", "kind", "trust").unionByName(fresh)
    best = fresh.filter(F.col("trust") >= INSTANCE_TRUST).groupBy("instance").agg(F.min(F.struct(-F.col("trust"), "kind")).alias("b"))
    return best.select("instance", F.col("b.kind").alias("kind"), (-F.col("b.col1")).alias("trust"))


def _found(rows: DataFrame, rounds: int) -> DataFrame:
    """Per row id the further spans, as (start, kind, end)."""
    new = rows.select("_rid", F.explode("_candidates").alias("x")).select("_rid", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.lower(F.translate("x.m", DIGIT_GAP + DOMAIN_DOT, " .")).alias("instance"))
    placed = new.join(discover(rows, rounds).select("instance", F.col("kind").alias("k")), "instance")
    return placed.groupBy("_rid").agg(F.collect_list(F.struct("s", "k", "e")).alias("_more"))


def with_spans(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, carry: bool = True) -> DataFrame:
    """``_base`` and ``_spans`` of every row: arrays of (s, k, e), k being the number of the kind.

    With ``carry`` the whole row goes along as the struct ``_doc``, else only ``doc_id``.
    """
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("_doc") if carry else docs["doc_id"]
    rows = with_matches(docs.select(whole, docs[text].cast("string").alias("_text"))).drop("_text")
    rows = store.keep(rows.withColumn("_rid", F.monotonically_increasing_id()), "spans")
    out = rows.join(_found(rows.select("_rid", "_base", "_candidates"), rounds), "_rid", "left")
    base = F.transform("_base", lambda b: F.struct(b["s"], b["k"], b["e"]))
    more = F.coalesce("_more", F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)"))
    return out.withColumn("_base", base).withColumn("_spans", F.array_sort(F.array_distinct(F.concat(F.col("_base"), more)))).drop("_more", "_candidates", "_rid")


def redact(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The documents with every span of their text replaced by its kind in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    spans = with_spans(docs, text, rounds).withColumn("_text", F.col(f"_doc.{text}").cast("string"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring("_text", acc["pos"] + 1, F.greatest(F.lit(0), s["s"] - acc["pos"]))
        piece = F.when(s["s"] < acc["pos"], F.lit("")).otherwise(F.concat(before, F.element_at(names, s["k"] + 1)))
        return F.struct(F.greatest(acc["pos"], s["e"]).alias("pos"), F.concat(acc["out"], piece).alias("out"))

    clean = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        step,
        lambda acc: F.concat(acc["out"], F.substring("_text", acc["pos"] + 1, F.length("_text"))),
    )
    clean = F.when(F.size("_spans") > 0, clean).otherwise(F.col("_text"))
    return spans.select(*(clean.alias(c) if c == text else F.col(f"_doc.{c}") for c in docs.columns))


def _text_of(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def op2_pii_bootstrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=False)
    kinds = F.transform("_base", lambda b: b["k"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *count, F.sha2(_text_of("_base"), 256).alias("base_sha256"), _text_of("_spans").alias("spans"))
