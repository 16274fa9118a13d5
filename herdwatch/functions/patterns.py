"""Dataset names and date patterns.

Patterns are written in the letters that policies use: ``Y`` or ``y`` year, ``M`` month, ``d``
day, ``D`` day of year, ``H``/``k``/``h``/``K`` hour, ``m`` minute, ``s`` second, ``S``
fraction, ``a`` half day, ``w`` week; text in single quotes is literal.

A pattern is compiled once, into a small struct (its *form*).  Policies are few, so that step
is a plain function, run on the driver for one pattern or in an Arrow UDF for a policy table.
Names are many; reading and printing them uses built-in expressions over the form's columns.

Week patterns (a year and a week, nothing else) are read and printed with the year of the
week; Spark's own patterns have no week.
"""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens of a pattern: quoted text, a run of one letter, or other characters.
_TOKEN = re.compile(r"'(?:[^']|'')*'|([a-zA-Z])\1*|[^a-zA-Z']+")
# Letter runs that can be both parsed and printed without a loss.
_FIELD = re.compile(r"y|yyy+|Y|YYY+|x|xxx+|MM?|ww?|dd?|D{1,3}|HH?|hh?|KK?|kk?|mm?|ss?|S+|a+")
_WEEK = re.compile("(YYYY|yyyy|xxxx)ww")
# The most digits a field prints for years before 10000.  Fixed values.
_DIGITS = {"y": 4, "Y": 4, "x": 4, "D": 3, "S": 1}

FORM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("error", "spark", "week")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("pieces", "shapes", "layouts", "texts")]
)


def compile_pattern(pattern: str | None) -> dict:
    """The form of a pattern.

    ``error`` says why it cannot be used.  ``spark`` is the pattern in Spark's letters; week
    patterns have ``week``, a regular expression, and ``pieces`` instead.  ``shapes`` are the
    printed forms it can have, with digits as 0.  ``layouts`` say, for each of the lengths its fields
    can have, how long a name is and where its literal text stands; ``texts`` are these texts.
    """
    form = dict.fromkeys(FORM.names)
    if pattern is None:
        return form
    tokens = [m.group(0) for m in _TOKEN.finditer(pattern)]
    fields = [t for t in tokens if t[0].isalpha()]
    form["error"] = _error(pattern, tokens, fields)
    if form["error"]:
        return form
    form["shapes"] = sorted({"".join(c) for c in itertools.product(*map(_shapes, tokens))})
    laid_out = sorted({_layout(tokens, c) for c in itertools.product(*map(_widths, tokens))})
    form["layouts"], form["texts"] = [x for x, _ in laid_out], [x for _, x in laid_out]
    if any(t[0] == "w" for t in fields):
        form["week"] = "^" + "".join(map(_week_rule, tokens)) + "$"
        form["pieces"] = [{"w": "week"}.get(t[0], "year") if t[0].isalpha() else "=" + _text(t) for t in tokens]
    else:
        form["spark"] = "".join(re.sub("a+", "a", t.replace("Y", "y")) if t[0].isalpha() else t for t in tokens)
    return form


def _error(pattern: str, tokens: list[str], fields: list[str]) -> str | None:
    bad = [t for t in fields if not _FIELD.fullmatch(t)]
    letters = {t[0] for t in fields}
    if "".join(tokens) != pattern:
        return "unterminated quote"
    if bad:
        return f"unsupported field {bad[0]}"
    if any(t[0] != "'" and re.search(r"[\[\]{}#]", t) for t in tokens if t not in fields):
        return "reserved character outside quotes"
    if letters & {"w", "x"} and not _WEEK.fullmatch("".join(fields)):
        return "unsupported week pattern"
    if fields and not letters & {"y", "Y", "x"}:
        return "no year"
    return None


def _text(token: str) -> str:
    if token == "''":
        return "'"
    return token[1:-1].replace("''", "'") if token[0] == "'" else token


def _week_rule(token: str) -> str:
    if token[0].isalpha():
        return r"(\d{2})" if token[0] == "w" else r"(\d{4})"
    return re.sub(r"([^\w\s])", r"\\\1", _text(token))


def _widths(token: str) -> list[int]:
    """How many characters a token can print."""
    if not token[0].isalpha():
        return [len(_text(token))]
    if token[0] == "a":
        return [2]
    return list(range(len(token), max(len(token), _DIGITS.get(token[0], 2)) + 1))


def _shapes(token: str) -> list[str]:
    if not token[0].isalpha():
        return [re.sub("[0-9]", "0", _text(token))]
    return ["AM", "PM"] if token[0] == "a" else ["0" * n for n in _widths(token)]


def _layout(tokens: list[str], widths: tuple[int, ...]) -> tuple[str, str]:
    """``size|start+length,...`` of the literal text, and the text."""
    ends = list(itertools.accumulate(widths))
    literal = [(end - n, n, _text(t)) for t, n, end in zip(tokens, widths, ends, strict=True) if not t[0].isalpha() and n]
    return f"{ends[-1] if ends else 0}|" + ",".join(f"{at}+{n}" for at, n, _ in literal), "".join(t for _, _, t in literal)


def layout_size(layout: Column) -> Column:
    return F.substring_index(layout, "|", 1).cast("int")


def cut_by_layout(name: Column, layout: Column) -> Column:
    """What a name has in the places where the layout has literal text."""
    spans = F.filter(F.split(F.substring_index(layout, "|", -1), ","), lambda x: x != "")
    cut = F.transform(
        spans,
        lambda x: F.substr(name, F.substring_index(x, "+", 1).cast("int") + 1, F.substring_index(x, "+", -1).cast("int")),
    )
    return F.array_join(cut, "")


def pattern_form(pattern: str) -> Column:
    """The form of one known pattern, as a literal."""
    form = compile_pattern(pattern)
    as_text = lambda v: F.lit(v).cast("string")
    as_array = lambda v: F.lit(None) if v is None else F.array(*map(F.lit, v))
    return F.struct(
        *(as_text(form[f]).alias(f) for f in ("error", "spark", "week")),
        *(as_array(form[f]).cast("array<string>").alias(f) for f in ("pieces", "shapes", "layouts", "texts")),
    )


@F.pandas_udf(FORM)
def _compile(pattern: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compile_pattern(p) for p in pattern], columns=FORM.names)


# Marked so that filters on what follows are not pushed below it, which would run it again.
_compile_once = _compile.asNondeterministic()


def with_form(df: DataFrame, pattern: str, into: str = "form") -> DataFrame:
    """Add the form of a pattern column; each distinct pattern is compiled once."""
    forms = df.select(F.col(pattern).alias("_pattern")).filter("_pattern IS NOT NULL").distinct()
    forms = forms.withColumn(into, _compile_once(F.col("_pattern")))
    return df.join(forms, df[pattern] == forms["_pattern"], "left").drop("_pattern")


def _monday(date: Column) -> Column:
    return F.to_date(F.date_trunc("week", date))


def print_date(ts: Column, form: Column) -> Column:
    """The name a pattern gives to a point in time (UTC)."""
    week_year = F.lpad(F.year(F.date_add(_monday(ts), 3)).cast("string"), 4, "0")
    week = F.lpad(F.weekofyear(ts).cast("string"), 2, "0")
    by_week = F.transform(
        form["pieces"],
        lambda t: F.when(t == "year", week_year).when(t == "week", week).otherwise(F.substring(t, 2, 1 << 30)),
    )
    return F.coalesce(F.call_function("date_format", ts, form["spark"]), F.array_join(by_week, ""))


def name_date(name: Column, form: Column) -> Column:
    """The point in time a name stands for, missing parts at their start; NULL if it has none."""
    year = F.get(F.regexp_extract_all(name, form["week"], F.lit(1)), F.lit(0)).cast("int")
    week = F.get(F.regexp_extract_all(name, form["week"], F.lit(2)), F.lit(0)).cast("int")
    monday = F.date_add(_monday(F.make_date(year, F.lit(1), F.lit(4))), (week - 1) * 7)
    by_week = F.when(F.weekofyear(monday) == week, monday).cast("timestamp")
    return F.coalesce(F.try_to_timestamp(name, form["spark"]), by_week)


def matches_form(name: Column, form: Column) -> Column:
    """True iff the whole name has the pattern's form: it parses and prints back the same."""
    date = name_date(name, form)
    return F.coalesce((F.year(date) < 10000) & (print_date(date, form) == name), F.lit(False))


def matches_pattern(name: Column, pattern: str) -> Column:
    return matches_form(name, pattern_form(pattern))


def floor_to_pattern(ts: Column, form: Column) -> Column:
    """The point in time without what the pattern does not say: printed and read back."""
    return name_date(print_date(ts, form), form)


def name_shape(name: Column) -> Column:
    """A name with every digit replaced by 0: it can only match patterns with that shape."""
    return F.regexp_replace(name, "[0-9]", "0")
