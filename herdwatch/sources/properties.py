"""Property files as settings rows (F1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A logical line: a comment, which ends with its natural line, or text in which a backslash takes the
# character after it along, a line end too.  Group 1 is the text; matches follow one another.
_LOGICAL = r"\G[ \t\f]*+(?:[#!][^\n]*+|([^\\\n]*+(?:\\(?:[\s\S]|\z)[^\\\n]*+)*+))(?:\n|\z)"
# Key, separator (=, : or blanks), value.
_LINE = r"^((?:\\[\s\S]|[^\\=: \t\f])*+)[ \t\f]*+[=:]?[ \t\f]*+([\s\S]*)$"

_UNIT = r"\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4}"
_PAIR = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
_CODES = rf"(?:{_UNIT}|{_PAIR})+"
_HALF = r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}"
_TOKEN = rf"[^\\]+|{_CODES}|{_HALF}|\\[\s\S]"


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """``(file, k, v)`` of property files; of a repeated key the last entry of the file counts.

    See ``parse_properties``.  A file is one row, as configuration files are small.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return parse_properties(files, "value")


def unescape(text: Column) -> Column:
    r"""Decode ``\t``, ``\n``, ``\r``, ``\f`` and ``\uXXXX``; other characters lose their backslash.

    Half of a surrogate pair is U+FFFD; a ``\u`` without four hex digits is a ``u``; a backslash at the
    very end goes.
    """

    def decoded(token: Column) -> Column:
        codes = F.decode(F.unhex(F.regexp_replace(token, r"\\u", "")), "UTF-16BE")
        return (
            F.when(~token.startswith("\\"), token)
            .when(token.rlike(f"^{_CODES}$"), codes)
            .when(token.rlike(f"^{_HALF}$"), "�")
            .otherwise(F.translate(F.substring(token, 2, 1), "tnrf", "\t\n\r\f"))
        )

    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return F.when(text.contains("\\"), F.array_join(F.transform(tokens, decoded), "")).otherwise(text)


def parse_properties(df: DataFrame, column: str) -> DataFrame:
    """The other columns, ``k`` and ``v`` for each entry of a property text.

    Lines end with LF, CR or both.  A line whose last backslash is no escaped one goes on in the next
    line, without the blanks that this begins with; comments never go on.  Keys and values are decoded.
    Comments and entries without a value are left out; a null text has no entries.
    """
    others = [c for c in df.columns if c != column]
    text = F.regexp_replace(F.col(column), r"\r\n?", "\n")
    lines = df.select(*others, F.posexplode(F.regexp_extract_all(text, F.lit(_LOGICAL), F.lit(1))).alias("_no", "_raw"))
    # Line ends that are left are those that a backslash has taken along.
    lines = lines.withColumn("_line", F.regexp_replace("_raw", r"\\\n[ \t\f]*", "")).filter("_line <> ''")
    part = lambda i: unescape(F.regexp_extract("_line", _LINE, i))
    entries = lines.select(*others, part(1).alias("k"), part(2).alias("v"), "_no")
    return entries.groupBy(*others, "k").agg(F.max_by("v", "_no").alias("v")).filter("v <> ''")
