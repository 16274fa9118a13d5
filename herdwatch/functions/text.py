"""Lists, pairs, typed values and addresses written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def non_blank(text: Column) -> Column:
    """The text, or NULL if it is empty or only blanks."""
    return F.when(F.trim(text) != "", text)


def split_list(text: Column) -> Column:
    """``a, b,c`` as [a, b, c]; empty entries at the end are dropped, others are kept."""
    return F.transform(F.split(F.regexp_replace(text, ",+$", ""), ","), strip)


def _entries(text: Column) -> Column:
    """Position and ``=``-separated parts of each non-empty entry."""
    entries = F.filter(F.split(text, ","), lambda e: e != "")
    parts = lambda e: F.transform(F.split(strip(e), "="), strip)
    return F.transform(entries, lambda e, i: F.struct(i.cast("int").alias("i"), parts(e).alias("p"), e.alias("raw")))


def _good(e: Column) -> Column:
    return (F.size(e["p"]) == 2) & (e["p"][0] != "") & (e["p"][1] != "")


def pairs(text: Column) -> Column:
    """``k=v,k=v`` as an array of (i, k, v), i being the entry's place; malformed entries are left out."""
    return F.transform(
        F.filter(_entries(text), _good), lambda e: F.struct(e["i"].alias("i"), e["p"][0].alias("k"), e["p"][1].alias("v"))
    )


def bad_pairs(text: Column) -> Column:
    """The entries that ``pairs`` leaves out."""
    return F.transform(F.filter(_entries(text), lambda e: ~_good(e)), lambda e: e["raw"])


def first_per_key(entries: Column) -> Column:
    """Of entries with the same key, the first."""
    return F.filter(
        entries, lambda e: ~F.exists(entries, lambda other: (other["k"] == e["k"]) & (other["i"] < e["i"]))
    )


def typed(text: Column, to: str, default=None, options: tuple[str, ...] = ()) -> Column:
    """A setting as int, bigint, float, double, boolean or one of ``options`` (``to="enum"``).

    What cannot be read gives the default.  A boolean never fails: any text but ``true`` is false.
    """
    fallback = F.lit(default)
    if to == "boolean":
        return F.when(text.isNotNull(), F.lower(text) == "true").otherwise(fallback.cast("boolean"))
    if to == "enum":
        return F.when(text.isin(*options), text).otherwise(fallback.cast("string"))
    if to in ("int", "bigint"):
        text = F.when(text.rlike(r"^[+-]?\d+$"), text)
    return F.coalesce(text.try_cast(to), fallback.cast(to))


def host_ip(host: Column) -> Column:
    """``x-a-b-c-d.domain`` as ``a.b.c.d``; NULL for other host names."""
    parts = F.split(F.split(host, r"\.")[0], "-")
    return F.when(F.size(parts) >= 5, F.array_join(F.slice(parts, 2, 4), "."))


def single_address(ip: Column) -> Column:
    return F.concat(ip, F.lit("/32"))


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def is_ipv6(ip: Column) -> Column:
    """Eight groups of up to four hex digits, one run of zero groups written as ``::``; the last two
    groups may be an IPv4 address."""
    group = "[0-9A-Fa-f]{1,4}"
    plain = F.regexp_replace(ip, rf":{_OCTET}(\.{_OCTET}){{3}}$", ":0:0")
    groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
    short = plain.rlike(rf"^({group}(:{group})*)?::({group}(:{group})*)?$") & (groups <= 7)
    return F.coalesce(plain.rlike(rf"^{group}(:{group}){{7}}$") | short, F.lit(False))


def wildcard_rule(word: str) -> str:
    """A name with ``*`` wildcards as an anchored regular expression."""
    quoted = "".join(".*" if c == "*" else c if c.isalnum() or c == "_" else "\\" + c for c in word)
    return f"^{quoted}$"
