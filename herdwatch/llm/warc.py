"""WARC records: resolving server-not-modified revisits to the responses they stand for.

A revisit holds only the headers of a 304 answer.  An as-of join by canonical URL finds the latest
earlier full response; its validators must agree with the revisit's (the entity tag by weak
comparison, else the date of last modification), and then the revisit is that response with those
headers replaced that a 304 may update.

The as-of join is a running maximum over time slices of each URL (``plans.slices``), so that a URL
with a third of all captures is cut into parts; the response found is joined back by its id.

Defined results (``status``): ``response`` for a full response, which stands for itself; ``etag`` or
``last-modified`` for a revisit resolved by that validator; ``unvalidated`` if neither side has one
in common with the other; ``mismatch`` if validators disagree, ``no-response`` without an earlier
response, ``no-url`` and ``no-date`` where these are missing or empty: these are not resolved and
have no merged headers.  Equal times are ordered by record id.  Rows with a null id refer but are not
referred to; of responses with the same id the smallest (by date and digest) is referred to.  An
empty table gives an empty result; extra columns are ignored.  ``unvalidated`` revisits are resolved
too, nothing speaking against it: leave them out by ``status`` if a validator is asked for.  Files are
read by ``read_warc``, which gives what is no record as rows with an error.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.llm import store
from herdwatch.plans.slices import running_before, without_slices

# Headers that a 304 answer updates in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that only track visits.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|sessionid|jsessionid|sid|phpsessid)(=|$)"
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
CRLF = "\r\n"
#: What all version lines begin with; a whole one; the header line that states the length of what follows the header.
MARK, VERSION = b"WARC/1.", re.compile(rb"WARC/1\.[0-9]+\r\n")
LENGTH = re.compile(rb"\r\ncontent-length[ \t]*:[ \t]*([0-9]{1,18})[ \t]*\r\n", re.I)
#: Records of more bytes are error rows.
LONGEST = 1 << 30
CUT = (pa.string(), pa.binary(), pa.string())


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a last slash, sorted query
    without tracking parameters; no scheme, user or fragment.  Empty and null give null."""
    part = lambda i: F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^@/?#]*@)?([^/:?#]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?", i)
    host = F.regexp_replace(F.lower(part(1)), r"^www\.", "")
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.regexp_replace(part(3), "/+$", "")
    query = F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    asked = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, port, path, asked))


def with_headers(df: DataFrame, block: str, out: str) -> DataFrame:
    """Add ``out``: the header lines of a block as a map; names in lower case, repeated ones joined by commas."""
    lines = F.filter(F.split(block, CRLF), lambda line: line.rlike("^[^:\\s]+:"))
    names = F.transform(lines, lambda line: F.lower(F.substring_index(line, ":", 1)))
    values = F.transform(lines, lambda line: F.trim(F.substring(line, F.instr(line, ":") + 1, F.length(line))))
    df = df.withColumns({"_names": names, "_values": values}).withColumn("_once", F.array_distinct("_names"))

    def of(name: Column) -> Column:
        pairs = F.filter(F.arrays_zip("_names", "_values"), lambda p: p["_names"] == name)
        return F.array_join(F.transform(pairs, lambda p: p["_values"]), ", ")

    joined = F.map_from_arrays("_once", F.transform("_once", of))
    single = F.size("_once") == F.size("_names")
    return df.withColumn(out, F.when(single, F.map_from_arrays("_names", "_values")).otherwise(joined)).drop("_names", "_values", "_once")


def _size(start: bytes) -> tuple[int | None, str | None]:
    """Bytes from the version line to the end of the payload, None while the header is not whole; an error."""
    end = start.find(b"\r\n\r\n")
    if end < 0:
        return None, None
    stated = LENGTH.search(start, 0, end + 2)
    return (end + 4 + int(stated[1]), None) if stated else (None, "no length")


def cut_records(pieces: Iterator[bytes], longest: int = LONGEST) -> Iterator[tuple[bytes, str | None]]:
    """(record, error) of a file, which is given in pieces that begin wherever a version line may stand.

    A record ends where its Content-Length says, if nothing but line ends stands between there and the
    next piece; version lines before that are payload.  What does not add up is a row with an error, and
    reading goes on at the next piece: ``no version line``, ``no header end``, ``no length``, ``wrong
    length``, ``truncated``, ``too long``.
    """
    waiting: deque[bytes] = deque()
    take = lambda: waiting.popleft() if waiting else next(pieces, None)
    while (piece := take()) is not None:
        held, size, need, error = [piece], len(piece), None, None if VERSION.match(piece) else "no version line"
        while not error:
            if need is None:
                need, error = _size(b"".join(held))
            if error or (need is not None and size >= need):
                break
            if size > longest or (need is not None and need > longest):
                error = "too long"
            elif (more := take()) is None:
                error = "truncated" if need is not None else "no header end"
            elif need is None and VERSION.match(more):
                waiting.appendleft(more)
                error = "no header end"
            else:
                held.append(more)
                size += len(more)
        whole = b"" if error else b"".join(held)
        if not error and whole[need:].strip(b"\r\n"):
            error = "wrong length"
        if error:
            yield held[0], error
            waiting.extendleft(reversed(held[1:]))
        else:
            yield whole[:need] + b"\r\n\r\n", None


def _cut_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((f.as_py(), p.as_py()) for batch in batches for f, p in zip(batch["file"], batch["piece"], strict=True))

    def found() -> Iterator[tuple[str, bytes, str | None]]:
        for file, mine in groupby(rows, key=lambda r: r[0]):
            before = next(mine)[1]  # what stands before the first version line
            if before:
                yield file, before, "no version line"
            for record, error in cut_records(MARK + p for _, p in mine):
                yield file, record, error

    held, size = [], 0
    for row in found():
        held.append(row)
        size += len(row[1])
        if size > 4 << 20 or len(held) == 1_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), CUT, strict=True)], names=["file", "record", "error"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), CUT, strict=True)], names=["file", "record", "error"])


def read_warc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of WARC/1.x files, plain or gzipped, as ``parse`` gives them, with ``file`` and ``error``;
    where ``error`` is set, ``raw`` is the text that is no record and all else is null.

    A file is gone through in order, a record at a time, since only lengths tell records from payloads:
    gzipped files as they are scanned, plain ones after a shuffle that brings their splits together.
    """
    store.bounded_batches(spark)
    text, name = spark.read.option("lineSep", MARK.decode()).text(path), F.col("_metadata.file_path")
    place = [name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"), F.col("value").cast("binary").alias("piece")]
    packed, plain = (text.filter(x).select(*place) for x in (name.endswith(".gz"), ~name.endswith(".gz")))
    plain = plain.repartition("file").sortWithinPartitions("file", "block", "no")
    cut = [x.select("file", "piece").mapInArrow(_cut_files, "file string, record binary, error string") for x in (packed, plain)]
    whole, said = F.col("error").isNull(), F.col("record").cast("string")
    rows = cut[0].unionAll(cut[1]).select("file", "error", F.when(~whole, said).alias("raw"), F.when(whole, said).alias("record"))
    return parse(rows, keep=("file", "error", "raw"))


def parse(records: DataFrame, column: str = "record", keep: Sequence[str] = ()) -> DataFrame:
    """(record_id, record_type, url, date, profile, http_status, headers, payload) of records as text, and the columns to ``keep``."""
    blocks = records.select(F.split(records[column], CRLF + CRLF, 3).alias("b"), F.struct(F.lit(0), *(records[x] for x in keep)).alias("_kept"))
    out = blocks.select("_kept", F.get("b", 0).alias("warc"), F.get("b", 1).alias("http"), F.get("b", 2).alias("payload"))
    out = with_headers(with_headers(out, "warc", "w"), "http", "headers")
    return out.select(
        F.col("w")["warc-record-id"].alias("record_id"),
        F.lower(F.col("w")["warc-type"]).alias("record_type"),
        F.col("w")["warc-target-uri"].alias("url"),
        F.try_to_timestamp(F.col("w")["warc-date"]).alias("date"),
        F.col("w")["warc-profile"].alias("profile"),
        F.regexp_extract("http", r"^HTTP/[0-9.]+ ([0-9]{3})", 1).alias("http_status"),
        "headers",
        F.when(F.col("payload").endswith(CRLF + CRLF), F.left("payload", F.length("payload") - 4)).otherwise(F.col("payload")).alias("payload"),
        *(F.col("_kept")[x].alias(x) for x in keep),
    )


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, record_type, canonical_url, date, status, refers_to, headers, payload_digest) of
    responses and not-modified revisits; ``records`` as from ``parse``."""
    rows = records.select("record_id", "record_type", canonical_url(F.col("url")).alias("canonical_url"), "date", "headers", F.sha2("payload", 256).alias("digest"), "profile", "http_status")
    revisit = (F.col("record_type") == "revisit") & (F.col("profile").endswith("server-not-modified") | (F.col("http_status") == "304"))
    # Parsed once; without payloads the captures are small.
    rows = store.keep(rows.filter((F.col("record_type") == "response") | revisit).drop("profile", "http_status"), "captures")
    placed = rows.filter("canonical_url is not null and date is not null")
    full = F.when(F.col("record_type") == "response", F.struct("date", "record_id"))
    asof = without_slices(running_before(placed, ["canonical_url"], {"latest": ("max", full)}, order=("date", "record_id")))
    asof = asof.withColumn("_to", F.when(F.col("record_type") == "revisit", F.col("latest.record_id"))).drop("latest")
    lost = rows.filter("canonical_url is null or date is null").withColumn("_to", F.lit(None).cast(rows.schema["record_id"].dataType))
    first = F.min_by(F.struct("headers", "digest"), F.struct("date", "digest")).alias("o")
    found = placed.filter("record_type = 'response' and record_id is not null").groupBy(F.col("record_id").alias("_to")).agg(first)
    # Only revisits with an earlier response are joined: all others would meet under the null id.
    linked = asof.filter("_to is not null").join(found, "_to", "left")
    alone = asof.filter("_to is null").unionByName(lost).withColumn("o", F.lit(None).cast(found.schema["o"].dataType))
    both = linked.unionByName(alone).withColumn("old", F.col("o.headers"))

    tag = lambda h: F.regexp_replace(F.col(h)["etag"], "^W/", "")
    modified = lambda h: F.col(h)["last-modified"]
    by_tag, by_date = tag("headers").isNotNull() & tag("old").isNotNull(), modified("headers").isNotNull() & modified("old").isNotNull()
    status = (
        F.when(F.col("record_type") == "response", "response")
        .when(F.col("canonical_url").isNull(), "no-url")
        .when(F.col("date").isNull(), "no-date")
        .when(F.col("old").isNull(), "no-response")
        .when(by_tag, F.when(tag("headers") == tag("old"), "etag").otherwise("mismatch"))
        .when(by_date, F.when(modified("headers") == modified("old"), "last-modified").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    both = both.withColumn("status", status)
    fresh = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("old", lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    own, done = F.col("status") == "response", F.col("status").isin("etag", "last-modified", "unvalidated")
    return both.select(
        "record_id", "record_type", "canonical_url", "date", "status",
        F.when(own, F.col("record_id")).when(done, F.col("_to")).alias("refers_to"),
        F.when(own, F.col("headers")).when(done, F.map_concat(kept, fresh)).alias("headers"),
        F.when(own, F.col("digest")).when(done, F.col("o.digest")).alias("payload_digest"),
    )


#: Captures made of the given pages, for Spark and DuckDB alike: each page is fetched once, and some
#: are asked for again, with the same, another or no validator, before or after the fetch.
CAPTURES = """
SELECT page_id, 0 AS visit, 'response' AS record_type, url, CAST(page_id * 7200 + 86400 AS BIGINT) AS seconds,
       CASE WHEN page_id % 5 <> 0 THEN '"' || md5(html) || '"' END AS etag,
       'version ' || CAST(page_id % 11 AS VARCHAR(9)) AS modified, 'max-age=60' AS cache, html FROM {pages}
UNION ALL
SELECT page_id, 1, 'revisit', url || '#again', CAST(page_id * 7200 + 86400 + 3600 * (1 + page_id % 9) AS BIGINT),
       CASE page_id % 3 WHEN 0 THEN 'W/"' || md5(html) || '"' WHEN 1 THEN '"other"' END,
       CASE WHEN page_id % 4 <> 3 THEN 'version ' || CAST(page_id % 11 AS VARCHAR(9)) END, 'max-age=600', NULL FROM {pages} WHERE page_id % 2 = 0
UNION ALL
SELECT page_id, 2, 'revisit', url, CAST(page_id * 7200 + 86400 - 60 AS BIGINT), NULL, NULL, NULL, NULL FROM {pages} WHERE page_id % 7 = 0
"""


def as_records(captures: DataFrame) -> DataFrame:
    """The captures written as WARC records."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))
    answer = F.when(F.col("record_type") == "response", "HTTP/1.1 200 OK").otherwise("HTTP/1.1 304 Not Modified")
    record = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat_ws("-", F.lpad(F.col("page_id").cast("string"), 12, "0"), "visit")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.date_format(F.timestamp_seconds("seconds"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Profile", F.when(F.col("record_type") == "revisit", NOT_MODIFIED)),
        F.lit(CRLF), answer, F.lit(CRLF),
        line("Content-Type", F.when(F.col("record_type") == "response", "text/html")),
        line("ETag", F.col("etag")), line("Last-Modified", F.col("modified")), line("Cache-Control", F.col("cache")),
        F.lit(CRLF), F.coalesce("html", F.lit("")),
    )
    return captures.select(record.alias("record"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = spark.sql(CAPTURES.format(pages="{pages}"), pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = resolve(parse(as_records(captures)))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("record_id", "record_type", "canonical_url", F.unix_timestamp("date").alias("seconds"), "status", "refers_to", F.array_join(lines, ";").alias("headers"), "payload_digest")
