"""WARC archives: written by Spark's own text sink, read back by verifying the chain of record boundaries.

Writing. Each page becomes one WARC/1.0 record: ``response``, or, if another page has the same payload of at least
``min_bytes`` bytes and a larger id, ``revisit`` of the largest (no block; the digest and length of the payload in its
header). Which pages are revisits is decided from digests alone, so payloads are shuffled only if the pages that are
revisits are too many to send to all executors (``BROADCAST_ROWS``). Files have at most ``RECORDS_PER_FILE`` records.

Reading. A file is cut into ranges. The task of a range emits, for each place where a record seems to begin (the magic
may also be inside a payload), the place behind it that its own header's length leads to. Places that a chain of such
steps from the file's start reaches are records, found by pointer jumping: every round doubles the length of the steps
that are known, so a chain of n ranges takes about log2(n) rounds (a task first follows the chains inside its range).
All other candidates are rejected. Then each file is read again at the verified places only.

Special input: a null payload is empty; a null id can't be referred to and leaves its row out; of rows that repeat an
id, the smallest payload counts; an empty table gives an archive without records, which reads as no rows; long
payloads are whole, up to the 2 GB a Spark value can have; other columns are not looked at. A truncated last record,
or bytes between records, raise ``BrokenArchive`` rather than lose the rest of the file.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.llm.store import Scratch, drop_folder, keyed, new_folder

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
RECORDS_PER_FILE = 1000
#: Revisits, or places of records, (two numbers each) up to which they are sent to all executors: at most 8 MB.
BROADCAST_ROWS = 500_000
#: Payloads of over ``LARGE`` bytes go to files of their own, so many to a file that it stays under ``FILE`` bytes if one does.
LARGE, FILE = 256 << 10, 256 << 20
#: Bytes of a file that one task looks through for candidates; a header may reach over by HEADER.
RANGE, HEADER = 8 << 20, 1 << 16
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


class BrokenArchive(ValueError):
    """A chain of records that ends before its file does."""


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: ten of its hex digits are eight digits to the base 32, which only need other letters."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, k + 1, 10), 16, 32), 8, "0") for k in range(0, 40, 10)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def digests(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """``pages`` with payload_bytes and payload_digest of the payload in UTF-8; null is empty."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(key, body.alias(payload), F.octet_length(body).cast("long").alias("payload_bytes")).withColumn("payload_digest", base32_sha1(F.encode(F.col(payload), "UTF-8")))


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """key and refers_to of each page that repeats the payload of a page with a larger key."""
    d = digests(pages, key, payload).where(F.col("payload_bytes") >= min_bytes).select(key, "payload_digest", "payload_bytes")
    most = d.groupBy("payload_digest", "payload_bytes").agg(F.max(key).alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return d.join(most, ["payload_digest", "payload_bytes"]).where(F.col(key) != F.col("refers_to")).select(key, "refers_to")


def write(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 0) -> None:
    """Writes an archive of ``pages`` (key, payload and, if there is one, url) into the folder ``path``."""
    scratch = Scratch(pages.sparkSession, "warc-write")
    own = keyed(pages, key, payload, (url,) if url in pages.columns else ())
    own = own.select(key, payload, (F.col(url) if url in pages.columns else F.lit(None).cast("string")).alias("_url"))
    table = repeats = scratch.keep(revisits(own, key, payload, min_bytes))
    if repeats.count() <= BROADCAST_ROWS:
        repeats = F.broadcast(repeats)
    body = F.coalesce(F.col(payload), F.lit(""))
    d = own.select(key, "_url", body.alias("_body"), F.octet_length(body).cast("long").alias("_n"), base32_sha1(F.encode(body, "UTF-8")).alias("_sha")).join(repeats, key, "left")
    # A target may hold no white space; what has any, or none at all, gets a name of our own.
    target = F.when(F.col("_url").rlike(r"^[^\x00-\x20\x7F]+$"), F.col("_url")).otherwise(F.concat(F.lit("urn:page:"), F.col(key)))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit(MAGIC.decode()),
        F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        F.lit("WARC-Record-ID: <urn:page:"), F.col(key), F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_sha"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">\r\nX-Payload-Length: "), F.col("_n"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("_n")), F.lit(END),
    )
    record = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("_body")))
    most = own.agg(F.max(F.octet_length(payload))).first()[0] or 0
    large = F.col("_n") > LARGE
    parts = [(d.where(~large), RECORDS_PER_FILE), (d.where(large), max(1, min(RECORDS_PER_FILE, FILE // max(1, most))))]
    for k, (rows, n) in enumerate(parts[: 1 + (most > LARGE)]):
        rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", n).mode("append" if k else "errorifexists").text(path)
    scratch.drop(table)


_HEADER = re.compile(rb"WARC/1\.0\r\n((?:[^\r\n]+\r\n)+)\r\n")
_LENGTH = re.compile(rb"^Content-Length: *(\d+)\r$", re.M | re.I)


def candidates_in(raw: bytes, base: int, size: int, limit: int) -> list[tuple[int, int]]:
    """(place, place behind the record) of whatever looks like a record that begins in ``raw[:limit]``, at ``base`` of a file of ``size`` bytes."""
    out, at = [], raw.find(MAGIC)
    while 0 <= at < limit:
        m = _HEADER.match(raw, at)
        n = _LENGTH.search(m[1]) if m else None
        if n and base + m.end() + int(n[1]) + 4 <= size:
            out.append((base + at, base + m.end() + int(n[1]) + 4))
        at = raw.find(MAGIC, at + 1)
    return out


def shortcuts(steps: list[tuple[int, int]], end: int) -> list[tuple[int, int]]:
    """(place, place that its chain leads to at or behind ``end``, or where it breaks off)."""
    step, far = dict(steps), {}
    for place, _ in reversed(steps):  # successors lie behind, so they are known
        after = step[place]
        far[place] = far.get(after, after) if after < end else after
    return sorted(far.items())


def files_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")


def boundaries(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """path, offset and length of each true record of the archive in the folder ``path``; reads tables of ``scratch``."""
    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(RANGE).cast("long")))
    cuts = files_of(spark, path).select("path", "length", "content", ranges.alias("base"))
    cuts = cuts.select("path", "length", "base", F.substring("content", F.col("base").cast("int") + 1, F.lit(RANGE + HEADER)).alias("raw"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for p, size, base, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                steps = candidates_in(raw, base, size, RANGE)
                far = dict(shortcuts(steps, base + RANGE))
                rows += [(p, size, at, after, far[at]) for at, after in steps]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _EMITTED, strict=True)], names=["path", "size", "offset", "after", "far"])

    found = scratch.keep(cuts.mapInArrow(emit, "path string, size long, offset long, after long, far long"))
    # Chains between ranges: (path, offset) -> far. Reached so far: places a chain from 0 leads to.
    jump = found.select("path", "offset", "far")
    reached = found.where("offset = 0").select("path", "offset")
    n = reached.count()
    while True:
        more = reached.join(jump, ["path", "offset"]).select("path", F.col("far").alias("offset"))
        reached = scratch.keep(reached.union(more).distinct())
        if (now := reached.count()) == n:
            break
        n = now
        ahead = jump.select("path", F.col("offset").alias("far"), F.col("far").alias("farther"))
        jump = scratch.keep(jump.join(ahead, ["path", "far"], "left").select("path", "offset", F.coalesce("farther", "far").alias("far")))
    whole = files_of(spark, path).select("path", "length")
    broken = whole.join(reached, (whole["path"] == reached["path"]) & (whole["length"] == reached["offset"]), "left_anti").limit(1).collect()
    if broken:
        raise BrokenArchive(f"the records of {broken[0]['path']} don't lead to its end")
    # Inside a range, records are what the chain from the range's entry steps on: from each entry to its far place.
    entry = reached.select("path", F.col("offset").alias("entry"))
    ordered = found.join(entry, (found["path"] == entry["path"]) & (found["offset"] == entry["entry"]), "left").select(found["path"], "offset", "after", "entry")
    return follow(ordered)


_EMITTED = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def follow(ordered: DataFrame) -> DataFrame:
    """Of candidates (path, offset, after, entry), those on the chains from the entries, one range of one file after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, expected = None, -1
        for b in batches:
            keep = []
            for i, (p, at, after, entry) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if p != path:
                    path, expected = p, -1
                if entry is not None or at == expected:
                    keep.append(i)
                    expected = after
            got = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array([y - x for x, y in zip(got.column(1).to_pylist(), got.column(2).to_pylist(), strict=True)], pa.int64())], names=["path", "offset", "length"])

    # All candidates of one file (a number each, and files are bounded) lie in one partition, in order.
    return ordered.repartition("path").sortWithinPartitions("path", "offset").mapInArrow(run, "path string, offset long, length long")


RECORD = T.StructType().add("record_id", "string").add("record_type", "string").add("target_uri", "string").add("refers_to", "string").add("digest", "string").add("payload_length", "long").add("payload", "binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: ids, type, what it refers to, the digest and length its header states, and the payload."""
    scratch = Scratch(spark, "warc-read")
    found = scratch.keep(boundaries(spark, path, scratch))
    scratch.drop(*(t for t, _ in list(scratch.paths.values()) if t is not found))
    places = found.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("at"))  # bounded by the file
    if found.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    files = files_of(spark, path).select("path", "content").join(places, "path").select("content", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, at in zip(b.column(0), b.column(1), strict=True):
                raw, rows = content.as_buffer(), []
                whole = memoryview(raw)
                for place in at.as_py():
                    rec = bytes(whole[place["offset"] : place["offset"] + place["length"]])
                    head = _HEADER.match(rec)
                    f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1].decode("utf-8").split("\r\n") if x)}
                    body = rec[head.end() : -4]
                    rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(f.get("x-payload-length", len(body))), body))
                    if len(rows) == 500:
                        yield _records(rows)
                        rows = []
                if rows:
                    yield _records(rows)

    return files.mapInArrow(run, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORD.names)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def round_trip(pages: DataFrame, folder: str | None = None, key: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` into ``folder`` (one of its own in the shared folder if not given) and reads the archive back.

    A response's digest and length are taken from the payload that was read; a revisit's from its header.
    """
    spark = pages.sparkSession
    own = folder is None
    folder = folder or new_folder(spark, "warc")
    write(pages, folder, key, payload, url, min_bytes)
    got = read(spark, folder)
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1).cast("long")
    response = F.col("record_type") == "response"
    out = got.select(
        number("record_id").alias(key),
        F.when(response, F.length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload"))).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(~response, number("refers_to")).alias("refers_to"),
    )
    if own:  # nobody else reads the archive
        out = Scratch(spark, "warc-out").keep(out)
        drop_folder(spark, folder)
    return out


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return round_trip(pages)


def op9_sql() -> str:
    """DuckDB text of the query; base 32 is put together from every five hexadecimal digits, which are four of its characters."""
    letter = lambda shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {shift}) & 31)::INT, 1)"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT page_id, strlen(body) AS payload_bytes, max(page_id) OVER (PARTITION BY body) AS top,
    list_transform(list_transform(range(0, 8), lambda k: CAST('0x' || substr(sha1(body), (1 + 5 * k)::INT, 5) AS BIGINT)), lambda v: {" || ".join(letter(x) for x in (15, 10, 5, 0))}) AS parts
  FROM p
)
SELECT page_id, payload_bytes, array_to_string(parts, '') AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d"""
