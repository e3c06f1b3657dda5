"""WARC archives: deterministic sharded writer and reader.

Writing: equal payloads of at least `revisit_from` bytes are found by digest and length (map-side combined, hot
payloads spread over runs); the record with the largest identifier is the response, the others are revisits
without a body. Records are range-sorted by identifier, then by a hash of address and payload. The borders of the ranges
depend on the rows alone, not on how they are dealt: payload bytes are summed in equal cells of the key space, heavy cells are cut
again until a range holds about `range_bytes`, and only the borders (one for each range) reach the driver. Each range is written by one task as a series of
files that roll once `roll_bytes` of compressed data are reached and open with a warcinfo record. Every record is one gzip member with
regenerated headers, digests and a record id derived from its identifier, without clock or host, so the same
rows give the same bytes. A file is written under a temporary name and renamed when whole; the
task then reports it, and after all tasks the driver writes one manifest, again by renaming. Repeated
attempts rewrite the same bytes under the same names, and readers take only files the manifest names.

Reading: files come through Spark's binaryFile source (a file is bounded by roll_bytes or one record), are
split into gzip members, and each record's length and digests are verified.

Defined cases: null or empty payloads are empty responses; equal identifiers are separate records with record ids of their own, and if
several share the largest identifier of a group the copies with it are all responses; a null identifier is
written as 'null' and read back as null, and comes first; an empty table gives a manifest without files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import attach_group, materialize, scratch_path, table
from keystrata.llm.elias_fano import write_file

ROLL_BYTES, REVISIT_FROM, RANGE_BYTES, CELLS = 8 << 20, 1000, 16 << 20, 4096
DATE = "1970-01-01T00:00:00Z"  # no clock in the bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = -(1 << 63)
READ_SCHEMA = "record_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record_urn(record_id: int | None, again: str = "") -> str:
    """again: what tells apart records that share an identifier."""
    return f"urn:keystrata:record:{'null' if record_id is None else record_id}{again}"


def _from_urn(text: str | None) -> int | None:
    tail = (text or "").strip("<>").rpartition(":")[2].partition(".")[0]
    return int(tail) if tail not in ("", "null") else None


def _member(lines: list[str], block: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode()
    return z.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def info_bytes(name: str) -> bytes:
    """The warcinfo record that opens the file `name`."""
    block = b"software: keystrata\r\nformat: WARC File Format 1.1\r\n"
    return _member(
        ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:keystrata:file:{name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}",
         "Content-Type: application/warc-fields", f"WARC-Block-Digest: {digest_header(hashlib.sha1(block).digest())}"], block
    )


def digest_header(payload_sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(payload_sha1).decode()


def record_bytes(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None, again: str = "") -> bytes:
    """One gzip member: a response, or with refers_to a revisit."""
    sha = hashlib.sha1(payload).digest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_urn(record_id, again)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: {digest_header(sha)}",
        f"WARC-Block-Digest: {digest_header(hashlib.sha1(block).digest())}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_urn(refers_to)}>"]
    return _member(lines, block)


def members(data: bytes) -> Iterator[bytes]:
    """The uncompressed gzip members of a file."""
    while data:
        z = zlib.decompressobj(31)
        out = z.decompress(data) + z.flush()
        if not z.eof:
            raise ValueError("truncated gzip member")
        yield out
        data = z.unused_data


def parse_record(raw: bytes) -> dict:
    """Headers, block and payload of one record; checks its length and digests."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(h["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("wrong record length")
    if h.get("warc-block-digest") and h["warc-block-digest"] != digest_header(hashlib.sha1(block).digest()):
        raise ValueError("wrong block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    if h["warc-type"] == "response" and h["warc-payload-digest"] != digest_header(hashlib.sha1(payload).digest()):
        raise ValueError("wrong payload digest")
    full = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return {"headers": h, "payload": payload, "full_bytes": full}


def _slim(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).alias("__url"), F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("__body"))


def plan_revisits(rows: DataFrame, digests: DataFrame, revisit_from: int) -> DataFrame:
    """(__id, __url, __body, __refers): each row with the response it revisits, if any; digests: (__id, __sha, __len) of the rows."""
    named = digests.select("__id", "__sha", "__len").filter(F.col("__len") >= revisit_from)
    best = attach_group(named, ["__sha", "__len"], F.col("__id"), {"__best": (F.max("__id"), "max")})
    revisit = best.filter(F.col("__id") < F.col("__best")).select(F.col("__id").alias("__id2"), "__sha", "__len", "__best").distinct()
    # written first, so that Spark knows its size: a short list is broadcast, and payloads aren't shuffled for it
    revisit = materialize(revisit, "revisits", keep=True)
    keyed = rows.withColumn("__s", F.unhex(F.sha1("__body"))).withColumn("__l", F.octet_length("__body"))
    on = (keyed["__id"] == revisit["__id2"]) & (keyed["__s"] == revisit["__sha"]) & (keyed["__l"] == revisit["__len"])
    return keyed.join(revisit, on, "left").select("__id", "__url", "__body", F.col("__best").alias("__refers"))


def range_borders(rows: DataFrame, range_bytes: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """Lower borders (identifier, hash) of ranges of about range_bytes each, from rows (k, h, n): keys and bytes.

    Bytes are summed in `cells` equal cells between the smallest and the largest identifier; cells heavier than a range are cut again,
    by identifier down to one, then by hash. A range that still is heavier holds one identifier and hash.
    """
    borders: list[tuple[int, int]] = []
    filled = 0

    def cut(part: DataFrame, col: str, fixed: int | None) -> None:
        nonlocal filled
        ends = part.agg(F.min(col), F.max(col)).first()
        if ends[0] is None:
            return
        low, width = ends[0], -(-(ends[1] - ends[0] + 1) // cells)
        # differences of longs may not fit a long, so they are taken as decimals
        cell = F.floor((F.col(col).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int").alias("cell")
        for r in part.groupBy(cell).agg(F.sum("n").alias("n")).orderBy("cell").collect():  # at most `cells` rows
            start = low + r["cell"] * width
            if r["n"] > range_bytes and (width > 1 or fixed is None):
                filled = range_bytes  # what is cut again starts a range of its own
                if width > 1:
                    cut(part.filter((F.col(col) >= start) & (F.col(col) <= min(start + width - 1, ends[1]))), col, fixed)
                else:
                    cut(part.filter(F.col(col) == start), "h", start)
                filled = range_bytes
                continue
            if not borders or filled + r["n"] > range_bytes:
                borders.append((start, LEAST) if fixed is None else (fixed, start))
                filled = 0
            filled += r["n"]

    cut(rows, "k", None)
    return borders


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", roll_bytes: int = ROLL_BYTES, revisit_from: int = REVISIT_FROM, range_bytes: int = RANGE_BYTES) -> list[str]:
    """Write the archives and the manifest under `folder`; returns the files' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, buf, size, count, serial, done, last, times = None, [], 0, 0, 0, [], (), 0

        def roll() -> None:
            nonlocal buf, size, count, serial
            if count:
                data = b"".join([info_bytes(name()), *buf])
                write_file(f"{folder}/{name()}", data)
                done.append((name(), count, len(data), hashlib.sha256(data).hexdigest()))
            buf, size, count, serial = [], 0, 0, serial + 1

        def name() -> str:
            return f"part-{part:06d}-{serial:06d}.warc.gz"

        for batch in batches:
            for pid, url, body, refers, no in zip(*(batch.column(i) for i in range(5))):
                if no.as_py() != part:
                    roll()
                    part, serial = no.as_py(), 0
                this = (part, pid.as_py())
                times = times + 1 if this == last else int(part > 0 and known.value[part - 1][0] == known.value[part][0] == (LEAST if this[1] is None else this[1]))
                last = this
                raw = record_bytes(pid.as_py(), url.as_py(), body.as_py() or b"", refers.as_py(), f".{part}.{times}" if times else "")
                buf.append(raw)
                size += len(raw)
                count += 1
                if size >= roll_bytes:
                    roll()
        roll()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["name", "records", "bytes", "sha256"])

    spark = pages.sparkSession
    key = F.coalesce(F.col("__id"), F.lit(LEAST)).alias("k")
    tie = F.xxhash64("__url", "__body").alias("h")
    rows = _slim(pages, id_col, url_col, body_col)
    # payloads are read once for their digests and sizes, once to be written
    digests = materialize(rows.select("__id", F.unhex(F.sha1("__body")).alias("__sha"), F.octet_length("__body").alias("__len"), key, tie), "digests")
    borders = range_borders(digests.select("k", "h", (F.col("__len") + 512).cast("long").alias("n")), range_bytes)
    known = spark.sparkContext.broadcast(borders)  # 16 bytes a range

    @F.udf("int", useArrow=True)
    def range_of(k, h):
        return max(bisect_right(known.value, (k, h)) - 1, 0)

    planned = plan_revisits(rows, digests, revisit_from).withColumn("__part", range_of(key, tie))
    ranged = planned.repartition(max(1, 2 * len(borders)), "__part").sortWithinPartitions("__part", F.col("__id").asc_nulls_first(), tie, "__url")
    files = ranged.select("__id", "__url", "__body", "__refers", "__part").mapInArrow(run, "name string, records long, bytes long, sha256 string")
    listed = sorted(tuple(r) for r in files.collect())  # a row a file
    manifest = [dict(zip(("name", "records", "bytes", "sha256"), r)) for r in listed]
    put_text(spark, f"{folder}/manifest.json", json.dumps({"version": 1, "files": manifest}, indent=1))
    return [f"{folder}/{m['name']}" for m in manifest]


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file through Spark's file systems: temporary name, then rename."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    store = target.getFileSystem(conf)
    out = store.create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not store.rename(temp, target):
        raise OSError(f"can't commit {path}")


def manifest_files(spark: SparkSession, folder: str) -> list[str]:
    """The files a manifest names."""
    text = "\n".join(r[0] for r in spark.read.text(f"{folder}/manifest.json", wholetext=True).collect())
    return [f"{folder}/{m['name']}" for m in json.loads(text)["files"]]


def read_warc(spark: SparkSession, files: list[str], with_payload: bool = True) -> DataFrame:
    """READ_SCHEMA, one row per record; payload is null for revisits, or if not wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for raw in members(content.as_py()):
                    r = parse_record(raw)
                    h = r["headers"]
                    if h["warc-type"] == "warcinfo":
                        continue
                    revisit = h["warc-type"] == "revisit"
                    sha = base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex()
                    body = r["payload"] if with_payload and not revisit else None
                    rows.append((_from_urn(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], r["full_bytes"], sha, _from_urn(h.get("warc-refers-to")), body))
                    size += len(body or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    if not files:
        return spark.createDataFrame([], READ_SCHEMA)
    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(run, READ_SCHEMA)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    got = read_warc(spark, manifest_files(spark, folder), with_payload=False)
    return got.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS best FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < best THEN best END AS refers_to
FROM d
"""
