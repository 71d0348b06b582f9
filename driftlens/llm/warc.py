"""WARC archives: written by Spark's text writer, read back in splits with boundary-chain verification.

A file is bytes; a split may begin anywhere, and payloads may hold the magic that opens a record. So every task emits
each magic it sees as a candidate, with the offset at which the record after it would begin. What can be reached from
offset 0 of a file along such candidates are its records; everything else is payload. Tasks contract chains inside
their split first, then pointer jumping over the exits of splits finds each split's first true record in
log2(splits of a file) rounds, and a second scan cuts the records there.
"""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import delete, lean, materialise, new_path, settled, table

MAGIC = b"WARC/1.1\r\n"
GAP = "\r\n\r\n"
#: Splits up to which their table (about 60 bytes a row) is broadcast to the second scan; beyond, rows are sorted instead.
BROADCAST_SPLITS = 200_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column, in plain expressions: four runs of 40 bits."""
    runs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substring(F.sha1(payload), k * 10 + F.lit(1), F.lit(10)), 16, 10).cast("long"))
    letter = lambda x, s: F.substring(F.lit(BASE32), (F.shiftright(x, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(*[letter(x, s) for s in range(35, -1, -5)])), "")


def digests(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, bytes, digest, first): first is the smallest page_id of equal payloads of at least min_bytes, or null."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows, _ = materialise(pages.select("page_id", F.octet_length(body).cast("long").alias("bytes"), base32_sha1(body).alias("digest")), "digests")
    first = rows.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(first, ["digest", "bytes"], "left")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """One record per row of ``pages`` (page_id, url, html; other columns are ignored), a WARC file per input split.

    Payload: html in UTF-8, null as empty. Of equal payloads the smallest page_id is a response, others are revisits
    that refer to it and hold no payload; rows that repeat the smallest page_id are all responses, and a null page_id is
    never smallest. White space and controls in urls are percent-encoded, so none can end a header line. An empty
    table makes an archive without records.
    """
    revisits, _ = materialise(digests(pages, min_bytes).filter("first is not null and not (page_id <=> first)").select(F.col("page_id").alias("_id"), "digest", "first").distinct(), "revisits")
    n = revisits.count()
    revisits = F.broadcast(revisits) if n <= BROADCAST_SPLITS else revisits
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html")).withColumn("_digest", base32_sha1(F.encode("html", "UTF-8")))
    rows = rows.join(revisits, F.expr("page_id <=> _id and _digest = digest"), "left")
    size = F.octet_length(F.encode("html", "UTF-8"))
    revisit = F.col("first").isNotNull()
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(GAP))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    length = F.octet_length(F.encode(http, "UTF-8")) + F.when(revisit, 0).otherwise(size)
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(F.col("first"))))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", GAP).text(path)


def header(data: bytes, at: int) -> tuple[dict, int, int] | None:
    """Fields, first byte of the block, and offset of the next record; None if no whole header stands at ``at``."""
    end = data.find(b"\r\n\r\n", at)  # a header is one piece of the text reader, so it ends in its split
    if end < 0 or not data.startswith(MAGIC, at):
        return None
    fields = {}
    for x in data[at:end].split(b"\r\n")[1:]:
        k, _, v = x.partition(b":")
        fields[k.strip().lower()] = v.strip()
    n = fields.get(b"content-length", b"")
    return (fields, end + 4, end + 4 + int(n) + 4) if n.isdigit() else None


def _successors(data: bytes):
    """(offset, offset of the next record) of each candidate, as ``header`` has them; a piece is parsed once for all its candidates."""
    at, end, line, n = data.find(MAGIC), -1, -1, b""
    while at >= 0:
        if at > end:
            if (end := data.find(b"\r\n\r\n", at)) < 0:
                return
            line, n, pos = -1, b"", at
            for x in data[at:end].split(b"\r\n"):
                k, _, v = x.partition(b":")
                if pos > at and k.strip().lower() == b"content-length":
                    line, n = pos, v.strip()  # the last one counts
                pos += len(x) + 2
        if line > at and n.isdigit():
            yield at, end + 4 + int(n) + 4
        at = data.find(MAGIC, at + 1)


def _splits(batches):
    """(file, block, any more columns, bytes) of each split, from rows with its pieces last, in file order."""
    at, held = None, []
    for batch in batches:
        for *key, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != at:
                if at:
                    yield *at, b"\r\n\r\n".join([*held, b""])
                at, held = key, []
            held.append(piece)
    if at:
        yield *at, b"\r\n\r\n".join([*held, b""])


def _chains(batches):
    """A row per split, with its size, and one per candidate: its offset, the chain's last record and exit beyond the split."""
    out = []
    for file, block, data in _splits(batches):
        out.append((file, block, len(data), None, None, None))
        succ = dict(_successors(data))
        ends: dict[int, tuple[int, int]] = {}
        for at in sorted(succ, reverse=True):
            to = succ[at]
            ends[at] = ends[to] if to in ends else (at, to)  # a chain that breaks inside the split exits where it broke
            last, leave = ends[at]
            out.append((file, block, None, at, last, leave))
    yield from _rows(out, ["file", "block", "size", "at", "last", "leave"], [pa.string(), *[pa.int64()] * 5])


def _rows(rows, names, types):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", GAP).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Per split: base (its offset in the file), entry (its first true record, from base) and owner (whose bytes come before)."""
    cands, drop = materialise(pieces(spark, path).mapInArrow(lean(_chains), "file string, block long, size long, at long, last long, leave long"), "candidates")
    dropped = [drop]
    order = W.partitionBy("file").orderBy("block")
    sizes = cands.filter("size is not null").select("file", "block", "size")
    sizes = sizes.withColumn("base", F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sizes, drop = materialise(sizes, "splits")
    dropped.append(drop)
    jump = cands.filter("at is not null").join(sizes.select("file", "block", "base"), ["file", "block"])
    jump = jump.select("file", "block", F.expr("base + at").alias("off"), F.expr("base + last").alias("last"), F.expr("base + leave").alias("to"))
    first, drop = materialise(jump, "jumps")
    dropped.append(drop)
    hop, reached = first.select("file", "off", "to"), first.filter("off = 0").select("file", "off")
    count = reached.count()
    while count:
        more = reached.join(hop, ["file", "off"]).select("file", F.col("to").alias("off")).join(first.select("file", "off"), ["file", "off"], "left_semi")
        reached, drop = materialise(reached.unionByName(more).distinct(), "reached")
        dropped.append(drop)
        if (now := reached.count()) == count:
            break
        count, far = now, hop.select("file", F.col("off").alias("to"), F.col("to").alias("to2"))
        hop, drop = materialise(hop.join(far, ["file", "to"]).select("file", "off", F.col("to2").alias("to")), "jumps")
        dropped.append(drop)
    found = first.join(reached, ["file", "off"]).groupBy("file", "block").agg(F.min("off").alias("off"), F.min_by("last", "off").alias("last"))
    out = sizes.join(found, ["file", "block"], "left")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    out = out.select("file", "block", "base", F.expr("coalesce(off - base, size)").alias("entry"), F.last("last", ignorenulls=True).over(before).alias("owner"))
    out, _ = materialise(out, "entries")
    delete(spark, *dropped)
    return out


_OUT = ["file", "off", "type", "id", "refers", "stated", "digest", "bytes", "payload", "whole"]
_TYPES = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.bool_()]
_SCHEMA = "file string, off long, type string, id string, refers string, stated string, digest string, bytes long, payload binary, whole boolean"


def _record(file: str, off: int, data: bytes, at: int, end: int, payload: bool):
    """A whole record's row; stated is the digest that its header names, digest that of the payload as read, both bare base32."""
    found = header(data, at)
    fields, block, succ = found
    body = memoryview(data)[block : succ - 4]
    cut = data.find(b"\r\n\r\n", block, succ - 4) if fields.get(b"content-type", b"").startswith(b"application/http") else block - 4
    body = memoryview(data)[cut + 4 : succ - 4] if cut >= 0 else body
    text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    return (file, off, text(b"warc-type"), text(b"warc-record-id"), text(b"warc-refers-to"), (text(b"warc-payload-digest") or "").removeprefix("sha1:") or None, base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body), bytes(body) if payload else None, True)


def _cut(payload: bool):
    def run(batches):
        out, held = [], 0
        for file, block, base, entry, owner, data in _splits(batches):
            del block
            if entry and owner is not None:
                out.append((file, owner, None, None, None, None, None, base, data[:entry], False))
            at = entry
            while at < len(data) and (found := header(data, at)):
                if found[2] > len(data):
                    out.append((file, base + at, None, None, None, None, None, base + at, data[at:], False))
                    break
                out.append(_record(file, base + at, data, at, found[2], payload))
                held += found[2] - at if payload else 200
                at = found[2]
                if held > 4 << 20:
                    yield from _rows(out, _OUT, _TYPES)
                    out, held = [], 0
        yield from _rows(out, _OUT, _TYPES)

    return run


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every true record below ``path``: file, off, type, id, refers, stated, digest (recomputed), bytes and, if asked for, payload.

    A revisit has no payload of its own, so its digest is that of nothing; stated is that of the payload it stands for.

    Records that span splits are put together from their fragments, a record at a time; one that its file cuts short
    is left out. Files may be of any length and number. An archive without records gives no rows.
    """
    at = entries(spark, path)
    rows = pieces(spark, path)
    if at.count() <= BROADCAST_SPLITS:
        rows = rows.join(F.broadcast(at), ["file", "block"])
    else:
        rows = rows.withColumn("_n", F.monotonically_increasing_id()).join(at, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "_n")
    rows = rows.select("file", "block", "base", "entry", "owner", "piece")
    cut, _ = materialise(rows.mapInArrow(lean(_cut(payload)), _SCHEMA), "records")

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(pdf.sort_values("bytes")["payload"])
        found = header(data, 0)
        whole = found is not None and found[2] <= len(data)
        rec = [_record(pdf["file"].iloc[0], int(pdf["off"].iloc[0]), data, 0, len(data), payload)] if whole else []
        return pd.DataFrame(rec, columns=_OUT)

    parts = cut.filter("not whole").groupBy("file", "off").applyInPandas(assemble, _SCHEMA)
    out = cut.filter("whole").unionByName(parts).drop("whole")
    return out if payload else out.drop("payload")


def followed(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records ``read`` back (page_id, type, refers_to, bytes, digest, stated).

    A revisit has the digest that it states and the bytes of the response that it refers to, found by both: one page_id
    may stand for several payloads. A revisit whose response is not there keeps its digest and has null bytes.
    """
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    response = read.filter("type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    full = response.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisit = read.filter("type = 'revisit'").select("page_id", F.col("type").alias("record_type"), "refers_to", F.col("stated").alias("payload_digest"))
    return response.select(*out).unionByName(revisit.join(full, ["refers_to", "payload_digest"], "left").select(*out))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run():
        path = new_path(spark, "warc")
        write_warc(table(spark, sf_dir, "pages"), path)
        number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
        read = read_warc(spark, path, payload=False).select(number("id").alias("page_id"), "type", number("refers").alias("refers_to"), "bytes", "digest", "stated")
        read, _ = materialise(read, "pages")
        delete(spark, path)
        return followed(read)

    return settled(spark, run, "found")
