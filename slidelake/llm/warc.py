"""WARC archives with revisit records.

Headers (a digest, a length, an id) are shuffled by payload digest; of equal payloads one stays a response and the
others become revisits that refer to it. Payloads are shuffled once, where the revisits are many, or not at all. Each
record is a gzip member of its own, as tools expect. Archives are written by Spark's text writer, so any store that
Spark knows will do and lost tasks are written again: a member's last byte (the highest of its length, 0 below 16 MB;
longer records are several members) is left to the writer as its line separator. Readers stream through an archive and
cut records by Content-Length, as payloads may hold anything.

Defined results: a null payload is empty. Payloads are equal when SHA-1, SHA-256 and length agree. The response is
the record with the largest id; rows that repeat that id and payload are all responses; a record with a null id is
a response of its own. Line breaks in a URI are dropped; a null URI has no header.
Other columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty, work_path, written

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 1000
#: Bytes of payload that an archive holds, about; and the most that it may hold, unless one record alone is more.
ARCHIVE_BYTES, MOST_BYTES = 32 << 20, 1 << 30
#: Records of more bytes have archives apart, so that a bound on the number of records is one on bytes.
LARGE = 1 << 16
#: Bytes of a gzip member, below 16 MB.
MEMBER = (1 << 24) - 1
#: The date of records, unless told: archives of equal input are equal.
DATE = "2026-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolved(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """headers (id, sha1, sha256, payload_bytes) with refers_to: the id of the response to whose payload a revisit points, else null."""
    key = ["sha1", "sha256", "payload_bytes"]
    originals = headers.filter(F.col("payload_bytes") >= least_bytes).groupBy(*key).agg(F.max("id").alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")
    originals = originals.select(*[F.col(k).alias(f"o_{k}") for k in key], "original")
    same = [F.col(k) == F.col(f"o_{k}") for k in key]
    met = headers.join(originals, same, "left")
    return met.select("id", *key, F.when(~F.col("id").eqNullSafe(F.col("original")), F.col("original")).alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def record_urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), id_.cast("string"), F.lit(">"))


def http_header(payload: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END))


def record(urn: Callable[[Column], Column] = record_urn) -> Column:
    """The text of one record of columns id, uri, payload, sha1, refers_to, date, http, with the CRLF CRLF after it. The block of a revisit is the HTTP header alone."""
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        _line("WARC-Record-ID", urn(F.col("id"))), _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.regexp_replace("uri", "[\r\n]", "")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(""), _line("WARC-Refers-To", urn(F.col("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block, F.lit(END),
    )


def packed(data: bytes) -> bytes:
    """gzip members, the last without its last byte."""
    out = []
    for at in range(0, max(1, len(data)), MEMBER):
        member = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(member.compress(data[at : at + MEMBER]) + member.flush())
    return b"".join(out)[:-1]


def write_records(texts: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Adds archives of texts(value: whole records as strings of any bytes, size) to path. The most records of an archive follow from the sizes, so that none outgrows what a reader can take."""
    sizes = texts.groupBy((F.col("size") > LARGE).alias("large")).agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("most")).collect()

    def members(values: pd.Series) -> pd.Series:
        return pd.Series([packed(v) for v in values], dtype=object)

    for lot in sizes or [{"large": False, "b": 0, "n": 1, "most": 1}]:
        top = LARGE if not lot["large"] else lot["most"]
        most = max(1, min(archive_bytes * lot["n"] // max(lot["b"], 1), MOST_BYTES // max(top, 1)))
        rows = texts.filter((F.col("size") > LARGE) == lot["large"]) if len(sizes) > 1 else texts
        # a cast leaves bytes as they are, also where they are not UTF-8
        value = F.pandas_udf(members, "binary")(F.col("value").cast("binary")).cast("string")
        rows.select(value.alias("value")).write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", most).text(path)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", date: str = DATE) -> None:
    """A record for every row of pages, in archives under path; equal payloads are written once."""
    payload = text_or_empty(F.col(payload_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    headers = rows.select("id", F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    revisits = resolved(headers, least_bytes).filter("refers_to IS NOT NULL AND id IS NOT NULL").select(F.col("id").alias("r_id"), F.col("sha1").alias("r_sha1"), "refers_to").distinct()
    # written first, so that Spark knows how many there are and moves payloads once at most
    revisits = written(revisits, "revisits")
    met = rows.withColumn("sha1", F.sha1("payload")).join(revisits, (F.col("id") == F.col("r_id")) & (F.col("sha1") == F.col("r_sha1")), "left")
    met = met.withColumn("date", F.lit(date)).withColumn("http", http_header(F.col("payload")))
    size = F.when(F.col("refers_to").isNotNull(), F.lit(0)).otherwise(F.octet_length("payload")).cast("long")
    write_records(met.select(record().alias("value"), size.alias("size")), path, archive_bytes)


def parsed(archive: bytes) -> Iterator[dict]:
    """The records of an archive, one at a time, cut by Content-Length: header fields in lower case, `block`, and `raw`: header and block as they were."""
    stream = gzip.open(io.BytesIO(archive)) if archive[:2] == b"\x1f\x8b" else io.BytesIO(archive)
    while line := stream.readline():
        if not line.strip():
            continue
        head, fields = [line], {}
        while line := stream.readline():
            head.append(line)
            if not line.strip():
                break
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        block = stream.read(int(fields.get("content-length", 0)))
        yield fields | {"block": block, "raw": b"".join(head) + block}


def number_of(urn: str | None) -> int | None:
    """The number that ends an id of this library; None for others."""
    tail = (urn or "").rpartition(":")[2].rstrip(">")
    return int(tail) if (urn or "").startswith("<urn:record:") and tail.lstrip("-").isdecimal() else None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row a record of any archives: urn, number (that ends this library's ids), uri, record_type, date, refers_to (a urn), digest (as the header says, in hex), sha1, sha256, payload_bytes, payload (of responses), http (the header before a payload, and a revisit's block), raw (of all but responses)."""
    names = ["urn", "number", "uri", "record_type", "date", "refers_to", "digest", "sha1", "sha256", "payload_bytes", "payload", "http", "raw"]

    def row(r: dict) -> tuple:
        urn, kind = r.get("warc-record-id"), r.get("warc-type", "")
        payload = http = None
        if kind == "response":
            head, cut, payload = r["block"].partition(b"\r\n\r\n")
            http = head + cut
        elif kind == "revisit":
            http = r["block"]
        whole = payload is not None
        return (
            urn, number_of(urn), r.get("warc-target-uri"), kind, r.get("warc-date"), r.get("warc-refers-to"), hex_digest(r.get("warc-payload-digest")), hashlib.sha1(payload).hexdigest() if whole else None,
            hashlib.sha256(payload).hexdigest() if whole else None, len(payload) if whole else None, payload, http, None if whole else r["raw"],
        )

    def frame(lot: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(lot, columns=names).astype({"number": "Int64", "payload_bytes": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive in pdf["content"]:
                lot, size = [], 0
                for r in parsed(archive):
                    lot.append(row(r))
                    size += len(r["raw"])
                    if len(lot) == 500 or size > 1 << 24:
                        yield frame(lot)
                        lot, size = [], 0
                if lot:
                    yield frame(lot)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "urn string, number long, uri string, record_type string, date string, refers_to string, digest string, sha1 string, sha256 string, payload_bytes long, payload binary, http binary, raw binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row a record of this library's archives: id, uri, record_type, digest (as its header says), payload_bytes and payload (null for revisits), sha1 (of the payload), refers_to."""
    number = F.regexp_extract("refers_to", r"^<urn:record:(-?\d+)>$", 1).try_cast("long")
    return read_records(spark, path).select(F.col("number").alias("id"), "uri", "record_type", "digest", "payload_bytes", "payload", "sha1", number.alias("refers_to"))


def revisit_resolution(records: DataFrame) -> DataFrame:
    """records with the payload's size and digest for revisits too, from the response to which they refer: id, payload_bytes, payload_digest, record_type, refers_to."""
    responses = records.filter("record_type = 'response' AND id IS NOT NULL").select(F.col("id").alias("o_id"), F.col("sha1").alias("o_sha1"), F.col("payload_bytes").alias("o_bytes")).distinct()
    meets = (F.col("refers_to") == F.col("o_id")) & (F.col("digest") == F.col("o_sha1"))
    met = records.drop("payload").join(responses, meets, "left")
    return met.select("id", F.coalesce("payload_bytes", "o_bytes").alias("payload_bytes"), F.coalesce("sha1", "o_sha1").alias("payload_digest"), "record_type", "refers_to")


def archived(pages: DataFrame, path: str | None = None, id_col: str = "page_id", **how) -> DataFrame:
    """Writes the archives of pages and reads them back: id, payload_bytes, payload_digest, record_type, refers_to."""
    path = path or work_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col=id_col, **how)
    return revisit_resolution(read_archives(pages.sparkSession, path).drop("payload")).withColumnRenamed("id", id_col)


def hex_digest(header: str | None) -> str | None:
    """The SHA-1 of a WARC-Payload-Digest header in hex (crawls write Base32); None for other algorithms and values."""
    algorithm, _, value = (header or "").partition(":")
    try:
        data = base64.b32decode(value.upper()) if len(value) == 32 else bytes.fromhex(value)
    except ValueError:
        return None
    return data.hex() if algorithm.strip().lower() in ("sha1", "sha-1") and len(data) == 20 else None


def rewritten(spark: SparkSession, source: str, target: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the archives at source again, each payload once, with fresh WARC headers; dates and HTTP headers stay.

    Headers alone are resolved, so a payload moves with its own record and no other. A revisit is resolved by its
    digest, or by the response that it names where it has none and all responses of that id have one payload; it then
    refers to the response that stays. Revisits whose payload is not here, or is another than they say, and records
    that are neither response nor revisit are written as they were.
    """
    records = written(read_records(spark, source), "records")
    id_ = F.when(F.col("urn").isNotNull(), F.struct("number", "urn"))
    responses = records.filter("record_type = 'response'").withColumn("id", id_)
    heads = responses.select("id", "sha1", "sha256", "payload_bytes")
    again = resolved(heads, least_bytes).filter("refers_to IS NOT NULL AND id IS NOT NULL").select(F.col("id").alias("r_id"), F.col("sha1").alias("r_sha1"), F.col("refers_to").alias("r_to")).distinct()
    kept = responses.join(written(again, "again"), (F.col("id") == F.col("r_id")) & (F.col("sha1") == F.col("r_sha1")), "left").withColumn("to", F.col("r_to"))
    named = heads.filter("id IS NOT NULL").groupBy(F.col("id.urn").alias("o_urn")).agg(F.min("sha1").alias("o_sha1"), F.max("sha1").alias("most")).filter("o_sha1 = most").drop("most")
    firsts = heads.filter("id IS NOT NULL").groupBy(F.col("sha1").alias("p_sha1")).agg(F.max("id").alias("to"))
    sought = records.filter("record_type = 'revisit'").drop("payload", "sha1").withColumn("id", id_).join(named, F.col("digest").isNull() & (F.col("refers_to") == F.col("o_urn")), "left")
    met = written(sought.withColumn("sha1", F.coalesce("digest", "o_sha1")).join(firsts, F.col("sha1") == F.col("p_sha1"), "left"), "revisits")
    columns = ["id", "uri", F.col("payload").cast("string").alias("payload"), "sha1", F.col("to").alias("refers_to"), "date", F.col("http").cast("string").alias("http")]
    fresh = kept.select(*columns).unionByName(met.filter("to IS NOT NULL").withColumn("payload", F.lit(None).cast("binary")).select(*columns))
    fresh = fresh.select(record(lambda x: x["urn"]).alias("value"))
    others = records.filter("record_type NOT IN ('response', 'revisit')").select("raw").unionByName(met.filter("to IS NULL").select("raw"))
    whole = fresh.unionByName(others.select(F.concat(F.col("raw").cast("string"), F.lit(END)).alias("value")))
    write_records(whole.withColumn("size", F.octet_length("value").cast("long")), target, archive_bytes)
