"""Content-addressed WARC archive.

Two tables are the archive. ``payloads`` holds each payload's bytes once, under their SHA-256 digest; ``headers``
holds every record's exact header, with the digest. A payload's length and SHA-1 are stored beside its digest, and
reading recomputes SHA-256 from the stored bytes and fails on a difference. Records are reconstructed by joining
headers to payloads: a response's block is its payload, a revisit's is empty and refers to the response. What a
record is and refers to is read from its header.

Of records with equal payloads the one with the largest id is the response. Only digests and ids are grouped. Bytes
move once, to be stored, and not at all when only facts about them are read back.

Defined results: a null payload is an empty one; a null or empty url is written as ``about:blank``; control characters
and spaces in urls are percent-encoded; payloads under ``least`` bytes are all responses; rows with equal id and
payload are each a response, with record ids of their own; null ids rank below all others; an empty table gives
empty archives.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, written

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """RFC 4648 base32 of a hex digest of a multiple of 20 bits (SHA-1 has 160): 5 hex digits make 4 characters."""
    out = []
    for group in range(8):
        value = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(ALPHABET), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


@dataclass
class Archive:
    """headers (digest, header) and payloads (digest, payload, n_bytes, sha1); id_type: SQL type of the record ids."""

    headers: DataFrame
    payloads: DataFrame
    id_type: str


def record_urn(record_id: Column, number: Column) -> Column:
    """A record's own name: its id, if it has one, and its number in the archive."""
    return F.concat(F.lit("urn:record:"), F.coalesce(F.concat(F.lit("id-"), F.url_encode(record_id.cast("string"))), F.lit("none")), F.lit(":"), number.cast("string"))


def safe_url(url: Column) -> Column:
    """The url without characters that would break a header line."""
    code = lambda c: F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))
    coded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7F]"), code(c)).otherwise(c)), "")
    return F.when(F.coalesce(url, F.lit("")) == "", "about:blank").when(url.rlike(r"[\x00-\x20\x7F]"), coded).otherwise(url)


def header_bytes(record_type: Column, uri: Column, urn: Column, refers: Column, digest: Column, length: Column, date: str) -> Column:
    """The WARC/1.1 header block of a record, up to and with the empty line."""
    line = "\r\n"
    return F.concat(
        F.lit("WARC/1.1" + line),
        F.lit("WARC-Type: "), record_type, F.lit(line),
        F.lit("WARC-Target-URI: "), safe_url(uri), F.lit(line),
        F.lit(f"WARC-Date: {date}{line}WARC-Record-ID: <"), urn, F.lit(">" + line),
        F.coalesce(F.concat(F.lit(f"WARC-Profile: {PROFILE}{line}WARC-Refers-To: <"), refers, F.lit(">" + line)), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), digest, F.lit(line),
        F.lit(f"Content-Type: text/html; charset=utf-8{line}Content-Length: "), length.cast("string"), F.lit(line + line),
    ).cast("binary")


def write_archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str | None = None) -> Archive:
    """Writes both tables to the shared folder and returns what reads them. date: WARC-Date of the records (now)."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).alias("record_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    facts = rows.select("record_id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
    # written, so that a record keeps its number; and so that the joins below read two plain exchanges and can be split
    facts = written(facts.withColumn("number", F.monotonically_increasing_id()), "warc-facts")
    order = F.struct(F.col("record_id").isNotNull().alias("has"), "record_id", (-F.col("number")).alias("number"))
    first = facts.groupBy("digest").agg(F.max(order).alias("top"))
    first = written(first.select("digest", F.col("top.record_id").alias("response"), (-F.col("top.number")).alias("response_number")), "warc-responses")
    revisit = (F.col("n_bytes") >= least) & ~F.col("record_id").eqNullSafe(F.col("response"))
    kind = F.when(revisit, "revisit").otherwise("response")
    refers = F.when(revisit, record_urn(F.col("response"), F.col("response_number")))
    length = F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    header = header_bytes(kind, F.col("url"), record_urn(F.col("record_id"), F.col("number")), refers, base32_of_hex(F.col("sha1")), length, date)
    headers = written(facts.join(first, "digest").select("digest", header.alias("header")), "warc-headers")
    # the response's row brings the bytes; rows of equal id and payload meet in one task, so the bytes travel once
    rid = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    bring = rows.select(F.sha2("payload", 256).alias("digest"), rid("record_id").alias("rid"), "payload")
    bring = bring.join(first.select("digest", rid("response").alias("rid")), ["digest", "rid"], "left_semi").dropDuplicates(["digest", "rid"])
    stored = written(bring.select("digest", "payload", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("sha1")), "warc-payloads")
    forget(facts, first)
    return Archive(headers, stored, df.schema[id_col].dataType.simpleString())


def read_payloads(archive: Archive) -> DataFrame:
    """Stored payloads; bytes that do not have their digest, length and SHA-1 raise an error."""
    fits = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("n_bytes")) & (F.sha1("payload") == F.col("sha1"))
    # the check yields the digest itself, so no reader of the digest can skip it
    proven = F.when(fits, F.col("digest")).otherwise(F.raise_error(F.lit("payload does not match its digest")))
    return archive.payloads.select(proven.alias("digest"), "payload", "n_bytes", "sha1")


def header_field(name: str) -> Column:
    """The value of a field of the column ``header``; null without it."""
    text = F.col("header").cast("string")
    return F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def named_id(urn: Column, id_type: str) -> Column:
    """The id in a record's name."""
    coded = F.regexp_extract(urn, r"^<urn:record:id-(.*):\d+>$", 1)
    return F.when(urn.startswith("<urn:record:id-"), F.url_decode(coded).cast(id_type))


def read_archive(archive: Archive) -> DataFrame:
    """Every record: record_id, record_type, refers_to, target_uri, payload_digest (all from the header), header, payload (of
    revisits too), n_bytes and sha1."""
    records = archive.headers.join(read_payloads(archive), "digest")
    return records.select(
        named_id(header_field("WARC-Record-ID"), archive.id_type).alias("record_id"), header_field("WARC-Type").alias("record_type"),
        named_id(header_field("WARC-Refers-To"), archive.id_type).alias("refers_to"), header_field("WARC-Target-URI").alias("target_uri"),
        F.substring_index(header_field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"), "digest", "header", "payload", "n_bytes", "sha1",
    )


def record_bytes() -> Column:
    """Exact bytes of a record of ``read_archive``: header, block and the closing empty lines."""
    return F.concat("header", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n"))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    records = read_archive(write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select(F.col("record_id").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h FROM pages),
m AS (SELECT page_id, octet_length(payload) AS n, h, max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM m
"""
