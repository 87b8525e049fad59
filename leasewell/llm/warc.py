"""A content-addressed WARC archive.

``write_archive`` keeps two tables below a folder: ``payloads`` holds the bytes of every distinct payload once, under
its SHA-256, and ``records`` the exact head of every record (WARC header block and HTTP head, byte for byte) with the
digest of its payload.  Digests are verified: rows that share one must agree in length and SHA-1 when written, and
stored bytes are hashed again when read.  ``read_archive`` joins heads and payloads into the original records;
``export_warc`` and ``import_warc`` exchange them with plain ``.warc`` files.

Of the records with equal payloads of at least ``REVISIT_BYTES`` bytes, the one of largest id is a ``response`` and
the others are ``revisit`` records of it; smaller payloads are stored once too, but all their records are responses.

Only light rows are grouped by digest (pre-aggregated); payload bytes are shuffled by page id when the archive is
written, and each distinct payload once by digest when records are rebuilt.  The joins by digest read written tables on
both sides, so that adaptive execution can split the join partition of a payload that a third of the pages share.

Defined cases: null html is an empty payload; a row with a null id gives no record; a null url gives no target line;
line breaks in a url are percent-encoded; rows that repeat id and html give a record each, of the same type.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 1000
#: The tables have no fetch time; all records carry this one unless a column is named.
DATE = "2024-01-01T00:00:00Z"
_ID = "urn:x-leasewell:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _agreed(column: str) -> Column:
    same = F.min(column).eqNullSafe(F.max(column))
    return F.when(same, F.max(column)).otherwise(F.raise_error(F.lit(f"two payloads share a digest but not their {column}")))


def _heads(record_type: Column) -> tuple[Column, Column]:
    """The WARC header block and the HTTP head of a record."""
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(record_type == "response", F.col("payload_bytes")).otherwise(0)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    revisit = F.concat(line("WARC-Refers-To", F.concat(F.lit(f"<{_ID}"), F.col("owner").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(_PROFILE)))
    block = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", F.concat(F.lit(f"<{_ID}"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(record_type == "revisit", revisit).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length),
        F.lit("\r\n"),
    )
    return block, http


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record for each page."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload")).where("page_id is not null")
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows.select("page_id", "url", "digest", F.sha1("payload").alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes")).write.parquet(f"{path}/pages")
    light = spark.read.parquet(f"{path}/pages")
    light.groupBy("digest").agg(F.max("page_id").alias("owner"), _agreed("payload_bytes").alias("bytes"), _agreed("payload_digest").alias("sha1")).write.parquet(f"{path}/owners")
    owners = spark.read.parquet(f"{path}/owners")

    held = rows.join(owners.select(F.col("owner").alias("page_id"), F.col("digest").alias("owned")), "page_id")
    held.where("digest = owned").dropDuplicates(["page_id", "digest"]).select("digest", "payload").write.parquet(f"{path}/payloads")

    joined = light.join(owners.select("digest", "owner"), "digest")
    kind = F.when((F.col("payload_bytes") >= REVISIT_BYTES) & (F.col("page_id") < F.col("owner")), "revisit").otherwise("response")
    block, http = _heads(kind)
    joined.select("page_id", "digest", F.encode(F.concat(block, http), "UTF-8").alias("head")).write.parquet(f"{path}/records")


def _field(head: Column, name: str) -> Column:
    """The value of a WARC header line, null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_extract(head, r"(?s)^(.*?)\r\n\r\n", 1), rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))


def _rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, head, record, payload, digest) of every record: its exact head joined with its payload, whose digest is
    verified."""
    records, stored = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    wrong = F.raise_error(F.lit("a stored payload does not have its digest"))
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong)
    rows = records.join(stored, "digest").select("page_id", "digest", F.decode("head", "UTF-8").alias("text"), "head", checked.alias("payload"))
    body = F.when(_field(F.col("text"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.withColumn("record", F.concat("head", body))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of each page, from its rebuilt record and full payload: page_id, payload_bytes,
    payload_digest, record_type, refers_to, target_uri.

    A record must be as long as its head says, and its payload have the digest that the head names.
    """
    text = F.col("text")
    number = lambda name: F.regexp_extract(_field(text, name), r":(-?\d+)>$", 1).cast("long")
    start = F.octet_length(F.substring_index("text", "\r\n\r\n", 1)) + 4
    whole = F.length("record") == start + _field(text, "Content-Length").cast("long")
    sha1 = F.sha1("payload")
    same = _field(text, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), sha1)
    digest = F.when(whole & same, sha1).otherwise(F.raise_error(F.lit("a record is not what its head says")))
    return _rebuilt(spark, path).select(
        number("WARC-Record-ID").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        _field(text, "WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        _field(text, "WARC-Target-URI").alias("target_uri"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record, payload): the original records, byte for byte, and their full payloads."""
    return _rebuilt(spark, path).select("page_id", "record", "payload")


def export_warc(spark: SparkSession, path: str, out: str) -> None:
    """Write the records as WARC files, one for each task; records end in two line breaks, as the format asks."""
    read_archive(spark, path).select(F.decode("record", "UTF-8").alias("value")).write.option("lineSep", "\r\n\r\n").text(out)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, record_type, record) of WARC files: each file is cut by the Content-Length of its records.

    page_id is null for records that another writer made.  A file is read as a row, so it must be under 2 GB.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                found, at = [], 0
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    lines = {name.strip().lower(): value.strip() for name, _, value in (x.partition(b":") for x in data[at:end].split(b"\r\n")[1:] if x)}
                    stop = end + int(lines[b"content-length"])
                    own = lines.get(b"warc-record-id", b"").decode("utf-8", "replace").strip("<>")
                    page = int(own[len(_ID) :]) if own.startswith(_ID) else None
                    found.append((own, page, lines.get(b"warc-type", b"").decode(), data[at:stop]))
                    at = stop + 4
                out = pd.DataFrame(found, columns=["record_id", "page_id", "record_type", "record"])
                out["page_id"] = out["page_id"].astype("Int64")
                yield out

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0 and path rlike '/(part-[^/]*|[^/]*[.]warc)$'").select("content").mapInPandas(cut, "record_id string, page_id long, record_type string, record binary")
