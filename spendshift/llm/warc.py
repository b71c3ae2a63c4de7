"""A content-addressed WARC archive: payload bytes once by digest, exact headers apart.

``write`` makes one WARC 1.1 record per page. Of the pages with equal payloads the one with
the largest id is written as a response, the others as revisits that name it. The archive
is two Parquet tables: ``headers`` holds every record's exact header block (and HTTP header
block for responses), ``payloads`` the bytes of each distinct payload under its SHA-256.
``read`` parses the header blocks, checks every stored payload against its address, length
and SHA-1, and joins the two; ``records`` rebuilds the records byte for byte.

Payload bytes are shuffled once, by digest, after copies within a task are folded; ids are
what is compared. A payload that a third of the pages share is one stored row.

Defined cases: a null html is an empty payload; a null url gives no target line, and line
breaks in a url are percent-encoded; a null id never is the response while another id has
the payload, and is its own response otherwise; rows that repeat the largest id of a
payload are all responses; pages whose payload is below ``least_bytes`` are all responses;
an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HEX_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAK = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 32 digits, no padding."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * n, 10), 16, 32), 8, "0") for n in range(4)]
    return F.translate(F.concat(*groups), _HEX_DIGITS, _BASE32)


def _record_id(page: Column, url: Column, digest: Column) -> Column:
    """A name that depends on the row alone, in the form of a version 5 UUID."""
    name = F.sha1(F.concat_ws("\n", F.coalesce(page.cast("string"), F.lit("none")), F.coalesce(url, F.lit("")), F.hex(digest)).cast("binary"))
    parts = [F.substring(name, 1, 8), F.substring(name, 9, 4), F.concat(F.lit("5"), F.substring(name, 14, 3)),
             F.concat(F.lit("8"), F.substring(name, 18, 3)), F.substring(name, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_BREAK)), F.lit(""))


def write(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date: str = "2000-01-01T00:00:00Z", least_bytes: int = 0,
) -> None:
    """Write the archive of ``pages`` below ``folder`` (shared by all executors)."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("address", F.unhex(F.sha2("payload", 256)))
    # One row per payload; a task folds its own copies before the bytes travel.
    stored = rows.groupBy("address").agg(F.any_value("payload").alias("payload"))
    stored.select("address", "payload", F.octet_length("payload").cast("long").alias("bytes")).write.parquet(f"{folder}/payloads")

    told = rows.select(
        "page", "url", "address", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1")
    )
    latest = told.groupBy("address").agg(F.max("page").alias("latest"))
    placed = told.join(latest, "address")
    again = F.coalesce((F.col("page") != F.col("latest")) | (F.col("page").isNull() & F.col("latest").isNotNull()), F.lit(False))
    again = again & (F.col("bytes") >= least_bytes)
    refers = F.when(again, F.col("latest"))
    http = F.when(~again, F.concat(
        F.lit(f"HTTP/1.1 200 OK{_BREAK}Content-Type: text/html; charset=utf-8{_BREAK}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(_BREAK * 2),
    )).otherwise("")
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{_BREAK}"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page"), F.col("url"), F.col("address"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("X-Page-Id", F.col("page").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("X-Payload-Length", F.col("bytes").cast("string")),
        _line("WARC-Profile", F.when(again, F.lit(_PROFILE))),
        _line("X-Refers-To-Page-Id", refers.cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{_BREAK}"),
        _line("Content-Length", F.when(again, F.lit(0)).otherwise(F.octet_length(http) + F.col("bytes")).cast("string")),
        F.lit(_BREAK),
    )
    placed.select("address", header.alias("header"), http.alias("http")).write.parquet(f"{folder}/headers")


def _field(name: str) -> Column:
    value = F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def verified_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(address, payload, bytes, sha1) of every stored payload; fails on one that is not what its address says."""
    stored = spark.read.parquet(f"{folder}/payloads")
    sound = (F.unhex(F.sha2("payload", 256)) == F.col("address")) & (F.octet_length("payload") == F.col("bytes"))
    checked = F.when(sound, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.hex("address"))).cast("binary")
    )
    return stored.select("address", checked.alias("payload")).select(
        "address", "payload", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1")
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, url, refers_to, address, payload_bytes, payload_digest) per record.

    What the headers claim is checked against the stored payload; a difference fails the read.
    """
    payloads = verified_payloads(spark, folder).select("address", "bytes", "sha1")
    joined = spark.read.parquet(f"{folder}/headers").join(payloads, "address", "left")
    said = F.concat_ws(":", _field("WARC-Payload-Digest"), _field("X-Payload-Length"))
    true = F.concat_ws(":", F.lit("sha1"), "sha1", F.col("bytes").cast("string"))
    digest = F.when(F.coalesce(said == true, F.lit(False)), F.col("sha1")).otherwise(
        F.raise_error(F.concat(F.lit("header and payload differ: "), F.col("header"))).cast("string")
    )
    return joined.select(
        _field("X-Page-Id").cast("long").alias("page_id"), _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("url"), _field("X-Refers-To-Page-Id").cast("long").alias("refers_to"),
        "address", F.col("bytes").alias("payload_bytes"), digest.alias("payload_digest"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(record, payload): every record's exact bytes, and the full payload it stands for."""
    payloads = verified_payloads(spark, folder).select("address", "payload")
    body = F.when(F.col("http") != "", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), body, F.lit((_BREAK * 2).encode()))
    return spark.read.parquet(f"{folder}/headers").join(payloads, "address").select(record.alias("record"), "payload")
