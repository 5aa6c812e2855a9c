"""Content-addressed WARC archive: payload bytes once per SHA-256, record headers apart.

``write(pages, path)`` makes two tables under ``path``
- ``payloads``: one row per distinct payload (digest, bytes), zstd Parquet. Equal digests are
  checked to be equal bytes (length and a second, independent hash agree) before one is kept.
- ``headers``: one row per record with the exact WARC header block and HTTP header block.
``read(path)`` joins both and yields each original record; ``record`` holds the whole WARC record.

Records with payloads of at least ``MIN_REVISIT`` bytes that equal another record's: the one with
the smallest page_id is a response, the others are revisits that refer to it. Smaller payloads are
all responses.

Inputs and defined results
- null html: an empty payload. Null url: an empty target URI. Very long payloads are whole.
- null page_id: sorts after all ids; if no record of the group has an id, all are responses.
- repeated rows (same page_id and payload): each is a record; those with the smallest id are responses.
- empty tables: an empty archive. Extra columns of any name are ignored.

No group of equal payloads meets in one task: the smallest id per digest is an aggregate that is
combined before the shuffle, and the joins on the digest are plain equi-joins that adaptive
execution splits where one digest is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import scratch

MIN_REVISIT = 100
CRLF = "\r\n"
UUID = "urn:uuid:00000000-0000-4000-8000-"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class CorruptArchive(RuntimeError):
    pass


def _uri(page_id) -> F.Column:
    """<urn:uuid:...> of a page id, 12 hex digits or more."""
    return F.concat(F.lit(f"<{UUID}"), F.lpad(F.lower(F.hex(page_id)), 16, "0"), F.lit(">"))


def _header(kind: str, length, has_target: bool = False):
    """The header block of one record kind as a column over page_id, url, digest, target."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), F.coalesce(_uri(F.col("page_id")), F.lit("<none>"))), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit("")))]
    lines += [F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))]
    if has_target:
        lines += [F.concat(F.lit("WARC-Refers-To: "), _uri(F.col("target"))), F.lit(f"WARC-Profile: {PROFILE}")]
    lines += [F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), length.cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write(pages: DataFrame, path: str) -> None:
    """Write the archive's two tables; raises CorruptArchive if two payloads share a digest."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    check = F.xxhash64("payload")
    stored = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("bytes").alias("bytes"), (F.min(F.struct("bytes", check)) == F.max(F.struct("bytes", check))).alias("same"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    spark = pages.sparkSession
    if spark.read.parquet(f"{path}/payloads").where("not same").limit(1).count():
        raise CorruptArchive("different payloads with one SHA-256")
    smallest = rows.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n")
    lean = rows.drop("payload")
    marked = lean.join(smallest, "digest", "left").withColumn("revisit", F.coalesce((F.col("bytes") >= MIN_REVISIT) & (~F.col("page_id").eqNullSafe(F.col("target"))) & F.col("target").isNotNull(), F.lit(False)))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    head = F.octet_length("http_header").cast("long")
    marked.withColumn("http_header", http).select(
        "page_id",
        "digest",
        F.when(F.col("revisit"), _header("revisit", head, True)).otherwise(_header("response", head + F.col("bytes"))).alias("warc_header"),
        "http_header",
    ).write.option("compression", "zstd").parquet(f"{path}/headers")


def field(name: str):
    """A header field's value, null where there is none."""
    got = F.regexp_extract("warc_header", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(got != "", got)


def _page(uri):
    return F.conv(F.regexp_extract(uri, f"{UUID}([0-9a-f]+)", 1), 16, -10).cast("long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each record: page_id, record_type, refers_to, url, digest, payload (whole, also of revisits), record (bytes as in a WARC file)."""
    heads = spark.read.parquet(f"{path}/headers").select(
        _page(field("WARC-Record-ID")).alias("page_id"),
        field("WARC-Type").alias("record_type"),
        F.when(field("WARC-Refers-To").isNotNull(), _page(field("WARC-Refers-To"))).alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_extract("warc_header", r"WARC-Payload-Digest: sha256:([0-9a-f]+)", 1).alias("digest"),
        "warc_header",
        "http_header",
    )
    stored = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    own = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.lit(b"\r\n\r\n")
    record = F.concat(F.encode("warc_header", "UTF-8"), F.encode("http_header", "UTF-8"), own, end)
    return heads.join(stored, "digest", "left").withColumn("record", record)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to an archive and return its records as read back."""
    spark = pages.sparkSession
    path = path or scratch.new_dir(spark, "warc")
    write(pages, path)
    return read(spark, path)


def report(records: DataFrame) -> DataFrame:
    """Digest and length are taken from the payload that came back, not from the header."""
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""
