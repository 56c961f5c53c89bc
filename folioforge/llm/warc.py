"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; the exact header of every record (WARC header and HTTP header)
is kept in a table of its own; records are rebuilt by joining the two. Grouping the payloads also compares the
least and the greatest payload of each digest, so equal digests are proved to mean equal bytes before anything is
written. Of the records with one payload, the one with the largest page id becomes the response; the others are
revisits of it.

Layout under ``path``: ``payloads`` (digest, payload) and ``headers`` (digest, header).

Cases: a null html is an empty payload; a null url becomes an empty target; a null page_id sorts below all others;
of rows with the same page_id and payload, the last in input order is the response; an empty table gives an empty
archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.lineage import fresh_path, written_to

# Fixed values of the record format.
_EOL = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = ("HTTP/1.1 200 OK" + _EOL + "Content-Type: text/html; charset=utf-8" + _EOL + "Content-Length: ")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: 40 bits at a time through base conversion, digits then renamed."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))


def _record_id(page_id: Column, number: Column) -> Column:
    """A stable urn from the page and the record's number in the input."""
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), number.cast("string")))
    return F.concat(
        F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _header(date: str) -> Column:
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(_HTTP), F.col("payload_bytes").cast("string"), F.lit(_EOL + _EOL))
    target = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1" + _EOL), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("number"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            _line("WARC-Profile", F.lit(_PROFILE)), _line("WARC-Refers-To", _record_id(F.col("last.page_id"), F.col("last.number"))),
            _line("X-Refers-To-Page-Id", F.coalesce(F.col("last.page_id").cast("string"), F.lit(""))),
        )).otherwise(""),
        _line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", length.cast("string")), F.lit(_EOL), http,
    )


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the archive; payloads under ``min_bytes`` never become revisits."""
    spark = pages.sparkSession
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.unhex(F.sha2("html", 256)))
    numbered = written_to(base.select(
        F.monotonically_increasing_id().alias("number"), "page_id", "url", "digest", base32_sha1(F.col("html")).alias("sha1"),
        F.octet_length("html").cast("long").alias("payload_bytes")), fresh_path(spark, "records"))

    least, greatest = F.min("html"), F.max("html")
    same = F.when(least == greatest, greatest).otherwise(F.raise_error(F.lit("two payloads share one digest")))
    payloads = base.groupBy("digest").agg(F.encode(same, "UTF-8").alias("payload"))
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")

    last = numbered.groupBy("digest").agg(F.max(F.struct("page_id", "number")).alias("last"))
    kind = F.when((F.col("payload_bytes") < min_bytes) | (F.col("number") == F.col("last.number")), "response").otherwise("revisit")
    headers = numbered.join(last, "digest").withColumn("record_type", kind).select("digest", _header(date).alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?dm)^{name}: ([^\r\n]*)\r$", 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, its fields parsed from the header and its payload joined back and checked.

    ``record`` holds the bytes of the WARC record as they would stand in a file. The figures of a payload are
    computed on its stored bytes before the join, so a reader of figures moves no payloads.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    checked = stored.select(
        "digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
        (F.unhex(F.sha2("payload", 256)) == F.col("digest")).alias("intact"))
    joined = spark.read.parquet(f"{path}/headers").join(checked, "digest")
    sound = F.col("intact") & (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest")))
    digest = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not match its record")))
    refers = _field("X-Refers-To-Page-Id")
    block = F.when(_field("WARC-Type") == "revisit", F.to_binary(F.lit(""), F.lit("utf-8"))).otherwise(F.col("payload"))
    return joined.select(
        _field("X-Page-Id").try_cast("bigint").alias("page_id"),
        _field("WARC-Target-URI").alias("url"), _field("WARC-Record-ID").alias("record_id"), "payload_bytes", digest.alias("payload_digest"),
        _field("WARC-Type").alias("record_type"), refers.try_cast("bigint").alias("refers_to"), "payload",
        F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit(_EOL + _EOL), "UTF-8")).alias("record"),
    )
