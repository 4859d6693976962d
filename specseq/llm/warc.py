"""WARC archives: writing, reading and revisit resolution.

Records are written by Spark's text writer: a record is one "line" of head and
block, and the line separator is the two line ends that close a WARC record.
Files are read back whole, one gzip file a row, and walked by Content-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EOL = "\r\n"
#: Fixed value: the profile of revisits by equal payload digest, from the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: the alphabet of base32 in RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to_id string, payload binary"
#: A payload that many pages share is joined in so many parts.
SALTS = 16


def sha1_base32(text: Column) -> Column:
    """SHA-1 of a string's UTF-8 bytes as bare upper-case base32."""
    digest = F.sha1(text.cast("binary"))
    quads = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*quads)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(page_id: Column) -> Column:
    """A URN made from the page's id, the same in each run."""
    d = F.md5(F.coalesce(page_id.cast("string"), F.lit("null")).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Decide for each row of pages (page_id, url, html) whether it is a response or a revisit.

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the
    smallest page_id is the response and the others revisit it; smaller payloads
    are all responses. A null html is an empty payload. Repeated rows of the
    smallest page_id are all responses; a null page_id counts after all others,
    and where a payload has only null ids, all its rows are responses.

    Headers (digest and id) alone are aggregated; the payloads move once, in a
    join whose left side is dealt in SALTS parts for each digest.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": sha1_base32(F.col("html"))})
    firsts = (
        rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null").select("payload_digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = rows.join(firsts, ["payload_digest", "salt"], "left")
    other = F.coalesce((F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("first_id")).alias("refers_to"),
    )


def write_warc(marked: DataFrame, path: str) -> None:
    """Write the rows of mark_revisits() as gzipped WARC files under path, with fresh headers.

    A revisit keeps its HTTP head and drops its payload. Line ends within a URL
    become spaces; a null URL or page_id leaves its header out.
    """
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL + EOL))
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "html"))

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))

    head = F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.col("record_type"), F.lit(EOL),
        header("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("page_id")), F.lit(">"))),
        F.lit(f"WARC-Date: 2000-01-01T00:00:00Z{EOL}"),
        header("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]+", " ")),
        header("X-Page-ID", F.col("page_id").cast("string")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), record_id(F.col("refers_to")), F.lit(">")))),
        F.lit(f"Content-Type: application/http;msgtype=response{EOL}Content-Length: "), F.octet_length("block").cast("string"), F.lit(EOL + EOL),
    )
    lines = marked.withColumn("http", http).withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))
    lines.write.option("lineSep", EOL + EOL).option("compression", "gzip").text(path)


def walk(data: bytes) -> Iterator[dict]:
    """The records of one uncompressed WARC file. Raises ValueError on a broken record."""
    at, end = 0, len(data)
    while at < end:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode()
        size = int(head["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} is cut off")
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        revisit = head.get("warc-type") == "revisit"
        yield {
            "record_id": head.get("warc-record-id", "").strip("<>"),
            "record_type": head.get("warc-type"),
            "page_id": int(head["x-page-id"]) if "x-page-id" in head else None,
            "url": head.get("warc-target-uri"),
            "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            "payload_bytes": stated if revisit else len(payload),
            "refers_to_id": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            "payload": None if revisit else payload,
        }
        at = stop + 4 + size + 4


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of RECORD from WARC files written by write_warc() (gzip or plain). Digests and lengths of responses are computed from the stored payload."""
    schema = RECORD if payloads else RECORD.rpartition(",")[0]
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, held = [], 0
                for row in walk(data):
                    rows.append({k: row[k] for k in names})
                    held += len(row["payload"] or b"") + 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=fields)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Join revisits to the responses they name; a revisit gets the original's page_id, digest and length.

    A revisit whose original is missing keeps what its own headers say and has a
    null refers_to. Only responses that some revisit names enter the join, and
    they are dealt in SALTS parts, as one may be named by a third of all records.
    """
    head = records.select("record_id", "record_type", "page_id", "payload_digest", "payload_bytes", "refers_to_id")
    named = head.where("refers_to_id is not null").select(F.col("refers_to_id").alias("record_id")).distinct()
    targets = (
        head.where("record_type = 'response'").join(named, "record_id", "left_semi")
        .groupBy("record_id").agg(F.min("page_id").alias("t_id"), F.min("payload_digest").alias("t_digest"), F.min("payload_bytes").alias("t_bytes"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("record_id", "refers_to_id")
    )
    salted = head.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    # Responses name nothing; a null key would gather them all in one partition.
    revisits, rest = salted.where("refers_to_id is not null"), salted.where("refers_to_id is null")
    done = revisits.join(targets, ["refers_to_id", "salt"], "left").select(
        "page_id", F.coalesce("t_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("t_digest", "payload_digest").alias("payload_digest"), "record_type", F.col("t_id").alias("refers_to")
    )
    return rest.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(done)
