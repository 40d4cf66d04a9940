"""WARC archives: writing pages as transactions, reading records back, and assembling captures.

``write_pages`` gives three records for every page: the request, the response (or a revisit of an equal payload's
response), and metadata that holds the page's id; request and metadata name the response in WARC-Concurrent-To.
Spark's text writer puts the records out, with the record terminator as its line separator, as .gz files that it
commits task by task.

``read_records`` streams archives: files are cut at what looks like a record's start, and Content-Length decides
whether it is one, so payloads may hold any bytes. A .gz file is read by one task, record by record.

``captures`` joins request, response and metadata records through their concurrent-to identifiers (given on either
side, or by way of the request) and gives one nested row for each response or revisit. ``requests`` and ``metadatas``
hold all its partners in the order of their ids, ``request`` and ``metadata`` the first. Requests and metadata that
reach no response, and records of other kinds, are rows of their own; a missing partner is null.

Null html is an empty payload. Pages with equal payloads: the smallest page_id (null last) is the response, of
repeated rows the first in the scan. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_path, written

END = "\r\n\r\n"
CUT = END + "WARC/1."
#: The date of records that have no better one.
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are always responses.
LEAST_REVISIT_BYTES = 0


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hexadecimal digits are 4 of base 32."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def urn(row: Column, kind: str) -> Column:
    h = F.sha2(F.concat_ws(":", F.lit(kind), row.cast("string")), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def record(headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """A record without its terminator; headers that are null are left out."""
    lines = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v), F.lit("\r\n")) for k, v in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(x, F.lit("")) for x in lines], length, block)


def write_pages(pages: DataFrame, path: str, least: int = LEAST_REVISIT_BYTES) -> None:
    """Writes ``pages`` (page_id, url, html) as archives under ``path``. The table has to read the same twice."""
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20").alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
    keys = rows.select("row", "page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= least)
    first = keys.groupBy("digest", "size").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first"))
    again = keys.join(first.hint("merge"), ["digest", "size"]).where("row <> first.row").select("row", F.col("first.row").alias("of"))
    placed = rows.join(again.hint("merge"), "row", "left")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    host = F.regexp_extract("url", r"^[a-z+]+://([^/?#]*)", 1)
    target = F.regexp_replace("url", r"^[a-z+]+://[^/?#]*", "")
    get = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    seen = F.col("of").isNotNull()
    main = urn(F.col("row"), "response")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", F.col("url"))]
    response = [("WARC-Type", F.when(seen, "revisit").otherwise("response")), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html").cast("binary")))), ("WARC-Profile", F.when(seen, REVISIT)), ("WARC-Refers-To", F.when(seen, urn(F.col("of"), "response"))), ("Content-Type", "application/http; msgtype=response")]
    request = [("WARC-Type", "request"), ("WARC-Record-ID", urn(F.col("row"), "request")), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")]
    metadata = [("WARC-Type", "metadata"), ("WARC-Record-ID", urn(F.col("row"), "metadata")), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")]
    fields = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    records = F.array(record(request, get), record(response, F.concat(http, F.when(seen, "").otherwise(F.col("html")))), record(metadata, fields))
    placed.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 60_000).text(path)


RECORD = """record_id string, record_type string, target_uri string, date string, concurrent_to array<string>, refers_to string,
content_type string, header_digest string, http_length long, payload_bytes long, payload_digest string, fields map<string,string>, block binary"""


def parsed(data: bytes, with_block: bool) -> dict | None:
    """The record in ``data``, None while it is not whole yet."""
    head = data.find(b"\r\n\r\n")
    if head < 0:
        return None
    headers: dict[str, list[str]] = {}
    for line in data[:head].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers.setdefault(name.strip().lower(), []).append(value.strip())
    length = int(headers.get("content-length", ["0"])[0])
    if len(data) < head + 4 + length:
        return None
    block = data[head + 4 : head + 4 + length]
    one = lambda name: headers.get(name, [None])[0]
    kind, http, payload, fields = one("warc-type"), None, block, {}
    if (one("content-type") or "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        for line in top.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            if name.strip().lower() == "content-length" and value.strip().isdigit():
                http = int(value)
    elif one("content-type") == "application/warc-fields":
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if v}
    return {
        "record_id": one("warc-record-id"), "record_type": kind, "target_uri": one("warc-target-uri"), "date": one("warc-date"), "concurrent_to": headers.get("warc-concurrent-to", []),
        "refers_to": one("warc-refers-to"), "content_type": one("content-type"), "header_digest": one("warc-payload-digest"), "http_length": http, "payload_bytes": len(payload),
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "fields": list(fields.items()), "block": block if with_block else None,
    }


def read_records(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """All records of the archives under ``path``; digests are computed over the payloads read."""
    chunks = spark.read.option("lineSep", CUT).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("chunk"))
    schema = spark.createDataFrame([], RECORD).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        file, held = None, b""
        for batch in batches:
            rows = []
            for name, chunk in zip(batch.column("file").to_pylist(), batch.column("chunk").to_pylist()):
                if name != file and held:
                    raise ValueError(f"{file} ends within a record")
                held = held + CUT.encode() + chunk if held and name == file else chunk
                file = name
                found = parsed(held, with_block) if held.strip() else {}
                if found is not None:
                    held = b""
                    if found:
                        rows.append(found)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        if held:
            raise ValueError(f"{file} ends within a record")

    return chunks.mapInArrow(run, schema)


def captures(records: DataFrame) -> DataFrame:
    """One row per response or revisit: the record's columns, and its requests and metadata as structs; and the rest."""
    main = F.coalesce(F.col("record_type").isin("response", "revisit"), F.lit(False))
    partner = F.coalesce(F.col("record_type").isin("request", "metadata"), F.lit(False))
    given = records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    ties = given.union(given.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ids = records.where(main).select(F.col("record_id").alias("capture"))
    direct = ties.join(ids.hint("merge"), F.col("b") == F.col("capture")).select(F.col("a").alias("other"), "capture")
    onward = ties.join(direct.hint("merge"), F.col("b") == F.col("other")).where(F.col("a") != F.col("capture")).select(F.col("a").alias("other"), "capture")
    partners = direct.union(onward).distinct()
    rest = records.where(partner)
    kept = [c for c in records.columns if c not in ("concurrent_to",)]
    met = rest.join(partners.hint("merge"), F.col("record_id") == F.col("other")).select("capture", "record_type", F.struct(*kept).alias("r"))
    by_id = lambda a, b: F.when(a.record_id < b.record_id, -1).when(a.record_id > b.record_id, 1).otherwise(0)
    nested = met.groupBy("capture").agg(*[F.array_sort(F.collect_list(F.when(F.col("record_type") == k, F.col("r"))), by_id).alias(name) for k, name in (("request", "requests"), ("metadata", "metadatas"))])
    matched = partners.select("other").distinct().hint("merge")
    own = records.join(matched, (F.col("record_id") == F.col("other")) & partner, "left_anti")
    found = own.join(nested.hint("merge"), F.col("record_id") == F.col("capture"), "left").drop("capture")
    return found.withColumns({"request": F.get("requests", F.lit(0)), "metadata": F.get("metadatas", F.lit(0))})


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back as a capture."""
    path = new_path(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = captures(written(read_records(spark, path, with_block=False).drop("block"), "records")).where("record_type in ('response', 'revisit')")  # narrow, and joined several times
    revisit = F.col("record_type") == "revisit"
    pages = found.select(
        F.expr("metadata.fields['page-id']").cast("long").alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("header_digest", "^sha1:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "record_id", F.col("refers_to").alias("_of"),
    )
    of = pages.where("record_type = 'response'").select(F.col("record_id").alias("_of"), F.col("page_id").alias("refers_to"))
    return pages.drop("record_id").join(of.hint("merge"), "_of", "left").drop("_of")


#: DuckDB has no base32: the SHA-1 is regrouped by 5 hexadecimal digits.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, html,
             row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS n, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS first_id FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substring(h, CAST(5 * i + 1 AS INT), 5) AS BIGINT)) AS g FROM k)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(flatten(list_transform(g, lambda x: list_transform([15, 10, 5, 0], lambda s: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS INT) + 1, 1)))), 'string_agg', '') AS payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first_id END AS refers_to
FROM v
"""
