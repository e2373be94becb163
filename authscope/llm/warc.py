"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; record headers are stored exactly, apart from them. The bytes of
a record are its header block, the stored payload (none for a revisit) and the record's end, put together by a
join on the digest. What is read back is parsed from these bytes and verified: a payload that doesn't hash to its
key, or to what its header says, stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authscope.llm.common import ROW_ID, by_row, materialize, new_path, position, release, sweep, with_row_id

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: eight groups of 20 bits, four letters each."""
    hexed, letters = F.sha1(payload), []
    for group in range(8):
        bits = F.conv(F.substring(hexed, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), (F.shiftright(bits, shift).bitwiseAND(31) + 1), F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _line(name: str, value) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(CRLF))


def facts(rows: DataFrame) -> DataFrame:
    """(row, page_id, url, digest, bytes, sha1) of rows (page_id, url, payload, row identity): what is said of every page,
    without its payload; `row` names it for good."""
    body = F.col("payload")
    row = F.lower(F.lpad(F.hex(F.xxhash64(*ROW_ID)), 16, "0"))
    return rows.select(*ROW_ID, row.alias("row"), "page_id", "url", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes"), base32_sha1(body).alias("sha1"))


def headers(found: DataFrame, firsts: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, record_type, header): the exact header block of every page's record, as bytes.

    Of pages with equal payloads one is the response, the first by id and row; the others refer to its record. Pages
    without id, and payloads under `least` bytes, are all responses. An HTTP header block precedes the payload of both.
    """
    rows = found.join(firsts.select(F.col("digest").alias("_digest"), "first"), F.col("digest") == F.col("_digest"), "left")
    response = F.col("first").isNull() | F.col("page_id").isNull() | (F.col("row") == F.col("first.row")) | (F.col("bytes") < least)
    record_id = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row, F.lit(">"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.octet_length(http) + F.when(response, F.col("bytes")).otherwise(0)
    kind = F.when(response, F.lit("response")).otherwise(F.lit("revisit"))
    refers = _line("WARC-Refers-To", record_id(F.col("first.page_id"), F.col("first.row")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", record_id(F.col("page_id"), F.col("row"))),
        _line("WARC-Date", DATE),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(response, F.lit("")).otherwise(F.concat(refers, _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", block.cast("string")),
        F.lit(CRLF),
        http,
    )
    return rows.select("page_id", "digest", kind.alias("record_type"), F.encode(head, "UTF-8").alias("header"))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", html: str = "html", url: str = "url", least: int = 0) -> None:
    """Write the payload store and the headers under path.

    Firsts are found on rows without payload; each distinct payload is then written by one of its rows, so a payload that
    most pages share costs no more than another. Payloads are moved only if there are too many to broadcast which rows. Null html is an empty payload; a null url gets a urn; rows that repeat an id, or
    lack one, are records of their own; no rows make an empty archive. Other columns are ignored, whatever they are called.
    """
    c = lambda name: F.col(f"c{position(pages, name)}")
    body = F.encode(F.coalesce(c(html).cast("string"), F.lit("")), "UTF-8")
    rows = with_row_id(pages, "pages").select(*ROW_ID, c(key).cast("long").alias("page_id"), c(url).cast("string").alias("url"), body.alias("payload"))
    narrow = materialize(facts(rows), "facts")
    firsts = narrow.filter("page_id is not null").groupBy("digest").agg(F.min(F.struct("page_id", "row", *ROW_ID)).alias("first"))
    headers(narrow, firsts, least).write.parquet(f"{path}/headers")
    # every payload by one of its rows: the first with an id, else any
    keepers = narrow.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "row", *ROW_ID)).alias("k")).select("digest", *[F.col(f"k.{c}").alias(c) for c in ROW_ID])
    keepers = materialize(keepers, "keepers", narrow)
    by_row(rows, keepers, "inner").select("digest", "payload").write.parquet(f"{path}/payloads")
    release(keepers)
    sweep(pages.sparkSession)


def read_payloads(spark, path: str) -> DataFrame:
    """The payload store, every payload verified against its digest."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    good = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload store: wrong bytes for "), F.col("digest"))))
    return stored.select("digest", good.cast("binary").alias("payload"))


def read_records(spark, path: str) -> DataFrame:
    """(page_id, record): every record's exact bytes. Responses meet their payload by digest, which few of them share;
    a revisit holds no payload and meets none."""
    heads = spark.read.schema("page_id long, digest string, record_type string, header binary").parquet(f"{path}/headers")
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    missing = F.raise_error(F.concat(F.lit("payload store: nothing for "), F.col("digest"))).cast("binary")
    whole = heads.filter("record_type = 'response'").join(read_payloads(spark, path), "digest", "left")
    whole = whole.select("page_id", F.concat("header", F.coalesce("payload", missing), end).alias("record"))
    return whole.unionByName(heads.filter("record_type = 'revisit'").select("page_id", F.concat("header", end).alias("record")))


def parse(records: DataFrame) -> DataFrame:
    """(fields of the header, block, payload) of every record, from its bytes alone: WARC header up to the first empty
    line, a block of Content-Length bytes, in it an HTTP header up to its first empty line and the payload behind it.

    A record whose block isn't followed by its end stops the job.
    """
    latin = lambda x: F.decode(x, "ISO-8859-1")  # noqa: E731  a character for each byte, so places are places of bytes
    split = records.select("record", F.instr(latin(F.col("record")), CRLF * 2).alias("at"))
    split = split.select("record", (F.col("at") + 4).alias("block_at"), F.decode(F.substring("record", F.lit(1), F.col("at") + 1), "UTF-8").alias("head"))
    field = lambda name: F.nullif(F.regexp_extract(F.col("head"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    parsed = split.select(
        "record", "block_at", field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Refers-To").alias("refers_to_id"),
        field("WARC-Target-URI").alias("uri"), F.regexp_extract("head", r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]*)\r\n", 1).alias("said_digest"), field("Content-Length").cast("int").alias("length"),
    )
    ends = F.substring("record", F.col("block_at") + F.col("length"), F.lit(5)) == F.encode(F.lit(CRLF * 2), "UTF-8")
    block = F.when(ends, F.substring("record", F.col("block_at"), F.col("length"))).otherwise(F.raise_error(F.concat(F.lit("broken record "), F.col("record_id"))))
    parsed = parsed.withColumn("block", block.cast("binary")).drop("record", "block_at", "length")
    http = F.instr(latin(F.col("block")), CRLF * 2) + 4
    payload = F.when(F.col("record_type") == "response", F.substring("block", http, F.octet_length("block")))
    return parsed.withColumn("payload", payload).drop("block")


def describe(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type and refers_to, from parsed records; a revisit's
    payload is that of the record it refers to. A payload that isn't what its header says stops the job."""
    page = lambda urn: F.expr(f"try_cast(regexp_extract({urn}, '^<urn:page:(-?[0-9]+):', 1) as bigint)")
    parsed = parse(records).select(
        "record_type", "record_id", "refers_to_id", "said_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )
    parsed = materialize(parsed, "parsed")
    wrong = F.raise_error(F.concat(F.lit("wrong payload in "), F.col("record_id")))
    held = parsed.filter("record_type = 'response'").withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("said_digest"), F.col("payload_digest")).otherwise(wrong.cast("string")))
    aside = held.select(F.col("record_id").alias("_id"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    again = parsed.filter("record_type = 'revisit'").join(aside, F.col("refers_to_id") == F.col("_id"), "left")
    same = F.when(F.col("_digest") == F.col("said_digest"), F.col("_digest")).otherwise(wrong.cast("string"))
    out = lambda df, size, digest, refers: df.select(page("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", refers.alias("refers_to"))
    return out(held, F.col("payload_bytes"), F.col("payload_digest"), F.lit(None).cast("long")).unionByName(out(again, F.col("_bytes"), same, page("refers_to_id")))


def archive(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", least: int = 0) -> str:
    """Write an archive in the shared folder; its path."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path, key, html, url, least)
    return path
