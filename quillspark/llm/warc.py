"""WARC archives: records for captured pages, and transactions assembled from records.

Archives are gzip files with a member per record, of bounded size, written by Spark's text writer (a row is an archive, and
the line separator is an empty gzip member) and read as binary files: both go through Spark's file systems only, whatever
store holds them.  A reader takes them apart member by member and digests the payloads that it finds; transactions are
joined by record ids alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.storage import materialize

#: Payloads from this size on are stored once; later ones revisit.
LEAST_REVISIT = 1000
#: Compressed bytes of an archive file, about: it is closed by the record that reaches them.
ARCHIVE_BYTES = 32 << 20
#: Bytes of an archive that are unpacked at once.
PIECE = 1 << 14
END = "\r\n\r\n"
#: Fixed value: how a gzip member begins.
MAGIC = b"\x1f\x8b\x08"
#: Fixed value: a gzip member without content, which ends every archive.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "0000000000000000")


def _record_id(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + "|"), key).cast("binary"))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def _lines(*parts) -> Column:
    """Header lines; a null part is left out."""
    return F.concat_ws("\r\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _line_safe(value: Column) -> Column:
    """A value that stays on its header line: controls and blanks are percent-encoded."""
    return F.when(value.rlike(r"[\x00-\x20\x7F]"), F.url_encode(value)).otherwise(value)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(record): three WARC records per page as text without their ending - request, response or revisit, and metadata.

    Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the largest id's is the response and the others
    revisit it.  A null payload is empty; a null url is empty; a null id is written as an empty name; rows that share an id
    are captures of their own, told apart by their place in the table, which is written down first so that it stays.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(_line_safe(F.col(url_col).cast("string")), F.lit("")).alias("url"), payload.alias("payload"),
        F.monotonically_increasing_id().alias("place"),
    )
    base = materialize(base, "captured_pages")
    base = base.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    # The key and id of the page that stands for each payload; a place breaks ties between rows of one id.
    shared = base.filter(F.col("size") >= LEAST_REVISIT).groupBy("sha1", "size").agg(F.max(F.struct("id", "place")).alias("top"), F.count("*").alias("n"))
    # Written first: the join then has exchanges of its own, which adaptive execution may split where a payload is hot.
    shared = materialize(shared.filter("n > 1").select("sha1", "size", "top"), "shared_payloads")
    base = base.join(shared, ["sha1", "size"], "left")
    revisit = F.col("top").isNotNull() & (F.col("place") != F.col("top.place"))
    base = base.withColumn("revisit", revisit)

    def key(id_: Column, place: Column) -> Column:
        return F.concat_ws("|", F.coalesce(id_.cast("string"), F.lit("")), place.cast("string"))

    own, target = key(F.col("id"), F.col("place")), key(F.col("top.id"), F.col("top.place"))
    date = "WARC-Date: 1970-01-01T00:00:00Z"
    uri = _header("WARC-Target-URI", F.col("url"))
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    get = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n"))
    request = F.concat(
        _lines("WARC/1.1", "WARC-Type: request", _header("WARC-Record-ID", _record_id("request", own)), _header("WARC-Concurrent-To", _record_id("capture", own)), date, uri,
               "Content-Type: application/http;msgtype=request", _header("Content-Length", F.octet_length(get).cast("string"))),
        F.lit(END), get,
    )
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    body = F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("payload")))
    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))
    capture = F.concat(
        _lines("WARC/1.1", F.when(F.col("revisit"), "WARC-Type: revisit").otherwise("WARC-Type: response"), _header("WARC-Record-ID", _record_id("capture", own)), date, uri, digest,
               F.when(F.col("revisit"), "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
               F.when(F.col("revisit"), _header("WARC-Refers-To", _record_id("capture", target))),
               "Content-Type: application/http;msgtype=response", _header("Content-Length", F.octet_length(body).cast("string"))),
        F.lit(END), body,
    )
    fields = F.concat(F.lit("page-id: "), name, F.lit("\r\n"))
    metadata = F.concat(
        _lines("WARC/1.1", "WARC-Type: metadata", _header("WARC-Record-ID", _record_id("metadata", own)), _header("WARC-Concurrent-To", _record_id("capture", own)), date, uri,
               "Content-Type: application/warc-fields", _header("Content-Length", F.octet_length(fields).cast("string"))),
        F.lit(END), fields,
    )
    return base.select(F.explode(F.array(request, capture, metadata)).alias("record"))


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **columns) -> None:
    """Write the pages' records as gzip archives of about ``archive_bytes`` each below ``path``, a member per record.

    An archive holds one record at least, so a page larger than the bound has a file of its own; an empty table leaves no
    archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                parts.append(packer.compress(record.as_py().encode("utf-8", "surrogatepass") + END.encode()) + packer.flush())
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])

    archives = records(pages, **columns).mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    writer = archives.write.option("maxRecordsPerFile", 1).option("compression", "none")
    writer.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def members(content: bytes) -> Iterator[tuple[bytes, str | None]]:
    """(content, None) of each gzip member in turn; content that is not compressed is given whole.

    (b"", reason) stands for a member that cannot be unpacked; reading goes on where the next one may begin.  Of a member
    that ends early, what there is comes first and the reason after it.
    """
    if content[:2] != MAGIC[:2]:
        yield content, None
        return
    at = 0
    while 0 <= at < len(content):
        start, unpacker, parts = at, zlib.decompressobj(31), []
        try:
            while not unpacker.eof and at < len(content):  # by pieces: what follows a member is handed back as a copy
                piece = content[at : at + PIECE]
                parts.append(unpacker.decompress(piece))
                at += len(piece) - len(unpacker.unused_data)
        except zlib.error as e:
            yield b"", f"member at byte {start}: {e}"
            at = content.find(MAGIC, start + 1)
            continue
        yield b"".join(parts), None
        if not unpacker.eof:
            yield b"", f"member at byte {start}: it ends early"


_HEADER = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record, by Content-Length. A cut last block is given as far as it goes.

    Bytes that are no record, and heads that are cut or give no length, become a record of type error whose block is the
    reason; reading goes on at the next ``WARC/``.
    """
    at, size = 0, len(data)
    while 0 <= at < size:
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        if not data.startswith(b"WARC/", at):
            yield {"warc-type": "error"}, b"no record at byte %d" % at
            at = data.find(b"WARC/", at)
            continue
        end = data.find(b"\r\n\r\n", at)
        fields = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(data[at : max(end, at)])}
        length = fields.get("content-length", "").strip()
        if not (length.isascii() and length.isdigit()):
            yield {"warc-type": "error"}, b"no length in the record at byte %d" % at
            at = data.find(b"WARC/", at + 5)
            continue
        start = end + 4
        yield fields, data[start : start + int(length)]
        at = start + int(length)


def split_block(fields: dict[str, str], block: bytes) -> tuple[str, bytes | None]:
    """(head, payload): an HTTP message's head and body; a block of another type is all head."""
    if fields.get("content-type", "").startswith("application/http"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        return (head + gap).decode("utf-8", "replace"), payload
    return block.decode("utf-8", "replace"), None


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``.

    (kind, record_id, concurrent_to, refers_to, uri, digest, head, payload, payload_bytes, payload_sha1); the last two are
    taken from the payload as it was read, ``digest`` is what the header claims.  Payload, bytes and SHA-1 are null for
    records that are no HTTP messages.  What is malformed gives a row of kind error with the reason as its head, and the
    rest of the archive is read on.  No archives give no rows; a page of any length is one record.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    names = ["kind", "record_id", "concurrent_to", "refers_to", "uri", "digest", "head", "payload"]
    headers = ["warc-type", "warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-payload-digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            payloads = columns[-1]
            sizes = pa.array([None if x is None else len(x) for x in payloads], pa.int64())
            found = pa.array([None if x is None else hashlib.sha1(x).hexdigest() for x in payloads], pa.string())
            arrays = [*(pa.array(c, pa.string()) for c in columns[:-1]), pa.array(payloads, pa.binary()), sizes, found]
            return pa.RecordBatch.from_arrays(arrays, [*names, "payload_bytes", "payload_sha1"])

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for member, broken in members(content.as_py()):
                    for fields, block in parse(member) if broken is None else [({"warc-type": "error"}, broken.encode())]:
                        rows.append([*(fields.get(h) for h in headers), *split_block(fields, block)])
                        held += len(block)
                        if held > 4 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    schema = ", ".join(f"{n} string" for n in names[:-1]) + ", payload binary, payload_bytes long, payload_sha1 string"
    return files.mapInArrow(run, schema)


def captures(found: DataFrame) -> DataFrame:
    """Transactions: one nested row per capture, its request and metadata joined through their concurrent-to ids.

    (record_id, kind, uri, digest, refers_to, payload, payload_bytes, payload_sha1, request struct, metadata struct).  A
    capture without request or metadata has null there; requests and metadata without a capture are left out; if several
    name one capture, the least by record id is taken; a revisit's payload is empty; no records give no rows.  ``found`` is
    read three times; without its column payload the rows have none either.
    """

    def partner(kind: str, *fields) -> DataFrame:
        rows = found.filter(F.col("kind") == kind).groupBy(F.col("concurrent_to").alias("record_id"))
        return rows.agg(F.min(F.struct(F.col("record_id").alias("id"), *fields)).alias(kind))

    main = found.filter(F.col("kind").isin("response", "revisit"))
    main = main.drop("concurrent_to", "head")
    return main.join(partner("request", F.col("uri"), F.col("head").alias("line")), "record_id", "left").join(partner("metadata", F.col("head").alias("fields")), "record_id", "left")


def resolve(transactions: DataFrame) -> DataFrame:
    """``transactions`` without payloads, with ``target`` (struct) for revisits, and ``verified``.

    ``target`` is the capture of the record that WARC-Refers-To names: its fields, bytes and SHA-1 as read; null if there is
    none.  ``payload_bytes`` and ``payload_sha1`` of a revisit are its target's.  ``verified``: the digest that the header
    claims is that of the payload (the target's, for a revisit); false where it is not, or where there is no target.
    """
    slim = materialize(transactions.drop("payload"), "transactions")
    targets = slim.filter(F.col("kind") == "response").select(F.col("record_id").alias("refers_to"), F.struct("metadata", "payload_bytes", "payload_sha1").alias("target"))
    # Responses that are referred to, so that a target that many revisits name meets them in a join that can be split.
    targets = targets.join(slim.filter("kind = 'revisit'").select("refers_to").distinct(), "refers_to", "left_semi")
    out = slim.join(materialize(targets, "targets"), "refers_to", "left")
    revisit = F.col("kind") == "revisit"
    out = out.withColumns({c: F.when(revisit, F.col(f"target.{c}")).otherwise(F.col(c)) for c in ("payload_bytes", "payload_sha1")})
    claimed = F.lower(F.regexp_replace("digest", "^sha1:", ""))
    return out.withColumn("verified", F.coalesce(claimed == F.col("payload_sha1"), F.lit(False)))


_FIELD = r"(?:^|\r\n){}: ([^\r\n]*)"


def metadata_field(name: str, record: str = "metadata") -> Column:
    """A field of a metadata record; null if it has none."""
    value = F.regexp_extract(F.col(f"{record}.fields"), _FIELD.format(re.escape(name)), 1)
    return F.when(value != "", value)


def sha1_hex(digest: str) -> str:
    """Bare lower-case hex of a payload digest in either spelling (hex or base 32)."""
    value = digest.removeprefix("sha1:")
    return value.lower() if len(value) == hashlib.sha1().digest_size * 2 else base64.b32decode(value).hex()
