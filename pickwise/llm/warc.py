"""Operator 5: WARC archives and the normaliser of monolithic gzip.

``write_archives`` turns rows into WARC/1.0 records and lets Spark's text writer put them
into gzip files: one gzip stream per file, records closed by CRLF CRLF (a "monolithic"
archive). ``normalise`` reads such files, inflates each stream once in bounded pieces,
writes every record as a gzip member of its own, and writes a sidecar index with one JSON
line per record (file, offset, length, type, id, target, digest). ``read_records`` walks
archives of either kind. All writing goes through Spark's commit protocol into any path
Spark can reach, so a lost executor repeats its files only.

Two details of the output format. The text writer must close each row with some bytes;
these are an empty gzip member, which is legal between members and inflates to nothing.
An archive's members and its index come out of the same pass, as the partitions
``kind=warc`` and ``kind=index`` of the output folder, ``archive=<name>`` below.

A file is handled in one task, as a gzip stream has no inner entry points; the writer
bounds the size of its files by ``records_per_file``, and readers of foreign archives rely
on their usual size of about a GB.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pickwise.llm.common import prepare, scratch, small_join, stored

#: A gzip member without content: the row separator of normalised archives.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
PAGE_URN = "urn:pickwise:page:"
DATE = "2000-01-01T00:00:00Z"
PIECE = 1 << 16


def payload_digest(raw: bytes) -> str:
    """Upper-case base32 SHA-1, without a prefix."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Append payload_bytes, payload_digest, record_type and refers_to.

    Of rows whose payloads (UTF-8; null: empty) are equal and have at least ``least_bytes``
    bytes, those with the largest id are responses and the others revisit that id; smaller
    payloads are all responses. A row repeated with that largest id is a response each
    time; a null id is smaller than any. The largest id per digest comes from a partial
    aggregate over digests alone; only digests that several rows share return to the rows,
    by broadcast when they are counted to be few, else salted, so that one payload shared by
    a third of all pages is spread. Columns of the new names are replaced."""
    new = ["payload_bytes", "payload_digest", "record_type", "refers_to"]
    base = pages.drop(*new)
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = base.withColumns({"payload_bytes": F.length(body).cast("long"), "__sha1": F.sha1(body)})
    several = (rows.where(F.col("payload_bytes") >= least_bytes).groupBy("__sha1")
               .agg(F.max(id_col).alias("__best"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    joined = small_join(rows, stored(several, "digests"), ["__sha1"], "left")
    revisit = F.col("__best").isNotNull() & (~F.col(id_col).eqNullSafe(F.col("__best")))
    return joined.select(*[F.col(f"`{c}`") for c in base.columns], "payload_bytes", base32(F.col("__sha1")).alias("payload_digest"),
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("__best")).alias("refers_to"))


def base32(hex_digest):
    """Base32 of a 40-digit hexadecimal string, by table: five hexadecimal digits are four base-32 digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(0, 40, 5):
        number = F.conv(F.substring(hex_digest, i + 1, 5), 16, 10).cast("int")
        parts.extend(F.substring(letters, F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0))
    return F.concat(*parts)


def record_text(id_col: str, url_col: str, payload_col: str):
    """One WARC record as a string column, without the closing CRLF CRLF.

    The block of a response is an HTTP head and the payload, that of a revisit the HTTP head
    alone, whose Content-Length still tells the size of the payload. Control characters of a
    URL are percent-encoded; a null URL gives no WARC-Target-URI."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    url = F.col(url_col).cast("string")
    for char, code in (("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(char), F.lit(code))
    revisit = F.col("record_type") == "revisit"
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(RECORD_END))
    block = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col(payload_col).cast("string"), F.lit(""))))

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    return F.concat(
        F.lit(f"WARC/1.0{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.concat(F.lit(f"<{PAGE_URN}"), ident, F.lit(">"))),
        line("WARC-Date", F.lit(DATE)), F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit(f"<{PAGE_URN}"), F.col("refers_to").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block)


def write_archives(rows: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   records_per_file: int = 50_000) -> None:
    """Write rows that have the columns of ``with_revisits`` as monolithic gzip archives below ``path``."""
    (rows.select(record_text(id_col, url_col, payload_col).alias("record")).write
     .option("compression", "gzip").option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file).text(path))


class Stream:
    """Bytes of a gzip file, of one member or many, inflated in pieces of bounded size."""

    def __init__(self, raw: bytes):
        self.raw = memoryview(raw)
        self.at = 0
        self.inflater = None
        self.start = 0              # offset of the member being read
        self.held = bytearray()
        self.done = False

    def _more(self) -> bool:
        """Inflate one piece; False at the end of the file."""
        while True:
            if self.inflater is None:
                if self.at >= len(self.raw):
                    self.done = True
                    return False
                self.inflater = zlib.decompressobj(31)
                self.start = self.at
            tail = self.inflater.unconsumed_tail
            if not tail:
                if self.at >= len(self.raw):
                    raise ValueError("the gzip stream is cut off")
                tail = self.raw[self.at:self.at + PIECE]
                self.at += len(tail)
            got = self.inflater.decompress(tail, 4 * PIECE)
            if self.inflater.eof:
                self.at -= len(self.inflater.unused_data)
                self.inflater = None
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at a clean end."""
        seen = 0
        while True:
            i = self.held.find(mark, max(0, seen - len(mark)))
            if i >= 0:
                return self.take(i + len(mark))
            seen = len(self.held)
            if not self._more():
                if self.held.strip():
                    raise ValueError("a record's header is cut off")
                return None

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("a record is cut off")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip_blank(self) -> None:
        """Drop line ends between records."""
        while True:
            k = len(self.held) - len(self.held.lstrip(b"\r\n"))
            del self.held[:k]
            if self.held or not self._more():
                return


def records(raw: bytes) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """(head bytes, headers with lower-case names, block) of each record of an archive file."""
    stream = Stream(raw)
    while True:
        stream.skip_blank()
        if not stream.held and stream.done:
            return
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        headers = parse_headers(head)
        yield head, headers, stream.take(int(headers["content-length"]))


def parse_headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "surrogateescape").split(CRLF)[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> None:
    """Rewrite the gzip archives below ``source``: a member per record, and a sidecar index, below ``target``."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(source).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                name = re.sub(r"[^A-Za-z0-9_.-]", "_", path.as_py().rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".txt"))
                archive = f"{name}-{zlib.crc32(path.as_py().encode()):08x}"  # files of one name in two folders stay apart
                yield from _members(archive, content.as_py(), level)

    made = files.mapInArrow(run, "kind string, archive string, seq long, value binary")
    (made.sortWithinPartitions("kind", "archive", "seq").select("kind", "archive", F.col("value").cast(StringType()).alias("value"))
     .write.partitionBy("kind", "archive").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(target))


def _members(archive: str, content: bytes, level: int, rows: int = 2_000, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Members and index lines of one archive, in batches of bounded rows and bytes."""
    kinds, seqs, values, size, offset = [], [], [], 0, 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([archive] * len(kinds), pa.string()),
                                           pa.array(seqs, pa.int64()), pa.array(values, pa.binary())],
                                          names=["kind", "archive", "seq", "value"])

    for seq, (head, headers, block) in enumerate(records(content)):
        member = gzip.compress(head + block + RECORD_END.encode(), level, mtime=0)
        entry = {"archive": archive, "offset": offset, "length": len(member), "type": headers.get("warc-type"),
                 "id": headers.get("warc-record-id"), "target": headers.get("warc-target-uri"), "digest": headers.get("warc-payload-digest")}
        kinds += ["warc", "index"]
        seqs += [seq, seq]
        line = gzip.compress(json.dumps(entry, sort_keys=True).encode() + b"\n", 1, mtime=0)
        values += [member, line]
        offset += len(member) + len(EMPTY_MEMBER)
        size += len(member) + len(line)
        if len(kinds) >= rows or size >= most:
            yield batch()
            kinds, seqs, values, size = [], [], [], 0
    if kinds:
        yield batch()


def _files(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(path, content) of the files below ``path``; with ``kind``, of that part of a normalised folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.where(F.col("path").contains(f"/kind={kind}/")) if kind else files


def read_records(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(archive, type, id, target, refers_to, digest, payload_bytes, payload) of every record below ``path``.

    ``payload`` is the block after the HTTP head, null for revisits; ``payload_bytes`` is its
    size, for revisits the size that the HTTP head states."""
    prepare(spark)
    files = _files(spark, path, kind)
    names = ["archive", "type", "id", "target", "refers_to", "digest", "payload_bytes", "payload"]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for _, h, block in records(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    told = int(parse_headers(http).get("content-length", len(payload)))
                    revisit = h.get("warc-type") == "revisit"
                    rows.append((name.as_py(), h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"),
                                 h.get("warc-payload-digest"), told if revisit else len(payload), None if revisit else payload))
                    size += len(block)
                    if len(rows) >= 2_000 or size >= 8 << 20:
                        yield _batch(rows, names, kinds)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names, kinds)

    return files.mapInArrow(run, "archive string, type string, id string, target string, refers_to string, digest string, payload_bytes long, payload binary")


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows (archive, offset, length, type, id, target, digest) of a normalised folder."""
    files = _files(spark, path, "index").select("content")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["archive", "offset", "length", "type", "id", "target", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                stream = Stream(content.as_py())
                rows = []
                while (line := stream.until(b"\n")) is not None:
                    entry = json.loads(line)
                    rows.append(tuple(entry[n] for n in names))
                    if len(rows) >= 10_000:
                        yield _batch(rows, names, kinds)
                        rows = []
                if rows:
                    yield _batch(rows, names, kinds)

    return files.mapInArrow(run, "archive string, offset long, length long, type string, id string, target string, digest string")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives, normalise them, read them back; one row per page.

    Returns id, payload_bytes, payload_digest, record_type, refers_to. Sizes and digests of
    responses are taken from the payload as read; those of revisits from their headers. An
    empty table gives no record."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    rows = with_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col, least_bytes)
    write_archives(rows, f"{folder}/monolithic", id_col, url_col, payload_col)
    normalise(spark, f"{folder}/monolithic", f"{folder}/members")
    found = read_records(spark, f"{folder}/members", "warc")
    return found.select(_page(F.col("id")).alias(id_col), "payload_bytes",
                        F.when(F.col("payload").isNotNull(), base32(F.sha1("payload"))).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
                        F.col("type").alias("record_type"), _page(F.col("refers_to")).alias("refers_to"))


def _page(urn):
    """The page number in a record's URN; null where there is none."""
    return F.regexp_extract(urn, f"<{PAGE_URN}(-?[0-9]+)>", 1).try_cast("long")
