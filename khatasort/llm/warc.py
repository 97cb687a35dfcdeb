"""WARC archives of Zstandard frames: writer and reader.

Layout, as in the public note on Zstandard WARC files: an archive may begin with a skippable frame (magic 0x184D2A5D)
that holds the dictionary, plain or itself a Zstandard frame; then every record is one frame of its own, compressed with
that dictionary, so a reader can start at any frame.  A record is ``WARC/1.1``, header lines, an empty line, a block of
Content-Length bytes and two line ends.

Writing.  Payloads of at least ``least_bytes`` bytes that equal another one (same SHA-1, SHA-256 and length) are told
apart by page_id alone: the largest is a response, the others are revisits that refer to it and carry no payload.  That
is settled on digests, not on texts: counts and maxima by digest are summed before they are shuffled, so a payload that
a third of all pages share is one row a task, and only digests of repeated payloads are joined back (broadcast while they
are few, so pages stay where they are).  Each task then packs its own pages into archives of a bounded size, all with
one dictionary, trained once on a bounded sample of whole records; nothing is gathered.

Archives are rows (archive, content) and can be kept in a table or written out as files (``save``); the reader takes
such rows, or files by Spark's ``binaryFile`` source.  It loads the dictionary from the leading frame, decodes a frame at
a time, and checks each record: version line, header syntax, the fields that WARC demands, Content-Length against the
block, one record a frame, no bytes left over, block and payload digests.  A fault raises, or with
``strict=False`` is given in column ``fault``.

Defined cases: null html is the empty payload, null url the target "urn:none:", null page_id a record without page field
(never referred to, and not a revisit); of repeated page_ids with one payload, one row is the response and the others
are revisits that refer to their own page_id; other columns are ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from urllib.parse import quote, unquote

import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pinned, ready, table

NAME = "op10_zstd_warc"

DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
LEAST_BYTES = 1000
#: Bytes of records in an archive before the next one begins, of the dictionary, and of a page that it is trained on; such pages at most.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLES = 8 << 20, 32 << 10, 1 << 20, 200
#: Revisits (id, digest and target) that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = b"\r\n"


class WarcError(ValueError):
    """A record or an archive that breaks the format."""


def sha1_text(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_of(digest: str) -> str:
    kind, _, value = digest.partition(":")
    if kind != "sha1" or len(value) != 32:
        raise WarcError(f"digest {digest!r} isn't a SHA-1 in base 32")
    try:
        return base64.b32decode(value).hex()
    except ValueError as err:
        raise WarcError(f"digest {digest!r}: {err}") from None


def record_id(page_id, kind: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{kind}:{digest}')}>"


def record(kind: str, url: str | None, payload: bytes, page_id=None, refers_to=None, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """One WARC record; a revisit leaves its payload out, keeps its digest and length, and names the response's record."""
    http = LINE.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if kind == "revisit" else http + payload
    digest = sha1_text(payload)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, kind, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%-._") if url is not None else "urn:none:"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", sha1_text(block)),
        ("X-Payload-Length", len(payload)),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", page_id))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, "response", digest)), ("X-Refers-To-Page", refers_to)]
    fields.append(("Content-Length", len(block)))
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + LINE + block + LINE + LINE


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of the one record in ``data``, checked."""
    head, split, rest = data.partition(b"\r\n\r\n")
    lines = head.split(LINE)
    if not split or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or len(name.split()) != 1 or name != name.strip():
            raise WarcError(f"header line {line[:60]!r}")
        key = name.decode("latin-1").lower()
        if key in fields and key != "warc-concurrent-to":
            raise WarcError(f"field {key} twice")
        fields[key] = value.strip().decode("utf-8")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in fields:
            raise WarcError(f"no field {need}")
    if not fields["content-length"].isdigit():
        raise WarcError("Content-Length isn't a number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, Content-Length {size}")
    block = rest[:size]
    if "warc-block-digest" in fields and hex_of(fields["warc-block-digest"]) != hashlib.sha1(block).hexdigest():
        raise WarcError("block digest differs")
    return fields, block


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from whole records, and from some of this module's own so that there are enough for one."""
    own = [record(kind, f"https://www.example.org/{i}/page", b"<!DOCTYPE html><html><head><title>%d</title></head><body><p>%d</p></body></html>" % (i, i * i), i, i) for i in range(200) for kind in ("response", "revisit")]
    return zstandard.train_dictionary(size, [*own, *samples], level=3).as_bytes()


def dictionary_of(pages: DataFrame, most: int = SAMPLES) -> bytes:
    """One dictionary for all archives, from at most ``most`` pages: those with the smallest hash of the id, without such as are longer than ``SAMPLE_BYTES`` each."""
    ids = pages.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    rows = pages.join(F.broadcast(ids), "page_id").where(F.octet_length("html") <= SAMPLE_BYTES).select("page_id", "url", "html").distinct().collect()
    return train([record("response", r.url, r.html.encode(), r.page_id) for r in sorted(rows, key=lambda r: (r.page_id, r.url or "", r.html))])


def archive(records: list[bytes], dictionary: bytes = b"", level: int = 3) -> bytes:
    """A file: the dictionary's skippable frame, if there is one, then a frame for each record."""
    out = []
    extra = {}
    if dictionary:
        packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
        out.append(DICTIONARY_MAGIC + len(packed).to_bytes(4, "little") + packed)
        extra["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
    pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, **extra)
    out += [pack.compress(x) for x in records]
    return b"".join(out)


def frames(data: bytes):
    """The decoded bytes of each frame of an archive."""
    at = 0
    extra = {}
    if data[:4] == DICTIONARY_MAGIC:
        size = int.from_bytes(data[4:8], "little")
        packed = data[8 : 8 + size]
        if len(packed) != size:
            raise WarcError("the dictionary's frame is cut off")
        try:
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(packed) if packed[:4] == FRAME_MAGIC else packed
            extra["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
        except zstandard.ZstdError as err:
            raise WarcError(f"dictionary: {err}") from None
        at = 8 + size
    view = memoryview(data)
    unpack = zstandard.ZstdDecompressor(**extra)
    window = 1 << 16
    while at < len(data):
        if data[at] & 0xF0 == 0x50 and data[at + 1 : at + 4] == b"\x2a\x4d\x18":  # another skippable frame
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        one, parts = unpack.decompressobj(), []
        end = at
        try:
            while not one.eof:
                if end >= len(data):
                    raise WarcError("a frame is cut off")
                parts.append(one.decompress(view[end : end + window]))
                end = min(end + window, len(data))
        except zstandard.ZstdError as err:
            raise WarcError(f"frame at byte {at}: {err}") from None
        at = end - len(one.unused_data)
        yield b"".join(parts)


def read_archive(data: bytes):
    """(fields, payload or None for a revisit) of each record, checked."""
    for raw in frames(data):
        fields, block = parse_record(raw)
        payload = None
        if fields["warc-type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if "warc-payload-digest" in fields and hex_of(fields["warc-payload-digest"]) != hashlib.sha1(payload).hexdigest():
                raise WarcError("payload digest differs")
            if "x-payload-length" in fields and int(fields["x-payload-length"]) != len(payload):
                raise WarcError("payload length differs")
        yield fields, payload


def plan(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, kind and refers_to of every page."""
    ids = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    big = (F.octet_length("html") >= least_bytes) & F.col("page_id").isNotNull()
    digest = F.unhex(F.concat(F.sha1(payload), F.sha2(payload, 256), F.lpad(F.hex(F.octet_length("html")), 16, "0")))
    marks = pinned(rows.where(big).select("page_id", digest.alias("digest")))
    repeated = marks.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    repeated = repeated.withColumnRenamed("digest", "repeated_digest")  # keys in another form: the left side gets a shuffle of its own, which Spark splits where one payload is very common
    named = marks.join(repeated, F.hex("digest") == F.hex("repeated_digest")).groupBy("page_id", "digest", "refers_to").agg(F.count("*").alias("times"))
    others = named.where("page_id <> refers_to or times > 1").select(F.col("page_id").alias("other_id"), F.col("digest").alias("other_digest"), "refers_to", (F.col("page_id") == F.col("refers_to")).alias("own"))
    others = pinned(others)
    if others.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        others = F.broadcast(others)
    found = rows.withColumn("digest", F.when(big, digest)).join(others, (F.col("page_id") == F.col("other_id")) & (F.col("digest") == F.col("other_digest")), "left")
    if others.where("own").limit(1).count():  # repeated rows of a response's page: the first is the response
        first = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")) == 1
        found = found.where("own is null or not own").withColumn("first", F.lit(False)).unionByName(found.where("own").withColumn("first", first))
    else:
        found = found.withColumn("first", F.lit(False))
    revisit = F.col("refers_to").isNotNull() & ~F.col("first")
    return found.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("refers_to")).cast(ids).alias("refers_to"))


def write(pages: DataFrame, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all pages: archive (a name) and content."""
    sent = pages.sparkSession.sparkContext.broadcast(dictionary_of(pages))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        waiting: list[bytes] = []
        held = 0

        def close():
            nonlocal number
            name = f"pages-{part:06d}-{number:06d}.warc.zst"
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive(waiting, sent.value)], pa.binary())], ["archive", "content"])

        for batch in batches:
            for page_id, url, html, kind, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                waiting.append(record(kind, url, html.encode(), page_id, refers_to))
                held += len(waiting[-1])
                if held >= archive_bytes:
                    yield close()
                    waiting, held = [], 0
        if waiting:
            yield close()

    return plan(pages, least_bytes).mapInArrow(run, "archive string, content binary")


def save(archives: DataFrame, folder: str) -> int:
    """Write the archives as files into a folder that all executors share, and return their number.

    Each task writes its own, through pyarrow's file system for the folder's scheme, under a passing name that is then
    changed, so a task that is run again leaves no half of a file.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, top = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(top, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                passing = f"{top}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(passing, compression=None) as out:
                    out.write(content.as_buffer())
                store.move(passing, f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return archives.select("archive", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Archive files as rows for read()."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def read(archives: DataFrame, strict: bool = True) -> DataFrame:
    """A row a record: archive, page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to, payload (null for a revisit), fault."""

    def run(batches):
        import pyarrow as pa

        names = ["archive", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "fault"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

        def table_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                try:
                    for fields, payload in read_archive(content.as_py()):
                        number = lambda key: int(fields[key]) if key in fields else None  # noqa: E731, B023
                        url = fields.get("warc-target-uri")
                        size = len(payload) if payload is not None else number("x-payload-length")
                        digest = hex_of(fields["warc-payload-digest"]) if "warc-payload-digest" in fields else None
                        rows.append((name, number("x-page-id"), None if url == "urn:none:" else url and unquote(url), size, digest, fields["warc-type"], number("x-refers-to-page"), payload, None))
                        held += len(payload or b"")
                        if held > 4 << 20:
                            yield table_of(rows)
                            rows, held = [], 0
                except WarcError as err:
                    if strict:
                        raise
                    rows.append((name, None, None, None, None, None, None, None, str(err)))
                if rows:
                    yield table_of(rows)

    return archives.select("archive", "content").mapInArrow(run, "archive string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, fault string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    written = pinned(write(table(spark, sf_dir, "pages")))
    return read(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, cast(octet_length(payload) as bigint) as payload_bytes, sha1(payload) as payload_digest,
  max(page_id) over (partition by payload) as last_id from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> last_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> last_id then last_id end as refers_to
from d
"""
