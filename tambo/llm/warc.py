"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

**Writing.**  Records are built in Spark expressions (SHA-1 of the payload, the
response that a copy refers to) and compressed in tasks.  An archive is one file:
a skippable frame (magic 0x184D2A5D) with the dictionary, then one frame per
record.  A task begins the next archive once the frames of one reach
``archive_bytes``; only a record larger than that makes a larger archive.  Each archive is one row for
Spark's text writer, which begins a new file with every row, on any file system it
knows; the bytes it writes behind a row, which stand between the frames too, form
an empty skippable frame, which readers pass over.  The dictionary is trained on a bounded sample of pages.
Payloads stay in the partitions of the input: only the keys of repeated payloads
are joined to them, broadcast while they are few (else the join shuffles).

**Reading.**  Archives are read as binary files.  The reader walks the frames,
loads the dictionary from the leading one, decodes each record's frame (its
content checksum is verified by the decoder), and validates version line,
required headers, Content-Length against the block, the closing line ends, and
a response's payload digest and payload length against its payload.  A bad record is an error that
names archive and place, unless ``errors`` is "report": then it is a row whose
``error`` says what is wrong.

Among rows of equal payloads of at least ``min_revisit`` bytes, the rows with
the largest page id are responses and the others revisits that name that id;
all other rows are responses.

Defined results: null html is an empty payload; a null url is an empty target;
control characters in a url are percent-encoded; a row with a null id is a
response (it is never the largest); rows that repeat the largest id are all
responses; an empty table gives no archive and no rows; only the id, url and
html columns are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tambo.llm.common import checkpointed
from tambo.session import scratch_path

VERSION = "WARC/1.1"
#: Skippable frame magics: the dictionary's, and that of the empty frame between rows.
DICTIONARY_MAGIC, GAP_MAGIC = 0x184D2A5D, 0x184D2A50
GAP = (struct.pack("<I", GAP_MAGIC) + struct.pack("<I", 0)).decode("ascii")
FRAME_MAGIC, DICTIONARY_ID = 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Pages the dictionary is trained on, its bytes, and the bytes of a page that are used.
SAMPLE_PAGES, DICTIONARY_BYTES, SAMPLE_BYTES = 400, 64 << 10, 16 << 10
#: Bytes of an archive's frames after which the next begins.
ARCHIVE_BYTES = 64 << 20
#: Bytes of the keys of repeated payloads (KEY_BYTES each, about) up to which they are broadcast.
MAX_BROADCAST_BYTES, KEY_BYTES = 16 << 20, 96
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


# ------------------------------------------------------------------ records
def with_record_types(pages: DataFrame, min_revisit: int = 1000, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """(page, url, payload, payload_bytes, digest, refers_to): refers_to is null for responses."""
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    same = (rows.filter(F.col("payload_bytes") >= min_revisit).groupBy(F.col("digest").alias("d"), F.col("payload_bytes").alias("b"))
                .agg(F.max("page").alias("largest"), F.count("*").alias("n")).filter("n > 1 and largest is not null"))
    same = checkpointed(same.drop("n"))
    found = rows.join(F.broadcast(same) if same.count() * KEY_BYTES <= MAX_BROADCAST_BYTES else same, (F.col("digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    return found.select("page", "url", "payload", "payload_bytes", "digest",
                        F.when(F.col("page") < F.col("largest"), F.col("largest")).alias("refers_to"))


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def record_heads(rows: DataFrame) -> DataFrame:
    """Header text and block of each record."""
    revisit = F.col("refers_to").isNotNull()
    safe = F.coalesce("url", F.lit(""))
    for char, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        safe = F.when(F.coalesce("url", F.lit("")).rlike(r"[\r\n]"), F.replace(safe, F.lit(char), F.lit(code))).otherwise(safe)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))                    # noqa: E731
    head = F.concat(
        F.lit(VERSION + "\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page"))), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))), F.lit("\r\n"))
    return rows.select(head.cast("binary").alias("head"), F.when(~revisit, F.col("payload")).alias("block"))


def train_dictionary(rows: DataFrame) -> bytes:
    """Dictionary from the beginnings of about SAMPLE_PAGES pages, chosen by a hash; empty if they are too few."""
    total = rows.count()
    share = F.pmod(F.xxhash64("page", "digest"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(share < SAMPLE_PAGES / max(total, 1)).select(F.substring("payload", 1, SAMPLE_BYTES).alias("p"))
    parts = sorted(bytes(r["p"]) for r in sample.filter("length(p) >= 64").collect())
    if len(parts) < 16 or sum(map(len, parts)) < 16 * 1024:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, parts)) // 10)
    return zstandard.train_dictionary(size, parts, level=3).as_bytes()


def write_archives(rows: DataFrame, path: str, level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the records of ``with_record_types`` rows as archives of about ``archive_bytes`` at most below ``path``."""
    dictionary = train_dictionary(rows)
    lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
        frames, held = [], 0
        whole = lambda: pa.RecordBatch.from_arrays([pa.array([GAP.encode().join([lead, *frames])], pa.binary())], ["value"])
        for batch in batches:
            for head, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                frame = press.compress(b"".join((head, block or b"", b"\r\n\r\n")))
                if frames and held + len(frame) > archive_bytes:
                    yield whole()
                    frames, held = [], 0
                frames.append(frame)
                held += len(frame)
        if frames:
            yield whole()

    frames = record_heads(rows).mapInArrow(run, "value binary")
    frames.select(F.col("value").cast("string")).write.option("lineSep", GAP).option("maxRecordsPerFile", 1).text(path)


# ------------------------------------------------------------------ reading
class BadRecord(ValueError):
    pass


def frames_of(data: memoryview) -> Iterator[tuple[int, int, memoryview]]:
    """(place, magic, content or whole frame) of every frame of an archive, in order."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise BadRecord(f"{at}: cut off in a frame head")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == GAP_MAGIC:
            if at + 8 + size > len(data):
                raise BadRecord(f"{at}: skippable frame runs over the end")
            yield at, magic, data[at + 8:at + 8 + size]
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = at + frame_size(data, at)
            yield at, magic, data[at:end]
            at = end
        else:
            raise BadRecord(f"{at}: no Zstandard frame")


def frame_size(data: memoryview, at: int) -> int:
    """Bytes of the frame at ``at``: its header, its blocks, its checksum."""
    try:
        parameters = zstandard.get_frame_parameters(data[at:at + 18])
        place = at + zstandard.frame_header_size(data[at:at + 18])
    except zstandard.ZstdError as e:
        raise BadRecord(f"{at}: {e}") from None
    last = False
    while not last:
        if place + 3 > len(data):
            raise BadRecord(f"{at}: frame runs over the end")
        head = int.from_bytes(data[place:place + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        place += 3 + (1 if kind == 1 else size)
    place += 4 * parameters.has_checksum
    if place > len(data):
        raise BadRecord(f"{at}: frame runs over the end")
    return place - at


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; BadRecord if they are not valid."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise BadRecord("no end of headers")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION.encode():
        raise BadRecord(f"version line {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for text in lines[1:]:
        name, colon, value = text.partition(b":")
        if not colon or not name.strip():
            raise BadRecord(f"header line {text[:40]!r}")
        headers[name.strip().decode()] = value.strip().decode("utf-8", "replace")
    missing = [h for h in REQUIRED if h not in headers]
    if missing:
        raise BadRecord(f"no {', '.join(missing)}")
    if not headers["Content-Length"].isdigit():
        raise BadRecord("Content-Length is no number")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadRecord(f"Content-Length {size}, but {len(rest) - 4} bytes stand before the closing line ends")
    block = rest[:size]
    digest = headers.get("WARC-Payload-Digest", "")
    if headers["WARC-Type"] == "response" and digest.startswith("sha1:") and hashlib.sha1(block).hexdigest() != digest[5:].lower():
        raise BadRecord("payload digest differs")
    stated = headers.get("WARC-Payload-Length")
    if headers["WARC-Type"] == "response" and stated is not None and stated != str(size):
        raise BadRecord(f"WARC-Payload-Length {stated[:20]}, but the payload has {size} bytes")
    return headers, block


def records_of(data: bytes) -> Iterator[tuple[int, dict[str, str] | None, bytes, str | None]]:
    """(place, headers, block, error) of every record of one archive."""
    decoder = zstandard.ZstdDecompressor()
    for n, (at, magic, content) in enumerate(frames_of(memoryview(data))):
        if magic == DICTIONARY_MAGIC and n == 0 and len(content):
            trained = bytes(content)
            if int.from_bytes(trained[:4], "little") == FRAME_MAGIC:
                trained = decoder.decompress(trained)                           # the dictionary may be compressed itself
            if int.from_bytes(trained[:4], "little") != DICTIONARY_ID:
                raise BadRecord(f"{at}: the leading frame holds no dictionary")
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
        if magic != FRAME_MAGIC:
            continue
        try:
            raw = decoder.decompressobj().decompress(content)
            yield at, *parse_record(raw), None
        except (zstandard.ZstdError, BadRecord) as e:
            yield at, None, b"", str(e)


def read_archives(spark: SparkSession, path: str, errors: str = "raise") -> DataFrame:
    """(archive, place, headers, block, error) per record of the archives below ``path``."""
    if errors not in ("raise", "report"):
        raise ValueError(f"unknown errors: {errors}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = ["archive", "place", "headers", "block", "error"]
    types = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                held = 0
                try:
                    for at, headers, block, error in records_of(content.as_py()):
                        if error is not None and errors == "raise":
                            raise BadRecord(f"{at}: {error}")
                        rows.append((path, at, list(headers.items()) if headers else None, block, error))
                        held += len(block) + 400
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                except BadRecord as e:
                    if errors == "raise":
                        raise BadRecord(f"{path} at {e}") from None
                    rows.append((path, None, None, b"", str(e)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.mapInArrow(run, "archive string, place bigint, headers map<string,string>, block binary, error string")


def page_of(header: Column) -> Column:
    """The page id in a record id; null for none."""
    return F.nullif(F.regexp_extract(F.coalesce(header, F.lit("")), r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")


def round_trip(pages: DataFrame, min_revisit: int = 1000, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES,
               **names) -> DataFrame:
    """Writes ``pages`` as archives and gives what reading them finds, one row per record."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(with_record_types(pages, min_revisit, **names), path, archive_bytes=archive_bytes)
    h = F.col("headers")
    found = read_archives(spark, path)
    return found.select(
        page_of(h["WARC-Record-ID"]).alias("page_id"), h["WARC-Payload-Length"].cast("long").alias("payload_bytes"),
        F.substring_index(h["WARC-Payload-Digest"], ":", -1).alias("payload_digest"), h["WARC-Type"].alias("record_type"),
        page_of(F.try_element_at(h, F.lit("WARC-Refers-To"))).alias("refers_to"), F.octet_length("block").cast("long").alias("block_bytes"))
