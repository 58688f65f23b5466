"""Web archives of one Zstandard frame a record, with a dictionary in a leading skippable frame: writing with revisits, and reading.

An archive is a row: its name and its bytes, at most about LARGEST of them before compression (or one record). Archives are tables that Spark writes and
reads, so any store that Spark reaches can hold them; `files` reads such files that lie there as they are.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhue.llm.tables import ship, staged

#: Fixed values of the format: skippable frame that holds a dictionary, any frame, a dictionary.
DICTIONARY_FRAME, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload in an archive, of a dictionary, and of payloads that train it, at most.
LARGEST, DICTIONARY_SIZE, TRAINING = 4 << 20, 16 << 10, 1 << 20
#: Payloads under this many bytes are never revisits.
LEAST = 100
SALTS = 16
LEVEL = 3
#: Compressed bytes that the reader takes at once while it looks for the end of a frame.
STRIDE = 1 << 13


class Damaged(ValueError):
    """An archive that breaks the format; the message names the byte."""


def record(headers: dict[str, str], body: bytes) -> bytes:
    head = b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in headers.items()), f"Content-Length: {len(body)}\r\n\r\n".encode()])
    return head + body + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A frame for the dictionary, which is trained on the first records (if they are enough for one), then a frame for each record."""
    some, size = [], 0
    for r in records:
        if size > TRAINING:
            break
        some.append(r[: TRAINING // 8])
        size += len(some[-1])
    known, lead = None, b""
    if len(some) >= 8:
        try:
            known = zstandard.train_dictionary(min(DICTIONARY_SIZE, max(1024, size // 10)), some, level=LEVEL)
        except zstandard.ZstdError:  # too little to learn from
            known = None
    if known is not None:
        raw = known.as_bytes()
        lead = struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
    return lead + b"".join(map(packer.compress, records))


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and body of a record; checks the version line, the headers and the length."""
    head, end, rest = raw.partition(b"\r\n\r\n")
    if not end:
        raise Damaged("no end of headers")
    lines = head.split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", VERSION):
        raise Damaged(f"version line {lines[0][:20]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged(f"header line {line[:40]!r}")
        headers[name.decode().strip().lower()] = value.decode().strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise Damaged(f"no {name}")
    if not headers["content-length"].isdigit():
        raise Damaged("content-length isn't a number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise Damaged(f"{len(rest) - 4} bytes where content-length says {n}")
    return headers, rest[:n]


def _unpacked(frame, some: bytes, at: int) -> bytes:
    try:
        return frame.decompress(some)
    except zstandard.ZstdError as e:
        raise Damaged(f"byte {at}: {e}") from e


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive. A dictionary stands in the first frame, as it is or compressed; further skippable frames are passed over."""
    at, known, first = 0, None, True
    while at < len(raw):
        if len(raw) - at < 8:
            raise Damaged(f"byte {at}: cut short")
        magic, size = struct.unpack_from("<II", raw, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            body = raw[at + 8 : at + 8 + size]
            if len(body) != size:
                raise Damaged(f"byte {at}: skippable frame cut short")
            if first and magic == DICTIONARY_FRAME:
                if body[:4] == struct.pack("<I", FRAME):
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                if body[:4] != struct.pack("<I", DICTIONARY):
                    raise Damaged(f"byte {at}: no dictionary in its frame")
                known = zstandard.ZstdCompressionDict(body)
            at, first = at + 8 + size, False
            continue
        if magic != FRAME:
            raise Damaged(f"byte {at}: no frame begins here")
        one = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        parts, to = [], at
        while not one.eof and to < len(raw):
            parts.append(_unpacked(one, raw[to : to + STRIDE], at))
            to = min(to + STRIDE, len(raw))
        if not one.eof:
            raise Damaged(f"byte {at}: frame cut short")
        try:
            yield parsed(b"".join(parts))
        except Damaged as e:
            raise Damaged(f"byte {at}: {e}") from None
        at, first = to - len(one.unused_data), False


def planned(pages: DataFrame, id: str, payload: str) -> DataFrame:
    """Adds digest, size, original (the smallest id of equal payloads of LEAST bytes and more, where the row has another id; else null)."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.withColumns({"digest": F.sha2(body, 256), "size": F.octet_length(body).cast("long")})
    groups = rows.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min(id).alias("least"), F.count("*").alias("n")).where("n > 1 AND least IS NOT NULL")
    # equal payloads may be a third of all rows: their group's row goes to each salt
    groups = groups.select(F.col("digest").alias("d"), "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    deal = F.pmod(F.xxhash64(F.col(id).cast("string")), F.lit(SALTS)).cast("int")
    joined = rows.join(groups, (F.col("digest") == F.col("d")) & (deal == F.col("salt")), "left").drop("d", "salt")
    return joined.withColumn("original", F.when(~F.col("least").eqNullSafe(F.col(id)), F.col("least"))).drop("least")


def written(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives (name, content) with a record for each row; equal payloads of LEAST bytes and more are stored once, by the smallest id.

    Null payloads are empty; null urls and ids leave their headers empty. Rows that repeat the smallest id are responses all; of payloads whose ids are all null, too.
    """
    ship(pages.sparkSession)
    rows = planned(pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(payload).alias("html")), "id", "html")
    rows = rows.select("id", "url", F.when(F.col("original").isNull(), F.coalesce("html", F.lit(""))).otherwise("").alias("html"), "digest", "size", "original")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def packed() -> pa.RecordBatch:
            content = archive(held)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()[:24] + ".warc.zst"]), pa.array([content], pa.binary())], ["name", "content"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pydict()
                for key, link, html, digest, length, original in zip(*(part[c] for c in ("id", "url", "html", "digest", "size", "original"))):
                    headers = {
                        "WARC-Type": "response" if original is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if key is None else key}>", "WARC-Date": date,
                        "WARC-Target-URI": " ".join((link or "").split()), "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "text/html; charset=utf-8",
                    }
                    if original is not None:
                        headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:page:{original}>", "Payload-Length": str(length)}
                    held.append(record(headers, html.encode()))
                    size += len(held[-1])
                    if size >= LARGEST:
                        yield packed()
                        held, size = [], 0
        if held:
            yield packed()

    return rows.mapInArrow(run, "name string, content binary")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Archives that lie as files below a path that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.col("path").alias("name"), "content")


def read(archives: DataFrame) -> DataFrame:
    """Records of archives (name, content): page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload (null for revisits).

    Stops at the first archive that breaks the format, or whose payload hasn't the digest its record tells.
    """
    ship(archives.sparkSession)
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def number(urn: str) -> int | None:
        value = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                rows: list[tuple] = []
                try:
                    for h, body in records(row["content"]):
                        digest = h["warc-payload-digest"].removeprefix("sha256:")
                        again = h["warc-type"] == "revisit"
                        if not again and hashlib.sha256(body).hexdigest() != digest:
                            raise Damaged(f"payload of {h['warc-record-id']} hasn't its digest")
                        size = int(h["payload-length"]) if again else len(body)
                        rows.append((number(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], digest, size, number(h["warc-refers-to"]) if again else None, None if again else body))
                except (Damaged, KeyError) as e:
                    raise Damaged(f"{row['name']}: {e}") from e
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + 256]], kinds[k]) for k in range(7)], names)

    return archives.mapInArrow(run, "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    return read(staged(written(pages)))
