"""WARC archives: write records with an index, read selected records back by ranges.

Each writing task makes one archive, every record a gzip member of its own, and
returns the record's index entry (archive, offset, length, URL, digest). The index
is a table; entries of failed or repeated task attempts never get into it, as every
attempt writes an archive of its own name. Reading selects index entries, puts
neighbouring ones into one byte range, and fetches only these ranges.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch_path, text_or_empty

#: Payloads below this are never revisits.
LEAST_REVISIT = 100
#: Ranges join over gaps of at most this, and are cut at about this many bytes.
MAX_GAP, MAX_RANGE = 64 << 10, 4 << 20
#: Rows of one payload digest are spread over so many keys before they are joined.
SALTS = 32
DATE = "2024-01-01T00:00:00Z"

INDEX = T.StructType(
    [
        T.StructField("record", T.LongType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("digest", T.StringType()),
    ]
)


def _header_value(value: str) -> str:
    """A header field's value on one line: percent signs and controls are coded."""
    return "".join(f"%{ord(c):02X}" if c == "%" or ord(c) < 32 or ord(c) == 127 else c for c in value)


def _plain_value(value: str) -> str:
    out, parts = [], value.split("%")
    out.append(parts[0])
    for p in parts[1:]:
        out.append(chr(int(p[:2], 16)) + p[2:])
    return "".join(out)


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the payload's digest and length in
    its header, and no payload."""
    body = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _header_value(url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "text/html; charset=utf-8"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields.append(("WARC-Refers-To", _record_id(refers_to)))
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("X-Refers-To-Page-ID", str(refers_to)))
    fields.append(("Content-Length", str(len(body))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (and under "version" the first line) and the content block."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k: v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record does not end where its header says")
    return {"version": version, **fields}, rest[:size]


def plan_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload (binary) -> + digest, refers_to (null for responses).

    Of rows with equal payloads of at least ``least`` bytes, those with the smallest
    page_id are responses. The digests that occur again are joined back over salted
    keys, so rows of one very common payload are spread over tasks.
    """
    known = materialize(
        pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("size")), "warc-digests"
    )
    first = known.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    first = materialize(first.filter("n > 1").select("digest", "first", salts.alias("salt")), "warc-repeated")
    rows = pages.withColumns(
        {"digest": F.sha2("payload", 256), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")}
    )
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return rows.join(first, ["digest", "salt"], "left").withColumn("refers_to", refers).drop("first", "salt")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write page_id, url, payload, digest, refers_to as archives under ``folder``
    and return the index. It is written as a table first, so that it is the index
    of exactly the archives that its own tasks wrote."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = fs.FileSystem.from_uri(folder)
        name, sink, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            index = []
            for page_id, url, payload, digest, refers_to in zip(*(batch[c] for c in range(5)), strict=True):
                if sink is None:
                    files.create_dir(top)
                    sink = files.open_output_stream(f"{top}/{name}", compression=None)
                page, body, refers = page_id.as_py(), payload.as_py() or b"", refers_to.as_py()
                member = _record(page, url.as_py(), body, digest.as_py(), refers, refers is not None)
                sink.write(member)
                index.append((page, name, at, len(member), url.as_py(), digest.as_py()))
                at += len(member)
            columns = list(zip(*index, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=INDEX.names)
        if sink is not None:
            sink.close()

    chosen = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "payload", "digest", "refers_to")
    return materialize(chosen.mapInArrow(write, INDEX), "warc-index")


def plan_ranges(index: DataFrame) -> DataFrame:
    """Selected index entries -> archive and its entries of about ``MAX_RANGE``
    consecutive bytes, sorted by offset."""
    entry = F.struct("offset", "length")
    return index.groupBy("archive", F.floor(F.col("offset") / MAX_RANGE).alias("stretch")).agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )


def coalesce_ranges(entries: list[tuple[int, int]], gap: int = MAX_GAP) -> list[tuple[int, int, list]]:
    """Sorted (offset, length) -> (start, end, entries) of each range to fetch."""
    out: list = []
    for offset, length in entries:
        if out and offset - out[-1][1] <= gap:
            start, end, own = out[-1]
            own.append((offset, length))
            out[-1] = (start, max(end, offset + length), own)
        else:
            out.append((offset, offset + length, [(offset, length)]))
    return out


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the selected index entries: page_id, url, record_type,
    payload_digest and payload_bytes (for responses taken from the payload itself,
    for revisits from the header), refers_to, payload (null for revisits)."""
    schema = (
        "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, "
        "refers_to bigint, payload binary"
    )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = fs.FileSystem.from_uri(folder)
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for archive, entries in zip(batch["archive"].to_pylist(), batch["entries"], strict=True):
                wanted = [(e["offset"].as_py(), e["length"].as_py()) for e in entries]
                with files.open_input_file(f"{top}/{archive}") as source:
                    for start, end, own in coalesce_ranges(wanted):
                        block = source.read_at(end - start, start)
                        found = [_row(block[o - start : o - start + n]) for o, n in own]
                        columns = list(zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
                        )

    return plan_ranges(index).select("archive", "entries").mapInArrow(read, schema)


def _row(member: bytes) -> tuple:
    head, body = parse_record(member)
    page = int(head["X-Page-ID"]) if head["X-Page-ID"] else None
    url = _plain_value(head["WARC-Target-URI"])
    kind = head["WARC-Type"]
    if kind == "revisit":
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        return page, url, kind, digest, int(head["X-Payload-Length"]), int(head["X-Refers-To-Page-ID"]), None
    digest = hashlib.sha256(body).hexdigest()
    if head["WARC-Payload-Digest"] != f"sha256:{digest}":
        raise ValueError(f"page {page}: the payload does not have its digest")
    return page, url, kind, digest, len(body), None, body


def archive_pages(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """page_id, url, html -> the index of the archives written, and their folder
    (by default one in the shared folder).

    Null html: an empty payload. Null url: an empty one. Null page_id: a record
    without an id; it is a revisit wherever its payload has been seen with an id.
    Repeated rows: a record each; rows of the smallest page_id of a payload are all
    responses. Empty table: no archives, an empty index. Further columns are ignored.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc-archives")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), text_or_empty("html").cast("binary").alias("payload"))
    return write_archives(plan_revisits(rows), folder), folder


def op3(spark, sf_dir):
    index, folder = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_sql(pages: str = "pages") -> str:
    return f"""
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM {pages}),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM rows)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM firsts
"""
