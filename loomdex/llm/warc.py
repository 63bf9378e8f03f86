"""Deterministic sharded WARC archives.

Writing: records are sorted by id within ranges of ids. The ranges follow from the
bytes in at most ``RANGES`` equal steps of the id, and a step above ``shard_bytes`` is
split again, down to single ids, so neither a sample nor the number of tasks moves them.
Rows without id are dealt by the hash of their payload to shards of their own. A task streams one range, compresses every record as a gzip member
of its own, and starts a new file where the compressed size passes ``file_bytes``.
Headers, record ids and digests are made anew from the row alone: the same table
gives the same bytes. A file is written under a temporary name with the attempt's
number and renamed when complete; a manifest table names the complete files, is
committed last, and readers open only what it names, so lost or repeated attempts
leave nothing that is read.

Of records with equal payloads (SHA-256) of at least ``revisit_bytes``, the one with
the largest id is the response and the others are revisits that refer to it.

Cases: a null payload is empty. A null url is an empty target. Control characters
and spaces in a url are percent-encoded. Rows without id have no key in the archive and
come first; they are responses unless a row with an id has their payload. Rows that
repeat the response's id and payload are responses too. An empty table writes an
empty manifest. Only the three named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import new_folder

RANGES = 4096
MANIFEST = "shard int, file string, records long, bytes long, sha1 string"
RECORD = "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcSettings:
    shard_bytes: int = 64 << 20
    file_bytes: int = 16 << 20
    revisit_bytes: int = 0
    date: str = "2000-01-01T00:00:00Z"
    level: int = 6


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key}:{digest}')}>"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(key: int | None, url: str | None, payload: bytes, owner: int | None, settings: WarcSettings) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if owner is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
    return record(
        [
            ("WARC-Type", "response" if owner is None else "revisit"),
            ("WARC-Record-ID", record_id(key, digest)),
            ("WARC-Date", settings.date),
            ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
            ("WARC-Profile", None if owner is None else PROFILE),
            ("WARC-Refers-To", None if owner is None else record_id(owner, digest)),
            ("X-Record-Key", key),
            ("X-Payload-Length", len(payload)),
            ("X-Refers-To-Key", owner),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


class RollingFiles:
    """The files of one shard; each is renamed when it is complete."""

    def __init__(self, folder: str, shard: int, attempt: int, settings: WarcSettings) -> None:
        from pyarrow import fs

        self.files, self.path = fs.FileSystem.from_uri(folder)
        self.shard, self.attempt, self.settings = shard, attempt, settings
        self.sequence, self.done, self.out = 0, [], None

    def open(self) -> None:
        self.name = f"part-{self.shard:06d}-{self.sequence:05d}.warc.gz"
        self.temporary = f"{self.path}/_temporary/{self.name}.{self.attempt}"
        self.files.create_dir(f"{self.path}/_temporary", recursive=True)
        self.out = self.files.open_output_stream(self.temporary, compression=None)
        self.records, self.size, self.sha = 0, 0, hashlib.sha1()
        info = f"software: loomdex\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
        self.append(
            record(
                [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", self.settings.date),
                 ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")],
                info,
            )
        )

    def append(self, raw: bytes) -> None:
        member = gzip.compress(raw, self.settings.level, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def write(self, raw: bytes) -> None:
        if self.out is None:
            self.open()
        self.append(raw)
        self.records += 1
        if self.size >= self.settings.file_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.move(self.temporary, f"{self.path}/{self.name}")
            self.done.append((self.shard, self.name, self.records, self.size, self.sha.hexdigest()))
            self.out, self.sequence = None, self.sequence + 1


def archiver(folder: str, settings: WarcSettings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a shard by id; before an id's records come its revisit marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        files, shard, marked, owners, done = None, None, object(), {}, []
        for batch in batches:
            for shard_now, key, sha, owner, url, html in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "sha", "owner", "url", "html")), strict=True):
                if shard_now != shard:
                    if files:
                        files.close()
                        done += files.done
                    files, shard = RollingFiles(folder, shard_now, attempt, settings), shard_now
                if key != marked:
                    marked, owners = key, {}
                if sha is not None:
                    owners[sha] = owner
                    continue
                payload = (html or "").encode()
                found = owners.get(hashlib.sha256(payload).hexdigest()) if owners else None
                files.write(page_record(key, url, payload, found, settings))
        if files:
            files.close()
            done += files.done
        names = ["shard", "file", "records", "bytes", "sha1"]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kinds[k]) for k in range(5)], names)

    return run


def shard_bounds(rows: DataFrame, settings: WarcSettings) -> tuple[list[tuple[int, DataFrame]], int, int]:
    """Shards by levels, each (bits, (cell, shard)) for the ids of a cell ``id >> bits``; how
    many shards rows without id have before them; and the number of all shards.

    A cell above ``shard_bytes`` is absent from its level and split in the next one.
    """
    least, most, unnamed = rows.agg(F.min("page_id"), F.max("page_id"), F.sum(F.when(F.col("page_id").isNull(), F.col("size")))).first()
    first = 0 if unnamed is None else max(1, -(-unnamed // settings.shard_bytes))
    if least is None:
        return [], first, max(1, first)
    bits = 0
    while (most >> bits) - (least >> bits) >= RANGES:
        bits += 1
    leaves, named = [], rows.filter("page_id IS NOT NULL")
    while True:
        sums = named.groupBy(F.shiftright("page_id", bits).alias("cell")).agg(F.sum("size").alias("size")).collect()
        heavy = [cell for cell, size in sums if bits and size > settings.shard_bytes]
        leaves += [(cell << bits, bits, cell, size) for cell, size in sums if not bits or size <= settings.shard_bytes]
        if not heavy:
            break
        cells = rows.sparkSession.createDataFrame([(cell,) for cell in heavy], "heavy long")
        named = named.join(F.broadcast(cells), F.shiftright("page_id", bits) == F.col("heavy"), "left_semi")
        # About RANGES new cells in all, at least 64 for each that is split.
        parts = max(64, RANGES // len(heavy))
        bits = max(0, bits - (parts.bit_length() - 1))
    levels, held, shard = {}, 0, first
    for _, bits, cell, size in sorted(leaves):
        if held and held + size > settings.shard_bytes:
            shard, held = shard + 1, 0
        held += size
        levels.setdefault(bits, []).append((cell, shard))
    frames = [(bits, rows.sparkSession.createDataFrame(cells, "cell long, shard int")) for bits, cells in levels.items()]
    return frames, first, shard + 1


def write_warc(pages: DataFrame, folder: str, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """Write the archives below ``folder`` and return the committed manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.coalesce("html", F.lit(""))
    light = rows.select("page_id", F.sha2(payload, 256).alias("sha"), F.octet_length(payload).alias("size"))
    repeated = light.filter(F.col("size") >= settings.revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    repeated = repeated.filter("n > 1 AND owner IS NOT NULL").drop("n")
    marks = light.join(repeated, "sha").filter(~F.col("page_id").eqNullSafe(F.col("owner"))).select("page_id", "sha", "owner").distinct()
    none = F.lit(None).cast("string")
    records = rows.select("page_id", none.alias("sha"), F.lit(None).cast("long").alias("owner"), "url", "html").union(
        marks.select("page_id", "sha", "owner", none, none)
    )
    levels, first, shards = shard_bounds(light, settings)
    # A mark and the payload it is for have one hash, so they meet in one shard.
    of_payload = F.pmod(F.xxhash64(F.coalesce("sha", F.sha2(payload, 256))), F.lit(max(1, first))).cast("int")
    placed, shard = records, F.when(F.col("page_id").isNull(), of_payload)
    for k, (bits, cells) in enumerate(levels):
        cells = cells.select(F.col("cell").alias(f"cell{k}"), F.col("shard").alias(f"shard{k}"))
        placed = placed.join(F.broadcast(cells), F.shiftright("page_id", bits) == F.col(f"cell{k}"), "left")
        shard = F.coalesce(shard, F.col(f"shard{k}"))
    placed = placed.select("page_id", "sha", "owner", "url", "html", shard.alias("shard"))
    ordered = placed.repartitionById(shards, "shard").sortWithinPartitions(
        "shard", F.col("page_id").asc_nulls_first(), F.col("sha").desc_nulls_last(), "url", "html"
    )
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(archiver(folder, settings), MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def records_of(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block


def reader(folder: str, with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kinds[k]) for k in range(7)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        found, held = [], 0
        for names in batches:
            for name in names.column("file").to_pylist():
                with files.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.open(raw) as plain:
                    for fields, block in records_of(io.BufferedReader(plain)):
                        if fields["warc-type"] == "warcinfo":
                            continue
                        if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"{name}: a block differs from its digest")
                        payload = block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if payload is not None and (base32_sha1(payload) != digest or len(payload) != int(fields["x-payload-length"])):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        key, owner = fields.get("x-record-key"), fields.get("x-refers-to-key")
                        found.append(
                            (key and int(key), fields["warc-type"], fields["warc-target-uri"], int(fields["x-payload-length"]), digest,
                             owner and int(owner), payload if with_payload else None)
                        )
                        held += len(payload or b"") if with_payload else 100
                        if held > 4 << 20:
                            yield batch(found)
                            found, held = [], 0
        yield batch(found)

    return run


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest below ``folder`` names."""
    names = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file")
    files = names.repartition(max(1, names.count()))
    return files.mapInArrow(reader(folder, with_payload), RECORD)


def archive_and_read(pages: DataFrame, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """Write archives to the shared folder and read them back, without payloads."""
    folder = new_folder(pages.sparkSession, "warc")
    write_warc(pages, folder, settings)
    return read_warc(pages.sparkSession, folder, with_payload=False)
