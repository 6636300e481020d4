"""Recordings: a container of records, read and written by Spark.

``WAWR``, container version u16, metadata length u32, metadata (tag u16, length u32, value), then
records (kind u8, length u32, payload) and a trailer record of kind 255 with their count and the
CRC-32 of all before it. Reading goes by file through ``binaryFile``, so it works on any file system
that Spark reads. A table holds a recording's bytes in parts of about 16 KB, so it may be of any size; records can only
be found one after the other, so a task walks a recording part by part and holds an open record at most.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.binary import joined, le, let
from tapeloom.operators.sequence import STRETCH

# Fixed values of the container.
MAGIC, VERSION = b"WAWR", 1
ENVELOPE, MARK, TRAILER = 0, 1, 255
CRITICAL = 0x8000
TAGS = {0x8001: "adapter", 0x8002: "provenance", 0x8003: "dictionary", 0x8004: "artifact_class", 0x8005: "input_digest", 0x8006: "transform", 1: "created_at", 2: "note"}

RECORD = "struct<ord: bigint, kind: int, payload: binary>"
WALKED = f"path string, error string, integrity string, found bigint, claimed bigint, dangling bigint, skipped bigint, unknown_critical bigint, meta array<struct<tag: int, value: binary>>, records array<{RECORD}>"
_STATES = ("error", "integrity", "found", "claimed", "dangling", "skipped", "unknown_critical")
_ARROW = pa.schema(
    [("path", pa.string()), ("error", pa.string()), ("integrity", pa.string())]
    + [(c, pa.int64()) for c in _STATES[2:]]
    + [("meta", pa.list_(pa.struct([("tag", pa.int32()), ("value", pa.binary())]))), ("records", pa.list_(pa.struct([("ord", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])))]
)
#: Bytes that a part of a table has before the record that fills it; bytes and records of a row of the walk, likewise.
PART, ROW, ROW_RECORDS = 1 << 14, 1 << 20, 1 << 13
#: Sections of a recording in a table.
HEAD, BODY, TAIL = 0, 1, 2
_ZEROS = memoryview(bytes(1 << 16))


class Walk:
    """A walk through one recording whose bytes come in runs of any size.

    It holds the bytes of the metadata or record that isn't whole yet, and the whole records until they are taken;
    without ``kept`` no records, whatever their size.
    """

    def __init__(self, path: str | None, kept: bool = True):
        self.out = dict.fromkeys(_STATES) | {"path": path, "meta": [], "records": []}
        self.kept, self.size = kept, 0
        self.held, self.begun, self.over = bytearray(), False, False
        self.crc = self.found = self.skipped = self.dangling = 0
        # Of a record that isn't kept: its kind, the bytes seen of it and those to come.
        self.open, self.seen, self.left = None, 0, 0

    def feed(self, data: bytes | memoryview) -> None:
        if self.over:
            self.dangling += len(data)
            return
        if self.left:
            data = memoryview(data)
            n = min(self.left, len(data))
            self.crc, self.seen, self.left = zlib.crc32(data[:n], self.crc), self.seen + n, self.left - n
            if self.left:
                return
            self._count(self.open)
            self.seen, data = 0, data[n:]
        self.held += data
        if self.begun or self._begin():
            self._records()

    def _begin(self) -> bool:
        """Whether the header and the metadata are there and sound."""
        held = self.held
        if held[:4] != MAGIC[: len(held)]:
            return self._fail("magic")
        if len(held) < 10:
            return False
        version, size = struct.unpack_from("<HI", held, 4)
        if version != VERSION:
            return self._fail("container_version")
        at, end = 10, 10 + size
        if end > len(held):
            return False
        while at < end:
            if at + 6 > end:
                return self._fail("metadata")
            tag, n = struct.unpack_from("<HI", held, at)
            if at + 6 + n > end:
                return self._fail("metadata")
            self.out["meta"].append({"tag": tag, "value": bytes(held[at + 6 : at + 6 + n])})
            at += 6 + n
        self.out["unknown_critical"] = sum(m["tag"] & CRITICAL > 0 and m["tag"] not in TAGS for m in self.out["meta"])
        self.begun = True
        self._pass(end)
        return True

    def _fail(self, error: str) -> bool:
        self.out["error"], self.over = error, True
        self.held.clear()
        return False

    def _pass(self, n: int) -> None:
        """The first bytes of those held are done with."""
        with memoryview(self.held) as held:
            self.crc = zlib.crc32(held[:n], self.crc)
        del self.held[:n]

    def _count(self, kind: int) -> None:
        self.found += 1
        self.skipped += kind not in (ENVELOPE, MARK)

    def _records(self) -> None:
        held, at = self.held, 0
        while at + 5 <= len(held):
            kind, size = struct.unpack_from("<BI", held, at)
            end = at + 5 + size
            if end > len(held):
                if not self.kept and kind != TRAILER:
                    self.open, self.seen, self.left = kind, len(held) - at, end - len(held)
                    at = len(held)
                break
            if kind == TRAILER:
                claimed, crc = struct.unpack("<II", bytes(held[at + 5 : min(end, at + 13)]).ljust(8, b"\0"))
                rest = len(held) - end
                self._pass(at)
                self.out |= {"claimed": claimed, "integrity": "complete" if crc == self.crc and claimed == self.found else "damaged"}
                self.over, self.dangling = True, rest
                self.held.clear()
                return
            if self.kept:
                self.out["records"].append({"ord": self.found, "kind": kind, "payload": bytes(held[at + 5 : end])})
                self.size += size
            self._count(kind)
            at = end
        self._pass(at)

    def taken(self) -> dict | None:
        """The records so far as a row without a state, if they fill one."""
        if self.size < ROW and len(self.out["records"]) < ROW_RECORDS:
            return None
        row = dict.fromkeys(_STATES) | {"path": self.out["path"], "meta": None, "records": self.out["records"]}
        self.out["records"], self.size = [], 0
        return row

    def end(self) -> dict:
        """The state, with the records that weren't taken."""
        out = self.out
        if not self.begun and not out["error"]:
            out["error"] = "magic" if len(self.held) < 4 else "truncated_header" if len(self.held) < 10 else "truncated_metadata"
        if out["error"]:
            return out
        out |= {"found": self.found, "skipped": self.skipped, "dangling": self.dangling}
        if not out["integrity"]:
            out |= {"integrity": "truncated", "dangling": self.seen + len(self.held)}
        elif self.dangling:
            out["integrity"] = "trailing_bytes"
        return out


def walk(path: str | None, data: bytes) -> dict:
    """One file's metadata, records and state: complete, damaged, trailing_bytes or truncated."""
    walked = Walk(path)
    walked.feed(data)
    return walked.end()


def _walked(rows: DataFrame, kept: bool, whole: bool) -> DataFrame:
    """``WALKED`` from ``path, content`` in order; ``whole``: each row is a recording of its own."""

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda r: pa.RecordBatch.from_pylist([r], schema=_ARROW)
        walked = None
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                if walked is None or whole or path.as_py() != walked.out["path"]:
                    if walked is not None:
                        yield row(walked.end())
                    walked = Walk(path.as_py(), kept)
                data = memoryview(content.as_buffer() or b"")
                for at in range(0, len(data), PART):
                    walked.feed(data[at : at + PART])
                    if full := walked.taken():
                        yield row(full)
        if walked is not None:
            yield row(walked.end())

    return rows.select("path", "content").mapInArrow(walks, WALKED)


def walk_files(files: DataFrame) -> DataFrame:
    """``WALKED`` from rows ``path, content``, each a file.

    A long recording gives several rows, with about ``ROW`` bytes of its records each; the state and the metadata
    stand in its last, which alone has an ``integrity`` or an ``error``.
    """
    return _walked(files, True, True)


def states(recordings: DataFrame) -> DataFrame:
    """One row per recording, without its records."""
    return recordings.filter("error is not null or integrity is not null").drop("records")


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """The files under ``path`` as ``walk_files`` gives them; an unreadable header gives ``error``, a cut file its whole records."""
    return walk_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.wawr").option("recursiveFileLookup", "true").load(path))


def records(recordings: DataFrame) -> DataFrame:
    """``path, ord, kind, payload``."""
    return recordings.select("path", F.inline("records"))


def envelopes(recordings: DataFrame) -> DataFrame:
    return records(recordings).filter(F.col("kind") == ENVELOPE).select("path", "ord", F.col("payload").alias("envelope"))


def marks(recordings: DataFrame) -> DataFrame:
    """Annotations: ``path, ord, delta_us, label``."""
    from tapeloom.functions.binary import read_le

    found = records(recordings).filter(F.col("kind") == MARK)
    return found.select("path", "ord", read_le(F.col("payload"), 1, 4).alias("delta_us"), F.expr("try_validate_utf8(cast(substring(payload, 5) as string))").alias("label"))


def meta_value(meta: Column, name: str) -> Column:
    """The first value of a tag, as bytes."""
    tag = next(t for t, n in TAGS.items() if n == name)
    return F.get(F.filter(meta, lambda m: m["tag"] == tag), F.lit(0))["value"]


def digest_text(value: Column) -> Column:
    """Printable ASCII as it is, other bytes as hex."""
    return F.when(F.hex(value).rlike("^([2-6][0-9A-F]|7[0-9A-E])*$"), value.cast("string")).otherwise(F.lower(F.hex(value)))


def _head(meta: dict[str, bytes] | None) -> bytes:
    tags = {n: t for t, n in TAGS.items()}
    packed = b"".join(struct.pack("<HI", tags[n], len(v)) + v for n, v in (meta or {}).items())
    return MAGIC + struct.pack("<HI", VERSION, len(packed)) + packed


def _record() -> Column:
    return F.concat(le(F.col("kind"), 1), le(F.octet_length("payload"), 4), F.col("payload"))


def contents(rows: DataFrame, meta: dict[str, bytes] | None = None, finished: bool = True) -> DataFrame:
    """``recording, content``: the bytes of a file per recording, from ``recording, ord, kind, payload``.

    Built from functions alone: records in order, the count and ``crc32`` for the trailer. Without
    ``finished`` there is no trailer, as in a file still being written. A file is one cell, which bounds
    its size; ``write_recordings`` has no such bound.
    """
    head = F.lit(_head(meta))
    grouped = rows.select("recording", F.struct("ord", _record().alias("bytes")).alias("r")).groupBy("recording").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    # Hex digits join without the quadratic copying of a fold over bytes.
    body = F.concat(head, F.unhex(F.array_join(F.transform("rs", lambda r: F.hex(r["bytes"])), "")))
    trailer = lambda b: F.concat(b, le(F.lit(TRAILER), 1), le(F.lit(8), 4), le(F.size("rs"), 4), le(F.crc32(b), 4))
    return grouped.select("recording", let(body, trailer if finished else lambda b: b).alias("content"))


def parts(rows: DataFrame, size: int = PART) -> DataFrame:
    """The records of ``recording, ord, kind, payload`` as bytes, in parts: ``recording, section, stretch, part, n, size, crc, content``.

    Rows are dealt by recording and stretches of ``ord`` (numbers); within one, a part ends with the record
    that brings it to ``size`` bytes. ``n``: its records.
    """
    rows = rows.select("recording", "ord", F.floor(F.col("ord") / STRETCH).alias("stretch"), _record().alias("bytes"))
    before = W.partitionBy("recording", "stretch").orderBy("ord", "bytes").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.octet_length("bytes")).over(before), F.lit(0)))
    placed = rows.select("recording", "stretch", F.floor(F.col("at") / size).alias("part"), F.struct("at", "bytes").alias("r"))
    grouped = placed.groupBy("recording", "stretch", "part").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    made = grouped.select("recording", "stretch", "part", F.size("rs").cast("bigint").alias("n"), joined(F.col("rs.bytes")).alias("content"))
    return made.select("recording", F.lit(BODY).alias("section"), "stretch", "part", "n", F.octet_length("content").cast("bigint").alias("size"), F.crc32("content").alias("crc"), "content")


def joined_crc(first: int, second: int, size: int) -> int:
    """The CRC-32 of bytes and ``size`` more, from that of each: by what as many zeros make of the first, as a CRC is linear."""
    shifted, none = first, 0
    for at in range(0, size, len(_ZEROS)):
        zeros = _ZEROS[: size - at]
        shifted, none = zlib.crc32(zeros, shifted), zlib.crc32(zeros, none)
    return shifted ^ none ^ second


def _ends(made: DataFrame, head: bytes) -> DataFrame:
    """The first and the last part of each recording, from the counts, sizes and checksums of those between."""
    columns = ["recording", "section", "stretch", "part", "n", "size", "crc", "content"]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def both() -> pa.RecordBatch:
            tail = struct.pack("<BIII", TRAILER, 8, n & 0xFFFFFFFF, crc)
            found = [[name] * 2, [HEAD, TAIL], [None] * 2, [None] * 2, [0] * 2, [len(head), len(tail)], [zlib.crc32(head), zlib.crc32(tail)], [head, tail]]
            kinds = [kind, pa.int32(), *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found, kinds, strict=True)], names=columns)

        begun, name, n, crc, kind = False, None, 0, 0, None
        for batch in batches:
            kind = batch.schema.field("recording").type
            for r in batch.to_pylist():
                if not begun or r["recording"] != name:
                    if begun:
                        yield both()
                    begun, name, n, crc = True, r["recording"], 0, zlib.crc32(head)
                n, crc = n + r["n"], joined_crc(crc, r["crc"], r["size"])
        if begun:
            yield both()

    rows = made.select("recording", "stretch", "part", "n", "size", "crc").repartition("recording").sortWithinPartitions("recording", "stretch", "part")
    return rows.mapInArrow(ends, made.select(*columns).schema)


def write_recordings(rows: DataFrame, path: str, meta: dict[str, bytes] | None = None) -> None:
    """A Parquet table of ``parts``, which executors can write to any shared folder.

    First the records, then what stands before and behind them; a recording that was cut off between the two can't be read.
    ``read_tables`` reads it back; ``contents`` gives one recording's bytes for other tools.
    """
    parts(rows).write.mode("overwrite").parquet(path)
    _ends(rows.sparkSession.read.parquet(path), _head(meta)).write.mode("append").parquet(path)


def read_tables(spark: SparkSession, path: str, kept: bool = True) -> DataFrame:
    """The recordings of a table as ``walk_files`` gives files; without ``kept`` all is walked, but no record returned."""
    rows = spark.read.parquet(path).withColumn("path", F.col("recording").cast("string"))
    return _walked(rows.repartition("path").sortWithinPartitions("path", "section", "stretch", "part"), kept, False)


def direction_positions(rows: DataFrame) -> DataFrame:
    """Place of each record in its recording, from 0, by ``ord``."""
    return rows.withColumn("position", F.row_number().over(W.partitionBy("path").orderBy("ord")) - 1)
