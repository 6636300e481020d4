"""Envelopes: a frame with the payloads that belong to its nodes, read and written natively.

Little-endian: version u16, flags u16, frame length u32, frame, entry count u16, then per entry
path length u8, path u16 each, status u8, payload length u32, payload.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.binary import joined, le, let, read_le

VERSION = 1
#: Status names by byte.
STATUS = ("ok", "decrypt_failed", "unsupported", "unobserved")
ENTRY = "struct<path: array<int>, status: int, payload: binary>"


def encode(frame: Column, *, outbound: Column, reencoded: Column, entries: Column | None = None) -> Column:
    """An envelope; null where an entry has a payload without status ok, or a status beyond the four."""
    flags = F.when(outbound, 1).otherwise(0) + F.when(reencoded, 2).otherwise(0)
    head = let(frame, lambda f: F.concat(le(F.lit(VERSION), 2), le(flags, 2), le(F.octet_length(f), 4), f))
    if entries is None:
        return F.concat(head, le(F.lit(0), 2))

    def entry(e: Column) -> Column:
        path = joined(F.transform(e["path"], lambda p: le(p, 2)))
        return F.concat(le(F.size(e["path"]), 1), path, le(e["status"], 1), le(F.octet_length(e["payload"]), 4), e["payload"])

    def sealed(found: Column) -> Column:
        sound = F.forall(found, lambda e: e["status"].between(0, 3) & ((e["status"] == 0) | (F.octet_length(e["payload"]) == 0)))
        return F.when(sound, F.concat(le(F.size(found), 2), joined(F.transform(found, entry))))

    return F.concat(head, let(entries, sealed))


def header(envelope: Column) -> Column:
    """``version, flags, frame_len, outbound, reencoded, error`` without a look at the entries."""
    head = F.struct(read_le(envelope, 1, 2).alias("version"), read_le(envelope, 3, 2).alias("flags"), read_le(envelope, 5, 4).alias("frame_len"), F.octet_length(envelope).alias("size"))

    def told(h: Column) -> Column:
        error = (
            F.when(h["frame_len"].isNull() | (h["size"] < 10 + h["frame_len"]), "truncated")
            .when(h["version"] != VERSION, "version")
            .when(h["flags"].bitwiseAND(F.lit(~3)) != 0, "reserved_flag")
        )
        return F.struct(
            h["version"].alias("version"),
            h["flags"].alias("flags"),
            h["frame_len"].alias("frame_len"),
            (h["flags"].bitwiseAND(F.lit(1)) != 0).alias("outbound"),
            (h["flags"].bitwiseAND(F.lit(2)) != 0).alias("reencoded"),
            error.alias("error"),
        )

    return let(head, told)


def frame_of(envelope: Column) -> Column:
    return F.substring(envelope, F.lit(9), read_le(envelope, 5, 4).cast("int"))


def entries(envelope: Column) -> Column:
    """``entries`` (array of path, status, payload) and ``error``: all are walked before any is given."""
    at = 9 + read_le(envelope, 5, 4)
    count = read_le(envelope, at.cast("int"), 2)
    begin = F.struct((at + 2).alias("at"), F.array().cast(f"array<{ENTRY}>").alias("entries"), F.lit(None).cast("string").alias("error"))

    def step(acc: Column, _: Column) -> Column:
        size = read_le(envelope, acc["at"].cast("int"), 1)

        def sized(n: Column) -> Column:
            path = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: read_le(envelope, (acc["at"] + 1 + 2 * k).cast("int"), 2).cast("int"))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                path.alias("path"),
                read_le(envelope, (acc["at"] + 1 + 2 * n).cast("int"), 1).alias("status"),
                read_le(envelope, (acc["at"] + 2 + 2 * n).cast("int"), 4).alias("length"),
                (acc["at"] + 6 + 2 * n).alias("start"),
            )

        def taken(e: Column) -> Column:
            payload = F.substring(envelope, e["start"].cast("int"), e["length"].cast("int"))
            wrong = (
                F.when(e["length"].isNull() | (F.octet_length(envelope) < e["start"] - 1 + e["length"]), "truncated")
                .when(e["status"] > 3, "status")
                .when((e["status"] != 0) & (e["length"] > 0), "payload_on_failure")
            )
            made = F.struct(e["path"].alias("path"), e["status"].cast("int").alias("status"), payload.alias("payload"))
            return let(
                F.coalesce(acc["error"], wrong),
                lambda error: F.struct(
                    F.when(error.isNull(), e["start"] + e["length"]).otherwise(acc["at"]).alias("at"),
                    F.when(error.isNull(), F.concat(acc["entries"], F.array(made))).otherwise(acc["entries"]).alias("entries"),
                    error.alias("error"),
                ),
            )

        return let(let(size, sized), taken)

    turns = F.when(count > 0, F.sequence(F.lit(1).cast("bigint"), count)).otherwise(F.array().cast("array<bigint>"))
    def ended(walked: Column) -> Column:
        error = F.coalesce(walked["error"], F.when(walked["at"] != F.octet_length(envelope) + 1, "trailing_bytes"))
        return F.struct(F.when(error.isNull(), walked["entries"]).alias("entries"), error.alias("error"))

    return let(F.aggregate(turns, begin, step), ended)


def status_name(status: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STATUS]), status)


def path_text(path: Column) -> Column:
    """``/a/b``; ``/`` for the root."""
    return F.concat(F.lit("/"), F.array_join(F.transform(path, lambda p: p.cast("string")), "/"))


def path_starts_with(path: Column, head: Column) -> Column:
    """Whether a node path leads through the node at ``head``, or to it."""
    return (F.size(path) >= F.size(head)) & (F.slice(path, F.lit(1), F.size(head)) == head)


def path_step(path: Column, i: Column | int) -> Column:
    """The child number at step ``i``, from 0; null beyond the end."""
    return F.get(path, F.lit(i) if isinstance(i, int) else i)


def at_path(found: Column, path: Column) -> Column:
    """The first entry at exactly this path, or null."""
    return F.get(F.filter(found, lambda e: e["path"] == path), F.lit(0))
