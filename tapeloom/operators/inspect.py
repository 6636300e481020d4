"""What recordings hold: a row of counts each, and a report in lines.

Counts are plain aggregates over envelopes and entries, so a recording's records never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import envelope, payload
from tapeloom.operators.values import escaped
from tapeloom.sources import recording

COUNTS = ("envelopes", "inbound", "outbound", *envelope.STATUS, "undecodable")


def counts(rows: DataFrame) -> DataFrame:
    """``path`` and ``COUNTS`` from ``path, envelope``: directions and the states of the entries.

    An envelope that can't be decoded in full counts as ``undecodable`` and in no direction; its entries
    don't count. Repeated envelopes count each; an empty table gives no rows.
    """
    head, body = envelope.header(F.col("envelope")), envelope.entries(F.col("envelope"))
    read = rows.select("path", head.alias("h"), body.alias("b")).withColumn("bad", F.coalesce("h.error", "b.error").isNotNull())
    states = [F.sum(F.when(F.col("bad"), 0).otherwise(F.size(F.filter("b.entries", lambda e: e["status"] == k)))).cast("bigint").alias(name) for k, name in enumerate(envelope.STATUS)]
    way = [F.count_if(~F.col("bad") & (F.col("h.outbound") == out)).alias(name) for name, out in (("inbound", False), ("outbound", True))]
    return read.groupBy("path").agg(F.count("*").alias("envelopes"), *way, *states, F.count_if("bad").alias("undecodable"))


def content(rows: DataFrame) -> DataFrame:
    """``path, content``: kinds of the payloads that were read, as (kind, n) by name; unreadable ones under that name."""
    body = envelope.entries(F.col("envelope"))
    sound = envelope.header(F.col("envelope"))["error"].isNull()
    read = rows.select("path", F.explode(F.when(sound, body["entries"])).alias("e")).filter("e.status = 0")
    found = read.select("path", payload.content(F.col("e.payload")).alias("c"))
    kind = F.when(F.col("c.error").isNotNull(), "unreadable").otherwise(F.col("c.kind")).alias("kind")
    by_kind = found.select("path", kind).groupBy("path", "kind").agg(F.count("*").alias("n"))
    # As many entries as there are kinds of messages.
    return by_kind.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("kind", "n"))).alias("content"))


def inspect(recordings: DataFrame) -> DataFrame:
    """The rows of ``sources.recording`` without their records, with ``COUNTS`` and ``content``.

    A recording without envelopes has counts of 0 and no content; an unreadable one has them too, and its ``error``.
    """
    rows = recording.envelopes(recordings)
    told = recording.states(recordings).join(counts(rows), "path", "left").na.fill(0, list(COUNTS))
    none = F.array().cast("array<struct<kind: string, n: bigint>>")
    return told.join(content(rows), "path", "left").withColumn("content", F.coalesce("content", none))


def _line(name: str, text: Column) -> Column:
    return F.concat(F.rpad(F.lit(f"  {name}"), 16, " "), text)


def report(inspected: DataFrame) -> DataFrame:
    """``path, line, text``: each recording of ``inspect`` described in lines, from 0.

    Text that comes from a file is escaped, so that it can't pass for a line of the report.
    """
    n = {c: F.col(c).cast("string") for c in (*COUNTS, "found", "claimed", "dangling", "skipped", "unknown_critical")}
    total = sum((F.col(s) for s in envelope.STATUS[1:]), F.col(envelope.STATUS[0]))
    state = (
        F.when(F.col("integrity") == "complete", "complete: count and checksum both hold")
        .when(F.col("integrity") == "damaged", F.concat(F.lit("DAMAGED: trailer claims "), n["claimed"], F.lit(", found "), n["found"]))
        .when(F.col("integrity") == "trailing_bytes", F.concat(F.lit("TRAILING BYTES: "), n["found"], F.lit(" records, then "), n["dangling"], F.lit(" bytes that are not read")))
        .otherwise(F.concat(F.lit("TRUNCATED: no trailer; "), n["found"], F.lit(" records read, "), n["dangling"], F.lit(" bytes left")))
    )
    note = recording.meta_value(F.col("meta"), "note")
    states = F.concat_ws(", ", *[F.concat(n[s], F.lit(" " + s.replace("_", "-"))) for s in envelope.STATUS])
    lines = F.array(
        F.when(note.isNotNull(), _line("note", escaped(recording.digest_text(note)))),
        _line("integrity", state),
        _line("envelopes", F.concat(n["envelopes"], F.lit(": "), n["inbound"], F.lit(" inbound, "), n["outbound"], F.lit(" outbound"))),
        F.when(total > 0, _line("plaintexts", F.concat(total.cast("string"), F.lit(": "), states))),
        F.when(F.col("undecodable") > 0, _line("unreadable", F.concat(n["undecodable"], F.lit(" envelopes did not decode")))),
        F.when(F.col("skipped") > 0, _line("skipped", F.concat(n["skipped"], F.lit(" records of unknown kinds")))),
        F.when(F.col("unknown_critical") > 0, _line("unknown meta", F.concat(n["unknown_critical"], F.lit(" critical tags that can't be read")))),
        F.when(F.size("content") > 0, _line("content", F.array_join(F.transform("content", lambda c: F.concat(c["kind"], F.lit(" "), c["n"].cast("string"))), ", "))),
    )
    unreadable = F.array(F.concat(F.lit("not a recording: "), F.col("error")))
    told = F.when(F.col("error").isNotNull(), unreadable).otherwise(F.array_compact(lines))
    return inspected.select("path", F.posexplode(told).alias("line", "text"))
