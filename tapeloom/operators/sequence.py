"""Operators on the order of stanzas: deduplication, joining frames with payloads, fencing."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW, LOOKAHEAD = 64, 64
MAX_TAG, MAX_ID = 24, 64
#: Ordinals of a key that one task takes at a time.
STRETCH = 1 << 16


def running(rows: DataFrame, keys: list[str], order: str, name: str, of: Column, kind: str = "sum", *, current: bool = True, backward: bool = False, stretch: int = STRETCH) -> DataFrame:
    """``name``: the sum or maximum of ``of`` over a key's rows before this one, and this one if ``current``.

    A key may hold any share of all rows, so its rows are dealt by stretches of ``order`` (whole numbers)
    as well: each stretch has its own running value, and gets what the stretches before it come to, from a row
    per stretch. ``backward``: over the rows after this one. Nothing before a row: 0 for sums, null for maxima.
    Rows that share an ordinal come one after the other in no fixed order.
    """
    total = {"sum": F.sum, "max": F.max}[kind]
    rows = rows.withColumns({"_stretch": F.floor(F.col(order) / stretch), "_of": of})
    by = [*keys, "_stretch"]

    def way(c: str) -> Column:
        return F.col(c).desc() if backward else F.col(c).asc()

    def earlier(window: WindowSpec, last: int) -> Column:
        return total("_of").over(window.rowsBetween(W.unboundedPreceding, last))

    inside = rows.withColumn("_inside", earlier(W.partitionBy(*by).orderBy(way(order)), 0 if current else -1))
    sums = rows.groupBy(*by).agg(total("_of").alias("_of"))
    # A null-safe join, since a key may be null.
    sums = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], earlier(W.partitionBy(*keys).orderBy(way("_stretch")), -1).alias("_before"))
    met = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    both = inside.join(sums, reduce(and_, met), "left")
    value = F.greatest("_before", "_inside") if kind == "max" else F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    return both.withColumn(name, value).drop("_stretch", "_of", "_inside", "_before", *[f"_k{i}" for i in range(len(by))])


def first_seen(stanzas: DataFrame) -> DataFrame:
    """``admission`` (new, duplicate, untracked) per row, over an unbounded window per session.

    ``stanzas`` has ``session, ord, tag, id``. A row without id, or whose tag or id is too long to
    track, is untracked.
    """
    tracked = F.col("id").isNotNull() & (F.octet_length(F.encode("id", "UTF-8")) <= MAX_ID) & (F.octet_length(F.encode("tag", "UTF-8")) <= MAX_TAG)
    rank = F.row_number().over(W.partitionBy("session", "tag", "id").orderBy("ord"))
    return stanzas.withColumn("admission", F.when(~F.coalesce(tracked, F.lit(False)), "untracked").when(rank == 1, "new").otherwise("duplicate"))


def admit(ring: OrderedDict, key: tuple[str, str] | None, window: int) -> str:
    """One step of the bounded window: a duplicate is not put in again, and only admissions push out."""
    if key is None or len(key[0].encode()) > MAX_TAG or len(key[1].encode()) > MAX_ID:
        return "untracked"
    if key in ring:
        return "duplicate"
    if window:
        ring[key] = None
        if len(ring) > window:
            ring.popitem(last=False)
    return "new"


def bounded_dedup(stanzas: DataFrame, window: int = WINDOW) -> DataFrame:
    """``admission`` over the last ``window`` admitted keys of each session.

    Rows are dealt by session and sorted by ``ord``; a task walks its rows batch by batch and holds
    one session's ring, whatever the session's length.
    """
    schema = f"session {stanzas.schema['session'].dataType.simpleString()}, ord bigint, tag string, id string, admission string"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, ring = object(), OrderedDict()
        for frame in batches:
            out = []
            for s, tag, key in zip(frame["session"], frame["tag"], frame["id"], strict=True):
                if s != session:
                    session, ring = s, OrderedDict()
                out.append(admit(ring, None if key is None or tag is None else (tag, key), window))
            yield frame.assign(admission=out)

    rows = stanzas.select("session", F.col("ord").cast("bigint").alias("ord"), "tag", "id")
    return rows.repartition("session").sortWithinPartitions("session", "ord").mapInPandas(walk, schema)


def join_payloads(held: DataFrame, payloads: DataFrame, lookahead: int = LOOKAHEAD) -> DataFrame:
    """Frames with the payloads that come after them: a left interval join bounded by stanzas.

    ``held`` has ``session, ord, id, slot``: a row per payload that a stanza waits for; ``ord`` counts
    the session's stanzas. ``payloads`` has ``session, at, id, slot, payload``; ``at`` is the ordinal
    of the last stanza before the payload. A payload belongs to the last stanza of its id at or
    before it, no more than ``lookahead`` stanzas back; of several the first counts. Returns ``held``
    with ``payload, done_at`` and ``status``, ok or unobserved.
    """
    stanzas = held.select("session", "id", "ord").distinct()
    until = F.lead("ord").over(W.partitionBy("session", "id").orderBy("ord"))
    reach = stanzas.withColumn("until", F.coalesce(until - 1, F.col("ord") + lookahead)).withColumn("until", F.least("until", F.col("ord") + lookahead))
    # Each stanza covers at most lookahead + 1 ordinals: as buckets of that width, two at most.
    width = lookahead + 1
    spread = reach.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor(F.col("ord") / width), F.floor(F.col("until") / width)))))
    come = payloads.withColumn("bucket", F.floor(F.col("at") / width))
    met = come.join(spread, ["session", "id", "bucket"]).filter("at between ord and until")
    first = met.groupBy("session", "id", "ord", "slot").agg(F.min(F.struct("at", "payload")).alias("first"))
    joined = held.join(first, ["session", "id", "ord", "slot"], "left")
    return joined.select(*[F.col(c) for c in held.columns], F.col("first.payload").alias("payload"), F.col("first.at").alias("done_at"), F.when(F.col("first").isNull(), "unobserved").otherwise("ok").alias("status"))


def emission_order(stanzas: DataFrame, lookahead: int = LOOKAHEAD) -> DataFrame:
    """``emitted_at`` per stanza: only the finished head of the queue leaves, so a running maximum.

    ``stanzas`` has ``session, ord, done_at``: null means given up after ``lookahead`` more stanzas.
    """
    return running(stanzas, ["session"], "ord", "emitted_at", F.coalesce("done_at", F.col("ord") + lookahead + 1), "max")


def fence(rows: DataFrame, key: str, order: str, token: str) -> DataFrame:
    """``admitted``: a token at least as new as all before it in its key; refused ones never raise the bar."""
    seen = running(rows, [key], order, "_bar", F.col(token), "max", current=False)
    return seen.withColumn("admitted", F.col(token) >= F.coalesce("_bar", token)).drop("_bar")


def stanzas_since(stanzas: DataFrame) -> DataFrame:
    """``age``: how many later stanzas of the session there are."""
    return running(stanzas, ["session"], "ord", "age", F.lit(1), current=False, backward=True)
