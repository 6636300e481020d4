"""Best-fit packing into sequences of several permitted lengths.

Pieces (a document, or its parts of the greatest length) go in order of falling length, each into
the open bin that leaves the least room. If it fits none, a bin is opened: of the permitted lengths
that hold the piece, the one of the least reduced cost, which is the cost of a bin of that length less
the room it leaves, as far as smaller pieces are still to come to fill it, at the lowest price per
token of any length. In the end each bin shrinks to the least permitted length that holds it. Beside this
joint packing stand those that open bins of one length only (of the next that holds the piece, for longer
pieces); the cheapest of them is taken, so permitting more lengths never costs more.

Documents are dealt to groups of about ``docs_per_group``, or ``tokens_per_group`` tokens if that gives more
groups, by a hash, and each group is packed
by itself; the bins that a group leaves part empty are few against those it fills. Documents of
one id and length are alike here: they are counted before the shuffle and dealt in lots of ``LOT``, so
no id makes a group large.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut

LENGTHS = (512, 1024, 2048, 4096)
LOT = 100
SCHEMA = "doc_id bigint, part bigint, first_token bigint, n_tokens bigint, bin_id bigint, start bigint, capacity bigint, used bigint"


def sequence_cost(length: int) -> float:
    """Cost of training on a sequence: its tokens, attention that grows with its length, and a fixed share."""
    return length * (1 + length / 65536) + 32


Packed = tuple[list[int], list[int], list[int]]


def cheapest(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost) -> Packed:
    """The packing of least cost: lengths chosen jointly, or one length for all that it holds."""
    lengths = tuple(sorted(lengths))
    tried = [pack(sizes, lengths, cost), *[pack(sizes, lengths, cost, opened=lengths[k:]) for k in range(len(lengths))]]
    return min(tried, key=lambda x: sum(map(cost, x[2])))


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost, opened: tuple[int, ...] = ()) -> Packed:
    """(bin, start) of each piece and the final length of each bin; sizes fall and fit the greatest length.

    With ``opened``, a bin is opened at the least of these lengths that holds the piece.
    """
    lengths = tuple(sorted(lengths))
    price = min(cost(x) / x for x in lengths)
    rooms: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # open bins by the room they have
    mask = 0  # bit r: some bin has room r
    left = sum(sizes)
    used: list[int] = []
    bins, starts = [], []
    for size in sizes:
        left -= size
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            chosen = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room = next(x for x in opened if x >= size) if opened else min((x for x in lengths if x >= size), key=lambda x: (cost(x) - price * min(x - size, left), x))
            chosen = len(used)
            used.append(0)
        bins.append(chosen)
        starts.append(used[chosen])
        used[chosen] += size
        room -= size
        if room:
            rooms[room].append(chosen)
            mask |= 1 << room
    return bins, starts, [next(x for x in lengths if x >= u) for u in used]


def n_tokens(text: Column) -> Column:
    """Words of a text and one end mark: the unit of the lengths here."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1


def pack_documents(documents: DataFrame, *, tokens: Column | None = None, lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost, docs_per_group: int = 20_000, tokens_per_group: int = 20_000_000) -> DataFrame:
    """Return a row per piece: ``doc_id, part, first_token, n_tokens, bin_id, start, capacity, used``.

    ``start`` is the piece's place in its bin, ``used`` what the bin holds, ``capacity`` its final
    length; ``tokens`` gives the length of a document (words and an end mark if none is given), from its row alone.

    Defined cases: a null or empty text has its end mark alone; a longer document than the greatest
    length is cut into parts of it and a rest; rows that share a ``doc_id`` (null included) are packed
    each; a length of 0 or null gives no piece; ties in length go by ``doc_id`` and part; an empty
    table gives no rows; other columns are ignored.
    """
    top = max(lengths)
    size = n_tokens(F.col("text")) if tokens is None else tokens
    counted = cut(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), size.cast("bigint").alias("n")).filter("n > 0").groupBy("doc_id", "n").agg(F.count("*").alias("times")))
    total = counted.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0)).alias("tokens")).first()
    groups = max(1, -(-total["docs"] // docs_per_group), -(-total["tokens"] // tokens_per_group))
    lots = counted.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("times") - 1) / LOT))))
    rows = lots.withColumn("times", F.least(F.lit(LOT), F.col("times") - F.col("lot") * LOT)).withColumn("group", F.pmod(F.xxhash64("doc_id", "n", "lot"), F.lit(groups)))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "n", "lot"], kind="stable")
        frame = frame.loc[frame.index.repeat(frame["times"])]
        n = frame["n"].to_numpy(np.int64)
        parts = -(-n // top)
        doc = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        pieces = np.minimum(top, n[doc] - part * top)
        order = np.argsort(-pieces, kind="stable")
        bins, starts, final = cheapest(pieces[order].tolist(), lengths, cost)
        bins, final = np.array(bins, np.int64), np.array(final, np.int64)
        held = np.bincount(bins, pieces[order], len(final)).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
        base = (int(frame["group"].iloc[0]) if len(frame) else 0) << 32
        return pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[doc[order]], "part": part[order], "first_token": part[order] * top, "n_tokens": pieces[order], "bin_id": base + bins, "start": starts, "capacity": final[bins], "used": held[bins]})

    return rows.repartition(groups, "group").groupBy("group").applyInPandas(place, SCHEMA)
