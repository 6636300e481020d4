"""Document fingerprints: one-permutation MinHash, kept as packed low-order bits.

The five-word shingles of a text (lower-cased words; fewer words make one shingle) are hashed
once. The top eight bits of a hash name one of 256 bins, and each bin keeps its least hash.
Empty bins are filled by optimal densification: each has its own sequence of hashed bins, the
same for every document, and takes the value of the first of them that is not empty; after
``PROBES`` tries the sequence goes on as a random order of all bins. Of each bin the low four
bits stay: 1024 bits a document, written as 256 hex digits.

Two different values agree in four bits by chance once in 16 times, so the likeness of two
fingerprints is (share of equal bins - 1/16) / (15/16), held between 0 and 1.

All of it is built from DataFrame functions. To find the least hash of each bin, one sentinel
per bin (the largest value there) joins the hashes; in sorted order the first value of each bin
is then its minimum or, in an empty bin, the sentinel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, shuffle_width

WORDS = 5
BINS, BIN_BITS, LOW_BITS, PROBES = 256, 8, 4, 8
_REST = (1 << (64 - BIN_BITS)) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS)


def _empty(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_REST)) == _REST


def shingle_hashes(text: Column) -> Column:
    """Hashes of all five-word shingles, repeats included; an empty array without words."""
    words = F.filter(F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        runs = F.transform(F.slice(h, F.lit(1), F.size(h) - (WORDS - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WORDS)]))
        return F.when(F.size(h) >= WORDS, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def _minima(hashes: Column) -> Column:
    """The 256 bins in order: least hash, or the bin's sentinel."""
    half = BINS // 2
    sentinels = F.array(*[F.lit((j << (64 - BIN_BITS)) | _REST) for j in range(-half, half)])
    return _let(F.sort_array(F.concat(hashes, sentinels)), lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))


def _densified(bins: Column) -> Column:
    def fill(pair: Column) -> Column:
        bins, full = pair["bins"], pair["full"]

        def value(x: Column, j: Column) -> Column:
            probes = F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda t: F.get(bins, F.pmod(F.xxhash64(j, t), F.lit(BINS)).cast("int")))
            tried = F.get(F.filter(probes, lambda v: ~_empty(v)), F.lit(0))
            later = F.array_min(F.transform(full, lambda o: F.struct(F.xxhash64(o["i"], j).alias("rank"), o["x"].alias("x"))))["x"]
            return F.when(~_empty(x), x).otherwise(F.coalesce(tried, later))

        return F.transform(bins, value)

    full = lambda b: F.filter(F.transform(b, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda o: ~_empty(o["x"]))
    return _let(bins, lambda b: _let(F.struct(b.alias("bins"), full(b).alias("full")), fill))


def fingerprint(text: Column) -> Column:
    """Sixteen 64-bit numbers of packed bins; null for a text without words."""
    per_long = 64 // LOW_BITS

    def pack(bins: Column) -> Column:
        low = lambda x: x.bitwiseAND(F.lit((1 << LOW_BITS) - 1))
        part = lambda q: F.slice(bins, q * per_long + 1, F.lit(per_long))
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // per_long - 1)), lambda q: F.aggregate(part(q), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(low(x))))

    return _let(shingle_hashes(text), lambda h: F.when(F.size(h) > 0, _let(_densified(_minima(h)), pack)))


def as_text(packed: Column) -> Column:
    """A fingerprint as hex digits; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints; 1 between two texts without words, 0 if one has none."""

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        spread = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return F.bit_count(spread.bitwiseAND(F.lit(0x1111111111111111)))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, x: acc + x)
    chance = 1 / (1 << LOW_BITS)
    estimate = ((BINS - unequal) / BINS - chance) / (1 - chance)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, n_chars, packed`` for each row; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.length(text).cast("bigint").alias("n_chars"), fingerprint(text).alias("packed"))


def following(ids: DataFrame) -> DataFrame:
    """``doc_id, next_id``: for each distinct id the next lower one; after the lowest comes the highest.

    Ids are dealt out in ranges; inside a range a window finds the neighbour, and the ends of the
    ranges, one row for each partition, are linked by a second window.
    """
    width = max(2, shuffle_width(ids.sparkSession))
    ranged = cut(ids.select("doc_id").filter("doc_id is not null").distinct().repartitionByRange(width, "doc_id").withColumn("range", F.spark_partition_id()))
    within = W.partitionBy("range").orderBy("doc_id")
    ends = ranged.groupBy("range").agg(F.max("doc_id").alias("top"))
    across = W.orderBy("range")
    last = F.max("top").over(W.partitionBy(F.lit(1)))
    before = ends.select("range", F.coalesce(F.lag("top").over(across), last).alias("below"))
    return ranged.withColumn("lower", F.lag("doc_id").over(within)).join(before, "range").select("doc_id", F.coalesce("lower", "below").alias("next_id"))


def edited_likeness(documents: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is the head of the next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    The next document has the next lower ``doc_id``; the lowest is followed by the highest.

    Defined cases: a null text is empty; rows of a null ``doc_id`` are left out; where rows share
    a ``doc_id``, each comes back, and the next document of the rows above is the one of the least
    text; a single document is followed by itself; an empty table gives no rows; other columns
    are ignored.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    known = cut(fingerprints(docs))
    counts = known.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    heads, own = docs, known
    asked = known.select("doc_id", F.floor(F.col("n_chars") / 3).cast("int").alias("k"))
    if counts["n"] > counts["ids"]:  # some rows share an id
        heads = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
        own = fingerprints(heads)
        asked = asked.groupBy("doc_id").agg(F.max("k").alias("k"))
    chain = following(known.select("doc_id"))
    next_known = own.select(F.col("doc_id").alias("next_id"), F.col("packed").alias("next_packed"))
    wanted = cut(chain.join(asked, "doc_id").join(next_known, "next_id").select("doc_id", "next_id", "k", "next_packed"))
    # Both joins name the same columns of the texts, so one shuffle of them serves both.
    sent = heads.alias("h").join(wanted.alias("w"), F.col("h.doc_id") == F.col("w.next_id")).select("w.doc_id", "w.next_packed", F.substring("h.text", F.lit(1), F.col("w.k")).alias("head"))
    k = F.floor(F.length("d.text") / 3).cast("int")
    whole = F.concat(F.substring("d.text", F.lit(1), F.length("d.text") - k), F.substring("s.head", F.lit(1), k))
    edited = docs.alias("d").join(sent.alias("s"), F.col("d.doc_id") == F.col("s.doc_id")).select("d.doc_id", "d.text", "s.next_packed", whole.alias("edited"))
    done = edited.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("_text"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_packed"), "next_packed")
    if counts["n"] > counts["ids"]:
        done = done.join(docs.select(F.sha2("text", 256).alias("_text"), fingerprint(F.col("text")).alias("packed")).dropDuplicates(["_text"]), "_text")
    else:
        done = done.join(known.select("doc_id", "packed"), "doc_id")
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("packed")).alias("fingerprint"),
        as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
