"""N-gram Jaccard join: documents whose sets of five-word shingles are alike.

A document's set holds its distinct five-word shingles (lower-cased words); with fewer words
the whole sequence is one shingle; without words it is empty and links with nothing. Two
documents link when 100 * intersection >= 75 * union. Equal sets are one *class*, named by a
64-bit hash of the set, so copies are never compared with each other.

1. One pass over the texts hashes shingles and deals them, packed in arrays, to buckets by
   hash. A class is sent once by each map task, however many copies the task has. The number of
   buckets follows from the bytes of the texts (``buckets_of``), so a bucket stays below some hundred
   MB at any size; each is one task, which takes it range by range of the hashes.
2. Each bucket counts the classes of each shingle and keeps shingles of two classes or more:
   a shingle of one class can be in no intersection, so what stays suffices for all counts.
3. Per class, kept shingles are put in order rare-first: (number of classes, hash), after its
   lone shingles. Two linked sets must share a shingle among the first n - ceil(.75 n) + 1 of
   each (prefix filter). A class whose prefix has lone shingles only is done: no links.
4. Prefix shingles meet in a join that never pairs up a whole group: first each class of a
   shingle is paired with one hub of it, the class whose shingles are the most widely shared
   (in a group of near copies, the one nearest to the original). Verified links give
   components. Then only pairs across components remain: of each shingle's classes, those
   outside its most common component meet the others of another component.
   The two sides also meet by size (linked sets differ by a third at most), which splits what
   a common shingle brings together.
5. Pairs pass the length filter, the positional filter (at the first shingle that a linked pair
   shares, what follows in both must suffice) and the suffix filter, then are verified once, by
   the exact size of the intersection. The suffix filter splits both sets, in the order of the
   hashes, at probe places, three times over into ``PARTS`` parts: a shingle of one part can only be
   shared with the same part of the other set, so the intersection is no larger than the sum of
   the smaller parts. A sketch stands beside it: each class has 64 * ``PARITIES`` bits, bit *k*
   telling whether an odd number of its kept shingles fall on *k*; each bit in which two classes
   differ needs a shingle that they don't share.

Components come from rounds of large-star and small-star steps on the links.

What rests on hashes: among N different sets, two share a name with a chance of N * N / 2**65 (3 in 10,000
for a hundred million sets). Shingles are told apart by 51 to 64 bits (48 and those of the bucket), so two
sets of 500 shingles count one in common that isn't with a chance below 2e-10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut
from tapeloom.llm.words import OTHER, STEP, Words, batches_of, mix

WORDS = 5
#: Similarity of at least 75 / 100.
PERCENT = 75
#: 64-bit words of parities per class; parts of the suffix filter, four to a word.
PARITIES, PARTS = 6, 8
SKETCH = tuple([f"p{k}" for k in range(PARITIES)] + [f"s{k}" for k in range(PARTS // 4)])
#: Bytes of text per bucket: the most, and what makes it worth while to have more of the first ``FEW``.
BUCKET_BYTES, LEAST_BYTES, FEW = 1 << 28, 1 << 18, 128
#: Shingles of a bucket that are counted at a time.
RANGE = 1 << 21
#: Shingles that a map task holds before it sends them.
HELD = 1 << 22


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): each text's distinct shingle hashes in ascending order, one text after the other."""
    words = Words(texts)
    hashes = words.hashes()
    counts = np.diff(words.first)
    shingles, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(hashes) >= WORDS:
        n = len(hashes) - WORDS + 1
        whole = words.text[:n] == words.text[WORDS - 1 :]
        h = np.full(n, np.uint64(WORDS))
        for k in range(WORDS):
            h = (h ^ hashes[k : n + k]) * STEP
            h ^= h >> np.uint64(31)
        shingles.append(np.compress(whole, mix(h)))
        owner.append(np.compress(whole, words.text[:n]))
    for c in range(1, WORDS):  # the texts of fewer words
        i = np.flatnonzero(counts == c)
        h = np.full(len(i), np.uint64(c))
        for k in range(c):
            h = (h ^ hashes[words.first[i] + k]) * OTHER
            h ^= h >> np.uint64(29)
        shingles.append(mix(h))
        owner.append(i)
    h, text = np.concatenate(shingles), np.concatenate(owner)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.bincount(text[new], minlength=len(texts))


def set_names(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for empty sets."""
    ends = np.cumsum(sizes)
    totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ OTHER))])
    crossed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + STEP) * OTHER)])
    a, b = totals[ends] - totals[ends - sizes], crossed[ends] - crossed[ends - sizes]
    names = mix(mix(a + sizes.astype(np.uint64)) ^ b)
    return np.where(sizes > 0, np.maximum(names, np.uint64(1)), np.uint64(0))


def prefix_length(n):
    """First shingles of a set of size n that must hold one of each linked set's first ones."""
    return n - (PERCENT * n + 99) // 100 + 1


def buckets_of(size: int) -> int:
    """The number of buckets, a power of two, for so many bytes of text."""
    wanted = max(size // BUCKET_BYTES, min(size // LEAST_BYTES, FEW), 8)
    return 1 << int(wanted - 1).bit_length()


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte: first all lowest bytes, so that compression sees the empty ones."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _packed(names: np.ndarray, numbers: np.ndarray) -> bytes:
    return names.astype("<u8").tobytes() + _planes(numbers)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    low = np.frombuffer(data, np.uint8, 4 * n, 8 * n).reshape(4, n)
    return np.frombuffer(data, "<u8", n), np.ascontiguousarray(low.T).view("<u4").reshape(-1)


def _by_bucket(batches: Iterator[pd.DataFrame], column: str) -> Iterator[tuple[int, pd.DataFrame]]:
    """(bucket, its rows) of a task's rows; a task has one bucket, unless partitions were joined."""
    held: dict[int, list[pd.DataFrame]] = {}
    for frame in batches:
        for bucket, part in frame.groupby(column):
            held.setdefault(int(bucket), []).append(part)
    for bucket in sorted(held):
        yield bucket, pd.concat(held.pop(bucket))


def _dealt(documents: DataFrame, buckets: int) -> DataFrame:
    """Packed rows (bucket, docs, sizes, classes, grams): a pass over the texts.

    ``docs`` has (doc_id, size, class) of documents, in rows of any bucket; ``sizes`` has (class, size) in
    rows of the class's home; ``classes`` has (class, shingles in this bucket) and ``grams`` their
    hashes, without two bytes, of which the bucket tells some bits.
    """
    bits = buckets.bit_length() - 1

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = (TaskContext.get().partitionId() if TaskContext.get() else 0) * 7919
        sent: set[int] = set()  # classes this task has sent
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # names, sizes, hashes
        waiting = 0

        def flush() -> Iterator[pd.DataFrame]:
            names, sizes, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            owner = np.repeat(np.arange(len(names)), sizes)
            bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            rows = []
            for b, (start, end) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)):
                if start < end:
                    part = order[start:end]
                    who, count = np.unique(owner[part], return_counts=True)
                    # Six of eight bytes; the bucket tells some of the others.
                    rows.append((b, b"", b"", _packed(names[who], count), np.ascontiguousarray(hashes[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()))
            home = (names % np.uint64(buckets)).astype(np.int64)
            rows += [(b, b"", _packed(names[home == b], sizes[home == b]), b"", b"") for b in np.unique(home).tolist()]
            yield pd.DataFrame(rows, columns=["bucket", "docs", "sizes", "classes", "grams"])

        for frame in batches:
            texts, ids = frame["text"].tolist(), frame["doc_id"].to_numpy(np.int64)
            for a, b in batches_of(texts):
                hashes, sizes = shingle_sets(texts[a:b])
                names = set_names(hashes, sizes)
                turn += 1
                docs = np.rec.fromarrays([ids[a:b], sizes, names], dtype="<i8,<i8,<u8")
                yield pd.DataFrame({"bucket": [turn % buckets], "docs": [docs.tobytes()], "sizes": [b""], "classes": [b""], "grams": [b""]})
                fresh = np.array([x not in sent and not sent.add(x) for x in names.tolist()], bool) & (sizes > 0)
                held.append((names[fresh], sizes[fresh], hashes[np.repeat(fresh, sizes)]))
                waiting += int(sizes[fresh].sum())
                if waiting >= HELD:
                    yield from flush()
                    held, waiting = [], 0
        if waiting:
            yield from flush()

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    return rows.mapInPandas(deal, "bucket int, docs binary, sizes binary, classes binary, grams binary")


def _shared(dealt: DataFrame, buckets: int) -> DataFrame:
    """Packed rows (home, docs, sizes, shared): ``shared`` has (class, gram, classes of the gram), for grams of two or more."""
    bits = np.uint64(64 - (buckets.bit_length() - 1))

    def shared_of(gram: np.ndarray, name: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((name, gram))
        gram, name = gram[order], name[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])
        gram, name = gram[new], name[new]
        first = np.ones(len(gram), bool)
        first[1:] = gram[1:] != gram[:-1]
        at = np.flatnonzero(first)
        df = np.diff(at, append=len(gram))
        df = np.repeat(df, df)
        many = df >= 2
        return [name[many], gram[many], df[many]]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for bucket, frame in _by_bucket(batches, "bucket"):
            rows = [(bucket, docs, sizes, b"") for docs, sizes in zip(frame["docs"], frame["sizes"], strict=True) if docs or sizes]
            classes = [_unpacked(x) for x in frame["classes"] if x]
            if classes:
                name, counts = (np.concatenate(x) for x in zip(*classes, strict=True))
                letters = np.frombuffer(b"".join(frame["grams"]), np.uint8).reshape(-1, 6)
                del frame, classes
                owner = np.repeat(np.arange(len(name)), counts)
                # The bytes that are left out, lowest bits of the bucket among them, stand above 48 bits.
                top = np.uint64(bucket) << bits & np.uint64(0xFFFF << 48)
                parts = -(-len(letters) // RANGE)
                # The two highest bytes that were sent are spread evenly enough to split by.
                part = (letters[:, 4].astype(np.int32) | (letters[:, 5].astype(np.int32) << 8 & 0xFF00)) * parts >> 16 if parts > 1 else None
                found = []
                for k in range(parts):
                    chosen = slice(None) if part is None else np.flatnonzero(part == k)
                    wide = np.zeros((len(letters) if part is None else len(chosen), 8), np.uint8)
                    wide[:, :6] = letters[chosen]
                    found.append(shared_of(wide.reshape(-1).view("<u8") | top, name[owner[chosen]]))
                name, gram, df = (np.concatenate(x) for x in zip(*found, strict=True))
                home = (name % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                ends = np.cumsum(np.bincount(home, minlength=buckets))
                for b, (start, end) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)):
                    if start < end:
                        at = order[start:end]
                        rows.append((b, b"", b"", np.rec.fromarrays([name[at], gram[at], df[at]], dtype="<u8,<u8,<u4").tobytes()))
            yield pd.DataFrame(rows, columns=["home", "docs", "sizes", "shared"])

    return dealt.repartitionById(buckets, F.col("bucket")).mapInPandas(count, "home int, docs binary, sizes binary, shared binary")


def _classes(shared: DataFrame, buckets: int) -> DataFrame:
    """Rows (class, n, lone, central, sketch, grams) of classes that may have links; grams are in prefix order."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, frame in _by_bucket(batches, "home"):
            found = np.concatenate([np.frombuffer(x, "<u8,<u8,<u4") for x in frame["shared"]])
            if not len(found):
                continue
            found = found[np.lexsort((found["f1"], found["f2"], found["f0"]))]
            name, df = found["f0"], found["f2"].astype(np.float64)
            at = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            counts = np.diff(at, append=len(name))
            known, size = (np.concatenate(x) for x in zip(*map(_unpacked, frame["sizes"]), strict=True))
            known, first = np.unique(known, return_index=True)
            n = size[first][np.searchsorted(known, name[at])].astype(np.int64)
            lone = n - counts
            central = np.add.reduceat(np.log2(df), at) / n
            keep = np.flatnonzero(lone < prefix_length(n))
            grams = np.ascontiguousarray(found["f1"])
            row = np.repeat(np.arange(len(at)), counts)
            width = 64 * PARITIES
            odd = np.bincount(row * width + (grams % np.uint64(width)).astype(np.int64), minlength=len(at) * width) & 1
            part = np.bincount(row * PARTS + (grams >> np.uint64(64 - (PARTS - 1).bit_length())).astype(np.int64), minlength=len(at) * PARTS)
            sketch = [np.packbits(odd.astype(bool)).view(np.int64).reshape(-1, PARITIES), np.minimum(part, 0xFFFF).astype("<u2").view(np.int64).reshape(-1, PARTS // 4)]
            columns = dict(zip(SKETCH, np.concatenate(sketch, axis=1)[keep].T, strict=True))
            grams = grams.view(np.int64)
            own = pd.Series([grams[at[i] : at[i] + counts[i]] for i in keep], dtype=object)
            yield pd.DataFrame({"class": np.ascontiguousarray(name[at][keep]).view(np.int64), "n": n[keep], "lone": lone[keep], "central": central[keep], **columns, "grams": own})

    rows = shared.filter("octet_length(shared) + octet_length(sizes) > 0").select("home", "sizes", "shared").repartitionById(buckets, F.col("home"))
    return rows.mapInPandas(gather, f"class bigint, n bigint, lone bigint, central double, {', '.join(f'{c} bigint' for c in SKETCH)}, grams array<bigint>")


def _verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are alike enough, from the exact size of the intersection."""
    sets = classes.select("class", "n", "grams")
    right = sets.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("g_b"))
    left = sets.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("g_a"))
    common = F.size(F.array_intersect("g_a", "g_b")).cast("bigint")
    both = pairs.join(right, "b").join(left, "a").withColumn("common", common)
    return both.filter(100 * F.col("common") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label): the smallest node that each linked node reaches.

    Large-star, then small-star, until a round changes nothing; the links of a node with many
    neighbours are only ever summed up by a minimum, and each round is cut from the last.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    mark = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.filter("u > v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots.select("node", F.col("node").alias("label")))


def _may_link(a: str, b: str) -> str:
    """The filters, for two classes at a common shingle; ``a`` and ``b`` are prefixes of column names."""
    n, m = f"{a}n", f"{b}n"
    needed = f"ceil(({PERCENT} * ({n} + {m})) / {100 + PERCENT})"
    differ = " + ".join(f"bit_count({a}p{k} ^ {b}p{k})" for k in range(PARITIES))
    part = lambda x, k: f"(shiftrightunsigned({x}s{k // 4}, {k % 4 * 16}) & 65535)"
    common = " + ".join(f"least({part(a, k)}, {part(b, k)})" for k in range(PARTS))
    return (
        f"least({n}, {m}) * 100 >= {PERCENT} * greatest({n}, {m})"
        f" and least({n} - {a}lone - {a}pos, {m} - {b}lone - {b}pos) >= {needed}"
        f" and {n} - {a}lone + {m} - {b}lone - ({differ}) >= 2 * {needed}"
        f" and (greatest({n}, {m}) > 65535 or {common} >= {needed})"  # larger parts may not be told in full
    )


def _links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes, by the two steps described above: enough of them for the components."""
    seen = ["class", "n", "lone", "pos", *SKETCH]
    prefix = f"cast(n - ceil({PERCENT} * n / 100) + 1 - lone as int)"
    postings = classes.select("central", *[c for c in seen if c != "pos"], F.posexplode(F.expr(f"slice(grams, 1, least(size(grams), {prefix}))")).alias("pos", "gram"))
    hubs = postings.groupBy("gram").agg(F.max(F.struct("central", *seen)).alias("hub"), F.count("*").alias("m")).filter("m > 1").select("gram", "hub.*")
    hubs = hubs.select("gram", *[F.col(c).alias(f"h_{c}") for c in seen])
    pairs = postings.join(hubs, "gram").filter("class <> h_class").filter(_may_link("", "h_"))
    tested = cut(pairs.select(F.least("class", "h_class").alias("a"), F.greatest("class", "h_class").alias("b")).distinct())
    first = cut(_verified(tested, classes))

    labels = components(first).withColumnRenamed("node", "class")
    labelled = postings.drop("central").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    by_label = labelled.groupBy("gram", "label").count().groupBy("gram").agg(F.max(F.struct("count", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    mixed = labelled.join(by_label.select("gram", F.col("top.label").alias("top")), "gram")
    # Sizes of linked sets differ by 4/3 at most, so their bands, on a base a little above, by one.
    band = F.floor(F.log(1.34, F.col("n"))).cast("int")
    odd = mixed.filter("label <> top").select("gram", F.explode(F.array(band - 1, band, band + 1)).alias("band"), *[F.col(c).alias(f"o_{c}") for c in (*seen, "label")])
    # A pair of odd classes comes up from both sides; it is kept where the first is the smaller.
    across = odd.join(mixed.withColumn("band", band), ["gram", "band"]).filter("label <> o_label and (label = top or class > o_class)").filter(_may_link("", "o_"))
    met = across.select(F.least("class", "o_class").alias("a"), F.greatest("class", "o_class").alias("b")).distinct()
    second = cut(_verified(met.join(tested, ["a", "b"], "left_anti"), classes))
    return first.union(second)


def join(documents: DataFrame) -> DataFrame:
    """Return ``doc_id, n_shingles, component_id`` for each row of ``documents``.

    Defined cases: rows of a null or empty text (or without words) have 0 shingles and their own id;
    rows of a null ``doc_id`` are left out; rows that repeat a ``doc_id`` come back once each, and
    differing texts of one id are joined like texts of two; equal texts always link; an empty table
    gives no rows; other columns are ignored.
    """
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = buckets_of(size)
    packed = cut(_shared(_dealt(documents, buckets), buckets))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for docs in frame["docs"]:
                found = np.frombuffer(docs, "<i8,<i8,<u8")
                yield pd.DataFrame({"doc_id": found["f0"], "n_shingles": found["f1"], "class": np.ascontiguousarray(found["f2"]).view(np.int64)})

    docs = packed.filter("octet_length(docs) > 0").select("docs").mapInPandas(unpack, "doc_id bigint, n_shingles bigint, class bigint")
    classes = cut(_classes(packed, buckets))
    labels = components(_links(classes))
    # The smallest document of each class, then of each component; a component is named by it.
    smallest = docs.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least_doc"))
    linked = labels.withColumnRenamed("node", "class").join(smallest, "class")
    # Cut, so that the join on a label of many classes has plain shuffles on both sides and can be split.
    least = cut(linked.groupBy("label").agg(F.min("least_doc").alias("component_id")))
    named = linked.join(least, "label").select("class", "component_id")
    by_class = smallest.join(named, "class", "left").select("class", F.coalesce("component_id", "least_doc").alias("component_id"))
    return docs.join(by_class, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
