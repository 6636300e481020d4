"""Token files: a wavelet matrix for each shard of token ids.

A shard holds the ids of a run of documents in ascending order. Its ids are first
replaced by their rank among the shard's distinct ids, so that a shard of few
distinct ids needs few bit-planes. Plane *k* holds bit *k* (highest first) of each
symbol, in the order left by a stable partition by the bits above: zeros before ones.
With a running count of ones for each block of 512 bits, rank and select on the planes
give single ids, counts of an id before a place, and the place of its k-th occurrence,
without decoding the rest.

The layout of a shard, little-endian: ``WVM1``, then uint32 counts (ids, documents,
distinct ids, planes), then the distinct ids (uint32), the ids per document (uint32),
the document ids (int64), the zeros of each plane (uint32), and for each plane its
block counts (uint32) and its bits (packed, lowest bit first).

Shards are rows (key, counts, payload) of a Parquet table: executors share no other
kind of folder on every cluster. Text is encoded piece by piece between single spaces;
no pre-token of a byte-level BPE crosses such a place, so pieces can be kept in a
table and each is encoded by the tokenizers library once.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.common import shared_folder, shuffle_width

MAGIC = b"WVM1"
BLOCK = 512
SHARD_SCHEMA = "part bigint, seq bigint, n_docs bigint, n_tokens bigint, payload binary"


class WaveletMatrix:
    """Bit-planes over symbols ``0 .. 2**planes - 1`` with rank and select."""

    def __init__(self, n: int, zeros: np.ndarray, counts: list[np.ndarray], bits: list[np.ndarray]):
        self.n, self.zeros, self.counts, self.bits = n, zeros, counts, bits

    @classmethod
    def build(cls, symbols: np.ndarray, planes: int) -> WaveletMatrix:
        n, zeros, counts, bits = len(symbols), [], [], []
        for k in reversed(range(planes)):
            ones = (symbols & symbols.dtype.type(1 << k)) != 0
            packed = np.packbits(ones, bitorder="little")
            whole = np.zeros(-(-n // BLOCK) * BLOCK // 8, np.uint8)
            whole[: len(packed)] = packed
            per_block = np.bitwise_count(whole.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            counts.append((np.cumsum(per_block, dtype=np.uint32) - per_block).astype("<u4"))
            bits.append(packed)
            low = np.compress(~ones, symbols)  # several times as fast as indexing by booleans
            zeros.append(len(low))
            symbols = np.concatenate([low, np.compress(ones, symbols)])
        return cls(n, np.array(zeros, "<u4"), counts, bits)

    def decode(self) -> np.ndarray:
        """All symbols in order: the partitions undone from the last plane to the first."""
        symbols = np.zeros(self.n, np.uint32 if len(self.bits) > 16 else np.uint16)
        for k, (packed, zeros) in enumerate(zip(reversed(self.bits), self.zeros[::-1], strict=True)):
            ones = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            back = np.empty_like(symbols)
            back[np.flatnonzero(~ones)] = symbols[:zeros]
            back[np.flatnonzero(ones)] = symbols[zeros:] | (1 << k)
            symbols = back
        return symbols

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // BLOCK
        if block >= len(self.counts[plane]):
            block = len(self.counts[plane]) - 1
        if block < 0:
            return 0
        start = block * BLOCK
        run = np.unpackbits(self.bits[plane][start // 8 : (i + 7) // 8], bitorder="little")[: i - start]
        return int(self.counts[plane][block]) + int(run.sum())

    def _bit(self, plane: int, i: int) -> int:
        return int(self.bits[plane][i >> 3] >> (i & 7)) & 1

    def access(self, i: int) -> int:
        symbol = 0
        for p in range(len(self.bits)):
            ones = self._ones(p, i)
            bit = self._bit(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
            symbol = symbol << 1 | bit
        return symbol

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the first ``i`` positions' occurrences of a symbol lie below the last plane."""
        low, high = 0, i
        for p in range(len(self.bits)):
            a, b = self._ones(p, low), self._ones(p, high)
            if symbol >> (len(self.bits) - 1 - p) & 1:
                low, high = int(self.zeros[p]) + a, int(self.zeros[p]) + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of a symbol before position ``i``."""
        low, high = self._range(symbol, i)
        return high - low

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value: the smallest i with k + 1 of them up to i."""
        low, high = 0, self.n - 1
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a symbol; -1 if there are fewer."""
        low, high = self._range(symbol, self.n)
        if k < 0 or low + k >= high:
            return -1
        i = low + k
        for p in reversed(range(len(self.bits))):
            bit = symbol >> (len(self.bits) - 1 - p) & 1
            i = self._select_bit(p, bit, i - int(self.zeros[p]) if bit else i)
        return i


class Shard:
    """A shard file: token access, counting and occurrence lookup by token id."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        n, docs, distinct, planes = np.frombuffer(payload, "<u4", 4, 4).tolist()
        at = 20

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, dtype, count, at)
            at += found.nbytes
            return found

        self.alphabet, self.lengths, self.doc_ids, zeros = take("<u4", distinct), take("<u4", docs), take("<i8", docs), take("<u4", planes)
        blocks = -(-n // BLOCK)
        counts, bits = [], []
        for _ in range(planes):
            counts.append(take("<u4", blocks))
            bits.append(take("u1", -(-n // 8)))
        if at != len(payload):
            raise ValueError("a token shard of the wrong length")
        self.n, self.matrix = n, WaveletMatrix(n, zeros, counts, bits)

    @staticmethod
    def pack(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray) -> bytes:
        seen = np.bincount(ids, minlength=1) if len(ids) else np.zeros(1, int)
        alphabet = np.flatnonzero(seen)
        ranks = np.zeros(len(seen), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        ranks[alphabet] = np.arange(len(alphabet))
        planes = max(0, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
        matrix = WaveletMatrix.build(ranks[ids] if len(ids) else np.zeros(0, ranks.dtype), planes)
        head = np.array([len(ids), len(lengths), len(alphabet), planes], "<u4")
        parts = [MAGIC, head.tobytes(), alphabet.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), matrix.zeros.tobytes()]
        for counts, bits in zip(matrix.counts, matrix.bits, strict=True):
            parts += [counts.tobytes(), bits.tobytes()]
        return b"".join(parts)

    def _symbol(self, token: int) -> int:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else -1

    def token(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.alphabet[self.matrix.access(i)])

    def count(self, token: int, before: int | None = None) -> int:
        symbol = self._symbol(token)
        return 0 if symbol < 0 else self.matrix.rank(symbol, self.n if before is None else before)

    def find(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token, or -1."""
        symbol = self._symbol(token)
        return -1 if symbol < 0 else self.matrix.select(symbol, k)

    def ids(self) -> np.ndarray:
        return self.alphabet[self.matrix.decode()] if self.n else np.zeros(0, np.uint32)


class PieceTable:
    """Piece numbers by 64-bit hash: open addressing in numpy, looked up and filled a batch at a time."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it has none."""
        out = np.full(len(hashes), -1, np.int64)
        at, slots = np.arange(len(hashes)), (hashes >> self.shift).astype(np.int64)
        while len(at):
            seen = self.keys[slots]
            hit = seen == hashes[at]
            out[np.compress(hit, at)] = self.values[np.compress(hit, slots)]
            on = ~hit & (seen != 0)
            at, slots = np.compress(on, at), (np.compress(on, slots) + 1) & self.mask
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Different hashes that the table doesn't hold."""
        slots = (hashes >> self.shift).astype(np.int64)
        while len(hashes):
            free = self.keys[slots] == 0
            self.keys[slots[free]] = hashes[free]
            won = free & (self.keys[slots] == hashes)  # of several that want one slot, the last one written
            self.values[slots[won]] = values[won]
            hashes, values, slots = hashes[~won], values[~won], (slots[~won] + 1) & self.mask


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start .. start + size - 1`` of each range, one range after the other."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)


class Ragged:
    """Lists of numbers in one array that doubles as it fills."""

    def __init__(self, dtype: type):
        self.flat, self.starts, self.used, self.lists = np.zeros(1 << 12, dtype), np.zeros(1 << 12, np.int64), 0, 0

    def __len__(self) -> int:
        return self.lists

    @staticmethod
    def _grown(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = self._grown(self.flat, self.used + len(values))
        self.starts = self._grown(self.starts, self.lists + len(sizes) + 1)
        self.flat[self.used : self.used + len(values)] = values
        self.starts[self.lists + 1 : self.lists + len(sizes) + 1] = self.used + np.cumsum(sizes)
        self.used, self.lists = self.used + len(values), self.lists + len(sizes)

    def size_of(self, which: np.ndarray) -> np.ndarray:
        return self.starts[which + 1] - self.starts[which]

    def get(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists one after the other, and their sizes."""
        starts = self.starts[which]
        sizes = self.starts[which + 1] - starts
        return self.flat[spread(starts, sizes)], sizes


class PieceEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, keeping the ids of pieces it has seen.

    A piece starts at a text's start, and at each single space or newline between two characters that
    are not white space: the pre-tokenizer's pattern always starts a new pre-token there, so a text's
    ids are those of its pieces. Pieces are looked up by a 64-bit hash and then compared byte by byte; one
    that meets another piece's hash is encoded by itself. About ``keep`` pieces, or ``keep_bytes``
    bytes of them, are kept before the store starts anew.
    """

    _STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
    _CHUNK = 1 << 22
    _SPACE = np.zeros(256, bool)
    _SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
    #: First two bytes of three-byte white space in UTF-8 (and of some other characters).
    _WIDE = np.zeros(1 << 16, bool)
    _WIDE[[0xE19A, 0xE280, 0xE281, 0xE380]] = True

    def __init__(self, path: str, end_id: int, keep: int = 1_500_000, keep_bytes: int = 1 << 26):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.keep, self.keep_bytes = Tokenizer.from_file(path), end_id, keep, keep_bytes
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose text starts with a space or newline
        self.opens[[i for x, i in vocabulary.items() if x[0] in "\u0120\u010a"]] = True
        self.powers = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.table = PieceTable(max(8, int(self.keep * 2.5).bit_length()))
        self.ids, self.letters = Ragged(np.uint32), Ragged(np.uint8)

    def _places(self, raw: np.ndarray) -> np.ndarray:
        """Where pieces start; 0xFF stands before each text, and three zeros before and after all."""
        at = np.flatnonzero((raw == 32) | (raw == 10))
        wide = lambda i: self._WIDE[raw[i].astype(np.uint16) << 8 | raw[i + 1]]
        narrow = lambda i: (raw[i] == 0xC2) & ((raw[i + 1] == 0x85) | (raw[i + 1] == 0xA0))
        single = ~(self._SPACE[raw[at - 1]] | self._SPACE[raw[at + 1]] | wide(at - 3) | wide(at + 1) | narrow(at - 2) | narrow(at + 1))
        starts = raw == 0xFF
        starts[np.compress(single, at)] = True
        return np.flatnonzero(starts)

    def _hashes(self, raw: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if sizes.max() > len(self.powers):
            self.powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max()), self._STEP)]))
        out, first = [], 0
        while first < len(places):
            last = max(first + 1, int(np.searchsorted(places, places[first] + self._CHUNK)))
            low, ends = places[first], places[first:last] - places[first]
            total = int(ends[-1] + sizes[last - 1])
            inside = np.arange(total) - np.repeat(ends, sizes[first:last])
            out.append(np.add.reduceat((raw[low : low + total] + np.uint64(1)) * self.powers[inside], ends))
            first = last
        h = np.concatenate(out) ^ sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ h >> np.uint64(29)) * self._STEP
        return np.maximum(h ^ h >> np.uint64(32), np.uint64(1))

    def _encoded(self, pieces: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, ids, sizes): the ids of pieces, and their order there, as numbers in ``pieces``."""
        words = [p[1:].split() == [p[1:]] for p in pieces]
        order, sizes, flat = [], [], []
        for sign in " \n":
            # Pieces of one kind side by side, as in a text; each starts where an id opens with its space or newline.
            chosen = [i for i, p in enumerate(pieces) if words[i] and p[0] == sign]
            joined = ["".join(pieces[i] for i in chosen[k : k + 500]) for k in range(0, len(chosen), 500)]
            ids = np.array([i for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for i in x.ids], np.uint32)
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(chosen):
                raise ValueError("the tokenizer does not start a token at each space; it is not a byte-level BPE")
            order += chosen
            sizes.append(np.diff(at, append=len(ids)))
            flat.append(ids)
        chosen = [i for i, p in enumerate(pieces) if not words[i] or p[0] not in " \n"]
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([pieces[i].removeprefix("\uffff") for i in chosen], add_special_tokens=False)]
        sizes.append(np.array([len(x) for x in ids], np.int64))
        flat.append(np.fromiter((i for x in ids for i in x), np.uint32))
        return order + chosen, np.concatenate(flat), np.concatenate(sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end id after each text, and the number of ids of each text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.ids) > self.keep or self.letters.used > self.keep_bytes:
            self._forget()
        whole = b"\0\0\0" + b"".join(b"\xff" + x.encode() for x in texts) + b"\0\0\0"
        raw = np.frombuffer(whole, np.uint8)
        places = self._places(raw)
        sizes = np.diff(places, append=len(raw) - 3)
        hashes = self._hashes(raw, places, sizes)
        found = self.table.find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh, where = np.unique(hashes[missing], return_index=True)
            where = missing[where]
            first = len(self.ids)
            order, ids, counts = self._encoded(self._pieces(whole, places[where], sizes[where]))
            self.ids.add(ids, counts)
            self.letters.add(raw[spread(places[where[order]], sizes[where[order]])], sizes[where[order]])
            self.table.add(fresh[order], np.arange(first, first + len(fresh), dtype=np.int32))
            found[missing] = self.table.find(hashes[missing])
        found = self._other_than_hash(raw, whole, places, sizes, found)
        ids, lengths = self.ids.get(found)
        upto = np.cumsum(lengths)
        ends = upto[np.append(np.flatnonzero(raw[places] == 0xFF)[1:], len(places)) - 1]
        return np.insert(ids, ends, self.end_id), np.diff(ends, prepend=0) + 1

    @staticmethod
    def _pieces(whole: bytes, places: np.ndarray, sizes: np.ndarray) -> list[str]:
        # U+FFFF, as the mark of a start, keeps such a piece apart from one that starts with a space.
        return [("\uffff" if whole[a] == 0xFF else chr(whole[a])) + whole[a + 1 : b].decode() for a, b in zip(places.tolist(), (places + sizes).tolist(), strict=True)]

    def _other_than_hash(self, raw: np.ndarray, whole: bytes, places: np.ndarray, sizes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """``found``, with pieces that differ from the stored ones of their hash encoded by themselves."""
        same = self.letters.size_of(found) == sizes
        if same.all():
            # The pieces lie side by side, so their stored letters must be what stands between the marks.
            differs = self.letters.get(found)[0] != raw[places[0] : len(raw) - 3]
            same = ~np.logical_or.reduceat(differs, places - places[0]) if differs.any() else same
        else:
            at = np.flatnonzero(same)
            equal = self.letters.get(found[at])[0] == raw[spread(places[at], sizes[at])]
            same[at] = np.logical_and.reduceat(equal, np.cumsum(sizes[at]) - sizes[at]) if len(at) else same[at]
        if not same.all():
            at = np.flatnonzero(~same)
            first = len(self.ids)
            order, ids, counts = self._encoded(self._pieces(whole, places[at], sizes[at]))
            self.ids.add(ids, counts)  # their hashes stay with the earlier pieces
            self.letters.add(raw[spread(places[at[order]], sizes[at[order]])], sizes[at[order]])
            found[at[order]] = np.arange(first, first + len(at))
        return found


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder_of(path: str, end_id: int) -> PieceEncoder:
    """The encoder of this Python worker, which outlives a task."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = PieceEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def write_shards(documents: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 2, tokens_per_shard: int = 1 << 20) -> None:
    """Encode every whole text and write shards, in ascending ``doc_id`` order, as a table at ``path``.

    Defined cases: a null or empty text has the end id alone; rows of a null ``doc_id`` are left out,
    as they have no place in the order; rows of one ``doc_id`` stay apart and go by text; an empty table writes an empty table;
    a text longer than a shard makes its shard longer; other columns are ignored. Shards are named by
    the first document of their task and a number within it, which is also their order.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, seq = encoder_of(tokenizer_path, end_id), None, 0
        ids, lengths, docs, held = [], [], [], 0

        def shard() -> pd.DataFrame:
            payload = Shard.pack(np.concatenate(ids), np.concatenate(lengths), np.concatenate(docs))
            return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [sum(map(len, docs))], "n_tokens": [held], "payload": [payload]})

        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.iloc[at : at + 256]
                part = int(rows["doc_id"].iloc[0]) if part is None else part
                found, per_text = encoder.encode(rows["text"].tolist())
                ids.append(found)
                lengths.append(per_text)
                docs.append(rows["doc_id"].to_numpy())
                held += len(found)
                if held >= tokens_per_shard:
                    yield shard()
                    ids, lengths, docs, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield shard()

    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    ordered = rows.repartitionByRange(max(2, shuffle_width(spark)), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInPandas(encode, SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards at ``path``: ``doc_id, start, n_tokens, ids_crc32``."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, seq, payload in zip(batch["part"], batch["seq"], batch["payload"], strict=True):
                shard = Shard(payload)
                ids, ends = shard.ids().astype("<u4", copy=False), np.cumsum(shard.lengths, dtype=np.int64)
                starts = ends - shard.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"part": part, "seq": seq, "doc_id": shard.doc_ids, "local": starts, "n_tokens": shard.lengths.astype(np.int64), "ids_crc32": np.array(crc, np.int64)})

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # One row per task that wrote: their number is the number of partitions, whatever the input.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    part_starts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    within = W.partitionBy("part").orderBy("seq")
    starts = (
        shards.select("part", "seq", "n_tokens")
        .withColumn("before", F.sum("n_tokens").over(within) - F.col("n_tokens"))
        .join(part_starts, "part")
        .select("part", "seq", (F.col("part_start") + F.col("before")).alias("shard_start"))
    )
    rows = shards.select("part", "seq", "payload").mapInPandas(decode, "part bigint, seq bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(documents: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the shards of ``documents`` to the shared folder and read them back."""
    spark = documents.sparkSession
    path = f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(documents, path, tokenizer_path, **options)
    return read_documents(spark, path)
