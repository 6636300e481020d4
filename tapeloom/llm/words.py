"""Words of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

import numpy as np

#: Lower-cases A-Z, leaves other bytes of UTF-8 alone.
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: The ASCII white space of the word pattern: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, one to one."""
    h = (h ^ h >> np.uint64(32)) * OTHER
    h = (h ^ h >> np.uint64(29)) * STEP
    return h ^ h >> np.uint64(32)


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range; no range is empty."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.uint64)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max()), STEP)]))
    upto = np.cumsum(sizes)
    inside = np.arange(upto[-1]) - np.repeat(upto - sizes, sizes)
    letters = raw[np.repeat(starts, sizes) + inside]
    return mix(np.add.reduceat((letters + np.uint64(1)) * powers[inside], upto - sizes) ^ sizes.astype(np.uint64) * OTHER)


class Words:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+`` of some texts: their places in ``raw`` and the text of each.

    ``cased`` has the same bytes before A-Z were lower-cased.
    """

    def __init__(self, texts: list[str]):
        encoded = [x.encode() for x in texts]
        whole = b" ".join([b"", *encoded, b""])
        self.cased = np.frombuffer(whole, np.uint8)
        self.raw = np.frombuffer(whole.translate(LOWER), np.uint8)
        space = SPACE[self.raw]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
        self.text_starts = 1 + np.cumsum(sizes) - sizes
        #: First word of each text; one more at the end.
        self.first = np.append(np.searchsorted(self.starts, self.text_starts), len(self.starts))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return range_hashes(self.raw, self.starts, self.ends)


def batches_of(texts: list[str], size: int = 1 << 21):
    """(start, end) runs of texts of about so many characters, one text at least."""
    start, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > size:
            yield start, i
            start, held = i, 0
        held += len(x)
    if start < len(texts):
        yield start, len(texts)
