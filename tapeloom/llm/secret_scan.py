"""Secret scans: plain patterns, and a character convolutional network over other candidates.

Base spans are leftmost non-overlapping matches per kind: ``assign`` (a named value), ``access``
(a cloud access key), ``hex`` (a long run of hex digits). Candidates are all runs of ``LEAST`` token
characters or more, and shorter ones, of ``SHORT`` or more, in which letters meet digits or the case
rises, or that start up to ``NEAR`` characters after a cue. The network sees each candidate with its
surroundings as windows of ``WINDOW`` characters: an embedding per character, one convolution, the
maximum and the mean over places, one dense layer. The candidate's own characters are marked. A long candidate has several windows, up to
``AFTER`` characters behind its end, and the maximum counts.

The network is to find what the patterns miss, so it is trained on the base spans of all documents in disguise
(``disguised``). Against them stand all candidates that touch no base span, without those that look like keys
themselves (``key_like``): these may be what is looked for. Each different window counts once.
Windows are dealt by hash into parts of about ``PART``; a task trains a part in numpy, and the parts' networks are averaged
after each of ``ROUNDS`` rounds (one part needs no averaging). The output is calibrated by a logistic fit on a fifth of the
windows that is kept from training, and the threshold is the highest that keeps ``recall`` of the disguised secrets there. Candidates at or above
it that touch no base span become spans of kind ``model``.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut

KINDS = ("assign", "access", "hex", "model")
LEAST, SHORT, NEAR, BEFORE, AFTER, WINDOW = 12, 6, 24, 24, 12, 64
PART, ROUNDS, STEPS, EPOCHS = 1 << 17, 2, 600, 6
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CUES = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "login")
_TOKEN = "[A-Za-z0-9+/_=.-]"
_LONG = re.compile(rf"(?<!{_TOKEN}){_TOKEN}{{{LEAST},}}+")
_RUN = re.compile(rf"{_TOKEN}++")
_MIXED = re.compile(r"[a-z][A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z]")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Base spans of a text, by start, then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _cue_ends(text: str) -> Iterator[int]:
    low = text.lower()
    if len(low) == len(text):
        for cue in _CUES:
            at = low.find(cue)
            while at >= 0:
                yield at + len(cue)
                at = low.find(cue, at + 1)
    else:  # a letter whose lower case is longer
        for m in re.finditer("|".join(_CUES), text, re.I):
            yield m.end()


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of token characters, without dots at their end."""
    runs = {m.span() for m in _LONG.finditer(text)}
    last = 0
    for m in _MIXED.finditer(text):
        if m.start() >= last:
            start = m.start()
            while start > 0 and text[start - 1] in _LETTERS:
                start -= 1
            last = _RUN.match(text, start).end()
            runs.add((start, last))
    for at in _cue_ends(text):
        while at < len(text) and text[at] in _LETTERS:  # the rest of the cue's own word
            at += 1
        place = at
        while (m := _RUN.search(text, place, min(len(text), at + NEAR + 1))) is not None:
            place = _RUN.match(text, m.start()).end()
            runs.add((m.start(), place))
    found = []
    for start, end in sorted(runs):
        while end > start and text[end - 1] == ".":
            end -= 1
        if end - start >= SHORT:
            found.append((start, end))
    return found


def key_like(x: str) -> bool:
    """Whether a fourth or more of neighbours differ in being a capital, a small letter or a digit."""
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 for c in x if c.isalnum()]
    return len(kinds) >= LEAST and 4 * sum(a != b for a, b in zip(kinds, kinds[1:])) >= len(kinds)


def disguised(text: str, span: Span) -> list[tuple[str, int, int]]:
    """(text, start, end) of a base span's surroundings, with the value shown as the patterns don't find it.

    ``assign``: the name without a sign after it, and no name if the value is ``key_like``; ``access``: without
    its first letters; ``hex``: in capitals.
    """
    kind, a, b = span
    left, right = text[max(0, a - BEFORE) : a], text[b : b + WINDOW]
    if kind == "assign":
        m = _ASSIGN.match(text, a)
        forms = [(re.match(r"\w+", m[0])[0] + " ", m[1])] + [("", m[1])] * key_like(m[1])
    else:
        forms = [("", text[a + 4 : b] if kind == "access" else text[a:b].upper())]
    return [(left + name + value + right, len(left + name), len(left + name + value)) for name, value in forms]


def uncovered(spans: list[Span], runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs that touch no span, by one sweep: spans are in order of their starts, and runs don't overlap."""
    out, j, top = [], 0, 0
    for start, end in runs:
        while j < len(spans) and spans[j][1] < end:
            top = max(top, spans[j][2])
            j += 1
        if top <= start:
            out.append((start, end))
    return out


def windows(text: str, start: int, end: int) -> list[bytes]:
    """The windows of a candidate: from its start, and in steps until ``AFTER`` characters behind its end are seen."""
    shown = WINDOW - BEFORE - AFTER
    last = max(start, end - shown)
    return [window(text, at, start, end) for at in [*range(start, last, shown), last]]


def window(text: str, at: int, start: int, end: int) -> bytes:
    """The characters around a place as bytes: ASCII, 127 for others, 0 outside the text; 128 more inside the candidate."""
    low = max(0, at - BEFORE)
    shown = text[low : at + WINDOW - BEFORE]
    code = bytearray(shown.encode("ascii", "replace").replace(b"?", b"\x7f"))
    a, b = max(0, start - low), min(len(code), end - low)
    code[a:b] = bytes(c | 128 for c in code[a:b])
    gap = BEFORE - (at - low)
    return b"\0" * gap + bytes(code) + b"\0" * (WINDOW - gap - len(code))


@dataclass
class Network:
    """Embedding (256, e), filters (width * e, f), dense (2 f), bias; then slope and shift of the calibration."""

    embedding: np.ndarray
    filters: np.ndarray
    offsets: np.ndarray
    dense: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    def forward(self, x: np.ndarray):
        width = len(self.filters) // self.embedding.shape[1]
        places = x.shape[1] - width + 1
        shown = self.embedding[x]
        patches = np.concatenate([shown[:, k : k + places] for k in range(width)], axis=2)
        z = np.maximum(patches @ self.filters + self.offsets, 0)
        top = z.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(z, top[:, None], 1)[:, 0], z.mean(axis=1)], axis=1)
        return patches, z, top, pooled, pooled @ self.dense + self.bias

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The output before calibration, the same for a window in any company: filters are looked up by character."""
        size = self.embedding.shape[1]
        width = len(self.filters) // size
        places = x.shape[1] - width + 1
        looked_up = [(self.embedding @ self.filters[k * size : (k + 1) * size]).astype(np.float32) for k in range(width)]
        out = [np.zeros(0)]
        for i in range(0, len(x), 512):
            part = x[i : i + 512]
            z = looked_up[0][part[:, :places]] + self.offsets.astype(np.float32)
            for k in range(1, width):
                z += looked_up[k][part[:, k : k + places]]
            np.maximum(z, 0, out=z)
            pooled = np.concatenate([z.max(axis=1), z.mean(axis=1, dtype=np.float64)], axis=1)
            out.append((pooled * self.dense).sum(axis=1) + self.bias)
        return np.concatenate(out)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.raw(x))


def _first(random: np.random.Generator, size: int, filters: int, width: int) -> Network:
    return Network(random.normal(0, 0.3, (256, size)), random.normal(0, 0.2, (width * size, filters)), np.zeros(filters), random.normal(0, 0.2, 2 * filters), 0.0)


def descend(net: Network, x: np.ndarray, y: np.ndarray, random: np.random.Generator) -> Network:
    """``net`` trained on all of the windows: ``STEPS`` steps or so, in one to ``EPOCHS`` epochs."""
    net = replace(net, embedding=net.embedding.copy(), filters=net.filters.copy(), offsets=net.offsets.copy(), dense=net.dense.copy())
    size, filters = net.embedding.shape[1], len(net.offsets)
    width = len(net.filters) // size
    state: list[list] = []
    step = 0
    for _ in range(int(np.clip(-(-STEPS * 64 // len(y)), 1, EPOCHS))):
        order = random.permutation(len(y))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            bx, by = x[chosen], y[chosen]
            patches, z, top, pooled, raw = net.forward(bx)
            error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - by) / len(by)
            back = error[:, None] * net.dense[None]
            dz = np.repeat(back[:, None, filters:] / z.shape[1], z.shape[1], axis=1)
            rows = np.arange(len(by))[:, None]
            dz[rows, top, np.arange(filters)] += back[:, :filters]
            dz *= z > 0
            flat = dz.reshape(-1, filters)
            d_filters = patches.reshape(len(flat), -1).T @ flat
            d_patches = dz @ net.filters.T
            seen = np.concatenate([bx[:, k : k + z.shape[1]].ravel() for k in range(width)])
            pulls = np.concatenate([d_patches[:, :, k * size : (k + 1) * size].reshape(-1, size) for k in range(width)])
            d_embedding = np.stack([np.bincount(seen, pulls[:, e], 256) for e in range(size)], axis=1)
            slopes = [d_embedding, d_filters, dz.sum(axis=(0, 1)), pooled.T @ error, np.array(error.sum())]
            state = state or [[np.zeros_like(s), np.zeros_like(s)] for s in slopes]
            step += 1
            moves = []
            for slope, s in zip(slopes, state, strict=True):
                s[0] = 0.9 * s[0] + 0.1 * slope
                s[1] = 0.99 * s[1] + 0.01 * slope * slope
                moves.append(0.01 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8))
            net.embedding -= moves[0]
            net.filters -= moves[1]
            net.offsets -= moves[2]
            net.dense -= moves[3]
            net.bias -= float(moves[4])
    return net


def _averaged(nets: list[tuple[Network, int]]) -> Network:
    """The mean of networks, each weighed by its number of windows."""
    total = sum(n for _, n in nets)
    mean = lambda name: sum(getattr(net, name) * (n / total) for net, n in nets)
    return Network(*[mean(c) for c in ("embedding", "filters", "offsets", "dense", "bias")])


def _windows(seen) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(s) for s in seen), np.uint8).reshape(-1, WINDOW)


def fit_network(found: DataFrame, *, recall: float = 0.98, size: int = 8, filters: int = 16, width: int = 5, seed: int = 3) -> Network | None:
    """Train on four fifths of ``findings``, calibrate and set the threshold on the rest; None without both labels in either part."""
    parts = max(1, -(-found.count() // PART))
    # By ranges of the hash and in its order: the same parts, and the same fifth of all, from any partitioning.
    dealt = found.withColumn("part", F.least(F.floor((F.col("rank") / 2.0**64 + 0.5) * parts), F.lit(parts - 1)))
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at = None, 0
        for frame in batches:
            part = frame["part"].to_numpy()
            fresh = np.append(True, part[1:] != part[:-1])[: len(part)]
            starts = np.flatnonzero(fresh)
            nth = np.arange(len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part))))
            if len(part) and part[0] == last:
                nth[part == last] += at
            if len(part):
                last, at = part[-1], nth[-1] + 1
            yield frame[["part", "seen", "label"]].assign(kept=(np.array([before[p] for p in part], np.int64) + nth) % 5 == 0)

    rows = cut(dealt.repartition(parts, "part").sortWithinPartitions("part", "rank", "seen").mapInPandas(told, "part bigint, seen binary, label int, kept boolean"))
    counts = {(r["kept"], r["label"]): r["n"] for r in rows.groupBy("kept", "label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 4:
        return None
    net = _first(np.random.default_rng(seed), size, filters, width)
    for turn in range(ROUNDS if parts > 1 else 1):

        def learn(batches: Iterator[pd.DataFrame], net: Network = net, turn: int = turn) -> Iterator[pd.DataFrame]:
            frames = [(f["part"].to_numpy(), f["label"].to_numpy(np.int64), _windows(f["seen"])) for f in batches]
            if frames:
                part, y, x = (np.concatenate(c) for c in zip(*frames, strict=True))
                for p in np.unique(part):
                    own, random = np.flatnonzero(part == p), np.random.default_rng(seed + turn)
                    if not turn:
                        _first(random, size, filters, width)
                    yield pd.DataFrame({"part": [p], "net": [pickle.dumps(descend(net, x[own], y[own], random))], "n": [len(own)]})

        made = rows.filter("not kept").mapInPandas(learn, "part bigint, net binary, n bigint").collect()
        net = _averaged([(pickle.loads(r["net"]), r["n"]) for r in sorted(made, key=lambda r: r["part"])])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"raw": net.raw(_windows(frame["seen"])), "label": frame["label"]})

    scored = cut(rows.filter("kept").select("seen", "label").mapInPandas(score, "raw double, label int"))
    # The k-th lowest output of the disguised secrets; the lowest ones are sorted by the tasks.
    lowest = scored.filter("label = 1").orderBy("raw").limit(int((1 - recall) * counts[True, 1]) + 1)
    least = lowest.agg(F.max("raw").alias("raw")).first()["raw"]
    # Alike outputs as one: the fit that follows sees each cell's mean and number of rows.
    ends = scored.agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.stddev_pop("raw").alias("spread")).first()
    cell = F.floor((F.col("raw") - ends["low"]) / max(ends["high"] - ends["low"], 1e-9) * 1000)
    cells = scored.groupBy("label", cell.alias("cell")).agg(F.avg("raw").alias("raw"), F.count("*").alias("n")).orderBy("label", "cell").collect()
    raw, y, n = (np.array([r[c] for r in cells], float) for c in ("raw", "label", "n"))
    weight = n / n.sum()
    raw_scale = max(1.0, ends["spread"])
    net.slope, net.shift = 1.0 / raw_scale, 0.0
    for _ in range(200):  # logistic calibration, slightly drawn to a slope of one
        off = weight * (net.calibrated(raw) - y)
        net.slope -= 0.5 * (float((off * raw).sum()) / raw_scale**2 + 1e-3 * (net.slope - 1))
        net.shift -= 0.5 * float(off.sum())
    net.threshold = float(net.calibrated(np.array([least]))[0])
    return net


def findings(documents: DataFrame) -> DataFrame:
    """``seen, label, rank``: each different window of the disguised base spans (1) and other candidates (0) of all documents, with a hash of it."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows: dict[bytes, int] = {}
            for text in frame["text"]:
                spans = base_spans(text)
                rows |= {w: 1 for span in spans for shown in disguised(text, span) for w in windows(*shown)}
                free = [(a, b) for a, b in uncovered(spans, candidates(text)) if not key_like(text[a:b])]
                for w in (w for a, b in free for w in windows(text, a, b)):
                    rows.setdefault(w, 0)
            yield pd.DataFrame({"seen": list(rows), "label": pd.Series(rows.values(), dtype="int32")})

    texts = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(extract, "seen binary, label int").groupBy("seen").agg(F.max("label").alias("label")).withColumn("rank", F.xxhash64("seen"))


def scan_text(text: str, net: Network | None) -> list[Span]:
    """Base spans and the network's, by start, then kind."""
    spans = base_spans(text)
    if net is not None:
        own = uncovered(spans, candidates(text))
        if own:
            seen = [windows(text, a, b) for a, b in own]
            x = np.frombuffer(b"".join(w for each in seen for w in each), np.uint8).reshape(-1, WINDOW)
            first = np.cumsum([0, *map(len, seen)])[:-1]
            top = np.maximum.reduceat(net.probability(x), first)
            spans += [("model", a, b) for (a, b), p in zip(own, top, strict=True) if p >= net.threshold]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS_TYPE = "array<struct<kind: string, start: bigint, end: bigint>>"


def scan(documents: DataFrame, net: Network | None) -> DataFrame:
    """All columns of ``documents`` and ``spans``, an array of (kind, start, end) in code points, end exclusive.

    Defined cases: a null or empty text has no spans; repeated rows are scanned each; an empty table
    stays empty; a column named spans is replaced.
    """

    @F.pandas_udf(SPANS_TYPE)
    def find(text: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(x, net)] for x in text.fillna("")], dtype=object)

    return documents.drop("spans").withColumn("spans", find("text"))


def train(documents: DataFrame, **options) -> Network | None:
    """A network from the documents themselves; None if they lack secrets or other candidates."""
    return fit_network(cut(findings(documents)), **options)


def redact(documents: DataFrame, net: Network | None, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with each run of overlapping spans in ``text`` replaced by ``mark``; null texts stay null."""

    @F.pandas_udf("string")
    def hide(text: pd.Series) -> pd.Series:
        out = []
        for x in text:
            if x is not None:
                at, parts = 0, []
                for _, a, b in scan_text(x, net):
                    if a >= at:
                        parts += [x[at:a], mark]
                    at = max(at, b)
                x = "".join([*parts, x[at:]])
            out.append(x)
        return pd.Series(out, dtype=object)

    return documents.withColumn("text", hide("text"))
