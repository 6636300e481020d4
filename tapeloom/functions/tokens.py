"""Token tables: the words that a frame writes as one byte, or as a dictionary byte and an index."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Words that a table may have: those of one byte, and of each of the four dictionaries.
SINGLE, DICTIONARIES, WORDS = 235, 4, 256


@dataclass(frozen=True)
class Servers:
    """Names of the servers that an address form implies."""

    user: str = "s.net"
    lid: str = "lid"
    hosted: str = "hosted"
    hosted_lid: str = "hosted.lid"
    interop: str = "interop"
    messenger: str = "msgr"


@dataclass(frozen=True)
class TokenTable:
    """``single`` from byte 1 on; ``double`` by dictionary and index."""

    single: tuple[str, ...]
    double: tuple[tuple[str, ...], ...] = ()
    servers: Servers = field(default_factory=Servers)

    def __post_init__(self) -> None:
        if len(self.single) > SINGLE or len(self.double) > DICTIONARIES or any(len(d) > WORDS for d in self.double):
            raise ValueError(f"a token table has {SINGLE} words of one byte and {DICTIONARIES} dictionaries of {WORDS} at most")
        words = [w for part in (self.single, *self.double) for w in part]
        if len(set(words)) != len(words) or not all(words):
            raise ValueError("the words of a token table must differ and not be empty")

    def places(self) -> dict[str, tuple[int, ...]]:
        """The bytes of each word."""
        found = {w: (236 + k, i) for k, d in enumerate(self.double) for i, w in enumerate(d)}
        return found | {w: (i + 1,) for i, w in enumerate(self.single)}

    def digest(self) -> str:
        """SHA-256 of the table as JSON, by which recordings name it."""
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps({"single": self.single, "double": self.double}, ensure_ascii=False, separators=(",", ":"))


def from_json(text: str, digest: str | None = None) -> TokenTable:
    """A table from ``{"single": [...], "double": [[...], ...]}``; ``digest`` pins its content."""
    found = json.loads(text)
    table = TokenTable(tuple(found["single"]), tuple(tuple(d) for d in found.get("double", ())))
    if digest is not None and table.digest() != digest:
        raise ValueError(f"the token table has the digest {table.digest()}, not {digest}")
    return table


def load(spark: SparkSession, path: str, digest: str | None = None) -> TokenTable:
    """A table from a JSON file that Spark can read; at most some thousand words."""
    return from_json(spark.read.text(path, wholetext=True).first()["value"], digest)


def from_words(words: DataFrame, single: Sequence[str]) -> TokenTable:
    """The words of one column, 1,024 at most, as dictionaries in ascending order behind ``single``."""
    found = [r[0] for r in words.distinct().orderBy(words.columns[0]).limit(DICTIONARIES * WORDS).collect() if r[0] and r[0] not in single]
    return TokenTable(tuple(single), tuple(tuple(found[k : k + WORDS]) for k in range(0, len(found), WORDS)))
