"""Streaming forms of the stateful operators: state is kept per session, by ordinals in the data.

Order inside a micro-batch is not given, so a batch's rows are sorted before they are taken. No
wall clock or watermark is used: recordings have no time per stanza.
"""

from __future__ import annotations

import heapq
import json
import pickle
import tempfile
from collections import OrderedDict
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators.sequence import LOOKAHEAD, WINDOW, admit


#: Rows of a key that are sorted at a time, and those of a sorted run that are held while runs are merged.
RUN, PIECE = 1 << 17, 1 << 11


def _in_order(frames: Iterator[pd.DataFrame], order: str) -> Iterator[tuple]:
    """The rows of all frames by ``order``: sorted runs go to files of the task's own, so memory is bounded by a run and a piece of each."""

    def stored(run: list[pd.DataFrame]) -> Iterator[tuple]:
        frame, file = pd.concat(run).sort_values(order, kind="stable"), tempfile.TemporaryFile()
        for at in range(0, len(frame), PIECE):
            pickle.dump(frame.iloc[at : at + PIECE], file)
        file.seek(0)
        return read(file, -(-len(frame) // PIECE))

    def read(file, pieces: int) -> Iterator[tuple]:
        with file:
            for _ in range(pieces):
                yield from pickle.load(file).itertuples(index=False)

    runs, held, n = [], [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= RUN:
            runs.append(stored(held))
            held, n = [], 0
    if held:
        runs.append(pd.concat(held).sort_values(order, kind="stable").itertuples(index=False))
    return heapq.merge(*runs, key=lambda r: getattr(r, order))


class _Dedup(StatefulProcessor):
    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "keys string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = json.loads(self.ring.get()[0]) if self.ring.exists() else []
        ring = OrderedDict(((t, i), None) for t, i in held)
        frame = pd.concat(list(rows)).sort_values("ord")
        found = [admit(ring, None if i is None or t is None else (t, i), self.window) for t, i in zip(frame["tag"], frame["id"], strict=True)]
        self.ring.update((json.dumps([list(k) for k in ring]),))
        yield frame[["session", "ord"]].assign(admission=found)

    def close(self) -> None:
        pass


def dedup_stream(stanzas: DataFrame, window: int = WINDOW) -> DataFrame:
    """``session, ord, admission`` of a stream ``session, ord, tag, id``: the window of admitted keys, exactly."""
    rows = stanzas.select("session", "ord", "tag", "id").groupBy("session")
    return rows.transformWithStateInPandas(_Dedup(window), "session bigint, ord bigint, admission string", "Append", "None")


class _Join(StatefulProcessor):
    """A queue of stanzas; only its finished head leaves."""

    def __init__(self, lookahead: int):
        self.lookahead = lookahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getValueState("queue", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        queue = json.loads(self.queue.get()[0]) if self.queue.exists() else []
        columns = ["session", "ord", "slot", "payload", "status"]
        ordered = _in_order(rows, "arrival")
        while part := list(islice(ordered, RUN)):
            out: list[tuple] = []
            for r in part:
                queue = self._step(queue, r)
                while queue and (queue[0]["done"] or all(s is not None for s in queue[0]["slots"])):
                    q = queue.pop(0)
                    out += [(key[0], q["ord"], i, s, "unobserved" if s is None else "ok") for i, s in enumerate(q["slots"])]
            yield pd.DataFrame(out, columns=columns)
        self.queue.update((json.dumps(queue),))

    def _step(self, queue: list[dict], r) -> list[dict]:
        if r.event == "flush":  # the end of a session: all that waits leaves
            for q in queue:
                q["done"] = True
        elif r.event == "frame":
            for q in queue:
                q["age"] += 1
                q["done"] = q["done"] or q["age"] > self.lookahead or q["id"] == r.id
            queue.append({"ord": int(r.ord), "id": r.id, "slots": [None] * int(r.slots), "age": 0, "done": r.id is None or r.slots == 0})
        else:
            for q in queue:
                if q["id"] == r.id and not q["done"] and 0 <= r.slot < len(q["slots"]):
                    q["slots"][int(r.slot)] = r.payload
                    break
        return queue

    def close(self) -> None:
        pass


def join_stream(timeline: DataFrame, lookahead: int = LOOKAHEAD) -> DataFrame:
    """Frames joined with payloads, in order: ``session, ord, slot, payload, status``.

    ``timeline`` has ``session, arrival, event (frame, payload or flush), ord, id, slots, slot, payload``. A
    repeated id ends the earlier wait; a payload for no waiting stanza is dropped. The state is one
    queue per session: at most ``lookahead`` stanzas behind the head wait.
    """
    schema = "session bigint, ord bigint, slot int, payload string, status string"
    return timeline.groupBy("session").transformWithStateInPandas(_Join(lookahead), schema, "Append", "None")


def stop_quietly(query, timeout_s: int = 60) -> bool:
    """Take in what has come, then stop; whether the query had drained. Its checkpoint stays."""
    query.processAllAvailable()
    query.stop()
    return query.awaitTermination(timeout_s)
