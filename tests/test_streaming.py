from pyspark.sql import functions as F

from tapeloom.operators import sequence
from tapeloom.plans import views
from tapeloom.streaming.stateful import dedup_stream, join_stream

DATA = "/root/testdata/sf0.001"




def test_dedup_stream_is_the_batch(spark, tmp_path):
    rows = views.stanzas(spark, DATA).select("session", "ord", "tag", "id").filter("ord < 300").coalesce(1)
    rows.write.parquet(str(tmp_path / "one"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "one"))
    q = dedup_stream(stream, 8).writeStream.format("memory").queryName("d").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["session"], r["ord"], r["admission"]) for r in spark.table("d").collect()}
    want = {(r["session"], r["ord"], r["admission"]) for r in sequence.bounded_dedup(rows, 8).select("session", "ord", "admission").collect()}
    assert got == want


def test_join_stream_keeps_order_and_bound(spark, tmp_path):
    f, p = "frame", "payload"
    line = [
        (1, 1, f, 1, "a", 2, None, None),
        (1, 2, f, 2, "b", 1, None, None),
        (1, 3, p, None, "b", None, 0, "B"),
        (1, 4, p, None, "a", None, 0, "A0"),
        (1, 5, p, None, "a", None, 1, "A1"),
        (1, 6, f, 3, "c", 1, None, None),
        (1, 7, f, 4, "x", 0, None, None),
        (1, 8, f, 5, "y", 0, None, None),
        (1, 9, f, 6, "z", 0, None, None),
        (1, 10, p, None, "c", None, 0, "late"),
        (1, 11, f, 7, "e", 2, None, None),
        (1, 12, p, None, "e", None, 1, "E1"),
        (1, 13, "flush", None, None, None, None, None),
    ]
    rows = spark.createDataFrame(line, "session bigint, arrival bigint, event string, ord bigint, id string, slots int, slot int, payload string")
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "one"))
    q = join_stream(stream, 2).writeStream.format("memory").queryName("j").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["ord"], r["slot"]): (r["payload"], r["status"]) for r in spark.table("j").select(F.col("ord"), "slot", "payload", "status").collect()}
    assert got == {(1, 0): ("A0", "ok"), (1, 1): ("A1", "ok"), (2, 0): ("B", "ok"), (3, 0): (None, "unobserved"), (7, 0): (None, "unobserved"), (7, 1): ("E1", "ok")}


def test_runs_are_merged_in_order(monkeypatch):
    import pandas as pd

    from tapeloom.streaming import stateful

    monkeypatch.setattr(stateful, "RUN", 10)
    monkeypatch.setattr(stateful, "PIECE", 3)
    frames = (pd.DataFrame({"arrival": [(7 * i + k) % 101 for k in range(4)], "id": [None, "a", "b", "c"]}) for i in range(9))
    assert [r.arrival for r in stateful._in_order(frames, "arrival")] == sorted((7 * i + k) % 101 for i in range(9) for k in range(4))
