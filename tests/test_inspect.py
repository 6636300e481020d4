from pyspark.sql import functions as F

from tapeloom.operators import inspect
from tapeloom.sources import recording
from tests.test_wire import _file


def test_reports_of_odd_recordings(spark):
    # An outbound frame of one byte, and one entry at /0 that failed.
    envelope = b"\x01\0\x01\0\x01\0\0\0f\x01\0\x01\x00\x00\x01\0\0\0\0"
    files = {"whole": _file([(0, envelope), (0, b"x"), (9, b"?")]), "cut": _file([(0, envelope)], trailer=False)[:-1], "empty": _file([]), "bad": b"nope"}
    made = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    inspected = inspect.inspect(recording.walk_files(made))
    got = {r["path"]: r for r in inspected.collect()}
    assert [got["whole"][c] for c in ("envelopes", "inbound", "outbound", "decrypt_failed", "undecodable", "skipped")] == [2, 0, 1, 1, 1, 1]
    assert got["cut"]["integrity"] == "truncated" and got["cut"]["envelopes"] == 0
    assert got["empty"]["envelopes"] == 0 and got["empty"]["content"] == []
    lines = {r["path"]: r["t"] for r in inspect.report(inspected).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "text")))["text"].alias("t")).collect()}
    assert lines["bad"] == ["not a recording: magic"]
    assert lines["empty"] == ["  integrity     complete: count and checksum both hold", "  envelopes     0: 0 inbound, 0 outbound"]
    assert lines["whole"] == [
        "  integrity     complete: count and checksum both hold",
        "  envelopes     2: 0 inbound, 1 outbound",
        "  plaintexts    1: 0 ok, 1 decrypt-failed, 0 unsupported, 0 unobserved",
        "  unreadable    1 envelopes did not decode",
        "  skipped       1 records of unknown kinds",
    ]
