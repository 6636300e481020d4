import random
import struct
import zlib
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import binary, envelope, frame, payload
from tapeloom.operators import capability, compare, sequence
from tapeloom.operators.derive import derive
from tapeloom.plans import views
from tapeloom.sources import recording

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_little_endian(spark):
    rows = spark.range(0, 65536, 97).select("id", binary.read_le(binary.le(F.col("id"), 2), 1, 2).alias("back"))
    assert rows.filter("id <> back").count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 300])
def test_wide_lists_and_bodies(spark, n):
    inner = frame.node("item", [("id", frame.text(F.lit("x" * n)))])
    made = frame.node("list", [("id", frame.text(F.lit("é" * n)))], frame.children(F.array_repeat(inner, n)))
    found = one(spark, frame.nodes(made))
    assert found["error"] is None and len(found["nodes"]) == n + 1
    assert found["nodes"][0]["attrs"][0]["text"] == "é" * n


def test_same_meaning_in_other_bytes(spark):
    plain = frame.node("receipt", [("id", frame.text(F.lit("1"))), ("from", frame.text(F.lit("7@s.net"))), ("t", frame.text(F.lit("12")))])
    packed = frame.node("receipt", [("id", frame.digits(F.lit("1"))), ("from", frame.jid(F.lit("7"), "s.net")), ("t", frame.digits(F.lit("12")))])
    rows = spark.range(1).select(frame.nodes(plain).alias("a"), frame.nodes(packed).alias("b"))
    got = rows.select(derive("a").alias("a"), derive("b").alias("b")).first()
    assert got["a"] == got["b"] and got["a"]["shape"] == "receipt"


def test_mutated_frames_never_raise(spark):
    good = views.framed(spark, DATA).limit(20).collect()
    random.seed(1)
    ok = refused = 0
    for row in good:
        for _ in range(60):
            b = bytearray(row["frame"])
            for _ in range(random.randint(1, 3)):
                b[random.randrange(len(b))] = random.randrange(256)
            found = frame.parse(bytes(b[: random.choice([len(b), len(b), random.randrange(len(b) + 1)])]))
            ok += found["error"] is None
            refused += found["error"] is not None
    assert ok and refused


def test_frame_limits():
    deep = b"\xf8\x01\x01"
    for _ in range(63):
        deep = b"\xf8\x02\x01\xf8\x01" + deep
    assert frame.parse(deep)["error"] is None
    assert frame.parse(b"\xf8\x02\x01\xf8\x01" + deep)["error"] == "too_deep"
    assert frame.parse(b"\xf8\x01\x01x")["error"] == "trailing_bytes"
    assert frame.parse(b"\xf8\x03\x01\x06\xff\x80")["error"] == "empty_odd_run"


def test_envelope_refusals(spark):
    entries = F.array(F.struct(F.array(F.lit(1), F.lit(300)).alias("path"), F.lit(0).alias("status"), F.lit(b"abc").alias("payload")))
    whole = bytes(one(spark, envelope.encode(F.lit(b"frame"), outbound=F.lit(True), reencoded=F.lit(False), entries=entries)))
    cases = [whole, whole + b"x", *[whole[:k] for k in range(len(whole))]]
    got = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, e binary").select("i", envelope.header(F.col("e"))["error"].alias("h"), envelope.entries(F.col("e")).alias("x")).orderBy("i").collect()
    first = got[0]
    assert first["h"] is None and first["x"]["error"] is None
    assert first["x"]["entries"][0]["path"] == [1, 300] and bytes(first["x"]["entries"][0]["payload"]) == b"abc"
    assert got[1]["x"]["error"] == "trailing_bytes"
    assert all(r["h"] or r["x"]["error"] for r in got[2:])
    bad = F.array(F.struct(F.array(F.lit(1)).alias("path"), F.lit(2).alias("status"), F.lit(b"abc").alias("payload")))
    assert one(spark, envelope.encode(F.lit(b"f"), outbound=F.lit(True), reencoded=F.lit(False), entries=bad)) is None


def test_payloads():
    assert payload.describe(b"")["kind"] == "empty"
    assert payload.describe(b"\x0a\x02hi")["text"] == "hi"
    assert payload.describe(b"\x8a\x03\x02hi")["kind"] == "unmodelled"
    assert payload.describe(b"\xaa\x02\x00")["error"] == "empty_wrapper"
    assert payload.describe(b"\x08" + b"\xff" * 9 + b"\x02")["error"] == "overlong_varint"
    assert payload.describe(b"\x0b\x14")["error"] == "unbalanced_group"
    assert payload.describe(b"\x00")["error"] == "field_zero"


def test_bounded_dedup_is_exact(spark):
    random.seed(3)
    rows = [(random.randrange(3), i, "message" if random.random() < 0.9 else "t" * 25, random.choice([None, *map(str, range(9)), "i" * 65])) for i in range(800)]
    got = {r["ord"]: r["admission"] for r in sequence.bounded_dedup(spark.createDataFrame(rows, "session bigint, ord bigint, tag string, id string"), 4).collect()}
    rings: dict = {}
    for s, o, t, i in rows:
        ring = rings.setdefault(s, OrderedDict())
        if i is None or len(t) > 24 or len(i) > 64:
            want = "untracked"
        elif (t, i) in ring:
            want = "duplicate"
        else:
            want = "new"
            ring[t, i] = None
            if len(ring) > 4:
                ring.popitem(last=False)
        assert got[o] == want
    assert {r["admission"] for r in sequence.bounded_dedup(spark.createDataFrame([(1, 1, "m", "a"), (1, 2, "m", "a")], "session bigint, ord bigint, tag string, id string"), 0).collect()} == {"new"}


def test_swapped_stanzas_are_found(spark):
    left = views.recordings(spark, DATA, "left").filter("recording = 1")
    swapped = left.withColumn("ord", F.when(F.col("direction") == "inbound", -F.col("ord")).otherwise(F.col("ord")))
    assert compare.verdict(compare.findings(left, left), "regression").first()["verdict"] == "pass"
    assert compare.verdict(compare.findings(left, swapped), "regression").first()["verdict"] == "fail"


def test_capabilities(spark):
    with pytest.raises(ValueError, match="detach, l0.plaintext"):
        capability.require(["takeover"], ["l0.plaintext", "detach", "takeover"])
    assert one(spark, capability.unknown(F.array(F.lit("x"), F.lit("takeover")))) == ["x"]


def _file(records, trailer=True, count=None, crc=None, meta=b""):
    body = b"WAWR" + struct.pack("<HI", 1, len(meta)) + meta
    for kind, data in records:
        body += struct.pack("<BI", kind, len(data)) + data
    if trailer:
        body += struct.pack("<BIII", 255, 8, len(records) if count is None else count, zlib.crc32(body) if crc is None else crc)
    return body


def test_recording_states():
    r = [(0, b"abc"), (1, b"\x01\0\0\0hi"), (9, b"?")]
    assert recording.walk("p", _file(r))["integrity"] == "complete"
    assert recording.walk("p", _file(r))["skipped"] == 1
    assert recording.walk("p", _file(r, count=7))["integrity"] == "damaged"
    assert recording.walk("p", _file(r, crc=1))["integrity"] == "damaged"
    assert recording.walk("p", _file(r) + b"x")["integrity"] == "trailing_bytes"
    cut = recording.walk("p", _file(r, trailer=False)[:-1])
    assert cut["integrity"] == "truncated" and cut["found"] == 2 and cut["dangling"] == 5
    assert recording.walk("p", b"nope")["error"] == "magic"
    assert recording.walk("p", _file([], meta=struct.pack("<HI", 0x80FF, 0)))["unknown_critical"] == 1


def test_recordings_round_trip(spark, tmp_path):
    rows = views.enveloped(spark, DATA).select(F.col("session").alias("recording"), "ord", F.lit(0).alias("kind"), F.col("envelope").alias("payload"))
    recording.write_recordings(rows, str(tmp_path / "t"), {"note": b"two", "adapter": b"a"})
    back = recording.read_tables(spark, str(tmp_path / "t"))
    assert {r["integrity"] for r in back.collect()} == {"complete"}
    assert recording.envelopes(back).count() == rows.count()
    assert back.select(recording.digest_text(recording.meta_value(F.col("meta"), "note")).alias("n")).first()["n"] == "two"
    (tmp_path / "f").mkdir()
    for r in recording.contents(rows, finished=False).collect():
        (tmp_path / "f" / f"{r['recording']}.wawr").write_bytes(bytes(r["content"]))
    assert {r["integrity"] for r in recording.read_recordings(spark, str(tmp_path / "f")).collect()} == {"truncated"}


@pytest.mark.parametrize("kept", [True, False])
def test_runs_of_bytes_are_walked_as_the_whole(kept):
    random.seed(2)
    whole = _file([(0, b"abc"), (1, b"\x01\0\0\0hi"), (9, b"?" * 300), (0, b"")], meta=struct.pack("<HI", 2, 1) + b"n")
    for data in (whole, whole + b"x", whole[:-14] + b"z" + whole[-13:], *[whole[:k] for k in range(len(whole))]):
        walked = recording.Walk("p", kept)
        cuts = sorted(random.randrange(len(data) + 1) for _ in range(5))
        for a, b in zip([0, *cuts], [*cuts, len(data)]):
            walked.feed(data[a:b])
        assert walked.end() == recording.walk("p", data) | ({} if kept else {"records": []})


def test_a_record_that_is_not_kept_is_not_held():
    walked = recording.Walk("p", False)
    walked.feed(_file([], trailer=False) + struct.pack("<BI", 0, 1 << 31))
    for _ in range(64):
        walked.feed(bytes(1 << 16))
        assert not walked.held
    assert walked.end()["dangling"] == 5 + (1 << 22)


def test_checksums_of_parts_join():
    a, b = b"abc" * 50_000, b"defg" * 40_000
    assert recording.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert recording.joined_crc(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def test_a_recording_is_written_and_read_in_parts(spark, tmp_path):
    # Ordinals that are missing, negative, repeated and far apart; a payload beyond a part; a recording without a name.
    random.seed(4)
    found = [(random.choice([1, 1, 1, 2, None]), random.choice([None, *range(-70_000, 200_000, 700)]), random.choice([0, 1, 9]), bytearray(random.randbytes(random.randrange(300)))) for _ in range(4000)]
    found.append((2, 5, 0, bytearray(100_000)))
    rows = spark.createDataFrame(found, "recording bigint, ord bigint, kind int, payload binary").repartition(3)
    recording.write_recordings(rows, str(tmp_path / "t"), {"note": b"two"})
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.groupBy("recording").count().agg(F.min("count")).first()[0] > 5
    assert table.agg(F.max(F.octet_length("content"))).first()[0] < recording.PART + 100_100
    bytes_of = {}
    for r in table.orderBy("section", "stretch", "part").collect():
        bytes_of[r["recording"]] = bytes_of.get(r["recording"], b"") + bytes(r["content"])
    assert bytes_of == {r["recording"]: bytes(r["content"]) for r in recording.contents(rows, {"note": b"two"}).collect()}
    back = recording.read_tables(spark, str(tmp_path / "t"))
    want = {None if k is None else str(k): recording.walk(None, b) for k, b in bytes_of.items()}
    for got in (recording.states(back), recording.states(recording.read_tables(spark, str(tmp_path / "t"), kept=False))):
        assert {r["path"]: (r["integrity"], r["found"], r["claimed"], r["skipped"]) for r in got.collect()} == {k: ("complete", w["found"], w["claimed"], w["skipped"]) for k, w in want.items()}
    read = recording.records(back).collect()
    assert len(read) == len(found)
    assert {(r["path"], r["ord"]): (r["kind"], bytes(r["payload"])) for r in read} == {(k, x["ord"]): (x["kind"], x["payload"]) for k, w in want.items() for x in w["records"]}


def test_a_long_recording_gives_rows_of_bounded_size(spark):
    n = recording.ROW_RECORDS * 2 + 5
    files = spark.createDataFrame([("a", bytearray(_file([(0, b"x")] * n))), ("a", bytearray(_file([])))], "path string, content binary").coalesce(1)
    rows = recording.walk_files(files)
    assert rows.agg(F.max(F.size("records"))).first()[0] < n
    assert [(r["integrity"], r["found"]) for r in recording.states(rows).orderBy("found").collect()] == [("complete", 0), ("complete", n)]
    assert recording.envelopes(rows).agg(F.count("*"), F.max("ord")).first()[:] == (n, n - 1)


@pytest.mark.parametrize("name", ["claim_tags", "enum_policy"])
def test_frames_are_parsed_once(spark, name):
    from tapeloom.plans import queries

    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("read(") == 1
