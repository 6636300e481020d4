"""Wire traffic made from the given tables: rows become frames, envelopes and payloads as real bytes.

Each view is lazy and grows with its table, so every operator works on data at scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import envelope, frame, payload

SERVER = "s.net"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, where they come from fewer files than there are cores.

    What follows makes many bytes from thin rows, so dealing out the rows first is the cheap place;
    a table of many files stays as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def stanzas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stanza_rows`` of the table."""
    return stanza_rows(table(spark, sf_dir, "events"))


def stanza_rows(events: DataFrame) -> DataFrame:
    """``ord, session, tag, direction, id, from_user, t`` from events, a table or a stream."""
    kind = F.col("event_type")
    tag = F.when(kind == "view", "receipt").when(kind == "click", "ack").when(kind == "purchase", "message").when(kind == "error", "call").otherwise("presence")
    return events.select(
        F.col("event_id").alias("ord"),
        (F.col("user_id") % 8).alias("session"),
        tag.alias("tag"),
        F.when(kind.isin("click", "purchase"), "outbound").otherwise("inbound").alias("direction"),
        F.get_json_object("props", "$.k").alias("id"),
        F.col("user_id").alias("from_user"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
    )


def stanza_frame(again: bool = False) -> Column:
    """A frame from a row of ``stanzas``; some have attributes that no shape allows.

    ``again``: as another writer would put it, with some times and addresses as text, and some senders lost.
    """
    ord_, tag = F.col("ord"), F.col("tag")
    sender, time = frame.jid(F.col("from_user").cast("string"), SERVER), frame.digits(F.col("t").cast("string"))
    if again:
        written = frame.text(F.concat(F.col("from_user").cast("string"), F.lit(f"@{SERVER}")))
        sender = F.when(ord_ % 31 == 0, F.lit(None).cast("binary")).when(ord_ % 17 == 0, written).otherwise(sender)
        time = F.when(ord_ % 19 == 0, frame.text(F.col("t").cast("string"))).otherwise(time)
    kind = (
        F.when(tag == "message", F.when(ord_ % 3 == 0, "sticker").otherwise("text"))
        .when(tag == "receipt", F.when(ord_ % 5 == 0, "bogus").when(ord_ % 5 < 3, "read"))
    )
    group = F.when(tag == "ack", F.when(ord_ % 4 == 0, "message").when(ord_ % 4 == 1, "receipt").when(ord_ % 4 == 2, "status"))
    error = F.when((tag == "ack") & (ord_ % 8 == 0), "404")
    notice = frame.node("offer_notice", [("call-creator", frame.jid(F.col("from_user").cast("string"), SERVER)), ("call-id", frame.text(F.col("id"))), ("type", frame.token("audio")), ("media", frame.token("audio"))])
    enc = frame.node("enc", [("type", frame.token("msg"))], frame.data(frame.utf8(F.col("ord").cast("string"))))
    inner = F.when((tag == "call") & (ord_ % 2 == 0), F.array(notice)).when(tag == "message", F.transform(F.sequence(F.lit(0), (ord_ % 3).cast("int")), lambda _: enc))
    attrs = [
        ("id", frame.text(F.col("id"))),
        ("from", sender),
        ("t", time),
        ("recipient", F.when((tag == "message") & (ord_ % 2 == 0), frame.jid(F.lit("7"), SERVER))),
        ("offline", F.when((tag == "message") & (ord_ % 4 == 1), frame.token("1"))),
        ("type", frame.text(kind)),
        ("class", frame.text(group)),
        ("error", frame.text(error)),
    ]
    return frame.node(tag, attrs, frame.children(inner))


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stanzas`` and each one's ``frame``."""
    return spread(stanzas(spark, sf_dir)).withColumn("frame", stanza_frame())


def enveloped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stanzas`` and each one's ``envelope``; every seventh was encoded again on its way."""
    rows = framed(spark, sf_dir)
    sealed = envelope.encode(F.col("frame"), outbound=F.col("direction") == "outbound", reencoded=F.col("ord") % 7 == 0)
    return rows.select("ord", "session", "tag", "direction", "id", "from_user", "t", sealed.alias("envelope"))


def turns_status() -> Column:
    role = F.col("role")
    return F.when(role == "system", 3).when((role == "assistant") & (F.col("turn") % 5 == 3), 1).otherwise(0)


def conversation_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, envelope``: a message frame per conversation, its turns as entries at path [turn]."""
    entry = F.struct(
        F.array(F.col("turn").cast("int")).alias("path"),
        F.col("status").alias("status"),
        F.when(F.col("status") == 0, payload.text_message(F.col("text"))).otherwise(F.lit(b"")).alias("payload"),
    )
    rows = table(spark, sf_dir, "conversations").withColumn("status", turns_status())
    grouped = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", entry.alias("entry")))), lambda x: x["entry"]).alias("entries"))
    head = frame.node("message", [("id", frame.text(F.col("conv_id").cast("string")))], frame.children(F.transform(F.col("entries"), lambda e: frame.node("enc", [("type", frame.token("msg"))]))))
    return grouped.select("conv_id", envelope.encode(head, outbound=F.lit(False), reencoded=F.lit(False), entries=F.col("entries")).alias("envelope"))


def document_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, text, payload``: the kind of message follows the language, and wrappers the id."""
    body = frame.utf8(F.col("text"))
    bare = (
        F.when(F.col("lang") == "en", payload.bytes_field(1, body))
        .when(F.col("lang") == "de", payload.bytes_field(6, payload.bytes_field(1, body)))
        .when(F.col("lang") == "fr", payload.bytes_field(3, F.concat(payload.bytes_field(1, F.lit(b"url")), payload.bytes_field(3, body))))
        .otherwise(payload.bytes_field(49, body))
    )
    depth = F.when(F.col("doc_id") % 10 > 6, F.col("doc_id") % 10).otherwise(F.col("doc_id") % 3)
    wrapped = F.aggregate(F.when(depth > 0, F.sequence(F.lit(1), depth.cast("int"))).otherwise(F.array().cast("array<int>")), bare, lambda acc, _: payload.bytes_field(37, payload.bytes_field(1, acc)))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", "text", depth.alias("depth"), wrapped.alias("payload"))


def recordings(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Baseline or candidate: ``recording, ord, direction, reencoded, frame, paths``.

    A recording is a session. The candidate loses the last stanza of sessions 5 on and the outbound half of session 6,
    writes some frames another way, changes some ids, marks and statuses, reads payloads that the baseline
    missed, and has frames with a byte too many and envelopes that are broken.
    """
    rows = spread(stanzas(spark, sf_dir))
    right = side == "right"
    o = F.col("ord")
    if right:
        rows = rows.filter("not (session >= 5 and ord % 97 = 1) and not (session = 6 and direction = 'outbound')")
        rows = rows.withColumn("id", F.when(o % 11 == 0, F.concat(F.col("id"), F.lit("x"))).otherwise(F.col("id")))
    rows = rows.withColumn("frame", stanza_frame(again=right))
    longer = F.when(F.lit(right) & (o % 37 == 0), F.concat(F.col("frame"), F.lit(b"?"))).otherwise(F.col("frame"))
    broken = F.lit(right) & (o % 41 == 0) & (F.col("direction") == "inbound")
    status = F.when(o % 13 == 0, 0 if right else 3).when(o % 17 == 0, 1 if right else 0).when(o % 19 == 0, 2 if right else 1).otherwise(0)
    said = F.concat(F.col("from_user").cast("string"), F.when(F.lit(right) & (o % 23 == 0), "!").otherwise(""))
    entry = F.struct(F.lit("/0").alias("path"), status.alias("status"), F.when(status == 0, said).alias("payload"))
    return rows.select(
        F.col("session").alias("recording"),
        "ord",
        "direction",
        ((o % 7 == 0) | (F.lit(right) & (o % 29 == 0))).alias("reencoded"),
        F.when(~broken, longer).alias("frame"),
        F.when(F.col("tag") == "message", F.array(entry)).otherwise(F.array().cast("array<struct<path: string, status: int, payload: string>>")).alias("paths"),
    )


def producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both sides of each recording declare: ``recording, l_outbound, r_outbound, l_provenance, r_provenance``."""
    k = F.col("recording")
    return (
        stanzas(spark, sf_dir)
        .select(F.col("session").alias("recording"))
        .distinct()
        .select("recording", (k != 3).alias("l_outbound"), (k != 6).alias("r_outbound"), F.lit("a").alias("l_provenance"), F.when(k == 2, "b").otherwise("a").alias("r_provenance"))
    )
