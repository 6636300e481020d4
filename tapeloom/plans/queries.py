"""The registered queries on wire traffic, and the same results as SQL over the source tables.

The SQL never sees bytes: it says from the source columns what must come out, so that an operator
that encodes or decodes wrongly differs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import envelope, frame, payload
from tapeloom.operators import capability, compare, inspect, sequence
from tapeloom.operators.derive import SHAPES, derive, event_equal, with_events
from tapeloom.plans import views
from tapeloom.session import shared_folder
from tapeloom.sources import recording
from tapeloom.streaming.stateful import dedup_stream, join_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}

_W = """w AS (SELECT event_id AS ord, user_id % 8 AS session,
  CASE event_type WHEN 'view' THEN 'receipt' WHEN 'click' THEN 'ack' WHEN 'purchase' THEN 'message' WHEN 'error' THEN 'call' ELSE 'presence' END AS tag,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'outbound' ELSE 'inbound' END AS direction,
  json_extract_string(props, '$.k') AS id, user_id AS from_user, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t FROM events)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames taken from envelopes and parsed: ``ord, session, direction, found``."""
    rows = views.enveloped(spark, sf_dir)
    return rows.select("ord", "session", "direction", frame.nodes(envelope.frame_of(F.col("envelope"))).alias("found"))


# --- decoding ----------------------------------------------------------------


@query(f"WITH {_W} SELECT tag, direction, count(*) AS n FROM w GROUP BY tag, direction")
def tally_by_tag(spark, sf_dir):
    rows = views.enveloped(spark, sf_dir)
    head = envelope.header(F.col("envelope"))
    tag = frame.root(frame.nodes(envelope.frame_of(F.col("envelope"))))["tag"]
    return rows.select(tag.alias("tag"), F.when(head["outbound"], "outbound").otherwise("inbound").alias("direction")).groupBy("tag", "direction").agg(F.count("*").alias("n"))


@query(f"WITH {_W} SELECT ord, 1 AS version, CAST(direction = 'outbound' AS BIGINT) + CASE WHEN ord % 7 = 0 THEN 2 ELSE 0 END AS flags, direction = 'outbound' AS outbound, ord % 7 = 0 AS reencoded, CAST(NULL AS VARCHAR) AS error FROM w")
def envelope_header(spark, sf_dir):
    rows = views.enveloped(spark, sf_dir).select("ord", envelope.header(F.col("envelope")).alias("h"))
    return rows.select("ord", F.col("h.version").cast("int").alias("version"), "h.flags", "h.outbound", "h.reencoded", "h.error")


_STATUS = "CASE WHEN role = 'system' THEN 'unobserved' WHEN role = 'assistant' AND turn % 5 = 3 THEN 'decrypt_failed' ELSE 'ok' END"


@query(f"SELECT conv_id, '/' || turn AS path, {_STATUS} AS status, CASE WHEN {_STATUS} = 'ok' THEN text END AS said FROM conversations")
def entry_explode(spark, sf_dir):
    rows = views.conversation_envelopes(spark, sf_dir).select("conv_id", F.explode(envelope.entries(F.col("envelope"))["entries"]).alias("e"))
    said = payload.content(F.col("e.payload"))["text"]
    return rows.select("conv_id", envelope.path_text(F.col("e.path")).alias("path"), envelope.status_name(F.col("e.status")).alias("status"), said.alias("said"))


@query(f"SELECT conv_id, {_STATUS} AS status, CASE WHEN {_STATUS} = 'ok' THEN sha256(text) END AS digest FROM conversations WHERE turn = 1")
def entry_at_path(spark, sf_dir):
    rows = views.conversation_envelopes(spark, sf_dir).select("conv_id", envelope.at_path(envelope.entries(F.col("envelope"))["entries"], F.array(F.lit(1))).alias("e")).filter("e is not null")
    return rows.select("conv_id", envelope.status_name(F.col("e.status")).alias("status"), F.sha2(payload.content(F.col("e.payload"))["text"], 256).alias("digest"))


@query(f"WITH {_W} SELECT ord, id, from_user || '@s.net' AS sender, t FROM w")
def node_attr_lookup(spark, sf_dir):
    top = frame.root(F.col("found"))
    return parsed(spark, sf_dir).select("ord", frame.attr(top, "id")["text"].alias("id"), frame.attr(top, "from")["text"].alias("sender"), frame.as_int(frame.attr(top, "t")).alias("t"))


@query(f"WITH {_W} SELECT ord, '/' || i AS path, CAST(ord AS VARCHAR) AS body FROM w, unnest(generate_series(0, ord % 3)) AS u(i) WHERE tag = 'message'")
def node_children(spark, sf_dir):
    rows = parsed(spark, sf_dir).select("ord", F.explode(frame.child_nodes(F.col("found"), "enc")).alias("n"))
    return rows.select("ord", envelope.path_text(F.col("n.path")).alias("path"), F.col("n.raw").cast("string").alias("body"))


@query(f"WITH {_W} SELECT tag, count(*) AS stanzas, CAST(sum(CASE WHEN tag = 'message' THEN 2 + ord % 3 WHEN tag = 'call' AND ord % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS nodes, CAST(max(CASE WHEN tag = 'message' OR (tag = 'call' AND ord % 2 = 0) THEN 1 ELSE 0 END) AS INT) AS depth FROM w GROUP BY tag")
def node_table(spark, sf_dir):
    rows = parsed(spark, sf_dir).select("ord", F.explode("found.nodes").alias("n"), frame.root(F.col("found"))["tag"].alias("tag"))
    return rows.groupBy("tag").agg(F.count_if(F.col("n.depth") == 0).alias("stanzas"), F.count("*").alias("nodes"), F.max("n.depth").alias("depth"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def packed_digits(spark, sf_dir):
    one = frame.node("item", [("t", frame.digits(F.col("user_id").cast("string")))])
    rows = views.table(spark, sf_dir, "events").select(frame.nodes(one).alias("found"))
    return rows.select(frame.as_int(frame.attr(frame.root(F.col("found")), "t")).alias("user_id")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_custkey || '@s.net' ELSE c_custkey || ':' || c_custkey % 4 || '@lid' END AS jid FROM customer")
def jid_render(spark, sf_dir):
    user, device = F.col("c_custkey").cast("string"), (F.col("c_custkey") % 4).cast("int")
    value = F.when(device == 0, frame.jid(user, views.SERVER)).otherwise(frame.device_jid(user, device, 1))
    rows = views.table(spark, sf_dir, "customer").select("c_custkey", frame.nodes(frame.node("item", [("from", value)])).alias("found"))
    return rows.select("c_custkey", frame.attr(frame.root(F.col("found")), "from")["text"].alias("jid"))


@query("SELECT 'group' AS kind, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'device', count(*) FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT 'user', count(*) FROM customer WHERE c_custkey % 3 = 2")
def jid_filter(spark, sf_dir):
    user, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 3
    value = F.when(k == 0, frame.jid(user, "g.us")).when(k == 1, frame.device_jid(user, F.lit(2))).otherwise(frame.jid(user, views.SERVER))
    rows = views.table(spark, sf_dir, "customer").select(frame.nodes(frame.node("item", [("from", value)])).alias("found"))
    text = frame.attr(frame.root(F.col("found")), "from")["text"]
    kind = F.when(text.endswith("@g.us"), "group").when(text.rlike(":[1-9][0-9]*@"), "device").otherwise("user")
    return rows.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {_W} SELECT policy, outcome, count(*) AS n FROM (SELECT CASE WHEN tag = 'receipt' AND ord % 5 = 0 THEN 'bogus' WHEN tag = 'receipt' AND ord % 5 < 3 THEN 'read' END AS v FROM w WHERE tag = 'receipt'), (VALUES ('required'), ('optional'), ('or_none')) AS p(policy), LATERAL (SELECT CASE WHEN v = 'read' THEN 'value' WHEN v IS NULL THEN CASE policy WHEN 'required' THEN 'error' ELSE 'none' END ELSE CASE policy WHEN 'or_none' THEN 'none' ELSE 'error' END END AS outcome) GROUP BY ALL")
def enum_policy(spark, sf_dir):
    from tapeloom.operators.derive import RECEIPT_TYPES

    kind = frame.attr(frame.root(F.col("found")), "type")["text"]
    known, none = kind.isin(*RECEIPT_TYPES), kind.isNull()
    outcome = lambda unknown, absent: F.when(none, absent).when(known, "value").otherwise(unknown)
    policies = F.array(*[F.struct(F.lit(p).alias("policy"), outcome(u, a).alias("outcome")) for p, u, a in (("required", "error", "error"), ("optional", "error", "none"), ("or_none", "none", "none"))])
    rows = parsed(spark, sf_dir).filter(frame.root(F.col("found"))["tag"] == "receipt")
    return rows.select(F.inline(policies)).groupBy("policy", "outcome").agg(F.count("*").alias("n"))


# --- payloads ----------------------------------------------------------------


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 6 WHEN 'fr' THEN 3 ELSE 49 END AS number, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents WHERE lang IN ('en', 'es')")
def proto_fields(spark, sf_dir):
    body = F.encode("text", "UTF-8")
    rows = views.table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "es"))
    found = payload.fields(F.when(F.col("lang") == "en", payload.bytes_field(1, body)).otherwise(payload.bytes_field(49, body)))
    return rows.select("doc_id", found.alias("f")).select("doc_id", F.get("f.fields", F.lit(0)).alias("x")).select("doc_id", F.col("x.number").cast("int").alias("number"), F.octet_length("x.raw").cast("bigint").alias("bytes"))


_DEPTH = "CASE WHEN doc_id % 10 > 6 THEN doc_id % 10 ELSE doc_id % 3 END"


@query(f"SELECT CASE WHEN {_DEPTH} > 8 THEN 'unreadable' ELSE CASE lang WHEN 'en' THEN 'conversation' WHEN 'de' THEN 'extended-text' WHEN 'fr' THEN 'image' ELSE 'unmodelled' END END AS kind, count(*) AS n, count(CASE WHEN {_DEPTH} <= 8 AND lang <> 'es' THEN 1 END) AS texts FROM documents GROUP BY kind")
def content_kind(spark, sf_dir):
    rows = views.document_payloads(spark, sf_dir).select(payload.content(F.col("payload")).alias("c"))
    return rows.select(F.when(F.col("c.error").isNotNull(), "unreadable").otherwise(F.col("c.kind")).alias("kind"), F.col("c.text").alias("said")).groupBy("kind").agg(F.count("*").alias("n"), F.count("said").alias("texts"))


@query(f"SELECT doc_id, CASE WHEN {_DEPTH} <= 8 THEN CAST({_DEPTH} AS INT) END AS wrappers, CASE WHEN {_DEPTH} > 8 THEN 'too_deeply_wrapped' END AS error, CASE WHEN {_DEPTH} <= 8 AND lang <> 'es' THEN sha256(text) END AS digest FROM documents")
def unwrap_depth(spark, sf_dir):
    rows = views.document_payloads(spark, sf_dir).select("doc_id", payload.content(F.col("payload")).alias("c"))
    return rows.select("doc_id", F.col("c.wrappers").alias("wrappers"), F.col("c.error").alias("error"), F.sha2("c.text", 256).alias("digest"))


@query(f"WITH {_W} SELECT session, count(*) AS n, count(*) AS checked FROM w GROUP BY session")
def crc_frames(spark, sf_dir):
    """Frame checksums against those of the frames that come out of the envelopes."""
    rows = views.framed(spark, sf_dir).withColumn("crc", F.crc32("frame"))
    sealed = envelope.encode(F.col("frame"), outbound=F.lit(False), reencoded=F.lit(False))
    again = rows.withColumn("back", F.crc32(envelope.frame_of(sealed)))
    return again.groupBy("session").agg(F.count("*").alias("n"), F.count_if(F.col("crc") == F.col("back")).alias("checked"))


# --- derivation --------------------------------------------------------------

_SHAPE = """CASE tag
  WHEN 'ack' THEN CASE WHEN ord % 4 = 0 AND ord % 8 = 0 THEN 'newsletter_response_negative' WHEN ord % 4 = 2 THEN 'newsletter_status_success' WHEN ord % 4 = 1 THEN 'publish_view_success' WHEN ord % 4 = 3 THEN 'message_ack_sync' ELSE 'ack' END
  WHEN 'call' THEN CASE WHEN ord % 2 = 0 THEN 'call_offer_notice' ELSE 'call' END
  WHEN 'message' THEN CASE WHEN ord % 3 <> 0 AND ord % 2 = 0 THEN 'message' WHEN ord % 3 <> 0 AND ord % 4 = 1 THEN 'message_ack_only' END
  WHEN 'receipt' THEN CASE WHEN ord % 5 = 0 THEN 'call_receipt' ELSE 'receipt' END END"""


def derived(spark, sf_dir) -> DataFrame:
    rows = parsed(spark, sf_dir)
    return rows.select("ord", "session", "direction", frame.root(F.col("found"))["tag"].alias("tag"), derive("found").alias("d")).select("ord", "session", "direction", "tag", "d.*")


@query(f"WITH {_W} SELECT ord, {_SHAPE} AS shape FROM w")
def derive_shape(spark, sf_dir):
    return derived(spark, sf_dir).select("ord", "shape")


_TYPED = ("ack", "call", "receipt", "message_ack_only")


@query(f"""WITH {_W}, d AS (SELECT *, {_SHAPE} AS shape FROM w) SELECT ord, shape, CASE WHEN shape IN ('ack', 'call', 'receipt', 'message_ack_only') THEN id END AS id,
CASE WHEN shape IN ('call', 'receipt', 'message', 'message_ack_only', 'call_offer_notice') THEN from_user END AS sender, CASE WHEN shape = 'message' THEN ord % 3 + 1 END AS n_enc, CASE WHEN shape = 'call_offer_notice' THEN 'audio' END AS media, CASE WHEN shape = 'message' AND ord % 3 <> 0 THEN 'text' END AS kind FROM d""")
def derive_fields(spark, sf_dir):
    """Fields of the typed events: text, addresses, children and allowed words."""
    rows = with_events(parsed(spark, sf_dir).select("ord", "found")).select("ord", "shape", "event")
    ids = F.coalesce(*[F.col(f"event.{s}.id.text") for s in _TYPED])
    sender = F.coalesce(*[F.col(f"event.{s}.from.user") for s in ("call", "receipt", "message", "message_ack_only", "call_offer_notice")])
    return rows.select("ord", "shape", ids.alias("id"), sender.cast("bigint").alias("sender"), F.array_size("event.message.enc").cast("bigint").alias("n_enc"), F.col("event.call_offer_notice.offer_notice.media.text").alias("media"), F.col("event.message.type").alias("kind"))


@query(f"WITH {_W} SELECT ord, ord % 31 <> 0 OR tag IN ('ack', 'presence') OR (tag = 'message' AND {_SHAPE} IS NULL) AS equal FROM w")
def semantic_equal(spark, sf_dir):
    """Whether a stanza written another way derives the same event, or the same error."""
    rows = views.spread(views.stanzas(spark, sf_dir)).select("ord", frame.nodes(views.stanza_frame()).alias("a"), frame.nodes(views.stanza_frame(again=True)).alias("b"))
    for m in "ab":
        rows = with_events(rows, m).withColumnsRenamed({"event": f"{m}_event", "error": f"{m}_error"}).drop("shape", m)
    return rows.select("ord", (event_equal("a_event", "b_event") & F.col("a_error").eqNullSafe(F.col("b_error"))).alias("equal"))


@query(f"WITH {_W} SELECT tag, CASE WHEN tag = 'presence' THEN 'unknown_stanza' WHEN {_SHAPE} IS NULL THEN 'no_matching_shape' ELSE 'none' END AS error, count(*) AS n FROM w GROUP BY ALL")
def derive_errors(spark, sf_dir):
    return derived(spark, sf_dir).select("tag", F.coalesce("error", F.lit("none")).alias("error")).groupBy("tag", "error").agg(F.count("*").alias("n"))


@query(f"WITH {_W}, s AS (SELECT DISTINCT {_SHAPE} AS shape FROM w), d(shape) AS (VALUES {', '.join(f'({s.name!r})' for s in SHAPES)}) SELECT shape, shape IN (SELECT shape FROM s WHERE shape IS NOT NULL) AS reached FROM d")
def corpus_coverage(spark, sf_dir):
    """Declared shapes, and whether the traffic reached them; none beyond those declared."""
    declared = spark.sql("SELECT explode(array(" + ", ".join(f"'{s.name}'" for s in SHAPES) + ")) AS shape")
    # A name that no shape has stands for none, so that no null test is pushed below the parser.
    reached = derived(spark, sf_dir).groupBy(F.coalesce("shape", F.lit("")).alias("shape")).agg(F.lit(True).alias("reached"))
    return declared.join(reached, "shape", "full").select("shape", F.coalesce("reached", F.lit(False)).alias("reached")).filter("shape <> ''")


# --- capabilities and filters ------------------------------------------------


@query(f"""WITH {_W} SELECT session, violation, count(*) AS n FROM (SELECT session,
  CASE WHEN session % 4 = 0 AND ord % 7 = 0 THEN 'reencoded_despite_zero_copy' WHEN session % 4 = 1 AND tag = 'message' THEN 'plaintexts_without_capability'
  WHEN session % 4 = 2 AND direction = 'outbound' THEN 'outbound_without_capability' WHEN session % 4 = 3 AND tag = 'message' AND ord % 2 = 1 THEN 'cause_without_capability' ELSE 'none' END AS violation FROM w) GROUP BY ALL""")
def verify_capability(spark, sf_dir):
    every = [c for c in capability.KNOWN]
    lacking = ["", "l0.plaintext", "l0.outbound.observed", "l0.plaintext.cause"]
    sets = [[c for c in every if c != gone and (k == 0 or c != "zero_copy_frame")] for k, gone in enumerate(lacking)]
    declared = spark.sql("SELECT k, c AS capabilities FROM VALUES " + ", ".join(f"({k}, array({', '.join(repr(c) for c in s)}))" for k, s in enumerate(sets)) + " AS d(k, c)")
    rows = views.stanzas(spark, sf_dir).withColumn("k", (F.col("session") % 4).cast("int")).join(F.broadcast(declared), "k")  # four rows
    check = capability.violation(F.col("capabilities"), reencoded=F.col("ord") % 7 == 0, n_plaintexts=(F.col("tag") == "message").cast("int"), outbound=F.col("direction") == "outbound", claims_cause=(F.col("tag") == "message") & (F.col("ord") % 2 == 1))
    return rows.select("session", F.coalesce(check, F.lit("none")).alias("violation")).groupBy("session", "violation").agg(F.count("*").alias("n"))


@query(f"WITH {_W} SELECT ord, tag FROM w WHERE tag IN ('message', 'call')")
def claim_tags(spark, sf_dir):
    return parsed(spark, sf_dir).select("ord", frame.root(F.col("found"))["tag"].alias("tag")).filter(F.col("tag").isin("message", "call"))


# --- aggregates --------------------------------------------------------------


@query(f"WITH {_W} SELECT session, count(*) AS stanzas, count(CASE WHEN ord % 7 = 0 THEN 1 END) AS reencoded, count(CASE WHEN direction = 'inbound' THEN 1 END) AS inbound, count(CASE WHEN direction = 'outbound' THEN 1 END) AS outbound FROM w GROUP BY session")
def counting_sink(spark, sf_dir):
    head = envelope.header(F.col("envelope"))
    rows = views.enveloped(spark, sf_dir).select("session", head.alias("h"))
    return rows.groupBy("session").agg(F.count("*").alias("stanzas"), F.count_if("h.reencoded").alias("reencoded"), F.count_if(~F.col("h.outbound")).alias("inbound"), F.count_if("h.outbound").alias("outbound"))


@query(f"WITH {_W} SELECT tag, count(*) FILTER (direction = 'inbound') AS inbound, count(*) FILTER (direction = 'outbound') AS outbound, count(*) FILTER (direction = 'inbound') <> count(*) FILTER (direction = 'outbound') AS differs FROM w GROUP BY tag")
def direction_pivot(spark, sf_dir):
    rows = views.stanzas(spark, sf_dir).groupBy("tag").pivot("direction", ["inbound", "outbound"]).count().na.fill(0, ["inbound", "outbound"])
    return rows.withColumn("differs", F.col("inbound") != F.col("outbound"))


@query(f"SELECT {_STATUS} AS status, count(*) AS n FROM conversations GROUP BY ALL")
def status_counts(spark, sf_dir):
    rows = views.conversation_envelopes(spark, sf_dir).select(F.explode(envelope.entries(F.col("envelope"))["entries"]).alias("e"))
    return rows.groupBy(envelope.status_name(F.col("e.status")).alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {_W} SELECT session, tag, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM w GROUP BY session, tag")
def legs_histogram(spark, sf_dir):
    return views.stanzas(spark, sf_dir).groupBy("session", "tag").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("SELECT lang, count(*) AS n, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, max(n_chars) AS most FROM documents GROUP BY lang")
def shape_percentiles(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.percentile("n_chars", 0.5).alias("p50"), F.percentile("n_chars", 0.9).alias("p90"), F.max("n_chars").alias("most"))


@query("SELECT user_id, count(*) AS calls, count(DISTINCT event_type) AS methods, round(count(*) / 2.0, 2) AS ratio FROM events GROUP BY user_id")
def calls_per_key(spark, sf_dir):
    return views.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.countDistinct("event_type").alias("methods"), F.round(F.count("*") / 2, 2).alias("ratio"))


# --- order -------------------------------------------------------------------


@query(f"WITH {_W} SELECT ord, CASE WHEN id IS NULL OR octet_length(encode(id)) > 64 THEN 'untracked' WHEN row_number() OVER (PARTITION BY session, tag, id ORDER BY ord) = 1 THEN 'new' ELSE 'duplicate' END AS admission FROM w")
def dedup_first_seen(spark, sf_dir):
    return sequence.first_seen(views.stanzas(spark, sf_dir)).select("ord", "admission")


@query()
def dedup_window64(spark, sf_dir):
    return sequence.bounded_dedup(views.stanzas(spark, sf_dir)).select("session", "ord", "admission")


def _held(spark, sf_dir) -> DataFrame:
    """Messages of each session wait for one payload per enc child; ``ord`` counts the session's stanzas."""
    rows = sequence.running(views.stanzas(spark, sf_dir), ["session"], "ord", "place", F.lit(1))
    waiting = rows.filter("tag = 'message'").select("session", F.col("place").alias("ord"), "id", "from_user", F.explode(F.sequence(F.lit(0), (F.col("ord") % 3).cast("int"))).alias("slot"))
    return waiting


def _payloads(spark, sf_dir) -> DataFrame:
    """Each waiting slot's payload comes some stanzas later, at times too late."""
    late = F.col("from_user") % 90
    return _held(spark, sf_dir).select("session", (F.col("ord") + late).alias("at"), "id", "slot", F.concat_ws("-", F.col("from_user").cast("string"), "slot").alias("payload"))


_JOIN = f"""{_W}, p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord) AS place FROM w),
h AS (SELECT session, place AS ord, id, from_user, CAST(slot AS INT) AS slot FROM p, unnest(generate_series(0, ord % 3)) AS u(slot) WHERE tag = 'message'),
s AS (SELECT session, id, ord, least(coalesce(lead(ord) OVER (PARTITION BY session, id ORDER BY ord) - 1, ord + 64), ord + 64) AS until FROM (SELECT DISTINCT session, id, ord FROM h)),
come AS (SELECT session, ord + from_user % 90 AS at, id, slot, from_user || '-' || slot AS payload FROM h),
m AS (SELECT c.session, c.id, s.ord, c.slot, c.at, c.payload, row_number() OVER (PARTITION BY c.session, c.id, s.ord, c.slot ORDER BY c.at, c.payload) AS k FROM come c JOIN s ON c.session = s.session AND c.id = s.id AND c.at BETWEEN s.ord AND s.until),
j AS (SELECT h.session, h.ord, h.slot, m.payload, m.at AS done_at, CASE WHEN m.at IS NULL THEN 'unobserved' ELSE 'ok' END AS status FROM h LEFT JOIN m ON h.session = m.session AND h.id = m.id AND h.ord = m.ord AND h.slot = m.slot AND m.k = 1)"""


@query(f"WITH {_JOIN} SELECT * FROM j")
def joiner_batch(spark, sf_dir):
    return sequence.join_payloads(_held(spark, sf_dir), _payloads(spark, sf_dir)).select("session", F.col("ord").cast("bigint").alias("ord"), "slot", "payload", "done_at", "status")


@query(f"WITH {_JOIN}, d AS (SELECT session, ord, CASE WHEN count(*) = count(done_at) THEN max(done_at) ELSE ord + 65 END AS done FROM j GROUP BY session, ord) SELECT session, ord, max(done) OVER (PARTITION BY session ORDER BY ord ROWS UNBOUNDED PRECEDING) AS emitted_at FROM d")
def joiner_order(spark, sf_dir):
    joined = sequence.join_payloads(_held(spark, sf_dir), _payloads(spark, sf_dir))
    done = joined.groupBy("session", "ord").agg(F.when(F.count("*") == F.count("done_at"), F.max("done_at")).alias("done_at"))
    return sequence.emission_order(done).select("session", F.col("ord").cast("bigint").alias("ord"), "emitted_at")


@query(f"WITH {_W} SELECT ord, t % 1000 >= coalesce(max(t % 1000) OVER (PARTITION BY session ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS admitted FROM w")
def fence_admit(spark, sf_dir):
    rows = views.stanzas(spark, sf_dir).withColumn("token", F.col("t") % 1000)
    return sequence.fence(rows, "session", "ord", "token").select("ord", "admitted")


@query(f"WITH {_W} SELECT ord, count(*) OVER (PARTITION BY session ORDER BY ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS age FROM w")
def ageing_counter(spark, sf_dir):
    return sequence.stanzas_since(views.stanzas(spark, sf_dir)).select("ord", "age")


# --- comparison --------------------------------------------------------------

_SIDE = """SELECT session AS recording, ord, direction, ord % 7 = 0 {re} AS reencoded, tag, tag = 'message' AS has, {shape} AS shape,
 CASE WHEN NOT ({broken}) THEN tag || '|' || {id} || '|' || {sender} || '|' || from_user || '|' || t || '|' || {time} || '|' || ord || '|' || ({longer}) END AS frame, {id} AS id, {longer} AS bad, {broken} AS broken,
 CASE WHEN ord % 13 = 0 THEN {a} WHEN ord % 17 = 0 THEN {b} WHEN ord % 19 = 0 THEN {c} ELSE 0 END AS status, from_user || {said} AS said FROM w"""
_LOST = f"CASE WHEN ord % 31 <> 0 OR tag = 'ack' THEN {_SHAPE} WHEN tag = 'call' THEN 'call_placeholder' END"
_L = _SIDE.format(re="", id="id", a=3, b=0, c=1, said="''", shape=_SHAPE, broken="false", sender="'j'", time="'d'", longer="false")
_R = _SIDE.format(
    re="OR ord % 29 = 0", id="CASE WHEN ord % 11 = 0 THEN id || 'x' ELSE id END", a=0, b=1, c=2, said="CASE WHEN ord % 23 = 0 THEN '!' ELSE '' END", shape=_LOST, broken="ord % 41 = 0 AND direction = 'inbound'",
    sender="CASE WHEN ord % 31 = 0 THEN 'n' WHEN ord % 17 = 0 THEN 'w' ELSE 'j' END", time="CASE WHEN ord % 19 = 0 THEN 'w' ELSE 'd' END", longer="ord % 37 = 0",
) + " WHERE NOT (session >= 5 AND ord % 97 = 1) AND NOT (session = 6 AND direction = 'outbound')"
_PAIRS = f"""{_W},
l AS (SELECT *, row_number() OVER (PARTITION BY recording, direction ORDER BY ord) - 1 AS position, count(*) OVER (PARTITION BY recording, direction) AS n FROM ({_L})),
r AS (SELECT *, row_number() OVER (PARTITION BY recording, direction ORDER BY ord) - 1 AS position, count(*) OVER (PARTITION BY recording, direction) AS n FROM ({_R})),
p AS (SELECT coalesce(l.recording, r.recording) AS recording, coalesce(l.direction, r.direction) AS direction, coalesce(l.position, r.position) AS position, l.ord AS l_ord, r.ord AS r_ord, l.n AS ln, r.n AS rn, l.frame AS lf, r.frame AS rf, l.reencoded AS lo, r.reencoded AS ro, l.shape AS ls, r.shape AS rs, l.id AS li, r.id AS ri, l.bad AS lb, r.bad AS rb, l.broken AS lx, r.broken AS rx,
  l.has AS lh, r.has AS rh, l.status AS lt, r.status AS rt, l.said AS lp, r.said AS rp
  FROM l FULL JOIN r ON l.recording = r.recording AND l.direction = r.direction AND l.position = r.position)"""


@query(f"WITH {_PAIRS} SELECT recording, direction, position, l_ord, r_ord FROM p")
def positional_compare(spark, sf_dir):
    pairs = compare.aligned(views.recordings(spark, sf_dir, "left"), views.recordings(spark, sf_dir, "right"))
    return pairs.select("recording", "direction", F.col("position").cast("bigint").alias("position"), "l_ord", "r_ord")


# Shapes with a field that says the id: only there does another id make another event.
_IDS = "('ack', 'call_offer_notice', 'call', 'message_ack_only', 'receipt', 'call_receipt')"
_FINDINGS = (
    f"WITH {_PAIRS}, a AS (SELECT recording, direction, count(l_ord) AS l, count(r_ord) AS r FROM p GROUP BY ALL), x AS (SELECT * FROM p WHERE ln = rn), q AS (SELECT * FROM x WHERE NOT lx AND NOT rx), "
    f"""f(recording, direction, layer, kind, position, side, path, only_left, only_right, worse) AS (SELECT recording, direction, 'L0', 'length', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), l, r, false FROM a WHERE l <> r AND NOT (recording = 6 AND direction = 'outbound')
UNION ALL SELECT recording, direction, 'L0', 'undeclared_direction', NULL, 'left', NULL, NULL, NULL, false FROM a WHERE recording = 3 AND direction = 'outbound' AND l > 0
UNION ALL SELECT recording, direction, 'L0', 'direction_coverage', NULL, NULL, NULL, l, r, l > 0 FROM a WHERE recording IN (3, 6) AND direction = 'outbound' AND l <> r
UNION ALL SELECT DISTINCT recording, NULL, 'L1', 'provenance', CAST(NULL AS BIGINT), NULL, NULL, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false FROM a WHERE recording = 2
UNION ALL SELECT recording, direction, 'L0', 'malformed_envelope', position, 'right', NULL, NULL, NULL, true FROM x WHERE rx
UNION ALL SELECT recording, direction, 'L0', 'frame', position, NULL, NULL, NULL, NULL, false FROM q WHERE lf <> rf
UNION ALL SELECT recording, direction, 'L0', 'frame_origin', position, NULL, NULL, NULL, NULL, ro FROM q WHERE lo <> ro
UNION ALL SELECT recording, direction, 'L0', 'plaintext', position, NULL, '/0', NULL, NULL, false FROM q WHERE lh AND lt = 0 AND rt = 0 AND lp <> rp
UNION ALL SELECT recording, direction, 'L0', 'plaintext_coverage', position, NULL, NULL, CAST(lt = 0 AS BIGINT), CAST(rt = 0 AS BIGINT), lt = 0 FROM q WHERE lh AND (lt = 0) <> (rt = 0)
UNION ALL SELECT recording, direction, 'L0', 'plaintext_status', position, NULL, '/0', NULL, NULL, false FROM q WHERE lh AND lt <> 0 AND rt <> 0 AND lt <> rt
UNION ALL SELECT recording, direction, 'L0', 'unparsable_frame', position, s, NULL, NULL, NULL, s = 'right' FROM q, (VALUES ('left'), ('right')) AS v(s) WHERE CASE s WHEN 'left' THEN lb ELSE rb END
UNION ALL SELECT recording, direction, 'L1', 'derivation', position, NULL, NULL, NULL, NULL, false FROM q WHERE NOT lb AND NOT rb AND (ls <> rs OR ls = rs AND ls IN {_IDS} AND li <> ri)
UNION ALL SELECT recording, direction, 'L1', 'derivation_outcome', position, NULL, NULL, NULL, NULL, false FROM q WHERE NOT lb AND NOT rb AND (ls IS NULL) <> (rs IS NULL))"""
)
_BAD = "kind NOT IN ('plaintext_coverage', 'frame_origin', 'direction_coverage', 'provenance') OR kind <> 'provenance' AND worse"
_BAD_INTEROP = "kind NOT IN ('plaintext_coverage', 'frame_origin', 'direction_coverage', 'provenance', 'frame', 'plaintext_status')"


def _found(spark, sf_dir) -> DataFrame:
    return compare.findings(views.recordings(spark, sf_dir, "left"), views.recordings(spark, sf_dir, "right"), views.producers(spark, sf_dir))


@query(f"{_FINDINGS} SELECT * FROM f")
def divergences(spark, sf_dir):
    return _found(spark, sf_dir)


@query(f"{_FINDINGS} SELECT 'interop' AS profile, count(*) AS n_findings, count(*) FILTER ({_BAD_INTEROP}) AS n_failures, CASE WHEN count(*) FILTER ({_BAD_INTEROP}) > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM f")
def verdict_interop(spark, sf_dir):
    return compare.verdict(_found(spark, sf_dir), "interop")


@query(f"{_FINDINGS} SELECT 'regression' AS profile, count(*) AS n_findings, count(*) FILTER ({_BAD}) AS n_failures, CASE WHEN count(*) FILTER ({_BAD}) > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM f")
def verdict_regression(spark, sf_dir):
    return compare.verdict(_found(spark, sf_dir), "regression")


@query(f"""{_FINDINGS}, c AS (SELECT recording, count(*) AS n_findings, count(*) FILTER ({_BAD_INTEROP}) AS n_failures FROM f GROUP BY recording), d AS (SELECT DISTINCT recording, CASE WHEN recording = 4 THEN 'different_input' END AS reason FROM a)
SELECT d.recording, coalesce(n_findings, 0) AS n_findings, coalesce(n_failures, 0) AS n_failures, reason, CASE WHEN reason IS NOT NULL THEN 'incomparable' WHEN n_failures > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM d LEFT JOIN c ON c.recording = d.recording""")
def verdict_by_recording(spark, sf_dir):
    """A verdict per recording; one pair was made from different input."""
    k = F.col("recording")
    side = lambda m, digest: {f"{m}declared": F.lit(True), f"{m}input_digest": digest, f"{m}unknown_critical": F.lit(0), f"{m}skipped": F.lit(0), f"{m}whole": F.lit(True), f"{m}artifact_class": F.lit("replayed"), f"{m}transform": F.lit(None).cast("string"), f"{m}dictionary": F.lit("x")}
    made = views.producers(spark, sf_dir).withColumns(side("l_", F.lit("d")) | side("r_", F.when(k == 4, "e").otherwise("d")))
    return compare.verdicts(_found(spark, sf_dir), "interop", made.select("recording", compare.incomparable("l_", "r_").alias("reason")))


@query(f"{_FINDINGS} SELECT recording, kind, count(*) FILTER (worse) AS worse, count(*) FILTER (kind IN ('plaintext_coverage', 'frame_origin') AND NOT worse) AS improved, count(*) AS n FROM f GROUP BY recording, kind")
def plaintext_coverage(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("recording", "kind").agg(F.count_if("worse").alias("worse"), F.count_if(compare.improves()).alias("improved"), F.count("*").alias("n"))


@query(f"{_FINDINGS} SELECT * REPLACE (position AS position), (SELECT count(*) FROM f) - 20 AS remaining FROM f ORDER BY recording, direction NULLS FIRST, layer, kind, position, path, side LIMIT 20")
def top_findings(spark, sf_dir):
    path = f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    _found(spark, sf_dir).write.parquet(path)  # they are read twice, for the first and for their number
    return compare.top_findings(spark.read.parquet(path), 20)


@query(f"WITH {_W} SELECT count(*) - count(*) AS n_findings, 'pass' AS verdict FROM w")
def replay_self(spark, sf_dir):
    same = views.recordings(spark, sf_dir, "left")
    return compare.verdict(compare.findings(same, same), "regression").select("n_findings", "verdict")


_META = "SELECT c_custkey AS k, c_custkey % 19 <> 0 AS declared, CASE WHEN c_custkey % 9 <> 0 THEN 'd' || c_custkey // 40 % 2 END AS input_digest, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS unknown_critical, CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 0 END AS skipped, c_custkey % 17 <> 0 AS whole, CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 2 THEN 'captured' ELSE 'sanitized' END AS artifact_class, CASE WHEN c_custkey // 16 % 3 > 0 THEN 't' || c_custkey // 16 % 3 END AS transform, 'x' || c_custkey // 5 % 7 AS dictionary FROM customer"


@query(f"""WITH m AS ({_META}) SELECT l.k, CASE WHEN NOT l.declared AND NOT r.declared THEN NULL WHEN l.declared <> r.declared THEN 'undeclared_input' WHEN greatest(l.unknown_critical, r.unknown_critical) > 0 THEN 'unknown_critical_tag'
 WHEN greatest(l.skipped, r.skipped) > 0 THEN 'skipped_record' WHEN NOT (l.whole AND r.whole) THEN 'not_whole' WHEN l.input_digest || r.input_digest IS NULL THEN 'undeclared_input' WHEN l.input_digest <> r.input_digest THEN 'different_input'
 WHEN l.artifact_class || r.artifact_class IS NULL THEN 'undeclared_artifact_class' WHEN l.artifact_class <> r.artifact_class THEN 'different_artifact_class' WHEN l.artifact_class = 'sanitized' AND coalesce(l.transform <> r.transform, true) THEN 'different_transform'
 WHEN l.dictionary <> r.dictionary THEN 'different_dictionary' END AS reason FROM m l JOIN m r ON r.k = l.k + 2""")
def incomparable_reason(spark, sf_dir):
    k = F.col("c_custkey")
    step = lambda n, m: F.floor(k / n) % m
    meta = views.table(spark, sf_dir, "customer").select(
        k.alias("k"),
        (k % 19 != 0).alias("declared"),
        F.when(k % 9 != 0, F.concat(F.lit("d"), step(40, 2).cast("string"))).alias("input_digest"),
        F.when(k % 11 == 0, 1).otherwise(0).alias("unknown_critical"),
        F.when(k % 13 == 0, 2).otherwise(0).alias("skipped"),
        (k % 17 != 0).alias("whole"),
        F.when(k % 8 == 2, "captured").when(k % 8 != 0, "sanitized").alias("artifact_class"),
        F.when(step(16, 3) > 0, F.concat(F.lit("t"), step(16, 3).cast("string"))).alias("transform"),
        F.concat(F.lit("x"), step(5, 7).cast("string")).alias("dictionary"),
    )
    right = meta.select((F.col("k") - 2).alias("k"), *[F.col(c).alias(f"r_{c}") for c in meta.columns if c != "k"])
    left = meta.select("k", *[F.col(c).alias(f"l_{c}") for c in meta.columns if c != "k"])
    return left.join(right, "k").select("k", compare.incomparable("l_", "r_").alias("reason"))


@query(f"WITH {_W}, s AS (SELECT session, tag, count(*) AS n FROM w GROUP BY session, tag) SELECT a.session AS left_engine, b.session AS right_engine, count(*) AS tags, count(*) FILTER (a.n <> b.n) AS differing FROM s a JOIN s b ON a.tag = b.tag AND a.session < b.session GROUP BY ALL")
def all_pairs(spark, sf_dir):
    """Every two engines once, on counts that are already aggregated: few rows, and they don't grow."""
    counts = views.stanzas(spark, sf_dir).groupBy("session", "tag").agg(F.count("*").alias("n"))
    a, b = counts.alias("a"), counts.alias("b")
    pairs = a.join(b, (F.col("a.tag") == F.col("b.tag")) & (F.col("a.session") < F.col("b.session")))
    return pairs.groupBy(F.col("a.session").alias("left_engine"), F.col("b.session").alias("right_engine")).agg(F.count("*").alias("tags"), F.count_if(F.col("a.n") != F.col("b.n")).alias("differing"))


# --- stores ------------------------------------------------------------------


def _stores(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    left = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    k = F.col("key")
    right = left.filter(k % 10 != 3).withColumn("name", F.when(k % 7 == 0, F.upper("name")).otherwise(F.col("name"))).withColumn("segment", F.when(k % 8 != 1, F.col("segment")))
    extra = left.filter(k % 50 == 0).withColumn("key", -k)
    return left, right.unionByName(extra)


@query("""WITH l AS (SELECT c_custkey AS key, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer),
r AS (SELECT key, CASE WHEN key % 7 = 0 THEN upper(name) ELSE name END AS name, nation, CASE WHEN key % 8 <> 1 THEN segment END AS segment FROM l WHERE key % 10 <> 3 UNION ALL SELECT -key, name, nation, segment FROM l WHERE key % 50 = 0),
lu AS (SELECT key, 'name' AS field, name AS v FROM l UNION ALL SELECT key, 'nation', nation FROM l UNION ALL SELECT key, 'segment', segment FROM l),
ru AS (SELECT key, 'name' AS field, name AS v FROM r UNION ALL SELECT key, 'nation', nation FROM r UNION ALL SELECT key, 'segment', segment FROM r)
SELECT coalesce(lu.key, ru.key) AS key, coalesce(lu.field, ru.field) AS field, lu.v AS "left", ru.v AS "right", CASE WHEN lu.key IS NULL THEN 'added' WHEN ru.key IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM lu FULL JOIN ru ON lu.key = ru.key AND lu.field = ru.field WHERE lu.key IS NULL OR ru.key IS NULL OR lu.v IS DISTINCT FROM ru.v""")
def store_diff(spark, sf_dir):
    return compare.table_diff(*_stores(spark, sf_dir), ["key"])


@query("WITH c AS (SELECT c_custkey % 8 AS device, c_custkey AS key FROM customer) SELECT device, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM c WHERE NOT (device < 4 AND key % 2 = 0) GROUP BY device")
def store_replace(spark, sf_dir):
    """Devices below 4 get a new snapshot of their odd keys; it replaces all that they had."""
    rows = views.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 8).alias("device"), F.col("c_custkey").alias("key"))
    snapshot = rows.filter("device < 4 and key % 2 = 1")
    named = rows.select("device").filter("device < 4").distinct()
    kept = rows.join(named, "device", "left_anti").unionByName(snapshot)
    return kept.groupBy("device").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("SELECT CAST(k AS BIGINT) AS address, bool_or(seeded) AS seeded, count(*) AS sightings FROM (SELECT c_custkey AS k, true AS seeded FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT user_id, false FROM events) GROUP BY k HAVING k IN (SELECT c_custkey FROM customer)")
def harvest_addresses(spark, sf_dir):
    store = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address"))
    seeded = store.filter("address % 2 = 0").withColumn("seeded", F.lit(True))
    seen = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("address"), F.lit(False).alias("seeded"))
    found = seeded.unionByName(seen).groupBy("address").agg(F.bool_or("seeded").alias("seeded"), F.count("*").alias("sightings"))
    return found.join(store, "address", "left_semi")


# --- containers and streams --------------------------------------------------


@query(f"WITH {_W} SELECT session, 'complete' AS integrity, count(*) + 1 AS found, count(*) + 1 AS claimed, 1 AS skipped, 'baseline' AS note FROM w GROUP BY session")
def recording_round_trip(spark, sf_dir):
    """Each session as a recording, with one record of an unknown kind; written, read back and walked."""
    rows = views.enveloped(spark, sf_dir).select(F.col("session").alias("recording"), "ord", F.lit(0).alias("kind"), F.col("envelope").alias("payload"))
    odd = rows.groupBy("recording").agg((F.max("ord") + 1).alias("ord")).select("recording", "ord", F.lit(9).alias("kind"), F.lit(b"?").alias("payload"))
    path = f"{shared_folder(spark)}/recordings-{uuid.uuid4().hex}"
    recording.write_recordings(rows.unionByName(odd), path, {"note": b"baseline"})
    back = recording.states(recording.read_tables(spark, path, kept=False))
    return back.select(F.col("path").cast("bigint").alias("session"), "integrity", "found", "claimed", F.col("skipped").cast("int").alias("skipped"), recording.digest_text(recording.meta_value(F.col("meta"), "note")).alias("note"))


_INSPECTED = f"""c AS (SELECT conv_id // 50 AS recording, conv_id, conv_id % 10 = 3 AS bad, {_STATUS} AS status FROM conversations),
i AS (SELECT recording, count(DISTINCT conv_id) AS envelopes, count(DISTINCT conv_id) FILTER (NOT bad) AS inbound, count(*) FILTER (NOT bad AND status = 'ok') AS ok,
 count(*) FILTER (NOT bad AND status = 'decrypt_failed') AS decrypt_failed, count(*) FILTER (NOT bad AND status = 'unobserved') AS unobserved, count(DISTINCT conv_id) FILTER (bad) AS undecodable FROM c GROUP BY recording)"""


def _inspected(spark, sf_dir) -> DataFrame:
    """Conversations as recordings of 50 each, every tenth envelope with a byte too many; written, walked and counted."""
    o, sealed = F.col("conv_id"), F.col("envelope")
    longer = F.when(o % 10 == 3, F.concat(sealed, F.lit(b"?"))).otherwise(sealed)
    rows = views.conversation_envelopes(spark, sf_dir).select(F.floor(o / 50).alias("recording"), o.alias("ord"), F.lit(0).alias("kind"), longer.alias("payload"))
    path = f"{shared_folder(spark)}/inspected-{uuid.uuid4().hex}"
    recording.write_recordings(rows, path, {"note": b"calls"})
    return inspect.inspect(recording.read_tables(spark, path))


@query(f"WITH {_INSPECTED} SELECT recording, envelopes, inbound, 0 AS outbound, ok, decrypt_failed, 0 AS unsupported, unobserved, undecodable, CASE WHEN ok > 0 THEN 'conversation ' || ok ELSE '' END AS content FROM i")
def inspect_recordings(spark, sf_dir):
    """What each recording holds: directions, states of entries, kinds of payloads, envelopes that don't decode."""
    kinds = F.array_join(F.transform("content", lambda c: F.concat(c["kind"], F.lit(" "), c["n"].cast("string"))), ", ")
    return _inspected(spark, sf_dir).select(F.col("path").cast("bigint").alias("recording"), *inspect.COUNTS, kinds.alias("content"))


@query(f"""WITH {_INSPECTED}, l AS (SELECT recording, [ '  note          calls', '  integrity     complete: count and checksum both hold', '  envelopes     ' || envelopes || ': ' || inbound || ' inbound, 0 outbound',
 CASE WHEN ok + decrypt_failed + unobserved > 0 THEN '  plaintexts    ' || (ok + decrypt_failed + unobserved) || ': ' || ok || ' ok, ' || decrypt_failed || ' decrypt-failed, 0 unsupported, ' || unobserved || ' unobserved' END,
 CASE WHEN undecodable > 0 THEN '  unreadable    ' || undecodable || ' envelopes did not decode' END, CASE WHEN ok > 0 THEN '  content       conversation ' || ok END] AS texts FROM i), u AS (SELECT recording, k, texts[k] AS text FROM (SELECT *, unnest(generate_series(1, len(texts))) AS k FROM l))
SELECT recording, CAST(row_number() OVER (PARTITION BY recording ORDER BY k) - 1 AS INT) AS line, text FROM u WHERE text IS NOT NULL""")
def inspect_report(spark, sf_dir):
    """The same as a report in lines."""
    return inspect.report(_inspected(spark, sf_dir)).select(F.col("path").cast("bigint").alias("recording"), "line", "text")


def _drained(spark, made: DataFrame, name: str) -> DataFrame:
    """All that a stream of the table gives, through a Parquet sink in the shared folder."""
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = made.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{base}/out")


def _stream(spark):
    """A reader of streams; stateful operators need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark.readStream


def _streamed(spark, sf_dir, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    # As a pattern, since a stream's plain path must be a folder and a table may be one file.
    return _stream(spark).schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


@query(SQL["dedup_first_seen"].replace("SELECT ord, CASE", "SELECT session, ord, CASE"))
def stream_dedup(spark, sf_dir):
    """The stream of events through the stateful form, with a window that no session fills."""
    rows = views.stanza_rows(_streamed(spark, sf_dir, "events"))
    return _drained(spark, dedup_stream(rows, 1 << 30), "dedup")


@query(f"""WITH {_W}, p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord) AS place, count(*) OVER (PARTITION BY session) AS n FROM w),
m AS (SELECT *, ord % 3 <> 0 AND (ord % 7 <> 0 OR n - place <= 64) AS came FROM p WHERE tag = 'message')
SELECT session, place AS ord, 0 AS slot, CASE WHEN came THEN CAST(from_user AS VARCHAR) END AS payload, CASE WHEN came THEN 'ok' ELSE 'unobserved' END AS status FROM m""")
def stream_joiner(spark, sf_dir):
    """All stanzas of each session and the payloads of its messages, as a folder of files that is read as a stream.

    A payload comes right behind its message; every third never comes, and of the others every seventh comes 70 stanzas
    later, when a message no longer waits unless the session has ended. A flush ends each session, in files of its own, later than
    all others.
    """
    rows = sequence.running(views.stanzas(spark, sf_dir), ["session"], "ord", "place", F.lit(1))
    o, place, message = F.col("ord"), F.col("place").cast("bigint"), F.col("tag") == "message"
    none = lambda kind: F.lit(None).cast(kind)

    def event(name: str, at: Column, **more: Column) -> Column:
        kinds = {"ord": "bigint", "id": "string", "slots": "int", "slot": "int", "payload": "string"}
        return F.struct(at.cast("bigint").alias("arrival"), F.lit(name).alias("event"), *[more.get(c, none(t)).cast(t).alias(c) for c, t in kinds.items()])

    frames = event("frame", place * 2, ord=place, id=o, slots=F.when(message, 1).otherwise(0))
    payloads = event("payload", (place + F.when(o % 7 == 0, 70).otherwise(0)) * 2 + 1, id=o, slot=F.lit(0), payload=F.col("from_user"))
    line = rows.select("session", F.explode(F.when(message & (o % 3 != 0), F.array(frames, payloads)).otherwise(F.array(frames))).alias("x")).select("session", "x.*")
    path = f"{shared_folder(spark)}/timeline-{uuid.uuid4().hex}"
    line.write.parquet(path)
    last = event("flush", F.lit((1 << 63) - 1))
    rows.select("session").distinct().select("session", last.alias("x")).select("session", "x.*").write.mode("append").parquet(path)
    return _drained(spark, join_stream(_stream(spark).schema(line.schema).parquet(path), 64), "join")
