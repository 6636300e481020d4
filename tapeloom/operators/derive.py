"""Typed events from nodes: an ordered table of shapes per tag; the first whose rules hold wins.

A shape is a line of fields. ``name`` is an attribute of that name, ``name=key`` one of another; ``!`` asks for it.
Without a type it is a value as it came; ``:int``, ``:jid`` and ``:<set>`` are read, ``@bytes``, ``@uint`` and ``@text`` are
the node's own body. ``name{...}`` is the first child of that tag, ``name!{...}`` one that must be there, ``name?{...}`` one
that is left out if its fields don't hold, and ``name*{...}`` all children of the tag, each with its value or
its error. A field that is there but malformed rejects its shape, optional or not.

The table becomes one expression: a struct per shape, of which one is filled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.frame import JID, VALUE
from tapeloom.operators.values import jid_equal_sql, value_equal_sql

# What the enumerated attributes allow, and the fields of each shape.
SETS = {
    "message": "text media medianotify pay poll reaction event",
    "receipt": "delivery read played inactive server-error sender read-self played-self peer_msg",
    "cipher": "skmsg pkmsg msg msmsg",
    "level": "high low unknown",
    "poll": "creation quiz_creation vote result_snapshot edit",
    "event": "creation response edit",
    "origin": "ctwa",
    "appdata": "default member_tag group_history",
    "readers": "all none",
    "edit": "0 1 7",
    "pricing": "CBP NBP PMP",
    "flag": "false true",
    "pricing_type": "free_customer_service free_entry_point regular",
}
_BOT = "bot{sender_timestamp_ms edit_target_id edit biz_bot type}"
_TAGGED = "franking{reporting_tag{element_value@bytes}} biz?{paid_convo_id! pricing_model:<pricing>! billable:<flag>! expiration_timestamp:int pricing_category pricing_type:<pricing_type>}"
#: (tag, name, guard, fields) in the order of dispatch.
TABLE = (
    ("ack", "newsletter_response_negative", ("class", "message"), f"error! class! t:int! edit application_error:int backoff:int {_TAGGED}"),
    ("ack", "newsletter_status_negative", ("class", "status"), "error! class! t:int! edit application_error:int backoff:int"),
    ("ack", "newsletter_status_success", ("class", "status"), "server_id:int class! t:int! edit"),
    ("ack", "publish_view_success", ("class", "receipt"), "class! t:int readreceipts:<readers> edit:<edit>"),
    ("ack", "ack", None, "id! t class! type participant:jid recipient:jid"),
    ("ack", "message_ack_sync", None, "t:int! sync phash refresh_lid addressing_mode count:int error:int"),
    ("ack", "read_receipt_ack", None, "readreceipts:<readers>"),
    ("call", "call_offer_notice", None, "id! from:jid! offer_notice!{call_creator=call-creator:jid! call_id=call-id! type! media!} t:int!"),
    ("call", "call", None, "from:jid! sender_lid:jid platform version t:int e:int id!"),
    ("call", "call_placeholder", None, "t:int"),
    (
        "message",
        "message",
        None,
        "plaintext{} enc*{type:<cipher>! mediatype content@bytes! count:int decrypt_fail=decrypt-fail state session_type} "
        f"device_identity=device-identity{{content@bytes!}} {_BOT} from:jid! participant:jid unavailable{{hosted type}} type:<message>! "
        "meta{polltype:<poll> status_mentioned origin:<origin> appdata:<appdata> thread_msg_id thread_msg_sender_jid:jid target_id target_sender_jid:jid target_chat_jid:jid "
        "target_chat_jid_lid:jid from:jid capi event_type:<event> context_source read is_group_status session_scope type st:int key{rkid content@bytes!}} "
        "t:int! verified_name{content@bytes!} verified_level:<level> verified_name_attr=verified_name:int biz{actual_actors:int host_storage:int privacy_mode_ts:int native_flow_name campaign_id} "
        "pay{} transaction{} recipient! hsm{tag category} reporting{reporting_token{content@bytes! v:int!} reporting_tag{content@bytes!}} rcat{}",
    ),
    ("message", "message_ack_only", None, f"type:<message>! offline! {_BOT} id! from:jid! participant:jid"),
    (
        "receipt",
        "retry_request",
        None,
        "type! from:jid! participant:jid is_lid recipient:jid retry!{id! count:int} "
        "keys{identity!{content@bytes!} skey!{id!{content@uint!} value!{content@bytes!} signature!{content@bytes!}} key{id!{content@uint!} value!{content@bytes!}}} "
        "id! t:int! registration!{content@uint!}",
    ),
    (
        "receipt",
        "receipt",
        None,
        "id! from:jid! offline type:<receipt> error{reason type!} participants{message_id key user*{jid:jid! t:int! type:<receipt> participant_pn:jid participant_username}} "
        "participant:jid recipient:jid list{item*{server_id id}} biz{actual_actors:int host_storage:int privacy_mode_ts:int} is_lid participant_pn:jid participant_username t:int",
    ),
    ("receipt", "call_receipt", None, "offer{} accept{} reject{} id! type from:jid!"),
)


@dataclass(frozen=True)
class Field:
    """``kind``: text, int, jid, bytes, uint, string, a set's name, or node; ``need``: ``!``, ``?``, ``*`` or nothing."""

    name: str
    key: str
    kind: str
    need: str
    inner: tuple[Field, ...] = ()

    @property
    def type(self) -> str:
        if self.kind == "node":
            inside = struct_type(self.inner)
            return f"array<struct<value: {inside}, error: string>>" if self.need == "*" else inside
        return {"text": VALUE, "int": "bigint", "jid": JID, "bytes": "binary", "uint": "decimal(20,0)"}.get(self.kind, "string")


def struct_type(fields: tuple[Field, ...]) -> str:
    # A node without fields of its own is told by one that is always true.
    return f"struct<{', '.join(f'`{f.name}`: {f.type}' for f in fields) or 'present: boolean'}>"


_FIELD = re.compile(r"\s*(?:(\})|([\w-]+)(?:=([\w-]+))?(?:([!?*]?)\{|(?::(\w+|<\w+>)|@(\w+))?(!?)(?=[\s}]|$)))")


def fields_of(text: str) -> tuple[Field, ...]:
    """The fields that a line says."""
    at = 0

    def block(top: bool) -> tuple[Field, ...]:
        nonlocal at
        found: list[Field] = []
        while at < len(text.rstrip()):
            m = _FIELD.match(text, at)
            if not m:
                raise ValueError(f"no field at {text[at : at + 30]!r}")
            at = m.end()
            if m[1]:
                if top:
                    raise ValueError("a bracket too many")
                return tuple(found)
            if m[4] is not None:
                found.append(Field(m[2], m[3] or m[2], "node", m[4], block(False)))
            else:
                found.append(Field(m[2], m[3] or m[2], (m[5] or m[6] or "text").strip("<>"), m[7]))
        if not top:
            raise ValueError("a bracket is missing")
        return tuple(found)

    return block(True)


@dataclass(frozen=True)
class Shape:
    tag: str
    name: str
    guard: tuple[str, str] | None
    fields: tuple[Field, ...]


SHAPES = tuple(Shape(tag, name, guard, fields_of(line)) for tag, name, guard, line in TABLE)
TAGS = tuple(dict.fromkeys(s.tag for s in SHAPES))
MESSAGE_TYPES, RECEIPT_TYPES = SETS["message"].split(), SETS["receipt"].split()
EVENT = f"struct<shape: string, {', '.join(f'{s.name}: {struct_type(s.fields)}' for s in SHAPES)}>"


class _Writer:
    """Writes the expressions; ``nodes`` is the SQL of the array of nodes. Lambda variables have numbers."""

    def __init__(self, nodes: str):
        self.nodes, self.numbers = nodes, count()

    def let(self, value: str, body) -> str:
        x = f"x{next(self.numbers)}"
        return f"get(transform(array({value}), {x} -> {body(x)}), 0)"

    def attr(self, node: str, key: str) -> str:
        a = f"x{next(self.numbers)}"
        return f"get(filter({node}.attrs, {a} -> {a}.key = '{key}'), 0)"

    def children(self, node: str, tag: str) -> str:
        c = f"x{next(self.numbers)}"
        return f"filter({self.nodes}, {c} -> {c}.depth = {node}.depth + 1 and {c}.tag = '{tag}' and slice({c}.path, 1, {node}.depth) = {node}.path)"

    def struct(self, fields: tuple[Field, ...], node: str) -> str:
        """``v`` and ``e`` of the fields of a node: their values, and the first error in their order, as ``code:detail``."""
        if not fields:
            return "named_struct('v', named_struct('present', true), 'e', cast(null as string))"
        found = {f"f{i}": self.found(f, node) for i, f in enumerate(fields)}

        def told(x: str) -> str:
            read = [self.read(f, node, f"{x}.f{i}") for i, f in enumerate(fields)]
            values = ", ".join(f"'{f.name}', {v}" for f, (v, _) in zip(fields, read, strict=True))
            errors = ", ".join([e for _, e in read if e] or ["cast(null as string)"])
            return f"named_struct('v', named_struct({values}), 'e', coalesce({errors}))"

        return self.let(f"named_struct({', '.join(f"'{n}', {x}" for n, x in found.items())})", told)

    def found(self, f: Field, node: str) -> str:
        """What a field is read from: an attribute, the node's kind of content, or children already read."""
        if f.kind in ("bytes", "uint"):
            return f"if({node}.content_kind = 'bytes', {node}.raw, null)"
        if f.kind != "node":
            return self.attr(node, f.key)
        c = f"x{next(self.numbers)}"
        read = f"transform({self.children(node, f.key)}, {c} -> {self.struct(f.inner, c)})"
        return read if f.need == "*" else f"get({read}, 0)"

    def read(self, f: Field, node: str, x: str) -> tuple[str, str]:
        """(SQL of the value, SQL of the error or nothing) from what was found."""
        if f.kind == "node":
            if f.need == "*":
                c = f"x{next(self.numbers)}"
                return f"transform({x}, {c} -> named_struct('value', if({c}.e is null, {c}.v, null), 'error', {c}.e))", ""
            absent = f"if({x} is null, 'missing_child:{f.key}', {x}.e)" if f.need == "!" else "" if f.need == "?" else f"{x}.e"
            return f"if({x}.e is null, {x}.v, null)", absent
        if f.kind in ("bytes", "uint"):
            absent = f"if({x} is null, 'missing_content:bytes', null)" if f.need else ""
            if f.kind == "bytes":
                return x, absent
            number = f"case when octet_length({x}) = 0 then cast(0 as decimal(20,0)) when octet_length({x}) <= 8 then cast(conv(hex({x}), 16, 10) as decimal(20,0)) end"
            wide = f"if(octet_length({x}) > 8, concat('content_too_wide:', octet_length({x})), null)"
            return number, f"coalesce({absent}, {wide})" if absent else wide
        absent = f"when {x} is null then 'missing_attr:{f.key}' " if f.need else ""
        if f.kind == "text":
            return x, f"case {absent}end" if absent else ""
        if f.kind == "int":
            value, code = f"if({x}.text rlike if({x}.kind = 'packed', '^[0-9]+$', '^[+-]?[0-9]+$') and {x}.kind <> 'jid', try_cast({x}.text as bigint), null)", "not_an_int"
        elif f.kind == "jid":
            value, code = f"{x}.jid", "not_a_jid"
        else:
            value, code = f"if({x}.text in ({', '.join(repr(w) for w in SETS[f.kind].split())}), {x}.text, null)", "unknown_enum_value"
        return value, f"case {absent}when {x} is not null and {value} is null then '{code}:{f.key}' end"

    def tried(self, shape: Shape, root: str) -> str:
        """``v`` and ``e`` of a shape, null where the tag or the guard is another."""
        tests = [f"{root}.tag = '{shape.tag}'"]
        if shape.guard:
            tests.append(f"coalesce({self.attr(root, shape.guard[0])}.text = '{shape.guard[1]}', false)")
        return f"if({' and '.join(tests)}, {self.struct(shape.fields, root)}, null)"


_KNOWN = ", ".join(f"'{t}'" for t in TAGS)


def derive(found: str) -> Column:
    """(shape, error) of the column of parsed frames by that name; one of the two is null. ``with_events`` gives the fields too.

    One expression in text: it is parsed at once, where hundreds of column calls would each take a trip.
    """
    writer = _Writer(f"{found}.nodes")

    def whole(root: str) -> str:
        def rule(s: Shape) -> str:
            guard = f"coalesce({writer.attr(root, s.guard[0])}.text = '{s.guard[1]}', false) and " if s.guard else ""
            return f"when {root}.tag = '{s.tag}' and {guard}{writer.struct(s.fields, root)}.e is null then '{s.name}'"

        told = f"named_struct('failed', {found}.error, 'known', coalesce({root}.tag in ({_KNOWN}), false), 'shape', case {' '.join(map(rule, SHAPES))} end)"
        error = lambda d: f"case when {d}.failed is not null then concat('parse:', {d}.failed) when not {d}.known then 'unknown_stanza' when {d}.shape is null then 'no_matching_shape' end"
        return writer.let(told, lambda d: f"named_struct('shape', if({d}.failed is null, {d}.shape, null), 'error', {error(d)})")

    return F.expr(writer.let(f"get({found}.nodes, 0)", whole))


def with_events(rows: DataFrame, found: str = "found") -> DataFrame:
    """``rows`` with ``event`` (``EVENT``: a struct per shape, one of them filled), ``shape`` and ``error`` (code, detail).

    Event or error is null. Each shape is read into a column of its own, so that no expression is deep. Filter the
    rows before, not by what is derived: Spark would move such a filter, and with it a copy of the rules, to the front.
    """
    writer = _Writer(f"{found}.nodes")
    kept = [F.col(c) for c in rows.columns]
    root = f"get({found}.nodes, 0)"
    read = rows.select(*kept, F.expr(root).alias("_root"))
    read = read.select(*kept, F.col("_root.tag").alias("_tag"), *[F.expr(writer.tried(s, "_root")).alias(f"_s{k}") for k, s in enumerate(SHAPES)])
    holds = " ".join(f"when _s{k} is not null and _s{k}.e is null then {k}" for k in range(len(SHAPES)))
    read = read.withColumn("_k", F.expr(f"case {holds} end"))
    parts = ", ".join(f"'{s.name}', if(_k = {k}, _s{k}.v, null)" for k, s in enumerate(SHAPES))
    name = " ".join(f"when {k} then '{s.name}'" for k, s in enumerate(SHAPES))
    code = lambda code, detail="''": f"named_struct('code', '{code}', 'detail', {detail})"
    error = f"case when {found}.error is not null then {code('parse', found + '.error')} when not coalesce(_tag in ({_KNOWN}), false) then {code('unknown_stanza')} when _k is null then {code('no_matching_shape', '_tag')} end"
    return read.select(*kept, F.expr(f"if(_k is null, null, named_struct('shape', case _k {name} end, {parts}))").alias("event"), F.expr(f"case _k {name} end").alias("shape"), F.expr(error).alias("error"))


def _equal(fields: tuple[Field, ...], a: str, b: str, numbers: Iterator[int]) -> str:
    tests = []
    for f in fields:
        x, y = f"{a}.`{f.name}`", f"{b}.`{f.name}`"
        if f.kind == "text":
            tests.append(value_equal_sql(x, y))
        elif f.kind == "jid":
            tests.append(jid_equal_sql(x, y))
        elif f.kind != "node":
            tests.append(f"{x} <=> {y}")
        elif f.need == "*":  # item by item; equal errors are equal
            p, q = f"y{next(numbers)}", f"y{next(numbers)}"
            item = f"{p}.error <=> {q}.error and ({p}.error is not null or {_equal(f.inner, p + '.value', q + '.value', numbers)})"
            tests.append(f"(size({x}) = size({y}) and forall(zip_with({x}, {y}, ({p}, {q}) -> {item}), z -> z))")
        else:
            tests.append(f"(case when {x} is null or {y} is null then {x} is null and {y} is null else {_equal(f.inner, x, y, numbers)} end)")
    return "(" + (" and ".join(tests) or "true") + ")"


def event_equal_sql(a: str, b: str) -> str:
    """SQL text: whether two events have the same shape and mean the same in every field; the nodes don't count."""
    numbers = count()
    cases = " ".join(f"when '{s.name}' then {_equal(s.fields, f'{a}.{s.name}', f'{b}.{s.name}', numbers)}" for s in SHAPES)
    return f"coalesce(case when {a} is null or {b} is null then {a} is null and {b} is null when {a}.shape <> {b}.shape then false else case {a}.shape {cases} end end, false)"


def event_equal(a: str, b: str) -> Column:
    return F.expr(event_equal_sql(a, b))


def richest_first(shapes: tuple[Shape, ...]) -> list[Shape]:
    """Shapes of a tag in the order in which none hides a later one: guarded first, then by required fields."""

    def required(fields: tuple[Field, ...]) -> int:
        return sum((f.need == "!") + (required(f.inner) if f.need == "!" else 0) for f in fields)

    return sorted(shapes, key=lambda s: (s.guard is None, -required(s.fields), -len(s.fields), s.name))
