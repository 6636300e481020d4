"""What values mean: addresses in any form, typed reading with errors as values, and equality across encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.binary import let, read_be
from tapeloom.functions.frame import as_int

ERROR = "struct<code: string, detail: string>"


def error(code: str, detail: Column | str = "") -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def jid(value: Column) -> Column:
    """A value read as an address, in parts; null if it is none. A bare server counts only as a token."""
    return value["jid"]


def jid_text(address: Column) -> Column:
    """An address written out; device 0 only with an integrator."""
    bare = (address["user_kind"] == "nil") & address["integrator"].isNull()
    device = F.when((address["device"] != 0) | address["integrator"].isNotNull(), F.concat(F.lit(":"), address["device"].cast("string"))).otherwise("")
    integrator = F.coalesce(F.concat(address["integrator"].cast("string"), F.lit("-")), F.lit(""))
    return F.when(bare, address["server"]).otherwise(F.concat(integrator, F.coalesce(address["user"], F.lit("")), device, F.lit("@"), address["server"]))


def is_device(address: Column) -> Column:
    return address["device"] != 0


def is_group(address: Column) -> Column:
    return address["server"] == "g.us"


def is_user(address: Column) -> Column:
    return (address["device"] == 0) & (address["server"] != "g.us")


# --- typed reading -----------------------------------------------------------


def typed(value: Column, read: Column, missing: Column, wrong: str, key: str) -> Column:
    """``value`` and ``error``: one of them null; both where an optional field is absent."""
    failure = F.when(missing, error("missing_attr", key)).when(value.isNotNull() & read.isNull(), error(wrong, key))
    return F.struct(read.alias("value"), failure.alias("error"))


def attr_string(value: Column, key: str, required: bool = True) -> Column:
    return typed(value, value, value.isNull() if required else F.lit(False), "", key)


def attr_int(value: Column, key: str, required: bool = True) -> Column:
    return typed(value, as_int(value), value.isNull() if required else F.lit(False), "not_an_int", key)


def attr_jid(value: Column, key: str, required: bool = True, kind: str = "any") -> Column:
    """``kind``: any, device, group or user address."""
    test = {"any": lambda a: F.lit(True), "device": is_device, "group": is_group, "user": is_user}[kind]
    found = let(jid(value), lambda a: F.when(test(a), a))
    return typed(value, found, value.isNull() if required else F.lit(False), "not_a_jid", key)


def attr_enum(value: Column, key: str, allowed: list[str], policy: str = "required") -> Column:
    """``policy``: required, optional (absent is none, unknown an error) or or_none (unknown is none too)."""
    known = F.when(value["text"].isin(*allowed), value["text"])
    if policy == "or_none":
        return F.struct(known.alias("value"), F.lit(None).cast(ERROR).alias("error"))
    return typed(value, known, value.isNull() if policy == "required" else F.lit(False), "unknown_enum_value", key)


def content_bytes(node: Column) -> Column:
    raw = F.when(node["content_kind"] == "bytes", node["raw"])
    return F.struct(raw.alias("value"), F.when(raw.isNull(), error("missing_content", "bytes")).alias("error"))


def content_string(node: Column) -> Column:
    """A body as text: a token, digits, an address, or bytes that are UTF-8."""
    sound = F.when(node["content_kind"] == "bytes", F.try_validate_utf8(node["raw"].cast("string"))).when(node["content_kind"].isin("token", "packed", "jid"), node["text"])
    return F.struct(sound.alias("value"), F.when(sound.isNull(), error("missing_content", "bytes")).alias("error"))


def content_uint(node: Column) -> Column:
    """A body as a number of up to eight bytes, highest first; an empty one is 0."""
    raw = F.when(node["content_kind"] == "bytes", node["raw"])
    wide = F.octet_length(raw) > 8
    failure = F.when(raw.isNull(), error("missing_content", "bytes")).when(wide, error("content_too_wide", F.octet_length(raw).cast("string")))
    return F.struct(F.when(~wide, read_be(raw)).alias("value"), failure.alias("error"))


# --- equality ----------------------------------------------------------------


def eq_str(value: Column, text: Column | str) -> Column:
    """Whether a value says this text; nil says nothing, not even the empty text."""
    return F.coalesce((value["kind"] != "nil") & (value["text"] == text), F.lit(False))


def _same_text(a: str, b: str, kind_a: str, kind_b: str) -> str:
    # Digits in a packed run are never the empty text.
    return f"({a} = {b} and (({kind_a} = 'packed') = ({kind_b} = 'packed') or {a} <> ''))"


def jid_equal_sql(a: str, b: str) -> str:
    """SQL text: whether two addresses name the same, whatever form their users came in."""
    users = _same_text(f"coalesce({a}.user, '')", f"coalesce({b}.user, '')", f"{a}.user_kind", f"{b}.user_kind")
    return f"(case when {a} is null or {b} is null then {a} is null and {b} is null else {a}.server = {b}.server and {a}.device = {b}.device and {a}.integrator <=> {b}.integrator and {users} end)"


def value_equal_sql(a: str, b: str) -> str:
    """SQL text: whether two values mean the same; it is not transitive, as addresses compare by parts but with text as text."""
    raw = lambda x: f"coalesce({x}.raw, cast({x}.text as binary))"
    return (
        f"(case when {a} is null or {b} is null then {a} is null and {b} is null"
        f" when {a}.kind = 'nil' or {b}.kind = 'nil' then {a}.kind = {b}.kind"
        f" when {a}.kind = 'jid' and {b}.kind = 'jid' then {jid_equal_sql(a + '.jid', b + '.jid')}"
        f" when ({a}.kind = 'packed') <> ({b}.kind = 'packed') then {a}.kind <> 'jid' and {b}.kind <> 'jid' and {a}.text = {b}.text and {a}.text <> '' and {raw(a)} = {raw(b)}"
        f" else {raw(a)} = {raw(b)} end)"
    )


def semantic_eq(a: str, b: str) -> Column:
    """Whether two values (of ``VALUE``, given as SQL text) mean the same, however they were encoded; null equals null."""
    return F.expr(f"coalesce({value_equal_sql(a, b)}, false)")


def escaped(text: Column) -> Column:
    """Control characters (C0, DEL, C1) as ``\\u{hex}``, so that a report shows what it prints."""

    def told(c: Column) -> Column:
        code = F.ascii(c)
        return F.when((code < 32) | code.between(127, 159), F.concat(F.lit("\\u{"), F.lower(F.hex(code)), F.lit("}"))).otherwise(c)

    shown = F.array_join(F.transform(F.split(text, ""), told), "")
    return F.when(text.rlike(r"[\x00-\x1f\x7f-\x9f]"), shown).otherwise(text)
