"""Chat formatting: a compiler from a sandboxed template language to Python closures.

The language is small: ``{{ expression }}``, ``{% for x in e %}``, ``{% if e %}``,
``{% elif e %}``, ``{% else %}``, ``{% set x = e %}``, ``{% generation %}`` and their
``end`` tags, ``{# comments #}``, and ``-`` inside a tag to trim white space beside it.
Expressions have literals, names, ``a.b`` and ``a['b']`` on dictionaries and lists,
``+ - * % == != < <= > >= in not and or``, inline ``a if c else b``, and filters from
the table ``FILTERS``. There are no calls, no attributes of Python objects and no way to
import, so a template can only read the values it is given.

What a template can use up is bounded: ``*`` and ``%`` take whole numbers only, texts made by ``+``, filters
or output stay under ``MAX_CHARS``, and tags and brackets nest ``MAX_NESTING`` deep at most. Whatever an
expression does wrong with the values it is given is a ``TemplateError``.

A template is read into a syntax tree of tuples, constants are folded (filters and
branches included), adjacent literals are merged, and the tree becomes nested closures.
Rendering appends pieces to a list and notes the span of each ``generation`` block in
code points: the loss mask.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that steer a model; none of them occurs in an escaped text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|", "|>")
_CONTROL = re.compile("|".join(re.escape(c[0]) + f"(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.S)
MAX_CHARS, MAX_NESTING = 1 << 28, 50

#: Marks each turn with its role, and puts what the assistant says under the loss mask.
TEMPLATE = """
{#- one conversation: messages have role and text -#}
{{- '<s>' -}}
{%- for m in messages -%}
  {{- '<|turn:' + (m.role | escape) + '|>' -}}
  {%- if m.role == 'assistant' -%}
    {%- generation -%}{{- m.text | escape -}}{%- endgeneration -%}
  {%- else -%}
    {{- m.text | escape -}}
  {%- endif -%}
  {{- '<|end|>' -}}
{%- endfor -%}
{{- '</s>' -}}
"""
_TURN = re.compile(r"<\|turn:(.*?)\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    r"""Doubles backslashes and puts ``\_`` after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0] + "\\_", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "" if m[1] == "_" else m[1], text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": escape,
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
    "first": lambda x: x[0],
    "last": lambda x: x[-1],
}


class TemplateError(ValueError):
    """The template is not in the language, or reads a value that isn't there."""


# --- reading -----------------------------------------------------------------

_TAG = re.compile(r"(\{\{|\{%|\{#)(-?)(.*?)(-?)(\}\}|%\}|#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\w+)|(==|!=|<=|>=|[-+*%<>|.()\[\]=,])|(\S))")
_WORDS = {"and", "or", "not", "in", "if", "else"}


def _closed(text: str) -> str:
    if re.search(r"\{[{%#]", text):
        raise TemplateError("a tag has no end")
    return text


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """(kind, body): kind is text, ``{{`` or ``{%``; white space beside ``-`` is gone."""
    at, trim = 0, False
    for m in _TAG.finditer(source):
        if {"{{": "}}", "{%": "%}", "{#": "#}"}[m[1]] != m[5]:
            raise TemplateError(f"{m[1]} ends with {m[5]}")
        text = _closed(source[at : m.start()])
        text = text.lstrip() if trim else text
        yield "text", text.rstrip() if m[2] else text
        if m[1] != "{#":
            yield m[1], m[3].strip()
        at, trim = m.end(), bool(m[4])
    text = _closed(source[at:])
    yield "text", text.lstrip() if trim else text


class _Expression:
    """Recursive descent over one expression; trees are tuples whose first item names the node."""

    def __init__(self, source: str):
        self.items, at = [], 0
        while at < len(source.rstrip()):
            m = _TOKEN.match(source, at)
            if m[5]:
                raise TemplateError(f"unexpected {m[5]!r}")
            kind = "number" if m[1] else "string" if m[2] else "word" if m[3] else "sign"
            self.items.append((kind, m[1] or m[2] or m[3] or m[4]))
            at = m.end()
        self.at = self.depth = 0

    def peek(self) -> str:
        return self.items[self.at][1] if self.at < len(self.items) else ""

    def take(self, *wanted: str) -> str:
        found = self.peek()
        if not found or wanted and (found not in wanted or self.items[self.at][0] == "string"):
            raise TemplateError(f"expected {wanted or 'more'}, found {found!r}")
        self.at += 1
        return found

    def accept(self, *wanted: str) -> str:
        return self.take(*wanted) if self.peek() in wanted and self.items[self.at][0] != "string" else ""

    def whole(self):
        tree = self.choice()
        if self.peek():
            raise TemplateError(f"unexpected {self.peek()!r}")
        return tree

    def deeper(self, read):
        self.depth += 1
        if self.depth > MAX_NESTING:
            raise TemplateError("an expression is nested too deep")
        tree = read()
        self.depth -= 1
        return tree

    def choice(self):
        return self.deeper(self.chosen)

    def chosen(self):
        tree = self.either()
        if self.accept("if"):
            test = self.either()
            return ("choice", test, tree, self.choice() if self.accept("else") else ("value", ""))
        return tree

    def either(self):
        tree = self.both()
        while self.accept("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.accept("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.deeper(self.negated)) if self.accept("not") else self.compared()

    def compared(self):
        tree = self.summed()
        while sign := self.accept("==", "!=", "<", "<=", ">", ">=", "in", "not"):
            if sign == "not":
                self.take("in")
                tree = ("not", ("in", tree, self.summed()))
            else:
                tree = (sign, tree, self.summed())
        return tree

    def summed(self):
        tree = self.product()
        while sign := self.accept("+", "-"):
            tree = (sign, tree, self.product())
        return tree

    def product(self):
        tree = self.filtered()
        while sign := self.accept("*", "%"):
            tree = (sign, tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.reached()
        while self.accept("|"):
            name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def reached(self):
        tree = self.single()
        while sign := self.accept(".", "["):
            if sign == ".":
                tree = ("item", tree, ("value", self.take()))
            else:
                tree = ("item", tree, self.choice())
                self.take("]")
        return tree

    def single(self):
        if not self.peek():
            raise TemplateError("an expression is missing")
        kind, found = self.items[self.at]
        self.at += 1
        if kind == "number":
            return ("value", int(found))
        if kind == "string":
            return ("value", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), found[1:-1], flags=re.S))
        if found == "(":
            tree = self.choice()
            self.take(")")
            return tree
        if found == "-":
            return ("-", ("value", 0), self.deeper(self.single))
        if kind == "word" and found not in _WORDS:
            return ("value", {"true": True, "false": False, "none": None}[found]) if found in ("true", "false", "none") else ("name", found)
        raise TemplateError(f"unexpected {found!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template: ``("block", [nodes])``."""
    pieces = list(_pieces(source))
    at = depth = 0
    marked = False  # inside a generation block

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(pieces):
            kind, body = pieces[at]
            at += 1
            if kind == "text":
                if body:
                    nodes.append(("emit", ("value", body)))
            elif kind == "{{":
                nodes.append(("emit", _Expression(body).whole()))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return ("block", nodes), body
                nodes.append(statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", nodes), ""

    def statement(word: str, rest: str) -> tuple:
        nonlocal depth
        depth += 1
        if depth > MAX_NESTING:
            raise TemplateError("tags are nested too deep")
        made = tag(word, rest)
        depth -= 1
        return made

    def tag(word: str, rest: str) -> tuple:
        nonlocal marked
        if word == "for":
            m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            return ("for", m[1], _Expression(m[2]).whole(), block("endfor")[0])
        if word == "if":
            test = _Expression(rest).whole()
            then, end = block("elif", "else", "endif")
            if end.startswith("elif"):
                return ("if", test, then, ("block", [statement("if", end[4:].strip())]))
            return ("if", test, then, block("endif")[0] if end == "else" else ("block", []))
        if word == "set":
            name, _, value = rest.partition("=")
            if not re.fullmatch(r"\w+", name.strip()):
                raise TemplateError(f"set {rest}")
            return ("set", name.strip(), _Expression(value).whole())
        if word == "generation":
            if marked:
                raise TemplateError("a generation block inside another")
            marked = True
            body = block("endgeneration")[0]
            marked = False
            return ("generation", body)
        raise TemplateError(f"no tag {word!r}")

    return block()[0]


# --- folding and compiling ---------------------------------------------------



def _whole(x: Any) -> int:
    if not isinstance(x, int) or abs(x) > 1 << 63:
        raise TemplateError(f"{x!r:.40} is no whole number of 64 bits")
    return x


def _added(a: Any, b: Any) -> Any:
    if isinstance(a, str) and isinstance(b, str):
        if len(a) + len(b) > MAX_CHARS:
            raise TemplateError("a text grows too long")
        return a + b
    return _whole(a) + _whole(b)


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": _added,
    "-": lambda a, b: _whole(a) - _whole(b),
    "*": lambda a, b: _whole(a) * _whole(b),
    "%": lambda a, b: _whole(a) % _whole(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}


def _reach(value: Any, key: Any) -> Any:
    try:
        if isinstance(value, (dict, list)):
            return value[key]
    except (KeyError, IndexError, TypeError):
        pass
    raise TemplateError(f"no item {key!r}")


def _applied(operation: Callable, *values: Any) -> Any:
    try:
        return operation(*values)
    except TemplateError:
        raise
    except (TypeError, ValueError, IndexError, KeyError, ZeroDivisionError) as e:
        raise TemplateError(str(e)) from None


def fold(tree: tuple) -> tuple:
    """The same template with its constant parts computed: values, filters, branches, literals side by side."""
    kind = tree[0]
    if kind in ("value", "name"):
        return tree
    if kind == "block":
        nodes: list[tuple] = []
        for node in map(fold, tree[1]):
            for x in node[1] if node[0] == "block" else [node]:
                if x[0] == "emit" and x[1][0] == "value" and nodes and nodes[-1][0] == "emit" and nodes[-1][1][0] == "value":
                    nodes[-1] = ("emit", ("value", str(nodes[-1][1][1]) + str(x[1][1])))
                else:
                    nodes.append(x)
        return ("block", nodes)
    parts = tuple(fold(x) if isinstance(x, tuple) else x for x in tree)
    constant = [x[1] for x in parts[1:] if isinstance(x, tuple) and x[0] == "value"]
    if kind in _BINARY and len(constant) == 2:
        return ("value", _applied(_BINARY[kind], *constant))
    if kind == "filter" and constant:
        return ("value", _applied(FILTERS[parts[1]], constant[0]))
    if parts[1:] and isinstance(parts[1], tuple) and parts[1][0] == "value":
        test = parts[1][1]
        if kind == "not":
            return ("value", not test)
        if kind == "and":
            return parts[2] if test else parts[1]
        if kind == "or":
            return parts[1] if test else parts[2]
        if kind in ("choice", "if"):
            return parts[2] if test else parts[3]
    return parts


class _Output:
    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.at = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.at += len(text)
        if self.at > MAX_CHARS:
            raise TemplateError("the output grows too long")
        self.pieces.append(text)


def _value(tree: tuple) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "value":
        constant = tree[1]
        return lambda names: constant
    if kind == "name":
        name = tree[1]

        def look(names: dict) -> Any:
            if name not in names:
                raise TemplateError(f"no value {name!r}")
            return names[name]

        return look
    if kind == "filter":
        apply, inner = FILTERS[tree[1]], _value(tree[2])
        return lambda names: _applied(apply, inner(names))
    if kind == "choice":
        test, then, other = map(_value, tree[1:])
        return lambda names: then(names) if test(names) else other(names)
    parts = [_value(x) for x in tree[1:]]
    if kind == "not":
        return lambda names: not parts[0](names)
    left, right = parts
    if kind == "and":
        return lambda names: left(names) and right(names)
    if kind == "or":
        return lambda names: left(names) or right(names)
    if kind == "item":
        return lambda names: _reach(left(names), right(names))
    apply = _BINARY[kind]
    return lambda names: _applied(apply, left(names), right(names))


def _run(tree: tuple) -> Callable[[dict, _Output], None]:
    kind = tree[0]
    if kind == "block":
        steps = [_run(x) for x in tree[1]]

        def all_steps(names: dict, out: _Output) -> None:
            for step in steps:
                step(names, out)

        return all_steps
    if kind == "emit":
        if tree[1][0] == "value":
            text = str(tree[1][1])
            return lambda names, out: out.add(text)
        value = _value(tree[1])
        return lambda names, out: out.add(str(value(names)))
    if kind == "set":
        name, value = tree[1], _value(tree[2])
        return lambda names, out: names.__setitem__(name, value(names))
    if kind == "if":
        test, then, other = _value(tree[1]), _run(tree[2]), _run(tree[3])
        return lambda names, out: (then if test(names) else other)(names, out)
    if kind == "generation":
        inside = _run(tree[1])

        def mark(names: dict, out: _Output) -> None:
            start = out.at
            inside(names, out)
            out.spans.append((start, out.at))

        return mark
    name, items, body = tree[1], _value(tree[2]), _run(tree[3])

    def loop(names: dict, out: _Output) -> None:
        found = items(names)
        if not isinstance(found, (list, dict)):
            raise TemplateError(f"for over {type(found).__name__}")
        inner = dict(names)
        for i, x in enumerate(found):
            inner[name] = x
            inner["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(found) - 1}
            body(inner, out)

    return loop


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from named values to (text, spans under the loss mask)."""
    run = _run(fold(parse(source)))

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        run(dict(names), out)
        return "".join(out.pieces), out.spans

    return render


# --- on Spark ----------------------------------------------------------------


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Return ``conv_id, formatted, spans`` (array of start, end), one row per conversation.

    ``conversations`` has ``conv_id, turn, role, text``; turns go by turn number, rows of
    equal turn by role, then text. Defined cases: a null text or role is empty; null turns
    come first; rows of a null conv_id form one conversation; repeated rows stay, each a turn
    of its own; an empty table gives no rows; other columns are ignored. One conversation is
    one row, as in any chat training set, so its turns meet in one task by design.
    """
    parse(template)  # a faulty template fails here, before the job

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = compile_template(template)
        for batch in batches:
            done = [run({"messages": [{"role": t["role"], "text": t["text"]} for t in turns]}) for turns in batch["turns"]]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "formatted": [x for x, _ in done], "spans": [[{"start": a, "end": b} for a, b in s] for _, s in done]})

    turns = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turns)).alias("turns"))
    return grouped.mapInPandas(render, f"conv_id {kind}, formatted string, spans array<struct<start: bigint, end: bigint>>")


def read_formatted(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns back from a text that ``TEMPLATE`` made."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]
