"""Chat formatting with a small template language, compiled to Python closures.

A template is text with ``{{ expression }}``, ``{% if %} / {% elif %} / {% else %} / {% endif %}``,
``{% for message in messages %} / {% endfor %}``, ``{% set name = expression %}`` and
``{% generation %} / {% endgeneration %}`` around what a loss covers. Expressions know string and number literals,
``true false none``, names, ``message.role`` and ``message.text``, ``loop.first loop.last loop.index0``, ``+``, ``~``,
comparisons, ``in``, ``and or not`` and the filters below; there is no way to call or to reach anything else. The
parser gives a syntax tree, constants are folded (literal operations, branches with a constant test, runs of text),
and each node becomes a closure.

Conversations may be longer than a task should hold: turns are rendered as they arrive, in order, and come out in
pieces of bounded size, each with the spans that the loss covers. So ``messages`` may be used in one loop at the top
level only, and a template looks one turn ahead at most (``loop.last``).

The filter ``escape`` puts a backslash before each backslash and each control string of the template, ``line`` also
before line ends; ``unescape`` takes them away again, so texts and roles are read back exactly.

Defined cases: null text and null role are empty; turns go by (turn, role, text), nulls first; repeated rows are turns
of their own; a null conv_id is a conversation like any other; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.codes import bounded
CONTROL = ("<turn>", "</turn>", "###")
TURNS = (
    "{% for message in messages %}<turn>### {{ message.role | line }}:\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
_control = re.compile("(" + "|".join(map(re.escape, ("\\", *CONTROL))) + ")")
_taken = re.compile(r"\\(.)", re.S)
FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda s: _control.sub(r"\\\1", s),
    "line": lambda s: _control.sub(r"\\\1", s).replace("\n", "\\\n").replace(":", "\\:"),
    "trim": lambda s: s.strip(),
    "upper": lambda s: s.upper(),
    "lower": lambda s: s.lower(),
    "capitalize": lambda s: s.capitalize(),
    "length": len,
    "string": str,
}
OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b, "~": lambda a, b: str(a) + str(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b,
    "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}
FIELDS = {"message": ("role", "text"), "loop": ("first", "last", "index0")}


def unescape(text: str) -> str:
    return _taken.sub(r"\1", text)


class TemplateError(ValueError):
    pass


_tag = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_token = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>().|]))""")
_escapes = {"n": "\n", "t": "\t"}


class Parser:
    """Nodes are tuples: ``text emit if for set gen`` and, in expressions, ``const name attr op and or not filter``."""

    def __init__(self, source: str):
        self.parts, at = [], 0
        for m in _tag.finditer(source):
            if m.start() > at:
                self.parts.append(("text", source[at : m.start()]))
            self.parts.append(("emit", m[1]) if m[1] is not None else ("tag", m[2]))
            at = m.end()
        if source[at:]:
            self.parts.append(("text", source[at:]))
        self.at = 0

    def block(self, ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nodes = []
        while self.at < len(self.parts):
            kind, body = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(("text", body))
                continue
            if kind == "emit":
                nodes.append(("emit", self.expression(body)))
                continue
            word, _, rest = body.strip().partition(" ")
            if word in ends:
                self.rest = rest
                return nodes, word
            nodes.append(self.tag(word, rest))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return nodes, ""

    def tag(self, word: str, rest: str) -> tuple:
        if word == "if":
            branches, other, test = [], [], self.expression(rest)
            while True:
                body, end = self.block(("elif", "else", "endif"))
                if test is not None:
                    branches.append((test, body))
                else:
                    other = body
                if end == "endif":
                    return ("if", branches, other)
                if test is None:
                    raise TemplateError(f"{end} after else")
                test = self.expression(self.rest) if end == "elif" else None
        if word == "for":
            if rest.split() != ["message", "in", "messages"]:
                raise TemplateError("the only loop is: for message in messages")
            return ("for", self.block(("endfor",))[0])
        if word == "generation":
            return ("gen", self.block(("endgeneration",))[0])
        if word == "set" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(.+)", rest, re.S)) and m[1] not in ("message", "messages", "loop"):
            return ("set", m[1], self.expression(m[2]))
        raise TemplateError(f"unknown tag: {word} {rest}")

    def expression(self, source: str) -> tuple:
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            if not (m := _token.match(source, at)):
                raise TemplateError(f"can't read: {source[at:]}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        node = self.either()
        if self.tokens:
            raise TemplateError(f"left over: {self.tokens}")
        return node

    def take(self, *words: str) -> str | None:
        return self.tokens.pop(0)[1] if self.tokens and self.tokens[0][0] in ("name", "op") and self.tokens[0][1] in words else None

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        if op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            node = ("op", op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while op := self.take("+", "~"):
            node = ("op", op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.take("|"):
            kind, name = self.tokens.pop(0) if self.tokens else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter: {name}")
            node = ("filter", name, node)
        return node

    def atom(self) -> tuple:
        if not self.tokens:
            raise TemplateError("an expression is missing")
        kind, value = self.tokens.pop(0)
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _escapes.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return ("const", int(value))
        if kind == "op" and value == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return node
        if kind == "name" and value in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value])
        if kind == "name" and value in FIELDS:
            if not self.take(".") or not self.tokens or self.tokens[0][1] not in FIELDS[value]:
                raise TemplateError(f"{value} has {', '.join(FIELDS[value])}")
            return ("attr", value, self.tokens.pop(0)[1])
        if kind == "name" and value not in ("and", "or", "not", "in", "messages"):
            return ("name", value)
        raise TemplateError(f"unexpected: {value}")


def fold_expression(node: tuple) -> tuple:
    kind = node[0]
    if kind in ("const", "name", "attr"):
        return node
    parts = tuple(fold_expression(x) if isinstance(x, tuple) else x for x in node)
    if kind in ("and", "or") and parts[1][0] == "const":
        return parts[2] if bool(parts[1][1]) == (kind == "and") else parts[1]
    if all(x[0] == "const" for x in parts[1:] if isinstance(x, tuple)):
        return ("const", value(parts)({}))
    return parts


def fold(nodes: list[tuple]) -> list[tuple]:
    """Fold constants: expressions, branches whose test is known, and neighbouring text."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            node = ("text", out.pop()[1] + node[1])
        if node != ("text", ""):
            out.append(node)

    for node in nodes:
        kind = node[0]
        if kind == "emit":
            e = fold_expression(node[1])
            add(("text", "" if e[1] is None else str(e[1])) if e[0] == "const" else ("emit", e))
        elif kind == "set":
            add(("set", node[1], fold_expression(node[2])))
        elif kind in ("for", "gen"):
            add((kind, fold(node[1])))
        elif kind == "if":
            branches, other = [], fold(node[2])
            for test, body in node[1]:
                test = fold_expression(test)
                if test[0] != "const":
                    branches.append((test, fold(body)))
                elif test[1]:
                    other = fold(body)
                    break
            for x in [("if", branches, other)] if branches else other:
                add(x)
        else:
            add(node)
    return out


def value(node: tuple) -> Callable[[dict], Any]:
    """The closure of an expression, over the names in force."""
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, k=node[1]: env.get(k)
    if kind == "attr":
        return lambda env, k=f"{node[1]}.{node[2]}": env[k]
    if kind == "not":
        return lambda env, a=value(node[1]): not a(env)
    if kind == "and":
        return lambda env, a=value(node[1]), b=value(node[2]): a(env) and b(env)
    if kind == "or":
        return lambda env, a=value(node[1]), b=value(node[2]): a(env) or b(env)
    if kind == "filter":
        return lambda env, f=FILTERS[node[1]], a=value(node[2]): f(a(env))
    return lambda env, f=OPERATORS[node[1]], a=value(node[2]), b=value(node[3]): f(a(env), b(env))


class Output:
    """Rendered text and the spans of it that the loss covers."""

    def __init__(self) -> None:
        self.parts, self.size, self.spans = [], 0, []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def program(nodes: list[tuple]) -> Callable[[dict, Output], None]:
    steps = [step(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: Output) -> None:
        for s in steps:
            s(env, out)

    return run


def step(node: tuple) -> Callable[[dict, Output], None]:
    kind = node[0]
    if kind == "text":
        return lambda env, out, t=node[1]: out.add(t)
    if kind == "emit":
        return lambda env, out, e=value(node[1]): out.add("" if (v := e(env)) is None else str(v))
    if kind == "set":
        return lambda env, out, k=node[1], e=value(node[2]): env.__setitem__(k, e(env))
    if kind == "gen":

        def generate(env: dict, out: Output, body=program(node[1])) -> None:
            start = out.size
            body(env, out)
            out.spans.append((start, out.size))

        return generate
    if kind == "if":

        def branch(env: dict, out: Output, tests=[(value(t), program(b)) for t, b in node[1]], other=program(node[2])) -> None:
            for test, body in tests:
                if test(env):
                    return body(env, out)
            other(env, out)

        return branch
    raise TemplateError("a loop belongs at the top level, once")


class Template:
    def __init__(self, source: str):
        self.nodes = fold(Parser(source).block(())[0])
        loops = [i for i, n in enumerate(self.nodes) if n[0] == "for"]
        if len(loops) > 1:
            raise TemplateError("a loop belongs at the top level, once")
        at = loops[0] if loops else len(self.nodes)
        self.before, self.after = program(self.nodes[:at]), program(self.nodes[at + 1 :])
        self.body = program(self.nodes[at][1]) if loops else None

    def pieces(self, messages: Iterator[tuple[str, str]], most: int = 1 << 20) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Text and loss spans (code points in the piece); a piece ends at the first end of a turn past ``most``."""
        env: dict[str, Any] = {}
        out = Output()
        self.before(env, out)
        turns = iter(messages)
        ahead = next(turns, None) if self.body else None
        index = 0
        while ahead is not None:
            (role, text), ahead = ahead, next(turns, None)
            env |= {"message.role": role, "message.text": text, "loop.first": index == 0, "loop.last": ahead is None, "loop.index0": index}
            self.body(env, out)
            index += 1
            if out.size >= most:
                yield "".join(out.parts), out.spans
                out = Output()
        self.after(env, out)
        yield "".join(out.parts), out.spans

    def render(self, messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        (found,) = self.pieces(iter(messages), most=1 << 62)
        return found


PIECE = "conv_id long, piece int, text string, spans array<struct<start:long,end:long>>"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def runs(rows: Iterator[tuple]) -> Iterator[tuple[Any, Iterator[tuple]]]:
    """Consecutive rows with the same first value, as they come; each run is to be used up before the next."""
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def run() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == key:
                yield row[1:]
                row = next(rows, None)

        yield key, (mine := run())
        for _ in mine:
            pass


def format_conversations(conversations: DataFrame, template: str = TURNS, piece_chars: int = 1 << 20) -> DataFrame:
    """Rows ``(conv_id, piece, text, spans)``: the formatted conversations, in order within each partition.

    The one shuffle brings a conversation's turns together in order; none is ever held as a whole.
    """
    Template(template)  # errors show here and not in a task
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        turns = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
        out, size = [], 0

        def flush() -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.string(), spans)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["conv_id", "piece", "text", "spans"])

        for conv, messages in runs(turns):
            for k, (text, found) in enumerate(compiled.pieces(messages, piece_chars)):
                out.append((conv, k, text, [{"start": a, "end": b} for a, b in found]))
                size += len(text)
                if size >= 1 << 22:
                    yield flush()
                    out, size = [], 0
        yield flush()

    return bounded(ordered_turns(conversations)).mapInArrow(render, PIECE)


_turn = re.compile(r"<turn>### ((?:\\.|[^\\\n])*):\n((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def read_back(pieces: DataFrame) -> DataFrame:
    """What the formatted text of ``TURNS`` says: turns, and the text under the loss mask, unescaped; pieces in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "spans"))))
        out = []
        for conv, parts in runs(rows):
            n = loss = size = 0
            turns, covered = hashlib.sha256(), hashlib.sha256()
            for text, spans in parts:
                at = 0
                while at < len(text):
                    if not (m := _turn.match(text, at)):
                        raise ValueError(f"conversation {conv}: no turn at {at}")
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                    n, at = n + 1, m.end()
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    loss += len(said)
                    covered.update(said.encode("utf-8", "surrogatepass"))
                size += len(text)
            out.append((conv, n, turns.hexdigest(), loss, covered.hexdigest(), size))
            if len(out) == 4096:
                yield rows_of(out)
                out = []
        yield rows_of(out)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return bounded(pieces).mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


SAID = "\\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(table.unionByName(extra)))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
said AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    replace(replace(replace(replace(text, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>'), '###', '\###') AS escaped,
    replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>'), '###', '\###'), chr(10), '\' || chr(10)), ':', '\:') AS line
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(length('<turn>### ' || line || ':' || chr(10) || escaped || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""
