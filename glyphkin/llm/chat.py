"""Operator 3: chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree becomes
Python closures that write pieces of a conversation and say which of them the loss covers. There are no calls and
no Python attributes: a name is looked up in the environment, `.x` and `[x]` in mappings and lists only, filters
come from a fixed table.

    text  {{ expression }}  {% set n = e %}  {% if e %} {% elif e %} {% else %} {% endif %}
    {% for x in e %} {% endfor %} (with loop.index, index0, first, last)
    {% generation %} {% endgeneration %}: what the model is to write; `{%-` and `-%}` strip white space

Closures take messages from an iterator and hand pieces on at once, so a conversation of any length needs the
memory of one turn. Inside texts and roles a backslash goes before every control string and every backslash,
which reading undoes. Rows are ordered by turn, then role, then text, nulls first; equal rows are separate turns.
A null role or text is empty; null conversation ids form one conversation. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import table

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<a>", "<t>", "</r>", "</t>")
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_TOKEN = re.compile(r"\\[\\<\[]|" + "|".join(map(re.escape, CONTROLS)))

TEMPLATE = """{{ '<s>' }}
{%- for m in messages -%}
  {%- if m.role == 'user' -%}
    {{ '[INST]' + (m.text | escape) + '[/INST]' }}
  {%- elif m.role == 'assistant' -%}
    {{ '<a>' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
  {%- else -%}
    {{ '<t>' }}{{ m.role | escape }}{{ '</r>' }}{{ m.text | escape }}{{ '</t>' }}
  {%- endif -%}
{%- endfor -%}"""


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


FILTERS: dict[str, Callable[[str], object]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}


class TemplateError(ValueError):
    pass


_LEXER = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+|.\[\]()<>]))", re.S)
_UNQUOTE = {"n": "\n", "t": "\t", "r": "\r"}
MAX_TEMPLATE = 1 << 16


class _Expression:
    """Recursive descent over one expression; nodes are tuples, constants are ('const', value)."""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _LEXER.match(text, at)
            if not m:
                raise TemplateError(f"can't read {text[at:]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup]))
            at = m.end()
        self.i = 0

    def take(self, *values: str) -> str | None:
        if self.i < len(self.tokens) and self.tokens[self.i][0] != "str" and self.tokens[self.i][1] in values:
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value} is missing")

    def whole(self) -> tuple:
        node = self.either()
        if self.i < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.i][1]!r}")
        return node

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
        node = self.added()
        while op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            node = (op, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while op := self.take("+", "-"):
            node = (op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.take("|"):
            kind, name = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.i += 1
            node = ("filter", name, node)
        return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.either()
            self.need(")")
        else:
            if self.i >= len(self.tokens):
                raise TemplateError("an expression ends too early")
            kind, value = self.tokens[self.i]
            self.i += 1
            if kind == "str":
                node = ("const", re.sub(r"\\(.)", lambda m: _UNQUOTE.get(m[1], m[1]), value[1:-1], flags=re.S))
            elif kind == "int":
                node = ("const", int(value))
            elif kind == "name" and value in ("true", "false", "none"):
                node = ("const", {"true": True, "false": False, "none": None}[value])
            elif kind == "name" and not value.startswith("_"):
                node = ("name", value)
            else:
                raise TemplateError(f"unexpected {value!r}")
        while op := self.take(".", "["):
            if op == ".":
                kind, value = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
                if kind != "name" or value.startswith("_"):
                    raise TemplateError(f"no member {value!r}")
                self.i += 1
                node = ("item", node, ("const", value))
            else:
                node = ("item", node, self.either())
                self.need("]")
        return node


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
}


def _item(value, key):
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int):
        return value[key]
    raise TemplateError(f"{type(value).__name__} has no member {key!r}")


def fold(node: tuple) -> tuple:
    """The expression with everything computed that needs no environment."""
    kind, args = node[0], node[1:]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        inner = fold(args[1])
        return ("const", FILTERS[args[0]](inner[1])) if inner[0] == "const" else ("filter", args[0], inner)
    args = tuple(map(fold, args))
    if kind in ("and", "or") and args[0][0] == "const":
        return args[1] if bool(args[0][1]) == (kind == "and") else args[0]
    if all(a[0] == "const" for a in args):
        if kind in _BINARY:
            return ("const", _BINARY[kind](args[0][1], args[1][1]))
        if kind == "not":
            return ("const", not args[0][1])
        if kind == "item":
            return ("const", _item(args[0][1], args[1][1]))
    return (kind, *args)


def _closure(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":

        def lookup(env, name=node[1]):
            if name not in env:
                raise TemplateError(f"unknown name {name!r}")
            return env[name]

        return lookup
    if kind == "filter":
        f, inner = FILTERS[node[1]], _closure(node[2])
        return lambda env: f(inner(env))
    if kind == "not":
        inner = _closure(node[1])
        return lambda env: not inner(env)
    a, b = _closure(node[1]), _closure(node[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    op = _item if kind == "item" else _BINARY[kind]
    return lambda env: op(a(env), b(env))


_SPLIT = re.compile(r"(\{\{.*?\}\}|\{%-?.*?-?%\})", re.S)


def parse(source: str) -> list[tuple]:
    """The template's syntax tree: ('text', s), ('out', e), ('set', n, e), ('if', [(e, body)]), ('for', n, e, body), ('generation', body)."""
    if len(source) > MAX_TEMPLATE:
        raise TemplateError("the template is too long")
    parts = _SPLIT.split(source)
    for i in range(1, len(parts), 2):
        if parts[i].startswith("{%-"):
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i].endswith("-%}"):
            parts[i + 1] = parts[i + 1].lstrip()
    root: list[tuple] = []
    stack: list[tuple[str, list, list]] = [("", root, root)]
    for i, part in enumerate(parts):
        body = stack[-1][2]
        if i % 2 == 0:
            if "{{" in part or "{%" in part:
                raise TemplateError(f"a tag is not closed in {part!r}")
            if part:
                body.append(("text", part))
        elif part.startswith("{{"):
            body.append(("out", fold(_Expression(part[2:-2]).whole())))
        else:
            word, _, rest = part[2:-2].strip("-").strip().partition(" ")
            if word == "set" and (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s*=(.*)", rest, re.S)):
                body.append(("set", m[1], fold(_Expression(m[2]).whole())))
            elif word == "for" and (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.*)", rest, re.S)):
                inner: list[tuple] = []
                body.append(("for", m[1], fold(_Expression(m[2]).whole()), inner))
                stack.append(("for", [], inner))
            elif word == "if":
                arms = [(fold(_Expression(rest).whole()), [])]
                body.append(("if", arms))
                stack.append(("if", arms, arms[0][1]))
            elif word in ("elif", "else") and stack[-1][0] == "if":
                arms = stack[-1][1]
                arms.append((fold(_Expression(rest).whole()) if word == "elif" else ("const", True), []))
                stack[-1] = ("if", arms, arms[-1][1])
            elif word == "generation":
                inner = []
                body.append(("generation", inner))
                stack.append(("generation", [], inner))
            elif word.startswith("end") and len(stack) > 1 and stack[-1][0] == word[3:]:
                stack.pop()
            else:
                raise TemplateError(f"unexpected {part}")
    if len(stack) > 1:
        raise TemplateError(f"end{stack[-1][0]} is missing")
    return simplify(root)


def simplify(body: list[tuple]) -> list[tuple]:
    """Constant output becomes text, neighbouring texts one, decided branches their body."""
    out: list[tuple] = []
    for node in body:
        if node[0] == "out" and node[1][0] == "const":
            node = ("text", _text(node[1][1]))
        if node[0] == "for":
            node = (*node[:3], simplify(node[3]))
        elif node[0] == "generation":
            node = ("generation", simplify(node[1]))
        elif node[0] == "if":
            arms = []
            for test, inner in node[1]:
                if test[0] != "const" or test[1]:
                    arms.append((test, simplify(inner)))
                if test[0] == "const" and test[1]:
                    break
            if not arms:
                continue
            if arms[0][0][0] == "const":
                for x in arms[0][1]:
                    _append(out, x)
                continue
            node = ("if", arms)
        _append(out, node)
    return out


def _append(out: list[tuple], node: tuple) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


def _text(value) -> str:
    return "" if value is None else str(value)


Emit = Callable[[str, bool], None]


def _run(body: list[tuple]) -> Callable[[dict, Emit, bool], None]:
    steps = [_step(n) for n in body]
    if len(steps) == 1:
        return steps[0]

    def all_steps(env, emit, generated):
        for s in steps:
            s(env, emit, generated)

    return all_steps


def _step(node: tuple) -> Callable[[dict, Emit, bool], None]:
    kind = node[0]
    if kind == "text":
        return lambda env, emit, generated, s=node[1]: emit(s, generated)
    if kind == "out":
        value = _closure(node[1])
        return lambda env, emit, generated: emit(_text(value(env)), generated)
    if kind == "generation":
        inner = _run(node[1])
        return lambda env, emit, generated: inner(env, emit, True)
    if kind == "set":
        value = _closure(node[2])

        def assign(env, emit, generated, name=node[1]):
            env[name] = value(env)

        return assign
    if kind == "if":
        arms = [(_closure(test), _run(inner)) for test, inner in node[1]]

        def choose(env, emit, generated):
            for test, inner in arms:
                if test(env):
                    inner(env, emit, generated)
                    return

        return choose
    name, values, inner = node[1], _closure(node[2]), _run(node[3])

    def loop(env, emit, generated):
        scope = dict(env)
        items = iter(values(env))
        ahead = list(itertools.islice(items, 1))
        index = 0
        while ahead:
            here = ahead.pop()
            ahead = list(itertools.islice(items, 1))
            scope[name] = here
            scope["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": not ahead}
            inner(scope, emit, generated)
            index += 1

    return loop


class Template:
    def __init__(self, source: str) -> None:
        self.tree = parse(source)
        self.run = _run(self.tree)

    def pieces(self, messages: Iterable[dict], emit: Emit, **names) -> None:
        """Calls emit(piece, generated) along the conversation."""
        self.run({"messages": messages, **names}, emit, False)

    def render(self, messages: Iterable[dict], **names) -> tuple[str, list[tuple[int, int]]]:
        """The formatted conversation and the spans that the loss covers."""
        out, spans, at = [], [], 0

        def emit(piece, generated):
            nonlocal at
            if generated:
                spans.append((at, at + len(piece)))
            out.append(piece)
            at += len(piece)

        self.pieces(messages, emit, **names)
        return "".join(out), spans


def unescape(text: str) -> str:
    """What escape made of a text, undone; only valid for escaped texts."""
    return re.sub(r"\\([\\<\[])", r"\1", text)


def _unfinished(text: str) -> int:
    """Where a token begins that the end of the text cuts off; the text's length if none does."""
    for i in range(max(0, len(text) - _LONGEST + 1), len(text)):
        rest = text[i:]
        if rest == "\\" or any(len(rest) < len(c) and c.startswith(rest) for c in CONTROLS):
            return i
    return len(text)


_LONGEST = max(map(len, CONTROLS))


class Reader:
    """Reads formatted output back, cut into pieces anywhere, and calls turn(role, text) for each turn."""

    ENDS = {"[/INST]": "user", "</s>": "assistant", "</t>": None}

    def __init__(self, turn: Callable[[str, str], None]) -> None:
        self.turn, self.role, self.text, self.tail = turn, "", [], ""

    def feed(self, piece: str) -> None:
        piece, at = self.tail + piece, 0
        for m in _TOKEN.finditer(piece):
            self.text.append(piece[at : m.start()])
            at, token = m.end(), m[0]
            if token[0] == "\\":
                self.text.append(token[1])
            elif token == "</r>":
                self.role, self.text = "".join(self.text), []
            elif token in self.ENDS:
                self.turn(self.ENDS[token] or self.role, "".join(self.text))
                self.role, self.text = "", []
            else:
                self.text = []
        rest = piece[at:]
        whole = _unfinished(rest)
        self.text.append(rest[:whole])
        self.tail = rest[whole:]


class Output:
    """A formatted conversation on its way out: its text, and the spans of it that the loss covers, by offsets.

    Both are read back from the text that has come out, `block` characters at a time: turns by a Reader, what is under
    the loss mask by cutting it out of the text and undoing its escapes.
    """

    def __init__(self, turn: Callable[[str, str], None], masked: Callable[[str], None], block: int = 1 << 16) -> None:
        self.reader, self.masked, self.block = Reader(turn), masked, block
        self.parts: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.base = self.size = 0
        self.tail = ""

    def emit(self, piece: str, generated: bool) -> None:
        if generated and piece:
            self.spans.append((self.size, self.size + len(piece)))
        self.parts.append(piece)
        self.size += len(piece)
        if self.size - self.base >= self.block:
            self.read()

    def read(self) -> None:
        text = "".join(self.parts)
        self.reader.feed(text)
        for a, b in self.spans:
            part = self.tail + text[a - self.base : b - self.base]
            # a backslash whose partner is still to come
            odd = (len(part) - len(part.rstrip("\\"))) % 2
            self.tail = part[len(part) - odd :]
            self.masked(unescape(part[: len(part) - odd]))
        self.parts, self.spans, self.base = [], [], self.size


def read_back(formatted: str) -> list[tuple[str, str]]:
    turns: list[tuple[str, str]] = []
    Reader(lambda r, t: turns.append((r, t))).feed(formatted)
    return turns


def _ordered(df: DataFrame) -> DataFrame:
    cols = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return cols.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conversation id, messages) in turn, without holding a conversation."""

    def rows():
        for b in batches:
            yield from zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist())

    for conv, group in itertools.groupby(rows(), key=lambda r: r[0]):
        yield conv, ({"role": r, "text": t} for _, r, t in group)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def format_conversations(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans): the whole text of each conversation and what the loss covers."""
    schema = T.StructType().add("conv_id", df.schema["conv_id"].dataType).add("n_turns", "long").add("formatted", "string")
    schema = schema.add("loss_spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
    parse(template)

    def run(batches):
        compiled = Template(template)

        def rows():
            for conv, messages in _conversations(batches):
                n = itertools.count()
                text, spans = compiled.render(m for m, _ in zip(messages, n))
                yield conv, next(n), text, [{"start": a, "end": b} for a, b in spans]

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield from _in_batches(rows(), pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", span)]), 100)

    return _ordered(df.withColumn("conv_id", F.col("conv_id").cast("long"))).mapInArrow(run, schema)


def conversation_digests(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Per conversation, what is read back from its formatted output, a block of it at a time."""
    parse(template)

    def run(batches):
        compiled = Template(template)

        def rows():
            for conv, messages in _conversations(batches):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                counts = [0, 0]

                def turn(role, text, turns=turns, counts=counts):
                    turns.update(f"{role}\n{text}\n".encode())
                    counts[0] += 1

                def masked(text, loss=loss, counts=counts):
                    loss.update(text.encode())
                    counts[1] += len(text)

                out = Output(turn, masked)
                compiled.pieces(messages, out.emit)
                out.read()
                yield conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), out.size

        yield from _in_batches(rows(), pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return _ordered(df.withColumn("conv_id", F.col("conv_id").cast("long"))).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and read back from the output."""
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return conversation_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))
