r"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants are folded, and each node becomes a
Python closure.  The language:

    {{ expression }}    {# comment #}    {% set name = expression %}
    {% for name in expression %} … {% endfor %}          (loop.index0, loop.first, loop.last)
    {% if expression %} … {% elif expression %} … {% else %} … {% endif %}
    {% generation %} … {% endgeneration %}               (text under the loss mask)

with strings, integers, true, false, none, names, ``a.b``, ``a['b']``, ``+``, ``==``, ``!=``,
``<``, ``<=``, ``>``, ``>=``, ``in``, ``not``, ``and``, ``or`` and the filters of ``FILTERS``.  A ``-`` inside
a tag takes the white space beside it.  It is a sandbox: a template reaches the given values
and their items only, never a Python attribute, calls nothing but the filters, and loops over
given lists alone, so it ends.

``escape`` makes a text free of control strings: each occurrence, already with any number of
backslashes after its first character, gets one more.  ``unescape`` takes one away again.  A
control string has its first character nowhere else, so none can arise where a text meets
the template's own.

Turns are brought together by a sort within the partitions of the conversation's id and
streamed; a task holds one conversation at a time, whose formatted text is one value anyway.

Defined results: rows of a conversation are in the order of ``turn`` (null first), then role
and text; null texts and roles are empty; rows with a null id are one conversation; repeated
rows are turns of their own.  An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalign.llm.batches import arrow_type, map_arrow

#: Marks of the default template; their first characters occur in them nowhere else.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = """{{ '<s>' }}{% for message in messages -%}
  [INST]{{ message.role | escape }}[/INST]
  {%- if message.role == 'assistant' -%}
    {% generation %}{{ message.text | escape }}{% endgeneration %}
  {%- else -%}
    {{ message.text | escape }}
  {%- endif -%}
  </s>
{%- endfor %}"""


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    return _pattern(controls, "*").sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    return _pattern(controls, "+").sub(lambda m: m[0][0] + m[0][2:], text)


@functools.lru_cache(maxsize=None)
def _pattern(controls: tuple[str, ...], often: str) -> re.Pattern:
    if any(c[:1] in d[1:] or c[1:2] == "\\" for c in controls for d in controls):
        raise ValueError("the first character of a control string may occur in none of them again")
    return re.compile("|".join(rf"{re.escape(c[0])}\\{often}{re.escape(c[1:])}" for c in controls))


#: What a template may apply with ``|``.
FILTERS: dict[str, Callable[[Any], Any]] = {"escape": escape, "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}


# -- syntax tree ----------------------------------------------------------------------------


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Item(NamedTuple):
    of: Any
    key: Any


class Apply(NamedTuple):
    """An operator or a filter over its operands."""
    f: Callable
    args: tuple


class Either(NamedTuple):
    """``and`` (if ``stop`` is False) or ``or``: the right side counts only if the left doesn't decide."""
    left: Any
    right: Any
    stop: bool


class Text(NamedTuple):
    value: Any


class Loop(NamedTuple):
    name: str
    over: Any
    body: tuple


class Choice(NamedTuple):
    branches: tuple  # of (condition, body)


class Bind(NamedTuple):
    name: str
    value: Any


class Mask(NamedTuple):
    body: tuple


class TemplateError(ValueError):
    pass


_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z]\w*)|(?P<sign>==|!=|<=|>=|[-<>+|.()\[\]=]))", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b}
_WORDS = {"true": True, "false": False, "none": None}
_KEYWORDS = {"and", "or", "not", "in", "if", "else"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"what is this: {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.tokens.append(("end", ""))

    def peek(self, *values: str) -> bool:
        return self.tokens[0][0] != "string" and self.tokens[0][1] in values

    def take(self, *values: str) -> str:
        if values and not self.peek(*values):
            raise TemplateError(f"{' or '.join(values)} expected, not {self.tokens[0][1]!r}")
        return self.tokens.pop(0)[1]

    def identifier(self) -> str:
        kind, value = self.tokens.pop(0)
        if kind != "name" or value in _KEYWORDS or value in _WORDS:
            raise TemplateError(f"a name expected, not {value!r}")
        return value

    def end(self, found):
        if self.tokens[0][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return found

    def either(self):
        left = self.both()
        while self.peek("or"):
            self.take()
            left = Either(left, self.both(), True)
        return left

    def both(self):
        left = self.negated()
        while self.peek("and"):
            self.take()
            left = Either(left, self.negated(), False)
        return left

    def negated(self):
        if self.peek("not"):
            self.take()
            return Apply(operator.not_, (self.negated(),))
        left = self.sum()
        while self.peek(*_COMPARE):
            left = Apply(_COMPARE[self.take()], (left, self.sum()))
        return left

    def sum(self):
        left = self.filtered()
        while self.peek("+"):
            self.take()
            left = Apply(operator.add, (left, self.filtered()))
        return left

    def filtered(self):
        left = self.atom()
        while self.peek("|"):
            self.take()
            name = self.identifier()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            left = Apply(FILTERS[name], (left,))
        return left

    def atom(self):
        kind, value = self.tokens[0]
        if kind == "string":
            self.take()
            out = Const(re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "number":
            out = Const(int(self.take()))
        elif self.peek("("):
            self.take()
            out = self.either()
            self.take(")")
        elif value in _WORDS and kind == "name":
            out = Const(_WORDS[self.take()])
        else:
            out = Name(self.identifier())
        while self.peek(".", "["):
            if self.take() == ".":
                out = Item(out, Const(self.identifier()))
            else:
                out = Item(out, self.either())
                self.take("]")
        return out


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """(kind, content) of a template: text, print or tag, white space taken as the tags say."""
    at, strip = 0, False
    for tag in _TAG.finditer(source):
        before = source[at:tag.start()]
        before = before.lstrip() if strip else before
        yield "text", before.rstrip() if tag[1] or tag[4] or tag[7] else before
        if tag[2] is not None:
            yield "print", tag[2]
        elif tag[5] is not None:
            yield "tag", tag[5].strip()
        at, strip = tag.end(), bool(tag[3] or tag[6] or tag[8])
    yield "text", source[at:].lstrip() if strip else source[at:]


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces = list(_pieces(source))[::-1]

    def body(*ends: str) -> tuple[tuple, str]:
        """Nodes up to a tag that begins with one of ``ends``; that tag."""
        out: list = []
        while pieces:
            kind, content = pieces.pop()
            if kind == "text":
                if content:
                    out.append(Text(Const(content)))
                continue
            if kind == "print":
                e = _Expression(content)
                out.append(Text(e.end(e.either())))
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return tuple(out), content
            e = _Expression(rest)
            if word == "for":
                name = e.identifier()
                e.take("in")
                over = e.end(e.either())
                out.append(Loop(name, over, body("endfor")[0]))
            elif word == "if":
                branches, condition = [], e.end(e.either())
                while True:
                    inside, stop = body("elif", "else", "endif")
                    branches.append((condition, inside))
                    if stop == "endif":
                        break
                    if stop == "else":
                        branches.append((Const(True), body("endif")[0]))
                        break
                    e = _Expression(stop[4:])
                    condition = e.end(e.either())
                out.append(Choice(tuple(branches)))
            elif word == "set":
                name = e.identifier()
                e.take("=")
                out.append(Bind(name, e.end(e.either())))
            elif content == "generation":
                out.append(Mask(body("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {content!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    return body()[0]


# -- constant folding -----------------------------------------------------------------------


def fold(node):
    """The same node with everything computed that depends on no value."""
    if isinstance(node, Apply):
        args = tuple(map(fold, node.args))
        return Const(node.f(*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Apply(node.f, args)
    if isinstance(node, Either):
        left, right = fold(node.left), fold(node.right)
        if isinstance(left, Const):
            return left if bool(left.value) is node.stop else right
        return Either(left, right, node.stop)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    return node


def fold_body(nodes: tuple) -> tuple:
    """Statements with folded expressions, constant branches decided, adjacent texts joined."""
    out: list = []

    def add(node) -> None:
        if isinstance(node, Text) and isinstance(node.value, Const):
            text = _shown(node.value.value)
            if out and isinstance(out[-1], Text) and isinstance(out[-1].value, Const):
                text = out.pop().value.value + text
            node = Text(Const(text))
            if not text:
                return
        out.append(node)

    for node in nodes:
        if isinstance(node, Text):
            add(Text(fold(node.value)))
        elif isinstance(node, Loop):
            add(Loop(node.name, fold(node.over), fold_body(node.body)))
        elif isinstance(node, Mask):
            add(Mask(fold_body(node.body)))
        elif isinstance(node, Bind):
            add(Bind(node.name, fold(node.value)))
        else:
            branches = [(fold(condition), inside) for condition, inside in node.branches]
            branches = [(c, inside) for c, inside in branches if not isinstance(c, Const) or c.value]
            sure = next((i for i, (c, _) in enumerate(branches) if isinstance(c, Const)), len(branches))
            if sure == 0 and branches:
                for inner in fold_body(branches[0][1]):
                    add(inner)
            elif branches:
                add(Choice(tuple((c, fold_body(inside)) for c, inside in branches[:sure + 1])))
    return tuple(out)


# -- closures -------------------------------------------------------------------------------


class Page:
    """What is rendered: pieces of text, and the spans under the loss mask."""

    def __init__(self):
        self.parts, self.length, self.spans, self.open = [], 0, [], 0

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


def _item(of: Any, key: Any) -> Any:
    """An item of a given mapping or list; absent ones are none."""
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, list | tuple | str) and isinstance(key, int) and 0 <= key < len(of):
        return of[key]
    return None


def _value(node) -> Callable[[dict], Any]:
    """A closure that computes an expression from the names in scope."""
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)
        return lambda scope: _item(of(scope), key(scope))
    if isinstance(node, Either):
        left, right, stop = _value(node.left), _value(node.right), node.stop
        return lambda scope: found if bool(found := left(scope)) is stop else right(scope)
    f, args = node.f, tuple(map(_value, node.args))
    if len(args) == 1:
        only, = args
        return lambda scope: f(only(scope))
    x, y = args
    return lambda scope: f(x(scope), y(scope))


def _writer(node) -> Callable[[dict, Page], None]:
    """A closure that renders a statement."""
    if isinstance(node, Text):
        if isinstance(node.value, Const):
            text = node.value.value
            return lambda scope, page: page.add(text)
        value = _value(node.value)
        return lambda scope, page: page.add(_shown(value(scope)))
    if isinstance(node, Bind):
        name, value = node.name, _value(node.value)

        def bind(scope: dict, page: Page) -> None:
            scope[name] = value(scope)

        return bind
    if isinstance(node, Choice):
        branches = [(_value(condition), _body(inside)) for condition, inside in node.branches]

        def choose(scope: dict, page: Page) -> None:
            for condition, inside in branches:
                if condition(scope):
                    inside(scope, page)
                    return

        return choose
    inside = _body(node.body)
    if isinstance(node, Mask):

        def mask(scope: dict, page: Page) -> None:
            begin = page.length
            page.open += 1
            inside(scope, page)
            page.open -= 1
            if not page.open and page.length > begin:
                page.spans.append((begin, page.length))

        return mask
    name, over = node.name, _value(node.over)

    def loop(scope: dict, page: Page) -> None:
        given = over(scope) or ()
        for i, value in enumerate(given):
            inside({**scope, name: value, "loop": {"index0": i, "first": i == 0, "last": i == len(given) - 1}}, page)

    return loop


def _body(nodes: tuple) -> Callable[[dict, Page], None]:
    writers = [_writer(n) for n in nodes]

    def run(scope: dict, page: Page) -> None:
        for writer in writers:
            writer(scope, page)

    return run


@functools.lru_cache(maxsize=16)
def compiled(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from a template's values to the text and its spans under the loss mask."""
    render = _body(fold_body(parse(source)))

    def run(values: dict) -> tuple[str, list[tuple[int, int]]]:
        page = Page()
        render(dict(values), page)
        return "".join(page.parts), page.spans

    return run


# -- Spark ----------------------------------------------------------------------------------


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, list[dict]]]:
    """(id, turns) of rows (id, role, text) in which equal ids are adjacent."""
    current, turns = None, []
    for batch in batches:
        for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if turns and key != current:
                yield current, turns
                turns = []
            current = key
            turns.append({"role": role or "", "text": text or ""})
    if turns:
        yield current, turns


def formatted(df: DataFrame, template: str = TEMPLATE, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key``, n_turns, text, spans (begin, end in code points, under the loss mask) of every conversation."""
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    together = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    compiled(template)  # a faulty template stops here, not in a task

    def run(batches):
        render = compiled(template)
        for i, turns in conversations(batches):
            out, spans = render({"messages": turns})
            yield pa.RecordBatch.from_pylist(
                [{"id": i, "n_turns": len(turns), "text": out, "spans": [{"begin": b, "end": e} for b, e in spans]}], schema)

    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("id", arrow_type(rows, "id")), ("n_turns", pa.int64()), ("text", pa.string()), ("spans", pa.list_(span))])
    kind = rows.schema["id"].dataType.simpleString()
    out = map_arrow(together, run, f"id {kind}, n_turns long, text string, spans array<struct<begin: long, end: long>>")
    return out.withColumnRenamed("id", key)


_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a text of the default template."""
    out, at = [], len("<s>")
    if not text.startswith("<s>"):
        raise ValueError("the text doesn't begin with <s>")
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def read_back(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of what texts of the default template hold: turns, and text under the loss mask."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                turns = turns_of(text)
                loss = "".join(unescape(text[s["begin"]:s["end"]]) for s in spans)
                said = "".join(f"{role}\n{content}\n" for role, content in turns)
                rows.append((i, len(turns), _digest(said), len(loss), _digest(loss), len(text)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows], schema)

    names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (arrow_type(df, key), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    schema = pa.schema(list(zip(names, kinds)))
    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, "text", "spans"), run, f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM rows),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(text, '(<)(\\*/?s>)', '\1\\\2', 'g'), '(\[)(\\*/?INST\])', '\1\\\2', 'g') AS etext,
         regexp_replace(regexp_replace(role, '(<)(\\*/?s>)', '\1\\\2', 'g'), '(\[)(\\*/?INST\])', '\1\\\2', 'g') AS erole FROM marked)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(length(etext) + length(erole) + 6 + 7 + 4) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
