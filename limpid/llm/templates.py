"""A compiler for chat templates: text to a syntax tree, constants folded, then Python closures.

The language: `{{ expression }}`, `{% for x in list %}`, `{% if %} {% elif %} {% else %}`, `{% set x = expression %}`,
`{% generation %}` around what a model is to learn, `{# comment #}`, and a minus beside a tag to trim white space.
Expressions have names, items (`m.role`, `m['role']`), text, whole numbers, true, false, none, `+` of texts or numbers, `==`, `!=`,
`in`, `not`, `and`, `or`, parentheses and filters (`| trim`).

It is a sandbox: a name is looked up among the values given and nowhere else, an item only in a dict, nothing can be
called but the filters below, and a loop runs over a list.  An unknown name or item is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

ESCAPE = "\\"


class TemplateError(ValueError):
    """A template that is not in the language, or one that asks for what is not there."""


# --- control strings -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Controls:
    """Strings that mark turns, and how a text that holds them is written so that it holds none.

    A control string in a text gets the escape character behind its first character, and an escape character is
    doubled.  No control string may begin as another (or itself) ends, so none can arise where a text meets one."""

    strings: tuple[str, ...]

    def __post_init__(self):
        for a in self.strings:
            if len(a) < 2 or ESCAPE in a:
                raise TemplateError(f"{a!r} cannot be a control string")
            for b in self.strings:
                if any(b.startswith(a[i:]) or a[i:].startswith(b) for i in range(1, len(a))):
                    raise TemplateError(f"the control string {b!r} can begin inside {a!r}")

    def escape(self, text: str) -> str:
        return self._found().sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if ESCAPE in text else text

    def _found(self) -> re.Pattern:
        # The escape character itself is doubled by the same rule: its first character, then the escape.
        return re.compile("|".join(map(re.escape, [*sorted(self.strings, key=len, reverse=True), ESCAPE])))


# --- reading -------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{-?(?P<out>.*?)-?\}\}|\{%-?(?P<tag>.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[|.\[\]()+,]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, content) of the template: text, out and tag; white space beside a minus is gone."""
    found, at, trim = [], 0, False

    def text(value: str, before_minus: bool) -> None:
        value = value.lstrip() if trim else value
        value = value.rstrip() if before_minus else value
        if value:
            found.append(("text", value))

    for m in _TAG.finditer(source):
        text(source[at : m.start()], m[0][2] == "-")
        at, trim = m.end(), m[0][-3] == "-"
        if m.lastgroup:
            found.append((m.lastgroup, m[m.lastgroup].strip()))
    text(source[at:], False)
    return found


# Nodes are (kind, ...) tuples.  Expressions: const value, name n, item e key, not e, op sign a b, filter f e args.
# Statements: text value, out e, for name e body, if [(e, body)] else, set name e, generation body.

class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "sign") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def either(self):
        left = self.both()
        while self.take("or"):
            left = ("op", "or", left, self.both())
        return left

    def both(self):
        left = self.negation()
        while self.take("and"):
            left = ("op", "and", left, self.negation())
        return left

    def negation(self):
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        left = self.total()
        while sign := self.take("==", "!=", "in"):
            left = ("op", sign, left, self.total())
        return left

    def total(self):
        left = self.filtered()
        while self.take("+"):
            left = ("op", "+", left, self.filtered())
        return left

    def filtered(self):
        value = self.item()
        while self.take("|"):
            name, args = self.word(), []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.either())
                    self.take(",")
            value = ("filter", name, value, args)
        return value

    def item(self):
        value = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                value = ("item", value, ("const", self.word()))
            else:
                value = ("item", value, self.either())
                self.need("]")
        return value

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self):
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return ("const", int(value))
        if kind == "name":
            return ("const", _WORDS[value]) if value in _WORDS else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    pieces = _pieces(source)
    at = 0

    def body(*ends: str) -> tuple[list[tuple], str]:
        """Statements up to a tag that starts with one of `ends`, and that tag."""
        nonlocal at
        out = []
        while at < len(pieces):
            kind, value = pieces[at]
            at += 1
            if kind == "text":
                out.append(("text", value))
            elif kind == "out":
                out.append(("out", _Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return out, value
                out.append(statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return out, ""

    def statement(word: str, rest: str) -> tuple:
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read the loop {rest!r}")
            return ("for", m[1], _Expression(m[2]).whole(), body("endfor")[0])
        if word == "if":
            branches, condition = [], rest
            while True:
                inner, end = body("elif", "else", "endif")
                branches.append((_Expression(condition).whole(), inner))
                if not end.startswith("elif"):
                    break
                condition = end[4:]
            return ("if", branches, body("endif")[0] if end == "else" else [])
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read the assignment {rest!r}")
            return ("set", m[1], _Expression(m[2]).whole())
        if word == "generation" and not rest:
            return ("generation", body("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    return body()[0]


# --- values --------------------------------------------------------------------------------------

def _text(value: Any) -> str:
    if value is None or isinstance(value, (dict, list)):
        raise TemplateError(f"a {type(value).__name__} is no text")
    return str(value).lower() if isinstance(value, bool) else str(value)


def _add(a, b):
    if type(a) is type(b) and type(a) in (str, int):
        return a + b
    raise TemplateError(f"cannot add {type(a).__name__} and {type(b).__name__}")


def _within(a, b):
    if isinstance(b, (dict, list)) or isinstance(a, str) and isinstance(b, str):
        return a in b
    raise TemplateError(f"nothing is in a {type(b).__name__}")


def _get(value, key):
    if not isinstance(value, dict) or key not in value:
        raise TemplateError(f"there is no item {key!r}")
    return value[key]


OPERATORS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": _add, "in": _within}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": len,
    "default": lambda v, other: other if v is None or v == "" else v,
}


# --- folding -------------------------------------------------------------------------------------

def fold_expression(tree: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with every part whose operands are constants replaced by its value."""
    kind = tree[0]
    if kind == "not":
        inner = fold_expression(tree[1], filters)
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind == "item":
        return ("item", fold_expression(tree[1], filters), fold_expression(tree[2], filters))
    if kind == "filter":
        _, name, value, args = tree
        if name not in filters:
            raise TemplateError(f"unknown filter {name!r}")
        value, args = fold_expression(value, filters), [fold_expression(a, filters) for a in args]
        if all(x[0] == "const" for x in (value, *args)):
            return ("const", filters[name](value[1], *[a[1] for a in args]))
        return ("filter", name, value, args)
    if kind == "op":
        _, sign, a, b = tree
        a, b = fold_expression(a, filters), fold_expression(b, filters)
        if sign in ("and", "or"):
            if a[0] == "const":  # the left side alone may decide
                return b if bool(a[1]) == (sign == "and") else a
        elif a[0] == b[0] == "const":
            return ("const", OPERATORS[sign](a[1], b[1]))
        return ("op", sign, a, b)
    return tree


def fold(body: list[tuple], filters: dict[str, Callable]) -> list[tuple]:
    """Statements with constant output as text, neighbouring texts joined and branches that are known chosen."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        kind = node[0]
        if kind == "out":
            value = fold_expression(node[1], filters)
            add(("text", _text(value[1])) if value[0] == "const" else ("out", value))
        elif kind == "for":
            add(("for", node[1], fold_expression(node[2], filters), fold(node[3], filters)))
        elif kind == "generation":
            add(("generation", fold(node[1], filters)))
        elif kind == "set":
            add(("set", node[1], fold_expression(node[2], filters)))
        elif kind == "if":
            branches, other = [], fold(node[2], filters)
            for condition, inner in node[1]:
                condition, inner = fold_expression(condition, filters), fold(inner, filters)
                if condition[0] != "const":
                    branches.append((condition, inner))
                elif condition[1]:
                    other = inner
                    break
            for x in [("if", branches, other)] if branches else other:
                add(x)
        else:
            add(node)
    return out


# --- closures ------------------------------------------------------------------------------------

@dataclass
class Output:
    """Rendered text, and the spans of code points inside generation tags."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    inside: bool = False

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def _value(tree: tuple, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    """A closure env -> value."""
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda env: value
    if kind == "name":
        name = tree[1]
        return lambda env: _get(env, name)
    if kind == "not":
        inner = _value(tree[1], filters)
        return lambda env: not inner(env)
    if kind == "item":
        owner, key = _value(tree[1], filters), _value(tree[2], filters)
        return lambda env: _get(owner(env), key(env))
    if kind == "filter":
        apply, value, args = filters[tree[1]], _value(tree[2], filters), [_value(a, filters) for a in tree[3]]
        return (lambda env: apply(value(env), *[a(env) for a in args])) if args else lambda env: apply(value(env))
    _, sign, a, b = tree
    left, right = _value(a, filters), _value(b, filters)
    if sign == "and":
        return lambda env: left(env) and right(env)
    if sign == "or":
        return lambda env: left(env) or right(env)
    operator = OPERATORS[sign]
    return lambda env: operator(left(env), right(env))


def _block(body: list[tuple], filters: dict[str, Callable]) -> Callable[[dict, Output], None]:
    steps = [_statement(node, filters) for node in body]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return steps[0] if len(steps) == 1 else run


def _statement(node: tuple, filters: dict[str, Callable]) -> Callable[[dict, Output], None]:
    """A closure (env, output) -> nothing."""
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, out: out.write(text)
    if kind == "out":
        value = _value(node[1], filters)
        return lambda env, out: out.write(_text(value(env)))
    if kind == "set":
        name, value = node[1], _value(node[2], filters)
        return lambda env, out: env.__setitem__(name, value(env))
    if kind == "if":
        branches, other = [(_value(c, filters), _block(b, filters)) for c, b in node[1]], _block(node[2], filters)

        def choose(env: dict, out: Output) -> None:
            for condition, inner in branches:
                if condition(env):
                    return inner(env, out)
            return other(env, out)

        return choose
    if kind == "generation":
        inside = _block(node[1], filters)

        def mark(env: dict, out: Output) -> None:
            if out.inside:
                raise TemplateError("generation inside generation")
            start, out.inside = out.size, True
            inside(env, out)
            out.inside = False
            if out.size > start:
                out.spans.append((start, out.size))

        return mark
    name, values, each = node[1], _value(node[2], filters), _block(node[3], filters)

    def loop(env: dict, out: Output) -> None:
        found = values(env)
        if not isinstance(found, list):
            raise TemplateError("a loop runs over a list")
        for i, x in enumerate(found):
            each(_scope(env, name, x, i, len(found)), out)

    return loop


def _scope(env: dict, name: str, value: Any, index: int, n: int) -> dict:
    """The values of one turn of a loop; what it sets ends with it."""
    return {**env, name: value, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": index == n - 1, "length": n}}


def _names(tree) -> set[str]:
    """Names that a tree reads."""
    if isinstance(tree, tuple) and tree and tree[0] == "name":
        return {tree[1]}
    return {n for x in tree for n in _names(x)} if isinstance(tree, (tuple, list)) else set()


class Template:
    """A compiled template: the filter `escape` knows its control strings."""

    def __init__(self, source: str, controls: Controls):
        self.filters = {**FILTERS, "escape": lambda v: controls.escape(_text(v))}
        # A constant can only be escaped, so `escape` folds as well.
        self.tree = fold(parse(source), self.filters)
        self.render_all = _block(self.tree, self.filters)

    def render(self, **values: Any) -> Output:
        out = Output()
        self.render_all(dict(values), out)
        return out

    def by_message(self) -> Messages:
        return Messages(self)


class Messages:
    """The same template one message at a time, for lists that are too long to hold.  It must have one loop over
    `messages` at its top level and use them nowhere else."""

    def __init__(self, template: Template):
        at = [i for i, node in enumerate(template.tree) if node[0] == "for" and node[2] == ("name", "messages")]
        if len(at) != 1 or "messages" in _names([template.tree[: at[0]], template.tree[at[0]][3], template.tree[at[0] + 1 :]]):
            raise TemplateError("the template must loop over messages once, at its top level")
        tree, filters = template.tree, template.filters
        self.name = tree[at[0]][1]
        self.before, self.each, self.after = (_block(b, filters) for b in (tree[: at[0]], tree[at[0]][3], tree[at[0] + 1 :]))

    def write(self, message: dict, index: int, n: int, out: Output) -> None:
        """Write the index-th of n messages, with what stands before the first and after the last.  What is set
        outside the loop is seen inside it."""
        env: dict = {}
        self.before(env, out if index == 0 else Output())
        self.each(_scope(env, self.name, message, index, n), out)
        if index == n - 1:
            self.after(env, out)
