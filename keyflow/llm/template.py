"""A small sandboxed template language: parsed to a syntax tree, constants folded, compiled to Python closures.

``{{ expr }}`` prints, ``{% for x in xs %}…{% endfor %}``, ``{% if e %}…{% elif e %}…{% else %}…{% endif %}``,
``{% set x = e %}``, ``{% generation %}…{% endgeneration %}`` marks what the model shall learn, ``{# … #}`` is a comment.
Expressions: strings, integers, true, false, none, names, ``x.field`` and ``x['field']`` on mappings only, ``+`` and ``~``,
comparisons, ``in``, and/or/not, ``a if c else b``, filters ``x|upper``. There are no calls, and no way to Python's own
attributes. ``loop.index0``, ``loop.index`` and ``loop.first`` exist inside a loop (not ``last``: the items may be a stream).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.\[\]()=]))""", re.S)
_WORDS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Print:
    expr: object


@dataclass(frozen=True)
class Set:
    name: str
    expr: object


@dataclass(frozen=True)
class If:
    cases: tuple  # of (condition, body)


@dataclass(frozen=True)
class For:
    name: str
    items: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Expression:
    def __init__(self, text: str, filters: dict):
        self.tokens, self.at, self.filters = [], 0, filters
        i, text = 0, text.strip()
        while i < len(text):
            m = _TOKEN.match(text, i)
            if not m:
                raise TemplateError(f"can't read {text[i:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            i = m.end()
            while i < len(text) and text[i].isspace():
                i += 1

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values)}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        name = self.tokens[self.at - 1][1]
        if name.startswith("_"):
            raise TemplateError(f"{name}: names can't begin with _")
        return name

    def end(self, found):
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def whole(self):
        return self.end(self.choice())

    def choice(self):
        x = self.either()
        if self.peek("if"):
            self.take("if")
            c = self.either()
            self.take("else")
            return Op("if", (c, x, self.choice()))
        return x

    def _chain(self, below: Callable, *ops: str):
        x = below()
        while self.peek(*ops):
            x = Op(self.take(*ops), (x, below()))
        return x

    def either(self):
        return self._chain(self.both, "or")

    def both(self):
        return self._chain(self.negated, "and")

    def negated(self):
        if self.peek("not"):
            self.take("not")
            return Op("not", (self.negated(),))
        return self._chain(self.joined, "==", "!=", "<", ">", "<=", ">=", "in")

    def joined(self):
        return self._chain(self.filtered, "+", "~")

    def filtered(self):
        x = self.part()
        while self.peek("|"):
            self.take("|")
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name}")
            x = Filter(name, x)
        return x

    def part(self):
        x = self.atom()
        while self.peek(".", "["):
            if self.take(".", "[") == ".":
                x = Field(x, Const(self.name()))
            else:
                x = Field(x, self.choice())
                self.take("]")
        return x

    def atom(self):
        if self.peek("("):
            self.take("(")
            x = self.choice()
            self.take(")")
            return x
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends too early")
        kind, text = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            self.at += 1
            return Const(int(text))
        if kind == "name" and text in _WORDS:
            self.at += 1
            return Const(_WORDS[text])
        return Name(self.name())


def parse(source: str, filters: dict) -> tuple:
    parts = [(p[:2], p[2:-2].strip("-").strip()) if _PARTS.fullmatch(p) else ("", p) for p in _PARTS.split(source) if p]
    at = 0

    def body(*ends: str):
        nonlocal at
        out = []
        while at < len(parts):
            kind, text = parts[at]
            at += 1
            if kind == "":
                out.append(Print(Const(text)))
            elif kind == "{{":
                out.append(Print(_Expression(text, filters).whole()))
            elif kind == "{%":
                word, _, rest = text.partition(" ")
                if word in ends:
                    return tuple(out), word, rest
                out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(out), "", ""

    def statement(word: str, rest: str):
        if word == "for":
            e = _Expression(rest, filters)
            name = e.name()
            e.take("in")
            items = e.whole()
            return For(name, items, body("endfor")[0])
        if word == "if":
            cases, condition = [], _Expression(rest, filters).whole()
            while True:
                inner, end, rest = body("elif", "else", "endif")
                cases.append((condition, inner))
                if end == "endif":
                    return If(tuple(cases))
                condition = Const(True) if end == "else" else _Expression(rest, filters).whole()
        if word == "set":
            e = _Expression(rest, filters)
            name = e.name()
            e.take("=")
            return Set(name, e.whole())
        if word == "generation":
            return Generation(body("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")

    return body()[0]


_OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "~": lambda a, b: _shown(a) + _shown(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not": lambda a: not a,
}


def _shown(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def _field(x, key):
    """A mapping's value; none for anything else, so that Python's attributes are out of reach."""
    return x.get(key) if isinstance(x, dict) else None


def fold(node, filters: dict):
    """The tree with constant parts worked out, dead branches gone and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in (fold(n, filters) for n in node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Print) and isinstance(y.expr, Const):
                    y = Print(Const(_shown(y.expr.value)))
                    if not y.expr.value:
                        continue
                    if out and isinstance(out[-1], Print) and isinstance(out[-1].expr, Const):
                        y = Print(Const(out.pop().expr.value + y.expr.value))
                out.append(y)
        return tuple(out)
    if isinstance(node, Print):
        return Print(fold(node.expr, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.expr, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.items, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):
        cases = []
        for c, inner in node.cases:
            c = fold(c, filters)
            if isinstance(c, Const) and not c.value:
                continue
            cases.append((c, fold(inner, filters)))
            if isinstance(c, Const):
                break
        if cases and isinstance(cases[0][0], Const):
            return cases[0][1]
        return If(tuple(cases)) if cases else ()
    if isinstance(node, Field):
        return Field(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Filter):
        of = fold(node.of, filters)
        return Const(filters[node.name](_shown(of.value))) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if node.op == "if" and isinstance(args[0], Const):
            return args[1] if args[0].value else args[2]
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op in _OPS and all(isinstance(a, Const) for a in args):
            try:
                return Const(_OPS[node.op](*(a.value for a in args)))
            except TypeError:  # an error only where it is reached
                pass
        return Op(node.op, args)
    return node


def _value(node, filters: dict) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, k=node.name: env.get(k)
    if isinstance(node, Field):
        of = _value(node.of, filters)
        if isinstance(node.key, Const):
            return lambda env, k=node.key.value: _field(of(env), k)
        key = _value(node.key, filters)
        return lambda env: _field(of(env), key(env))
    if isinstance(node, Filter):
        of, f = _value(node.of, filters), filters[node.name]
        return lambda env: f(_shown(of(env)))
    args = [_value(a, filters) for a in node.args]
    if node.op == "if":
        c, x, y = args
        return lambda env: x(env) if c(env) else y(env)
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    f = _OPS[node.op]
    if len(args) == 1:
        return lambda env: f(args[0](env))
    return lambda env: f(args[0](env), args[1](env))


Piece = tuple[str, bool]


def _body(nodes: tuple, filters: dict, learn: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step(n, filters, learn) for n in nodes]

    def run(env):
        for s in steps:
            yield from s(env)

    return run


def _step(node, filters: dict, learn: bool) -> Callable[[dict], Iterable[Piece]]:
    if isinstance(node, Print):
        if isinstance(node.expr, Const):
            piece = ((node.expr.value, learn),)
            return lambda env: piece
        value = _value(node.expr, filters)
        return lambda env: ((_shown(value(env)), learn),)
    if isinstance(node, Set):
        value = _value(node.expr, filters)

        def put(env):
            env[node.name] = value(env)
            return ()

        return put
    if isinstance(node, Generation):
        return _body(node.body, filters, True)
    if isinstance(node, If):
        cases = [(_value(c, filters), _body(b, filters, learn)) for c, b in node.cases]

        def choose(env):
            for c, b in cases:
                if c(env):
                    return b(env)
            return ()

        return choose
    items, inner = _value(node.items, filters), _body(node.body, filters, learn)

    def loop(env):
        for i, x in enumerate(items(env) or ()):
            yield from inner(env | {node.name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0}})

    return loop


FILTERS: dict[str, Callable[[str], str]] = {"upper": str.upper, "lower": str.lower, "trim": str.strip}


def compile_template(source: str, filters: dict | None = None) -> Callable[[dict], Iterator[Piece]]:
    """A function of the variables that yields (text, whether it is under a generation marker), piece by piece."""
    filters = FILTERS | (filters or {})
    return _body(fold(parse(source, filters), filters), filters, False)
