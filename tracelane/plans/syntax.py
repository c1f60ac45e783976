"""The rule language: tokens, syntax tree and a Pratt parser. Precedence follows Python's."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class PolicyError(Exception):
    """A policy that can't be loaded. The message shows the line and a caret under the place."""

    def __init__(self, message: str, source: str = "", at: int | None = None):
        if at is not None:
            line = source.count("\n", 0, at)
            begin = source.rfind("\n", 0, at) + 1
            end = source.find("\n", at)
            excerpt = source[begin : len(source) if end < 0 else end]
            message = f"{message} (line {line + 1})\n  {excerpt}\n  {' ' * (at - begin)}^"
        super().__init__(message)


@dataclass(frozen=True)
class Node:
    kind: str
    value: Any = None
    parts: tuple = ()
    at: int = field(default=0, compare=False)

    def walk(self):
        yield self
        for p in self.parts:
            if isinstance(p, Node):
                yield from p.walk()


@dataclass(frozen=True)
class Rule:
    head: Node
    body: tuple
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Predicate:
    name: str
    parameters: tuple  # (name, type name)
    body: tuple


@dataclass
class Module:
    source: str
    imports: dict = field(default_factory=dict)  # local name -> last part of what it names
    constants: dict = field(default_factory=dict)
    predicates: dict = field(default_factory=dict)
    functions: list = field(default_factory=list)
    rules: list = field(default_factory=list)


TOKEN = re.compile(
    r"""(?P<blank>[ \t]+|\\\n)|(?P<comment>\#[^\n]*)|(?P<newline>\n)
    |(?P<string>[rf]?(?:'''(?:.|\n)*?'''|\"\"\"(?:.|\n)*?\"\"\"|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"))
    |(?P<number>\d+\.\d+|\d+)|(?P<tool>tool:[A-Za-z_]\w*)|(?P<ref><[A-Z_]+>)|(?P<name>[A-Za-z_]\w*)
    |(?P<op>:=|->|~>|==|!=|<=|>=|\*\*|[-+*/%<>()\[\]{},.:=])""",
    re.X,
)
KEYWORDS = {"raise", "if", "else", "import", "from", "as", "and", "or", "not", "in", "is", "contains_only", "for", "def", "return", "True", "False", "None"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


#: Operators that can't end a line: it goes on with the next one.
OPEN_ENDED = {"and", "or", "not", "in", "is", "contains_only", "==", "!=", "<", "<=", ">", ">=", "+", "-", "/", "%", "**", "->", "~>"}
_GOES_ON = re.compile(r"\n(?:[ \t]*(?:\#[^\n]*)?\n)*[ \t]*(?:and|or)\b")


def continues(out: list[Token], source: str, at: int) -> bool:
    """Whether the line that ends here goes on: after an operator, or before a line that begins with `and` or `or`."""
    after = bool(out) and out[-1].kind in ("op", "keyword") and out[-1].text in OPEN_ENDED
    return after or bool(out) and out[-1].kind != "newline" and bool(_GOES_ON.match(source, at))


def tokens(source: str) -> list[Token]:
    """Tokens with `indent` and `dedent`; line ends within brackets don't count."""
    out: list[Token] = []
    stack, depth, at, fresh = [0], 0, 0, True
    while at < len(source):
        if fresh and not depth:
            m = re.compile(r"[ \t]*").match(source, at)
            rest = source[m.end() : m.end() + 1]
            if rest in ("\n", "#", ""):
                at = m.end()
                if rest == "#":
                    at = source.find("\n", at) if "\n" in source[at:] else len(source)
                at += 1
                continue
            width = len(m.group().expandtabs(4))
            if width > stack[-1]:
                stack.append(width)
                out.append(Token("indent", "", m.end()))
            while width < stack[-1]:
                stack.pop()
                out.append(Token("dedent", "", m.end()))
            if width != stack[-1]:
                raise PolicyError("inconsistent indentation", source, m.end())
            at, fresh = m.end(), False
        m = TOKEN.match(source, at)
        if not m:
            raise PolicyError(f"unexpected character {source[at]!r}", source, at)
        kind, text = m.lastgroup, m.group()
        if kind == "newline":
            if not depth and not continues(out, source, at):
                out.append(Token("newline", "", at))
                fresh = True
        elif kind not in ("blank", "comment"):
            depth += (text in ("(", "[", "{")) - (text in (")", "]", "}")) if kind == "op" else 0
            out.append(Token("keyword" if kind == "name" and text in KEYWORDS else kind, text, at))
        at = m.end()
    out.append(Token("newline", "", at))
    out += [Token("dedent", "", at)] * (len(stack) - 1) + [Token("end", "", at)]
    return out


def text_of(literal: str) -> str:
    """The value of a string literal. Only an escaped quote and an escaped line end are unescaped; f-strings aren't interpolated."""
    body = literal[1:] if literal[0] in "rf" else literal
    quote = body[:3] if body[:3] in ("'''", '"""') else body[0]
    inner = body[len(quote) : -len(quote)]
    return inner.replace("\\" + quote[0], quote[0])


BINARY = {"or": 10, "and": 20, "in": 40, "is": 40, "contains_only": 40, "==": 40, "!=": 40, "<": 40, "<=": 40, ">": 40, ">=": 40, "+": 50, "-": 50, "*": 60, "/": 60, "%": 60, "**": 80}


class Parser:
    def __init__(self, source: str):
        self.source, self.all, self.i = source, tokens(source), 0

    @property
    def now(self) -> Token:
        return self.all[self.i]

    def fail(self, message: str, token: Token | None = None):
        raise PolicyError(message, self.source, (token or self.now).at)

    def take(self, text: str | None = None, kind: str | None = None) -> Token:
        t = self.now
        if (text is not None and t.text != text) or (kind is not None and t.kind != kind):
            self.fail(f"expected {text or kind}, found {t.text or t.kind}")
        self.i += 1
        return t

    def has(self, text: str, ahead: int = 0) -> bool:
        t = self.all[min(self.i + ahead, len(self.all) - 1)]
        return t.text == text and t.kind in ("op", "keyword")

    # -- statements

    def module(self) -> Module:
        out = Module(self.source)
        while self.now.kind != "end":
            t = self.now
            if t.kind == "newline":
                self.i += 1
            elif self.has("import") or self.has("from"):
                self.imports(out)
            elif self.has("raise"):
                self.i += 1
                head = self.expression(stop_at_if=True)
                self.take("if")
                self.take(":")
                out.rules.append(Rule(head, self.block(), t.at))
            elif self.has("def"):
                self.skip_function(out)
            elif t.kind == "name":
                self.definition(out)
            else:
                self.fail(f"unexpected {t.text or t.kind}")
        return out

    def dotted(self) -> str:
        name = self.take(kind="name").text
        while self.has("."):
            self.i += 1
            name += "." + self.take(kind="name").text
        return name

    def imports(self, out: Module) -> None:
        if self.take().text == "import":
            name = self.dotted()
            local = name
            if self.has("as"):
                self.i += 1
                local = self.take(kind="name").text
            out.imports[local.split(".")[0]] = name
        else:
            module = self.dotted()
            self.take("import")
            closing = self.has("(")
            if closing:
                self.i += 1
            while True:
                name = "*" if self.has("*") else None
                name = self.take().text if name else self.take(kind="name").text
                local = name
                if self.has("as"):
                    self.i += 1
                    local = self.take(kind="name").text
                out.imports[local] = f"{module}.{name}"
                if not self.has(","):
                    break
                self.i += 1
            if closing:
                self.take(")")
        self.take(kind="newline")

    def skip_function(self, out: Module) -> None:
        """`def` bodies are read and never evaluated."""
        self.i += 1
        out.functions.append(self.take(kind="name").text)
        while self.now.kind != "indent":
            if self.now.kind == "end":
                self.fail("a function has no body")
            self.i += 1
        depth = 0
        while True:
            depth += (self.now.kind == "indent") - (self.now.kind == "dedent")
            self.i += 1
            if depth == 0:
                return

    def definition(self, out: Module) -> None:
        name = self.take(kind="name")
        if self.has("("):
            self.i += 1
            parameters = []
            while not self.has(")"):
                p = self.take(kind="name").text
                self.take(":")
                parameters.append((p, self.take(kind="name").text))
                if self.has(","):
                    self.i += 1
            self.take(")")
            self.take(":=")
            body = self.block() if self.now.kind == "newline" else (self.expression(),)
            if name.text in out.predicates:
                self.fail(f"{name.text} is defined twice", name)
            out.predicates[name.text] = Predicate(name.text, tuple(parameters), body)
        else:
            self.take(":=")
            if self.now.kind == "newline":
                self.i += 1
                self.take(kind="indent")
                out.constants[name.text] = self.expression()
                self.take(kind="newline")
                self.take(kind="dedent")
            else:
                out.constants[name.text] = self.expression()

    def block(self) -> tuple:
        self.take(kind="newline")
        self.take(kind="indent")
        lines = []
        while self.now.kind != "dedent":
            if self.now.kind == "newline":
                self.i += 1
                continue
            lines.append(self.line())
        self.i += 1
        return tuple(lines)

    def line(self) -> Node:
        e = self.expression()
        if self.has(":") and (e.kind in ("call", "name") or e.kind == "unary" and e.value == "not"):
            self.i += 1
            inner, negated = (e.parts[0], True) if e.kind == "unary" else (e, False)
            call = inner if inner.kind == "call" else Node("call", inner, (), inner.at)
            q = Node("quantifier", (call.value.value, dict(call.parts[1]) if len(call.parts) > 1 else {}), self.block(), e.at)
            return Node("unary", "not", (q,), e.at) if negated else q
        self.take(kind="newline")
        return e

    # -- expressions

    def expression(self, stop_at_if: bool = False) -> Node:
        left = self.binary(0)
        if self.has(":="):
            if left.kind != "name":
                self.fail("only a name can be assigned to")
            self.i += 1
            return Node("assign", left.value, (self.expression(),), left.at)
        if self.has("->") or self.has("~>"):
            op = self.take()
            right = self.binary(0)
            if left.kind not in ("name", "typed") or right.kind not in ("name", "typed"):
                self.fail("flow operators take variables only", op)
            if self.has("->") or self.has("~>"):
                self.fail("flow operators can't be chained")
            return Node("flow", op.text, (left, right), op.at)
        if self.has("if") and not stop_at_if:
            self.i += 1
            condition = self.binary(0)
            self.take("else")
            return Node("ternary", None, (condition, left, self.expression()), left.at)
        return left

    def binary(self, least: int) -> Node:
        if self.has("not") and least <= 30:
            t = self.take()
            left = Node("unary", "not", (self.binary(30),), t.at)
        else:
            left = self.unary()
        while self.now.kind in ("op", "keyword") and (power := BINARY.get(self.now.text)) and power > least:
            op = self.take()
            if op.text == "is" and self.has("not"):
                self.i += 1
                left = Node("unary", "not", (Node("binary", "is", (left, self.binary(power)), op.at),), op.at)
            elif op.text in ("in", "is"):
                left = Node("binary", op.text, (left, self.binary(power)), op.at)
            else:
                left = Node("binary", op.text, (left, self.binary(power - (op.text == "**"))), op.at)
        return left

    def unary(self) -> Node:
        if self.now.kind == "op" and self.now.text in ("-", "+"):
            t = self.take()
            return Node("unary", t.text, (self.unary(),), t.at)
        return self.postfix(self.primary())

    def postfix(self, e: Node) -> Node:
        while True:
            if self.has("."):
                self.i += 1
                t = self.take()
                if t.kind not in ("name", "keyword"):
                    self.fail("expected a name", t)
                e = Node("member", t.text, (e,), t.at)
            elif self.has("["):
                t = self.take()
                e = Node("key", None, (e, self.expression()), t.at)
                self.take("]")
            elif self.has("("):
                e = self.call(e)
            else:
                return e

    def call(self, e: Node) -> Node:
        t = self.take("(")
        args, named = [], []
        while not self.has(")"):
            if self.now.kind == "name" and self.has("=", 1):
                name = self.take().text
                self.i += 1
                named.append((name, self.expression()))
            else:
                args.append(Node("wildcard", None, (), self.take().at) if self.has("*") else self.expression())
            if not self.has(")"):
                self.take(",")
        self.take(")")
        if e.kind == "tool":
            return Node("pattern", e.value, tuple(args), t.at)
        return Node("call", e, (tuple(args), tuple(named)), t.at)

    def primary(self) -> Node:
        t = self.now
        self.i += 1
        if t.kind == "number":
            return Node("number", float(t.text) if "." in t.text else int(t.text), (), t.at)
        if t.kind == "string":
            return Node("string", text_of(t.text), (), t.at)
        if t.kind == "tool":
            return Node("tool", t.text[5:], (), t.at)
        if t.kind == "ref":
            return Node("ref", t.text[1:-1], (), t.at)
        if t.kind == "name":
            return Node("name", t.text, (), t.at)
        if t.text in ("True", "False", "None"):
            return Node("const", {"True": True, "False": False, "None": None}[t.text], (), t.at)
        if t.text == "*":
            return Node("wildcard", None, (), t.at)
        if t.text == "(":
            if self.now.kind == "name" and self.has(":", 1):
                name = self.take().text
                self.i += 1
                type_name = self.dotted()
                self.take(")")
                node = Node("typed", (name, type_name), (), t.at)
                if self.has("in"):
                    self.i += 1
                    return Node("typed_in", (name, type_name), (self.binary(40),), t.at)
                return node
            e = self.expression()
            if self.has(","):
                items = [e]
                while self.has(","):
                    self.i += 1
                    if not self.has(")"):
                        items.append(self.expression())
                self.take(")")
                return Node("list", None, tuple(items), t.at)
            self.take(")")
            return e
        if t.text == "[":
            items = []
            while not self.has("]"):
                items.append(self.expression())
                if len(items) == 1 and self.has("for"):
                    self.i += 1
                    var = self.take(kind="name").text
                    self.take("in")
                    source = self.binary(0)
                    condition = None
                    if self.has("if"):
                        self.i += 1
                        condition = self.binary(0)
                    self.take("]")
                    return Node("comprehension", var, (items[0], source, *([condition] if condition else [])), t.at)
                if not self.has("]"):
                    self.take(",")
            self.take("]")
            return Node("list", None, tuple(items), t.at)
        if t.text == "{":
            entries = []
            while not self.has("}"):
                k = self.take()
                if k.kind not in ("string", "name"):
                    self.fail("a key must be a string or a name", k)
                self.take(":")
                entries.append(Node("entry", text_of(k.text) if k.kind == "string" else k.text, (self.expression(),), k.at))
                if not self.has("}"):
                    self.take(",")
            self.take("}")
            return Node("dict", None, tuple(entries), t.at)
        self.fail(f"unexpected {t.text or t.kind}", t)


def parse(source: str) -> Module:
    import textwrap

    return Parser(textwrap.dedent(source).strip("\n") + "\n").module()
