"""A small reader of JavaScript source: tokens, literals, and the calls and assignments that catalogs are made of.

It reads expressions into tuples and steps over what it doesn't know. Nodes are
  ("str", value) ("num", value) ("name", name) ("bool", value) ("null",)
  ("array", [node or None]) ("object", [(key, node)], plain) ("member", node, name)
  ("index", node, node) ("call", node, [node]) ("new", node, [node])
  ("unary", op, node) ("binary", op, node, node) ("assign", op, node, node)
  ("cond", test, yes, no) ("function", first token, last token) ("other",)
each wrapped as Node(kind, args, start, end) with token positions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)+", re.S)
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+n?|0[oO][0-7]+n?|0[bB][01]+n?|(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?n?")
_NAME = re.compile(r"#?[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*")
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
#: What single-letter escapes stand for, and words after which a slash begins a pattern.
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "else", "do", "yield", "await"}
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "in": 8, "instanceof": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "|=", "&=", "^=", "<<=", ">>=", ">>>=", "&&=", "||=", "??=", "**="}
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class JsError(ValueError):
    """Source that can't be read."""


class Token(NamedTuple):
    kind: str  # name, num, str, punct, regex, template
    text: str
    start: int
    end: int


class Node(NamedTuple):
    kind: str
    args: tuple
    start: int
    end: int


def unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        if code := m[1] or m[2] or m[3]:
            return chr(int(code, 16))
        return _SIMPLE.get(m[4], m[4])

    return _ESCAPE.sub(one, body) if "\\" in body else body


def _string_end(src: str, at: int) -> int:
    quote, i = src[at], at + 1
    while i < len(src):
        c = src[i]
        if c == "\\":
            i += 2
        elif c == quote:
            return i + 1
        elif c == "\n" and quote != "`":
            break
        elif quote == "`" and c == "$" and src.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(src) and depth:
                if src[i] in "'\"`":
                    i = _string_end(src, i)
                    continue
                depth += {"{": 1, "}": -1}.get(src[i], 0)
                i += 1
        else:
            i += 1
    raise JsError(f"string without end at {at}")


def tokens(src: str, tolerant: bool = True) -> list[Token]:
    """All tokens. What can't be read is stepped over, or is an error if not `tolerant`."""
    out: list[Token] = []
    i, n = 0, len(src)
    while i < n:
        if m := _SPACE.match(src, i):
            i = m.end()
            continue
        c = src[i]
        if c in "'\"`":
            try:
                end = _string_end(src, i)
                out.append(Token("template" if c == "`" else "str", src[i:end], i, end))
                i = end
                continue
            except JsError:
                if not tolerant:
                    raise
        elif m := _NAME.match(src, i):
            out.append(Token("name", m[0], i, m.end()))
            i = m.end()
            continue
        elif (c.isdigit() or c == ".") and (m := _NUMBER.match(src, i)):
            out.append(Token("num", m[0], i, m.end()))
            i = m.end()
            continue
        elif c == "/" and _regex_may_begin(out) and (m := _REGEX.match(src, i)):
            out.append(Token("regex", m[0], i, m.end()))
            i = m.end()
            continue
        elif m := _PUNCT.match(src, i):
            out.append(Token("punct", m[0], i, m.end()))
            i = m.end()
            continue
        elif not tolerant:
            raise JsError(f"unknown character at {i}")
        i += 1
    return out


def _regex_may_begin(before: list[Token]) -> bool:
    if not before:
        return True
    t = before[-1]
    return t.text in _BEFORE_REGEX if t.kind == "name" else t.kind == "punct" and t.text not in (")", "]", "}", "++", "--")


def matching(toks: list[Token]) -> dict[int, int]:
    """Position of the closing bracket of each opening one; unmatched ones are left out."""
    stack, out = [], {}
    for i, t in enumerate(toks):
        if t.kind != "punct":
            continue
        if t.text in _CLOSE:
            stack.append(i)
        elif t.text in ")]}":
            while stack and _CLOSE[toks[stack[-1]].text] != t.text:
                stack.pop()
            if stack:
                out[stack.pop()] = i
    return out


class Reader:
    """Reads expressions from a token list."""

    def __init__(self, src: str, tolerant: bool = True):
        self.src = src
        self.toks = tokens(src, tolerant)
        self.close = matching(self.toks)
        if not tolerant:
            opens = sum(t.kind == "punct" and t.text in _CLOSE for t in self.toks)
            if opens != len(self.close) or opens != sum(t.kind == "punct" and t.text in (")", "]", "}") for t in self.toks):
                raise JsError("brackets don't match")

    def text(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < len(self.toks) else ""

    def is_(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].text == text and self.toks[i].kind in ("punct", "name")

    def expression(self, i: int, least: int = 0) -> Node:
        """The expression that begins at token i, without the comma operator."""
        left = self._unary(i)
        while left.end < len(self.toks):
            t = self.toks[left.end]
            op = t.text if t.kind in ("punct", "name") else ""
            if op in _BINARY and _BINARY[op] >= max(1, least):
                right = self.expression(left.end + 1, _BINARY[op] + (op != "**"))
                left = Node("binary", (op, left, right), i, right.end)
            elif op in _ASSIGN and not least and left.kind in ("name", "member", "index", "array", "object"):
                right = self.expression(left.end + 1)
                left = Node("assign", (op, left, right), i, right.end)
            elif op == "?" and not least:
                yes = self.expression(left.end + 1)
                if not self.is_(yes.end, ":"):
                    return left
                no = self.expression(yes.end + 1)
                left = Node("cond", (left, yes, no), i, no.end)
            else:
                break
        return left

    def _unary(self, i: int) -> Node:
        t = self.text(i)
        if i < len(self.toks) and self.toks[i].kind in ("punct", "name") and t in ("!", "-", "+", "~", "typeof", "void", "delete", "await", "++", "--"):
            inner = self._unary(i + 1)
            return Node("unary", (t, inner), i, inner.end)
        return self._postfix(self._primary(i))

    def _postfix(self, node: Node) -> Node:
        while node.end < len(self.toks):
            t = self.toks[node.end]
            if t.kind == "template":
                node = Node("call", (node, []), node.start, node.end + 1)
            elif t.kind != "punct":
                break
            elif t.text in (".", "?.") and node.end + 1 < len(self.toks) and self.toks[node.end + 1].kind == "name":
                node = Node("member", (node, self.text(node.end + 1)), node.start, node.end + 2)
            elif t.text == "?." and self.text(node.end + 1) in ("(", "["):
                node = node._replace(end=node.end + 1)
            elif t.text == "[" and node.end in self.close:
                inner = self.expression(node.end + 1)
                shut = self.close[node.end] + 1
                node = Node("member", (node, unescape(inner_text(inner))), node.start, shut) if inner.kind == "str" else Node("index", (node, inner), node.start, shut)
            elif t.text == "(" and node.end in self.close:
                shut = self.close[node.end]
                node = Node("call", (node, self.items(node.end + 1, shut)), node.start, shut + 1)
            elif t.text in ("++", "--"):
                node = node._replace(end=node.end + 1)
            else:
                break
        return node

    def items(self, i: int, shut: int) -> list[Node | None]:
        """Comma-separated expressions up to a bracket; holes and spreads are None."""
        out: list[Node | None] = []
        while i < shut:
            if self.is_(i, ","):
                out.append(None)
                i += 1
                continue
            spread = self.is_(i, "...")
            node = self.expression(i + spread)
            out.append(None if spread else node)
            i = max(node.end, i + 1)
            while i < shut and not self.is_(i, ","):  # not understood: on to the next comma of this level
                i = self.close.get(i, i) + 1
            i += 1
        return out

    def _primary(self, i: int) -> Node:
        if i >= len(self.toks):
            return Node("other", (), i, i)
        t = self.toks[i]
        if t.kind == "str":
            return Node("str", (unescape(t.text[1:-1]),), i, i + 1)
        if t.kind == "template":
            plain = "${" not in t.text
            return Node("str", (unescape(t.text[1:-1]),), i, i + 1) if plain else Node("other", (), i, i + 1)
        if t.kind == "num":
            return Node("num", (number(t.text),), i, i + 1)
        if t.kind == "regex":
            return Node("other", (), i, i + 1)
        if t.kind == "name":
            return self._named(i, t.text)
        if t.text == "(" and i in self.close:
            return self._parens(i)
        if t.text == "[" and i in self.close:
            return Node("array", (self.items(i + 1, self.close[i]),), i, self.close[i] + 1)
        if t.text == "{" and i in self.close:
            return self.object(i)
        return Node("other", (), i, i + 1)

    def _named(self, i: int, name: str) -> Node:
        if name in ("true", "false"):
            return Node("bool", (name == "true",), i, i + 1)
        if name == "null":
            return Node("null", (), i, i + 1)
        if name in ("function", "async", "class") and (body := self._body(i)):
            return body
        if name == "new":
            callee = self._primary(i + 1)
            while self.is_(callee.end, ".") and callee.end + 1 < len(self.toks):
                callee = Node("member", (callee, self.text(callee.end + 1)), callee.start, callee.end + 2)
            args: list = []
            end = callee.end
            if self.is_(end, "(") and end in self.close:
                args, end = self.items(end + 1, self.close[end]), self.close[end] + 1
            return Node("new", (callee, args), i, end)
        if self.is_(i + 1, "=>"):
            return self._arrow(i, i + 2)
        return Node("name", (name,), i, i + 1)

    def _body(self, i: int) -> Node | None:
        """A function or class, as the tokens of its body."""
        j = i
        while j < len(self.toks) and not self.is_(j, "{"):
            if self.is_(j, "("):
                j = self.close.get(j, j)
                if self.is_(j + 1, "=>"):
                    return self._arrow(i, j + 2)
            elif self.toks[j].kind == "punct" and self.text(j) not in ("*", ".", "=>"):
                return None
            j += 1
        return Node("function", (j, self.close[j]), i, self.close[j] + 1) if j in self.close else None

    def _arrow(self, start: int, body: int) -> Node:
        if self.is_(body, "{") and body in self.close:
            return Node("function", (body, self.close[body]), start, self.close[body] + 1)
        inner = self.expression(body)
        return Node("function", (body, inner.end), start, inner.end)

    def _parens(self, i: int) -> Node:
        shut = self.close[i]
        if self.is_(shut + 1, "=>"):
            return self._arrow(i, shut + 2)
        inside = self.items(i + 1, shut)
        last = next((x for x in reversed(inside) if x), None)
        return last._replace(start=i, end=shut + 1) if last else Node("other", (), i, shut + 1)

    def object(self, i: int) -> Node:
        """An object literal; `plain` says that each entry is a key with a value."""
        shut, j, out, plain = self.close[i], i + 1, [], True
        while j < shut:
            t = self.toks[j]
            if t.text == "," and t.kind == "punct":
                j += 1
                continue
            key = unescape(t.text[1:-1]) if t.kind == "str" else str(number(t.text)) if t.kind == "num" else t.text if t.kind == "name" else None
            if key is not None and self.is_(j + 1, ":"):
                value = self.expression(j + 2)
                out.append((key, value))
                j = max(value.end, j + 3)
            else:
                plain = False
                if t.kind == "name" and (self.is_(j + 1, ",") or j + 1 == shut):
                    out.append((t.text, Node("name", (t.text,), j, j + 1)))
            while j < shut and not self.is_(j, ","):
                if t.kind != "punct" and self.toks[j].text != "," and j == shut:
                    break
                j = self.close.get(j, j) + 1
        return Node("object", (out, plain), i, shut + 1)

    # What extractors look for, anywhere in the source.

    def calls(self) -> Iterator[Node]:
        """Every call whose callee begins at a name or a bracket, in order of its first token."""
        for i, t in enumerate(self.toks):
            if t.kind != "name" or self.is_(i - 1, ".") or self.is_(i - 1, "?.") or t.text in ("function", "return", "typeof", "new", "case"):
                continue
            node = self._postfix(self._named(i, t.text)) if not self.is_(i + 1, "=>") else None
            found = []
            while node is not None and node.kind in ("call", "member", "index"):
                if node.kind == "call":
                    found.append(node)
                node = node.args[0]
            yield from found

    def objects(self) -> Iterator[Node]:
        """Every bracket that reads as an object literal with an entry."""
        for i, t in enumerate(self.toks):
            if t.kind == "punct" and t.text == "{" and i in self.close and self.toks[i + 1].kind in ("name", "str", "num") and self.is_(i + 2, ":"):
                yield self.object(i)

    def declared(self) -> Iterator[tuple[str, Node]]:
        """(name, value) of each plain assignment to a name, declared or not."""
        for i, t in enumerate(self.toks):
            if t.kind == "name" and self.is_(i + 1, "=") and not self.is_(i - 1, ".") and not self.is_(i - 1, "?."):
                yield t.text, self.expression(i + 2)

    def assigned(self) -> Iterator[tuple[str, str, Node]]:
        """(object, property, value) of each assignment to a property of a name."""
        for i, t in enumerate(self.toks):
            if t.kind == "name" and self.is_(i + 1, ".") and i + 3 < len(self.toks) and self.toks[i + 2].kind == "name" and self.is_(i + 3, "=") and not self.is_(i - 1, "."):
                yield t.text, self.text(i + 2), self.expression(i + 4)

    def strings(self) -> Iterator[str]:
        for t in self.toks:
            if t.kind == "str":
                yield unescape(t.text[1:-1])


def inner_text(node: Node) -> str:
    return node.args[0] if node.kind == "str" else ""


def number(text: str) -> int | float:
    body = text.rstrip("n").replace("_", "") if text[:2].lower() != "0x" else text.rstrip("n")
    if body[:2].lower() in ("0x", "0o", "0b"):
        return int(body, 0)
    value = float(body)
    return int(value) if "." not in body and "e" not in body.lower() else value


# What values of nodes are.


def as_str(node: Node | None) -> str | None:
    return node.args[0] if node is not None and node.kind == "str" else None


def as_name(node: Node | None) -> str | None:
    return node.args[0] if node is not None and node.kind == "name" else None


def as_number(node: Node | None) -> int | float | None:
    """A numeric literal, also a negative one."""
    if node is None:
        return None
    if node.kind == "num":
        return node.args[0]
    if node.kind == "unary" and node.args[0] == "-":
        inner = as_number(node.args[1])
        return None if inner is None else -inner
    return None


def as_int(node: Node | None) -> int | None:
    value = as_number(node)
    return int(value) if value is not None and value == int(value) else None


def as_bool(node: Node | None) -> bool | None:
    """true and false, and their short forms !0 and !1."""
    if node is None:
        return None
    if node.kind == "bool":
        return node.args[0]
    if node.kind == "unary" and node.args[0] == "!":
        value = as_number(node.args[1])
        return None if value is None else value == 0
    return None


def as_array(node: Node | None) -> list[Node | None] | None:
    return node.args[0] if node is not None and node.kind == "array" else None


def as_object(node: Node | None) -> list[tuple[str, Node]] | None:
    return node.args[0] if node is not None and node.kind == "object" else None


def entry(node: Node | None, key: str) -> Node | None:
    """The first value of a key of an object literal."""
    return next((v for k, v in as_object(node) or () if k == key), None)


def required(node: Node | None) -> str | None:
    """The module of a call with one text as its first argument, r("module")."""
    if node is not None and node.kind == "assign":
        node = node.args[2]
    if node is not None and node.kind == "call" and node.args[0].kind == "name" and node.args[1]:
        return as_str(node.args[1][0])
    return None


def method(node: Node) -> str | None:
    """The name of the method that a call calls."""
    return node.args[0].args[1] if node.kind == "call" and node.args[0].kind == "member" else None


def alternatives(node: Node, op: str = "|") -> list[Node]:
    """The operands of a chain of one operator."""
    if node.kind == "binary" and node.args[0] == op:
        return alternatives(node.args[1], op) + alternatives(node.args[2], op)
    return [node]


class Definition(NamedTuple):
    name: str
    deps: list[str]
    start: int
    end: int
    factory_start: int
    factory_end: int


def definitions(src: str, strict: bool = False) -> list[Definition]:
    """The module definitions __d(name, [dependencies], factory, ...) of a source, with character offsets.

    Tolerant reading doesn't look inside a module that it has found, and steps
    over what it can't read; strict reading does look inside, and fails there.
    Dependencies that aren't texts are left out.
    """
    r = Reader(src, not strict)
    out, skip = [], -1
    for i, t in enumerate(r.toks):
        if i < skip or t.kind != "name" or t.text != "__d" or not r.is_(i + 1, "(") or i + 1 not in r.close or r.is_(i - 1, ".") or r.is_(i - 1, "function"):
            continue
        shut = r.close[i + 1]
        args = r.items(i + 2, shut)
        if len(args) < 3 or (name := as_str(args[0])) is None or args[2] is None:
            continue
        deps = [d for x in as_array(args[1]) or () if (d := as_str(x)) is not None]
        first, last = r.toks[args[2].start], r.toks[args[2].end - 1]
        out.append(Definition(name, deps, t.start, r.toks[shut].end, first.start, last.end))
        if not strict:
            skip = shut + 1
    return out
