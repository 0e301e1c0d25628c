"""Constant values of expressions, from literals alone or with the named constants of their file.

A value is text: a whole number in decimal digits; a string's content behind one quotation mark, or
behind a backslash in hexadecimal digits where its bytes are not UTF-8; ``true`` or ``false``.
Expressions whose value is not known so have none.
"""

from __future__ import annotations

import re

from .parser import Node

_DIGITS = {"x": 16, "b": 2, "o": 8}
#: Fixed values of the language.
_PLAIN_ESCAPES = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, "'": 39, '"': 34}
_ESCAPE = re.compile(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[0-7]{3}|.)", re.S)


def bare(n: Node) -> Node:
    """The expression inside all parentheses."""
    while n.kind == "Paren" and n.children:
        n = n.children[0]
    return n


def _whole(text: str) -> int | None:
    plain = text.replace("_", "").lower()
    try:
        if len(plain) > 1 and plain[0] == "0":
            return int(plain[2:], _DIGITS[plain[1]]) if plain[1] in _DIGITS else int(plain, 8)
        return int(plain)
    except ValueError:
        return None


def _unescaped(text: str) -> bytes:
    out, at = bytearray(), 0
    for m in _ESCAPE.finditer(text):
        out += text[at : m.start()].encode()
        code, at = m[1], m.end()
        if code[0] == "x" and len(code) == 3:
            out.append(int(code[1:], 16))
        elif code[0] in "uU" and len(code) > 1:
            out += chr(min(int(code[1:], 16), 0x10FFFF)).encode("utf-8", "replace")
        elif code.isdigit():
            out.append(int(code, 8) & 255)
        else:
            out.append(_PLAIN_ESCAPES.get(code, 63))
    return bytes(out + text[at:].encode())


def text_value(content: bytes) -> str:
    try:
        return '"' + content.decode()
    except UnicodeDecodeError:
        return "\\" + content.hex()


def _content(value: str) -> bytes:
    return value[1:].encode() if value[0] == '"' else bytes.fromhex(value[1:])


def literal(n: Node) -> str | None:
    """The value of a literal, in parentheses or not."""
    n = bare(n)
    if n.kind == "Ident" and n.name in ("true", "false"):
        return n.name
    if n.kind != "BasicLit" or not n.name:
        return None
    first = n.name[0]
    if first == "`":
        return text_value(n.name[1:-1].replace("\r", "").encode())
    if first == '"':
        return text_value(_unescaped(n.name[1:-1]))
    if first == "'":
        content = n.name[1:-1]
        if len(content) > 1 and content[0] == "\\" and content[1] in "x01234567":
            return str(_unescaped(content)[0])
        rune = _unescaped(content).decode("utf-8", "replace")
        return str(ord(rune)) if len(rune) == 1 else None
    if re.fullmatch(r"0[xX][0-9A-Fa-f_]+|0[bBoO]?[0-7_]*|[0-9_]+", n.name):
        number = _whole(n.name)
        return None if number is None else str(number)
    return None


def constant(n: Node, named: dict[str, str], depth: int = 0) -> str | None:
    """The value of an expression of literals, named constants, ``+`` on strings and whole-number arithmetic."""
    n = bare(n)
    if (value := literal(n)) is not None:
        return value
    if n.kind == "Ident":
        return named.get(n.name)
    if depth > 50 or n.kind not in ("Binary", "Unary"):
        return None
    parts = [constant(c, named, depth + 1) for c in n.children]
    if None in parts or any(p in ("true", "false") for p in parts):
        return None
    if all(p[0] in '"\\' for p in parts):
        return text_value(b"".join(map(_content, parts))) if n.kind == "Binary" and n.name == "+" else None
    if any(p[0] in '"\\' for p in parts) or max(map(len, parts)) > 60:
        return None
    numbers = [int(p) for p in parts]
    if n.kind == "Unary":
        return str(-numbers[0]) if n.name == "-" else str(numbers[0]) if n.name == "+" else None
    a, b = numbers
    if n.name in ("/", "%"):
        if not b:
            return None
        whole = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return str(whole if n.name == "/" else a - b * whole)
    if n.name in ("<<", ">>"):
        return str(a << b if n.name == "<<" else a >> b) if 0 <= b < 200 else None
    got = {"+": a + b, "-": a - b, "*": a * b, "|": a | b, "&": a & b, "^": a ^ b}.get(n.name)
    return None if got is None else str(got)


def named_constants(root: Node) -> dict[str, str]:
    """Values of the constants whose names are declared once in the file."""
    specs, declared = [], {}
    stack = [root]
    while stack:
        n = stack.pop()
        if n.kind == "ConstSpec":
            names, values = ([c for c in n.children if c.role == role] for role in ("name", "value"))
            if len(names) == len(values):
                specs += zip([c.name for c in names], values, strict=True)
        for c in n.children:
            if c.kind == "Ident" and (c.role == "name" or c.role == "left" and n.kind == "AssignStmt" and n.name == ":="):
                declared[c.name] = declared.get(c.name, 0) + 1
        stack.extend(n.children)
    out: dict[str, str] = {}
    for _ in range(3):  # constants of constants
        for name, value in specs:
            if declared.get(name) == 1 and name not in out and (got := constant(value, out)) is not None:
                out[name] = got
    return out


def imported(root: Node) -> dict[str, str]:
    """Import paths by the names under which the file uses them; names that the file declares itself are left out."""
    out, declared, stack = {}, set(), [root]
    while stack:
        n = stack.pop()
        if n.kind == "ImportSpec":
            path = n.name[1:-1]
            alias = next((c.name for c in n.children if c.role == "alias"), None)
            last = path.rsplit("/", 1)
            base = last[0].rsplit("/", 1)[-1] if len(last) == 2 and re.fullmatch(r"v[0-9]+", last[1]) else last[-1]
            out[alias or base] = path
            continue
        if n.kind == "AssignStmt" and n.name == ":=":
            declared.update(c.name for c in n.children if c.kind == "Ident" and c.role == "left")
        elif n.kind not in ("Field", "MethodSpec", "PackageClause", "MethodDecl"):
            declared.update(c.name for c in n.children if c.kind == "Ident" and c.role == "name")
        stack.extend(n.children)
    return {k: v for k, v in out.items() if k not in declared and k not in ("_", ".")}


def target(n: Node, packages: dict[str, str]) -> str:
    """What a call or selector names: ``import/path.Name`` where its package is imported, else its names behind ``~``."""
    n = bare(n)
    if n.kind == "Call" and n.children:
        return "" if bare(n.children[0]).kind == "Call" else target(n.children[0], packages)
    if n.kind == "Ident":
        return n.name
    if n.kind == "Selector" and len(n.children) == 2:
        x = bare(n.children[0])
        if x.kind == "Ident":
            return f"{packages.get(x.name, '~' + x.name)}.{n.name}"
        inner = target(x, packages) if x.kind == "Selector" else ""
        return f"{inner}.{n.name}"
    return ""
