"""A recursive-descent Go parser whose tree has what checks ask for: declarations, statements, expressions.

A node has a kind, a byte range, an optional name (identifier, operator or literal text) and children
in order with roles. Types are expressions. Spelling is a node's tokens joined by single spaces, so
two nodes are spelt alike whatever their white space and comments.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .lexer import Source, SourceError, Token

_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_LITERALS = frozenset(["int", "float", "imag", "char", "string"])


@dataclass(slots=True)
class Node:
    kind: str
    start: int
    end: int = 0
    name: str = ""
    children: list[Node] = field(default_factory=list)
    role: str = ""
    first: int = 0  # token range
    last: int = 0

    def add(self, child: Node | None, role: str = "") -> Node | None:
        if child is not None:
            child.role = role or child.role
            self.children.append(child)
        return child

    def of(self, role: str) -> list[Node]:
        return [c for c in self.children if c.role == role]

    def one(self, role: str) -> Node | None:
        return next((c for c in self.children if c.role == role), None)


class Parser:
    def __init__(self, source: Source):
        self.source, self.t, self.i = source, source.tokens, 0
        self.no_literal = 0  # above 0: a brace opens a block, not a composite literal

    # --- tokens

    @property
    def tok(self) -> Token:
        return self.t[self.i]

    def at(self, *texts: str) -> bool:
        return self.tok.kind in ("op", "keyword") and self.tok.text in texts

    def take(self, text: str) -> bool:
        if self.at(text):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.at(text):
            line, col = self.source.position(self.tok.start)
            raise SourceError(f"{line}:{col}: expected {text!r}, found {self.tok.text!r}")
        self.i += 1
        return self.t[self.i - 1]

    def node(self, kind: str, name: str = "") -> Node:
        return Node(kind, self.tok.start, 0, name, first=self.i)

    def done(self, n: Node) -> Node:
        n.last = self.i
        k = self.i - 1
        while k > n.first and self.t[k].end == self.t[k].start:
            k -= 1
        n.end = self.t[k].end if self.i > n.first else n.start
        return n

    def around(self, kind: str, inner: Node, name: str = "") -> Node:
        """A node that begins where ``inner`` does."""
        return Node(kind, inner.start, 0, name, first=inner.first)

    def semi(self) -> None:
        if not self.at(")", "}") and not self.take(";") and self.tok.kind != "eof":
            self.need(";")

    def ident(self) -> Node:
        if self.tok.kind != "ident":
            self.need("identifier")
        n = self.node("Ident", self.tok.text)
        self.i += 1
        return self.done(n)

    # --- file and declarations

    def file(self) -> Node:
        n = self.node("SourceFile")
        package = self.node("PackageClause")
        self.need("package")
        package.name = package.add(self.ident(), "name").name
        n.add(self.done(package), "package")
        self.semi()
        while self.tok.kind != "eof":
            if self.at("import"):
                self.group("ImportDecl", self.import_spec, n)
            elif self.at("const", "var", "type"):
                self.declaration(n)
            elif self.at("func"):
                n.add(self.function(), "decl")
            elif not self.take(";"):
                self.need("declaration")
                continue
            self.take(";")
        return self.done(n)

    def group(self, kind: str, spec, parent: Node) -> None:
        n = self.node(kind)
        self.i += 1
        if self.take("("):
            while not self.at(")"):
                n.add(spec(), "spec")
                self.semi()
            self.need(")")
        else:
            n.add(spec(), "spec")
        parent.add(self.done(n), "decl")

    def declaration(self, parent: Node) -> None:
        kind = {"const": "ConstDecl", "var": "VarDecl", "type": "TypeDecl"}[self.tok.text]
        self.group(kind, self.type_spec if kind == "TypeDecl" else lambda: self.value_spec(kind[:-4] + "Spec"), parent)

    def import_spec(self) -> Node:
        n = self.node("ImportSpec")
        if self.tok.kind == "ident" or self.at("."):
            alias = self.node("Ident", self.tok.text)
            self.i += 1
            n.add(self.done(alias), "alias")
        path = n.add(self.operand(), "path")
        n.name = path.name
        return self.done(n)

    def value_spec(self, kind: str) -> Node:
        n = self.node(kind)
        n.add(self.ident(), "name")
        while self.take(","):
            n.add(self.ident(), "name")
        if not self.at("=", ";", ")"):
            n.add(self.type(), "type")
        if self.take("="):
            for e in self.expressions():
                n.add(e, "value")
        return self.done(n)

    def type_spec(self) -> Node:
        n = self.node("TypeSpec")
        n.name = n.add(self.ident(), "name").name
        if self.at("[") and self._type_parameters():
            self.type_parameters(n)
        self.take("=")
        n.add(self.type(), "type")
        return self.done(n)

    def _type_parameters(self) -> bool:
        """Whether the bracket opens type parameters: a name and then a type, not a length."""
        a, b = self.t[self.i + 1], self.t[self.i + 2]
        return a.kind == "ident" and (b.kind == "ident" or b.text in (",", "*", "[", "interface", "func", "chan", "map", "~", "(") and not (b.text in ("*", "(", "[") and self._closes_alone()))

    def _closes_alone(self) -> bool:
        depth, k = 0, self.i
        while self.t[k].kind != "eof":
            depth += self.t[k].text in ("[", "(") and self.t[k].kind == "op"
            depth -= self.t[k].text in ("]", ")") and self.t[k].kind == "op"
            if depth == 0:
                return self.t[k - 1].kind in ("int", "ident") and not any(x.text == "," for x in self.t[self.i : k])
            k += 1
        return True

    def type_parameters(self, n: Node) -> None:
        self.need("[")
        while not self.at("]"):
            p = self.node("TypeParam")
            p.add(self.ident(), "name")
            while self.take(","):
                p.add(self.ident(), "name")
            p.add(self.constraint(), "type")
            n.add(self.done(p), "typeparam")
            if not self.take(","):
                break
        self.need("]")

    def constraint(self) -> Node:
        def term() -> Node:
            if self.at("~"):
                u = self.node("Unary", "~")
                self.i += 1
                u.add(self.type(), "x")
                return self.done(u)
            return self.type()

        left = term()
        while self.at("|"):
            b = self.around("Binary", left, "|")
            self.i += 1
            b.add(left, "x")
            b.add(term(), "y")
            left = self.done(b)
        return left

    def function(self) -> Node:
        n = self.node("FunctionDecl")
        self.need("func")
        if self.at("("):
            n.kind = "MethodDecl"
            for p in self.parameters():
                n.add(p, "receiver")
        n.name = n.add(self.ident(), "name").name
        if self.at("["):
            self.type_parameters(n)
        self.signature(n)
        if self.at("{"):
            n.add(self.body(), "body")
        return self.done(n)

    def signature(self, n: Node) -> None:
        for p in self.parameters():
            n.add(p, "param")
        if self.at("("):
            for p in self.parameters():
                n.add(p, "result")
        elif self._starts_type():
            r = self.node("Param")
            r.add(self.type(), "type")
            n.add(self.done(r), "result")

    def _starts_type(self) -> bool:
        return self.tok.kind == "ident" or self.at("*", "[", "func", "map", "chan", "struct", "interface", "<-", "(")

    def parameters(self) -> list[Node]:
        """Parameters in order; each node has its names and one type."""
        self.need("(")
        entries = []
        while not self.at(")"):
            entry = self.node("Param")
            entry.add(self.variadic(), "type")
            if not self.at(",", ")"):
                name = entry.children.pop()
                entry.add(name, "name")
                entry.add(self.variadic(), "type")
            entries.append(self.done(entry))
            if not self.take(","):
                break
        self.need(")")
        if not any(e.of("name") for e in entries):
            return entries
        out, names = [], []
        for e in entries:
            if e.of("name"):
                for x in names:
                    x.role = "name"
                    e.start, e.first = min(e.start, x.start), min(e.first, x.first)
                e.children = names + e.children
                names = []
                out.append(e)
            else:
                names.append(e.children[0])
        return out

    def variadic(self) -> Node:
        if self.at("..."):
            n = self.node("Ellipsis")
            self.i += 1
            n.add(self.type(), "x")
            return self.done(n)
        return self.type()

    # --- types

    def type(self) -> Node:
        if self.at("*"):
            n = self.node("Star")
            self.i += 1
            n.add(self.type(), "x")
            return self.done(n)
        if self.at("("):
            n = self.node("Paren")
            self.i += 1
            n.add(self.type(), "x")
            self.need(")")
            return self.done(n)
        if self.at("["):
            n = self.node("ArrayType")
            self.i += 1
            if self.at("..."):
                self.i += 1
            elif not self.at("]"):
                n.add(self.free(self.expression), "len")
            self.need("]")
            n.add(self.type(), "elem")
            return self.done(n)
        if self.at("map"):
            n = self.node("MapType")
            self.i += 1
            self.need("[")
            n.add(self.type(), "key")
            self.need("]")
            n.add(self.type(), "elem")
            return self.done(n)
        if self.at("chan", "<-"):
            n = self.node("ChanType")
            self.take("<-")
            self.need("chan")
            self.take("<-")
            n.add(self.type(), "elem")
            return self.done(n)
        if self.at("func"):
            n = self.node("FuncType")
            self.i += 1
            self.signature(n)
            return self.done(n)
        if self.at("struct"):
            return self.struct()
        if self.at("interface"):
            return self.interface()
        n = self.ident()
        if self.at("."):
            s = self.around("Selector", n)
            self.i += 1
            s.add(n, "x")
            s.name = s.add(self.ident(), "sel").name
            n = self.done(s)
        if self.at("[") and not (self.t[self.i + 1].text == "]" and self.t[self.i + 1].kind == "op"):
            x = self.around("Index", n)
            self.i += 1
            x.add(n, "x")
            x.add(self.type(), "index")
            while self.take(","):
                x.add(self.type(), "index")
            self.need("]")
            n = self.done(x)
        return n

    def struct(self) -> Node:
        n = self.node("StructType")
        self.need("struct")
        self.need("{")
        while not self.at("}"):
            f = self.node("Field")
            first = self.type()
            if self.at(",") or not self.at(";", "}") and self.tok.kind != "string":
                f.add(first, "name")
                while self.take(","):
                    f.add(self.ident(), "name")
                f.add(self.type(), "type")
            else:
                f.add(first, "type")
            if self.tok.kind == "string":
                f.add(self.operand(), "tag")
            n.add(self.done(f), "field")
            self.semi()
        self.need("}")
        return self.done(n)

    def interface(self) -> Node:
        n = self.node("InterfaceType")
        self.need("interface")
        self.need("{")
        while not self.at("}"):
            if self.tok.kind == "ident" and self.t[self.i + 1].text == "(":
                m = self.node("MethodSpec")
                m.name = m.add(self.ident(), "name").name
                self.signature(m)
                n.add(self.done(m), "method")
            else:
                n.add(self.constraint(), "embed")
            self.semi()
        self.need("}")
        return self.done(n)

    # --- statements

    def free(self, f):
        """``f`` inside brackets, where braces are literals again."""
        held, self.no_literal = self.no_literal, 0
        try:
            return f()
        finally:
            self.no_literal = held

    def body(self) -> Node:
        return self.free(self.block)

    def block(self) -> Node:
        n = self.node("Block")
        self.need("{")
        self.statements(n)
        self.need("}")
        return self.done(n)

    def statements(self, n: Node) -> None:
        while not self.at("}", "case", "default") and self.tok.kind != "eof":
            if self.take(";"):
                continue
            n.add(self.statement(), "stmt")
            self.semi()

    def statement(self) -> Node:
        if self.at("const", "var", "type"):
            n = self.node("DeclStmt")
            self.declaration(n)
            return self.done(n)
        if self.at("{"):
            return self.free(self.block)
        if self.at("if"):
            return self.if_stmt()
        if self.at("for"):
            return self.for_stmt()
        if self.at("switch"):
            return self.switch_stmt()
        if self.at("select"):
            n = self.node("SelectStmt")
            self.i += 1
            return self.clauses(n, "CommClause")
        if self.at("return"):
            n = self.node("ReturnStmt")
            self.i += 1
            if not self.at(";", "}"):
                for e in self.expressions():
                    n.add(e, "value")
            return self.done(n)
        if self.at("defer", "go"):
            n = self.node("DeferStmt" if self.tok.text == "defer" else "GoStmt")
            self.i += 1
            n.add(self.expression(), "call")
            return self.done(n)
        if self.at("break", "continue", "goto", "fallthrough"):
            n = self.node({"break": "BreakStmt", "continue": "ContinueStmt", "goto": "GotoStmt", "fallthrough": "FallthroughStmt"}[self.tok.text])
            self.i += 1
            if self.tok.kind == "ident":
                n.name = n.add(self.ident(), "label").name
            return self.done(n)
        if self.tok.kind == "ident" and self.t[self.i + 1].text == ":" and self.t[self.i + 1].kind == "op":
            n = self.node("LabeledStmt", self.tok.text)
            self.i += 2
            while self.take(";"):
                pass
            if not self.at("}"):
                n.add(self.statement(), "stmt")
            return self.done(n)
        return self.simple()

    def simple(self) -> Node:
        left = self.expressions()
        n = self.around("ExprStmt", left[0])
        if self.tok.kind == "op" and self.tok.text in _ASSIGN:
            n.kind, n.name = "AssignStmt", self.tok.text
            self.i += 1
            for e in left:
                n.add(e, "left")
            if self.at("range"):
                r = self.node("Range")
                self.i += 1
                r.add(self.expression(), "x")
                n.add(self.done(r), "right")
            else:
                for e in self.expressions():
                    n.add(e, "right")
            return self.done(n)
        if self.at("++", "--"):
            n.kind, n.name = "IncDecStmt", self.tok.text
            self.i += 1
            n.add(left[0], "left")
            return self.done(n)
        if self.at("<-"):
            n.kind = "SendStmt"
            self.i += 1
            n.add(left[0], "channel")
            n.add(self.expression(), "value")
            return self.done(n)
        for e in left:
            n.add(e, "x")
        return self.done(n)

    def if_stmt(self) -> Node:
        n = self.node("IfStmt")
        self.need("if")
        self.no_literal += 1
        if not self.at(";"):
            first = self.simple()
        else:
            first = None
        if self.take(";"):
            n.add(first, "init")
            first = self.simple()
        self.no_literal -= 1
        cond = first.children[0] if first.kind == "ExprStmt" else first
        n.add(cond, "cond")
        n.add(self.body(), "then")
        if self.take("else"):
            n.add(self.if_stmt() if self.at("if") else self.body(), "else")
        return self.done(n)

    def for_stmt(self) -> Node:
        n = self.node("ForStmt")
        self.need("for")
        self.no_literal += 1
        if self.at("range"):
            r = self.node("Range")
            self.i += 1
            r.add(self.expression(), "x")
            n.add(self.done(r), "range")
        elif not self.at("{"):
            first = None if self.at(";") else self.simple()
            if first is not None and any(c.kind == "Range" for c in first.children):
                n.add(first, "range")
            elif self.take(";"):
                n.add(first, "init")
                if not self.at(";"):
                    n.add(self.expression(), "cond")
                self.need(";")
                if not self.at("{"):
                    n.add(self.simple(), "post")
            else:
                n.add(first.children[0] if first.kind == "ExprStmt" else first, "cond")
        self.no_literal -= 1
        n.add(self.body(), "body")
        return self.done(n)

    def switch_stmt(self) -> Node:
        n = self.node("SwitchStmt")
        self.need("switch")
        self.no_literal += 1
        if not self.at("{"):
            first = None if self.at(";") else self.simple()
            if self.take(";"):
                n.add(first, "init")
                first = None if self.at("{") else self.simple()
            if first is not None:
                tag = first.children[0] if first.kind == "ExprStmt" else first
                x = tag.children[-1] if tag.kind == "AssignStmt" else tag
                if x.kind == "TypeAssert" and x.name == "type":
                    n.kind = "TypeSwitchStmt"
                n.add(tag, "tag")
        self.no_literal -= 1
        return self.free(lambda: self.clauses(n, "CaseClause"))

    def clauses(self, n: Node, kind: str) -> Node:
        self.need("{")
        while not self.at("}"):
            c = self.node(kind)
            if self.take("default"):
                c.name = "default"
            else:
                self.need("case")
                if kind == "CommClause":
                    c.add(self.simple(), "comm")
                else:
                    c.add(self.case_item(), "value")
                    while self.take(","):
                        c.add(self.case_item(), "value")
            self.need(":")
            self.statements(c)
            n.add(self.done(c), "clause")
        self.need("}")
        return self.done(n)

    def case_item(self) -> Node:
        return self.type() if self.at("[", "map", "chan", "struct", "interface") or self.at("func") and not self._literal_func() else self.expression()

    def _literal_func(self) -> bool:
        k, depth = self.i + 1, 0
        while self.t[k].kind != "eof":
            depth += self.t[k].text in ("(", "[")
            depth -= self.t[k].text in (")", "]")
            if depth == 0 and self.t[k].text in (":", ",", "{"):
                return self.t[k].text == "{"
            k += 1
        return False

    # --- expressions

    def expressions(self) -> list[Node]:
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        return out

    def expression(self, level: int = 1) -> Node:
        left = self.unary()
        while self.tok.kind == "op" and _BINARY.get(self.tok.text, 0) >= level:
            op = self.tok.text
            n = self.around("Binary", left, op)
            self.i += 1
            n.add(left, "x")
            n.add(self.expression(_BINARY[op] + 1), "y")
            left = self.done(n)
        return left

    def unary(self) -> Node:
        if self.at("<-") and self.t[self.i + 1].text == "chan":
            return self.type()
        if self.at("+", "-", "!", "^", "&", "<-", "~"):
            n = self.node("Unary", self.tok.text)
            self.i += 1
            n.add(self.unary(), "x")
            return self.done(n)
        if self.at("*"):
            n = self.node("Star")
            self.i += 1
            n.add(self.unary(), "x")
            return self.done(n)
        return self.primary()

    def operand(self) -> Node:
        if self.tok.kind in _LITERALS:
            n = self.node("BasicLit", self.tok.text)
            self.i += 1
            return self.done(n)
        if self.at("("):
            n = self.node("Paren")
            self.i += 1
            n.add(self.free(lambda: self.type() if self.at("[", "map", "chan", "struct", "interface") else self.expression()), "x")
            self.need(")")
            return self.done(n)
        if self.at("func"):
            n = self.node("FunctionLit")
            self.i += 1
            self.signature(n)
            if self.at("{"):
                n.add(self.body(), "body")
            else:
                n.kind = "FuncType"
            return self.done(n)
        if self.at("[", "map", "chan", "struct", "interface"):
            return self.type()
        return self.ident()

    def primary(self) -> Node:
        x = self.operand()
        while True:
            if self.at("."):
                self.i += 1
                if self.take("("):
                    n = self.around("TypeAssert", x)
                    n.add(x, "x")
                    if self.take("type"):
                        n.name = "type"
                    else:
                        n.add(self.free(self.type), "type")
                    self.need(")")
                else:
                    n = self.around("Selector", x)
                    n.add(x, "x")
                    n.name = n.add(self.ident(), "sel").name
            elif self.at("("):
                n = self.around("Call", x)
                self.i += 1
                n.add(x, "fun")
                self.free(lambda n=n: self.arguments(n))
                self.need(")")
            elif self.at("["):
                n = self.free(lambda x=x: self.index(x))
            elif self.at("{") and (x.kind in ("ArrayType", "MapType", "StructType") or not self.no_literal and x.kind in ("Ident", "Selector", "Index")):
                n = self.around("CompositeLit", x)
                n.add(x, "type")
                self.free(lambda n=n: self.elements(n))
            else:
                return x
            x = self.done(n)

    def arguments(self, n: Node) -> None:
        while not self.at(")"):
            n.add(self.type() if self.at("[", "map", "chan", "struct", "interface") and not self._is_literal_type() else self.expression(), "arg")
            if self.take("..."):
                n.name = "..."
            if not self.take(","):
                break

    def _is_literal_type(self) -> bool:
        """Whether a type at the argument's start is followed by a literal or a conversion."""
        held = self.i
        try:
            self.type()
            return not self.at(",", ")")
        except SourceError:
            return True
        finally:
            self.i = held

    def index(self, x: Node) -> Node:
        n = self.around("Index", x)
        self.need("[")
        n.add(x, "x")
        parts = 0
        while not self.at("]"):
            if self.take(":"):
                parts += 1
                n.kind = "Slice"
                continue
            n.add(self.type() if self.at("[", "map", "chan", "struct", "interface", "func", "*") else self.expression(), "index")
            self.take(",")
        self.need("]")
        return n

    def elements(self, n: Node) -> None:
        self.need("{")
        while not self.at("}"):
            first = self.element()
            if self.take(":"):
                kv = self.around("KeyValue", first)
                kv.add(first, "key")
                kv.add(self.element(), "value")
                first = self.done(kv)
            n.add(first, "element")
            if not self.take(","):
                break
        self.need("}")

    def element(self) -> Node:
        if self.at("{"):
            n = self.node("CompositeLit")
            self.elements(n)
            return self.done(n)
        return self.expression()


def parse(data: bytes) -> tuple[Source, Node]:
    """Source and tree of one file; ``SourceError`` if it cannot be read."""
    source = Source(data)
    return source, Parser(source).file()
