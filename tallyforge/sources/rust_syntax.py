"""A lexer and an error-intolerant parser for Rust source, made for measuring: it keeps structure and drops names.

``parse_file`` walks items and returns plain dicts for functions, types and fingerprints. Expressions are parsed by operator
precedence into nodes, and one walk over the nodes of a body takes all of its measures at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Macros that count as assertions, keywords that make a macro count as a function, and types of one state.
ASSERTIONS = frozenset(["assert", "assert_eq", "assert_ne", "debug_assert", "debug_assert_eq", "debug_assert_ne", "ensure", "bail"])
CONTROL_FLOW = frozenset(["if", "match", "while", "for", "loop"])

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*)
      |(?P<block>/\*)
      |(?P<raw>(?:br|cr|r)(?P<hash>\#*)")
      |(?P<str>(?:b|c)?"(?:\\.|[^"\\])*")
      |(?P<char>b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^\\'])')
      |(?P<life>'[A-Za-z_]\w*)
      |(?P<num>\d[\w]*(?:\.\d[\w]*)?(?:(?<=[eE])[+-]\d[\d_]*)?)
      |(?P<id>(?:r\#)?[^\W\d]\w*)
      |(?P<punct>[^\s\w"'])""",
    re.X | re.S,
)
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_BINARY = {
    "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10,
}
_ASSIGN_OPS = frozenset(["+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="])
_CLOSED = frozenset(["If", "Match", "For", "While", "Loop", "BlockExpr", "Unsafe"])


class RustSyntaxError(ValueError):
    pass


@dataclass(slots=True)
class Token:
    kind: str  # id, num, str, char, life, or the character of a punctuation mark
    text: str
    line: int
    joint: bool = False  # the next mark follows without a blank
    match: int = -1  # index of the partner of a bracket


@dataclass(slots=True)
class Node:
    kind: str
    kids: list[Node] = field(default_factory=list)
    info: object = None


def lex(source: str) -> list[Token]:
    out: list[Token] = []
    open_: list[int] = []
    pos, line, n = 0, 1, len(source)
    if source.startswith("#!") and not source.startswith("#!["):
        pos = source.find("\n") if "\n" in source else n
    while pos < n:
        m = _TOKEN.match(source, pos)
        if not m:
            raise RustSyntaxError(f"line {line}: cannot read {source[pos : pos + 10]!r}")
        kind, end = m.lastgroup if m.lastgroup != "hash" else "raw", m.end()
        if kind == "block":
            depth = 1
            while depth:
                a, b = source.find("/*", end), source.find("*/", end)
                if b < 0:
                    raise RustSyntaxError(f"line {line}: comment without end")
                depth, end = (depth + 1, a + 2) if 0 <= a < b else (depth - 1, b + 2)
        elif kind == "raw":
            stop = source.find('"' + m["hash"], end)
            if stop < 0:
                raise RustSyntaxError(f"line {line}: string without end")
            end = stop + 1 + len(m["hash"])
            out.append(Token("str", "", line))
        elif kind == "punct":
            c = m[0]
            t = Token(c, c, line, end < n and not source[end].isspace() and not source[end].isalnum() and source[end] not in "_\"'")
            if c in _PAIRS:
                open_.append(len(out))
            elif c in ")]}":
                if not open_ or _PAIRS[out[open_[-1]].kind] != c:
                    raise RustSyntaxError(f"line {line}: {c} does not match")
                t.match = open_.pop()
                out[t.match].match = len(out)
            out.append(t)
        elif kind != "skip":
            # 1..2 is a number, two dots and a number; 1.max() is a call
            out.append(Token("str" if kind in ("str", "raw") else kind, m[0].removeprefix("r#"), line))
        line += source.count("\n", pos, end)
        pos = end
    if open_:
        raise RustSyntaxError(f"line {out[open_[-1]].line}: bracket without partner")
    return out


class Parser:
    def __init__(self, tokens: list[Token]):
        self.t = tokens
        self.i = 0
        self.end = len(tokens)

    # ---- looking ----

    def at(self, *texts: str, ahead: int = 0) -> bool:
        k = self.i + ahead
        return k < self.end and self.t[k].kind != "str" and self.t[k].text in texts

    def kind(self, ahead: int = 0) -> str:
        k = self.i + ahead
        return self.t[k].kind if k < self.end else ""

    def marks(self, ahead: int = 0) -> str:
        """The longest operator that starts here."""
        k, text = self.i + ahead, ""
        while k < self.end and len(text) < 3 and self.t[k].kind == self.t[k].text and not self.t[k].text.isalnum():
            text += self.t[k].text
            if not self.t[k].joint:
                break
            k += 1
        for size in (3, 2, 1):
            if text[:size] in _OPERATORS and len(text) >= size:
                return text[:size]
        return text[:1]

    def need(self, text: str) -> Token:
        if not self.at(text):
            k = min(self.i, len(self.t) - 1)
            raise RustSyntaxError(f"line {self.t[k].line if self.t else 0}: expected {text!r}")
        self.i += 1
        return self.t[self.i - 1]

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def inside(self) -> tuple[int, int]:
        """Step over a bracketed group; the range of what it holds. A closing bracket is an error: its partner lies behind."""
        if not self.more() or self.t[self.i].kind not in _PAIRS:
            raise RustSyntaxError(f"line {self.t[min(self.i, len(self.t) - 1)].line}: expected a group")
        a = self.i + 1
        b = self.t[self.i].match
        self.i = b + 1
        return a, b

    def within(self, span: tuple[int, int]) -> Parser:
        p = Parser(self.t)
        p.i, p.end = span
        return p

    def more(self) -> bool:
        return self.i < self.end

    # ---- attributes, paths, types, patterns ----

    def attributes(self) -> list[tuple[int, int]]:
        out = []
        while self.at("#") and (self.at("[", ahead=1) or self.at("!", ahead=1) and self.at("[", ahead=2)):
            self.i += 1
            self.take("!")
            out.append(self.inside())
        return out

    def angle(self) -> tuple[int, int]:
        """Step over ``<...>``; arrows do not close it."""
        a, depth = self.i + 1, 0
        while self.more():
            c = self.t[self.i]
            if c.kind in _PAIRS:
                self.i = c.match
            elif c.kind == "<":
                depth += 1
            elif c.kind == ">" and not (self.t[self.i - 1].kind in "-=" and self.t[self.i - 1].joint):
                depth -= 1
                if not depth:
                    self.i += 1
                    return a, self.i - 1
            self.i += 1
        raise RustSyntaxError("angle bracket without partner")

    def type(self) -> tuple:
        """('path', segments, last name, argument types) | ('ref', type) | ('tuple', types) | ('other',)."""
        if self.take("&"):
            self.take_kind("life")
            self.take("mut")
            return ("ref", self.type())
        if self.at("*") and self.at("const", "mut", ahead=1):
            self.i += 2
            self.type()
            return ("other",)
        if self.at("("):
            p, parts, comma = self.within(self.inside()), [], False
            while p.more():
                parts.append(p.type())
                comma |= p.take(",")
            return parts[0] if len(parts) == 1 and not comma else ("tuple", parts)
        if self.at("["):
            self.inside()
            return ("other",)
        if self.take("!"):
            return ("other",)
        if self.take("dyn", "impl"):
            self.bounds()
            return ("other",)
        if self.at("for"):
            self.i += 1
            self.angle()
            return self.type()
        if self.at("unsafe", "extern", "fn"):
            while self.more() and not self.at("fn"):
                self.i += 1
            self.need("fn")
            self.inside()
            if self.marks() == "->":
                self.i += 2
                self.type()
            return ("other",)
        if self.at("<"):
            self.angle()
            count, name, args = 2, "", []
            while self.marks() == "::":
                self.i += 3
                if self.at("<"):
                    self.angle()
            return ("path", count, name, args)
        return self.type_path()

    def take_kind(self, kind: str) -> bool:
        if self.kind() == kind:
            self.i += 1
            return True
        return False

    def type_path(self) -> tuple:
        if self.marks() == "::":
            self.i += 2
        count, name, args = 0, "", []
        while True:
            if self.kind() != "id":
                raise RustSyntaxError(f"line {self.t[min(self.i, len(self.t) - 1)].line}: expected a type")
            name, args = self.t[self.i].text, []
            count += 1
            self.i += 1
            if self.take("!"):
                self.inside()
                return ("other",)
            if self.marks() == "::" and self.at("<", ahead=2):
                self.i += 2
            if self.at("<") and self.marks() not in ("<=", "<<="):
                p = self.within(self.angle())
                while p.more():
                    if p.kind() == "life":
                        p.i += 1
                    elif p.kind() == "id" and p.at("=", ahead=1):
                        p.i += 2
                        p.type()
                    elif p.kind() in ("num", "str", "char") or p.at("{", "-"):
                        p.i = p.t[p.i].match + 1 if p.at("{") else p.i + 1 + p.at("-")
                    else:
                        args.append(p.type())
                    if p.take(":"):
                        p.bounds()
                    if not p.take(","):
                        break
            elif self.at("("):
                self.inside()
                if self.marks() == "->":
                    self.i += 2
                    self.type()
            if self.marks() != "::":
                return ("path", count, name, args)
            self.i += 2

    def bounds(self) -> None:
        while True:
            self.take("?", "~")
            self.take("const")
            if not self.take_kind("life"):
                self.type()
            if not self.take("+"):
                return

    def pattern(self, *stops: str) -> tuple[bool, list[Node]]:
        """(binds mutably, literal nodes) up to one of ``stops`` outside brackets.

        Only plain, tuple, tuple-struct and struct patterns are looked into, as the measured engine does: references, slices,
        alternatives and typed patterns do not count as mutable.
        """
        a, lits, simple, closed = self.i, [], True, -1
        while self.more():
            c, op = self.t[self.i], self.marks()
            if self.i > closed and c.kind != "str":
                if op in stops or c.kind == "id" and c.text in stops:
                    break
                simple &= op != "|"
            if c.kind in _PAIRS:
                closed = max(closed, c.match)
            if c.kind in ("num", "str", "char") or c.kind == "id" and c.text in ("true", "false"):
                lits.append(Node("Lit"))
            if op == "<":
                self.angle()
            else:
                self.i += len(op) if op in ("::", "..", "..=", "=>") else 1
        return simple and self._mutable(a, self.i), lits

    def _mutable(self, a: int, b: int) -> bool:
        t = self.t
        if a >= b:
            return False
        if t[a].text == "ref" and t[a].kind == "id":
            a += 1
        if a < b and t[a].text == "mut" and t[a].kind == "id":
            return True
        if t[a].kind == "id":
            while a < b and t[a].kind not in "({":
                if t[a].text == "@":
                    return False
                a += 1
        if a < b and t[a].kind in "({":
            parts, start, k, stop = [], a + 1, a + 1, t[a].match
            named = t[a].kind == "{"
            while k <= stop:
                if k == stop or t[k].kind == ",":
                    s = start
                    if named:
                        for j in range(start, k):
                            if t[j].kind == ":" and t[j + 1].kind != ":":
                                s = j + 1
                                break
                    parts.append((s, k))
                    start = k + 1
                elif t[k].kind in _PAIRS:
                    k = t[k].match
                k += 1
            return any(self._mutable(s, e) for s, e in parts)
        return False

    # ---- statements ----

    def block(self) -> Node:
        """A block's statements; stands at ``{``."""
        if not self.at("{"):
            self.need("{")
        p, out = self.within(self.inside()), []
        while p.more():
            s = p.statement()
            if s is not None:
                out.append(s)
        return Node("Block", out)

    def statement(self) -> Node | None:
        if self.take(";"):
            return None
        mark = self.i
        self.attributes()
        if self.at("let"):
            self.i += 1
            mut, lits = self.pattern("=", ":", ";")
            typed = False
            if self.at(":"):
                self.i += 1
                self.type()
                typed = True
            kids, init = list(lits), None
            if self.take("="):
                init = self.expr()
                kids.append(init)
                if self.take("else"):
                    kids.append(self.block())
            self.take(";")
            return Node("Let", kids, (mut and not typed, init))
        if self.is_item():
            self.i = mark
            return self.item_in_body()
        if self.kind() == "id" and not self.at("if", "match", "while", "for", "loop", "return", "break", "continue", "move", "async", "unsafe", "self", "Self"):
            save = self.i
            mac = self.macro_path()
            if mac is not None and not (self.at(".") and self.marks() == "." or self.at("?")) and (self.t[self.i - 1].kind == "}" or self.at(";") or not self.more()):
                self.take(";")
                return Node("MacroStmt", [], mac)
            self.i = save
        e = self.expr(statement=True)
        self.take(";")
        return e

    def is_item(self) -> bool:
        k = 0
        if self.at("pub"):
            return True
        if self.at("fn", "struct", "enum", "mod", "trait", "use", "static", "type", "extern", "impl") and not (self.at("type", "extern") and self.kind(1) not in ("id", "str")):
            return True
        if self.at("const") and (self.kind(1) == "id" and not self.at("move", "async", ahead=1) or self.at("_", ahead=1)):
            return True
        if self.at("unsafe", "async") and self.at("fn", "impl", "trait", "extern", "unsafe", ahead=1 + k):
            return True
        if self.at("union") and self.kind(1) == "id" and self.at("{", "<", ahead=2):
            return True
        return self.at("macro_rules") and self.at("!", ahead=1)

    def item_in_body(self) -> Node:
        """An item among statements: what its function bodies and initializers hold counts for the outer body as well."""
        item = self.item()
        kids = []
        if item and item["kind"] == "fn" and item["body"] is not None:
            kids.append(item["body"])
        elif item and item["kind"] == "const" and item["init"] is not None:
            kids.append(item["init"])
        elif item and item["kind"] in ("impl", "trait", "mod"):
            kids += [x["body"] for x in item["items"] if x and x["kind"] == "fn" and x["body"] is not None]
        return Node("Item", kids, item)

    def macro_path(self) -> tuple[str, tuple[int, int]] | None:
        k = self.i
        while k < self.end and self.t[k].kind == "id":
            name = self.t[k].text
            k += 1
            if k + 1 < self.end and self.t[k].kind == "!" and self.t[k + 1].kind in _PAIRS:
                self.i = k + 1
                return name, self.inside()
            if k + 2 < self.end and self.t[k].kind == ":" and self.t[k + 1].kind == ":":
                k += 2
            else:
                return None
        return None

    # ---- expressions ----

    def expr(self, least: int = 0, structs: bool = True, statement: bool = False) -> Node:
        self.attributes()
        op = self.marks()
        if op in ("..", "..="):
            self.i += len(op)
            left = Node("Range", [self.expr(2, structs)] if self.starts(structs) else [])
        else:
            left = self.unary(structs, statement)
        if statement and left.kind in _CLOSED:
            if not (self.at(".") and self.marks() == "." or self.at("?")):
                return left
            left = self.postfix(left, structs)
        while self.more():
            if self.at("as") and least <= 11:
                self.i += 1
                self.type()
                left = Node("Cast", [left])
                continue
            op = self.marks()
            if op in _BINARY and _BINARY[op] >= max(least, 1) and not (op == "|" and least > 5):
                if _BINARY[op] < least:
                    break
                self.i += len(op)
                left = Node("Binary", [left, self.expr(_BINARY[op] + 1, structs)], op)
            elif op in ("..", "..=") and least <= 1:
                self.i += len(op)
                left = Node("Range", [left] + ([self.expr(2, structs)] if self.starts(structs) else []))
            elif op == "=" and least == 0:
                self.i += 1
                left = Node("Assign", [left, self.expr(0, structs)])
            elif op in _ASSIGN_OPS and least == 0:
                self.i += len(op)
                left = Node("Binary", [left, self.expr(0, structs)], op)
            else:
                break
        return left

    def starts(self, structs: bool) -> bool:
        """Whether an operand can follow here."""
        if not self.more() or self.at(")", "]", "}", ",", ";", "as", "else", "=") or self.at("{") and not structs:
            return False
        return self.marks() not in ("=>", "==")

    def unary(self, structs: bool, statement: bool = False) -> Node:
        if self.at("-", "!", "*") and self.kind() != "id":
            self.i += 1
            return Node("Unary", [self.unary(structs)])
        if self.at("&"):
            twice = self.marks() == "&&"
            self.i += 2 if twice else 1
            if self.at("raw") and self.at("const", "mut", ahead=1):
                self.i += 2
            self.take("mut")
            inner = Node("Ref", [self.unary(structs)])
            return Node("Ref", [inner]) if twice else inner
        first = self.primary(structs)
        if statement and first.kind in _CLOSED:
            return first
        return self.postfix(first, structs)

    def postfix(self, e: Node, structs: bool) -> Node:
        while self.more():
            if self.at("?"):
                self.i += 1
                e = Node("Try", [e])
            elif self.at("("):
                e = Node("Call", [e, *self.arguments()])
            elif self.at("["):
                p = self.within(self.inside())
                e = Node("Index", [e, p.expr()])
            elif self.at(".") and self.marks() == ".":
                self.i += 1
                if self.take("await"):
                    e = Node("Await", [e])
                    continue
                number = self.kind() == "num"
                text = self.t[self.i].text if self.more() else ""
                self.i += 1
                if number:
                    for _ in text.split("."):
                        e = Node("Field", [e])
                    continue
                if self.marks() == "::":
                    self.i += 2
                    self.angle()
                e = Node("Call", [e, *self.arguments()]) if self.at("(") else Node("Field", [e])
            else:
                break
        return e

    def arguments(self) -> list[Node]:
        p, out = self.within(self.inside()), []
        while p.more():
            out.append(p.expr())
            if not p.take(","):
                break
        if p.more():
            raise RustSyntaxError(f"line {p.t[p.i].line}: expected ','")
        return out

    def condition(self) -> Node:
        return self.expr(0, structs=False)

    def primary(self, structs: bool) -> Node:
        if not self.more():
            raise RustSyntaxError("unexpected end")
        t = self.t[self.i]
        if t.kind == "life":
            self.i += 1
            self.need(":")
            return self.primary(structs)
        if t.kind in ("num", "str", "char"):
            self.i += 1
            if t.kind == "num" and self.at(".") and self.marks() == "." and self.kind(1) != "id":
                self.i += 1  # 1. is a number
            return Node("Lit", [], t.text)
        if t.kind == "(":
            p, kids = self.within(self.inside()), []
            while p.more():
                kids.append(p.expr())
                if not p.take(","):
                    break
            return Node("Group", kids)
        if t.kind == "[":
            p, kids = self.within(self.inside()), []
            while p.more():
                kids.append(p.expr())
                if not p.take(",", ";"):
                    break
            return Node("Array", kids)
        if t.kind == "{":
            return Node("BlockExpr", [self.block()])
        if t.kind == "|" or self.at("move", "static") and self.at("|", "move", ahead=1) or self.at("async") and (self.at("|", ahead=1) or self.at("move", ahead=1) and self.at("|", ahead=2)):
            return self.closure()
        if t.kind == "<":
            self.angle()
            while self.marks() == "::":
                self.i += 2
                if self.at("<"):
                    self.angle()
                else:
                    self.i += 1
            return Node("Path")
        if t.kind != "id":
            raise RustSyntaxError(f"line {t.line}: unexpected {t.text!r}")
        word = t.text
        if word == "if":
            self.i += 1
            kids = [self.condition(), self.block()]
            other = None
            if self.take("else"):
                other = self.primary(structs)
            return Node("If", kids, other)
        if word == "let":
            self.i += 1
            _, lits = self.pattern("=")
            self.need("=")
            return Node("LetCond", [*lits, self.expr(4, structs=False)])
        if word == "match":
            self.i += 1
            head = self.condition()
            p, arms = self.within(self.inside()), []
            while p.more():
                p.attributes()
                _, kids = p.pattern("=>", "if")
                if p.take("if"):
                    kids.append(p.expr())
                p.need("=")
                p.need(">")
                body = p.expr(statement=p.at("{"))
                kids.append(body)
                arms.append(Node("Arm", kids))
                p.take(",")
            return Node("Match", [head, *arms], len(arms))
        if word == "for":
            self.i += 1
            _, lits = self.pattern("in")
            self.need("in")
            return Node("For", [*lits, self.condition(), self.block()])
        if word == "while":
            self.i += 1
            return Node("While", [self.condition(), self.block()])
        if word == "loop":
            self.i += 1
            return Node("Loop", [self.block()])
        if word == "unsafe" or word == "const" and self.at("{", ahead=1):
            self.i += 1
            return Node("Unsafe", [self.block()])
        if word == "async":
            self.i += 1
            self.take("move")
            return Node("Unsafe", [self.block()])
        if word in ("return", "break", "continue", "yield"):
            self.i += 1
            if word in ("break", "continue"):
                self.take_kind("life")
            kids = [self.expr(0, structs)] if word != "continue" and self.starts(structs) else []
            return Node("Return" if word == "return" else "Jump", kids)
        mac = self.macro_path()
        if mac is not None:
            return Node("MacroExpr", [], mac)
        # a path
        names = []
        while True:
            if self.kind() != "id":
                raise RustSyntaxError(f"line {self.t[min(self.i, len(self.t) - 1)].line}: expected a name")
            names.append(self.t[self.i].text)
            self.i += 1
            if self.marks() != "::":
                break
            self.i += 2
            if self.at("<"):
                self.angle()
                names.append("<>")
                if self.marks() != "::":
                    break
                self.i += 2
        if structs and self.at("{") and word not in ("true", "false"):
            p, kids = self.within(self.inside()), []
            while p.more():
                p.attributes()
                if p.marks() == "..":
                    p.i += 2
                    if p.more():
                        kids.append(p.expr())
                elif p.at(":", ahead=1) and p.marks(1) == ":":
                    p.i += 2
                    kids.append(p.expr())
                else:
                    p.i += 1
                    kids.append(Node("Path"))
                if not p.take(","):
                    break
            return Node("Struct", kids)
        if names[-1] in ("true", "false") and len(names) == 1:
            return Node("Lit", [], names[0])
        return Node("Path", [], names[0] if len(names) == 1 else None)

    def closure(self) -> Node:
        while self.more() and not self.at("|"):
            self.i += 1
        lits: list[Node] = []
        if self.marks() == "||":
            self.i += 2
        else:
            self.need("|")
            while self.more() and not self.at("|"):
                _, found = self.pattern(",", ":", "|")
                lits += found
                if self.take(":"):
                    self.type()
                self.take(",")
            self.need("|")
        if self.marks() == "->":
            self.i += 2
            self.type()
            return Node("Closure", [*lits, Node("BlockExpr", [self.block()])])
        return Node("Closure", [*lits, self.expr()])

    # ---- items ----

    def item(self) -> dict | None:
        attrs = self.attributes()
        public = False
        if self.take("pub"):
            if self.at("("):
                self.inside()
            else:
                public = True
        base = {"attrs": attrs, "public": public}
        while self.at("default", "const", "async", "unsafe", "extern") and not (self.at("const") and not self.at("fn", "async", "unsafe", "extern", ahead=1)) and not (self.at("extern") and (self.at("crate", "{", ahead=1) or self.kind(1) == "str" and self.at("{", ahead=2))):
            self.i += 1
            self.take_kind("str")
        if self.at("fn"):
            self.i += 1
            name = self.t[self.i]
            self.i += 1
            if self.at("<"):
                self.angle()
            params = self.inside()
            while self.more() and not self.at("{", ";"):
                if self.t[self.i].kind in _PAIRS:
                    self.i = self.t[self.i].match
                self.i += 1
            body, span = None, None
            if self.at("{"):
                span = (self.i, self.t[self.i].match)
                body = self.block()
            else:
                self.take(";")
            return base | {"kind": "fn", "name": name.text, "line": name.line, "params": params, "body": body, "span": span}
        if self.at("struct", "enum", "union"):
            word = self.t[self.i].text
            name = self.t[self.i + 1]
            self.i += 2
            if self.at("<"):
                self.angle()
            while self.more() and not self.at("{", ";", "("):
                self.i += 1
            fields = self.inside() if self.at("{", "(") else None
            named = fields is not None and self.t[fields[0] - 1].kind == "{"
            if not named:
                while self.more() and not self.take(";"):
                    self.i += 1
            return base | {"kind": word, "name": name.text, "line": name.line, "fields": fields if named else None}
        if self.at("impl"):
            self.i += 1
            if self.at("<"):
                self.angle()
            self.take("!")
            target, trait = self.type(), False
            if self.take("for"):
                target, trait = self.type(), True
            while self.more() and not self.at("{"):
                self.i += 1
            return base | {"kind": "impl", "target": target, "trait": trait, "items": self.within(self.inside()).items()}
        if self.at("mod"):
            name = self.t[self.i + 1]
            self.i += 2
            items = self.within(self.inside()).items() if self.at("{") else None
            self.take(";")
            return base | {"kind": "mod", "name": name.text, "items": items or [], "inline": items is not None}
        if self.at("trait", "auto"):
            self.take("auto")
            name = self.t[self.i + 1]
            self.i += 2
            while self.more() and not self.at("{", ";"):
                self.i += 1
            items = self.within(self.inside()).items() if self.at("{") else []
            self.take(";")
            return base | {"kind": "trait", "name": name.text, "items": items}
        if self.at("macro_rules"):
            self.i += 2
            name = self.t[self.i].text
            self.i += 1
            span = self.inside()
            self.take(";")
            return base | {"kind": "macro", "name": name, "span": span}
        if self.at("const", "static"):
            self.i += 1
            self.take("mut")
            self.i += 1
            if self.take(":"):
                self.type()
            init = self.expr() if self.take("=") else None
            self.need(";")
            return base | {"kind": "const", "init": init}
        # use, type, extern crate, foreign blocks, macro calls: nothing in them is measured
        start = self.i
        while self.more():
            c = self.t[self.i]
            if c.kind in _PAIRS:
                self.i = c.match + 1
                if c.kind == "{" and not self.at(";") and self.t[start].text != "use":
                    return base | {"kind": "other"}
                continue
            self.i += 1
            if c.kind == ";":
                return base | {"kind": "other"}
        if self.i == start:
            raise RustSyntaxError("expected an item")
        return base | {"kind": "other"}

    def items(self) -> list[dict]:
        out = []
        while self.more():
            if self.take(";"):
                continue
            if self.at("#") and self.at("!", ahead=1) and self.at("[", ahead=2):
                self.i += 2
                self.inside()
                continue
            before = self.i
            it = self.item()
            if self.i == before:
                raise RustSyntaxError(f"line {self.t[self.i].line}: expected an item")
            if it:
                out.append(it)
        return out


_OPERATORS = frozenset([*_BINARY, *_ASSIGN_OPS, "=", "..", "..=", "=>", "->", "::", ".", "!", "?", ":", ",", ";", "#", "@", "&", "|", "$", "~", "(", ")", "[", "]", "{", "}", "<", ">"])
