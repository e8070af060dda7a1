"""Measures of parsed Rust files: functions, types, fingerprints."""

from __future__ import annotations

import math

from .rust_syntax import ASSERTIONS, CONTROL_FLOW, Node, Parser, RustSyntaxError, lex

MOST = 2**64 - 1
#: The shape token of each kind of node. Other kinds are looked through.
SHAPE = {
    "If": "If",
    "Match": "Match",
    "Arm": "MatchArm",
    "For": "For",
    "While": "While",
    "Loop": "Loop",
    "Return": "Return",
    "Call": "Call",
    "Field": "FieldAccess",
    "Index": "IndexAccess",
    "Binary": "BinOp",
    "Unary": "UnaryOp",
    "Assign": "Assign",
    "BlockExpr": "Block",
    "Closure": "Closure",
    "Try": "Try",
    "MacroExpr": "Macro",
    "Lit": "Literal",
    "Ref": "Reference",
    "Await": "Await",
}
_NESTS = frozenset(["If", "Match", "For", "While", "Loop", "Closure"])
_BRANCHES = frozenset(["If", "For", "While", "Loop", "Try"])


def code_lines(text: str) -> int:
    """Lines that are neither blank nor comment; the same rule as ``functions.text.code_lines``."""
    n, inside = 0, False
    for raw in text.split("\n"):
        line = raw.strip()
        if not inside and line.startswith("/*"):
            inside, line = True, line[2:]
        if inside:
            head, close, line = line.partition("*/")
            if not close:
                continue
            inside, line = False, line.strip()
        n += bool(line) and not line.startswith("//")
    return n


def type_states(t: tuple) -> int:
    """States of a type as written: bool 2, Option 1 + T, Result T + E, tuples multiply, references are looked through, else 1."""
    if t[0] == "ref":
        return type_states(t[1])
    if t[0] == "tuple":
        return min(math.prod(type_states(x) for x in t[1]), MOST)
    if t[0] == "path" and t[1] == 1:
        _, _, name, args = t
        if name == "bool":
            return 2
        if name == "Option" and args:
            return min(1 + type_states(args[0]), MOST)
        if name == "Result" and len(args) >= 2:
            return min(type_states(args[0]) + type_states(args[1]), MOST)
    return 1


def resolved_states(t: tuple, local: dict[str, tuple[str, list]], seen: tuple[str, ...] = ()) -> int:
    """Like ``type_states``, but follows types of ``local``: (kind, fields) of structs, (kind, variants) of enums.

    Structs multiply their fields, enums add up their variants; a cycle and a chain deeper than 64 count as one state.
    """
    if t[0] == "ref":
        return resolved_states(t[1], local, seen)
    if t[0] == "tuple":
        return min(math.prod(resolved_states(x, local, seen) for x in t[1]), MOST)
    if t[0] == "path":
        name, args = t[2], t[3]
        if name in local:
            if name in seen or len(seen) >= 64:
                return 1
            kind, parts = local[name]
            deeper = (*seen, name)
            if kind == "struct":
                return min(math.prod(resolved_states(x, local, deeper) for x in parts), MOST)
            return min(sum(math.prod(resolved_states(x, local, deeper) for x in v) for v in parts), MOST)
        if t[1] == 1 and name == "Option" and args:
            return min(1 + resolved_states(args[0], local, seen), MOST)
        if t[1] == 1 and name == "Result" and len(args) >= 2:
            return min(resolved_states(args[0], local, seen) + resolved_states(args[1], local, seen), MOST)
    return type_states(t)


def initializer_states(e: Node | None) -> int:
    if e is None:
        return 1
    if e.kind == "Lit" and e.info in ("true", "false") or e.kind == "Path" and e.info == "None":
        return 2
    if e.kind == "Call" and e.kids and e.kids[0].kind == "Path" and e.kids[0].info in ("Some", "Ok", "Err"):
        return 2
    return 1


class Measure:
    """One walk over a body that takes every measure."""

    def __init__(self, parser: Parser):
        self.p = parser
        self.shape: list[str] = []
        self.depth = self.deepest = 0
        self.branches = 1
        self.mutable = 0
        self.states = 1
        self.asserts = self.meaningful = 0

    def walk(self, e: Node) -> None:
        kind = e.kind
        if kind == "Let":
            mut, init = e.info
            self.shape.append("LetMut" if mut else "Let")
            if mut:
                self.mutable += 1
                self.states = min(self.states * initializer_states(init), MOST)
        elif kind in SHAPE:
            self.shape.append(SHAPE[kind])
        if kind in ("MacroExpr", "MacroStmt") and e.info[0] in ASSERTIONS:
            self.asserts += 1
            a, b = e.info[1]
            self.meaningful += any(t.kind == "id" and t.text not in ("true", "false") for t in self.p.t[a:b])
        if kind in _BRANCHES or kind == "Binary" and e.info in ("&&", "||"):
            self.branches += 1
        if kind == "Match":
            self.branches += max(e.info - 1, 0)
        if kind in _NESTS:
            self.depth += 1
            self.deepest = max(self.deepest, self.depth)
        for k in e.kids:
            self.walk(k)
        if kind == "If" and e.info is not None:
            self.shape.append("Else")
            self.walk(e.info)
        if kind in _NESTS:
            self.depth -= 1


def _attribute_is(p: Parser, span: tuple[int, int], name: str) -> bool:
    return span[1] - span[0] == 1 and p.t[span[0]].text == name


def _cfg_test(p: Parser, span: tuple[int, int]) -> bool:
    """``cfg(test)``; nested predicates are not looked into."""
    a, b = span
    if b - a < 3 or p.t[a].text != "cfg" or p.t[a + 1].kind != "(":
        return False
    k = a + 2
    while k < p.t[a + 1].match:
        if p.t[k].text == "test":
            return True
        k = p.t[k].match + 1 if p.t[k].match > k else k + 1
    return False


def _parameters(p: Parser, span: tuple[int, int]) -> int:
    """Parameters with a type; a receiver has none of its own."""
    k, n, colon, angle = span[0], 0, False, 0
    receiver = False
    first = True
    while k < span[1]:
        t = p.t[k]
        if t.kind in "([{":
            k = t.match
        elif t.kind == "<":
            angle += 1
        elif t.kind == ">" and not (p.t[k - 1].kind == "-" and p.t[k - 1].joint):
            angle -= 1
        elif t.kind == ":" and not angle and not t.joint and not p.t[k - 1].kind == ":":
            colon = True
        elif first and t.kind == "id" and t.text == "self":
            receiver = True
        elif t.kind == "," and not angle:
            n += colon and not receiver
            colon, receiver, first = False, False, False
        k += 1
    return n + (colon and not receiver)


def _fields(p: Parser, span: tuple[int, int]) -> list[tuple]:
    q, out = p.within(span), []
    while q.more():
        q.attributes()
        if q.take("pub") and q.at("("):
            q.inside()
        q.i += 1
        q.need(":")
        out.append(q.type())
        if not q.take(","):
            break
    return out


def _variants(p: Parser, span: tuple[int, int]) -> list[list[tuple]]:
    q, out = p.within(span), []
    while q.more():
        q.attributes()
        q.i += 1
        fields: list[tuple] = []
        if q.at("{"):
            fields = _fields(p, q.inside())
        elif q.at("("):
            r = q.within(q.inside())
            while r.more():
                r.attributes()
                if r.take("pub") and r.at("("):
                    r.inside()
                fields.append(r.type())
                if not r.take(","):
                    break
        out.append(fields)
        if q.take("="):
            q.expr()
        if not q.take(","):
            break
    return out


def _named(t: tuple, name: str) -> bool:
    return t[0] == "path" and t[1] == 1 and t[2] == name


def measure_file(source: str, file: str) -> dict:
    """All relations of one file. Raises ``RustSyntaxError`` for what can't be parsed."""
    p = Parser(lex(source))
    out: dict = {"functions": [], "types": [], "fingerprints": [], "macros": 0, "exported": 0}
    text = source.split("\n")

    def scope_path(scope):
        return [{"kind": k, "name": n} for k, n in scope]

    def module(scope):
        return "::".join(n for k, n in scope if k == "module")

    def function(it: dict, scope: tuple, public: bool, test: bool) -> None:
        test = test or any(_attribute_is(p, a, "test") for a in it["attrs"])
        if it["body"] is None:
            return
        m = Measure(p)
        for s in it["body"].kids:
            m.walk(s)
        a, b = it["span"]
        first, last = p.t[a].line, p.t[b].line
        lines = max(code_lines("\n".join(text[first - 1 : last - 1])), 1) if last > first else 1
        here = (*scope, ("function", it["name"]))
        out["functions"].append(
            {
                "name": it["name"],
                "file": file,
                "module_path": module(scope),
                "scope_path": scope_path(here),
                "line": it["line"],
                "lines": lines,
                "params": _parameters(p, it["params"]),
                "nesting_depth": m.deepest,
                "cyclomatic": m.branches,
                "mutable_bindings": m.mutable,
                "internal_state_cardinality_log2": math.log2(m.states) if m.states > 1 else 0.0,
                "assertions": m.asserts,
                "meaningful_assertions": m.meaningful,
                "is_test": test,
                "is_pub": public,
            }
        )
        if not test:
            out["fingerprints"].append({"name": it["name"], "file": file, "line": it["line"], "shape": m.shape, "scope_path": scope_path(here)})
        for s in it["body"].kids:
            if s.kind == "Item" and s.info:
                walk([s.info], here, False, test)

    def type_row(it: dict, scope: tuple) -> None:
        if it["kind"] == "struct":
            if it["fields"] is None:
                return
            fields = _fields(p, it["fields"])
            states, total = math.prod(type_states(f) for f in fields), len(fields)
        else:
            variants = _variants(p, it["fields"]) if it["fields"] else []
            fields = [f for v in variants for f in v]
            states, total = max([1, *(math.prod(type_states(f) for f in v) for v in variants)]), len(variants)
        states = min(states, MOST)
        out["types"].append(
            {
                "name": it["name"],
                "file": file,
                "module_path": module(scope),
                "scope_path": scope_path((*scope, ("type", it["name"]))),
                "line": it["line"],
                "kind": "Struct" if it["kind"] == "struct" else "Enum",
                "bool_fields": sum(_named(f, "bool") for f in fields),
                "option_fields": sum(_named(f, "Option") for f in fields),
                "total_fields": total,
                "state_cardinality": states,
                "state_cardinality_log2": math.log2(states) if states > 1 else 0.0,
            }
        )

    def walk(items: list[dict], scope: tuple, public: bool, test: bool) -> None:
        for it in items:
            hidden = test or any(_cfg_test(p, a) for a in it["attrs"])
            kind = it["kind"]
            if kind == "fn":
                function(it, scope, public and it["public"], hidden)
            elif kind in ("struct", "enum"):
                type_row(it, scope)
            elif kind == "impl":
                name = it["target"][2] if it["target"][0] == "path" else ""
                inner = (*scope, ("type", name)) if len(name.encode()) > 1 else scope
                for f in it["items"]:
                    if f["kind"] == "fn":
                        function(f, inner, public and (it["trait"] or f["public"]), hidden)
            elif kind == "trait":
                for f in it["items"]:
                    if f["kind"] == "fn":
                        function(f, (*scope, ("type", it["name"])), False, hidden)
            elif kind == "mod":
                walk(it["items"], (*scope, ("module", it["name"])), public and it["public"], hidden)
            elif kind == "macro" and not hidden:
                a, b = it["span"]
                if any(t.kind == "id" and t.text in CONTROL_FLOW for t in p.t[a:b]):
                    if any(_attribute_is(p, x, "macro_export") for x in it["attrs"]):
                        out["exported"] += 1
                    else:
                        out["macros"] += 1

    walk(p.items(), (), True, False)
    return out


__all__ = ["RustSyntaxError", "code_lines", "measure_file", "resolved_states", "type_states"]
