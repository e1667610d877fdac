"""Symbols, calls, imports, inheritance, HTTP routes and HTTP clients of source files.

Python files are read with `ast`. Rust, TypeScript, JavaScript, Go and Java files are read by one pass over their tokens
that keeps a stack of open brackets. `parsed` runs either in mapInPandas: one file in, one row with arrays out, so a file
never leaves its task. `signals` finds RPC and queue contracts per line with built-in expressions only.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines_of, service_name

# The node kinds, method names and callers that count must equal the reference's for equal results.
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD", "ALL")
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "HTTP"}
CLIENT_OBJECTS = ("axios", "http", "client", "req", "httpx", "got", "superagent")
CLIENT_VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
REQUESTS_VERBS = ("get", "post", "put", "delete", "patch")
RPC_CLIENTS = (r"(\w+)ServiceStub", r"(\w+)ServiceClient", r"New(\w+)Client\(")
RPC_SERVERS = (r"add_(\w+)Servicer_to_server", r"Register(\w+)Server", r"\.register\((\w+)Service")
PRODUCERS = (r"\.send\(\s*[\"']([^\"']+)[\"']", r"\.publish\(\s*[\"']([^\"']+)[\"']", r"basic_publish\([^,]*,\s*[\"']([^\"']+)[\"']", r"SendMessage\([^,]*,\s*[\"']([^\"']+)[\"']")
CONSUMERS = (r"\.subscribe\(\s*\[[\"']([^\"']+)[\"']", r"\.subscribe\(\s*[\"']([^\"']+)[\"']", r"@KafkaListener\([^)]*topics\s*=\s*[\"']([^\"']+)[\"']", r"@RabbitListener\([^)]*queues\s*=\s*[\"']([^\"']+)[\"']", r"ReceiveMessage\([^,]*,\s*[\"']([^\"']+)[\"']")

SCHEMA = (
    "path string, language string, symbols array<struct<name string, kind string, start_line int, end_line int, public boolean>>, calls array<struct<scope string, name string>>, "
    "imports array<string>, inherits array<struct<child string, parent string, edge_type string>>, routes array<struct<handler string, label string>>, clients array<struct<scope string, method string, path string>>"
)

STRINGS = {
    "rust": r"""\bb?r(?P<hash>\#*)".*?"(?P=hash)|\bb?"(?:\\.|[^"\\])*"|"(?:\\.|[^"\\])*"|'(?:\\[^']+|[^'\\\n])'""",
    "go": r"""`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""",
    "java": r'''"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*\'''',
    "script": r"""`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""",
}
LEXERS = {k: re.compile(rf"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>{v})|(?P<name>[^\W\d]\w*|\$\w*)|(?P<digits>\d[\w.]*)|(?P<sign>::|=>|->|\?\.|[!=]==?|&&|\|\||.)", re.S) for k, v in STRINGS.items()}
REGEX_LITERAL = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
OPENS, CLOSES = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
KEYWORDS = {
    "rust": frozenset("if else for while loop match return fn struct impl trait in as move let const mut ref use where unsafe async await dyn".split()),
    "go": frozenset("if else for switch return func struct interface go defer select range const var import map chan type".split()),
    "java": frozenset("if else for while switch return catch do try new super throw synchronized".split()),
    "script": frozenset("if else for while switch return catch function class interface in of as do try typeof void delete await yield throw new super let const var import export with async".split()),
}
EXPRESSION_BEFORE = frozenset(["=", "(", ",", ":", "[", "?", "&&", "||", "=>", "return", "new", "!", "typeof", "throw", "==", "===", "+", "await"])
OBJECT_BEFORE = frozenset(["=", "(", ",", ":", "[", "?", "&&", "||", "return"])
MEMBER_WORDS = frozenset(["async", "static", "get", "set", "public", "private", "protected", "override", "readonly", "abstract", "*"])
RUST_WORDS = frozenset(["pub", "async", "unsafe", "const", "extern", "default"])
JAVA_MODIFIERS = frozenset("public private protected static final abstract synchronized native default strictfp transient volatile sealed".split())


@dataclass
class Found:
    symbols: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    inherits: list[dict] = field(default_factory=list)
    routes: list[dict] = field(default_factory=list)
    clients: list[dict] = field(default_factory=list)

    def symbol(self, name: str, kind: str, start: int, end: int, public: bool) -> int:
        self.symbols.append({"name": name, "kind": kind, "start_line": start, "end_line": end, "public": public})
        return len(self.symbols) - 1

    def inherit(self, child: str, parent: str | None, edge_type: str) -> None:
        if parent:
            self.inherits.append({"child": child, "parent": parent, "edge_type": edge_type})

    def client(self, scope: str, callee: str, text: str | None) -> None:
        """A call of a known HTTP client with a literal address."""
        owner, _, verb = callee.rpartition(".")
        method, strip = None, False
        if callee == "fetch":
            method = "GET"
        elif owner == "http" and verb in ("Get", "Post", "Put", "Delete"):
            method = verb.upper()
        elif callee == "urllib.request.urlopen":
            method, strip = "GET", True
        elif owner in CLIENT_OBJECTS and verb in CLIENT_VERBS:
            method = verb.upper()
        elif owner == "requests" and verb in REQUESTS_VERBS:
            method, strip = verb.upper(), True
        if method and text is not None:
            self.clients.append({"scope": scope, "method": method, "path": _rooted(_without_host(text) if strip else text)})

    def route(self, name: str, text: str | None, handler: str | None) -> None:
        verb = "HTTP" if name.upper() == "ROUTE" else name.upper()
        if text is not None and handler and (verb == "HTTP" and name.upper() == "ROUTE" or verb in HTTP_METHODS):
            self.routes.append({"handler": handler, "label": f"{verb} {text}"})


def _without_host(url: str) -> str:
    _, scheme, rest = url.partition("://")
    return url if not scheme else rest[rest.index("/") :] if "/" in rest else "/"


def _rooted(path: str) -> str:
    path = path.strip()
    return path if path.startswith("/") else "/" + path


# Python


class _Python(ast.NodeVisitor):
    def __init__(self) -> None:
        self.found, self.scopes = Found(), []

    def visit_FunctionDef(self, node) -> None:
        self._decorated(node)
        for decorator in node.decorator_list:
            self.visit(decorator)
        self.found.symbol(node.name, "function", node.lineno, node.end_lineno, False)
        self.scopes.append(node.name)
        for part in (node.args, *filter(None, [node.returns]), *node.body):
            self.visit(part)
        self.scopes.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        self.found.symbol(node.name, "class", node.lineno, node.end_lineno, True)
        self.generic_visit(node)

    def visit_Import(self, node) -> None:
        last = node.names[-1]
        self.found.imports.append(last.asname or last.name.rpartition(".")[2])

    def visit_Call(self, node) -> None:
        callee, text = ast.unparse(node.func), self._text(node)
        if isinstance(node.func, ast.Name):
            after = node.args[1:] if node.args and self._literal(node.args[0]) is not None else node.args
            self.found.route(callee, text, next(filter(None, map(self._handler, [*after, *node.args])), None))
        if self.scopes:
            self.found.client(self.scopes[-1], callee, text)
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                self.found.calls.append({"scope": self.scopes[-1], "name": name})
        self.generic_visit(node)

    def _decorated(self, node) -> None:
        for decorator in node.decorator_list:
            if isinstance(decorator, ast.Call):
                callee = ast.unparse(decorator.func)
                verb = "ROUTE" if callee == "route" or callee.endswith(".route") else callee.removeprefix("app.").upper()
                if (verb == "ROUTE" or verb in HTTP_METHODS) and self._text(decorator) is not None:
                    return self.found.route(verb, self._text(decorator), node.name)

    @staticmethod
    def _literal(node) -> str | None:
        return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None

    def _text(self, call) -> str | None:
        return next((t for t in map(self._literal, call.args) if t is not None), None)

    def _handler(self, node) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        inner = node.args if isinstance(node, ast.Call) else ast.iter_child_nodes(node)
        return next(filter(None, map(self._handler, inner)), None)


def _broken_python(text: str) -> Found:
    """Definitions of a file that doesn't parse, by indentation; no relations."""
    found, open_, last = Found(), [], 0
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and indent <= open_[-1][0]:
            found.symbols[open_.pop()[1]]["end_line"] = last
        if m := re.match(r"\s*(?:async\s+)?(def|class)\s+(\w+)", line):
            is_class = m[1] == "class"
            open_.append((indent, found.symbol(m[2], "class" if is_class else "function", number, number, is_class)))
        last = number
    for _, at in open_:
        found.symbols[at]["end_line"] = last
    return found


# Languages with braces


@dataclass
class _Frame:
    """An open bracket: what it belongs to, its symbol, and where its current member starts."""

    kind: str
    symbol: int | None = None
    member: int = 0
    opened: int = 0


class _Braces:
    def __init__(self, text: str, language: str) -> None:
        self.language = language
        self.script = language in ("typescript", "javascript")
        self.keywords = KEYWORDS["script" if self.script else language]
        self.tokens = self._lex(text)
        self.opened: dict[int, int] = {}
        self.found = Found()
        self.stack = [_Frame("top")]
        self.bodies: dict[int, _Frame] = {}
        self.jumps: dict[int, int] = {}

    def _lex(self, text: str) -> list[tuple[str, str, int]]:
        lexer, out, at, line = LEXERS["script" if self.script else self.language], [], 0, 1
        while at < len(text):
            m = None
            if self.script and text[at] == "/" and (not out or out[-1][1] in EXPRESSION_BEFORE or out[-1][1] in "{};"):
                m = REGEX_LITERAL.match(text, at)
                if m:
                    out.append(("digits", m[0], line))
            if m is None:
                m = lexer.match(text, at)
                if m.lastgroup != "skip":
                    kind = "text" if m["text"] is not None else m.lastgroup
                    out.append((kind, m[0], line))
            line += m[0].count("\n")
            at = m.end()
        return out

    def word(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) and self.tokens[i][0] != "text" else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][0] == "name"

    def line(self, i: int) -> int:
        return self.tokens[min(max(i, 0), len(self.tokens) - 1)][2]

    def closing(self, i: int) -> int:
        """Index of the bracket that closes the one at i, or of the last token."""
        depth = 0
        for j in range(i, len(self.tokens)):
            depth += (self.word(j) in OPENS) - (self.word(j) in CLOSES)
            if depth == 0:
                return j
        return len(self.tokens) - 1

    def ahead(self, i: int, *stops: str) -> int:
        """The next of the stops outside brackets that open after i; braces of Go type literals are passed over."""
        j = i
        while j < len(self.tokens):
            w = self.word(j)
            if w in stops and not (w == "{" and self.language == "go" and self.word(j - 1) in ("interface", "struct")):
                return j
            if w in CLOSES:
                return j
            j = self.closing(j) + 1 if w in OPENS else j + 1
        return len(self.tokens)

    def body(self, i: int, frame: _Frame, stop: str = ";") -> int:
        """Notes the frame for the body after i; the index of its brace, or of the stop if there is no body."""
        j = self.ahead(i, "{", stop)
        if self.word(j) == "{":
            self.bodies[j] = frame
        return j

    def after_parameters(self, i: int) -> int:
        """For scripts: the index after the parameters from i and their return type."""
        j = self.closing(self.ahead(i, "(")) + 1 if self.word(i) != "(" else self.closing(i) + 1
        if self.word(j) != ":":
            return j
        j += 1
        start = j
        while j < len(self.tokens):
            w = self.word(j)
            if w == "{" and (j == start or self.word(j - 1) in ("|", "&", "=>", "<", ",")):
                end = self.closing(j)
                self.jumps[j] = end + 1
                j = end + 1
            elif w in ("(", "["):
                j = self.closing(j) + 1
            elif w in ("{", ";", ",") or w in CLOSES or w == "=":
                return j
            else:
                j += 1
        return j

    def names(self, start: int, end: int) -> list[str]:
        """Base names of a comma-separated list of types."""
        out, depth, last = [], 0, None
        for j in range(start, end):
            w = self.word(j)
            depth += (w == "<") - (w == ">")
            if depth == 0 and w == ",":
                out.append(last)
                last = None
            elif depth == 0 and self.is_name(j):
                last = w
        return [x for x in [*out, last] if x]

    def declare(self, name: str, kind: str, start: int, at: int, public: bool, frame: str, semicolon: bool = True) -> None:
        """A symbol whose body follows `at`; without one it ends at the semicolon, or doesn't count."""
        node = _Frame(frame, len(self.found.symbols))
        j = self.body(at, node)
        if self.word(j) == "{" or semicolon:
            self.found.symbol(name, kind, self.line(start), self.line(j), public)

    def run(self) -> Found:
        i = 0
        while i < len(self.tokens):
            if i in self.jumps:
                i = self.jumps[i]
                continue
            kind, w, line = self.tokens[i]
            if kind == "sign" and w in OPENS:
                self.stack.append(self.bodies.pop(i, None) or self._plain(i))
                self.stack[-1].member = self.stack[-1].opened = i + 1
            elif kind == "sign" and w in CLOSES:
                if len(self.stack) > 1:
                    frame = self.stack.pop()
                    self.opened[i] = frame.opened - 1
                    if frame.symbol is not None:
                        self.found.symbols[frame.symbol]["end_line"] = line
                if w == "}":
                    self.stack[-1].member = i + 1
            elif kind == "sign" and w == ";":
                self.stack[-1].member = i + 1
            elif kind == "name":
                i = self._name(i, w)
                continue
            i += 1
        for frame in self.stack:
            if frame.symbol is not None:
                self.found.symbols[frame.symbol]["end_line"] = self.line(len(self.tokens) - 1)
        return self.found

    def _plain(self, i: int) -> _Frame:
        if self.word(i) != "{":
            return _Frame("round")
        if self.language == "java" and self.word(i - 1) == ")":
            j = self.opened.get(i - 1, 0) - 1
            while self.is_name(j) and self.word(j) != "new" or self.word(j) in (".", "<", ">", ","):
                j -= 1
            return _Frame("class" if self.word(j) == "new" else "block")
        return _Frame("object" if self.script and self.word(i - 1) in OBJECT_BEFORE else "block")

    def _name(self, i: int, w: str) -> int:
        """Handles the name at i; the index to go on from."""
        step = getattr(self, "_script" if self.script else f"_{self.language}")(i, w)
        if step is not None:
            return step
        if self.word(i + 1) == "(" and (w not in self.keywords or self.word(i - 1) in (".", "?.")) and self.language != "java":
            self._call(i, w)
        return i + 1

    def _rust(self, i: int, w: str) -> int | None:
        start, public = i, False
        while self.word(start - 1) in RUST_WORDS or self.word(start - 1) == ")" and self.word(start - 4) == "pub" or start > 0 and self.tokens[start - 1][0] == "text" and self.word(start - 2) == "extern":
            start -= 4 if self.word(start - 1) == ")" else 2 if self.tokens[start - 1][0] == "text" else 1
            public |= self.word(start) == "pub"
        if w == "fn" and self.is_name(i + 1):
            self.declare(self.word(i + 1), "function", start, i + 2, public, "function", semicolon=False)
            return i + 2
        if w in ("struct", "trait") and self.is_name(i + 1):
            self.declare(self.word(i + 1), "class" if w == "struct" else "type", start, i + 2, True, "class")
            return i + 2
        if w == "impl" and self.stack[-1].kind != "round" and self.word(i - 1) not in ("->", ":", "<", "=", "&", ","):
            end = self.body(i + 1, _Frame("class"))
            j = i + 1
            if self.word(j) == "<":
                depth = 0
                while j < end:
                    depth += (self.word(j) == "<") - (self.word(j) == ">")
                    j += 1
                    if depth == 0:
                        break
            stop = next((k for k in range(j, end) if self.word(k) == "where"), end)
            of = next((k for k in range(j, stop) if self.word(k) == "for" and self.word(k + 1) != "<"), None)
            if of is not None:
                trait, owner = self.names(j, of), self.names(of + 1, stop)
                if trait and owner and any(s["name"] == owner[-1] for s in self.found.symbols):
                    self.found.inherit(owner[-1], trait[-1], "implements")
            return end
        if w == "use":
            end = self.ahead_flat(i + 1)
            last = [self.word(k) for k in range(i + 1, end) if self.is_name(k) and self.word(k) not in ("crate", "self", "super", "as")]
            self.found.imports += last[-1:]
            return end
        if self.word(i + 1) == "!" and self.word(i + 2) in OPENS and w not in self.keywords:
            return self.closing(i + 2) + 1
        return None

    def ahead_flat(self, i: int) -> int:
        """The next semicolon, whatever brackets are between."""
        return next((j for j in range(i, len(self.tokens)) if self.word(j) == ";"), len(self.tokens))

    def _script(self, i: int, w: str) -> int | None:
        before = self.word(i - 1)
        top = self.stack[-1].kind
        if w == "function" and self.is_name(i + 1):
            at = self.after_parameters(i + 2)
            if self.word(at) == "{":
                start = i - 1 if before == "async" else i
                if self.word(start - 1) in EXPRESSION_BEFORE:
                    self.bodies[at] = _Frame("block")
                else:
                    self.declare(self.word(i + 1), "function", start, at, False, "function", semicolon=False)
            return i + 2
        if w == "class" and before != "." and self.word(i + 1) != ":":
            end = self.body(i + 1, _Frame("class"))
            if self.is_name(i + 1) and before != "abstract" and before not in EXPRESSION_BEFORE and self.word(end) == "{":
                name = self.word(i + 1)
                self.bodies[end].symbol = self.found.symbol(name, "class", self.line(i), self.line(end), True)
                if self.language == "typescript":
                    self._heritage(name, i + 2, end)
            return end
        if w == "interface" and self.is_name(i + 1) and self.language == "typescript":
            self.declare(self.word(i + 1), "type", i, i + 2, True, "type", semicolon=False)
            return i + 2
        if w == "import" and self.word(i + 1) not in ("(", "."):
            end = next((j for j in range(i + 1, len(self.tokens)) if self.tokens[j][0] == "text" or self.word(j) == ";"), len(self.tokens))
            last = [self.word(k) for k in range(i + 1, end) if self.is_name(k) and self.word(k) not in ("from", "as", "type")]
            self.found.imports += last[-1:]
            return end
        in_literal = top == "object" and (before in ("{", ",") or before in MEMBER_WORDS)
        if self.word(i + 1) == "(" and w not in self.keywords - {"delete", "with", "in", "of"} and (top == "class" and before not in (".", "=", "@", "new") or in_literal):
            at = self.after_parameters(i + 1)
            if self.word(at) == "{":
                start = i
                while self.word(start - 1) in MEMBER_WORDS:
                    start -= 1
                self.declare(w, "function", start, at, False, "function", semicolon=False)
                return i + 1
        return None

    def _heritage(self, name: str, start: int, end: int) -> None:
        marks = [j for j in range(start, end) if self.word(j) in ("extends", "implements")] + [end]
        for j, stop in zip(marks, marks[1:], strict=False):
            types = self.names(j + 1, stop)
            for parent in types[:1] if self.word(j) == "extends" else types:
                self.found.inherit(name, parent, self.word(j))

    def _go(self, i: int, w: str) -> int | None:
        if w != "func" or len(self.stack) > 1:
            return None
        if self.is_name(i + 1):
            self.declare(self.word(i + 1), "function", i, i + 2, False, "function", semicolon=False)
            return i + 2
        name = self.closing(i + 1) + 1
        if self.is_name(name) and self.word(name + 1) in ("(", "["):
            self.declare(self.word(name), "method", i, name + 1, True, "function", semicolon=False)
            return name + 1
        return None

    def _java(self, i: int, w: str) -> int | None:
        before, frame = self.word(i - 1), self.stack[-1]
        if w == "import":
            end = self.ahead_flat(i)
            self.found.imports += [self.word(k) for k in range(i + 1, end) if self.is_name(k) and self.word(k) != "static"][-1:]
            return end
        if w in ("class", "interface", "enum", "record") and self.is_name(i + 1) and before != ".":
            end, name = self.body(i + 1, _Frame("class" if before != "@" else "block")), self.word(i + 1)
            if w in ("class", "interface") and before != "@" and self.word(end) == "{":
                self.bodies[end].symbol = self.found.symbol(name, "class" if w == "class" else "type", self.line(frame.member), self.line(end), True)
                if w == "class":
                    self._heritage(name, i + 2, end)
            return end
        is_typed = (self.is_name(i - 1) and before not in JAVA_MODIFIERS and before != "new") or before in ("]", ">")
        if frame.kind == "class" and self.word(i + 1) == "(" and is_typed:
            start = frame.member
            self.declare(w, "method", start, self.closing(i + 1) + 1, True, "function")
            for j in range(start, i):
                if self.word(j) == "@" and self.word(j + 1) in MAPPINGS:
                    inside = range(j + 3, self.closing(j + 2)) if self.word(j + 2) == "(" else ()
                    text = next((self.tokens[k][1].strip('"') for k in inside if self.tokens[k][0] == "text"), "/")
                    self.found.routes.append({"handler": w, "label": f"{MAPPINGS[self.word(j + 1)]} {text}"})
                    break
            return i + 1
        return None

    def _call(self, i: int, w: str) -> None:
        before = self.word(i - 1)
        if before in ("new", "function", "fn", "func"):
            return
        callee, j = w, i
        while self.word(j - 1) in (".", "?.", "::"):
            joint = self.word(j - 1)
            if not self.is_name(j - 2):
                callee = "()" + joint + callee
                break
            callee = self.word(j - 2) + joint + callee
            j -= 2
        arguments = self._arguments(i + 1)
        literal = [self.tokens[a][1].strip("\"'`") if b - a == 1 and self.tokens[a][0] == "text" else None for a, b in arguments]
        first = next((k for k, t in enumerate(literal) if t is not None), None)
        text = None if first is None else literal[first]
        if first is not None and (self.language != "go" or "." not in callee):
            others = [*arguments[first + 1 :], *arguments]
            self.found.route(w, text, next(filter(None, (self._handler(a, b) for a, b in others)), None))
        scope = next((self.found.symbols[f.symbol]["name"] for f in reversed(self.stack) if f.kind == "function" and f.symbol is not None), None)
        if scope is not None:
            self.found.client(scope, callee, text)
            self.found.calls.append({"scope": scope, "name": w})

    def _arguments(self, i: int) -> list[tuple[int, int]]:
        """Spans of the arguments in the brackets that open at i."""
        end, out, start, j = self.closing(i), [], i + 1, i + 1
        while j < end:
            if self.word(j) == ",":
                out.append((start, j))
                start = j + 1
            j = self.closing(j) + 1 if self.word(j) in OPENS else j + 1
        return [*out, (start, end)] if end > start else out

    def _handler(self, start: int, end: int) -> str | None:
        """The first name of an argument; of a call, the first name within its arguments."""
        j = start
        while j < end:
            if self.is_name(j) and self.word(j) not in self.keywords:
                k = j
                while self.word(k + 1) in (".", "::") and self.is_name(k + 2):
                    k += 2
                if self.word(k + 1) == "(":
                    return self._handler(k + 2, self.closing(k + 1))
                return self.word(k) if self.word(j + 1) == "::" else self.word(j)
            j += 1
        return None


def parse(text: str, language: str) -> Found:
    if language == "python":
        reader = _Python()
        try:
            reader.visit(ast.parse(text))
        except (SyntaxError, ValueError, RecursionError):
            return _broken_python(text)
        return reader.found
    return _Braces(text, language).run() if language in ("rust", "typescript", "javascript", "go", "java") else Found()


def parsed(files: DataFrame) -> DataFrame:
    """One row per file (path, language, text) with arrays of what it holds; files without text hold nothing."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parse(t or "", n) for t, n in zip(batch["text"], batch["language"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "language": batch["language"]} | {c: [getattr(f, c) for f in found] for c in ("symbols", "calls", "imports", "inherits", "routes", "clients")})

    return files.select("path", "language", "text").mapInPandas(read, SCHEMA)


def _captures(line: str, patterns: tuple[str, ...]) -> list[F.Column]:
    return [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in patterns]


def _named(kind: str, names: F.Column) -> F.Column:
    return F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))


def signals(files: DataFrame) -> DataFrame:
    """(path, line, kind, name) of RPC clients and servers and of queue producers and consumers, once a line each."""
    rows = files.select("path", F.posexplode(lines_of(F.col("text"))).alias("at", "source"))
    annotated = F.when(F.col("source").contains("@GrpcService"), F.nullif(F.regexp_extract("source", r"class\s+(\w+)", 1), F.lit("")))
    sides = {
        "rpc_client": [service_name(c) for c in _captures("source", RPC_CLIENTS)],
        "rpc_server": [service_name(c) for c in [*_captures("source", RPC_SERVERS), annotated]],
        "producer": _captures("source", PRODUCERS),
        "consumer": _captures("source", CONSUMERS),
    }
    found = F.flatten(F.array(*(_named(kind, F.array_distinct(F.array_compact(F.array(*columns)))) for kind, columns in sides.items())))
    return rows.select("path", (F.col("at") + 1).alias("line"), F.explode(found).alias("f")).select("path", "line", "f.kind", "f.name")
