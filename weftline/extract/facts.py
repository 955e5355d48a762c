"""What one TypeScript file says: its declarations, and the names that it uses.

A file is read by a tolerant recursive descent that knows declarations, scopes and
member chains, not types beyond what is written down. A use names its target as far
as the file alone can: by a name of the module, by a member of a class, or by a
member of a written type. Joins over all files find the declarations meant.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from weftline.extract.tokens import Token, tokenize, unescaped

#: Longest documentation kept.
MAX_DOC = 400
VERBS = ("get", "post", "put", "delete", "patch", "options", "head", "all")
_ASSIGN = {"=", "+=", "-=", "*=", "**=", "/=", "%=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override", "accessor"}
_WORDS = {"true", "false", "null", "undefined", "this", "super", "typeof", "void", "delete", "in", "of", "instanceof", "await", "yield", "return", "throw", "case", "default", "else", "do", "if", "for", "while", "switch", "try", "finally", "break", "continue", "new", "as", "satisfies", "is", "keyof", "infer", "asserts", "async", "import", "export", "let", "const", "var"}
_BUILT_IN = {"string", "number", "boolean", "any", "unknown", "never", "void", "object", "symbol", "bigint", "null", "undefined", "true", "false", "this", "keyof", "typeof", "readonly", "infer", "unique", "extends", "is", "asserts", "in", "out", "new", "abstract", "const", "import"}
_CLOSE = {"(": ")", "[": "]", "{": "}"}
#: A word or sign after which a new line doesn't end an expression.
_GOES_ON = {".", "?.", "?", ":", "=>", "&&", "||", "??", "+", "-", "*", "/", "%", "**", "<", ">", "<=", "==", "===", "!=", "!==", "&", "|", "^", "<<", ",", "(", "[", "instanceof", "in", "as", "satisfies", *_ASSIGN}


def summary(doc: str | None) -> str | None:
    """First paragraph of a documentation comment in one line; none if it is empty."""
    if not doc:
        return None
    lines = [re.sub(r"^\s*\*? ?", "", x, count=1) if k else x for k, x in enumerate(doc[3:-2].split("\n"))]
    body = re.split(r"(?m)^\s*@", "\n".join(lines).strip("\r"), maxsplit=1)[0].strip()
    text = re.sub(r"\s+", " ", re.split(r"\n\s*\n", body)[0])

    def shown(m: re.Match) -> str:
        return m[1].split("|")[-1].strip() if "|" in m[1] else m[1].split()[0] if m[1].split() else ""

    text = re.sub(r"\{@(?:linkcode|linkplain|link)\s+([^}]+)\}", shown, text).strip()
    if not text:
        return None
    return text if len(text) <= MAX_DOC else text[: MAX_DOC - 1].rstrip() + "…"


def host_of(url: str) -> str:
    """Host and port of an absolute URL, else ``(dynamic)``."""
    try:
        parts = urlsplit(url.strip())
        host = parts.netloc.rpartition("@")[2].lower()
        if not parts.scheme or not host:
            return "(dynamic)"
        port = {"http": ":80", "https": ":443", "ws": ":80", "wss": ":443", "ftp": ":21"}.get(parts.scheme)
        return host.removesuffix(port) if port else host
    except ValueError:
        return "(dynamic)"


@dataclass
class Scope:
    """Names of a function or block: whether each has a written type."""

    names: dict[str, str | None] = field(default_factory=dict)
    #: Names that hold a function.
    callable: set[str] = field(default_factory=set)


@dataclass
class Owner:
    """A declaration around the code at hand."""

    syntax: str
    id: str
    emitted: bool  # as the end of a call
    scope: bool  # as the reader of a flag or caller of a host


class File:
    """``rows``: dicts of facts in order of the text."""

    def __init__(self, path: str, text: str) -> None:
        self.path, self.text = path, text
        self.rows: list[dict] = []
        self.module = f"Module:{path}"
        self.owners: list[Owner] = []
        self.scopes: list[Scope] = []
        self.classes: list[str] = []
        self.generics: list[set[str]] = []
        self.tokens, _, _ = tokenize(text)
        self.exported = self._export_list()
        self.tops = self._top_names()
        self.say("node", id=self.module, kind="Module", name=path)
        self.at = 0
        self.statements(len(self.tokens), top=True)

    # ---- small tools

    def say(self, fact: str, **what) -> None:
        self.rows.append({"fact": fact, "seq": len(self.rows), **what})

    def tok(self, k: int = 0) -> Token | None:
        return self.tokens[self.at + k] if 0 <= self.at + k < len(self.tokens) else None

    def text_at(self, at: int) -> str:
        return self.tokens[at].text if 0 <= at < len(self.tokens) else ""

    def is_(self, *texts: str, k: int = 0) -> bool:
        t = self.tok(k)
        return t is not None and t.kind in ("word", "punct") and t.text in texts

    def match(self, at: int) -> int:
        """Place of the bracket that closes the one at ``at``."""
        depth = 0
        for k in range(at, len(self.tokens)):
            t = self.tokens[k]
            if t.kind == "punct":
                if t.text in "([{":
                    depth += 1
                elif t.text in ")]}":
                    depth -= 1
                    if depth == 0:
                        return k
        return len(self.tokens) - 1

    def angle(self, at: int) -> int | None:
        """Place of the > that closes the < at ``at`` if it can be a list of types."""
        depth, k = 0, at
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.kind == "punct":
                if t.text == "<":
                    depth += 1
                elif t.text == ">":
                    depth -= 1
                    if depth == 0:
                        return k
                elif t.text in _CLOSE:
                    k = self.match(k)
                elif t.text not in (",", "|", "&", ".", "=>", "?", ":", "=", "...", "-", "]"):
                    return None
            elif t.kind == "number" and depth == 0:
                return None
            k += 1
        return None

    def _statement_level(self):
        """Places of tokens outside all brackets."""
        at = 0
        while at < len(self.tokens):
            yield at
            at = self.match(at) + 1 if self.tokens[at].kind == "punct" and self.tokens[at].text in _CLOSE else at + 1

    def _export_list(self) -> set[str]:
        """Local names that ``export { ... }`` or ``export default name`` publish."""
        out = set()
        for at in self._statement_level():
            if self.text_at(at) != "export":
                continue
            nxt = at + 2 if self.text_at(at + 1) == "type" and self.text_at(at + 2) == "{" else at + 1
            if self.text_at(nxt) == "{":
                end = self.match(nxt)
                if self.text_at(end + 1) != "from":
                    out |= {a for a, _ in self._specifiers(nxt, end)}
            elif self.text_at(at + 1) == "default" and self.tokens[at + 2 : at + 3] and self.tokens[at + 2].kind == "word" and self.text_at(at + 2) not in ("function", "class", "async", "abstract", "interface", "new"):
                following = self.tokens[at + 3 : at + 4]
                if not following or following[0].text == ";" or following[0].fresh:
                    out.add(self.text_at(at + 2))
        return out

    def _specifiers(self, start: int, end: int) -> list[tuple[str, str]]:
        """(name, alias) of ``{ a, b as c, type d }``."""
        out, part = [], []
        for k in range(start + 1, end + 1):
            t = self.tokens[k]
            if t.text in (",", "}") and t.kind == "punct":
                words = [x.text.strip("'\"") for x in part]
                if words[:1] == ["type"] and len(words) > 1 and words[1] != "as":
                    words = words[1:]
                if words:
                    out.append((words[0], words[2] if len(words) > 2 and words[1] == "as" else words[0]))
                part = []
            else:
                part.append(t)
        return out

    def _top_names(self) -> set[str]:
        """Names that the module's own statements and imports introduce."""
        out, at = set(), 0
        places = list(self._statement_level())
        for n, at in enumerate(places):
            word = self.text_at(at)
            nxt = self.tokens[at + 1] if at + 1 < len(self.tokens) else None
            if self.tokens[at].kind != "word" or nxt is None or self.text_at(at - 1) in (".", "?."):
                continue
            if word in ("class", "interface", "enum", "function", "namespace", "module") or (word == "type" and nxt.kind == "word" and self.text_at(at + 2) in ("=", "<")):
                name = self.tokens[at + 2] if nxt.text == "*" and at + 2 < len(self.tokens) else nxt
                if name.kind == "word":
                    out.add(name.text)
            elif word in ("const", "let", "var"):
                k = n + 1
                while k < len(places):
                    t = self.tokens[places[k]]
                    if t.kind == "word":
                        out.add(t.text)
                    elif t.text in "{[":
                        end = self.match(places[k])
                        out |= {x.text for j, x in enumerate(self.tokens[places[k] : end]) if x.kind == "word" and self.text_at(places[k] + j + 1) != ":"}
                    # the next declarator follows a comma
                    while k < len(places) and self.text_at(places[k]) not in (",", ";") and not (k > n + 1 and self.tokens[places[k]].fresh and self.text_at(places[k] - 1) not in _GOES_ON and self.text_at(places[k]) not in _GOES_ON):
                        k += 1
                    if k >= len(places) or self.text_at(places[k]) != ",":
                        break
                    k += 1
            elif word == "import":
                k = at + 1
                while k < len(self.tokens) and self.tokens[k].kind != "string" and self.text_at(k) not in (";", "("):
                    if self.tokens[k].kind == "word" and self.text_at(k) not in ("from", "as", "type"):
                        out.add(self.text_at(k))
                    k += 1
        return out

    # ---- declarations

    def node(self, syntax: str, kind: str, name: str, start: Token, end_line: int, parent: str, exported: bool = False, doc: str | None = None, top: bool = True, **more) -> str:
        ident = f"{syntax}:{self.path}#{name}@{start.line}"
        if top:
            text = summary(doc)
            self.say("node", id=ident, kind=kind, name=name, parent=parent, start_line=start.line, end_line=end_line, exported=exported, metadata=json.dumps({"documentation": text}, ensure_ascii=False) if text else None, syntax=syntax, **more)
        return ident

    def lookup(self, name: str) -> tuple[str, str | None]:
        """("local", its type), ("module", None) or ("none", None)."""
        for scope in reversed(self.scopes):
            if name in scope.names:
                return "local", scope.names[name]
        return ("module", None) if name in self.tops else ("none", None)

    def caller(self) -> str:
        return next((o.id for o in reversed(self.owners) if o.emitted), self.module)

    def reader_scope(self) -> str:
        return next((o.id for o in reversed(self.owners) if o.scope), self.module)

    def value_scope(self) -> str | None:
        inner = next((o.id for o in reversed(self.owners) if o.syntax in ("FunctionDeclaration", "MethodDeclaration")), None)
        return inner or next((o.id for o in reversed(self.owners) if o.syntax != "other"), None)

    def use(self, kind: str, source: str | None, how: str, a: str, b: str | None = None, c: str | None = None) -> None:
        if source is not None:
            self.say("use", kind=kind, id=source, how=how, a=a, b=b, c=c)

    def statements(self, stop: int, top: bool = False) -> None:
        if not top:
            self.scopes.append(Scope())
            self._hoist(stop)
        while self.at < stop:
            before = self.at
            self.statement(stop, top)
            if self.at == before:
                self.at += 1
        if not top:
            self.scopes.pop()

    def _hoist(self, stop: int) -> None:
        """Names of the functions and classes of a block, known before it runs."""
        at = self.at
        while at < stop:
            t = self.tokens[at]
            if t.kind == "word" and t.text in ("function", "class", "enum") and self.text_at(at - 1) not in ("=", "(", ",", "return", ".", ":", "?", "new", "=>"):
                name = at + 2 if self.text_at(at + 1) == "*" else at + 1
                if name < stop and self.tokens[name].kind == "word":
                    self.scopes[-1].names[self.text_at(name)] = None
                    if t.text == "function":
                        self.scopes[-1].callable.add(self.text_at(name))
            at = self.match(at) + 1 if t.kind == "punct" and t.text in _CLOSE else at + 1

    def statement(self, stop: int, top: bool) -> None:
        start = self.tok()
        doc = start.doc
        if start.kind == "punct":
            if start.text == "{":
                end = self.match(self.at)
                self.at += 1
                self.statements(end)
                self.at = end + 1
            elif start.text == ";":
                self.at += 1
            elif start.text == "@":
                self.at += 1
            else:
                self.expression(stop, statement=True)
            return
        if start.kind != "word":
            self.expression(stop, statement=True)
            return
        if start.text.startswith("@"):  # a decorator: its arguments are ordinary calls
            self.expression(stop, statement=True, decorator=True)
            if self.at < stop and self.tok().doc is None:
                self.tok().doc = doc
            return
        if start.text == "import" and not self.is_("(", ".", k=1):
            self.import_(stop)
            return
        if start.text == "export" and self.is_("{", "*", "type", "=", k=1) and not (self.is_("type", k=1) and not self.is_("{", "*", k=2)):
            self.export(stop)
            return
        mods, at = set(), self.at
        while self.text_at(at) in _MODIFIERS and at < stop and not (self.text_at(at) in ("declare", "abstract", "async", "static", "readonly") and (at + 1 >= len(self.tokens) or self.tokens[at + 1].kind != "word" or self.tokens[at + 1].fresh)):
            mods.add(self.text_at(at))
            at += 1
        word, nxt = self.text_at(at), self.tokens[at + 1] if at + 1 < len(self.tokens) else None
        exported = "export" in mods
        default = "default" in mods
        if word == "class" or (word == "interface" and nxt and nxt.kind == "word"):
            self.at = at
            self.class_(start, exported, default, doc, top, word)
        elif word == "function":
            self.at = at
            self.function(start, exported, default, doc, top)
        elif word == "enum" or (word == "const" and nxt and nxt.text == "enum"):
            self.at = at + (2 if word == "const" else 1)
            name = self.tok()
            self.at += 1
            end = self.match(self.at) if self.is_("{") else self.at
            ident = self.node("EnumDeclaration", "Enum", name.text, start, self.tokens[end].end_line, self.module, exported or name.text in self.exported, doc, top, local=name.text, publish=self.publish(name.text, exported, default))
            self.owners.append(Owner("EnumDeclaration", ident, top, top))
            self.at += 1
            while self.at < end:
                if self.tok().kind in ("word", "string") and self.is_("=", k=1):
                    self.at += 2
                    self.expression(end)
                else:
                    self.at += 1
            self.owners.pop()
            self.at = end + 1
        elif word == "type" and nxt and nxt.kind == "word" and not nxt.fresh and self.text_at(at + 2) in ("=", "<"):
            self.at = at + 1
            self.alias(start, exported, default, doc, top, stop)
        elif word in ("const", "let", "var") and nxt and (nxt.kind == "word" or nxt.text in "{["):
            self.at = at + 1
            self.variables(start, exported, doc, top, stop)
        elif word in ("namespace", "module", "global") and nxt and (nxt.kind in ("word", "string") or nxt.text == "{"):
            while self.at < stop and not self.is_("{"):
                self.at += 1
            if self.at < stop:
                end = self.match(self.at)
                self.at += 1
                self.statements(end)
                self.at = end + 1
        elif default:
            self.at = at
            if start.text == "export" and self.tok() is not None and self.tok().kind == "word" and self.tok().text in self.tops:
                self.say("publish", name="default", local=self.tok().text)
            self.expression(stop, statement=True)
        else:
            self.control(stop)

    def control(self, stop: int) -> None:
        word = self.tok().text
        if word in ("if", "while", "switch", "with") and self.is_("(", k=1):
            self.at += 1
            self.bracket()
            if word == "switch" and self.is_("{"):
                self.block()
        elif word == "for":
            self.at += 2 if self.is_("await", k=1) else 1
            if self.is_("("):
                end = self.match(self.at)
                self.at += 1
                self.scopes.append(Scope())
                if self.is_("const", "let", "var"):
                    self.at += 1
                    self.pattern(end)
                while self.at < end:
                    before = self.at
                    self.expression(end)
                    if self.at == before or self.is_(";", ",", "of", "in"):
                        self.at += 1
                self.at = end + 1
                if self.at < stop:
                    self.statement(stop, False)
                self.scopes.pop()
        elif word in ("try", "finally", "else", "do"):
            self.at += 1
        elif word == "catch":
            self.at += 1
            self.scopes.append(Scope())
            if self.is_("("):
                end = self.match(self.at)
                self.at += 1
                self.pattern(end)
                self.at = end + 1
            if self.is_("{"):
                self.block()
            self.scopes.pop()
        elif word in ("return", "throw"):
            self.at += 1
            if self.at < stop and not self.tok().fresh:
                self.expression(stop, statement=True)
        elif word in ("break", "continue"):
            self.at += 1
            if self.at < stop and self.tok().kind == "word" and not self.tok().fresh:
                self.at += 1
        elif word == "case":
            self.at += 1
            self.expression(stop, until=":")
            self.at += self.is_(":")
        elif word == "default" and self.is_(":", k=1):
            self.at += 2
        elif self.is_(":", k=1):  # a label
            self.at += 2
        else:
            self.expression(stop, statement=True)

    def block(self) -> None:
        end = self.match(self.at)
        self.at += 1
        self.statements(end)
        self.at = end + 1

    def publish(self, name: str, exported: bool, default: bool) -> str | None:
        return "default" if default else name if exported else None

    def import_(self, stop: int) -> None:
        start = self.at
        self.at += 1
        if self.is_("type") and not self.is_("from", ",", k=1) and not (self.is_("=", k=1)):
            self.at += 1
        pairs: list[tuple[str, str]] = []
        while self.at < stop and self.tok().kind != "string":
            t = self.tok()
            if t.text == "{":
                end = self.match(self.at)
                pairs += self._specifiers(self.at, end)
                self.at = end + 1
            elif t.text == "*" and self.is_("as", k=1):
                pairs.append(("*", self.text_at(self.at + 2)))
                self.at += 3
            elif t.text in ("from", ","):
                self.at += 1
            elif t.kind == "word" and not self.is_("=", k=1):
                pairs.append(("default", t.text))
                self.at += 1
            else:  # import a = require(...), which is another kind of statement
                self.at = start + 1
                self.expression(stop, statement=True)
                return
        if self.at < stop:
            spec = unescaped(self.tok().text[1:-1])
            self.say("import", a=spec)
            for name, local in pairs:
                self.say("bind", a=spec, b=name, local=local)
            self.at += 1
        if self.is_("with", "assert") and self.is_("{", k=1):
            self.at = self.match(self.at + 1) + 1

    def export(self, stop: int) -> None:
        self.at += 1
        self.at += self.is_("type")
        if self.is_("="):
            self.at += 1
            self.expression(stop, statement=True)
            return
        pairs: list[tuple[str, str]] = []
        if self.is_("*"):
            self.at += 1
            if self.is_("as"):
                pairs = [("*", self.text_at(self.at + 1))]
                self.at += 2
            else:
                pairs = [("*", "*")]
        else:
            end = self.match(self.at)
            pairs = self._specifiers(self.at, end)
            self.at = end + 1
        if self.is_("from"):
            self.at += 1
            spec = unescaped(self.tok().text[1:-1]) if self.tok() else ""
            for name, alias in pairs:
                self.say("reexport", a=spec, b=name, name=alias)
            self.at += 1
        else:
            for name, alias in pairs:
                self.say("publish", name=alias, local=name)

    # ---- types

    def type_end(self, at: int, stop: int, ends: tuple[str, ...], block_ends: bool = False) -> int:
        """Place after the type that begins at ``at``. ``block_ends``: a brace after a
        whole type begins a body."""
        whole = False
        while at < stop:
            t = self.tokens[at]
            if t.kind == "punct":
                if t.text == "{" and whole and block_ends:
                    return at
                if t.text in _CLOSE:
                    if t.text == "[" and whole and t.fresh:
                        return at
                    at, whole = self.match(at) + 1, True
                    if self.text_at(at) == "=>":
                        at, whole = at + 1, False
                    continue
                if t.text == "<" and (end := self.angle(at)) is not None:
                    at, whole = end + 1, True
                    continue
                if t.text in ends or t.text in ")]}":
                    return at
                if t.text in ("|", "&", ".", "=>", "?", ":"):
                    at, whole = at + 1, False
                    continue
                if t.text in ("-", "+"):
                    at += 1
                    continue
                return at
            if whole and t.text not in ("extends", "is", "in", "keyof") and self.text_at(at - 1) not in ("keyof", "typeof", "readonly", "infer", "asserts", "unique", "extends", "is", "new", "abstract", "in"):
                return at
            whole = not (t.kind == "word" and t.text in ("keyof", "typeof", "readonly", "infer", "asserts", "unique", "extends", "is", "new", "abstract", "in"))
            if t.text == "typeof":
                at += 1
            at += 1
        return at

    def type_uses(self, start: int, end: int, kind: str, source: str) -> str | None:
        """Uses for each type named between two places; the type's plain name, if it has
        one."""
        own = {x for g in self.generics for x in g}
        k = start
        while k < end:
            t = self.tokens[k]
            before, after = self.text_at(k - 1), self.text_at(k + 1)
            named = t.kind == "word" and t.text not in _BUILT_IN and before not in (".", "typeof", "infer") and after != "=>"
            # a name before a colon is a member's or a parameter's, unless a condition chooses it
            if named and (after == ":" or (after == "?" and self.text_at(k + 2) == ":")) and k > start and before in ("{", ";", ",", "(", "...", "[", "}"):
                named = False
            if named and after == "(" and before in ("{", ";", ","):
                named = False
            if named and before in ("{", ";", ",") and after in (";", "}") and k > start and self._in_braces(start, k):
                named = False
            if named:
                path = [t.text]
                while self.text_at(k + 1) == "." and k + 2 < end:
                    path.append(self.text_at(k + 2))
                    k += 2
                if path[0] not in own:
                    if len(path) == 1:
                        self.use(kind, source, "name", path[0])
                    else:
                        self.use(kind, source, "member", path[0], path[-1])
            k += 1
        return self.plain_type(start, end)

    def _in_braces(self, start: int, k: int) -> bool:
        depth = 0
        for j in range(k - 1, start - 1, -1):
            depth += (self.text_at(j) in ("}", ")", "]")) - (self.text_at(j) in ("{", "(", "["))
            if depth < 0:
                return self.text_at(j) == "{"
        return False

    def plain_type(self, start: int, end: int) -> str | None:
        """The name of the type between two places, without type arguments, null or
        undefined."""
        words = [k for k in range(start, end) if self.tokens[k].kind == "word" and self.text_at(k) not in ("null", "undefined", "readonly")]
        if not words or self.text_at(words[0]) in _BUILT_IN or (words[0] > start and self.text_at(words[0] - 1) not in ("|", "&")):
            return None
        after = self.text_at(words[0] + 1) if words[0] + 1 < end else ""
        if after in ("", "|") or (after == "<" and self.text_at(end - 1) == ">"):
            rest = [k for k in words[1:] if after == "|"]
            return self.text_at(words[0]) if not rest else None
        return None

    def type_parameters(self) -> set[str]:
        """Names of the ``<...>`` here, which is passed."""
        if not self.is_("<"):
            return set()
        end = self.angle(self.at)
        if end is None:
            return set()
        names, depth = set(), 0
        for k in range(self.at, end):
            depth += (self.text_at(k) in ("<", "(", "{", "[")) - (self.text_at(k) in (">", ")", "}", "]"))
            if depth == 1 and self.text_at(k) in ("<", ","):
                j = k + 1
                while self.text_at(j) in ("const", "in", "out"):
                    j += 1
                names.add(self.text_at(j))
        self.at = end + 1
        return names

    def alias(self, start: Token, exported: bool, default: bool, doc: str | None, top: bool, stop: int) -> None:
        name = self.tok()
        self.at += 1
        self.generics.append(self.type_parameters())
        self.at += self.is_("=")
        begin = self.at
        end = self.type_end(self.at, stop, (";",))
        last = self.tokens[max(begin, end) - 1]
        closed = end < stop and self.text_at(end) == ";"
        ident = self.node("TypeAliasDeclaration", "TypeAlias", name.text, start, self.tokens[end].end_line if closed else last.end_line, self.module, exported or name.text in self.exported, doc, top, local=name.text, publish=self.publish(name.text, exported, default))
        if top:
            self.type_uses(begin, end, "USES_TYPE", ident)
        self.generics.pop()
        self.at = end + closed

    # ---- variables and patterns

    def pattern(self, stop: int, top: bool = False) -> tuple[str, bool]:
        """Declare the names of a binding pattern here; (its text, whether it is one
        name)."""
        t = self.tok()
        if t is None or self.at >= stop:
            return "", True
        if t.kind == "word":
            self.at += 1
            if not top:
                self.scopes[-1].names[t.text] = None
            return t.text, True
        if t.text in "{[":
            end = self.match(self.at)
            text = self.text[t.start : self.tokens[end].stop]
            self.at += 1
            while self.at < end:
                x = self.tok()
                if x.text == "...":
                    self.at += 1
                elif x.text in "{[" and x.kind == "punct":
                    self.pattern(end, top)
                elif x.kind in ("word", "string", "number") and self.is_(":", k=1):
                    self.at += 2
                elif x.kind == "word":
                    self.pattern(end, top)
                elif x.text == "=":
                    self.at += 1
                    self.expression(end)
                else:
                    self.at += 1
            self.at = end + 1
            return text, False
        self.at += 1
        return t.text, True

    def variables(self, start: Token, exported: bool, doc: str | None, top: bool, stop: int) -> None:
        while self.at < stop:
            name_at = self.tok()
            # the end of a declarator is known once it has been read: its fact is put in before what it holds
            place = len(self.rows)
            ident = f"VariableDeclaration:{self.path}#{self._pattern_text()}@{name_at.line}"
            self.owners.append(Owner("VariableDeclaration", ident, top, top))
            name, single = self.pattern(stop, top)
            self.at += self.is_("!")
            kind = None
            if self.is_(":"):
                begin = self.at + 1
                end = self.type_end(begin, stop, ("=", ",", ";"))
                kind = self.type_uses(begin, end, "USES_TYPE", ident) if top else self.plain_type(begin, end)
                self.at = end
            function = False
            if self.is_("=") and self.at < stop:
                self.at += 1
                kind = kind or self.made_type()
                function = self.function_here()
                self.expression(stop, statement=True)
                if self.text_at(self.at - 1) == ";":
                    self.at -= 1
            self.owners.pop()
            if single and not top:
                self.scopes[-1].names[name] = kind
                if function:
                    self.scopes[-1].callable.add(name)
            if top:
                later, self.rows = self.rows[place:], self.rows[:place]
                public = exported or (single and name in self.exported)
                self.node("VariableDeclaration", "Variable", name, name_at, self.tokens[self.at - 1].end_line, self.module, public, doc, local=name, publish=name if exported and single else None, type=kind, function=function)
                for row in later:
                    self.rows.append(row | {"seq": len(self.rows)})
            if not self.is_(","):
                break
            self.at += 1
        self.at += self.is_(";")

    def _pattern_text(self) -> str:
        t = self.tok()
        return self.text[t.start : self.tokens[self.match(self.at)].stop] if t.kind == "punct" and t.text in "{[" else t.text

    def made_type(self) -> str | None:
        """The class of a ``new`` expression here."""
        k = 1 if self.is_("await") else 0
        if self.is_("new", k=k) and (t := self.tok(k + 1)) is not None and t.kind == "word" and not self.is_(".", k=k + 2):
            end = self.at + k + 2
            if self.text_at(end) == "<" and (close := self.angle(end)) is not None:
                end = close + 1
            end = self.match(end) + 1 if self.text_at(end) == "(" else end
            return t.text if self.text_at(end) not in (".", "?.", "[") else None
        return None

    def function_here(self) -> bool:
        """Whether an arrow function or function expression begins here."""
        k = 1 if self.is_("async") and not self.is_("=>", k=1) else 0
        return self.is_("function", k=k) or self.arrow(self.at + k) is not None

    def arrow(self, at: int) -> int | None:
        """Place of the => of the arrow function at ``at``."""
        if at >= len(self.tokens):
            return None
        if self.text_at(at) == "<" and (end := self.angle(at)) is not None and self.text_at(end + 1) == "(":
            at = end + 1
        if self.tokens[at].kind == "word" and self.text_at(at + 1) == "=>":
            return at + 1
        if self.text_at(at) == "(" and self.tokens[at].kind == "punct":
            end = self.match(at) + 1
            if self.text_at(end) == "=>":
                return end
            if self.text_at(end) == ":":
                after = self.type_end(end + 1, len(self.tokens), (",", ";", "="))
                # the type itself may hold the arrow of a function type: the last one is ours
                if self.text_at(after) == "=>":
                    return after
                if self.text_at(after - 1) == "=>":
                    return after - 1
                for k in range(end + 1, after):
                    if self.text_at(k) == "=>" and self.text_at(k - 1) != ")":
                        return k
        return None

    # ---- functions and classes

    def parameters(self, source: str | None, owner: str | None, properties: str | None = None) -> None:
        """Declare the parameters of the list here; with ``source`` their types are
        its, with ``owner`` they become nodes, with ``properties`` those with a modifier
        are members of that class."""
        end = self.match(self.at)
        self.at += 1
        while self.at < end:
            start = self.tok()
            mods = set()
            while self.tok() is not None and self.tok().text.startswith("@") and self.at < end:
                self.at += 1
                if self.is_("("):
                    self.bracket()
            while self.is_("public", "private", "protected", "readonly", "override") and not self.is_(",", ")", ":", "?", "=", k=1):
                mods.add(self.tok().text)
                self.at += 1
            self.at += self.is_("...")
            before = self.at
            name, single = self.pattern(end)
            if self.at == before:
                self.at += 1
                continue
            self.at += self.is_("?")
            kind = None
            if self.is_(":"):
                begin = self.at + 1
                stop = self.type_end(begin, end, ("=", ","))
                kind = self.type_uses(begin, stop, "PARAM_TYPE", source) if source else self.plain_type(begin, stop)
                self.at = stop
            if self.is_("="):
                self.at += 1
                kind = kind or self.made_type()
                self.expression(end)
            if single:
                self.scopes[-1].names[name] = kind
            if owner:
                self.node("Parameter", "Parameter", name, start, self.tokens[self.at - 1].end_line, owner)
            if properties and mods and kind:
                self.say("property", id=properties, name=name, type=kind)
            self.at += self.is_(",")
        self.at = end + 1

    def signature(self, source: str | None, owner: str | None, stop: int, properties: str | None = None) -> None:
        """Parameters and the type of the result."""
        if self.is_("("):
            self.parameters(source, owner, properties)
        if self.is_(":"):
            begin = self.at + 1
            end = self.type_end(begin, stop, (";", ",", "=>"), block_ends=True)
            # an arrow after the type belongs to a function type only if one has begun
            if source:
                self.type_uses(begin, end, "RETURNS", source)
            self.at = end

    def function(self, start: Token, exported: bool, default: bool, doc: str | None, top: bool) -> None:
        self.at += 1
        self.at += self.is_("*")
        name = "anonymous"
        if self.tok() is not None and self.tok().kind == "word":
            name = self.tok().text
            self.at += 1
        ident = f"FunctionDeclaration:{self.path}#{name}@{start.line}"
        body = self._body_after(self.at)
        if body is None and self._same_follows(name):
            self._skip_signature()  # an overload of what follows
            return
        end_line = self.tokens[self.match(body) if body is not None else max(self.at - 1, self._signature_end() - 1)].end_line
        if top:
            self.node("FunctionDeclaration", "Function", name, start, end_line, self.module, exported or name in self.exported, doc, local=name, publish=self.publish(name, exported, default), function=True)
        self.owners.append(Owner("FunctionDeclaration", ident, top, top))
        self.generics.append(self.type_parameters())
        self.scopes.append(Scope())
        self.signature(ident if top else None, ident if top else None, len(self.tokens))
        if self.is_("{"):
            self.block()
        else:
            self.at += self.is_(";")
        self.scopes.pop()
        self.generics.pop()
        self.owners.pop()

    def _signature_end(self) -> int:
        at = self.at
        if self.text_at(at) == "<" and (end := self.angle(at)) is not None:
            at = end + 1
        at = self.match(at) + 1 if self.text_at(at) == "(" else at
        if self.text_at(at) == ":":
            at = self.type_end(at + 1, len(self.tokens), (";", ","), block_ends=True)
        return at

    def _body_after(self, at: int) -> int | None:
        end = self._signature_end()
        return end if self.text_at(end) == "{" and self.tokens[end].kind == "punct" else None

    def _skip_signature(self) -> None:
        self.at = self._signature_end()
        self.at += self.is_(";")

    def _same_follows(self, name: str) -> bool:
        at = self._signature_end()
        at += self.text_at(at) == ";"
        while self.text_at(at) in _MODIFIERS or self.text_at(at) in ("function", "*"):
            at += 1
        return self.text_at(at) == name and self.text_at(at + 1) in ("(", "<")

    def class_(self, start: Token, exported: bool, default: bool, doc: str | None, top: bool, word: str) -> None:
        self.at += 1
        name = "anonymous"
        if self.tok() is not None and self.tok().kind == "word" and self.tok().text not in ("extends", "implements"):
            name = self.tok().text
            self.at += 1
        syntax, kind = ("ClassDeclaration", "Class") if word == "class" else ("InterfaceDeclaration", "Interface")
        ident = f"{syntax}:{self.path}#{name}@{start.line}"
        self.generics.append(self.type_parameters())
        head = self.at
        while head < len(self.tokens) and self.text_at(head) != "{":
            end = self.angle(head) if self.text_at(head) == "<" else self.match(head) if self.text_at(head) == "(" else None
            head = end + 1 if end is not None else head + 1
        end = self.match(head) if head < len(self.tokens) else len(self.tokens) - 1
        if top:
            self.node(syntax, kind, name, start, self.tokens[end].end_line, self.module, exported or name in self.exported, doc, local=name, publish=self.publish(name, exported, default))
        elif self.scopes:
            self.scopes[-1].names.setdefault(name, None)
        self._heritage(head, ident, word, top)
        self.owners.append(Owner(syntax, ident, top, top))
        self.classes.append(ident)
        self.at = head + 1
        while self.at < end:
            before = self.at
            self.member(end, ident, word, top)
            if self.at == before:
                self.at += 1
        self.classes.pop()
        self.owners.pop()
        self.generics.pop()
        self.at = end + 1

    def _heritage(self, head: int, ident: str, word: str, top: bool) -> None:
        role, at = None, self.at
        while at < head:
            t = self.text_at(at)
            if t in ("extends", "implements"):
                role, at = t, at + 1
                continue
            if role and self.tokens[at].kind == "word":
                path = [t]
                while self.text_at(at + 1) == "." and at + 2 < head:
                    path.append(self.text_at(at + 2))
                    at += 2
                if top:
                    kind = "IMPLEMENTS" if role == "implements" else "EXTENDS"
                    self.say("heritage", id=ident, kind=kind, how="name" if len(path) == 1 else "member", a=path[0], b=path[-1] if len(path) > 1 else None)
            if t == "<" and (close := self.angle(at)) is not None:
                at = close
            elif t == "(":
                at = self.match(at)
            at += 1

    def member(self, stop: int, owner: str, word: str, top: bool) -> None:
        start = self.tok()
        doc = start.doc
        if start.text in (";", ","):
            self.at += 1
            return
        if start.text.startswith("@") and start.kind == "word":
            self.expression(stop, statement=True, decorator=True)
            if self.at < stop:
                t = self.tok()
                t.doc = t.doc or doc
                # a declaration begins with its decorators
                t.line = start.line
            return
        while self.tok() is not None and self.is_(*_MODIFIERS, "get", "set") and self.at < stop and not self.is_("(", "=", ":", ";", "?", "!", "<", "}", ",", k=1) and not (self.tok(1) is not None and self.tok(1).fresh and not self.is_("async", "get", "set")):
            if self.is_("get", "set"):
                start = Token(start.kind, start.text, start.line, start.start, start.stop, start.end_line)
                start.kind = "accessor"
            self.at += 1
            if self.is_("{"):  # a static block
                self.block()
                return
        self.at += self.is_("*")
        t = self.tok()
        if t is None or self.at >= stop:
            return
        if t.text == "[" and t.kind == "punct":
            close = self.match(self.at)
            name = self.text[t.start : self.tokens[close].stop]
            index = self.text_at(self.at + 2) == ":" and word == "interface" or (self.text_at(self.at + 2) == ":")
            if not index and word == "class":
                self.at += 1
                self.expression(close)
            self.at = close + 1
            if index:
                end = self.type_end(self.at + 1, stop, (";", ",")) if self.is_(":") else self.at
                self.at = end
                return
        elif t.kind in ("word", "string", "number"):
            name = t.text[1:-1] if t.kind == "string" else t.text
            self.at += 1
        elif t.text in ("(", "<"):  # a call signature
            self._skip_signature()
            return
        else:
            self.at += 1
            return
        self.at += self.is_("?", "!")
        if self.is_("(", "<"):
            self._method(start, name, stop, owner, word, top, doc)
        else:
            self._property(start, name, stop, owner, word, top, doc)

    def _method(self, start: Token, name: str, stop: int, owner: str, word: str, top: bool, doc: str | None) -> None:
        body = self._body_after(self.at)
        if name == "constructor" or start.kind == "accessor":
            self.owners.append(Owner("other", owner, False, False))
            self.scopes.append(Scope())
            self.signature(None, None, stop, owner if name == "constructor" else None)
            if self.is_("{"):
                self.block()
            else:
                self.at += self.is_(";", ",")
            self.scopes.pop()
            self.owners.pop()
            return
        if word == "class" and body is None and self._same_follows(name):
            self._skip_signature()
            return
        syntax = "MethodDeclaration" if word == "class" else "MethodSignature"
        close = self.match(body) if body is not None else self._signature_end() - (self.text_at(self._signature_end()) != ";")
        ident = f"{syntax}:{self.path}#{name}@{start.line}"
        if top:
            self.node(syntax, "Method", name, start, self.tokens[min(close, len(self.tokens) - 1)].end_line, owner, doc=doc)
            self.say("member", id=ident, a=owner, name=name)
        self.owners.append(Owner(syntax, ident, True, word == "class"))
        self.generics.append(self.type_parameters())
        self.scopes.append(Scope())
        self.signature(ident if top else None, ident if top else None, stop)
        if self.is_("{"):
            self.block()
        else:
            self.at += self.is_(";", ",")
        self.scopes.pop()
        self.generics.pop()
        self.owners.pop()

    def _property(self, start: Token, name: str, stop: int, owner: str, word: str, top: bool, doc: str | None) -> None:
        syntax = "PropertyDeclaration" if word == "class" else "PropertySignature"
        ident = f"{syntax}:{self.path}#{name}@{start.line}"
        place = len(self.rows)
        kind = None
        self.owners.append(Owner(syntax, ident, False, word == "class"))
        if self.is_(":"):
            begin = self.at + 1
            end = self.type_end(begin, stop, ("=", ";", ","))
            kind = self.type_uses(begin, end, "USES_TYPE", ident) if top else self.plain_type(begin, end)
            self.at = end
        if self.is_("="):
            self.at += 1
            kind = kind or self.made_type()
            self.expression(stop, statement=True)
            if self.text_at(self.at - 1) == ";":
                self.at -= 1
        self.owners.pop()
        closed = self.is_(";", ",") and self.at < stop
        if top and start.kind != "accessor":
            later, self.rows = self.rows[place:], self.rows[:place]
            self.node(syntax, "Property", name, start, self.tokens[self.at if closed else self.at - 1].end_line, owner, doc=doc)
            if kind:
                self.say("property", id=owner, name=name, type=kind)
            for row in later:
                self.rows.append(row | {"seq": len(self.rows)})
        self.at += closed

    # ---- expressions

    def bracket(self) -> None:
        """All expressions within the bracket here."""
        end = self.match(self.at)
        self.at += 1
        while self.at < end:
            before = self.at
            self.expression(end)
            if self.at == before or self.is_(",", ";"):
                self.at += 1
        self.at = end + 1

    def expression(self, stop: int, statement: bool = False, until: str | None = None, decorator: bool = False) -> None:
        """One expression up to a comma (or, as a ``statement``, up to where it ends)."""
        done = False  # whether an operand has ended
        while self.at < stop:
            t = self.tok()
            if t.kind == "punct":
                if t.text in ")]}" or (t.text == "," and not statement) or (t.text == ";") or t.text == until:
                    self.at += t.text == ";" and statement
                    return
                if t.text == "," and statement:
                    return
                if done and statement and t.fresh and t.text not in _GOES_ON and t.text not in ("{",):
                    return
                if decorator and done and t.text not in (".", "("):
                    return
                if t.text == "(" or t.text == "<":
                    if not done and self.arrow(self.at) is not None:
                        self.arrow_function(stop)
                        done = True
                        continue
                    if t.text == "<":
                        close = self.angle(self.at)
                        if done and close is not None and self.text_at(close + 1) in ("(", "`"):
                            self.at = close + 1
                            continue
                        self.at, done = self.at + 1, False
                        continue
                    self.bracket()
                    done = True
                    continue
                if t.text == "[":
                    self.bracket()
                    done = True
                    continue
                if t.text == "{":
                    if done:
                        return
                    self.object_()
                    done = True
                    continue
                if t.text in ("++", "--"):
                    self.at += 1
                    continue
                if t.text == "!" and done:
                    self.at += 1
                    continue
                if t.text in (".", "?."):
                    self.at += 1
                    if self.tok() is not None and self.tok().kind == "word" and self.at < stop:
                        self.at += 1
                    done = True
                    continue
                if t.text == "?" and self.conditional(stop, until):
                    done = True
                    continue
                self.at, done = self.at + 1, False
                continue
            if done and statement and t.fresh and t.text not in _GOES_ON:
                return
            if decorator and done:
                return
            if t.kind == "template":
                for tokens in t.inner:
                    self.inside(tokens)
                self.at, done = self.at + 1, True
                continue
            if t.kind != "word":
                if done and statement and t.kind in ("string", "number"):
                    return
                self.at, done = self.at + 1, True
                continue
            if t.text in ("as", "satisfies") and done:
                self.at += 1
                if self.is_("const"):
                    self.at += 1
                else:
                    self.at = self.type_end(self.at, stop, (",", ";", "=", "&&", "||", "??", "?", ":"))
                continue
            if done and t.text not in ("instanceof", "in", "of"):
                return
            if t.text == "of":
                if done:
                    return
            if t.text in ("function", "class") or (t.text == "async" and self.is_("function", k=1)):
                self.nested(stop)
                done = True
                continue
            if self.arrow(self.at) is not None and t.text != "async" or (t.text == "async" and not self.is_("=>", k=1) and self.arrow(self.at + 1) is not None):
                self.at += t.text == "async"
                self.arrow_function(stop)
                done = True
                continue
            if t.text == "new":
                self.at += 1
                self.chain(stop, new=True)
                done = True
                continue
            if t.text in _WORDS and t.text not in ("this", "super", "undefined", "import"):
                self.at += 1
                done = t.text in ("true", "false", "null")
                continue
            self.chain(stop)
            done = True

    def conditional(self, stop: int, until: str | None) -> bool:
        """The part of a conditional expression after its question mark, so that its
        colon doesn't look like another's."""
        self.at += 1
        self.expression(stop, until=":")
        if self.is_(":") and self.at < stop:
            self.at += 1
            # what follows the colon goes on in the caller's loop
        return False

    def inside(self, tokens: list[Token]) -> None:
        """Expressions of a template, which have tokens of their own."""
        saved = self.tokens, self.at
        self.tokens, self.at = tokens, 0
        while self.at < len(tokens):
            before = self.at
            self.expression(len(tokens))
            if self.at == before:
                self.at += 1
        self.tokens, self.at = saved

    def nested(self, stop: int) -> None:
        """A function or class expression."""
        self.at += self.is_("async")
        if self.is_("class"):
            start = self.tok()
            self.scopes.append(Scope())
            self.class_(start, False, False, None, False, "class")
            self.scopes.pop()
            return
        self.at += 1
        self.at += self.is_("*")
        self.scopes.append(Scope())
        if self.tok() is not None and self.tok().kind == "word":
            self.scopes[-1].names[self.tok().text] = None
            self.at += 1
        self.generics.append(self.type_parameters())
        self.signature(None, None, stop)
        if self.is_("{"):
            self.block()
        self.generics.pop()
        self.scopes.pop()

    def arrow_function(self, stop: int) -> None:
        place = self.arrow(self.at)
        self.generics.append(self.type_parameters())
        self.scopes.append(Scope())
        if self.is_("("):
            self.parameters(None, None)
        else:
            self.pattern(stop)
        self.at = place + 1
        if self.is_("{"):
            self.block()
        else:
            self.expression(stop)
        self.scopes.pop()
        self.generics.pop()

    def object_(self) -> None:
        end = self.match(self.at)
        self.at += 1
        while self.at < end:
            t = self.tok()
            if t.text in (",", "...") and t.kind == "punct":
                self.at += 1
                if t.text == "...":
                    self.expression(end)
                continue
            while self.is_("async", "get", "set") and not self.is_("(", ":", ",", "}", "=", k=1):
                self.at += 1
            self.at += self.is_("*")
            t = self.tok()
            if t.kind in ("word", "string", "number") and self.is_(":", k=1):
                self.at += 2
                self.expression(end)
            elif t.kind == "punct" and t.text == "[":
                self.bracket()
                if self.is_(":"):
                    self.at += 1
                    self.expression(end)
                elif self.is_("("):
                    self._object_method(t, end)
            elif t.kind in ("word", "string", "number") and self.is_("(", "<", k=1):
                self.at += 1
                self._object_method(t, end)
            elif t.kind == "word" and self.is_(",", "}", k=1):
                self.at += 1  # a shorthand stands for its own property, not for a value
            elif t.kind == "word" and self.is_("=", k=1):
                self.at += 2
                self.expression(end)
            else:
                before = self.at
                self.expression(end)
                if self.at == before:
                    self.at += 1
        self.at = end + 1

    def _object_method(self, name: Token, end: int) -> None:
        # a method all the same, though never a node
        self.owners.append(Owner("MethodDeclaration", f"MethodDeclaration:{self.path}#{name.text}@{name.line}", False, False))
        self.scopes.append(Scope())
        self.generics.append(self.type_parameters())
        self.signature(None, None, end)
        if self.is_("{"):
            self.block()
        self.generics.pop()
        self.scopes.pop()
        self.owners.pop()

    def chain(self, stop: int, new: bool = False) -> None:
        """A name with the members after it, and what is done with it."""
        first = self.tok()
        begin = self.at
        path = [first.text]
        self.at += 1
        if new and first.kind != "word":
            self.at = begin
            if self.is_("("):
                self.bracket()
            return
        if first.text == "import" and self.is_("("):
            self.bracket()
            return
        while self.is_(".", "?.") and self.at + 1 < stop and self.tok(1).kind == "word":
            path.append(self.tok(1).text)
            self.at += 2
            self.at += self.is_("!") and self.is_(".", "(", "[", k=1)
        self._flag(path, begin)
        before = self.text_at(begin - 1)
        previous = self.tokens[begin - 1] if begin else None
        if self.is_("<") and (close := self.angle(self.at)) is not None and self.text_at(close + 1) == "(":
            self.at = close + 1
        if self.is_("?.") and self.is_("(", k=1):
            self.at += 1
        call = self.is_("(") and self.at < stop
        kind = self.lookup(path[0])
        if new:
            if len(path) == 1 and kind[0] == "module":
                self.use("INSTANTIATES", self.caller(), "name", path[0])
            elif len(path) == 2 and kind[0] == "module":
                self.use("INSTANTIATES", self.caller(), "member", path[0], path[1])
                self.use("READS", self.value_scope(), "name", path[0])
            made = path[0] if len(path) == 1 else None
            if call:
                self.bracket()
            if made and self.is_(".") and self.tok(1) is not None and self.tok(1).kind == "word":
                member = self.tok(1).text
                self.at += 2
                if self.is_("("):
                    self.use("CALLS", self.caller(), "typed", made, member)
                    self.bracket()
            return
        if path[0] not in ("this", "super", "undefined", "import") and kind[0] == "module":
            after = self.text_at(self.at)
            single = len(path) == 1
            write = single and (after in _ASSIGN or after in ("++", "--") or (before in ("++", "--") and previous.kind == "punct"))
            name_only = single and (call or (after == "=" and before not in ("(", ",")))
            if not name_only and not (single and after == "=" ):
                self.use("READS", self.value_scope(), "name", path[0])
            if write:
                self.use("WRITES", self.value_scope(), "name", path[0])
        if call:
            self._call(path, kind, begin)

    def _target(self, path: list[str], kind: tuple[str, str | None]) -> tuple | None:
        """(how, a, b, c) of what a chain names."""
        own = self.classes[-1] if self.classes else None
        if path[0] == "this" and own:
            return ("class", own, path[1], None) if len(path) == 2 else ("prop", own, path[1], path[2]) if len(path) == 3 else None
        if path[0] == "super" and own and len(path) == 2:
            return ("super", own, path[1], None)
        if kind[0] == "module":
            return ("name", path[0], None, None) if len(path) == 1 else ("member", path[0], path[1], None) if len(path) == 2 else ("deep", path[0], path[1], path[2]) if len(path) == 3 else None
        if kind[0] == "local" and kind[1]:
            return ("typed", kind[1], path[1], None) if len(path) == 2 else ("typedprop", kind[1], path[1], path[2]) if len(path) == 3 else None
        return None

    def _call(self, path: list[str], kind: tuple[str, str | None], begin: int) -> None:
        target = self._target(path, kind)
        if target:
            self.use("CALLS", self.caller(), *target)
        open_ = self.at
        if path == ["fetch"] or (len(path) == 2 and path[1] == "fetch" and path[0] in ("window", "globalThis", "self")):
            arg = self.tokens[open_ + 1]
            alone = self.text_at(open_ + 2) in (",", ")")
            literal = alone and (arg.kind == "string" or (arg.kind == "template" and not arg.inner))
            self.say("api", id=self.reader_scope(), name=host_of(unescaped(arg.text[1:-1])) if literal else "(dynamic)")
        if len(path) > 1 and path[-1] in VERBS:
            self._route(path[-1].upper(), begin, open_)
        self.bracket()
        # further members and calls of the result
        while self.is_(".", "?.") and self.tok(1) is not None and self.tok(1).kind == "word":
            verb = self.tok(1).text
            self.at += 2
            if self.is_("<") and (close := self.angle(self.at)) is not None and self.text_at(close + 1) == "(":
                self.at = close + 1
            if self.is_("("):
                if verb in VERBS:
                    self._route(verb.upper(), begin, self.at)
                self.bracket()

    def _route(self, verb: str, begin: int, open_: int) -> None:
        end = self.match(open_)
        cuts, k = [open_], open_ + 1
        while k < end:
            if self.text_at(k) == "," and self.tokens[k].kind == "punct":
                cuts.append(k)
            if self.text_at(k) == "<" and (close := self.angle(k)) is not None and self.text_at(close + 1) == "(":
                k = close
            k = self.match(k) + 1 if self.tokens[k].kind == "punct" and self.text_at(k) in _CLOSE else k + 1
        if self.text_at(end - 1) == ",":
            cuts.pop()
        if len(cuts) < 2 or self.tokens[open_ + 1].kind != "string" or self.text_at(open_ + 2) != ",":
            return
        saved, self.at = self.at, cuts[-1] + 1
        inline = self.function_here()
        first, path = self.tok(), []
        while self.tok() is not None and self.tok().kind == "word" and self.at < end:
            path.append(self.tok().text)
            self.at += 1
            if not self.is_("."):
                break
            self.at += 1
        whole = self.at >= end or (self.text_at(self.at) == "," and self.at + 1 == end)
        self.at = saved
        how, a, b, c = "inline", None, None, None
        if not inline:
            if not whole or not path:
                return
            kind = self.lookup(first.text)
            if kind[0] == "local" and len(path) == 1:
                if not any(first.text in s.callable for s in self.scopes if first.text in s.names):
                    return
            elif (found := self._target(path, kind)) is None:
                return
            else:
                how, a, b, c = found
        text = unescaped(self.tokens[open_ + 1].text[1:-1])
        self.say("endpoint", id=f"Endpoint:{verb} {text}", name=f"{verb} {text}", how=how, a=a, b=b, c=c, start_line=self.tokens[begin].line, end_line=self.tokens[end].end_line)

    def _flag(self, path: list[str], begin: int) -> None:
        """A read of ``process.env.NAME`` or ``process.env['NAME']``."""
        if path[:2] != ["process", "env"]:
            return
        name = path[2] if len(path) > 2 else None
        if name is None and (self.is_("[") or (self.is_("?.") and self.is_("[", k=1))):
            at = self.at + (1 if self.is_("[") else 2)
            if self.tokens[at].kind == "string" and self.text_at(at + 1) == "]":
                name = unescaped(self.tokens[at].text[1:-1])
        if name:
            self.say("flag", id=self.reader_scope(), name=name)


def facts(path: str, text: str) -> list[dict]:
    """Facts of a file. A file that can't be read to its end gives what came before."""
    file = File.__new__(File)
    try:
        file.__init__(path, text)
    except (RecursionError, IndexError, AttributeError):
        if not getattr(file, "rows", None):
            return [{"fact": "node", "seq": 0, "id": f"Module:{path}", "kind": "Module", "name": path}]
    return file.rows
