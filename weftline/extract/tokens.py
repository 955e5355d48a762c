"""Tokens of TypeScript text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_SKIP = re.compile(r"[ \t\r\f\v\u00a0\ufeff]+")
_WORD = re.compile(r"[#@]?[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*")
_NUMBER = re.compile(r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)n?")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.|\\\n)*'?|\"(?:[^\"\\\n]|\\.|\\\n)*\"?")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@#\\]")
_ESCAPE = re.compile(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r?\n|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "new", "delete", "void", "throw", "do", "else", "yield", "await", "instanceof"}


@dataclass
class Token:
    kind: str  # word, number, string, template, regex, punct, end
    text: str
    line: int
    start: int
    stop: int
    end_line: int
    #: Whether a line ends before it, and the last documentation comment before it.
    fresh: bool = False
    doc: str | None = None
    #: Of a template: the tokens of each of its expressions.
    inner: list[list[Token]] = field(default_factory=list)


def unescaped(literal: str) -> str:
    """The value of a string literal without its quotes."""

    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] == "u" and len(c) > 1:
            return chr(min(int(c.strip("u{}"), 16), 0x10FFFF))
        if c[0] == "x" and len(c) == 3:
            return chr(int(c[1:], 16))
        return "" if c.endswith("\n") else _PLAIN.get(c, c)

    return _ESCAPE.sub(one, literal)


def tokenize(text: str, at: int = 0, line: int = 1, nested: bool = False) -> tuple[list[Token], int, int]:
    """(tokens, place, line). With ``nested`` it ends at the brace that closes the
    expression of a template. Text that is no TypeScript gives some tokens, too."""
    out: list[Token] = []
    fresh, doc, depth, n = True, None, 0, len(text)
    while at < n:
        c = text[at]
        if c == "\n":
            line, at, fresh = line + 1, at + 1, True
            continue
        if m := _SKIP.match(text, at):
            at = m.end()
            continue
        if text.startswith("//", at) or (at == 0 and text.startswith("#!")):
            end = text.find("\n", at)
            at = n if end < 0 else end
            continue
        if text.startswith("/*", at):
            end = text.find("*/", at + 2)
            end = n if end < 0 else end + 2
            comment = text[at:end]
            if comment.startswith("/**") and len(comment) > 4:
                doc = comment
            fresh |= "\n" in comment
            line, at = line + comment.count("\n"), end
            continue
        begun, first = at, line
        token = None
        if c == "`":
            at, inner = at + 1, []
            while at < n and text[at] != "`":
                if text[at] == "\\":
                    line += text[at + 1 : at + 2] == "\n"
                    at += 2
                elif text.startswith("${", at):
                    tokens, at, line = tokenize(text, at + 2, line, True)
                    inner.append(tokens)
                else:
                    line += text[at] == "\n"
                    at += 1
            at = min(at + 1, n)
            token = Token("template", text[begun:at], first, begun, at, line, inner=inner)
        elif m := _WORD.match(text, at):
            token = Token("word", m[0], line, at, m.end(), line)
        elif m := _NUMBER.match(text, at):
            token = Token("number", m[0], line, at, m.end(), line)
        elif c in "'\"":
            m = _STRING.match(text, at)
            line += m[0].count("\n")
            token = Token("string", m[0], first, at, m.end(), line)
        elif c == "/" and _operand_next(out) and (m := _REGEX.match(text, at)):
            token = Token("regex", m[0], line, at, m.end(), line)
        elif m := _PUNCT.match(text, at):
            token = Token("punct", m[0], line, at, m.end(), line)
            if nested:
                depth += (m[0] == "{") - (m[0] == "}")
                if depth < 0:
                    return out, m.end(), line
        else:
            at += 1
            continue
        at = token.stop
        token.fresh, token.doc = fresh, doc
        fresh, doc = False, None
        out.append(token)
    return out, at, line


def _operand_next(before: list[Token]) -> bool:
    if not before:
        return True
    last = before[-1]
    if last.kind == "word":
        return last.text in _BEFORE_REGEX
    return last.kind == "punct" and last.text not in (")", "]", "}", "++", "--")
